"""Per-row decisions: confidence filter, energy gate, drop reasons, outcome rules and UI event checks."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import inf, isnan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.text import first_word


@dataclass(frozen=True)
class FilterConfig:
    """Fixed default values of the confidence filter. Comparisons are strict."""

    no_speech: float = 0.71
    token_confidence: float = 0.001
    avg_logprob: float | None = -1.0
    avg_logprob_by_engine: dict[str, float] = field(default_factory=lambda: {"reazonspeech": -0.40, "qwen3-asr": -0.42})


SIGNALS = ("no_speech_prob", "token_confidence_mean", "avg_logprob")


def rejected_by(config: FilterConfig = FilterConfig(), engine: str = "engine_name") -> Column:
    """Which signal rejects the row, or null. The log-probability decides only where it is the only signal."""
    nsp, tcm, alp = map(F.col, SIGNALS)
    by_engine = F.create_map(*(F.lit(x) for kv in config.avg_logprob_by_engine.items() for x in kv)) if config.avg_logprob_by_engine else None
    own = F.try_element_at(by_engine, first_word(engine)) if by_engine is not None else F.lit(None).cast("double")
    threshold = F.coalesce(own, F.lit(config.avg_logprob).cast("double"))
    only = nsp.isNull() & tcm.isNull()
    return F.when(nsp > config.no_speech, "no_speech_prob").when(tcm < config.token_confidence, "token_confidence_mean").when(only & (alp < threshold), "avg_logprob")


MODES = ("off", "observe", "on")


def filter_outputs(rows: DataFrame, mode: str, config: FilterConfig = FilterConfig()) -> tuple[DataFrame, DataFrame]:
    """(kept rows, decision log): off decides nothing, observe logs all and keeps all, on logs and removes rejects."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    decided = rows.withColumn("reason", rejected_by(config)).withColumn("decision", F.when(F.col("reason").isNull(), "pass").otherwise("reject"))
    if mode == "off":
        return rows, decided.limit(0)
    if mode == "observe":
        return rows, decided
    return decided.filter("reason is null").select(*rows.columns), decided.filter("reason is not null")


def energy_passes(energy: Column, threshold_dbfs: float) -> Column:
    """Whether a segment stays: its energy isn't strictly below the threshold; -inf turns the gate off."""
    if isnan(threshold_dbfs) or threshold_dbfs == inf:
        raise ValueError("the threshold must be a number or -inf")
    return F.lit(True) if threshold_dbfs == -inf else energy >= threshold_dbfs


def drop_reason(empty_audio: Column, low_energy: Column, error: Column, rejected: Column, text: Column) -> Column:
    """The first guard that drops a segment, or null. error: an exception's name or null."""
    return F.when(empty_audio, "empty_audio").when(low_energy, "energy_gate").when(error.isNotNull(), F.concat(F.lit("engine_error:"), error)).when(rejected, "filter_reject").when(F.trim(text) == "", "engine_empty")


def outcome_violations(reason: Column, text: Column, called: Column) -> Column:
    """Names of the rules that an outcome breaks."""
    rules = {
        "empty_reason": reason == "",
        "reason_with_text": reason.isNotNull() & (text != ""),
        "energy_after_call": (reason == "energy_gate") & called,
        "reject_without_call": reason.isin("filter_reject", "engine_empty") & ~called,
        "emitted_without_call": reason.isNull() & ~called,
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))


#: The keys that each type of UI event must have.
REQUIRED = {
    "transcription": ("text", "source_id", "is_final", "timestamp", "event_type"),
    "status": ("event_type", "status_code", "message", "timestamp", "source_id"),
    "error": ("event_type", "error_code", "message", "timestamp", "source_id"),
    "translation_request": ("event_type", "text", "source_id", "source_language", "target_language", "timestamp"),
    "translation_result": ("event_type", "original_text", "translated_text", "source_id", "source_language", "target_language", "timestamp"),
    "subtitle": ("event_type", "text", "source_id", "destination", "is_translated", "timestamp"),
}
DESTINATIONS = ("obs", "vrchat")


def has(raw: Column | str, *keys: str) -> Column:
    """Whether a JSON object has all keys, null values included."""
    got = F.json_object_keys(raw)
    out = F.lit(True)
    for k in keys:
        out = out & F.coalesce(F.array_contains(got, k), F.lit(False))
    return out


def valid_event(raw: Column | str) -> Column:
    """Whether a raw JSON event has its type's keys; without a type, text and source_id; unknown types are invalid."""
    kind = F.get_json_object(raw, "$.event_type")
    out = F.when(kind.isNull(), has(raw, "text", "source_id"))
    for k, keys in REQUIRED.items():
        out = out.when(kind == k, has(raw, *keys))
    return out.otherwise(False)


def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def rehydrate(raw: Column | str) -> Column:
    """Struct of a repaired transcription event, or null if no text is found."""
    g = lambda k: F.get_json_object(raw, f"$.{k}")
    text = F.coalesce(_full(g("text")), _full(g("metadata.text")), _full(g("display_text")), _full(g("status")))
    final = F.coalesce(g("is_final"), g("metadata.is_final"), F.lit("false")) == "true"
    stamp = F.coalesce(g("timestamp"), g("metadata.timestamp")).cast("double")
    event = F.struct(text.alias("text"), F.coalesce(g("source_id"), F.lit("unknown")).alias("source_id"), final.alias("is_final"), stamp.alias("timestamp"), F.coalesce(g("phase"), F.when(final, "final").otherwise("interim")).alias("phase"))
    return F.when(text.isNotNull(), event)


def route(raw: Column | str) -> Column:
    """The event type that an untyped JSON object normalises to by the keys it has, or null; a typed one keeps a valid or repairable type."""
    kind = F.get_json_object(raw, "$.event_type")
    typed = F.when(valid_event(raw), F.coalesce(kind, F.lit("transcription"))).when((kind == "transcription") & rehydrate(raw).isNotNull(), "transcription")
    free = F.when(has(raw, "text", "source_id"), "transcription").when(has(raw, "status_code", "message"), "status").when(has(raw, "error_code", "message"), "error")
    return F.when(has(raw, "event_type"), typed).otherwise(free)


def valid_translation(source: Column, target: Column) -> Column:
    return source != target


def valid_destination(destination: Column) -> Column:
    return F.coalesce(destination.isin(*DESTINATIONS), F.lit(False))
