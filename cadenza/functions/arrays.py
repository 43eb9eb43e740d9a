"""Column functions over arrays of samples, spectra and class scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-10


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(values: dict[str, Column], use) -> Column:
    """use(struct) with the values computed once for a row, not once for every element of a lambda that names them."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), use), F.lit(0))


def total(a: Column | str, of=lambda x: x) -> Column:
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + of(x))


def mean_of(a: Column | str) -> Column:
    """Mean of the non-null elements, null if there are none."""
    there = F.filter(col(a), lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, total(there) / F.size(there))


def rms(a: Column | str) -> Column:
    return F.sqrt(total(a, lambda x: x * x) / F.size(col(a)))


def db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(FLOOR)))


def peak(a: Column | str) -> Column:
    return F.array_max(F.transform(col(a), F.abs))


def chunks(a: Column | str, size: int) -> Column:
    """Neighbouring pieces of ``size`` elements; the last may be shorter."""
    a = col(a)
    return F.transform(F.sequence(F.lit(0), F.size(a) - 1, F.lit(size)), lambda i: F.slice(a, i + 1, size))


def padded_windows(a: Column | str, size: int) -> Column:
    """Neighbouring windows of ``size`` elements, the last one filled up with zeros; none of an empty array."""
    return F.when(F.size(col(a)) > 0, F.transform(chunks(a, size), lambda w: F.concat(w, F.array_repeat(F.lit(0.0), size - F.size(w))))).otherwise(F.array().cast("array<array<double>>"))


def overlapping_frames(a: Column | str, size: int, step: int) -> Column:
    """Whole frames of ``size`` elements that start every ``step``; none of an array under a frame."""
    a = col(a)
    starts = F.sequence(F.lit(1), F.size(a) - size + 1, F.lit(step))
    return F.when(F.size(a) >= size, F.transform(starts, lambda i: F.slice(a, i, size))).otherwise(F.array().cast("array<array<double>>"))


def quantile(a: Column | str, q: float) -> Column:
    """Linear interpolation over the sorted elements."""
    s = F.array_sort(col(a))
    at = (F.size(s) - 1) * q
    lo = F.floor(at).cast("int")
    return F.get(s, lo) + (at - lo) * (F.get(s, F.least(lo + 1, F.size(s) - 1)) - F.get(s, lo))


ENERGY_METRICS = ("whole_rms", "max_frame_rms", "p95_frame_rms", "top3_frame_rms")


def energy_dbfs(a: Column | str, frame: int, metric: str = "max_frame_rms") -> Column:
    """A segment's level in dB by one of four metrics; a partial last frame counts; segments under a frame use the whole."""
    if metric not in ENERGY_METRICS:
        raise ValueError(f"metric must be one of {ENERGY_METRICS}")
    a = col(a)
    if metric == "whole_rms" or frame <= 0:
        return db(rms(a))
    per = F.transform(chunks(a, frame), rms)
    if metric == "max_frame_rms":
        value = F.array_max(per)
    elif metric == "p95_frame_rms":
        value = quantile(per, 0.95)
    else:
        top = F.slice(F.sort_array(per, asc=False), 1, 3)
        value = total(top) / F.size(top)
    return db(F.when(F.size(a) < frame, rms(a)).otherwise(value))


def zero_crossing_rate(a: Column | str) -> Column:
    a = col(a)
    n = F.size(a)
    sign = lambda x: (x < 0).cast("int")
    crossed = F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1), lambda x, y: F.abs(sign(x) - sign(y)).cast("double"))
    return total(crossed) / F.greatest(n - 1, F.lit(1))


def flatness(power: Column | str) -> Column:
    """Geometric over arithmetic mean."""
    p = F.transform(col(power), lambda x: F.greatest(x, F.lit(1e-12)))
    return F.exp(total(p, F.log) / F.size(p)) / (total(p) / F.size(p))


def centroid(spectrum: Column | str, width_hz: float) -> Column:
    """Mean frequency by magnitude; 0 for a silent spectrum."""
    s = col(spectrum)
    weighted = total(F.transform(s, lambda x, i: x * i * F.lit(width_hz)))
    return F.when(total(s) > 0, weighted / total(s)).otherwise(0.0)


def flux(now: Column | str, before: Column | str) -> Column:
    """Sum of rises against the previous vector; 0 without one."""
    return F.coalesce(total(F.zip_with(col(now), col(before), lambda x, y: F.greatest(x - y, F.lit(0.0)))), F.lit(0.0))


def voiced_confidence(a: Column | str, low: int, high: int) -> Column:
    """Largest autocorrelation at lags low..high over that at lag 0, of the centred samples; 0 for constant ones."""
    a = col(a)
    product = lambda x, k: total(F.zip_with(F.slice(x, F.lit(1), F.size(x) - k), F.slice(x, k + 1, F.size(x) - k), lambda p, q: p * q))

    def of(x: Column, zero: Column) -> Column:
        best = F.array_max(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: product(x, k)))
        return F.when(zero > 0, F.greatest(best / zero, F.lit(0.0))).otherwise(0.0)

    centred = bound({"a": a, "m": total(a) / F.size(a)}, lambda s: F.transform(s["a"], lambda v: v - s["m"]))
    return bound({"x": centred}, lambda s: bound({"x": s["x"], "z": total(s["x"], lambda v: v * v)}, lambda t: of(t["x"], t["z"])))


def fit_length(noise: Column | str, n: Column) -> Column:
    """noise repeated or cut to n samples."""
    noise = col(noise)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(noise, i % F.size(noise)))).otherwise(F.array().cast("array<double>"))


def power(a: Column | str) -> Column:
    return total(a, lambda x: x * x) / F.size(col(a))


def mix_at_snr(speech: Column | str, noise: Column | str, snr_db: Column) -> Column:
    """speech plus noise scaled to the SNR; speech alone if either has no power."""
    speech, noise = col(speech), col(noise)

    def mixed(b: Column) -> Column:
        gain = F.sqrt(b["ps"] / (b["pn"] * F.pow(F.lit(10.0), b["snr"] / 10)))
        add = bound({"s": b["s"], "n": b["n"], "g": gain}, lambda c: F.zip_with(c["s"], c["n"], lambda x, y: x + c["g"] * y))
        return F.when((b["ps"] > 0) & (b["pn"] > 0), add).otherwise(b["s"])

    fitted = bound({"n": noise, "k": F.size(speech)}, lambda b: fit_length(b["n"], b["k"]))
    powers = lambda b: bound({"s": b["s"], "n": b["n"], "snr": b["snr"], "ps": power(b["s"]), "pn": power(b["n"])}, mixed)
    return bound({"s": speech, "n": fitted, "snr": snr_db}, powers)


def renorm(a: Column | str, target: float = 0.95) -> Column:
    """Struct (samples, clipped): scaled to the target peak if the peak is over 1."""

    def scaled(b: Column) -> Column:
        samples = F.when(b["p"] > 1, F.transform(b["a"], lambda x: x * (target / b["p"]))).otherwise(b["a"])
        return F.struct(samples.alias("samples"), (b["p"] > 1).alias("clipped"))

    return bound({"a": col(a)}, lambda b: bound({"a": b["a"], "p": peak(b["a"])}, scaled))


def uniform_windows(a: Column | str, size: int, most: int) -> Column:
    """Up to ``most`` windows of ``size`` at an even stride (half to even); the whole if shorter; the centre if most is 1."""
    a = col(a)
    n = F.size(a)
    k = F.least(F.lit(most), F.floor(n / size).cast("int"))
    stride = F.when(k > 1, (n - size) / (k - 1)).otherwise(0.0)
    starts = F.when(k == 1, F.array(F.floor((n - size) / 2).cast("int"))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), lambda i: F.bround(i * stride).cast("int")))
    return F.when(n <= size, F.array(a)).otherwise(F.transform(starts, lambda s: F.slice(a, s + 1, size)))


def policies(probs: Column | str, target: list[int], speech: list[int], classes: int | None = None) -> dict[str, Column]:
    """Reject scores of a class vector: max and sum over target classes, and max target less max speech-like class."""
    p = col(probs)
    if classes is not None:
        p = F.when(F.size(p) == classes, p).otherwise(F.raise_error(F.format_string("%d classes, not %d", F.size(p), F.lit(classes))))
    pick = lambda ix: F.transform(F.lit(ix), lambda i: F.get(p, i))
    return {"max": F.array_max(pick(target)), "sum": total(pick(target)), "target_minus_speech": F.array_max(pick(target)) - F.array_max(pick(speech))}


def amplitude(db_value: float) -> float:
    return 0.0 if db_value == -math.inf else 10 ** (db_value / 20)
