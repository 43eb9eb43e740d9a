"""Op 10: personal data by validated patterns, plus candidates that gradient-boosted trees select.

Base spans follow fixed patterns and checks and always stay. High-recall generators propose further,
looser and overlapping spans (spelled-out addresses, numbers grouped in other ways). Trees judge them by
format and context. They learn from a bounded sample of texts: into each, values of two kinds in
disguise and look-alikes of two kinds are written at random places. Base spans and disguised values are
positive; look-alikes and all other candidates of the sample are negative, but for those that carry the
mark of a disguised value (``doubtful``), which teach nothing. Texts are split in two by their
hash: one half fits the trees, the other sets each kind's threshold, the least from 0.5 on that reaches ``precision`` there. Accepted spans that overlap no base span and no better accepted span are added.
One narrow pass over whole texts.

Null text is empty. Repeated rows give equal results, and teach once. Without examples nothing is added.
"""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import boosting

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match starts within a run of digits: one that starts at its beginning goes as far
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
AT, DOT = r"(?:@|[(\[]at[)\]]| at )", r"(?:\.|[(\[]dot[)\]]| dot )"
#: Looser shapes of each kind.
LOOSE = (
    ("email", re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+-]{{0,63}} ?{AT} ?[A-Za-z0-9-]{{1,63}}(?: ?{DOT} ?[A-Za-z0-9-]{{2,63}}){{1,4}}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|[(\[]dot[)\]]| dot ) ?[0-9]{1,3}){3}(?![0-9])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._/-]{0,2}[0-9]{3,6}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9])(?:\+|00)?(?:[0-9(][0-9() ./-]{5,22}[0-9])(?![0-9])")),
)
#: Words that stand beside personal data.
CUES = ("mail", "email", "contact", "write", "phone", "tel", "call", "mobile", "fax", "card", "visa", "account", "ip", "address", "host", "server")
WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 if len(p) < 400 else not p.strip("0")[3:] and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= len(DIGIT.findall(m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    if not DIGIT.search(text) and "@" not in text and not MAY_AT.search(text):
        return []
    return [(kind, *m.span()) for kind, pattern in LOOSE for m in pattern.finditer(text)]


MAY_AT = re.compile(r"[ (\[]at[)\] ]")
BRACKETED = re.compile(r"[(\[](?:at|dot|\.)[)\]]")
SPELLED = re.compile(r" dot ")


def describe(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    s = text[start:end]
    digits = [c for c in s if c.isascii() and c.isdigit()]
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g] or [0]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    near = WORD.findall(before.lower())[-4:] + WORD.findall(after.lower())[:2]
    entropy = -sum(p * math.log2(p) for p in (digits.count(c) / len(digits) for c in set(digits))) if digits else 0.0
    marks = set(re.findall(r"[^0-9A-Za-z]+", s))
    last = re.split(r"[^A-Za-z0-9]+", s)[-1]
    row = [
        KINDS.index(kind), len(s), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1], groups.count(4), sum(c.isalpha() for c in s), sum(c.isupper() for c in s),
        s.count(" "), s.count("-"), s.count("."), s.count("/"), s.count("("), s.count("@"), s.count(". "), len(marks), s[:1] == "+", s[:2] == "00", len(BRACKETED.findall(s)), len(SPELLED.findall(s)), " at " in s, len(last),
        luhn("".join(digits)) if digits else -1, entropy, len(set(digits)), sum(w in CUES for w in near), before[-1:].isalnum(), after[:1].isalnum(), before[-1:] in "\n\t .,;:", before.endswith("="), before[-1:] in "\"'", "v" in near or "version" in near, sum(c.isdigit() for c in before + after),
    ]
    return [float(x) for x in row]


def doubtful(text: str, kind: str, start: int, end: int) -> bool:
    """Whether a candidate that is no base span carries the mark of a disguised value, so that it may well be one."""
    s = text[start:end]
    digits = "".join(c for c in s if c.isascii() and c.isdigit())
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return s[0] == "+" or (s[:2] == "00" and not s.isdigit()) or s[0] == "("
    return bool(BRACKETED.search(s) or SPELLED.search(s)) or (kind == "email" and "@" in s)


def _number(rng, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _word(rng, least: int = 3, most: int = 10) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(least, most)))


def _card_number(rng, valid: bool) -> str:
    n = rng.choice((15, 16, 16, 16))
    head = str(rng.randint(1, 9)) + _number(rng, n - 2)
    return next(head + c for c in "0123456789" if luhn(head + c)) if valid else next(head + c for c in rng.sample("0123456789", 10) if not luhn(head + c))


def _grouped(rng, digits: str, separators: str) -> str:
    sizes = (4, 6, 5) if len(digits) == 15 else (4, 4, 4, 4)
    sep, out, at = rng.choice(separators), [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return sep.join(out)


def disguised(rng, kind: str) -> str:
    """A value of the kind as people write it past simple patterns."""
    if kind == "email":
        local = _word(rng) + rng.choice(("", "." + _word(rng), "_" + _word(rng), _number(rng, 2)))
        labels = [_word(rng) for _ in range(rng.choice((1, 1, 2)))] + [rng.choice(("com", "org", "net", "de", "fr", "es", "io"))]
        at = rng.choice((" (at) ", " [at] ", "(at)", "[at]", " at ", " @ "))
        dots = (" (dot) ", " [dot] ", "(dot)", "[dot]", " dot ")
        dot = rng.choice(dots if at == " at " else (*dots, "."))
        return local + at + labels[0] + "".join((dot if i == len(labels) - 2 else rng.choice((dot, "."))) + x for i, x in enumerate(labels[1:]))
    if kind == "ip":
        return rng.choice((" . ", "[.]", " (dot) ", "(dot)", " [dot] ", " dot ")).join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        return _grouped(rng, _card_number(rng, True), "._/")
    if rng.random() < 0.5:
        groups = [_number(rng, rng.randint(2, 4)) for _ in range(rng.randint(2, 3))] if rng.random() < 0.5 else [_number(rng, rng.randint(2, 3)), _number(rng, rng.randint(5, 8))]
        return "00" + rng.choice(("1", "33", "34", "44", "49", "351", "420")) + " " + rng.choice(" -/").join(groups)
    return f"({_number(rng, 3)}) {_number(rng, 3)}{rng.choice('-. ')}{_number(rng, 4)}"


def look_alike(rng, kind: str) -> str:
    """Text that the generators propose and that is no personal data."""
    year, day = rng.randint(1900, 2030), f"{rng.randint(1, 28):02d}"
    if kind == "email":
        return rng.choice((f"{_word(rng)} at {_word(rng)}. {_word(rng).title()}", f"{rng.randint(1, 99)} @ {rng.randint(1, 99)}.{_number(rng, 2)}", f"{_word(rng)} at {_word(rng)}.{_word(rng)}", f"@{_word(rng)}.{_word(rng)}"))
    if kind == "ip":
        return ".".join(str(rng.randint(256, 999)) for _ in range(4)) if rng.random() < 0.5 else rng.choice((" . ", ". ")).join(str(rng.randint(1, 999)) for _ in range(4))
    if kind == "card":
        digits = _card_number(rng, False)
        return rng.choice((digits, _grouped(rng, digits, " -._/")))
    return rng.choice((f"{year}-{day}-{day} {day}", f"{day}/{day}/{year}", f"{year}-{year + 4} {year + 9}", _number(rng, rng.randint(7, 12)), "00" + _number(rng, rng.randint(6, 10)), f"978-{rng.randint(0, 9)}-{_number(rng, 2)}-{_number(rng, 6)}-{_number(rng, 1)}", f"{rng.randint(1, 9)}.{_number(rng, 3)}.{_number(rng, 3)}", f"{rng.randint(1, 99)} {_number(rng, 3)} {_number(rng, 3)}"))


def examples(text: str, rng) -> list[tuple[list[float], int]]:
    """(features, label) of a text's own candidates and of values written into it."""
    sure = set(base_spans(text))
    out = [(describe(text, *c), int(c in sure)) for c in candidates(text) if c in sure or not doubtful(text, *c)]
    kinds = rng.sample(KINDS, 4)
    for i, kind in enumerate(kinds):
        value = disguised(rng, kind) if i < 2 else look_alike(rng, kind)
        at = text.find(" ", rng.randint(0, max(0, len(text) - 1)))
        at = len(text) if at < 0 else at
        lead = rng.choice((" ", " ", f" {rng.choice(CUES)} ", f" {rng.choice(CUES)}: "))
        head, tail = text[max(0, at - 60) : at] + lead, rng.choice((" ", ", ", ". ")) + text[at + 1 : at + 60]
        here, lo, hi = head + value + tail, len(head), len(head) + len(value)
        for k, s, e in candidates(here):
            if s < hi and lo < e:
                exact = (k, s, e) == (kind, lo, hi)
                if i >= 2 or exact or k != kind:
                    out.append((describe(here, k, s, e), int(i < 2 and exact)))
    return out


def _sample(docs: DataFrame, texts: int) -> DataFrame:
    """(part, x, y) of the examples of the first texts by hash of their id, one text an id; by the hash of the text, part 0 is to fit, part 1 to calibrate."""
    ids = docs.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts)
    one = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m"))

    def run(batches):
        for b in batches:
            got = [(d % 2, *e) for d, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for e in examples(t or "", random.Random(h))]
            part, x, y = zip(*got, strict=True) if got else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(x, pa.list_(pa.float64())), pa.array(y, pa.int32())], names=["part", "x", "y"])

    return one.select(F.pmod(F.xxhash64("m.h"), F.lit(2)).cast("int").alias("part"), F.col("m.h").alias("h"), F.col("m.text").alias("text")).mapInArrow(run, "part int, x array<double>, y int")


def learn(docs: DataFrame, texts: int = 4000, spans: int = 20_000, precision: float = 0.98) -> tuple[boosting.Trees, dict[str, float]]:
    """The trees, and the threshold of every kind, from docs (doc_id, text)."""
    got = _sample(docs, texts).orderBy(F.xxhash64("x", "part"), "x", "part", "y").limit(spans).collect()
    part, x, y = np.array([r["part"] for r in got]), np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    if not (part == 0).any():
        return boosting.Trees(-1.0, 1), {}
    model = boosting.fit(x[part == 0], y[part == 0], rounds=80, depth=4)
    held, kinds, p = y[part == 1], x[part == 1][:, 0], model.probability(x[part == 1])
    return model, {k: max(0.5, boosting.threshold_for(p[kinds == i], held[kinds == i], precision)) for i, k in enumerate(KINDS)}


def added_spans(text: str, sure: list, trees: boosting.Trees, cuts: dict[str, float]) -> list[tuple[str, int, int]]:
    """Candidates beyond the base spans that the trees accept, the best of overlapping ones."""
    taken = sorted((s, e) for _, s, e in sure)
    found = [c for c in candidates(text) if not any(a < c[2] and c[1] < b for a, b in taken)] if cuts else []
    if not found:
        return []
    p = trees.probability(np.array([describe(text, *c) for c in found]))
    out: list[tuple[str, int, int]] = []
    for i in sorted(range(len(found)), key=lambda i: (-p[i], found[i][1], found[i][0])):
        kind, s, e = found[i]
        if p[i] >= cuts[kind] and not any(a < e and s < b for _, a, b in out):
            out.append(found[i])
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_texts: int = 4000, sample_spans: int = 20_000, precision: float = 0.98) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(learn(d, sample_texts, sample_spans, precision))

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                sure = base_spans(text)
                spans = sorted(sure + added_spans(text, sure, *shared.value), key=lambda c: (KINDS.index(c[0]), c[1]))
                line = lambda cs: ",".join(f"{k}:{s}:{e}" for k, s, e in cs)
                rows.append((*(sum(c[0] == k for c in sure) for k in KINDS), hashlib.sha256(line(sure).encode()).hexdigest(), line(spans)))
            cols = zip(*rows, strict=True) if rows else ((),) * 6
            kinds = (pa.int64(),) * 4 + (pa.string(),) * 2
            cols = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return d.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
