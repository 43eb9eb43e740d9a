"""Op 4: toxicity by a factorization machine over hashed terms.

A document's terms are its distinct lower-cased words and the leading 4 and 5 letters of each, hashed
to 30 bits. The machine adds a weight for every term and, for every pair of terms, the product of two
short learned vectors, so a pair can count that its single terms do not. It is fitted on at most
``sample_rows`` labelled documents (the first by hash of doc_id) over the ``features`` terms whose counts
in that sample depend most on the label (chi-squared); the model's size is bounded by these two
parameters, and it is broadcast. Scoring is one narrow pass over whole texts.

Null and empty texts have no terms and get the machine's base score. With no labelled rows every score
is 0. Repeated rows score alike; of rows with one doc_id, that of the least hash of its text teaches. Rows with null labels or ids teach nothing; of contradicting labels
for one doc_id, toxic wins. Extra columns pass through ``score`` untouched.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.runtime import materialise

BITS = 30
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 500_000
THRESHOLD = 0.7


def hashed(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << BITS) - 1)


def terms(word: str) -> tuple[int, ...]:
    return (hashed(word), hashed("4 " + word[:4]), hashed("5 " + word[:5]))


def vocabulary(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Machine:
    """ids: sorted hashes of the terms in use; w and v have a row for each; constant is used if there are none."""

    ids: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, present: np.ndarray) -> float:
        s = self.v[present].sum(axis=0)
        return self.w0 + self.w[present].sum() + 0.5 * float((s * s).sum() - (self.v[present] ** 2).sum())


def fit_machine(x: np.ndarray, y: np.ndarray, ids: np.ndarray, rank: int = 4, rounds: int = 400, decay: float = 2e-5, seed: int = 7) -> Machine:
    """Full-batch Adam on logistic loss with weight decay; x is rows by terms, 0 or 1."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    p = [np.array([np.log((y.sum() + 1) / (n - y.sum() + 1))]), np.zeros(m), rng.normal(0, 0.01, (m, rank))]
    x = x.astype(np.float32)
    moments = [(np.zeros_like(a), np.zeros_like(a)) for a in p]
    for t in range(1, rounds + 1):
        w0, w, v = p
        xv = x @ v.astype(np.float32)
        z = w0 + x @ w.astype(np.float32) + 0.5 * ((xv**2).sum(axis=1) - x @ (v**2).sum(axis=1).astype(np.float32))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        xg = x.T @ g.astype(np.float32)
        grads = [np.array([g.sum()]), xg + decay * w, x.T @ (g[:, None] * xv).astype(np.float32) - v * xg[:, None] + decay * v]
        for a, d, (m1, m2) in zip(p, grads, moments, strict=True):
            m1 += 0.1 * (d - m1)
            m2 += 0.01 * (d * d - m2)
            a -= 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Machine(ids, float(p[0][0]), p[1], p[2])


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 6000, features: int = 256, least: int = 3) -> Machine:
    """The machine for labels of documents that are not held out."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    known = known.filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)

    def run(batches):
        for b in batches:
            out = [sorted({h for w in vocabulary(t.as_py()) for h in terms(w)}) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int32()))], names=["y", "fs"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    one = texts.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("m")).select("y", "m.text")
    sample = materialise(one.mapInArrow(run, "y int, fs array<int>"), "labelled-sample")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return Machine(np.zeros(0, np.int32), -np.inf, np.zeros(0), np.zeros((0, 1)))
    c = sample.select("y", F.explode("fs").alias("f")).groupBy("f").agg(F.count("*").alias("c"), F.sum("y").alias("p")).filter(F.col("c") >= least)
    off = F.col("p") * F.lit(n) - F.col("c") * F.lit(pos)
    best = c.select("f", (off * off / (F.col("c") * (F.lit(n) - F.col("c") + 1.0))).alias("chi")).orderBy(F.desc("chi"), "f").limit(features)
    ids = np.array(sorted(r["f"] for r in best.collect()), np.int32)
    rows = sample.select("y", F.array_intersect("fs", F.lit(ids.tolist()) if len(ids) else F.array().cast("array<int>")).alias("fs")).collect()
    x = np.zeros((len(rows), len(ids)), np.float32)
    for i, r in enumerate(rows):
        x[i, np.searchsorted(ids, r["fs"])] = 1
    return fit_machine(x, np.array([r["y"] for r in rows], float), ids)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with out_col: the probability that a text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = shared.value
        at = {int(h): i for i, h in enumerate(m.ids)}
        known: dict[str, tuple[int, ...]] = {}
        out = np.zeros(len(texts))
        for i, t in enumerate(texts):
            present: set[int] = set()
            for w in vocabulary(t):
                k = known.get(w)
                if k is None:
                    if len(known) >= CACHE_WORDS:
                        known.clear()
                    k = known[w] = tuple(at[h] for h in terms(w) if h in at)
                if k:
                    present.update(k)
            out[i] = m.margin(np.fromiter(sorted(present), np.int64, len(present)))
        with np.errstate(over="ignore"):
            return pd.Series(1 / (1 + np.exp(-out)))

    return docs.withColumn(out_col, of(F.col(text_col)))


def predicted(score_col: str = "score", threshold: float = THRESHOLD) -> Column:
    return (F.col(score_col) >= threshold).cast("int")
