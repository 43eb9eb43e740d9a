"""Op 13 against brute force, and its edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from cadenza.llm import repeats

SCHEMA = "doc_id long, text string, h long, rid string, at int, c string"


def brute(texts, words=13):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts]
    first = {}
    for d, ws in split:
        if d is not None:
            for s in range(len(ws) - words + 1):
                g = tuple(ws[s : s + words])
                first[g] = min(first.get(g, d), d)
    out = []
    for d, ws in split:
        gone = np.zeros(len(ws), bool)
        for s in range(len(ws) - words + 1):
            if d is not None and first[tuple(ws[s : s + words])] < d:
                gone[s : s + words] = True
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((d, len(ws), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, "y") for d, t in rows], SCHEMA)


def got(df):
    rows = df.collect()
    for r in rows:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"].split()) == r["n_words"] - r["n_removed"]
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=repr)


def test_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sum(x[2] for x in want) > 1000
    assert got(repeats.remove_repeats(docs)) == want


@pytest.mark.parametrize("crowd, frequent, stretch, chunk", [(2000, 32, 1 << 18, 20_000), (0, 1, 50, 10), (3, 2, 300, 40), (10**9, 32, 64, 1)])
def test_few_words_and_many_borders(spark, monkeypatch, crowd, frequent, stretch, chunk):
    """Texts of few different words repeat at all lengths and places; every way of dealing anchors gives one result."""
    for name, value in (("CROWD", crowd), ("FREQUENT", frequent), ("SAMPLE", 2), ("STRETCH", stretch), ("CHUNK", chunk)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(crowd)
    parts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(8, 40))) for _ in range(12)]
    texts = [(rng.randint(0, 60), "  ".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice("abc") for _ in range(rng.randint(1, 9)))) for _ in range(80)]
    docs = frame(spark, texts).repartition(5)
    assert got(repeats.remove_repeats(docs)) == brute(texts)
    assert got(repeats.remove_repeats(docs, words=7, gram=3)) == brute(texts, 7)


def test_exact_length_and_borders(spark):
    w = [f"w{i}" for i in range(40)]
    texts = [(1, " ".join(w)), (2, "x " + " ".join(w[5:18]) + " y"), (3, "q " + " ".join(w[5:17]) + " y"), (4, " ".join(w[:13])), (5, "\t".join(w[27:]) + "\n"), (6, "W" + " ".join(w[27:])), (7, " ".join(w[10:25]) + " " + " ".join(w[:30]))]
    out = got(repeats.remove_repeats(frame(spark, texts)))
    assert out == brute(texts)
    assert [x[2] for x in out] == [0, 13, 0, 13, 13, 0, 45]


def test_hot_passage_and_copies(spark, monkeypatch):
    """A third of the documents are one text, and one passage stands in most others between other words."""
    monkeypatch.setattr(repeats, "CROWD", 50)
    passage = " ".join(f"p{i}" for i in range(20))
    rng = random.Random(4)
    other = lambda: " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20)))
    texts = [(i, "copy " * 3 + passage[::-1] + " tail " * 20) for i in range(100)] + [(100 + i, f"{other()} {passage} {other()}") for i in range(200)]
    assert got(repeats.remove_repeats(frame(spark, texts).repartition(16))) == brute(texts)


def test_edge_cases(spark):
    """Null and empty texts, null and repeated ids, repeated rows, a very long text with very long words."""
    same = " ".join(f"s{i}" for i in range(30))
    long = " ".join(f"w{i * 7919 % 1000} the" for i in range(60_000)) + " " + "z" * 3_000_000 + " end"
    texts = [(1, None), (2, ""), (3, same), (3, same), (3, "a " + same), (4, same), (None, same), (None, None), (5, long), (6, long), (7, " \n\t "), (8, "é ü 　x y " * 9), (9, "é ü 　x y " * 9)]
    assert got(repeats.remove_repeats(frame(spark, texts))) == brute(texts)
    assert repeats.remove_repeats(frame(spark, [])).collect() == []
