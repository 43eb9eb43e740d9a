"""Op 11 against brute force, and its edge cases."""

import random
import re
import zlib

import numpy as np
import pytest

from cadenza.llm import spelling


def brute(texts, least_length=6, least_count=5, every=199, times=5):
    n = {}
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_length:
                n[w] = n.get(w, 0) + 1
    n = {w: k for w, k in n.items() if k >= least_count}
    return n, brute_variants(n, times)


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n, times=5):
    out = {}
    for w in n:
        ns = [x for x in n if near(w, x)]
        best = min(ns, key=lambda x: (-n[x], x)) if ns else None
        out[w] = (len(ns), best if ns and n[best] >= times * n[w] else None)
    form = {w: f for w, (_, f) in out.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (k, n[w], f, n[f] if f else None, root(w)) for w, (k, f) in out.items()}


def got(df):
    return {r["word"]: (r["n_near"], r["n"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    n, want = brute(texts)
    assert len(want) > 100 and any(x[2] for x in want.values())
    assert got(spelling.variants(spelling.vocabulary(docs))) == want


def random_words(seed, k=300, letters="abÀÿz"):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(3, 6))): rng.choice([5, 6, 30, 31, 200, 5000]) for _ in range(k)}


@pytest.mark.parametrize("blocks", [1 << 20, 7])
def test_dense_vocabulary_in_one_or_many_rounds(spark, monkeypatch, blocks):
    """Nearly every edit is a word; with few blocks a length has several parts and the shards take turns."""
    monkeypatch.setattr(spelling, "BLOCKS", blocks)
    n = random_words(1)
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    turns = spelling.shards(words)
    assert (len(turns) > 3) == (blocks == 7) and all(sum(x[3] for x in t) <= blocks for t in turns)
    assert got(spelling.variants(words)) == brute_variants(n)


def test_chains_and_ties(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 3000, "bbbbbb": 7, "bbbbb": 35, "bbbbbbb": 35, "zzzzzz": 9}
    out = got(spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert out == brute_variants(n)
    assert out["aaaaaa"][4] == "aaabbb" and out["bbbbbb"][2] == "bbbbb" and out["zzzzzz"] == (0, 9, None, None, "zzzzzz")


def test_filters_have_no_false_negatives_and_few_false_positives(spark):
    rng = random.Random(3)
    ws = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(4000)]
    words = spark.createDataFrame([(w, 5) for w in set(ws)], "word string, n long")
    (turn,) = spelling.shards(words)
    shard = spelling.build_filters(words, turn)[8]
    assert spelling.known(spelling.word_hash(spelling.codes_of(ws, 8)), shard).all()
    other = ["".join(rng.choice("qrstuvwxyz") for _ in range(8)) for _ in range(20_000)]
    assert spelling.known(spelling.word_hash(spelling.codes_of(other, 8)), shard).mean() < 0.005


def test_hashes_of_edits_are_those_of_the_words():
    ws = ["abcdef", "ffffff", "zÿzÿzÿ"]
    codes = spelling.codes_of(ws, 6)
    gone = spelling.deletion_hashes(codes)
    alphabet = np.array([ord(c) for c in "axÿ"], np.uint64)
    for r, w in enumerate(ws):
        for i in range(6):
            short = w[:i] + w[i + 1 :]
            assert gone[r, i] == spelling.word_hash(spelling.codes_of([short], 5))[0]
    for size in (1, 1 << 20):
        for first, h in spelling.replacement_hashes(codes, alphabet, size):
            for r in range(3):
                for i in range(h.shape[1]):
                    for a, c in enumerate("axÿ"):
                        w = ws[r][: first + i] + c + ws[r][first + i + 1 :]
                        assert h[r, i, a] == spelling.word_hash(spelling.codes_of([w], 6))[0]


def test_edge_cases(spark):
    schema = "doc_id long, text string, n long, word string"
    long = "x" * 3000
    texts = [(1, None), (2, ""), (None, "Flower flower FLOWER flower flowers"), (3, "flower " * 40 + "Ünder-ünder " * 6), (3, "flower " * 40), (4, f"{long} " * 6), (5, "flowers " * 7 + "floweys " * 5)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in texts], schema)
    n, want = brute(texts)
    assert got(spelling.variants(spelling.vocabulary(docs, least_length=4, every=10**9))) == brute(texts, 4, every=10**9)[1]
    assert got(spelling.variants(spelling.vocabulary(docs))) == want and long in want
    assert got(spelling.variants(spelling.vocabulary(docs, every=3))) == brute(texts, every=3)[1]
    none = spelling.variants(spelling.vocabulary(docs.limit(0)))
    assert none.collect() == [] and set(none.columns) == {"word", "form", "root", "n", "n_near", "form_n"}
