"""SimHash near copies at a five-word similarity of 0.8, against brute force."""

import random

import numpy as np
import pytest

from cadenza.llm import simhash
from tests.llm.test_operators import frame, none, odd, rows  # noqa: F401


def sets_of(text):
    ws = text.encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_kept(texts):
    """Ids that are the least of their component of pairs at 0.8 or more."""
    sets, label = {d: sets_of(t) for d, t in texts.items()}, {d: d for d in texts}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d for d in texts if root(d) == d}


def test_copies_beyond_three_bits(spark, sf):
    """Documents 145 and 177 of sf0.001 are copies at 0.83 whose 3-word fingerprints differ by more than 3 bits."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["text"] for r in simhash.keep_similar(docs).collect()}
    assert got == {d: texts[d] for d in brute_kept(texts)}
    assert not {145, 177} & set(got)


def families(rng):
    """Families of copies with 0 to 12 edits, chains and a passage that all share."""
    word = lambda: f"w{rng.randrange(400)}"
    shared, texts = " ".join(f"s{i}" for i in range(20)), {}
    for _ in range(12):
        ws = [word() for _ in range(rng.randrange(3, 160))]
        for _ in range(rng.randrange(1, 15)):
            own = list(ws)
            for _ in range(rng.randrange(0, 13)):
                own[rng.randrange(len(own))] = word()
            texts[len(texts)] = " ".join(own) + (f" {shared}" if rng.random() < 0.5 else "")
            ws = own if rng.random() < 0.3 else ws
    return texts


@pytest.mark.parametrize("hot", [50_000, 20])
def test_families_of_edited_copies(spark, monkeypatch, hot):
    """No two texts below 0.8 are joined, and nearly no copy is missed; with and without deals that are dealt again."""
    texts = families(random.Random(7))
    whole = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda n, s, m, w: whole(n, s, m, w, hot=hot))
    got = {r["doc_id"] for r in simhash.keep_similar(frame(spark, [(d, t, "a") for d, t in texts.items()])).collect()}
    want = brute_kept(texts)
    assert want <= got and len(got - want) <= 0.02 * (len(texts) - len(want))
    assert len(got) < len(texts)


def edited_families(rng, n=60, size=12):
    """Families of variants whose pairs lie on both sides of 0.8."""
    texts = {}
    for f in range(n):
        ws = [f"w{f}_{i}" for i in range(120)]
        for _ in range(size):
            own = list(ws)
            for i in rng.sample(range(120), rng.randrange(1, 4)):
                own[i] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    return texts


@pytest.mark.parametrize("bits", [64, 3])
def test_no_link_is_hidden_by_a_refuted_one(spark, bits):
    """720 variants near 0.8: against all exact pairs nothing is joined that isn't owed, and what is missed keeps to the bound; names of three bits clash and change nothing."""
    texts = edited_families(random.Random(11))
    docs = frame(spark, [(d, t, "a") for d, t in texts.items()])
    got = {r["doc_id"] for r in simhash.keep_similar(docs, bits=bits).collect()}
    want = brute_kept(texts)
    assert 100 < len(texts) - len(want) < len(texts) * 0.9
    assert want <= got and len(got - want) <= 0.005 * (len(texts) - len(want))


def test_pairs_across_labels_equal_brute_force():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 2, (80, 4), dtype=np.uint64) * np.uint64(0xFF00FF) ^ rng.integers(0, 8, (80, 4), dtype=np.uint64), axis=0)
    group, labels = np.sort(rng.integers(0, 3, len(codes))), rng.integers(0, 6, len(codes))
    a, b = simhash.trie_links(codes, group, (9,), block=50, labels=labels)
    far = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    near = (far <= 9) & (group[:, None] == group) & (labels[:, None] != labels)
    assert sorted(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True)) == [(i, j) for i, j in np.argwhere(near).tolist() if i < j]


def test_sketch_rules_out_no_similar_pair():
    """Sets of 0 to 3,000 hashes, and copies with changes up to and beyond a Jaccard similarity of 0.8."""
    rng = np.random.default_rng(9)
    sets, wrong, far = [], 0, 0
    for n in (0, 1, 2, 5, 9, 10, 40, 90, 300, 3000):
        base = rng.integers(-(1 << 63), 1 << 63, n)
        for share in (0.0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.3):
            k = round(n * share)
            sets.append(np.unique(np.concatenate((base[k:], rng.integers(-(1 << 63), 1 << 63, k)))))
    sk = np.array([simhash.sketch(x) for x in sets])
    a, b = np.triu_indices(len(sets), 1)
    says = simhash.may_reach(sk[:, 0], sk[:, 1:], 0.8)(a, b)
    for i, j, may in zip(a, b, says, strict=True):
        shared, both = len(np.intersect1d(sets[i], sets[j])), len(np.union1d(sets[i], sets[j]))
        assert may or 5 * shared < 4 * both
        if 10 <= both <= 1000 and shared < 0.7 * both:
            far, wrong = far + 1, wrong + bool(may)
    assert far > 500 and wrong < 0.02 * far


def test_wide_trie_equals_brute_force():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 63, (300, 4), dtype=np.int64).view(np.uint64)
    for i in range(1, 300):
        if i % 10:
            codes[i] = codes[i - 1]
            for bit in rng.integers(0, 256, rng.integers(0, 70)):
                codes[i, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    codes = codes[np.lexsort(codes.T[::-1])]
    a, b = simhash.trie_links(codes, np.zeros(300, np.int64), (20, 40))
    far = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    assert (far[a, b] <= 40).all()
    forest, all_pairs = simhash.Forest(300), np.nonzero(far <= 40)
    forest.link(*all_pairs)
    mine = simhash.Forest(300)
    mine.link(a, b)
    assert np.array_equal(mine.label, forest.label) and len(a) == 300 - len(set(forest.label))


def test_edges(spark, odd, none):  # noqa: F811
    kept = [(r["doc_id"], (r["text"] or "")[:9]) for r in rows(simhash.keep_similar(odd))]
    assert sorted(kept, key=str) == [(1, ""), (3, "one two t"), (3, "other wor"), (4, "w0 the w9"), (7, "é ü ñ \u3000 x")]
    assert simhash.keep_similar(odd).columns == odd.columns
    assert simhash.keep_similar(none).count() == 0
