"""Op 12 against brute force, and its edge cases."""

import hashlib
import random
import re
import zlib

import pytest

from cadenza.llm import prefixes

SCHEMA = "conv_id long, turn int, role string, text string, depth long, k1 string"


def conversations(rows):
    out = {}
    for c, _, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def rebuilt(convs):
    out = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + ts[h:]
    return out


def brute(convs):
    members, out = {}, {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        cost = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += cost
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out[min(m), len(k)] = (min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


def test_conversations_equal_brute_force(spark, sf):
    t = spark.read.parquet(f"{sf}/conversations.parquet")
    convs = conversations([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in t.collect()])
    assert got(prefixes.rebuilt_trie(t)) == brute(rebuilt(convs))
    assert got(prefixes.trie(t)) == brute(convs)


@pytest.mark.parametrize("band", [1, 2, 3, 32])
def test_random_tries_in_bands(spark, band):
    """Long and short conversations of few different turns, whose prefixes cross the borders of bands; some own a long tail alone."""
    rng = random.Random(band)
    rows = []
    for c in range(-25, 60):
        n = rng.choice([1, 1, 2, 3, 4, 6, 9])
        rows += [(c, i, rng.choice("ua"), rng.choice(["a b", "c"]) if i < 6 else f"own {c % 7} {i}") for i in range(n)]
    rows += [(100 + k, i, "u", "same" if i < 8 + k else f"{k} {i}") for k in range(3) for i in range(17)]
    convs = conversations(rows)
    assert got(prefixes.trie(frame(spark, rows), band=band)) == brute(convs)
    assert got(prefixes.rebuilt_trie(frame(spark, rows), band=band)) == brute(rebuilt(convs))


def test_hot_conversation_and_shared_turns(spark, monkeypatch):
    """A third of all rows in one conversation; a third of the conversations are one text; ids in many blocks."""
    monkeypatch.setattr(prefixes, "BLOCK", 2)
    rows = [(7, i, "u", f"t {i % 5}") for i in range(400)] + [(1000 + 3 * c, i, "u", "hello all") for c in range(150) for i in range(2)] + [(5000 + c, i, "u", f"{i * c}") for c in range(60) for i in range(3)]
    convs = conversations(rows)
    assert got(prefixes.trie(frame(spark, rows), band=16)) == brute(convs)


def test_edge_cases(spark):
    """Null and repeated turns, null roles and texts, rows without conversation, turnless conversations, an empty table."""
    rows = [(0, None, "u", "x y"), (0, 1, None, None), (0, 1, None, None), (0, 2, "u", "z"), (0, 1, "a", "b"), (3, 5, "u", ""), (None, 1, "u", "q"), (21, 1, "u", "one"), (25, None, None, None), (9, 1, "u", "long " * 50_000), (11, 1, "u", "long " * 50_000), (-3, 1, "u", "n"), (-20, 1, "u", "m")]
    convs = conversations(rows)
    assert any(not t for t in rebuilt(convs).values())
    assert got(prefixes.rebuilt_trie(frame(spark, rows))) == brute(rebuilt(convs))
    assert got(prefixes.trie(frame(spark, rows))) == brute(convs)
    none = prefixes.rebuilt_trie(frame(spark, []))
    assert none.collect() == [] and "ends_sha256" in none.columns
