"""Column functions over transcripts: normal forms, error rates, short-utterance rules, engine keys."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that Japanese normalisation drops, and those that comparison drops.
JA_MARKS = "。、．，！？・「」『』（）"
COMPARE_MARKS = "、。,.!?！？…・「」『』()（）"
#: Languages written with spaces, and sentence ends.
SPACED = ("en", "fr", "de", "es", "it", "pt", "nl", "ru", "ko", "pl", "sv", "da", "no", "fi", "cs", "hu", "ro", "tr", "vi", "id", "ms")
ENDS = "。！？.!?"
#: Display-name prefixes (longest first) and aliases of engine ids.
PREFIXES = (("nvidia parakeet tdt ctc", "parakeet_ja"), ("mistralai voxtral", "voxtral"), ("nvidia parakeet", "parakeet"), ("nvidia canary", "canary"))
ALIASES = {"qwen3-asr": "qwen3asr"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column) -> Column:
    """White space (of any script) to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_en(c: Column | str, keep_apostrophes: bool = False) -> Column:
    low = F.lower(col(c))
    return collapse(F.regexp_replace(low if keep_apostrophes else F.replace(low, F.lit("'"), F.lit("")), r"(?U)[^a-z0-9\s]", " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_ja(c: Column | str, strip_punctuation: bool = True, normalize_width: bool = False) -> Column:
    c = nfkc(strip(col(c))) if normalize_width else col(c)
    return F.regexp_replace(F.translate(c, JA_MARKS, "") if strip_punctuation else c, r"(?U)\s+", "")


def normalize_generic(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(col(c)), r"\p{P}", ""))


def normalize_by_language(c: Column | str, language: Column) -> Column:
    return F.when(language == "en", normalize_en(c)).when(language == "ja", normalize_ja(c)).otherwise(normalize_generic(c))


def normalize_compare(c: Column | str, width: bool = True) -> Column:
    c = nfkc(col(c)) if width else col(c)
    return F.translate(F.regexp_replace(c, r"(?U)\s+", ""), COMPARE_MARKS, "")


def katakana_to_hiragana(c: Column) -> Column:
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(c, kata, "".join(chr(ord(k) - 0x60) for k in kata))


#: Kanji digits, places within four digits, names of every fourth place, marks that alignment drops.
KANJI_DIGITS, KANJI_PLACES, KANJI_GROUPS = "〇一二三四五六七八九", ("", "十", "百", "千"), ("", "万", "億", "兆", "京")
ALIGN_MARKS = "、。，．・〜「」『』（）()！？!?.,;:\"'-"
DIGITS_BY_CJK = re.compile("(?<=[぀-ヿ一-鿿])[0-9]+|[0-9]+(?=[぀-ヿ一-鿿])")


def kanji_number(digits: str) -> str:
    """A number in kanji, without 一 before 十, 百 and 千; digits beyond the names stay."""
    n = digits.lstrip("0")
    if not n:
        return "零"
    if len(n) > 4 * len(KANJI_GROUPS):
        return digits
    out = ""
    for at, d in enumerate(n):
        group, place = divmod(len(n) - 1 - at, 4)
        if d != "0":
            out += (KANJI_DIGITS[int(d)] if d != "1" or not place else "") + KANJI_PLACES[place]
        if not place and n[max(0, at - 3) : at + 1].strip("0"):
            out += KANJI_GROUPS[group]
    return out


@F.pandas_udf(T.StringType())
def kanji_width(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition; then digits beside kana or kanji as kanji numerals."""
    number = lambda m: kanji_number(m.group())
    return s.map(lambda t: None if t is None else DIGITS_BY_CJK.sub(number, unicodedata.normalize("NFKC", t)))


def alignment_text(c: Column | str, reading=lambda c: c) -> Column:
    """Width-normal, digits in Japanese text as kanji numerals, in hiragana, without marks and space; ``reading`` is a hook for a user's dictionary of readings."""
    return F.regexp_replace(F.translate(katakana_to_hiragana(reading(kanji_width(col(c)))), ALIGN_MARKS, ""), r"(?U)\s+", "")


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance of two sequences of hashable items, by Myers' bit vectors: one pass over b with integers of len(a) bits."""
    if len(a) < len(b):
        a, b = b, a
    lo, most = 0, len(b)
    while lo < most and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < most - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m = len(a)
    if not b:
        return m
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    at = {}
    for x in set(b) & places.keys():
        bits = bytearray(m // 8 + 1)
        for i in places[x]:
            bits[i >> 3] |= 1 << (i & 7)
        at[x] = int.from_bytes(bits, "little")
    full, last, distance = (1 << m) - 1, 1 << (m - 1), m
    up, down = full, 0
    for y in b:
        equal = at.get(y, 0)
        vertical = equal | down
        horizontal = ((((equal & up) + up) ^ up) | equal) & full
        rise, fall = down | (full ^ (horizontal | up)), up & horizontal
        distance += 1 if rise & last else -1 if fall & last else 0
        rise, fall = ((rise << 1) | 1) & full, (fall << 1) & full
        up, down = fall | (full ^ (vertical | rise)), rise & vertical
    return distance


#: Bits that a batch keeps in each word (the 64th holds a carry), words of its bit vectors, most words and fewest pairs that go as a batch; other pairs go one by one.
BITS, BATCH_WORDS, MOST_WORDS, LEAST_PAIRS = 63, 8192, 16, 16


def _placed(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items of the sequences that begin at starts: their sequence's number, their place in it, and the item."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, place, flat[np.repeat(starts, sizes) + place]


def _batch(a, b, m: np.ndarray, n: np.ndarray, kinds: int) -> np.ndarray:
    """Distances of pairs with bit vectors of equally many words, by descending n: ``edit_distance``'s steps on all pairs at once."""
    (row, place, item), (b_row, b_place, b_item) = a, b
    words, pairs = max(1, -(-int(m.max()) // BITS)), len(m)
    if pairs * kinds * words <= 1 << 20:
        ids, b_ids, n_ids = row * kinds + item, b_row * kinds + b_item, pairs * kinds
    else:
        codes, known = pd.factorize(np.concatenate([row * kinds + item, b_row * kinds + b_item]))
        ids, b_ids, n_ids = codes[: len(row)], codes[len(row) :], len(known)
    at = np.zeros(words * n_ids, np.uint64)
    np.add.at(at, place // BITS * n_ids + ids, np.uint64(1) << (place % BITS).astype(np.uint64))
    at = at.reshape(words, n_ids)
    steps = np.zeros((int(n.max(initial=0)), pairs), np.int64)
    steps[b_place, b_row] = b_ids
    one, carry, full = np.uint64(1), np.uint64(BITS), np.uint64((1 << BITS) - 1)
    up, down = np.full((words, pairs), full), np.zeros((words, pairs), np.uint64)
    equal, fall, rise, over = (np.empty((words, pairs), np.uint64) for _ in range(4))
    last_up, last_down = up.copy(), down.copy()
    left = np.searchsorted(-n, -np.arange(1, len(steps) + 2), "right")  # pairs whose n is not below the step's number, from 1
    for y, k, going in zip(steps, left, left[1:], strict=False):
        np.take(at, y, axis=1, out=equal, mode="clip")
        np.bitwise_and(equal, up, out=fall)
        fall += up
        for w in range(1, words):
            fall[w] += fall[w - 1] >> carry
        fall ^= up
        fall |= equal
        np.bitwise_or(fall, up, out=rise)
        np.invert(rise, out=rise)
        rise |= down
        fall &= up
        for x in (rise, fall):
            x += x
            if words > 1:
                np.right_shift(x, carry, out=over)
                x[1:] |= over[:-1]
        rise[0] |= one
        equal |= down
        np.bitwise_and(rise, equal, out=down)
        down &= full
        rise |= equal
        np.invert(rise, out=rise)
        np.bitwise_or(rise, fall, out=up)
        up &= full
        if going < k:  # these pairs end here
            last_up[:, going:k], last_down[:, going:k] = up[:, going:k], down[:, going:k]
    own = (one << np.clip(m - BITS * np.arange(words)[:, None], 0, BITS).astype(np.uint64)) - one
    rises, falls = (np.bitwise_count(x & own).sum(0, dtype=np.int64) for x in (last_up, last_down))
    return n + rises - falls


def edit_distances(flat: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Levenshtein distances of pairs of sequences of m and n items of flat (small numbers) that begin at a and b.

    Pairs with bit vectors of equally many words go through Myers' steps together; long ones, and the few left of a kind, one by one.
    """
    short = m < n
    a, m, b, n = np.where(short, b, a), np.where(short, n, m), np.where(short, a, b), np.where(short, m, n)
    kinds, words = int(flat.max(initial=0)) + 1, np.maximum(1, -(-m // BITS))
    order, out = np.lexsort((-n, words)), np.zeros(len(m), np.int64)
    for alike in np.split(order, np.flatnonzero(np.diff(words[order])) + 1):
        size = max(1, BATCH_WORDS // int(words[alike].max(initial=1)))
        for i in range(0, len(alike), size):
            p = alike[i : i + size]
            if words[p[0]] > MOST_WORDS or len(p) < LEAST_PAIRS:
                out[p] = [edit_distance(flat[a[x] : a[x] + m[x]].tolist(), flat[b[x] : b[x] + n[x]].tolist()) for x in p]
            else:
                out[p] = _batch(_placed(flat, a[p], m[p]), _placed(flat, b[p], n[p]), m[p], n[p], kinds)
    return out


def _numbered(ref: pa.Array, hyp: pa.Array) -> np.ndarray:
    """The characters or elements of ref, then those of hyp, as numbers from 0 in each batch."""
    if pa.types.is_string(ref.type) or pa.types.is_large_string(ref.type):
        points = np.frombuffer("".join(x for s in (ref, hyp) for x in s.to_pylist() if x is not None).encode("utf-32-le"), np.uint32)
        seen = np.zeros(int(points.max(initial=0)) + 1, bool)
        seen[points] = True
        return (np.cumsum(seen) - 1)[points]
    return pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


@F.arrow_udf(T.LongType())
def edits(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Edit distance of two texts by characters, or of two arrays by elements; null with either."""
    size = pc.list_value_length if pa.types.is_list(ref.type) or pa.types.is_large_list(ref.type) else pc.utf8_length
    m, n = (size(x).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (ref, hyp))
    a, b = np.cumsum(m) - m, m.sum() + np.cumsum(n) - n
    null = np.asarray(pc.or_(ref.is_null(), hyp.is_null()).to_numpy(zero_copy_only=False), bool)
    return pa.array(edit_distances(_numbered(ref, hyp), a, np.where(null, 0, m), b, np.where(null, 0, n)), pa.int64(), mask=null)


def cer(ref: Column | str, hyp: Column | str) -> Column:
    """Character edits over the reference's length; an empty reference gives 0 for an empty hypothesis, else 1."""
    ref, hyp = col(ref), col(hyp)
    return F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(edits(ref, hyp) / F.length(ref))


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def wer(ref: Column | str, hyp: Column | str) -> Column:
    """Word edits over reference words; an empty reference gives 0 for an empty hypothesis, else 1."""
    r, h = word_list(col(ref)), word_list(col(hyp))
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(edits(r, h) / F.size(r))


def truncated_side(a: Column | str, b: Column | str, least: int = 2) -> Column:
    """'a' or 'b' for the text that is a proper beginning of the other and at least ``least`` shorter, else null."""
    a, b = col(a), col(b)
    return F.when((a != b) & b.startswith(a) & (F.length(b) - F.length(a) >= least), "a").when((a != b) & a.startswith(b) & (F.length(a) - F.length(b) >= least), "b")


def is_short(text: Column | str, max_words: int = 1, max_chars: int = 4) -> Column:
    t = strip(col(text))
    n = F.size(F.split(t, r"(?U)\s+"))
    ended = F.lit(ENDS).contains(F.right(t, F.lit(1)))
    return F.when(t == "", False).when(ended, False).when(n >= 2, n <= max_words).otherwise(F.length(t) <= max_chars)


def join_text(a: Column | str, b: Column | str, language: Column) -> Column:
    a, b = col(a), col(b)
    code = F.lower(F.substring(language, 1, 2))
    none = F.coalesce(language, F.lit("")) == ""
    space = F.coalesce(code.isin(*SPACED), F.lit(False)) | (none & (a.contains(" ") | b.contains(" ")))
    return F.when(space, F.concat(a, F.lit(" "), b)).otherwise(F.concat(a, b))


def first_word(c: Column | str) -> Column:
    """Lower-cased first word, null if blank."""
    t = F.lower(strip(col(c)))
    return F.when(t != "", F.element_at(F.split(t, r"(?U)\s+"), 1))


def engine_id(c: Column | str) -> Column:
    """Display name to engine id: prefixes, then the first word or its alias; '' if blank."""
    t = F.lower(strip(col(c)))
    w = first_word(c)
    word = reduce(lambda acc, kv: F.when(w == kv[0], kv[1]).otherwise(acc), ALIASES.items(), w)
    out = reduce(lambda acc, kv: F.when(t.startswith(kv[0]), kv[1]).otherwise(acc), reversed(PREFIXES), word)
    return F.coalesce(out, F.lit(""))


def stamp(seconds: Column | str, truncate: bool = False, comma: bool = True) -> Column:
    """HH:MM:SS,mmm; rounded milliseconds, or truncated ones with negatives as 0."""
    s = col(seconds)
    ms = F.floor(F.greatest(s, F.lit(0.0)) * 1000) if truncate else F.bround(s * 1000).cast("long")
    f = "%02d:%02d:%02d" + ("," if comma else ".") + "%03d"
    return F.format_string(f, F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def primary_language(code: Column | str) -> Column:
    return F.lower(F.element_at(F.split(col(code), "[-_]"), 1))


def last_sentence(text: Column | str, context: int) -> Column:
    """The last line; of a single line the last sentence if there are more sentences than context ones."""
    t = F.trim(col(text))
    lines = F.split(t, "\n")
    parts = F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: s != "")
    return F.when(F.size(lines) > 1, F.trim(F.element_at(lines, -1))).when(F.size(parts) > context, F.element_at(parts, -1)).otherwise(t)


def natural_key(c: Column | str) -> Column:
    """Sorts digits as numbers of any length and letters without case."""
    parts = F.regexp_extract_all(F.lower(col(c)), F.lit(r"(\d+|\D+)"), F.lit(1))
    number = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(number(x)).cast("string"), 10, "0"), F.lit(" "), number(x))).otherwise(x))
