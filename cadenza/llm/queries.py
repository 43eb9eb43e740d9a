"""The opN_ queries with production parameters, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import decontamination, licenses, lines, neighbours, packing, pii, prefixes, repeats, simhash, spelling, suffixes, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), machine)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score").withColumn("predicted", toxicity.predicted())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents"))


#: The rules of op 6.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", *(F.col(f"__{c}").alias(c) for c in ("host", "path", "rule", "verdict")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_neighbours": op2_neighbours,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_url_filter": op6_url_filter,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_pii": op10_pii,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_substring_dedup": op13_substring_dedup,
}

OP1_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM low),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) s FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') g
       FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) s FROM d, (SELECT DISTINCT k FROM iw) WHERE len(w) >= k)),
hit AS (SELECT doc_id, s, dw.k, item_id FROM dw JOIN iw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) n_items, string_agg(x, ',' ORDER BY x) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(ids.s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) ls FROM documents),
l AS (SELECT doc_id, source, unnest(ls) line, unnest(generate_series(0, len(ls) - 1)) no FROM d),
bad AS (SELECT line, min((doc_id, no)) AS first FROM l WHERE length(line) >= 10 GROUP BY line HAVING count(DISTINCT source) >= 10),
j AS (SELECT l.doc_id, no, l.line, bad.line IS NOT NULL AND (l.doc_id, no) <> bad.first AS gone FROM l LEFT JOIN bad USING (line)),
k AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '') text, count(*) n_lines, count(*) FILTER (gone) n_removed FROM j GROUP BY doc_id)
SELECT d.doc_id, k.text, CAST(coalesce(n_lines, 0) AS BIGINT) n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) n_removed FROM d LEFT JOIN k USING (doc_id)
"""

def _op9_sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.TEMPLATES.items())
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""
WITH lic(license, text) AS (VALUES {values}),
t AS (SELECT license, regexp_extract_all(lower(text), '{word}') w FROM lic),
ts AS (SELECT DISTINCT license, len(w) n, array_to_string(w[i:i + 4], ' ') sh FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) i FROM t)),
tn AS (SELECT license, count(*) m FROM ts GROUP BY license),
d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') w FROM documents),
ds AS (SELECT doc_id, i - 1 pos, array_to_string(w[i:i + 4], ' ') sh FROM (SELECT *, unnest(generate_series(1, len(w) - 4)) i FROM d WHERE len(w) >= 5)),
hit AS (SELECT doc_id, license, n, pos, sh, unnest([pos // n, pos // n - 1]) k FROM ds JOIN ts USING (sh)),
win AS (SELECT doc_id, license, k, count(DISTINCT sh) c FROM hit WHERE k >= 0 AND pos <= k * n + 2 * n - 5 GROUP BY doc_id, license, k)
SELECT doc_id, license, count(*) n_windows, max(c / m) containment FROM win JOIN tn USING (license) WHERE c / m >= 0.8 GROUP BY doc_id, license
"""


def crc32_sql(text: str) -> str:
    """CRC-32 of a DuckDB string's UTF-8 bytes, bit by bit; 3988292384 is the reversed polynomial."""
    octets = f"[('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(octet_length(encode({text})))]"
    bits = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda a, b: {bits}), 4294967295)"


# a run of 199 in 1 loses a letter; near words are those that share a word with one letter left out at the same place, or one such word itself
OP11_SQL = rf"""
WITH runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w FROM documents),
h AS (SELECT w, {crc32_sql("(id || ':' || w)")} c FROM runs WHERE length(w) >= 6),
v AS (SELECT word, count(*) n FROM (SELECT CASE WHEN c % 199 = 0 THEN w[1:c % length(w)] || w[c % length(w) + 2:] ELSE w END word FROM h) WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
cut AS (SELECT word, n, i, w[1:i] || w[i + 2:] k FROM (SELECT word, word w, n, unnest(range(length(word))) i FROM v)),
pair AS (SELECT a.word a, b.word b, b.n m FROM cut a JOIN cut b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.k = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.k = b.word),
near AS (SELECT a, count(*) n_near, min((-m, b)) best FROM pair GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) n_near, CASE WHEN -best[1] >= 5 * n THEN best[2] END form, CASE WHEN -best[1] >= 5 * n THEN -best[1] END form_n FROM v LEFT JOIN near ON a = word),
up(word, root) AS (SELECT word, word FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, up.root, f.n, f.n_near, CAST(f.form_n AS BIGINT) form_n FROM f JOIN up ON up.word = f.word JOIN f t ON t.word = up.root AND t.form IS NULL
""".replace("WITH runs", "WITH RECURSIVE runs")

OP12_SQL = rf"""
WITH t AS (SELECT conv_id c, coalesce(role, '') r, coalesce(text, '') x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) i FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list((r, x) ORDER BY i) ts FROM t GROUP BY c),
h AS (SELECT o.c, coalesce(b.ts, [])[1:k] || o.ts[k + 1:] ts FROM (SELECT *, {crc32_sql("(CAST(c AS VARCHAR))")} % 4 k FROM o) o LEFT JOIN o b ON b.c = o.c - o.c % 20),
p AS (SELECT c, len(ts) n, d, ts[1:d] s FROM (SELECT *, unnest(range(len(ts) + 1)) d FROM h)),
n AS (SELECT s, d, min(c) c, count(*) n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '') ends FROM p GROUP BY s, d),
k AS (SELECT s[1:d - 1] s, d - 1 d, count(*) n_children FROM n WHERE d > 0 GROUP BY ALL),
w AS (SELECT n.*, coalesce(n_children, 0) n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.s[-1][2], '[^ 	-
]+')) END saved FROM n LEFT JOIN k USING (s, d)),
a AS (SELECT s[1:e] s, e d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) n_leaves, sum(saved) saved_tokens FROM (SELECT *, unnest(range(d + 1)) e FROM w) GROUP BY ALL)
SELECT w.c conv_id, w.d AS depth, q.c parent_conv_id, w.n_convs, w.n_children, CAST(a.n_leaves AS BIGINT) n_leaves, CAST(a.saved_tokens AS BIGINT) saved_tokens, sha256(w.ends) ends_sha256
FROM w JOIN a USING (s, d) LEFT JOIN n q ON q.d = w.d - 1 AND q.s = w.s[1:w.d - 1]
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () r, doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') w FROM documents),
g AS (SELECT r, doc_id, s, array_to_string(w[s:s + 12], ' ') g FROM (SELECT *, unnest(generate_series(1, len(w) - 12)) s FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) first FROM g GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(s, s + 12)) i FROM g JOIN f USING (g) WHERE doc_id > first),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) t, count(*) n FROM (SELECT r, unnest(w) x, unnest(generate_series(1, len(w))) i FROM d) LEFT JOIN (SELECT r, i, true AS hit FROM gone) USING (r, i) WHERE hit IS NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

ORACLES = {"op11_spelling_variants": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_substring_dedup": OP13_SQL, "op1_decontamination": OP1_SQL, "op8_line_dedup": OP8_SQL, "op9_license_scan": _op9_sql()}
