"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, hard_negatives, hilbert_shards, language_id, license_scan, line_dedup, lsh_forest, periodic_runs, sentencepiece_codec, suffix_dedup, token_counts, token_shards
from .store import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOWER_SQL = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@_query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


@_query
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_dedup(_table(spark, sf_dir, "documents"))


SQL["op3_near_dedup"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.y, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.x
"""


@_query
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-shards")
    token_shards.write_token_shards(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), path, end_id=2)
    return token_shards.read_token_shards(spark, path, token=2)


@_query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first call fills the cache and encodes the misses; the second finds every count in it."""
    docs, cache = _table(spark, sf_dir, "documents"), fresh_path(spark, "token-counts")
    for _ in range(2):
        counts = token_counts.token_counts(docs, tokenizer_file("byte_bpe_50k.json"), cache)
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.transform("matches", lambda m: m["license"]), ",").alias("licenses"), F.array_max(F.transform("matches", lambda m: m["coverage"])).alias("best_coverage"), "matches")


@_query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), unnamed=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_WORDS_SQL = "regexp_extract_all(" + _LOWER_SQL.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op7_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS p
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.p = bw.p),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS x FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


@_query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("text_sha256"))


_LINES_SQL = r"""
lines AS (SELECT doc_id, i, line, trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))) AS t
          FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {docs}))),
num AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS s, i FROM lines WHERE t <> ''),
pair AS (SELECT doc_id, s, t, lead(t) OVER (PARTITION BY doc_id ORDER BY s) AS u FROM num),
gone AS (
    SELECT doc_id, s FROM (SELECT doc_id, s, t, row_number() OVER (PARTITION BY t ORDER BY doc_id, s) AS r FROM num) WHERE r > 1 AND len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) >= 50
    UNION SELECT doc_id, unnest([s, s + 1]) FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY t, u ORDER BY doc_id, s) AS r FROM pair WHERE u IS NOT NULL) WHERE r > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text
         FROM lines l LEFT JOIN num n ON l.doc_id = n.doc_id AND l.i = n.i LEFT JOIN gone g ON n.doc_id = g.doc_id AND n.s = g.s
         WHERE g.s IS NULL GROUP BY l.doc_id)
"""
SQL["op8_line_dedup"] = f"""
WITH {_LINES_SQL.format(docs="documents")},
n AS (SELECT doc_id, count(*) AS n_lines FROM num GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE p IS NULL OR p <> s - 1) AS n_runs
      FROM (SELECT doc_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM gone) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n_lines, 0) AS n_lines, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_runs, 0) AS n_runs, sha256(coalesce(k.text, '')) AS text_sha256
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@_query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.learn(docs)
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", "score")


@_query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


SQL["op10_exact_dedup"] = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


@_query
def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of shards are at most one apart; the texts are read back from the shards' files."""
    path = fresh_path(spark, "hilbert-shards")
    hilbert_shards.write_shards(_table(spark, sf_dir, "documents"), path)
    text = F.coalesce("row.text", F.lit(""))
    return hilbert_shards.read_shards(spark, path).select("row.doc_id", "size", F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding", (F.col("vec_id") % 50 == 0).alias("anchor"))
    return hard_negatives.hard_negatives(rows)


SQL["op12_hard_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text): in a tenth of the documents, by a hash of doc_id, the words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("words", place(i).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_periods(_table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    best = [(-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"), F.expr("1000 * best.length DIV -best.period").alias("exponent_milli")]
    return rows.select("doc_id", "n_runs", *best, "runs_sha256", "collapsed_sha256")
