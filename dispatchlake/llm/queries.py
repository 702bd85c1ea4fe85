"""The registered queries of this subpackage, and SQL for those that it can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, annulus, decontaminate, divergence, html_text, licenses, line_dedup, lm, mixing, sharding, simhash, substring_dedup, toxicity


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = substring_dedup.substring_dedup(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, _table(spark, folder, "labels")))
    held_out = F.coalesce(F.expr(f"{toxicity.fold()} = 2"), F.lit(False))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    ids = F.array_join(F.array_sort(F.array_distinct(F.col("items").cast("array<string>"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size(F.array_distinct("items")).cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents"), carry=False)


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scored(_table(spark, folder, "documents"))


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(_table(spark, folder, "pages"))


def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.simhash(_table(spark, folder, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("mark")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "source", "epoch", "source_weight", "mix_order")


def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 100 = 0"))


def op11_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    return annulus.clustered(_table(spark, folder, "embeddings"))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


def op13_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = line_dedup.dedup(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_toxicity, op3_decontamination, op4_license_scan, op5_sharding, op6_lm_scoring, op7_html_extraction,
        op8_simhash_near_dedup, op9_mixing, op10_nearest_neighbours, op11_centroid_clustering, op12_source_divergence, op13_line_dedup,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({text}, '{pattern}')"
_ANY, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_OP1 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')", pattern=_ANY)} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(ws) - 11, 1))) AS i, ws FROM w),
h AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS t FROM g),
m AS (SELECT t, min(doc_id) AS low FROM h GROUP BY t),
hit AS (SELECT doc_id, list(i) AS starts FROM h JOIN m USING (t) WHERE low < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 13)))) AS places FROM hit),
p AS (SELECT doc_id, ws[k] AS word, k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)),
away AS (SELECT doc_id, unnest(places) AS k FROM gone),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY k) AS s FROM p ANTI JOIN away USING (doc_id, k) GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_OP3 = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(text=_LOWER, pattern=_ALNUM)} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS.format(text=_LOWER, pattern=_ALNUM)} AS ws FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, array_to_string(ws[i : i + n - 1], ' ') AS t, n
    FROM (SELECT item_id, ws, least(len(ws), 13) AS n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)
),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS t FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, n WHERE len(ws) >= n)),
hit AS (SELECT doc_id, n, i, list(item_id) AS items FROM dw JOIN bw USING (t, n) GROUP BY doc_id, n, i),
s AS (
    SELECT doc_id, len(list_distinct(flatten(list(range(i, i + n)))))::BIGINT AS n_hit, list_sort(list_distinct(list_transform(flatten(list(items)), lambda x: x::VARCHAR))) AS ids
    FROM hit GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM d LEFT JOIN s USING (doc_id)
"""

_SQUARE = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
_ASSIGNED = f"""
a{{r}} AS MATERIALIZED (
    SELECT vec_id, v, arg_min(no, d * 1000 + no) AS no, min(d) AS d
    FROM (SELECT vec_id, v, no, {_SQUARE}::HUGEINT AS d FROM x, c{{r}}) GROUP BY vec_id, v
)"""
_MOVED = """
m{r} AS (SELECT no, i, sum(v[i])::HUGEINT AS s, count(*) AS n FROM (SELECT no, v, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY no, i),
c{next} AS MATERIALIZED (
    SELECT c{r}.no, coalesce(f.c, c{r}.c) AS c
    FROM c{r} LEFT JOIN (SELECT no, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{r} GROUP BY no) f USING (no)
)"""
_OP11 = f"""
WITH x AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS no, v AS c FROM (SELECT v, sha256('1:' || vec_id::VARCHAR) AS h FROM x ORDER BY h LIMIT 16)),
{",".join(_ASSIGNED.format(r=r) + "," + _MOVED.format(r=r, next=r + 1) for r in range(3))},
{_ASSIGNED.format(r=3)}
SELECT vec_id, no::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY no))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (no)
"""

_OP12 = rf"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_WORDS.format(text=_LOWER, pattern=r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")} AS ts FROM documents
),
t AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
f AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.n AS ln FROM g JOIN k USING (lang) LEFT JOIN n USING (lang, source, term)),
w AS (SELECT lang, source, sum(n) + 5 * count(*) AS whole, sum(ln) + 5 * count(*) AS lang_whole FROM f GROUP BY lang, source),
p AS (
    SELECT lang, source, term, n, 1 + ((n + 5)::HUGEINT * 1000000000) // whole::HUGEINT AS p, 1 + ((ln + 5)::HUGEINT * 1000000000) // lang_whole::HUGEINT AS q
    FROM f JOIN w USING (lang, source)
),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 50
"""

_OP13 = rf"""
WITH l AS (
    SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line, len(ls) AS n_lines FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
),
k AS (SELECT *, {_LOWER.replace("coalesce(text, '')", "trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
h AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, top IS NOT NULL AND top <> doc_id AS gone FROM k LEFT JOIN h USING (key))
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op3_decontamination": _OP3, "op11_centroid_clustering": _OP11, "op12_source_divergence": _OP12, "op13_line_dedup": _OP13}
