"""Queries of the training-data problems 1 and 4 to 9, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.encodings import garbled
from wavemill.llm.mixture import mix, mix_report
from wavemill.llm.neardup import NearDuplicates
from wavemill.llm.runs import collapse_runs
from wavemill.llm.spans import shared_counts, shared_spans
from wavemill.llm.tokens import count_tokens, encode
from wavemill.llm.topk import frequent_values
from wavemill.sources.tables import materialise, table

CLEAN_MASK = 0xFFFFFFFC


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    runs = collapse_runs(table(spark, d, "fingerprints"), min_len=3)
    return runs.select(F.col("id").alias("fp_id"), "start_pos", "run_len").distinct()


def p1_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapse_runs(table(spark, d, "fingerprints")).withColumnRenamed("id", "fp_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    clean = F.col("hash").bitwiseAND(F.lit(CLEAN_MASK))
    return frequent_values(table(spark, d, "sampled_postings"), clean, share=0.003).select(F.col("value").alias("hash"))


def p4_top100(spark: SparkSession, d: str) -> DataFrame:
    clean = F.col("hash").bitwiseAND(F.lit(CLEAN_MASK))
    return frequent_values(table(spark, d, "sampled_postings"), clean, k=100).select(F.col("value").alias("hash"), "n_rows")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = NearDuplicates(table(spark, d, "fingerprints")).pairs()
    return pairs.select(F.col("id_a").alias("fp_id_a"), F.col("id_b").alias("fp_id_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(table(spark, d, "fingerprints")).groups().withColumnRenamed("id", "fp_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_counts(table(spark, d, "fingerprints")).withColumnRenamed("id", "fp_id")


def p6_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = shared_spans(table(spark, d, "fingerprints"))
    return spans.select(F.col("id").alias("fp_id"), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    sized = materialise(count_tokens(table(spark, d, "documents"), keep=["doc_id", "source"]), "sized")
    mixed = mix(sized, table(spark, d, "mix_targets"))
    return mixed.select(F.col("id").alias("doc_id"), "source", "copy", F.col("amount").alias("n_tokens"), "finish", "position")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = materialise(count_tokens(table(spark, d, "documents"), keep=["doc_id", "source"]), "sized")
    targets = table(spark, d, "mix_targets")
    return mix_report(mix(sized, targets), targets).withColumnRenamed("amount", "n_tokens")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents"), restore=False).select(F.col("id").alias("doc_id"))


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return garbled(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_collapsed, p4_found, p4_top100, p5_found, p5_groups, p6_found, p6_spans, p7_ids, p8_mixture, p8_shares, p9_found, p9_restored)}

_RUNS = """
WITH r AS (SELECT DISTINCT fp_id, duration_ms, "values" AS v FROM fingerprints WHERE len("values") > 0),
e AS (SELECT fp_id, duration_ms, len(v) AS n, unnest(v) AS x, unnest(range(len(v))) AS i FROM r),
m AS (SELECT *, CASE WHEN bit_count(xor(x, lag(x) OVER w)) <= 2 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY fp_id, duration_ms ORDER BY i)),
g AS (SELECT *, sum(new) OVER (PARTITION BY fp_id, duration_ms ORDER BY i) AS k FROM m),
runs AS (SELECT fp_id, min(i)::BIGINT AS start_pos, count(*) AS run_len, arg_min(x, i) AS value, duration_ms::DOUBLE * count(*) / any_value(n) AS run_ms
    FROM g GROUP BY fp_id, duration_ms, k)
"""

_NEAR = """
WITH s AS (SELECT DISTINCT fp_id, duration_ms AS d, list_distinct("values") AS v FROM fingerprints WHERE len("values") > 0 AND duration_ms IS NOT NULL AND fp_id IS NOT NULL),
r AS (SELECT row_number() OVER () AS k, * FROM s), e AS (SELECT k, unnest(v) AS x FROM r),
f AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY c, x) AS o FROM e JOIN (SELECT x, count(*) AS c FROM e GROUP BY x) USING (x)),
p AS (SELECT k, x FROM f JOIN r USING (k) WHERE o <= len(v) - ceil(0.5 * len(v)) + 1),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.x = b.x AND a.k < b.k),
t AS (SELECT ra.fp_id AS ia, rb.fp_id AS ib, len(list_intersect(ra.v, rb.v)) AS n, len(ra.v) AS na, len(rb.v) AS nb
    FROM c JOIN r ra ON a = ra.k JOIN r rb ON b = rb.k WHERE abs(ra.d - rb.d) <= 0.1 * greatest(ra.d, rb.d) AND ra.fp_id <> rb.fp_id),
pairs AS (SELECT DISTINCT least(ia, ib) AS fp_id_a, greatest(ia, ib) AS fp_id_b FROM t WHERE n >= 0.5 * (na + nb - n))
"""

_SHARED = """
WITH r AS (SELECT DISTINCT fp_id, "values" AS v FROM fingerprints WHERE len("values") >= 32 AND fp_id IS NOT NULL),
w AS (SELECT fp_id, unnest(range(len(v) - 31)) AS i, v FROM r), h AS (SELECT fp_id, i, md5(v[i + 1 : i + 32]::VARCHAR) AS h FROM w),
s AS (SELECT h FROM h GROUP BY h HAVING count(DISTINCT fp_id) > 1), c AS (SELECT DISTINCT fp_id, i FROM h SEMI JOIN s USING (h))
"""

SQL = {
    "p1_found": _RUNS + "SELECT DISTINCT fp_id, start_pos, run_len FROM runs WHERE run_len >= 3",
    "p1_collapsed": _RUNS + "SELECT DISTINCT fp_id, start_pos, run_len, value, run_ms FROM runs",
    "p4_found": f"""SELECT hash & {CLEAN_MASK} AS hash FROM sampled_postings WHERE hash IS NOT NULL GROUP BY 1
HAVING count(*) >= 0.003 * (SELECT count(*) FROM sampled_postings)""",
    "p4_top100": f"""SELECT hash & {CLEAN_MASK} AS hash, count(*) AS n_rows FROM sampled_postings WHERE hash IS NOT NULL GROUP BY 1
ORDER BY n_rows DESC, hash LIMIT 100""",
    "p5_found": _NEAR + "SELECT fp_id_a, fp_id_b FROM pairs",
    "p5_groups": _NEAR.replace("WITH s AS", "WITH RECURSIVE s AS", 1) + """, links AS (SELECT fp_id_a AS x, fp_id_b AS y FROM pairs UNION ALL SELECT fp_id_b, fp_id_a FROM pairs),
reach AS (SELECT DISTINCT fp_id AS x, fp_id AS y FROM s UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT x AS fp_id, min(y) AS group_id FROM reach GROUP BY x""",
    "p6_found": _SHARED + """, g AS (SELECT fp_id, i, lead(i) OVER (PARTITION BY fp_id ORDER BY i) AS j FROM c)
SELECT fp_id, sum(least(32, coalesce(j - i, 32)))::BIGINT AS n_shared FROM g GROUP BY fp_id""",
    "p6_spans": _SHARED + """, g AS (SELECT fp_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY fp_id ORDER BY i) + 32 THEN 0 ELSE 1 END AS new FROM c),
k AS (SELECT fp_id, i, sum(new) OVER (PARTITION BY fp_id ORDER BY i) AS k FROM g)
SELECT fp_id, min(i) AS start_pos, max(i) + 32 AS end_pos FROM k GROUP BY fp_id, k""",
}
