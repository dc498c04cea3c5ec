"""Queries of the general data problems (2 and 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.operators.heavy_keys import heavy_keys, key_counts
from wavemill.operators.orphans import failed_references, orphan_references
from wavemill.sources.tables import table

#: Unsigned 32-bit value with its two low bits cleared.
CLEAN_MASK = 0xFFFFFFFC
HEAVY_SHARE = 0.015


def clean_hash():
    return F.col("hash").bitwiseAND(F.lit(CLEAN_MASK))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    hashes = heavy_keys(table(spark, d, "sampled_postings"), clean_hash(), HEAVY_SHARE)
    ids = heavy_keys(table(spark, d, "band_postings"), "fp_id", HEAVY_SHARE)
    return hashes.select(F.lit("sampled_postings").alias("src"), "key_id").unionByName(ids.select(F.lit("band_postings").alias("src"), "key_id"))


def p2_key_counts(spark: SparkSession, d: str) -> DataFrame:
    hashes = key_counts(table(spark, d, "sampled_postings"), clean_hash(), "fp_id").withColumn("src", F.lit("sampled_postings"))
    ids = key_counts(table(spark, d, "band_postings"), "fp_id", "bucket").withColumn("src", F.lit("band_postings"))
    return hashes.unionByName(ids).select("src", "key_id", "n_rows", "n_counterparts")


def _failed(spark: SparkSession, d: str) -> DataFrame:
    refs = None
    for name in ("mappings", "mappings_overflow", "band_postings"):
        part = table(spark, d, name).select(F.lit(name).alias("src"), "fp_id", "added_at").where(F.col("fp_id").isNotNull())
        refs = part if refs is None else refs.unionByName(part)
    additions = table(spark, d, "fingerprints").select("fp_id", "added_at").unionByName(table(spark, d, "fingerprints_overflow").select("fp_id", "added_at"))
    deletions = table(spark, d, "deleted_fps").select("fp_id", F.col("deleted_at").alias("added_at"))
    return failed_references(refs, additions, deletions, table(spark, d, "reserved_fps"), "fp_id", "added_at")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _failed(spark, d).select("src", F.date_format("added_at", "yyyy-MM").alias("period"), "fp_id", "kind").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("src", "period", "kind").agg(F.count(F.lit(1)).alias("n_ids"))


def p3_composite(spark: SparkSession, d: str) -> DataFrame:
    """Later mappings whose (fp_id, track_id), as far as it is given, stands in no earlier mapping."""
    refs = table(spark, d, "mappings_overflow").select("fp_id", "track_id", "mbid", "added_at")
    return orphan_references(refs, ["fp_id", "track_id"], table(spark, d, "mappings"), "partial")


QUERIES = {"p2_found": p2_found, "p2_key_counts": p2_key_counts, "p3_found": p3_found, "p3_report": p3_report, "p3_composite": p3_composite}

_P3 = """
WITH adds AS (SELECT fp_id, added_at AS t FROM fingerprints UNION ALL SELECT fp_id, added_at FROM fingerprints_overflow),
changes AS (SELECT fp_id, t, max(alive) AS alive FROM (
    SELECT fp_id, t, 1 AS alive FROM adds UNION ALL SELECT fp_id, deleted_at, 0 FROM deleted_fps) WHERE t IS NOT NULL GROUP BY fp_id, t),
firsts AS (SELECT fp_id, min(t) AS t1 FROM adds GROUP BY fp_id),
refs AS (SELECT DISTINCT 'mappings' AS src, fp_id, added_at AS t FROM mappings UNION SELECT 'mappings_overflow', fp_id, added_at FROM mappings_overflow
    UNION SELECT 'band_postings', fp_id, added_at FROM band_postings),
open AS (SELECT * FROM refs WHERE fp_id IS NOT NULL AND fp_id NOT IN (SELECT fp_id FROM reserved_fps WHERE fp_id IS NOT NULL)),
seen AS (SELECT o.*, c.alive FROM open o ASOF LEFT JOIN changes c ON o.fp_id = c.fp_id AND o.t >= c.t),
found AS (SELECT DISTINCT s.src, strftime(s.t, '%Y-%m') AS period, s.fp_id,
    CASE WHEN f.fp_id IS NULL THEN 'missing' WHEN f.t1 > s.t THEN 'late' ELSE 'deleted' END AS kind
    FROM seen s LEFT JOIN firsts f ON s.fp_id = f.fp_id WHERE coalesce(s.alive, 0) = 0)
"""

SQL = {
    "p2_found": f"""
SELECT 'sampled_postings' AS src, hash & {CLEAN_MASK} AS key_id FROM sampled_postings WHERE hash IS NOT NULL
GROUP BY hash & {CLEAN_MASK} HAVING count(*) >= 0.015 * (SELECT count(*) FROM sampled_postings)
UNION ALL SELECT 'band_postings', fp_id FROM band_postings WHERE fp_id IS NOT NULL
GROUP BY fp_id HAVING count(*) >= 0.015 * (SELECT count(*) FROM band_postings)""",
    "p2_key_counts": f"""
SELECT 'sampled_postings' AS src, hash & {CLEAN_MASK} AS key_id, count(*) AS n_rows, count(DISTINCT fp_id) AS n_counterparts
FROM sampled_postings WHERE hash IS NOT NULL GROUP BY hash & {CLEAN_MASK}
UNION ALL SELECT 'band_postings', fp_id, count(*), count(DISTINCT bucket) FROM band_postings WHERE fp_id IS NOT NULL GROUP BY fp_id""",
    "p3_found": _P3 + "SELECT src, period, fp_id, kind FROM found",
    "p3_report": _P3 + "SELECT src, period, kind, count(*) AS n_ids FROM found GROUP BY src, period, kind",
    "p3_composite": """
SELECT r.fp_id, r.track_id, r.mbid, r.added_at FROM mappings_overflow r
WHERE (r.fp_id IS NOT NULL OR r.track_id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM mappings m
    WHERE (r.fp_id IS NULL OR r.fp_id = m.fp_id) AND (r.track_id IS NULL OR r.track_id = m.track_id))""",
}
