"""Counts of a dataset, and whether its overflow calls for compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dataset_stats(spark: SparkSession, *, fingerprints: DataFrame | None = None, overflow: DataFrame | None = None, mappings: DataFrame | None = None, has_search_index: bool = False, has_posting_index: bool = False) -> DataFrame:
    """One row of counts and of what the dataset has. Records are those of the main tables."""

    def counted(df: DataFrame | None, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name)) if df is not None else spark.range(1).select(F.lit(0).cast("bigint").alias(name))

    parts = [counted(fingerprints, "record_count"), counted(overflow, "overflow_count"), counted(mappings, "metadata_count")]
    one = parts[0].select(F.lit("record_count").alias("k"), F.col("record_count").alias("n"))
    for part in parts[1:]:
        one = one.unionByName(part.select(F.lit(part.columns[0]).alias("k"), F.col(part.columns[0]).alias("n")))
    counts = one.agg(*(F.max(F.when(F.col("k") == p.columns[0], F.col("n"))).alias(p.columns[0]) for p in parts))
    flags = {"has_data_store": fingerprints is not None, "has_metadata": mappings is not None, "has_search_index": has_search_index, "has_posting_index": has_posting_index}
    return counts.select("*", (F.col("overflow_count") > 0).alias("has_overflow"), *(F.lit(v).alias(k) for k, v in flags.items()))


def needs_compaction(stats: DataFrame, threshold_pct: float | Column) -> DataFrame:
    """``(needs_compaction)`` and the columns beyond the statistics: whether the overflow has reached that many percent of
    the main records; with no main records, whether there is an overflow; never without a fingerprint table."""
    limit = threshold_pct if isinstance(threshold_pct, Column) else F.lit(threshold_pct)
    grown = F.when(F.col("record_count") == 0, F.col("has_overflow")).otherwise(F.col("overflow_count") / F.col("record_count") >= limit / 100)
    return stats.select((F.col("has_data_store") & grown).alias("needs_compaction"), *(c for c in stats.columns if c == "threshold_pct"))
