"""Band index: postings of every value's bands, their statistics, and searches in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions.bits import bucket_of, extract_bands
from wavemill.tuning import BandTuning


def exploded_bands(df: DataFrame, key: str, tuning: BandTuning, pos: str = "pos") -> DataFrame:
    """``(key, pos, band, band_value)`` for each band of each value; null arrays and elements give no row."""
    values = df.select(key, F.posexplode("values").alias(pos, "_v")).where(F.col("_v").isNotNull())
    return values.select(key, pos, F.posexplode(extract_bands("_v", tuning)).alias("band", "band_value"))


def band_postings(fingerprints: DataFrame, tuning: BandTuning = BandTuning()) -> DataFrame:
    """The index ``(bucket, band, band_value, fp_id, pos)``; equal postings are kept as often as they occur."""
    rows = exploded_bands(fingerprints, "fp_id", tuning)
    return rows.select(bucket_of(F.col("band"), F.col("band_value"), tuning).alias("bucket"), "band", "band_value", "fp_id", "pos")


def bucket_directory(postings: DataFrame) -> DataFrame:
    """``(bucket, n_postings)`` of the buckets in use."""
    return postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_postings"))


def band_stats(postings: DataFrame, tuning: BandTuning = BandTuning()) -> DataFrame:
    """One row: all buckets, postings, and postings a bucket in whole numbers, empty buckets included."""
    total = F.count(F.lit(1))
    return postings.agg(F.lit(tuning.total_buckets).cast("bigint").alias("total_buckets"), total.alias("total_postings"), F.floor(total / tuning.total_buckets).alias("avg_per_bucket"))


def posting_list(postings: DataFrame, bucket: int, overflow: DataFrame | None = None) -> DataFrame:
    """``(fp_id, pos)`` of one bucket, of the main and the overflow postings."""
    all_ = postings if overflow is None else postings.unionByName(overflow)
    return all_.where(F.col("bucket") == bucket).select("fp_id", "pos")


def band_search(queries: DataFrame, postings: DataFrame, tuning: BandTuning = BandTuning(), overflow: DataFrame | None = None) -> DataFrame:
    """Every posting ``(qid, fp_id, pos)`` that shares a band with a value of the query, as often as it does."""
    all_ = postings if overflow is None else postings.unionByName(overflow)
    bands = exploded_bands(queries, "qid", tuning, "qpos")
    return bands.join(all_.select("band", "band_value", "fp_id", "pos"), ["band", "band_value"]).select("qid", "fp_id", "pos")
