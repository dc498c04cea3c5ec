"""Deterministic fingerprints from a linear congruential generator, for tests and demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.schema import U32

# Multiplier and increment of the generator, milliseconds a value.
MULTIPLIER, INCREMENT, MS = 1103515245, 12345, 100


def lcg_fingerprints(ids: DataFrame, count: int, id_col: str = "fp_id") -> DataFrame:
    """``(fp_id, duration_ms, values)``: from each id as the seed, ``count`` steps modulo 2 ** 32."""
    step = lambda s: (s * F.lit(MULTIPLIER) + F.lit(INCREMENT)).bitwiseAND(F.lit(U32))
    start = F.array(F.col(id_col).cast("bigint"))
    made = F.aggregate(F.sequence(F.lit(1), F.lit(count)), start, lambda acc, _: F.concat(acc, F.array(step(F.element_at(acc, -1)))))
    return ids.select(F.col(id_col).cast("bigint").alias("fp_id"), F.lit(count * MS).cast("bigint").alias("duration_ms"), F.slice(made, 2, count).alias("values"))


def lcg_range(spark: SparkSession, first: int, last: int, count: int) -> DataFrame:
    return lcg_fingerprints(spark.range(first, last + 1).withColumnRenamed("id", "fp_id"), count)
