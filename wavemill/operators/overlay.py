"""Latest-wins overlays: an overflow batch over a main table, lookups through both, and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, key: str, order: list[str] | None = None, first: bool = False) -> DataFrame:
    """One row for each key: the greatest by ``order`` (the first columns first), the least with ``first``.

    Without ``order`` the given columns themselves decide, so the choice never depends on how the rows lie. A null key
    is a key like any other. The reduction is an aggregate with a map-side part, so repeated keys don't skew it.
    """
    rest = [c for c in df.columns if c != key]
    by = F.struct(*[c for c in (order or rest)], *[c for c in rest if c not in (order or rest)])
    pick = F.min_by if first else F.max_by
    return df.groupBy(key).agg(pick(F.struct(*rest), by).alias("_row")).select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def overlay(main: DataFrame, overflow: DataFrame | None, key: str = "fp_id", mark: str | None = None) -> DataFrame:
    """All rows of ``overflow`` and those of ``main`` whose key isn't in it; null keys shadow nothing.

    ``mark`` names a boolean column that says which rows come from the overflow.
    """
    named = (lambda df, x: df.withColumn(mark, F.lit(x))) if mark else (lambda df, x: df)
    if overflow is None:
        return named(main, False)
    kept = main.join(overflow.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti").select(*main.columns)
    return named(overflow.select(*main.columns), True).unionByName(named(kept, False))


def lookup(main: DataFrame, overflow: DataFrame | None, keys: DataFrame, key: str = "fp_id") -> DataFrame:
    """Rows of the wanted ``keys``: those of the overflow, else of the main table."""
    wanted = keys.select(key).distinct()
    found = main.join(wanted, key, "left_semi")
    return overlay(found, overflow.join(wanted, key, "left_semi") if overflow is not None else None, key)


def first_of_batch(records: DataFrame, key: str = "fp_id", order: str = "seq") -> DataFrame:
    """Of each key of an ingest batch its first record, by the ingest order ``order``."""
    return one_per_key(records, key, [order], first=True)
