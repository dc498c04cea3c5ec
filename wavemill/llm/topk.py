"""The most frequent values of a column, by counting prefixes of their hashes and lengthening those that may win."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.sources.tables import materialise

#: Lengths, in bits of a 64-bit hash, of the prefixes that are counted before the values themselves.
LEVELS = (12, 24, 36)
#: Prefixes followed for each wanted value by the first descent, which only sets the lower bound.
BEAM = 4
#: Surviving prefixes up to which they are sent to every executor (some MB); more of them rule out too little to be
#: worth a join, and all values are counted in their place.
SENT_PREFIXES = 100_000


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("value"), 64 - bits)


def _within(values: DataFrame, bits: int, kept: DataFrame | None) -> DataFrame:
    """Values under the kept prefixes ``(p)``; all of them if there is nothing kept."""
    if kept is None:
        return values
    return values.withColumn("p", _prefix(bits)).join(F.broadcast(kept), "p", "left_semi").drop("p")


def _refine(values: DataFrame, least: int, levels: tuple[int, ...]) -> DataFrame:
    """Counts of all values that occur at least ``least`` times; a prefix counts at least as much as any value under it."""
    bits, kept = 0, None
    for level in levels if least > 1 else ():
        counts = _within(values, bits, kept).groupBy(_prefix(level).alias("p")).count().where(F.col("count") >= least)
        survivors = materialise(counts.select("p"), "prefixes")
        if survivors.count() > SENT_PREFIXES:
            break
        bits, kept = level, survivors
    return _within(values, bits, kept).groupBy("value").count().where(F.col("count") >= least)


def frequent_values(df: DataFrame, value: Column | str, *, share: float | None = None, k: int | None = None, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The most frequent non-null values and their exact counts: ``(value, n_rows)``.

    Either all values that hold at least ``share`` of all rows (null and repeated rows count in the total), or the
    ``k`` most frequent ones, equal counts in order of the value.

    SQL counts the prefixes of the values' hashes level by level. A prefix stays only if its count reaches the lower
    bound that a winning value needs, and only values under the prefixes of the last level are counted as such. So
    at most 1 / share prefixes are ever kept (for ``k``: rows divided by the k-th count), each level counts at most
    4096 prefixes for each of them, and nothing is kept for the many rare values. Survivors stay a table; where a flat
    column leaves more than ``SENT_PREFIXES`` of them, the values are counted from the prefixes of the level before.
    For ``k`` a first descent along the ``BEAM * k`` fullest prefixes counts ``k`` actual values; the least of these
    counts is the bound (1 if there are fewer). Both are exact. The driver holds the ``BEAM * k`` prefixes and ``k``
    counts of that descent and nothing else.

    An empty table, and a column of nulls, give no row. Other columns are ignored.
    """
    if (share is None) == (k is None):
        raise ValueError("give either share or k")
    values = df.select((F.col(value) if isinstance(value, str) else value).alias("value")).where(F.col("value").isNotNull())
    if share is not None:
        total = df.count()
        least = max(1, -int(-share * total // 1))
        return _refine(values, least, levels).select("value", F.col("count").alias("n_rows"))
    bits, kept = 0, None
    for level in levels:
        counts = _within(values, bits, kept).groupBy(_prefix(level).alias("p")).count()
        fullest = [(r.p,) for r in counts.orderBy(F.desc("count"), "p").limit(BEAM * k).collect()]
        bits, kept = level, df.sparkSession.createDataFrame(fullest, "p long")
    reached = _within(values, bits, kept).groupBy("value").count().orderBy(F.desc("count")).limit(k).select("count").collect()
    least = min((r[0] for r in reached), default=1) if len(reached) == k else 1
    found = _refine(values, least, levels).orderBy(F.desc("count"), "value").limit(k)
    return found.select("value", F.col("count").alias("n_rows"))
