"""Mixtures of sources in wanted shares, by weighted fair queueing over shuffled copies."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.sources.tables import materialise

#: Rows that one window of the running sums holds on average.
ROWS_PER_CELL = 20_000
#: Copies that one range of the queue holds on average; the driver adds up one number for each range.
ROWS_PER_RANGE = 1_000_000


def normal_source(c: Column | str) -> Column:
    """Source names are compared in lower case, without spaces around."""
    return F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", "")))


def _running(df: DataFrame, group: list[str], cell: str, order: list[Column], amount: str, name: str) -> DataFrame:
    """``df`` plus the running sum of ``amount`` in its group, in order of ``cell`` and then ``order``.

    The sums of whole cells run first (one row for each cell), then those inside each cell, so no window holds more
    than one cell.
    """
    cells = df.groupBy(*group, cell).agg(F.sum(amount).alias("_sum"))
    upto = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.join(offsets, [*group, cell]).withColumn(name, F.col("_before") + F.sum(amount).over(inside)).drop("_before")


def _settings(targets: DataFrame) -> DataFrame:
    """One row for each source of the targets: names that are equal after normalization add up their shares and take
    the greatest of their repeats."""
    rows = targets.select(normal_source(F.col("source")).alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull())
    return rows.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))


def _running_in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one sorted range with its number and their running sum in it."""
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        sums = total + np.cumsum(batch.column("amount").to_numpy())
        total = int(sums[-1]) if len(sums) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(sums.astype(np.int64))], names=[*batch.schema.names, "part", "sum"])


def _queued(queue: DataFrame, parts: int) -> DataFrame:
    """``queue`` plus ``position``, the tokens up to and including each copy in order of the finish times.

    The queue is sorted by ranges over all tasks; each range adds up its own, and the ranges' totals place them.
    """
    order = ["finish", "source", "copy", "id", "amount"]
    schema = T.StructType([*queue.schema, T.StructField("part", T.IntegerType()), T.StructField("sum", T.LongType())])
    ranges = queue.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_running_in_range, schema)
    ranges = materialise(ranges, "queue")
    totals = sorted((r.part, r.s) for r in ranges.groupBy("part").agg(F.max("sum").alias("s")).collect())
    before = [(p, b) for (p, _), b in zip(totals, accumulate((s for _, s in totals), initial=0))]
    offsets = queue.sparkSession.createDataFrame(before, "part int, before long")
    return ranges.join(F.broadcast(offsets), "part").withColumn("position", F.col("before") + F.col("sum")).drop("part", "sum", "before")


def mix(docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", amount_col: str = "n_tokens", seed: int = 1) -> DataFrame:
    """Rows of the mixture: ``(id, source, copy, amount, finish, position)``, a text once for each ``copy`` used.

    Each source's texts stand in a shuffled order, then again in another order for the second copy, up to
    ``max_repeats`` copies. A copy's virtual finish time is the source's running sum of tokens divided by its target
    share; all copies are range-sorted by that time and taken until the budget, the tokens of all texts of the targets'
    sources, is used up. While every source lasts, each gets its share; where one runs out of copies, the others
    share what it leaves in proportion.

    ``targets`` (source, target_share, max_repeats) is a configuration table of some rows and is read on the driver;
    equal sources add up their shares and take the greatest of their repeats. Sources compare by :func:`normal_source`; texts of other or null sources take no part, nor do texts of no tokens;
    a share of null or 0, or no repeats, leaves a source out of the mixture but in the budget. Repeated ids count as
    separate texts. An empty table gives no row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), normal_source(F.col(source_col)).alias("source"), F.col(amount_col).cast("bigint").alias("amount"))
    wanted = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in _settings(targets).collect()}
    rows = rows.where(F.col("source").isin(list(wanted)) & (F.col("amount") > 0))
    totals = {r.source: (r.s, r.n) for r in rows.groupBy("source").agg(F.sum("amount").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    budget = sum(s for s, _ in totals.values())
    use = {k: wanted[k] for k in totals if wanted[k][0] > 0 and wanted[k][1] > 0}
    # the time at which the budget is used up if every source drains at its share until its copies run out
    filled = lambda t: sum(min(w * t, m * totals[k][0]) for k, (w, m) in use.items())
    ends = sorted(m * totals[k][0] / w for k, (w, m) in use.items())
    close, before = ends[-1] if ends else 0.0, 0.0
    for t in ends:
        if filled(t) >= budget:
            rate = (filled(t) - filled(before)) / (t - before)
            close = before + (budget - filled(before)) / rate
            break
        before = t
    # of each source, as many copies of the whole as are begun by then; one more text may be reached
    copies = {k: min(m, int(min(w * close, m * totals[k][0]) // totals[k][0]) + 1) for k, (w, m) in use.items()}
    schema = "source string, share double, copies int, total long, cells long"
    plan = spark.createDataFrame([(k, use[k][0], copies[k], int(totals[k][0]), max(1, totals[k][1] // ROWS_PER_CELL)) for k in use], schema)
    mixed = rows.join(F.broadcast(plan), "source").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    mixed = mixed.withColumn("_key", F.xxhash64("id", "copy", F.lit(seed))).withColumn("_cell", F.pmod(F.shiftrightunsigned("_key", 20), F.col("cells")))
    mixed = _running(mixed, ["source", "copy"], "_cell", [F.col("_key"), F.col("id"), F.col("amount")], "amount", "_sum")
    mixed = mixed.withColumn("finish", (F.col("copy") * F.col("total") + F.col("_sum")) / F.col("share"))
    n = sum(totals[k][1] * copies[k] for k in use)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS_PER_RANGE))
    queue = _queued(mixed.select("id", "source", "copy", "amount", "finish"), parts)
    return queue.where(F.col("position") <= budget).select("id", "source", "copy", "amount", "finish", "position")


def mix_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source got: ``(source, target_share, share, amount, n_rows, n_texts, reached)``; ``reached``
    if the share lies within 0.01 of the target. Sources without any text are reported with 0."""
    got = mixture.groupBy("source").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_texts"))
    all_ = _settings(targets).drop("max_repeats").join(got, "source", "left").fillna(0, ["amount", "n_rows", "n_texts"])
    share = F.col("amount") / F.greatest(F.sum("amount").over(Window.partitionBy()), F.lit(1))
    all_ = all_.withColumn("share", share).withColumn("reached", F.abs(F.col("share") - F.col("target_share")) <= 0.01)
    return all_.select("source", "target_share", "share", "amount", "n_rows", "n_texts", "reached")
