"""Long exact stretches that records share, by rolling hashes of every window of fixed length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.sources.tables import partitions_for

#: Bases of the two rolling hashes modulo 2 ** 64 (odd, so that an inverse exists). A window is known by all 64 bits of
#: the first and 32 of the second: among 10 ** 13 windows less than one pair of unlike ones is expected to agree.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Windows and records that a task remembers.
REMEMBERED = 1 << 20
#: Bytes of windows that a task puts together.
PARTITION_BYTES = 16 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, so that near values get unrelated hashes."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)])[:n]


def window_hashes(values: np.ndarray, offsets: np.ndarray, width: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hash of every window of ``width`` values that lies in one record, the window's start in ``values``, and
    the hash of each whole record.

    With S the running sum of value * base ** i, the window at i hashes to (S[i + width] - S[i]) * base ** -i.
    """
    n = len(values)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(values) * _powers(base, n), out=run[1:])
    back = _powers(pow(base, -1, 1 << 64), n + 1)
    whole = (run[offsets[1:]] - run[offsets[:-1]]) * back[offsets[:-1]]
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, offsets[:-1][counts > 0], 1)
    np.add.at(edges, (offsets[:-1] + counts)[counts > 0], -1)
    start = np.flatnonzero(np.cumsum(edges) > 0)
    return mixed((run[start + width] - run[start]) * back[start]), start, mixed(whole)


def _once(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, known: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The records without those that the task has had before, id and values alike."""
    *_, whole = window_hashes(values, offsets, 1 << 30)
    sizes, keep = np.diff(offsets), np.zeros(len(ids), bool)
    for i, key in enumerate(zip(ids.tolist(), whole.tolist(), sizes.tolist())):
        if key not in known:
            if len(known) >= REMEMBERED:
                known.clear()
            known.add(key)
            keep[i] = True
    return ids[keep], values[np.repeat(keep, sizes)], np.r_[0, np.cumsum(sizes[keep])].astype(np.int64)


def _windows(width: int, schema: pa.Schema):
    """Rows (h, g, id, at): of a window its hashes and position, of a hash that is known to be shared -1 in place of the
    position, of an interval that is settled already a hash of its own and start and end as two halves of one number."""

    def batch_of(h: np.ndarray, g: np.ndarray, ids: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.astype(np.int64)), pa.array(ids), pa.array(at.astype(np.int64))], schema=schema)

    def of(ids: np.ndarray, values: np.ndarray, offsets: np.ndarray, told: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, start, _ = window_hashes(values, offsets, width)
        if not len(h):
            return
        g = window_hashes(values, offsets, width, SECOND)[0] >> np.uint64(32)
        owner = np.searchsorted(offsets, start, "right") - 1
        order = np.lexsort((g, h))
        h, g, who, pos = h[order], g[order], ids[owner[order]], (start - offsets[owner])[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        size = np.diff(np.r_[first, len(h)])
        # what has been told holds of two ids, so of one beside the window's own
        at = np.minimum(np.searchsorted(told[0], h[first]), max(len(told[0]) - 1, 0))
        before = (told[0][at] == h[first]) & (told[1][at] == g[first]) if len(told[0]) else np.zeros(len(first), bool)
        here = np.minimum.reduceat(who, first) != np.maximum.reduceat(who, first)
        shared = np.repeat(here | before, size)
        yield batch_of(h[~shared], g[~shared], who[~shared], pos[~shared])
        new = first[here & ~before]
        if len(new):  # one row tells the other tasks; the windows themselves need no partner any more
            yield batch_of(h[new], g[new], who[new], np.full(len(new), -1))
            every = [np.r_[t, x[new]] for t, x in zip(told, (h, g))] if len(told[0]) + len(new) <= REMEMBERED else [h[new], g[new]]
            order = np.argsort(every[0], kind="stable")
            told[:] = [x[order] for x in every]
        if shared.any():
            order = np.lexsort((pos[shared], who[shared]))
            w, p = who[shared][order], pos[shared][order]
            begins = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (p[1:] > p[:-1] + width)])
            ends = np.r_[p[begins[1:] - 1], p[-1:]] + width
            own = mixed(mixed(w[begins]) + p[begins].astype(np.uint64))
            yield batch_of(own, np.full(len(begins), 1 << 32), w[begins], ends << 32 | p[begins])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, known = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)], set()
        for batch in batches:
            lists = batch.column("values")
            flat = lists.flatten()
            if not len(flat):
                continue
            offsets = np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))].astype(np.int64)
            yield from of(*_once(batch.column("id").to_numpy(), flat.fill_null(-1).to_numpy(zero_copy_only=False), offsets, known), told)

    return run


def shared_windows(df: DataFrame, id_col: str, values_col: str, width: int) -> DataFrame:
    """Intervals ``(id, start_pos, end_pos)`` of values that stand, window by window, in another id's record too.

    Windows shared inside one Arrow batch, or found to be shared by an earlier batch of the task, are settled there and
    sent on as merged intervals; the window itself is told once by each task. So a window that a third of all records
    hold costs one row a task, and an id delivered again and again counts once a task. All other windows meet by
    their hashes in one shuffle and are counted there.
    """
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("h", "g", "id", "at")])
    arrow = pa.schema([(c, pa.int64()) for c in out.names])
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(values_col).alias("values"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("values") >= width))
    windows = rows.mapInArrow(_windows(width, arrow), out)
    same = Window.partitionBy("h", "g")
    # a window's row takes some three times the bytes of the value that it begins with
    met = windows.repartition(partitions_for(df, 3.0, PARTITION_BYTES), "h")
    met = met.withColumns({"low": F.min("id").over(same), "high": F.max("id").over(same), "told": F.min("at").over(same) < 0})
    end = F.shiftright("at", 32).cast("int")
    kept = met.where((end > 0) | ((F.col("at") >= 0) & (F.col("told") | (F.col("low") != F.col("high")))))
    pos = F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    return kept.select("id", pos.alias("start_pos"), F.when(end > 0, end).otherwise(pos + width).alias("end_pos"))


def shared_spans(df: DataFrame, id_col: str = "fp_id", values_col: str = "values", *, width: int = 32) -> DataFrame:
    """Maximal intervals ``(id, start_pos, end_pos)`` in which every value lies in a stretch of at least ``width``
    values that stands, value for value, in the record of another id. ``end_pos`` is exclusive.

    Rows of one id count as one record; repeated rows change nothing. Null ids, null or short ``values`` give no row;
    null elements compare as equal to each other. Other columns are ignored.
    """
    parts = shared_windows(df, id_col, values_col, width)
    order = Window.partitionBy("id").orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("start_pos") > reach, 1).when(reach.isNull(), 1).otherwise(0)
    numbered = parts.withColumn("new", new).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("id", "span").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("span")


def shared_counts(df: DataFrame, id_col: str = "fp_id", values_col: str = "values", *, width: int = 32) -> DataFrame:
    """For each id with shared stretches, how many of its values they cover: ``(id, n_shared)``."""
    covered = shared_spans(df, id_col, values_col, width=width)
    return covered.groupBy("id").agg(F.sum(F.col("end_pos") - F.col("start_pos")).cast("bigint").alias("n_shared"))
