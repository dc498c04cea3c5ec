"""Stretches of equal or nearly equal neighbouring events, found by a regular expression over symbol strings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.sources.tables import marked

#: Symbols are the code points above the basic plane, two for each event of a chunk's dictionary.
FIRST_SYMBOL, EVENTS = 0x10000, 1 << 19
#: Values turned into one symbol string at a time.
CHUNK = 1 << 19


def symbols(values: np.ndarray, starts: np.ndarray, max_bits: int) -> str:
    """One code point for each value: that of its canonical event.

    A value is taken for the event of the value before it if they differ in at most ``max_bits`` bits, so a chain of such
    values has its first one as canonical event; the first value of a record (``starts``) always begins a chain. A
    dictionary of the chunk's canonical events gives each its symbol, so equal events have equal symbols wherever they
    stand. Each event has a second symbol, which it takes only where it follows itself (one record ends with it and the
    next begins with it, or values drift away by small steps and jump back): these are two repetitions, not one.
    """
    new = np.ones(len(values), bool)
    new[1:] = np.bitwise_count(values[1:] ^ values[:-1]) > max_bits
    new[starts] = True
    first = np.flatnonzero(new)
    _, event = np.unique(values[first], return_inverse=True)
    event = event % EVENTS  # a single record of more events shares symbols, which the second symbol keeps apart as well
    place = np.arange(len(event))
    turn = (place - np.maximum.accumulate(np.where(np.r_[True, event[1:] != event[:-1]], place, 0))) % 2
    symbol = FIRST_SYMBOL + 2 * event + turn
    return symbol[np.cumsum(new) - 1].astype("<u4").tobytes().decode("utf-32-le")


def spans(text: str, min_len: int) -> np.ndarray:
    """Start and end of every longest repetition of one symbol, at least ``min_len`` long."""
    pattern = re.compile(r"(.)\1{%d,}" % (min_len - 1) if min_len > 1 else r"(.)\1*", re.S)
    return np.array([m.span() for m in pattern.finditer(text)], np.int64).reshape(-1, 2)


def _run(max_bits: int, min_len: int, schema: pa.Schema):
    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column("values")
        offsets = lists.offsets.to_numpy()
        flat = lists.values
        none = flat.is_null().to_numpy(zero_copy_only=False) if flat.null_count else None
        flat = flat.fill_null(0).to_numpy(zero_copy_only=False) if flat.null_count else flat.to_numpy()
        row = 0
        while row < len(batch):
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
            last = min(last, len(batch))
            base, at = offsets[row], offsets[row : last + 1] - offsets[row]
            values = flat[base : offsets[last]]
            if len(values):
                starts = at[:-1][at[:-1] < at[1:]]
                if none is not None:  # a null event stands for itself
                    lost = np.flatnonzero(none[base : offsets[last]])
                    starts = np.unique(np.r_[starts, lost, lost[lost + 1 < len(values)] + 1])
                found = spans(symbols(values, starts, max_bits), min_len)
                if len(found):
                    owner = np.searchsorted(at, found[:, 0], "right") - 1
                    pick = pa.array(owner + row)
                    start, length = found[:, 0] - at[owner], found[:, 1] - found[:, 0]
                    size = at[owner + 1] - at[owner]
                    first = pa.array(values[found[:, 0]], mask=None if none is None else none[base : offsets[last]][found[:, 0]])
                    ms = batch.column("duration_ms").take(pick)
                    share = pa.compute.divide(pa.compute.multiply(ms.cast(pa.float64()), pa.array(length.astype(float))), pa.array(size.astype(float)))
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), pa.array(start), pa.array(length), first, share], schema=schema)
            row = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from of(batch)

    return run


def collapse_runs(df: DataFrame, id_col: str = "fp_id", values_col: str = "values", duration_col: str = "duration_ms", *, max_bits: int = 2, min_len: int = 1) -> DataFrame:
    """Every longest stretch of at least ``min_len`` values in which each differs from the one before it in at most
    ``max_bits`` bits: ``(id, start_pos, run_len, value, run_ms)`` with the position from 0, the count of values, the
    first value and the stretch's share of the duration. With ``min_len`` 1 that is the collapsed sequence.

    Events become code points, records become strings and a backreference finds the repetitions; a record is
    handled inside its own row. Equal stretches of an id count once. With ``min_len`` 1, where the result is as long as
    the records, only the stretches of ids with several rows are compared, which a filter of fixed size tells apart; all
    others are shuffled nowhere.

    Null and empty ``values`` give no row; a null element is a stretch of its own with a null value; a null duration
    gives a null share; a null id is kept as an id. Columns other than the three named ones are ignored.
    """
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField("id", kind), T.StructField("start_pos", T.LongType()), T.StructField("run_len", T.LongType()), T.StructField("value", T.LongType()), T.StructField("run_ms", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = df.select(F.col(id_col).alias("id"), F.col(values_col).alias("values"), F.col(duration_col).cast("bigint").alias("duration_ms"))
    rows = rows.where(F.size("values") >= min_len)
    runs = _run(max_bits, min_len, to_arrow_schema(out))
    if min_len > 1:
        return rows.mapInArrow(runs, out).distinct()
    several = rows.groupBy("id").count().where("count > 1").select("id")
    known = marked(rows, several, "id", "several")
    alone, again = (known.where(which).drop("several").mapInArrow(runs, out) for which in ("not several", "several"))
    return alone.unionByName(again.distinct())
