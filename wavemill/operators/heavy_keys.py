"""Per-key counts that no heavy key can delay: dense accumulators per input split, reduced block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys that one split's accumulators may hold before they are handed on.
FLUSH_KEYS = 1 << 19
#: Input rows per block of the key space; a block never holds more distinct keys than that.
ROWS_PER_BLOCK = 1 << 22


def _accumulate(keys: list, rows: list, pairs: list) -> tuple:
    """Dictionary-encode all keys gathered so far and scatter-add their counts into dense arrays."""
    encoded = pa.concat_arrays(keys).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    size = len(encoded.dictionary)
    n, d = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(n, codes, np.concatenate(rows))
    np.add.at(d, codes, np.concatenate(pairs))
    return encoded.dictionary, n, d


def _blocks_of(values: pa.Array, n_blocks: int) -> np.ndarray:
    """The block of each key: a mix of integer keys, a hash of the bytes of any other key."""
    if pa.types.is_integer(values.type):
        x = values.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(33)) % np.uint64(n_blocks)).astype(np.int32)
    x = pd.util.hash_array(values.cast(pa.string()).to_numpy(zero_copy_only=False).astype(object), categorize=False)
    return (x % np.uint64(n_blocks)).astype(np.int32)


def _split_counts(n_blocks: int, schema: pa.Schema):
    kind = schema.field("keys").type.value_type

    def emit(keys: pa.Array, n: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
        block = _blocks_of(keys, n_blocks)
        order = np.argsort(block, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0])
        offsets = pa.array(np.r_[starts, len(order)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (keys.take(pa.array(order)).cast(kind), pa.array(n[order]), pa.array(d[order]))]
        return pa.RecordBatch.from_arrays([pa.array(block[order][starts]), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, pairs, held = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            encoded = batch.column("key").dictionary_encode()
            codes = encoded.indices.to_numpy(zero_copy_only=False)
            size = len(encoded.dictionary)
            if "n" in batch.schema.names:
                n, d = np.zeros(size, np.int64), np.zeros(size, np.int64)
                np.add.at(n, codes, batch.column("n").to_numpy(zero_copy_only=False))
                np.add.at(d, codes, batch.column("d").to_numpy(zero_copy_only=False))
            else:
                n = np.bincount(codes, minlength=size).astype(np.int64)
                d = np.zeros(size, np.int64)
            keys.append(encoded.dictionary), rows.append(n), pairs.append(d)
            held += size
            if held > FLUSH_KEYS:
                merged = _accumulate(keys, rows, pairs)
                keys, rows, pairs, held = [merged[0]], [merged[1]], [merged[2]], len(merged[0])
                if held > FLUSH_KEYS // 2:
                    yield emit(*merged)
                    keys, rows, pairs, held = [], [], [], 0
        if held:
            yield emit(*_accumulate(keys, rows, pairs))

    return run


def _block_sums(kind: pa.DataType):
    """Sum the arrays of each block; the rows come sorted by block, so one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key_id", "n_rows", "n_counterparts"]
        keys, rows, pairs, held, base, block = [], [], [], 0, 0, None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            bounds = np.flatnonzero(np.r_[True, np.diff(blocks) != 0, True]) if len(blocks) else []
            for start, end in zip(bounds[:-1], bounds[1:]):
                if blocks[start] != block:
                    if held:
                        k, n, d = _accumulate(keys, rows, pairs)
                        yield pa.RecordBatch.from_arrays([k.cast(kind), pa.array(n), pa.array(d)], names=names)
                    keys, rows, pairs, held, base, block = [], [], [], 0, 0, blocks[start]
                part = batch.slice(start, end - start)
                keys.append(pc.list_flatten(part.column("keys")))
                rows.append(pc.list_flatten(part.column("n")).to_numpy(zero_copy_only=False))
                pairs.append(pc.list_flatten(part.column("d")).to_numpy(zero_copy_only=False))
                held += len(keys[-1])
                if held > 2 * base + FLUSH_KEYS:
                    k, n, d = _accumulate(keys, rows, pairs)
                    keys, rows, pairs, held, base = [k], [n], [d], len(k), len(k)
        if held:
            k, n, d = _accumulate(keys, rows, pairs)
            yield pa.RecordBatch.from_arrays([k.cast(kind), pa.array(n), pa.array(d)], names=names)

    return run


def key_counts(df: DataFrame, key: Column | str, counterpart: Column | str | None = None, *, rows: int | None = None) -> DataFrame:
    """Rows and distinct non-null counterparts of every non-null key: ``(key_id, n_rows, n_counterparts)``.

    Each input split dictionary-encodes its keys and adds their rows into dense arrays (bincount, scatter-add). The
    arrays leave the split cut into blocks of the key space, and blocks are summed in a distributed reduction, so a
    key with a third of all rows sends one number per split. Distinct counterparts are counted from deduplicated
    (key, counterpart) pairs, which are spread by the pair and not by the key. Without ``counterpart`` no pair is
    formed and ``n_counterparts`` is 0.

    ``rows`` is the number of input rows if it is known; else it is counted. It sets the number of blocks.
    Null keys are left out, null counterparts count as rows only, an empty table gives no row; other columns,
    whatever their names, are ignored.
    """
    key = F.col(key) if isinstance(key, str) else key
    spark = df.sparkSession
    if rows is None:
        rows = df.count()
    n_blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_BLOCK))
    if counterpart is None:
        splits = df.select(key.alias("key")).where(F.col("key").isNotNull())
    else:
        counterpart = F.col(counterpart) if isinstance(counterpart, str) else counterpart
        pairs = df.select(key.alias("key"), counterpart.alias("other")).where(F.col("key").isNotNull())
        splits = pairs.groupBy("key", "other").agg(F.count(F.lit(1)).alias("n")).select("key", "n", F.col("other").isNotNull().cast("bigint").alias("d"))
    kind = splits.schema["key"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    block_schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("n", T.ArrayType(T.LongType())), T.StructField("d", T.ArrayType(T.LongType()))])
    arrow_schema = pa.schema([("block", pa.int32()), ("keys", pa.list_(arrow)), ("n", pa.list_(pa.int64())), ("d", pa.list_(pa.int64()))])
    out = T.StructType([T.StructField("key_id", kind), T.StructField("n_rows", T.LongType()), T.StructField("n_counterparts", T.LongType())])
    blocks = splits.mapInArrow(_split_counts(n_blocks, arrow_schema), block_schema)
    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(_block_sums(arrow), out)


def heavy_keys(df: DataFrame, key: Column | str, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows: ``(key_id, n_rows)``. Rows with a null key count in the total."""
    total = df.count()
    return key_counts(df, key, rows=total).where(F.col("n_rows") >= F.lit(share) * F.lit(total)).select("key_id", "n_rows")
