"""Array codecs: xor-deltas in variable-length bytes, and in bit-packed blocks with exceptions.

The first value stands as four little-endian bytes, then the xor of each value with the one before it. Spark runs the
codecs as Arrow functions; a batch of arrays is encoded in variable length at once, in blocks one array at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from wavemill.errors import InvalidCompression, TruncatedVarint

# Fixed value: values of a packed block.
BLOCK = 128


def varint_encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all numbers, 7 bits each from the lowest, and the length of each."""
    x = x.astype(np.uint64)
    size = 1 + sum((x >= np.uint64(1 << b)).astype(np.int64) for b in (7, 14, 21, 28))
    at = np.r_[0, np.cumsum(size)]
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        has = size > k
        part = (x[has] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[:-1][has] + k] = part.astype(np.uint8) | np.where(size[has] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def varint_decode(data: np.ndarray, count: int) -> tuple[np.ndarray, int]:
    """The first ``count`` numbers, and how many bytes they took."""
    ends = np.flatnonzero(data < 128)[:count]
    if len(ends) < count:
        raise TruncatedVarint(f"{len(ends)} numbers of {count}")
    if not count:
        return np.zeros(0, np.uint64), 0
    starts = np.r_[0, ends[:-1] + 1]
    if (ends - starts >= 5).any():
        raise TruncatedVarint("more than 5 bytes")
    out = np.zeros(count, np.uint64)
    for k in range(5):
        has = starts + k <= ends
        out[has] |= (data[starts[has] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    return out & np.uint64(0xFFFFFFFF), int(ends[-1] + 1)


def block_width(x: np.ndarray) -> int:
    """Bits that hold nine tenths of the numbers."""
    widths = np.sort(np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(int) + 1, 0))
    return int(widths[max(len(x) * 9 // 10 - 1, 0)]) if len(x) else 0


def pack_block(x: np.ndarray) -> bytes:
    """One block: width, number of exceptions, packed low bits, exceptions as position and whole number."""
    width = block_width(x)
    x = x.astype(np.uint64)
    over = np.flatnonzero(x >> np.uint64(width)) if width < 32 else np.zeros(0, int)
    bits = ((x[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    tail = np.zeros(len(over), np.dtype([("i", "u1"), ("v", "<u4")]))
    tail["i"], tail["v"] = over, x[over]
    return bytes([width, len(over)]) + np.packbits(bits.ravel(), bitorder="little").tobytes() + tail.tobytes()


def unpack_block(data: bytes, at: int, count: int) -> tuple[np.ndarray, int]:
    """The ``count`` numbers of the block that begins at ``at``, and where the next begins."""
    if at + 2 > len(data):
        raise InvalidCompression("a block is missing")
    width, n_over = data[at], data[at + 1]
    body = (count * width + 7) // 8
    end = at + 2 + body + 5 * n_over
    if width > 32 or end > len(data):
        raise InvalidCompression("a block is broken")
    bits = np.unpackbits(np.frombuffer(data, np.uint8, body, at + 2), bitorder="little")[: count * width].reshape(count, width).astype(np.uint64)
    out = (bits << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64) if width else np.zeros(count, np.uint64)
    tail = np.frombuffer(data, np.dtype([("i", "u1"), ("v", "<u4")]), n_over, at + 2 + body)
    if n_over and int(tail["i"].max()) >= count:
        raise InvalidCompression("an exception lies outside its block")
    out[tail["i"]] = tail["v"]
    return out, end


def compress(values: np.ndarray) -> bytes:
    """Variable-length encoding of one array; nothing for an empty one."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    return int(v[0]).to_bytes(4, "little") + varint_encode(v[1:] ^ v[:-1])[0].tobytes()


def decompress(data: bytes, count: int) -> np.ndarray:
    if count == 0:
        return np.zeros(0, np.int64)
    if len(data) < 4:
        raise InvalidCompression("no first value")
    deltas, _ = varint_decode(np.frombuffer(data, np.uint8, offset=4), count - 1)
    return np.bitwise_xor.accumulate(np.r_[np.uint64(int.from_bytes(data[:4], "little")), deltas]).astype(np.int64)


def compress_all(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``compress`` of many arrays, array k from ``offsets[k]`` to ``offsets[k + 1]``: all bytes, and where each begins."""
    v, n = np.asarray(values, np.uint64), np.diff(offsets)
    x = np.zeros(len(v), np.uint64)
    x[1:] = v[1:] ^ v[:-1]
    heads = offsets[:-1][n > 0]
    rest = np.ones(len(v), bool)
    rest[heads] = False
    data, size = varint_encode(x[rest])
    each = np.zeros(len(v), np.int64)
    each[rest], each[heads] = size, 4
    before = np.r_[0, np.cumsum(each)]
    at = before[offsets]
    out = np.empty(at[-1], np.uint8)
    first = before[heads][:, None] + np.arange(4)
    body = np.ones(len(out), bool)
    body[first] = False
    out[first] = v[heads].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[body] = data
    return out, at


def decompress_all(data: np.ndarray, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``decompress`` of many arrays, one after the other; bytes beyond an array's count are left out."""
    n = counts.astype(np.int64)
    if (np.diff(at)[n > 0] < 4).any():
        raise InvalidCompression("no first value")
    head = at[:-1][n > 0][:, None] + np.arange(4)
    stops = data < 128
    stops[head] = False
    stop = np.flatnonzero(stops)
    # of each array, its first count - 1 numbers: where they end, and where they begin
    low, high = np.searchsorted(stop, at[:-1]), np.searchsorted(stop, at[1:])
    wanted = np.maximum(n - 1, 0)
    if (high - low < wanted).any():
        raise TruncatedVarint("numbers are missing")
    place = np.repeat(low - (np.cumsum(wanted) - wanted), wanted) + np.arange(wanted.sum())
    ends = stop[place]
    first = np.zeros(len(place), bool)
    first[(np.cumsum(wanted) - wanted)[wanted > 0]] = True
    starts = np.where(first, np.repeat(at[:-1] + 4, wanted), np.r_[-1, ends[:-1]] + 1)
    if (ends - starts >= 5).any():
        raise TruncatedVarint("more than 5 bytes")
    deltas = np.zeros(len(place), np.uint64)
    for k in range(5):
        has = starts + k <= ends
        deltas[has] |= (data[starts[has] + k].astype(np.uint64) & np.uint64(127)) << np.uint64(7 * k)
    x = np.zeros(n.sum(), np.uint64)
    begin = np.cumsum(n) - n
    heads = begin[n > 0]
    rest = np.ones(len(x), bool)
    rest[heads] = False
    x[heads] = np.ascontiguousarray(data[head]).view("<u4").ravel()
    x[rest] = deltas & np.uint64(0xFFFFFFFF)
    run = np.bitwise_xor.accumulate(x) if len(x) else x
    return (run ^ np.repeat(np.r_[np.uint64(0), run][heads], n[n > 0])).astype(np.int64)


def compress_packed(values: np.ndarray) -> bytes:
    """Block-packed encoding of one array; nothing for an empty one."""
    v = np.asarray(values, np.uint64)
    if not len(v):
        return b""
    d = v[1:] ^ v[:-1]
    return int(v[0]).to_bytes(4, "little") + b"".join(pack_block(d[k : k + BLOCK]) for k in range(0, len(d), BLOCK))


def decompress_packed(data: bytes, count: int) -> np.ndarray:
    if count == 0:
        return np.zeros(0, np.int64)
    if len(data) < 4:
        raise InvalidCompression("no first value")
    parts, at = [np.array([int.from_bytes(data[:4], "little")], np.uint64)], 4
    for k in range(0, count - 1, BLOCK):
        part, at = unpack_block(data, at, min(BLOCK, count - 1 - k))
        parts.append(part)
    return np.bitwise_xor.accumulate(np.concatenate(parts)).astype(np.int64)


def compress_postings(ids: np.ndarray, positions: np.ndarray) -> bytes:
    """Sorted (id, position) pairs: first id, packed differences of the ids, then all positions in two bytes each."""
    ids = np.asarray(ids, np.uint64)
    if not len(ids):
        return b""
    d = (ids[1:] - ids[:-1]) & np.uint64(0xFFFFFFFF)
    return int(ids[0]).to_bytes(4, "little") + b"".join(pack_block(d[k : k + BLOCK]) for k in range(0, len(d), BLOCK)) + np.asarray(positions, "<u2").tobytes()


def decompress_postings(data: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    if count == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < 4:
        raise InvalidCompression("no first id")
    parts, at = [np.array([int.from_bytes(data[:4], "little")], np.uint64)], 4
    for k in range(0, count - 1, BLOCK):
        part, at = unpack_block(data, at, min(BLOCK, count - 1 - k))
        parts.append(part)
    if at + 2 * count > len(data):
        raise InvalidCompression("positions are missing")
    ids = (np.cumsum(np.concatenate(parts), dtype=np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return ids, np.frombuffer(data, "<u2", count, at).astype(np.int64)


def _encoder(one):
    def run(values: pa.Array) -> pa.Array:
        return pa.array([one(np.array(v.values.to_numpy(zero_copy_only=False), np.int64)) if v.is_valid else None for v in values], pa.binary())

    return run


def _decoder(one):
    def run(data: pa.Array, count: pa.Array) -> pa.Array:
        return pa.array([one(d.as_py(), n.as_py()) if d.is_valid and n.is_valid else None for d, n in zip(data, count)], pa.list_(pa.int64()))

    return run


def _applied(function, result: str, *columns: Column | str) -> Column:
    run = F.arrow_udf(function, result)
    return run(*columns)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The items of all lists (or the bytes of all binaries) that aren't null, and where each begins."""
    column = column.drop_null()
    if pa.types.is_binary(column.type):
        at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(at) else np.zeros(0, np.uint8)
        return data, at - at[0] if len(at) else np.zeros(1, np.int64)
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), at - at[0]


def _placed(array: pa.Array, there: np.ndarray) -> pa.Array:
    """The items of ``array`` at the rows that are ``there``, nulls elsewhere."""
    return array.take(pa.array(np.cumsum(there) - 1, mask=~there))


def encoded(values: Column | str) -> Column:
    """Bytes of the variable-length encoding, a batch of arrays at a time; null for null."""

    def run(values: pa.Array) -> pa.Array:
        there = values.is_valid().to_numpy(zero_copy_only=False)
        if not there.any():
            return pa.nulls(len(values), pa.binary())
        data, at = compress_all(*_flat(values))
        return _placed(pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]), there)

    return _applied(run, "binary", values)


def decoded(data: Column | str, count: Column | str) -> Column:
    def run(data: pa.Array, count: pa.Array) -> pa.Array:
        there = data.is_valid().to_numpy(zero_copy_only=False) & count.is_valid().to_numpy(zero_copy_only=False)
        if not there.any():
            return pa.nulls(len(data), pa.list_(pa.int64()))
        n = count.filter(pa.array(there)).to_numpy()
        values = decompress_all(*_flat(data.filter(pa.array(there))), n)
        return _placed(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(values)), there)

    return _applied(run, "array<bigint>", data, count)


def encoded_packed(values: Column | str) -> Column:
    """Bytes of the block-packed encoding; null for null."""

    def run(values: pa.Array) -> pa.Array:
        return _encoder(compress_packed)(values)

    return _applied(run, "binary", values)


def decoded_packed(data: Column | str, count: Column | str) -> Column:
    def run(data: pa.Array, count: pa.Array) -> pa.Array:
        return _decoder(decompress_packed)(data, count)

    return _applied(run, "array<bigint>", data, count)


def encoded_postings(ids: Column | str, positions: Column | str) -> Column:
    """Bytes of a posting list, sorted by id; null for null."""

    def run(ids: pa.Array, positions: pa.Array) -> pa.Array:
        lists = lambda a: [np.array(v.values.to_numpy(zero_copy_only=False), np.int64) if v.is_valid else None for v in a]
        return pa.array([None if i is None or p is None else compress_postings(i, p) for i, p in zip(lists(ids), lists(positions))], pa.binary())

    return _applied(run, "binary", ids, positions)


def decoded_postings(data: Column | str, count: Column | str) -> Column:
    """A struct of ``ids`` and ``positions``."""

    def run(data: pa.Array, count: pa.Array) -> pa.Array:
        both = [decompress_postings(d.as_py(), n.as_py()) if d.is_valid and n.is_valid else None for d, n in zip(data, count)]
        return pa.array([None if b is None else {"ids": b[0], "positions": b[1]} for b in both], pa.struct([("ids", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))]))

    return _applied(run, "struct<ids:array<bigint>,positions:array<bigint>>", data, count)
