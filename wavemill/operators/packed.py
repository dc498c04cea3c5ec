"""Tables of postings in few bytes: moved as blobs of columns, for searches over many buckets and for the layout of an index.

A posting is three numbers ``(key, code, at)``. Each task packs its postings by the part they go to; a blob holds the bytes
of a column plane by plane, compressed: the high planes are zeros and take up nothing.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.operators.dense import BAND_BITS, NO_ID, POS_BITS

#: Postings of a part, postings that a task packs at once, and meetings of them expanded at once; cells of the counts of
#: these, and candidates found before they are put to those kept.
PART_ROWS, PACKED_ROWS, MEETINGS, CELLS, PENDING = 1_000_000, 1_500_000, 1 << 18, 1 << 20, 1 << 17
#: Postings of a sample for each part of an index, and of the sample in all.
SAMPLED, MOST_SAMPLED = 200, 100_000

_BLOBS = "_to int, _part int, n long, " + ", ".join(f"c{i} binary" for i in range(5))


def _blob(a: np.ndarray) -> bytes:
    wide = len(a) and a.min() < 0
    planes = np.ascontiguousarray(a, "<i8").view(np.uint8).reshape(-1, 8).T
    used = 8 if wide else max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([used]) + pa.compress(planes[:used].tobytes(), "zstd", asbytes=True)


def _unblob(b: pa.Buffer, n: int) -> np.ndarray:
    used = b[0]
    out = np.zeros((n, 8), np.uint8)
    out[:, :used] = np.frombuffer(pa.decompress(b.slice(1), n * used, "zstd"), np.uint8).reshape(used, n).T
    return out.view("<i8").reshape(-1)


def _numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def _packing(rows: DataFrame, tasks: int, part_of: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """Blobs of all rows (up to five columns of numbers), each of one part, to be found in task ``_part`` modulo ``tasks``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            part = part_of(columns)
            order = np.argsort(part, kind="stable")
            there, starts = np.unique(part[order], return_index=True)
            for p, a, b in zip(there, starts, [*starts[1:], len(order)]):
                some = order[a:b]
                blobs = [pa.array([_blob(c[some])], pa.binary()) for c in columns]
                blobs += [pa.array([None], pa.binary())] * (5 - len(blobs))
                yield pa.RecordBatch.from_arrays([pa.array([int(p) % tasks], pa.int32()), pa.array([int(p)], pa.int32()), pa.array([int(b - a)]), *blobs], names=[x.split()[0] for x in _BLOBS.split(", ")])

        for b in batches:
            if len(b):
                held.append(_numbers(b))
            if sum(len(h[0]) for h in held) >= PACKED_ROWS:
                yield from flush()
        if held:
            yield from flush()

    return rows.mapInArrow(run, _BLOBS)


def _columns(blobs: list[tuple], n: int) -> list[np.ndarray]:
    return [np.concatenate([_unblob(b[3 + i], b[2]) for b in blobs]) if blobs else np.zeros(0, np.int64) for i in range(n)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The blobs of each part in turn; they come sorted by part."""
    part, blobs = None, []
    for batch in batches:
        numbers = zip(*(c.to_pylist() for c in batch.columns[:3]))
        for i, row in enumerate(numbers):
            if row[1] != part:
                if blobs:
                    yield part, blobs
                part, blobs = row[1], []
            blobs.append((*row, *(c[i].as_buffer() for c in batch.columns[3:])))  # not copied
    if blobs:
        yield part, blobs


def _table(kinds: dict[str, pa.DataType], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)).cast(kind) for c, kind in zip(columns, kinds.values())], names=list(kinds))


def _spread(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each id, from high bits of a product, so that ids in steps spread as well."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


class _Queries:
    """The query rows ``(key, code, at, n, least)`` of a batch, sorted by code."""

    def __init__(self, blobs: list[tuple]):
        key, code, at, n, least = _columns(blobs, 5)
        self.ids, q = np.unique(key, return_inverse=True)
        self.least = np.zeros(len(self.ids), np.int64)
        self.least[q] = least
        order = np.lexsort((q, code))
        self.q, self.at, self.n = q[order], at[order], n[order]
        self.codes, self.start, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.once = bool((n == 1).all())


def _best(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of ``(query, id, matches, first)`` the ``k`` of each query with most matches, then the least id."""
    order = np.lexsort((found[1], -found[2], found[0]))
    q = found[0][order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    turn = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return [c[order[turn < k]] for c in found]


def _met(queries: _Queries, key: np.ndarray, code: np.ndarray, at: np.ndarray, bar: np.ndarray, cells: int, meetings: int) -> Iterator[list[np.ndarray]]:
    """Of a few fingerprints at a time ``(query, id, matches, first)`` of those that reach the query's ``bar``, which may
    rise between them."""
    which = np.minimum(np.searchsorted(queries.codes, code), max(len(queries.codes) - 1, 0))
    meets = queries.codes[which] == code
    key, which, at = key[meets], which[meets], at[meets]
    if not len(key):
        return
    order = np.lexsort((at, which, key))
    key, which, at = key[order], which[order], at[order]
    # an id's postings of one bucket meet the same queries, so they meet once, by their number
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (which[1:] != which[:-1])])
    times = np.diff(np.r_[first, len(key)])
    key, which, at = key[first], which[first], at[first]
    ids, f = np.unique(key, return_inverse=True)
    edges = np.searchsorted(f, np.arange(len(ids) + 1))
    upto = np.cumsum(queries.count[which])
    many, most = len(queries.ids), max(1, cells // max(len(queries.ids), 1))
    a = 0
    while a < len(ids):
        before = upto[edges[a] - 1] if edges[a] else 0
        b = int(np.searchsorted(upto[edges[a + 1 : a + most + 1] - 1], before + meetings, "right")) + a
        b = min(max(b, a + 1), len(ids))
        s = slice(edges[a], edges[b])
        n = queries.count[which[s]]
        src = np.arange(n.sum()) + np.repeat(queries.start[which[s]] - (np.cumsum(n) - n), n)
        cell = np.repeat((f[s] - a) * many, n) + queries.q[src]
        weights = None if queries.once and (times[s] == 1).all() else np.repeat(times[s], n).astype(np.float64) * queries.n[src]
        m = np.bincount(cell, weights, minlength=(b - a) * many).reshape(b - a, many)  # sums of whole numbers below 2 ** 53 are exact
        enough = (m >= bar).reshape(-1)
        hits = np.flatnonzero(enough)
        if len(hits):
            own = np.flatnonzero(enough[cell])
            meeting = (queries.at[src[own]] << (POS_BITS + 1)) | np.repeat(at[s], n)[own]
            firsts = np.full(len(hits), np.iinfo(np.int64).max)
            np.minimum.at(firsts, np.searchsorted(hits, cell[own]), meeting)
            yield [hits % many, ids[a + hits // many], m.reshape(-1)[hits].astype(np.int64), firsts]
        a = b


def candidates(queries: DataFrame, postings: DataFrame, n_postings: int, k: int) -> DataFrame:
    """``(qid, fp_id, matches, qpos, pos)`` of the two sides ``dense.band_numbers``: of each task the ``k`` best of each query
    that reach its ``least``. A task takes its parts of the ids one after the other, so its memory is that of a part, of
    the queries and of what it keeps of each query."""
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    parts = max(tasks, n_postings // PART_ROWS + 1)
    own = _packing(postings, tasks, lambda c: _spread(c[0], parts))
    every = _packing(queries, tasks, lambda c: np.full(len(c[0]), -1)).withColumn("_to", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    moved = own.unionByName(every).repartitionById(tasks, "_to").sortWithinPartitions("_part")
    kinds = {"qid": pa.int64(), "fp_id": pa.int64(), "matches": pa.int64(), "qpos": pa.int32(), "pos": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept, bar, more = None, [np.zeros(0, np.int64)] * 4, np.zeros(0, np.int64), []

        def merged() -> list[np.ndarray]:
            best = _best([np.concatenate(c) for c in zip(kept, *more)], k)
            more.clear()
            n = np.bincount(best[0], minlength=len(bar))
            full = np.flatnonzero(n >= k)
            bar[full] = best[2][np.cumsum(n)[full] - 1]  # an id that only equals the k-th may still come before it
            return best

        for part, blobs in _parts(batches):
            if part < 0:
                held = _Queries(blobs)
                bar = np.maximum(held.least, 1)
                continue
            if held is None:
                return
            for found in _met(held, *_columns(blobs, 3), bar, CELLS, MEETINGS):
                more.append(found)
                if sum(len(m[0]) for m in more) >= max(PENDING, len(kept[0]) // 2):
                    kept = merged()
        if more:
            kept = merged()
        for a in range(0, len(kept[0]), 100_000):
            q, ids, m, first = (c[a : a + 100_000] for c in kept)
            yield _table(kinds, held.ids[q], ids, m, first >> (POS_BITS + 1 + BAND_BITS), first & ((1 << POS_BITS) - 1))

    found = moved.mapInArrow(run, "qid long, fp_id long, matches long, qpos int, pos int")
    return found.withColumn("qid", F.nullif("qid", F.lit(NO_ID)))


def laid_out(rows: DataFrame, buckets_per_band: int, kind: str) -> DataFrame:
    """Band postings sorted by bucket, id and position, each partition a range of them; ``kind`` is the type of a bucket.

    The bounds come from a sample of a bounded number of postings. The band and its value follow from the bucket.
    """
    spark = rows.sparkSession
    number = lambda c: F.coalesce(F.col(c), F.lit(NO_ID)).cast("bigint").alias(c)
    rows = rows.select(number("bucket"), number("fp_id"), number("pos"))
    n = rows.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) if n > PART_ROWS else 1
    parts = max(parts, n // PART_ROWS + 1)
    share = min(1.0, min(SAMPLED * parts, MOST_SAMPLED) / max(n, 1))
    sample = sorted(map(tuple, rows.sample(share, 1).collect())) if parts > 1 else []
    bounds = sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    buckets = np.array([b[0] for b in bounds], np.int64)

    def part_of(c: list[np.ndarray]) -> np.ndarray:
        part = np.searchsorted(buckets, c[0], "right")
        split = np.flatnonzero(np.searchsorted(buckets, c[0], "left") != part)  # only in the bucket of a bound the id counts, too
        part[split] = [bisect_right(bounds, x) for x in zip(*(a[split].tolist() for a in c))]
        return part

    moved = _packing(rows, len(bounds) + 1, part_of).repartitionById(len(bounds) + 1, "_to")
    whole = pa.int64() if kind == "bigint" else pa.int32()
    kinds = {"bucket": whole, "band": pa.int32(), "band_value": whole, "fp_id": pa.int64(), "pos": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in _parts(batches):
            bucket, ids, pos = _columns(blobs, 3)
            order = np.lexsort((pos, ids, bucket))
            for a in range(0, len(order), 100_000):
                o = order[a : a + 100_000]
                yield _table(kinds, bucket[o], bucket[o] // buckets_per_band, bucket[o] % buckets_per_band, ids[o], pos[o])

    out = moved.mapInArrow(run, f"bucket {kind}, band int, band_value {kind}, fp_id long, pos int")
    return out.withColumn("fp_id", F.nullif("fp_id", F.lit(NO_ID)))
