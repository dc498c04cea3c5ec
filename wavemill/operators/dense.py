"""Searches of large batches by arrays: each task holds all postings of its fingerprints and meets them with every query.

Where a batch meets most postings of an index, the meetings are many times the tables. They are not made as rows here:
counted bands meet by a matrix product, votes are expanded for a few fingerprints at a time, counted and forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.sources.tables import partitions_for

#: Stands for a null id among the numbers.
NO_ID = -(1 << 63)
#: Cells of one matrix, and votes expanded at once (as many as stay in a core's cache).
CELLS, VOTES = 1 << 21, 1 << 16
#: Rows of a batch that leaves a task.
ROWS = 1 << 16
#: Bits of a position, below the bit of a late posting; bits of a band below a query's position.
POS_BITS, BAND_BITS = 26, 5
#: How many times the bytes of its files an index takes as arrays.
GROWTH = 6


def _parts(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``(_part, key, code, at, n, least)`` of both tables: postings (``n`` = 0) in the part of their id, queries in
    every part."""
    n = max(2 * queries.sparkSession.sparkContext.defaultParallelism, partitions_for(index, GROWTH))
    every = queries.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    own = index.withColumns({"_part": F.pmod(F.xxhash64("key"), F.lit(n)).cast("int"), "n": F.lit(0).cast("bigint"), "least": F.lit(0).cast("bigint")})
    return every.unionByName(own).repartitionById(n, "_part").drop("_part")


class _Held:
    """The queries and postings of one task: queries by number, postings sorted by id."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        rows = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if len(b)]
        key, code, at, n, least = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, np.int64) for _ in range(5))
        q = n > 0
        self.qids, self.q = np.unique(key[q], return_inverse=True)
        self.qcode, self.qat, self.qn = code[q], at[q], n[q]
        self.least = np.zeros(len(self.qids), np.int64)
        self.least[self.q] = least[q]
        order = np.argsort(key[~q], kind="stable")
        self.ids, self.f = np.unique(key[~q][order], return_inverse=True)
        self.code, self.at = code[~q][order], at[~q][order]

    def chunks(self, most: int) -> Iterator[tuple[int, int, slice]]:
        """Ranges of ``most`` fingerprints with the slice of their postings."""
        for a in range(0, len(self.ids), most):
            b = min(a + most, len(self.ids))
            yield a, b, slice(*np.searchsorted(self.f, [a, b]))


def _blocks(held: _Held, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable]]:
    """For each block of queries: their numbers, their matrix (bucket, query), and their buckets in order of the
    meetings with the query positions there; and what gives the matrix (id, bucket) of a range of fingerprints."""
    order = np.lexsort((held.qat, held.q))
    q, code, at, n = held.q[order], held.qcode[order], held.qat[order], held.qn[order]
    edges = np.searchsorted(q, np.arange(len(held.qids) + 1))
    most_p = np.bincount(held.f).max(initial=0)
    most_q = np.bincount(q, n).max(initial=0)
    kind = np.float32 if float(most_p) * float(most_q) < 1 << 24 else np.float64  # sums of counts stay exact

    def matrix(a: int, b: int, s: slice) -> np.ndarray:
        return np.bincount((held.f[s] - a) * buckets + held.code[s], minlength=(b - a) * buckets).reshape(b - a, buckets).astype(kind)

    size = max(1, CELLS // buckets)
    for a in range(0, len(held.qids), size):
        b = min(a + size, len(held.qids))
        s = slice(edges[a], edges[b])
        wide = np.zeros((buckets, b - a), kind)
        wide[code[s], q[s] - a] = n[s]
        turn = np.arange(edges[a], edges[b]) - edges[q[s]]
        listed = np.full((b - a, max(1, int(np.diff(edges[a : b + 1]).max(initial=0)))), buckets, np.int64)
        places = np.zeros_like(listed)
        listed[q[s] - a, turn], places[q[s] - a, turn] = code[s], at[s] >> BAND_BITS
        yield np.arange(a, b), wide, listed, places, matrix


def _best(key: np.ndarray, f: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` rows of each query with most matches, then the least id, in that order."""
    order = np.lexsort((f, -m, key))
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    turn = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
    order = order[turn < k]
    return key[turn < k], f[order], m[order]


def _first_meetings(held: _Held, buckets: int, q: np.ndarray, f: np.ndarray, listed: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each pair of a query and a fingerprint first meets: the query's position and the posting's."""
    qpos, pos = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
    order = np.argsort(f, kind="stable")
    for a, b, s in held.chunks(max(1, CELLS // buckets)):
        some = order[slice(*np.searchsorted(f[order], [a, b]))]
        if not len(some):
            continue
        none = np.iinfo(np.int64).max
        first = np.full((b - a, buckets + 1), none)
        np.minimum.at(first.reshape(-1), (held.f[s] - a) * (buckets + 1) + held.code[s], held.at[s])
        for start in range(0, listed.shape[1], 16):
            tried = listed[q[some], start : start + 16]
            there = first[(f[some] - a)[:, None], tried] != none
            met = there.any(1)
            hit, at = some[met], there[met].argmax(1)
            qpos[hit] = places[q[hit], start + at]
            pos[hit] = first[f[hit] - a, listed[q[hit], start + at]] & ((1 << POS_BITS) - 1)
            some = some[~met]
            if not len(some):
                break
    return qpos, pos


def _table(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, dtype=np.int64)) for c in columns.values()], names=list(columns))


def band_numbers(queries: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a band search as numbers: queries ``(qid, bucket, band, qn, q1, least)`` and postings
    ``(fp_id, bucket, late, pos)``."""
    at = F.shiftleft(F.col("q1").cast("bigint"), BAND_BITS) + F.col("band")
    q = queries.select(F.coalesce("qid", F.lit(NO_ID)).cast("bigint").alias("key"), F.col("bucket").cast("bigint").alias("code"), at.cast("bigint").alias("at"), F.col("qn").alias("n"), F.col("least").cast("bigint").alias("least"))
    late = F.shiftleft(F.col("late").cast("bigint"), POS_BITS) + F.col("pos")
    return q, postings.select(F.col("fp_id").cast("bigint").alias("key"), F.col("bucket").cast("bigint").alias("code"), late.alias("at"))


def band_rows(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """The numbers of both sides, each posting in the part of its id."""
    return _parts(*band_numbers(queries, postings))


def band_candidates(rows: DataFrame, buckets: int, k: int) -> DataFrame:
    """``(qid, fp_id, matches, qpos, pos)`` of ``band_rows``: of each part of the ids the ``k`` best of each query
    that reach its ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(batches)
        for numbers, wide, listed, places, matrix in _blocks(held, buckets):
            least = held.least[numbers]
            bar = np.maximum(least, 1)  # a later id must have more matches than the k-th so far
            kept = tuple(np.zeros(0, np.int64) for _ in range(3))
            for a, b, s in held.chunks(max(1, CELLS // buckets)):
                m = matrix(a, b, s) @ wide
                f, q = np.nonzero(m >= bar.astype(m.dtype))
                if not len(f):
                    continue
                more = (q, f + a, m[f, q].astype(np.int64))
                kept = _best(*(np.concatenate(x) for x in zip(kept, more)), k)
                n = np.bincount(kept[0], minlength=len(numbers))
                full = np.flatnonzero(n >= k)
                bar[full] = kept[2][np.cumsum(n)[full] - 1] + 1
            q, f, m = kept
            qpos, pos = _first_meetings(held, buckets, q, f, listed, places)
            yield _table(qid=held.qids[numbers[q]], fp_id=held.ids[f], matches=m, qpos=qpos, pos=pos)

    found = rows.mapInArrow(run, "qid long, fp_id long, matches long, qpos long, pos long")
    return found.select(F.nullif("qid", F.lit(NO_ID)).alias("qid"), "fp_id", "matches", F.col("qpos").cast("int").alias("qpos"), F.col("pos").cast("int").alias("pos"))


def band_counts(rows: DataFrame, buckets: int) -> DataFrame:
    """``(qid, n_matches, n_fps)`` of ``band_rows``: all meetings of a query, and the ids that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(batches)
        for numbers, wide, _, _, matrix in _blocks(held, buckets):
            total, n = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
            for a, b, s in held.chunks(max(1, CELLS // buckets)):
                m = matrix(a, b, s) @ wide
                total += m.sum(0, dtype=np.float64).astype(np.int64)
                n += np.count_nonzero(m, axis=0)
            yield _table(qid=held.qids[numbers[n > 0]], n_matches=total[n > 0], n_fps=n[n > 0])

    found = rows.mapInArrow(run, "qid long, n_matches long, n_fps long")
    return found.groupBy("qid").agg(F.sum("n_matches").alias("n_matches"), F.sum("n_fps").alias("n_fps")).withColumn("qid", F.nullif("qid", F.lit(NO_ID)))


def band_sums(rows: DataFrame, buckets: int) -> DataFrame:
    """``(qid, fp_id, n, positions)`` of ``band_rows``: of each pair that meets, how often it does and the sum of the
    postings' positions over all meetings, each by a matrix product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(batches)
        pos = held.at & ((1 << POS_BITS) - 1)
        for numbers, wide, _, _, matrix in _blocks(held, buckets):
            most = float(wide.sum(0, dtype=np.float64).max(initial=0))
            for a, b, s in held.chunks(max(1, CELLS // buckets)):
                sums = np.bincount((held.f[s] - a) * buckets + held.code[s], pos[s], (b - a) * buckets).reshape(b - a, buckets)
                kind = np.float32 if sums.sum(1).max(initial=0) * most < 1 << 24 else np.float64  # sums stay exact
                m, t = matrix(a, b, s) @ wide, sums.astype(kind) @ wide.astype(kind, copy=False)
                f, q = np.nonzero(m)
                for c in range(0, len(f), ROWS):
                    fs, qs = f[c : c + ROWS], q[c : c + ROWS]
                    yield _table(qid=held.qids[numbers[qs]], fp_id=held.ids[fs + a], n=m[fs, qs], positions=t[fs, qs])

    found = rows.mapInArrow(run, "qid long, fp_id long, n long, positions long")
    return found.withColumn("qid", F.nullif("qid", F.lit(NO_ID)))


def best_votes(queries: DataFrame, postings: DataFrame, stride: int, least: int) -> DataFrame:
    """``(qid, fp_id, hits, delta)``: of queries ``(qid, p, hash)`` and postings ``(hash, fp_id, ordinal)`` the offset
    with most votes of each pair (then the smaller absolute, then the smaller offset), if it has ``least``."""
    q = queries.select(F.coalesce("qid", F.lit(NO_ID)).cast("bigint").alias("key"), F.col("hash").cast("bigint").alias("code"), F.col("p").cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("least"))
    rows = _parts(q, postings.select(F.coalesce("fp_id", F.lit(NO_ID)).cast("bigint").alias("key"), F.col("hash").cast("bigint").alias("code"), F.col("ordinal").cast("bigint").alias("at")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(batches)
        order = np.lexsort((held.qat, held.q, held.qcode))
        q, p = held.q[order], held.qat[order]
        hashes, start, count = np.unique(held.qcode[order], return_index=True, return_counts=True)
        if not len(hashes):
            return
        which = np.minimum(np.searchsorted(hashes, held.code), len(hashes) - 1)
        met = np.flatnonzero(hashes[which] == held.code)
        f, which, ahead = held.f[met], which[met], held.at[met] * stride
        if not len(met):
            return
        low = int(ahead.min() - p.max())
        span = int(ahead.max() - p.min()) - low + 1
        votes = np.cumsum(count[which])
        ends = np.flatnonzero(np.r_[f[1:] != f[:-1], True]) + 1  # a fingerprint's votes are counted together
        each, place, a = len(held.qids) * span, q * span - p, 0  # numbers taken up by a fingerprint
        short = place.astype(np.int32) if each < 1 << 31 else place
        found: list[tuple[np.ndarray, ...]] = []
        while a < len(met):
            until = np.searchsorted(votes, (votes[a - 1] if a else 0) + VOTES)
            b = int(ends[max(np.searchsorted(ends, until, "right") - 1, np.searchsorted(ends, a, "right"))])
            n = count[which[a:b]]
            upto = np.cumsum(n)
            src = np.arange(upto[-1]) + np.repeat(start[which[a:b]] - (upto - n), n)
            base = (f[a:b] - f[a]) * each + (ahead[a:b] - low)
            if (f[b - 1] - f[a] + 1) * each < 1 << 31:  # half the bytes sort in half the time
                key = np.repeat(base.astype(np.int32), n) + short[src]
            else:
                key = np.repeat(base, n) + place[src]
            key.sort()
            # a key with enough votes is equal to the one so many places further
            enough = np.unique(key[: len(key) - least + 1][key[least - 1 :] == key[: len(key) - least + 1]]) if len(key) >= least else key[:0]
            hits = np.searchsorted(key, enough, "right") - np.searchsorted(key, enough)
            pair, delta = enough // span, enough % span + low
            best = np.lexsort((delta, np.abs(delta), -hits, pair))
            best = best[np.r_[True, pair[best][1:] != pair[best][:-1]]] if len(best) else best
            found.append((pair[best] % len(held.qids), f[a] + pair[best] // len(held.qids), hits[best], delta[best]))
            a = b
            if a == len(met) or len(found) == 256:
                qs, fs, hits, delta = map(np.concatenate, zip(*found))
                yield _table(qid=held.qids[qs], fp_id=held.ids[fs], hits=hits, delta=delta)
                found = []

    hits = rows.mapInArrow(run, "qid long, fp_id long, hits long, delta long")
    return hits.select(F.nullif("qid", F.lit(NO_ID)).alias("qid"), F.nullif("fp_id", F.lit(NO_ID)).alias("fp_id"), "hits", F.col("delta").cast("int").alias("delta"))
