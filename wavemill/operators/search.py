"""The two searches over batches of query fingerprints, and their verification.

Queries are a table ``(qid, values)``; every cut and rank is taken for each qid, so one query and a million run through
the same plan.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.bits import bit_errors, bucket_of, class_name, classify, overlap, quantized
from wavemill.operators import dense, packed
from wavemill.operators.bands import band_search, exploded_bands
from wavemill.sources.tables import free_shuffles, materialise, thinned
from wavemill.tuning import DEFAULTS, BandTuning, HitOptions, PostingTuning, QueryOptions


#: Query rows up to which a batch of queries is sent to every executor (some 10 MB); a larger batch is shuffled.
SENT_ROWS = 200_000
#: Parts into which the postings of one key fall when they are shuffled to a large batch, which goes to each part.
SPREAD = 16
#: Different keys up to which a batch also filters the scan, and the ranges that then cover the keys.
PROBED_KEYS, RANGES = 4096, 16
#: Meetings of a batch with a band index from which they are counted as arrays, buckets up to which that is possible,
#: query values from which votes are counted so, and those up to which their hashes (some 30 MB) probe the index before.
DENSE_MEETINGS, DENSE_BUCKETS, DENSE_VALUES, PROBED_VALUES = 200_000_000, 4096, 50_000, 2_000_000


def covering(keys: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges that hold all keys, cut where the keys lie furthest apart."""
    keys = sorted(set(keys))
    if keys and 2 * len(keys) > keys[-1] - keys[0]:  # gaps this narrow spare nothing
        return [(keys[0], keys[-1])]
    gaps = sorted(sorted(range(1, len(keys)), key=lambda i: keys[i - 1] - keys[i])[: most - 1])
    return [(keys[a], keys[b - 1]) for a, b in zip([0, *gaps], [*gaps, len(keys)])] if keys else []


def probed(index: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows of an index whose ``column`` lies in a range that the keys (one column) take up.

    Few keys become ranges in the scan's own filter, so a file sorted by the column is read where they lie and nowhere
    else. Many keys lie everywhere, and the index stays as it is.
    """
    some = [r[0] for r in keys.where(F.col(keys.columns[0]).isNotNull()).distinct().limit(PROBED_KEYS + 1).collect()]
    if len(some) > PROBED_KEYS:
        return index
    within = [F.col(column).between(low, high) if low < high else F.col(column) == low for low, high in covering(some)]
    return index.where(reduce(or_, within)) if within else index.where(F.lit(False))


def _met(queries: DataFrame, index: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """The join of exploded queries with an index; ``rows`` bounds the rows of ``queries``.

    A batch of up to ``SENT_ROWS`` goes to every executor and probes the index where it lies, so only postings that meet
    a query are moved at all. These are placed by id and multiplied with the queries there: all that an id meets is
    counted in place, while the meetings, many times as many as the postings, are never shuffled. For a larger batch
    both sides are shuffled by key and by a part of the fingerprints, so that a frequent key is no single task.
    """
    if rows <= SENT_ROWS:
        # the probe goes below the steps that make postings distinct or count them
        met = index.join(F.broadcast(queries.select(*keys).distinct()), keys, "left_semi")
        # a given number of parts, since the few bytes of what meets would be put together into few tasks
        spark = queries.sparkSession
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        return met.repartition(parts, "fp_id").join(F.broadcast(queries), keys)
    parts = queries.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return index.withColumn("_part", F.pmod(F.xxhash64("fp_id"), F.lit(SPREAD)).cast("int")).join(parts, [*keys, "_part"]).drop("_part")


def _values(queries: DataFrame) -> int:
    return queries.agg(F.coalesce(F.sum(F.greatest(F.size("values"), F.lit(0))), F.lit(0))).first()[0]


def _numbered(queries: DataFrame, *indexes: DataFrame | None) -> bool:
    """Whether the ids are whole numbers, as the arrays need them."""
    kinds = [dict(queries.dtypes)["qid"], *(dict(x.dtypes)["fp_id"] for x in indexes if x is not None)]
    return set(kinds) <= {"bigint", "int", "smallint", "tinyint"}


def _sides(queries: DataFrame, postings: DataFrame, tuning: BandTuning, overflow: DataFrame | None, least: Column) -> tuple[DataFrame, DataFrame, int] | None:
    """Both sides of a band search by arrays and the number of postings, if the batch meets the index so often that it is
    worth it; ``least`` is what a candidate needs by the size of its query, ``_size``."""
    if not _numbered(queries, postings, overflow):
        return None
    n = postings.count()
    if _values(queries) * tuning.num_bands * n / tuning.total_buckets < DENSE_MEETINGS:
        return None
    q = exploded_bands(queries, "qid", tuning, "qpos").groupBy("qid", "band", "band_value").agg(F.count(F.lit(1)).alias("qn"), F.min("qpos").alias("q1"))
    sizes = queries.select(F.col("qid").alias("_qid"), F.size("values").alias("_size"))
    q = q.join(sizes, q["qid"].eqNullSafe(F.col("_qid"))).withColumn("least", least)

    def bucket(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", bucket_of(F.col("band"), F.col("band_value"), tuning))

    parts = [x.where(F.col("fp_id").isNotNull() & F.col("pos").isNotNull()).select("band", "band_value", "fp_id", "pos", F.lit(late).alias("late")) for late, x in enumerate((postings, overflow)) if x is not None]
    rows = bucket(reduce(DataFrame.unionByName, parts)).where(F.col("bucket").between(0, tuning.total_buckets - 1) & F.col("band_value").between(0, tuning.buckets_per_band - 1))
    return bucket(q), rows, n


def match_counts(queries: DataFrame, postings: DataFrame, tuning: BandTuning = BandTuning(), overflow: DataFrame | None = None) -> DataFrame:
    """``(qid, n_matches, n_fps)``: all meetings of a query with the index, and the fingerprints that it meets."""
    sides = _sides(queries, postings, tuning, overflow, F.lit(1)) if tuning.total_buckets <= DENSE_BUCKETS else None
    if sides is not None:
        return dense.band_counts(dense.band_rows(*sides[:2]), tuning.total_buckets)
    met = band_matches(queries, postings, tuning, overflow)
    return met.groupBy("qid").agg(F.sum("matches").alias("n_matches"), F.count(F.lit(1)).alias("n_fps"))


def match_sums(queries: DataFrame, postings: DataFrame, tuning: BandTuning = BandTuning(), overflow: DataFrame | None = None) -> DataFrame:
    """``(qid, fp_id, n, positions)``: of each query and fingerprint all meetings and the sum of their positions."""
    sides = _sides(queries, postings, tuning, overflow, F.lit(1)) if tuning.total_buckets <= DENSE_BUCKETS else None
    if sides is not None:
        return dense.band_sums(dense.band_rows(*sides[:2]), tuning.total_buckets)
    met = band_search(queries, postings, tuning, overflow)
    return met.groupBy("qid", "fp_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("bigint")).alias("positions"))


def band_matches(queries: DataFrame, postings: DataFrame, tuning: BandTuning = BandTuning(), overflow: DataFrame | None = None) -> DataFrame:
    """``(qid, fp_id, matches, qpos, pos)``: how often a fingerprint's postings meet the query's bands, and where the
    first meeting lies (in order of query position, band, main before overflow, position).

    Both sides are counted before the join: query bands by (qid, band, value) and postings by (band, value, id), so
    repeated bands and a bucket's repeated postings of one id cross the join once, and an id with a third of all rows
    is at most one row for each bucket; counts multiply and firsts are minima, so the result is that of joining every row.
    """
    q = exploded_bands(queries, "qid", tuning, "qpos").groupBy("qid", "band", "band_value").agg(F.count(F.lit(1)).alias("qn"), F.min("qpos").alias("q1"))
    wanted = q.select(bucket_of(F.col("band"), F.col("band_value"), tuning).alias("bucket"))

    def part(index: DataFrame, late: int) -> DataFrame:
        rows = probed(index, wanted, "bucket") if "bucket" in index.columns else index
        rows = rows.select("band", "band_value", "fp_id", "pos", F.lit(late).alias("late"))
        return rows.where(F.col("fp_id").isNotNull() & F.col("pos").isNotNull())

    parts = part(postings, 0) if overflow is None else part(postings, 0).unionByName(part(overflow, 1))
    p = parts.groupBy("band", "band_value", "fp_id", "late").agg(F.count(F.lit(1)).alias("pn"), F.min("pos").alias("p1"))
    met = _met(q, p, ["band", "band_value"], _values(queries) * tuning.num_bands)
    # the order of the meetings as one number, query position, 5 bits of band, 1 bit late, 26 bits of position: a
    # number aggregates by hash, a struct only by sorting
    order = F.shiftleft(F.col("q1").cast("bigint"), 32) + F.shiftleft(F.col("band").cast("bigint"), 27) + F.shiftleft(F.col("late").cast("bigint"), 26) + F.col("p1")
    both = met.groupBy("qid", "fp_id").agg(F.sum(F.col("qn") * F.col("pn")).alias("matches"), F.min(order).alias("first"))
    return both.select("qid", "fp_id", "matches", F.shiftright("first", 32).cast("int").alias("qpos"), F.col("first").bitwiseAND(F.lit((1 << 26) - 1)).cast("int").alias("pos"))


def band_candidates(queries: DataFrame, postings: DataFrame, tuning: BandTuning = BandTuning(), options: QueryOptions = DEFAULTS, overflow: DataFrame | None = None) -> DataFrame:
    """The candidates of each query that reach the threshold, the best ``max_candidates`` by matches, then id.

    The adaptive threshold is 2 % of the query's bands, at least 3.
    """
    adaptive = lambda size: F.greatest(F.lit(3), F.floor(size * F.lit(tuning.num_bands) / 50))
    sides = _sides(queries, postings, tuning, overflow, F.lit(options.threshold) if options.threshold else adaptive(F.col("_size")))
    best = Window.partitionBy("qid").orderBy(F.desc("matches"), "fp_id")
    if sides is not None:
        q, rows, n = sides
        if tuning.total_buckets > DENSE_BUCKETS:
            met = packed.candidates(*dense.band_numbers(q, rows), n, options.candidates)
        else:
            met = dense.band_candidates(dense.band_rows(q, rows), tuning.total_buckets, options.candidates)
        met = met if options.threshold else met.where(F.col("qid").isNotNull())
    elif options.threshold:
        met = band_matches(queries, postings, tuning, overflow).where(F.col("matches") >= options.threshold)
    else:
        sizes = queries.select("qid", adaptive(F.size("values")).alias("least"))
        met = band_matches(queries, postings, tuning, overflow).join(sizes, "qid").where(F.col("matches") >= F.col("least")).drop("least")
    met = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= options.candidates).drop("rank")
    if sides is None or tuning.total_buckets <= DENSE_BUCKETS:
        return met
    # few rows, written once: the postings moved for them leave the disk before what follows takes its own
    met = materialise(met, "candidates")
    free_shuffles(met.sparkSession)
    return met


def _either(main: DataFrame, overflow: DataFrame | None, columns: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both tables with ``_order``, by which the current one of an id is the greatest: overflow before main,
    then the latest (if ``added_at`` is there), then by ``ties`` and a hash of the row."""

    def marked(df: DataFrame, late: int) -> DataFrame:
        at = F.col("added_at") if "added_at" in df.columns else F.lit(None).cast("timestamp")
        return df.select("fp_id", *columns, F.struct(F.lit(late).alias("late"), at.alias("at"), *ties, F.xxhash64(*columns).alias("hash")).alias("_order"))

    return marked(main, 0) if overflow is None else marked(main, 0).unionByName(marked(overflow, 1))


def verified(candidates: DataFrame, queries: DataFrame, fingerprints: DataFrame, overflow: DataFrame | None = None) -> DataFrame:
    """``candidates`` (qid, fp_id, offset, ...) with ``bits`` compared and ``errors`` found at their offset.

    Candidates meet all rows of their id, and the current one is kept after the comparison: so ``candidates`` is
    computed once, and neither fingerprints nor their values are shuffled while candidates are few. Candidates without
    a fingerprint drop out, as do those without an overlap.
    """
    both = candidates.join(_either(fingerprints, overflow, ["values"]).withColumnRenamed("values", "_c"), "fp_id")
    both = both.join(queries.select("qid", F.col("values").alias("_q")), "qid")
    both = both.withColumn("bits", (overlap(F.col("_c"), F.col("_q"), F.col("offset")) * 32).cast("bigint"))
    both = both.withColumn("errors", bit_errors(F.col("_c"), F.col("_q"), F.col("offset"))).drop("_c", "_q")
    return _current(both).where("bits > 0")


def _current(rows: DataFrame) -> DataFrame:
    newest = Window.partitionBy("qid", "fp_id").orderBy(F.desc("_order"))
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_order")


def band_query(queries: DataFrame, postings: DataFrame, fingerprints: DataFrame, *, tuning: BandTuning = BandTuning(), options: QueryOptions = DEFAULTS, mappings: DataFrame | None = None, overflow_postings: DataFrame | None = None, overflow_fingerprints: DataFrame | None = None, overflow_mappings: DataFrame | None = None) -> DataFrame:
    """Matches ``(qid, fp_id, ber, score, score_name, matches, offset, rank)``, with ``mbid``, ``track_id`` and
    ``metadata`` if mappings are given and wanted; best bit error rate first, then id.

    Rates of 0.35 and more are no match even under a higher ``max_bit_error_rate``. Superseded fingerprints are still
    found through their old postings and compared by their new values. An id with several mappings shows its latest
    (by ``added_at`` if there). Empty and null queries have no match.
    """
    found = band_candidates(queries, postings, tuning, options, overflow_postings)
    if hasattr(found, "scratch_path"):  # written already, so it can also tell which fingerprints need to be moved
        fingerprints = thinned(fingerprints, found, "fp_id")
    found = found.select("qid", "fp_id", "matches", (F.col("pos") - F.col("qpos")).alias("offset"))
    found = verified(found, queries, fingerprints, overflow_fingerprints).withColumn("ber", F.col("errors") / F.col("bits"))
    found = found.withColumn("score", classify(F.col("ber"))).where((F.col("ber") < options.error_rate) & (F.col("score") < 3))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("ber", "fp_id")))
    out = found.select("qid", "fp_id", "ber", "score", class_name(F.col("score")).alias("score_name"), "matches", "offset", "rank")
    if mappings is None or not options.include_metadata:
        return out
    columns = [c for c in ("mbid", "track_id", "metadata") if c in mappings.columns]
    return _current(out.join(_either(mappings, overflow_mappings, columns, tuple(c for c in ("mbid", "track_id") if c in columns)), "fp_id", "left")).select(*out.columns, *columns)


def full_query(queries: DataFrame, postings: DataFrame, *, tuning: PostingTuning = PostingTuning(), options: HitOptions = HitOptions(), overflow: DataFrame | None = None) -> DataFrame:
    """Hits ``(qid, fp_id, hits, delta, rank)`` by exact offset: every query value, quantized, votes for the offset
    between its position and that of each posting of its hash.

    Of each fingerprint the offset with most votes counts (ties: the smaller absolute, then the smaller offset), if it
    has ``min_hits``; the best ``top_k`` are ranked by votes, absolute offset, offset and id. Overflow postings vote
    beside the main ones.
    """
    q = queries.select("qid", F.posexplode("values").alias("p", "v")).where(F.col("v").isNotNull())
    q = q.select("qid", "p", quantized("v", tuning.qbits).alias("hash"))
    parts = [probed(index, q.select("hash"), "hash") for index in (postings, overflow) if index is not None]
    values = _values(queries)
    if values > DENSE_VALUES and _numbered(queries, *parts):
        every = reduce(DataFrame.unionByName, parts)
        if values <= PROBED_VALUES:  # the probe goes below the steps that make postings distinct
            every = every.join(F.broadcast(q.select("hash").distinct()), "hash", "left_semi")
        return _ranked_hits(dense.best_votes(q, every, tuning.stride, options.hits), options)
    votes = _met(q, reduce(DataFrame.unionByName, parts), ["hash"], values).select("qid", "fp_id", (F.col("ordinal") * tuning.stride - F.col("p")).alias("delta"))
    # an offset short of the votes can't be its fingerprint's answer, so it goes before the best one is sought
    votes = votes.groupBy("qid", "fp_id", "delta").agg(F.count(F.lit(1)).alias("hits")).where(F.col("hits") >= options.hits)
    # most votes, then the smaller absolute offset, then the smaller one, as one number (28, 34 and 1 bits)
    rank = F.shiftleft(F.lit((1 << 28) - 1) - F.col("hits"), 35) + F.shiftleft(F.abs("delta").cast("bigint"), 1) + (F.col("delta") > 0).cast("bigint")
    best = votes.groupBy("qid", "fp_id").agg(F.min(rank).alias("b"))
    away = F.shiftrightunsigned("b", 1).bitwiseAND(F.lit((1 << 34) - 1)).cast("int")
    delta = F.when(F.col("b").bitwiseAND(F.lit(1)) == 1, away).otherwise(-away)
    return _ranked_hits(best.select("qid", "fp_id", (F.lit((1 << 28) - 1) - F.shiftrightunsigned("b", 35)).alias("hits"), delta.alias("delta")), options)


def _ranked_hits(best: DataFrame, options: HitOptions) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("hits"), F.abs("delta"), "delta", "fp_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.k)


def verified_hits(hits: DataFrame, queries: DataFrame, fingerprints: DataFrame, overflow: DataFrame | None = None) -> DataFrame:
    """Hits of the full query with the bit error rate at their offset, as ``ber`` and ``score``."""
    found = verified(hits.withColumnRenamed("delta", "offset"), queries, fingerprints, overflow)
    ber = F.col("errors") / F.col("bits")
    return found.select("qid", "fp_id", "hits", F.col("offset").alias("delta"), "rank", ber.alias("ber"), classify(ber).alias("score"))
