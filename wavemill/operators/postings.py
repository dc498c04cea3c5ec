"""Sampled posting index: every stride-th value, quantized, with its ordinal; buckets, skip directory and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions.bits import quantize_mask, quantized, varint_len
from wavemill.schema import U32
from wavemill.tuning import MAX_ORDINAL, PostingTuning

#: Low bits of the hashes that share a cell in a search of the skip directory.
CELL_BITS = 14
#: Ids whose postings stand in one list.
LIST_IDS = 4096


def sampled(fingerprints: DataFrame, tuning: PostingTuning = PostingTuning()) -> DataFrame:
    """``(hash, fp_id, ordinal)`` of positions 0, stride, ... up to the last ordinal that the index can hold, equal
    postings once. Only the sampled elements are exploded."""
    last = F.least(F.floor((F.size("values") - 1) / tuning.stride), F.lit(MAX_ORDINAL)).cast("int")
    some = fingerprints.where(F.size("values") > 0).select("fp_id", "values", F.explode(F.sequence(F.lit(0), last)).alias("ordinal"))
    rows = some.select(F.col("values")[F.col("ordinal") * tuning.stride].alias("v"), "fp_id", "ordinal").where(F.col("v").isNotNull())
    return rows.select(quantized("v", tuning.qbits).alias("hash"), "fp_id", "ordinal").distinct()


def clean(postings: DataFrame, tuning: PostingTuning = PostingTuning()) -> DataFrame:
    """Postings of any writer as the index holds them: unsigned quantized hash, no nulls, each once."""
    rows = postings.select(quantized("hash", tuning.qbits).alias("hash"), "fp_id", "ordinal")
    return rows.where(F.col("hash").isNotNull() & F.col("fp_id").isNotNull() & F.col("ordinal").isNotNull()).distinct()


def from_values(rows: DataFrame, tuning: PostingTuning = PostingTuning()) -> DataFrame:
    """Postings of given ``(fp_id, hashes, ordinals)``; both arrays must be of one length, or the job fails."""
    same = F.assert_true(F.size("hashes") == F.size("ordinals"), F.lit("hashes and ordinals differ in length"))
    pairs = rows.where(same.isNull()).select("fp_id", F.explode(F.arrays_zip("hashes", "ordinals")).alias("p"))
    return pairs.select(quantized(F.col("p.hashes"), tuning.qbits).alias("hash"), "fp_id", F.col("p.ordinals").cast("int").alias("ordinal")).distinct()


def buckets(postings: DataFrame) -> DataFrame:
    """``(hash, n_postings)`` of every bucket."""
    return postings.groupBy("hash").agg(F.count(F.lit(1)).alias("n_postings"))


def posting_stats(postings: DataFrame) -> DataFrame:
    """One row: buckets in use, postings, postings a bucket in whole numbers (0 for an empty index)."""
    per = buckets(postings).agg(F.count(F.lit(1)).alias("bucket_count"), F.coalesce(F.sum("n_postings"), F.lit(0)).alias("total_postings"))
    return per.withColumn("avg_per_bucket", F.floor(F.coalesce(F.col("total_postings") / F.nullif(F.col("bucket_count"), F.lit(0)), F.lit(0))))


def _ordered_hashes(postings: DataFrame) -> DataFrame:
    """``(hash, rank, before)`` of every bucket: its rank from 0 in order of the hash, and the hash before it (0 for none).

    Buckets are ranked inside ranges of the high hash bits, after the ranges' counts and last hashes are carried over
    the ranges (at most 4096 of them), so no single task ranks all buckets.
    """
    hashes = postings.select("hash").distinct().withColumn("_range", F.shiftrightunsigned("hash", 20))
    ranges = hashes.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.max("hash").alias("_last"))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"), F.coalesce(F.max("_last").over(upto), F.lit(0)).alias("_last"))
    inside = Window.partitionBy("_range").orderBy("hash")
    ranked = hashes.join(ranges, "_range")
    return ranked.select("hash", (F.col("_first") + F.row_number().over(inside) - 1).alias("rank"), F.coalesce(F.lag("hash").over(inside), F.col("_last")).alias("before"))


def skip_directory(postings: DataFrame, tuning: PostingTuning = PostingTuning()) -> DataFrame:
    """``(entry, hash)``: the first hash of every skip_interval-th bucket in order of the hash."""
    ranked = _ordered_hashes(postings).where(F.col("rank") % tuning.skip_interval == 0)
    return ranked.select((F.col("rank") / tuning.skip_interval).cast("bigint").alias("entry"), "hash")


def skip_search(directory: DataFrame, hashes: DataFrame) -> DataFrame:
    """``(hash, entry, low, high)`` of each different wanted hash: the last skip entry at or before it and the bounds of
    what is to be read for it, ``high`` exclusive and null at the end. A hash before the first entry is in no bucket and
    has no row.

    Entries and hashes meet by the high bits of the hash: an entry stands in every cell of hashes that it reaches into
    (in all at most as many rows as there are entries and cells), a hash in its own.
    """
    cell = F.shiftrightunsigned("hash", CELL_BITS)
    # entries are numbered in order, so the next one bounds each
    following = directory.select((F.col("entry") - 1).alias("entry"), F.col("hash").alias("high"))
    entries = directory.join(following, "entry", "left").withColumn("low", F.col("hash"))
    last = F.shiftrightunsigned(F.coalesce(F.col("high") - 1, F.lit(U32)), CELL_BITS)
    entries = entries.select("entry", "low", "high", F.explode(F.sequence(cell, last)).alias("cell"))
    wanted = hashes.select("hash").where(F.col("hash").isNotNull()).distinct().withColumn("cell", cell)
    found = wanted.join(entries, "cell").where((F.col("low") <= F.col("hash")) & (F.col("high").isNull() | (F.col("hash") < F.col("high"))))
    return found.select("hash", "entry", "low", "high")


def posting_lists(postings: DataFrame) -> DataFrame:
    """``(hash, part, n_postings, ids, ordinals)``: the postings of each bucket as arrays sorted by id and ordinal.

    A part holds the postings of ``LIST_IDS`` neighbouring ids (``fp_id`` divided by it), so a hash with a third of all
    postings is many bounded lists.
    """
    p = postings.groupBy("hash", F.floor(F.col("fp_id") / LIST_IDS).alias("part")).agg(F.sort_array(F.collect_list(F.struct("fp_id", "ordinal"))).alias("p"))
    return p.select("hash", "part", F.size("p").cast("bigint").alias("n_postings"), F.col("p.fp_id").alias("ids"), F.col("p.ordinal").alias("ordinals"))


def lookup_hash(postings: DataFrame, value: int | Column, tuning: PostingTuning = PostingTuning(), overflow: DataFrame | None = None) -> DataFrame:
    """Postings of one hash, of the main index and the overflow together; the overflow shadows nothing. The filter
    reaches the scan."""
    wanted = F.lit(value & quantize_mask(tuning.qbits)) if isinstance(value, int) else quantized(value, tuning.qbits)
    all_ = postings if overflow is None else postings.unionByName(overflow)
    return all_.where(F.col("hash") == wanted)


def bucket_sizes(postings: DataFrame) -> DataFrame:
    """``(hash, n_postings, n_bytes)``: what a bucket takes with variable-length numbers: the difference to the hash
    before, the count, the differences of its sorted ids, and a byte for each ordinal."""
    order = Window.partitionBy("hash").orderBy("fp_id", "ordinal")
    deltas = postings.withColumn("d", F.col("fp_id") - F.coalesce(F.lag("fp_id").over(order), F.lit(0)))
    n = F.count(F.lit(1))
    sizes = deltas.groupBy("hash").agg(n.alias("n_postings"), (F.sum(varint_len(F.col("d"))) + n + varint_len(n)).cast("bigint").alias("_bytes"))
    both = sizes.join(_ordered_hashes(postings), "hash")
    return both.select("hash", "n_postings", (F.col("_bytes") + varint_len(F.col("hash") - F.col("before"))).alias("n_bytes"))
