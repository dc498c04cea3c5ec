"""Queries of the engine's own operators on the fingerprint tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import bits, codec, strings
from wavemill.operators import bands, overlay, postings, search, stats
from wavemill.sources.fixtures import lcg_fingerprints
from wavemill.sources.tables import table
from wavemill.tuning import STRATEGIES, HitOptions, QueryOptions, auto_tune, grid

FIELDS = ("title", "artist", "release", "year")


def _fps(spark: SparkSession, d: str, name: str = "fingerprints") -> DataFrame:
    return table(spark, d, name)


def _index(spark: SparkSession, d: str) -> DataFrame:
    return postings.clean(table(spark, d, "sampled_postings"))


def _overflow_index(spark: SparkSession, d: str) -> DataFrame:
    return postings.sampled(_fps(spark, d, "fingerprints_overflow"))


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "band_postings").select("bucket", "band", "band_value", "fp_id", "pos")


def _overflow_bands(spark: SparkSession, d: str) -> DataFrame:
    return bands.band_postings(_fps(spark, d, "fingerprints_overflow"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "queries")


def _whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# scans, lookups and overlays


def overlay_scan(spark, d):
    rows = overlay.overlay(_fps(spark, d), _fps(spark, d, "fingerprints_overflow"), mark="from_overflow")
    return rows.select("fp_id", "duration_ms", F.size("values").cast("bigint").alias("n_values"), "from_overflow")




def lookup_fingerprint(spark, d):
    """The current fingerprint of every deleted id that is still stored."""
    found = overlay.lookup(_fps(spark, d), _fps(spark, d, "fingerprints_overflow"), table(spark, d, "deleted_fps"))
    one = overlay.one_per_key(found.withColumn("n_values", F.size("values").cast("bigint")).select("fp_id", "added_at", "duration_ms", "n_values"), "fp_id", ["added_at"])
    return one.select("fp_id", "duration_ms", "n_values", "added_at")


def lookup_metadata(spark, d):
    """All current mappings of every deleted id."""
    found = overlay.lookup(table(spark, d, "mappings"), table(spark, d, "mappings_overflow"), table(spark, d, "deleted_fps"))
    return found.select("fp_id", "mbid", "track_id", *(F.col(f"metadata.{f}").alias(f) for f in FIELDS))


def lookup_hash(spark, d):
    """Postings of every different hash of every query."""
    q = _queries(spark, d).select("qid", F.explode("values").alias("v")).select("qid", bits.quantized("v", 2).alias("hash")).distinct()
    all_ = _index(spark, d).unionByName(_overflow_index(spark, d))
    return _whole(q.join(all_, "hash").select("qid", "hash", "fp_id", "ordinal"), "ordinal")


def iterate_mappings(spark, d):
    rows = overlay.overlay(table(spark, d, "mappings"), table(spark, d, "mappings_overflow"), mark="from_overflow")
    return rows.select("fp_id", "mbid", "track_id", *(F.col(f"metadata.{f}").alias(f) for f in FIELDS), "from_overflow")


def latest_mappings(spark, d):
    """One mapping for each id, the newest."""
    rows = table(spark, d, "mappings").where(F.col("fp_id").isNotNull()).select("fp_id", "added_at", "track_id", "mbid")
    return overlay.one_per_key(rows, "fp_id", ["added_at", "track_id", "mbid"])


def overflow_first_wins(spark, d):
    """Of each id of the overflow batch the record that came first."""
    rows = _fps(spark, d, "fingerprints_overflow").select("fp_id", "added_at", F.size("values").cast("bigint").alias("n_values"))
    return overlay.first_of_batch(rows.distinct(), "fp_id", "added_at")


def compact_datastore(spark, d):
    """The fingerprint table after compaction, with the sum of the values for a checksum."""
    rows = overlay.overlay(_fps(spark, d), _fps(spark, d, "fingerprints_overflow"))
    total = F.aggregate("values", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("fp_id", "duration_ms", F.size("values").cast("bigint").alias("n_values"), total.alias("checksum"))


def compact_metadata(spark, d):
    """The mappings after compaction with texts in the form of the string pool."""
    rows = overlay.overlay(table(spark, d, "mappings"), table(spark, d, "mappings_overflow"))
    return rows.select("fp_id", "mbid", "track_id", strings.encode_metadata("metadata").alias("text"))


def compact_posting_index(spark, d):
    """The sampled index rebuilt from the compacted table."""
    rows = overlay.overlay(_fps(spark, d), _fps(spark, d, "fingerprints_overflow"))
    return _whole(postings.sampled(rows), "ordinal")


def compact_search_index(spark, d):
    """The band index rebuilt from the compacted table."""
    rows = overlay.overlay(_fps(spark, d), _fps(spark, d, "fingerprints_overflow"))
    return _whole(bands.band_postings(rows), "bucket", "band", "band_value", "pos")


# index builders


def sampled_postings_build(spark, d):
    return _whole(postings.sampled(_fps(spark, d)), "ordinal")


def posting_stats(spark, d):
    return postings.posting_stats(_index(spark, d))


def posting_buckets(spark, d):
    return postings.buckets(_index(spark, d))


def posting_bucket_sizes(spark, d):
    return postings.bucket_sizes(_index(spark, d))


def skip_directory(spark, d):
    return postings.skip_directory(_index(spark, d))


def extract_bands(spark, d):
    """The bands of every value of the fingerprint table."""
    return _whole(bands.exploded_bands(_fps(spark, d), "fp_id", bands.BandTuning()), "pos", "band", "band_value")


def band_directory(spark, d):
    """Postings of each bucket of the band index built from all fingerprints."""
    return bands.bucket_directory(bands.band_postings(_fps(spark, d)))


def band_stats(spark, d):
    return bands.band_stats(_bands(spark, d))


def band_posting_lists(spark, d):
    """The postings of every bucket that a band of any query falls into, each once for its bucket."""
    wanted = bands.band_postings(_queries(spark, d).withColumnRenamed("qid", "fp_id")).select("bucket").distinct()
    every = _bands(spark, d).unionByName(_overflow_bands(spark, d))
    return _whole(every.join(wanted, "bucket", "left_semi").select("bucket", "fp_id", "pos"), "bucket", "pos")


# searches


def query_full(spark, d):
    return _whole(search.full_query(_queries(spark, d), _index(spark, d)), "delta", "rank")


def query_full_minhits_topk(spark, d):
    return _whole(search.full_query(_queries(spark, d), _index(spark, d), options=HitOptions(min_hits=5, top_k=3)), "delta", "rank")


def query_full_overflow(spark, d):
    return _whole(search.full_query(_queries(spark, d), _index(spark, d), overflow=_overflow_index(spark, d)), "delta", "rank")


def query_full_verified(spark, d):
    hits = search.full_query(_queries(spark, d), _index(spark, d))
    return _whole(search.verified_hits(hits, _queries(spark, d), _fps(spark, d)), "delta", "rank", "score")


def band_search_counts(spark, d):
    """How many postings each query meets in all."""
    return search.match_counts(_queries(spark, d), _bands(spark, d))


def band_candidates(spark, d):
    return _whole(search.band_candidates(_queries(spark, d), _bands(spark, d)), "qpos", "pos")


def band_query(spark, d):
    return _whole(search.band_query(_queries(spark, d), _bands(spark, d), _fps(spark, d)), "score", "offset", "rank")


def band_query_options(spark, d):
    options = QueryOptions(max_candidates=20, min_match_threshold=10, max_bit_error_rate=0.2)
    return _whole(search.band_query(_queries(spark, d), _bands(spark, d), _fps(spark, d), options=options), "score", "offset", "rank")


def band_query_metadata(spark, d):
    found = search.band_query(_queries(spark, d), _bands(spark, d), _fps(spark, d), mappings=table(spark, d, "mappings"), overflow_mappings=table(spark, d, "mappings_overflow"))
    return found.select("qid", "fp_id", "ber", "score_name", "mbid", "track_id", F.col("metadata.title").alias("title"))


def band_query_overflow(spark, d):
    found = search.band_query(_queries(spark, d), _bands(spark, d), _fps(spark, d), overflow_postings=_overflow_bands(spark, d), overflow_fingerprints=_fps(spark, d, "fingerprints_overflow"))
    return _whole(found, "score", "offset", "rank")


def lcg_query(spark, d):
    """A fingerprint generated from every id of the fingerprint table, each a query from its 17th value on, against all
    of them."""
    ids = _fps(spark, d).select("fp_id").where(F.col("fp_id").isNotNull()).distinct()
    fps = lcg_fingerprints(ids, 64)
    q = fps.select(F.col("fp_id").alias("qid"), F.slice("values", 17, 48).alias("values"))
    return _whole(search.full_query(q, postings.sampled(fps)), "delta", "rank")


# scalar functions


def hamming_pairs(spark, d):
    """Bit errors between the stored and the re-issued values of an id."""
    one = lambda name: overlay.one_per_key(_fps(spark, d, name).select("fp_id", "values"), "fp_id")
    both = one("fingerprints").join(one("fingerprints_overflow").withColumnRenamed("values", "later"), "fp_id")
    n = bits.overlap(F.col("values"), F.col("later"), F.lit(0)).cast("bigint") * 32
    both = both.select("fp_id", n.alias("bits"), bits.bit_errors(F.col("values"), F.col("later"), F.lit(0)).alias("errors")).where("bits > 0")
    score = bits.classify(F.col("errors") / F.col("bits"))
    return both.select("*", (F.col("errors") / F.col("bits")).alias("ber"), bits.class_name(score).alias("score_name"))


def xor_deltas(spark, d):
    return _whole(_fps(spark, d).select("fp_id", "added_at", F.posexplode(bits.xor_deltas("values")).alias("pos", "delta")), "pos")


def encoded_sizes(spark, d):
    rows = _fps(spark, d).where(F.col("values").isNotNull())
    return rows.select("fp_id", "added_at", F.size("values").cast("bigint").alias("n_values"), bits.varint_size("values").alias("varint_bytes"), bits.packed_size("values").alias("packed_bytes"))


def _round_trip(spark, d, encode, decode):
    rows = _fps(spark, d).where(F.col("values").isNotNull()).select("fp_id", "added_at", "values", encode("values").alias("data"))
    back = rows.select("fp_id", "added_at", F.length("data").cast("bigint").alias("n_bytes"), decode("data", F.size("values")).alias("v"))
    total = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return back.select("fp_id", "added_at", "n_bytes", F.size("v").cast("bigint").alias("n_values"), total.alias("checksum"))


def codec_roundtrip_varint(spark, d):
    return _round_trip(spark, d, codec.encoded, codec.decoded)


def codec_roundtrip_packed(spark, d):
    return _round_trip(spark, d, codec.encoded_packed, codec.decoded_packed)


def _all_mappings(spark, d):
    return table(spark, d, "mappings").unionByName(table(spark, d, "mappings_overflow"))


def string_pool_encode(spark, d):
    return _all_mappings(spark, d).select("fp_id", "mbid", "added_at", strings.encode_metadata("metadata").alias("text"))


def string_pool_parse(spark, d):
    """Metadata after encoding and parsing: null fields come back empty."""
    rows = _all_mappings(spark, d).select("fp_id", "mbid", "added_at", strings.parse_metadata(strings.encode_metadata("metadata")).alias("m"))
    return rows.select("fp_id", "mbid", "added_at", *(F.col(f"m.{f}").alias(f) for f in FIELDS))


# statistics and tuning


def _stats(spark, d):
    return stats.dataset_stats(spark, fingerprints=_fps(spark, d), overflow=_fps(spark, d, "fingerprints_overflow"), mappings=table(spark, d, "mappings"), has_search_index=True, has_posting_index=True)


def dataset_stats(spark, d):
    return _stats(spark, d)


def needs_compaction(spark, d):
    levels = F.explode(F.array(*map(F.lit, (1.0, 5.0, 10.0, 50.0))))
    return stats.needs_compaction(_stats(spark, d).withColumn("threshold_pct", levels), F.col("threshold_pct"))


def autotune_grid(spark, d):
    n = _fps(spark, d).count()
    rows = [(g["bands"], g["bits"], g["est_size"], g["est_ram"], g["manual"], g["speed"], g["low_ram"], g["balanced"]) for g in grid(n)]
    return spark.createDataFrame(rows, "bands long, bits long, est_size long, est_ram long, manual long, speed long, low_ram long, balanced long")


def autotune_choice(spark, d):
    n = _fps(spark, d).count()
    best = [(s, auto_tune(n, s)) for s in STRATEGIES]
    return spark.createDataFrame([(s, t.num_bands, t.bits_per_band) for s, t in best], "strategy string, bands long, bits long")


QUERIES = {f.__name__: f for f in (
    query_full, query_full_minhits_topk, query_full_overflow, query_full_verified, band_search_counts, band_candidates, band_query, band_query_options, band_query_metadata, band_query_overflow, lcg_query,
    overlay_scan, lookup_fingerprint, lookup_metadata, lookup_hash, iterate_mappings, latest_mappings, overflow_first_wins, compact_datastore, compact_metadata, compact_posting_index, compact_search_index,
    sampled_postings_build, posting_stats, posting_buckets, posting_bucket_sizes, skip_directory, extract_bands, band_directory, band_stats, band_posting_lists,
    hamming_pairs, xor_deltas, encoded_sizes, codec_roundtrip_varint, codec_roundtrip_packed, string_pool_encode, string_pool_parse, dataset_stats, needs_compaction, autotune_grid, autotune_choice,
)}
