"""Explicit schemas. Unsigned 32-bit numbers are stored as bigint in [0, 2 ** 32)."""

from pyspark.sql import types as T

U32 = 0xFFFFFFFF

FINGERPRINTS = T.StructType([
    T.StructField("fp_id", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
    T.StructField("values", T.ArrayType(T.LongType())),
])
METADATA = T.StructType([T.StructField(name, T.StringType()) for name in ("title", "artist", "release", "year")])
MAPPINGS = T.StructType([
    T.StructField("fp_id", T.LongType()),
    T.StructField("mbid", T.StringType()),
    T.StructField("track_id", T.LongType()),
    T.StructField("metadata", METADATA),
])
BAND_POSTINGS = T.StructType([
    T.StructField("bucket", T.IntegerType()),
    T.StructField("band", T.IntegerType()),
    T.StructField("band_value", T.IntegerType()),
    T.StructField("fp_id", T.LongType()),
    T.StructField("pos", T.IntegerType()),
])
SAMPLED_POSTINGS = T.StructType([
    T.StructField("hash", T.LongType()),
    T.StructField("fp_id", T.LongType()),
    T.StructField("ordinal", T.IntegerType()),
])
QUERIES = T.StructType([T.StructField("qid", T.LongType()), T.StructField("values", T.ArrayType(T.LongType()))])
TABLES = {"fingerprints": FINGERPRINTS, "mappings": MAPPINGS, "band_postings": BAND_POSTINGS, "sampled_postings": SAMPLED_POSTINGS}
