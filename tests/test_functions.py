import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill import errors
from wavemill.functions import bits, codec, strings
from wavemill.tuning import DEFAULTS, BandTuning, HitOptions, PostingTuning, QueryOptions, auto_tune, grid

U32 = st.integers(0, 2**32 - 1)
ARRAYS = st.one_of(st.lists(U32, max_size=300), st.lists(st.integers(0, 300), max_size=300))


@pytest.mark.parametrize("value", [0, 1, 127, 128, 255, 256, 16383, 16384, 0x0FFFFFFF, 0xFFFFFFFF])
def test_varint(value):
    data, size = codec.varint_encode(np.array([value]))
    assert codec.varint_decode(data, 1)[0].tolist() == [value]
    assert size[0] == max(1, -(-value.bit_length() // 7))


def test_varint_refuses_broken_data():
    with pytest.raises(errors.TruncatedVarint):
        codec.varint_decode(np.array([128, 128], np.uint8), 1)
    with pytest.raises(errors.TruncatedVarint):
        codec.varint_decode(np.array([128] * 5 + [1], np.uint8), 1)


@settings(max_examples=60, deadline=None)
@given(ARRAYS)
def test_round_trips(values):
    assert codec.decompress(codec.compress(values), len(values)).tolist() == values
    assert codec.decompress_packed(codec.compress_packed(values), len(values)).tolist() == values


@pytest.mark.parametrize("count", [1, 10, 50, 127, 128, 129, 130, 256, 500])
def test_packed_blocks(count):
    values = [(i * 2654435761) % 2**32 if i % 7 else i for i in range(count)]
    assert codec.decompress_packed(codec.compress_packed(values), count).tolist() == values


def test_sizes_of_constant_arrays():
    assert codec.compress([]) == b"" and codec.compress_packed([]) == b""
    assert codec.compress([0xDEADBEEF]) == bytes.fromhex("efbeadde")
    assert len(codec.compress([0x12345678] * 50)) == 53
    assert len(codec.compress_packed([7] * 200)) == 4 + 2 * 2


def test_packed_refuses_broken_data():
    data = codec.compress_packed(list(range(100)))
    for broken in (data[:3], data[:-1], data[:4] + bytes([40]) + data[5:]):
        with pytest.raises(errors.InvalidCompression):
            codec.decompress_packed(broken, 100)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(U32, st.integers(0, 65535)), max_size=300))
def test_posting_lists(pairs):
    pairs = sorted(pairs)
    ids, pos = [p[0] for p in pairs], [p[1] for p in pairs]
    back = codec.decompress_postings(codec.compress_postings(ids, pos), len(pairs))
    assert (back[0].tolist(), back[1].tolist()) == (ids, pos)


def test_columns(spark):
    arrays = [None, [], [5], [1, 2, 3], [0xFFFFFFFF, 0, 0xFFFFFFFF], list(range(400)), [(i * 2654435761) % 2**32 for i in range(300)]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(arrays)], "id int, v array<bigint>")
    df = df.select("id", "v", codec.encoded("v").alias("a"), codec.encoded_packed("v").alias("b"), bits.varint_size("v").alias("na"), bits.packed_size("v").alias("nb"))
    df = df.select("*", codec.decoded("a", F.size("v")).alias("va"), codec.decoded_packed("b", F.size("v")).alias("vb"))
    for r in df.collect():
        if r.v is None:
            assert r.a is None and r.va is None and r.b is None
        else:
            assert r.va == r.v and r.vb == r.v and len(r.a) == r.na and len(r.b) == r.nb


def test_bands_and_masks(spark):
    one = spark.range(1).select(bits.extract_bands(F.lit(0xAABBCCDD), BandTuning()).alias("b"), bits.quantized(F.lit(-2146582564), 2).alias("q"))
    assert one.first().b == [0xDD, 0xCC, 0xBB, 0xAA]
    assert one.first().q == (-2146582564) % 2**32 & 0xFFFFFFFC
    assert bits.quantize_mask(0) == 0xFFFFFFFF and bits.quantize_mask(24) == 0xFF000000


def test_bit_errors(spark):
    rows = [([1, 2, 3, 4], [2, 3, 4], 1), ([2, 3], [1, 2, 3, 0], -1), ([1], [1], 5), ([1, 1], [0, 3], 0)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, o int")
    got = df.select(bits.overlap(F.col("a"), F.col("b"), F.col("o")).alias("n"), bits.bit_errors(F.col("a"), F.col("b"), F.col("o")).alias("e")).collect()
    assert [(r.n, r.e) for r in got] == [(3, 0), (2, 0), (0, 0), (2, 2)]


def test_classes(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1499, 0.15, 0.2499, 0.25, 0.3499, 0.35, 1.0)], "x double")
    got = [tuple(r) for r in df.select(bits.classify(F.col("x")), bits.class_name(bits.classify(F.col("x")))).collect()]
    assert [g[0] for g in got] == [0, 0, 1, 1, 2, 2, 3, 3] and got[0][1] == "strong" and got[-1][1] == "none"


def test_metadata_texts(spark):
    rows = [("Song", "Artist", None, "2020"), ("", None, None, None), ("a\nt=b", None, None, None)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)] + [(9, None)], "i int, m struct<title:string,artist:string,release:string,year:string>")
    got = {r.i: (r.t, r.p) for r in df.select("i", strings.encode_metadata("m").alias("t"), strings.parse_metadata(strings.encode_metadata("m")).alias("p")).collect()}
    assert got[0][0] == "t=Song\na=Artist\ny=2020\n" and tuple(got[0][1]) == ("Song", "Artist", "", "2020")
    assert got[1][0] == "" and tuple(got[1][1]) == ("", "", "", "")
    assert tuple(got[2][1])[0] == "b"
    assert got[9] == (None, None)


def test_auto_tune():
    choose = lambda *a, **k: (lambda t: (t.num_bands, t.bits_per_band))(auto_tune(*a, **k))
    assert choose(1000) == (4, 8) and choose(1000, "speed") == (8, 4) and choose(1000, "low_ram") == (1, 4)
    assert [choose(n, "balanced") for n in (1000, 72_000, 73_000, 90_000_000)] == [(8, 4), (8, 4), (1, 4), (1, 4)]
    assert choose(1000, available_ram=1024) == (4, 4) and choose(1_000_000, storage_budget=10**9) == (1, 8)
    assert choose(1000, "balanced", available_ram=100) == (4, 8)
    assert all(g["bands"] * g["bits"] <= 32 for g in grid(1))


def test_tunings_and_options():
    for bad in ((5, 9), (0, 8), (6, 10)):
        with pytest.raises(errors.InvalidTuning):
            BandTuning(*bad)
    for bad in ({"stride": 0}, {"qbits": 25}, {"skip_interval": 0}):
        with pytest.raises(errors.InvalidTuning):
            PostingTuning(**bad)
    assert PostingTuning.of() == PostingTuning(8, 0, 64) and PostingTuning.of(4, 3, 2) == PostingTuning(4, 3, 2)
    o = QueryOptions(max_candidates=-1, max_bit_error_rate=0)
    assert (o.candidates, o.threshold, o.error_rate, o.include_metadata) == (100, 0, 0.35, False) and DEFAULTS.include_metadata
    assert (HitOptions().hits, HitOptions().k, HitOptions(4, 1).hits) == (3, 100, 4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from([0, 1, 127, 128, 2**14, 2**21, 2**28, 2**31, 2**32 - 1, 77]), max_size=6)), max_size=8))
def test_batches_equal_single_arrays(rows):
    import pyarrow as pa

    values = pa.array(rows, pa.list_(pa.int64()))
    kept = [r for r in rows if r is not None]
    data, at = codec.compress_all(*codec._flat(values)) if kept else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert [data[a:b].tobytes() for a, b in zip(at, at[1:])] == [codec.compress(np.array(r, np.int64)) for r in kept]
    back = codec.decompress_all(data, at, np.array([len(r) for r in kept], np.int64))
    assert back.tolist() == [x for r in kept for x in r]
    # a shorter count leaves the rest out
    fewer = np.array([max(len(r) - 1, 0) for r in kept], np.int64)
    assert codec.decompress_all(data, at, fewer).tolist() == [x for r in kept for x in r[:-1]]


def test_broken_batches():
    data, at = codec.compress_all(np.array([5, 300, 7]), np.array([0, 3]))
    for cut, error in ((3, codec.InvalidCompression), (5, codec.TruncatedVarint)):
        with pytest.raises(error):
            codec.decompress_all(data[:cut], np.array([0, cut]), np.array([3]))
    with pytest.raises(codec.TruncatedVarint):
        codec.decompress_all(np.r_[data[:4], np.full(5, 255, np.uint8), np.uint8(1)], np.array([0, 10]), np.array([2]))
