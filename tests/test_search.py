"""Searches on generated fingerprints, against known results and against a simulation posting by posting."""

from collections import defaultdict

import pytest

from wavemill.operators import bands, postings, search
from wavemill.sources.fixtures import lcg_range
from wavemill.tuning import BandTuning, HitOptions, PostingTuning, QueryOptions


def lcg(seed, count):
    out, x = [], seed
    for _ in range(count):
        x = (x * 1103515245 + 12345) % 2**32
        out.append(x)
    return out


def as_queries(spark, *arrays):
    return spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "qid long, values array<bigint>")


def simulated(query, stored, overflow=(), k=100):
    """The band query with 4 x 8, posting by posting."""
    count, first = defaultdict(int), {}
    for qpos, v in enumerate(query):
        for band in range(4):
            for late, table in enumerate((stored, dict(overflow))):
                for fp in sorted(table):
                    for pos, w in enumerate(table[fp]):
                        if (v >> 8 * band) & 255 == (w >> 8 * band) & 255:
                            count[fp] += 1
                            first.setdefault(fp, pos - qpos)
    least = max(3, int(len(query) * 4 * 0.02))
    best = sorted((fp for fp in count if count[fp] >= least), key=lambda f: (-count[f], f))[:k]
    current = {**stored, **dict(overflow)}
    out = []
    for fp in best:
        o, c = first[fp], current[fp]
        pairs = list(zip(c[max(o, 0) :], query[max(-o, 0) :]))
        if pairs:
            ber = sum(bin(a ^ b).count("1") for a, b in pairs) / (32 * len(pairs))
            if ber < 0.35:
                out.append((fp, count[fp], o, ber))
    return sorted(out, key=lambda m: (m[3], m[0]))


def test_generator(spark):
    rows = {r.fp_id: r for r in lcg_range(spark, 1, 3, 50).collect()}
    assert rows[1]["values"] == lcg(1, 50) and rows[1]["values"][:3] == [1103527590, 2524885223, 662824084]
    assert rows[2].duration_ms == 5000


@pytest.mark.parametrize("changed", [False, True])
def test_band_query_finds_exact_and_similar(spark, changed):
    fps = lcg_range(spark, 1, 8, 50)
    query = [v ^ 1 if changed and i % 5 == 0 else v for i, v in enumerate(lcg(1, 50))]
    got = search.band_query(as_queries(spark, query), bands.band_postings(fps), fps).collect()
    assert [(r.fp_id, r.matches, r.offset, r.ber, r.score_name) for r in got] == [(1, 219 if changed else 228, 0, 0.00625 if changed else 0.0, "strong")]


def test_band_candidates_of_generated(spark):
    got = search.band_candidates(as_queries(spark, lcg(1, 50)), bands.band_postings(lcg_range(spark, 1, 8, 50))).collect()
    assert {r.fp_id: (r.matches, r.pos, r.qpos) for r in got} == {1: (228, 0, 0), 2: (29, 46, 5), 3: (17, 40, 21), 4: (31, 45, 0), 5: (28, 31, 2), 6: (55, 23, 2), 7: (50, 30, 0), 8: (20, 40, 2)}


def test_band_query_equals_simulation_with_overflow(spark):
    stored = {i: lcg(i, 40) for i in range(1, 13)}
    later = {3: lcg(77, 40), 50: lcg(50, 40), 51: lcg(1, 20) + lcg(50, 20)}
    frame = lambda d: spark.createDataFrame([(k, v) for k, v in d.items()], "fp_id long, values array<bigint>")
    queries = [lcg(1, 40), lcg(3, 40)[5:30], lcg(77, 40), lcg(50, 40)[3:], [1, 2, 3]]
    got = search.band_query(as_queries(spark, *queries), bands.band_postings(frame(stored)), frame(stored), overflow_postings=bands.band_postings(frame(later)), overflow_fingerprints=frame(later)).collect()
    for i, q in enumerate(queries):
        mine = sorted(((r.fp_id, r.matches, r.offset, r.ber) for r in got if r.qid == i), key=lambda m: (m[3], m[0]))
        assert mine == simulated(q, stored, later)


def test_every_tuning(spark):
    """Whatever the number of bands, a fingerprint finds itself at its offset with as many meetings as counted by hand."""
    fps, query = lcg_range(spark, 1, 4, 40), lcg(2, 40)[5:]
    for n, size in [(1, 1), (32, 1), (20, 1), (17, 1), (1, 32), (16, 2), (10, 3), (8, 4), (6, 5), (2, 16)]:
        t = BandTuning(n, size)
        band = lambda v, k: (v >> size * k) & ((1 << size) - 1)  # noqa: B023, E731
        met = {(fp, qp, k, p) for fp in range(1, 5) for qp, v in enumerate(query) for p, w in enumerate(lcg(fp, 40)) for k in range(n) if band(v, k) == band(w, k)}
        got = {r.fp_id: (r.matches, r.qpos, r.pos) for r in search.band_matches(as_queries(spark, query), bands.band_postings(fps, t), t).collect()}
        want = {}
        for fp in {m[0] for m in met}:
            mine = [m for m in met if m[0] == fp]
            _, qp, _, p = min(mine)
            want[fp] = (len(mine), qp, p)
        assert got == want


def test_metadata_only_without_options_or_if_asked(spark):
    fps = lcg_range(spark, 1, 3, 50)
    maps = spark.createDataFrame([(1, "m", 5)], "fp_id long, mbid string, track_id long")
    found = lambda **o: search.band_query(as_queries(spark, lcg(1, 50)), bands.band_postings(fps), fps, mappings=maps, **o)
    assert "mbid" in found().columns and "mbid" not in found(options=QueryOptions(max_candidates=5)).columns
    assert found(options=QueryOptions(include_metadata=True)).first().mbid == "m"


def test_band_query_options_and_empty(spark):
    fps = lcg_range(spark, 1, 8, 50)
    index = bands.band_postings(fps)
    queries = as_queries(spark, lcg(1, 50), [], None)
    assert [r.qid for r in search.band_query(queries, index, fps).collect()] == [0]
    assert search.band_query(queries, index, fps, options=QueryOptions(min_match_threshold=229)).count() == 0
    assert search.band_query(queries, index, fps.where("false")).count() == 0
    assert search.band_query(queries, index.where("false"), fps).count() == 0
    wide = search.band_query(queries, index, fps, options=QueryOptions(max_bit_error_rate=0.9))
    assert wide.where("ber >= 0.35").count() == 0


def test_partitioning_does_not_matter(spark):
    fps = lcg_range(spark, 1, 20, 60)
    q = as_queries(spark, lcg(4, 60), lcg(9, 60)[10:])
    one = search.band_query(q, bands.band_postings(fps.coalesce(1)), fps).collect()
    many = search.band_query(q.repartition(3), bands.band_postings(fps.repartition(7)), fps.repartition(5)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_posting_index_of_generated(spark):
    index = postings.sampled(lcg_range(spark, 1, 15, 64))
    stats = postings.posting_stats(index).first()
    assert tuple(stats) == (120, 120, 1)
    got = search.full_query(as_queries(spark, lcg(1, 64), lcg(1, 64)[16:]), index).collect()
    assert sorted((r.qid, r.fp_id, r.hits, r.delta) for r in got) == [(0, 1, 8, 0), (1, 1, 6, 16)]


def filled(n, at):
    out = [(0xDEAD0000 + 8 * i) % 2**32 for i in range(n)]
    for k, v in at.items():
        out[k] = v
    return out


def test_quantized_votes(spark):
    rows = spark.createDataFrame([(7, [0x1001, 0x2002, 0x3003], [0, 1, 2])], "fp_id long, hashes array<bigint>, ordinals array<int>")
    got = search.full_query(as_queries(spark, filled(24, {0: 0x1002, 8: 0x2001, 16: 0x3000})), postings.from_values(rows)).collect()
    assert [(r.fp_id, r.hits, r.delta) for r in got] == [(7, 3, 0)]


def test_vote_ranking(spark):
    h = [0x1100, 0x2200, 0x3300, 0x4400, 0x5500]
    rows = [(10, h, [0, 1, 2, 3, 4]), (20, h[:4], [0, 1, 2, 3]), (30, h[:3], [0, 3, 7]), (40, h[:3], [1, 2, 3]), (50, h[:3], [0, 1, 2])]
    index = postings.from_values(spark.createDataFrame(rows, "fp_id long, hashes array<bigint>, ordinals array<int>"))
    q = as_queries(spark, filled(40, {8 * i: v | 3 for i, v in enumerate(h)}))
    hits = lambda **o: [(r.fp_id, r.hits, r.delta) for r in search.full_query(q, index, options=HitOptions(**o)).orderBy("rank").collect()]
    assert hits() == [(10, 5, 0), (20, 4, 0), (50, 3, 0), (40, 3, 8)]
    assert hits(min_hits=4) == [(10, 5, 0), (20, 4, 0)] and hits(top_k=1) == [(10, 5, 0)]
    assert sorted(r.fp_id for r in postings.lookup_hash(index, h[0] | 2).collect()) == [10, 20, 30, 40, 50]


def test_skip_directory_and_buckets(spark):
    rows = spark.createDataFrame([(256 * i, fp, i) for i in range(1, 201) for fp in (1, 2)], "hash long, fp_id long, ordinal int")
    t = PostingTuning(8, 2, 4)
    assert tuple(postings.posting_stats(rows).first()) == (200, 400, 2)
    skip = {r.entry: r.hash for r in postings.skip_directory(rows, t).collect()}
    assert len(skip) == 50 and skip == {k: 256 * (4 * k + 1) for k in range(50)}
    assert postings.lookup_hash(rows, 5 * 256 + 128, t).count() == 0 and postings.lookup_hash(rows, 200 * 256, t).count() == 2
    assert tuple(postings.posting_stats(rows.where("false")).first()) == (0, 0, 0)


def test_sampling_stops_at_the_last_ordinal(spark):
    df = spark.createDataFrame([(1, list(range(0, 4 * 3000, 4)), "x"), (2, [], "y"), (3, None, "z"), (4, [8, None], "z")], "fp_id long, values array<bigint>, hash string")
    got = postings.sampled(df)
    assert got.where("fp_id = 1").agg({"ordinal": "max"}).first()[0] == 255 and got.where("fp_id = 1").count() == 256
    assert got.where("fp_id > 1").count() == 1
    assert bands.band_postings(df, BandTuning(2, 16)).where("fp_id = 4").count() == 2


def test_unequal_lengths_fail(spark):
    rows = spark.createDataFrame([(1, [1, 2], [0])], "fp_id long, hashes array<bigint>, ordinals array<int>")
    with pytest.raises(Exception, match="differ in length"):
        postings.from_values(rows).collect()


def test_verified_hits(spark):
    fps = lcg_range(spark, 1, 5, 64)
    q = as_queries(spark, lcg(2, 64)[8:])
    got = search.verified_hits(search.full_query(q, postings.sampled(fps)), q, fps).collect()
    assert [(r.fp_id, r.delta, r.ber, r.score) for r in got] == [(2, 8, 0.0, 0)]
