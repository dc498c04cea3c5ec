"""What the plans must look like to hold at scale: pushed filters, pruned columns, few exchanges, no Python in searches."""

import re

import pytest
from conftest import DATA

from wavemill.operators import heavy_keys, postings, search
from wavemill.plans import catalog, engine
from wavemill.tuning import HitOptions


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_reaches_the_scan(spark):
    index = spark.read.parquet(f"{DATA}/sampled_postings.parquet")
    p = plan(postings.lookup_hash(index, 761953584))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(hash,761953584\)", p)


def test_searches_stay_in_the_jvm_and_read_few_columns(spark):
    for name in ("query_full", "band_query", "band_query_overflow"):
        p = plan(catalog.QUERIES[name](spark, str(DATA)))
        assert not re.search("Python|Arrow|CartesianProduct|BroadcastNestedLoop", p)
        assert "added_at" not in re.sub(r"fingerprints[^\n]*", "", p) or name != "query_full"


@pytest.mark.parametrize("name", ["query_full", "query_full_overflow", "band_query", "band_query_overflow"])
def test_the_index_is_probed_where_it_lies(spark, name):
    """Between the scan of an index and the probe by the queries' keys nothing is exchanged."""
    p = plan(catalog.QUERIES[name](spark, str(DATA)))
    probes = re.findall(r"LeftSemi, BuildRight[^\n]*\n((?:(?!Broadcast|LeftSemi)[^\n]*\n)*?[^\n]*FileScan[^\n]*)", p)
    assert len(probes) == (2 if "overflow" in name else 1) and not any("Exchange" in x for x in probes)


def test_few_keys_reach_the_scan(spark, tmp_path):
    """The scan of a stored index is cut to the ranges that the keys of a small batch take up."""
    rows = spark.range(200_000).selectExpr("id * 4 as hash", "id as fp_id", "cast(id % 5 as int) as ordinal")
    rows.sort("hash").coalesce(1).write.option("parquet.block.size", 1 << 17).parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    q = spark.createDataFrame([(1, [8, 12, 16, 400_000, 400_004])], "qid long, values array<bigint>")
    got = search.full_query(q, index, options=HitOptions(min_hits=1))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(hash,8\)[^\]]*EqualTo\(hash,400004\)", plan(got))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert sorted(r.fp_id for r in got.collect()) == [2, 3, 4, 100_000, 100_001]
    none = spark.createDataFrame([(1, [])], q.schema)
    assert search.full_query(none, index).count() == 0


def test_ranges_cover_keys():
    assert search.covering([5, 1, 900, 3, 907], 2) == [(1, 5), (900, 907)] and search.covering([]) == [] and search.covering([7, 7]) == [(7, 7)]
    keys = [k * k for k in range(1000)]
    ranges = search.covering(keys)
    assert len(ranges) == search.RANGES and all(any(a <= k <= b for a, b in ranges) for k in keys)


def test_large_batches_are_shuffled_not_sent(spark, monkeypatch):
    q, index = engine._queries(spark, str(DATA)), engine._index(spark, str(DATA))
    small = sorted(map(tuple, search.full_query(q, index).collect()))
    monkeypatch.setattr(search, "SENT_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = search.full_query(q, index)
        assert "BroadcastHashJoin" not in plan(large) and sorted(map(tuple, large.collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_without_counterparts_read_one_column(spark):
    p = plan(heavy_keys.key_counts(spark.read.parquet(f"{DATA}/band_postings.parquet"), "fp_id"))
    assert "ReadSchema: struct<fp_id:bigint>" in p and len(re.findall("Exchange hash", p)) == 1


def test_no_query_joins_everything_with_everything(spark):
    for name, query in catalog.QUERIES.items():
        assert not re.search("CartesianProduct|BroadcastNestedLoop", plan(query(spark, str(DATA)))), name
