"""Searches by arrays against SQL and against the plans of small batches."""

import pytest
from conftest import DATA, rows_of, same_as_sql

from wavemill.operators import bands, dense, search
from wavemill.plans import catalog, engine
from wavemill.tuning import BandTuning, HitOptions, QueryOptions


@pytest.fixture
def arrays(monkeypatch):
    monkeypatch.setattr(search, "DENSE_MEETINGS", 0)
    monkeypatch.setattr(search, "DENSE_VALUES", 0)


@pytest.fixture(params=[1 << 21, 1 << 13])
def sizes(request, monkeypatch):
    """Blocks as they are, and so small that there are many."""
    monkeypatch.setattr(dense, "CELLS", request.param)
    monkeypatch.setattr(dense, "VOTES", request.param)


def by_arrays(df):
    return "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["band_search_counts", "band_candidates", "band_query", "band_query_options", "band_query_metadata", "band_query_overflow"])
def test_bands_by_arrays_equal_sql(spark, duck, arrays, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    assert by_arrays(df)
    same_as_sql(df, duck, catalog.SQL[name])


@pytest.mark.parametrize("name", ["query_full", "query_full_verified", "query_full_minhits_topk", "query_full_overflow", "stored_query_full"])
def test_votes_by_arrays_equal_sql(spark, duck, arrays, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    assert by_arrays(df)
    same_as_sql(df, duck, catalog.SQL[name])


def test_blocks_and_odd_rows(spark, sizes, monkeypatch):
    """Many blocks, null ids and elements, empty queries, few candidates and any number of hits."""
    q = engine._queries(spark, str(DATA)).unionByName(spark.createDataFrame([(9001, []), (9002, None), (9003, [None, 5]), (None, [5, 6])], "qid long, values array<bigint>"))
    fps, index = engine._fps(spark, str(DATA)), engine._index(spark, str(DATA))
    posts = bands.band_postings(fps).unionByName(bands.band_postings(spark.createDataFrame([(None, [5]), (70_001, [5, None, 5, 6])], "fp_id long, values array<bigint>")))
    late = bands.band_postings(engine._fps(spark, str(DATA), "fingerprints_overflow"))
    votes = index.unionByName(spark.createDataFrame([(8, None, 3), (4, None, 0), (4, 70_001, 0)], index.schema))

    def found():
        return [
            rows_of(search.band_candidates(q, posts, BandTuning(), QueryOptions(max_candidates=7), late)),
            rows_of(search.band_candidates(q, posts, BandTuning(), QueryOptions(max_candidates=3, min_match_threshold=20))),
            rows_of(search.match_counts(q, posts, BandTuning(), late)),
            rows_of(search.full_query(q, votes, options=HitOptions(min_hits=1, top_k=9), overflow=votes)),
            rows_of(search.band_candidates(q, posts.where("false"))),
            rows_of(search.full_query(q, votes.where("false"))),
        ]

    before = found()
    monkeypatch.setattr(search, "DENSE_MEETINGS", 0)
    monkeypatch.setattr(search, "DENSE_VALUES", -1)
    assert found() == before and all(before[:4])
