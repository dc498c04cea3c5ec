"""All meetings of a query and a fingerprint, by arrays as by rows."""

import pytest
from conftest import DATA, rows_of, same_as_sql

from wavemill.operators import bands, dense, search
from wavemill.plans import catalog, engine


def test_band_search_by_arrays_equals_sql(spark, duck, monkeypatch):
    monkeypatch.setattr(search, "DENSE_MEETINGS", 0)
    df = catalog.QUERIES["band_search"](spark, str(DATA))
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    same_as_sql(df, duck, catalog.SQL["band_search"])


@pytest.mark.parametrize("size", [1 << 21, 1 << 13])
def test_odd_rows_and_large_sums(spark, size, monkeypatch):
    """Null ids and elements, repeated bands, an overflow, positions whose sums pass 24 bits, many blocks."""
    monkeypatch.setattr(dense, "CELLS", size)
    monkeypatch.setattr(dense, "ROWS", size >> 5)
    q = engine._queries(spark, str(DATA)).unionByName(spark.createDataFrame([(9001, []), (9002, None), (9003, [None, 5, 5]), (None, [5, 6])], "qid long, values array<bigint>"))
    posts = bands.band_postings(engine._fps(spark, str(DATA))).unionByName(bands.band_postings(spark.createDataFrame([(None, [5]), (70_001, [5, None, 5, 6]), (-3, [5] * 60_001)], "fp_id long, values array<bigint>")))
    late = bands.band_postings(engine._fps(spark, str(DATA), "fingerprints_overflow"))
    posts = posts.where("fp_id is not null")
    before = rows_of(search.match_sums(q, posts, overflow=late))
    monkeypatch.setattr(search, "DENSE_MEETINGS", 0)
    assert rows_of(search.match_sums(q, posts, overflow=late)) == before and max(r[3] for r in before) > 1 << 24
