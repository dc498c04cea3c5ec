"""Postings moved as blobs: searches over many buckets, and the layout of a band index."""

import pytest
from conftest import DATA, rows_of, same_as_sql
from pyspark.sql import functions as F

from wavemill.operators import bands, packed, search
from wavemill.plans import catalog, engine
from wavemill.sources.store import Dataset
from wavemill.tuning import BandTuning, QueryOptions

WIDE = BandTuning(2, 16)


@pytest.fixture(params=[1 << 21, 1 << 10])
def sizes(request, monkeypatch):
    """Parts and blocks as they are, and so small that there are many."""
    for name in ("PART_ROWS", "PACKED_ROWS", "MEETINGS", "CELLS", "PENDING"):
        monkeypatch.setattr(packed, name, request.param)


def test_stored_query_by_arrays_equals_sql(spark, duck, sizes, monkeypatch):
    monkeypatch.setattr(search, "DENSE_MEETINGS", 0)
    calls, own = [], packed.candidates
    monkeypatch.setattr(packed, "candidates", lambda *x: calls.append(1) or own(*x))
    df = catalog.QUERIES["stored_query"](spark, str(DATA))
    assert calls
    same_as_sql(df, duck, catalog.SQL["stored_query"])


def test_odd_rows_of_many_buckets(spark, sizes, monkeypatch):
    """Null ids and elements, empty queries, repeated values, ties at the last candidate, an overflow; a band of all bits."""
    q = engine._queries(spark, str(DATA)).unionByName(spark.createDataFrame([(9001, []), (9002, None), (9003, [None, 5, 5]), (None, [5, 6])], "qid long, values array<bigint>"))
    odd = spark.createDataFrame([(None, [5]), (70_001, [5, None, 5, 6]), (-3, [6, 5])], "fp_id long, values array<bigint>")
    fps = engine._fps(spark, str(DATA)).select("fp_id", "values").unionByName(odd)
    late = engine._fps(spark, str(DATA), "fingerprints_overflow").select("fp_id", "values")

    def found():
        return [
            rows_of(search.band_candidates(q, bands.band_postings(fps, t), t, o, bands.band_postings(late, t)))
            for t in (WIDE, BandTuning(1, 32))
            for o in (QueryOptions(max_candidates=7), QueryOptions(max_candidates=3, min_match_threshold=1))
        ]

    before = found()
    monkeypatch.setattr(search, "DENSE_MEETINGS", 0)
    assert found() == before and all(before)


def test_layout_of_a_band_index(spark, sizes, tmp_path):
    """All postings, null ids too; each file sorted, and a range of buckets and ids that no other file reaches into."""
    fps = engine._fps(spark, str(DATA)).select("fp_id", "duration_ms", "values").unionByName(spark.createDataFrame([(None, 1, [5, None, 7])], "fp_id long, duration_ms long, values array<bigint>"))
    ds = Dataset.create(spark, str(tmp_path / "ds"), fingerprints=fps, band_tuning=WIDE, posting_tuning=None)
    stored = ds._main("band_postings")
    want = bands.band_postings(fps, WIDE)
    assert stored.exceptAll(want).isEmpty() and want.exceptAll(stored).isEmpty() and stored.dtypes == want.dtypes
    files = {}
    for r in stored.withColumn("_file", F.input_file_name()).collect():
        files.setdefault(r["_file"], []).append((r.bucket, r.fp_id if r.fp_id is not None else -(1 << 63), r.pos))
    assert all(rows == sorted(rows) for rows in files.values())
    ranges = sorted((rows[0], rows[-1]) for rows in files.values())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    assert len(files) > 1 or packed.PART_ROWS > 1 << 10
