import json
from pathlib import Path

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from wavemill import errors
from wavemill.sources.fixtures import lcg_fingerprints, lcg_range
from wavemill.sources.store import Dataset, from_compressed
from wavemill.streaming.ingest import arrivals_by_window, ingest
from wavemill.tuning import BandTuning, PostingTuning, QueryOptions


def ids(spark, *values):
    return lcg_fingerprints(spark.createDataFrame([(v,) for v in values], "fp_id long"), 64)


def metadata(spark, rows):
    return spark.createDataFrame(rows, "fp_id long, mbid string, track_id long, metadata struct<title:string,artist:string,release:string,year:string>")


META = [(10, "m10", 1, ("Song A", "Artist A", "Album A", "2020")), (20, "m20", 2, ("Song B", None, None, None)), (30, "m30", 3, None)]


@pytest.fixture
def dataset(spark, tmp_path):
    return Dataset.create(spark, str(tmp_path / "ds"), fingerprints=ids(spark, 50, 10, 30, 20, 40), mappings=metadata(spark, META), posting_tuning=PostingTuning(8, 2, 16))


def test_round_trip_and_lookup(spark, dataset):
    again = Dataset.open(spark, dataset.path)
    assert again.lookup(30)["values"] == ids(spark, 30).first()["values"]
    assert again.lookup_metadata(10).metadata.title == "Song A" and again.lookup_metadata(30).metadata is None
    for missing in (lambda: again.lookup(999), lambda: again.lookup_metadata(999)):
        with pytest.raises(errors.RecordNotFound):
            missing()
    assert (again.band_tuning, again.posting_tuning) == (BandTuning(), PostingTuning(8, 2, 16))
    row = again.stats().first()
    assert (row.record_count, row.metadata_count, row.overflow_count, row.has_overflow, row.has_search_index) == (5, 3, 0, False, True)
    assert not again.needs_compaction(5)


def test_queries(spark, dataset):
    q = ids(spark, 20).selectExpr("1L as qid", "values")
    (r,) = dataset.query(q).collect()
    assert (r.fp_id, r.ber, r.mbid, r.metadata.title) == (20, 0.0, "m20", "Song B")
    assert "mbid" not in dataset.query(q, QueryOptions(include_metadata=False)).columns
    assert [(r.fp_id, r.hits, r.delta) for r in dataset.query_full(q).collect()] == [(20, 8, 0)]
    assert dataset.query_full(q, verify=True).first().ber == 0.0


def test_overflow_and_compaction(spark, dataset):
    dataset.append_fingerprints(ids(spark, 1000, 1010, 1020))
    dataset.append_sampled_postings([1000, 1010, 1020])
    dataset.append_band_postings([1000, 1010])
    assert dataset.lookup(1010)["values"] == ids(spark, 1010).first()["values"]
    assert dataset.fingerprints().where("from_overflow").count() == 3 and dataset.needs_compaction(50) and not dataset.needs_compaction(61)
    q = ids(spark, 1000).selectExpr("1L as qid", "values")
    assert [(r.fp_id, r.hits) for r in dataset.query_full(q).collect()] == [(1000, 8)]
    assert [r.fp_id for r in dataset.query(q).collect()] == [1000]
    with pytest.raises(errors.RecordNotFound):
        dataset.append_sampled_postings([12345])
    tuning = dataset.posting_tuning
    dataset.compact()
    again = Dataset.open(spark, dataset.path)
    row = again.stats().first()
    assert (row.record_count, row.has_overflow) == (8, False) and again.posting_tuning == tuning
    assert again._main("sampled_postings").count() == 64 and again._main("band_postings").count() == 8 * 64 * 4
    assert again.query(q).where("rank = 1").first().fp_id == 1000
    again.vacuum()
    assert Dataset.open(spark, dataset.path).lookup(1000).duration_ms == 6400
    assert len(list(Path(dataset.path, "fingerprints").glob("*.json"))) == 1


def test_second_append_replaces_or_accumulates(spark, dataset):
    dataset.append_fingerprints(ids(spark, 100))
    dataset.append_fingerprints(ids(spark, 200))
    assert rows_of(dataset.fingerprints().where("from_overflow"), "fp_id") == [(200,)]
    dataset.append_fingerprints(ids(spark, 300, 200), mode="accumulate")
    assert rows_of(dataset.fingerprints().where("from_overflow"), "fp_id") == [(200,), (300,)]
    dataset.truncate_overflow("fingerprints")
    assert dataset.fingerprints().count() == 5
    with pytest.raises(errors.OffsetOutOfBounds):
        dataset.truncate_overflow("nothing")


def test_appends_are_laid_over_each_other(spark, dataset):
    """Each accumulated append is a folder of its own; the newest record of an id counts; compaction folds all in."""
    fps = lambda *rows: spark.createDataFrame(rows, "fp_id long, duration_ms long, values array<bigint>")
    dataset.append_fingerprints(fps((10, 1, [1]), (77, 1, [1]), (77, 2, [2])))
    first = dataset.manifest["tables"]["fingerprints"]["overflow"]
    dataset.append_fingerprints(fps((77, 3, [3]), (88, 1, [1])), mode="accumulate")
    dataset.append_fingerprints(fps((88, 4, [4])), mode="accumulate")
    assert dataset.manifest["tables"]["fingerprints"]["overflow"][:1] == first and len(dataset.manifest["tables"]["fingerprints"]["overflow"]) == 3
    again = Dataset.open(spark, dataset.path)
    assert rows_of(again.fingerprints().where("from_overflow"), "fp_id", "duration_ms") == [(10, 1), (77, 3), (88, 4)]
    assert again.lookup(77).duration_ms == 3 and again.fingerprints().count() == 7
    again.compact()
    again.vacuum()
    assert rows_of(Dataset.open(spark, dataset.path)._main("fingerprints").where("fp_id > 50 or fp_id = 10"), "fp_id", "duration_ms") == [(10, 1), (77, 3), (88, 4)]


def test_two_writers(spark, dataset):
    """The second of two writers that opened the same state is refused and loses nothing of the first's."""
    one, two = Dataset.open(spark, dataset.path), Dataset.open(spark, dataset.path)
    one.append_fingerprints(ids(spark, 100))
    with pytest.raises(errors.ConcurrentChange):
        two.append_fingerprints(ids(spark, 200))
    assert rows_of(Dataset.open(spark, dataset.path).fingerprints().where("from_overflow"), "fp_id") == [(100,)]
    one.append_fingerprints(ids(spark, 300), mode="accumulate")
    assert rows_of(one.fingerprints().where("from_overflow"), "fp_id") == [(100,), (300,)]


def test_bands_of_all_bits(spark, tmp_path):
    fps = lcg_range(spark, 1, 4, 30)
    ds = Dataset.create(spark, str(tmp_path / "wide"), fingerprints=fps, band_tuning=BandTuning(1, 32), posting_tuning=None)
    assert [r.fp_id for r in ds.query(fps.where("fp_id = 3").selectExpr("1L as qid", "values")).collect()] == [3]


def test_overflow_mappings_shadow(spark, dataset):
    dataset.append_mappings(metadata(spark, [(10, "new", 777, None), (60, "m60", 6, ("x", "y", "z", "1"))]))
    rows = {r.fp_id: (r.track_id, r.from_overflow) for r in dataset.mappings().collect()}
    assert rows == {10: (777, True), 60: (6, True), 20: (2, False), 30: (3, False)}
    dataset.compact(["mappings"])
    assert dataset._main("mappings").count() == 4 and dataset._overflow("mappings") is None


def test_texts_can_be_left_out(spark, tmp_path):
    ds = Dataset.create(spark, str(tmp_path / "x"), fingerprints=lcg_range(spark, 1, 3, 20), mappings=metadata(spark, META), include_text=False)
    assert ds.mappings().where("metadata is not null").count() == 0
    ds.append_mappings(metadata(spark, META))
    ds.compact()
    assert ds.mappings().where("metadata is not null").count() == 0


def test_what_is_missing(spark, tmp_path):
    fps = lcg_range(spark, 1, 3, 64)
    q = fps.selectExpr("fp_id as qid", "values")
    with pytest.raises(errors.NoIndex):
        Dataset.create(spark, str(tmp_path / "a"), fingerprints=fps, band_tuning=None, posting_tuning=None)
    with pytest.raises(errors.NoIndex):
        Dataset.open(spark, str(tmp_path / "none"))
    no_band = Dataset.create(spark, str(tmp_path / "b"), fingerprints=fps, band_tuning=None)
    with pytest.raises(errors.NoSearchIndex):
        no_band.query(q)
    no_posting = Dataset.create(spark, str(tmp_path / "c"), fingerprints=fps, posting_tuning=None)
    with pytest.raises(errors.NoPostingIndex):
        no_posting.query_full(q)
    assert no_posting.lookup_metadata(1) is None and no_posting.mappings().count() == 0
    from wavemill.operators.postings import sampled

    only = Dataset.create(spark, str(tmp_path / "d"), sampled_postings=sampled(fps))
    assert only.query_full(q).count() == 3
    with pytest.raises(errors.NoDataStore):
        only.lookup(1)


def test_manifest_is_checked(spark, dataset):
    file = Path(dataset.path, "manifest.json")
    good = json.loads(file.read_text())
    for change, error in (({"version": 1}, errors.UnsupportedVersion), ({"colour": 1}, errors.UnknownFlags), ({"dataset_id": "other"}, errors.DatasetMismatch)):
        dataset.files.write("manifest.json", json.dumps(good | change))
        with pytest.raises(error):
            Dataset.open(spark, dataset.path)
    good["tables"]["fingerprints"]["overflow"] = "fingerprints/gone"
    dataset.files.write("manifest.json", json.dumps(good))
    with pytest.raises(errors.CorruptOverflow):
        Dataset.open(spark, dataset.path)


def test_limits_of_records(spark, dataset):
    big = spark.createDataFrame([(1, 1, list(range(65536)))], "fp_id long, duration_ms long, values array<bigint>")
    with pytest.raises(errors.OffsetOutOfBounds):
        dataset.append_fingerprints(big)
    with pytest.raises(errors.OffsetOutOfBounds):
        dataset.append_fingerprints(spark.createDataFrame([(1, 1, [])], big.schema))


@pytest.mark.parametrize("packed", [False, True])
def test_encoded_fingerprints(spark, packed):
    from wavemill.functions import codec

    fps = lcg_range(spark, 1, 5, 40)
    encode = codec.encoded_packed if packed else codec.encoded
    data = fps.select("fp_id", "duration_ms", encode("values").alias("data"), F.size("values").alias("raw_count"))
    assert rows_of(from_compressed(data, packed)) == rows_of(fps)


def test_stream_into_overflow(spark, dataset, tmp_path):
    source = str(tmp_path / "in")
    ids(spark, 70, 80, 10).write.parquet(source)
    stream = spark.readStream.schema(ids(spark, 1).schema).parquet(source)
    for _ in range(2):
        run = ingest(stream, dataset, str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination()
        ids(spark, 90).write.mode("append").parquet(source)
    assert rows_of(dataset.fingerprints().where("from_overflow"), "fp_id") == [(10,), (70,), (80,), (90,)]
    q = ids(spark, 90).selectExpr("1L as qid", "values")
    assert [(r.fp_id, r.hits) for r in dataset.query_full(q).collect()] == [(90, 8)]
    assert [r.fp_id for r in dataset.query(q).collect()] == [90]


def test_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1, 2], "2024-01-01 01:00:00"), (2, None, "2024-01-01 02:00:00"), (3, [1], "2024-01-05 02:00:00")], "fp_id long, values array<bigint>, t string")
    rows.selectExpr("fp_id", "values", "cast(t as timestamp) as added_at").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("fp_id long, values array<bigint>, added_at timestamp").parquet(str(tmp_path / "in"))
    run = arrivals_by_window(stream).writeStream.outputMode("append").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [(r.n_fps, r.n_values) for r in spark.table("arrivals").collect()] == [(2, 2)]
