"""Container files: round trips of all four kinds, an overflow laid by hand, and broken files."""

import struct
import uuid

import numpy as np
import pytest
from conftest import rows_of

from wavemill import errors
from wavemill.functions import codec
from wavemill.operators import bands, postings
from wavemill.sources import container as c
from wavemill.sources.fixtures import lcg_range
from wavemill.sources.store import Dataset
from wavemill.tuning import BandTuning, PostingTuning

FAMILY = "TEST"


@pytest.mark.parametrize("packed", [False, True])
def test_fingerprints(spark, tmp_path, packed):
    path = str(tmp_path / "a")
    fps = lcg_range(spark, 1, 100, 50).unionByName(spark.createDataFrame([(7, None, []), (500, 5, [2**32 - 1]), (7, 1, [1, 1])], "fp_id long, duration_ms long, values array<bigint>"))
    mine = uuid.uuid4()
    c.write_container(fps.repartition(5), path, "D", FAMILY, packed=packed, dataset_id=mine, source_date=77)
    got = c.read_container(spark, path, "D", FAMILY, perTask=7)
    assert rows_of(got, "fp_id", "duration_ms", "values", "from_overflow") == sorted([(r.fp_id, r.duration_ms or 0, r["values"], False) for r in fps.collect()], key=str)
    h = c.read_header(path, "D", FAMILY)
    assert (h.records, h.packed, h.source_date, h.dataset_id) == (103, packed, 77, mine.bytes)


@pytest.mark.parametrize("packed", [False, True])
def test_band_postings(spark, tmp_path, packed):
    path, fps = str(tmp_path / "a"), lcg_range(spark, 1, 15, 30)
    c.write_container(fps, path, "X", FAMILY, packed=packed, tuning=BandTuning(4, 7))
    got = c.read_container(spark, path, "X", FAMILY)
    want = bands.band_postings(fps, BandTuning(4, 7))
    assert rows_of(got, *want.columns) == rows_of(want) and c.read_header(path, "X", FAMILY).tuning == BandTuning(4, 7)


def test_sampled_postings(spark, tmp_path):
    path, fps, tuning = str(tmp_path / "a"), lcg_range(spark, 1, 40, 64), PostingTuning(4, 22, 3)
    c.write_container(fps, path, "I", FAMILY, tuning=tuning)
    want = postings.sampled(fps, tuning)
    for per in (1, 1000):
        assert rows_of(c.read_container(spark, path, "I", FAMILY, perTask=per), *want.columns) == rows_of(want)
    assert c.read_header(path, "I", FAMILY).tuning == tuning
    c.write_container(fps.where("false"), path, "I", FAMILY)
    assert c.read_container(spark, path, "I", FAMILY).count() == 0


def test_mappings(spark, tmp_path):
    path, ids = str(tmp_path / "a"), [str(uuid.UUID(int=i)) for i in (5, 6, 7)]
    rows = [(10, ids[0], 1, ("Söng", "A", "", "2020")), (10, ids[1], 2, None), (4_000_000_000, ids[2], 3, ("", "", "", ""))]
    df = spark.createDataFrame(rows, "fp_id long, mbid string, track_id long, metadata struct<title:string,artist:string,release:string,year:string>")
    c.write_container(df, path, "M", FAMILY)
    got = {r.mbid: (r.fp_id, r.track_id, r.metadata and tuple(r.metadata)) for r in c.read_container(spark, path, "M", FAMILY).collect()}
    assert got == {m: (i, t, x) for i, m, t, x in rows}
    c.write_container(df, path, "M", FAMILY, texts=False)
    assert c.read_container(spark, path, "M", FAMILY).where("metadata is not null").count() == 0


def with_overflow(path):
    """Append an overflow of two fingerprints by hand, as the layout describes it."""
    data = open(path, "rb").read()[: -c.FOOTER.size]
    encode = codec.compress_packed if data[12] & 1 else codec.compress
    blobs = [encode([1, 2, 3]), encode([9])]
    table = b"".join(struct.pack("<IIHHIHH", i, at, 0, len(b), 10 * i, n, 0) for i, at, b, n in ((3, 0, blobs[0], 3), (70, len(blobs[0]), blobs[1], 1)))
    head = c.OVERFLOW.pack(c.magic(FAMILY, "D", "O"), 2, c.OVERFLOW.size + len(table))
    open(path, "wb").write(data + head + table + b"".join(blobs) + c.FOOTER.pack(len(data), c.magic(FAMILY, "D", "F")))


def test_overflow(spark, tmp_path):
    path = str(tmp_path / "a")
    c.write_container(lcg_range(spark, 1, 5, 10), path, "D", FAMILY)
    with_overflow(path)
    got = c.read_container(spark, path, "D", FAMILY)
    assert rows_of(got.where("from_overflow"), "fp_id", "duration_ms", "values") == [(3, 30, [1, 2, 3]), (70, 700, [9])]
    assert got.count() == 7


def test_dataset_out_and_in(spark, tmp_path):
    fps = lcg_range(spark, 1, 12, 64)
    meta = spark.createDataFrame([(3, str(uuid.UUID(int=9)), 4, ("T", "", "", ""))], "fp_id long, mbid string, track_id long, metadata struct<title:string,artist:string,release:string,year:string>")
    ds = Dataset.create(spark, str(tmp_path / "ds"), fingerprints=fps, mappings=meta, band_tuning=BandTuning(2, 16), posting_tuning=PostingTuning(8, 4, 5))
    files = {k: str(tmp_path / k) for k in "DXIM"}
    c.export_dataset(ds, files, FAMILY, packed=True)
    with_overflow(files["D"])
    again = c.import_dataset(spark, files, FAMILY, str(tmp_path / "again"))
    assert again.manifest["dataset_id"] == ds.manifest["dataset_id"] and (again.band_tuning, again.posting_tuning) == (ds.band_tuning, ds.posting_tuning)
    q = fps.where("fp_id = 5").selectExpr("1L as qid", "values")
    assert [tuple(r) for r in again.query_full(q).collect()] == [tuple(r) for r in ds.query_full(q).collect()]
    assert again.lookup_metadata(3).metadata.title == "T" and again.lookup(3)["values"] == [1, 2, 3] and again.fingerprints().count() == 13
    # an overflow is folded into what is exported, as compaction would
    c.export_dataset(again, {k: str(tmp_path / f"all-{k}") for k in "DI"}, FAMILY)
    assert again._overflow("fingerprints") is not None
    out = c.import_dataset(spark, {k: str(tmp_path / f"all-{k}") for k in "DI"}, FAMILY, str(tmp_path / "third"))
    again.compact()
    for name in ("fingerprints", "sampled_postings"):
        assert rows_of(out._main(name)) == rows_of(again._main(name))
    c.write_container(fps, files["I"], "I", FAMILY)
    with pytest.raises(errors.DatasetMismatch):
        c.import_dataset(spark, files, FAMILY, str(tmp_path / "other"))


def test_broken_files(spark, tmp_path):
    path = str(tmp_path / "a")
    c.write_container(lcg_range(spark, 1, 5, 10), path, "D", FAMILY)
    good = bytearray(open(path, "rb").read())

    def broken(at, value, error, kind="D", family=FAMILY):
        data = bytearray(good)
        data[at : at + len(value)] = value
        open(path, "wb").write(data)
        with pytest.raises(error):
            c.read_header(path, kind, family)

    broken(0, b"XXXX", errors.BadMagic)
    broken(8, b"\x01", errors.UnsupportedVersion)
    broken(12, b"\x04", errors.UnknownFlags)
    broken(0x58, struct.pack("<Q", 10**9), errors.OffsetOutOfBounds)
    broken(len(good) - 8, b"YYYY", errors.BadMagic)
    broken(len(good) - 16, struct.pack("<Q", 96), errors.CorruptOverflow)
    broken(len(good) - 16, struct.pack("<Q", 10**9), errors.CorruptOverflow)
    open(path, "wb").write(good[:50])
    with pytest.raises(errors.BadMagic):
        c.read_header(path, "D", FAMILY)
    with pytest.raises(errors.OffsetOutOfBounds):
        c.write_container(spark.createDataFrame([(None, 1, [1])], "fp_id long, duration_ms long, values array<bigint>"), path, "D", FAMILY)


def test_layout_sizes():
    assert (c.HEADER.size, c.FOOTER.size, c.OVERFLOW.size, c.BAND_TUNING.size, c.POSTING_TUNING.size) == (96, 16, 16, 64, 64)
    assert [np.dtype(d).itemsize for d in (c.RECORD, c.MAPPING, c.BUCKET, c.SKIP)] == [20, 32, 12, 12]
