from wavemill.sources import tables


def test_partitions_follow_the_input(spark, tmp_path, monkeypatch):
    spark.range(200_000).write.parquet(str(tmp_path / "t.parquet"))
    df = tables.table(spark, str(tmp_path), "t")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tables.partitions_for(df, 1.0) == least
    monkeypatch.setattr(tables, "PARTITION_BYTES", 10_000)
    assert tables.partitions_for(df.where("id > 5"), 1.0) > 20 > least
    assert tables.partitions_for(spark.createDataFrame([(1,)], "a int"), 1.0) == least


def test_scratch_is_the_shared_folder(spark):
    assert tables.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    df = tables.materialise(spark.range(5).toDF("x"), "test")
    assert df.count() == 5 and tables.scratch_root(spark) in df.inputFiles()[0]


def test_filters_keep_what_is_wanted(spark, monkeypatch):
    rows, wanted = spark.range(-500, 20_000).selectExpr("id as k", "id % 3 as x"), spark.range(-500, 20_000, 7).toDF("k")
    for bits in (1 << 25, 1 << 16):
        monkeypatch.setattr(tables, "FILTER_BITS", bits)
        kept = tables.thinned(rows, wanted, "k")
        assert kept.columns == ["k", "x"] and wanted.join(kept, "k", "left_anti").count() == 0
        assert kept.count() <= wanted.count() + 20_500 * 3000 / bits + 20
    assert tables.thinned(rows, wanted.where("false"), "k").count() == 0
    texts = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    got = {r.k: r.m for r in tables.marked(texts, texts.where("k is null or k = 'b'"), "k", "m").collect()}
    assert got == {"a": False, None: True, "b": True}


def test_scratch_needs_a_shared_folder_on_a_cluster(monkeypatch):
    import pytest

    from wavemill.errors import NoSharedFolder

    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(NoSharedFolder):
        tables.scratch_root(Session())


def test_scratch_is_deleted(spark):
    import os
    from urllib.parse import urlparse

    df = tables.materialise(spark.range(3).toDF("x"), "test")
    path = urlparse(df.scratch_path).path
    assert os.path.isdir(path) and spark.sparkContext.applicationId in path
    tables.discard(df)
    assert not os.path.exists(path)
