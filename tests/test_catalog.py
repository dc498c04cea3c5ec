"""Every core query against its SQL on the smallest tables."""

import pytest
from conftest import DATA, same_as_sql

from wavemill.plans import catalog


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(catalog.QUERIES[name](spark, str(DATA)), duck, catalog.SQL[name])


#: The queries that append the whole overflow table to a dataset.
APPENDED = ["container_dataset", "stored_accumulated", "stored_appended", "stored_appended_bands", "stored_appended_query", "stored_compacted", "stored_compacted_bands", "stored_compacted_mappings", "stored_compacted_postings", "stored_lookups", "stored_stats", "stored_truncated"]


@pytest.fixture(scope="module")
def emptied(spark, tmp_path_factory):
    """The smallest tables with overflow records without values, of an id that is stored and is deleted, and of a new one."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("emptied"), duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for file in DATA.glob("*.parquet"):
        if file.stem != "fingerprints_overflow":
            (folder / file.name).symlink_to(file)
    more = f"""SELECT fp_id, 1::BIGINT, []::BIGINT[], TIMESTAMP '2024-01-01' FROM (SELECT min(fp_id) AS fp_id FROM '{DATA}/deleted_fps.parquet' SEMI JOIN '{DATA}/fingerprints.parquet' USING (fp_id)
        ANTI JOIN '{DATA}/fingerprints_overflow.parquet' USING (fp_id)) UNION ALL SELECT 987654321, 1, [], TIMESTAMP '2024-01-01' UNION ALL SELECT 987654322, 1, NULL, NULL"""
    con.sql(f"COPY (SELECT fp_id, duration_ms, \"values\", added_at FROM '{DATA}/fingerprints_overflow.parquet' UNION ALL {more}) TO '{folder}/fingerprints_overflow.parquet'")
    for file in folder.glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return folder, con


@pytest.mark.parametrize("name", APPENDED)
def test_emptied_records_are_appended(spark, emptied, name):
    folder, con = emptied
    same_as_sql(catalog.QUERIES[name](spark, str(folder)), con, catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["qid", "fp_id", "hits", "delta", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
