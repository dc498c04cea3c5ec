"""The queries that SQL can express, on the smallest tables, and the shapes of the others."""

import pytest
from conftest import DATA, same_as_sql

from wavemill.llm import catalog

SHAPES = {
    "p1_found": "fp_id bigint, start_pos bigint, run_len bigint",
    "p4_found": "hash bigint",
    "p5_found": "fp_id_a bigint, fp_id_b bigint",
    "p6_found": "fp_id bigint, n_shared bigint",
    "p7_ids": "doc_id bigint, ids array<int>",
    "p9_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same_as_sql(catalog.QUERIES[name](spark, str(DATA)), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_columns(spark, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == SHAPES[name]


def test_every_document_is_encoded(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert catalog.QUERIES["p7_ids"](spark, str(DATA)).count() == docs.count()


def test_mixture_keeps_the_budget(spark):
    rows = catalog.QUERIES["p8_mixture"](spark, str(DATA)).collect()
    assert rows and max(r.position for r in rows) == sum(r.n_tokens for r in rows)
    assert {r.source for r in catalog.QUERIES["p8_shares"](spark, str(DATA)).collect()} == {r.source for r in spark.read.parquet(f"{DATA}/mix_targets.parquet").collect()}


def test_groups_hold_all_pairs(spark):
    group = {r.fp_id: r.group_id for r in catalog.QUERIES["p5_groups"](spark, str(DATA)).collect()}
    assert all(group[r.fp_id_a] == group[r.fp_id_b] for r in catalog.QUERIES["p5_found"](spark, str(DATA)).collect())
