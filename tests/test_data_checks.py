"""Per-key counts and failed references on small cases against plain Python."""

from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from conftest import DATA, rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill.operators import heavy_keys, orphans
from wavemill.plans import data_checks


def counted(rows):
    n, other = defaultdict(int), defaultdict(set)
    for k, o in rows:
        if k is not None:
            n[k] += 1
            other[k].add(o)
    return sorted((k, n[k], len(other[k] - {None})) for k in n)


@pytest.mark.parametrize("flush", [1 << 19, 4])
def test_counts_with_hot_and_null_keys(spark, monkeypatch, flush):
    monkeypatch.setattr(heavy_keys, "FLUSH_KEYS", flush)
    rows = [(7, i % 50) for i in range(3000)] + [(i, None) for i in range(100)] + [(None, 5)] * 40 + [(2**32 - 1, 1), (-3, 1), (-3, 1)]
    df = spark.createDataFrame([(k, o, "x", 1) for k, o in rows], "k long, o long, n string, block int").repartition(5)
    assert rows_of(heavy_keys.key_counts(df, "k", "o")) == sorted(counted(rows), key=str)
    plain = rows_of(heavy_keys.key_counts(df, "k"))
    assert [(k, n) for k, n, _ in plain] == [(k, n) for k, n, _ in sorted(counted(rows), key=str)] and {d for *_, d in plain} == {0}


def test_counts_of_text_keys_and_empty(spark):
    rows = [("a", 1), ("a", 2), ("", 1), (None, 1), ("ä" * 1000, 3)]
    df = spark.createDataFrame(rows, "k string, o long")
    assert rows_of(heavy_keys.key_counts(df, "k", "o")) == sorted(counted(rows), key=str)
    assert heavy_keys.key_counts(df.where("false"), "k", "o").count() == 0
    assert heavy_keys.heavy_keys(df.where("false"), "k", 0.1).count() == 0
    assert heavy_keys.key_counts(df.where("k is null"), "k", "o").count() == 0


def test_share_counts_null_rows(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(2,)] * 2 + [(None,)] * 5, "k long")
    assert rows_of(heavy_keys.heavy_keys(df, "k", 0.3)) == [(1, 3)]
    assert rows_of(heavy_keys.heavy_keys(df, "k", 0.2)) == [(1, 3), (2, 2)]


def orphaned(refs, targets, match):
    out = []
    for r in refs:
        nulls = sum(x is None for x in r[:2])
        if nulls == 2 or (nulls and match == "simple"):
            continue
        if nulls and match == "full" or not any(all(a is None or a == b for a, b in zip(r[:2], t)) for t in targets):
            out.append(r)
    return sorted(out, key=str)


@pytest.mark.parametrize("match", orphans.MATCHES)
def test_spans(spark, match):
    """A key column that must lie in a span, by null mask."""
    refs = [(1, 5), (1, 9), (1, None), (2, 5), (3, 1), (None, 5), (4, 4), (4, None), (None, None), (5, 7)]
    targets = [(1, 3, 6), (1, 3, 6), (2, 6, None), (3, None, 2), (4, 4, 4), (5, None, None), (None, 0, 99)]
    r, t = spark.createDataFrame(refs, "k long, at long"), spark.createDataFrame(targets, "k long, a long, b long")
    got = orphans.orphan_references(r, ["k", "at"], t, match, {"at": ("a", "b")})
    want = [(1, 9), (2, 5), (4, 4)] + ([(1, None), (4, None), (None, 5)] if match == "full" else [])
    assert rows_of(got) == sorted(want, key=str)
    with pytest.raises(ValueError):
        orphans.orphan_references(r, ["at"], t, match, {"at": ("a", "b")})


def test_p3_uses_the_anti_join_by_mask(spark, monkeypatch):
    seen = []
    real = orphans.orphan_references
    monkeypatch.setattr(orphans, "orphan_references", lambda *a: seen.append(a[1]) or real(*a))
    data_checks.p3_found(spark, str(DATA))
    assert seen == [["fp_id", "added_at"]]


@pytest.mark.parametrize("match", orphans.MATCHES)
def test_composite_keys(spark, match):
    refs = [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (None, 2, "c"), (None, 9, "d"), (2, None, "e"), (9, None, "f"), (None, None, "g"), (3, 3, None)]
    targets = [(1, 1), (2, 2), (1, 1), (None, 9), (3, None)]
    r = spark.createDataFrame(refs, "x long, y long, tag string")
    t = spark.createDataFrame(targets, "x long, y long")
    assert rows_of(orphans.orphan_references(r, ["x", "y"], t, match)) == orphaned(refs, targets, match)
    empty = orphans.orphan_references(r, ["x", "y"], t.where("false"), match)
    assert rows_of(empty) == orphaned(refs, [], match)
    with pytest.raises(ValueError):
        orphans.orphan_references(r, ["x"], t, "some")


T0 = datetime(2024, 1, 31, 23, 0)
TIMES = st.one_of(st.none(), st.integers(0, 12).map(lambda h: T0 + timedelta(hours=7 * h)))
IDS = st.one_of(st.none(), st.integers(1, 4))


def failing(refs, adds, dels, exempt):
    out = set()
    for key, at in refs:
        if key is None or at is None or key in exempt:
            if key is not None and at is None and key not in exempt and key not in {k for k, _ in adds}:
                out.add((key, at, "missing"))
            continue
        mine = [t for k, t in adds if k == key and t is not None]
        events = [(t, 1) for t in mine if t <= at] + [(t, 0) for k, t in dels if k == key and t is not None and t <= at]
        if events and max(events)[1]:
            continue
        out.add((key, at, "missing" if not mine else "late" if min(mine) > at else "deleted"))
    return sorted(out, key=str)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(IDS, TIMES), max_size=12), st.lists(st.tuples(IDS, TIMES.filter(bool)), max_size=8), st.lists(st.tuples(IDS, TIMES), max_size=8), st.sets(st.integers(1, 4), max_size=1))
def test_failed_references(spark, refs, adds, dels, exempt):
    frame = lambda rows: spark.createDataFrame(rows, "k long, at timestamp")
    got = orphans.failed_references(frame(refs), frame(adds), frame(dels), spark.createDataFrame([(x,) for x in exempt], "k long"), "k", "at")
    assert rows_of(got.select("k", "at", "kind")) == failing(refs, adds, dels, exempt)


def test_clashing_columns(spark):
    refs = spark.createDataFrame([(1, T0, "x", 5, "y"), (2, T0, "x", 6, "z")], "k long, at timestamp, kind string, _n int, value string")
    adds = spark.createDataFrame([(1, T0, 1), (2, T0 + timedelta(hours=1), 2)], "k long, at timestamp, kind int")
    got = orphans.failed_references(refs, adds, adds.where("k = 1").select("k", F.expr("at - interval 1 hour").alias("at")), adds.where("false"), "k", "at")
    assert rows_of(got) == [(2, T0, 6, "z", "late")]


def test_full_match_refuses_partly_null(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k long, at timestamp")
    refs, adds = frame([(1, None), (None, T0), (None, None), (1, T0)]), frame([(1, T0)])
    got = orphans.failed_references(refs, adds, frame([]), None, "k", "at", "full")
    assert rows_of(got.select("k", "at", "kind")) == [(1, None, "incomplete"), (None, T0, "incomplete")]
    assert orphans.failed_references(refs, adds, frame([]), None, "k", "at", "simple").count() == 0
