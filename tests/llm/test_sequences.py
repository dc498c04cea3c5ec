"""Runs, frequent values, shared spans and near copies against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wavemill.llm import neardup, runs, spans, topk

QUIET = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SMALL = st.one_of(st.none(), st.lists(st.sampled_from([0, 1, 3, 7, 15, 2**32 - 1, 2**31]), max_size=20))


def as_runs(rows, max_bits, min_len):
    out = set()
    for key, values, ms in rows:
        values = values or []
        i = 0
        while i < len(values):
            j = i + 1
            while j < len(values) and None not in (values[j], values[j - 1]) and bin(values[j] ^ values[j - 1]).count("1") <= max_bits:
                j += 1
            if j - i >= min_len:
                out.add((key, i, j - i, values[i], None if ms is None else ms * (j - i) / len(values)))
            i = j
    return sorted(out, key=str)


SCHEMA = "id long, values array<bigint>, duration_ms long, value string, run_len int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


@QUIET
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), SMALL, st.one_of(st.none(), st.integers(0, 1000))), max_size=8), st.integers(1, 4))
def test_runs(spark, rows, min_len):
    got = runs.collapse_runs(frame(spark, rows), "id", min_len=min_len)
    assert [tuple(r) for r in rows_of(got)] == as_runs(rows, 2, min_len)


def test_runs_with_null_elements_and_long_records(spark, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 50)
    r = random.Random(1)
    long = [r.choice([0, 1, 2**20, 5]) for _ in range(3000)]
    rows = [(1, [5, 5, None, 5, 5, 5, None, None], 80), (2, long, 999), (2, long, 999), (3, [7] * 1000, None), (4, [], 5)]
    for min_len in (1, 2, 3):
        assert rows_of(runs.collapse_runs(frame(spark, rows), "id", min_len=min_len)) == as_runs(rows, 2, min_len)
    assert runs.collapse_runs(frame(spark, rows).where("false"), "id").count() == 0


def test_symbols_stand_for_events(monkeypatch):
    v = np.array([9, 9, 1000, 9, 8, 1000, 0, 3, 15, 0, 0, 0], np.int64)
    text = runs.symbols(v, np.array([0, 11]), 2)
    assert text[0] == text[1] == text[3] == text[4] and text[2] == text[5]  # equal events, equal symbols
    assert text[6] == text[7] == text[8] != text[9] == text[10] != text[11]  # 15 to 0 is a jump; a new record
    assert runs.spans(text, 2).tolist() == [[0, 2], [3, 5], [6, 9], [9, 11]]
    many = np.arange(100_000, dtype=np.int64) * 0x10101
    for events in (1 << 19, 7):
        monkeypatch.setattr(runs, "EVENTS", events)
        text = runs.symbols(many, np.array([0]), 0)
        assert len(text) == 100_000 and not len(runs.spans(text, 2))


@pytest.mark.parametrize("k", [1, 3, 50])
def test_frequent_values(spark, k):
    r = random.Random(2)
    values = [int(r.paretovariate(0.7)) for _ in range(4000)] + [None] * 100 + [-5] * 30
    df = spark.createDataFrame([(v, "x", 1) for v in values], "v long, value string, count int")
    counts = Counter(v for v in values if v is not None)
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:k]
    assert rows_of(topk.frequent_values(df, "v", k=k)) == sorted(want, key=str)
    limit = 0.01 * len(values)
    assert rows_of(topk.frequent_values(df, "v", share=0.01)) == sorted([(v, n) for v, n in counts.items() if n >= limit], key=str)


@pytest.mark.parametrize("sent", [topk.SENT_PREFIXES, 50])
def test_flat_column(spark, monkeypatch, sent):
    """Where every value is as frequent as any other, the driver still gets no more than what k asks for."""
    monkeypatch.setattr(topk, "SENT_PREFIXES", sent)
    df = spark.range(60_000).selectExpr("id % 20000 as v")
    got, real = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: got.append(real(self)) or got[-1])
    frequent = topk.frequent_values(df, "v", k=100)
    assert max(map(len, got), default=0) <= topk.BEAM * 100
    assert [tuple(r) for r in real(frequent.orderBy("value"))] == [(v, 3) for v in range(100)]
    once = topk.frequent_values(spark.range(500).selectExpr("id as v"), "v", k=3)
    assert [tuple(r) for r in real(once.orderBy("value"))] == [(0, 1), (1, 1), (2, 1)]


def test_frequent_values_edges(spark):
    df = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "v string")
    assert rows_of(topk.frequent_values(df, "v", k=10)) == [("", 1), ("a", 2)]
    assert rows_of(topk.frequent_values(df, "v", share=0.5)) == [("a", 2)]
    for empty in (df.where("false"), df.where("v is null")):
        assert topk.frequent_values(empty, "v", k=3).count() == 0 and topk.frequent_values(empty, "v", share=0.1).count() == 0
    with pytest.raises(ValueError):
        topk.frequent_values(df, "v")


def covered(rows, width):
    where = defaultdict(set)
    for key, values in rows:
        if key is not None:
            for i in range(len(values or []) - width + 1):
                where[tuple(values[i : i + width])].add(key)
    out = defaultdict(set)
    for key, values in rows:
        if key is not None:
            for i in range(len(values or []) - width + 1):
                if len(where[tuple(values[i : i + width])]) > 1:
                    out[key] |= set(range(i, i + width))
    return sorted(((k, len(v)) for k, v in out.items()), key=str)


@QUIET
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.lists(st.integers(0, 2), max_size=14))), max_size=7, unique_by=lambda r: r[0]), st.integers(1, 3))
def test_shared_counts(spark, rows, parts):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + rows[:1]], "id long, values array<bigint>, h string, flag int").repartition(parts)
    assert rows_of(spans.shared_counts(df, "id", "values", width=4)) == covered(rows, 4)


@pytest.mark.parametrize("remembered", [spans.REMEMBERED, 3])
def test_hot_windows_and_ids_are_sent_once_a_task(monkeypatch, remembered):
    """Over many batches of one task, a window that all records hold and a record that comes again cost a row each."""
    import pyarrow as pa

    monkeypatch.setattr(spans, "REMEMBERED", remembered)
    schema = pa.schema([(c, pa.int64()) for c in ("h", "g", "id", "at")])
    r = random.Random(8)
    common = [r.randrange(2**32) for _ in range(6)]
    records = [(i % 7, common + [i % 7] * 2) for i in range(60)] + [(99, [5, 6, 7, 8, 9])] * 60
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in records[n : n + 5]]), pa.array([v for _, v in records[n : n + 5]])], names=["id", "values"]) for n in range(0, len(records), 5)]
    rows = [x for b in spans._windows(4, schema)(iter(batches)) for x in b.to_pylist()]
    told, settled = [x for x in rows if x["at"] == -1], [x for x in rows if x["at"] >> 32 > 0]
    assert len({(x["h"], x["g"]) for x in told}) == 3 and {x["id"] for x in settled} <= set(range(7))
    if remembered > 3:
        assert len(told) == 3 and sum(x["id"] == 99 for x in rows) == 2 and sorted(x["id"] for x in settled) == list(range(7))


def test_shared_spans_of_hot_windows(spark):
    r = random.Random(3)
    common = [r.randrange(2**32) for _ in range(40)]
    rows = [(i, [r.randrange(2**32) for _ in range(r.randrange(50))] + (common if i % 3 == 0 else []) + [7] * (i % 5) * 10) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, values array<bigint>").repartition(6)
    assert rows_of(spans.shared_counts(df, "id", "values")) == covered(rows, 32)
    got = spans.shared_spans(df, "id", "values").collect()
    by = defaultdict(list)
    for s in got:
        by[s.id].append((s.start_pos, s.end_pos))
    assert all(a[1] < b[0] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:]))
    assert spans.shared_counts(df.where("false"), "id", "values").count() == 0


def linked(rows, similarity=0.5, tolerance=0.1):
    rows = list({(k, s): (k, s, set(v)) for k, s, v in rows if k is not None and s is not None and v}.values())
    out = set()
    for i, (a, sa, va) in enumerate(rows):
        for b, sb, vb in rows[i + 1 :]:
            if a != b and len(va & vb) >= similarity * len(va | vb) and abs(sa - sb) <= tolerance * max(sa, sb):
                out.add((min(a, b), max(a, b)))
    return sorted(out, key=str)


def grouped(rows):
    parent = {k: k for k, s, v in rows if k is not None and s is not None and v}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked(rows):
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return sorted(((k, find(k)) for k in parent), key=str)


def near_copies(seed, n, copies):
    r = random.Random(seed)
    rows, base = [], [[r.randrange(2**32) for _ in range(r.randrange(30, 90))] for _ in range(n)]
    for i in range(n * copies):
        v = list(base[i % n])
        for _ in range(int(len(v) * r.choice([0, 0, 0.05, 0.2]))):
            v[r.randrange(len(v))] = r.randrange(2**32)
        rows.append((i, 10_000 + r.choice([0, 100, 800, 1500, 4000]), v))
    rows += [(900, None, base[0]), (901, 10_000, None), (902, 10_000, []), (None, 10_000, base[0]), (903, 0, [5]), (904, 0, [5]), rows[3]]
    return rows


def test_an_id_with_several_sets(spark):
    """Links of every set of an id count; values with nulls and repeats are sets."""
    a, b = list(range(20)), list(range(100, 120))
    rows = [(1, 1000, a), (1, 1000, b), (2, 1000, a[:-1] + [77]), (3, 1000, [*b[:-1], 78, 78]), (4, 1000, [None, 1, 2]), (5, 1000, [2, 1, None, None]), (6, 1000, [1, 2]), (7, 1000, [1, 2, -1])]
    near = neardup.NearDuplicates(spark.createDataFrame(rows, "fp_id long, duration_ms long, values array<bigint>"))
    assert rows_of(near.pairs()) == [(1, 2), (1, 3), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)]
    assert rows_of(near.groups()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 4)]


@pytest.mark.parametrize("members", [4096, 2])
@pytest.mark.parametrize("bucket", [256, 3])
def test_near_duplicates(spark, monkeypatch, bucket, members):
    monkeypatch.setattr(neardup, "BUCKET", bucket)
    monkeypatch.setattr(neardup, "MEMBERS", members)
    rows = near_copies(4, 12, 8)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "fp_id long, duration_ms long, values array<bigint>, n int, key string").repartition(3)
    near = neardup.NearDuplicates(df)
    want = linked(rows)
    assert len(want) > 50 and rows_of(near.pairs()) == want
    assert rows_of(near.groups()) == grouped(rows)


def test_many_equal_copies(spark):
    rows = [(i, 1000 + 60 * (i % 7), [1, 2, 3, 4]) for i in range(60)] + [(i, 1000, [i, i + 1]) for i in range(100, 130, 3)]
    df = spark.createDataFrame(rows, "fp_id long, duration_ms long, values array<bigint>")
    near = neardup.NearDuplicates(df)
    assert near.classes.count() == 11 and near.candidates().count() == 0
    assert rows_of(near.pairs()) == linked(rows) and rows_of(near.groups()) == grouped(rows)
    empty = neardup.NearDuplicates(df.where("false"))
    assert empty.pairs().count() == 0 and empty.groups().count() == 0


def test_ten_thousand_equal_sets(spark):
    """Equal sets of unlike sizes: as many links as there are, and not the square of the class."""
    df = spark.range(10_000).selectExpr("id as fp_id", "cast(1000 * pow(1.12, id % 100) + id div 100 % 2 as bigint) as duration_ms", "array(1L, 2L, 3L) as values")
    near = neardup.NearDuplicates(df)
    assert near.classes.count() == 1 and near.sketched.where("sketch is not null").count() <= 8
    assert near.pairs().count() == 100 * (100 * 99 // 2)
    assert near.groups().select("group_id").distinct().count() == 100


def test_joint_estimate():
    r = np.random.default_rng(5)
    for similarity in (0.1, 0.5, 0.9):
        common = int(400 * similarity)
        a, b = [], []
        for _ in range(40):
            x = r.integers(0, 2**32, 800 - common)
            a.append(x[:400]), b.append(x[400 - common :])
        sketch = lambda sets: neardup.registers(np.concatenate(sets), np.arange(len(sets)) * 400)
        n = np.full(40, 400.0)
        got = neardup.joint_estimate(sketch(a), sketch(b), n, n)
        assert abs(got.mean() - common / (800 - common)) < 0.04


def test_sketches_merge():
    x, y = np.arange(50) * 977, np.arange(30, 90) * 977
    one = lambda v: neardup.registers(np.unique(v), np.array([0]))[0]
    assert (np.maximum(one(x), one(y)) == one(np.r_[x, y])).all()


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, 500)]
    label = {}
    for a, b in edges:
        if a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = neardup.components(spark.createDataFrame(edges, "u long, v long"))
    assert rows_of(got) == sorted(label.items(), key=str)
