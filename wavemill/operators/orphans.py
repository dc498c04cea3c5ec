"""References to records that don't exist: anti-joins by null mask, and checks against a record's life over time."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.sources.tables import materialise

MATCHES = ("simple", "partial", "full")


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def orphan_references(refs: DataFrame, keys: list[str], targets: DataFrame, match: str = "simple", spans: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Rows of ``refs`` whose composite key ``keys`` has no partner in ``targets`` (same column names).

    References are split by null mask (which key columns are null); each mask is anti-joined with the distinct
    targets on its non-null columns only. The declared match semantics, as in SQL, say what null means:

    * ``simple``: a reference with any null is not checked, so never an orphan;
    * ``partial``: the non-null columns must occur together in some target; all null is no orphan;
    * ``full``: all null is no orphan, some but not all null is an orphan.

    A key column named in ``spans`` isn't compared for equality: it must lie in the target's half-open span, of which
    the two columns are given; a null start means since ever, a null end for good, and an empty span holds nothing.
    It is checked together with the other columns only, so a mask with nothing else is no orphan under ``partial``.

    Repeated references stay repeated; the result has exactly the columns of ``refs``. Targets with nulls match by
    their non-null columns under ``partial`` only. Empty targets make every checked reference an orphan.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    spans = spans or {}
    equal = [k for k in keys if k not in spans]
    if not equal:
        raise ValueError("a key of spans only can't be checked")
    out = None
    for mask in product((False, True), repeat=len(keys)):
        part = refs.where(_all([F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(keys, mask)]))
        there = [k for k, null in zip(keys, mask) if not null]
        if not there or (any(mask) and match == "simple"):
            continue
        if not any(mask) or match == "partial":
            same, inside = [k for k in there if k in equal], [k for k in there if k in spans]
            if not same:
                continue
            ends = [F.col(c).alias(f"_{i}_{e}") for i, k in enumerate(inside) for e, c in enumerate(spans[k])]
            known = targets.where(_all([F.col(k).isNotNull() for k in same])).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(same)], *ends).distinct()
            on = [part[k] == F.col(f"_k{i}") for i, k in enumerate(same)]
            for i, k in enumerate(inside):
                on.append((F.col(f"_{i}_0").isNull() | (F.col(f"_{i}_0") <= part[k])) & (F.col(f"_{i}_1").isNull() | (part[k] < F.col(f"_{i}_1"))))
            part = part.join(known, _all(on), "left_anti")
        out = part if out is None else out.unionByName(part)
    return out


def lives(additions: DataFrame, deletions: DataFrame, key: str, at: str) -> DataFrame:
    """The spans ``(key, _from, _to)`` in which each key is there: from an addition to the next deletion or for good.

    At equal times the addition comes last. Changes are cut into days: in each day a window finds the next change, and
    over an id's days another finds the first change of the next one, so no window holds more than one key's changes
    of a day or its days. An addition without a time gives an empty span: the key is known, but there at no time.
    """
    added = additions.select(key, at, F.lit(1).alias("_alive")).where(F.col(key).isNotNull())
    gone = deletions.select(key, at, F.lit(0).alias("_alive")).where(F.col(key).isNotNull() & F.col(at).isNotNull())
    changes = added.where(F.col(at).isNotNull()).unionByName(gone).groupBy(key, at).agg(F.max("_alive").alias("_alive")).withColumn("_day", F.to_date(at))
    days = changes.groupBy(key, "_day").agg(F.min(at).alias("_first")).withColumn("_after", F.lead("_first").over(Window.partitionBy(key).orderBy("_day"))).drop("_first")
    following = F.coalesce(F.lead(at).over(Window.partitionBy(key, "_day").orderBy(at)), F.col("_after"))
    spans = changes.join(days, [key, "_day"]).withColumn("_to", following).where("_alive = 1").select(key, F.col(at).alias("_from"), "_to")
    never = F.lit(0).cast("timestamp").cast(additions.schema[at].dataType)
    return spans.unionByName(added.where(F.col(at).isNull()).select(key, never.alias("_from"), never.alias("_to")).distinct())


def failed_references(refs: DataFrame, additions: DataFrame, deletions: DataFrame, exempt: DataFrame | None, key: str, at: str, match: str = "partial") -> DataFrame:
    """References (``key``, ``at`` and any other columns) that fail at their time, with ``kind``.

    The reference is the composite (key, time), and its targets are the spans in which a key is there (``lives``), those
    of ``exempt`` keys at all times: :func:`orphan_references` anti-joins the mask with both columns on the key with the
    time inside the span, and the mask without a time on the key alone under ``partial``; that one is an orphan under
    ``full`` and not checked under ``simple``. A null key is no reference, under ``full`` an orphan if it has a time.

    ``kind``: 'missing' if the key was never added at a time, 'late' if it was only added after the reference's,
    'deleted' otherwise, 'incomplete' for what ``full`` refuses. Equal references are reported once. A column ``kind``
    that ``refs`` has already is replaced.
    """
    # read by every mask, and far smaller than the tables it comes from
    refs = materialise(refs.drop("kind").distinct(), "references")
    there = lives(additions, deletions, key, at)
    if exempt is not None:
        ever = F.lit(None).cast(refs.schema[at].dataType)
        there = there.unionByName(exempt.select(key, ever.alias("_from"), ever.alias("_to")))
    failed = orphan_references(refs, [key, at], there, match, {at: ("_from", "_to")})
    partly = F.col(key).isNull() | F.col(at).isNull()
    first = additions.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(at).alias("_first"))
    kind = F.when(partly & F.lit(match == "full"), "incomplete").when(F.col("_first").isNull() | F.col(at).isNull(), "missing").when(F.col(at) < F.col("_first"), "late").otherwise("deleted")
    return failed.join(first, F.col(key) == F.col("_key"), "left").select(*refs.columns, kind.alias("kind"))
