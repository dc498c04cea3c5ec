"""Near copies among sets of values: SetSketch registers in bands, a joint likelihood estimate, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavemill.llm.spans import mixed
from wavemill.sources.tables import discard, materialise, partitions_for, thinned

#: Registers of a sketch, registers of a band, the base by which the register values are spaced, and the last value, at
#: which they are truncated (minima down to e ** -64). Two sets of similarity 0.5 agree in none of the 32 bands once in
#: 10,000 times, unrelated ones in any once in 10 ** 8 times.
REGISTERS, BAND = 64, 2
SPACING, LAST = 1 + 2.0**-14, 1 << 20
#: Values sketched at a time.
CHUNK = 1 << 18
#: A bucket with more sets than this is split by further registers instead of being paired.
BUCKET = 256
#: How often a bucket is split at most; what is larger still is paired.
SPLITS = 3
#: Members of one class and size range that one task pairs with their partners.
MEMBERS = 4096
#: Classes that a task remembers, so as to sketch each once.
REMEMBERED = 1 << 18
#: How many standard deviations below the threshold an estimate may lie before a pair is given up unverified.
SLACK = 4.0
#: Fixed pseudo-random numbers of the registers' hash functions.
_A = mixed(np.arange(1, REGISTERS + 1) * 2) | np.uint64(1)
_C = mixed(np.arange(1, REGISTERS + 1) * 2 + 1)


def registers(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """SetSketch of each set of distinct ``values``: per register the truncated logarithm of the least exponential
    variable of its members. It only depends on the least hash, so that is taken first."""
    x = mixed(values)
    out = np.empty((len(starts), REGISTERS), np.int32)
    for i in range(REGISTERS):
        least = np.minimum.reduceat((x * _A[i] + _C[i]) >> np.uint64(32), starts)
        h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
        out[:, i] = np.clip(np.floor(1 - np.log(h) / np.log(SPACING)), 0, LAST)
    return out


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, spacing: float = SPACING) -> np.ndarray:
    """Maximum likelihood similarity of pairs of sketches, from how many registers are greater, less and equal."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (spacing - 1) / spacing) / np.log(spacing)

    def likelihood(j):
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return up * np.log(more + tiny) + down * np.log(less + tiny) + same * np.log(np.maximum(1 - more - less, 0) + tiny)

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left = likelihood(low + third) > likelihood(high - third)
        low, high = np.where(left, low, low + third), np.where(left, high - third, high)
    return (low + high) / 2


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    flat = column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    return flat.fill_null(-1).to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _sketches(schema: pa.Schema):
    """Sketches of the sets; of equal sets that a task meets only the first gets one, the others a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for i, c in enumerate(zip(batch.column("c1").to_pylist(), batch.column("c2").to_pylist())):
                if c not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(c)
                    new[i] = True
            flat, offsets = _lists(batch.filter(pa.array(new)), "set")
            parts, row = [], 0
            while row < len(offsets) - 1:
                last = min(len(offsets) - 1, max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1))
                parts.append(registers(flat[offsets[row] : offsets[last]], offsets[row:last] - offsets[row]).ravel())
                row = last
            ends = pa.array(np.r_[0, np.cumsum(new) * REGISTERS].astype(np.int32))
            sketch = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)), mask=pa.array(~new))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "size", "c1", "c2", "n")), sketch], schema=schema)

    return run


def _estimates(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (batch.column(f"sketch_{s}").flatten().to_numpy().reshape(-1, REGISTERS) for s in "ab")
            j = joint_estimate(a, b, *(batch.column(f"n_{s}").to_numpy().astype(float) for s in "ab"))
            near = pa.array(j >= least - SLACK * (least * (1 - least) / REGISTERS) ** 0.5)
            yield batch.select(PAIR).filter(near)

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            (va, oa), (vb, ob) = (_lists(batch, f"set_{s}") for s in "ab")
            n_a, n_b = np.diff(oa), np.diff(ob)
            both = np.r_[va, vb]
            owner = np.r_[np.repeat(np.arange(len(batch)), n_a), np.repeat(np.arange(len(batch)), n_b)]
            order = np.lexsort((both, owner))
            both, owner = both[order], owner[order]
            twice = (both[1:] == both[:-1]) & (owner[1:] == owner[:-1])
            common = np.bincount(owner[1:][twice], minlength=len(batch))
            yield batch.select(PAIR).filter(pa.array(common >= least * (n_a + n_b - common)))

    return run


#: A pair of classes, each named by the two hashes of its set.
PAIR = ["a1", "a2", "b1", "b2"]


class NearDuplicates:
    """Pairs and groups of records whose sets of distinct values have a similarity of at least ``similarity`` and
    whose sizes (durations) differ by at most ``tolerance`` of the larger.

    Records with equal sets form one class from the start, named by 128 bits of hash; only classes are sketched into
    buckets, compared and verified, so a set that a third of all records share is one entry. Buckets over ``BUCKET``
    classes are split by further registers until they are small (at most ``SPLITS`` times); no pair is dropped for the
    size of its bucket.

    An id counts once for each set and size it has. Null ids, null sizes, null and empty values take no part; null
    elements count as one common value. Other columns are ignored.
    """

    def __init__(self, df: DataFrame, id_col: str = "fp_id", values_col: str = "values", size_col: str = "duration_ms", *, similarity: float = 0.5, tolerance: float = 0.1):
        self.similarity, self.tolerance = similarity, tolerance
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(size_col).cast("bigint").alias("size"), F.col(values_col).cast("array<bigint>").alias("values"))
        self.rows = rows.where(F.col("id").isNotNull() & F.col("size").isNotNull() & (F.size("values") > 0))
        out = T.StructType([T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.ArrayType(T.IntegerType()))])
        arrow = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("n", pa.int32()), ("sketch", pa.list_(pa.int32()))])
        self.sketched = materialise(self._named(self.rows).mapInArrow(_sketches(arrow), out), "sketches")
        self.leads = self.sketched.where("sketch is not null")
        one = self.sketched.groupBy("c1", "c2").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        self.classes = materialise(one, "classes")
        self.members = self.sketched.select("id", "size", "c1", "c2").distinct()

    def _named(self, rows: DataFrame) -> DataFrame:
        """``(id, size, set, c1, c2, n)``: the distinct values, the two hashes that name their class, and their count."""
        rows = rows.select("id", "size", F.sort_array(F.array_distinct("values")).alias("set"))
        n = F.size("set")  # a null adds nothing to a hash, but it adds to the size
        return rows.withColumns({"c1": F.xxhash64(n, "set"), "c2": F.xxhash64(F.lit(1), "set", n), "n": n})

    def _close(self, a: Column, b: Column) -> Column:
        """Sizes a and b differ by at most the tolerance of the larger (in whole numbers, without rounding)."""
        return F.abs(a - b) <= F.lit(self.tolerance) * F.greatest(a, b)

    def _pairs_in_buckets(self, rows: DataFrame) -> DataFrame:
        a, b = (rows.select("key", F.col("c").alias(x)) for x in "ab")
        return a.join(b, "key").where(F.col("a") < F.col("b")).select("a", "b")

    def candidates(self) -> DataFrame:
        """Distinct pairs ``(a, b)`` of classes, by the first half of their names, that share a bucket, a < b."""
        # the number of its band stands in the lowest bits of a bucket's key
        key = lambda band, *parts: F.xxhash64(*parts).bitwiseAND(F.lit(-REGISTERS)).bitwiseOR(band)
        bands = [key(F.lit(k), F.lit(k), *(F.col("sketch")[i] for i in range(k, k + BAND))) for k in range(0, REGISTERS, BAND)]
        rows = self.leads.select(F.col("c1").alias("c"), F.explode(F.array(*bands)).alias("key"))
        out, depth, pool = None, 0, self.leads.select(F.col("c1").alias("c"), "sketch")
        while True:
            rows = rows.repartition(partitions_for(self.rows, 1.0), "key").dropDuplicates(["key", "c"]).withColumn("among", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("among > 1")
            rows = materialise(rows, "buckets")
            last = depth == SPLITS
            found = self._pairs_in_buckets(rows if last else rows.where(F.col("among") <= BUCKET))
            out = found if out is None else out.unionByName(found)
            full = rows.where(F.col("among") > BUCKET)
            if last or full.isEmpty():
                return out.distinct()
            depth += 1
            # each member goes on by 8 registers outside its band: a pair of similarity 0.5 meets again 255 times of 256
            band = F.col("key").bitwiseAND(F.lit(REGISTERS - 1))
            more = [key(band, "key", F.lit(t), F.get("sketch", ((band + F.lit(BAND + 8 * (depth - 1) + t)) % REGISTERS).cast("int"))) for t in range(8)]
            # only sketches of members of full buckets are needed from here on
            pool = materialise(pool.join(full.select("c").distinct(), "c", "left_semi").dropDuplicates(["c"]), "pool")
            rows = full.select("c", "key").join(pool, "c").select("c", F.explode(F.array(*more)).alias("key"))

    def class_pairs(self) -> DataFrame:
        """Pairs ``(a1, a2, b1, b2)`` of classes with a similarity of at least the threshold, verified on the sets."""
        pair = T.StructType([T.StructField(c, T.LongType()) for c in PAIR])
        # before any sketch is fetched, pairs go that can't be near by the counts of their values or by their sizes: no
        # members of two classes are near in size if the classes' ranges are too far apart
        a, b = (self.classes.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "least", "most"))) for x in "ab")
        found = self.candidates().withColumnsRenamed({"a": "a1", "b": "b1"}).join(a, "a1").join(b, "b1")
        apart = F.greatest(F.col("least_a") - F.col("most_b"), F.col("least_b") - F.col("most_a"), F.lit(0))
        found = found.where(apart <= F.lit(self.tolerance) * F.greatest("most_a", "most_b"))
        found = found.where(F.least("n_a", "n_b") >= F.lit(self.similarity) * F.greatest("n_a", "n_b"))
        found = materialise(found.select(*PAIR, "n_a", "n_b"), "candidates")
        ends = lambda df: df.select(F.explode(F.array(*(F.struct(F.col(f"{x}1").alias("c1"), F.col(f"{x}2").alias("c2")) for x in "ab"))).alias("c")).select("c.*").distinct()
        met = ends(found)
        light = thinned(self.leads.select("c1", "c2", "sketch"), met, "c1").join(met, ["c1", "c2"], "left_semi").dropDuplicates(["c1", "c2"])
        a, b = (light.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab")
        likely = found.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).mapInArrow(_estimates(self.similarity), pair)
        likely = materialise(likely, "likely")
        discard(found)
        wanted = ends(likely)
        ids = self.leads.select("id", "c1", "c2").join(wanted, ["c1", "c2"], "left_semi").select("id").distinct()
        sets = self._named(thinned(self.rows, ids, "id")).select("c1", "c2", "set").join(wanted, ["c1", "c2"], "left_semi")
        sets = materialise(sets.dropDuplicates(["c1", "c2"]), "sets")
        a, b = (sets.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("set").alias(f"set_{x}")) for x in "ab")
        return likely.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).mapInArrow(_verified(self.similarity), pair)

    def pairs(self) -> DataFrame:
        """All linked pairs ``(id_a, id_b)`` of ids, the smaller first, members of one class included.

        Members meet by class and range of sizes: ranges are so wide that sizes within the tolerance lie in the same
        or neighbouring ones, so what is compared is a small multiple of the result. A class with many members in a
        range is cut into parts, which meet two by two, so no task holds more than ``MEMBERS`` on a side.
        """
        unit = ["c1", "c2", "range", "part"]
        # sizes up to 0 are linked to equal ones only and have a range of their own
        at = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log1p(-self.tolerance))) if 0 < self.tolerance < 1 else F.lit(0)
        members = self.members.withColumn("range", F.when(F.col("size") > 0, at).otherwise(F.lit(-2)).cast("int"))
        many = members.groupBy("c1", "c2", "range").count().where(F.col("count") > MEMBERS)
        many = many.select("c1", "c2", "range", F.ceil(F.col("count") / MEMBERS).alias("parts"))
        members = members.join(many, ["c1", "c2", "range"], "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).drop("parts")
        members = materialise(members, "members")
        units = members.select(unit).distinct()
        own = self.classes.where("rows > 1").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("c1").alias("b1"), F.col("c2").alias("b2"))
        pairs = self.class_pairs().unionByName(own)
        ua, ub = (units.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("range").alias(f"r{x}"), F.col("part").alias(f"p{x}")) for x in "ab")
        met = pairs.join(ua, ["a1", "a2"]).withColumn("rb", F.explode(F.array(F.col("ra") - 1, "ra", F.col("ra") + 1))).join(ub, ["b1", "b2", "rb"])
        same = (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))
        met = met.where(~same | (F.struct("ra", "pa") <= F.struct("rb", "pb")))
        a, b = (members.select(F.col("c1").alias(f"{x}1"), F.col("c2").alias(f"{x}2"), F.col("range").alias(f"r{x}"), F.col("part").alias(f"p{x}"), F.col("id").alias(f"i{x}"), F.col("size").alias(f"s{x}")) for x in "ab")
        linked = met.join(a, ["a1", "a2", "ra", "pa"]).join(b, ["b1", "b2", "rb", "pb"])
        linked = linked.where(self._close(F.col("sa"), F.col("sb")) & (F.col("ia") != F.col("ib")))
        return linked.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """One row ``(id, group_id)`` for each id that takes part; linked ids share a group, named by its least id.

        A pair of classes is chained in order of size: all members between two linked ones are linked to their
        neighbours, so the chain connects the same ids as all pairs do.
        """
        sized = materialise(self.members.groupBy("c1", "c2", "size").agg(F.min("id").alias("node")), "nodes")
        pairs = self.class_pairs()
        alone = self.classes.where("least < most").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("c1").alias("b1"), F.col("c2").alias("b2"))
        both = [F.struct(F.col(f"{x}1").alias("c1"), F.col(f"{x}2").alias("c2")) for x in "ab"]
        ends = pairs.unionByName(alone).select(*PAIR, F.explode(F.array_distinct(F.array(*both))).alias("c")).select(*PAIR, "c.*")
        order = Window.partitionBy(*PAIR).orderBy("size", "node")
        chain = ends.join(sized, ["c1", "c2"]).withColumn("next", F.lead("node").over(order)).withColumn("next_size", F.lead("size").over(order))
        edges = chain.where(F.col("next").isNotNull() & self._close(F.col("size"), F.col("next_size"))).select(F.col("node").alias("u"), F.col("next").alias("v"))
        same = self.members.join(sized, ["c1", "c2", "size"]).where("id <> node").select(F.col("id").alias("u"), F.col("node").alias("v"))
        labels = components(edges.unionByName(same))
        return self.members.select("id").distinct().join(labels, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges ``(u, v)``: ``(id, group_id)`` with the least id of each component.

    Large and small stars take turns until nothing changes; each round is written to the shared folder and the one
    before deleted. Edges at a node only meet in a minimum, never as a list. Rounds compare by the count and two sums of
    hashes of their edges.
    """

    def mark(df: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftrightunsigned(h, 32))).first())

    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialise(small.where("u <> v").distinct(), "edges")
        discard(edges)
        if (now := mark(after)) == before:
            return after.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.col("v").alias("group_id")).unionByName(after.select(F.col("v").alias("id"), F.col("v").alias("group_id")).distinct())
        edges, before = after, now
