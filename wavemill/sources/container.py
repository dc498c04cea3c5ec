"""Single-file binary containers of the four tables: a Spark data source to read them, and a writer.

A container begins with a header of 96 bytes (magic, version, flags, counts, dataset id, two sections) and ends with a
footer that may point to an overflow region. Kinds: 'D' fingerprints, 'X' band postings, 'I' sampled postings, 'M'
mappings. Magic numbers begin with four letters that name the family of files; they are a parameter, ``family``.

Reading is split by ranges of records, buckets or skip entries, each task reading its own range of the file, which all
executors must reach by the same path. Writing sorts by ranges and encodes each range in its own task into the shared
scratch folder; only offsets and sizes go through the driver, which joins the parts into one file.
"""

from __future__ import annotations

import os
import shutil
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wavemill.errors import BadMagic, CorruptOverflow, DatasetMismatch, InvalidCompression, InvalidTuning, OffsetOutOfBounds, TruncatedVarint, UnknownFlags, UnsupportedVersion
from wavemill.functions import codec
from wavemill.operators import bands, postings
from wavemill.schema import BAND_POSTINGS, FINGERPRINTS, MAPPINGS, SAMPLED_POSTINGS, U32
from wavemill.sources.store import VERSION, Dataset
from wavemill.sources.tables import scratch_folder
from wavemill.tuning import BandTuning, PostingTuning

# The binary layout. All numbers are little-endian and unsigned.
MAJOR, MINOR = 0, 1
HEADER = struct.Struct("<8sHHIQQQ16s8sQQQQ")
FOOTER = struct.Struct("<Q8s")
OVERFLOW = struct.Struct("<8sII")
RECORD = np.dtype([("id", "<u4"), ("low", "<u4"), ("high", "<u2"), ("length", "<u2"), ("ms", "<u4"), ("count", "<u2"), ("zero", "<u2")])
MAPPING = np.dtype([("id", "<u4"), ("mbid", "V16"), ("track", "<u4"), ("at", "<u4"), ("length", "<u4")])
BUCKET = np.dtype([("at", "<u8"), ("count", "<u4")])
SKIP = np.dtype([("hash", "<u4"), ("at", "<u8")])
BAND_TUNING = struct.Struct("<BBIIQIB41x")
POSTING_TUNING = struct.Struct("<BBIIQIB41x")
NO_TEXT = 0xFFFFFFFF
#: Flag bits: of 'D' and 'X' bit 0 is the packed encoding, of 'M' that texts are there; bit 1: there is an overflow.
PACKED, TEXTS, OVERFLOWN = 1, 1, 2
SCHEMAS = {"D": FINGERPRINTS, "X": BAND_POSTINGS, "I": SAMPLED_POSTINGS, "M": MAPPINGS}
#: Records, buckets or skip entries that one task reads.
PER_TASK = {"D": 20_000, "X": 64, "I": 1_000, "M": 100_000}


def magic(family: str, kind: str, part: str = "") -> bytes:
    """The eight bytes that mark a file ('' ), its footer ('F') or its overflow ('O')."""
    return f"{family}-{kind}{part}".encode().ljust(8, b"\0")


@dataclass
class Header:
    kind: str
    flags: int = 0
    records: int = 0
    created_at: int = 0
    source_date: int = 0
    dataset_id: bytes = b"\0" * 16
    sections: tuple[int, int, int, int] = (0, 0, 0, 0)
    tuning: BandTuning | PostingTuning | None = None
    overflow: tuple[int, int, int] | None = field(default=None)  # where its header ends, its two numbers
    size: int = 0

    @property
    def packed(self) -> bool:
        return bool(self.flags & PACKED)


def read_header(path: str, kind: str, family: str) -> Header:
    """Header, tuning and overflow of a file, all checked against its size."""
    size = os.path.getsize(path)
    if size < HEADER.size + FOOTER.size:
        raise BadMagic("the file is too small")
    with open(path, "rb") as f:
        m, major, minor, flags, records, created, source, dataset, _, *sections = HEADER.unpack(f.read(HEADER.size))
        if m != magic(family, kind):
            raise BadMagic(repr(m))
        if major != MAJOR:
            raise UnsupportedVersion(f"{major}.{minor}")
        if flags & ~(OVERFLOWN if kind == "I" else 3):
            raise UnknownFlags(hex(flags))
        if sections[0] + sections[1] > size or sections[2] + sections[3] > size:
            raise OffsetOutOfBounds("a section lies beyond the end")
        h = Header(kind, flags, records, created, source, dataset, tuple(sections), size=size)
        if kind == "X":
            n, bits, per, total, *_ = BAND_TUNING.unpack(f.read(BAND_TUNING.size))
            h.tuning = BandTuning(n, bits)
            if (per, total) != (h.tuning.buckets_per_band, h.tuning.total_buckets) or total * BUCKET.itemsize != sections[1]:
                raise InvalidTuning("the bucket numbers don't fit")
        elif kind == "I":
            stride, qbits, skip, _, _, n_skip, _ = POSTING_TUNING.unpack(f.read(POSTING_TUNING.size))
            h.tuning = PostingTuning(stride, qbits, skip)
            if n_skip * SKIP.itemsize != sections[1]:
                raise InvalidTuning("the skip directory doesn't fit")
        f.seek(size - FOOTER.size)
        at, m = FOOTER.unpack(f.read(FOOTER.size))
        if m != magic(family, kind, "F"):
            raise BadMagic(repr(m))
        if at:
            if at + OVERFLOW.size > size:
                raise CorruptOverflow("it lies beyond the end")
            f.seek(at)
            m, one, two = OVERFLOW.unpack(f.read(OVERFLOW.size))
            if m != magic(family, kind, "O"):
                raise CorruptOverflow(repr(m))
            h.overflow = (at + OVERFLOW.size, one, two)
    return h


def _part(path: str, at: int, length: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(at)
        data = f.read(length)
    if len(data) < length:
        raise OffsetOutOfBounds(f"{length} bytes at {at}")
    return data


@dataclass
class Task(InputPartition):
    """A range of a region: entries from ``first`` to ``last`` of the table at ``table``, payloads from ``blob`` on."""

    table: int
    blob: int
    end: int
    first: int
    last: int
    total: int
    from_overflow: bool


def _fingerprints(path: str, h: Header, t: Task) -> pa.RecordBatch:
    r = np.frombuffer(_part(path, t.table + RECORD.itemsize * t.first, RECORD.itemsize * (t.last - t.first)), RECORD)
    at = r["low"].astype(np.int64) | (r["high"].astype(np.int64) << 32)
    ends = at + r["length"]
    if len(r) and t.blob + int(ends.max()) > t.end:
        raise OffsetOutOfBounds("a record lies beyond its section")
    base = int(at.min()) if len(r) else 0
    data = _part(path, t.blob + base, int(ends.max()) - base) if len(r) else b""
    one = codec.decompress_packed if h.packed else codec.decompress
    values = [one(data[a - base : b - base], int(n)) for a, b, n in zip(at, ends, r["count"])]
    offsets = np.r_[0, np.cumsum([len(v) for v in values])].astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(r["id"].astype(np.int64)), pa.array(r["ms"].astype(np.int64)), lists], names=FINGERPRINTS.names)


def _mappings(path: str, h: Header, t: Task) -> pa.RecordBatch:
    r = np.frombuffer(_part(path, t.table + MAPPING.itemsize * t.first, MAPPING.itemsize * (t.last - t.first)), MAPPING)
    there = r["at"] != NO_TEXT
    low = int(r["at"][there].min()) if there.any() else 0
    high = int((r["at"][there].astype(np.int64) + r["length"][there]).max()) if there.any() else 0
    if t.blob + high > t.end:
        raise OffsetOutOfBounds("a text lies beyond its section")
    pool = _part(path, t.blob + low, high - low)
    names = {"t": "title", "a": "artist", "r": "release", "y": "year"}
    texts = []
    for has, at, n in zip(there, r["at"], r["length"]):
        fields = dict.fromkeys(names.values(), "")
        if has:
            for line in pool[int(at) - low : int(at) - low + int(n)].decode().split("\n"):
                if line[1:2] == "=" and line[0] in names:
                    fields[names[line[0]]] = line[2:]
        texts.append(fields if has else None)
    kind = pa.struct([(n, pa.string()) for n in names.values()])
    mbids = [str(uuid.UUID(bytes=bytes(x))) for x in r["mbid"]]
    return pa.RecordBatch.from_arrays([pa.array(r["id"].astype(np.int64)), pa.array(mbids, pa.string()), pa.array(r["track"].astype(np.int64)), pa.array(texts, kind)], names=MAPPINGS.names)


def _bucket_postings(data: bytes, count: int, packed: bool) -> tuple[np.ndarray, np.ndarray]:
    if packed:
        return codec.decompress_postings(data, count)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < 6:
        raise InvalidCompression("a posting list is broken")
    # a number of unknown length and two bytes by turns: only one after the other tells where each begins
    ids, pos, at, end = [int.from_bytes(data[:4], "little")], [int.from_bytes(data[4:6], "little")], 6, len(data)
    for _ in range(count - 1):
        delta, shift = 0, 0
        while at < end and data[at] > 127 and shift < 28:
            delta |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
        if at + 3 > end:
            raise InvalidCompression("a posting list is broken")
        if data[at] > 127:
            raise TruncatedVarint("more than 5 bytes")
        ids.append(ids[-1] + (delta | data[at] << shift) & U32)
        pos.append(data[at + 1] | data[at + 2] << 8)
        at += 3
    return np.array(ids), np.array(pos)


def _band_postings(path: str, h: Header, t: Task) -> pa.RecordBatch:
    r = np.frombuffer(_part(path, t.table + BUCKET.itemsize * t.first, BUCKET.itemsize * (min(t.last + 1, t.total) - t.first)), BUCKET)
    starts = r["at"].astype(np.int64)
    ends = np.r_[starts[1:], t.end - t.blob][: t.last - t.first] if len(r) == t.last - t.first else starts[1:]
    out = []
    for k in range(t.last - t.first):
        n = int(r["count"][k])
        if n:
            # empty buckets may hold no offset, so the next one in use bounds the list
            later = next((int(x["at"]) for x in r[k + 1 :] if x["count"]), None)
            end = later if later is not None else (int(ends[k]) if ends[k] > starts[k] else t.end - t.blob)
            ids, pos = _bucket_postings(_part(path, t.blob + int(starts[k]), end - int(starts[k])), n, h.packed and not t.from_overflow)
            out.append((np.full(n, t.first + k), ids, pos))
    bucket, ids, pos = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
    per = h.tuning.buckets_per_band
    columns = [pa.array(bucket.astype(np.int32)), pa.array((bucket // per).astype(np.int32)), pa.array((bucket % per).astype(np.int32)), pa.array(ids.astype(np.int64)), pa.array(pos.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=BAND_POSTINGS.names)


def _sampled_postings(path: str, h: Header, t: Task) -> pa.RecordBatch:
    r = np.frombuffer(_part(path, t.table + SKIP.itemsize * t.first, SKIP.itemsize * (min(t.last + 1, t.total) - t.first)), SKIP)
    n = t.last - t.first
    stop = int(r["at"][n]) if len(r) > n else t.end - t.blob
    data = np.frombuffer(_part(path, t.blob + int(r["at"][0]), stop - int(r["at"][0])), np.uint8) if n else np.zeros(0, np.uint8)
    at, hash_, hashes, ids, ordinals = 0, None, [], [], []
    while at < len(data):
        (delta, count), used = codec.varint_decode(data[at : at + 10], 2)
        at += used
        hash_ = int(r["hash"][0]) if hash_ is None else hash_ + int(delta)
        d, used = codec.varint_decode(data[at : at + 5 * int(count)], int(count))
        at += used
        if at + int(count) > len(data):
            raise InvalidCompression("a bucket is broken")
        ids.append(np.cumsum(d).astype(np.int64))
        ordinals.append(data[at : at + int(count)].astype(np.int32))
        hashes.append(np.full(int(count), hash_, np.int64))
        at += int(count)
    columns = [pa.array(np.concatenate(x) if x else np.zeros(0, k)) for x, k in ((hashes, np.int64), (ids, np.int64), (ordinals, np.int32))]
    return pa.RecordBatch.from_arrays(columns, names=SAMPLED_POSTINGS.names)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.family = options["path"], options.get("kind", "D"), options["family"]
        self.per_task = int(options.get("pertask", PER_TASK[self.kind]))

    def partitions(self) -> list[Task]:
        h = read_header(self.path, self.kind, self.family)
        s0, n0, s1, n1 = h.sections
        width = {"D": RECORD, "X": BUCKET, "I": SKIP, "M": MAPPING}[self.kind].itemsize
        regions = [(s0, s1, s1 + n1, n0 // width, False)]
        if h.overflow:
            at, one, two = h.overflow
            end = h.size - FOOTER.size
            count = two if self.kind in "XI" else one
            # what the overflow's second number means differs by kind: a count of entries or where its payload begins
            blob = at + count * width if self.kind in "XI" else at - OVERFLOW.size + two
            if at + count * width > end or blob > end:
                raise CorruptOverflow("it lies beyond the end")
            regions.append((at, blob, end, count, True))
        out = []
        for table, blob, end, n, late in regions:
            out += [Task(table, blob, end, k, min(k + self.per_task, n), n, late) for k in range(0, n, self.per_task)]
        return out

    def read(self, t: Task | None) -> Iterator[pa.RecordBatch]:
        if t is None:  # a file without entries has no ranges
            return
        h = read_header(self.path, self.kind, self.family)
        batch = {"D": _fingerprints, "X": _band_postings, "I": _sampled_postings, "M": _mappings}[self.kind](self.path, h, t)
        yield batch.append_column("from_overflow", pa.array(np.full(len(batch), t.from_overflow)))


class ContainerSource(DataSource):
    """``spark.read.format('wavemill_container').option('kind', 'D').option('family', ...).load(path)``: the rows of the
    kind's table, main ones and those of the overflow, with ``from_overflow``."""

    @classmethod
    def name(cls) -> str:
        return "wavemill_container"

    def schema(self) -> T.StructType:
        return T.StructType([*SCHEMAS[self.options.get("kind", "D")], T.StructField("from_overflow", T.BooleanType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_container(spark: SparkSession, path: str, kind: str, family: str, **options) -> DataFrame:
    """The table of one container file."""
    spark.dataSource.register(ContainerSource)
    reader = spark.read.format("wavemill_container").option("kind", kind).option("family", family)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load(path)


# writing: each task encodes its range to (table bytes, payload bytes); offsets are made absolute when the parts join


def _encode_fingerprints(rows: pa.Table, packed: bool) -> tuple[np.ndarray, bytes]:
    one = codec.compress_packed if packed else codec.compress
    values = rows.column("values").combine_chunks()
    data = [one(np.array(v.values.to_numpy(zero_copy_only=False))) if v.is_valid else b"" for v in values]
    sizes = [len(v.values) if v.is_valid else 0 for v in values]
    if any(len(d) > 65535 for d in data) or any(n > 65535 for n in sizes):
        raise OffsetOutOfBounds("a fingerprint is too long for the container")
    r = np.zeros(len(rows), RECORD)
    at = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)[:-1] if data else np.zeros(0, np.int64)
    r["id"], r["low"], r["high"], r["length"] = rows.column("fp_id").to_numpy(), at & U32, at >> 32, [len(d) for d in data]
    r["ms"], r["count"] = rows.column("duration_ms").fill_null(0).to_numpy(), sizes
    return r, b"".join(data)


def _encode_mappings(rows: pa.Table, texts: bool) -> tuple[np.ndarray, bytes]:
    r, pool, at = np.zeros(len(rows), MAPPING), [], 0
    r["id"], r["track"] = rows.column("fp_id").to_numpy(), rows.column("track_id").fill_null(0).to_numpy()
    r["mbid"] = [np.void(uuid.UUID(m).bytes if m else b"\0" * 16) for m in rows.column("mbid").to_pylist()]
    for i, text in enumerate(rows.column("text").to_pylist()):
        if text is None or not texts:
            r["at"][i] = NO_TEXT
        else:
            b = text.encode()
            r["at"][i], r["length"][i] = at, len(b)
            pool.append(b)
            at += len(b)
    return r, b"".join(pool)


def _encode_bucket(ids: np.ndarray, pos: np.ndarray, packed: bool) -> bytes:
    if packed:
        return codec.compress_postings(ids, pos)
    deltas, size = codec.varint_encode(np.diff(ids))
    body = _woven(deltas, size, np.asarray(pos[1:], "<u2").view(np.uint8), np.full(len(pos) - 1, 2))
    return int(ids[0]).to_bytes(4, "little") + int(pos[0]).to_bytes(2, "little") + body[0].tobytes()


def _woven(one: np.ndarray, n_one: np.ndarray, two: np.ndarray, n_two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``one`` and ``two`` by turns, of the given sizes; and where each turn begins."""
    at = np.cumsum(n_one + n_two) - (n_one + n_two)
    out = np.empty(len(one) + len(two), np.uint8)
    for data, n, start in ((one, n_one, at), (two, n_two, at + n_one)):
        out[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(len(data))] = data
    return out, at


def _grouped(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, np.diff(keys) != 0, True]) if len(keys) else []
    return list(zip(edges[:-1], edges[1:]))


def _encode_bands(rows: pa.Table, packed: bool) -> tuple[np.ndarray, bytes]:
    bucket, ids, pos = (rows.column(c).to_numpy() for c in ("bucket", "fp_id", "pos"))
    groups = _grouped(bucket)
    data = [_encode_bucket(ids[a:b], pos[a:b], packed) for a, b in groups]
    r = np.zeros(len(groups), np.dtype([("bucket", "<u4"), *BUCKET.descr]))
    r["bucket"], r["count"] = [bucket[a] for a, _ in groups], [b - a for a, b in groups]
    r["at"] = np.r_[0, np.cumsum([len(d) for d in data])][:-1] if data else []
    return r, b"".join(data)


def _encode_sampled(rows: pa.Table, _: bool) -> tuple[np.ndarray, bytes]:
    """Each bucket without its hash difference, which depends on the part before; (hash, offset, count) beside it."""
    hashes, ids, ordinals = (rows.column(c).to_numpy() for c in ("hash", "fp_id", "ordinal"))
    groups, data = _grouped(hashes), []
    for a, b in groups:
        numbers, _ = codec.varint_encode(np.r_[b - a, ids[a], np.diff(ids[a:b])])
        data.append(numbers.tobytes() + ordinals[a:b].astype(np.uint8).tobytes())
    r = np.zeros(len(groups), np.dtype([*SKIP.descr, ("length", "<u8"), ("count", "<u4")]))
    r["hash"], r["length"], r["count"] = [hashes[a] for a, _ in groups], [len(d) for d in data], [b - a for a, b in groups]
    return r, b"".join(data)


_ENCODE = {"D": _encode_fingerprints, "X": _encode_bands, "I": _encode_sampled, "M": _encode_mappings}


def write_container(df: DataFrame, path: str, kind: str, family: str, *, packed: bool = False, texts: bool = True, tuning: BandTuning | PostingTuning | None = None, dataset_id: uuid.UUID | None = None, source_date: int = 0, created_at: int | None = None) -> None:
    """Write one container file from a table of the kind's columns (for 'X' and 'I' of postings, or of fingerprints).

    Rows are sorted as the format wants; repeated rows stay, but for sampled postings, which are a set. A bucket of
    'X' or 'I' is encoded by one task, as the format has no way to split it. The file appears when it is complete.
    Null ids are refused, null durations and tracks become 0, a null text none.
    """
    if kind in "XI":
        tuning = tuning or (BandTuning() if kind == "X" else PostingTuning())
        if "values" in df.columns:
            df = bands.band_postings(df, tuning) if kind == "X" else postings.sampled(df, tuning)
        elif kind == "I":
            df = postings.clean(df, tuning)
    if not df.where(F.col("fp_id").isNull()).isEmpty():
        raise OffsetOutOfBounds("a null id can't be written")
    if kind == "M":
        from wavemill.functions.strings import encode_metadata

        df = df.select("fp_id", "mbid", "track_id", encode_metadata("metadata").alias("text"))
    keys = {"D": ["fp_id"], "M": ["fp_id"], "X": ["bucket"], "I": ["hash"]}[kind]
    order = {"D": ["fp_id"], "M": ["fp_id"], "X": ["bucket", "fp_id", "pos"], "I": ["hash", "fp_id", "ordinal"]}[kind]
    root = urlparse(scratch_folder(df.sparkSession))
    if root.scheme not in ("", "file"):
        raise OffsetOutOfBounds("containers are written through a mounted scratch folder")
    folder = f"{root.path}/container-{uuid.uuid4().hex}"
    os.makedirs(folder)
    encode, flag = _ENCODE[kind], texts if kind == "M" else packed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = [b for b in batches if len(b)]
        if not got:
            return
        table, payload = encode(pa.Table.from_batches(got), flag)
        name = f"{folder}/{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
        np.save(f"{name}.npy", table)
        with open(name, "wb") as f:
            f.write(payload)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([name])], names=["part", "name"])

    made = df.repartitionByRange(*keys).sortWithinPartitions(*order).mapInArrow(run, "part long, name string").collect()
    parts = [r.name for r in sorted(made)]
    head = HEADER.size + (BAND_TUNING.size if kind in "XI" else 0)
    tables = [np.load(f"{p}.npy") for p in parts]
    sizes = [os.path.getsize(p) for p in parts]
    beside = f"{path}.{uuid.uuid4().hex}"
    flags = (TEXTS if texts else 0) if kind == "M" else (PACKED if packed and kind != "I" else 0)
    with open(beside, "wb") as f:
        if kind in "DM":
            records = sum(map(len, tables))
            f.seek(head)
            base = 0
            for t, n in zip(tables, sizes):
                if kind == "D":
                    at = (t["low"].astype(np.int64) | t["high"].astype(np.int64) << 32) + base
                    t["low"], t["high"] = at & U32, at >> 32
                else:
                    t["at"] = np.where(t["at"] == NO_TEXT, NO_TEXT, t["at"] + base)
                f.write(t.tobytes())
                base += n
            length = f.tell() - head
        elif kind == "X":
            records = sum(int(t["count"].sum()) for t in tables)
            directory, base = np.zeros(tuning.total_buckets, BUCKET), 0
            for t, n in zip(tables, sizes):
                directory["at"][t["bucket"]], directory["count"][t["bucket"]] = t["at"] + base, t["count"]
                base += n
            f.seek(head)
            f.write(directory.tobytes())
            length, stats = directory.nbytes, BAND_TUNING.pack(tuning.num_bands, tuning.bits_per_band, tuning.buckets_per_band, tuning.total_buckets, records, records // tuning.total_buckets, 0)
        else:
            every = np.concatenate([t["hash"] for t in tables]) if tables else np.zeros(0, np.uint32)
            records, n_skip = sum(int(t["count"].sum()) for t in tables), -(-len(every) // tuning.skip_interval)
            length = n_skip * SKIP.itemsize
            stats = POSTING_TUNING.pack(tuning.stride, tuning.qbits, tuning.skip_interval, len(every), records, n_skip, 0)
        start = head + length + (-(head + length) % 8)
        f.seek(start)
        if kind == "I":
            skip, before, seen = np.zeros(n_skip, SKIP), 0, 0
            for t, p in zip(tables, parts):
                deltas, size = codec.varint_encode(np.diff(np.r_[before, t["hash"].astype(np.int64)]))
                data, at = _woven(deltas, size, np.fromfile(p, np.uint8), t["length"].astype(np.int64))
                rank = seen + np.arange(len(t))
                first = rank % tuning.skip_interval == 0
                skip["hash"][rank[first] // tuning.skip_interval] = t["hash"][first]
                skip["at"][rank[first] // tuning.skip_interval] = f.tell() - start + at[first]
                f.write(data.tobytes())
                before, seen = int(t["hash"][-1]), seen + len(t)
        else:
            for p in parts:
                with open(p, "rb") as g:
                    while chunk := g.read(1 << 20):
                        f.write(chunk)
        end = f.tell()
        f.write(b"\0" * (-end % 8))
        f.write(FOOTER.pack(0, magic(family, kind, "F")))
        f.seek(0)
        created = int(time.time()) if created_at is None else created_at
        f.write(HEADER.pack(magic(family, kind), MAJOR, MINOR, flags, records, created, source_date, (dataset_id or uuid.uuid4()).bytes, b"\0" * 8, head, length, start, end - start))
        if kind in "XI":
            f.write(stats)
        if kind == "I":
            f.seek(head)
            f.write(skip.tobytes())
    os.replace(beside, path)
    shutil.rmtree(folder)


KINDS = {"D": "fingerprints", "X": "band_postings", "I": "sampled_postings", "M": "mappings"}


def import_dataset(spark: SparkSession, files: dict[str, str], family: str, path: str) -> Dataset:
    """A dataset at ``path`` from container files, ``files`` by kind; their overflows become its overflows.

    All files must be of one dataset. Tunings and the source date are those of the files.
    """
    headers = {kind: read_header(file, kind, family) for kind, file in files.items()}
    ids = {h.dataset_id for h in headers.values()}
    if len(ids) != 1:
        raise DatasetMismatch(", ".join(sorted(str(uuid.UUID(bytes=i)) for i in ids)))
    tuning = {kind: asdict(h.tuning) if h.tuning else None for kind, h in headers.items()}
    any_header = next(iter(headers.values()))
    texts = bool(headers["M"].flags & TEXTS) if "M" in headers else True
    manifest = {"version": VERSION, "revision": 0, "dataset_id": str(uuid.UUID(bytes=any_header.dataset_id)), "created_at": any_header.created_at, "source_date": any_header.source_date, "tables": {}, "band_tuning": tuning.get("X"), "posting_tuning": tuning.get("I"), "include_text": texts}
    ds = Dataset(spark, path, manifest)
    for kind, file in files.items():
        rows = read_container(spark, file, kind, family)
        main, later = (rows.where(late).drop("from_overflow") for late in ("not from_overflow", "from_overflow"))
        manifest["tables"][KINDS[kind]] = {"main": ds._write(KINDS[kind], main), "overflow": [ds._write(KINDS[kind], later)] if headers[kind].overflow else None}
    ds._publish(first=True)
    return Dataset.open(spark, path)


def export_dataset(ds: Dataset, files: dict[str, str], family: str, *, packed: bool = False) -> None:
    """The tables of a dataset as container files of its id, ``files`` by kind. The files have no overflow, so a table
    that has one is exported as it would be after compaction; the dataset stays as it is."""
    for kind, file in files.items():
        tuning = ds.band_tuning if kind == "X" else ds.posting_tuning if kind == "I" else None
        write_container(ds.compacted(KINDS[kind]), file, kind, family, packed=packed, texts=ds.manifest["include_text"], tuning=tuning, dataset_id=uuid.UUID(ds.manifest["dataset_id"]), source_date=ds.manifest["source_date"] or 0)
