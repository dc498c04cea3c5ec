"""A dataset in a folder: Parquet tables in versioned folders, and one manifest whose swap publishes a change.

Layout: ``manifest.json`` names the current folder of each table and the folders of its overflow, oldest first. A change
writes new folders first and replaces the manifest last, so a reader sees the old state or the new one. The manifest
counts its revisions; a writer whose dataset another one has changed since is refused, and opens it again. Folders that
no manifest names any more are left for ``vacuum``.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wavemill.errors import ConcurrentChange, CorruptOverflow, DatasetMismatch, NoDataStore, NoIndex, NoPostingIndex, NoSearchIndex, OffsetOutOfBounds, RecordNotFound, UnknownFlags, UnsupportedVersion
from wavemill.functions import codec
from wavemill.operators import bands, overlay, packed, postings, search, stats
from wavemill.schema import TABLES
from wavemill.sources.tables import free_shuffles
from wavemill.tuning import DEFAULTS, MAX_VALUES, BandTuning, HitOptions, PostingTuning, QueryOptions

log = logging.getLogger("wavemill")

VERSION = 0
FIELDS = {"version", "revision", "dataset_id", "created_at", "source_date", "tables", "band_tuning", "posting_tuning", "include_text"}
#: Order in which each table is laid out; a range of it is a file, so a lookup prunes to some files and row groups.
LAYOUT = {"fingerprints": ["fp_id"], "mappings": ["fp_id"], "band_postings": ["bucket", "fp_id", "pos"], "sampled_postings": ["hash", "fp_id", "ordinal"]}


def from_compressed(rows: DataFrame, packed: bool = False) -> DataFrame:
    """Fingerprints of encoded ones ``(fp_id, duration_ms, data, raw_count)``, to be stored like any others."""
    decode = codec.decoded_packed if packed else codec.decoded
    return rows.select("fp_id", "duration_ms", decode("data", "raw_count").alias("values"))


class _Files:
    """Small files on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark._jvm, path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Whole or not at all: written beside the file, then renamed over it."""
        beside = f"{name}.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        uri, conf = self._path("").toUri(), self.fs.getConf()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri() if uri.getScheme() is None else uri, conf)
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        over = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(over, 0, options.OVERWRITE)
        context.rename(self._path(beside), self._path(name), over)

    def list(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.exists(name) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Dataset:
    """An open dataset. Every method that reads returns a DataFrame; single lookups return one row."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        self.files = _Files(spark, path)

    # opening and building

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Dataset:
        """Open what the manifest names; a dataset without any index, or with neither fingerprints nor sampled
        postings, is refused, as are tables of another dataset."""
        files = _Files(spark, path)
        if not files.exists("manifest.json"):
            raise NoIndex(path)
        manifest = json.loads(files.read("manifest.json"))
        if manifest.get("version") != VERSION:
            raise UnsupportedVersion(str(manifest.get("version")))
        if unknown := set(manifest) - FIELDS:
            raise UnknownFlags(", ".join(sorted(unknown)))
        there = manifest["tables"]
        if "band_postings" not in there and "sampled_postings" not in there:
            raise NoIndex(path)
        if "fingerprints" not in there and "sampled_postings" not in there:
            raise NoDataStore(path)
        for name, parts in there.items():
            if name not in TABLES:
                raise UnknownFlags(name)
            for kind, folder in [(k, x) for k, v in parts.items() for x in (v if isinstance(v, list) else [v]) if x]:
                if not files.exists(f"{folder}.json"):
                    raise CorruptOverflow(folder) if kind == "overflow" else OffsetOutOfBounds(folder)
                if json.loads(files.read(f"{folder}.json"))["dataset_id"] != manifest["dataset_id"]:
                    raise DatasetMismatch(folder)
        return cls(spark, path, manifest)

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, fingerprints: DataFrame | None = None, mappings: DataFrame | None = None, band_tuning: BandTuning | None = BandTuning(), posting_tuning: PostingTuning | None = PostingTuning(), include_text: bool = True, dataset_id: str | None = None, source_date: int | None = None, sampled_postings: DataFrame | None = None) -> Dataset:
        """Write a dataset: the tables given and the indexes whose tuning is given, built from the fingerprints.

        ``sampled_postings`` (hash, fp_id, ordinal) may be given in place of fingerprints. Texts are dropped without
        ``include_text``.
        """
        manifest = {"version": VERSION, "revision": 0, "dataset_id": dataset_id or str(uuid.uuid4()), "created_at": int(time.time()), "source_date": source_date, "tables": {}, "band_tuning": None, "posting_tuning": None, "include_text": include_text}
        self = cls(spark, path, manifest)
        tables = manifest["tables"]
        if fingerprints is not None:
            tables["fingerprints"] = {"main": self._write("fingerprints", self._checked(fingerprints)), "overflow": None}
            base = self._main("fingerprints")
            if band_tuning is not None:
                manifest["band_tuning"] = asdict(band_tuning)
                tables["band_postings"] = {"main": self._write("band_postings", bands.band_postings(base, band_tuning)), "overflow": None}
        if posting_tuning is not None and (fingerprints is not None or sampled_postings is not None):
            manifest["posting_tuning"] = asdict(posting_tuning)
            rows = postings.clean(sampled_postings, posting_tuning) if sampled_postings is not None else postings.sampled(self._main("fingerprints"), posting_tuning)
            tables["sampled_postings"] = {"main": self._write("sampled_postings", rows), "overflow": None}
        if mappings is not None:
            tables["mappings"] = {"main": self._write("mappings", self._texts(mappings)), "overflow": None}
        self._publish(first=True)
        return cls.open(spark, path)

    def _checked(self, rows: DataFrame, empty: bool = True) -> DataFrame:
        """Fingerprints whose values an index position can address; without ``empty`` they must have values, too."""
        bad = rows.where((F.size("values") > MAX_VALUES) | (F.lit(not empty) & (F.coalesce(F.size("values"), F.lit(0)) < 1)))
        if not bad.isEmpty():
            raise OffsetOutOfBounds(f"fingerprint {bad.select('fp_id').first()[0]} has no or too many values")
        return rows

    def _texts(self, rows: DataFrame) -> DataFrame:
        return rows if self.manifest["include_text"] else rows.withColumn("metadata", F.lit(None).cast(TABLES["mappings"]["metadata"].dataType))

    def _write(self, name: str, rows: DataFrame) -> str:
        wide = ("bucket", "band_value") if name == "band_postings" and self.band_tuning.bits_per_band == 32 else ()
        columns = [F.col(f.name).cast("bigint" if f.name in wide else f.dataType) for f in TABLES[name]]
        extra = [c for c in ("added_at",) if c in rows.columns]
        folder = f"{name}/{uuid.uuid4().hex}"
        keys = LAYOUT[name]
        if name == "band_postings":  # the largest table: moved in few bytes, and ids stored by their differences
            out = packed.laid_out(rows, self.band_tuning.buckets_per_band, "bigint" if wide else "int").select(*columns)
            out.write.options(**{"compression": "zstd", "parquet.writer.version": "v2"}).parquet(f"{self.path}/{folder}")
        else:
            rows.select(*columns, *extra).repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{self.path}/{folder}")
        free_shuffles(self.spark)
        self.files.write(f"{folder}.json", json.dumps({"dataset_id": self.manifest["dataset_id"]}))
        log.info("wrote %s", folder)
        return folder

    def _publish(self, first: bool = False) -> None:
        if not first and self.files.exists("manifest.json"):
            now = json.loads(self.files.read("manifest.json")).get("revision", 0)
            if now != self.manifest.get("revision", 0):
                raise ConcurrentChange(f"{self.path} is at revision {now}")
            self.manifest["revision"] = now + 1
        self.files.write("manifest.json", json.dumps(self.manifest, indent=1))
        log.info("published %s", self.path)

    def vacuum(self) -> None:
        """Remove folders that the manifest doesn't name; only when no older reader is at work."""
        named = {x for parts in self.manifest["tables"].values() for v in parts.values() for x in (v if isinstance(v, list) else [v])}
        for name in TABLES:
            for entry in self.files.list(name):
                if f"{name}/{entry.removesuffix('.json')}" not in named:
                    self.files.remove(f"{name}/{entry}")

    # tables

    def _has(self, name: str) -> bool:
        return name in self.manifest["tables"]

    def _main(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest['tables'][name]['main']}")

    def _overflow(self, name: str) -> DataFrame | None:
        """The overflow: of each id the rows of the newest folder that has it; rows without an id stay."""
        folders = self.manifest["tables"].get(name, {}).get("overflow") or []
        parts = [self.spark.read.parquet(f"{self.path}/{folder}") for folder in folders]
        if len(parts) < 2:
            return parts[0] if parts else None
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_seq", F.lit(i)) for i, p in enumerate(parts)])
        newest = every.groupBy(F.col("fp_id").alias("_id")).agg(F.max("_seq").alias("_newest"))
        kept = every.join(newest, F.col("fp_id") == F.col("_id"), "left").where(F.col("fp_id").isNull() | (F.col("_seq") == F.col("_newest")))
        return kept.drop("_seq", "_id", "_newest")

    def _need(self, name: str, error: type[Exception]) -> DataFrame:
        if not self._has(name):
            raise error(self.path)
        return self._main(name)

    @property
    def band_tuning(self) -> BandTuning:
        return BandTuning(**self.manifest["band_tuning"])

    @property
    def posting_tuning(self) -> PostingTuning:
        return PostingTuning(**self.manifest["posting_tuning"])

    def fingerprints(self) -> DataFrame:
        """All current fingerprints, with ``from_overflow``."""
        return overlay.overlay(self._need("fingerprints", NoDataStore), self._overflow("fingerprints"), mark="from_overflow")

    def mappings(self) -> DataFrame:
        """All current mappings, with ``from_overflow``; none without a mapping table."""
        if not self._has("mappings"):
            return self.spark.createDataFrame([], TABLES["mappings"]).withColumn("from_overflow", F.lit(False))
        return overlay.overlay(self._main("mappings"), self._overflow("mappings"), mark="from_overflow")

    # reading

    def lookup(self, fp_id: int) -> Row:
        """The fingerprint of an id; the filter reaches the scans."""
        main, later = self._need("fingerprints", NoDataStore), self._overflow("fingerprints")
        for part in (later, main):
            if part is not None and (found := part.where(F.col("fp_id") == fp_id).limit(1).collect()):
                return found[0]
        raise RecordNotFound(str(fp_id))

    def lookup_all(self, ids: DataFrame) -> DataFrame:
        """The fingerprints of all ids of a table."""
        return overlay.lookup(self._need("fingerprints", NoDataStore), self._overflow("fingerprints"), ids)

    def lookup_metadata(self, fp_id: int) -> Row | None:
        """The mapping of an id; None without a mapping table."""
        if not self._has("mappings"):
            return None
        for part in (self._overflow("mappings"), self._main("mappings")):
            if part is not None and (found := part.where(F.col("fp_id") == fp_id).limit(1).collect()):
                return found[0]
        raise RecordNotFound(str(fp_id))

    def lookup_hash(self, value: int) -> DataFrame:
        return postings.lookup_hash(self._need("sampled_postings", NoPostingIndex), value, self.posting_tuning, self._overflow("sampled_postings"))

    def posting_list(self, bucket: int) -> DataFrame:
        return bands.posting_list(self._need("band_postings", NoSearchIndex), bucket, self._overflow("band_postings"))

    def query(self, queries: DataFrame, options: QueryOptions = DEFAULTS) -> DataFrame:
        index = self._need("band_postings", NoSearchIndex)
        mapped = {"mappings": self._main("mappings"), "overflow_mappings": self._overflow("mappings")} if self._has("mappings") else {}
        return search.band_query(queries, index, self._need("fingerprints", NoDataStore), tuning=self.band_tuning, options=options, overflow_postings=self._overflow("band_postings"), overflow_fingerprints=self._overflow("fingerprints"), **mapped)

    def query_full(self, queries: DataFrame, options: HitOptions = HitOptions(), verify: bool = False) -> DataFrame:
        hits = search.full_query(queries, self._need("sampled_postings", NoPostingIndex), tuning=self.posting_tuning, options=options, overflow=self._overflow("sampled_postings"))
        return search.verified_hits(hits, queries, self._need("fingerprints", NoDataStore), self._overflow("fingerprints")) if verify else hits

    def stats(self) -> DataFrame:
        main = {n: self._main(n) if self._has(n) else None for n in ("fingerprints", "mappings")}
        return stats.dataset_stats(self.spark, fingerprints=main["fingerprints"], overflow=self._overflow("fingerprints"), mappings=main["mappings"], has_search_index=self._has("band_postings"), has_posting_index=self._has("sampled_postings"))

    def needs_compaction(self, threshold_pct: float) -> bool:
        return bool(stats.needs_compaction(self.stats(), threshold_pct).first()[0])

    # overflow

    def _append(self, name: str, rows: DataFrame, mode: str) -> None:
        """A new overflow replaces the one before it; with ``accumulate`` it is laid over that, as a folder of its own
        whose ids take the place of the same ids before. Nothing older is read or written again until ``compact``."""
        if mode not in ("replace", "accumulate"):
            raise ValueError(mode)
        before = self.manifest["tables"][name]["overflow"] or []
        self.manifest["tables"][name]["overflow"] = [*(before if mode == "accumulate" else []), self._write(name, rows)]
        self._publish()

    def append_fingerprints(self, records: DataFrame, mode: str = "replace", empty: bool = False) -> None:
        """Records without values are refused; with ``empty`` they supersede the records of their ids like any others."""
        self._need("fingerprints", NoDataStore)
        self._append("fingerprints", self._checked(records, empty=empty), mode)

    def append_mappings(self, records: DataFrame, mode: str = "replace") -> None:
        self._need("mappings", RecordNotFound)
        self._append("mappings", records, mode)

    def _stored(self, ids: Iterable[int] | DataFrame) -> DataFrame:
        wanted = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "fp_id long")
        found = self.lookup_all(wanted)
        missing = wanted.select("fp_id").join(found.select("fp_id").distinct(), "fp_id", "left_anti")
        if not missing.isEmpty():
            raise RecordNotFound(str(missing.first()[0]))
        return found

    def append_band_postings(self, ids: Iterable[int] | DataFrame, mode: str = "replace") -> None:
        """Band postings of stored ids; an id that isn't stored is an error."""
        self._need("band_postings", NoSearchIndex)
        self._append("band_postings", bands.band_postings(self._stored(ids), self.band_tuning), mode)

    def append_sampled_postings(self, ids: Iterable[int] | DataFrame, mode: str = "replace") -> None:
        self._need("sampled_postings", NoPostingIndex)
        self._append("sampled_postings", postings.sampled(self._stored(ids), self.posting_tuning), mode)

    def append_sampled_values(self, records: DataFrame, mode: str = "replace", order: str | None = None) -> None:
        """Sampled postings of given fingerprints that need not be stored; of repeated ids the first by ``order``."""
        self._need("sampled_postings", NoPostingIndex)
        rows = overlay.first_of_batch(records, "fp_id", order) if order else records
        self._append("sampled_postings", postings.sampled(rows, self.posting_tuning), mode)

    def truncate_overflow(self, name: str | None = None) -> None:
        """Drop the overflow of one table or of all."""
        if name is not None and not self._has(name):
            raise OffsetOutOfBounds(name)
        for table in [name] if name else self.manifest["tables"]:
            self.manifest["tables"][table]["overflow"] = None
        self._publish()

    # compaction

    def compact(self, tables: Iterable[str] | None = None) -> None:
        """Fold the overflow of the named tables (default: all) into their main part, in one swap of the manifest.

        Records of the overflow win. Indexes are rebuilt from the compacted fingerprints with their tuning; an index
        over no fingerprint table keeps its own and its overflow postings.
        """
        wanted = [n for n in (tables if tables is not None else list(self.manifest["tables"])) if self._has(n)]
        new = {}
        for name in [n for n in ("fingerprints", "mappings", "band_postings", "sampled_postings") if n in wanted]:
            base = self.spark.read.parquet(f"{self.path}/{new['fingerprints']}") if "fingerprints" in new else (self._main("fingerprints") if self._has("fingerprints") else None)
            new[name] = self._write(name, self.compacted(name, base))
        for name, folder in new.items():
            self.manifest["tables"][name] = {"main": folder, "overflow": None}
        self._publish()

    def compacted(self, name: str, base: DataFrame | None = None) -> DataFrame:
        """The rows of a table once its overflow is folded in; those of an index come from the fingerprints ``base``, by
        default all current ones."""
        main, later = self._main(name), self._overflow(name)
        if name in ("fingerprints", "mappings"):
            rows = overlay.overlay(main, later)
            return self._texts(rows) if name == "mappings" else rows
        if base is None and self._has("fingerprints"):
            base = self.fingerprints().drop("from_overflow")
        if name == "band_postings":
            if base is None:
                raise NoDataStore(self.path)
            return bands.band_postings(base, self.band_tuning)
        return postings.sampled(base, self.posting_tuning) if base is not None else (main if later is None else main.unionByName(later)).distinct()
