"""Reading of named tables and a scratch space that every executor can reach."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.errors import NoSharedFolder

_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where none is named, a local session gets a folder of its own; on a cluster no folder of this machine would do, so
    that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wavemill-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder in the scratch space. It is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{scratch_root(spark).rstrip('/')}/wavemill/{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _FOLDERS[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared scratch folder and read it back.

    It cuts the lineage: the parts survive the loss of any executor, and several readers don't run the plan again.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what :func:`materialise` wrote, once nothing reads it any more."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing refers to any more deleted now, not when the driver happens to collect."""
    gc.collect()
    spark._jvm.System.gc()


#: Bits of the filter that goes to every executor (4 MB).
FILTER_BITS = 1 << 25


def marked(df: DataFrame, wanted: DataFrame, key: str, mark: str) -> DataFrame:
    """``df`` with a boolean ``mark``: whether ``key`` may stand in ``wanted`` (its column of that name). Where it says no,
    the key doesn't.

    The hashes of the wanted keys (a null is a key like any other) set bits in a filter of fixed size, whatever the tables'
    sizes, so no row is shuffled. Of other keys one in ``FILTER_BITS`` / number of wanted keys is marked wrongly.
    """
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = wanted.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.join(F.broadcast(bits), F.bitmap_bucket_number(place) == F.col("_bucket"), "left")
    return met.select(*df.columns, F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1, F.lit(False)).alias(mark))


def thinned(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose ``key`` may stand in ``wanted``, and some others (see ``marked``).

    It spares a semi-join the shuffle of rows that have no partner; the exact join must follow.
    """
    return marked(df, wanted, key, "_wanted").where("_wanted").drop("_wanted")


#: Bytes that one partition of a shuffle should hold.
PARTITION_BYTES = 64 << 20


def partitions_for(df: DataFrame, growth: float, size: int | None = None) -> int:
    """Partitions of ``size`` bytes for a shuffle of ``growth`` times the bytes of the tables under ``df``, at least the
    session's number.

    Only what Spark knows of its input files counts; inputs of unknown size leave the session's number.
    """
    known = 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
    while leaves.hasNext():
        leaf = int(str(leaves.next().stats().sizeInBytes()))
        known += leaf if leaf < 1 << 60 else 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(known * growth / (size or PARTITION_BYTES)) + 1)
