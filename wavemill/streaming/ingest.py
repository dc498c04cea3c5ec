"""A stream of fingerprints into a dataset's overflow, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from wavemill.operators.overlay import one_per_key
from wavemill.sources.store import Dataset


def ingest(stream: DataFrame, dataset: Dataset, checkpoint: str, *, index: bool = True) -> DataStreamWriter:
    """Writer of a stream ``(fp_id, duration_ms, values)`` that upserts each batch into the dataset's overflow.

    Of repeated ids in a batch one record is kept; later batches win over earlier ones. An upsert of the same batch
    twice, as after a restart, leaves the same state: fingerprints are replaced by id, and postings are a set, so the
    sink is idempotent. Records without an id or without values are left out. Start it with ``.start()``.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col("fp_id").isNotNull() & (F.size("values") > 0)).select("fp_id", "duration_ms", "values")
        rows = one_per_key(rows, "fp_id").persist()
        try:
            if rows.isEmpty():
                return
            dataset.append_fingerprints(rows, mode="accumulate")
            if index and dataset.manifest["tables"].get("sampled_postings"):
                dataset.append_sampled_values(rows, mode="accumulate")
            if index and dataset.manifest["tables"].get("band_postings"):
                dataset.append_band_postings(rows.select("fp_id"), mode="accumulate")
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)


def arrivals_by_window(stream: DataFrame, *, time_col: str = "added_at", window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Fingerprints and values that arrive in each time window, late ones up to ``delay``: ``(start, n_fps, n_values)``."""
    timed = stream.withWatermark(time_col, delay).groupBy(F.window(time_col, window))
    counted = timed.agg(F.count(F.lit(1)).alias("n_fps"), F.sum(F.greatest(F.size("values"), F.lit(0))).alias("n_values"))
    return counted.select(F.col("window.start").alias("start"), "n_fps", "n_values")
