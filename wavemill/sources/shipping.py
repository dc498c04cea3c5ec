"""The library itself, sent to the workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the session's Python workers import this library wherever they run: its source files go to them once for
    each application, as a zip that the driver serves."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="wavemill-")) / "wavemill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
