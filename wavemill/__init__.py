"""Fingerprint analytics on Spark: storage, banded and full-resolution search, overlays, and data checks.

Everything is a DataFrame plan. Sub-packages: ``functions`` (column expressions and codecs), ``operators``
(relational operators), ``sources`` (tables, dataset store), ``streaming`` (incremental ingest) and ``plans``
(registered queries with their SQL counterparts).
"""

__version__ = "0.1.0"
