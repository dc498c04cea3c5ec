"""The SQL counterparts of the engine's queries, for DuckDB."""

from __future__ import annotations

MASK = 4294967292

_INDEX = f"""idx AS (SELECT DISTINCT hash & {MASK} AS hash, fp_id, ordinal FROM sampled_postings
    WHERE hash IS NOT NULL AND fp_id IS NOT NULL AND ordinal IS NOT NULL)"""


def _varint(x: str) -> str:
    return f"CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 WHEN {x} < 2097152 THEN 3 WHEN {x} < 268435456 THEN 4 ELSE 5 END"


def _sampled(source: str, name: str) -> str:
    return f"""{name} AS (SELECT DISTINCT v & {MASK} AS hash, fp_id, (i / 8)::INT AS ordinal FROM (
    SELECT fp_id, unnest("values") AS v, unnest(range(len("values"))) AS i FROM {source} WHERE len("values") > 0)
    WHERE i % 8 = 0 AND i / 8 <= 255 AND v IS NOT NULL)"""


def _full(index: str, postings: str, hits: int = 3, k: int = 100, queries: str = "queries") -> str:
    return f"""WITH {index},
q AS (SELECT qid, unnest("values") & {MASK} AS hash, unnest(range(len("values"))) AS p FROM {queries} WHERE len("values") > 0),
votes AS (SELECT qid, fp_id, ordinal * 8 - p AS delta, count(*) AS hits FROM q JOIN ({postings}) USING (hash) GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY qid, fp_id ORDER BY hits DESC, abs(delta), delta) = 1),
full_ AS (SELECT qid, fp_id, hits, delta::BIGINT AS delta, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, abs(delta), delta, fp_id) AS rank
    FROM best WHERE hits >= {hits} QUALIFY rank <= {k})
"""


_OVERLAY = """every AS (SELECT fp_id, duration_ms, "values", true AS from_overflow FROM fingerprints_overflow UNION ALL
    SELECT fp_id, duration_ms, "values", false FROM fingerprints f WHERE NOT EXISTS (SELECT 1 FROM fingerprints_overflow o WHERE o.fp_id = f.fp_id))"""
_MAPPED = """every_map AS (SELECT *, true AS from_overflow FROM mappings_overflow UNION ALL
    SELECT *, false FROM mappings m WHERE NOT EXISTS (SELECT 1 FROM mappings_overflow o WHERE o.fp_id = m.fp_id))"""
_META = "metadata.title AS title, metadata.artist AS artist, metadata.release AS release, metadata.year AS year"
_TEXT = """CASE WHEN metadata IS NOT NULL THEN
    CASE WHEN coalesce(metadata.title, '') <> '' THEN 't=' || metadata.title || chr(10) ELSE '' END || CASE WHEN coalesce(metadata.artist, '') <> '' THEN 'a=' || metadata.artist || chr(10) ELSE '' END ||
    CASE WHEN coalesce(metadata.release, '') <> '' THEN 'r=' || metadata.release || chr(10) ELSE '' END || CASE WHEN coalesce(metadata.year, '') <> '' THEN 'y=' || metadata.year || chr(10) ELSE '' END END"""

_QBANDS = """qb AS (SELECT qid, p, k, (v >> (8 * k)) & 255 AS bv FROM (SELECT qid, unnest("values") AS v, unnest(range(len("values"))) AS p FROM queries WHERE len("values") > 0), range(4) r(k) WHERE v IS NOT NULL)"""
_OVERFLOW_BANDS = """SELECT k AS band, (v >> (8 * k)) & 255 AS band_value, fp_id, i AS pos, 1 AS late FROM (
    SELECT fp_id, unnest("values") AS v, unnest(range(len("values"))) AS i FROM fingerprints_overflow WHERE len("values") > 0), range(4) r(k)"""


def _candidates(overflow: bool = False, least: str = "greatest(3, len(q.\"values\") * 4 // 50)", k: int = 100) -> str:
    late = f" UNION ALL {_OVERFLOW_BANDS}" if overflow else ""
    return f"""WITH {_QBANDS},
post AS (SELECT band, band_value, fp_id, pos, 0 AS late FROM band_postings WHERE fp_id IS NOT NULL AND pos IS NOT NULL{late}),
qc AS (SELECT qid, k, bv, count(*) AS qn, min(p) AS q1 FROM qb GROUP BY ALL),
pc AS (SELECT band, band_value, fp_id, late, count(*) AS pn, min(pos) AS p1 FROM post GROUP BY ALL),
met AS (SELECT qid, fp_id, sum(qn * pn)::BIGINT AS matches, min((q1, k, late, p1)) AS first FROM qc JOIN pc ON k = band AND bv = band_value GROUP BY ALL),
cand AS (SELECT m.qid, m.fp_id, matches, first[1] AS qpos, first[4] AS pos FROM met m JOIN queries q USING (qid) WHERE matches >= {least}
    QUALIFY row_number() OVER (PARTITION BY m.qid ORDER BY matches DESC, m.fp_id) <= {k})
"""


def _verify(offset: str, source: str) -> str:
    """Errors of candidates (qid, fp_id, o) over the values ``source`` (fp_id, v)."""
    return f"""c AS (SELECT s.*, {offset} AS o, f.v AS cv, q."values" AS qv FROM {source} s JOIN one f USING (fp_id) JOIN queries q USING (qid)),
n AS (SELECT *, greatest(least(len(cv) - greatest(o, 0), len(qv) - greatest(-o, 0)), 0) AS n FROM c),
e AS (SELECT *, n * 32 AS bits, list_sum(list_transform(range(1, n + 1), lambda i: bit_count(xor(cv[i + greatest(o, 0)], qv[i + greatest(-o, 0)])))) AS errors FROM n WHERE n > 0),
b AS (SELECT *, errors::DOUBLE / bits AS ber, CASE WHEN errors::DOUBLE / bits < 0.15 THEN 0 WHEN errors::DOUBLE / bits < 0.25 THEN 1 WHEN errors::DOUBLE / bits < 0.35 THEN 2 ELSE 3 END AS score FROM e)"""


_ONE = 'one AS (SELECT fp_id, max("values") AS v FROM fingerprints GROUP BY fp_id)'
_ONE_OVERLAID = """one AS (SELECT fp_id, arg_max("values", added_at) AS v FROM fingerprints_overflow GROUP BY fp_id UNION ALL
    SELECT fp_id, max("values") FROM fingerprints f WHERE NOT EXISTS (SELECT 1 FROM fingerprints_overflow o WHERE o.fp_id = f.fp_id) GROUP BY fp_id)"""
_NAME = "(['strong', 'likely', 'weak', 'none'])[score + 1]"


def _band_query(cand: str, one: str = _ONE, rate: str = "0.35") -> str:
    return f"""{cand}, {one}, {_verify("(s.pos - s.qpos)", "cand")},
matched AS (SELECT qid, fp_id, ber, score::BIGINT AS score, {_NAME} AS score_name, matches, o::BIGINT AS "offset",
    row_number() OVER (PARTITION BY qid ORDER BY ber, fp_id) AS rank FROM b WHERE ber < {rate} AND score < 3)
"""


_BAND = _band_query(_candidates())
_ALL = "SELECT * FROM matched"
_XOR = """list_transform(range(2, len("values") + 1), lambda i: xor("values"[i], "values"[i - 1]))"""
_SIZES = f"""s AS (SELECT row_number() OVER () AS k, fp_id, added_at, "values", {_XOR} AS x FROM fingerprints WHERE "values" IS NOT NULL),
x AS (SELECT k, unnest(x) AS d, unnest(range(len(x))) AS i FROM s), w AS (SELECT k, d, i // 128 AS blk, CASE WHEN d = 0 THEN 0 ELSE floor(log2(d))::INT + 1 END AS w FROM x),
bw AS (SELECT k, blk, count(*) AS n, (list_sort(list(w)))[greatest(count(*) * 9 // 10, 1)] AS b FROM w GROUP BY ALL),
ex AS (SELECT k, blk, count(*) AS n_over FROM w JOIN bw USING (k, blk) WHERE w > b GROUP BY ALL),
pk AS (SELECT k, sum(2 + (n * b + 7) // 8 + 5 * coalesce(n_over, 0)) AS bytes FROM bw LEFT JOIN ex USING (k, blk) GROUP BY k),
vi AS (SELECT k, sum({_varint('d')}) AS bytes FROM x GROUP BY k),
sized AS (SELECT fp_id, added_at, len("values") AS n_values, list_sum("values") AS total, CASE WHEN len("values") = 0 THEN 0 ELSE 4 + coalesce(vi.bytes, 0) END AS varint_bytes,
    CASE WHEN len("values") = 0 THEN 0 ELSE 4 + coalesce(pk.bytes, 0) END AS packed_bytes FROM s LEFT JOIN vi USING (k) LEFT JOIN pk USING (k))"""
_GRID = """n AS (SELECT count(*) AS n FROM fingerprints), g AS (SELECT bands, bits, bands * (1::BIGINT << bits) * 12 AS est_ram FROM range(1, 9) a(bands), range(4, 17) b(bits) WHERE bands * bits <= 32),
grid AS (SELECT bands, bits, (est_ram + n * 720 * bands)::BIGINT AS est_size, est_ram, -10 * abs(bands - 4) - 10 * abs(bits - 8) AS manual, 100 * bands - 10 * bits AS speed, -bands * (1::BIGINT << bits) AS low_ram,
    (50 * bands - ((est_ram + n * 720 * bands)::BIGINT >> 20))::BIGINT AS balanced FROM g, n)"""

_LCG = """RECURSIVE l AS (SELECT DISTINCT fp_id, 0 AS k, fp_id::BIGINT AS x FROM fingerprints WHERE fp_id IS NOT NULL UNION ALL
    SELECT fp_id, k + 1, (x * 1103515245 + 12345) & 4294967295 FROM l WHERE k < 64),
idx AS (SELECT DISTINCT x & 4294967292 AS hash, fp_id, ((k - 1) // 8)::INT AS ordinal FROM l WHERE k > 0 AND (k - 1) % 8 = 0),
lq AS (SELECT fp_id AS qid, list(x ORDER BY k) AS "values" FROM l WHERE k > 16 GROUP BY fp_id)"""

SQL = {
    "query_full": _full(_INDEX, "SELECT * FROM idx") + "SELECT * FROM full_",
    "query_full_minhits_topk": _full(_INDEX, "SELECT * FROM idx", 5, 3) + "SELECT * FROM full_",
    "query_full_overflow": _full(_INDEX + ", " + _sampled("fingerprints_overflow", "ovf"), "SELECT * FROM idx UNION ALL SELECT * FROM ovf") + "SELECT * FROM full_",
    "query_full_verified": _full(_INDEX, "SELECT * FROM idx") + f", {_ONE}, {_verify('s.delta', 'full_')} SELECT qid, fp_id, hits, delta, rank, ber, score::BIGINT AS score FROM b",
    "band_search_counts": _candidates() + "SELECT qid, sum(matches)::BIGINT AS n_matches, count(*) AS n_fps FROM met GROUP BY qid",
    "band_candidates": _candidates() + "SELECT qid, fp_id, matches, qpos, pos::BIGINT AS pos FROM cand",
    "band_query": _BAND + _ALL,
    "band_query_options": _band_query(_candidates(least="10", k=20), rate="0.2") + _ALL,
    "band_query_metadata": _BAND + f""", {_MAPPED}, m1 AS (SELECT fp_id, mbid, track_id, metadata.title AS title FROM every_map WHERE fp_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY fp_id ORDER BY added_at DESC, mbid DESC NULLS LAST, track_id DESC NULLS LAST, metadata DESC NULLS LAST) = 1)
SELECT qid, fp_id, ber, score_name, mbid, track_id, title FROM matched LEFT JOIN m1 USING (fp_id)""",
    "band_query_overflow": _band_query(_candidates(True), _ONE_OVERLAID) + _ALL,
    "lcg_query": _full(_LCG, "SELECT * FROM idx", queries="lq") + "SELECT * FROM full_",
    "overlay_scan": f'WITH {_OVERLAY} SELECT fp_id, duration_ms, coalesce(len("values"), NULL) AS n_values, from_overflow FROM every',
    "lookup_fingerprint": """WITH k AS (SELECT DISTINCT fp_id FROM deleted_fps), e AS (SELECT * FROM fingerprints_overflow SEMI JOIN k USING (fp_id) UNION ALL
    SELECT * FROM (SELECT * FROM fingerprints SEMI JOIN k USING (fp_id)) ANTI JOIN fingerprints_overflow USING (fp_id))
SELECT fp_id, duration_ms, len("values") AS n_values, added_at FROM e QUALIFY row_number() OVER (PARTITION BY fp_id ORDER BY added_at DESC NULLS LAST, duration_ms DESC NULLS LAST, len("values") DESC NULLS LAST) = 1""",
    "lookup_metadata": f"WITH {_MAPPED} SELECT fp_id, mbid, track_id, {_META} FROM every_map SEMI JOIN deleted_fps USING (fp_id)",
    "lookup_hash": f"""WITH {_INDEX}, {_sampled("fingerprints_overflow", "ovf")} SELECT q.qid, q.hash, p.fp_id, p.ordinal::BIGINT AS ordinal
FROM (SELECT DISTINCT qid, v & {MASK} AS hash FROM (SELECT qid, unnest("values") AS v FROM queries)) q JOIN (SELECT * FROM idx UNION ALL SELECT * FROM ovf) p USING (hash)""",
    "iterate_mappings": f"WITH {_MAPPED} SELECT fp_id, mbid, track_id, {_META}, from_overflow FROM every_map",
    "latest_mappings": """SELECT fp_id, added_at, track_id, mbid FROM mappings WHERE fp_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY fp_id ORDER BY added_at DESC NULLS LAST, track_id DESC NULLS LAST, mbid DESC NULLS LAST) = 1""",
    "overflow_first_wins": """SELECT fp_id, added_at, len("values") AS n_values FROM fingerprints_overflow
QUALIFY row_number() OVER (PARTITION BY fp_id ORDER BY added_at NULLS FIRST, len("values") NULLS FIRST) = 1""",
    "compact_datastore": f'WITH {_OVERLAY} SELECT fp_id, duration_ms, len("values") AS n_values, CASE WHEN len("values") = 0 THEN 0 ELSE list_sum("values") END::BIGINT AS checksum FROM every',
    "compact_metadata": f"WITH {_MAPPED} SELECT fp_id, mbid, track_id, {_TEXT} AS text FROM every_map",
    "compact_posting_index": f"WITH {_OVERLAY}, {_sampled('every', 'p')} SELECT hash, fp_id, ordinal::BIGINT AS ordinal FROM p",
    "compact_search_index": f"""WITH {_OVERLAY}, v AS (SELECT fp_id, unnest("values") AS v, unnest(range(len("values"))) AS i FROM every WHERE len("values") > 0)
SELECT k * 256 + ((v >> (8 * k)) & 255) AS bucket, k AS band, (v >> (8 * k)) & 255 AS band_value, fp_id, i AS pos FROM v, range(4) r(k) WHERE v IS NOT NULL""",
    "sampled_postings_build": f"WITH {_sampled('fingerprints', 'p')} SELECT hash, fp_id, ordinal::BIGINT AS ordinal FROM p",
    "posting_stats": f"WITH {_INDEX} SELECT count(DISTINCT hash) AS bucket_count, count(*) AS total_postings, (count(*) // count(DISTINCT hash))::BIGINT AS avg_per_bucket FROM idx",
    "posting_buckets": f"WITH {_INDEX} SELECT hash, count(*) AS n_postings FROM idx GROUP BY hash",
    "posting_bucket_sizes": f"""WITH {_INDEX}, d AS (SELECT hash, fp_id - coalesce(lag(fp_id) OVER (PARTITION BY hash ORDER BY fp_id, ordinal), 0) AS d FROM idx),
h AS (SELECT hash, hash - lag(hash, 1, 0) OVER (ORDER BY hash) AS g FROM (SELECT DISTINCT hash FROM idx)),
v AS (SELECT hash, count(*) AS n, sum({_varint('d')}) AS b FROM d GROUP BY hash)
SELECT hash, n AS n_postings, (b + n + {_varint('n')} + {_varint('g')})::BIGINT AS n_bytes FROM v JOIN h USING (hash)""",
    "skip_directory": f"WITH {_INDEX}, r AS (SELECT hash, row_number() OVER (ORDER BY hash) - 1 AS r FROM (SELECT DISTINCT hash FROM idx)) SELECT (r // 64)::BIGINT AS entry, hash FROM r WHERE r % 64 = 0",
    "extract_bands": """WITH v AS (SELECT fp_id, unnest("values") AS v, unnest(range(len("values"))) AS p FROM fingerprints WHERE len("values") > 0)
SELECT fp_id, p AS pos, k AS band, (v >> (8 * k)) & 255 AS band_value FROM v, range(4) r(k) WHERE v IS NOT NULL""",
    "band_directory": """WITH v AS (SELECT unnest("values") AS v FROM fingerprints WHERE len("values") > 0)
SELECT (k * 256 + ((v >> (8 * k)) & 255))::INT AS bucket, count(*) AS n_postings FROM v, range(4) r(k) WHERE v IS NOT NULL GROUP BY 1""",
    "band_stats": "SELECT 1024::BIGINT AS total_buckets, count(*) AS total_postings, count(*) // 1024 AS avg_per_bucket FROM band_postings",
    "band_posting_lists": f"""WITH {_QBANDS}, b AS (SELECT DISTINCT k * 256 + bv AS bucket FROM qb)
SELECT bucket::BIGINT AS bucket, fp_id, pos::BIGINT AS pos FROM (SELECT bucket, fp_id, pos FROM band_postings
    UNION ALL SELECT band * 256 + band_value, fp_id, pos FROM ({_OVERFLOW_BANDS})) SEMI JOIN b USING (bucket)""",
    "hamming_pairs": f"""WITH a AS (SELECT fp_id, max("values") AS x FROM fingerprints GROUP BY fp_id), b AS (SELECT fp_id, max("values") AS y FROM fingerprints_overflow GROUP BY fp_id),
n AS (SELECT fp_id, x, y, least(len(x), len(y)) AS n FROM a JOIN b USING (fp_id)),
e AS (SELECT fp_id, n * 32 AS bits, list_sum(list_transform(range(1, n + 1), lambda i: bit_count(xor(x[i], y[i]))))::BIGINT AS errors FROM n WHERE n > 0),
s AS (SELECT *, errors::DOUBLE / bits AS ber, CASE WHEN errors::DOUBLE / bits < 0.15 THEN 0 WHEN errors::DOUBLE / bits < 0.25 THEN 1 WHEN errors::DOUBLE / bits < 0.35 THEN 2 ELSE 3 END AS score FROM e)
SELECT fp_id, bits, errors, ber, {_NAME} AS score_name FROM s""",
    "xor_deltas": f'WITH x AS (SELECT fp_id, added_at, {_XOR} AS x FROM fingerprints WHERE len("values") > 1) SELECT fp_id, added_at, unnest(range(len(x))) AS pos, unnest(x) AS delta FROM x',
    "encoded_sizes": f"WITH {_SIZES} SELECT fp_id, added_at, n_values, varint_bytes::BIGINT AS varint_bytes, packed_bytes::BIGINT AS packed_bytes FROM sized",
    "codec_roundtrip_varint": f"WITH {_SIZES} SELECT fp_id, added_at, varint_bytes::BIGINT AS n_bytes, n_values, coalesce(total, 0)::BIGINT AS checksum FROM sized",
    "codec_roundtrip_packed": f"WITH {_SIZES} SELECT fp_id, added_at, packed_bytes::BIGINT AS n_bytes, n_values, coalesce(total, 0)::BIGINT AS checksum FROM sized",
    "string_pool_encode": f"SELECT fp_id, mbid, added_at, {_TEXT} AS text FROM (SELECT * FROM mappings UNION ALL SELECT * FROM mappings_overflow)",
    "string_pool_parse": """SELECT fp_id, mbid, added_at, CASE WHEN metadata IS NOT NULL THEN coalesce(metadata.title, '') END AS title, CASE WHEN metadata IS NOT NULL THEN coalesce(metadata.artist, '') END AS artist,
CASE WHEN metadata IS NOT NULL THEN coalesce(metadata.release, '') END AS release, CASE WHEN metadata IS NOT NULL THEN coalesce(metadata.year, '') END AS year FROM (SELECT * FROM mappings UNION ALL SELECT * FROM mappings_overflow)""",
    "dataset_stats": """SELECT a.n AS record_count, b.n AS overflow_count, c.n AS metadata_count, b.n > 0 AS has_overflow, true AS has_data_store, true AS has_metadata, true AS has_search_index, true AS has_posting_index
FROM (SELECT count(*) AS n FROM fingerprints) a, (SELECT count(*) AS n FROM fingerprints_overflow) b, (SELECT count(*) AS n FROM mappings) c""",
    "needs_compaction": """SELECT b.n / a.n >= t / 100 AS needs_compaction, t AS threshold_pct
FROM (SELECT count(*)::DOUBLE AS n FROM fingerprints) a, (SELECT count(*)::DOUBLE AS n FROM fingerprints_overflow) b, (SELECT unnest([1.0, 5.0, 10.0, 50.0])::DOUBLE AS t)""",
    "autotune_grid": f"WITH {_GRID} SELECT bands, bits, est_size, est_ram, manual::BIGINT AS manual, speed::BIGINT AS speed, low_ram::BIGINT AS low_ram, balanced FROM grid",
    "autotune_choice": f"""WITH {_GRID}, s AS (SELECT 'manual' AS strategy, bands, bits, manual AS score FROM grid UNION ALL SELECT 'speed', bands, bits, speed FROM grid
    UNION ALL SELECT 'low_ram', bands, bits, low_ram FROM grid UNION ALL SELECT 'balanced', bands, bits, balanced FROM grid)
SELECT strategy, bands, bits FROM s QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY score DESC, bits, bands) = 1""",
}
