"""Queries of the subpackage, by name."""

from __future__ import annotations

import os

from ..util import read

#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("POINTTIDE_TOKENIZERS", "/opt/tokenizers")
ALIKE = [("positions", 3, 1.0), ("color_dc", 3, 0.5)]


def p1_found(spark, d):
    from .neighbours import similar_pairs

    return similar_pairs(read(spark, d, "trajectories"), "vec_id", "positions", 24, 5)


def _pieces(spark, d, later):
    from .pieces import split_oversized

    return split_oversized(read(spark, d, "chunk_samples"), "chunk_id", "interval_no", "tick", "stored_size", ("generation", "take_label"), 4_000_000, 2, later)


def p2_found(spark, d):
    return _pieces(spark, d, 0.0)


def p2_balanced(spark, d):
    return _pieces(spark, d, 1.0)


def p4_found(spark, d):
    from .clusters import similarity_clusters

    return similarity_clusters(read(spark, d, "splats"), "splat_id", ALIKE, 0.06, 6)


def p4_clusters(spark, d):
    from .clusters import describe_clusters

    return describe_clusters(read(spark, d, "splats"), p4_found(spark, d), "splat_id", ALIKE)


def p4_leaves(spark, d):
    from .clusters import bisecting_leaves

    return bisecting_leaves(read(spark, d, "splats"), "splat_id", ALIKE, leaf_rows=2_000, compact=0.25)


PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _percentiles(spark, d, ps, keep):
    from pyspark.sql import functions as F

    from .percentiles import percentiles

    fields = {f"scale_{i}": F.col("scales")[i] for i in range(3)} | {"opacity": F.col("opacity")}
    args = "splat_id", "capture_id", "observed_at", fields, ps
    return percentiles(read(spark, d, "splats"), *args, keep=keep), args


def p5_percentiles(spark, d):
    return _percentiles(spark, d, PERCENTILES, 2000)[0]


def p5_compressed(spark, d):
    """Summaries of 100 values, so that most are compressed and merged with error; every stated error is held against the true ranks."""
    from .percentiles import rank_check

    found, args = _percentiles(spark, d, PERCENTILES, 100)
    return rank_check(read(spark, d, "splats"), found, *args, 100)


def p7_ids(spark, d, path=TOKENIZERS + "/byte_bpe_50k.tiktoken"):
    from .tokens import encode_corpus

    return encode_corpus(read(spark, d, "documents"), "doc_id", "text", path)


def p8_found(spark, d):
    from .leaks import leaked

    return leaked(read(spark, d, "documents"), "doc_id", "text", read(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark, d):
    from .garbled import garbled_documents

    return garbled_documents(read(spark, d, "documents"), "doc_id", "text")


def p9_restored(spark, d):
    from .garbled import restored_documents

    return restored_documents(read(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_balanced, p4_found, p4_clusters, p4_leaves, p5_percentiles, p5_compressed, p7_ids, p8_found, p9_found, p9_restored)}
#: The SQL of p1 compares all pairs of vectors, that of p4 follows all links; both are bearable on the small tables only. That of p5
#: ranks all values, which the summaries equal as long as no group has more than they keep.
_INTERVALS = """WITH RECURSIVE d AS (SELECT chunk_id, interval_no AS i, min(tick) AS tick, min(stored_size) AS sz, min(generation) AS gen, min(take_label) AS label FROM chunk_samples GROUP BY ALL),
big AS (SELECT chunk_id, count(*) AS n, sum(sz) AS total FROM d GROUP BY chunk_id HAVING sum(sz) > 4000000),
f AS (SELECT d.chunk_id, i, tick, sz, n, gen, coalesce(last_value(label IGNORE NULLS) OVER w, NULL) AS lab, sum(sz) OVER w AS upto FROM d JOIN big ON d.chunk_id = big.chunk_id WINDOW w AS (PARTITION BY d.chunk_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, upto - sz AS before, i > 0 AND (gen <> lag(gen) OVER w OR lab IS DISTINCT FROM lag(lab) OVER w) AS nat FROM f WINDOW w AS (PARTITION BY chunk_id ORDER BY i)),
ends AS (SELECT chunk_id, i AS e, before AS p, nat FROM g UNION ALL SELECT chunk_id, n, total, true FROM big),
s AS (SELECT c.chunk_id, c.i AS c, min(a.i) AS s FROM g c JOIN g a ON a.chunk_id = c.chunk_id AND a.i BETWEEN c.i - 2 AND c.i AND (a.i = c.i OR c.upto - a.before <= 4000000) GROUP BY ALL),"""
_VALUES = """WITH s AS (SELECT DISTINCT splat_id, capture_id, observed_at::DATE AS day, scales, opacity FROM splats),
v AS (SELECT capture_id, day, 'scale_' || i AS field, scales[i + 1]::DOUBLE AS v FROM s, range(3) r(i) WHERE isfinite(scales[i + 1]) UNION ALL SELECT capture_id, day, 'opacity', opacity::DOUBLE FROM s WHERE isfinite(opacity)),
g AS (SELECT 'day' AS level, capture_id, day, field, list_sort(list(v)) AS l FROM v GROUP BY ALL UNION ALL SELECT 'all', capture_id, NULL, field, list_sort(list(v)) FROM v GROUP BY ALL),
q AS (SELECT p::DOUBLE AS p FROM (VALUES (0.01), (0.05), (0.25), (0.5), (0.75), (0.95), (0.99)) q(p))
"""
SQL: dict[str, str] = {
    "p1_found": """
WITH t AS (SELECT DISTINCT vec_id AS k, positions::DOUBLE[] AS p FROM trajectories WHERE len(positions) = 24 AND isfinite(list_sum(positions::DOUBLE[]))),
q AS (SELECT a.k AS a, b.k AS b, list_distance(a.p, b.p) AS d FROM t a JOIN t b ON a.k <> b.k),
n AS (SELECT a, b FROM q QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5)
SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM n""",
    "p2_found": _INTERVALS + """
far AS (SELECT s.chunk_id, c, s, max(e) AS far, max(e) FILTER (ends.nat) AS last FROM s JOIN g ON g.chunk_id = s.chunk_id AND g.i = s JOIN ends ON ends.chunk_id = s.chunk_id AND e > c AND (p - g.before <= 4000000 OR e = c + 1) GROUP BY ALL),
nxt AS (SELECT chunk_id, c, s, coalesce(last, far) AS e FROM far),
walk AS (SELECT chunk_id, c, s, e FROM nxt WHERE c = 0 UNION ALL SELECT n.chunk_id, n.c, n.s, n.e FROM walk w JOIN nxt n ON n.chunk_id = w.chunk_id AND n.c = w.e)
SELECT w.chunk_id, g.tick AS piece_start_tick, (w.e - w.s)::BIGINT AS piece_intervals FROM walk w JOIN g ON g.chunk_id = w.chunk_id AND g.i = w.s""",
    # costs from the last position to the first, each list holding those of the positions behind
    "p2_balanced": _INTERVALS + """
o AS (SELECT s.chunk_id, c, s, list(CASE WHEN ends.nat THEN 0 ELSE 4 * 4000000::HUGEINT * 4000000 END + (4000000 - least(p - g.before, 4000000))::HUGEINT * (4000000 - least(p - g.before, 4000000)) ORDER BY e) AS own
FROM s JOIN g ON g.chunk_id = s.chunk_id AND g.i = s JOIN ends ON ends.chunk_id = s.chunk_id AND e > c AND (p - g.before <= 4000000 OR e = c + 1) GROUP BY ALL),
w AS (SELECT chunk_id, n AS c, NULL::BIGINT AS s, NULL::BIGINT AS e, [0::HUGEINT] AS cost FROM big
UNION ALL SELECT chunk_id, c, s, c + len(t) - list_position(list_reverse(t), list_min(t)) + 1, list_prepend(list_min(t), cost) FROM (SELECT o.chunk_id, o.c, o.s, w.cost, [own[k] + w.cost[k] for k in range(1, len(own) + 1)] AS t FROM w JOIN o ON o.chunk_id = w.chunk_id AND o.c = w.c - 1)),
walk AS (SELECT chunk_id, c, s, e FROM w WHERE c = 0 UNION ALL SELECT n.chunk_id, n.c, n.s, n.e FROM walk v JOIN w n ON n.chunk_id = v.chunk_id AND n.c = v.e AND n.s IS NOT NULL)
SELECT v.chunk_id, g.tick AS piece_start_tick, (v.e - v.s)::BIGINT AS piece_intervals FROM walk v JOIN g ON g.chunk_id = v.chunk_id AND g.i = v.s""",
    "p4_found": """
WITH RECURSIVE t AS (SELECT DISTINCT splat_id AS k, positions[1]::DOUBLE AS x, positions[2]::DOUBLE AS y, positions[3]::DOUBLE AS z, color_dc[1]::DOUBLE / 2 AS r, color_dc[2]::DOUBLE / 2 AS g, color_dc[3]::DOUBLE / 2 AS b FROM splats
WHERE isfinite(positions[1]) AND isfinite(positions[2]) AND isfinite(positions[3]) AND isfinite(color_dc[1]) AND isfinite(color_dc[2]) AND isfinite(color_dc[3])),
c AS (SELECT *, floor(x / 0.0601) AS cx, floor(y / 0.0601) AS cy, floor(z / 0.0601) AS cz FROM t),
o AS (SELECT i FROM (VALUES (-1), (0), (1)) v(i)), m AS (SELECT c.*, cx + a.i AS nx, cy + e.i AS ny, cz + f.i AS nz FROM c, o a, o e, o f),
e AS (SELECT m.k AS a, c.k AS b FROM m JOIN c ON m.nx = c.cx AND m.ny = c.cy AND m.nz = c.cz WHERE m.k <> c.k AND (m.x-c.x)*(m.x-c.x) + (m.y-c.y)*(m.y-c.y) + (m.z-c.z)*(m.z-c.z) + (m.r-c.r)*(m.r-c.r) + (m.g-c.g)*(m.g-c.g) + (m.b-c.b)*(m.b-c.b) <= 0.06::DOUBLE * 0.06::DOUBLE),
reach AS (SELECT DISTINCT a, a AS b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
l AS (SELECT a AS splat_id, min(b) AS cluster_id FROM reach GROUP BY a)
SELECT splat_id, cluster_id FROM l QUALIFY count(*) OVER (PARTITION BY cluster_id) >= 6""",
    "p5_percentiles": _VALUES + """SELECT level, capture_id, day, field, len(l)::BIGINT AS n, p, l[greatest(1, ceil(p * len(l) - 1e-9))::BIGINT] AS value, 0::BIGINT AS rank_error FROM g, q""",
    # the query counts true ranks itself; here stand the groups and what must hold for each
    "p5_compressed": _VALUES + """SELECT level, capture_id, day, field, len(l)::BIGINT AS n, p, true AS within, true AS bounded FROM g, q""",
    # words without compatibility decomposition, which no passage of the items needs; it changes what few texts hold of signs
    "p8_found": """
WITH d AS (SELECT DISTINCT doc_id AS k, text FROM documents WHERE text IS NOT NULL), i AS (SELECT DISTINCT item_id AS k, text FROM eval_items WHERE text IS NOT NULL),
dw AS (SELECT k, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM d), iw AS (SELECT k, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM i),
dg AS (SELECT DISTINCT k, unnest([w[j:j + 11] for j in range(1, len(w) - 10)]) AS g FROM dw WHERE len(w) >= 12), ig AS (SELECT DISTINCT k, unnest([w[j:j + 11] for j in range(1, len(w) - 10)]) AS g FROM iw WHERE len(w) >= 12)
SELECT DISTINCT dg.k AS doc_id, ig.k AS item_id FROM dg JOIN ig USING (g)""",
}
