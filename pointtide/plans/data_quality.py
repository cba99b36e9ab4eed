"""Queries on faulty readings and on schemas, with the SQL they are checked against."""

from __future__ import annotations

from ..util import read


def p6_found(spark, d):
    from ..operators.spikes import faulty_readings

    return faulty_readings(read(spark, d, "splats"), read(spark, d, "trajectories"), read(spark, d, "chunk_groups"))


def _drift(spark, d):
    from ..operators.drift import Drift

    return Drift(read(spark, d, "ply_files"), read(spark, d, "ply_properties"), read(spark, d, "ply_vertices"))


def p3_found(spark, d):
    return _drift(spark, d).changes


def p3_unified(spark, d):
    return _drift(spark, d).unified()


def p3_cells(spark, d):
    """The unified table by cells."""
    return _drift(spark, d).cells()


QUERIES = {f.__name__: f for f in (p3_found, p3_unified, p3_cells, p6_found)}

_CANON = "CASE lower(trim(prop_type)) WHEN 'char' THEN 'int8' WHEN 'uchar' THEN 'uint8' WHEN 'short' THEN 'int16' WHEN 'ushort' THEN 'uint16' WHEN 'int' THEN 'int32' WHEN 'uint' THEN 'uint32' WHEN 'float' THEN 'float32' WHEN 'double' THEN 'float64' ELSE nullif(lower(trim(prop_type)), '') END"

# without sketches and matching: on these tables no property carries on into two others
_DRIFT = f"""WITH RECURSIVE f AS (SELECT DISTINCT file_id, sequence_id AS q, frame_no AS k FROM ply_files),
fr AS (SELECT q, k, min(file_id) AS file, row_number() OVER (PARTITION BY q ORDER BY k) AS n FROM f GROUP BY q, k),
p AS (SELECT file_id, prop_name AS name, min(ordinal) AS o, max({_CANON}) AS type FROM ply_properties WHERE prop_name IS NOT NULL GROUP BY ALL),
h AS (SELECT q, n, fr.k, name, max(type) AS type, min(file_id) AS file, min_by(o, file_id) AS o FROM p JOIN f USING (file_id) JOIN fr USING (q, k) GROUP BY ALL),
came AS (SELECT * FROM h WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM h b WHERE b.q = h.q AND b.n = h.n - 1 AND b.name = h.name)),
gone AS (SELECT h.*, fr.k AS k2 FROM h JOIN fr ON fr.q = h.q AND fr.n = h.n + 1 WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.q = h.q AND b.n = h.n + 1 AND b.name = h.name)),
v AS (SELECT DISTINCT file_id, row_no, string_split(trim(regexp_replace(line, '\\s+', ' ', 'g')), ' ') AS w FROM ply_vertices WHERE line IS NOT NULL),
pair AS (SELECT g.q, c.n, c.k, g.name AS old, c.name AS new, TRY_CAST(va.w[g.o + 1] AS DOUBLE) AS a, TRY_CAST(vb.w[c.o + 1] AS DOUBLE) AS b FROM gone g JOIN came c ON c.q = g.q AND c.n = g.n + 1 JOIN v va ON va.file_id = g.file JOIN v vb ON vb.file_id = c.file AND vb.row_no = va.row_no),
ren AS (SELECT q, n, k, old, new FROM pair GROUP BY ALL HAVING avg(abs(a - b)) / greatest(stddev_pop(a), avg(abs(a)) * 1e-9, 1e-9) <= 0.15),
st AS (SELECT q, n, k, name, type AS known, false AS re, name AS first FROM h WHERE n = 1 UNION ALL SELECT q, n, k, name, type, false, name FROM came WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.q = came.q AND ren.n = came.n AND ren.new = came.name)
UNION ALL SELECT h.q, h.n, h.k, h.name, coalesce(h.type, st.known), coalesce(h.type <> st.known, false), st.first FROM st JOIN h ON h.q = st.q AND h.n = st.n + 1 AND (h.name = st.name OR EXISTS (SELECT 1 FROM ren WHERE ren.q = h.q AND ren.n = h.n AND ren.old = st.name AND ren.new = h.name)))
"""
SQL = {
    "p3_found": _DRIFT + """SELECT q AS sequence_id, k AS frame_no, 'renamed' AS change_kind, new AS prop_name FROM ren
UNION ALL SELECT q, k, 'added', name FROM came WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.q = came.q AND ren.n = came.n AND ren.new = came.name)
UNION ALL SELECT q, k2, 'removed', name FROM gone WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.q = gone.q AND ren.n = gone.n + 1 AND ren.old = gone.name)
UNION ALL SELECT q, k, 'retyped', name FROM st WHERE re""",
    # a property is named as it was first named; every vertex of a frame counts in the file with the smallest id that holds it
    "p3_cells": _DRIFT + """, fs AS (SELECT q, k, min(file_id) AS file FROM f GROUP BY ALL),
pr AS (SELECT q, k, any_value(file) AS file, first AS property, min(p.o) AS o FROM st JOIN fs USING (q, k) JOIN p ON p.file_id = fs.file AND p.name = st.name GROUP BY q, k, first)
SELECT q AS sequence_id, k AS frame_no, row_no, property, min(TRY_CAST(w[o + 1] AS DOUBLE)) AS value FROM pr JOIN v ON v.file_id = pr.file GROUP BY ALL""",
    "p6_found": """
WITH s AS (SELECT DISTINCT splat_id AS k, capture_id AS c, chunk_id, record_id, positions AS p, scales AS sc FROM splats),
sp AS (SELECT * FROM s WHERE p IS NOT NULL),
spok AS (SELECT k, c, chunk_id, p[1]::DOUBLE AS x, p[2]::DOUBLE AS y, p[3]::DOUBLE AS z FROM sp WHERE isfinite(p[1]) AND isfinite(p[2]) AND isfinite(p[3])),
mid AS (SELECT chunk_id, median(x) AS mx, median(y) AS my, median(z) AS mz FROM spok GROUP BY chunk_id),
spr AS (SELECT k, c, sqrt((x-mx)*(x-mx)+(y-my)*(y-my)+(z-mz)*(z-mz)) AS r FROM spok JOIN mid USING (chunk_id)),
spm AS (SELECT c, median(r) AS m FROM spr GROUP BY c),
ss AS (SELECT *, isfinite(sc[1]) AND isfinite(sc[2]) AND isfinite(sc[3]) AND sc[1] > 0 AND sc[2] > 0 AND sc[3] > 0 AS ok FROM s WHERE sc IS NOT NULL),
ssr AS (SELECT k, c, greatest(sc[1], sc[2], sc[3])::DOUBLE AS r FROM ss WHERE ok),
ssm AS (SELECT c, median(r) AS m FROM ssr GROUP BY c),
sst AS (SELECT *, CASE WHEN lag(record_id) OVER w = record_id - 1 AND lag(sc) OVER w = sc THEN 0 ELSE 1 END AS fresh FROM ss WINDOW w AS (PARTITION BY chunk_id ORDER BY record_id)),
sisl AS (SELECT *, sum(fresh) OVER (PARTITION BY chunk_id ORDER BY record_id ROWS UNBOUNDED PRECEDING) AS isl FROM sst),
srun AS (SELECT k, count(*) OVER (PARTITION BY chunk_id, isl) AS n FROM sisl),
t AS (SELECT DISTINCT vec_id AS k, capture_id AS c, positions AS p FROM trajectories WHERE len(positions) = 24),
tf AS (SELECT *, isfinite(list_sum(p::DOUBLE[])) AS ok FROM t),
tm AS (SELECT k, c, p, median(p[3*i+1]::DOUBLE) AS mx, median(p[3*i+2]::DOUBLE) AS my, median(p[3*i+3]::DOUBLE) AS mz FROM tf, range(8) r(i) WHERE ok GROUP BY k, c, p),
tr AS (SELECT k, c, max(sqrt((p[3*i+1]::DOUBLE-mx)**2 + (p[3*i+2]::DOUBLE-my)**2 + (p[3*i+3]::DOUBLE-mz)**2)) AS r FROM tm, range(8) r(i) GROUP BY k, c),
tmed AS (SELECT c, median(r) AS m FROM tr GROUP BY c),
th AS (SELECT DISTINCT k FROM tf, range(4) r(i) WHERE p[3*i+1:3*i+12] = p[3*i+4:3*i+15]),
b AS (SELECT DISTINCT block_id AS k, capture_id AS c, chunk_index, group_no, trajectory_min AS lo, trajectory_max AS r FROM chunk_groups WHERE trajectory_max IS NOT NULL),
bf AS (SELECT *, isfinite(r) AND NOT coalesce(r < lo, false) AS ok FROM b),
bm AS (SELECT c, median(r) AS m FROM bf WHERE ok GROUP BY c),
bst AS (SELECT *, CASE WHEN lag(chunk_index) OVER w = chunk_index - 1 AND lag(r) OVER w = r THEN 0 ELSE 1 END AS fresh FROM b WINDOW w AS (PARTITION BY c, group_no ORDER BY chunk_index)),
bisl AS (SELECT *, sum(fresh) OVER (PARTITION BY c, group_no ORDER BY chunk_index ROWS UNBOUNDED PRECEDING) AS isl FROM bst),
brun AS (SELECT k, count(*) OVER (PARTITION BY c, group_no, isl) AS n FROM bisl)
SELECT 'splats' AS table_name, k AS row_key, 'positions' AS field_name FROM sp WHERE NOT (isfinite(p[1]) AND isfinite(p[2]) AND isfinite(p[3]))
UNION SELECT 'splats', k, 'positions' FROM spr JOIN spm USING (c) WHERE r > 7 * m
UNION SELECT 'splats', k, 'scales' FROM ss WHERE NOT ok
UNION SELECT 'splats', k, 'scales' FROM ssr JOIN ssm USING (c) WHERE r > 7 * m OR r < m / 7
UNION SELECT 'splats', k, 'scales' FROM srun WHERE n >= 6
UNION SELECT 'trajectories', k, 'positions' FROM tf WHERE NOT ok
UNION SELECT 'trajectories', k, 'positions' FROM tr JOIN tmed USING (c) WHERE r > 7 * m
UNION SELECT 'trajectories', k, 'positions' FROM th
UNION SELECT 'chunk_groups', k, 'trajectory_max' FROM bf WHERE NOT ok
UNION SELECT 'chunk_groups', k, 'trajectory_max' FROM bf JOIN bm USING (c) WHERE ok AND (r > 7 * m OR r < m / 7)
UNION SELECT 'chunk_groups', k, 'trajectory_max' FROM brun WHERE n >= 4
""",
}
