"""SQL (DuckDB) that gives the same rows as the queries of the same name."""

from __future__ import annotations


def current(name: str, columns: str) -> str:
    """Current rows of an element table, as SQL."""
    return f"(SELECT id, max(info.version) AS version, arg_max(changetype, coalesce(info.version, -1)) AS ct, {', '.join(f'arg_max({c}, coalesce(info.version, -1)) AS {c}' for c in columns.split())} FROM {name} WHERE id IS NOT NULL GROUP BY id)"


#: arg_max skips rows whose value is null; in a struct the value is never null
def current_whole(name: str, columns: str) -> str:
    fields = ", ".join(f"'{c}': {c}" for c in columns.split())
    return f"(SELECT id, r.v AS version, r.ct AS ct, {', '.join(f'r.{c} AS {c}' for c in columns.split())} FROM (SELECT id, arg_max({{'v': info.version, 'ct': changetype, {fields}}}, coalesce(info.version, -1)) AS r FROM {name} WHERE id IS NOT NULL GROUP BY id))"


P1 = f"""
WITH n AS (SELECT id, lon / 1e7 AS lon, lat / 1e7 AS lat FROM {current_whole("osm_nodes", "lon lat")}
           WHERE coalesce(ct NOT IN (1, 2), true) AND abs(lon) <= 1800000000 AND abs(lat) <= 900000000),
     u AS (SELECT id, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM n),
     g AS (SELECT *, floor(x * 600000)::BIGINT AS gx, floor(y * 600000)::BIGINT AS gy, floor(z * 600000)::BIGINT AS gz FROM u),
     s AS (SELECT g.*, gx + a.d AS hx, gy + b.d AS hy, gz + c.d AS hz FROM g, (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d))
SELECT g.id AS id_a, s.id AS id_b FROM g JOIN s ON g.gx = s.hx AND g.gy = s.hy AND g.gz = s.hz
WHERE g.id < s.id AND sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2 + (g.z - s.z) ** 2) <= 2 * sin(5 / 6371008.8 / 2)
"""

P2 = """
WITH v AS (SELECT type, id, info.version AS version, min(info.timestamp) AS t, bool_or(coalesce(info.visible, false)) AS vis
           FROM info_snapshots WHERE info IS NOT NULL AND info.timestamp IS NOT NULL AND info.version IS NOT NULL AND type IS NOT NULL AND id IS NOT NULL GROUP BY ALL)
SELECT type, id, version, valid_from, valid_to FROM (SELECT type, id, version, vis, t AS valid_from, coalesce(lead(t) OVER (PARTITION BY type, id ORDER BY version), -1) AS valid_to FROM v) WHERE vis
"""

_LINKS = f"""
live AS (SELECT * FROM {current_whole("osm_relations", "members")} WHERE coalesce(ct NOT IN (1, 2), true)),
links AS (SELECT DISTINCT l.id AS parent, m.ref AS child FROM (SELECT id, unnest(members) AS m FROM live) l JOIN live c ON l.m.type = 2 AND l.m.ref = c.id),
ids AS (SELECT parent AS id FROM links UNION SELECT child FROM links),
tree(id, root_id, depth, path) AS (
    SELECT id, id, 0::BIGINT, id::VARCHAR FROM ids WHERE id NOT IN (SELECT child FROM links)
    UNION ALL SELECT k.child, t.root_id, t.depth + 1, t.path || '/' || k.child FROM tree t JOIN links k ON k.parent = t.id)
"""

P3 = f"""
WITH RECURSIVE {_LINKS}
SELECT * FROM tree UNION ALL SELECT id, -1, -1, 'cycle' FROM ids WHERE id NOT IN (SELECT id FROM tree)
"""

P3_RANGES = f"""
WITH RECURSIVE {_LINKS},
up AS (SELECT id, id AS top FROM tree UNION ALL SELECT u.id, k.parent FROM up u JOIN links k ON k.child = u.top)
SELECT top AS id, count(*) - 1 AS descendants FROM up GROUP BY top
"""

_REFS = """
refs AS (
    SELECT DISTINCT * FROM (
        SELECT 1 AS src_type, id AS src_id, 0 AS ref_type, unnest(refs) AS ref_id FROM osm_ways WHERE coalesce(changetype NOT IN (1, 2), true)
        UNION ALL SELECT 2, id, m.type, m.ref FROM (SELECT id, unnest(members) AS m FROM osm_relations WHERE coalesce(changetype NOT IN (1, 2), true)))
    WHERE src_id IS NOT NULL AND ref_type IS NOT NULL AND ref_id IS NOT NULL),
base AS (SELECT kind, id, bool_or(coalesce(ct NOT IN (1, 2), true)) AS live FROM (
    SELECT 0 AS kind, id, changetype AS ct FROM osm_nodes UNION ALL SELECT 1, id, changetype FROM osm_ways UNION ALL SELECT 2, id, changetype FROM osm_relations) GROUP BY ALL),
late AS (SELECT DISTINCT type AS kind, id FROM osm_changes WHERE changetype IN (3, 4, 5)),
orphans AS (SELECT r.*, CASE WHEN l.id IS NOT NULL THEN 'late' WHEN b.id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
    FROM refs r LEFT JOIN base b ON b.kind = r.ref_type AND b.id = r.ref_id LEFT JOIN late l ON l.kind = r.ref_type AND l.id = r.ref_id
    WHERE coalesce(NOT b.live, true))
"""

P5 = f"WITH {_REFS} SELECT * FROM orphans"

P5_REPORT = f"""
WITH {_REFS},
times AS (SELECT 1 AS src_type, id AS src_id, strftime(make_timestamp(info.timestamp * 1000000), '%Y-%m') AS period FROM {current_whole("osm_ways", "info")}
    UNION ALL SELECT 2, id, strftime(make_timestamp(info.timestamp * 1000000), '%Y-%m') FROM {current_whole("osm_relations", "info")})
SELECT src_type, ref_type, period, state, count(*) AS orphans FROM orphans LEFT JOIN times USING (src_type, src_id) GROUP BY ALL
"""

P6 = "SELECT qt FROM qt_items WHERE qt >= 0 GROUP BY qt HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM qt_items)"

P6_TOTALS = "SELECT qt, count(*) AS n, sum(weight)::BIGINT AS total FROM qt_items GROUP BY qt"

P7 = """
WITH acts AS (SELECT id, info.version AS v, 1 AS side, file_idx, changetype IN (4, 5) AS there FROM osm_changes WHERE type = 0 AND changetype IN (1, 4, 5) AND id IS NOT NULL),
rows AS (SELECT * FROM acts UNION ALL SELECT id, info.version, 0, 0, coalesce(changetype NOT IN (1, 2), true) FROM osm_nodes WHERE id IN (SELECT id FROM acts))
SELECT id, v AS version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(v, -1) DESC, side DESC, file_idx DESC, there DESC) AS nth FROM rows) WHERE nth = 1 AND there
"""

P1_REGIONS = f"""
WITH n AS (SELECT id, lon, lat FROM {current_whole("osm_nodes", "lon lat")} WHERE coalesce(ct NOT IN (1, 2), true) AND abs(lon) <= 1800000000 AND abs(lat) <= 900000000),
     w AS (SELECT id, refs FROM {current_whole("osm_ways", "refs")} WHERE coalesce(ct NOT IN (1, 2), true) AND len(refs) > 3 AND refs[1] = refs[-1]),
     p AS (SELECT w.id, pos, n.lon, n.lat FROM (SELECT id, unnest(refs) AS node, generate_subscripts(refs, 1) AS pos FROM w) w LEFT JOIN n ON n.id = w.node),
     r AS (SELECT id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM p GROUP BY id HAVING count(lon) = count(*)),
     e AS (SELECT id, lon AS ax, lat AS ay, lag(lon) OVER o AS bx, lag(lat) OVER o AS b_y FROM p WHERE id IN (SELECT id FROM r) WINDOW o AS (PARTITION BY id ORDER BY pos)),
     near AS (SELECT r.id AS region_id, n.id, n.lon, n.lat FROM n JOIN r ON n.lon BETWEEN x0 AND x1 AND n.lat BETWEEN y0 AND y1)
SELECT region_id, near.id FROM near JOIN e ON e.id = region_id AND (ay > near.lat) <> (b_y > near.lat) AND near.lon < (bx - ax)::DOUBLE * (near.lat - ay) / (b_y - ay) + ax
GROUP BY ALL HAVING count(*) % 2 = 1
"""

P2_ATTRIBUTES = """
WITH s AS (SELECT type, id, snapshot_idx, first_date AS day, max(struct_pack(version := info.version, changeset := info.changeset, user_id := info.user_id, visible := info.visible)) AS a
           FROM (SELECT *, min(snapshot_date) OVER (PARTITION BY type, id, snapshot_idx) AS first_date, row_number() OVER (PARTITION BY type, id, snapshot_idx ORDER BY info.version DESC NULLS LAST, info.changeset DESC NULLS LAST, info.user_id DESC NULLS LAST, info.visible DESC NULLS LAST) AS nth FROM info_snapshots
                 WHERE info IS NOT NULL AND type IS NOT NULL AND id IS NOT NULL AND snapshot_idx IS NOT NULL AND snapshot_date IS NOT NULL) WHERE nth = 1 GROUP BY ALL),
     m AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR a IS DISTINCT FROM lag(a) OVER o THEN 1 ELSE 0 END AS mark FROM s WINDOW o AS (PARTITION BY type, id ORDER BY snapshot_idx)),
     n AS (SELECT *, sum(mark) OVER (PARTITION BY type, id ORDER BY snapshot_idx) AS island FROM m),
     g AS (SELECT type, id, island, first(a) AS a, min(day) AS valid_from, count(*) AS snapshots FROM n GROUP BY ALL)
SELECT type, id, a.version AS version, a.changeset AS changeset, a.user_id AS user_id, a.visible AS visible, valid_from, coalesce(lead(valid_from) OVER (PARTITION BY type, id ORDER BY island), -1) AS valid_to, snapshots FROM g
"""

_P7_ROWS = """
acts AS (SELECT id, info.version AS v, 1 AS side, file_idx, changetype AS ct, changetype IN (4, 5) AS there, lon, lat, info.user_id AS user_id FROM osm_changes WHERE type = 0 AND changetype IN (1, 4, 5) AND id IS NOT NULL),
base AS (SELECT id, info.version AS v, 0 AS side, -1 AS file_idx, 0 AS ct, coalesce(changetype NOT IN (1, 2), true) AS there, lon, lat, info.user_id AS user_id FROM osm_nodes WHERE id IS NOT NULL)
"""

P7_TABLE = f"""
WITH {_P7_ROWS}
SELECT id, v AS version, lon, lat FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(v, -1) DESC, side DESC, file_idx DESC, ct DESC, there DESC, lon DESC NULLS LAST, lat DESC NULLS LAST) AS nth FROM (SELECT * FROM acts UNION ALL SELECT * FROM base)) WHERE nth = 1 AND there
"""


P7_COLUMNS = f"""
WITH {_P7_ROWS},
one AS (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(v, -1) DESC, there DESC, lon DESC NULLS LAST, lat DESC NULLS LAST, user_id DESC NULLS LAST) AS nth FROM base) WHERE nth = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY coalesce(v, -1) DESC, side DESC, file_idx DESC, ct DESC, lon DESC NULLS LAST, lat DESC NULLS LAST, user_id DESC NULLS LAST) AS nth,
      dense_rank() OVER (PARTITION BY id ORDER BY coalesce(v, -1) DESC, side DESC, file_idx DESC, ct DESC) AS place FROM (SELECT * FROM acts UNION ALL SELECT * FROM one)),
c AS (SELECT *, min(place) FILTER (ct <> 4) OVER (PARTITION BY id) AS cleared, first_value(there) OVER (PARTITION BY id ORDER BY nth) AS exists_, first_value(v) OVER (PARTITION BY id ORDER BY nth) AS version FROM r)
SELECT id, version, {', '.join(f"max(row(-place, {c})) FILTER ({c} IS NOT NULL AND there AND place <= coalesce(cleared, place))[2] AS {c}" for c in ("lon", "lat", "user_id"))} FROM c WHERE exists_ GROUP BY id, version
"""

SQL: dict[str, str] = {"p1_regions": P1_REGIONS, "p2_attributes": P2_ATTRIBUTES, "p7_table": P7_TABLE, "p7_columns": P7_COLUMNS, "p1_found": P1, "p2_found": P2, "p3_found": P3, "p3_ranges": P3_RANGES, "p5_found": P5, "p5_report": P5_REPORT, "p6_found": P6, "p6_totals": P6_TOTALS, "p7_found": P7}
