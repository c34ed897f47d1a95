"""SQL (DuckDB) that gives the same rows as the element queries of the same name."""

from __future__ import annotations

from tilewright.element_queries import AS_OF, BOX, LEVEL, MONTH, RING
from tilewright.functions.style import DROP_KEYS, FEATURE_KEYS, HIGHWAY_RANK, MIN_ZOOM, POLYGON_TAGS, Z_ORDER
from tilewright.oracle import current_whole

LIVE = "coalesce(ct NOT IN (1, 2), true)"
PLACED = "abs(lon) <= 1800000000 AND abs(lat) <= 900000000"


def _nodes(columns: str = "lon lat") -> str:
    return f"(SELECT * FROM {current_whole('osm_nodes', columns)} WHERE {LIVE} AND {PLACED})"


def _ways(columns: str = "refs") -> str:
    return f"(SELECT * FROM {current_whole('osm_ways', columns)} WHERE {LIVE})"


def _relations(columns: str = "members") -> str:
    return f"(SELECT * FROM {current_whole('osm_relations', columns)} WHERE {LIVE})"


def _elements(columns: str) -> str:
    names = ", ".join(columns.split())
    return "(" + " UNION ALL ".join(f"SELECT {k} AS type, id, {names} FROM {current_whole(t, columns)} WHERE {LIVE}" for k, t in enumerate(("osm_nodes", "osm_ways", "osm_relations"))) + ")"


def _all(columns: str) -> str:
    return "(" + " UNION ALL ".join(f"SELECT {k} AS type, id, changetype, {columns} FROM {t}" for k, t in enumerate(("osm_nodes", "osm_ways", "osm_relations"))) + ")"


def _texts(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _round(q: str, level: str | int) -> str:
    return f"(CASE WHEN {q} < 0 THEN {q} WHEN ({level}) = 0 THEN 0 WHEN ({q} & 31) < ({level}) THEN {q} ELSE (({q} >> (63 - 2 * ({level}))::BIGINT) * pow(2, 63 - 2 * ({level}))::HUGEINT + ({level}))::BIGINT END)"


def _common(a: str, b: str) -> str:
    level = f"least({a} & 31, {b} & 31, CASE WHEN (xor({a}, {b}) >> 5) = 0 THEN 31 ELSE (63 - length(bin((xor({a}, {b}) >> 5) * 32))) // 2 END)"
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} < 0 THEN {b} WHEN {b} < 0 THEN {a} WHEN {a} = {b} THEN {a} ELSE {_round(a, level)} END)"


def _common_of(q: str) -> str:
    low, high = f"min({q}) FILTER (WHERE {q} >= 0)", f"max({q}) FILTER (WHERE {q} >= 0)"
    return f"coalesce({_common(low, high)}, -1)"


#: Keys of the boxes bx(k, minx, miny, maxx, maxy), as recursive tables; the last is keyed(k, key).
KEYED = """
north AS (SELECT *, CASE WHEN miny <= -900000000 THEN -1e9 WHEN miny >= 900000000 THEN 1e9 ELSE ln(tan((1 + miny * 1e-7 / 90) * pi() / 4)) / pi() END AS n0,
    CASE WHEN maxy + (miny = maxy)::INT <= -900000000 THEN -1e9 WHEN maxy + (miny = maxy)::INT >= 900000000 THEN 1e9 ELSE ln(tan((1 + (CASE WHEN miny = maxy THEN maxy * 1e-7 + 1e-7 ELSE maxy * 1e-7 END) / 90) * pi() / 4)) / pi() END AS n1 FROM bx WHERE minx <= maxx AND miny <= maxy),
calc AS (
    SELECT k, 0 AS l, minx * 1e-7 / 180 AS x0, n0 AS y0, (CASE WHEN minx = maxx THEN maxx * 1e-7 + 1e-7 ELSE maxx * 1e-7 END) / 180 AS x1, n1 AS y1, 0::BIGINT AS key FROM north
    UNION ALL
    SELECT k, l + 1, 2 * (x0 + CASE WHEN q % 2 = 0 THEN 0.5 ELSE -0.5 END), 2 * (y0 + CASE WHEN q >= 2 THEN 0.5 ELSE -0.5 END), 2 * (x1 + CASE WHEN q % 2 = 0 THEN 0.5 ELSE -0.5 END), 2 * (y1 + CASE WHEN q >= 2 THEN 0.5 ELSE -0.5 END), (key + q * pow(2, 61 - 2 * l)::HUGEINT + 1)::BIGINT
    FROM (SELECT *, CASE WHEN x0 < -1.05 OR x1 > 1.05 OR y0 < -1.05 OR y1 > 1.05 THEN -1 WHEN x1 <= 0 AND y0 >= 0 THEN 0 WHEN x0 >= 0 AND y0 >= 0 THEN 1 WHEN x1 <= 0 AND y1 <= 0 THEN 2 WHEN x0 >= 0 AND y1 <= 0 THEN 3
        WHEN x1 < 0.05 AND abs(x1) < abs(x0) AND y0 > -0.05 AND abs(y1) >= abs(y0) THEN 0 WHEN x0 > -0.05 AND abs(x1) >= abs(x0) AND y0 > -0.05 AND abs(y1) >= abs(y0) THEN 1
        WHEN x1 < 0.05 AND abs(x1) < abs(x0) AND y1 < 0.05 AND abs(y1) < abs(y0) THEN 2 WHEN x0 > -0.05 AND abs(x1) >= abs(x0) AND y1 < 0.05 AND abs(y1) < abs(y0) THEN 3 ELSE -1 END AS q FROM calc WHERE l < 18)
    WHERE q >= 0),
keyed AS (SELECT bx.k, coalesce(max(calc.key), -1) AS key FROM bx LEFT JOIN calc USING (k) GROUP BY bx.k)
"""

_KEYS = f"(SELECT * FROM {_elements('quadtree')} WHERE quadtree IS NOT NULL)"

_WAY_BOXES = f"""
n AS MATERIALIZED (SELECT id, lon, lat FROM {_nodes()}),
w AS MATERIALIZED (SELECT id, refs FROM {_ways()}),
wn AS (SELECT DISTINCT id, node FROM (SELECT id, unnest(refs) AS node FROM w) WHERE node IS NOT NULL),
boxes AS (SELECT w.id, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy, count(lon) AS found, count(wn.node) - count(lon) AS missing FROM w LEFT JOIN wn USING (id) LEFT JOIN n ON n.id = wn.node GROUP BY w.id)
"""

_WAY_KEYS = f"{_WAY_BOXES}, bx AS (SELECT id AS k, minx, miny, maxx, maxy FROM boxes UNION ALL SELECT -id - 1000000000000, lon, lat, lon, lat FROM n), {KEYED}, wq AS (SELECT k AS id, key AS quadtree FROM keyed WHERE k > -1000000000000)"

_NODE_KEYS = f"""{_WAY_KEYS},
nq AS (SELECT n.id, CASE WHEN coalesce(s.q, -1) >= 0 THEN s.q ELSE o.key END AS quadtree FROM n JOIN keyed o ON o.k = -n.id - 1000000000000
    LEFT JOIN (SELECT wn.node AS id, {_common_of('wq.quadtree')} AS q FROM wn JOIN wq USING (id) GROUP BY wn.node) s ON s.id = n.id)"""

_TILED = "t AS (SELECT DISTINCT tile_qt FROM tiles WHERE tile_qt >= 0)"


def _assigned(source: str, key: str = "quadtree") -> str:
    """Rows with tile_qt: by distinct key, its ancestors against the tiles."""
    up = _round("key", "l")
    return f"""src AS ({source}), dk AS (SELECT DISTINCT {key} AS key FROM src WHERE {key} >= 0), {_TILED},
    best AS (SELECT key, max(tile_qt) AS tile FROM (SELECT key, {up} AS a FROM (SELECT key, unnest(range(0, (key & 31) + 1)) AS l FROM dk)) u JOIN t ON t.tile_qt = u.a GROUP BY key),
    tiled AS (SELECT src.*, CASE WHEN {key} >= 0 THEN coalesce(best.tile, 0) END AS tile_qt FROM src LEFT JOIN best ON best.key = src.{key})"""


def _area(ring: bool) -> str:
    x0, y0, x1, y1 = BOX
    hit = f"lon BETWEEN {x0} AND {x1} AND lat BETWEEN {y0} AND {y1}"
    if ring:
        tests = []
        for i, (ax, ay) in enumerate(RING):
            bx, by = RING[i - 1]
            if ay != by:
                tests.append(f"((({ay} > lat) <> ({by} > lat)) AND lon < ({bx - ax})::DOUBLE * (lat - {ay}) / {by - ay} + {ax})::INT")
        hit += f" AND ({' + '.join(tests)}) % 2 = 1"
    return f"""
n AS (SELECT id, lon, lat FROM {_nodes()}), w AS (SELECT id, refs FROM {_ways()}), r AS (SELECT id, members FROM {_relations()}),
wn AS (SELECT DISTINCT id, node FROM (SELECT id, unnest(refs) AS node FROM w) WHERE node IS NOT NULL),
seed AS (SELECT DISTINCT id FROM n WHERE {hit}),
gw AS (SELECT DISTINCT wn.id FROM wn JOIN seed ON seed.id = wn.node),
gn AS (SELECT id FROM seed UNION SELECT wn.node FROM wn JOIN gw USING (id)),
low AS (SELECT 0 AS type, id FROM gn UNION ALL SELECT 1, id FROM gw),
m AS (SELECT DISTINCT id, m.type AS kind, m.ref AS ref FROM (SELECT id, unnest(members) AS m FROM r)),
gr(id) AS (SELECT DISTINCT m.id FROM m JOIN low ON low.type = m.kind AND low.id = m.ref UNION SELECT m.id FROM gr JOIN m ON m.kind = 2 AND m.ref = gr.id),
area AS (SELECT * FROM low UNION ALL SELECT 2, id FROM gr)
"""


_STORED = f"SELECT type, id, 0 AS changetype, info.version AS version, quadtree FROM {_elements('quadtree info')}"


def _overlay(files: str, apply: bool) -> str:
    rows = f"""{_assigned(f"SELECT type, id, changetype, version, quadtree, -1 AS file_idx FROM ({_STORED}) UNION ALL SELECT type, id, changetype, info.version, quadtree, file_idx FROM osm_changes WHERE id IS NOT NULL {files}")},
    base AS (SELECT DISTINCT tile_qt FROM tiled WHERE file_idx = -1 AND tile_qt IS NOT NULL),
    won AS (SELECT tile_qt, type, id, changetype, version FROM (SELECT *, row_number() OVER (PARTITION BY tile_qt, type, id ORDER BY file_idx DESC, changetype DESC, version DESC) AS nth FROM tiled WHERE tile_qt IN (SELECT tile_qt FROM base)) WHERE nth = 1),
    touched AS (SELECT DISTINCT tile_qt FROM tiled WHERE file_idx >= 0)"""
    if not apply:
        return f"WITH {rows} SELECT * FROM won"
    return f"WITH {rows} SELECT tile_qt, type, id, CASE WHEN tile_qt IN (SELECT tile_qt FROM touched) THEN 0 ELSE changetype END AS changetype, version FROM won WHERE tile_qt NOT IN (SELECT tile_qt FROM touched) OR changetype NOT IN (1, 2)"


_NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY coalesce(info.version, -1) DESC, coalesce(file_idx, 2147483647), changetype DESC) AS nth FROM osm_changes WHERE type IS NOT NULL AND id IS NOT NULL) WHERE nth = 1)"
_APPLIED = f"""new AS (SELECT * FROM {_NEWEST}), base AS (SELECT type, id, 0 AS changetype, info, tags FROM {_elements('info tags')}),
after AS (SELECT type, id, changetype, info, tags FROM base WHERE (type, id) NOT IN (SELECT (type, id) FROM new) UNION ALL SELECT type, id, 0, info, tags FROM new WHERE changetype >= 4)"""


def _has(key: str, val: str | None = None) -> str:
    return f"len([t FOR t IN tags IF t.key = '{key}'" + (f" AND t.val = '{val}'" if val else "") + "]) > 0"


def _joined(condition: str, tags: str = "tags") -> str:
    return f"array_to_string([t.key || '=' || coalesce(t.val, '') FOR t IN {tags} IF {condition}], ';')"


_DROPPED = f"(t.key IN {_texts(DROP_KEYS)} OR (contains(t.key, ':') AND split_part(t.key, ':', 1) || ':' IN {_texts(DROP_KEYS)}))"
_POLYGON = " OR ".join(f"(t.key = '{k}'" + {"all": "", "include": f" AND coalesce(t.val, '') IN {_texts(v)}" if v else "", "exclude": f" AND coalesce(t.val, '') NOT IN {_texts(v)}" if v else ""}[how] + ")" for k, (how, v) in POLYGON_TAGS.items())
_Z = "CASE " + " ".join(f"WHEN t.key = '{k}' AND t.val = '{v}' THEN {z}" for k, vals in Z_ORDER.items() for v, z in vals.items()) + " END"


def _zoom(kind: int) -> str:
    exact = "CASE " + " ".join(f"WHEN t.key = '{k}' AND t.val = '{v}' THEN {z}" for kd, k, v, z in MIN_ZOOM if kd == kind and v != "*") + " END"
    loose = "CASE " + " ".join(f"WHEN t.key = '{k}' THEN {z}" for kd, k, v, z in MIN_ZOOM if kd == kind and v == "*") + " END"
    return f"list_min([coalesce({exact if 'WHEN' in exact else 'NULL'}, {loose}) FOR t IN tags])"


def _relation_tag(target: str, where: list[tuple[str, str]], source: str, how: str) -> str:
    passes = " AND ".join(_has(k, v) for k, v in where)
    src = f"SELECT m.ref AS id, v FROM (SELECT [t.val FOR t IN tags IF t.key = '{source}'][1] AS v, unnest(members) AS m FROM {_relations('members tags')} WHERE {passes}) WHERE v IS NOT NULL AND m.type = 1"
    number = "try_cast(nullif(regexp_extract(v, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT)"
    if how == "list":
        return f"SELECT id, '{target}' AS key, string_agg(DISTINCT v, '; ' ORDER BY v) AS val FROM ({src}) GROUP BY id"
    return f"SELECT id, '{target}' AS key, {how}(n)::VARCHAR AS val FROM (SELECT id, {number} AS n FROM ({src})) WHERE n IS NOT NULL GROUP BY id"


_QUOTE = lambda x: f"""'"' || replace(replace(replace({x}, chr(10), ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '"'"""
def _metres(lat: str) -> str:
    """Mercator metres of a latitude; null at the south pole."""
    return f"(CASE WHEN {lat} > -900000000 THEN ln(tan(({lat} * 1e-7 / 90 + 1) * pi() / 4)) / pi() * 20037508.342789244 END)"


_PLACES = f"n AS (SELECT id, lon, lat FROM {_nodes()}), w AS (SELECT id, refs FROM {_ways()}), wn AS (SELECT id, unnest(refs) AS node, generate_subscripts(refs, 1) AS pos FROM w), p AS (SELECT wn.id, pos, lon, lat, lon * 1e-7 / 180 * 20037508.342789244 AS x, {_metres('lat')} AS y FROM wn JOIN n ON n.id = wn.node)"
_RANK = "CASE v " + " ".join(f"WHEN '{h}' THEN {i}" for i, h in enumerate(HIGHWAY_RANK)) + " END"
_WEIGHTS = f"SELECT {_round('qt', LEVEL)} AS quadtree, sum(weight)::BIGINT AS n FROM qt_items WHERE qt >= 0 GROUP BY 1 HAVING sum(weight) IS NOT NULL"
_TILE_X = "list_sum([((({q} >> (61 - 2 * l)::BIGINT) & {bit}) // {bit}) * pow(2, ({q} & 31) - 1 - l)::BIGINT FOR l IN range(0, {q} & 31)])"


def _tile(q: str, bit: int) -> str:
    return f"coalesce({_TILE_X.format(q=q, bit=bit)}, 0)::BIGINT"


def _bbox(q: str, buffer: float = 0.0) -> str:
    """Columns minx, miny, maxx, maxy in degrees of the keys q of a table."""
    un = lambda y: f"((atan(exp(({y}) * 90 * pi() / 90)) * 4 / pi() - 1) * 90)"
    size = f"(2 / pow(2, {q} & 31))"
    x0, y1 = f"({_tile(q, 1)} * {size} - 1)", f"(1 - {_tile(q, 2)} * {size})"
    a = f"{x0} * 180 AS ax, ({x0} + {size}) * 180 AS bx, {un(f'{y1} - {size}')} AS ay, {un(y1)} AS cy"
    return a


_TILE_BOXES = f"SELECT *, {_bbox('tile_qt')} FROM (SELECT DISTINCT tile_qt, file_idx, end_date FROM tiles WHERE tile_qt >= 0)"

SQL: dict[str, str] = {
    "count_by_type_changetype": f"SELECT type, changetype, count(*) AS n, min(id) AS min_id, max(id) AS max_id, min(info.timestamp) AS min_time, max(info.timestamp) AS max_time FROM {_all('info')} GROUP BY type, changetype",
    "node_bounds": "SELECT changetype, count(*) AS n, min(lon) AS min_lon, max(lon) AS max_lon, min(lat) AS min_lat, max(lat) AS max_lat FROM osm_nodes GROUP BY changetype",
    "way_ref_stats": "SELECT changetype, count(*) AS n, sum(coalesce(len(refs), 0))::BIGINT AS refs, min(list_min([r FOR r IN refs IF r <> 0])) AS min_ref, max(list_max([r FOR r IN refs IF r <> 0])) AS max_ref, max(coalesce(len(refs), 0)) AS longest FROM osm_ways GROUP BY changetype",
    "relation_member_stats": "SELECT changetype, count(*) AS n, " + ", ".join(f"sum(coalesce(len([m FOR m IN members IF m.type = {k}]), 0))::BIGINT AS {c}" for k, c in enumerate(("node_members", "way_members", "relation_members"))) + ", count(*) FILTER (WHERE coalesce(len(members), 0) = 0) AS empty, max(coalesce(len(members), 0)) AS longest FROM osm_relations GROUP BY changetype",
    "tile_summary": f"SELECT quadtree AS tile_qt, count(*) FILTER (WHERE type = 0) AS nodes, count(*) FILTER (WHERE type = 1) AS ways, count(*) FILTER (WHERE type = 2) AS relations FROM {_all('quadtree')} GROUP BY quadtree",
    "qt_point": f"WITH RECURSIVE bx AS (SELECT id AS k, lon AS minx, lat AS miny, lon AS maxx, lat AS maxy FROM {_nodes()}), {KEYED} SELECT k AS id, key AS quadtree FROM keyed",
    "qt_round": f"SELECT type, id, {_round('quadtree', 6)} AS at_6, {_round('quadtree', 0)} AS at_0 FROM {_KEYS}",
    "qt_common": f"SELECT type, id, {_common('quadtree', '1998375577622413322')} AS shared FROM {_KEYS}",
    "qt_common_by_user": f"SELECT info.user_id AS user_id, {_common_of('quadtree')} AS shared FROM {_elements('quadtree info')} GROUP BY 1",
    "qt_text": f"SELECT type, id, CASE WHEN quadtree < 0 THEN 'NULL' ELSE array_to_string([chr((65 + ((quadtree >> (61 - 2 * l)::BIGINT) & 3))::INT) FOR l IN range(0, quadtree & 31)], '') END AS letters, true AS back FROM {_KEYS}",
    "qt_xyz": f"SELECT type, id, {_tile('quadtree', 1)} AS x, {_tile('quadtree', 2)} AS y, quadtree & 31 AS z, true AS back FROM {_KEYS} WHERE quadtree >= 0",
    "qt_tile_bbox": f"SELECT DISTINCT tile_qt, round(trunc(ax * 1e7 + sign(ax) * 0.5) / 10000)::BIGINT AS minx, round(trunc(ay * 1e7 + sign(ay) * 0.5) / 10000)::BIGINT AS miny, round(trunc(bx * 1e7 + sign(bx) * 0.5) / 10000)::BIGINT AS maxx, round(trunc(cy * 1e7 + sign(cy) * 0.5) / 10000)::BIGINT AS maxy FROM ({_TILE_BOXES})",
    "qt_histogram": _WEIGHTS,
    "qt_rollup": f"WITH h AS ({_WEIGHTS}) SELECT a AS quadtree, coalesce(sum(n) FILTER (WHERE a = q), 0)::BIGINT AS own, sum(n)::BIGINT AS total FROM (SELECT quadtree AS q, n, {_round('quadtree', 'l')} AS a FROM (SELECT quadtree, n, unnest(range(0, (quadtree & 31) + 1)) AS l FROM h)) GROUP BY a",
    "tiles_of_box": f"SELECT DISTINCT tile_qt, file_idx FROM ({_TILE_BOXES}) WHERE (end_date IS NULL OR end_date <= {AS_OF}) AND (ax - (bx - ax) * 0.05) * 1e7 <= {BOX[2]} AND (bx + (bx - ax) * 0.05) * 1e7 >= {BOX[0]} AND (ay - (cy - ay) * 0.05) * 1e7 <= {BOX[3]} AND (cy + (cy - ay) * 0.05) * 1e7 >= {BOX[1]}",
    "way_bbox": f"WITH {_WAY_BOXES} SELECT * FROM boxes",
    "way_quadtree": f"WITH RECURSIVE {_WAY_KEYS} SELECT id, quadtree FROM wq",
    "node_quadtree": f"WITH RECURSIVE {_NODE_KEYS} SELECT id, quadtree FROM nq",
    "relation_quadtree": f"""WITH RECURSIVE {_NODE_KEYS}, r AS (SELECT id, members FROM {_relations()}), m AS (SELECT DISTINCT id, m.type AS kind, m.ref AS ref FROM (SELECT id, unnest(members) AS m FROM r)),
        reach(id, sub) AS (SELECT id, id FROM r UNION SELECT reach.id, m.ref FROM reach JOIN m ON m.kind = 2 AND m.id = reach.sub),
        leaf AS (SELECT 0 AS kind, id, quadtree FROM nq UNION ALL SELECT 1, id, quadtree FROM wq)
        SELECT id, greatest(q, 0) AS quadtree FROM (SELECT reach.id, {_common_of('leaf.quadtree')} AS q FROM reach LEFT JOIN m ON m.id = reach.sub LEFT JOIN leaf ON leaf.kind = m.kind AND leaf.id = m.ref GROUP BY reach.id)""",
    "assign_tile": f"WITH {_assigned('SELECT * FROM ' + _KEYS)} SELECT type, id, tile_qt FROM tiled",
    "cluster_counts": f"WITH {_assigned('SELECT * FROM ' + _KEYS)} SELECT tile_qt, count(*) AS n FROM tiled GROUP BY tile_qt",
    "block_8000": f"SELECT type, block, count(*) AS n, min(id) AS min_id, max(id) AS max_id FROM (SELECT type, id, (row_number() OVER (PARTITION BY type ORDER BY id) - 1) // 8000 AS block FROM {_elements('info')}) GROUP BY ALL",
    "split_id_key": f"SELECT type, id, CASE type WHEN 0 THEN least(id // 1000, 11) WHEN 1 THEN least(id // 200, 11) + 12 ELSE least(id // 100, 11) + 24 END AS part FROM {_elements('info')}",
    "filter_tags": f"SELECT type, id, coalesce({_joined(f't.key IS NOT NULL AND (t.key IN {_texts(FEATURE_KEYS)} OR NOT {_DROPPED})')}, '') AS kept, coalesce(len([t FOR t IN tags IF t.key IN {_texts(FEATURE_KEYS)}]) > 0, false) AS feature, try_cast([t.val FOR t IN tags IF t.key = 'layer'][1] AS BIGINT) AS layer FROM {_elements('tags')}",
    "polygon_tags": f"SELECT type, id, coalesce(len([t FOR t IN tags IF {_POLYGON}]) > 0, false) AS polygon FROM {_elements('tags')}",
    "zorder": f"SELECT type, id, list_max([{_Z} FOR t IN tags]) AS zorder FROM {_elements('tags')}",
    "minzoom_tag": f"SELECT type, id, zoom, coalesce(zoom <= CASE WHEN type = 0 THEN 14 ELSE 12 END, false) AS shows FROM (SELECT type, id, CASE WHEN type = 0 THEN {_zoom(0)} ELSE least({_zoom(1)}, {_zoom(2)}) END AS zoom FROM {_elements('tags')})",
    "tags_json": f"SELECT type, id, '{{' || array_to_string(list_transform(list_sort(list_distinct([t.key FOR t IN tags IF t.key IS NOT NULL])), lambda k: to_json(k)::VARCHAR || ':' || coalesce(to_json([t.val FOR t IN tags IF t.key = k][1])::VARCHAR, 'null')), ',') || '}}' AS json FROM {_elements('tags')} WHERE tags IS NOT NULL",
    "tags_hstore": f"SELECT type, id, array_to_string([{_QUOTE('t.key')} || '=>' || coalesce({_QUOTE('t.val')}, 'NULL') FOR t IN tags IF t.key IS NOT NULL], ',') AS hstore FROM {_elements('tags')} WHERE tags IS NOT NULL",
    "tags_fixed": f"SELECT type, id, {_joined('true', 'list_sort([{key: replace(t.key, chr(127), chr(0)[2:]), val: replace(t.val, chr(127), chr(0)[2:])} FOR t IN tags IF t.key IS NOT NULL AND t.val IS NOT NULL])')} AS fixed, coalesce(len([t FOR t IN tags IF contains(t.key, chr(127)) OR contains(t.val, chr(127))]) > 0, false) AS odd FROM {_elements('tags')}",
    "parent_tags": f"""WITH w AS (SELECT id, refs, tags FROM {_ways('refs tags')}), n AS (SELECT id, tags FROM {_nodes('lon lat tags')}),
        ref AS (SELECT DISTINCT id, node FROM (SELECT id, unnest(refs) AS node FROM w) WHERE node IS NOT NULL),
        hv AS (SELECT ref.node, ref.id, [t.val FOR t IN w.tags IF t.key = 'highway'][-1] AS v FROM ref JOIN w USING (id)),
        sv AS (SELECT ref.node, ref.id, [t.val FOR t IN w.tags IF t.key = 'service'][-1] AS v FROM ref JOIN w USING (id))
        SELECT node AS id, 'parent_highway' AS key, arg_max(v, rank) AS val FROM (SELECT *, {_RANK} AS rank FROM hv) JOIN n ON n.id = node WHERE rank IS NOT NULL AND ({_has('highway')} OR {_has('railway')}) GROUP BY node
        UNION ALL SELECT node, 'parent_service', arg_min(v, sv.id) FROM sv JOIN n ON n.id = node WHERE v <> '' AND {_has('highway')} GROUP BY node""",
    "relation_tags": " UNION ALL ".join([_relation_tag("min_admin_level", [("type", "boundary"), ("boundary", "administrative")], "admin_level", "min"), _relation_tag("max_admin_level", [("type", "boundary"), ("boundary", "administrative")], "admin_level", "max"), _relation_tag("bus_routes", [("type", "route"), ("route", "bus")], "ref", "list"), _relation_tag("bicycle_routes", [("type", "route"), ("route", "bicycle")], "ref", "list")]),
    "mercator_forward": f"SELECT id, round(lon * 1e-7 / 180 * 20037508.342789244, 2) AS x, round({_metres('lat')}, 2) AS y FROM {_nodes()}",
    "line_lengths": f"WITH {_PLACES}, seg AS (SELECT id, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS d FROM p WINDOW o AS (PARTITION BY id ORDER BY pos)), s AS (SELECT id, count(*) AS points, CASE WHEN count(*) - 1 = count(d) THEN coalesce(sum(d), 0) END AS d FROM seg GROUP BY id) SELECT w.id, coalesce(len(w.refs), 0) - coalesce(s.points, 0) AS missing, coalesce(s.points, 0) AS points, CASE WHEN s.id IS NULL THEN 0 ELSE round(s.d, 1) END AS length FROM w LEFT JOIN s USING (id)",
    "ring_areas": f"WITH {_PLACES}, seg AS (SELECT id, lag(x) OVER o * y - lag(y) OVER o * x AS c FROM p WINDOW o AS (PARTITION BY id ORDER BY pos)), s AS (SELECT id, count(*) AS points, CASE WHEN count(*) - 1 = count(c) THEN sum(c) END AS c FROM seg GROUP BY id) SELECT w.id, round(-0.5 * s.c / 1e4, 0)::BIGINT AS hectares, true AS placed FROM w JOIN s USING (id) WHERE len(refs) > 3 AND refs[1] = refs[-1] AND s.points = len(refs)",
    "bbox_extract": f"WITH RECURSIVE {_area(False)} SELECT type, id FROM area",
    "poly_extract": f"WITH RECURSIVE {_area(True)} SELECT type, id FROM area",
    "filter_members": f"WITH RECURSIVE {_area(False)}, f AS (SELECT id, unnest(members) AS mm, generate_subscripts(members, 1) AS pos FROM r) SELECT f.id, string_agg(mm.type || ':' || mm.ref, ',' ORDER BY pos) AS members FROM f JOIN area ON area.type = mm.type AND area.id = mm.ref GROUP BY f.id",
    "idset_invert": f"WITH named AS (SELECT 0 AS type, unnest(refs) AS id FROM {_ways()} UNION SELECT m.type, m.ref FROM (SELECT unnest(members) AS m FROM {_relations()})) SELECT type, id FROM {_elements('quadtree')} e WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.type = e.type AND n.id = e.id)",
    "dedupe_version": f"SELECT type, id, info.version AS version, file_idx, changetype FROM {_NEWEST}",
    "overlay_merge": _overlay("", False),
    "overlay_apply": _overlay("", True),
    "snapshot_asof": _overlay(f"AND file_idx <= {MONTH}", True),
    "apply_change": f"WITH {_APPLIED} SELECT type, id, changetype, info.version AS version FROM after",
    "original_rows": f"""WITH f AS (SELECT type, id, changetype, coalesce(info.version, -1) AS version, 0 AS file_idx FROM {_all('info')} UNION ALL SELECT type, id, changetype, coalesce(info.version, -1), file_idx FROM osm_changes WHERE file_idx <= 30),
        one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, id, file_idx ORDER BY version DESC, changetype DESC) AS nth FROM f) WHERE nth = 1 AND changetype <> 2 AND (type, id) IN (SELECT (type, id) FROM osm_changes WHERE file_idx > 30))
        SELECT type, id, version, file_idx FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY file_idx DESC) AS n2 FROM one) WHERE n2 = 1 AND changetype <> 1""",
    "index_lookup": f"""WITH {_assigned("SELECT 0 AS type, id, NULL::BIGINT[] AS refs, NULL::STRUCT(type INT, ref BIGINT, role VARCHAR)[] AS members, quadtree FROM " + _nodes("lon lat quadtree") + " UNION ALL SELECT 1, id, refs, NULL, quadtree FROM " + _ways("refs quadtree") + " UNION ALL SELECT 2, id, NULL, members, quadtree FROM " + _relations("members quadtree"))},
        ix AS (SELECT tile_qt, type, id FROM tiled UNION ALL SELECT tile_qt, 0, unnest(refs) FROM tiled UNION ALL SELECT tile_qt, m.type, m.ref FROM (SELECT tile_qt, unnest(members) AS m FROM tiled))
        SELECT DISTINCT tile_qt FROM ix WHERE tile_qt IS NOT NULL AND (type, id) IN (SELECT (type, id) FROM osm_changes WHERE type IS NOT NULL AND id IS NOT NULL)""",
    "change_tiles": f"""WITH {_assigned(f"SELECT type, id, changetype, quadtree, 0 AS stored FROM {_NEWEST} UNION ALL SELECT type, id, 0, quadtree, 1 FROM ({_STORED})")},
        p AS (SELECT a.*, o.tile_qt AS old FROM (SELECT * FROM tiled WHERE stored = 0) a LEFT JOIN (SELECT * FROM tiled WHERE stored = 1) o USING (type, id))
        SELECT tile_qt, type, id, changetype, quadtree FROM p WHERE changetype > 2 UNION ALL SELECT old, type, id, 2, 0 FROM p WHERE changetype > 2 AND old <> tile_qt UNION ALL SELECT old, type, id, changetype, quadtree FROM p WHERE changetype = 1 AND old IS NOT NULL""",
    "dataset_diff": f"""WITH {_APPLIED} SELECT type, reason, count(*) AS n FROM (SELECT coalesce(a.type, b.type) AS type, CASE WHEN b.id IS NULL THEN 'only_left' WHEN a.id IS NULL THEN 'only_right'
        WHEN a.info.version IS DISTINCT FROM b.info.version THEN 'version' WHEN a.info.timestamp IS DISTINCT FROM b.info.timestamp THEN 'timestamp' WHEN a.info.changeset IS DISTINCT FROM b.info.changeset THEN 'changeset' WHEN a.info.user_id IS DISTINCT FROM b.info.user_id THEN 'user_id'
        WHEN a.tags IS DISTINCT FROM b.tags THEN 'tags' ELSE 'same' END AS reason FROM base a FULL JOIN after b ON a.type = b.type AND a.id = b.id) GROUP BY ALL""",
    "renamed_users": f"SELECT a.info.user_id AS user_id, a.info.user AS left_user, b.info.user AS right_user, count(*) AS n FROM {_elements('info')} a JOIN {_NEWEST} b ON a.type = b.type AND a.id = b.id AND a.info.user_id = b.info.user_id WHERE a.info.user IS DISTINCT FROM b.info.user GROUP BY ALL",
}
def _fold() -> str:
    """Tiles below 200 folded into their parents, from level 17 upwards; a row of the recursion is a tile after a level."""
    leaf = f"SELECT {_round('qt', 17)} AS q, sum(weight)::BIGINT AS n FROM qt_items WHERE qt >= 0 GROUP BY 1 HAVING sum(weight) IS NOT NULL"
    step = f"SELECT l, q, n, {_round('q', 'l')} AS tile FROM (SELECT l - 1 AS l, q, n FROM r WHERE l > 1)"
    small = f"SELECT l, CASE WHEN (q & 31) >= l AND sum(CASE WHEN (q & 31) >= l THEN n END) OVER (PARTITION BY tile) < 200 THEN {_round('q', 'l - 1')} ELSE q END AS q, n FROM ({step})"
    return f"WITH RECURSIVE r(l, q, n) AS (SELECT 18, q, n FROM ({leaf}) UNION ALL SELECT l, q, sum(n)::BIGINT FROM ({small}) GROUP BY l, q) SELECT q AS quadtree, n FROM r WHERE l = 1"


_KEPT = _joined(f"t.key IS NOT NULL AND (t.key IN {_texts(FEATURE_KEYS)} OR NOT {_DROPPED})")
_FEATURE = f"len([t FOR t IN tags IF t.key IN {_texts(FEATURE_KEYS)}]) > 0"
_LAYER = "try_cast([t.val FOR t IN tags IF t.key = 'layer'][1] AS BIGINT)"
_KEPT_LIST = f"[t FOR t IN tags IF t.key IS NOT NULL AND (t.key IN {_texts(FEATURE_KEYS)} OR NOT {_DROPPED})]"


def _res_zoom(metres: str) -> str:
    return f"(CASE WHEN abs({metres}) < 0.001 THEN 20.0 ELSE log2(20037508.342789244 * 2 / 256 / ({metres})) END)"


_SHAPES = f"""
n AS (SELECT id, lon, lat, tags FROM {_nodes('lon lat tags')}), w AS (SELECT id, refs, tags FROM {_ways('refs tags')}),
p AS (SELECT wn.id, pos, lon, lat, {_metres('lat')} AS y, lon * 1e-7 / 180 * 20037508.342789244 AS x
    FROM (SELECT id, unnest(refs) AS node, generate_subscripts(refs, 1) AS pos FROM w) wn JOIN n ON n.id = wn.node),
seg AS (SELECT id, lon, lat, sqrt((x - lag(x) OVER o) ** 2 + (y - lag(y) OVER o) ** 2) AS d, lag(x) OVER o * y - lag(y) OVER o * x AS c FROM p WINDOW o AS (PARTITION BY id ORDER BY pos)),
s AS (SELECT id, count(*) AS points, CASE WHEN count(*) - 1 = count(d) THEN sum(d) END AS length, CASE WHEN count(*) - 1 = count(c) THEN -0.5 * sum(c) END AS area, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM seg GROUP BY id HAVING count(*) >= 2),
shape AS (
    SELECT 3 AS type, id, tags, NULL::DOUBLE AS length, NULL::DOUBLE AS area, lon AS minx, lat AS miny, lon AS maxx, lat AS maxy FROM n WHERE len(tags) > 0 AND {_FEATURE}
    UNION ALL SELECT CASE WHEN polygon THEN 5 ELSE 4 END, id, tags, CASE WHEN NOT polygon THEN s_length END, CASE WHEN polygon THEN abs(s_area) END, minx, miny, maxx, maxy
    FROM (SELECT w.id, w.tags, s.length AS s_length, s.area AS s_area, s.minx, s.miny, s.maxx, s.maxy, coalesce(len(refs) > 3 AND refs[1] = refs[-1] AND points > 3 AND len([t FOR t IN {_KEPT_LIST} IF POLYGON_RULES]) > 0, false) AS polygon FROM w JOIN s USING (id) WHERE {_FEATURE})),
bx AS (SELECT id * 8 + type AS k, minx, miny, maxx, maxy FROM shape), {KEYED},
zoomed AS (SELECT type, id, tags, length, area, {_LAYER} AS layer, CASE WHEN type <> 3 THEN list_max([{_Z} FOR t IN {_KEPT_LIST}]) END AS zorder, keyed.key AS quadtree,
    CASE WHEN type = 3 THEN {_zoom(0).replace(" IN tags]", f" IN {_KEPT_LIST}]")} ELSE least({_zoom(1).replace(" IN tags]", f" IN {_KEPT_LIST}]")}, {_zoom(2).replace(" IN tags]", f" IN {_KEPT_LIST}]")}) END AS tag_zoom,
    CASE WHEN type = 5 THEN trunc({_res_zoom('sqrt(area / 5.0)')})::BIGINT ELSE 0 END AS size_zoom FROM shape JOIN keyed ON keyed.k = id * 8 + type),
made AS (SELECT *, CASE WHEN tag_zoom IS NOT NULL THEN greatest(tag_zoom, size_zoom) END AS minzoom FROM zoomed)
"""

SQL |= {
    "qt_fold_small": _fold(),
    "plain_shapes": f"WITH RECURSIVE {_SHAPES.replace('POLYGON_RULES', _POLYGON)} SELECT type, id, quadtree, layer, zorder, minzoom, round(length, 1) AS length, round(area / 1e4, 0) AS hectares, coalesce({_KEPT}, '') AS kept FROM made",
    "plain_shapes_to_zoom": f"WITH RECURSIVE {_SHAPES.replace('POLYGON_RULES', 'false')} SELECT type, id, minzoom, zorder FROM made WHERE minzoom <= 13",
    "dataset_update": f"""WITH new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type, id ORDER BY coalesce(info.version, -1) DESC, coalesce(file_idx, 2147483647), changetype DESC) AS nth FROM osm_changes WHERE type IS NOT NULL AND id IS NOT NULL AND changetype IN (1, 4, 5)) WHERE nth = 1),
        base AS (SELECT 0 AS type, id, info FROM {_nodes('lon lat info')} UNION ALL SELECT 1, id, info FROM {_ways('refs info')} UNION ALL SELECT 2, id, info FROM {_relations('members info')})
        SELECT type, id, 0 AS changetype, info.version AS version FROM base WHERE (type, id) NOT IN (SELECT (type, id) FROM new) UNION ALL SELECT type, id, 0, info.version FROM new WHERE changetype >= 4""",
    "way_node_pairs": f"SELECT id AS way_id, pos::INT AS pos, node AS node_id FROM (SELECT id, unnest(refs) AS node, generate_subscripts(refs, 1) - 1 AS pos FROM {_ways()}) WHERE node IS NOT NULL",
    "box_tests": f"WITH {_WAY_BOXES} SELECT id, minx <= {BOX[2]} AND maxx >= {BOX[0]} AND miny <= {BOX[3]} AND maxy >= {BOX[1]} AS touches, minx >= {BOX[0]} AND maxx <= {BOX[2]} AND miny >= {BOX[1]} AND maxy <= {BOX[3]} AS inside FROM boxes WHERE found > 0",
    "tag_edits": f"""SELECT type, id, array_to_string([t.key || '=' || coalesce(t.val, '') FOR t IN CASE WHEN h IS NULL THEN plain ELSE list_append([t FOR t IN coalesce(plain, []) IF t.key IS NULL OR t.key <> 'checked'], {{key: 'checked', val: h}}) END], ';') AS edited, first_name, last_name, residential
        FROM (SELECT type, id, [t FOR t IN tags IF t.key IS NULL OR t.key <> 'note'] AS plain, [t.val FOR t IN tags IF t.key = 'highway'][1] AS h, [t.val FOR t IN tags IF t.key = 'name'][1] AS first_name, [t.val FOR t IN tags IF t.key = 'name'][-1] AS last_name, coalesce(len([t FOR t IN tags IF t.key = 'highway' AND t.val = 'residential']) > 0, false) AS residential FROM {_elements('tags')})""",
    "tags_packed": f"SELECT type, id, coalesce(list_sum([4 + strlen(coalesce(t.key, '')) + strlen(coalesce(t.val, '')) FOR t IN tags]), 0)::INT AS bytes, coalesce(array_to_string([coalesce(t.key, '') || '=' || coalesce(t.val, '') FOR t IN tags], ';'), '') AS tags FROM {_elements('tags')} WHERE tags IS NOT NULL",
    "members_fixed": f"SELECT id, array_to_string([coalesce(replace(m.role, chr(127), chr(0)[2:]), '-') FOR m IN members], ';') AS roles, coalesce(len([m FOR m IN members IF contains(m.role, chr(127))]) > 0, false) AS odd FROM {_relations()}",
    "dates": f"SELECT type, id, strftime(make_timestamp(info.timestamp * 1000000), '%Y-%m-%dT%H:%M:%S') AS at FROM {_elements('info')}",
    "short_keys": f"SELECT type, id, CASE WHEN quadtree >= 0 THEN (((quadtree >> 23) * 32) | (quadtree & 31)) + 1 ELSE 0 END AS short, CASE WHEN quadtree >= 0 THEN quadtree ELSE -1 END AS long FROM {_KEYS}",
    "keys_of_elements": f"SELECT type, id, coalesce(quadtree, -1) AS quadtree FROM {_elements('quadtree')}",
    "id_positions": f"SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS place FROM {_elements('info')}",
    "mercator_boxes": f"""WITH {_WAY_BOXES} SELECT id, {', '.join(f"round({c} * 1e-7 / 180 * 20037508.342789244, 1) AS {c}" for c in ('minx', 'maxx'))}, {', '.join(f"round({_metres(c)}, 1) AS {c}" for c in ('miny', 'maxy'))} FROM boxes WHERE found > 0""",
}


def _ring_codes() -> str:
    """Codes by the definition: extents, containment, the centre's even-odd test, and segments of box and ring that have a point in common."""
    xs, ys = zip(*RING)
    edges = [(*RING[i - 1], *RING[i]) for i in range(len(RING))]
    ring = " UNION ALL ".join(f"SELECT {a}::DOUBLE AS ax, {b}::DOUBLE AS ay, {c}::DOUBLE AS cx, {d}::DOUBLE AS cy" for a, b, c, d in edges)
    whole = lambda v: f"trunc({v} * 1e7 + sign({v}) * 0.5)"
    side = lambda p, q, r: f"(({q}x - {p}x) * ({r}y - {p}y) - ({q}y - {p}y) * ({r}x - {p}x))"
    return f"""WITH ring AS ({ring}),
    b AS (SELECT tile_qt, {whole('(ax - (bx - ax) * 0.05)')} AS x0, {whole('(ay - (cy - ay) * 0.05)')} AS y0, {whole('(bx + (bx - ax) * 0.05)')} AS x1, {whole('(cy + (cy - ay) * 0.05)')} AS y1 FROM (SELECT DISTINCT tile_qt, ax, bx, ay, cy FROM ({_TILE_BOXES}))),
    sides AS (SELECT tile_qt, x0 AS px, y0 AS py, x1 AS qx, y0 AS qy FROM b UNION ALL SELECT tile_qt, x1, y0, x1, y1 FROM b UNION ALL SELECT tile_qt, x1, y1, x0, y1 FROM b UNION ALL SELECT tile_qt, x0, y1, x0, y0 FROM b),
    cross_ AS (SELECT DISTINCT tile_qt FROM sides JOIN ring ON greatest(px, qx) >= least(ax, cx) AND least(px, qx) <= greatest(ax, cx) AND greatest(py, qy) >= least(ay, cy) AND least(py, qy) <= greatest(ay, cy)
        AND sign({side('p', 'q', 'a')}) * sign({side('p', 'q', 'c')}) <= 0 AND sign({side('a', 'c', 'p')}) * sign({side('a', 'c', 'q')}) <= 0),
    mid AS (SELECT tile_qt, count(*) % 2 = 1 AS inside FROM b JOIN ring ON (ay > (y0 + y1) / 2) <> (cy > (y0 + y1) / 2) AND (x0 + x1) / 2 < (ax - cx) * ((y0 + y1) / 2 - cy) / (ay - cy) + cx GROUP BY tile_qt)
    SELECT b.tile_qt, CASE WHEN {min(xs)} > x1 OR {max(xs)} < x0 OR {min(ys)} > y1 OR {max(ys)} < y0 THEN 0 WHEN x0 <= {min(xs)} AND x1 >= {max(xs)} AND y0 <= {min(ys)} AND y1 >= {max(ys)} THEN 1 WHEN inside THEN 2 WHEN c.tile_qt IS NOT NULL THEN 3 ELSE 4 END AS code
    FROM b LEFT JOIN mid ON mid.tile_qt = b.tile_qt LEFT JOIN cross_ c ON c.tile_qt = b.tile_qt"""


SQL["tiles_of_ring"] = _ring_codes()
SQL["change_keys"] = f"""WITH RECURSIVE ch AS (SELECT * FROM {_NEWEST}), alive AS (SELECT * FROM ch WHERE changetype > 2),
    n AS (SELECT id, lon, lat, quadtree FROM {_nodes('lon lat quadtree')}), w AS (SELECT id, quadtree FROM {_ways('refs quadtree')}), r AS (SELECT id, members, quadtree FROM {_relations('members quadtree')}),
    nn AS (SELECT id, lon, lat FROM alive WHERE type = 0), places AS (SELECT id, lon, lat FROM n WHERE id NOT IN (SELECT id FROM nn) UNION ALL SELECT * FROM nn),
    nw AS (SELECT id, refs FROM alive WHERE type = 1), wn AS (SELECT DISTINCT id, node FROM (SELECT id, unnest(refs) AS node FROM nw) WHERE node IS NOT NULL),
    wb AS (SELECT nw.id, min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM nw LEFT JOIN wn USING (id) LEFT JOIN places ON places.id = wn.node AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY nw.id),
    bx AS (SELECT id AS k, minx, miny, maxx, maxy FROM wb UNION ALL SELECT -id - 1000000000000, lon, lat, lon, lat FROM nn), {KEYED},
    wq AS (SELECT k AS id, key AS q FROM keyed WHERE k > -1000000000000), own AS (SELECT -k - 1000000000000 AS id, key AS q FROM keyed WHERE k <= -1000000000000),
    thr AS (SELECT node AS id, {_common_of('wq.q')} AS q FROM wn JOIN wq USING (id) GROUP BY node),
    nq0 AS (SELECT coalesce(thr.id, own.id) AS id, coalesce(thr.q, own.q, -1) AS here FROM thr FULL JOIN own ON thr.id = own.id),
    nq1 AS (SELECT nq0.id, n.quadtree AS old, coalesce(n.quadtree, -1) AS old_, here FROM nq0 LEFT JOIN n ON n.id = nq0.id),
    nq AS (SELECT id, old, {_common('old_', 'here')} AS q FROM nq1),
    moved AS (SELECT 0 AS kind, id, q FROM nq WHERE old IS NULL OR q <> old UNION ALL SELECT 1, id, q FROM wq),
    mem AS (SELECT id, m.type AS kind, m.ref AS ref FROM (SELECT id, unnest(members) AS m FROM (SELECT id, members FROM r WHERE id NOT IN (SELECT id FROM alive WHERE type = 2) UNION ALL SELECT id, members FROM alive WHERE type = 2))),
    by_m AS (SELECT mem.id, {_common_of('moved.q')} AS q FROM mem JOIN moved ON moved.kind = mem.kind AND moved.id = mem.ref GROUP BY mem.id),
    rq AS (SELECT id, old, {_common('old_', 'here')} AS q FROM (SELECT by_m.id, r.quadtree AS old, coalesce(r.quadtree, -1) AS old_, by_m.q AS here FROM by_m LEFT JOIN r ON r.id = by_m.id)),
    rows_ AS (SELECT 0 AS type, id, old, q FROM nq UNION ALL SELECT 1, wq.id, w.quadtree, wq.q FROM wq LEFT JOIN w ON w.id = wq.id UNION ALL SELECT 2, id, old, q FROM rq)
    SELECT coalesce(rows_.type, ch.type) AS type, coalesce(rows_.id, ch.id) AS id, coalesce(q, ch.quadtree, -1) AS quadtree, coalesce(ch.changetype, 3) AS changetype FROM rows_ FULL JOIN ch ON ch.type = rows_.type AND ch.id = rows_.id
    WHERE coalesce(ch.changetype, 3) IN (1, 4, 5) OR old IS NULL OR q <> old"""
SQL["stream_update"] = SQL["dedupe_version"]
