"""Fixed values of the default style: keys, rules and ranks that decide what becomes which geometry."""

from __future__ import annotations

import csv
import json
from dataclasses import dataclass, field

# Keys that make an element a feature.
FEATURE_KEYS = """
aerialway aeroway amenity barrier boundary bridge building construction embankment highway historic junction landuse
leisure lock man_made military natural place power railway route service shop tourism tunnel water waterway
""".split()

# Keys kept beside the feature keys.
OTHER_KEYS = """
access addr:housename addr:housenumber addr:interpolation admin_level bicycle covered foot horse layer name oneway ref
religion surface tracktype
""".split()

# Keys (or, ending in a colon, beginnings of keys) that are dropped.
DROP_KEYS = """
note source source_ref attribution comment fixme created_by odbl project:eurosha_2012 ref:UrbIS accuracy:meters
waterway:type statscan:rbuid ref:ruian:addr ref:ruian building:ruian:type dibavod:id uir_adr:ADRESA_KOD gst:feat_id
osak:identifier maaamet:ETAK ref:FR:FANTOIR OPPDATERIN addr:city:simc addr:street:sym_ul building:usage:pl
building:use:pl teryt:simc raba:id linz2osm:objectid dcgis:gis_id nycdoitt:bin chicago:building_id lojic:bgnum
massgis:way_id import import_uuid OBJTYPE SK53_bulk:load note: source: CLC: geobase: canvec: kms: ngbe: it:fvg: KSJ2:
yh: LINZ2OSM: LINZ: WroclawGIS: naptan: tiger: gnis: NHD: nhd: mvdgis:
""".split()

# Tags that make a closed way a polygon; every value, or only those, or all but those.
POLYGON_TAGS = {
    "aeroway": ("exclude", ["taxiway"]),
    "amenity": ("all", []),
    "area": ("all", []),
    "area:highway": ("all", []),
    "barrier": ("include", ["city_wall", "ditch", "wall", "spikes"]),
    "boundary": ("all", []),
    "building": ("all", []),
    "building:part": ("all", []),
    "golf": ("all", []),
    "highway": ("include", ["services", "rest_area", "escape", "elevator"]),
    "historic": ("all", []),
    "landuse": ("all", []),
    "leisure": ("all", []),
    "man_made": ("exclude", ["cutline", "embankment", "pipeline"]),
    "military": ("all", []),
    "natural": ("exclude", ["coastline", "cliff", "ridge", "arete", "tree_row"]),
    "office": ("all", []),
    "place": ("all", []),
    "power": ("include", ["plant", "substation", "generator", "transformer"]),
    "public_transport": ("all", []),
    "railway": ("include", ["station", "turntable", "roundhouse", "platform"]),
    "shop": ("all", []),
    "tourism": ("all", []),
    "waterway": ("include", ["riverbank", "dock", "boatyard", "dam"]),
}

# ways' values from the least to the most important.
HIGHWAY_RANK = """
footway cycleway bridleway path steps pedestrian service track byway living_street residential road unclassified
tertiary tertiary_link secondary secondary_link primary primary_link trunk trunk_link motorway motorway_link siding rail
""".split()

# Drawing order by key and value.
Z_ORDER = {
    "highway": {"motorway": 380, "trunk": 370, "primary": 360, "secondary": 350, "tertiary": 340, "residential": 330, "unclassified": 330, "road": 330, "living_street": 320, "pedestrian": 310, "raceway": 300, "motorway_link": 240, "trunk_link": 230, "primary_link": 220, "secondary_link": 210, "tertiary_link": 200, "service": 150, "track": 110, "path": 100, "footway": 100, "bridleway": 100, "cycleway": 100, "steps": 90, "platform": 90},
    "construction": {"motorway": 33, "trunk": 33, "primary": 33, "secondary": 33, "tertiary": 33, "residential": 33, "unclassified": 33, "road": 33, "living_street": 32, "pedestrian": 31, "raceway": 30, "motorway_link": 24, "trunk_link": 23, "primary_link": 2, "secondary_link": 21, "tertiary_link": 20, "service": 15, "track": 11, "path": 10, "footway": 10, "bridleway": 10, "cycleway": 10, "steps": 9, "platform": 9},
    "railway": {"rail": 440, "subway": 420, "narrow_gauge": 420, "light_rail": 420, "funicular": 420, "preserved": 420, "monorail": 420, "miniature": 420, "turntable": 420, "tram": 410, "disused": 400, "construction": 400, "platform": 90},
    "aeroway": {"runway": 60, "taxiway": 50},
}

# Zoom levels by kind (0 point, 1 line, 2 polygon), key and value, for use where no table is given.
MIN_ZOOM = [
    (0, "place", "*", 10), (0, "amenity", "*", 17), (0, "shop", "*", 17), (0, "tourism", "*", 17), (0, "natural", "*", 15), (0, "highway", "*", 16), (0, "railway", "station", 12), (0, "barrier", "*", 17), (0, "power", "*", 15),
    (1, "highway", "motorway", 5), (1, "highway", "trunk", 5), (1, "highway", "primary", 8), (1, "highway", "secondary", 9), (1, "highway", "tertiary", 10), (1, "highway", "*", 13), (1, "railway", "rail", 8), (1, "railway", "*", 12), (1, "waterway", "river", 8), (1, "waterway", "*", 13), (1, "boundary", "*", 10), (1, "power", "*", 14), (1, "route", "*", 10),
    (2, "building", "*", 13), (2, "landuse", "*", 10), (2, "leisure", "*", 10), (2, "natural", "*", 8), (2, "amenity", "*", 12), (2, "boundary", "*", 8), (2, "shop", "*", 13), (2, "tourism", "*", 12), (2, "water", "*", 8),
]


@dataclass(frozen=True)
class ParentTag:
    """A node with ``node_key`` gets ``out_key``: the highest ranked value of ``way_key`` on the ways through it; without ranks, that of the first way."""

    out_key: str
    node_key: str
    way_key: str
    ranks: tuple[str, ...] = ()


@dataclass(frozen=True)
class RelationTag:
    """A member way gets ``target``: min, max or list of ``source`` over the relations with all tags of ``where`` (``*``: any value)."""

    target: str
    where: tuple[tuple[str, str], ...]
    source: str
    how: str


# Tags that nodes get from ways, and ways from relations.
PARENT_TAGS = (ParentTag("parent_highway", "highway", "highway", tuple(HIGHWAY_RANK)), ParentTag("parent_highway", "railway", "highway", tuple(HIGHWAY_RANK)), ParentTag("parent_service", "highway", "service"))
RELATION_TAGS = (
    RelationTag("min_admin_level", (("type", "boundary"), ("boundary", "administrative")), "admin_level", "min"),
    RelationTag("max_admin_level", (("type", "boundary"), ("boundary", "administrative")), "admin_level", "max"),
    RelationTag("bus_routes", (("type", "route"), ("route", "bus")), "ref", "list"),
    RelationTag("bicycle_routes", (("type", "route"), ("route", "bicycle")), "ref", "list"),
)


@dataclass(frozen=True)
class Style:
    """What to keep and how to judge it. ``other_keys`` None keeps every other key; ``all_objects`` keeps elements without a feature key too."""

    feature_keys: tuple[str, ...] = tuple(FEATURE_KEYS)
    other_keys: tuple[str, ...] | None = None
    drop_keys: tuple[str, ...] = tuple(DROP_KEYS)
    polygon_tags: dict = field(default_factory=lambda: POLYGON_TAGS)
    parent_tags: tuple[ParentTag, ...] = PARENT_TAGS
    relation_tags: tuple[RelationTag, ...] = RELATION_TAGS
    min_zoom: tuple = tuple(MIN_ZOOM)
    multipolygons: bool = True
    boundaries: bool = True
    all_objects: bool = False
    min_length: float = 0.0
    min_area: float = 5.0

    def to_json(self) -> dict:
        """The style as plain values; ``from_json`` gives it back. Zooms and least sizes aren't part of it."""
        ranks = lambda s: {v: k for k, v in enumerate(s.ranks)}
        parents: dict[str, dict] = {}
        for s in self.parent_tags:
            entry = parents.setdefault(s.out_key, {"node_keys": [], "way_key": s.way_key, "way_priority": ranks(s)})
            entry["node_keys"].append(s.node_key)
        relations = [{"target_key": r.target, "source_filter": dict(r.where), "source_key": r.source, "type": r.how} for r in self.relation_tags]
        polygons = {k: "all" if how == "all" else {how: list(vals)} for k, (how, vals) in self.polygon_tags.items()}
        return {
            "feature_keys": list(self.feature_keys), "other_keys": None if self.other_keys is None else list(self.other_keys), "drop_keys": sorted(self.drop_keys), "polygon_tags": polygons,
            "parent_tags": parents, "relation_tag_spec": relations, "multipolygons": self.multipolygons, "boundary_relations": self.boundaries, "all_objs": self.all_objects,
        }

    @staticmethod
    def from_json(value: dict, **more) -> Style:
        """A style of plain values; what they lack, zooms and least sizes are the default's or those of ``more``."""
        base = Style()
        polygons = {k: ("all", []) if v == "all" else next((how, list(v[how])) for how in ("include", "exclude") if how in v) for k, v in value.get("polygon_tags", {}).items()} if "polygon_tags" in value else base.polygon_tags
        parents = base.parent_tags
        if "parent_tags" in value:
            parents = tuple(ParentTag(out, node, e["way_key"], tuple(sorted(e.get("way_priority") or {}, key=(e.get("way_priority") or {}).get))) for out, e in value["parent_tags"].items() for node in e["node_keys"])
        relations = base.relation_tags
        if "relation_tag_spec" in value:
            relations = tuple(RelationTag(r["target_key"], tuple(dict(r["source_filter"]).items()), r["source_key"], r["type"]) for r in value["relation_tag_spec"])
        other = value.get("other_keys")
        return Style(
            tuple(value.get("feature_keys", base.feature_keys)), None if other is None else tuple(other), tuple(value.get("drop_keys") or ()), polygons, parents, relations,
            multipolygons=value.get("multipolygons", True), boundaries=value.get("boundary_relations", True), all_objects=value.get("all_objs", False), **more,
        )


def read_min_zoom(path: str) -> tuple:
    """Rows (kind, key, value, zoom) of a CSV file; of rows that agree in the first three the first counts."""
    from tilewright.sources.files import read_text

    return tuple((int(r[0]), r[1], r[2], int(r[3])) for r in csv.reader(read_text(path).splitlines()) if len(r) > 3)


def read_style(path: str, **more) -> Style:
    """Style of a JSON file."""
    from tilewright.sources.files import read_text

    return Style.from_json(json.loads(read_text(path)), **more)
