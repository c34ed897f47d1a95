"""Functions of tag lists: arrays of structs (key, val) in which keys may repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.style import Z_ORDER

NONE = "array<struct<key:string,val:string>>"


def find_tag(tags: Column, key: str) -> Column:
    """Value of the first tag with the key; null if there is none."""
    return F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["val"]


def last_tag(tags: Column, key: str) -> Column:
    """Value of the last tag with the key."""
    return F.try_element_at(F.filter(tags, lambda t: t["key"] == key), F.lit(-1))["val"]


def has_tag(tags: Column, key: str, val: str = "*") -> Column:
    """Whether a tag has the key and the value (``*``: any)."""
    return F.coalesce(F.exists(tags, lambda t: (t["key"] == key) & (F.lit(True) if val == "*" else F.coalesce(t["val"] == val, F.lit(False)))), F.lit(False))


def remove_tag(tags: Column, key: str) -> Column:
    return F.filter(tags, lambda t: F.coalesce(t["key"] != key, F.lit(True)))


def set_tag(tags: Column, key: str, val: Column) -> Column:
    """The tag added at the end, others of its key removed; unchanged where ``val`` is null."""
    added = F.array(F.struct(F.lit(key).alias("key"), val.alias("val")))
    return F.when(val.isNull(), tags).otherwise(F.concat(F.coalesce(remove_tag(tags, key), F.array().cast(NONE)), added))


def fix_text(text: Column) -> Column:
    """Without the delete character."""
    return F.translate(text, chr(127), "")


def fix_tags(tags: Column) -> Column:
    """Delete characters removed, sorted by key (then value)."""
    return F.array_sort(F.transform(tags, lambda t: F.struct(fix_text(t["key"]).alias("key"), fix_text(t["val"]).alias("val"))))


def has_delete_character(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: (F.instr(t["key"], chr(127)) > 0) | (F.instr(t["val"], chr(127)) > 0)), F.lit(False))


def fix_members(members: Column) -> Column:
    """Members whose roles have no delete characters."""
    return F.transform(members, lambda m: m.withField("role", fix_text(m["role"])))


def roles_have_delete_character(members: Column) -> Column:
    return F.coalesce(F.exists(members, lambda m: F.instr(m["role"], chr(127)) > 0), F.lit(False))


def is_dropped(key: Column, drop_keys: list[str]) -> Column:
    """The key itself, or its beginning through the first colon, is to be dropped."""
    return key.isin(*drop_keys) | F.concat(F.substring_index(key, ":", 1), F.lit(":")).isin(*drop_keys) & key.contains(":") if drop_keys else F.lit(False)


def filter_tags(tags: Column, feature_keys: list[str], other_keys: list[str] | None, drop_keys: list[str]) -> Column:
    """Tags to keep: feature keys always, other keys if listed (None: all) and not dropped. Tags without a key go."""
    def kept(t: Column) -> Column:
        other = F.lit(True) if other_keys is None else t["key"].isin(*other_keys) if other_keys else F.lit(False)
        return F.coalesce(t["key"].isin(*feature_keys) | (other & ~is_dropped(t["key"], drop_keys)), F.lit(False))

    return F.coalesce(F.filter(tags, kept), F.array().cast(NONE))


def is_feature(tags: Column, feature_keys: list[str]) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t["key"].isin(*feature_keys)), F.lit(False))


def layer(tags: Column) -> Column:
    """The ``layer`` tag as a number; null if it isn't one."""
    return find_tag(tags, "layer").try_cast("bigint")


def is_polygon(tags: Column, rules: dict[str, tuple[str, list[str]]]) -> Column:
    """Whether any tag makes a closed way a polygon."""
    every = [k for k, (how, _) in rules.items() if how == "all"]
    only = [k + "=" + v for k, (how, vals) in rules.items() if how == "include" for v in vals]
    but = [k for k, (how, _) in rules.items() if how == "exclude"]
    but_not = [k + "=" + v for k, (how, vals) in rules.items() if how == "exclude" for v in vals]

    def passes(t: Column) -> Column:
        pair = F.concat_ws("=", t["key"], F.coalesce(t["val"], F.lit("")))
        some = F.lit(False)
        if every:
            some = some | t["key"].isin(*every)
        if only:
            some = some | pair.isin(*only)
        if but:
            some = some | (t["key"].isin(*but) & ~pair.isin(*but_not))
        return F.coalesce(some, F.lit(False))

    return F.coalesce(F.exists(tags, passes), F.lit(False))


def _lookup(pairs: dict[str, int]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in pairs]), F.array(*[F.lit(v).cast("bigint") for v in pairs.values()]))


def z_order(tags: Column) -> Column:
    """Greatest drawing order of the tags; null if none has one."""
    table = _lookup({f"{k}={v}": z for k, vals in Z_ORDER.items() for v, z in vals.items()})
    return F.array_max(F.transform(tags, lambda t: F.try_element_at(table, F.concat_ws("=", t["key"], F.coalesce(t["val"], F.lit(""))))))


def tag_zoom(tags: Column, kinds: list[int], table: tuple) -> Column:
    """Least zoom of the tags: a row with the tag's value goes before one with ``*``; of equal rows the first counts."""
    found: dict[str, int] = {}
    for kind, key, val, zoom in table:
        found.setdefault(f"{kind}|{key}={val}", zoom)
    if not found:
        return F.lit(None).cast("bigint")
    zooms = _lookup(found)
    at = lambda kind, t, val: F.try_element_at(zooms, F.concat(F.lit(f"{kind}|"), t["key"], F.lit("="), val))

    def of(kind: int) -> Column:
        return F.transform(tags, lambda t: F.coalesce(at(kind, t, F.coalesce(t["val"], F.lit(""))), at(kind, t, F.lit("*"))))

    each = [of(kind) for kind in kinds]
    return F.least(*[F.array_min(e) for e in each]) if len(each) > 1 else F.array_min(each[0])


def leading_number(val: Column) -> Column:
    """The integer that a text starts with, after blanks; null if there is none or it is too long."""
    return F.regexp_extract(val, r"^\s*([+-]?\d+)", 1).try_cast("bigint")


def as_json(tags: Column) -> Column:
    """Object of the tags sorted by key; of repeated keys the first; tags without a key are left out."""
    known = F.array_sort(F.filter(tags, lambda t: t["key"].isNotNull()), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    firsts = F.filter(F.transform(known, lambda t, i: F.struct(t["key"].alias("key"), t["val"].alias("val"), ((i == 0) | (F.get(known, i - 1)["key"] != t["key"])).alias("first"))), lambda t: t["first"])
    return F.to_json(F.map_from_arrays(F.transform(firsts, lambda t: t["key"]), F.transform(firsts, lambda t: t["val"])), {"ignoreNullFields": "false"})


def _quoted(text: Column) -> Column:
    """Quotes and backslashes escaped, line ends dropped."""
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(text, F.lit("\n"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def as_hstore(tags: Column) -> Column:
    """hstore text ``"key"=>"val"`` joined by commas, in stored order; null values as NULL, tags without a key left out."""
    return F.array_join(F.transform(F.filter(tags, lambda t: t["key"].isNotNull()), lambda t: F.concat(_quoted(t["key"]), F.lit("=>"), F.coalesce(_quoted(t["val"]), F.lit("NULL")))), ",")


def shows_by(tags: Column, kinds: list[int], table: tuple, zoom: int) -> Column:
    """Whether the tags alone let an element show at ``zoom``, before it has a geometry; false for tags without a zoom."""
    return F.coalesce(tag_zoom(tags, kinds, table) <= zoom, F.lit(False))
