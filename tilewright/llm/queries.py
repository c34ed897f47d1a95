"""Queries over texts and terms, and the SQL (DuckDB) that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.frequency import marked_terms
from tilewright.llm.leaks import edited_items, leaked_items
from tilewright.llm.mojibake import garbled_documents, restored_documents
from tilewright.llm.tokenize import encode_texts
from tilewright.operators.current import current_rows


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tagged(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (current_rows(_table(spark, folder, name), ["tags"]).select("tags") for name in ("osm_nodes", "osm_ways", "osm_relations")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Tag pairs in fewer than 3 elements or in at least a twentieth of the tagged elements."""
    return marked_terms(_tagged(spark, folder), "tags").where("mark is not null").select(F.col("key").alias("tag_key"), F.col("val").alias("tag_val"), "mark")


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Occurrences and elements of every tag pair."""
    return marked_terms(_tagged(spark, folder), "tags").select(F.col("key").alias("tag_key"), F.col("val").alias("tag_val"), "occurrences", F.col("records").alias("elements"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(_table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with at least 13 consecutive words of an item."""
    return leaked_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items")).where("run >= 13").select("doc_id", "item_id")


def p9_edited(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose best alignment with an item scores as 13 equal words do, with score and longest run."""
    return edited_items(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"), 26).select("doc_id", "item_id", "score", "run")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text that was decoded wrongly."""
    return garbled_documents(_table(spark, folder, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Garbled documents with their restored text."""
    return restored_documents(_table(spark, folder, "documents")).select("doc_id", "restored")


QUERIES = {f.__name__: f for f in (p4_found, p4_counts, p8_ids, p9_found, p9_edited, p10_found, p10_restored)}

_PAIRS = """
WITH cur AS (
    SELECT 0 AS kind, id, arg_max({'t': tags}, coalesce(info.version, -1)).t AS tags FROM osm_nodes WHERE id IS NOT NULL GROUP BY id
    UNION ALL SELECT 1, id, arg_max({'t': tags}, coalesce(info.version, -1)).t FROM osm_ways WHERE id IS NOT NULL GROUP BY id
    UNION ALL SELECT 2, id, arg_max({'t': tags}, coalesce(info.version, -1)).t FROM osm_relations WHERE id IS NOT NULL GROUP BY id),
flat AS (SELECT kind, id, unnest(tags) AS t FROM cur),
counts AS (SELECT t.key AS tag_key, t.val AS tag_val, count(*) AS occurrences, count(DISTINCT (kind, id)) AS elements FROM flat WHERE t.key IS NOT NULL AND t.val IS NOT NULL GROUP BY ALL)
"""

_NOISE = r"</?\p{L}[^<>]*>|\[/?\p{L}[^\[\]]*\]|&#?[0-9A-Za-z]{1,10};"


def _windows(name: str, key: str) -> str:
    words = rf"[replace(lower(x), 'ß', 'ss') FOR x IN regexp_extract_all(regexp_replace(text, '{_NOISE}', ' ', 'g'), '[\p{{L}}\p{{N}}]+')]"
    return f"SELECT DISTINCT {key}, array_to_string(ws[i:i + 12], ' ') AS passage FROM (SELECT {key}, ws, unnest(range(1, len(ws) - 11)) AS i FROM (SELECT {key}, {words} AS ws FROM {name} WHERE text IS NOT NULL))"


SQL: dict[str, str] = {
    "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({_windows('documents', 'doc_id')}) JOIN ({_windows('eval_items', 'item_id')}) USING (passage)",
    "p4_found": _PAIRS + "SELECT tag_key, tag_val, CASE WHEN elements < 3 THEN 'rare' ELSE 'common' END AS mark FROM counts WHERE elements < 3 OR elements * 20 >= (SELECT count(*) FROM cur WHERE len(tags) > 0)",
    "p4_counts": _PAIRS + "SELECT * FROM counts",
}
