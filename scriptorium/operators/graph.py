"""A property graph as two frames: upserts of vertices and edges, links of documents and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The kinds of vertices and relations that the graph knows.
KINDS = ("Artist", "Company", "AIModel", "Topic", "Case", "Law")
RELATIONS = ("DISCUSSES", "MENTIONS", "DEVELOPS", "RELATED_TO", "CITES")


def upsert_vertices(rows: DataFrame) -> DataFrame:
    """label, key, name: one vertex per label and key with the last name by (created_at, id); unknown labels and null keys are left out."""
    known = rows.where(F.col("entity_type").isin(*KINDS) & F.col("neo4j_node_key").isNotNull())
    return known.groupBy(F.col("entity_type").alias("label"), F.col("neo4j_node_key").alias("key")).agg(F.max_by("name", F.struct("created_at", "id")).alias("name"))


def upsert_edges(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """document_id, relation, label, key, confidence of the last row by (created_at, id). A missing or zero confidence is 0.5."""
    known = rows.where(F.col("relation_type").isin(*RELATIONS))
    vertices = entities.where(F.col("entity_type").isin(*KINDS) & F.col("neo4j_node_key").isNotNull()).select(F.col("id").alias("entity_id"), F.col("entity_type").alias("label"), F.col("neo4j_node_key").alias("key"))
    sure = F.coalesce(F.nullif(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(0.5))
    joined = known.join(vertices, "entity_id")
    return joined.groupBy("document_id", F.col("relation_type").alias("relation"), "label", "key").agg(F.round(F.max_by(sure, F.struct("created_at", "id")), 6).alias("confidence"))


def upsert_names(existing: DataFrame, new: DataFrame) -> DataFrame:
    """normalized_name, entity_type, name: existing names stay, new keys come with the name of their least id."""
    keys = ["normalized_name", "entity_type"]
    old = existing.groupBy(*keys).agg(F.min_by("name", "id").alias("old"))
    fresh = new.groupBy(*keys).agg(F.min_by("name", "id").alias("fresh"))
    return old.join(fresh, keys, "full_outer").select(*keys, F.coalesce("old", "fresh").alias("name"))


def new_links(existing: DataFrame, new: DataFrame) -> DataFrame:
    """document_id, entity_id, relation_type that the existing links lack; null relations match each other."""
    keys = ["document_id", "entity_id", "relation_type"]
    a, b = new.select(*keys).distinct().alias("a"), existing.select(*keys).alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, same[0] & same[1] & same[2], "left_anti")


def broken_uniqueness(rows: DataFrame) -> DataFrame:
    """entity_type, normalized_name, n of keys that more than one row carries."""
    return rows.groupBy("entity_type", "normalized_name").agg(F.count("*").alias("n")).where("n > 1")
