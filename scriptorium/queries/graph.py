"""The graph of documents and entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators import graph as G
from scriptorium.storage import table

_KNOWN = "entity_type IN ('Artist', 'Company', 'AIModel', 'Topic', 'Case', 'Law') AND neo4j_node_key IS NOT NULL"
_REL = "relation_type IN ('DISCUSSES', 'MENTIONS', 'DEVELOPS', 'RELATED_TO', 'CITES')"


@query(f"SELECT entity_type AS label, neo4j_node_key AS key, arg_max(name, (created_at, id)) AS name FROM entities WHERE {_KNOWN} GROUP BY ALL")
def graph_vertices(spark, d):
    return G.upsert_vertices(table(spark, d, "entities"))


@query(f"""SELECT document_id, relation_type AS relation, entity_type AS label, neo4j_node_key AS key, round(arg_max(coalesce(nullif(CAST(confidence AS DOUBLE), 0.0), 0.5), (l.created_at, l.id)), 6) AS confidence
  FROM document_entities l JOIN entities e ON e.id = l.entity_id WHERE {_KNOWN} AND {_REL} GROUP BY ALL""")
def graph_edges(spark, d):
    return G.upsert_edges(table(spark, d, "document_entities"), table(spark, d, "entities"))


@query("""WITH o AS (SELECT normalized_name, entity_type, arg_min(name, id) AS name FROM entities WHERE created_at < TIMESTAMPTZ '2025-01-01 00:00:00+00' GROUP BY ALL),
  n AS (SELECT normalized_name, entity_type, arg_min(name, id) AS name FROM entities WHERE created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' GROUP BY ALL)
  SELECT normalized_name, entity_type, coalesce(o.name, n.name) AS name FROM o FULL JOIN n USING (normalized_name, entity_type)""")
def entity_upsert(spark, d):
    rows = table(spark, d, "entities")
    cut = F.lit("2025-01-01").cast("timestamp")
    return G.upsert_names(rows.where(F.col("created_at") < cut), rows.where(F.col("created_at") >= cut))


@query("""WITH l AS (SELECT DISTINCT document_id, entity_id, relation_type, created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AS new FROM document_entities)
  SELECT document_id, entity_id, relation_type FROM l WHERE new EXCEPT SELECT document_id, entity_id, relation_type FROM l WHERE NOT new""")
def new_entity_links(spark, d):
    rows = table(spark, d, "document_entities")
    cut = F.lit("2025-01-01").cast("timestamp")
    return G.new_links(rows.where(F.col("created_at") < cut), rows.where(F.col("created_at") >= cut))


@query("SELECT entity_type, normalized_name, count(*) AS n FROM entities GROUP BY ALL HAVING n > 1")
def entity_uniqueness(spark, d):
    return G.broken_uniqueness(table(spark, d, "entities"))


@query("""SELECT e.entity_type, l.relation_type, count(*) AS links, count(DISTINCT l.document_id) AS documents, round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence FROM document_entities l JOIN entities e ON e.id = l.entity_id GROUP BY ALL""")
def link_statistics(spark, d):
    joined = table(spark, d, "document_entities").join(table(spark, d, "entities").select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
    return joined.groupBy("entity_type", "relation_type").agg(F.count("*").alias("links"), F.count_distinct("document_id").alias("documents"), F.round(F.avg(F.col("confidence").cast("double")), 6).alias("confidence"))
