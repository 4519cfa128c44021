"""Relational statistics: filters, joins, aggregates, windows, orders and set operations over the tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators import relational as R
from scriptorium.storage import table


@query("SELECT count(*) AS n, count(DISTINCT document_id) AS documents, sum(token_count) AS tokens FROM chunks")
def chunk_totals(spark, d):
    return table(spark, d, "chunks").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"), F.sum("token_count").alias("tokens"))


@query("SELECT document_type, count(*) AS n FROM documents GROUP BY document_type")
def type_counts(spark, d):
    return table(spark, d, "documents").groupBy("document_type").agg(F.count("*").alias("n"))


@query("SELECT category, document_type, count(*) AS n FROM documents GROUP BY ALL")
def category_type_crosstab(spark, d):
    return table(spark, d, "documents").groupBy("category", "document_type").agg(F.count("*").alias("n"))


@query("""SELECT document_type, count(*) FILTER (WHERE published_at < DATE '2024-07-01') AS before, count(*) FILTER (WHERE published_at >= DATE '2024-07-01') AS after,
  count(*) FILTER (WHERE published_at IS NULL) AS undated, min(published_at) AS first, max(published_at) AS last FROM documents GROUP BY document_type""")
def cutoff_distribution(spark, d):
    return R.cutoff_counts(table(spark, d, "documents"), "document_type", "published_at", "2024-07-01")


@query("SELECT document_type, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.document_id = d.doc_id) GROUP BY document_type")
def documents_without_chunks(spark, d):
    missing = R.without_children(table(spark, d, "documents"), table(spark, d, "chunks"), "doc_id", "document_id")
    return missing.groupBy("document_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, title FROM documents d WHERE NOT EXISTS (SELECT 1 FROM document_entities e WHERE e.document_id = d.doc_id)")
def documents_without_entities(spark, d):
    return R.without_children(table(spark, d, "documents"), table(spark, d, "document_entities"), "doc_id", "document_id").select("doc_id", "title")


@query("""SELECT d.document_type, count(*) AS chunks, count(*) FILTER (WHERE c.content_tokenized IS NULL) AS untokenized, count(*) FILTER (WHERE c.token_count IS NOT NULL) AS counted
  FROM chunks c JOIN documents d ON c.document_id = d.doc_id GROUP BY 1""")
def null_tokens_by_type(spark, d):
    joined = R.chunks_with_documents(table(spark, d, "chunks"), table(spark, d, "documents").select("doc_id", "document_type"))
    return joined.groupBy("document_type").agg(F.count("*").alias("chunks"), F.count_if(F.col("content_tokenized").isNull()).alias("untokenized"), F.count("token_count").alias("counted"))


@query("""SELECT d.doc_id, s.name AS source_name, s.trust_level, (SELECT count(*) FROM chunks c WHERE c.document_id = d.doc_id) AS chunks FROM documents d JOIN sources s ON d.source_id = s.id""")
def chunk_counts_per_document(spark, d):
    docs, sources = table(spark, d, "documents").select("doc_id", "source_id"), table(spark, d, "sources")
    counted = R.child_counts(docs, table(spark, d, "chunks"), "doc_id", "document_id", "chunks")
    return counted.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "trust_level"), "source_id").select("doc_id", "source_name", "trust_level", "chunks")


@query("""SELECT p.id AS paper_id, r.section, count(c.id) AS citations FROM papers p CROSS JOIN (SELECT unnest(['introduction', 'body', 'conclusion']) AS section) r
  LEFT JOIN paper_citations c ON c.paper_id = p.id AND c.section = r.section GROUP BY ALL""")
def coverage_by_section(spark, d):
    return R.section_coverage(table(spark, d, "papers"), table(spark, d, "paper_citations"), ["introduction", "body", "conclusion"])


@query("SELECT doc_id, published_at, created_at FROM documents ORDER BY published_at DESC NULLS LAST, created_at DESC NULLS LAST, doc_id LIMIT 10")
def latest_ten(spark, d):
    return table(spark, d, "documents").select("doc_id", "published_at", "created_at").orderBy(F.desc_nulls_last("published_at"), F.desc_nulls_last("created_at"), "doc_id").limit(10)


@query("SELECT doc_id, document_type, row_number() OVER (PARTITION BY document_type ORDER BY published_at DESC NULLS LAST, doc_id) AS rank FROM documents QUALIFY rank <= 5")
def newest_per_type(spark, d):
    w = W.partitionBy("document_type").orderBy(F.desc_nulls_last("published_at"), "doc_id")
    return table(spark, d, "documents").select("doc_id", "document_type", F.row_number().over(w).alias("rank")).where("rank <= 5")


@query("SELECT doc_id FROM documents WHERE category = '저작권' AND published_at >= DATE '2024-06-01' AND document_type IN ('news', 'official', 'policy') AND url IS NOT NULL")
def filtered_documents(spark, d):
    docs = R.metadata_filter(table(spark, d, "documents"), category="저작권", published_after="2024-06-01")
    return docs.where(F.col("document_type").isin("news", "official", "policy") & F.col("url").isNotNull()).select("doc_id")


@query("SELECT doc_id FROM documents WHERE length(text) >= 200 AND regexp_matches(title, '(?i)licen[cs]e|voice|저작권') AND url IS NOT NULL AND regexp_matches(url, '^https://')")
def long_relevant_documents(spark, d):
    return R.relevant(table(spark, d, "documents"), least=200, pattern="licen[cs]e|voice|저작권").where(F.col("url").rlike("^https://")).select("doc_id")


@query("SELECT chunk_id, count(*) AS n, count(DISTINCT paper_id) AS papers, max(relevance_score) AS best, round(avg(CAST(relevance_score AS DOUBLE)), 9) AS mean FROM paper_citations GROUP BY chunk_id")
def citations_per_chunk(spark, d):
    return table(spark, d, "paper_citations").groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_distinct("paper_id").alias("papers"), F.max("relevance_score").alias("best"), F.round(F.avg(F.col("relevance_score").cast("double")), 9).alias("mean"))


@query("""SELECT source_type, count(*) AS collected, count(*) FILTER (WHERE doc_id IS NULL) AS empty, count(*) FILTER (WHERE text IS NULL) AS textless, count(DISTINCT content_hash) AS contents
  FROM sources s LEFT JOIN documents d ON d.source_id = s.id GROUP BY GROUPING SETS ((source_type), ())""")
def collection_report(spark, d):
    """Counters per kind of source and in total."""
    joined = table(spark, d, "sources").select("id", "source_type").join(table(spark, d, "documents").select(F.col("source_id").alias("id"), "doc_id", "text", "content_hash"), "id", "left")
    return R.report(joined, "source_type", F.count("*").alias("collected"), F.count_if(F.col("doc_id").isNull()).alias("empty"), F.count_if(F.col("text").isNull()).alias("textless"), F.count_distinct("content_hash").alias("contents"))


@query("""WITH w AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS rn FROM papers) SELECT id, CAST(floor((rn - 1) / 40) AS BIGINT) AS batch FROM w""")
def id_batches(spark, d):
    return R.batches(table(spark, d, "papers").select("id", "created_at"), ["created_at", "id"], 40).select("id", "batch")


@query("SELECT unnest(['Dataset', 'Venue', 'Law', 'Case']) AS missing EXCEPT SELECT entity_type FROM entities")
def missing_entity_types(spark, d):
    """Required values that a column doesn't have."""
    return R.missing_values(table(spark, d, "entities"), "entity_type", ["Dataset", "Venue", "Law", "Case"], "missing")


@query("""SELECT coalesce(v.doc_id, k.doc_id) AS doc_id, v.rank AS by_date, k.rank AS by_size FROM
  (SELECT doc_id, row_number() OVER (ORDER BY published_at DESC NULLS LAST, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50) v FULL OUTER JOIN
  (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50) k ON v.doc_id = k.doc_id""")
def ranks_full_outer(spark, d):
    docs = table(spark, d, "documents")
    a = R.top_ranked(docs.select("doc_id", "published_at"), [F.desc_nulls_last("published_at"), F.asc("doc_id")], 50).select("doc_id", F.col("rank").alias("by_date"))
    b = R.top_ranked(docs.select("doc_id", "n_chars"), [F.desc_nulls_last("n_chars"), F.asc("doc_id")], 50).select("doc_id", F.col("rank").alias("by_size"))
    return a.join(b, "doc_id", "full_outer")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 9) AS k FROM events GROUP BY event_type")
def event_totals(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg(F.get_json_object("props", "$.k").cast("double")), 9).alias("k"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS discount, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def line_totals(spark, d):
    return (
        table(spark, d, "lineitem")
        .where("l_shipdate <= timestamp'1998-09-02'")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("discount"), F.count("*").alias("n"))
    )


@query("SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 40) GROUP BY 1")
def orders_with_large_lines(spark, d):
    large = table(spark, d, "lineitem").where("l_quantity >= 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(large, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("done"))


@query("""SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def customers_by_nation(spark, d):
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
