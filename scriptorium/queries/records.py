"""Records between services, paging, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query

from scriptorium.operators import records as R
from scriptorium.plans import retrieval as P
from scriptorium.queries.retrieval import _inputs
from scriptorium.sources.readers import unseen
from scriptorium.storage import table


@query("""SELECT doc_id, url FROM documents WHERE created_at >= TIMESTAMPTZ '2025-01-01 00:00:00+00' AND (url IS NULL OR url NOT IN (SELECT url FROM documents WHERE url IS NOT NULL AND created_at < TIMESTAMPTZ '2025-01-01 00:00:00+00'))""")
def new_urls(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "url", "created_at")
    cut = F.lit("2025-01-01").cast("timestamp")
    return unseen(docs.where(F.col("created_at") >= cut), docs.where(F.col("created_at") < cut), "url").select("doc_id", "url")


@query("SELECT id, concat_ws(chr(10) || chr(10), abstract, introduction, conclusion) AS content FROM papers")
def joined_parts(spark, d):
    return table(spark, d, "papers").select("id", F.concat_ws("\n\n", "abstract", "introduction", "conclusion").alias("content"))


@query("SELECT id FROM papers ORDER BY created_at, id LIMIT 20 OFFSET 10")
def second_page(spark, d):
    return table(spark, d, "papers").orderBy("created_at", "id").offset(10).limit(20).select("id")


@query("SELECT sample_id, metadata.license AS license FROM train_balanced WHERE metadata.license IN ('KEEP') OR metadata.license IS NULL OR trim(metadata.license) = ''")
def allowed_or_missing(spark, d):
    return table(spark, d, "train_balanced").select("sample_id", F.col("metadata.license").alias("license")).where(R.allowed(F.col("license"), ["KEEP"]))


@query("""SELECT document_id, true AS is_relevant, list_sort(list(DISTINCT name) FILTER (WHERE entity_type <> 'Venue')) AS names, count(*) AS relations, round(sum(coalesce(nullif(CAST(confidence AS DOUBLE), 0.0), 0.5)), 4) AS confidence
  FROM document_entities l JOIN entities e ON e.id = l.entity_id WHERE relation_type IS NOT NULL GROUP BY document_id""")
def parsed_extractions(spark, d):
    """Answers of an extraction model made from the links, with an unknown kind among them, and parsed again."""
    links = table(spark, d, "document_entities").where("relation_type is not null").join(table(spark, d, "entities").select(F.col("id").alias("entity_id"), "name", "entity_type"), "entity_id")
    relation = F.struct(F.col("name").alias("entity_name"), "entity_type", "relation_type", F.col("confidence").cast("double").alias("confidence"))
    grouped = links.groupBy("document_id").agg(F.collect_set(F.struct("name", "entity_type")).alias("entities"), F.collect_list(relation).alias("relations"))
    strange = F.array(F.struct(F.lit("x").alias("name"), F.lit("Venue").alias("entity_type")))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.lit(True).alias("is_relevant"), F.concat("entities", strange).alias("entities"), "relations")), F.lit("\n```"))
    x = grouped.select("document_id", R.parsed_extraction(answer).alias("x"))
    names = F.array_sort(F.array_distinct(F.transform("x.entities", lambda e: e["name"])))
    return x.select("document_id", "x.is_relevant", names.alias("names"), F.size("x.relations").alias("relations"), F.round(F.aggregate("x.relations", F.lit(0.0), lambda a, r: a + r["confidence"]), 4).alias("confidence"))


@query("SELECT id, CASE WHEN d.doc_id IS NULL THEN claim_text ELSE claim_text || ' [1]' END AS text FROM paper_citations c LEFT JOIN documents d ON d.doc_id = c.document_id")
def numbered_citations(spark, d):
    rows = table(spark, d, "paper_citations").join(table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit(True).alias("known")), "document_id", "left")
    ids = F.when(F.col("known"), F.array("chunk_id")).otherwise(F.array().cast("array<string>"))
    return rows.select("id", R.numbered(F.concat("claim_text", F.lit(" ["), "chunk_id", F.lit("] [none]")), ids).alias("text"))


@query("""WITH r AS (SELECT paper_id, document_id, min(id) AS first FROM paper_citations GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY first) AS k FROM r)
  SELECT paper_id, list(k ORDER BY k) AS numbers FROM n GROUP BY paper_id""")
def trailing_numbers(spark, d):
    order = table(spark, d, "paper_citations").groupBy("paper_id", "document_id").agg(F.min("id").alias("first"))
    ids = order.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("first", F.col("document_id").cast("string").alias("d")))).alias("a"))
    cited = F.transform("a", lambda x: x["d"])
    return ids.select("paper_id", R.trailing_numbers(F.concat(cited, cited), cited, F.lit("no number yet")).alias("numbers"))


@query("SELECT id, rtrim(body, E'\\n ') AS body FROM papers WHERE body IS NOT NULL AND trim(body, E'\\n ') <> ''")
def references_stripped(spark, d):
    body = F.concat("body", F.lit("\nReferences\n[1] x"))
    return table(spark, d, "papers").where("trim(BOTH '\n ' FROM body) <> ''").select("id", F.rtrim(R.without_references(body), F.lit("\n ")).alias("body"))


@query("SELECT id AS chunk_id, CAST(document_id AS VARCHAR) AS document_id, content FROM chunks WHERE trim(content) <> ''")
def service_contexts(spark, d):
    return R.contexts(table(spark, d, "chunks"))


@query("SELECT map_from_entries(list((k, n) ORDER BY k)) AS counts FROM (SELECT coalesce(category, 'none') AS k, count(*) AS n FROM documents GROUP BY 1)")
def category_counters(spark, d):
    return R.counter_map(table(spark, d, "documents"), "category")


@query("SELECT doc_id, list_transform([10, 23, 40, 17], lambda p: CAST(floor(n_chars * p / 100) AS BIGINT)) || [n_chars - CAST(list_sum(list_transform([10, 23, 40, 17], lambda p: floor(n_chars * p / 100))) AS BIGINT)] AS parts FROM documents WHERE n_chars IS NOT NULL")
def length_budgets(spark, d):
    return table(spark, d, "documents").where("n_chars is not null").select("doc_id", R.shares(F.col("n_chars"), [10, 23, 40, 17]).alias("parts"))


@query("""SELECT document_id, string_agg(to_json({'chunk_id': id, 'content': content}), chr(10) || chr(10) ORDER BY chunk_index) AS blocks FROM chunks WHERE content IS NOT NULL GROUP BY document_id""")
def serialized_contexts(spark, d):
    return R.serialized(table(spark, d, "chunks"))


@query("""SELECT document_id, string_agg(to_json({'chunk_id': id, 'content': content}), chr(10) || chr(10) ORDER BY chunk_index, id) AS blocks FROM chunks WHERE content IS NOT NULL GROUP BY document_id""")
def serialized_chunks(spark, d):
    return R.serialized(table(spark, d, "chunks"))


@query(r"""WITH sc AS (SELECT c.id AS chunk_id, c.content FROM chunks c JOIN documents d ON d.doc_id = c.document_id),
  ct AS (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS t FROM sc WHERE content IS NOT NULL), stat AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM ct),
  tf AS (SELECT chunk_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, t, unnest(t) AS term FROM ct) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM eval_items),
  kw AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score FROM asked JOIN tf USING (term) JOIN df USING (term), stat GROUP BY query_id, chunk_id),
  top AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM kw WHERE score > 0 QUALIFY pos <= 30),
  j AS (SELECT top.*, pos <= 20 AND len(list_intersect(list_distinct(regexp_extract_all(lower(replace(left(content, 300), chr(10), ' ')), '[^ \t\n\r\f\v]+')), list_distinct(regexp_extract_all(lower(text), '[^ \t\n\r\f\v]+')))) >= 2 AS good
    FROM top JOIN sc USING (chunk_id) JOIN eval_items ON item_id = query_id)
  SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM j WHERE pos > 20 OR good OR query_id NOT IN (SELECT query_id FROM j WHERE good)""")
def reranked_contexts(spark, d):
    topics, chunks = _inputs(spark, d)
    best = P.keyword_channel(topics, chunks, 30).where("not scope").join(chunks.select("chunk_id", "content"), "chunk_id").join(topics.select("query_id", F.col("text").alias("topic")), "query_id")
    return R.rerank(best.select("query_id", "topic", "chunk_id", "content", F.col("rank").alias("pos")), R.word_judge)


@query(r"""SELECT id, CASE WHEN regexp_matches(trim(abstract), '[.!?]$') THEN abstract WHEN regexp_matches(trim(conclusion), '[.!?]$') THEN conclusion ELSE 'No text.' END AS text FROM papers""")
def first_safe_text(spark, d):
    return table(spark, d, "papers").select("id", R.first_safe([F.col("abstract"), F.col("conclusion")], lambda c: F.trim(c).rlike("[.!?]$"), "No text.").alias("text"))


@query("""SELECT coalesce(c.category, d.category) AS category, count(*) AS n, count(*) FILTER (WHERE c.category IS DISTINCT FROM d.category AND c.category IS NOT NULL) AS changed FROM documents d LEFT JOIN (
  SELECT source_id, mode_of AS category FROM (SELECT source_id, trim(category) AS mode_of, row_number() OVER (PARTITION BY source_id ORDER BY count(*) DESC, trim(category)) AS r FROM documents WHERE category IS NOT NULL AND source_id IS NOT NULL GROUP BY 1, 2) WHERE r = 1) c ON c.source_id = d.source_id AND d.document_type = 'news' GROUP BY 1""")
def reclassified_news(spark, d):
    """News get their source's most frequent category; others keep theirs."""
    docs = table(spark, d, "documents").select("doc_id", "source_id", "document_type", "category")
    counts = docs.where("category is not null and source_id is not null").groupBy("source_id", F.trim("category").alias("new")).agg(F.count("*").alias("n"))
    usual = counts.groupBy("source_id").agg(F.min_by("new", F.struct(-F.col("n"), "new")).alias("new"))
    joined = docs.join(usual, "source_id", "left").withColumn("new", F.when(F.col("document_type") == "news", F.col("new")))
    return joined.groupBy(F.coalesce("new", "category").alias("category")).agg(F.count("*").alias("n"), F.count_if(F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("category"))).alias("changed"))
