"""Retrieval for every evaluation item as topic, over all chunks; nearest vectors for every fiftieth row."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators import records
from scriptorium.plans import retrieval as P
from scriptorium.operators.matching import nearest
from scriptorium.storage import stage, table

_WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_BUCKETS = "list_transform(" + _WORDS + ", lambda t: CAST('0x' || substr(md5(t), 1, 4) AS INT) % 64)"
_VEC = "CAST(list_transform(range(64), lambda i: CAST(len(list_filter({b}, lambda x: x = i)) AS DOUBLE)) AS DOUBLE[64])"
_CHUNKS = """
  sc AS (SELECT c.id AS chunk_id, c.document_id, c.chunk_index, c.content, d.document_type, d.category FROM chunks c JOIN documents d ON d.doc_id = c.document_id),
  tp AS (SELECT item_id AS query_id, text, category FROM eval_items),
  scopes AS (SELECT unnest([false, true]) AS scope)"""
_VECTOR = f"""
  cb AS (SELECT chunk_id, category, {_BUCKETS.format('content')} AS b FROM sc WHERE content IS NOT NULL),
  cv AS (SELECT chunk_id, category, {_VEC.format(b='b')} AS w FROM cb WHERE len(b) > 0),
  tb AS (SELECT query_id, category, {_BUCKETS.format('text')} AS b FROM tp WHERE text IS NOT NULL),
  tv AS (SELECT query_id, category, {_VEC.format(b='b')} AS v FROM tb WHERE len(b) > 0),
  vs AS (SELECT query_id, chunk_id, tv.category = cv.category AS own, round(3 - round(array_cosine_similarity(v, w) + 2, 12), 12) AS x FROM tv, cv),
  vector AS (SELECT query_id, chunk_id, scope, row_number() OVER (PARTITION BY query_id, scope ORDER BY x, chunk_id) AS rank FROM vs JOIN scopes ON NOT scope OR own QUALIFY rank <= 50)"""
_KEYWORD = f"""
  ct AS (SELECT chunk_id, category, {_WORDS.format('content')} AS t FROM sc WHERE content IS NOT NULL),
  stat AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM ct),
  tf AS (SELECT chunk_id, category, len(t) AS dl, term, count(*) AS tf FROM (SELECT chunk_id, category, t, unnest(t) AS term FROM ct) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  asked AS (SELECT DISTINCT query_id, category AS own, unnest({_WORDS.format('text')}) AS term FROM tp),
  kw AS (SELECT query_id, chunk_id, any_value(category = own) AS own, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / mean))), 6) AS score
    FROM asked JOIN tf USING (term) JOIN df USING (term), stat GROUP BY query_id, chunk_id),
  keyword AS (SELECT query_id, chunk_id, score, scope, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, chunk_id) AS rank FROM kw JOIN scopes ON NOT scope OR own WHERE score > 0 QUALIFY rank <= 50)"""
_PHRASE = r"""
  pn AS (SELECT DISTINCT query_id, category, lower(p) AS p FROM (SELECT query_id, category, unnest(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9&.''-]{1,}(?:[ \t\n\r\f\x0b]+[A-Z][A-Za-z0-9&.''-]{1,})*)', 1)) AS p FROM tp)
    WHERE length(p) >= 3 AND lower(p) NOT IN ('v', 'vs', 'inc', 'co', 'ltd', 'llc', 'the', 'a', 'an', 'of', 'and')),
  ph AS (SELECT query_id, chunk_id, any_value(pn.category = sc.category) AS own, CAST(count(*) AS DOUBLE) AS score FROM pn JOIN sc ON contains(lower(content), p) GROUP BY query_id, chunk_id),
  phrase AS (SELECT query_id, chunk_id, score, scope, row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, chunk_id) AS rank FROM ph JOIN scopes ON NOT scope OR own QUALIFY rank <= 30)"""
_GRAPH = f"""
  gw AS (SELECT DISTINCT query_id, unnest({_WORDS.format('text')}) AS w FROM tp),
  ge AS (SELECT DISTINCT query_id, id AS entity_id, entity_type FROM gw JOIN entities ON length(w) >= 2 AND contains(lower(name), w)),
  gs AS (SELECT query_id, document_id, CAST(sum(CASE relation_type WHEN 'DISCUSSES' THEN 3 WHEN 'CITES' THEN 2 ELSE 1 END * CASE entity_type WHEN 'Case' THEN 3 ELSE 1 END) AS DOUBLE) AS score
    FROM ge JOIN (SELECT DISTINCT document_id, entity_id, relation_type FROM document_entities) USING (entity_id) GROUP BY ALL),
  gd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM gs QUALIFY rank <= 30),
  graph AS (SELECT query_id, sc.chunk_id, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, gd.document_id, chunk_index, sc.chunk_id) AS n
    FROM gd JOIN sc ON sc.document_id = gd.document_id QUALIFY n <= 30)"""
_FILLED = """
  ch AS (SELECT 'vector' AS channel, 1 AS w, query_id, chunk_id, scope, rank FROM vector UNION ALL SELECT 'keyword', 1, query_id, chunk_id, scope, rank FROM keyword UNION ALL SELECT 'phrase', 2, query_id, chunk_id, scope, rank FROM phrase),
  full_topics AS (SELECT query_id FROM ch JOIN sc USING (chunk_id) WHERE scope GROUP BY 1 HAVING count(DISTINCT document_id) >= 20),
  sized AS (SELECT channel, query_id, max(rank) AS size FROM ch WHERE scope GROUP BY 1, 2),
  filled AS (SELECT channel, w, query_id, chunk_id, rank FROM ch WHERE scope UNION ALL
    SELECT channel, w, query_id, chunk_id, coalesce(size, 0) + row_number() OVER (PARTITION BY channel, query_id ORDER BY rank, chunk_id) FROM (SELECT * FROM ch WHERE NOT scope AND query_id NOT IN (SELECT query_id FROM full_topics)
      AND NOT EXISTS (SELECT 1 FROM ch p WHERE p.scope AND p.channel = ch.channel AND p.query_id = ch.query_id AND p.chunk_id = ch.chunk_id)) LEFT JOIN sized USING (channel, query_id))"""
_FUSED = """
  u AS (SELECT query_id, chunk_id, rank, channel, w FROM filled UNION ALL SELECT query_id, chunk_id, rank, 'graph', 1 FROM graph),
  act AS (SELECT query_id, count(DISTINCT channel) AS active FROM u GROUP BY 1),
  fused AS (SELECT query_id, chunk_id, round(sum(w / (60 + rank)), 12) AS score, count(DISTINCT channel) AS channel_count, any_value(active) AS active FROM u JOIN act USING (query_id) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 20)"""
_CHOSEN = r"""
  pas AS (SELECT f.*, sc.document_id, sc.document_type, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, f.chunk_id) AS pos,
      len(list_intersect(list_distinct(regexp_extract_all(lower(replace(left(sc.content, 300), chr(10), ' ')), '[^ \t\n\r\f\v]+')), list_distinct(regexp_extract_all(lower(tp.text), '[^ \t\n\r\f\v]+')))) >= 2 AS good
    FROM fused f JOIN sc ON sc.chunk_id = f.chunk_id JOIN tp USING (query_id)
    WHERE CASE WHEN active >= 3 THEN score >= 1 / 63 - 1e-9 OR channel_count >= 2 ELSE score >= 1 / 66 - 1e-9 END),
  rel AS (SELECT query_id, chunk_id, document_id, document_type, score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pos FROM pas WHERE coalesce(good, false) OR query_id NOT IN (SELECT query_id FROM pas WHERE good)),
  fst AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, document_id ORDER BY pos) = 1 THEN 0 ELSE 1 END AS phase FROM rel),
  trn AS (SELECT *, CASE WHEN phase = 0 THEN row_number() OVER (PARTITION BY query_id, document_type, phase ORDER BY pos) ELSE 0 END AS turn,
    CASE WHEN phase = 0 THEN min(pos) OVER (PARTITION BY query_id, document_type, phase) ELSE 0 END AS type_pos FROM fst),
  chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, turn, type_pos, pos) AS place FROM trn QUALIFY place <= 5)"""
_SEARCH = f"{_CHUNKS}, {_VECTOR}, {_KEYWORD}, {_PHRASE}, {_GRAPH}, {_FILLED}, {_FUSED}"


def _inputs(spark, d):
    topics = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text", "category", "label")
    return topics, P.searchable(table(spark, d, "chunks").withColumnRenamed("id", "chunk_id"), table(spark, d, "documents"))


@query(f"WITH {_CHUNKS}, {_KEYWORD} SELECT query_id, chunk_id, score, scope, rank FROM keyword")
def keyword_topk(spark, d):
    return P.keyword_channel(*_inputs(spark, d))


@query(f"WITH {_CHUNKS}, {_PHRASE} SELECT query_id, chunk_id, score, scope, rank FROM phrase")
def exact_phrase_topk(spark, d):
    return P.phrase_channel(*_inputs(spark, d))


@query(f"WITH {_CHUNKS}, {_GRAPH} SELECT query_id, chunk_id, score, rank FROM graph")
def graph_topk(spark, d):
    topics, chunks = _inputs(spark, d)
    return P.graph_channel(P.graph_documents(topics, table(spark, d, "entities"), table(spark, d, "document_entities")), chunks)


@query(f"WITH {_CHUNKS}, {_VECTOR} SELECT query_id, chunk_id, scope, rank FROM vector")
def chunk_vector_topk(spark, d):
    return P.vector_channel(*_inputs(spark, d)).drop("score")


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[64]) AS w FROM embeddings),
  s AS (SELECT query_id, row_id, round(array_cosine_distance(v, w), 12) AS x FROM q, e) SELECT query_id, row_id, round(x, 9) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY x, row_id) AS rank FROM s QUALIFY rank <= 50""")
def vector_topk(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(vectors, vectors.where("id % 50 = 0"), 50)


def _channels(spark, d):
    topics, chunks = _inputs(spark, d)
    found = {"vector": P.vector_channel(topics, chunks), "keyword": P.keyword_channel(topics, chunks), "phrase": P.phrase_channel(topics, chunks)}
    return topics, chunks, P.filled(topics, chunks, found, P.pool_size())


@query(f"WITH {_CHUNKS}, {_VECTOR}, {_KEYWORD}, {_PHRASE}, {_FILLED} SELECT channel, query_id, chunk_id, rank FROM filled")
def category_backfill(spark, d):
    """Each channel's best chunks of the topic's category, filled up from all where their documents, over all three, are fewer than the pool of 20."""
    out = None
    for name, rows in _channels(spark, d)[2].items():
        rows = rows.select(F.lit(name).alias("channel"), "query_id", "chunk_id", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


def _fused(spark, d):
    topics, chunks, filled = _channels(spark, d)
    graph = P.graph_channel(P.graph_documents(topics, table(spark, d, "entities"), table(spark, d, "document_entities")), chunks)
    return topics, chunks, P.pool(P.fuse([("vector", 1, filled["vector"]), ("keyword", 1, filled["keyword"]), ("phrase", 2, filled["phrase"]), ("graph", 1, graph)]))


@query(f"WITH {_SEARCH} SELECT query_id, chunk_id, score, channel_count, active, least(100.0, score / (3 / 61) * 100) AS percent FROM fused")
def rank_fusion(spark, d):
    return _fused(spark, d)[2].withColumn("percent", P.relevance_percent(F.col("score")))


def _selected(spark, d):
    """Fusion, the pool of candidates, the relevance filter, the judge, then the diverse five."""
    topics, chunks, fused = _fused(spark, d)
    passed = stage(P.positions(P.relevant(fused).join(chunks.drop("category", "chunk_index"), "chunk_id")), "relevant")
    judged = records.rerank(passed.join(topics.select("query_id", F.col("text").alias("topic")), "query_id"), records.word_judge)
    ranked = stage(passed.drop("pos", "content").join(judged.withColumnRenamed("place", "pos"), ["query_id", "chunk_id"]), "judged")
    return topics, ranked, P.diverse(ranked)


@query(f"WITH {_SEARCH}, {_CHOSEN} SELECT query_id, chunk_id, document_id, document_type, pos, place FROM chosen")
def search_contexts(spark, d):
    return _selected(spark, d)[2]


@query(f"""WITH {_SEARCH}, {_CHOSEN}, best AS (SELECT query_id, document_id, max(score) AS score FROM chosen GROUP BY 1, 2)
  SELECT query_id, document_id, score, title, url FROM best JOIN documents ON doc_id = document_id""")
def search_sources(spark, d):
    _, ranked, chosen = _selected(spark, d)
    return P.sources(chosen, ranked.join(chosen.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi"), table(spark, d, "documents"))


@query(f"""WITH {_SEARCH}, {_CHOSEN},
  per AS (SELECT query_id, category, avg(label) AS p FROM (SELECT query_id, i.category, l.label FROM (SELECT query_id, label FROM (SELECT c.query_id, CASE WHEN d.category IS NULL THEN -1 WHEN d.category = i.category THEN 1 ELSE 0 END AS label FROM (SELECT DISTINCT query_id, document_id FROM chosen) c JOIN documents d ON d.doc_id = c.document_id JOIN eval_items i ON i.item_id = c.query_id)) l JOIN (SELECT item_id AS query_id, category FROM eval_items) i USING (query_id)) WHERE label >= 0 GROUP BY 1, 2)
  SELECT category, round(avg(round(p, 9)), 6) AS precision, count(*) AS topics FROM per GROUP BY GROUPING SETS ((category), ())""")
def precision_at_five(spark, d):
    """Labels stand in for people's: a document of the topic's category is right, one without category is not judged."""
    topics, _, chosen = _selected(spark, d)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("category").alias("is"))
    pairs = chosen.select("query_id", "document_id").distinct()
    labels = pairs.join(docs, "document_id").join(topics.select("query_id", "category"), "query_id").select("query_id", "document_id", F.when(F.col("is").isNull(), -1).when(F.col("is") == F.col("category"), 1).otherwise(0).alias("label"))
    return P.precision_at_k(pairs, labels, topics.select("query_id", "category"))[1]
