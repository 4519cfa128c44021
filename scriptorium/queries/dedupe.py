"""Duplicates among the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import text as T
from scriptorium.operators import dedupe as D
from scriptorium.storage import table

_HASH = "sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))))"


def _hashed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "title", "document_type", "category", "url", "created_at", T.content_hash(F.col("text")).alias("hash"))
    return docs


@query(f"SELECT doc_id, hash FROM (SELECT doc_id, created_at, {_HASH} AS hash FROM documents) QUALIFY hash IS NULL OR row_number() OVER (PARTITION BY hash ORDER BY created_at, doc_id) = 1")
def exact_dedup_keep_first(spark, d):
    return D.keep_first(_hashed(spark, d), "hash", ["created_at", "doc_id"]).select("doc_id", "hash")


@query("SELECT doc_id, url FROM documents QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY created_at, doc_id) = 1")
def url_dedup(spark, d):
    return D.keep_first(table(spark, d, "documents").select("doc_id", "url", "created_at"), "url", ["created_at", "doc_id"]).select("doc_id", "url")


_SIMILAR = """WITH t AS (SELECT DISTINCT document_type, title FROM documents WHERE title IS NOT NULL AND document_type IS NOT NULL),
  w AS (SELECT document_type, title, '  ' || unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+')) || ' ' AS w FROM t),
  g AS (SELECT document_type, title, list(DISTINCT g) AS t FROM (SELECT document_type, title, unnest(list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3))) AS g FROM w) GROUP BY ALL)
  SELECT a.document_type, a.title AS title_a, b.title AS title_b, len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AS similarity
  FROM g a JOIN g b ON a.document_type = b.document_type AND a.title < b.title WHERE similarity > 0.6"""


@query(_SIMILAR)
def similar_titles(spark, d):
    return D.similar_titles(table(spark, d, "documents"))


@query(f"""WITH s AS ({_SIMILAR}), b AS (SELECT document_type, title_a AS title, title_b AS best, similarity FROM s UNION ALL SELECT document_type, title_b, title_a, similarity FROM s)
  SELECT document_type, title, best, similarity FROM b QUALIFY row_number() OVER (PARTITION BY document_type, title ORDER BY similarity DESC, best) = 1""")
def best_similar_title(spark, d):
    return D.best_matches(table(spark, d, "documents"))


def _arrivals(spark, d):
    return table(spark, d, "documents").select("doc_id", "created_at", T.content_hash(F.col("text")).alias("content_hash"), "document_type", "title", (F.col("category") != "unknown").alias("relevant"))


@query()
def intake_statuses(spark, d):
    return D.acceptance(_arrivals(spark, d))


@query()
def intake_counters(spark, d):
    """What a run of the intake reports: rows by status."""
    return D.acceptance(_arrivals(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


# Kinds of document, those that go first when two carry one number.
_PRECEDENCE = ["official", "policy", "case", "paper", "news", "webpage"]


@query("""SELECT doc_id, number FROM (SELECT *, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number, list_position(['official', 'policy', 'case', 'paper', 'news', 'webpage'], document_type) AS r FROM documents)
  QUALIFY number IS NULL OR row_number() OVER (PARTITION BY number ORDER BY r, doc_id) = 1""")
def number_precedence(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "document_type", F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit("")).alias("number"))
    return D.by_precedence(docs, "number", F.array_position(F.array(*map(F.lit, _PRECEDENCE)), F.col("document_type")), "doc_id").select("doc_id", "number")


@query(f"""WITH h AS (SELECT doc_id, {_HASH.replace('text', 'title')} AS new, content_hash AS old FROM documents),
  v AS (SELECT new AS v, doc_id FROM h UNION ALL SELECT old, doc_id FROM h), taken AS (SELECT v FROM v WHERE v IS NOT NULL GROUP BY v HAVING count(DISTINCT doc_id) > 1)
  SELECT doc_id FROM h WHERE new IS DISTINCT FROM old AND new IN (SELECT v FROM taken)""")
def rewrite_conflicts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.content_hash(F.col("title")).alias("new"), F.col("content_hash").alias("old"))
    return D.rewrite_conflicts(docs, "old", "new", "doc_id").select("doc_id")
