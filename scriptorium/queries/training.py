"""Chunks and training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions.arrays import from_inverted, inverted
from scriptorium.functions.text import clean_extracted
from scriptorium.operators import chunking as C
from scriptorium.operators import training as T
from scriptorium.storage import table

_CHUNKS = """w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) <> ''),
  k AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 600) / 500) AS BIGINT)))) AS i FROM w),
  c AS (SELECT doc_id AS document_id, i AS chunk_index, array_to_string(w[i * 500 + 1 : i * 500 + 600], ' ') AS content, len(w[i * 500 + 1 : i * 500 + 600]) AS token_count FROM k)"""


@query(f"WITH {_CHUNKS} SELECT document_id, chunk_index, content, token_count, content AS content_tokenized FROM c")
def chunk_documents(spark, d):
    return C.chunk(table(spark, d, "documents"))


@query(f"WITH {_CHUNKS} SELECT chunk_index, count(*) AS n, min(token_count) AS least, max(token_count) AS most FROM c GROUP BY 1")
def chunk_statistics(spark, d):
    return C.chunk(table(spark, d, "documents")).groupBy("chunk_index").agg(F.count("*").alias("n"), F.min("token_count").alias("least"), F.max("token_count").alias("most"))


@query("SELECT id, coalesce(nullif(content_tokenized, ''), content) AS searchable, len(string_split(coalesce(nullif(content_tokenized, ''), content), ' ')) AS n FROM chunks WHERE content IS NOT NULL")
def searchable_chunks(spark, d):
    s = C.searchable(F.col("content_tokenized"), F.col("content"))
    return table(spark, d, "chunks").where("content is not null").select("id", s.alias("searchable"), F.size(F.split(s, " ", -1)).alias("n"))


@query()
def embedded_chunks(spark, d):
    rows = table(spark, d, "chunks").select("id", "content", F.lit(None).cast("array<double>").alias("embedding"))
    return C.embed_missing(rows, "content").select("id", "embedding", "embedding_error")


@query("""SELECT paper_id, section, input, output FROM (SELECT id AS paper_id, title AS input, unnest([{'section': 'title', 'output': title, 'least': 1}, {'section': 'abstract', 'output': trim(abstract), 'least': 80}, {'section': 'introduction', 'output': trim(introduction), 'least': 250},
  {'section': 'body', 'output': trim(body), 'least': 800}, {'section': 'conclusion', 'output': trim(conclusion), 'least': 180}], recursive := true) FROM papers) WHERE length(output) >= least""")
def paper_samples(spark, d):
    return T.paper_samples(table(spark, d, "papers"))


_KEY = "coalesce(nullif(trim(paper_id), ''), nullif(trim(source), ''), CAST(sample_id AS VARCHAR))"


def _keyed(spark, d):
    return table(spark, d, "train_balanced").withColumn("key", T.paper_key(F.col("paper_id"), F.col("source"), F.col("sample_id")))


@query(f"""WITH s AS (SELECT sample_id, {_KEY} AS key FROM train_balanced), g AS (SELECT key, row_number() OVER (ORDER BY sha256(key || '/42')) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT key FROM s))
  SELECT sample_id, s.key, CASE WHEN n > 2 AND r <= greatest(1, round_even(n * 0.15, 0)) THEN 'validation' ELSE 'train' END AS part FROM s JOIN g ON g.key = s.key""")
def split_by_group(spark, d):
    return T.split_groups(_keyed(spark, d).select("sample_id", "key"), "key")


@query()
def body_pieces(spark, d):
    """Cleaned bodies in pieces; tested against a plain loop."""
    rows = table(spark, d, "papers").where("body is not null").select("id", T.body_pieces(clean_extracted(F.col("body"))).alias("pieces"))
    return rows.select("id", F.posexplode("pieces").alias("piece_no", "piece"))


_BALANCED = f"""s AS (SELECT sample_id, section, {_KEY} AS key FROM train_balanced),
  b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sample_id) - 1 AS r, count(*) OVER (PARTITION BY key) AS n FROM s WHERE starts_with(section, 'body')),
  kept AS (SELECT sample_id, section, key FROM b WHERE n <= 5 OR list_contains(list_transform(range(5), lambda i: CAST(round_even(i * (n - 1) / 4, 0) AS BIGINT)), r) UNION ALL SELECT sample_id, section, key FROM s WHERE NOT coalesce(starts_with(section, 'body'), false))"""


@query(f"WITH {_BALANCED} SELECT sample_id, section, key FROM kept")
def balanced_samples(spark, d):
    return T.balance(_keyed(spark, d).select("sample_id", "section", "key"), "key", "sample_id")


@query(f"""WITH {_BALANCED} SELECT string_split(section, '_')[1] AS part, count(*) AS before, count(kept.sample_id) AS after FROM s LEFT JOIN (SELECT sample_id FROM kept) kept USING (sample_id) GROUP BY 1""")
def balance_report(spark, d):
    rows = _keyed(spark, d).select("sample_id", "section", "key")
    kept = T.balance(rows, "key", "sample_id").select("sample_id", F.lit(1).alias("kept"))
    return rows.join(kept, "sample_id", "left").groupBy(F.split_part("section", F.lit("_"), F.lit(1)).alias("part")).agg(F.count("*").alias("before"), F.count("kept").alias("after"))


@query("""WITH t AS (SELECT sample_id, list_transform(string_split(instruction || ' ' || input || ' ' || output, ' '), lambda w: length(w)) AS ids, len(string_split(instruction || ' ' || input, ' ')) AS p FROM train_balanced WHERE instruction IS NOT NULL AND input IS NOT NULL AND output IS NOT NULL)
  SELECT sample_id, len(ids) AS n, CASE WHEN len(ids) - p < 8 THEN 0 ELSE len(ids) - p END AS trained, CASE WHEN len(ids) - p < 8 THEN -100 * len(ids) ELSE CAST(list_sum(ids[p + 1 :]) AS BIGINT) - 100 * p END AS total FROM t""")
def masked_labels(spark, d):
    """Word lengths stand in for token ids; the number of labels that count, and the sum of all labels."""
    rows = table(spark, d, "train_balanced").where("instruction is not null and input is not null and output is not null")
    ids = F.transform(F.split(F.concat_ws(" ", "instruction", "input", "output"), " ", -1), lambda w: F.length(w))
    prompt = F.size(F.split(F.concat_ws(" ", "instruction", "input"), " ", -1))
    labels = rows.select("sample_id", T.masked_labels(ids, prompt).alias("l"))
    return labels.select("sample_id", F.size("l").alias("n"), F.size(F.filter("l", lambda x: x != T.IGNORED)).alias("trained"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("""SELECT sample_id, section, CASE WHEN section = 'title' THEN 0 WHEN section = 'abstract' THEN 1 WHEN section = 'introduction' THEN 2 WHEN regexp_matches(section, '^body_[0-9]+$') THEN 100 + CAST(regexp_extract(section, '[0-9]+') AS INT) WHEN section = 'conclusion' THEN 9999 ELSE 5000 END AS place FROM train_balanced""")
def section_order(spark, d):
    return table(spark, d, "train_balanced").select("sample_id", "section", T.section_rank(F.col("section")).alias("place"))


@query("""SELECT split, source, count(*) AS samples, count(DISTINCT paper_id) AS papers, array_to_string(list_sort(list(DISTINCT section)), ',') AS sections FROM train_balanced GROUP BY split, source""")
def sample_counts(spark, d):
    return table(spark, d, "train_balanced").groupBy("split", "source").agg(F.count("*").alias("samples"), F.count_distinct("paper_id").alias("papers"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


@query("SELECT exp(avg(CAST(relevance_score AS DOUBLE))) AS perplexity FROM paper_citations")
def perplexity(spark, d):
    """exp of a mean loss; the citations' scores stand in for losses."""
    return table(spark, d, "paper_citations").agg(F.exp(F.avg(F.col("relevance_score").cast("double"))).alias("perplexity"))


@query("""WITH a AS (SELECT id, string_split(trim(regexp_replace(abstract, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), ' ') AS w FROM papers WHERE abstract IS NOT NULL) SELECT id, array_to_string(w, ' ') AS abstract FROM a""")
def rebuilt_abstracts(spark, d):
    """Abstracts from inverted indexes: word -> positions, put back in order."""
    return table(spark, d, "papers").where("abstract is not null").select("id", from_inverted(inverted(F.col("abstract"))).alias("abstract"))
