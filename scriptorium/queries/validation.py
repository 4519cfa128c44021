"""Support of the papers by their citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions.text import heading_key
from scriptorium.operators import validation as V
from scriptorium.storage import table

_SQ = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))".format
_SECTIONS = """sec AS (SELECT id AS paper_id, 'abstract' AS section, abstract AS content FROM papers UNION ALL SELECT id, 'introduction', introduction FROM papers
  UNION ALL SELECT id, 'body', body FROM papers UNION ALL SELECT id, 'conclusion', conclusion FROM papers)"""
_HELD = f"""{_SECTIONS}, held AS (SELECT paper_id, section, chunk_id, document_id, claim_text, min(id) AS id, arg_min(relevance_score, c.id) AS relevance_score FROM paper_citations c JOIN sec s USING (paper_id, section)
  WHERE {_SQ('claim_text')} <> '' AND EXISTS (SELECT 1 FROM chunks k WHERE k.id = c.chunk_id AND k.document_id = c.document_id) AND document_id IN (SELECT doc_id FROM documents)
  AND contains({_SQ('content')}, {_SQ('claim_text')}) GROUP BY ALL)"""


def _evidence(spark, d):
    return V.valid_evidence(table(spark, d, "paper_citations"), table(spark, d, "papers"), table(spark, d, "chunks"), table(spark, d, "documents"))


@query(f"WITH {_HELD} SELECT paper_id, section, chunk_id, document_id, claim_text, id FROM held")
def valid_evidence(spark, d):
    return _evidence(spark, d).drop("relevance_score")


@query(f"""WITH {_HELD}, best AS (SELECT paper_id, document_id, min(id) AS first FROM paper_citations SEMI JOIN held USING (paper_id, document_id) GROUP BY 1, 2)
  SELECT paper_id, document_id, row_number() OVER (PARTITION BY paper_id ORDER BY first, document_id) AS number, title FROM best JOIN documents ON doc_id = document_id""")
def cited_references(spark, d):
    return V.references(_evidence(spark, d), table(spark, d, "paper_citations"), table(spark, d, "documents"))


@query("""SELECT id AS paper_id, coalesce(length(title), 0) + coalesce(length(abstract), 0) + coalesce(length(introduction), 0) + coalesce(length(body), 0) + coalesce(length(conclusion), 0) AS chars,
  array_to_string(list_sort(list_filter([CASE WHEN coalesce(trim(abstract), '') = '' THEN 'abstract' END, CASE WHEN coalesce(trim(title), '') = '' THEN 'title' END, CASE WHEN coalesce(trim(introduction), '') = '' THEN 'introduction' END,
  CASE WHEN coalesce(trim(body), '') = '' THEN 'body' END, CASE WHEN coalesce(trim(conclusion), '') = '' THEN 'conclusion' END], lambda x: x IS NOT NULL)), ',') AS missing FROM papers""")
def paper_faults(spark, d):
    return V.faults(table(spark, d, "papers"))


@query(f"""WITH {_SECTIONS}, p AS (SELECT unnest(['id', 'price', 'address']) AS pattern, unnest(['[0-9a-f]{{8}}-[0-9a-f]{{4}}', '[0-9],[0-9]{{3}}', 'https?://']) AS re)
  SELECT paper_id, section, pattern FROM sec, p WHERE content IS NOT NULL AND regexp_matches(content, re)""")
def pattern_hits(spark, d):
    return V.pattern_hits(V.sections(table(spark, d, "papers")), {"id": "[0-9a-f]{8}-[0-9a-f]{4}", "price": "[0-9],[0-9]{3}", "address": "https?://"})


@query()
def evidence_within_budget(spark, d):
    chunks = table(spark, d, "chunks").where("content is not null").select(F.col("document_id").alias("query_id"), F.col("chunk_index").alias("pos"), F.length("content").alias("size"))
    return V.within_budget(chunks, 4500)


@query(r"""WITH l AS (SELECT id AS paper_id, unnest(string_split(body, chr(10))) AS heading, unnest(range(len(string_split(body, chr(10))))) AS pos FROM papers WHERE body IS NOT NULL),
  k AS (SELECT *, regexp_replace(lower(regexp_replace(heading, '^[ \t\n\r\f\x0b]*[0-9]+[.)][ \t\n\r\f\x0b]*', '')), '[ \t\n\r\f\x0b]', '', 'g') AS key FROM l)
  SELECT paper_id, key, heading, pos FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY paper_id, key ORDER BY pos) = 1""")
def first_headings(spark, d):
    lines = table(spark, d, "papers").where("body is not null").select(F.col("id").alias("paper_id"), F.posexplode(F.split("body", "\n")).alias("pos", "heading"))
    return V.first_headings(lines.withColumn("key", heading_key(F.col("heading"))))
