"""Incremental intake, maintenance, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import text as T
from scriptorium.operators import maintenance as M
from scriptorium.queries.dedupe import _arrivals
from scriptorium.sources import readers as R
from scriptorium.sources import sinks as S
from scriptorium.storage import scratch, table
from scriptorium.streaming import intake


@query()
def incremental_intake(spark, d):
    """All documents as three landings in order of arrival, each taken in by a run of its own; statuses are those of the whole at once."""
    home = scratch(spark, "intake")
    folder = f"{home}/landing"
    rows = _arrivals(spark, d)
    bounds = rows.select(F.percentile_approx(F.unix_micros(F.coalesce("created_at", F.lit(0).cast("timestamp"))), [0.33, 0.66])).first()[0]
    part = F.when(F.unix_micros("created_at") <= bounds[0], 0).when(F.unix_micros("created_at") <= bounds[1], 1).otherwise(2)
    part = F.when(F.col("created_at").isNull(), 0).otherwise(part)
    for i in range(3):
        rows.where(part == i).write.mode("append").parquet(folder)
        statuses = intake.run(spark, folder, rows.schema, home)
    return statuses.select("doc_id", "status")


_NEW = "regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', E'\\n\\n', 'g')"


@query(f"SELECT doc_id, sha256(text) AS old, sha256({_NEW}) AS new FROM documents WHERE text <> {_NEW}")
def rewrite_diff(spark, d):
    new = F.regexp_replace(F.regexp_replace("text", "[ \\t]+", " "), "\\n{3,}", "\n\n")
    diff = M.rewrite_diff(table(spark, d, "documents"), "doc_id", "text", new)
    return diff.select("doc_id", F.sha2("old", 256).alias("old"), F.sha2("new", 256).alias("new"))


@query(r"""WITH f AS (SELECT doc_id, published_at AS s, try_strptime(nullif(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), '%Y-%m-%d')::DATE AS e, CAST(date_trunc('month', created_at) AS DATE) AS a FROM documents)
  SELECT doc_id, CASE WHEN e IS NOT NULL AND s IS NOT DISTINCT FROM e THEN 'unchanged' WHEN e IS NOT NULL THEN 'exact' WHEN a IS NOT NULL AND CAST(date_trunc('month', s) AS DATE) IS DISTINCT FROM a THEN 'approximate' WHEN a IS NOT NULL THEN 'unchanged' ELSE 'manual' END AS outcome FROM f""")
def date_outcomes(spark, d):
    from scriptorium.functions.dates import iso_date

    rows = table(spark, d, "documents").select("doc_id", F.col("published_at").alias("s"), iso_date(F.regexp_extract("text", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)).alias("e"), F.trunc("created_at", "month").alias("a"))
    return rows.select("doc_id", M.date_outcomes(rows, "s", "e", "a").alias("outcome"))


@query("""WITH gone AS (SELECT doc_id FROM documents WHERE category = 'unknown')
  SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'chunks', count(*) FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM gone)
  UNION ALL SELECT 'links', count(*) FROM document_entities WHERE document_id NOT IN (SELECT doc_id FROM gone) UNION ALL SELECT 'citations', count(*) FROM paper_citations WHERE document_id NOT IN (SELECT doc_id FROM gone)""")
def cascade_delete(spark, d):
    docs = table(spark, d, "documents")
    children = {"chunks": (table(spark, d, "chunks"), "document_id"), "links": (table(spark, d, "document_entities"), "document_id"), "citations": (table(spark, d, "paper_citations"), "document_id")}
    left = M.cascade(docs, children, "doc_id", docs.where("category = 'unknown'"))
    out = None
    for name, df in left.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit("documents" if name == "parents" else name).alias("name"), "n")
        out = row if out is None else out.unionAll(row)
    return out


@query("SELECT doc_id, title, lang, published_at FROM documents")
def json_lines_round_trip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "title", "lang", "published_at")
    path = scratch(spark, "jsonl")
    S.json_lines(rows, path)
    return R.json_lines(spark, path, rows.schema)


@query("SELECT doc_id, source, category FROM documents")
def csv_round_trip(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "category")
    path = scratch(spark, "csv")
    S.csv(rows, path)
    return spark.read.schema(rows.schema).csv(path, header=True, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


@query(r"""SELECT doc_id, coalesce(nullif(trim(regexp_replace(title, '[\x00-\x20]+', ' ', 'g')), ''), '다른 제목') AS title, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS doi, nullif(trim(url), '') AS url, category IS NOT DISTINCT FROM 'unknown' AS deleted FROM documents""")
def harvested_records(spark, d):
    """Records as a harvest lands them, written as XML with titles in two languages and identifiers of two types, and read back; a record without an English title has its other one."""
    docs = table(spark, d, "documents").withColumns({"title": F.nullif(F.trim(F.regexp_replace("title", "[\\x00-\\x20]+", " ")), F.lit("")), "url": F.nullif(F.trim("url"), F.lit(""))})
    number = F.nullif(F.regexp_extract("url", "/([0-9]+)", 1), F.lit(""))
    named = lambda kind, value: F.struct(F.lit(kind).alias("_type"), value.alias("_VALUE"))
    title = lambda lang, value: F.struct(F.lit(lang).alias("_lang"), value.alias("_VALUE"))
    identifiers = F.filter(F.array(named("url", F.col("url")), named("doi", number)), lambda x: x["_VALUE"].isNotNull())
    status = F.struct(F.when(F.col("category").eqNullSafe("unknown"), F.lit("deleted")).alias("_status"))
    record = F.struct(status.alias("header"), F.array(title("ko", F.lit("다른 제목")), title("en", F.col("title"))).alias("title"), identifiers.alias("identifier"))
    return R.harvested(docs.select("doc_id", F.to_xml(record, {"rowTag": "record"}).alias("xml")), "xml").select("doc_id", "title", "doi", "url", "deleted")


@query("SELECT doc_id, trim(title) AS title, url AS link FROM documents WHERE url IS NOT NULL AND title IS NOT NULL AND trim(title) <> ''")
def feed_items(spark, d):
    """Feed entries, written as XML records and read back; entries without a link are left out."""
    rows = table(spark, d, "documents").where("title is not null and trim(title) <> ''").select("doc_id", F.to_xml(F.struct(F.trim("title").alias("title"), F.col("url").alias("link")), {"rowTag": "item"}).alias("xml"))
    return R.feed_items(rows, "xml").select("doc_id", "title", "link")


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS INT) AS place, chunk_index FROM (SELECT document_id AS doc_id, chunk_index FROM chunks)")
def enveloped_lists(spark, d):
    """Answers that hold one object or a list under a name, brought to rows."""
    listed = table(spark, d, "chunks").groupBy(F.col("document_id").alias("doc_id")).agg(F.sort_array(F.collect_list("chunk_index")).alias("all"))
    one = F.to_json(F.struct(F.struct(F.col("all")[0].alias("i")).alias("rows")))
    many = F.to_json(F.struct(F.transform("all", lambda x: F.struct(x.alias("i"))).alias("rows")))
    answers = listed.select("doc_id", F.when(F.size("all") == 1, one).otherwise(many).alias("json"))
    return R.envelope_rows(answers, "json", "rows", "struct<i:int>").select("doc_id", F.col("place").alias("place"), F.col("row.i").alias("chunk_index"))


@query("SELECT d.doc_id, t.url FROM documents d LEFT JOIN (SELECT title, arg_min(url, doc_id) AS url FROM documents WHERE url IS NOT NULL AND title IS NOT NULL GROUP BY title) t ON t.title = d.title")
def urls_by_title(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "title", "url")
    return R.urls_by_title(docs.select("doc_id", "title"), docs).select("doc_id", "url")


_BASE = "regexp_replace(lower(trim({})), 'v[0-9]+$', '')".format


@query(f"""WITH w AS (SELECT DISTINCT paper_id AS id FROM train_balanced WHERE split <> 'train' AND paper_id IS NOT NULL), h AS (SELECT DISTINCT paper_id AS id FROM train_balanced WHERE split = 'train' AND paper_id IS NOT NULL)
  SELECT w.id, coalesce((SELECT min(h.id) FROM h WHERE h.id = w.id), (SELECT min(h.id) FROM h WHERE {_BASE('h.id')} = {_BASE('w.id')} AND {_BASE('w.id')} <> ''), (SELECT min(h.id) FROM h WHERE starts_with({_BASE('h.id')}, {_BASE('w.id')}) AND {_BASE('w.id')} <> '')) AS found FROM w""")
def ids_by_precedence(spark, d):
    rows = table(spark, d, "train_balanced").where("paper_id is not null").select("split", F.col("paper_id").alias("id"))
    return R.by_precedence(rows.where("split <> 'train'").select("id").distinct(), rows.where("split = 'train'").select("id").distinct())
