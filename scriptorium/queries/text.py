"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import text as T
from scriptorium.storage import table

_SQUEEZE = "trim(regexp_replace({}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g'))"
_SQ = _SQUEEZE.format


@query(f"SELECT doc_id, sha256(lower({_SQ('text')})) AS hash FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT id, regexp_replace(replace(lower({_SQ('name')}), ' ', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS key FROM entities")
def entity_name_keys(spark, d):
    return table(spark, d, "entities").select("id", T.normalize_name(F.col("name")).alias("key"))


@query(r"""SELECT doc_id, trim(title) AS title,
  regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g') AS text,
  lower(coalesce(nullif(trim(lang), ''), 'ko')) AS lang FROM documents""")
def normalized_documents(spark, d):
    c = F.col
    return table(spark, d, "documents").select("doc_id", F.trim("title").alias("title"), T.normalize_lines(c("text")).alias("text"), F.lower(T.or_default(c("lang"), "ko")).alias("lang"))


@query(r"""SELECT doc_id,
  CASE WHEN regexp_matches(coalesce(title, '') || substr(coalesce(text, ''), 1, 200), '[가-힣]') THEN 'ko' ELSE 'en' END AS by_head,
  CASE WHEN regexp_matches(substr(coalesce(text, ''), 1, 2000), '[가-힣]') THEN 'ko' ELSE 'en' END AS by_2000,
  coalesce(CASE WHEN length(regexp_replace(text, '[ \t\n\r\f\x0b]', '', 'g')) = 0 THEN 0.0
    ELSE length(regexp_replace(text, '[^가-힣]', '', 'g')) / length(regexp_replace(text, '[ \t\n\r\f\x0b]', '', 'g')) END >= 0.2, false) AS korean,
  coalesce(regexp_matches(text, '[぀-ヿ㐀-䶿一-鿿가-힣]'), false) AS cjk FROM documents""")
def language_rules(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        T.script_language(F.concat(F.coalesce("title", F.lit("")), F.substring(F.coalesce(t, F.lit("")), 1, 200))).alias("by_head"),
        T.script_language(t, 2000).alias("by_2000"),
        F.coalesce(T.hangul_share(t) >= 0.2, F.lit(False)).alias("korean"),
        F.coalesce(T.has_cjk(t), F.lit(False)).alias("cjk"),
    )


@query(r"""WITH found AS (SELECT doc_id, regexp_extract_all(title, '\b([A-Z][A-Za-z0-9&.''-]{1,}(?:[ \t\n\r\f\x0b]+[A-Z][A-Za-z0-9&.''-]{1,})*)', 1) AS names FROM documents WHERE title IS NOT NULL),
  each AS (SELECT doc_id, unnest(names) AS name, unnest(range(1, len(names) + 1)) AS pos FROM found),
  good AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY pos) AS n FROM each WHERE length(name) >= 3
    AND lower(name) NOT IN ('v', 'vs', 'inc', 'co', 'ltd', 'llc', 'the', 'a', 'an', 'of', 'and'))
  SELECT doc_id, name FROM good WHERE n = 1""")
def title_proper_nouns(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", F.explode(T.proper_nouns(F.col("title"))).alias("name"))


@query(r"""SELECT doc_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z]+://([^/?#:]+)', 1), '^www\.', ''), '') AS host,
  split_part(regexp_extract(url, '([^/]*)$', 1), 'v', 1) AS short_id, regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS safe,
  nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS number, nullif(regexp_replace(regexp_extract(url, '(?i)(?:arxiv\.org/abs/|48550/arxiv\.)([A-Za-z0-9_.\-]+)', 1), 'v[0-9]+$', ''), '') AS preprint FROM documents""")
def url_parts(spark, d):
    u = F.col("url")
    return table(spark, d, "documents").select("doc_id", T.url_host(u).alias("host"), T.short_id(u).alias("short_id"), T.safe_name(u).alias("safe"), F.nullif(F.regexp_extract(u, "/([0-9]+)", 1), F.lit("")).alias("number"), T.preprint_id(u).alias("preprint"))


@query(r"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(body, chr(0), ' '), '\r\n?', E'\n', 'g'), '([A-Za-z])-\n([a-z])', '\1\2', 'g'), '[ \t]*\n[ \t]*', E'\n', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'),
  '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g')) AS body FROM papers""")
def cleaned_bodies(spark, d):
    return table(spark, d, "papers").select("id", F.trim(T.clean_extracted(F.col("body"))).alias("body"))


@query(r"""WITH lines AS (SELECT id, unnest(string_split(body, E'\n')) AS line FROM papers WHERE body IS NOT NULL)
  SELECT id, line AS heading, regexp_replace(lower(regexp_replace(line, '^[ \t\n\r\f\x0b]*[0-9]+[.)][ \t\n\r\f\x0b]*', '')), '[ \t\n\r\f\x0b]', '', 'g') AS key
  FROM lines WHERE regexp_matches(line, '^[0-9]+[.)] ')""")
def heading_keys(spark, d):
    lines = table(spark, d, "papers").where("body is not null").select("id", F.explode(F.split("body", "\n")).alias("heading"))
    return lines.where(F.col("heading").rlike("^[0-9]+[.)] ")).withColumn("key", T.heading_key(F.col("heading")))


@query(r"""SELECT id, trim(regexp_replace('[' || chunk_id || ']', '^\[+|\]+$', '', 'g')) AS key, regexp_replace(claim_text, '[ \t\n\r\f\x0b]+', ' ', 'g') AS claim FROM paper_citations""")
def citation_keys(spark, d):
    return table(spark, d, "paper_citations").select("id", T.citation_key(F.concat(F.lit("["), "chunk_id", F.lit("]"))).alias("key"), F.regexp_replace("claim_text", T.WS + "+", " ").alias("claim"))


_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])[ \t\n\r\f\x0b]+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x)), lambda x: x <> '')"


@query(rf"""SELECT doc_id, len({_SENT}) AS sentences, len(list_filter({_SENT}, lambda x: length(x) >= 40 AND NOT regexp_matches(x, '[가-힣]'))) AS foreign_sentences,
  len(regexp_extract_all(text, '(?:^| )[b-hj-zB-HJ-Z](?: |$)')) AS stray FROM documents WHERE text IS NOT NULL""")
def sentence_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(T.sentences(t)).alias("sentences"), T.foreign_sentences(t).alias("foreign_sentences"), F.regexp_count(t, F.lit("(?:^| )[b-hj-zB-HJ-Z](?: |$)")).alias("stray"))


@query("""SELECT doc_id, i AS piece_no, substr(text, i * 1500 + 1, 1500) AS piece
  FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1500) AS BIGINT))) AS i FROM documents WHERE text IS NOT NULL)""")
def fixed_slices(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.slices(F.col("text"), 1500)).alias("piece_no", "piece"))


@query(r"""WITH h AS (SELECT id, abstract, substr(abstract, 1, 200) AS head FROM papers WHERE abstract IS NOT NULL)
  SELECT id, CASE WHEN length(abstract) <= 200 THEN abstract ELSE coalesce(nullif(regexp_extract(head, '^((?s:.*)[.!?])(?:[ \t\n]|$)', 1), ''), nullif(regexp_extract(head, '^((?s:.*)) ', 1), ''), head) END AS trimmed,
  replace(substr(abstract, 1, 300), chr(10), ' ') AS snippet FROM h""")
def trimmed_abstracts(spark, d):
    a = F.col("abstract")
    return table(spark, d, "papers").where("abstract is not null").select("id", T.whole_sentences(a, 200).alias("trimmed"), T.snippet(a).alias("snippet"))


@query(r"""WITH c AS (SELECT id, regexp_replace(body, '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g') AS body FROM papers WHERE body IS NOT NULL),
  h AS (SELECT id, body, regexp_replace(substr(body, 1, 2000), '[ \t\n\r\f\x0b]+$', '') AS head FROM c),
  p AS (SELECT *, CASE WHEN instr(reverse(head), E'\n\n') = 0 THEN 0 ELSE length(head) - instr(reverse(head), E'\n\n') - 1 END AS paragraph,
    CASE WHEN instr(reverse(head), '.다') = 0 THEN 0 ELSE length(head) - instr(reverse(head), '.다') - 1 END AS korean, CASE WHEN instr(reverse(head), '.') = 0 THEN 0 ELSE length(head) - instr(reverse(head), '.') END AS stop FROM h)
  SELECT id, CASE WHEN length(body) <= 2000 THEN body ELSE regexp_replace(CASE WHEN paragraph >= 1800 THEN substr(head, 1, paragraph) WHEN korean >= 1700 THEN substr(head, 1, korean + 2) WHEN stop >= 1400 THEN substr(head, 1, stop + 1) ELSE head END,
    '^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$', '', 'g') END AS trimmed FROM p""")
def boundary_trimmed(spark, d):
    return table(spark, d, "papers").where("body is not null").select("id", T.boundary_trim(F.col("body"), 2000).alias("trimmed"))


@query(r"""SELECT sample_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(output, '(?m)^[ \t]*#+[ \t]*', '', 'g'),
  '(?m)^[ \t]*(?:[-*•]|[0-9]+[.)]|[IVX]+\.)[ \t]+', '', 'g'), 'https?://[^ \t\n]+', '', 'g'), '\[[0-9, -]+\]', '', 'g'), '[ \t\n\r\f\x0b]+', ' ', 'g')) AS output FROM train_balanced""")
def plain_drafts(spark, d):
    return table(spark, d, "train_balanced").select("sample_id", T.plain_draft(F.col("output")).alias("output"))


@query(r"""SELECT item_id, left(text, CASE WHEN category IN ('저작권', 'AI작곡') THEN 150 ELSE 60 END) AS head, trim(regexp_replace(trim(text), '^["''“”‘’]+|["''“”‘’]+$', '', 'g')) AS unquoted,
  CASE WHEN instr(text, ': ') > 0 THEN trim(substr(text, instr(text, ': ') + 2)) ELSE text END AS behind FROM eval_items""")
def item_heads(spark, d):
    t = F.col("text")
    return table(spark, d, "eval_items").select("item_id", F.left(t, F.when(F.col("category").isin("저작권", "AI작곡"), 150).otherwise(60)).alias("head"), T.unquote(t).alias("unquoted"), T.after_mark(t, ": ").alias("behind"))


@query(r"""SELECT document_type, source, concat(document_type, ':', coalesce(source, '?')) AS label, nullif(array_to_string(list_sort(list_distinct(list_filter(list(author), lambda x: trim(x) <> ''))), ', '), '') AS authors
  FROM documents GROUP BY document_type, source""")
def source_labels(spark, d):
    return (
        table(spark, d, "documents")
        .groupBy("document_type", "source")
        .agg(F.sort_array(F.collect_set("author")).alias("a"))
        .select("document_type", "source", F.concat("document_type", F.lit(":"), F.coalesce("source", F.lit("?"))).alias("label"), T.joined_or_null(F.col("a")).alias("authors"))
    )


# Phrases that promise more than a text can hold.
_RISKY = ["always", "never", "\\bproves?\\b", "guarantee", "100 ?%", "undoubtedly"]


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)always|never|\bproves?\b|guarantee|100 ?%|undoubtedly') AS risky FROM documents WHERE text IS NOT NULL""")
def risky_phrases(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.matches_any(F.col("text"), _RISKY).alias("risky"))


@query(r"""WITH t AS (SELECT id, '```json' || chr(10) || to_json({'title': title, 'n': length(title)}) || chr(10) || '```' AS raw FROM papers WHERE title IS NOT NULL)
  SELECT id, regexp_extract(raw, '(?s)```[a-z]*\n(.*)\n```', 1) ->> '$.title' AS title FROM t""")
def fenced_json_titles(spark, d):
    raw = F.concat(F.lit("```json\n"), F.to_json(F.struct("title", F.length("title").alias("n"))), F.lit("\n```"))
    return table(spark, d, "papers").where("title is not null").select("id", F.get_json_object(T.unfence(raw), "$.title").alias("title"))


@query(r"""SELECT id, title, CASE WHEN trim(string_split(body, chr(10))[1]) = '' THEN body WHEN regexp_replace(lower(regexp_replace(string_split(body, chr(10))[1], '^[ \t\n\r\f\x0b]*[0-9]+[.)][ \t\n\r\f\x0b]*', '')), '[ \t\n\r\f\x0b]', '', 'g')
   = regexp_replace(lower(regexp_replace(title, '^[ \t\n\r\f\x0b]*[0-9]+[.)][ \t\n\r\f\x0b]*', '')), '[ \t\n\r\f\x0b]', '', 'g') THEN trim(substr(body, length(string_split(body, chr(10))[1]) + 2)) ELSE body END AS body FROM (
   SELECT id, title, title || chr(10) || body AS body FROM papers WHERE title IS NOT NULL AND body IS NOT NULL)""")
def repeated_headings_removed(spark, d):
    papers = table(spark, d, "papers").where("title is not null and body is not null").select("id", "title", F.concat("title", F.lit("\n"), "body").alias("body"))
    return papers.select("id", "title", F.when(F.trim(F.substring_index("body", "\n", 1)) == "", F.col("body")).otherwise(T.without_heading(F.col("body"), F.col("title"))).alias("body"))


@query(r"""SELECT id, claim_text AS claim FROM paper_citations""")
def citations_kept_inline(spark, d):
    marked = F.concat("claim_text", F.lit(" [x]"))
    return table(spark, d, "paper_citations").select("id", T.known_citations(F.regexp_replace(marked, " \\[x\\]$", "[x]"), F.array("chunk_id")).alias("claim"))


@query(r"""SELECT id, rtrim(conclusion, E' \n') AS conclusion FROM papers WHERE conclusion IS NOT NULL AND trim(conclusion, E' \n') <> ''""")
def conclusions_without_bibliography(spark, d):
    c = F.concat("conclusion", F.lit("\nReferences\n[1] x"))
    return table(spark, d, "papers").where("trim(BOTH ' \n' FROM conclusion) <> ''").select("id", F.rtrim(T.without_bibliography(c)).alias("conclusion"))
