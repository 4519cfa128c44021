"""Cleaning of pages and lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators import cleaning as C
from scriptorium.storage import table

_MARKERS = ["Back to top", "맨 위로", "Nach oben", *C.FOOTERS]
_PATTERNS = ["^©", "^[-*»+][ \\t]", "@", *C.LINE_PATTERNS]
_WIDGETS = ["print", "save", "share", "mail", "chat", "copy", "link", "comments", "menu", "search", "close", *C.WIDGETS]


def _pages(docs):
    """Pages made of the documents: the escaped text in an article, among elements without content."""
    html = F.concat(
        F.lit("<html><head><title> "), C.escaped(F.coalesce("title", F.lit(""))), F.lit(" </title><script>var a = '<p>no</p>';</script></head><body><nav><a>Menu</a></nav><!-- <p>no</p> --><article><p>"),
        F.replace(C.escaped(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article><footer>Imprint</footer></body></html>"),
    )
    pages = docs.where("text is not null").select("doc_id", html.alias("html"))
    return pages.select("doc_id", C.page_title(F.col("html")).alias("title"), C.page_text(F.col("html")).alias("text"))


@query("""SELECT doc_id, nullif(trim(title), '') AS title, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS text
  FROM documents WHERE text IS NOT NULL""")
def clean_pages(spark, d):
    return _pages(table(spark, d, "documents"))


_LINES = "string_split(text, chr(10))"
_MARKED = " OR ".join(f"starts_with(trim(x), '{m}')" for m in _MARKERS)


@query(f"""WITH l AS (SELECT doc_id, {_LINES} AS lines, list_position(list_transform({_LINES}, lambda x: {_MARKED}), true) AS pos FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, array_to_string(CASE WHEN pos > 0 THEN lines[1 : pos - 1] ELSE lines END, chr(10)) AS text FROM l""")
def footers_cut(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(C.before_marker(F.split("text", "\n", -1), _MARKERS), "\n").alias("text"))


_MATCHED = " OR ".join(f"regexp_matches(trim(line), '{p}')" for p in _PATTERNS)
_NAMES = ", ".join(f"'{w}'" for w in _WIDGETS)


@query(rf"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line, unnest(range(len({_LINES}))) AS i FROM documents WHERE text IS NOT NULL),
  w AS (SELECT *, list_filter(regexp_split_to_array(trim(line), '[ \t]+'), lambda x: x <> '') AS w FROM l),
  k AS (SELECT *, (len(w) >= 6 AND len(list_filter(w, lambda x: NOT regexp_matches(x, '{C.MENU_WORD}'))) = 0 AND NOT regexp_matches(line, '[.!?"''“”「」]')) AS menu,
    (len(w) >= 3 AND len(list_filter(w, lambda x: lower(x) IN ({_NAMES}) OR regexp_matches(x, '{C.WIDGET_SHAPES}'))) / greatest(len(w), 1) >= 0.6) AS widget, {_MATCHED} AS pattern FROM w)
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT menu AND NOT widget AND NOT pattern), '') AS text, count(*) FILTER (WHERE menu OR widget OR pattern) AS removed FROM k GROUP BY doc_id""")
def boilerplate_lines(spark, d):
    lines = F.split("text", "\n", -1)
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", lines.alias("l"), C.keep_lines(lines, _PATTERNS, _WIDGETS).alias("k"))
    return rows.select("doc_id", F.array_join("k", "\n").alias("text"), (F.size("l") - F.size("k")).alias("removed"))


@query(rf"""WITH l AS (SELECT doc_id, trim(unnest({_LINES})) AS line, unnest(range(len({_LINES}))) AS i FROM documents WHERE text IS NOT NULL),
  m AS (SELECT *, length(line) <= 60 AND NOT regexp_matches(line, '[.!?"''“”「」,]') AS menu FROM l WHERE line <> ''), b AS (SELECT *, sum(CASE WHEN menu THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS breaks FROM m)
  SELECT doc_id, min(i) + 1 AS first, max(i) + 1 AS last, count(*) AS n FROM b WHERE menu GROUP BY doc_id, breaks HAVING count(*) >= 4""")
def menu_runs(spark, d):
    return C.menu_runs(table(spark, d, "documents"), least=4, longest=60)


@query()
def reflowed_texts(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", C.reflow(F.col("text")).alias("text"))


@query()
def cleaned_texts(spark, d):
    """All rules for lines, in their order, on every document; the order is tested on a fixture."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text").transform(C.clean_lines, "text", _MARKERS, _PATTERNS, _WIDGETS)


@query()
def page_records(spark, d):
    """Pages made of all web pages, with their date in a meta element, brought back to date, title and cleaned text."""
    docs = table(spark, d, "documents").where("text is not null and document_type = 'webpage'")
    meta = F.concat(F.lit('<html><head><meta content="'), F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("")), F.lit('" property="article:published_time"></head>'))
    html = F.concat(meta, F.lit("<body><nav>Menu</nav><article><title>"), C.escaped(F.coalesce("title", F.lit(""))), F.lit("</title><p>"), F.replace(C.escaped(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    return C.page_records(docs.select("doc_id", html.alias("html")), "html", _MARKERS, _PATTERNS, _WIDGETS).drop("html")


@query()
def parsed_sections(spark, d):
    papers = table(spark, d, "papers").where("body is not null")
    text = F.concat_ws("\n", F.lit("Introduction"), "introduction", "body", F.lit("Conclusion"), "conclusion")
    return papers.select("id", C.split_sections(text).alias("s")).select("id", "s.*")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)<br[ \t]*/?>', ' ', 'g'), '\[[^\]\n]{0,80}(?:rights|권리)[^\]\n]{0,80}\]', ' ', 'g'), '[ \t]+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL""")
def fixed_substitutions(spark, d):
    table_of = [("(?i)<br[ \\t]*/?>", " "), ("\\[[^\\]\\n]{0,80}(?:rights|권리)[^\\]\\n]{0,80}\\]", " "), ("[ \\t]+", " ")]
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.trim(C.substitute(F.col("text"), table_of)).alias("text"))
