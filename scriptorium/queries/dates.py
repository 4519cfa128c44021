"""Date functions over the dates, times, addresses and ids of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import dates as D
from scriptorium.storage import table


@query("SELECT doc_id, published_at AS iso, published_at AS compact, published_at AS dotted, CAST(created_at AS DATE) AS mail, CAST(created_at AS DATE) AS zulu FROM documents")
def date_formats_read(spark, d):
    p, t = F.col("published_at"), F.col("created_at")
    return table(spark, d, "documents").select(
        "doc_id",
        D.iso_date(F.concat(F.date_format(p, "yyyy-MM-dd"), F.lit("T09:00:00+09:00"))).alias("iso"),
        D.any_date(F.date_format(p, "yyyyMMdd")).alias("compact"),
        D.any_date(F.date_format(p, "yyyy.MM.dd")).alias("dotted"),
        D.mail_date(F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss Z")).alias("mail"),
        D.zulu_date(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("zulu"),
    )


@query(r"""SELECT doc_id, try_strptime(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '%Y-%m-%d')::DATE AS in_text,
  coalesce(try_strptime(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '%Y-%m-%d')::DATE, published_at, created_at::DATE) AS best,
  strftime(published_at, '%Y-%m-%d') AS iso, published_at IS NOT NULL AND published_at >= DATE '2024-07-01' AS late,
  published_at >= DATE '2025-06-30' - 180 AS recent FROM documents""")
def published_date_cascade(spark, d):
    """Precedence of dates: in the page, stored, time of collection; the day that counts as today is a parameter."""
    docs = table(spark, d, "documents")
    in_text = D.iso_date(F.regexp_extract("text", "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1))
    p = F.col("published_at")
    return docs.select(
        "doc_id",
        in_text.alias("in_text"),
        F.coalesce(in_text, p, F.col("created_at").cast("date")).alias("best"),
        D.iso_or_null(p).alias("iso"),
        (p.isNotNull() & (p >= F.lit("2024-07-01").cast("date"))).alias("late"),
        (p >= F.date_sub(F.lit("2025-06-30").cast("date"), 180)).alias("recent"),
    )


@query(r"""SELECT sample_id, CASE WHEN substr(m, 3, 2) BETWEEN '01' AND '12' THEN make_date(2000 + CAST(substr(m, 1, 2) AS INT), CAST(substr(m, 3, 2) AS INT), 1) END AS month,
  make_date(year, 1, 1) AS year FROM (SELECT sample_id, regexp_extract(paper_id, '(?:^|[^0-9])([0-9]{4})\.[0-9]{4,5}', 1) AS m, metadata.year AS year FROM train_balanced)""")
def id_months(spark, d):
    return table(spark, d, "train_balanced").select("sample_id", D.id_month(F.col("paper_id")).alias("month"), D.year_or_date(F.col("metadata.year").cast("string")).alias("year"))


@query("SELECT doc_id, make_date(year(published_at), month(published_at), 1) AS month, make_date(year(published_at), 1, 1) AS bad_month, coalesce(make_date(year(published_at), 1, 1), DATE '2025-01-01') AS or_today FROM documents")
def month_dates(spark, d):
    y, m = F.year("published_at"), F.month("published_at")
    return table(spark, d, "documents").select("doc_id", D.month_date(y, m).alias("month"), D.month_date(y, m + 12).alias("bad_month"), D.month_date(y, F.lit(None), F.lit("2025-01-01").cast("date")).alias("or_today"))


@query("SELECT doc_id, published_at AS meta, published_at AS element, published_at AS linked, published_at AS named, published_at AS path FROM documents WHERE published_at BETWEEN DATE '1990-01-01' AND DATE '2099-12-31'")
def page_dates(spark, d):
    docs = table(spark, d, "documents").where("published_at between date'1990-01-01' and date'2099-12-31'")
    day = F.date_format("published_at", "yyyy-MM-dd")
    page = lambda before, after: D.page_date(F.concat(F.lit("<html><head>" + before), day, F.lit(after + "</head></html>")))
    return docs.select(
        "doc_id",
        page('<meta property="article:published_time" content="', 'T01:02:03Z"/>').alias("meta"),
        page('<time class="x" datetime="', '">').alias("element"),
        page('<script type="application/ld+json">{"@graph":[{"datePublished" : "', '"}]}</script>').alias("linked"),
        page('<meta name="my_publish_day" content="', '">').alias("named"),
        D.path_date(F.concat(F.lit("https://a.example/"), F.date_format("published_at", "yyyy/M/d"), F.lit("/x"))).alias("path"),
    )
