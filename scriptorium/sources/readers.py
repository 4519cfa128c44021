"""Readers of landed records: JSON lines and files, feeds, answers of services, harvested XML, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scriptorium.functions.arrays import enveloped, one_or_many

# The columns of a raw document record.
RAW = "title string, content string, url string, author string, category string, document_type string, published_at date, language string, source_name string"


def json_lines(spark: SparkSession, path: str, schema: StructType | str, bad: str = "drop") -> DataFrame:
    """JSON lines; bad lines are dropped, fail the read, or come as rows with their text in _corrupt_record ('keep')."""
    mode = {"drop": "DROPMALFORMED", "fail": "FAILFAST", "keep": "PERMISSIVE"}[bad]
    return spark.read.schema(schema).option("mode", mode).json(path)


def json_files(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One JSON value per file, with the file's name as source_file."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.col("_metadata.file_name"))


def feed_items(df: DataFrame, xml: str) -> DataFrame:
    """Adds title, link, published, updated of an RSS item or Atom entry; entries without a link are left out."""
    parsed = F.from_xml(xml, "title string, link string, pubDate string, published string, updated string, description string")
    rows = df.withColumn("_x", parsed).select(*df.columns, F.trim("_x.title").alias("title"), F.nullif(F.trim("_x.link"), F.lit("")).alias("link"), F.coalesce("_x.published", "_x.pubDate").alias("published"), F.col("_x.updated").alias("updated"))
    return rows.where("link is not null")


def envelope_rows(df: DataFrame, json: str, name: str, element: str) -> DataFrame:
    """Adds place and row for each object under `name`, which may hold one object, a list, or be missing (then the value itself)."""
    rows = one_or_many(enveloped(F.col(json), name), element)
    return df.select(*df.columns, F.posexplode(rows).alias("_i", "row")).withColumn("place", F.col("_i") + 1).drop("_i")


def in_language(elements: Column, language: str) -> Column:
    """Of elements with _VALUE and _lang: the value in the language, else the first."""
    return F.coalesce(F.get(F.filter(elements, lambda e: e["_lang"] == language), F.lit(0))["_VALUE"], F.get(elements, F.lit(0))["_VALUE"])


def identifier(elements: Column, kind: str) -> Column:
    """Of elements with _VALUE and _type: the value of the kind; null if none has it."""
    return F.get(F.filter(elements, lambda e: e["_type"] == kind), F.lit(0))["_VALUE"]


def harvested(df: DataFrame, xml: str, language: str = "en") -> DataFrame:
    """Adds title, doi, url and deleted of one harvested record: titles by language, identifiers by type."""
    element = "array<struct<_VALUE:string,{}:string>>".format
    parsed = F.from_xml(xml, f"header struct<_status:string>, title {element('_lang')}, identifier {element('_type')}")
    r = df.withColumn("_x", parsed)
    return r.select(*df.columns, in_language(F.col("_x.title"), language).alias("title"), identifier(F.col("_x.identifier"), "doi").alias("doi"), identifier(F.col("_x.identifier"), "url").alias("url"), F.coalesce(F.col("_x.header._status") == "deleted", F.lit(False)).alias("deleted"))


def resumption(xml: Column) -> Column:
    """struct(token, error) of a harvested page: the token of the next page, null on the last; no matching records is no error."""
    token = F.nullif(F.trim(F.regexp_extract(xml, "(?s)<resumptionToken[^>]*>(.*?)</resumptionToken>", 1)), F.lit(""))
    error = F.nullif(F.regexp_extract(xml, '<error[^>]*code="([^"]*)"', 1), F.lit(""))
    return F.struct(token.alias("token"), F.nullif(error, F.lit("noRecordsMatch")).alias("error"))


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not seen; rows with a null key stay. Goes before whatever is dear."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def urls_by_title(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """rows with the url of the first listed row (by doc_id) of equal title; null where none has one."""
    first = listed.where("url is not null and title is not null").groupBy("title").agg(F.min_by("url", "doc_id").alias("url"))
    return rows.join(first, "title", "left")


def by_precedence(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """id, found: the id itself if we have it, else the least id of equal base (lower case, without version), else the least id whose base begins with it, else null.

    Beginnings are the substrings of the bases we have, one row each, so all three steps are joins on equality.
    """
    base = F.regexp_replace(F.lower(F.trim("id")), "v[0-9]+$", "")
    exact = have.select("id", F.col("id").alias("exact")).distinct()
    based = have.withColumn("base", base).where("base <> ''")
    near = based.groupBy("base").agg(F.min("id").alias("near"))
    begin = based.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.length("base")), lambda n: F.substring("base", F.lit(1), n))).alias("base")).groupBy("base").agg(F.min("id").alias("begins"))
    found = wanted.withColumn("base", base).join(exact, "id", "left").join(near, "base", "left").join(begin, "base", "left")
    return found.select("id", F.coalesce("exact", "near", "begins").alias("found"))
