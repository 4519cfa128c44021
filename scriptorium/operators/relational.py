"""Relational building blocks; each leaves the choice of join and aggregation to Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.storage import stage


def metadata_filter(df: DataFrame, category: str | None = None, published_after: str | None = None) -> DataFrame:
    """Each given condition becomes a filter that reaches the scan; none given, none added. Null values never match."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if published_after is not None:
        df = df.where(F.col("published_at") >= F.lit(published_after).cast("date"))
    return df


def relevant(docs: DataFrame, least: int, pattern: str) -> DataFrame:
    """Documents with text of `least` or more characters, a URL, and a title that the case-insensitive pattern finds."""
    return docs.where(F.col("url").isNotNull() & (F.length("text") >= least) & F.col("title").rlike("(?i)" + pattern))


def cutoff_counts(df: DataFrame, key: str, day: str, cutoff: str) -> DataFrame:
    """Rows before, from and without the day, first and last day, per key (null is a key)."""
    at = F.lit(cutoff).cast("date")
    return df.groupBy(key).agg(F.count_if(F.col(day) < at).alias("before"), F.count_if(F.col(day) >= at).alias("after"), F.count_if(F.col(day).isNull()).alias("undated"), F.min(day).alias("first"), F.max(day).alias("last"))


def without_children(parents: DataFrame, children: DataFrame, key: str, reference: str) -> DataFrame:
    """Parents that no child refers to; parents with a null key stay."""
    return parents.join(children.select(F.col(reference).alias(key)), key, "left_anti")


def child_counts(parents: DataFrame, children: DataFrame, key: str, reference: str, name: str) -> DataFrame:
    """Parents with the number of their children, 0 where there is none. Children are counted before the join."""
    counted = children.groupBy(F.col(reference).alias(key)).agg(F.count("*").alias(name))
    return parents.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def chunks_with_documents(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs, F.col("document_id") == F.col("doc_id"))


def section_coverage(papers: DataFrame, citations: DataFrame, sections: list[str]) -> DataFrame:
    """paper_id, section, citations for every required section, 0 where nothing is cited. Citations are counted first."""
    counted = citations.groupBy("paper_id", "section").agg(F.count("id").alias("citations"))
    wanted = papers.select(F.col("id").alias("paper_id"), F.explode(F.array(*map(F.lit, sections))).alias("section"))
    return wanted.join(counted, ["paper_id", "section"], "left").withColumn("citations", F.coalesce("citations", F.lit(0)))


def report(df: DataFrame, key: str, *counters: Column) -> DataFrame:
    """Counters per key and over all rows (key null)."""
    return df.groupingSets([[key], []], key).agg(*counters)


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds batch, the number of the group of `size` consecutive rows in the given total order.

    Positions come from a range sort: rows are counted per sorted partition and each partition is numbered from its offset,
    so no task sees more than its range.
    """
    ranked = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    ranked = stage(ranked.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    sizes = ranked.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per partition
    first = ranked.join(F.broadcast(offsets), "_part")
    position = F.col("_offset") + F.col("_id") - F.shiftleft(F.col("_part").cast("long"), 33)
    return first.withColumn("batch", F.floor(position / size)).drop("_part", "_id", "_n", "_offset")


def missing_values(df: DataFrame, column: str, required: list[str], name: str) -> DataFrame:
    wanted = df.sparkSession.createDataFrame([(x,) for x in required], f"{name} string")
    return wanted.subtract(df.select(F.col(column).alias(name)))


def top_ranked(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows with their rank: top-k first, so the window sees k rows only."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(W.orderBy(*order)))
