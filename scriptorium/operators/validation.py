"""Whether papers are supported by the chunks that they cite."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import squeeze

SECTIONS = ("abstract", "introduction", "body", "conclusion")


def sections(papers: DataFrame, names: tuple[str, ...] = SECTIONS) -> DataFrame:
    """paper_id, section, content: one row per section that is not null."""
    rows = papers.select(F.col("id").alias("paper_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(n).alias("content")) for n in names])).alias("s"))
    return rows.select("paper_id", "s.section", "s.content").where("content is not null")


def valid_evidence(citations: DataFrame, papers: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Citations that hold, one of each: the claim is not blank, the chunk belongs to the document, the document exists, and the
    section contains the claim up to white space. Of equal citations the one of least id stays. Nulls never hold."""
    given = citations.where(squeeze(F.col("claim_text")) != "").join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), ["chunk_id", "document_id"], "left_semi")
    given = given.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi").join(sections(papers), ["paper_id", "section"])
    held = given.where(F.contains(squeeze(F.col("content")), squeeze(F.col("claim_text"))))
    key = ["paper_id", "section", "chunk_id", "document_id", "claim_text"]
    return held.groupBy(*key).agg(F.min("id").alias("id"), F.min_by("relevance_score", "id").alias("relevance_score"))


def references(evidence: DataFrame, citations: DataFrame, docs: DataFrame) -> DataFrame:
    """paper_id, number, document_id, title: the documents that evidence cites, in the order of the paper's sources, numbered from 1.

    The sources of a paper are the documents of all its citations, in the order of each one's first citation id.
    """
    order = citations.groupBy("paper_id", "document_id").agg(F.min("id").alias("first"))
    cited = evidence.select("paper_id", "document_id").distinct().join(order, ["paper_id", "document_id"])
    listed = cited.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("first", "document_id"))).alias("all"))
    numbered = listed.select("paper_id", F.posexplode("all").alias("pos", "r")).select("paper_id", (F.col("pos") + 1).alias("number"), F.col("r.document_id").alias("document_id"))
    return numbered.join(docs.select(F.col("doc_id").alias("document_id"), "title"), "document_id")


def faults(papers: DataFrame) -> DataFrame:
    """paper_id, chars, missing: total length and the sorted names of parts that are null or blank."""
    parts = ("title", "abstract", "introduction", "body", "conclusion")
    blank = F.filter(F.array(*[F.when(F.coalesce(F.trim(p), F.lit("")) == "", p) for p in parts]), lambda x: x.isNotNull())
    chars = sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0))
    return papers.select(F.col("id").alias("paper_id"), chars.alias("chars"), F.array_join(F.array_sort(blank), ",").alias("missing"))


def pattern_hits(parts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """paper_id, section, pattern: which named patterns are found where."""
    hit = F.filter(F.array(*[F.when(F.col("content").rlike(p), F.lit(n)) for n, p in patterns.items()]), lambda x: x.isNotNull())
    return parts.select("paper_id", "section", F.explode(hit).alias("pattern"))


def within_budget(contexts: DataFrame, budget: int) -> DataFrame:
    """Greedy selection per query in order: what does not fit is skipped, later ones that fit are taken. contexts: query_id, pos, size.

    Null sizes are left out; of rows with one pos the smaller comes first.
    """
    ordered = contexts.where("size is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "size"))).alias("all"))

    def run(lists: pd.Series) -> pd.DataFrame:
        rows = []
        for items in lists:
            used, taken = 0, []
            for x in items:
                if used + x["size"] <= budget:
                    used += x["size"]
                    taken.append(x["pos"])
            rows.append((used, taken))
        return pd.DataFrame(rows, columns=["used", "taken"])

    folded = ordered.select("query_id", F.pandas_udf(run, "used long, taken array<int>")("all").alias("f"))
    return folded.select("query_id", F.col("f.used").alias("used"), F.explode("f.taken").alias("pos"))


def first_headings(headings: DataFrame) -> DataFrame:
    """The first heading of each key in a paper. headings: paper_id, pos, heading, key."""
    return headings.groupBy("paper_id", "key").agg(F.min_by("heading", "pos").alias("heading"), F.min("pos").alias("pos")).where("key <> ''")
