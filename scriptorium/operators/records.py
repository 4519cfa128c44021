"""Records between services: parsed answers, contexts, citations, reranked lists."""

from __future__ import annotations

import re

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import WS, unfence
from scriptorium.operators.graph import KINDS, RELATIONS
from scriptorium.operators.matching import map_blocks

EXTRACTION = "is_relevant boolean, relevance_reason string, category string, entities array<struct<name:string,entity_type:string>>, relations array<struct<entity_name:string,entity_type:string,relation_type:string,confidence:double>>"


def parsed_extraction(answer: Column) -> Column:
    """A model's answer as a struct: fences go, unknown kinds and relations are left out, a missing or zero confidence is 0.5.

    What isn't JSON counts as not relevant, with empty lists.
    """
    j = F.from_json(unfence(answer), EXTRACTION)
    empty_e, empty_r = F.array().cast("array<struct<name:string,entity_type:string>>"), F.array().cast("array<struct<entity_name:string,entity_type:string,relation_type:string,confidence:double>>")
    entities = F.filter(F.coalesce(j["entities"], empty_e), lambda e: e["entity_type"].isin(*KINDS) & (F.trim(e["name"]) != ""))
    relations = F.filter(F.coalesce(j["relations"], empty_r), lambda r: r["entity_type"].isin(*KINDS) & r["relation_type"].isin(*RELATIONS))
    sure = F.transform(relations, lambda r: F.struct(r["entity_name"].alias("entity_name"), r["entity_type"].alias("entity_type"), r["relation_type"].alias("relation_type"), F.coalesce(F.nullif(r["confidence"], F.lit(0.0)), F.lit(0.5)).alias("confidence")))
    return F.struct(F.coalesce(j["is_relevant"], F.lit(False)).alias("is_relevant"), j["category"].alias("category"), entities.alias("entities"), sure.alias("relations"))


def allowed(c: Column, values: list[str]) -> Column:
    """Whether a value is in the list; null and blank are allowed too."""
    return c.isin(*values) | c.isNull() | (F.trim(c) == "")


def numbered(text: Column, ids: Column) -> Column:
    """Bracketed ids become the number of their place in ids; other bracketed ids go, with the blank before them."""
    parts = F.regexp_extract_all(text, F.lit("([^\\[]+|\\[[^\\]]*\\]?)"), F.lit(1))
    inside = lambda p: F.regexp_replace(p, "^\\[|\\]$", "")
    shown = F.transform(parts, lambda p: F.when(~p.startswith("["), p).when(F.array_contains(ids, inside(p)), F.concat(F.lit("["), F.array_position(ids, inside(p)).cast("string"), F.lit("]"))).otherwise(""))
    return F.regexp_replace(F.array_join(shown, ""), " +(?=[.,;:!?]|$)", "")


def trailing_numbers(citations: Column, ids: Column, text: Column) -> Column:
    """Numbers of citations that have one and are not in the text already, each once, in order."""
    fresh = F.filter(F.array_distinct(citations), lambda c: F.array_contains(ids, c) & ~F.contains(text, F.concat(F.lit("["), c, F.lit("]"))))
    return F.transform(fresh, lambda c: F.array_position(ids, c))


def without_references(text: Column, share: float = 0.45) -> Column:
    """The text before its last line that heads references, if that stands behind `share` of the text."""
    head = F.regexp_extract(text, "(?is)^(.*\\n)[ \\t]*(?:references|bibliography|참고문헌)[ \\t]*(?:\\n|$)", 1)
    return F.when((head != "") & (F.length(head) > share * F.length(text)), F.rtrim(head, F.lit("\n "))).otherwise(text)


def contexts(raw: DataFrame) -> DataFrame:
    """chunk_id, document_id as strings, content; blank and null contents are left out."""
    return raw.where(F.trim("content") != "").select(F.col("id").cast("string").alias("chunk_id"), F.col("document_id").cast("string").alias("document_id"), "content")


_SPACED = re.compile(r"[^ \t\n\r\f\v]+")


def serialized(chunks: DataFrame) -> DataFrame:
    """document_id, blocks: a JSON block for each chunk whose content is not null, in the order of chunk_index, joined by blank lines."""
    block = F.struct("chunk_index", F.to_json(F.struct(F.col("id").alias("chunk_id"), "content")).alias("j"))
    rows = chunks.where("content is not null").groupBy("document_id").agg(F.array_sort(F.collect_list(block)).alias("b"))
    return rows.select("document_id", F.array_join(F.transform("b", lambda x: x["j"]), "\n\n").alias("blocks"))


def counter_map(df: DataFrame, column: str) -> DataFrame:
    """One row: map of value -> rows, null values under 'none'. The map is as large as the number of values: for closed vocabularies."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("none")).alias("k")).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("counts"))


def rerank(candidates: DataFrame, judge: Callable[[str, list[str]], list[int]], judged: int = 20) -> DataFrame:
    """query_id, chunk_id, place: of each topic's first `judged` candidates those that the judge keeps, then all others unjudged.

    candidates: query_id, topic, chunk_id, content, pos. The judge gets the topic and the contents and gives places from 1. If it fails, gives
    no list, places out of range, or keeps nothing, the topic's candidates pass unchanged.
    """
    grouped = candidates.groupBy("query_id", "topic").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", F.left("content", F.lit(300)).alias("content")))).alias("all"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for q, topic, found in zip(*(c.to_pylist() for c in batch.columns)):
            head, tail = found[:judged], found[judged:]
            try:
                keep = judge(topic, [(x["content"] or "").replace("\n", " ") for x in head])
                keep = sorted({k for k in keep if 1 <= k <= len(head)})
                head = [head[k - 1] for k in keep] or head
            except Exception:  # an answer that can't be used changes nothing
                pass
            rows += [(q, x["chunk_id"], i) for i, x in enumerate(head + tail, 1)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32()))], names=["query_id", "chunk_id", "place"])

    return map_blocks(grouped.select("query_id", "topic", "all"), run, "query_id long, chunk_id string, place int")


def word_judge(topic: str, contents: list[str]) -> list[int]:
    """A deterministic stand-in for a model: keeps contents that share two or more words with the topic."""
    words = set(_SPACED.findall((topic or "").lower()))
    return [i for i, c in enumerate(contents, 1) if len(words.intersection(_SPACED.findall(c.lower()))) >= 2]


def first_safe(attempts: list[Column], safe: Callable[[Column], Column], fallback: str) -> Column:
    """The first attempt that is safe, else the fallback."""
    return F.coalesce(*[F.when(safe(a), a) for a in attempts], F.lit(fallback))


def shares(total: Column, percents: list[int]) -> Column:
    """Whole-number parts of a total by per cent, the rest as the last part."""
    parts = [F.floor(total * p / 100) for p in percents]
    return F.array(*parts, total - sum(parts[1:], parts[0]))
