"""Bounded samples of labelled text, from which per-language models are fitted."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LANGUAGES = ("en", "ko", "de", "fr", "es", "ja")
MOST_LABELS, LINES, CHARS = 64, 100, 2000
SAMPLE_DOCS = 1500  # documents in the sample, whatever the size of the corpus; languages have equal shares
_MARKED = re.compile("[\u0080-\u009f�]|[Â-ô][\u0080-¿]|[Ѐ-ӿ][^\\x00-\\x7fЀ-ӿ\\s]|[√‚¬][^\\x00-\\x7f]")


def label(column: str) -> F.Column:
    """A language label without blanks, case and suffix; null for a missing one."""
    plain = F.lower(F.regexp_extract(F.trim(column), "^([A-Za-z]+)", 1))
    return F.when(plain.isin("", "und", "unknown"), None).otherwise(plain)


def label_codes(docs: DataFrame, most: int = MOST_LABELS) -> tuple[str, ...]:
    """The most frequent language labels, at most `most`; wrong ones among them are for the caller to find. Every document counts."""
    rows = docs.select(label("lang").alias("label")).where(F.length("label").isin(2, 3)).groupBy("label").agg(F.count("*").alias("n"))
    return tuple(sorted(r["label"] for r in rows.orderBy(F.desc("n"), "label").limit(most).collect()))


def labelled_lines(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, size: int = SAMPLE_DOCS, least: int = 100) -> list[tuple[str, str]]:
    """(label, line) of the lines of `least` or more characters and without marks of a wrong encoding, of at most `size` documents.

    Each language has an equal share of the sample: the different texts of least hash that carry its label, so any run takes the
    same ones and copies count once. They are found on hashes alone; then their texts, and no others, go to the driver. Lines are
    distinct and, within a label, in the order of their hashes: whoever takes some from the front has lines of any document. Of a text
    at most LINES such lines are sampled, of a line at most CHARS characters, so that the sample's size is bounded in bytes too.
    """
    if not languages:
        return []
    rows = docs.select("doc_id", "text", label("lang").alias("label"), F.xxhash64("text").alias("hash")).where(F.col("label").isin(*languages) & F.col("text").isNotNull())
    texts = rows.groupBy("label", "hash").agg(F.min("doc_id").alias("first"))
    taken = texts.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("hash"))).where(F.col("nth") <= -(-size // len(languages)))  # up to 1,000 a label, a top-k in each task comes first
    same = (rows["label"] == taken["label"]) & (rows["hash"] == taken["hash"]) & rows["doc_id"].eqNullSafe(taken["first"])
    found = rows.join(F.broadcast(taken), same, "left_semi").groupBy("label", "hash").agg(F.first("text").alias("text")).select("label", F.transform(F.slice(F.filter(F.split("text", "\n", -1), lambda x: F.length(x) >= least), 1, LINES), lambda x: F.substring(x, 1, CHARS)).alias("lines")).collect()  # at most `size` short rows are broadcast
    lines = {(r["label"], line) for r in found for line in r["lines"] if not _MARKED.search(line)}
    return sorted(lines, key=lambda x: (x[0], hashlib.blake2b(x[1].encode("utf-8", "surrogatepass"), digest_size=16).digest()))
