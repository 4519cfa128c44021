"""Documents to chunks and chunks to vectors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import squeeze
from scriptorium.storage import ship

SIZE, OVERLAP, DIMENSION = 600, 100, 64


def word_windows(c: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Windows of `size` words that overlap; the last one is the first to reach the end. A text without words has none."""
    step = max(size - overlap, 1)
    words = F.split(squeeze(c), " ")
    last = F.greatest(F.lit(0), F.ceil((F.size(words) - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k * step + 1, size), " "))
    return F.when(squeeze(c) == "", F.array().cast("array<string>")).otherwise(windows)


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """document_id, chunk_index, content, token_count, content_tokenized (the fallback: the content itself). Null texts have no chunk."""
    rows = docs.where("text is not null").select(F.col("doc_id").alias("document_id"), F.posexplode(word_windows(F.col("text"), size, overlap)).alias("chunk_index", "content"))
    return rows.withColumn("token_count", F.size(F.split("content", " "))).withColumn("content_tokenized", F.col("content"))


def searchable(tokenized: Column, content: Column) -> Column:
    """The tokenized text, or the content where that is null or empty."""
    return F.coalesce(F.nullif(tokenized, F.lit("")), content)


def hashed_vectors(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of length one."""
    out = np.zeros((len(texts), dimension))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = xxhash.xxh3_64_intdigest(word)
            out[i, h % dimension] += 1 if h >> 63 else -1
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(rows: DataFrame, column: str, provider: Callable[[list[str]], np.ndarray] = hashed_vectors, batch: int = 100, dimension: int = DIMENSION, tries: int = 3, pause: float = 5.0) -> DataFrame:
    """Adds embedding and embedding_error. The provider gets at most `batch` texts a call; a failing call is tried again, `tries` times in all,
    after as many seconds as its error asks for (retry_after) or else `pause` times the number of tries. Then it leaves nulls and its
    message, and other rows go on. Vectors of another dimension count as failures. Null and blank texts get no vector."""

    def run(parts):
        for text in parts:
            vectors, errors = [None] * len(text), [None] * len(text)
            todo = [i for i, t in enumerate(text) if t is not None and t.strip()]
            for start in range(0, len(todo), batch):
                at = todo[start : start + batch]
                for n in range(1, tries + 1):
                    try:
                        got = np.asarray(provider([text.iloc[i] for i in at]), float)
                        if got.shape != (len(at), dimension):
                            raise ValueError(f"expected {len(at)} vectors of {dimension}")
                        for i, v in zip(at, got):
                            vectors[i], errors[i] = v.tolist(), None
                        break
                    except Exception as e:  # one batch may fail
                        for i in at:
                            errors[i] = str(e)
                        if n < tries:
                            time.sleep(getattr(e, "retry_after", None) or pause * n)
            yield pd.DataFrame({"v": vectors, "e": errors})

    ship(rows.sparkSession)
    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "v array<double>, e string")
    return rows.withColumn("_e", udf(F.col(column))).withColumn("embedding", F.col("_e.v")).withColumn("embedding_error", F.col("_e.e")).drop("_e")


def embed_missing(rows: DataFrame, column: str, **params) -> DataFrame:
    """Rows without an embedding get one; the others pass unchanged."""
    old = rows.where("embedding is not null").withColumn("embedding_error", F.lit(None).cast("string"))
    return old.unionByName(embed(rows.where("embedding is null").drop("embedding"), column, **params).select(*old.columns))
