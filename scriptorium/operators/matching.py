"""A stated set of queries against all rows: each task scores blocks of rows for all queries and keeps its best few."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.storage import ship

MOST_PATTERNS = 200_000  # patterns that may be broadcast; more are joined by shuffle


def map_blocks(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = 512) -> DataFrame:
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def pieces(c: Column, size: int) -> Column:
    """The distinct substrings of `size` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - size + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(size))))


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """id, pattern - every (id, text) row with each pattern that its lower-cased text contains.

    A pattern is met through its first three characters (two or one, where it is that short), which are joined with the distinct substrings of
    the texts of that length; what meets is verified. Few substrings meet, so only ids and substrings are joined, and texts come back for the hits.
    Null and empty patterns match nothing.
    """
    wanted = patterns.select(F.lower("pattern").alias("pattern")).where("pattern <> ''").distinct().withColumn("size", F.least(F.length("pattern"), F.lit(3))).withColumn("head", F.left("pattern", F.col("size")))
    few = wanted.limit(MOST_PATTERNS + 1).count() <= MOST_PATTERNS
    if few:  # a checked number of short strings
        wanted = F.broadcast(wanted)
    lower = texts.where("text is not null").select("id", F.lower("text").alias("text"))
    sizes = [r[0] for r in wanted.select("size").distinct().orderBy("size").collect()]
    out = None
    for size in sizes:
        own = wanted.where(F.col("size") == size).drop("size")
        met = lower.select("id", "text", F.explode(pieces(F.col("text"), size)).alias("head")).join(own, "head").where(F.contains("text", "pattern")).select("id", "pattern")
        out = met if out is None else out.unionByName(met)
    return texts.select("id", F.lit("").alias("pattern")).limit(0) if out is None else out.distinct()


def best_rows(scores: DataFrame, query: str, row: str, k: int, *scope: str) -> DataFrame:
    """The k rows of highest score per query (and scope), ties by the row's id, with their rank. Each task passes on its k best only."""
    w = W.partitionBy(query, *scope).orderBy(F.desc("score"), row)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keep_best(queries: list, rows: list, scores: np.ndarray, k: int, row_type: pa.DataType, query_type: pa.DataType, scope: bool = False) -> pa.RecordBatch:
    """Of one block's [row, query] scores, those above zero that can be among a query's best k: the block's k best and their ties."""
    out_q, out_r, out_s = [], [], []
    for j, q in enumerate(queries):
        column = scores[:, j]
        hit = np.flatnonzero(column > 0)
        if len(hit) > k:
            hit = hit[column[hit] >= np.partition(column[hit], len(hit) - k)[len(hit) - k]]
        out_q += [q] * len(hit)
        out_r += [rows[i] for i in hit.tolist()]
        out_s.append(column[hit])
    return pa.RecordBatch.from_arrays([pa.array(out_q, query_type), pa.array(out_r, row_type), pa.array(np.concatenate(out_s) if out_s else [], pa.float64()), pa.array([scope] * len(out_q), pa.bool_())], names=["query_id", "row_id", "score", "scope"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query_id, row_id, distance, rank: the k rows of least cosine distance per query, ties by row_id; exact.

    vectors and queries: id, vector; with a column category on both sides also scope: the ranking among all rows has scope false, that
    among the rows of the query's category has scope true. Both are packed into blocks that meet pairwise, so each task multiplies two
    small matrices; only k rows per query and block go on. Null vectors and vectors of no length have no rows.
    """
    scoped = "category" in vectors.columns and "category" in queries.columns
    row_type = vectors.schema["id"].dataType.simpleString()

    def packed(df: DataFrame, name: str) -> DataFrame:
        good = df.where("vector is not null and size(vector) > 0").select("id", "vector", *(["category"] if scoped else []))
        n = good.count()
        numbered = good.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n // block + 1)))
        return numbered.groupBy("b").agg(F.collect_list(F.struct("id", "vector", *(["category"] if scoped else []))).alias(name)).drop("b")

    pairs = packed(vectors, "rows").crossJoin(packed(queries, "queries"))  # of blocks, not of rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = []
        for i in range(batch.num_rows):
            r, q = batch.column("rows")[i].as_py(), batch.column("queries")[i].as_py()
            m, n = (np.array([x["vector"] for x in side], np.float64) for side in (r, q))
            m, n = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (m, n))
            near = np.round(m @ n.T + 2.0, 12)  # above zero, so that every row counts
            ids, rows, kind = [x["id"] for x in q], [x["id"] for x in r], pa.string() if row_type == "string" else pa.int64()
            parts.append(keep_best(ids, rows, near, k, kind, pa.int64(), False))
            if scoped:
                parts.append(keep_best(ids, rows, near * same([x["category"] for x in r], [x["category"] for x in q]), k, kind, pa.int64(), True))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if parts else None

    found = map_blocks(pairs.select("rows", "queries"), run, f"query_id long, row_id {row_type}, score double, scope boolean", 1)
    best = best_rows(found, "query_id", "row_id", k, "scope").select("query_id", "row_id", F.round(F.lit(3.0) - F.col("score"), 9).alias("distance"), "rank", "scope")
    return best if scoped else best.drop("scope")


def same(rows: list, queries: list) -> np.ndarray:
    """[row, query]: 1 where both have one category, else 0; null is none."""
    kinds = {c: i for i, c in enumerate({c for c in queries if c is not None})}
    return (np.array([kinds.get(c, -1) for c in rows])[:, None] == np.array([kinds.get(c, -2) for c in queries])[None, :]).astype(float)
