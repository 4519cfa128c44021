"""Problem 10: visually identical text with different characters."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import canon, map_slices, two_longs


def consistent_text(docs: DataFrame) -> DataFrame:
    """doc_id, text in the consistent form (see kernels.canon) to be read: tokens of several possible scripts by context; changed.

    Null text stays null and is not changed; empty text stays empty. One narrow pass, no shuffle.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        out = [None if t is None else canon(t, by_context=True) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, pa.string()), pa.array([a != b for a, b in zip(texts, out)], pa.bool_())],
            names=["doc_id", "text", "changed"],
        )

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, text string, changed boolean")


def form_keys(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 (128-bit hash of the consistent form), stored (64-bit hash of the stored text).

    Null texts are left out; they have no look.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, t) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t is not None]
        keys = [two_longs(canon(t).encode("utf-8", "surrogatepass")) for _, t in rows]
        stored = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 for _, t in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows], pa.int64()),
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array(stored, pa.int64()),
            ],
            names=["doc_id", "k1", "k2", "stored"],
        )

    return map_slices(docs.select("doc_id", "text").where("text is not null"), run, "doc_id long, k1 long, k2 long, stored long")


def lookalike_pairs(docs: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b: documents of different stored text and equal consistent form, smaller id first.

    Forms with one stored spelling are dropped by a map-side combined aggregate before any join, so a text
    delivered many times unchanged never meets itself. Within a form, only documents of different stored
    text are joined, as every such pair is a row of the result.
    """
    keys = form_keys(docs)
    several = keys.groupBy("k1", "k2").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("k1", "k2")
    kept = keys.join(several, ["k1", "k2"], "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    return a.join(b, (F.col("a.k1") == F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2")) & (F.col("a.doc_id") < F.col("b.doc_id")) & (F.col("a.stored") != F.col("b.stored"))).select(
        F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b")
    )


def lookalike_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id, spellings, copies, links: one row per document whose form has several stored spellings.

    group_id is the least doc_id of the form, spellings the number of different stored texts, copies the number of
    documents of this document's spelling, links that of documents of other spellings. No pairs are made: spellings are counted first
    (map-side combined, so a text that a third of all rows carry is one row per task), and documents join one row per spelling.
    """
    keys = form_keys(docs)
    spelled = keys.groupBy("k1", "k2", "stored").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    forms = spelled.groupBy("k1", "k2").agg(F.count("*").alias("spellings"), F.sum("copies").alias("all"), F.min("first").alias("group_id")).where("spellings > 1")
    several = spelled.drop("first").join(forms, ["k1", "k2"])
    return keys.join(several, ["k1", "k2", "stored"]).select("doc_id", "group_id", "spellings", "copies", (F.col("all") - F.col("copies")).alias("links"))
