"""Problem 2: lines repeated across the documents of one source, by content-defined chunks."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.llm.kernels import U64, list_array, map_slices, mix
from scriptorium.storage import stage

WINDOW, MASK, LEAST_DOCS, LEAST_CHARS = 8, 31, 5, 60  # characters in the rolling hash; one cut in MASK + 1 places; documents of a source; letters of a span
_GOLD = U64(0x9E3779B97F4A7C15)
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """By code point: 0 falls out of a line's key (white space, digits, punctuation, symbols), 1 letter, 2 other."""
    global _kinds
    if _kinds is None:
        k = np.full(0x110000, 2, np.uint8)
        for o in range(0x32000):
            c = chr(o)
            cat = unicodedata.category(c)
            k[o] = 0 if cat[0] in "ZNPS" or c.isspace() else 1 if cat[0] == "L" else 2
        _kinds = k
    return _kinds


def line_chunks(docs: DataFrame, window: int = WINDOW, mask: int = MASK, places: bool = False) -> DataFrame:
    """doc_id, source_id, line_no, key, chunks, firsts - one row per line that has a letter; with `places` also starts, ends, sizes.

    The characters of the key of a document stream through a rolling hash over `window` characters; where its low bits are
    zero the text is cut, so equal passages give equal chunks wherever they stand. A line break is a cut too, as the
    shortest lines have two letters, and no window reaches over it. key is the hash over the line's chunks; firsts marks the first
    place of each chunk in the document; starts and ends are the chunks' places in the line, sizes their characters without
    white space, digits, punctuation and symbols. Documents with null text or null source have no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, sources, texts = (c.to_pylist() for c in batch.columns)
        counts = np.array([t.count("\n") + 1 for t in texts])
        lowered = [t.lower() for t in texts]
        if places:  # a letter that becomes two would shift them
            lowered = [low if len(low) == len(t) else "".join(c if len(c.lower()) > 1 else c.lower() for c in t) for low, t in zip(lowered, texts)]
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = kinds()[points]
        line_of = np.cumsum(points == 10)
        kept = kind > 0
        line = line_of[kept]
        if not len(line):
            return None
        total = int(counts.sum())
        has_letter = np.bincount(line, kind[kept] == 1, total) > 0
        char = mix(points[kept].astype(U64) * _GOLD + U64(1))
        at = np.arange(len(line))
        new_line = np.r_[True, line[1:] != line[:-1]]
        place = at - np.maximum.accumulate(np.where(new_line, at, 0))
        with np.errstate(over="ignore"):
            roll = char.copy()
            power = U64(1)
            for back in range(1, window):
                power = power * _GOLD
                roll[back:] += char[:-back] * power
            cut = (place >= window - 1) & ((mix(roll) & U64(mask)) == 0)
            starts = np.flatnonzero(np.r_[True, cut[:-1]] | new_line)
            in_chunk = at - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
            chunk = mix(np.add.reduceat(mix(char + _GOLD * (in_chunk + 1).astype(U64)), starts))
            chunk_line = line[starts]
            first_chunk = np.flatnonzero(np.r_[True, chunk_line[1:] != chunk_line[:-1]])
            n_chunks = np.diff(np.r_[first_chunk, len(chunk)])
            nth = np.arange(len(chunk)) - np.repeat(first_chunk, n_chunks)
            key = mix(np.add.reduceat(mix(chunk + _GOLD * (nth + 1).astype(U64)), first_chunk))
        lines = chunk_line[first_chunk]
        doc_of_line = np.repeat(np.arange(len(texts)), counts)
        first_line = np.cumsum(counts) - counts
        ok = has_letter[lines]
        chunk_ok = np.repeat(ok, n_chunks)
        lines, n_chunks, key, chunk, chunk_line = lines[ok], n_chunks[ok], key[ok], chunk[chunk_ok], chunk_line[chunk_ok]
        if not len(lines):
            return None
        doc = doc_of_line[lines]
        more = []
        if places:
            where = np.flatnonzero(kept)
            begin = np.r_[0, np.flatnonzero(points == 10) + 1]
            first_at, last_at = where[starts], where[np.r_[starts[1:], len(at)] - 1] + 1
            sizes = np.diff(np.r_[starts, len(at)])
            own = begin[line[starts]]
            more = [list_array(x[chunk_ok].astype(np.int32), n_chunks, pa.int32()) for x in (first_at - own, last_at - own, sizes)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(ids)[doc], pa.int64()),
                pa.array(np.array(sources)[doc], pa.int32()),
                pa.array((lines - first_line[doc] + 1).astype(np.int32), pa.int32()),
                pa.array(key.view(np.int64), pa.int64()),
                list_array(chunk.view(np.int64), n_chunks, pa.int64()),
                list_array(_first(doc_of_line[chunk_line], chunk), n_chunks, pa.bool_()),
                *more,
            ],
            names=["doc_id", "source_id", "line_no", "key", "chunks", "firsts", *(["starts", "ends", "sizes"] if places else [])],
        )

    rows = docs.select("doc_id", "source_id", "text").where("text is not null and source_id is not null")
    return map_slices(rows, run, "doc_id long, source_id int, line_no int, key long, chunks array<long>, firsts array<boolean>" + (", starts array<int>, ends array<int>, sizes array<int>" if places else ""))


def _first(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(doc)), value, doc))
    d, v = doc[order], value[order]
    out = np.empty(len(doc), bool)
    out[order] = np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])]
    return out


def _common(chunks: DataFrame, least_docs: int) -> DataFrame:
    """source_id, chunk that at least least_docs documents of the source hold; a chunk that a third of all documents hold is one partial row per task."""
    return chunks.groupBy("source_id", "chunk").agg(F.count_if("first").alias("docs")).where(F.col("docs") >= least_docs).select("source_id", "chunk")


def _exploded(lines: DataFrame, *kept: str) -> DataFrame:
    return lines.select(*kept, "source_id", F.explode(F.arrays_zip("chunks", "firsts")).alias("c")).select(*kept, "source_id", F.col("c.chunks").alias("chunk"), F.col("c.firsts").alias("first"))


def repeated_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, **params) -> DataFrame:
    """doc_id, line_no, source_id of every line found in at least least_docs different documents of its source.

    Documents are counted per source and chunk. A line enters by its chunk of least hash, which is the same wherever the line stands: if
    that is repeated the line is a candidate, and the exact count of documents by the hash over all its chunks decides. So all chunks are
    counted, but only one row per line is joined; that side may have hot chunks, the other has one row per chunk, which the
    adaptive skew join splits. A row that is repeated under one id is one document.
    """
    lines = stage(line_chunks(docs, **params), "lines")
    common = _common(_exploded(lines), least_docs)
    entry = lines.select("doc_id", "line_no", "source_id", "key", F.array_min("chunks").alias("chunk"))
    candidates = stage(entry.join(common, ["source_id", "chunk"], "left_semi").drop("chunk"), "candidate-lines")
    sure = candidates.groupBy("source_id", "key").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= least_docs).select("source_id", "key")
    return candidates.join(sure, ["source_id", "key"], "left_semi").select("doc_id", "line_no", "source_id").distinct()


def repeated_spans(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, **params) -> DataFrame:
    """doc_id, line_no, first_char, last_char (places in the line), docs: maximal runs of repeated chunks of a line that as a whole stand in at least least_docs documents of the source.

    This also finds a notice that is glued to other text: its chunks but the first and the last, whose ends lie in the other text, are the
    same everywhere. Runs under least_chars letters are too common in any language and are left. Joins as in repeated_lines, but with
    all chunks; a run is put together by its line, and counted by its hash.
    """
    lines = stage(line_chunks(docs, places=True, **params), "lines")
    common = _common(_exploded(lines), least_docs).withColumn("common", F.lit(True))
    placed = lines.select("doc_id", "line_no", "source_id", F.explode(F.arrays_zip("chunks", "starts", "ends", "sizes")).alias("c")).select("doc_id", "line_no", "source_id", F.col("c.chunks").alias("chunk"), F.col("c.starts").alias("start"), F.col("c.ends").alias("end"), F.col("c.sizes").alias("size")).distinct()
    met = placed.join(common, ["source_id", "chunk"], "left")
    by_line = W.partitionBy("doc_id", "source_id", "line_no").orderBy("start")
    runs = met.withColumn("run", F.count_if(F.col("common").isNull()).over(by_line)).where("common").groupBy("doc_id", "source_id", "line_no", "run").agg(
        F.min("start").alias("first_char"), F.max("end").alias("last_char"), F.sum("size").alias("size"), F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("start", "chunk"))), lambda c: c["chunk"])).alias("hash")
    )
    runs = stage(runs.where(F.col("size") >= least_chars), "runs")
    counted = runs.groupBy("source_id", "hash").agg(F.count_distinct("doc_id").alias("docs")).where(F.col("docs") >= least_docs)
    return runs.join(counted, ["source_id", "hash"]).select("doc_id", "line_no", "first_char", "last_char", "docs")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, removed: every text without the found spans, all else as it is; null stays null."""
    cut = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "first_char", "last_char"))).alias("cut"))

    def rest(line, i):
        own = F.filter("cut", lambda c: c["line_no"] == i + 1)
        end = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
        fold = F.aggregate(own, end, lambda acc, c: F.struct(F.concat(acc["kept"], F.substring(line, acc["at"] + 1, c["first_char"] - acc["at"])).alias("kept"), c["last_char"].alias("at")))
        return F.concat(fold["kept"], F.substring(line, fold["at"] + 1, F.length(line)))

    kept = F.array_join(F.transform(F.split("text", "\n", -1), rest), "\n")
    return docs.select("doc_id", "text").join(cut, "doc_id", "left").select("doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("cut"), F.lit(0)).alias("removed"))


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text, removed: every text without its found lines, all other lines as they are; null stays null."""
    cut = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("cut"))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col("cut"), i + 1)), "\n")
    return docs.select("doc_id", "text").join(cut, "doc_id", "left").select("doc_id", F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size("cut"), F.lit(0)).alias("removed"))
