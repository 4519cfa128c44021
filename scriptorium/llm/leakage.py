"""Problem 9: evaluation texts inside training text, by a broadcast hash set of normalised n-grams."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import U64, WORD, map_slices, runs, word_hashes

N, MOST_GRAMS = 12, 2_000_000


def _grams(batch: pa.RecordBatch, n: int) -> pa.RecordBatch | None:
    ids, hashes, places = [], [], []
    for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text:
            h = runs(word_hashes(text), n)
            ids.append(np.full(len(h), i))
            hashes.append(h.view(np.int64))
            places.append(np.arange(len(h)))
    if not ids:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (hashes, ids, places)], names=["gram", "id", "place"])


def grams(df: DataFrame, key: str, n: int = N) -> DataFrame:
    """gram, id, place: the hash of every run of n words of `text`, the row's key and the first word's index."""
    return map_slices(df.select(F.col(key).cast("long"), "text").where("text is not null"), lambda b: _grams(b, n), "gram long, id long, place long")


def leaks(docs: DataFrame, items: DataFrame, n: int = N, most_grams: int = MOST_GRAMS) -> DataFrame:
    """doc_id, item_id, first_char, last_char: each maximal span of the document's text that an item shares.

    A span is n or more consecutive words of both texts; every hash hit is verified on the words. Items are
    broadcast only while their n-grams number at most most_grams (the size is counted first); beyond that the windows
    of both sides are joined by hash, and the joined documents take the same verification with their items.
    Null, empty and shorter texts have no rows.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    docs = docs.select("doc_id", "text").where("text is not null")
    schema = "doc_id long, item_id long, first_char int, last_char int"
    size = grams(items, "item_id", n).limit(most_grams + 1).count()
    if size > most_grams:
        met = grams(docs, "doc_id", n).select("gram", F.col("id").alias("doc_id")).distinct().join(grams(items, "item_id", n).select("gram", F.col("id").alias("item_id")).distinct(), "gram").select("doc_id", "item_id").distinct()
        pairs = met.join(docs, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id").select("doc_id", "text", "item_id", "item_text")

        def verify(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc, text, item, item_text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += _spans(doc, text, _Index([(item, item_text)], n))
            return _rows(rows)

        return map_slices(pairs, verify, schema)
    token = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.toLocalIterator()])

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        index = _index(token, shared, n)
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows += _spans(doc, text, index)
        return _rows(rows)

    return map_slices(docs, scan, schema)


class _Index:
    """The items' n-grams as sorted arrays: 16 bytes each, so at most_grams some 32 MB in a worker. Words are read again from an item's text when it is hit."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.texts = n, dict(items)
        self.words: dict[int, list[str]] = {}
        self.ids = np.array([i for i, _ in items], np.int64)
        each = [runs(word_hashes(text), n) for _, text in items]
        hashes = np.concatenate(each) if each else np.empty(0, U64)
        order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[order]
        self.item = np.repeat(np.arange(len(items), dtype=np.int32), [len(h) for h in each])[order]
        self.place = np.concatenate([np.arange(len(h), dtype=np.int32) for h in each])[order] if each else np.empty(0, np.int32)

    def hits(self, h: np.uint64):
        """(item, place) of every n-gram with that hash."""
        a, b = np.searchsorted(self.sorted, h, "left"), np.searchsorted(self.sorted, h, "right")
        return zip(self.ids[self.item[a:b]].tolist(), self.place[a:b].tolist())

    def item_words(self, item: int) -> list[str]:
        if item not in self.words:
            if len(self.words) >= 10_000:
                self.words.clear()
            self.words[item] = WORD.findall(self.texts[item].lower())
        return self.words[item]


_indexes: dict[str, _Index] = {}


def _index(token: str, shared, n: int) -> _Index:
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = _Index(shared.value, n)
    return _indexes[token]


def _spans(doc: int, text: str, index: _Index) -> list[tuple[int, int, int, int]]:
    hashes = runs(word_hashes(text), index.n)
    if not len(hashes) or not len(index.sorted):
        return []
    near = np.minimum(np.searchsorted(index.sorted, hashes), len(index.sorted) - 1)
    hits = np.flatnonzero(index.sorted[near] == hashes)
    if not len(hits):
        return []
    found = list(WORD.finditer(text.lower()))
    same_length = len(text.lower()) == len(text)  # else places in the lower-case text would not hold in the stored text
    words = [m.group() for m in found]
    if not same_length:
        found = list(WORD.finditer(text))
    last: dict[tuple[int, int], list[int]] = {}
    out = []
    for i in hits.tolist():
        for item, place in index.hits(hashes[i]):
            if words[i : i + index.n] == index.item_words(item)[place : place + index.n]:
                open_span = last.get((item, i - place))
                if open_span and i <= open_span[1] + 1:
                    open_span[1] = i
                else:
                    open_span = last[(item, i - place)] = [i, i]
                    out.append((item, open_span))
    return [(doc, item, found[a].start(), found[b + index.n - 1].end()) for item, (a, b) in out]


def _rows(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "first_char", "last_char"])


def without_leaks(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, removed_chars: the text of every document without its leaked spans; null stays null."""
    cuts = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first_char", "last_char"))).alias("cuts"))
    start = F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    fold = F.aggregate(
        F.col("cuts"),
        start,
        lambda acc, c: F.struct(
            F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, F.greatest(c["first_char"] - acc["at"], F.lit(0)))).alias("kept"),
            F.greatest(acc["at"], c["last_char"]).alias("at"),
        ),
        lambda acc: F.concat(acc["kept"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return docs.select("doc_id", "text").join(cuts, "doc_id", "left").select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(fold).alias("text"), F.col("text").alias("was")).select("doc_id", "text", F.coalesce(F.length("was") - F.length("text"), F.lit(0)).alias("removed_chars"))
