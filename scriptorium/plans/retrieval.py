"""Hybrid retrieval for a batch of topics: keyword, exact-phrase, graph and vector channels, fused and filtered.

Every frame carries query_id, so all topics run in one job. Every ranking has a total order.
"""

from __future__ import annotations

from collections import Counter
from hashlib import md5

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.text import proper_nouns
from scriptorium.operators.matching import best_rows, containing, keep_best, map_blocks, nearest, same
from scriptorium.storage import per_value, stage

K1, B = 1.2, 0.75
MOST_ASKED = 1_000_000  # words of topics, each topic's counted for itself, that are broadcast at once
CHANNEL_K, PHRASE_K, GRAPH_K, RRF_K = 50, 30, 30, 60
_WORD = r"[\p{L}\p{N}]+"


def terms(c: str) -> F.Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({_WORD})"), F.lit(1))


# --- channels --------------------------------------------------------------------------------------------------------


def searchable(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_id, document_id, chunk_index, content, document_type, category: chunks of known documents, written once for all channels."""
    of = docs.select(F.col("doc_id").alias("document_id"), "document_type", "category")
    return stage(chunks.select("chunk_id", "document_id", "chunk_index", "content").join(of, "document_id"), "searchable")


def bucket_vector(c: str, size: int = 64) -> F.Column:
    """A deterministic stand-in for an embedding: how many words of the text fall into each of `size` buckets of a hash; null without words."""
    find, known = regex.compile(_WORD).findall, {}

    def bucket(word: str) -> int:
        if word not in known:
            if len(known) >= 1_000_000:
                known.clear()
            known[word] = int(md5(word.encode()).hexdigest()[:4], 16) % size
        return known[word]

    def vector(text: str) -> list[float] | None:
        words = find(text.lower())
        return np.bincount([bucket(w) for w in words], minlength=size).astype(float).tolist() if words else None

    return per_value(vector, "array<double>")(F.col(c))


def vector_channel(topics: DataFrame, chunks: DataFrame, k: int = CHANNEL_K, embed=bucket_vector) -> DataFrame:
    """query_id, chunk_id, score, rank, scope: the k nearest chunks of each topic, among all and among those of its category; exact.

    embed gives the vector of a text column; for a model's vectors give a function that names the column they are in.
    """
    rows = chunks.where("content is not null").select(F.col("chunk_id").alias("id"), embed("content").alias("vector"), "category")
    found = nearest(rows, topics.select(F.col("query_id").alias("id"), embed("text").alias("vector"), "category"), k)
    return found.select("query_id", F.col("row_id").alias("chunk_id"), (1 - F.col("distance")).alias("score"), "rank", "scope")


def keyword_channel(topics: DataFrame, chunks: DataFrame, k: int = CHANNEL_K, most: int = MOST_ASKED) -> DataFrame:
    """query_id, chunk_id, score, rank, scope: BM25 over any of the topic's words; the k best chunks of each topic, among all (scope false) and among those of its category.

    topics: query_id, text, category; chunks: chunk_id, content, category. Corpus statistics come from all chunks by a partial aggregate;
    only those of the topics' words, a stated set, go to the driver, and from there as a sparse table. It is counted first: more than `most`
    words of topics are taken in blocks of topics, a pass each. Each task scores its chunks against the topics and passes on its best, so no
    pair of a topic and a chunk is shuffled that can't be among the best.
    """
    spark = chunks.sparkSession
    per = chunks.where("content is not null").select(terms("content").alias("t"))
    n, mean = per.agg(F.count("*"), F.avg(F.size("t"))).first()
    asked = topics.select("query_id", "category", F.explode(F.array_distinct(terms("text"))).alias("term"))
    blocks = asked.count() // most + 1
    found = None
    for block in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        part = _keyword_block(spark, own, chunks, per, n, float(mean or 1), k)
        found = part if found is None else found.unionByName(part)
    return best_rows(found, "query_id", "row_id", k, "scope").select("query_id", F.col("row_id").alias("chunk_id"), "score", "rank", "scope")


def _keyword_block(spark, asked: DataFrame, chunks: DataFrame, per: DataFrame, n: int, mean: float, k: int) -> DataFrame:
    words = F.broadcast(asked.select("term").distinct())  # at most MOST_ASKED
    df = {r[0]: r[1] for r in per.select(F.explode(F.array_distinct("t")).alias("term")).join(words, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).collect()}
    rows = asked.collect()
    queries = sorted({r["query_id"] for r in rows})
    place = {q: j for j, q in enumerate(queries)}
    category = {r["query_id"]: r["category"] for r in rows}
    table: dict[str, tuple[list, list]] = {}
    for r in rows:
        if r["term"] in df:
            at, weight = table.setdefault(r["term"], ([], []))
            at.append(place[r["query_id"]])
            weight.append(np.log(1 + (n - df[r["term"]] + 0.5) / (df[r["term"]] + 0.5)))
    shared = spark.sparkContext.broadcast(({t: (np.array(a), np.array(w)) for t, (a, w) in table.items()}, queries, [category[q] for q in queries]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        table, queries, categories = shared.value
        find = regex.compile(_WORD).findall
        scores = np.zeros((batch.num_rows, len(queries)))
        for i, content in enumerate(batch.column(1).to_pylist()):
            words = find((content or "").lower())
            for word, tf in Counter(w for w in words if w in table).items():
                at, weight = table[word]
                scores[i, at] += weight * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean)))
        scores = np.round(scores, 6)
        ids = batch.column(0).to_pylist()
        parts = [keep_best(queries, ids, scores, k, pa.string(), pa.int64(), False), keep_best(queries, ids, scores * same(batch.column(2).to_pylist(), categories), k, pa.string(), pa.int64(), True)]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if any(p.num_rows for p in parts) else None

    return map_blocks(chunks.select("chunk_id", "content", "category"), run, "query_id long, row_id string, score double, scope boolean")


def phrase_channel(topics: DataFrame, chunks: DataFrame, k: int = PHRASE_K) -> DataFrame:
    """query_id, chunk_id, score, rank, scope: chunks by the number of the topic's proper-noun phrases that they contain, among all and among those of its category. A topic without phrases has no rows."""
    phrases = topics.select("query_id", F.explode(proper_nouns(F.col("text"))).alias("phrase")).select("query_id", F.lower("phrase").alias("pattern")).distinct()
    hits = containing(chunks.select(F.col("chunk_id").alias("id"), F.col("content").alias("text")), phrases.select("pattern"))
    scored = hits.join(phrases, "pattern").groupBy("query_id", F.col("id").alias("chunk_id")).agg(F.count("*").cast("double").alias("score"))
    scored = scored.join(chunks.select("chunk_id", "category"), "chunk_id").join(F.broadcast(topics.select("query_id", F.col("category").alias("own"))), "query_id")
    scopes = scored.withColumn("scope", F.explode(F.when(F.coalesce(F.col("category") == F.col("own"), F.lit(False)), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    return best_rows(scopes, "query_id", "chunk_id", k, "scope").select("query_id", "chunk_id", "score", "rank", "scope")


def filled(topics: DataFrame, chunks: DataFrame, channels: dict[str, DataFrame], pool: int) -> dict[str, DataFrame]:
    """Each channel's rows (query_id, chunk_id, rank): those of the topic's category, filled up from all where they are few.

    Few are under `pool` different documents over all the channels of the category together; then every channel goes on with its rows among
    all chunks. A topic without a category has the rows among all.
    """
    staged = {name: stage(rows.select("query_id", "chunk_id", "rank", "scope"), "channel") for name, rows in channels.items()}  # k rows a topic and scope
    every = None
    for rows in staged.values():
        own = rows.where("scope").select("query_id", "chunk_id")
        every = own if every is None else every.union(own)
    documents = every.join(chunks.select("chunk_id", "document_id"), "chunk_id").groupBy("query_id").agg(F.count_distinct("document_id").alias("documents"))
    full = stage(documents.where(F.col("documents") >= pool).join(topics.where("category is not null").select("query_id"), "query_id", "left_semi").select("query_id"), "full")
    return {name: merge_backfill(rows.where("scope").drop("scope"), rows.where("not scope").drop("scope").join(full, "query_id", "left_anti")) for name, rows in staged.items()}


# Weights of relations and of entity kinds.
RELATION_WEIGHT = {"DISCUSSES": 3, "CITES": 2}
KIND_WEIGHT = {"Case": 3}


def _weight(c: str, table: dict[str, int]) -> F.Column:
    out = F.lit(1)
    for value, weight in table.items():
        out = F.when(F.col(c) == value, weight).otherwise(out)
    return out


def graph_documents(topics: DataFrame, entities: DataFrame, links: DataFrame, k: int = GRAPH_K) -> DataFrame:
    """query_id, document_id, score, rank: documents one step from an entity whose name contains a word of the topic.

    The score sums relation weight times entity weight over distinct (document, entity, relation). Links with null relation count 1.
    """
    words = topics.select("query_id", F.explode(F.array_distinct(terms("text"))).alias("pattern")).where("length(pattern) >= 2")
    named = containing(entities.select("id", F.col("name").alias("text")), words.select("pattern"))
    met = named.join(words, "pattern").select("query_id", F.col("id").alias("entity_id")).distinct().join(entities.select(F.col("id").alias("entity_id"), "entity_type"), "entity_id")
    steps = links.select("document_id", "entity_id", "relation_type").distinct()
    scored = met.join(steps, "entity_id").groupBy("query_id", "document_id").agg(F.sum(_weight("relation_type", RELATION_WEIGHT) * _weight("entity_type", KIND_WEIGHT)).cast("double").alias("score"))
    return best_rows(scored, "query_id", "document_id", k)


def graph_channel(documents: DataFrame, chunks: DataFrame, k: int = GRAPH_K) -> DataFrame:
    """query_id, chunk_id, score, rank: the chunks of the ranked documents, each with its document's rank, k per topic in rank order."""
    rows = documents.join(chunks.select("chunk_id", "document_id", "chunk_index"), "document_id")
    w = W.partitionBy("query_id").orderBy("rank", "document_id", "chunk_index", "chunk_id")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("query_id", "chunk_id", "score", "rank")


# --- fusion and selection --------------------------------------------------------------------------------------------


def fuse(channels: list[tuple[str, int, DataFrame]], k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, score, channel_count, active: reciprocal rank fusion of (name, weight, ranked rows).

    A weight of two counts a list twice in the score but as one channel. active is the number of channels with rows for the topic.
    """
    union = None
    for name, weight, ranked in channels:
        # few rows per topic, written once: they are read twice below
        part = stage(ranked.select("query_id", "chunk_id", "rank", F.lit(name).alias("channel"), F.lit(weight).alias("weight")), "channel")
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 12).alias("score"), F.count_distinct("channel").alias("channel_count"))
    return fused.join(union.groupBy("query_id").agg(F.count_distinct("channel").alias("active")), "query_id")


def pool_size(k: int = 5) -> int:
    """How many fused candidates go on to the filters, for k results."""
    return max(4 * k, 20)


def pool(fused: DataFrame, k: int = 5) -> DataFrame:
    """The best pool_size(k) fused rows of each topic, by score, ties by chunk_id."""
    return best_rows(fused, "query_id", "chunk_id", pool_size(k)).drop("rank")


def relevant(fused: DataFrame) -> DataFrame:
    """With three or more active channels: a score of a first-three rank or two channels; else a score of a first-six rank."""
    tiny = 1e-9
    strict = (F.col("score") >= 1 / 63 - tiny) | (F.col("channel_count") >= 2)
    return fused.where(F.when(F.col("active") >= 3, strict).otherwise(F.col("score") >= 1 / 66 - tiny))


def merge_backfill(primary: DataFrame, backfill: DataFrame) -> DataFrame:
    """Primary rows with their ranks, then the backfill's chunks that primary lacks, ranked on behind them, per topic."""
    size = primary.groupBy("query_id").agg(F.max("rank").alias("size"))
    new = backfill.join(primary.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(size, "query_id", "left")
    w = W.partitionBy("query_id").orderBy("rank", "chunk_id")
    return primary.select("query_id", "chunk_id", "rank").unionByName(new.select("query_id", "chunk_id", (F.coalesce("size", F.lit(0)) + F.row_number().over(w)).alias("rank")))


def diverse(candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, chunk_id, place: the best chunk of each document, taken in turn from the document types, then the rest by position.

    candidates: query_id, chunk_id, document_id, document_type, pos. Types take turns in the order of their first appearance.
    """
    q = W.partitionBy("query_id")
    first = F.row_number().over(W.partitionBy("query_id", "document_id").orderBy("pos")) == 1
    marked = candidates.withColumn("phase", F.when(first, 0).otherwise(1))
    by_type = W.partitionBy("query_id", "document_type", "phase")
    marked = marked.withColumn("turn", F.when(F.col("phase") == 0, F.row_number().over(by_type.orderBy("pos"))).otherwise(0)).withColumn("type_pos", F.when(F.col("phase") == 0, F.min("pos").over(by_type)).otherwise(0))
    return marked.withColumn("place", F.row_number().over(q.orderBy("phase", "turn", "type_pos", "pos"))).where(F.col("place") <= k).select("query_id", "chunk_id", "document_id", "document_type", "pos", "place")


def positions(fused: DataFrame) -> DataFrame:
    return fused.withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def sources(selected: DataFrame, scores: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, document_id, title, url, score: the selected chunks' documents with the best score among their relevant chunks."""
    best = scores.groupBy("query_id", "document_id").agg(F.max("score").alias("score"))
    chosen = selected.select("query_id", "document_id").distinct().join(best, ["query_id", "document_id"])
    return chosen.join(docs.select(F.col("doc_id").alias("document_id"), "title", "url"), "document_id")


def relevance_percent(score: F.Column) -> F.Column:
    return F.least(F.lit(100.0), score / (3 / (RRF_K + 1)) * 100)


def precision_at_k(selected: DataFrame, labels: DataFrame, category: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per topic, per category with null for all topics): mean of labels 1 and 0; -1 is skipped; the overall mean is of topics."""
    judged = selected.join(labels, ["query_id", "document_id"]).where("label >= 0")
    per = judged.groupBy("query_id").agg(F.round(F.avg("label"), 9).alias("precision")).join(category, "query_id")
    return per, per.groupingSets([["category"], []], "category").agg(F.round(F.avg("precision"), 6).alias("precision"), F.count("*").alias("topics"))
