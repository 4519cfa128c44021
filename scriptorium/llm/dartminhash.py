"""Problem 4: near-duplicate records, by DartMinHash signatures and a banded join.

Darts: every weighted element owns the region [0, weight) x [0, infinity) of a plane; hashed darts of unit density
fall into it, each with a rank (second axis) and a signature coordinate. Per coordinate the dart of least rank over all
elements is kept. Two sets keep the same dart with a probability equal to their weighted Jaccard similarity.
Only darts below a rank bound are thrown, chosen so that all coordinates fill with some k*(ln k + c) darts whatever the
number of elements; the few sets with an unfilled coordinate throw again below twice the bound.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import U64, canon, list_array, map_slices, mix, runs, two_longs, word_hashes
from scriptorium.storage import stage

ROWS, BANDS, SHINGLE, MIN_WORDS, SIMILARITY = 5, 60, 3, 30, 0.6
CODE_BITS = 128  # one bit of each of the first darts; unequal bits tell apart pairs that only share a band by chance
_POISSON = (np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)]) * 2.0**64).astype(np.uint64)  # of mean 1
_GOLD = U64(0x9E3779B97F4A7C15)


def _throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, bound: np.ndarray, k: int):
    """Slots (owner * k + coordinate) and ranks of the darts below the owner's rank bound."""
    with np.errstate(over="ignore"):
        columns = np.ceil(weights).astype(np.int64)  # cells of unit area
        layers = np.ceil(bound).astype(np.int64)[owner]
        per = columns * layers
        element = np.repeat(np.arange(len(elements)), per)
        cell = np.arange(len(element)) - np.repeat(np.cumsum(per) - per, per)
        layer = cell // columns[element]
        column = cell - layer * columns[element]
        seed = mix(elements[element] + _GOLD * (column * (1 << 32) + layer + 1).astype(U64))
        count = np.searchsorted(_POISSON, seed)
        dart = np.repeat(np.arange(len(seed)), count)
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        a = mix(seed[dart] + _GOLD * (nth + 7).astype(U64))
        b = mix(a + _GOLD)
    of = element[dart]
    own = owner[of]
    rank = layer[dart] + (b >> U64(11)) * 2.0**-53
    keep = (column[dart] + (a >> U64(40)) * 2.0**-24 < weights[of]) & (rank < bound[own])
    return (own * k + ((a & U64(0xFFFFFF)) % U64(k)).astype(np.int64))[keep], rank[keep]


def signatures(elements: np.ndarray, weights: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """One row of k dart ids per set; elements and weights of the sets stand one after another. Empty sets give zeros.

    The id of a dart is its rank, drawn from 53 hashed bits.
    """
    out = np.zeros((len(sizes), k), U64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(owner, weights, len(sizes))
    todo = total > 0
    factor = math.log(k) + 3
    while todo.any():
        use = todo[owner]
        bound = np.zeros(len(sizes))
        bound[todo] = k * factor / total[todo]
        slot, rank = _throw(elements[use], weights[use], owner[use], bound, k)
        best = np.full(len(sizes) * k, np.inf)
        np.minimum.at(best, slot, rank)
        best = best.reshape(len(sizes), k)
        full = todo & np.isfinite(best).all(1)
        out[full] = best[full].view(U64)
        todo &= ~full
        factor *= 2
    return out


def fingerprint(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, k1, k2 (hash of the word sequence), code1, code2 (one-bit code), shingles (32-bit hashes, distinct), bands (64-bit band keys).

    The words are those of the consistent form. Documents under min_words words, null and empty ones have no row.
    """
    k = rows * bands

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, keys, sets = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text is None:
                continue
            hashes = word_hashes(canon(text))
            if len(hashes) >= max(min_words, shingle):
                ids.append(doc)
                keys.append(two_longs(hashes.tobytes()))
                sets.append(np.unique(runs(hashes, shingle)))
        if not ids:
            return None
        sizes = np.array([len(s) for s in sets])
        elements = np.concatenate(sets)
        parts = []
        step = 8  # sets at a time, to stay in the processor's cache
        ends = np.cumsum(sizes)
        for i in range(0, len(sizes), step):
            lo, hi = (0 if i == 0 else ends[i - 1]), ends[min(i + step, len(sizes)) - 1]
            parts.append(signatures(elements[lo:hi], np.ones(hi - lo), sizes[i : i + step], k))
        sig = np.concatenate(parts)
        code = np.packbits((mix(sig[:, :CODE_BITS]) & U64(1)).astype(np.uint8), axis=1).view(">i8").astype(np.int64)
        sig = sig.reshape(len(sizes), bands, rows)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * _GOLD, (len(sizes), bands)).copy()
            for r in range(rows):
                key = mix(key ^ sig[:, :, r])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([x[0] for x in keys], pa.int64()),
                pa.array([x[1] for x in keys], pa.int64()),
                pa.array(code[:, 0].copy(), pa.int64()),
                pa.array(code[:, 1].copy(), pa.int64()),
                list_array((elements >> U64(32)).astype(np.uint32).view(np.int32), sizes, pa.int32()),
                list_array(key.view(np.int64).ravel(), np.full(len(sizes), bands), pa.int64()),
            ],
            names=["doc_id", "k1", "k2", "code1", "code2", "shingles", "bands"],
        )

    return map_slices(docs.select("doc_id", "text").where("text is not null"), run, "doc_id long, k1 long, k2 long, code1 long, code2 long, shingles array<int>, bands array<long>")


def most_apart(similarity: float) -> int:
    """Unequal code bits that a pair of that similarity passes only once in some hundred thousand cases (4.3 deviations)."""
    p = (1 - similarity) / 2
    return math.ceil(CODE_BITS * p + 4.3 * math.sqrt(CODE_BITS * p * (1 - p)))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, **params) -> tuple[DataFrame, DataFrame]:
    """(classes, links).

    classes: doc_id, rep - every document of enough words with the least doc_id of equal word sequence.
    links: rep_a, rep_b, similarity - representatives whose Jaccard similarity over distinct word runs is at least
    `similarity`, rep_a < rep_b. Candidates share a band of their dart signatures and lie near in the one-bit code, whose
    rows are small; each is verified on the whole shingle sets. Copies collapse before the band join, so a text delivered a million times is one row there;
    oversized band buckets are split by the adaptive skew join, and no bucket is capped.
    """
    prints = stage(fingerprint(docs, **params), "darts")
    reps = prints.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"))
    classes = stage(prints.select("doc_id", "k1", "k2").join(reps, ["k1", "k2"]).select("doc_id", "rep"), "classes")
    heads = classes.where("doc_id = rep").select("doc_id")
    banded = prints.select("doc_id", F.explode("bands").alias("band")).join(heads, "doc_id", "left_semi")
    a, b = banded.alias("a"), banded.alias("b")
    candidates = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("rep_a"), F.col("b.doc_id").alias("rep_b")).distinct()
    codes = prints.select("doc_id", "code1", "code2")
    for side in ("rep_a", "rep_b"):
        candidates = candidates.join(codes.select(F.col("doc_id").alias(side), F.col("code1").alias(f"{side}_1"), F.col("code2").alias(f"{side}_2")), side)
    apart = sum(F.bit_count(F.col(f"rep_a_{i}").bitwiseXOR(F.col(f"rep_b_{i}"))) for i in (1, 2))
    candidates = stage(candidates.where(apart <= most_apart(similarity)).select("rep_a", "rep_b"), "candidates")
    involved = candidates.select(F.col("rep_a").alias("doc_id")).union(candidates.select("rep_b")).distinct()
    sets = prints.select("doc_id", "shingles").join(involved, "doc_id", "left_semi")
    one = sets.select(F.col("doc_id").alias("rep_a"), F.col("shingles").alias("s"))
    two = sets.select(F.col("doc_id").alias("rep_b"), F.col("shingles").alias("t"))
    both = candidates.join(one, "rep_a").join(two, "rep_b").select("rep_a", "rep_b", F.size(F.array_intersect("s", "t")).alias("both"), F.size("s").alias("n"), F.size("t").alias("m"))
    links = both.select("rep_a", "rep_b", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)
    return classes, links


def document_pairs(classes: DataFrame, links: DataFrame) -> DataFrame:
    """doc_id_a, doc_id_b, smaller id first: all linked pairs of documents, equal word sequences included."""
    same = classes.alias("a").join(classes.alias("b"), (F.col("a.rep") == F.col("b.rep")) & (F.col("a.doc_id") < F.col("b.doc_id"))).select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))
    x, y = classes.select(F.col("rep").alias("rep_a"), F.col("doc_id").alias("x")), classes.select(F.col("rep").alias("rep_b"), F.col("doc_id").alias("y"))
    cross = links.join(x, "rep_a").join(y, "rep_b").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
    return same.unionByName(cross)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the least node of it). nodes: node; edges: a, b.

    Labels spread over edges and over pointers of labels (pointer jumping), so rounds grow with the logarithm of
    the longest path; each round is written to the shared folder.
    """
    both = stage(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = stage(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.least("component", F.coalesce("near", "component")).alias("next"), F.col("component").alias("old"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = stage(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("component"), "old"), "labels")
        moved = after.where("component <> old").limit(1).count()
        labels = after.select("node", "component")
        if not moved:
            return labels


def duplicate_groups(docs: DataFrame, **params) -> DataFrame:
    """doc_id, group_id, links: the least doc_id of the connected group and the number of links of the document's class to other classes."""
    classes, links = near_duplicates(docs, **params)
    links = stage(links, "links")
    found = components(classes.where("doc_id = rep").select(F.col("rep").alias("node")), links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    degree = links.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return classes.join(found.select(F.col("node").alias("rep"), F.col("component").alias("group_id")), "rep").join(degree, "rep", "left").select("doc_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
