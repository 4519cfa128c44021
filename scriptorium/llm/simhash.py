"""Problem 1: same or near-same records across splits, by similarity-hash bit fingerprints joined on code blocks.

A record's fingerprint is a row of b-bit minwise hashes: of each of SYMBOLS hash functions the least value over the record's word
runs is taken and BITS of it kept. Two records agree in a symbol as often as their similarity says. The code is segmented into
blocks of whole symbols; records of different splits that agree in one block, and whose one-bit codes lie within a
Hamming radius, are candidates; their texts decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import U64, list_array, map_slices, mix, runs, two_longs, word_hashes
from scriptorium.storage import stage

SYMBOLS, BITS, BLOCK_SYMBOLS, RADIUS = 128, 12, 4, 46
CODE_BITS = 128
SHINGLE, MIN_WORDS, SIMILARITY = 3, 20, 0.6
_GOLD = U64(0x9E3779B97F4A7C15)


def minwise(elements: np.ndarray, symbols: int) -> np.ndarray:
    """The least 32-bit hash over the elements under each of `symbols` hash functions; two functions share one mix."""
    lane = mix(np.arange(1, symbols // 2 + 1, dtype=U64) * _GOLD)[None, :]
    least = np.full(symbols, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(elements), 256):  # a slice stays in the processor's cache, whatever the record's length
        least = np.minimum(least, mix(elements[i : i + 256, None] ^ lane).view(np.uint32).min(0))
    return least


def fingerprints(texts: DataFrame, symbols: int = SYMBOLS, bits: int = BITS, block_symbols: int = BLOCK_SYMBOLS, shingle: int = SHINGLE, min_words: int = MIN_WORDS) -> DataFrame:
    """id, k1, k2 (hash of the word sequence), code1, code2 (one bit of each symbol), blocks (block keys), shingles (32-bit hashes).

    A block key holds block_symbols * bits bits (48) of the code and the block's number, so unrelated records meet in a block about
    never, at any size of the table.
    """
    blocks = symbols // block_symbols

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, keys, sets = [], [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = word_hashes(text)
            if len(h) >= max(min_words, shingle):
                ids.append(i)
                keys.append(two_longs(h.tobytes()))
                sets.append(np.unique(runs(h, shingle)))
        if not ids:
            return None
        least = mix(np.array([minwise(s, symbols) for s in sets]).astype(U64))
        code = np.packbits((least[:, :CODE_BITS] & U64(1)).astype(np.uint8), axis=1).view(">i8").astype(np.int64)
        kept = ((least >> U64(8)) & U64((1 << bits) - 1)).astype(np.int64).reshape(len(ids), blocks, block_symbols)
        values = kept @ (1 << (bits * np.arange(block_symbols, dtype=np.int64)))
        values += np.arange(blocks, dtype=np.int64) << (bits * block_symbols)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int64()),
                pa.array(code[:, 0].copy(), pa.int64()),
                pa.array(code[:, 1].copy(), pa.int64()),
                list_array(values.ravel(), np.full(len(ids), blocks), pa.int64()),
                list_array((np.concatenate(sets) >> U64(32)).astype(np.uint32).view(np.int32), np.array([len(s) for s in sets]), pa.int32()),
            ],
            names=["id", "k1", "k2", "code1", "code2", "blocks", "shingles"],
        )

    return map_slices(texts.select("id", "text").where("text is not null"), run, "id long, k1 long, k2 long, code1 long, code2 long, blocks array<long>, shingles array<int>")


def linked_classes(samples: DataFrame, train: str = "train", radius: int = RADIUS, similarity: float = SIMILARITY, **params) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: id, rep, trained - every sample of enough words, the least id of equal word sequence, and whether it is of the train split.
    links: rep_t, rep_e, similarity - classes with a sample of the train split and classes with one of another, whose Jaccard
    similarity over distinct word runs is at least `similarity`; a class with both is linked to itself. Equal outputs collapse
    before the block join. Candidates carry their codes only; word runs join the few that lie within the radius.
    """
    texts = samples.select(F.col("sample_id").alias("id"), F.col("output").alias("text"))
    prints = stage(fingerprints(texts, **params), "fingerprints")
    side = samples.select(F.col("sample_id").alias("id"), F.coalesce(F.col("split") == train, F.lit(False)).alias("trained"))
    keyed = prints.select("id", "k1", "k2").join(side, "id").distinct()
    classes = keyed.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.max("trained").alias("has_train"), F.min("trained").alias("only_train"))
    members = stage(keyed.join(classes, ["k1", "k2"]).select("id", "rep", "trained", "has_train", "only_train"), "members")
    heads = members.where("id = rep").select("id", "has_train", "only_train").distinct()

    blocked = prints.select("id", "code1", "code2", "blocks").join(heads, "id").dropDuplicates(["id"]).select(F.col("id").alias("rep"), "has_train", "only_train", "code1", "code2", F.explode("blocks").alias("block"))
    t, e = blocked.where("has_train").alias("t"), blocked.where("not only_train").alias("e")
    distance = F.bit_count(F.col("t.code1").bitwiseXOR(F.col("e.code1"))) + F.bit_count(F.col("t.code2").bitwiseXOR(F.col("e.code2")))
    met = t.join(e, (F.col("t.block") == F.col("e.block")) & (F.col("t.rep") != F.col("e.rep")) & (distance <= radius))
    candidates = stage(met.select(F.col("t.rep").alias("rep_t"), F.col("e.rep").alias("rep_e")).distinct(), "met")

    involved = candidates.select(F.explode(F.array("rep_t", "rep_e")).alias("id")).distinct()
    sets = prints.select("id", "shingles").join(involved, "id", "left_semi").dropDuplicates(["id"])
    one, two = sets.select(F.col("id").alias("rep_t"), F.col("shingles").alias("s")), sets.select(F.col("id").alias("rep_e"), F.col("shingles").alias("u"))
    both = candidates.join(one, "rep_t").join(two, "rep_e").select("rep_t", "rep_e", F.size(F.array_intersect("s", "u")).alias("both"), F.size("s").alias("n"), F.size("u").alias("m"))
    near = both.select("rep_t", "rep_e", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("similarity")).where(F.col("similarity") >= similarity - 1e-9)
    same = members.where("id = rep and has_train and not only_train").select(F.col("rep").alias("rep_t"), F.col("rep").alias("rep_e"), F.lit(1.0).alias("similarity")).distinct()
    return members.select("id", "rep", "trained"), near.unionByName(same)


def cross_split(samples: DataFrame, **params) -> DataFrame:
    """sample_id_a, sample_id_b, similarity: pairs of similar outputs, exactly one of them in the train split, smaller id first.

    See linked_classes. Null outputs have no pair; a null split counts as another split than train. The pairs are members of
    linked classes, so a text delivered many times in both splits gives all its pairs here; overlap_counts needs none.
    """
    members, links = linked_classes(samples, **params)
    trained = members.where("trained").select(F.col("rep").alias("rep_t"), F.col("id").alias("x"))
    other = members.where("not trained").select(F.col("rep").alias("rep_e"), F.col("id").alias("y"))
    return links.join(trained, "rep_t").join(other, "rep_e").select(F.least("x", "y").alias("sample_id_a"), F.greatest("x", "y").alias("sample_id_b"), "similarity")


def overlap_counts(samples: DataFrame, train: str = "train", **params) -> DataFrame:
    """split, source, samples, overlapping, pairs: of each split other than train and each source (null sources are one group).

    Pairs are counted, never made: a class has as many partners as its linked classes have samples of the train split.
    """
    members, links = linked_classes(samples, train, **params)
    sizes = members.where("trained").groupBy(F.col("rep").alias("rep_t")).agg(F.count("*").alias("trained"))
    partners = links.select("rep_t", "rep_e").join(sizes, "rep_t").groupBy(F.col("rep_e").alias("rep")).agg(F.sum("trained").alias("pairs"))
    ends = members.where("not trained").join(partners, "rep").select(F.col("id").alias("sample_id"), "pairs")
    held = samples.where(~F.coalesce(F.col("split") == train, F.lit(False))).select("sample_id", "split", "source")
    return held.join(ends, "sample_id", "left").groupBy("split", "source").agg(F.count("*").alias("samples"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
