"""Similar sets of trigrams: blocks of rows meet pairwise, each pair of blocks in one task that gives similar pairs only.

Candidates never leave the task that finds them, so what is shuffled and staged grows with the rows and not with the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.storage import ship, stage

BLOCK = 16_384  # rows of a block, if they have 64 trigrams each
MEETINGS = 1_000_000  # candidates looked at together
COMPARED = 2_000_000  # trigrams compared together
OWN, BITS = 384, 512  # bits of a set: the most frequent trigrams have one each, the others share the rest


def _codes(grams: pa.Array) -> np.ndarray:
    """Trigrams as numbers: three code points of 21 bits."""
    text = "".join(grams.to_pylist()).encode("utf-32-le")
    c = np.frombuffer(text, np.uint32).reshape(-1, 3).astype(np.int64)
    return (c[:, 0] << 42) | (c[:, 1] << 21) | c[:, 2]


def packed(sets: DataFrame, block: int) -> DataFrame:
    """no, lo, hi, known, rows: blocks of sets, neighbours in type; lo and hi are the least and greatest type, known tells whether all rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        load = np.cumsum(1 + pc.list_value_length(table.column("t")).to_numpy() / 64) // (2 * block)
        cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), table.num_rows]
        for k, (start, end) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = table.slice(start, end - start).combine_chunks().to_batches()[0]
            grams = part.column("t")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(grams).to_numpy())]), pa.int32()), pa.array(_codes(grams.flatten())))
            rows = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "document_type", "title", "known")), lists], names=["id", "document_type", "title", "known", "t"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema) as out:
                out.write_batch(rows)
            ends = pc.min_max(part.column("document_type"))
            yield pa.RecordBatch.from_arrays([pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([ends["min"].as_py()]), pa.array([ends["max"].as_py()]), pa.array([pc.all(part.column("known")).as_py()]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["no", "lo", "hi", "known", "rows"])

    ship(sets.sparkSession)
    full = sets.where(F.size("t") > 0).select("id", "document_type", "title", "known", "t")
    load = full.agg(F.sum(1 + F.size("t") / 64)).first()[0] or 0
    spread = full.repartitionByRange(int(load / (2 * block)) + 1, "known", "document_type", F.xxhash64("title"))
    return stage(spread.mapInArrow(run, "no long, lo string, hi string, known boolean, rows binary"), "blocks")


class _Side:
    """Rows of one block: codes of their trigrams by rising frequency, their places, and bits."""

    def __init__(self, rows: np.ndarray, codes: np.ndarray, n: np.ndarray, vocabulary: int):
        self.n, self.v = n, vocabulary
        self.keys = np.sort(rows * vocabulary + codes)  # by row, then rarest first
        self.row, self.code = self.keys // vocabulary, self.keys % vocabulary
        self.start = np.concatenate([[0], np.cumsum(n)])
        self.place = np.arange(len(self.keys)) - self.start[self.row] + 1
        often = vocabulary - 1 - self.code
        bits = np.zeros((len(n), BITS), np.uint8)
        bits[self.row, np.where(often < OWN, often, OWN + often % (BITS - OWN))] = 1
        self.words = np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)

    def shared(self, other: _Side, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Trigrams that row x[i] has in common with the other side's row y[i]."""
        n = self.n[x]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.start[x] - (ends - n), n)
        wanted = np.repeat(y * self.v, n) + self.code[at]
        found = np.minimum(np.searchsorted(other.keys, wanted), len(other.keys) - 1)
        return np.add.reduceat((other.keys[found] == wanted).astype(np.int64), ends - n)


def _found(short: _Side, long: _Side, threshold: float, ties: bool, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the two sides over the threshold, with the similarity, where the first is the shorter one (or as long, with ties).

    What two sets share begins with their rarest common trigram. The shorter one has it among its first n (1 - 2 t / (1 + t)) + 1, the longer
    one among its first n (1 - t) + 1; only those meet, with lengths that fit, and from there on enough must be left in both.
    """
    t = max(threshold, 1e-9)
    share, slack = t / (1 + t), 1e-9
    a = np.flatnonzero(short.place <= short.n[short.row] * (1 - 2 * share) + 1 + slack)
    b = np.flatnonzero(long.place <= long.n[long.row] * (1 - t) + 1 + slack)
    if not len(a) or not len(b):
        return
    width = int(max(short.n.max(), long.n.max())) + 2
    key = long.code[b] * width + long.n[long.row[b]]
    b, key = b[order := np.argsort(key, kind="stable")], key[order]
    b_row, b_place = long.row[b], long.place[b]
    a_row, a_place, a_n, a_code = short.row[a], short.place[a], short.n[short.row[a]], short.code[a]
    lo = np.searchsorted(key, a_code * width + a_n + (not ties))
    hi = np.searchsorted(key, a_code * width + np.minimum(np.floor(a_n / t + slack), width - 1).astype(np.int64), "right")
    met = np.maximum(hi - lo, 0)
    total = np.cumsum(met)
    last = np.flatnonzero(np.diff(a_row, append=-1)) + 1  # a row's candidates are looked at together
    begin = 0
    while begin < len(a):
        done = total[begin - 1] if begin else 0
        end = last[max(np.searchsorted(total[last - 1], done + MEETINGS, "right") - 1, np.searchsorted(last, begin, "right"))]
        m = met[begin:end]
        e = np.repeat(np.arange(begin, end), m)
        at = np.arange(len(e)) + np.repeat(lo[begin:end] - (np.cumsum(m) - m), m)
        begin = end
        x, y = a_row[e], b_row[at]
        nx, ny = a_n[e], long.n[y]
        spare = np.minimum(nx - a_place[e], ny - b_place[at]) + 1 - (share * (nx + ny) - slack)
        good = spare >= 0
        if same:
            good &= (nx < ny) | (x < y)
        x, y, room = x[good], y[good], (nx - (share * (nx + ny) - slack))[good]
        for w in range(BITS // 64):  # trigrams of the shorter one that the longer one can't have
            room = room - np.bitwise_count(short.words[w][x] & ~long.words[w][y])
            if w % 2:
                good = room >= 0
                x, y, room = x[good], y[good], room[good]
        pairs = np.unique(x * len(long.n) + y)
        step = max(1, COMPARED // int(short.n.max()))
        for i in range(0, len(pairs), step):
            x, y = np.divmod(pairs[i : i + step], len(long.n))
            both = short.shared(long, x, y)
            alike = both / (short.n[x] + long.n[y] - both)
            good = alike > threshold
            if good.any():
                yield x[good], y[good], alike[good]


def _pairs(a: pa.RecordBatch, b: pa.RecordBatch, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in a and in b of similar rows of one type, not both known, with the similarity."""
    types = pc.unique(pa.concat_arrays([a.column("document_type"), b.column("document_type")]))
    kind = [pc.index_in(x.column("document_type"), types).to_numpy().astype(np.int64) for x in (a, b)]
    n = [pc.list_value_length(x.column("t")).to_numpy().astype(np.int64) for x in (a, b)]
    known = [x.column("known").to_numpy(zero_copy_only=False) for x in (a, b)]
    grams = [x.column("t").flatten().to_numpy() for x in (a, b)]
    words, code = np.unique(np.concatenate(grams), return_inverse=True)
    own = np.concatenate([np.repeat(k, m) for k, m in zip(kind, n, strict=True)])
    tokens, code, often = np.unique(own * len(words) + code, return_inverse=True, return_counts=True)  # a trigram of a type
    rank = np.empty(len(tokens), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(tokens))
    code = rank[code]
    left, right = (_Side(np.repeat(np.arange(len(m)), m), c, m, len(tokens)) for c, m in zip((code[: len(grams[0])], code[len(grams[0]) :]), n, strict=True))
    for x, y, s in _found(left, right, threshold, True, same):
        new = ~(known[0][x] & known[1][y])
        yield x[new], y[new], s[new]
    if not same:
        for y, x, s in _found(right, left, threshold, False, False):
            new = ~(known[0][x] & known[1][y])
            yield x[new], y[new], s[new]


def _each_pair(a: pa.RecordBatch, b: pa.RecordBatch, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    titles = pa.concat_arrays([a.column("title"), b.column("title")])
    order = np.empty(len(titles), np.int64)
    order[pc.sort_indices(titles).to_numpy()] = np.arange(len(titles))
    for x, y, s in _pairs(a, b, same, threshold):
        y = y + a.num_rows
        first, second = np.where(order[x] < order[y], x, y), np.where(order[x] < order[y], y, x)
        yield pa.RecordBatch.from_arrays([a.column("document_type").take(pa.array(np.minimum(x, y))), titles.take(pa.array(first)), titles.take(pa.array(second)), pa.array(s)], names=["document_type", "title_a", "title_b", "similarity"])


def _each_best(a: pa.RecordBatch, b: pa.RecordBatch, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    """For each row its best match in the other block."""
    titles = pa.concat_arrays([a.column("title"), b.column("title")])
    ids = np.concatenate([a.column("id").to_numpy(), b.column("id").to_numpy()])
    by_title = pc.sort_indices(titles).to_numpy().astype(np.int64)
    order = np.empty(len(titles), np.int64)
    order[by_title] = np.arange(len(titles))
    size, best = np.zeros(len(titles)), np.full(len(titles), len(titles), np.int64)
    for x, y, s in _pairs(a, b, same, threshold):
        y = y if same else y + a.num_rows
        one, two, s = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([s, s])
        top = size.copy()
        np.maximum.at(top, one, s)
        best[top > size] = len(titles)
        size, hit = top, s == top[one]
        np.minimum.at(best, one[hit], order[two[hit]])
    rows = np.flatnonzero(size > 0)
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), titles.take(pa.array(by_title[best[rows]])), pa.array(size[rows])], names=["id", "best", "similarity"])


def _each_link(a: pa.RecordBatch, b: pa.RecordBatch, same: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    ids = [x.column("id").to_numpy() for x in (a, b)]
    for x, y, _ in _pairs(a, b, same, threshold):
        yield pa.RecordBatch.from_arrays([pa.array(ids[0][x]), pa.array(ids[1][y])], names=["a", "b"])


def _met(sets: DataFrame, threshold: float, block: int, each, schema: str) -> DataFrame:
    blocks = packed(sets, block)
    a, b = blocks.alias("a"), blocks.alias("b")
    on = (F.col("a.no") <= F.col("b.no")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi")) & ~(F.col("a.known") & F.col("b.known"))
    both = a.join(b, on).select((F.col("a.no") == F.col("b.no")).alias("same"), F.col("a.rows").alias("a"), F.col("b.rows").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda c, i: pa.ipc.open_stream(c[i].as_buffer()).read_next_batch()
        for batch in batches:
            for i in range(batch.num_rows):
                yield from each(read(batch.column("a"), i), read(batch.column("b"), i), batch.column("same")[i].as_py(), threshold)

    return both.mapInArrow(run, schema)


def similar_pairs(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """document_type, title_a, title_b, similarity of every two rows of a type whose sets have a Jaccard similarity over the threshold.

    sets: id, document_type, title, known, t (different trigrams). Rows without trigrams, and two known rows, match nothing.
    """
    return _met(sets, threshold, block, _each_pair, "document_type string, title_a string, title_b string, similarity double")


def best_in_blocks(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """id, best, similarity: for each row its most similar one in each block that has one over the threshold, of equals the least title."""
    return _met(sets, threshold, block, _each_best, "id long, best string, similarity double")


def similar_ids(sets: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a, b: the ids of every two similar rows, once."""
    return _met(sets, threshold, block, _each_link, "a long, b long")
