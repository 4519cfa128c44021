"""Problem 8: encoding of a corpus by a public byte-level vocabulary through a transducer lexicon.

Frequent words are compiled into a minimal acyclic automaton whose arcs carry numbers; their sum along a word's path
is the word's place in a table of id lists. It is written as flat arrays, sent to every executor as a file and
memory-mapped there. Words that it doesn't hold are merged exactly by the vocabulary's ranks.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import list_array, map_slices, mapped, share_arrays
from scriptorium.storage import local_folder, stage

VOCABULARY, WORDS, LEAST = "/opt/tokenizers/byte_bpe_50k.tiktoken", 32_768, 16
# Fixed value: the vocabulary's own pattern of words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_GAP = re.compile(r" (?=\S)")
_ODD_GAP = re.compile(r" (?!\S)")


def pieces(text: str) -> list[str]:
    """The text cut before every blank that a non-space follows; no word of the pattern crosses such a cut."""
    if not _ODD_GAP.search(text):
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]
    first, *rest = _GAP.split(text)
    return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank, the leftmost of equals, is joined until no pair is in the vocabulary.

    Pairs wait in a heap, and parts know their neighbours, so a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    rank = ranks.get
    size = len(word)
    ends = list(range(1, size + 1))  # of the part that begins there; 0 where none begins any more
    before = list(range(-1, size - 1))
    heap = [r << 32 | i for i in range(size - 1) if (r := rank(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        middle = ends[i]
        if not middle or middle == size:
            continue
        end = ends[middle]
        if rank(word[i:end]) != top >> 32:  # an entry of a pair that has changed since
            continue
        ends[i], ends[middle] = end, 0
        if end < size:
            before[end] = i
            if (r := rank(word[i : ends[end]])) is not None:
                heappush(heap, r << 32 | i)
        if i and (r := rank(word[before[i] : end])) is not None:
            heappush(heap, r << 32 | before[i])
    out, i = [], 0
    while i < size:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


# --- the automaton ---------------------------------------------------------------------------------------------------


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic automaton of the words and of their id lists.

    arcs: state * 256 + byte, ascending; target and number of each arc; final marks. Words must not be empty. Built in one
    pass over the sorted words: what the next word can't change any more is replaced by an equal state seen before.
    """
    states: list[list] = [[False, {}]]
    known: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # parent, byte, child: states that may still change

    def settle(depth: int) -> None:
        while len(path) > depth:
            parent, byte, child = path.pop()
            final, arcs = states[child]
            shape = (final, tuple(arcs.items()))
            states[parent][1][byte] = known.setdefault(shape, child)

    before = b""
    for word in sorted(words):
        depth = 0
        while depth < min(len(word), len(before)) and word[depth] == before[depth]:
            depth += 1
        settle(depth)
        at = path[-1][2] if path else 0
        for byte in word[depth:]:
            states.append([False, {}])
            states[at][1][byte] = len(states) - 1
            path.append((at, byte, len(states) - 1))
            at = len(states) - 1
        states[at][0] = True
        before = word
    settle(0)

    number: dict[int, int] = {}
    order: list[int] = []
    todo = [0]
    while todo:
        s = todo.pop()
        if s not in number:
            number[s] = len(order)
            order.append(s)
            todo += states[s][1].values()
    size: dict[int, int] = {}
    stack = [(0, False)]
    while stack:  # how many words each state can still spell
        s, ready = stack.pop()
        if s in size:
            continue
        if ready:
            size[s] = states[s][0] + sum(size[t] for t in states[s][1].values())
        else:
            stack.append((s, True))
            stack += [(t, False) for t in states[s][1].values()]
    arcs = []
    for s in order:
        skipped = int(states[s][0])
        for byte, t in sorted(states[s][1].items()):
            arcs.append((number[s] * 256 + byte, number[t], skipped))
            skipped += size[t]
    arcs.sort()
    lists = [words[w] for w in sorted(words)]
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    return {
        "arc": np.array([a[0] for a in arcs], np.int64),
        "target": np.array([a[1] for a in arcs], np.int64),
        "number": np.array([a[2] for a in arcs], np.int64),
        "final": np.array([states[s][0] for s in order], np.bool_),
        "offsets": offsets,
        "ids": np.array([i for x in lists for i in x], np.int64),
    }


def look_up(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The place of each word's id list, -1 for words that the automaton doesn't hold; all words walk at once."""
    found = np.full(len(words), -1)
    if not len(lexicon["arc"]) or not words:
        return found
    lengths = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lengths) - lengths
    live = np.flatnonzero(lengths > 0)
    state, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    step = 0
    while len(live):
        want = state[live] * 256 + data[starts[live] + step]
        at = np.minimum(np.searchsorted(lexicon["arc"], want), len(lexicon["arc"]) - 1)
        ok = lexicon["arc"][at] == want
        live, at = live[ok], at[ok]
        state[live] = lexicon["target"][at]
        total[live] += lexicon["number"][at]
        step += 1
        done = lengths[live] == step
        ended = live[done]
        found[ended] = np.where(lexicon["final"][state[ended]], total[ended], -1)
        live = live[~done]
    return found


# --- the corpus ------------------------------------------------------------------------------------------------------


def frequent_words(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> DataFrame:
    """word, n: the most frequent words of all texts, at most `words` and each seen `least` times or more. Every text is counted.

    Frequencies fall into classes of a sixteenth of a doubling; whole classes are taken from the top while they fit, so
    no task sorts the vocabulary and only the sizes of the classes, a thousand at most, go to the driver.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(pieces(text))
        split = regex.compile(PATTERN).findall
        counts: Counter[str] = Counter()
        for piece, n in seen.items():
            for word in split(piece):
                counts[word] += n
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts = map_slices(docs.select("text").where("text is not null"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    counts = stage(counts.withColumn("class", F.floor(F.log2("n") * 16).cast("int")), "words")
    room, lowest = words, None
    for row in counts.groupBy("class").agg(F.count("*").alias("size")).orderBy(F.desc("class")).collect():
        room -= row["size"]
        if room < 0:
            break
        lowest = row["class"]
    return counts.where(F.col("class") >= (lowest if lowest is not None else 2**30)).select("word", "n")


class _Encoder:
    """What a Python worker keeps: the mapped lexicon, the ranks, and the pieces met so far (at most a million)."""

    def __init__(self, token: str, ranks: dict[bytes, int]):
        self.lexicon = {name: mapped(token, name) for name in ("arc", "target", "number", "final", "offsets", "ids")}
        self.ranks = ranks
        self.split = regex.compile(PATTERN).findall
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.word_ids: dict[str, np.ndarray] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)
        self.used = 0

    def learn(self, new: list[str]) -> None:
        if len(self.place) + len(new) > 1_000_000:
            self.clear()
        cut = [self.split(p) for p in new]
        unknown = [w for w in dict.fromkeys(w for ws in cut for w in ws) if w not in self.word_ids]
        raw = [w.encode("utf-8", "surrogatepass") for w in unknown]
        offsets, ids = self.lexicon["offsets"], self.lexicon["ids"]
        for w, b, at in zip(unknown, raw, look_up(self.lexicon, raw).tolist()):
            self.word_ids[w] = ids[offsets[at] : offsets[at + 1]].tolist() if at >= 0 else merge(b, self.ranks)
        for p, ws in zip(new, cut):
            out = [i for w in ws for i in self.word_ids[w]]
            k = len(self.place)
            self.place[p] = k
            if k + 1 >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
            while self.used + len(out) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty(len(self.flat), np.int32)])
            self.flat[self.used : self.used + len(out)] = out
            self.used += len(out)
            self.ends[k + 1] = self.used

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        cut = [pieces(t) if t else [] for t in texts]
        flat = [p for ps in cut for p in ps]
        new = [p for p in set(flat) if p not in self.place]
        if len(self.place) + len(new) > 1_000_000:
            self.clear()
            new = list(set(flat))
        self.learn(new)
        at = np.fromiter(map(self.place.__getitem__, flat), np.int64, len(flat))
        size = self.ends[at + 1] - self.ends[at]
        done = np.cumsum(size)
        ids = self.flat[np.repeat(self.ends[at] - (done - size), size) + np.arange(done[-1] if len(done) else 0)]
        last = np.cumsum([len(ps) for ps in cut])
        ends = np.r_[0, done][last]
        return list_array(ids, np.diff(np.r_[0, ends]), pa.int32())


_encoders: dict[str, _Encoder] = {}
_ranks: dict[str, dict[bytes, int]] = {}


def _shared_ranks(name: str) -> dict[bytes, int]:
    """The vocabulary of a file that Spark sent, read once in each Python worker."""
    if name not in _ranks:
        _ranks.clear()
        _ranks[name] = read_ranks(SparkFiles.get(name))
    return _ranks[name]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, words: int = WORDS) -> DataFrame:
    """doc_id, ids: the ids of every text by the vocabulary, without special tokens; an empty list for empty and null text.

    The lexicon holds the `words` most frequent words of the corpus, so its size is bounded by that parameter.
    """
    spark = docs.sparkSession
    shared = local_folder("vocabulary") / f"{uuid.uuid4().hex}-{Path(vocabulary).name}"
    shared.write_bytes(Path(vocabulary).read_bytes())
    spark.sparkContext.addFile(str(shared))

    def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
        ranks = _shared_ranks(shared.name)
        words = batch.column(0).to_pylist()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([merge(w.encode(), ranks) for w in words], pa.list_(pa.int32()))], names=["word", "ids"])

    chosen = map_slices(frequent_words(docs, words).select("word").repartition(spark.sparkContext.defaultParallelism), merged, "word string, ids array<int>")
    token = share_arrays(spark, compile_lexicon({r[0].encode(): list(r[1]) for r in chosen.collect()}))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if token not in _encoders:
            _encoders.clear()
            _encoders[token] = _Encoder(token, _shared_ranks(shared.name))
        return pa.RecordBatch.from_arrays([batch.column(0), _encoders[token].encode(batch.column(1).to_pylist())], names=["doc_id", "ids"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>")
