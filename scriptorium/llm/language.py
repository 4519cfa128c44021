"""Problem 5: the languages of documents and of their lines, by cross-parsing entropy.

A suffix automaton of labelled text per language yields longest matches: a line is parsed into phrases, each the longest
passage from its start that the language's text contains. The language that needs fewest phrases wins.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import encoding
from scriptorium.llm.kernels import canon, map_slices
from scriptorium.llm.samples import SAMPLE_DOCS, label, label_codes, labelled_lines

TRAIN_CHARS, LEAST_CHARS, WINDOW, BITS = 30_000, 100, 256, 6
# Fixed value: accented letters of Latin alphabets that have a symbol of their own.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
# First and last code point of scripts, and the symbol that leads their letters; 63 leads letters of all others.
SCRIPTS = ((0xAC00, 0xD7A3, 58), (0x1100, 0x11FF, 58), (0x3041, 0x309F, 59), (0x30A1, 0x30FF, 60), (0x3400, 0x9FFF, 61), (0xF900, 0xFAFF, 61), (0x0400, 0x052F, 62))
_symbols: np.ndarray | None = None


def symbols() -> np.ndarray:
    """Code point -> one of 64 symbols: 0 what is no letter, letters of Latin one by one (other accented ones as their plain letter), a leading symbol for letters of other scripts."""
    global _symbols
    if _symbols is None:
        s = np.zeros(0x110000, np.uint8)
        for o in range(0xAA, 0x20000):
            c = chr(o)
            if c.isalpha():
                plain = unicodedata.normalize("NFD", c)[0].lower()
                s[o] = 1 + ord(plain) - ord("a") if "a" <= plain <= "z" else 63
        for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED, 1):
            s[ord(c)] = i
        for first, last, symbol in SCRIPTS:
            s[first : last + 1] = symbol
        s[0x20000:0x32000] = 61
        _symbols = s
    return _symbols


def coded(text: str) -> np.ndarray:
    """Symbols of the lower-cased text; a run of non-letters is one 0. A letter beyond Latin is its leading symbol and two of its code point's digits."""
    return coded_lines([text])[0]


def coded_lines(texts: list[str]) -> list[np.ndarray]:
    """The symbols of each text, all at once."""
    lower = [t.lower() for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = symbols()[points]
    ends = np.cumsum([len(t) for t in lower])
    kept = codes != 0
    kept[1:] |= kept[:-1].copy()
    kept[[end - len(t) for t, end in zip(lower, ends.tolist()) if t]] = True  # what a text begins with stays
    size = np.where(codes >= 58, 3, 1) * kept
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])].tolist()
    codes, points, size = codes[kept], points[kept], size[kept]
    out = np.repeat(codes, size)
    beyond = size == 3
    at = (np.cumsum(size) - size)[beyond]
    out[at + 1] = (points[beyond] >> 6) & 63
    out[at + 2] = points[beyond] & 63
    return [out[a:b] for a, b in zip(ends, ends[1:])]


def main_script(text: str) -> int:
    """The script most letters of a text are of: 1 Latin, 2 Hangul, 3 kana and Han, 4 Cyrillic, 5 other, 0 without letters."""
    codes = symbols()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    kinds = np.bincount(np.array([0] + [1] * 57 + [2, 3, 3, 3, 4, 5])[codes], minlength=6)[1:]
    return int(kinds.argmax()) + 1 if kinds.any() else 0


class Arcs(NamedTuple):
    """A suffix automaton as it is sent: some three arcs a symbol of its text at most. `at` is state * 64 + symbol."""

    states: int
    at: np.ndarray
    to: np.ndarray

    def table(self) -> np.ndarray:
        """Transition table [state, symbol]; 0 where a passage doesn't go on, 1 is the start."""
        table = np.zeros(self.states << BITS, np.int64)
        table[self.at] = self.to
        return table.reshape(self.states, 1 << BITS)


def suffix_automaton(text: np.ndarray) -> Arcs:
    moves: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for c in text.tolist():
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    at = np.array([(s << BITS) + c for s, m in enumerate(moves) for c in m], np.int32)
    return Arcs(len(moves), at, np.array([q for m in moves for q in m.values()], np.int32))


def parser(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return joined([suffix_automaton(text) for text in texts])


def joined(automata: list[Arcs]) -> tuple[np.ndarray, np.ndarray]:
    """One table for all languages: entry = next state * 2 + whether a new phrase began; and the start states.

    Leaving the start state begins a phrase. Where the passage can't go on, the next symbol begins one too.
    """
    parts, roots, base = [], [], 0
    for automaton in automata:
        table = automaton.table()
        fresh = np.where(table[1] > 0, table[1], 1)  # a symbol the language never has is a phrase of its own
        step = np.where(table > 0, (table + base) * 2, (fresh[None, :] + base) * 2 + 1)
        step[1] = (fresh + base) * 2 + 1
        parts.append(step.astype(np.int32))
        roots.append(1 + base)
        base += len(table)
    return np.concatenate(parts).ravel(), np.array(roots, np.int32)


_parsers: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _parser(token: str, shared) -> tuple[np.ndarray, np.ndarray]:
    """The tables of a run, laid out once in each Python worker: the driver sends arcs, a megabyte a language at most; the tables are tens of megabytes."""
    if token not in _parsers:
        _parsers.clear()
        _parsers[token] = joined(shared.value)
    return _parsers[token]


def phrases(table: np.ndarray, roots: np.ndarray, lines: list[np.ndarray], window: int = WINDOW) -> np.ndarray:
    """[language, line]: phrases of each line; lines are parsed in windows side by side, all languages at once."""
    out = np.zeros((len(roots), len(lines)), np.int64)
    sizes = np.array([len(x) for x in lines], np.int64)
    if not sizes.sum():
        return out
    pieces = (sizes + window - 1) // window
    line = np.repeat(np.arange(len(lines)), pieces)
    nth = np.arange(len(line)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(sizes) - sizes)[line] + nth * window
    size = np.minimum(sizes[line] - nth * window, window)
    order = np.argsort(-size, kind="stable")
    line, begin, size = line[order], begin[order], size[order]
    data = np.concatenate(lines).astype(np.int32)
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # how many pieces are longer than t
    state = np.repeat(roots[:, None], len(size), 1).astype(np.int32)
    count = np.zeros(state.shape, np.int32)
    for t, k in enumerate(active.tolist()):
        step = table[(state[:, :k] << BITS) + data[begin[:k] + t]]
        count[:, :k] += step & 1
        state[:, :k] = step >> 1
    for i in range(len(roots)):
        out[i] = np.bincount(line, count[i], len(lines))
    return out


class Model(NamedTuple):
    languages: tuple[str, ...]
    texts: list[np.ndarray]
    ceilings: np.ndarray  # most phrases a symbol in a line of each language
    automata: list[Arcs]  # of the texts


def train(labelled: list[tuple[str, str]], chars: int = TRAIN_CHARS) -> Model:
    """The languages of a bounded sample of labelled lines, a text of at most some `chars` symbols of each, and how many phrases their lines need.

    Labels may be wrong: a line is used only if its script is the one that most lines of its label have, and if the parser of the
    other half of the lines agrees with its label. A label half of whose lines or more are not used that way is no language.
    The lines that are left over, a tenth at least, measure the phrases a symbol of a language's own lines and of those of other languages; the ceiling of a
    language lies between the 99th percentile of the first and the 5th of the second; one with under 20 such lines has none.
    """
    labels = tuple(sorted({lang for lang, _ in labelled}))
    lines = [(labels.index(lang), coded(text), main_script(text)) for lang, text in labelled]
    usual = {i: Counter(s for own, _, s in lines if own == i).most_common(1)[0][0] for i in range(len(labels))}
    fitting = [(i, x) for i, x, s in lines if s == usual[i] and s]

    def fit(chosen: list[tuple[int, np.ndarray]], limit: int) -> tuple[list[np.ndarray], list[tuple[int, np.ndarray]]]:
        texts, rest = [], []
        for i in range(len(labels)):
            own = [x for lang, x in chosen if lang == i]
            room = np.cumsum([0] + [len(x) for x in own])[:-1] < limit if own else []
            texts.append(np.concatenate([x for x, r in zip(own, room) if r] or [np.empty(0, np.uint8)])[: 2 * limit])
            rest += [(i, x) for x, r in zip(own, room) if not r]
        return texts, rest

    halves = [fitting[::2], fitting[1::2]]
    kept: list[tuple[int, np.ndarray]] = []
    for own, other in ((halves[0], halves[1]), (halves[1], halves[0])):
        if own and other:
            winner = phrases(*parser(fit(other, chars // 4)[0]), [x for _, x in own]).argmin(0)
            kept += [pair for pair, w in zip(own, winner.tolist()) if pair[0] == w]
        else:
            kept += own
    met, total = Counter(i for i, _ in kept), Counter(i for i, _, _ in lines)
    sure = [i for i in range(len(labels)) if 2 * met[i] > total[i]]
    kept = [pair for pair in kept if pair[0] in sure]
    texts, rest = fit([pair for n, pair in enumerate(kept) if n % 10], chars)
    rest += kept[::10]
    texts = [texts[i] for i in sure]
    automata = [suffix_automaton(text) for text in texts]
    ceilings = np.full(len(sure), np.inf)
    if rest and len(sure) > 1:
        rate = phrases(*joined(automata), [x for _, x in rest]) / np.array([len(x) for _, x in rest])
        owner = np.array([sure.index(i) for i, _ in rest])
        for i in range(len(sure)):
            if (owner == i).sum() >= 20 and (owner != i).any():
                own, foreign = np.percentile(rate[i, owner == i], 99), np.percentile(rate[i, owner != i], 5)
                ceilings[i] = max(np.sqrt(own * foreign), 1.1 * own)
    return Model(tuple(labels[i] for i in sure), texts, ceilings, automata)


def line_languages(docs: DataFrame, languages: tuple[str, ...] | None = None, least_chars: int = LEAST_CHARS, sample_docs: int = SAMPLE_DOCS, short_texts: bool = True) -> DataFrame:
    """doc_id, line_no, lang, confidence of every line of least_chars or more characters.

    A document without such a line is one segment, with a null line_no (left out if not short_texts). The languages are those that the
    labels of a bounded sample agree on, or the given ones; a text that needs more phrases a symbol than lines of the language it comes
    nearest to has a null lang. Garbled lines are judged by their restored text. confidence is 1 less the winner's phrases over the
    second's, so 0 for a tie (the first language in alphabetical order then wins) and for a null lang. Texts without letters, null and
    empty texts have no rows; nor has any text if no label is found.
    """
    spark = docs.sparkSession
    sample = labelled_lines(docs, languages or label_codes(docs), sample_docs)
    model = train(sample)
    names = model.languages
    token, automata = uuid.uuid4().hex, spark.sparkContext.broadcast(model.automata)
    dictionaries = spark.sparkContext.broadcast(encoding.train([(lang, line) for lang, line in sample if lang in names]))
    ceilings = model.ceilings

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, numbers, lines = [], [], []
        fix = encoding.repairer(token, dictionaries, names)
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            segments = [(n, line) for n, line in enumerate(text.split("\n"), 1) if len(line) >= least_chars]
            if not segments and short_texts:
                segments = [(None, " ".join(text.split("\n")))]
            for number, line in segments:
                if not line.isascii():
                    line = encoding.readable(fix, line)
                    if number and len(line) < least_chars:
                        continue
                ids.append(doc)
                numbers.append(number)
                lines.append(canon(line, by_context=True))
        codes = coded_lines(lines) if lines else []
        lettered = [i for i, code in enumerate(codes) if code.any()]
        if not lettered or not names:
            return None
        ids, numbers, codes = ([x[i] for i in lettered] for x in (ids, numbers, codes))
        whole = ["�" not in lines[i] for i in lettered]  # what is lost begins phrases in any language
        count = phrases(*_parser(token, automata), codes)
        best = count.argmin(0)
        first, second = np.partition(count, min(1, len(names) - 1), 0)[: 2 if len(names) > 1 else 1][[0, -1]]
        known = (first <= ceilings[best] * np.array([len(x) for x in codes])) | ~np.array(whole)
        confidence = np.where(known, 1 - first / np.maximum(second, 1) if len(names) > 1 else 1.0, 0.0)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array([names[i] if k else None for i, k in zip(best.tolist(), known.tolist())], pa.string()), pa.array(confidence, pa.float64())],
            names=["doc_id", "line_no", "lang", "confidence"],
        )

    return map_slices(docs.select("doc_id", "text").where("text is not null"), run, "doc_id long, line_no int, lang string, confidence double")


def document_languages(docs: DataFrame, **params) -> DataFrame:
    """doc_id, lang, segments, confidence: the languages of a document and the mean confidence of their lines; null for lines of no known language."""
    return line_languages(docs, **params).groupBy("doc_id", "lang").agg(F.count("*").alias("segments"), F.avg("confidence").alias("confidence"))


def wrong_labels(docs: DataFrame, **params) -> DataFrame:
    """doc_id, lang, label, confidence: all languages of each document whose label is missing, wrong or names one of several.

    Lines of no known language, and documents without a long enough line, give no row.
    """
    found = document_languages(docs, short_texts=False, **params).where("lang is not null").groupBy("doc_id").agg(F.collect_list(F.struct("lang", "confidence")).alias("found"))
    labels = docs.select("doc_id", label("lang").alias("label"))
    same = (F.size("found") == 1) & F.col("label").eqNullSafe(F.col("found")[0]["lang"])
    return found.join(labels, "doc_id").where(~same).select("doc_id", "label", F.explode("found").alias("f")).select("doc_id", F.col("f.lang").alias("lang"), "label", F.col("f.confidence").alias("confidence"))
