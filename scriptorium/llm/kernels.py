"""Small helpers that run inside Spark tasks: consistent form, words, hashes."""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession

from scriptorium.storage import local_folder, ship

SLICE = 512  # rows handled at once inside a task; bounds the memory of the Python worker


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = SLICE) -> DataFrame:
    """mapInArrow over slices of at most `rows` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = fn(batch.slice(start, rows))
                if out is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    share_letters(df.sparkSession)
    return df.mapInArrow(run, schema)


def share_arrays(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """Send arrays of bounded size to every executor as files; gives the token under which tasks map them."""
    token = f"arrays-{uuid.uuid4().hex}"
    folder = local_folder("arrays")
    for name, array in arrays.items():
        np.save(folder / f"{token}-{name}.npy", array)
        spark.sparkContext.addFile(str(folder / f"{token}-{name}.npy"))
    return token


def mapped(token: str, name: str) -> np.ndarray:
    """Inside a task: one shared array, memory-mapped, so the workers of an executor hold it once."""
    return np.asarray(np.load(SparkFiles.get(f"{token}-{name}.npy"), mmap_mode="r"))


# --- consistent form -------------------------------------------------------------------------------------------------

# Letters of other alphabets that look like Latin letters, pair by pair; they come before the public table.
CYRILLIC_LIKE = dict(zip("асԁеһіјӏорԛѕԝхуѵүАВСЕНІЈКМОРЅТХУҮԚԜѴ", "acdehijlopqswxyvyABCEHIJKMOPSTXYYQWV"))
GREEK_LIKE = dict(zip("οναριΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ovapiABEZHIKMNOPTYX"))
# Characters without width, kinds of space, and kinds of hyphen.
ZERO_WIDTH = re.compile("[\u00ad\u034f\u061c\u180e\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]+")
EMOJI = "\u2600-\u27bf\ufe0f\U0001f000-\U0001faff"
JOINER = re.compile(f"(?<![{EMOJI}])\u200d|\u200d(?![{EMOJI}])")  # between emoji a joiner changes the picture
SPACE_KINDS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
SPACES = re.compile(f"[{SPACE_KINDS}]")
HYPHENS = re.compile("[\u2010\u2011]")
# Forms of plain letters - ligatures, digraphs, letters as symbols, Roman numerals, radicals, full and half width, mathematical.
_FORMS = "\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3\u2102\u210a-\u2115\u2119-\u211d\u2124\u2128\u212a-\u212d\u212f-\u2134\u2139\u2160-\u217f\u2f00-\u2fd5\u3131-\u318e\ufb00-\ufb06\ufb13-\ufb17\uff01-\uffdc\uffe0-\uffee\U0001d400-\U0001d7ff"
COMPATIBLE = re.compile(f"[{_FORMS}]+")
_ODD = f"{_FORMS}\u00a0\u00ad\u0300-\u036f\u061c\u1100-\u11ff\u1680\u180e\u2000-\u2011\u202a-\u202f\u205f-\u2069\u3000\u3099\u309a\ufeff"
TOKEN = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")
LETTERS_FILE = "look-alike-letters.json"
# Scripts whose letters have no case and stand for syllables or words; they are not compared.
_APART = r"[\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Tangut}\p{Yi}\p{Khitan_Small_Script}\p{Nushu}]"


def look_alikes(spark: SparkSession) -> list[list[str]]:
    """Classes of look-alike letters, from the public table of confusables that Spark's ICU library carries.

    Letters of any alphabet that is written from left to right belong together if the table gives them one prototype and they
    have the same case. Latin letters of ISO 8859-1 and Latin Extended-A stand for themselves: an accent or a missing dot
    is a real difference.
    """
    import regex  # only here: the driver builds the table once

    apart = regex.compile(_APART)
    found = [c for c in map(chr, range(0x41, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.bidirectional(c) == "L" and not apart.match(c)]
    found = [c for c in found if unicodedata.normalize("NFD", c) == c and not COMPATIBLE.match(c) and not "\u0080" <= c <= "\u017f"]
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    fixed = CYRILLIC_LIKE | GREEK_LIKE
    classes: dict[tuple[str, str], list[str]] = {}
    for letter, prototype in zip(found, checker.getSkeleton("\n".join(found)).split("\n")):
        kind = unicodedata.category(letter)
        plain = fixed.get(letter) or (letter if letter.isascii() else "I" if (prototype, kind) == ("l", "Lu") else prototype)
        is_plain = len(plain) == 1 and plain.isascii() and plain.isalpha() and kind in ("Lo", unicodedata.category(plain))
        classes.setdefault((plain, "") if is_plain else (prototype, kind), []).append(letter)
    return [sorted(members, key=lambda c: (not c.isascii(), c not in fixed, c)) for members in classes.values() if len(members) > 1]


_shared: set[str] = set()


def share_letters(spark: SparkSession) -> None:
    """Send the table of look-alike letters to the executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shared:
        path = local_folder("letters") / LETTERS_FILE
        path.write_text(json.dumps(look_alikes(spark)))
        sc.addFile(str(path))
        _shared.add(sc.applicationId)


def script(ch: str) -> str:
    """The script of a letter, as its name states it."""
    return unicodedata.name(ch, "none").split()[0].lower()


class Letters:
    """ways: letter -> its spellings by script; plain: letter -> the letter that stands for its class; odd, foreign: patterns."""

    def __init__(self, classes: list[list[str]]):
        self.ways: dict[str, dict[str, str]] = {}
        self.plain: dict[str, str] = {}
        for members in classes:
            spelled: dict[str, str] = {}
            for letter in members:  # a phonetic letter is the Latin spelling of none but a plain Latin letter
                name = script(letter)
                spelled.setdefault("phonetic" if name == "latin" and not members[0].isascii() else name, letter)
            for letter in members:
                self.ways[letter] = spelled
                self.plain[letter] = spelled.get("latin", members[0])
        beyond = "".join(sorted(c for c in self.ways if "\x7f" < c < "\U00010000")) + "\U00010000-\U00016fff"  # one range there, as the pattern would try single ones in turn
        self.foreign = re.compile(f"[{beyond}]")
        self.odd = re.compile(f"[{_ODD}{beyond}]")


_letters: Letters | None = None


def letters() -> Letters:
    """The table: in a task from the file that the driver sent, on the driver from the library of the active session."""
    global _letters
    if _letters is None:
        if TaskContext.get() is not None:
            _letters = Letters(json.loads(Path(SparkFiles.get(LETTERS_FILE)).read_text()))
        else:
            _letters = Letters(look_alikes(SparkSession.builder.getOrCreate()))
    return _letters


def _one_script(text: str, by_context: bool) -> str:
    table = letters()
    firm: dict[str, int] = {}
    if by_context:
        for ch in text:
            if ch.isalpha() and ch not in table.ways:
                s = script(ch)
                firm[s] = firm.get(s, 0) + 1

    def fix(m: re.Match) -> str:
        token = m.group()
        if not by_context and not table.foreign.search(token):
            return token
        flat = unicodedata.normalize("NFD", token)
        common: set[str] | None = None
        for c in flat:
            if not "\u0300" <= c <= "\u036f":
                ways = table.ways.get(c) or (script(c),)
                common = set(ways) if common is None else common.intersection(ways)
                if not common:
                    break
        if not common:
            spelled = "".join(table.plain.get(c, c) for c in flat)
        else:
            name = max(sorted(common), key=lambda s: (firm.get(s, 0), s == "latin", s == "cyrillic", s == "greek"))
            spelled = "".join(table.ways[c][name] if c in table.ways else c for c in flat)
        return unicodedata.normalize("NFC", spelled)

    return TOKEN.sub(fix, text)


def canon(text: str, by_context: bool = False) -> str:
    """The one consistent form of a text; texts that look alike get equal forms, and the form of a line is that line of the text's form.

    Full-width, half-width, mathematical and ligature forms become their plain letters, accents and syllables are composed,
    zero-width characters and direction marks go, every kind of space becomes a blank. Of each token the sets of scripts in which its
    letters can be spelled are intersected: a token that can be spelled in Latin is, any other in the script it shares; letters of a
    token without a common script become the letter of their class. Case, other punctuation, wording, the number of spaces and line
    breaks stay.

    by_context: a token that could be spelled in several scripts takes that of most letters of the text that have no
    look-alike (Latin among equals); those are the same in all look-alike copies, so copies stay equal. For texts to be read.
    """
    if text.isascii():
        return text
    table = letters()
    if not table.odd.search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    text = ZERO_WIDTH.sub("", text)
    if "\u200d" in text:
        text = JOINER.sub("", text)
    text = HYPHENS.sub("-", SPACES.sub(" ", text))
    text = COMPATIBLE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = unicodedata.normalize("NFC", text)
    return _one_script(text, by_context) if table.foreign.search(text) else text


# --- words and hashes ------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand; emptied when it holds a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


HASHES = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    get = HASHES.__getitem__
    found = WORD.findall(text.lower())
    return np.fromiter(map(get, found), dtype=U64, count=len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public domain splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words."""
    if len(hashes) < n:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for i in range(1, n):
            out = out * U64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def two_longs(data: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(data)
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)
