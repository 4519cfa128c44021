"""Problem 7: text that went through a wrong character encoding, by minimum description length.

Text goes wrong when bytes written in one encoding are read in another. A table of code pages gives the ways back; every chain of
them that a line admits gives candidates; after each step those of shortest description go on. Each candidate is
compressed with a zstandard dictionary per language, and the one of least compressed size plus chain cost wins. If
that is the stored text, the line stays unchanged.
"""

from __future__ import annotations

import re
import uuid
from functools import cache, lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from scriptorium.llm.kernels import SPACE_KINDS, map_slices
from scriptorium.llm.samples import LANGUAGES, SAMPLE_DOCS, labelled_lines

DICTIONARY_CHARS, STEP_COST, NEW_CHARACTER_COST, WIDTH = 24_000, 3, 4, 8

# Code pages of one byte a character and of several in which bytes may have been read, and by language the encodings beside UTF-8 in which they may have been written.
SINGLE = ("cp1252", "cp1251", "cp1250", "iso8859_2", "koi8_r", "mac_roman", "cp437", "cp850")
DOUBLE = ("cp949", "cp932", "gbk", "big5")
WRITTEN = {"ko": ("cp949",), "ja": ("cp932", "euc_jp"), "zh": ("gbk", "big5"), "ru": ("cp1251", "koi8_r"), "uk": ("cp1251", "koi8_r")}
_UTF8 = r"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}"
# Whole runs of bytes that are UTF-8; a lone sequence of two bytes is one letter of two of these pages and counts only beside a Latin letter.
_RUN = rf"(?:{_UTF8})*(?:[\xe0-\xef][\x80-\xbf]{{2}}|[\xf0-\xf4][\x80-\xbf]{{3}}|(?:{_UTF8}){{2}})(?:{_UTF8})*(?![\x80-\xff])"
_UTF8_RUNS = re.compile(rf"[\x00-\x7f](?=[\xc2-\xf4][\x80-\xbf])(?:{_RUN}|[\xc2-\xdf][\x80-\xbf](?=[A-Za-z])|(?<=[A-Za-z])[\xc2-\xdf][\x80-\xbf](?![\x80-\xff]))".encode("latin-1"))


@cache
def _page(codec: str) -> dict[int, int]:
    """Character -> byte of a code page; bytes without a character stand for themselves, as do the characters of Latin-1 that the page lacks."""
    out = {b: b for b in range(128, 256)} if codec == "cp1252" else {}
    for b in range(128, 256):
        try:
            out[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            out[b] = b
    return out


@cache
def _characters(codec: str) -> frozenset[str]:
    return frozenset(map(chr, _page(codec)))


@cache
def _adjacent() -> re.Pattern:
    """What begins a sequence in any page of single bytes, before what goes on with one in any: every passage holds such a pair."""
    first, later = ("".join(map(re.escape, sorted(frozenset().union(*parts)))) for parts in zip(*map(_ends, SINGLE)))
    return re.compile(f"[{first}][{later}]")


@cache
def _passages(codec: str) -> re.Pattern:
    """Passages whose characters are, byte by byte of the code page, valid UTF-8."""
    show: dict[int, str] = {}
    for char, byte in _page(codec).items():
        show[byte] = show.get(byte, "") + re.escape(chr(char))
    tail = "[" + "".join(show.get(b, "") for b in range(0x80, 0xC0)) + "]"
    two, three, four = ("[" + "".join(show.get(b, "") for b in r) + "]" for r in (range(0xC2, 0xE0), range(0xE0, 0xF0), range(0xF0, 0xF5)))
    return re.compile(f"(?:{two}{tail}|{three}{tail}{{2}}|{four}{tail}{{3}})+")


@cache
def _ends(codec: str) -> tuple[frozenset[str], frozenset[str]]:
    """The characters of the page for bytes that begin a UTF-8 sequence and for those that go on with one."""
    page = _page(codec).items()
    return frozenset(chr(c) for c, b in page if 0xC2 <= b <= 0xF4), frozenset(chr(c) for c, b in page if 0x80 <= b < 0xC0)


_ASCII = frozenset(map(chr, range(128)))
_HAN, _WIDE = re.compile("[㐀-鿿豈-﫿｡-ﾟ]"), re.compile("[㐀-\U0010ffff]")


@lru_cache(8)
def _unknown(known: frozenset[str]) -> re.Pattern:
    """A character beyond ASCII that is not known."""
    return re.compile("[^\x00-\x7f" + "".join(map(re.escape, sorted(known))) + "]")


def _raw(text: str, codec: str) -> bytes | None:
    """The bytes that were read as this text; None if it holds a character that the page lacks."""
    if codec in DOUBLE:
        try:
            return text.encode(codec)
        except UnicodeEncodeError:
            return None
    try:
        return text.translate(_page(codec)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def _undone(passage: str, codec: str) -> str:
    try:
        return _raw(passage, codec).decode("utf-8")
    except UnicodeDecodeError:  # overlong forms and surrogates
        return passage


_undone_often = lru_cache(1 << 14)(_undone)  # a letter or two, or a word; asked for short passages only


def _utf8_read_as(text: str, codec: str) -> str | None:
    """The text with every passage undone that is UTF-8 read in the code page; None if there is none."""
    if codec in DOUBLE:
        raw = text.encode(codec, "replace")
        if not _UTF8_RUNS.search(b"\n" + raw):
            return None
        try:
            return text.encode(codec).decode("utf-8")
        except UnicodeError:  # only where most of the line went wrong: a few syllables are valid UTF-8 by chance
            was = re.sub("[^\x00-\x7f]+", lambda m: _whole_run(m.group(), codec), text)
            rest = sum(a == b for a, b in zip(re.findall("[^\x00-\x7f]+", text), re.findall("[^\x00-\x7f]+", was)))
            return was if 2 * rest <= len(re.findall("[^\x00-\x7f]+", text)) else None

    def undo(m: re.Match) -> str:
        passage = m.group()
        return (_undone_often if len(passage) <= 32 else _undone)(passage, codec)

    was, passages = _passages(codec).subn(undo, text)
    return was if passages else None


def _whole_run(run: str, codec: str) -> str:
    raw = _raw(run, codec)
    try:
        return raw.decode("utf-8") if raw is not None else run
    except UnicodeDecodeError:
        return run


def steps_back(text: str, written: tuple[str, ...], known: frozenset[str]) -> list[tuple[str, tuple[str, str]]]:
    """(earlier text, step) for every way back: UTF-8 in any page, and, where the text has characters that no language of the collection uses, the encodings of its languages.

    A page is tried only if the text has the characters that any passage garbled by it must hold.
    """
    out = []
    paired, unknown = _adjacent().search(text), _unknown(known).search(text)
    beyond = set(text).difference(_ASCII) if paired or unknown else set()
    for codec in SINGLE if paired else ():
        first, later = _ends(codec)
        if not beyond.isdisjoint(first) and not beyond.isdisjoint(later):
            was = _utf8_read_as(text, codec)
            if was is not None:
                out.append((was, (codec, "utf-8")))
    for codec in () if not _WIDE.search(text) else DOUBLE if _HAN.search(text) else DOUBLE[:1]:
        was = _utf8_read_as(text, codec)
        if was is not None:
            out.append((was, (codec, "utf-8")))
    if unknown:
        for codec in SINGLE:
            if beyond.issubset(_characters(codec)):
                raw = _raw(text, codec)
                for other in written:
                    if other != codec:
                        try:
                            out.append((raw.decode(other), (codec, other)))
                        except UnicodeDecodeError:
                            pass
    return out


class Compressors:
    """One compressor per dictionary; `best` chooses among the candidates of a line."""

    def __init__(self, dictionaries: list[bytes], languages: tuple[str, ...] = LANGUAGES):
        self.each = []
        for d in dictionaries:
            shared = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=3)
            self.each.append(zstandard.ZstdCompressor(dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False))
        self.each = self.each or [zstandard.ZstdCompressor(level=3)]
        self.written = tuple(dict.fromkeys(x for lang in languages for x in WRITTEN.get(lang, ())))
        self.known = frozenset(SPACE_KINDS).union(c for d in dictionaries for c in d.decode("utf-8", "replace") if c > "\x7f")

    def compressed(self, text: str) -> int:
        data = text.encode("utf-8", "surrogatepass")
        return min(len(c.compress(data)) for c in self.each)

    def size(self, text: str) -> int:
        """Bytes of the shortest description: compressed, and some more for each character that no sample has."""
        return self.compressed(text) + NEW_CHARACTER_COST * len(set(text).difference(_ASCII, self.known))

    def best(self, line: str, step_cost: int = STEP_COST, width: int = WIDTH) -> tuple[str, tuple]:
        """The text and chain of least description length; (line, ()) if no chain is shorter.

        Chains have any length: after each step the `width` texts of shortest description go on. Every step shortens the text in
        UTF-8, so a chain ends, and no text is met twice. Half of a double mistake need not look better than the whole.
        """
        if line.isascii() or not (found := steps_back(line, self.written, self.known)):
            return line, ()
        least = self.size(line)
        best, seen, last = (line, ()), {line}, [(least, line, (), found)]
        while last:
            new = []
            for _, text, chain, found in last:
                room = len(text.encode("utf-8", "surrogatepass"))
                for was, step in found:
                    if was not in seen and "\x00" not in was and len(was.encode("utf-8", "surrogatepass")) < room:
                        seen.add(was)
                        partly = not set(text).difference(_ASCII).isdisjoint(was)  # then it must be told where
                        after = self.size(was) + step_cost * (len(chain) + 1 + partly)
                        new.append((after, was, (*chain, step)))
            new.sort(key=lambda x: x[0])
            if new and new[0][0] < least:
                least, best = new[0][0], new[0][1:]
            last = [(*x, steps_back(x[1], self.written, self.known)) for x in new[:width] if not x[1].isascii()]
        return best


def train(lines: list[tuple[str, str]], chars: int = DICTIONARY_CHARS) -> list[bytes]:
    """One dictionary per language, of some `chars` characters of (language, line) labelled with it."""
    kept: dict[str, list[str]] = {}
    for lang, line in lines:
        if sum(map(len, kept.setdefault(lang, []))) < chars:
            kept[lang].append(line)
    return ["\n".join(lines).encode("utf-8", "surrogatepass") for _, lines in sorted(kept.items())]


class Repairer:
    """Kept by a Python worker for one set of dictionaries."""

    def __init__(self, dictionaries: list[bytes], languages: tuple[str, ...] = LANGUAGES):
        self.compressors = Compressors(dictionaries, languages)

    def line(self, line: str) -> tuple[str, tuple]:
        return (line, ()) if line.isascii() else self.compressors.best(line)

    def field(self, text: str) -> tuple[str, str, bool] | None:
        """(text with restorable lines restored, chains, whether all places were restored); None if nothing is garbled."""
        if text.isascii():
            return None
        lines, chains, lost = [], [], "�" in text
        for line in text.split("\n"):
            fixed, chain = self.line(line)
            lines.append(fixed)
            if chain:
                chains.append(" + ".join(f"{a}>{b}" for a, b in chain))
        if not chains and not lost:
            return None
        return "\n".join(lines), ", ".join(sorted(set(chains))), not lost


_repairers: dict[str, Repairer] = {}


def repairer(token: str, shared, languages: tuple[str, ...] = LANGUAGES) -> Repairer:
    if token not in _repairers:
        _repairers.clear()
        _repairers[token] = Repairer(shared.value, languages)
    return _repairers[token]


def garbled_fields(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, field ('text' or 'title'), restored, chains, complete - a row for each field with a garbled place.

    restored holds the field with every restorable line restored and all else as stored; complete is false where
    replacement characters show that something was lost. Null and empty fields have no rows. The models are a few hundred
    kilobytes, bounded by parameters, and broadcast; the pass itself is narrow.
    """
    token, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(train(labelled_lines(docs, languages, sample_docs)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fix = repairer(token, shared)
        rows = []
        for doc, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            for name, value in (("title", title), ("text", text)):
                if value and (got := fix.field(value)):
                    rows.append((doc, name, *got))
        columns = list(zip(*rows)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["doc_id", "field", "restored", "chains", "complete"])

    return map_slices(docs.select("doc_id", "title", "text"), run, "doc_id long, field string, restored string, chains string, complete boolean")


def readable(fix: Repairer, line: str) -> str:
    """The restored line; of a line with losses, what can be read of it: enough to tell its language."""
    fixed = line if "�" in line else fix.line(line)[0]
    if "�" in fixed:
        rest = fixed.replace("�", "")
        beyond = lambda s: sum(not c.isascii() for c in s)
        for codec in DOUBLE:
            read = rest.encode(codec, "ignore").decode("utf-8", "ignore")
            if beyond(read) >= 0.2 * beyond(rest) and fix.compressors.compressed(read) < 0.8 * fix.compressors.compressed(rest):
                return read
    return fixed
