"""Problem 3: the main body of web pages among menus, notices, lists of other articles and footers.

Parser events give each line of a page its text-to-tag ratio; the ratios are smoothed with a Gaussian and a threshold
clusters the lines into the content region and the rest. As the pages come as lines of text whose tags are mostly
gone, what is left of links counts as tags (list marks, separators, addresses), and of the text of a line only what is not
link text counts: a line that many different articles carry comes from the site's template, and a line that reads like the
title of another article is a link to it. These two weigh the ratio; the region of the smoothed ratios alone chooses the lines.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import canon, list_array, map_slices, mapped, share_arrays
from scriptorium.storage import stage

BITS, LEAST_ARTICLES, ROUNDS, MARGIN, LONG = 18, 5, 3, 0.0, 200
SIGMA, THRESHOLD, REACH = 0.7, 0.0, 6.0  # of the smoothing in lines; of the smoothed binary logarithms of the ratios; of one such logarithm
TEMPER = 6.0  # a line's words are not independent, so its log-odds are too large by some such factor
MARK = re.compile(r"^\s*(?:[-+*•»>\[]|\d{1,2}[.)])\s*")
LINKS = re.compile(r"[|·>»©]|\S+@\S+|https?://|\s{2,}\S|\s/\s")
ADDRESS = re.compile(r"\S+@\S+|https?://\S+")
TOKENS = re.compile(r"[ァ-ヿ]+|[ぁ-ゟ]+|[一-鿿]+|[가-힣]+|[^\W\d_ぁ-ヿ一-鿿가-힣]+|\d+|[:;,–—/()“”„«»?!。、]")
LETTERS = re.compile(r"[\W\d_]+")


class _Tags(HTMLParser):
    """Counts start and end tags by line of the page, fed line by line."""

    def __init__(self, lines: int):
        super().__init__(convert_charrefs=True)
        self.counts = np.zeros(lines)

    def _count(self) -> None:
        self.counts[min(self.getpos()[0] - 1, len(self.counts) - 1)] += 1

    def handle_starttag(self, tag, attrs):
        self._count()

    def handle_endtag(self, tag):
        self._count()


def tag_counts(lines: list[str]) -> np.ndarray:
    """Tags of each line: those of parser events, and what is left of links."""
    parser = _Tags(len(lines))
    if any("<" in x for x in lines):
        for line in lines:
            parser.feed(line + "\n")
    return parser.counts + [len(LINKS.findall(x)) + bool(MARK.match(x)) for x in lines]


def content_region(chars: np.ndarray, tags: np.ndarray, linked: np.ndarray, sigma: float = SIGMA, threshold: float = THRESHOLD, reach: float = REACH) -> np.ndarray:
    """Whether each of consecutive non-empty lines is in the content region.

    chars: characters of the line, tags: its tags, linked: the part of its text that is link text, 0 to 1. The ratio of other text to tags
    is taken as a logarithm of at most `reach` either way, so that one long paragraph does not drown the lines beside it, and smoothed
    with a Gaussian of sigma lines; lines above the threshold (one character a tag) are content.
    """
    if not len(chars):
        return np.zeros(0, bool)
    ratio = np.clip(np.log2(np.maximum(chars * (1 - linked), 1e-9) / (1 + tags)), -reach, reach)
    far = max(int(np.ceil(3 * sigma)), 1)
    kernel = np.exp(-0.5 * (np.arange(-far, far + 1) / sigma) ** 2)
    weight = np.convolve(np.pad(np.ones(len(ratio)), far), kernel, "valid")
    return np.convolve(np.pad(ratio, far), kernel, "valid") / weight > threshold


def features(line: str, bits: int = BITS) -> np.ndarray:
    """Buckets of the list mark in front (first), of the words, word pairs (also of a word's end and a word) and pairs over a gap of one or two words."""
    plain = MARK.sub("", line).strip()
    tokens = ["^" + ("a" if plain[:1].islower() else "A"), *TOKENS.findall(plain.lower()), "$"]
    ends = ["~" + t[-1] for t in tokens]  # in some languages a name carries its role at its end
    mark = MARK.match(line)
    lead = ["mark " + re.sub(r"\d", "9", mark.group().strip())[:1] if mark else "mark none"]
    names = lead + tokens + [f"{a} {b}" for a, b in zip(ends, tokens[1:])] + [f"{a} . {b}" for a, b in zip(ends, tokens[2:])] + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])] + [f"{a} . {b}" for a, b in zip(tokens, tokens[2:])] + [f"{a} . . {b}" for a, b in zip(tokens, tokens[3:])]
    return np.fromiter((xxhash.xxh3_64_intdigest(n) >> (64 - bits) for n in names), np.int32, len(names))


def _key(line: str, source: str) -> str:
    """The letters of a line in its consistent form, without the site's name and addresses."""
    flat = ADDRESS.sub(" ", " ".join(canon(line).casefold().split()))
    if source:
        flat = flat.replace(source, " ")
    return LETTERS.sub("", flat)


def page_lines(docs: DataFrame, headings: DataFrame, longest_title: int, bits: int = BITS) -> DataFrame:
    """What a parse of all texts yields: one row per non-empty line, and one per title.

    side: 'page' a line of a web page, 'other' a line of another document (only its key counts), 'title' the title of a document,
    'heading' a line of `headings`. page is the hash of the text; key the hash of the line's letters, null without any; article the
    hash of the document's longest line, which tells copies of an article from different articles; own whether the line is the
    document's stored title, titled whether there is one; features of lines up to longest_title characters.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        buckets: list[np.ndarray] = []
        none = np.empty(0, np.int32)

        def add(*row, f=none):
            rows.append(row)
            buckets.append(f)

        for doc, kind, source, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            lines = (text or "").split("\n")
            page = kind == "webpage"
            name = " ".join((source or "").casefold().split())
            own = LETTERS.sub("", canon(title or "").casefold())
            if own and len(title) <= longest_title:
                add(doc, "title", None, 0, 0, 0, None, None, False, True, False, f=features(canon(title), bits)[1:])
            if not text:
                continue
            article = xxhash.xxh3_64_intdigest(max(lines, key=len)) - 2**63
            whole = xxhash.xxh3_64_intdigest(text) - 2**63
            tags = tag_counts(lines) if page else None
            for i, line in enumerate(lines):
                if not line.strip():
                    continue
                if kind == "heading":
                    if len(line) <= longest_title:
                        add(doc, "heading", None, 0, 0, 0, None, None, False, False, False, f=features(canon(line), bits))
                    continue
                key = _key(line, name)
                key = xxhash.xxh3_64_intdigest(key) - 2**63 if key else None
                if page:
                    f = features(canon(line), bits) if len(line) <= longest_title else none
                    is_own = bool(own) and len(line) <= 2 * len(title) + 8 and LETTERS.sub("", canon(line).casefold()) == own
                    add(doc, "page", whole, i + 1, len(line.strip()), int(tags[i]), key, article, is_own, bool(own), bool(MARK.match(line)), f=f)
                elif key is not None:
                    add(doc, "other", None, i + 1, 0, 0, key, article, False, False, False)
        if not rows:
            return None
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] + [list_array(np.concatenate(buckets), np.array([len(f) for f in buckets]), pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "side", "page", "line_no", "chars", "tags", "key", "article", "own", "titled", "mark", "features"])

    rows = docs.select("doc_id", "document_type", "source", "title", "text").where("title is not null or text is not null")
    none = F.lit(None).cast("string")
    rows = rows.unionByName(headings.select(F.lit(None).cast("long").alias("doc_id"), F.lit("heading").alias("document_type"), none.alias("source"), none.alias("title"), "text").where("text is not null"))
    return map_slices(rows, run, "doc_id long, side string, page long, line_no int, chars int, tags int, key long, article long, own boolean, titled boolean, mark boolean, features array<int>")


def _scores(features: pa.ListArray, weight: np.ndarray, skip_first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, buckets, row of each bucket) of the rows' features; a row without any scores 0."""
    flat = features.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(features.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    if skip_first and len(flat):
        begin = np.cumsum(sizes) - sizes
        rest = np.ones(len(flat), bool)
        rest[begin[sizes > 0]] = False
        flat, row = flat[rest], row[rest]
    return np.bincount(row, weight[flat], len(sizes)), flat, row


def title_weights(lines: DataFrame, bits: int = BITS, rounds: int = ROUNDS, margin: float = MARGIN) -> np.ndarray:
    """Log-odds per feature bucket that a short line is a title, learned from titles and unlabelled lines of pages.

    lines: a table of page_lines. Titles stand on one side, lines of pages (but a page's own title) and headings on the other; those
    hold titles too, so in each further round the lines that the last round took for titles change sides, and those it was
    not sure of (within `margin`) are left out. List marks count from the second round on. All rows count; at most 2^bits sums
    pass the driver, whatever the size of the table.
    """
    spark = lines.sparkSession
    rows = lines.where("side <> 'other' and not own and size(features) > 0").select((F.col("side") == "title").alias("title"), "features")
    weights = np.zeros(1 << bits, np.float32)
    for turn in range(rounds):
        token = share_arrays(spark, {"weights": weights})

        def run(batch: pa.RecordBatch, token: str = token, first: bool = turn == 0) -> pa.RecordBatch:
            titles = batch.column(0).to_numpy(zero_copy_only=False)
            counts = []
            for side, skip in ((titles, False), (~titles, first)):
                chosen = batch.column(1).filter(pa.array(side))
                score, flat, row = _scores(chosen, mapped(token, "weights"), skip)
                as_title = np.ones(len(score), bool) if side is titles else (np.zeros(len(score), bool) if first else score > margin)
                as_other = np.zeros(len(score), bool) if side is titles else (np.ones(len(score), bool) if first else score <= -margin)
                counts += [(flat[as_title[row]], 1), (flat[as_other[row]], 0)]
            met = [np.unique(np.concatenate([f for f, s in counts if s == which]), return_counts=True) for which in (1, 0)]
            bucket = np.concatenate([x[0] for x in met])
            n = np.concatenate([x[1] for x in met])
            is_title = np.repeat([1, 0], [len(x[0]) for x in met])
            return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(n * is_title, pa.int64()), pa.array(n * (1 - is_title), pa.int64())], names=["bucket", "title", "other"])

        got = map_slices(rows, run, "bucket int, title long, other long", 8192).groupBy("bucket").agg(F.sum("title").alias("title"), F.sum("other").alias("other")).toPandas()
        counts = np.ones((2, 1 << bits))
        counts[0, got["bucket"]] += got["title"]
        counts[1, got["bucket"]] += got["other"]
        counts /= np.maximum(counts.sum(1, keepdims=True) - (1 << bits), 1)
        weights = np.log(counts[0] / counts[1]).astype(np.float32)
    return weights


def weighed_lines(docs: DataFrame, headings: DataFrame, least_articles: int = LEAST_ARTICLES, bits: int = BITS) -> DataFrame:
    """doc_id, page, line_no, chars, tags, own, titled, mark, score, common: the lines of web pages and what weighs their ratios.

    score: log-odds that the line is a title; common: at least least_articles different articles carry it. Titles are as long as 999
    in 1,000 titles of the collection at most.
    """
    longest = docs.where("title is not null").agg(F.percentile_approx(F.length("title"), 0.999)).first()[0] or 0
    lines = stage(page_lines(docs, headings, longest, bits), "page-lines")
    token = share_arrays(docs.sparkSession, {"weights": title_weights(lines, bits)})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = _scores(batch.column("features"), mapped(token, "weights"))[0]
        names = ["doc_id", "page", "line_no", "chars", "tags", "key", "own", "titled", "mark"]
        return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(score, pa.float32())], names=[*names, "score"])

    pages = lines.where("side = 'page'").select("doc_id", "page", "line_no", "chars", "tags", "key", "own", "titled", "mark", "features")
    scored = map_slices(pages, run, "doc_id long, page long, line_no int, chars int, tags int, key long, own boolean, titled boolean, mark boolean, score float", 8192)
    common = lines.where("key is not null").select("key", "article").distinct().groupBy("key").agg(F.count("*").alias("articles")).where(F.col("articles") >= least_articles).select("key", F.lit(True).alias("common"))
    keyed = scored.where("key is not null").join(common, "key", "left")
    return keyed.unionByName(scored.where("key is null").withColumn("common", F.lit(None).cast("boolean"))).drop("key").withColumn("common", F.coalesce("common", F.lit(False)))


def _page_region(lines: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """(line numbers, in the content region) of the lines of one page, in any order."""
    lines = sorted(lines, key=lambda x: x["line_no"])
    own = np.array([x["own"] for x in lines])
    score = np.array([x["score"] for x in lines])
    if not lines[0]["titled"]:  # without a stored title, the unmarked title before the first long line is the page's own
        first = next((i for i, x in enumerate(lines) if x["chars"] > LONG), len(lines))
        before = [i for i in range(min(first + 1, len(lines))) if score[i] > 0 and not lines[i]["mark"]]
        if before:
            own[before[-1]] = True
    linked = np.where(own, 0, np.maximum(np.array([x["common"] for x in lines]), 1 / (1 + np.exp(-np.clip(score / TEMPER, -30, 30)))))
    region = content_region(np.where(own, LONG, np.array([x["chars"] for x in lines])), np.where(own, 0, np.array([x["tags"] for x in lines])), linked)
    return np.array([x["line_no"] for x in lines]), region | own


def boilerplate(docs: DataFrame, headings: DataFrame, least_articles: int = LEAST_ARTICLES) -> DataFrame:
    """doc_id, line_no of every non-empty line of a web page that is not part of its article.

    headings: text with headings of articles, from which titles are told. The page's own title always stays, all other lines of any length
    stay if they are in the content region (see content_region). Null texts have no rows; a page without content may lose all but
    its title. Different articles are counted by partial distinct sums, so copies of one page in any number count once; a page that
    is repeated under its id is one page. The lines of a page come together in one row, as the page came.
    """
    weighed = weighed_lines(docs, headings, least_articles)
    pages = weighed.groupBy("doc_id", "page").agg(F.collect_set(F.struct("line_no", "chars", "tags", "own", "titled", "mark", "score", "common")).alias("lines")).drop("page")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        docs_out, numbers = [], []
        for doc, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            number, region = _page_region(lines)
            cut = number[~region].tolist()
            docs_out += [doc] * len(cut)
            numbers += cut
        return pa.RecordBatch.from_arrays([pa.array(docs_out, pa.int64()), pa.array(numbers, pa.int32())], names=["doc_id", "line_no"])

    return map_slices(pages, run, "doc_id long, line_no int")


def main_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, text: every web page without the found lines and without empty lines, in order; null texts stay null."""
    cut = found.groupBy("doc_id").agg(F.collect_set("line_no").alias("cut"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: (F.trim(x) != "") & ~F.coalesce(F.array_contains(F.col("cut"), i + 1), F.lit(False)))
    return docs.where("document_type = 'webpage'").select("doc_id", "text").join(cut, "doc_id", "left").select("doc_id", F.array_join(kept, "\n").alias("text"))
