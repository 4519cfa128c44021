"""Scalar text functions: Column -> Column, all built in and null-safe (null stays null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = "[ \\t\\n\\r\\f\\x0b]"
HANGUL = "[가-힣]"
CJK = "[぀-ヿ㐀-䶿一-鿿가-힣]"


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def content_hash(c: Column) -> Column:
    return F.sha2(F.lower(squeeze(c)), 256)


def normalize_name(c: Column) -> Column:
    """Trimmed, lower case, white space to underscores, everything but letters, digits and underscores removed."""
    return F.regexp_replace(F.regexp_replace(F.lower(squeeze(c)), " ", "_"), "[^\\p{L}\\p{N}_]", "")


def normalize_lines(c: Column) -> Column:
    """Runs of blanks and tabs become one blank, more than two line breaks become two, ends are trimmed."""
    out = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.regexp_replace(out, f"^{WS}+|{WS}+$", "")


def or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))


def has_hangul(c: Column) -> Column:
    return c.rlike(HANGUL)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def script_language(c: Column, head: int | None = None) -> Column:
    """'ko' if a Hangul syllable stands in the (head of the) text, else 'en'; null counts as no text."""
    part = F.coalesce(F.substring(c, 1, head) if head else c, F.lit(""))
    return F.when(has_hangul(part), "ko").otherwise("en")


def hangul_share(c: Column) -> Column:
    """Hangul syllables among the characters that are no white space; 0 for a text without such characters."""
    solid = F.length(F.regexp_replace(c, WS, ""))
    return F.when(solid == 0, 0.0).otherwise(F.length(F.regexp_replace(c, "[^가-힣]", "")) / solid)


def proper_nouns(c: Column) -> Column:
    """Runs of capitalized words of two or more characters, three characters in all, without common words, first spelling each."""
    word = "[A-Z][A-Za-z0-9&.'-]{1,}"
    found = F.regexp_extract_all(c, F.lit(f"(?<![A-Za-z0-9_])({word}(?:{WS}+{word})*)"), F.lit(1))
    # Capitalized words that are no names.
    stop = ("v", "vs", "inc", "co", "ltd", "llc", "the", "a", "an", "of", "and")
    kept = F.filter(found, lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(*stop))
    return F.filter(kept, lambda x, i: F.array_position(F.transform(kept, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def short_id(c: Column) -> Column:
    """Last segment of a path, cut at the first v."""
    return F.split_part(F.substring_index(c, "/", -1), F.lit("v"), F.lit(1))


def preprint_id(c: Column) -> Column:
    """The id in the address of a preprint's abstract page or in its DOI, without version; null where there is none."""
    found = F.regexp_extract(c, r"(?i)(?:arxiv\.org/abs/|48550/arxiv\.)([A-Za-z0-9_.\-]+)", 1)
    return F.nullif(F.regexp_replace(found, "v[0-9]+$", ""), F.lit(""))


def url_host(c: Column) -> Column:
    """Host of a URL in lower case without a leading www.; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(c)), "^[a-z]+://([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(host, "^www\\.", ""), F.lit(""))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]+", "_")


def clean_extracted(c: Column) -> Column:
    """Text taken from page images: NUL to blank, line ends unified, hyphenated words joined, blank lines capped."""
    out = F.regexp_replace(F.translate(c, "\x00", " "), "\\r\\n?", "\n")
    out = F.regexp_replace(out, "([A-Za-z])-\\n([a-z])", "$1$2")
    out = F.regexp_replace(out, "[ \\t]*\\n[ \\t]*", "\n")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), "\\n{3,}", "\n\n"), f"^{WS}+|{WS}+$", "")


def heading_key(c: Column) -> Column:
    """Heading without its number, in lower case, without white space."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, f"^{WS}*[0-9]+[.)]{WS}*", "")), WS, "")


def citation_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), "^\\[+|\\]+$", ""))


def plain_markup(c: Column) -> Column:
    """Generated text without code fences, tags, entities of markup, zero-width characters and lines of lone numbers."""
    out = c
    # The entities of markup.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.translate(out, " ​‌‍﻿", " ")
    out = F.regexp_replace(out, "```[a-z]*", "")
    out = F.regexp_replace(out, "</?[A-Za-z][^<>]*>", "")
    out = F.regexp_replace(out, "(?m)^[ \\t]*[0-9]+[ \\t]*$", "")
    return normalize_lines(out)


def plain_draft(c: Column) -> Column:
    """Draft text without heading marks, list marks, links, DOIs and numbered citations."""
    out = F.regexp_replace(c, "(?m)^[ \\t]*#+[ \\t]*", "")
    out = F.regexp_replace(out, "(?m)^[ \\t]*(?:[-*•]|[0-9]+[.)]|[IVX]+\\.)[ \\t]+", "")
    out = F.regexp_replace(out, "https?://[^ \\t\\n]+", "")
    out = F.regexp_replace(out, "10\\.[0-9]{4,9}/[^ \\t\\n]+", "")
    return squeeze(F.regexp_replace(out, "\\[[0-9, -]+\\]", ""))


def sentences(c: Column) -> Column:
    """Sentences: cut at white space behind . ! ? and at line breaks; empty ones left out."""
    marked = F.regexp_replace(c, f"([.!?]){WS}+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n+"), lambda x: F.trim(x)), lambda x: x != "")


def foreign_sentences(c: Column, least: int = 40) -> Column:
    """Number of sentences of `least` or more characters without a Hangul syllable."""
    return F.size(F.filter(sentences(c), lambda x: (F.length(x) >= least) & ~has_hangul(x)))


def slices(c: Column, width: int) -> Column:
    """Consecutive pieces of `width` characters; an empty text has none."""
    n = F.ceil(F.length(c) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def whole_sentences(c: Column, limit: int) -> Column:
    """The text up to `limit` characters, cut behind the last sentence end, else before the last blank, else hard."""
    head = F.substring(c, 1, limit)
    sentence = F.regexp_extract(head, "^((?s).*[.!?])(?:[ \\t\\n]|$)", 1)
    words = F.regexp_extract(head, "^((?s).*) ", 1)
    return F.when(F.length(c) <= limit, c).otherwise(F.coalesce(F.nullif(sentence, F.lit("")), F.nullif(words, F.lit("")), head))


def _last(text: Column, mark: str) -> Column:
    """Characters up to and without the last `mark`; 0 if it is not there."""
    at = F.instr(F.reverse(text), mark[::-1])
    return F.when(at == 0, 0).otherwise(F.length(text) - at - len(mark) + 1)


def boundary_trim(c: Column, limit: int) -> Column:
    """Cut at a paragraph in the last tenth, else at a Korean sentence end in the last 15 %, else at a full stop in the last 30 %, else hard; trimmed."""
    c = F.regexp_replace(c, f"^{WS}+|{WS}+$", "")
    head = F.regexp_replace(F.substring(c, 1, limit), f"{WS}+$", "")
    paragraph, korean, stop = _last(head, "\n\n"), _last(head, "다."), _last(head, ".")
    cut = F.when(paragraph >= int(0.9 * limit), F.substring(head, F.lit(1), paragraph)).when(korean >= int(0.85 * limit), F.substring(head, F.lit(1), korean + 2)).when(stop >= int(0.7 * limit), F.substring(head, F.lit(1), stop + 1))
    return F.when(F.length(c) <= limit, c).otherwise(F.regexp_replace(F.coalesce(cut, head), f"^{WS}+|{WS}+$", ""))


def broken_words(c: Column) -> Column:
    """Signs of torn text: two stray single letters (not a, i), or two runs of three words of one or two letters."""
    stray = F.regexp_count(c, F.lit("(?:^| )[b-hj-zB-HJ-Z](?= |$)")) >= 2
    return stray | (F.regexp_count(c, F.lit("(?:^| )[A-Za-z]{1,2} [A-Za-z]{1,2} [A-Za-z]{1,2}(?= |$)")) >= 2)


def matches_any(c: Column, patterns: list[str]) -> Column:
    """Whether one of a table of case-insensitive patterns is found."""
    return F.exists(F.array(*[F.lit("(?i)" + p) for p in patterns]), lambda p: F.regexp_like(c, p))


def unfence(c: Column) -> Column:
    """The inside of a fenced code block, else the trimmed text."""
    inside = F.regexp_extract(c, "(?s)```[a-z]*\\n(.*?)```", 1)
    return F.trim(F.coalesce(F.nullif(inside, F.lit("")), c), F.lit(" \n"))


def without_heading(content: Column, heading: Column) -> Column:
    """Content without a first line that repeats the heading."""
    first = F.substring_index(content, "\n", 1)
    rest = F.substring(content, F.length(first) + 2, F.length(content))
    return F.when(heading_key(first) == heading_key(heading), F.trim(rest)).otherwise(content)


def known_citations(content: Column, known: Column) -> Column:
    """Bracketed ids stay only if known (an array); a blank before punctuation goes."""
    parts = F.regexp_extract_all(content, F.lit("([^\\[]+|\\[[^\\]]*\\]?)"), F.lit(1))
    kept = F.filter(parts, lambda p: ~p.startswith("[") | F.array_contains(known, F.regexp_replace(p, "^\\[|\\]$", "")))
    return F.regexp_replace(F.array_join(kept, ""), " +([.,;:!?])", "$1")


def without_bibliography(c: Column) -> Column:
    """The text before a line that heads a bibliography."""
    at = F.regexp_instr(c, F.lit("(?im)^[ \\t]*(?:references|bibliography|참고문헌)[ \\t]*:?[ \\t]*$"))
    return F.when(at > 0, F.trim(F.substring(c, F.lit(1), at - 1), F.lit(" \n"))).otherwise(c)


def snippet(c: Column, width: int = 300) -> Column:
    return F.translate(F.substring(c, 1, width), "\n", " ")


def unquote(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), "^[\"'“”‘’]+|[\"'“”‘’]+$", ""))


def after_mark(c: Column, mark: str) -> Column:
    """The text behind the first `mark`, trimmed; the whole text where it isn't found."""
    at = F.locate(mark, c)
    return F.when(at > 0, F.trim(F.substring(c, at + len(mark), F.length(c)))).otherwise(c)


def joined_or_null(names: Column, sep: str = ", ") -> Column:
    return F.nullif(F.array_join(F.filter(names, lambda x: F.trim(x) != ""), sep), F.lit(""))
