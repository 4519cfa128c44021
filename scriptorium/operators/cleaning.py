"""Cleaning of pages and of lines of text, in built-in functions over arrays of lines; only entities are decoded in Python."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions.dates import page_date
from scriptorium.storage import per_value, ship

# Elements that hold no content.
NOISE = ("script", "style", "nav", "header", "footer", "aside", "form", "iframe")
# Beginnings of lines with which the lists below an article begin.
FOOTERS = ("최신 기사", "주간 인기 기사", "많이 본 뉴스", "인터넷 신문 등록 번호")
# Lines that belong to a site, not to an article.
LINE_PATTERNS = (
    r"^.{0,20}(기자|특파원|인턴기자)\s*\([^()\n]{0,60}@[^()\n]{0,60}\)\s*$",
    r"^입력\s*\d{4}[.\-]\d{2}[.\-]\d{2}\.?\s*\d{1,2}:\d{2}(\s*수정\s*\d{4}[.\-]\d{2}[.\-]\d{2}\.?\s*\d{1,2}:\d{2})?\s*$",
    r"^구글\s*검색\s*선호\s*출처로\s*추가.*$",
    r"^공유하기\b.*(카카오톡|페이스북|트위터|블로그|URL\s*복사|주소\s*복사).*$",
    r"^(카카오톡|페이스북|트위터|블로그|URL\s*복사|주소\s*복사|X)$",
    r"^(?:이전\s*기사\s*보기|다음\s*기사\s*보기)(?:\s+(?:이전\s*기사\s*보기|다음\s*기사\s*보기))*\s*$",
    r"^\[\s*사진\s*[:：]?\s*[^\[\]\n]{0,80}\]\s*(◆.{0,40})?$",
    r"^(제목|담당부서|담당자|등록일|작성일|작성자|수정일|조회수|조회|첨부문서|첨부파일|미리보기|다운로드|이전글|다음글|이전\s*글|다음\s*글|목록|목록으로|인쇄|공유하기)\s*$",
    r"^Loading\.\.\.$",
    r"^.{0,60}is the result of applying Google Translate\.",
)
# Names of controls, shapes of further ones, the shape of a menu's word, marks that a menu has not.
WIDGETS = ("댓글", "좋아요", "싫어요", "슬퍼요", "화나요", "후속요청", "공감", "비공감", "최고예요", "응원해요", "북마크", "스크랩", "공유", "공유하기", "페이스북", "메신저", "트위터", "카카오톡", "네이버", "밴드", "닫기", "복사", "프린트", "제보", "폰트", "글자크기", "본문")
WIDGET_SHAPES = r"^\d단계$|^\d+px$|^URL이?$|^복사(되었습니다|됨)\.?$"
MENU_WORD = "^[가-힣A-Za-z0-9]{1,8}(/[가-힣A-Za-z0-9]{1,8})?$"
MENU_LINE_MARKS = """[.!?"'“”「」]"""


def escaped(c: Column) -> Column:
    """Text as it is written in a page."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def decoded(c: Column) -> Column:
    """Text with its entities read once, as HTML 5 has them: &amp;lt; gives &lt;."""
    return per_value(unescape, "string")(c)


def without_noise(html: Column) -> Column:
    """The page without comments and without elements that hold no content."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in NOISE:
        out = F.regexp_replace(out, f"(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>", "")
    return out


def scope(html: Column, elements: tuple[str, ...] = ("article", "main", "body")) -> Column:
    """The inside of the first of the elements that the page has, else the page."""
    ways = [F.nullif(F.regexp_extract(html, f"(?is)<{e}\\b[^>]*>(.*)</{e}\\s*>", 1), F.lit("")) for e in elements]
    return F.coalesce(*ways, html)


def plain_lines(html: Column) -> Column:
    """Text with a line break at every tag; lines are trimmed and empty ones left out."""
    lines = F.split(decoded(F.regexp_replace(html, "<[^>]*>", "\n")), "\n")
    return F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), "\n")


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(decoded(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def page_text(html: Column) -> Column:
    return plain_lines(scope(without_noise(html)))


def substitute(c: Column, table: list[tuple[str, str]]) -> Column:
    """A table of patterns, applied in order."""
    for pattern, to in table:
        c = F.regexp_replace(c, pattern, to)
    return c


def before_marker(lines: Column, markers: list[str]) -> Column:
    """Lines before the first one that starts with a marker; all if none does."""
    hit = F.transform(lines, lambda x: F.exists(F.array(*map(F.lit, markers)), lambda m: F.startswith(F.trim(x), m)))
    at = F.array_position(hit, True)
    return F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)


def _words(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), "[ \t]+"), lambda w: w != "")


def is_menu(line: Column) -> Column:
    """Six or more words, each short and of letters and digits (two with a slash between count as one), and no sentence mark."""
    words = _words(line)
    return (F.size(words) >= 6) & F.forall(words, lambda w: w.rlike(MENU_WORD)) & ~line.rlike(MENU_LINE_MARKS)


def is_widget(line: Column, words: list[str], share: float = 0.6) -> Column:
    """Three or more words, most of them names of controls (in any case) or of their shapes."""
    given = _words(line)
    known = F.filter(given, lambda w: F.lower(w).isin(*words) | w.rlike(WIDGET_SHAPES))
    return (F.size(given) >= 3) & (F.size(known) / F.greatest(F.size(given), F.lit(1)) >= share)


def keep_lines(lines: Column, patterns: list[str], widgets: list[str]) -> Column:
    """Lines that, trimmed, match no pattern and are neither menus nor controls."""
    bad = lambda x: F.coalesce(F.exists(F.array(*map(F.lit, patterns)), lambda p: F.regexp_like(F.trim(x), p)) | is_menu(x) | is_widget(x, widgets), F.lit(False))
    return F.filter(lines, lambda x: ~bad(x))


# Marks that a line of a menu has not, a line that only separates, the end of a sentence, a sign of gossip lines.
MENU_MARKS = """[.!?"'“”「」,]"""
SEPARATOR = re.compile(r"^[|•·»▶>\-–—]+$")
SENTENCE_END = re.compile(r"""[.!?:;"'”’)\]』」]\s*$""")
HEART = "♥"


def menu_runs(docs: DataFrame, least: int = 8, longest: int = 20) -> DataFrame:
    """doc_id, first, last, n of each run of `least` or more short lines without sentence marks; blank lines don't end a run. Lines count from 1.

    Windows are per document, so a task holds one document's lines at a time.
    """
    lines = docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    solid = lines.withColumn("line", F.trim("line")).where("line <> ''")
    w = W.partitionBy("doc_id").orderBy("i")
    menu = (F.length("line") <= longest) & ~F.col("line").rlike(MENU_MARKS)
    runs = solid.withColumn("menu", menu).withColumn("breaks", F.sum((~F.col("menu")).cast("int")).over(w)).where("menu")
    return runs.groupBy("doc_id", "breaks").agg((F.min("i") + 1).alias("first"), (F.max("i") + 1).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("breaks")


def _outside_runs(lines: list[str], least: int, longest: int) -> list[str]:
    kept, run, solid = [], [], 0
    for line in [*lines, None]:
        text = None if line is None else line.strip()
        if text == "" or text and len(text) <= longest and not re.search(MENU_MARKS, text):
            run.append(line)
            solid += text != ""
            continue
        kept += [] if solid >= least else run
        run, solid = [], 0
        if line is not None:
            kept.append(line)
    return kept


def without_menu_runs(c: Column, least: int = 8, longest: int = 20) -> Column:
    """The text without its runs of `least` or more short lines without sentence marks, blank lines among and beside them included."""
    return per_value(lambda t: "\n".join(_outside_runs(t.split("\n"), least, longest)), "string")(c)


def _joined(lines: list[str], most: int) -> str:
    out, parts, size = [], [], 0
    for line in lines:
        line = line.strip()
        if not line or SEPARATOR.match(line):
            out += [" ".join(parts)] if parts else []
            out.append("")
            parts, size = [], 0
            continue
        size += len(line) + bool(parts)
        parts.append(line)
        if size >= most or SENTENCE_END.search(line):
            out.append(" ".join(parts))
            parts, size = [], 0
    return "\n".join(out + ([" ".join(parts)] if parts else []))


def reflow(c: Column, most: int = 400) -> Column:
    """Broken lines joined until a sentence ends or the line reaches `most` characters; blank lines and lines of separators, which become blank, end a paragraph."""
    return per_value(lambda t: _joined(t.split("\n"), most), "string")(c)


def clean_lines(df: DataFrame, column: str, markers: list[str], patterns: list[str], widgets: list[str], least: int = 8, longest: int = 20, most: int = 400) -> DataFrame:
    """df with the column's texts under all rules for lines, in their order: cut at the first footer marker, drop gossip, boilerplate, menu and
    control lines (built-in functions), then drop runs of menu lines and join broken lines (a helper on Arrow batches).

    Joining comes last: a dropped line would else have been joined to a real one. Null stays null, an empty text empty.
    """
    lines = before_marker(F.split(column, "\n", -1), markers)
    lines = keep_lines(F.filter(lines, lambda x: ~F.contains(x, F.lit(HEART))), patterns, widgets)
    kept = df.withColumn(column, F.array_join(lines, "\n"))

    def run(batches):
        for batch in batches:
            texts = [None if t is None else _joined(_outside_runs(t.split("\n"), least, longest), most) for t in batch.column(column).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(texts, pa.string()))

    ship(df.sparkSession)
    return kept.mapInArrow(run, kept.schema)


def page_records(pages: DataFrame, html: str, markers: list[str], patterns: list[str], widgets: list[str]) -> DataFrame:
    """Adds published, title, text of a page: its date is read first, as scripts carry it; then elements without content go, the article is scoped, its lines are cleaned."""
    read = pages.withColumns({"published": page_date(F.col(html)), "title": page_title(F.col(html)), "text": page_text(F.col(html))})
    return clean_lines(read, "text", markers, patterns, widgets)


def split_sections(text: Column) -> Column:
    """struct(introduction, body, conclusion, status) by numbered or named headings of their own lines.

    exact if an introduction and a conclusion are headed, partial if one is, else unparsed. Without a heading behind the introduction, it
    ends after 2,500 characters or 15 %, whichever is more.
    """
    at = lambda names: F.regexp_instr(text, F.lit(f"(?im)^[ \\t]*(?:[0-9ivx]+[.)]?[ \\t]*)?(?:{names})[ \\t]*$"))
    intro, end = at("introduction|서론|einleitung|introducción"), at("conclusions?|concluding remarks|결론|fazit|conclusión")
    rest = F.substring(text, F.greatest(intro, F.lit(1)), F.length(text))
    further = F.regexp_instr(F.substring(rest, F.lit(20), F.length(rest)), F.lit("(?m)^[ \\t]*[0-9]+[.)][ \\t]+[^\\n]{3,80}$"))
    cut = F.when(further > 0, F.greatest(intro, F.lit(1)) + 18 + further).otherwise(F.greatest(intro, F.lit(1)) + F.greatest(F.lit(2500), F.floor(F.length(text) * 0.15).cast("int")))
    stop = F.when(end > 0, end).otherwise(F.length(text) + 1)
    cut = F.least(cut, stop)
    piece = lambda a, b: F.trim(F.substring(text, a, F.greatest(b - a, F.lit(0))), F.lit(" \n"))
    status = F.when((intro > 0) & (end > 0), "exact").when((intro > 0) | (end > 0), "partial").otherwise("unparsed")
    return F.struct(piece(F.greatest(intro, F.lit(1)), cut).alias("introduction"), piece(cut, stop).alias("body"), F.when(end > 0, piece(end, F.length(text) + 1)).alias("conclusion"), status.alias("status"))
