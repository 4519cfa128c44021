"""The pN operators against plain loops over the whole small tables."""

import collections
import re
import unicodedata

import pytest

from scriptorium.llm import queries
from scriptorium.llm.kernels import canon

WORD = re.compile(r"[^\W_]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def runs(text, n=3):
    words = WORD.findall((text or "").lower())
    return len(words), {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def similar_pairs(rows, least, ok=lambda a, b: True):
    sets = [(key, tag, s) for key, tag, text in rows for n, s in [runs(text)] if n >= least]
    return {(min(a, b), max(a, b)) for i, (a, x, s) in enumerate(sets) for b, y, t in sets[:i] if ok(x, y) and len(s & t) >= 0.6 * len(s | t) - 1e-9}


def found(spark, sf_dir, name):
    return {tuple(r) for r in queries.QUERIES[name](spark, sf_dir).collect()}


def test_p1(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/train_balanced.parquet").collect()
    expected = similar_pairs([(r.sample_id, r.split, r.output) for r in rows], 20, lambda a, b: (a == "train") != (b == "train"))
    assert found(spark, sf_dir, "p1_found") == expected
    counts = queries.p1_counts(spark, sf_dir).collect()
    assert sum(r.pairs for r in counts) == len(expected)


def test_p2(spark, sf_dir, docs):
    def key(line):
        return "".join(c for c in line.lower() if not (unicodedata.category(c)[0] in "ZNPS" or c.isspace()))

    lines = [(r.doc_id, i, r.source_id, key(x)) for r in docs.values() if r.text is not None and r.source_id is not None for i, x in enumerate(r.text.split("\n"), 1)]
    met = collections.defaultdict(set)
    for doc, _, source, k in lines:
        met[source, k].add(doc)
    expected = {(doc, i) for doc, i, source, k in lines if any(c.isalpha() for c in k) and len(met[source, k]) >= 5}
    assert found(spark, sf_dir, "p2_found") == expected
    for r in queries.p2_cleaned(spark, sf_dir).collect():
        text = docs[r.doc_id].text
        assert r.text == (None if text is None else "\n".join(x for i, x in enumerate(text.split("\n"), 1) if (r.doc_id, i) not in expected))


def test_p3(spark, sf_dir, docs):
    cut = found(spark, sf_dir, "p3_found")
    pages = {r.doc_id: r for r in queries.p3_main_text(spark, sf_dir).collect()}
    assert set(pages) == {d for d, r in docs.items() if r.document_type == "webpage"} and cut
    for doc, page in pages.items():
        lines = (docs[doc].text or "").split("\n")
        assert all(lines[i - 1].strip() for d, i in cut if d == doc)
        assert (page.text or "").split("\n") == ([x for i, x in enumerate(lines, 1) if x.strip() and (doc, i) not in cut] or [""])
        own = (docs[doc].title or "").strip()
        assert not own or all(lines[i - 1].strip() != own for d, i in cut if d == doc)


def test_p4(spark, sf_dir, docs):
    expected = similar_pairs([(r.doc_id, None, canon(r.text)) for r in docs.values() if r.text], 30)
    assert found(spark, sf_dir, "p4_found") == expected
    groups = {r.doc_id: r.group_id for r in queries.p4_groups(spark, sf_dir).collect()}
    assert all(groups[a] == groups[b] for a, b in expected)
    assert len(set(groups.values())) < len(groups)


def test_p5(spark, sf_dir, docs):
    rows = queries.p5_lines(spark, sf_dir).collect()
    assert all(0 <= r.confidence <= 1 for r in rows)
    lines = [r for r in rows if r.line_no]
    short = {r.doc_id for r in rows if not r.line_no}
    assert all(max(map(len, docs[d].text.split("\n"))) < 100 for d in short) and short.isdisjoint(r.doc_id for r in lines)
    hangul = [r for r in lines if len(re.findall("[가-힣]", docs[r.doc_id].text.split("\n")[r.line_no - 1])) > 50]
    kana = [r for r in lines if len(re.findall("[ぁ-ゟ]", docs[r.doc_id].text.split("\n")[r.line_no - 1])) > 50]
    assert {r.lang for r in hangul} == {"ko"} and {r.lang for r in kana} == {"ja"}
    assert sum(r.lang is not None for r in lines) > 0.95 * len(lines)  # a language of a handful of documents is none
    by_doc = collections.defaultdict(set)
    for r in lines:
        if r.lang:
            by_doc[r.doc_id].add(r.lang)
    plain = {d: re.sub("[^a-z].*", "", (docs[d].lang or "").strip().lower()) for d in by_doc}
    sure = [d for d in by_doc if plain[d] in ("en", "ko", "de", "fr", "es", "ja")]
    assert sum(plain[d] in by_doc[d] for d in sure) > 0.9 * len(sure)  # some labels are wrong
    expected = {(d, lang) for d, langs in by_doc.items() for lang in langs if langs != {plain[d]}}
    assert found(spark, sf_dir, "p5_found") == expected


def test_p6(spark, sf_dir):
    items = {("chunk", r.id): r.content for r in spark.read.parquet(f"{sf_dir}/chunks.parquet").collect()} | {("paper", r.id): r.body for r in spark.read.parquet(f"{sf_dir}/papers.parquet").collect()}
    assert found(spark, sf_dir, "p6_found") == {k for k, t in items.items() if t is not None and len(t) > 3000}
    parts = collections.defaultdict(list)
    for r in queries.p6_pieces(spark, sf_dir).collect():
        parts[r.item_kind, r.item_id].append(r)
    assert set(parts) == {k for k, t in items.items() if t is not None}
    for key, rows in parts.items():
        rows.sort(key=lambda r: r.piece_no)
        text, end = items[key], 0
        for r in rows:
            assert r.content == text[r.start : r.start + len(r.content)] and len(r.content) <= 3000 and end - 250 <= r.start <= end
            end = r.start + len(r.content)
        assert end == len(text) and [r.piece_no for r in rows] == list(range(1, len(rows) + 1))


def test_p7(spark, sf_dir, docs):
    fixed = {(r.doc_id, r.field): r for r in queries.p7_restored(spark, sf_dir).collect()}
    assert found(spark, sf_dir, "p7_found") == set(fixed)
    assert all(k in fixed for k in ((d, f) for d, r in docs.items() for f in ("text", "title") if "�" in (r[f] or "")))
    assert not any(re.search("Ã[\u0080-¿]", r.restored) for r in fixed.values() if r.complete)


def test_p8(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, sf_dir).collect()}
    assert got == {d: tokenizer.encode(r.text or "", add_special_tokens=False).ids for d, r in docs.items()}


def test_p9(spark, sf_dir, docs):
    at = collections.defaultdict(set)
    for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").collect():
        words = WORD.findall((r.text or "").lower())
        for i in range(len(words) - 11):
            at[tuple(words[i : i + 12])].add(r.item_id)
    expected = set()
    for r in docs.values():
        words = WORD.findall((r.text or "").lower())
        expected |= {(r.doc_id, item) for i in range(len(words) - 11) for item in at.get(tuple(words[i : i + 12]), ())}
    assert found(spark, sf_dir, "p9_found") == expected
    for r in queries.p9_cleaned(spark, sf_dir).collect():
        words = WORD.findall((r.text or "").lower())
        assert r.removed_chars == len(docs[r.doc_id].text or "") - len(r.text or "")
        assert (r.removed_chars > 0) == (r.doc_id in {d for d, _ in expected})


def test_p10(spark, sf_dir, docs):
    forms = collections.defaultdict(list)
    for r in docs.values():
        if r.text is not None:
            forms[canon(r.text)].append(r)
    expected = {(min(a.doc_id, b.doc_id), max(a.doc_id, b.doc_id)) for rs in forms.values() for i, a in enumerate(rs) for b in rs[:i] if a.text != b.text}
    assert found(spark, sf_dir, "p10_found") == expected
    for r in queries.p10_consistent(spark, sf_dir).collect():
        text = docs[r.doc_id].text
        assert r.text == (None if text is None else canon(text, by_context=True)) and r.changed == (r.text != text)
    groups = {r.doc_id: r for r in queries.p10_groups(spark, sf_dir).collect()}
    assert set(groups) == {d for pair in expected for d in pair}
    assert sum(r.links for r in groups.values()) == 2 * len(expected)
