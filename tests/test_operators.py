"""Operators that SQL can't express, against plain loops; and edge cases."""

import datetime
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import arrays, dates
from scriptorium.functions import text as T
from scriptorium.operators import chunking, cleaning, dedupe, matching, records, training, validation
from scriptorium.plans import retrieval
from scriptorium.sources import readers, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ",".join(f"{k} string" for k in values))
    return row.repartition(1).select(column.alias("x")).first()[0]


def grams(title):
    import regex

    return {("  " + w + " ")[i : i + 3] for w in regex.findall(r"[\p{L}\p{N}]+", title.lower()) for i in range(len(w) + 1)}


def sequential(rows):
    kept, out = [], {}
    for r in sorted(rows, key=lambda r: (r["created_at"] or datetime.datetime(1970, 1, 1), r["doc_id"])):
        near = lambda k: k["document_type"] == r["document_type"] is not None and r["title"] is not None is not k["title"] and (k["title"] == r["title"] or (grams(k["title"]) and len(grams(k["title"]) & grams(r["title"])) > 0.6 * len(grams(k["title"]) | grams(r["title"]))))
        if r["content_hash"] is not None and any(k["content_hash"] == r["content_hash"] for k in kept):
            out[r["doc_id"]] = "duplicate"
        elif any(k["title"] is not None and near(k) for k in kept):
            out[r["doc_id"]] = "near_duplicate"
        elif not r["relevant"]:
            out[r["doc_id"]] = "irrelevant"
        else:
            out[r["doc_id"]] = "inserted"
            kept.append(r)
    return out


ARRIVALS = "doc_id long, created_at timestamp, content_hash string, document_type string, title string, relevant boolean"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_acceptance_equals_the_sequential_loop(spark, seed):
    rnd = random.Random(seed)
    words = ["red", "green", "blue", "white", "black"]
    rows = []
    for i in range(60):
        rows.append((i, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rnd.randrange(20)), rnd.choice(["h1", "h2", "h3", "h4", None, f"u{i}"]), rnd.choice(["a", "b", None]), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 6)))]), rnd.random() < 0.7))
    names = [c.split()[0] for c in ARRIVALS.split(", ")]
    expected = sequential([dict(zip(names, r)) for r in rows])
    df = spark.createDataFrame(rows, ARRIVALS)
    assert dict(dedupe.acceptance(df).collect()) == expected
    first = df.where("created_at < timestamp'2024-01-01 10:00:00'")
    before = dict(dedupe.acceptance(first).collect())
    known = first.where(F.col("doc_id").isin([k for k, v in before.items() if v == "inserted"]))
    after = dict(dedupe.acceptance(df.where("created_at >= timestamp'2024-01-01 10:00:00'"), known).collect())
    assert before | after == expected


def test_intake_by_files_equals_the_whole(spark, sf_dir):
    from scriptorium import catalog

    assert dict(catalog.QUERIES["incremental_intake"](spark, sf_dir).collect()) == dict(catalog.QUERIES["intake_statuses"](spark, sf_dir).collect())


def test_keep_first_leaves_null_keys_and_takes_ties_by_order(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 5), (None, 6)], "k string, o int")
    assert sorted(map(tuple, dedupe.keep_first(df, "k", ["o"]).collect()), key=str) == sorted([("a", 1), (None, 5), (None, 6)], key=str)
    assert dedupe.keep_first(df.limit(0), "k", ["o"]).count() == 0


@given(n=st.integers(0, 60), size=st.integers(1, 12), overlap=st.integers(0, 12))
@settings(max_examples=15, deadline=None)
def test_word_windows_equal_the_loop(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    step, expected, at = max(size - overlap, 1), [], 0
    while at < n:
        expected.append(" ".join(words[at : at + size]))
        if at + size >= n:
            break
        at += step
    assert one(spark, chunking.word_windows(F.col("t"), size, overlap), t="  ".join(words)) == expected


def test_failed_embeddings_leave_nulls(spark):
    def provider(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no answer")
        return chunking.hashed_vectors(texts)

    df = spark.createDataFrame([("good",), ("bad",), (None,), (" ",)], "t string").coalesce(1)
    rows = {r.t: r for r in chunking.embed(df, "t", provider, batch=1, pause=0.01).collect()}
    assert len(rows["good"].embedding) == 64 and rows["good"].embedding_error is None
    assert rows["bad"].embedding is None and rows["bad"].embedding_error == "no answer"
    assert rows[None].embedding is None and rows[" "].embedding is None


def test_budget_skips_what_does_not_fit(spark):
    df = spark.createDataFrame([(1, 0, 40), (1, 1, 70), (1, 2, 60)], "query_id long, pos int, size int")
    assert [(r.pos, r.used) for r in validation.within_budget(df, 100).orderBy("pos").collect()] == [(0, 100), (2, 100)]


@pytest.mark.parametrize("n,most", [(0, 5), (1, 5), (5, 5), (6, 5), (11, 5), (100, 5), (9, 1)])
def test_even_positions(spark, n, most):
    expected = list(range(n)) if n <= most else [(n - 1) // 2] if most == 1 else [round(i * (n - 1) / (most - 1)) for i in range(most)]
    if n:
        assert spark.range(1).select(training.even_positions(F.lit(n), most)).first()[0] == expected


def test_masked_labels(spark):
    ids = F.array(*[F.lit(i) for i in range(12)])
    row = spark.range(1).select(training.masked_labels(ids, F.lit(3)), training.masked_labels(ids, F.lit(6))).first()
    assert row[0] == [-100] * 3 + list(range(3, 12)) and row[1] == [-100] * 12


def test_containing_equals_the_loop(spark):
    texts = spark.createDataFrame([(1, "The Cat sat"), (2, "concatenate"), (3, None), (4, "")], "id long, text string")
    patterns = spark.createDataFrame([("CAT",), ("at s",), ("",), (None,)], "pattern string")
    assert sorted(map(tuple, matching.containing(texts, patterns).collect())) == [(1, "at s"), (1, "cat"), (2, "cat")]
    assert matching.containing(texts, patterns.limit(0)).count() == 0


def test_nearest_is_exact(spark):
    rnd = np.random.default_rng(1)
    m = rnd.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(999, None)], "id long, vector array<double>")
    got = matching.nearest(df, df.where("id % 50 = 0"), 7, block=64).collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        expected = sorted((round(1 - u[q] @ u[i], 9), i) for i in range(300))[:7]
        assert [r.row_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for _, i in expected]


def test_diverse_takes_types_in_turn(spark):
    rows = [(1, "a", 10, "news", 1), (1, "b", 10, "news", 2), (1, "c", 11, "news", 3), (1, "d", 12, "law", 4)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, document_id long, document_type string, pos int")
    assert [r.chunk_id for r in retrieval.diverse(df, 4).orderBy("place").collect()] == ["a", "d", "c", "b"]


def test_fusion_counts_a_doubled_list_as_one_channel(spark):
    ranked = spark.createDataFrame([(1, "a", 1)], "query_id long, chunk_id string, rank int")
    row = retrieval.fuse([("x", 2, ranked), ("y", 1, ranked)]).first()
    assert row.score == pytest.approx(3 / 61) and row.channel_count == 2 and row.active == 2


def test_texts(spark):
    t = F.col("t")
    assert one(spark, T.normalize_name(t), t="  Suno  ") == "suno"
    assert one(spark, T.normalize_name(t), t="빅 Entertainment!") == "빅_entertainment"
    assert one(spark, T.proper_nouns(t), t="Concord Music Group v ABKCO and Concord music GROUP") == ["Concord Music Group", "ABKCO", "Concord", "GROUP"]
    assert one(spark, T.whole_sentences(t, 12), t="One two. Three four.") == "One two."
    assert one(spark, T.whole_sentences(t, 9), t="One two three") == "One two"
    assert one(spark, T.unfence(t), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.without_bibliography(t), t="End.\nReferences\n[1]") == "End."
    assert one(spark, T.known_citations(t, F.array(F.lit("a"))), t="x [a] y [b] .") == "x [a] y."
    assert one(spark, T.plain_markup(t), t="```html\n<b>A &amp; B</b>\n12\nC​```") == "A & B\n\nC"
    assert one(spark, T.broken_words(t), t="x y of text") is True and one(spark, T.broken_words(t), t="a text I read") is False
    assert one(spark, T.boundary_trim(t, 10), t="A bc. Def ghi jkl") == "A bc. Def"
    assert one(spark, T.boundary_trim(t, 20), t="First one. Second one is. longer") == "First one. Second on"
    assert one(spark, T.boundary_trim(t, 20), t="가나다라마바사아자차카타파하 갔다. 그리고 또") == "가나다라마바사아자차카타파하 갔다."
    assert one(spark, T.preprint_id(t), t="http://arXiv.org/abs/2403.01234v2") == "2403.01234" and one(spark, T.preprint_id(t), t="https://doi.org/10.48550/arXiv.2401.5") == "2401.5" and one(spark, T.preprint_id(t), t="https://a.example/2403.01234") is None
    assert one(spark, T.safe_name(t), t="a/b c.pdf") == "a_b_c.pdf"
    for f in (T.content_hash, T.normalize_name, T.normalize_lines, T.sentences, T.url_host, T.heading_key, T.plain_draft, T.unquote):
        assert one(spark, f(t), t=None) is None


def test_dates(spark):
    t = F.col("t")
    day = datetime.date
    assert one(spark, dates.mail_date(t), t="Tue, 02 Jan 2024 23:30:00 +0900") == day(2024, 1, 2)
    assert one(spark, dates.any_date(t), t="2024.13.01") is None
    assert one(spark, dates.path_date(t), t="https://a.example/2024/2/30/x") is None
    assert one(spark, dates.path_date(t), t="https://a.example/2024/2/29/x") == day(2024, 2, 29)
    assert one(spark, dates.id_month(t), t="2413.01234") is None
    assert one(spark, dates.page_date(t), t='<meta property="article:published_time" content="nope"><time class="x" datetime="2024-05-06">') == day(2024, 5, 6)
    assert one(spark, dates.page_date(t), t='<meta itemprop="datePublished" content="2020-01-01"><meta content=\'2021-02-02T00:00\' name="publish-date">') == day(2021, 2, 2)
    linked = '<script type="application/ld+json">{"@graph": [{"uploadDate": "2019-01-01", "x": {"y": 1}}, {"dateCreated": "2018-01-01"}], "dateCreated": "no"}</script>'
    assert one(spark, dates.page_date(t), t=linked) == day(2019, 1, 1)
    assert one(spark, dates.page_date(t), t='<script>{"datePublished": "2017-01-01"}</script><script type="application/ld+json">broken</script><script type="application/ld+json">[{"a": 1}, {"datePublished": "2016-03-04T05:06"}]</script>') == day(2016, 3, 4)
    assert one(spark, dates.page_date(t), t='<meta name="modified_time" content="2015-01-02"><meta name="description" content="2014-01-01">') == day(2015, 1, 2)
    assert one(spark, dates.page_date(t), t="<p>2015-01-02</p>") is None and one(spark, dates.page_date(t), t=None) is None


def test_json_and_xml(spark):
    t = F.col("t")
    assert one(spark, arrays.one_or_many(t, "struct<a:int>"), t='{"a": 1}') == [(1,)]
    assert one(spark, arrays.one_or_many(t, "struct<a:int>"), t='[{"a": 1}, {"a": 2}]') == [(1,), (2,)]
    assert one(spark, arrays.one_or_many(t, "struct<a:int>"), t="?") is None
    xml = '<record><header status="deleted"/><title lang="ko">가</title><title lang="en">A</title><identifier type="doi">10.1/x</identifier></record>'
    row = readers.harvested(spark.createDataFrame([(xml,)], "xml string"), "xml").first()
    assert (row.title, row.doi, row.url, row.deleted) == ("A", "10.1/x", None, True)
    assert one(spark, readers.resumption(t), t='<error code="noRecordsMatch"/>') == (None, None)
    assert one(spark, readers.resumption(t), t="<resumptionToken>abc</resumptionToken>") == ("abc", None)


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect()) == [1, 2]
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "a.jsonl"), "a int", "fail").collect()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.html").write_bytes("café".encode("cp1252"))
    assert readers.pages(spark, str(tmp_path / "p")).first().html == "café"
    sinks.text(spark.createDataFrame([("x",), (None,)], "t string"), "t", str(tmp_path / "t"))
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect() if r.value] == ["x"]
    sinks.text(spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1), "t", str(tmp_path / "u"))
    assert next((tmp_path / "u").glob("part-*")).read_text() == "a\n\nb\n\n"


def test_lines(spark):
    t = F.col("t")
    assert one(spark, cleaning.reflow(t), t="a\nb.\n\nc\n|\nd\ne") == "a b.\n\nc\n\nd e"
    assert one(spark, cleaning.is_menu(t), t="News Sport Art Music Film Law") is True
    html = "<html><body><nav>x</nav><p>a</p><script>'</p>'</script><p>b</body></html>"
    assert one(spark, cleaning.page_text(t), t=html) == "a\nb"
    s = one(spark, cleaning.split_sections(t), t="1. Introduction\nhello\n2. Methods used\nbody\nConclusion\nend")
    assert (s.introduction, s.body, s.conclusion, s.status) == ("1. Introduction\nhello", "2. Methods used\nbody", "Conclusion\nend", "exact")


def test_every_chunk_is_serialized(spark, sf_dir, tmp_path):
    from scriptorium import catalog

    texts = ["plain", "한국어 문장", "日本語", "“quoted” café", 'a "b" \\ / \t\r\n\x01\x7f\u2028 🎤', "", None]
    rows = [(f"c{i}", i % 2, 10 - i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "id string, document_id long, chunk_index int, content string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r.document_id: [(b["chunk_id"], b["content"]) for b in map(json.loads, r.blocks.split("\n\n"))] for r in catalog.QUERIES["serialized_chunks"](spark, str(tmp_path)).collect()}
    assert got == {d: [(c, t) for c, own, _, t in sorted(rows, key=lambda r: r[2]) if own == d and t is not None] for d in (0, 1)}
    blocks = catalog.QUERIES["serialized_chunks"](spark, sf_dir).selectExpr("sum(size(split(blocks, '\n\n')))").first()[0]
    assert blocks == spark.read.parquet(f"{sf_dir}/chunks.parquet").where("content is not null").count()


def test_pages_with_entities(spark, tmp_path):
    from scriptorium import catalog

    t = F.col("t")
    html = "<html><head><title>R&amp;D &#8212; a &lt; b</title></head><body><p>x &lt;y&gt; &amp;lt; caf&eacute;</p><p>&#x1F3A4; &unknown; AT&T</p></body></html>"
    assert one(spark, cleaning.page_text(t), t=html) == "x <y> &lt; café\n🎤 &unknown; AT&T"
    assert one(spark, cleaning.page_title(t), t=html) == "R&D — a < b"
    assert one(spark, cleaning.page_title(t), t=None) is None and one(spark, cleaning.page_text(t), t=None) is None
    rows = [(1, "a < b & c", "1 < 2 > 0\n<|endoftext|>\n</p></article>&lt;b&gt; <script>"), (2, None, "plain"), (3, " x ", None), (4, "&amp;", "\n \n&nbsp;")]
    spark.createDataFrame(rows, "doc_id long, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.title, r.text) for r in catalog.QUERIES["clean_pages"](spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1:], 2: (None, "plain"), 4: ("&amp;", "&nbsp;")}


def test_line_rules_in_their_order(spark, tmp_path):
    t = F.col("t")
    menu = "\n".join(["Home", "News", "", "Charts", "Law", "Art", "Music", "Film", "Shop"])
    text = f"Print Save Share\n♥ gossip\n{menu}\nA longer sentence that goes\non here.\n\nShort\nline.\nBack to top\nOther article."
    spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string").write.parquet(str(tmp_path / "texts"))
    rows = cleaning.clean_lines(spark.read.parquet(str(tmp_path / "texts")), "t", ["Back to top"], ["^©"], ["print", "save", "share"])
    assert {r.id: r.t for r in rows.collect()} == {1: "A longer sentence that goes on here.\n\nShort line.", 2: None, 3: ""}
    assert one(spark, cleaning.without_menu_runs(t), t="a\n\nb\nc") == "a\n\nb\nc"
    page = f"<html><head><title>T &amp; U</title><script type='application/ld+json'>{{\"datePublished\": \"2024-05-06\"}}</script></head><body><nav>x</nav><article><p>{text.replace(chr(10), '</p><p>')}</p></article></body></html>"
    spark.createDataFrame([(page,)], "html string").write.parquet(str(tmp_path / "pages"))
    r = cleaning.page_records(spark.read.parquet(str(tmp_path / "pages")), "html", ["Back to top"], ["^©"], ["print", "save", "share"]).first()
    assert (r.published, r.title, r.text) == (datetime.date(2024, 5, 6), "T & U", "A longer sentence that goes on here.\nShort line.")


def test_body_pieces(spark):
    t = F.col("t")
    rnd = random.Random(4)
    text = " ".join(rnd.choice(["word", "ends.", "갔다.", "x\n\n", "longer"]) for _ in range(4000))
    pieces = one(spark, training.body_pieces(t, 300, 25), t=text)
    at = 0
    for p in pieces:
        assert len(p) <= 300 and p == p.strip()
        at = text.index(p, max(at - 26, 0)) + len(p)
    assert at >= len(text.rstrip()) - 1
    assert one(spark, training.body_pieces(t), t="short") == ["short"] and one(spark, training.body_pieces(t), t="") == [] and one(spark, training.body_pieces(t), t=None) is None
    assert [len(p) for p in one(spark, training.body_pieces(t, 100, 10), t="x" * 250)] == [100, 100, 70]


@pytest.mark.parametrize("n,share", [(1, 0.15), (2, 0.15), (3, 0.15), (40, 0.15), (3000, 0.15)])
def test_split_takes_the_groups_of_least_hash(spark, n, share):
    import hashlib

    df = spark.range(n * 2).select((F.col("id") % n).cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    got = {r.k for r in training.split_groups(df, "k", share, small=10).where("part = 'validation'").collect()}
    hashes = sorted((hashlib.sha256(f"{i}/42".encode()).hexdigest(), str(i)) for i in range(n))
    assert got == {k for _, k in hashes[: 0 if n <= 2 else max(1, round(n * share))]}


def test_balance_of_a_large_group(spark):
    df = spark.range(5000).select(F.col("id").alias("sample_id"), F.lit("body_1").alias("section"), F.when(F.col("id") % 10 == 0, F.lit("b")).when(F.col("id") % 3 == 0, F.lit("a")).alias("g"))
    rows = df.collect()
    expected = set()
    for g in ("a", "b", None):
        own = sorted(r.sample_id for r in rows if r.g == g)
        expected |= {own[round(i * (len(own) - 1) / 4)] for i in range(5)}
    assert {r.sample_id for r in training.balance(df, "g", "sample_id", 5, 16).collect()} == expected
    assert training.balance(df.limit(0), "g", "sample_id").count() == 0


def test_retried_embeddings(spark):
    def provider(texts, calls=[]):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return chunking.hashed_vectors(texts)

    row = chunking.embed(spark.createDataFrame([("good",)], "t string").coalesce(1), "t", provider, pause=0.01).first()
    assert len(row.embedding) == 64 and row.embedding_error is None


def test_best_matches(spark):
    titles = ["the red house on the hill", "the red house on a hill", "the red house on the hills", "other", "another red house on the hill"]
    df = spark.createDataFrame([("a", t) for t in titles] + [("b", titles[0]), (None, "x"), ("a", None)], "document_type string, title string")
    got = {(r.document_type, r.title): r.best for r in dedupe.best_matches(df).collect()}
    alike = lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y))
    near = {x: sorted((-alike(x, y), y) for y in titles if y != x and alike(x, y) > 0.6) for x in titles}
    assert got == {("a", x): ys[0][1] for x, ys in near.items() if ys}


@pytest.mark.parametrize("block", [7, 1000])
def test_similar_sets_in_blocks_equal_brute_force(spark, block):
    from scriptorium.operators import similar

    rnd = random.Random(5)
    words = ["red", "green", "blue", "white", "black", "노란", "큰 집", "東京"]
    titles = {(rnd.choice(["a", "b", "c"]), " ".join(rnd.choices(words, k=rnd.randint(0, 6))), rnd.random() < 0.3) for _ in range(150)}
    titles = list({t[:2]: t for t in titles}.values())
    docs = spark.createDataFrame(titles, "document_type string, title string, known boolean")
    alike = lambda x, y: len(grams(x) & grams(y)) / len(grams(x) | grams(y)) if grams(x) else 0
    for threshold in (0.3, 0.6, 0.9):
        expected = {(a[0], *sorted((a[1], b[1])), alike(a[1], b[1])) for a in titles for b in titles if a[0] == b[0] and a[1] < b[1] and not (a[2] and b[2]) and alike(a[1], b[1]) > threshold}
        got = list(map(tuple, similar.similar_pairs(dedupe._titles(docs), threshold, block).collect()))
        assert set(got) == expected and len(got) == len(expected)
    assert dedupe.similar_titles(docs.limit(0)).count() == 0 and dedupe.best_matches(docs.limit(0)).count() == 0


def local_bytes(spark):
    """Bytes that Spark keeps on this disk: shuffle and spill files."""
    from pathlib import Path

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for x in folders for f in Path(x.getPath()).rglob("shuffle_*"))


@pytest.mark.parametrize("which", ["best_matches", "similar_titles"])
def test_no_candidate_is_shuffled(spark, which):
    import hashlib

    names = [hashlib.md5(str(i).encode()).hexdigest()[:10] for i in range(400)]
    docs = spark.createDataFrame([("a", f"yearly report on the water supply and the public libraries of {x}") for x in names], "document_type string, title string")
    before = local_bytes(spark)
    found = getattr(dedupe, which)(docs).collect()
    assert len(found) == (400 if which == "best_matches" else 400 * 399 / 2)
    assert local_bytes(spark) - before < 100_000


def test_intake_stages_no_titles_for_links(spark):
    from pathlib import Path

    rows = [(i, None, f"h{i}", "a", f"yearly report on the water supply of district {i:03d}", True) for i in range(120)]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    old = set(shared.glob("stage-title-links-*"))
    got = dict(dedupe.acceptance(spark.createDataFrame(rows, ARRIVALS)).collect())
    assert got[0] == "inserted" and all(got[i] == "near_duplicate" for i in range(1, 120))
    made = set(shared.glob("stage-title-links-*")) - old
    links = [spark.read.parquet(str(p)) for p in made]
    assert made and all(kind == "bigint" for x in links for _, kind in x.dtypes) and max(x.count() for x in links) == 120 * 119 / 2


def test_a_cluster_needs_a_shared_folder(spark):
    from scriptorium import storage

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        storage.shared_dir(Session)


def test_ids_are_found_by_themselves_their_base_or_their_beginning(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = dict(readers.by_precedence(ids("2401.1v2", "2401.2", "2401", "x", "", None), ids("2401.1v3", "2401.1", "2401.2", "2401.2v1")).collect())
    assert got == {"2401.1v2": "2401.1", "2401.2": "2401.2", "2401": "2401.1", "x": None, "": None, None: None}


def test_answers_of_models(spark):
    t = F.col("t")
    read = lambda text: one(spark, records.parsed_extraction(t), t=text)
    full = read('```json\n{"is_relevant": true, "category": "저작권", "entities": [{"name": "Suno", "entity_type": "AIModel"}, {"name": " ", "entity_type": "Case"}, {"name": "x", "entity_type": "Planet"}], "relations": [{"entity_name": "Suno", "entity_type": "AIModel", "relation_type": "DISCUSSES", "confidence": 0}, {"entity_name": "y", "entity_type": "Law", "relation_type": "CITES", "confidence": 0.9}, {"entity_name": "z", "entity_type": "Law", "relation_type": "EATS"}]}\n```')
    assert full.is_relevant and full.category == "저작권" and [e.name for e in full.entities] == ["Suno"]
    assert [(r.entity_name, r.confidence) for r in full.relations] == [("Suno", 0.5), ("y", 0.9)]
    for broken in ("no answer", "{", "[]", ""):
        r = read(broken)
        assert (r.is_relevant, r.category, r.entities, r.relations) == (False, None, [], [])
    assert read('{"is_relevant": true}').relations == []


def test_citations_in_texts(spark):
    t, ids = F.col("t"), F.array(F.lit("a1"), F.lit("b2"))
    assert one(spark, records.numbered(t, ids), t="One [b2], two [a1][zz] and [q] end [zz].") == "One [2], two [1] and  end."
    assert one(spark, records.numbered(t, ids), t="no ids") == "no ids" and one(spark, records.numbered(t, ids), t="open [b2") == "open [2]"
    assert one(spark, records.trailing_numbers(F.array(F.lit("b2"), F.lit("zz"), F.lit("b2"), F.lit("a1")), ids, t), t="has [a1]") == [2]
    assert one(spark, T.known_citations(t, ids), t="[a1] stays [zz] , [ ] goes [b2") == "[a1] stays,  goes [b2"
    assert one(spark, T.citation_key(t), t=" [[a-1]] ") == "a-1"
    body = "Start\nReferences\nnot here\n" + "text " * 30 + "\n참고문헌\n[1] x\n[2] y"
    assert one(spark, records.without_references(t), t=body) == body[: body.index("\n참고문헌")].rstrip("\n ")
    assert one(spark, records.without_references(t), t="References\n" + "long " * 20) == "References\n" + "long " * 20
    assert one(spark, records.without_references(t), t="references are good") == "references are good" and one(spark, records.without_references(t), t=None) is None
    assert one(spark, T.without_bibliography(t), t="End.\n  bibliography: \n[1]\n") == "End." and one(spark, T.without_bibliography(t), t="A bibliography of x") == "A bibliography of x"
    assert one(spark, T.without_heading(t, F.lit("2) The  Title")), t="1. the title\n\nBody") == "Body" and one(spark, T.without_heading(t, F.lit("Other")), t="Title\nBody") == "Title\nBody"
    assert one(spark, T.unfence(t), t="```\nx\n``` and more") == "x" and one(spark, T.unfence(t), t=" plain ") == "plain"


def test_envelopes_and_inverted_texts(spark):
    t = F.col("t")
    df = spark.createDataFrame([(1, '{"rows": {"i": 5}}'), (2, '{"rows": [{"i": 6}, {"i": 7}]}'), (3, '[{"i": 8}]'), (4, '{"i": 9}'), (5, "broken"), (6, '{"rows": []}'), (7, None)], "k int, json string")
    assert sorted((r.k, r.place, r.row.i) for r in readers.envelope_rows(df, "json", "rows", "struct<i:int>").collect()) == [(1, 1, 5), (2, 1, 6), (2, 2, 7), (3, 1, 8), (4, 1, 9)]
    m = F.from_json(t, "map<string,array<int>>")
    assert one(spark, arrays.from_inverted(m), t='{"the": [0, 3], "of": [2], "end": [1, 4]}') == "the end of the end"
    assert one(spark, arrays.from_inverted(m), t="{}") == "" and one(spark, arrays.from_inverted(m), t=None) is None
    feed = spark.createDataFrame([("<item><title> A &amp; B </title><link>http://x/1</link><pubDate>Tue, 02 Jan 2024 00:00:00 GMT</pubDate></item>",), ("<item><title>no link</title></item>",), ("<item><link> </link></item>",)], "xml string")
    assert [(r.title, r.link, r.published) for r in readers.feed_items(feed, "xml").collect()] == [("A & B", "http://x/1", "Tue, 02 Jan 2024 00:00:00 GMT")]
