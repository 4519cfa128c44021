"""Edge cases of the pN operators, and their kernels."""

import collections
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import dartminhash, encoding, language, leakage, lexicon, lookalike, pages, pieces, simhash, site_lines
from scriptorium.llm.kernels import canon, runs, word_hashes
from scriptorium.llm.samples import labelled_lines

DOC = "doc_id long, source_id int, source string, title string, text string, lang string, document_type string, id string, rep long, bands int, key string, word string"


def frame(spark, rows):
    """Documents with columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, 2, "k", "w") for r in rows], DOC)


def odd(spark):
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    same = "The quick brown fox jumps over the lazy dog and runs away from all the other animals of the dark forest again and again until the morning comes with light and birds sing their songs"
    rows = [(1, 1, "A", "t", None, "en", "webpage"), (2, 1, "A", None, "", "en", "webpage"), (3, None, None, "", "  \n\n ", None, None), (4, 1, "A", "t", long, "en", "webpage")]
    rows += [(i, 1, "A", "same", same, "en", "news") for i in range(10, 18)] + [(17, 1, "A", "same", same, "en", "news"), (None, 1, "A", "n", same, "en", "news")]
    rows += [(30, 2, "B", "\x00", "\x00 🎤 <|endoftext|> \r\n\t", "xx", "webpage")]
    return frame(spark, rows)


def every(spark, docs):
    papers = spark.createDataFrame([("1. A heading",), (None,)], "text string")
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog and runs away from all the"), (2, None), (3, "")], "item_id long, text string")
    return {
        "p2": site_lines.repeated_lines(docs),
        "p3": pages.boilerplate(docs, papers),
        "p4": dartminhash.document_pairs(*dartminhash.near_duplicates(docs)).distinct(),
        "p4g": dartminhash.duplicate_groups(docs),
        "p5": language.wrong_labels(docs),
        "p6": pieces.pieces(docs.select(F.lit("d").alias("item_kind"), F.col("doc_id").cast("string").alias("item_id"), F.col("text").alias("content"))),
        "p7": encoding.garbled_fields(docs),
        "p8": lexicon.encode(docs),
        "p9": leakage.leaks(docs, items),
        "p10": lookalike.lookalike_pairs(docs),
        "p10c": lookalike.consistent_text(docs),
    }


def test_odd_rows(spark):
    got = {k: df.collect() for k, df in every(spark, odd(spark)).items()}
    assert {(r.doc_id, r.line_no) for r in got["p2"]} >= {(i, 1) for i in range(10, 18)}
    assert {(r.doc_id_a, r.doc_id_b) for r in got["p4"]} == {(a, b) for a in range(10, 18) for b in range(a + 1, 18)}
    ids = {r.doc_id: r.ids for r in got["p8"]}
    assert ids[1] == ids[2] == [] and len(ids[4]) > 100_000
    assert max(len(r.content) for r in got["p6"]) <= 3000
    assert {r.doc_id for r in got["p9"]} == {*range(10, 18), None}
    assert got["p10"] == [] and {r.text for r in got["p10c"] if r.doc_id == 1} == {None}


def test_empty_tables(spark):
    got = {k: df.collect() for k, df in every(spark, odd(spark).limit(0)).items()}
    assert all(rows == [] for rows in got.values())


SAMPLE = "sample_id long, split string, source string, output string, id string, rep long"


def test_samples(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(1, "train", None, text), (2, "train", "s", text), (3, "test", "s", text.upper()), (4, None, None, text + " end"), (5, "test", "s", None), (6, "test", "s", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SAMPLE)
    pairs = simhash.cross_split(df).cache()
    assert {(r[0], r[1]) for r in pairs.collect()} == {(1, 3), (2, 3), (1, 4), (2, 4)}
    counts = {(r["split"], r["source"]): (r.samples, r.overlapping, r.pairs) for r in simhash.overlap_counts(df).collect()}
    assert counts == {("test", "s"): (3, 1, 2), (None, None): (1, 1, 2)}
    assert simhash.cross_split(df.limit(0)).collect() == []


def test_labelled_lines_are_distinct_and_of_the_whole_sample(spark):
    """A third of the rows are copies of one text, and its line sorts before all others."""
    copied = "Aaa " + "all the same " * 12
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(400)]
    own = [f"{'BCDEFGHIJKLMNOPQRSTUVWXYZ'[i % 25]} {' '.join(rng.choices(words, k=30))}" for i in range(600)]
    rows = [(i, copied if i % 3 == 0 else own[i * 2 // 3]) for i in range(900)]
    rows += [(0, copied)] * 20 + [(None, copied)] * 20 + [(2000 + i, f"Über {' '.join(rng.choices(words, k=30))}") for i in range(30)]
    docs = spark.createDataFrame([(i, t, "de" if t[0] == "Ü" else "en") for i, t in rows], "doc_id long, text string, lang string").repartition(7)
    lines = labelled_lines(docs, ("en", "de"), 400)
    assert len(lines) == len(set(lines)) and collections.Counter(lang for lang, _ in lines) == {"en": 200, "de": 30}
    assert lines == labelled_lines(docs.repartition(3), ("en", "de"), 400)
    everything = labelled_lines(docs, ("en", "de"))
    assert sorted(everything) == sorted({("en", t) for t in [copied, *own]} | {("de", t) for _, t in rows if t[0] == "Ü"})
    model = language.train(everything, 5000)
    text = model.texts[model.languages.index("en")]
    codes = text.tobytes()
    used = [t for t in own if language.coded(t).tobytes() in codes]
    assert len({t[0] for t in used}) > 8 and codes.count(language.coded(copied).tobytes()) <= 1
    kept = dict(zip(("de", "en"), encoding.train(everything, 5000)))["en"].decode().split("\n")
    assert len({t[0] for t in kept}) > 8 and len(kept) == len(set(kept))


def test_large_item_sets_are_joined(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n"), (2, "nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "x a b c d e f g h i j k l y")], "item_id long, text string")
    assert sorted(leakage.leaks(docs, items, most_grams=0).collect()) == sorted(leakage.leaks(docs, items).collect()) != []


def test_removed_spans(spark):
    text = "Before. " + " ".join("abcdefghijklmn") + ". After"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join("abcdefghijklmn"))], "item_id long, text string")
    got = {r.doc_id: r for r in leakage.without_leaks(docs, leakage.leaks(docs, items)).collect()}
    assert got[1].text == "Before. . After" and got[2].text is None


LOOK_ALIKE = [
    ("ｃａｔ", "cat"), ("ﬁeld", "field"), ("e\u0301te\u0301", "été"), ("ca\u200bt", "cat"), ("a\u00a0b", "a b"), ("c\u043eunted", "counted"), ("\u03a4hr\u03bfugh", "Through"), ("\u1109\u1175범", "시범"),
    ("\U0001d400bc", "Abc"), ("\u2163", "IV"), ("\u2170\u2170", "ii"), ("\u0251rt", "art"), ("\u0555K", "OK"), ("\u13aart", "Art"), ("a\u2011b", "a-b"), ("a\u202ab\u2066", "ab"), ("pay\u0440\u0430", "paypa"),
    ("Слово paypa", "Слово \u0440\u0430\u0443\u0440\u0430"), ("м\u0061ма", "мама"), ("Г\u03c1ад", "Град"),
]
DIFFERENT = [("слово", "slovo"), ("λόγος", "logos"), ("été", "ete"), ("Cat", "cat"), ("a  b", "a b"), ("x²", "x2"), ("sınır", "sinir"), ("l1", "ll"), ("O0", "OO"), ("口", "ロ"), ("a,b", "a.b")]


@pytest.mark.parametrize("by_context", [False, True])
def test_consistent_form(spark, by_context):
    for a, b in LOOK_ALIKE:
        assert canon(a, by_context) == canon(b, by_context), (a, b)
    for a, b in DIFFERENT:
        assert canon(a, by_context) != canon(b, by_context), (a, b)


def test_the_form_of_a_line_is_that_line_of_the_form(spark):
    text = "\n".join(x for pair in LOOK_ALIKE + DIFFERENT for x in pair)
    assert canon(text).split("\n") == [canon(x) for x in text.split("\n")]
    assert canon("нос и рот в порту", by_context=True) == "нос и рот в порту"


def test_pairs_and_groups_of_look_alikes(spark):
    rows = [(1, "plain text"), (2, "plаin text"), (3, "plain text"), (4, "plain text"), (5, "other"), (6, "other"), (7, None), (8, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in lookalike.lookalike_pairs(docs).collect()} == {(1, 2), (2, 3), (2, 4)}
    assert sorted(tuple(r) for r in lookalike.lookalike_groups(docs).collect()) == [(1, 1, 2, 3, 1), (2, 1, 2, 1, 3), (3, 1, 2, 3, 1), (4, 1, 2, 3, 1)]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_consistent_form_is_stable(text):
    SparkSession.builder.getOrCreate()
    assert canon(canon(text)) == canon(text)


@given(st.lists(st.text(alphabet="abc ", min_size=1, max_size=6), max_size=30), st.lists(st.text(alphabet="abcd ", min_size=1, max_size=6), max_size=30))
@settings(max_examples=100, deadline=None)
def test_lexicon_holds_its_words_only(words, others):
    given_words = {w.encode(): [i, i + 1] for i, w in enumerate(dict.fromkeys(words))}
    compiled = lexicon.compile_lexicon(given_words)
    asked = [w.encode() for w in words + others]
    for w, at in zip(asked, lexicon.look_up(compiled, asked).tolist()):
        assert (compiled["ids"][compiled["offsets"][at] : compiled["offsets"][at + 1]].tolist() if at >= 0 else None) == given_words.get(w)


@given(st.text(alphabet=st.sampled_from(list("ab \n\t'1.!é가🎤")), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_keep_words_whole(text):
    import regex

    find = regex.compile(lexicon.PATTERN).findall
    assert "".join(lexicon.pieces(text)) == text
    assert [w for p in lexicon.pieces(text) for w in find(p)] == find(text)


@given(st.text(alphabet=st.sampled_from(list("ab ,;.\n")), min_size=1, max_size=400), st.integers(5, 60), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_cuts(text, limit, overlap):
    spans = pieces.cut(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(b - a <= limit for a, b in spans)
    assert all(a < c and 0 <= b - c <= overlap for (a, b), (c, _) in zip(spans, spans[1:]))


def test_strongest_cut_equals_a_scan():
    rnd = random.Random(5)
    text = "".join(rnd.choice("ab ,.\n") for _ in range(500))
    cuts = pieces.StrongestCut(text, 200)
    strength = np.zeros(len(text) + 1, int)
    for value, pattern in pieces.PAUSES:
        for m in pattern.finditer(text):
            strength[m.end()] = max(strength[m.end()], value)
    strength[[0, -1]] = 0
    for _ in range(300):
        a = rnd.randrange(0, 480)
        b = min(a + rnd.randrange(1, 150), 500)
        part = strength[a : b + 1]
        expected = None if part.max() == 0 else (a + len(part) - 1 - int(part[::-1].argmax()), a + int(part.argmax()))
        assert (cuts.query(a, b), cuts.query(a, b, False)) == ((None, None) if expected is None else expected)


def test_phrases_equal_the_loop():
    rnd = np.random.default_rng(2)
    trained = [rnd.integers(1, 6, 300).astype(np.uint8), rnd.integers(3, 9, 200).astype(np.uint8)]
    lines = [rnd.integers(0, 9, n).astype(np.uint8) for n in (1, 5, 40, 100)]

    def loop(text, line):
        t, n, at = bytes(text), 0, 0
        while at < len(line):
            end = at + 1
            while end <= len(line) and bytes(line[at:end]) in t:
                end += 1
            at = max(end - 1, at + 1)
            n += 1
        return n

    got = language.phrases(*language.parser(trained), lines, window=1000)
    assert got.tolist() == [[loop(t, x) for x in lines] for t in trained]


def test_automata_are_built_on_the_driver_and_lines_coded_together(monkeypatch):
    rnd = np.random.default_rng(7)
    trained = [rnd.integers(0, 64, 500).astype(np.uint8) for _ in range(2)]
    sent, whole = [language.suffix_automaton(t) for t in trained], language.parser(trained)
    monkeypatch.setattr(language, "suffix_automaton", None)  # a worker lays out what it was sent
    table, roots = language._parser("token", type("Sent", (), {"value": sent}))
    assert table.tolist() == whole[0].tolist() and roots.tolist() == whole[1].tolist()
    lines = ["", "…Été, l’île", "등록 A1", "  ", "ΣΑΣ", "", "\ud800 x", "İI", "日本 かな"]
    got = language.coded_lines(lines)
    assert [x.tolist() for x in got] == [language.coded(x).tolist() for x in lines]
    assert got[1].tolist() == [0, *language.coded("été").tolist(), 0, 12, 0, *language.coded("île").tolist()]
    assert [len(x) for x in got] == [0, 10, 9, 1, 9, 0, 2, 3, 13]


@pytest.mark.parametrize("similarity", [0.3, 0.6, 0.9])
def test_darts_agree_as_often_as_the_similarity(similarity):
    rnd = np.random.default_rng(3)
    both = int(200 * similarity)
    pool = rnd.integers(1, 2**63, 200).astype(np.uint64)
    half = (200 - both) // 2
    a, b = np.r_[pool[:both], pool[both : both + half]], np.r_[pool[:both], pool[both + half :]]
    sig = dartminhash.signatures(np.r_[a, b], np.ones(len(a) + len(b)), np.array([len(a), len(b)]), 2000)
    assert abs((sig[0] == sig[1]).mean() - both / 200) < 0.05


def test_darts_follow_weights():
    x = np.array([11, 22], np.uint64)
    sig = dartminhash.signatures(np.r_[x, x], np.array([3.0, 1.0, 1.0, 3.0]), np.array([2, 2]), 4000)
    assert abs((sig[0] == sig[1]).mean() - 2 / 6) < 0.05  # min(3,1) + min(1,3) over max


@pytest.mark.parametrize("text", ["Le comité a publié la clé de répartition à l’île.", "등록 심사관은 이용 거부 명부를 수정했다.", "管理団体は冬の公聴会で試験契約を翻訳した。"])
@pytest.mark.parametrize("wrong,right", [("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("mac_roman", "utf-8"), ("latin-1", "cp949"), ("latin-1", "cp932")])
def test_encoding_round_trip(text, wrong, right):
    try:
        raw = text.encode(right)
        bad = raw.decode("latin-1") if wrong == "latin-1" else "".join(bytes([b]).decode(wrong, "strict") if b not in _undefined(wrong) else chr(b) for b in raw)
    except UnicodeEncodeError:
        pytest.skip("not in that encoding")
    fix = encoding.Compressors([text.encode()])
    assert fix.best(bad)[0] == text
    assert fix.best(text) == (text, ())


@pytest.mark.parametrize("text", ["Le comité a publié la clé de répartition à l’île.", "등록 심사관은 이용 거부 명부를 수정했다.", "管理団体は冬の公聴会で試験契約を翻訳した。"])
@pytest.mark.parametrize("codec", ["cp1252", "cp1251", "cp1250", "iso8859_2", "koi8_r", "mac_roman", "cp437", "cp850"])
def test_text_that_went_wrong_three_times(text, codec):
    shown = {}
    for char, byte in encoding._page(codec).items():
        shown.setdefault(byte, chr(char))
    bad = text
    for _ in range(3):
        bad = "".join(chr(b) if b < 128 else shown[b] for b in bad.encode())
    fixed, chain = encoding.Compressors([text.encode()]).best(bad)
    assert fixed == text and len(chain) == 3


def test_other_encodings_and_mixed_lines():
    ja, ko = "管理団体は冬の公聴会で試験契約を翻訳した。", "등록 심사관은 이용 거부 명부를 수정했다."
    fix = encoding.Repairer([ja.encode(), ko.encode(), "Zürich und Köln".encode()])
    assert fix.line(ja.encode("euc_jp").decode("latin-1"))[0] == ja
    assert fix.line("„Köln“ – " + "Zürich".encode().decode("cp1252"))[0] == "„Köln“ – Zürich"
    assert fix.field("Köln\nein Rest � fehlt") == ("Köln\nein Rest � fehlt", "", False)
    assert fix.field("Köln – Zürich\n" + ko) is None
    assert fix.line("청청 측은 이를 비교했다")[1] == () and fix.line("일반 한국어 문장 속의 첫 낱말")[1] == ()  # syllables whose bytes are UTF-8 by chance


def test_no_page_is_tried_where_no_passage_can_begin(monkeypatch):
    fix = encoding.Compressors([b"x"])
    lines = ["« Köln » – 등록 심사관은 « é » 이용했다", "été – où 管理団体"]
    found = [fix.best(line) for line in lines]
    monkeypatch.setattr(encoding, "_passages", None)
    assert [fix.best(line) for line in lines] == found == [(line, ()) for line in lines]


def test_half_of_a_double_mistake_need_not_look_better():
    sample = "La sociedad de gestión retiró a comienzos de primavera el acuerdo. Un coro de la costa publicó la licencia piloto sobre la autoría."
    fix = encoding.Compressors([sample.encode(), "La conférence de l’été".encode()], ("es", "fr"))
    line = "Para Gyssit, la sociedad de gestión publicó la licencia"
    bad = line.encode().decode("cp1252").encode().decode("cp1252")
    assert fix.best(bad) == (line, (("cp1252", "utf-8"),) * 2)
    assert fix.best("à la conférence de l’île, car") == ("à la conférence de l’île, car", ())


def _undefined(codec):
    out = set()
    for b in range(256):
        try:
            bytes([b]).decode(codec)
        except UnicodeDecodeError:
            out.add(b)
    return out


def test_region_of_markup():
    lines = ["<ul><li><a>Home</a></li><li><a>News</a></li></ul>"] * 4 + ["A long paragraph of the article that says much about many things and more " * 3, "Another long paragraph of the same article with many further words in it " * 3] + ["<div><a>Imprint</a></div><div><a>Contact</a></div><p></p>"] * 4
    tags = pages.tag_counts(lines)
    assert tags[0] > 4
    region = pages.content_region(np.array([len(re.sub("<[^>]*>", "", x)) for x in lines]), tags, np.zeros(len(lines)))
    assert region[4] and region[5] and not region[0] and not region[9]


def test_smoothing_joins_short_lines_to_their_neighbours():
    chars, tags, linked = np.array([300, 20, 300, 20, 20, 20, 20]), np.array([0, 0, 0, 0, 0, 0, 0]), np.array([0, 0.98, 0, 0.999, 0.999, 0.999, 0.999])
    assert pages.content_region(chars, tags, linked).tolist() == [True, True, True, False, False, False, False]
    assert not pages.content_region(np.array([300, 40, 300]), np.zeros(3), np.array([0, 1.0, 0]))[1]


def test_planted_page_lines(spark):
    """Forty pages of a site with a menu, a notice of over 200 characters, a title, paragraphs with a subhead, and links to the other articles."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    notice = "We and our partners store and read information on your device, such as cookies, and process personal data for advertisements and content, measurement, audience research and the development of services; you can change your choice at any time in the settings of this site."
    titles = [f"What {say(1)} owes {say(1)} about {say(2)}" for _ in range(60)]
    rows, truth = [], set()
    for doc in range(40):
        others = rng.sample([titles[i] for i in range(60) if i != doc], 3)
        lines = ["Home | News | Charts", titles[doc], say(60), "", say(50), say(3).capitalize(), say(70), notice, *others, "Imprint  Privacy  Contact"]
        truth |= {(doc, i) for i, x in enumerate(lines, 1) if x in ("Home | News | Charts", notice, "Imprint  Privacy  Contact", *others)}
        rows.append((doc, "webpage", "Site", titles[doc], "\n".join(lines)))
    rows += [(100 + i, "news", "Site", titles[i], say(40)) for i in range(40, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, document_type string, source string, title string, text string")
    papers = spark.createDataFrame([(None,)], "text string")
    got = {tuple(r) for r in pages.boilerplate(docs, papers).collect()}
    assert len(got ^ truth) <= 0.02 * len(truth) and {k for k in truth if k[1] in (1, 8, 12)} <= got
    weighed = {(r.doc_id, r.line_no): r for r in pages.weighed_lines(docs, papers).collect()}
    assert sum(not weighed[k].common for k in truth) > 60 and len(weighed) == sum(1 for r in rows[:40] for x in r[4].split("\n") if x.strip())


def test_glued_notices_are_cut(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(500)]
    notice = "This article was written with the kind support of the regional press fund and may be copied by members of the union of local newspapers in every district"
    rows = [(i, 1, f"{' '.join(rng.choices(words, k=20))} {notice} {' '.join(rng.choices(words, k=10))}\nİstanbul own line {words[i]}") for i in range(8)] + [(20, 1, None), (21, None, notice), (22, 2, notice)]
    docs = spark.createDataFrame(rows, "doc_id long, source_id int, text string")
    texts = {r[0]: r[2] for r in rows}
    got = {r.doc_id: r for r in site_lines.without_spans(docs, site_lines.repeated_spans(docs)).collect()}
    assert {d for d, r in got.items() if r.removed} == set(range(8)) and {d: got[d].text for d in (20, 21, 22)} == {d: texts[d] for d in (20, 21, 22)}
    for d in range(8):
        before, after = texts[d].split(notice)
        assert got[d].text.startswith(before) and got[d].text.endswith(after) and len(texts[d]) - len(got[d].text) > 0.6 * len(notice)
    assert site_lines.repeated_spans(docs.limit(0)).collect() == [] and site_lines.repeated_lines(docs).count() == 0


def test_languages_come_from_the_sample(spark):
    """Chinese beside Japanese, a label that is no language, a text in none of the languages, a text of short lines."""
    rng = random.Random(4)
    alphabets = {"xa": "abcdefgh", "xb": "efghijkl", "ja": "のはをにがとでしたるこれ管理団体冬公聴会", "zh": "的是在了和我们这中国人大上个管理团体冬公听会"}
    vocabulary = {k: ["".join(rng.choices(a, k=rng.randrange(2, 6))) for _ in range(150)] for k, a in alphabets.items()}
    say = lambda k, n: (" " if k[0] == "x" else "").join(rng.choices(vocabulary[k], k=n))
    rows = [(i, "\n".join(say(k, 60) for _ in range(4)), k) for i, k in enumerate(list(alphabets) * 60)] + [(1000 + i, say(("xa", "xb", "ja")[i % 3], 60), "zz") for i in range(30)]
    rows += [(2000, " ".join("".join(rng.choices("pqrstuvwxyz", k=5)) for _ in range(40)), None), (2001, "\n".join(say("xa", 4) for _ in range(8)), None), (2002, "", None), (2003, None, "xa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = {r.doc_id: r for r in language.document_languages(docs).collect()}
    assert {got[i].lang for i in range(0, 240, 4)} == {"xa"} and {got[i].lang for i in range(2, 240, 4)} == {"ja"} and {got[i].lang for i in range(3, 240, 4)} == {"zh"}
    assert "zz" not in {r.lang for r in got.values()} and got[2000].lang is None and got[2000].confidence == 0
    assert got[2001].lang == "xa" and 2002 not in got and 2003 not in got
    wrong = {(r.doc_id, r.lang) for r in language.wrong_labels(docs).collect()}
    assert {d for d, _ in wrong} == set(range(1000, 1030))


def test_long_words_are_merged_in_little_time():
    ranks = lexicon.read_ranks(lexicon.VOCABULARY)
    start = time.time()
    assert len(lexicon.merge(b"a" * 200_000, ranks)) < 200_000 and time.time() - start < 20


@given(st.text(alphabet=st.sampled_from(list("abeinst é가")), min_size=1, max_size=40))
@settings(max_examples=200, deadline=None)
def test_merge_equals_the_plain_loop(text):
    ranks = {bytes([b]): b for b in range(256)} | {w: 256 + i for i, w in enumerate([b"in", b"st", b"ab", b"abe", b"be", b"inst", b"aa", b"aab", b"nt", b"\xc3\xa9"])}
    parts = [bytes([b]) for b in text.encode()]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert lexicon.merge(text.encode(), ranks) == [ranks[p] for p in parts]


def test_runs_and_hashes():
    h = word_hashes("A b C")
    assert (h == word_hashes("a B c")).all() and len(runs(h, 3)) == 1 and len(runs(h, 4)) == 0
