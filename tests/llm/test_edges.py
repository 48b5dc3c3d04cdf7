"""Edge cases of the corpus operators: clashing names, empty tables, odd ids, broken markup, exact edits."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rolesift.llm import bpe, decontamination, html_text, langid, lattice, licences, lm, minhash, toxicity

CLASHES = ["__text", "__html", "__row", "__known", "gone", "leak", "repeat", "row", "node", "key", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(1, base, "en"), (2, base + " more", "en"), (2, "another text of the same id " * 9, "en"), (3, "another text of the same id " * 9, "de"), (3, "another text of the same id " * 9, "de"), (4, None, None), (None, base, "en"), (5, "² ½ 12 Ⅷ", "en")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return frame.select("*", *(F.lit("x").alias(c) for c in CLASHES))


def test_clashing_names(docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, "word3 word4 word5 word6 word7 word8")], "item_id long, text string")
    n, wide = docs.count(), set(docs.columns)
    found = [lm.score(docs, lm.train(docs)), toxicity.score(docs, toxicity.train(docs, labels)), langid.predict(docs, langid.train(docs)), bpe.encode(docs, *bpe.default_ranks()), html_text.extract(docs.withColumnRenamed("text", "html"), into="main")]
    for frame in found:
        assert frame.count() == n and wide - {"text"} <= set(frame.columns)
    assert set(minhash.deduplicated(docs).columns) == wide == set(decontamination.cleaned(docs, items).columns)
    assert licences.scan(docs.withColumn("path", F.lit("a/b"))).count() == n


def test_no_language_without_a_letter(docs):
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got[4] == got[5] == "und" != got[1]


def test_repeated_ids_keep_their_texts_and_links(docs):
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    one = docs.where("doc_id = 2 or doc_id is null")
    assert sorted(r.text for r in minhash.deduplicated(one).collect()) == sorted(r.text for r in one.collect())
    assert minhash.deduplicated(docs.where("doc_id = 3")).count() == 1


def test_string_ids(docs, spark):
    named = docs.select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id: r.class_id for r in minhash.classes(named).collect()}["d3"] == "d1"
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0])], "vec_id string, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(vectors).collect()} == {"a": (1, "a"), "b": (1, "a"), "c": (0, "c")}


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    labels, items = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    assert langid.predict(none, langid.train(none)).count() == toxicity.score(none, toxicity.train(none, labels)).count() == bpe.encode(none, *bpe.default_ranks()).count() == 0
    assert decontamination.pairs(docs, items).count() == decontamination.pairs(none, items).count() == minhash.deduplicated(none).count() == 0
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


PAGE = """<html><head><title>t</title></head><body><nav>Menu</nav><div class="site-footer">no</div>
<article><h1>Head &amp; more</h1><p class="form-factor">First  one
goes on.</p><div class="share-buttons">no</div><p>Second <b>bold</b>.</p><section class="comments"><p>reader</p></section></article>
<script>var x = "<p>no</p>";</script><footer>no</footer></body></html>"""


def test_main_text_of_a_planted_page():
    assert html_text.main_text(PAGE) == "Head & more\n\nFirst one goes on.\n\nSecond bold."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""


@pytest.mark.parametrize("broken", ["<a " * 300_000 + '"', "<b>" * 200_000 + "</i>" * 200_000, "<span>" * 100_000 + "<div></div>" * 80_000, "<p title='x" * 90_000, "<!--" * 250_000, "<a><p>x" * 80_000, "</p>" * 200_000])
def test_broken_markup_in_linear_time(broken):
    start = time.time()
    html_text.main_text(broken)
    assert time.time() - start < 12


def test_appends_and_edits_are_exact():
    ranks, pattern = bpe.default_ranks()
    v = bpe.Vocabulary(ranks, pattern)
    grown = bpe.EncodedText(v, "x'l")
    grown.append("l")
    assert grown.ids() == v.encode("x'll")
    r = random.Random(4)
    alphabet = ["a", "l", "'", "r", "e", "v", "s", " ", "  ", "\n", "\t", "1", "23", ".", "!", "é", "ß", "漢", "don", " the", "LL", "'T"]
    for _ in range(1500):
        text = "".join(r.choices(alphabet, k=r.randint(0, 14)))
        held = bpe.EncodedText(v, text)
        for _ in range(3):
            a = r.randint(0, len(text))
            b = r.randint(a, min(len(text), a + 4))
            new = "".join(r.choices(alphabet, k=r.randint(0, 3)))
            if r.random() < 0.4:
                a = b = len(text)
                held.append(new)
            else:
                held.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert held.ids() == v.encode(text), repr(text)


def test_piece_tables():
    ranks, pattern = bpe.default_ranks()
    v, r = bpe.Vocabulary(ranks, pattern), random.Random(5)
    for _ in range(200):
        data = bytes(r.choices(b"abcdethein ", k=r.randint(1, 30)))
        table = bpe.PieceTable(v, data)
        a = r.randint(0, len(data))
        b = r.randint(a, len(data))
        new = bytes(r.choices(b"theins", k=r.randint(0, 5)))
        table.edit(a, b, new)
        data = data[:a] + new + data[b:]
        assert table.ids() == v.encode_piece(data) if data else table.ids() == []


def test_decoding_gives_the_bytes_back(docs):
    ranks, pattern = bpe.default_ranks()
    coded = bpe.encode(docs, ranks, pattern, keep=["text", "doc_id"]).drop("decoded")
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in bpe.decode(coded, ranks, pattern).collect())


def test_every_vector_row_keeps_its_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (None, [0.01, 1.0]), (None, [-1.0, 0.0]), (3, None), (3, [2.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in lattice.near_duplicates(frame).collect() if r.vec_id or r.component_id)
    assert found == [(0, 1, 1), (1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (3, 2, 1)]
    assert lattice.near_duplicates(frame).count() == len(rows)


@pytest.mark.parametrize("local", [0, 1000])
def test_components_by_rounds_and_contracted(spark, local):
    import random

    from rolesift.llm.common import written
    from rolesift.llm.components import components

    r = random.Random(4)
    links = [(r.randint(0, 400), r.randint(0, 400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(12)] + [(2000, x) for x in range(2001, 2040)] + [(5, 5), (None, 3)]
    more = [(0, 2000), (3000, 3001), (3001, 1004), (7, None)]

    def plain(pairs):
        label = {}
        for x, y in pairs:
            if x is not None and y is not None and x != y:
                label.setdefault(x, x), label.setdefault(y, y)
        for _ in range(500):
            before = dict(label)
            for x, y in pairs:
                if x in label and y in label:
                    label[x] = label[y] = min(label[x], label[y])
            if before == label:
                return label

    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first = written(components(frame(links), local=local), "first")
    assert {(x.node, x.component) for x in first.collect()} == set(plain(links).items())
    both = components(frame(more), known=first, local=local).collect()
    assert len(both) == len(set(both)) and {(x.node, x.component) for x in both} == set(plain([x for x in links if x != (5, 5)] + more).items())


def test_main_text_keeps_short_paragraphs_and_compound_names():
    page = '<article><p>One.</p><div class="related-work"><p>Two.</p></div><div class="form-factor">Three</div><section id="search-algorithms">Four</section><div class="comment-list">no</div><div class="share-buttons">no</div></article>'
    assert html_text.main_text(page) == "One.\n\nTwo.\n\nThree\n\nFour"
    body = "Long text stands here. " * 40
    page = f'<body><p>{body}</p><ul class="menu"><li>Home</li></ul><p>Short closing.</p><ul class="menu"><li>Top</li></ul><p>© 2024 The Paper.</p><div class="site-footer">Imprint.</div></body>'
    assert html_text.main_text(page) == f"{body.strip()}\n\nShort closing."
