"""The corpus operators against brute force, round trips and held-out rows, on small tables."""

from itertools import combinations

import numpy as np
import pytest
import tiktoken

from rolesift.llm import bpe, decontamination, langid, lattice, licences, minhash, token_shards, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"


def words(seed, n):
    r = np.random.default_rng(seed)
    return [f"w{x}" for x in r.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 80)
    near = base[:40] + ["other"] + base[41:]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(words(2, 80))), (5, None), (6, ""), (7, "   "), (None, " ".join(base)), (8, "one two"), (9, "one two"), (10, " ".join(words(3, 20000)))]
    return spark.createDataFrame([(i, t, "en", "src") for i, t in rows], SCHEMA)


def test_minhash_matches_brute_force(docs):
    found = {r.doc_id: r.class_id for r in minhash.classes(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id and r.text and r.text.split()}
    want = {i: i for i in found}
    for a, b in combinations(sorted(texts), 2):
        if minhash.similarity(minhash.shingle_counts(texts[a], 5), minhash.shingle_counts(texts[b], 5)) >= 0.8:
            low, high = sorted((want[a], want[b]))
            want = {k: low if v == high else v for k, v in want.items()}
    assert found == want
    assert found[2] == 1 and found[3] == 1 and found[9] == 8


def test_minhash_of_no_rows(spark):
    assert minhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_bpe_matches_the_library(docs):
    import base64

    import public_tokenizers as P

    ranks, pattern = bpe.default_ranks()
    known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=known, special_tokens={})
    for r in bpe.encode(docs, ranks, pattern).collect():
        assert r.token_ids == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()


def test_feistel_is_a_permutation():
    p = token_shards.Params()
    for n in (1, 2, 3, 17, 1000):
        x = np.arange(n, dtype=np.uint64)
        y = token_shards.feistel(x, n, p)
        assert sorted(y.tolist()) == list(range(n))
        assert token_shards.unfeistel(y, n, p).tolist() == x.tolist()


def test_lattice_matches_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([base, base + 0.05 * r.normal(size=base.shape), base[:3]]))]
    rows += [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32)]
    found = {x.vec_id: x.n_links for x in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    m = np.array([v for i, v in rows if i < 900], dtype=np.float32).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = ((m @ m.T) >= 0.95).sum(1) - 1
    assert {900: 0, 901: 0, 902: 0}.items() <= found.items()
    got = np.array([found[i] for i in range(len(m))])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()


def test_licences_own_and_inherited(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/x", "plain words here"),
        (3, "a/b/y", "some text\n# Licensed under the Apache License, Version 2.0.\nmore"),
        (4, "c/z", "plain words here"),
        (5, None, None),
        (6, "a/b/c/e", ""),
        (None, "a/q", "Released under the MIT License."),
    ]
    got = {r.doc_id: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("Apache-2.0", "own"), 4: (None, "none"), 5: (None, "none"), 6: ("MIT", "inherited"), None: (None, "none")}
    assert licences.scan(spark.createDataFrame([], "doc_id long, path string, text string")).count() == 0


def test_decontamination_finds_items_in_long_texts(docs, spark):
    held = docs.where("doc_id = 10").first().text.split()[5000:5030]
    items = spark.createDataFrame([(1, " ".join(held)), (2, " ".join(words(77, 30))), (3, None), (4, "")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontamination.pairs(docs, items).collect()] == [(10, 1)]
    assert decontamination.cleaned(docs, items).count() == docs.count() - 1


def test_language_of_held_out_texts(spark):
    r = np.random.default_rng(3)
    make = lambda parts: " ".join("".join(r.choice(parts, 3)) for _ in range(30))
    rows = [(i, make(["ab", "ac", "ad"]) if i % 2 else make(["xy", "xz", "xw"]), "one" if i % 2 else "two", "s") for i in range(120)]
    model = langid.train(spark.createDataFrame(rows[:90], SCHEMA))
    got = langid.predict(spark.createDataFrame([*rows[90:], (500, None, "one", "s"), (501, "12 34", "one", "s")], SCHEMA), model).collect()
    assert all(x.lang_pred == (x.lang if x.doc_id < 500 else "und") and 0 <= x.lang_score <= 1 for x in got)


def test_toxicity_of_held_out_texts(spark):
    rows = [(i, " ".join(words(i, 40)) + (" hatefulword" if i % 4 == 0 else ""), "en", "s") for i in range(160)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows[:120], SCHEMA), labels)
    got = toxicity.score(spark.createDataFrame([*rows[120:], (500, None, None, None)], SCHEMA), model).collect()
    assert all((x.toxicity >= model.params.threshold) == (x.doc_id % 4 == 0) for x in got if x.doc_id < 500)
    nothing = toxicity.train(spark.createDataFrame([], SCHEMA), labels)
    assert toxicity.score(spark.createDataFrame(rows[:1], SCHEMA), nothing).first().toxicity < 0.01
