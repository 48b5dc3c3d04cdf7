"""The language model against brute force: base score, whole score, and probabilities that add up to one."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from rolesift.llm import lm

P = lm.Params(head_words=60, own_leaves=20, rows=1 << 10)
SCHEMA = "doc_id long, text string, __row int, __Known string, score string"


@pytest.fixture(scope="module")
def made(spark):
    r = np.random.default_rng(1)
    rows = []
    for i in range(150):
        at, out = int(r.integers(0, 80)), []
        for _ in range(int(r.integers(0, 60))):
            out.append(f"w{at}")
            at = (at * 7 + int(r.integers(0, 3))) % 80 if r.random() < 0.9 else int(r.integers(0, 400))
        rows.append((i, " ".join(out).upper() if i % 9 == 0 else "\n".join(out), i, "x", "y"))
    rows += [(200, None, 1, "", ""), (201, "", 1, "", ""), (202, "never seen words", 1, "", ""), (7, rows[7][1], 1, "", ""), (None, "w1 w2", 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = lm.train(docs.where(~lm.held_out()), P)
    return rows, model, lm.score(docs, model).collect()


def tokens(text):
    return [*(text or "").encode().lower().split(), lm.END]


def is_held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_base_score_and_counts(made):
    rows, _, got = made
    counts = Counter(t for i, text, *_ in rows if not is_held_out(i) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), len(t), sum(counts[x] > 0 for x in t), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in t), 6)) for i, text, *_ in rows for t in [tokens(text)])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def token_probability(model, before, word, known):
    """P(word | three words before), by plain loops over the weights."""
    h = [np.uint32(0x5EED) if x is None else (lm.xxhash.xxh3_64_intdigest(x) >> 32) & 0xFFFFFFFF for x in before]
    c, b, a = (int(x) for x in h)
    m = 0xFFFFFFFF
    pair = (a * 0x9E3779B1 & m) ^ (b + 0x85EBCA6B & m)
    triple = (pair * 0xC2B2AE35 & m) ^ (c + 0x27D4EB2F & m)
    features = np.array([[a], [b * 3 + 1 & m], [pair], [triple]], np.uint32)
    leaf, out = int(model.words.leaf(lm.endings([word]))[0]), 1.0
    for k in range(3):
        context, digit = leaf >> 4 * (3 - k), leaf >> 4 * (2 - k) & 15
        z = model.start[k][context].astype(float)
        for row in lm.level_rows(features, np.array([context]), k, model.params.rows)[:, 0]:
            z = z + model.weights[k][row]
        e = np.exp(z - z.max())
        out *= e[digit] / e.sum()
    return out * (known.get(word, 0) + 1) / 10 ** model.log_total[leaf]


def test_score_by_plain_loops(made):
    rows, model, got = made
    counts = Counter(t for i, text, *_ in rows if not is_held_out(i) for t in tokens(text))
    found = {str(r.doc_id): r.score for r in got}
    for i, text, *_ in [*rows[:12], *rows[-5:-2]]:
        t = [None, None, None, *tokens(text)]
        want = sum(math.log10(token_probability(model, t[k - 3 : k], t[k], counts)) for k in range(3, len(t)))
        assert found[str(i)] == pytest.approx(want, abs=1e-3)


def test_probabilities_add_up_to_one(made):
    rows, model, _ = made
    counts = Counter(t for i, text, *_ in rows if not is_held_out(i) for t in tokens(text))
    known = sum(token_probability(model, [b"w1", b"w7", b"w49"], w, counts) for w in counts)
    # The rest is left to one unseen word a leaf; leaves without any word keep half a token's share.
    assert 0.3 < known <= 1.0


def test_history_helps_on_held_out_texts(made):
    _, _, got = made
    held = [r for r in got if r.doc_id is not None and r.doc_id < 150 and is_held_out(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    model = lm.train(none, P)
    assert lm.score(none, model).count() == 0
    only = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), model).first()
    assert (only.n_tokens, only.n_known, only.train_tokens) == (3, 0, 0) and only.base_score == 0


def test_blocks_are_words_of_plain_splits_hashed_once_a_task(monkeypatch):
    rows = ["", "A a\tB\x0bb\x0c\r\n\x1c\x85 \x00 \x00\x00", "é" * 40 + " É x" + "y" * 64, "q" * 64 + " " + "q" * 65 + " " + "q" * 65, " ", "\udc80 a", " ".join(f"w{i % 300}" for i in range(900))]
    calls, digest = Counter(), lm.xxhash.xxh3_64_intdigest
    counted = lambda x: calls.update([bytes(x)]) or digest(x)
    hashes = lm.Hashes()
    monkeypatch.setattr(lm.xxhash, "xxh3_64_intdigest", counted)
    for part in (rows[:3], rows[3:], rows, []):
        block = lm.Block(part, hashes)
        want = [(i, w) for i, x in enumerate(part) for w in [*x.encode("utf-8", "surrogatepass").lower().split(), lm.END]]
        assert block.doc.tolist() == [i for i, _ in want]
        assert block.hash.view(np.uint64)[block.token].tolist() == [digest(w) for _, w in want]
        assert block.ending[block.token].tolist() == lm.endings([w for _, w in want]).tolist() if want else not len(block.token)
        assert len(set(block.hash.tolist())) == len(block.hash) == len({lm.END, *(w for _, w in want)})
    assert all(n == 1 for w, n in calls.items() if w != lm.END and len(w) <= lm.SHORT)


@pytest.mark.parametrize("tokens", [1, 2, 37, 70_000])
def test_an_update_adds_up_repeated_rows(tokens):
    r = np.random.default_rng(tokens)
    rows = r.integers(0, 50, (4, tokens)).astype(np.uint16)
    d = r.normal(size=(tokens, lm.WIDTH)).astype(np.float32)
    w, seen = r.normal(size=(64, lm.WIDTH)).astype(np.float32), np.full(64, 1e-2, np.float32)
    want, sums = w.astype(float), np.zeros((64, lm.WIDTH))
    for k in range(4):
        np.add.at(sums, rows[k], d)
    there = np.unique(rows)
    total = 1e-2 + (sums[there] ** 2).sum(axis=1)
    want[there] -= sums[there] * (0.1 / np.sqrt(total))[:, None]
    lm.update(w, seen, rows, d, 0.1)
    assert np.allclose(w, want, atol=1e-4) and np.allclose(seen[there], total, rtol=1e-3)
