"""The encoder's cache: a piece is encoded once while it is kept, and a trimmed cache changes nothing."""

import random

import numpy as np
import pytest

from rolesift.llm import bpe


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(*bpe.default_ranks())


def test_a_piece_beside_other_marks_is_encoded_once(vocabulary):
    seen = []
    encoder = bpe.TextEncoder(vocabulary, lambda pieces: seen.extend(pieces) or vocabulary.encode_pieces(pieces))
    for text in ("some qwertyish, words", "some qwertyish. words", "(some qwertyish!) words\nwords"):
        assert encoder(text) == vocabulary.encode(text)
    assert len(seen) == len(set(seen)) and seen.count(" qwertyish") == 1


def test_a_trimmed_cache_gives_the_same_ids_and_bytes(vocabulary, monkeypatch):
    r = random.Random(4)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    monkeypatch.setattr(bpe, "CACHE_IDS", 200)
    encoder = bpe.TextEncoder(vocabulary)
    marks = [" ", "  ", "\n", ", ", "'ll ", "\0", "é", "漢字", " 12", "!?"]
    for _ in range(60):
        rows = ["".join("".join(r.choices("abeinrst", k=r.randint(1, 9))) + r.choice(marks) for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 4))] + ["", "zz" * 300]
        ids, begins = encoder.flat(rows)
        data, at = vocabulary.bytes_of(ids)
        for k, text in enumerate(rows):
            assert ids[begins[k] : begins[k + 1]].tolist() == vocabulary.encode(text)
            assert data[at[begins[k]] : at[begins[k + 1]]].tobytes() == text.encode()
        encoder.trim()
        assert len(encoder.known) < 40 and len(encoder.ids) < 200 and len(encoder.known) == len(encoder.start) == len(encoder.size) == len(encoder.used)
    ids, begins = encoder.flat([])
    assert ids.tolist() == [] and begins.tolist() == [0] and vocabulary.bytes_of(ids)[0].tolist() == []


def test_a_byte_without_a_rank_leaves_nothing_behind():
    import base64

    few = bpe.Vocabulary(b"\n".join(base64.b64encode(bytes([x])) + b" %d" % k for k, x in enumerate(b"ab ")), bpe.default_ranks()[1])
    encoder = bpe.TextEncoder(few)
    for _ in range(2):
        with pytest.raises(ValueError):
            encoder("ab xb")
    assert encoder("ab ab") == [0, 1, 2, 0, 1]


def test_spans():
    at, begins = bpe.spans(np.array([5, 0, 7]), np.array([2, 0, 3]))
    assert at.tolist() == [5, 6, 7, 8, 9] and begins.tolist() == [0, 2, 2, 5]
