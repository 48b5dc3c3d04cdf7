"""Training-order shards: slots from rows alone, whole files, and reading from any slot on."""

import base64

import numpy as np
import pytest
import regex
import tiktoken

from rolesift.llm import bpe, token_shards
from rolesift.llm.common import shared_dir

P = token_shards.Params(length=8, shard=16, passes=3)


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(2)
    made = [(i % 50 if i % 7 else None, " ".join(f"w{x}" for x in r.integers(0, 900, r.integers(0, 40)))) for i in range(120)]
    return [*made, (3, None), (4, ""), (5, "same text"), (5, "same text"), (5, "other text")]


def made(spark, rows, folder, split, schema="doc_id long, text string"):
    frame = spark.createDataFrame(rows, schema).repartition(split)
    return sorted((r.slot, r.shard, r.offset, r.doc_id is None, r.doc_id, r.part, r.n_tokens, r.sha256) for r in token_shards.materialise(frame, *bpe.default_ranks(), P, folder=str(folder)).collect())


def test_slots_do_not_depend_on_the_split(spark, rows, tmp_path):
    a, b = made(spark, rows, tmp_path / "a", 1), made(spark, rows[::-1], tmp_path / "b", 9)
    assert a == b and [x[0] for x in a] == list(range(len(a)))
    assert not [x for x in (tmp_path / "a").iterdir() if x.name.endswith(".part")]


def test_reader_returns_what_the_library_encodes(spark, rows, tmp_path):
    found = made(spark, rows, tmp_path / "a", 4)
    ranks, pattern = bpe.default_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}, special_tokens={})
    reader = token_shards.ShardReader(str(tmp_path / "a"))
    whole = reader.read(0, len(reader))
    assert len(whole) == len(found)
    assert (reader.read(13, 21) == whole[13:34]).all() and len(reader.read(len(reader), 5)) == 0
    want = sorted(tuple(x[k : k + 8]) + (P.fill,) * (8 - len(x[k : k + 8])) for _, t in rows for x in [[*library.encode_ordinary(t or ""), P.end]] for k in range(0, len(x), 8))
    assert sorted(map(tuple, whole.tolist())) == want


def test_no_rows_string_ids_and_other_columns(spark, tmp_path):
    assert made(spark, [], tmp_path / "none", 1) == []
    frame = spark.createDataFrame([("b", "x", 1), ("a", "y", 2)], "doc_id string, text string, __text int")
    assert {r.doc_id for r in token_shards.materialise(frame, *bpe.default_ranks(), P, folder=str(tmp_path / "s")).collect()} == {"a", "b"}


def test_a_repeated_task_leaves_the_same_files(spark, rows, tmp_path):
    made(spark, rows, tmp_path / "a", 2)
    before = {f.name: f.read_bytes() for f in (tmp_path / "a").iterdir()}
    made(spark, rows, tmp_path / "a", 5)
    assert before == {f.name: f.read_bytes() for f in (tmp_path / "a").iterdir()}


def test_more_white_space_in_a_row_than_the_library_takes(spark, tmp_path):
    text = "word" + " " * 1_000_001 + "x" + "\n" * 1_000_000
    params = token_shards.Params(length=4096, shard=16, passes=1)
    ranks, pattern = bpe.default_ranks()
    frame = spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")
    found = token_shards.materialise(frame, ranks, pattern, params, folder=str(tmp_path / "w")).collect()
    whole = token_shards.ShardReader(str(tmp_path / "w")).read(0, len(found))
    ids = np.concatenate([whole[r.slot, : r.n_tokens] for r in sorted(found, key=lambda r: r.part) if r.doc_id == 1]).tolist()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}, special_tokens={})
    with pytest.raises(BaseException, match="StackOverflow"):
        library.encode_ordinary(text)
    assert ids == [*(i for piece in regex.findall(pattern, text) for i in library._encode_single_piece(piece)), params.end]


def test_the_shared_folder_needs_no_scheme(spark, rows, tmp_path, monkeypatch):
    assert shared_dir(spark)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(token_shards.materialise(frame, *bpe.default_ranks(), P).collect())
    monkeypatch.setattr(spark.sparkContext, "master", "local-cluster[2,1,1024]")
    assert sorted(token_shards.materialise(frame, *bpe.default_ranks(), P).collect()) == want
    with pytest.raises(ValueError, match="local to each machine"):
        token_shards.materialise(frame, *bpe.default_ranks(), P, folder=str(tmp_path / "own"))
