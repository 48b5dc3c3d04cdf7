"""The five stages of the pipeline together, on planted rows, against plain Python."""

import base64
import hashlib
from itertools import combinations

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from rolesift.llm import bpe, minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "xyxzxw xwxwxy xzxzxz xyxyxw xwxzxy xyxwxz xzxyxz xwxyxy xyxzxz xzxwxw"


def planted():
    r = np.random.default_rng(11)
    parts = {"one": ["ab", "ac", "ad"], "two": ["xy", "xz", "xw"]}
    prose = lambda lang: ["".join(r.choice(parts[lang], 3)) for _ in range(45)]
    rows = []
    for i in range(160):
        lang = "one" if i % 2 else "two"
        rows.append((i, " ".join(prose(lang) + ["hatefulword"] * (i % 4 == 0)), lang))
    texts = {i: t for i, t, _ in rows}
    near = texts[5].split()
    near[43] = "adadad"
    far = texts[7].split()[:22] + prose("one")[:23]
    rows += [(200, texts[5], "one"), (201, " ".join(near), "one"), (202, " ".join(far), "one"), (203, texts[8], "two")]
    rows += [(204, " ".join(prose("two")[:20] + ITEM.split() + prose("two")[:20]), "two")]
    # Six words of the item make two of its six shingles: too few.
    rows += [(205, " ".join(prose("two")[:20] + ITEM.split()[:6] + prose("two")[:20]), "two")]
    rows += [(206, None, "one"), (207, "12 34 --", "one"), (208, "", None)]
    return [(i, t, lang, f"s{i % 3}", None if t is None else len(t)) for i, t, lang in rows]


def expected(rows):
    """One document of each near-duplicate group, the least id, of those that are clean and have letters, without the item."""
    left = {i: t for i, t, *_ in rows if t and "hatefulword" not in t and any(c.isalpha() for c in t)}
    label = {i: i for i in left}
    bags = {i: minhash.shingle_counts(t, 5) for i, t in left.items()}
    for a, b in combinations(sorted(left), 2):
        if minhash.similarity(bags[a], bags[b]) >= 0.8:
            low, high = sorted((label[a], label[b]))
            label = {k: low if v == high else v for k, v in label.items()}
    shingles = lambda t: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)}
    item = shingles(ITEM)
    kept = {i for i in left if label[i] == i and len(item & shingles(left[i])) < 0.8 * len(item)}
    ranks, pattern = bpe.default_ranks()
    known = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
    return {(i, tuple(library.encode_ordinary(left[i])), hashlib.sha256(left[i].encode()).hexdigest()) for i in kept}


def written_tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_matches_plain_python(spark, tmp_path):
    rows = planted()
    written_tables(spark, tmp_path, rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected(rows)
    assert len(got) == len(want) and {(r.doc_id, tuple(r.token_ids), r.decoded_sha256) for r in got} == want
    ids = {r.doc_id for r in got}
    assert {5, 7, 202, 205} <= ids and not ids & {8, 200, 201, 203, 204, 206, 207, 208}


def test_pipeline_of_no_documents(spark, tmp_path):
    written_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
