"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly. DataFrame functions only.

A text is cut into words (lower case, letters and digits only) and shingles of five words;
an item of fewer words is one shingle of all of them. A document holds an item if at least
0.8 of the item's different shingles occur in it.

Search: items are partitioned by their number of shingles n, and the sketch of an item are
the least hashes of its shingles, as many as the partition's upper bound u may miss at the
threshold, plus one: u - ceil(0.8 u) + 1. A document that holds the item holds one of
them, however long it is, so it is found by looking up the document's shingle hashes in
the sketches. Every pair found is then verified by the shingles themselves.

Cases: null texts, and texts or items without a word, are in no pair. Rows with one
doc_id (item_id) are one document (item): its shingles are those of all its rows. Rows
without an id are not searched, and stay in a cleaned table. Repeated rows change
nothing. Ties in a sketch's hashes are kept whole. An empty table of either kind gives no
pairs. Other columns are never read, and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.common import free_name, sized, written

@dataclass(frozen=True)
class Params:
    words: int = 5
    containment: float = 0.8


def words_of(text: str | Column) -> Column:
    """The words of a text; null for a null text, empty without words."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingle_hashes(words: str, k: int) -> Column:
    """Hashes of the k-word shingles of an array of word hashes; empty if it has fewer than k words."""
    size = F.size(words)
    made = F.transform(F.sequence(F.lit(0), size - k), lambda i: F.xxhash64(*(F.get(F.col(words), i + j) for j in range(k))))
    return F.when(size >= k, made).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(words: str, k: int) -> Column:
    """The k-word shingles themselves."""
    size = F.size(words)
    made = F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.array_join(F.slice(F.col(words), i, k), " "))
    return F.when(size >= k, made).otherwise(F.array().cast("array<string>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def pairs(docs: DataFrame, items: DataFrame, p: Params = Params(), *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_matched, n_shingles, containment) of every pair at or above the threshold."""
    cut = items.select(F.col(item_key).alias("item_id"), words_of(item_text).alias("w")).where("item_id is not null and size(w) > 0").withColumn("k", F.least(F.size("w"), F.lit(p.words)))
    lengths = range(1, p.words + 1)
    by_length = lambda make, words: F.coalesce(*(F.when(F.col("k") == k, make(words, k)) for k in lengths))
    entries = written(
        cut.withColumn("h", word_hashes(F.col("w")))
        .select("item_id", "k", F.explode(F.arrays_zip(by_length(shingle_texts, "w").alias("shingle"), by_length(shingle_hashes, "h").alias("hash"))).alias("e"))
        .select("item_id", "k", "e.shingle", "e.hash")
        .distinct(),
        "items",
    )
    sizes = entries.groupBy("item_id").agg(F.count("*").alias("n"))
    upper = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    sizes = sizes.withColumn("sketch", (upper - F.ceil(upper * F.lit(p.containment) - 1e-9) + 1).cast("int"))
    least = entries.groupBy("item_id", "k").agg(F.array_sort(F.collect_set("hash")).alias("hashes")).join(sizes, "item_id")
    sketches = written(least.select("item_id", "k", F.explode(F.slice("hashes", 1, F.col("sketch"))).alias("hash")), "sketches")
    used = sorted(r["k"] for r in sketches.select("k").distinct().collect())  # numbers from 1 to words

    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    hashed = rows.select("doc_id", word_hashes(words_of("__text")).alias("h"))
    found = None
    for k in used:
        hits = hashed.select("doc_id", F.explode(shingle_hashes("h", k)).alias("hash")).join(sized(sketches.where(F.col("k") == k).select("hash", "item_id")), "hash").select("doc_id", "item_id").distinct()
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = rows.select("doc_id").join(sketches.select("item_id"), F.lit(False))
    candidates = written(found.distinct(), "candidates")

    # Exact: the different shingles of candidate documents that are shingles of a candidate item.
    ids = candidates.select("doc_id").distinct()
    held = rows.join(sized(ids), "doc_id", "left_semi").select("doc_id", words_of("__text").alias("w"))
    matched = None
    for k in used:
        own = sized(entries.where(F.col("k") == k).select("item_id", "shingle"))
        part = held.select("doc_id", F.explode(F.array_distinct(shingle_texts("w", k))).alias("shingle")).join(own, "shingle")
        matched = part if matched is None else matched.unionByName(part)
    if matched is None:
        matched = candidates.select("doc_id", "item_id", F.lit("").alias("shingle"))
    counts = matched.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("n_matched"))
    share = F.col("n_matched") / F.col("n")
    return counts.join(candidates, ["doc_id", "item_id"], "left_semi").join(sized(sizes.select("item_id", "n")), "item_id").where(share >= p.containment - 1e-9).select("doc_id", "item_id", "n_matched", F.col("n").alias("n_shingles"), share.alias("containment"))


def cleaned(docs: DataFrame, items: DataFrame, p: Params = Params(), *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    leak = free_name(docs.columns, "leak")
    leaks = written(pairs(docs, items, p, key=key, text=text, item_key=item_key, item_text=item_text).select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(sized(leaks), F.col(key) == F.col(leak), "left_anti")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


ORACLE_SQL = r"""
WITH d0 AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i0 AS (SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
d1 AS (SELECT doc_id, string_split(t, ' ') AS w FROM d0 WHERE t <> ''),
i1 AS (SELECT item_id, string_split(t, ' ') AS w, least(5, len(string_split(t, ' '))) AS k FROM i0 WHERE t <> ''),
i2 AS (SELECT item_id, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM i1),
i3 AS (SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM i2),
n AS (SELECT item_id, count(*) AS n FROM i3 GROUP BY item_id),
d2 AS (SELECT doc_id, k, w, unnest(range(1, CAST(len(w) - k + 2 AS BIGINT))) AS p FROM d1, (SELECT DISTINCT k FROM i1) WHERE len(w) >= k),
d3 AS (SELECT DISTINCT doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS s FROM d2),
m AS (SELECT doc_id, item_id, count(*) AS n_matched FROM d3 JOIN i3 USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_matched, n AS n_shingles, n_matched / n AS containment FROM m JOIN n USING (item_id) WHERE n_matched / n >= 0.8 - 1e-9
"""
