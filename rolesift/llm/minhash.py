"""Near-duplicates of whole texts by BagMinHash signatures of their word-shingle multisets.

A text is the multiset of its shingles of five words (lower case, cut at white space; a
shorter text is one shingle of all its words). Similarity is the weighted Jaccard
similarity of the multisets, and documents link from 0.8 on.

Signature: weights are discretised at 0, 1, 2, 4, 8, ... and within an interval at whole
numbers. Every (shingle, interval) has a Poisson process of the interval's length as its
rate, seeded by both. Each of its points falls on one of the m components at a time and on
a place in the interval, found by halving it; the point counts where the shingle's weight
reaches beyond the place. A component keeps the first point that counts. Two components
are equal with the probability of the weighted Jaccard similarity. Points later than the
time by which all components have one are not made.

Candidates share a band of the signature. Texts that are equal word by word are one node,
so that a group of copies costs one row. Within a bucket, each node is compared with the
bucket's leader only, for a few rounds with other leaders; most nodes of a bucket then are
in one component. At last every node outside the bucket's largest component is compared
with all nodes of other components in the bucket: blocks of both are dealt over tasks, and
only verified links leave a task, so no candidate link is lost and no pair is ever a row.
Links are verified by the exact multisets of 64-bit shingle hashes, which are written once,
for candidates only.

Cases: null texts and texts without words link with nothing. Rows with one id are one
document: each of its texts may link, and all of them share its class. Rows without an id
link with nothing: they have no class, and stay when documents are dropped. Ids may be of any type with an order; the least one names a
class. Ties (equal texts) are one node. An empty table gives no rows. Other columns are
never read, and may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm.common import drop_scratch, forget_in_worker, free_name, sized, slices, texts, written
from rolesift.llm.components import components


@dataclass(frozen=True)
class Params:
    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 6  # a pair at 0.8 shares a band with probability 0.998, one at 0.6 with 0.62, one at 0.4 with 0.08
    leader_rounds: int = 1
    block: int = 256  # nodes compared with each other at once, and their bytes
    block_bytes: int = 8_000_000

    @property
    def size(self) -> int:
        return self.bands * self.rows


def words_of(text: str) -> list[str]:
    return text.lower().split()


def shingle_counts(text: str, n: int) -> Counter:
    w = words_of(text)
    if not w:
        return Counter()
    return Counter(zip(*(w[i:] for i in range(n)), strict=False)) if len(w) >= n else Counter([tuple(w)])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets; 0 if one is empty."""
    if not a or not b:
        return 0.0
    if len(b) < len(a):
        a, b = b, a
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (a.total() + b.total() - both)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of a text and their weights."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(x, len(known)) for x in w), np.int64, len(w))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, known), np.uint64, len(known))[at]
    k = min(n, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = (out + h[i : i + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
    """BagMinHash signatures (bags x m times); a row of infinities for an empty bag. All bags are worked on at once."""
    out = np.full((len(bags), m), np.inf)
    flat = out.reshape(-1)
    total = np.array([w.sum() for _, w in bags], np.float64)
    if not len(bags) or not total.any():
        return out
    element = np.concatenate([e for e, _ in bags])
    weight = np.concatenate([w for _, w in bags])
    doc = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    # The processes: each element's intervals that begin below its weight.
    seeds, rates, reach, docs = [mix(element)], [np.ones(len(element))], [np.ones(len(element))], [doc]
    low, level = 1, 1
    while (more := np.flatnonzero(weight > low)).size:
        seeds.append(mix(element[more] + np.uint64(level * 0xD6E8FEB86659FD93 % 2**64)))
        rates.append(np.full(len(more), float(low)))
        reach.append(np.minimum(1.0, (weight[more] - low) / low))
        docs.append(doc[more])
        low, level = 2 * low, level + 1
    seed, rate, reach, doc = map(np.concatenate, (seeds, rates, reach, docs))
    step = np.zeros(len(seed), np.uint64)

    def uniform(s: np.ndarray, k: np.ndarray, salt: int) -> np.ndarray:
        return ((mix(s + (k * np.uint64(4) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    time = -np.log(uniform(seed, step, 1)) / rate
    until = np.where(total > 0, m * (np.log(m) + 3.0) / np.maximum(total, 1), 0.0)
    live = np.arange(len(seed))
    while live.size:
        now = live
        while now.size:
            now = now[time[now] <= until[doc[now]]]
            if not now.size:
                break
            s, k = seed[now], step[now]
            # The place in the interval, as the bits of its halvings; beyond the weight the point does not count.
            counts = uniform(s, k, 2) < reach[now]
            hit = now[counts]
            np.minimum.at(flat, doc[hit] * m + (mix(seed[hit] + (step[hit] * np.uint64(4) + np.uint64(3)) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(m)).astype(np.int64), time[hit])
            step[now] = k + np.uint64(1)
            time[now] -= np.log(uniform(s, k + np.uint64(1), 1)) / rate[now]
        short = np.isinf(out).any(axis=1) & (total > 0)
        until[short] *= 1.5
        live = np.flatnonzero(short[doc]) if short.any() else np.zeros(0, np.int64)
    return out


def band_keys(signature: np.ndarray, p: Params) -> np.ndarray:
    """One 64-bit key a band, with the band's number in it."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), p.bands, p.rows)
    out = np.broadcast_to(np.arange(p.bands, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F), bits.shape[:2]).copy()
    for i in range(p.rows):
        out = mix(out + bits[:, :, i])
    return out.view(np.int64)


def digests(rows: list[str]) -> np.ndarray:
    """128-bit hashes of the texts' words in order, as two longs each."""
    found = b"".join(xxhash.xxh3_128_digest(" ".join(words_of(x)).encode("utf-8", "surrogatepass")) for x in rows)
    return np.frombuffer(found, ">i8").reshape(-1, 2).astype(np.int64)


def signed(docs: DataFrame, p: Params, key: str, text: str) -> DataFrame:
    """(row, id, h1, h2, bands) of rows with an id: a number for the row, the hash of a text's words in order, and its band keys (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        at = TaskContext.get().partitionId() << 33
        for part in slices(batches, rows=256, chars=1_000_000, text="__text"):
            rows = texts(part, "__text")
            bags = [bag(x, p.words) for x in rows]
            keys = band_keys(signatures(bags, p.size), p)
            digest = digests(rows)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * p.bands), pa.array(keys.reshape(-1)), mask=pa.array([not len(e) for e, _ in bags]))
            yield pa.RecordBatch.from_arrays([pa.array(at + np.arange(len(rows))), part.column("id"), pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands], names=["row", "id", "h1", "h2", "bands"])
            at += len(rows)

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("__text"))
    schema = T.StructType([T.StructField("row", T.LongType()), rows.schema["id"], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema)


def bags_of(nodes: DataFrame, docs: DataFrame, p: Params, key: str, text: str) -> DataFrame:
    """(node, hashes, counts) of the nodes (node, id, h1, h2): sorted shingle hashes and their counts, as bytes. Texts are read once more, those of the nodes only."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("__text")).join(sized(nodes), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=256, chars=1_000_000, text="__text"):
            rows = texts(part, "__text")
            found = digests(rows)
            # One id may stand for several texts: the node's own is the one with its hash.
            own = (found[:, 0] == np.asarray(part.column("h1"))) & (found[:, 1] == np.asarray(part.column("h2")))
            bags = [bag(rows[i], p.words) for i in np.flatnonzero(own)]
            yield pa.RecordBatch.from_arrays(
                [part.column("node").filter(pa.array(own)), pa.array([e.tobytes() for e, _ in bags], pa.binary()), pa.array([w.astype("<i4").tobytes() for _, w in bags], pa.binary())],
                names=["node", "hashes", "counts"],
            )

    return rows.mapInArrow(run, "node long, hashes binary, counts binary").groupBy("node").agg(F.first("hashes").alias("hashes"), F.first("counts").alias("counts"))


def _bag(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(hashes, "<u8"), np.frombuffer(counts, "<i4")


def bag_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags of sorted hashes."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def verified(pairs: DataFrame, bags: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the threshold."""
    left, right = (bags.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}"), F.col("counts").alias(f"c{x}")) for x in "ab")
    # The hint keeps a table of bags from ever being broadcast; a leader with very many rows is split by the adaptive join.
    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=256):
            columns = [part.column(c).to_pylist() for c in ("ha", "ca", "hb", "cb")]
            keep = [bag_similarity(_bag(ha, ca), _bag(hb, cb)) >= p.similarity - 1e-12 for ha, ca, hb, cb in zip(*columns, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ha", "ca", "hb", "cb").mapInArrow(run, "a long, b long")


def block_links(frame: pd.DataFrame, p: Params) -> pd.DataFrame:
    """The links between the outer nodes of a block and the others of different components, by one inverted list of the outer nodes' shingles."""
    outer = frame[frame["outer"]].drop_duplicates("node")
    inner = frame[frame["inner"]].drop_duplicates("node")
    bags = [_bag(h, c) for h, c in zip(outer["hashes"], outer["counts"], strict=True)]
    out: list[tuple[int, int]] = []
    if not bags or not len(inner):
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
    owner = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    hashes, counts = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags]).astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    hashes, counts, owner = hashes[order], counts[order], owner[order]
    size, names, labels = np.array([int(c.sum()) for _, c in bags]), outer["node"].to_numpy(), outer["label"].to_numpy()
    for node, label, h, c in zip(inner["node"], inner["label"], inner["hashes"], inner["counts"], strict=True):
        h, c = _bag(h, c)
        first, last = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        times = last - first
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        both = np.bincount(owner[at], weights=np.minimum(counts[at], np.repeat(c, times)), minlength=len(bags))
        near = np.flatnonzero((both / (size + int(c.sum()) - both) >= p.similarity - 1e-12) & (labels != label))
        out += [(min(node, names[i]), max(node, names[i])) for i in near]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def placed_in(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, label): the members of buckets with their component so far."""
    return members.select("key", "node").join(label.withColumnRenamed("component", "label"), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))


def open_buckets(members: DataFrame, label: DataFrame, turn: int) -> DataFrame:
    """(key, node, label, lead) of the buckets that hold several components; lead: another (node, label) of the bucket each turn."""
    placed = placed_in(members, label)
    mixed = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min_by(F.struct("node", "label"), F.xxhash64("node", F.lit(turn))).alias("lead")).where("least < most")
    # An expression of the key, so that the join deals both sides anew and can split a hot bucket over tasks.
    return placed.join(mixed.select(F.col("key").bitwiseXOR(F.lit(0).cast("long")).alias("key"), "lead"), "key")


def remaining_blocks(members: DataFrame, label: DataFrame, weight: DataFrame, p: Params) -> DataFrame:
    """(key, x, y, node, label, outer, inner): of each bucket with several components, blocks of its outer nodes (those outside its largest component) against blocks of all its nodes. weight: (node, bytes)."""
    placed = open_buckets(members, label, 0).select("key", "node", "label").join(weight, "node")
    groups = placed.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    largest = groups.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    top = groups.join(largest.select("key", "top.label"), ["key", "label"]).select("key", F.col("n").alias("n_top"), F.col("bytes").alias("bytes_top"))
    plan = written(
        largest.join(top, "key").select(
            "key",
            F.col("top.label").alias("top"),
            F.ceil(F.greatest((F.col("n") - F.col("n_top")) / p.block, (F.col("bytes") - F.col("bytes_top")) / p.block_bytes)).cast("int").alias("outers"),
            F.ceil(F.greatest(F.col("n") / p.block, F.col("bytes") / p.block_bytes)).cast("int").alias("inners"),
        ),
        "blocks",
    )
    rows = placed.join(plan, "key").withColumn("outer", F.col("label") != F.col("top"))
    deal = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    inner = rows.select("key", each("outers").alias("x"), deal("inners", 1).alias("y"), "node", "label", F.lit(False).alias("outer"), F.lit(True).alias("inner"))
    outer = rows.where("outer").select("key", deal("outers", 2).alias("x"), each("inners").alias("y"), "node", "label", F.lit(True).alias("outer"), F.lit(False).alias("inner"))
    return inner.unionByName(outer)


def node_components(members: DataFrame, bags: DataFrame, p: Params) -> DataFrame:
    """(node, component) of the nodes that any chain of verified candidate links joins. members: (key, leader, node)."""
    links = verified(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), bags, p)
    label = written(components(links), "labels")
    for turn in range(1, p.leader_rounds + 1):
        rows = open_buckets(members, label, turn).where("label <> lead.label")
        pairs = written(rows.select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():  # every bucket is one component
            return label
        label = written(components(verified(pairs, bags, p), known=label), "labels")
    weight = bags.select("node", (F.length("hashes") + F.length("counts")).cast("long").alias("bytes"))
    blocks = written(remaining_blocks(members, label, weight, p), "remaining")
    if blocks.isEmpty():
        return label
    last = blocks.join(bags.hint("merge"), "node").groupBy("key", "x", "y").applyInPandas(lambda frame: block_links(frame, p), "a long, b long")
    return written(components(last, known=label), "labels")


def classes(docs: DataFrame, p: Params = Params(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id) for every different id: class_id is the least id that it links with, over any number of links."""
    spark = docs.sparkSession
    table = written(signed(docs, p, key, text), "signed")
    # Copies: one node for each text, named by the least of its rows' numbers. Copies within a task meet before the shuffle.
    nodes = written(table.where("bands is not null").groupBy("h1", "h2").agg(F.min(F.struct("row", "id", "bands")).alias("n")).select("h1", "h2", F.col("n.row").alias("node"), F.col("n.id").alias("id"), F.col("n.bands").alias("bands")), "nodes")
    entries = nodes.select("node", F.explode("bands").alias("key"))
    shared = written(entries.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"), "shared")
    # Only entries of buckets with company go on; most buckets hold one node.
    members = written(entries.join(shared, "key").select("key", "leader", "node"), "members")
    candidates = written(nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", "id", "h1", "h2"), "candidates")
    bags = written(bags_of(candidates, docs, p, key, text), "bags", "zstd")
    label = node_components(members, bags, p)
    for gone in (members, shared, candidates, bags):
        drop_scratch(spark, gone)
    # Each id with its nodes; an id of several texts joins them.
    of = written(table.where("bands is not null").select("id", "h1", "h2").distinct().join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "node"), "of")
    several = of.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("id", "a")
    several = written(of.join(several, "id").where("node <> a").select("a", F.col("node").alias("b")), "several")
    if not several.isEmpty():
        label = written(components(several, known=label), "labels")
    named = of.join(label, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    least = written(named.groupBy("component").agg(F.min("id").alias("class_id")), "least")
    found = written(named.join(least, "component").groupBy("id").agg(F.min("class_id").alias("class_id")), "found")
    rest = table.select("id").distinct().join(found, "id", "left")
    return rest.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"))


def deduplicated(docs: DataFrame, p: Params = Params(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the document with the least id of each class, with all their columns; of an id's rows with the same words one stays, every different text does. Rows without an id stay."""
    found = written(classes(docs, p, key=key, text=text), "classes")
    name, mark = free_name(docs.columns, "gone"), free_name(docs.columns, "repeat")
    gone = written(found.where(F.col(key) != F.col("class_id")).select(F.col(key).alias(name)), "gone")
    kept = docs.join(sized(gone), F.col(key) == F.col(name), "left_anti")
    repeats = written(docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(name)).count().where("count > 1").select(name), "repeats")
    if repeats.isEmpty():
        return kept
    # Rows that repeat an id and a text, word by word: one of them stays.
    again = kept.join(sized(repeats), F.col(key) == F.col(name), "left_semi")
    window = Window.partitionBy(F.col(key), F.sha2(F.regexp_replace(F.trim(F.lower(F.coalesce(F.col(text), F.lit("")))), r"\s+", " "), 256)).orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
    again = again.withColumn(mark, F.row_number().over(window)).where(F.col(mark) == 1).drop(mark)
    return kept.join(sized(repeats), F.col(key) == F.col(name), "left_anti").unionByName(again)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
