"""Hard negatives by product quantisation with stored residual norms, exact in the end.

Every component x becomes the whole number floor(256 x), x in double precision, and a row's
score is its inner product with the anchor. A row is stored as a code (for each pair of
components, the nearest of 256 centroids) and the norm of what the code leaves over. The
anchor's table of inner products with the centroids gives an estimate, and by Cauchy-Schwarz
the true score is within (anchor's norm x residual norm) of it. These bounds leave out only
rows that can't be among the best of a block; what is left is scored exactly in whole
numbers, and the bests of all blocks meet in a ranking by anchor.

1. Positives: the first rows of the anchor's label. Labels are dealt into parts by a hash,
   and a part's anchors and rows into blocks, so that a label of any size is shared by tasks.
2. Negatives: for each anchor and positive, the first rows of other labels whose score lies in
   the window from `low` to `high` per cent of the positive's. All rows, in blocks.

The codebooks are fitted on at most Params.sample rows and Params.sample_bytes bytes (those
with the least hashes), for at most Params.lengths vector lengths. They decide the work, never
the result: every row is encoded, and a row of another length has the zero code, with its
whole norm as residual.

Cases: rows without an id, label or vector, and those with a null or non-finite component (or
one that 256 x makes non-finite) take no part. Vectors are scored against those of their own
length only; an empty one scores 0 with other empty ones. Repeated rows are rows of their own:
a copy of an anchor is one of its positives, and each copy is an anchor. Ties go to the smaller
id. Scores beyond a long are kept at its limits. An empty table gives no rows. Other
columns are never read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm.common import drop_scratch, sized, written


@dataclass(frozen=True)
class Params:
    positives: int = 5
    negatives: int = 3
    low: int = 50  # per cent of the positive's score
    high: int = 95
    sub: int = 2  # components a code number stands for
    centroids: int = 256
    sample: int = 4096
    sample_bytes: int = 32_000_000
    lengths: int = 4
    rounds: int = 6
    block: int = 8192  # rows, or anchors, of a block, and their bytes
    block_bytes: int = 32_000_000
    at_once: int = 64  # anchors scored together
    seed: int = 13


def unpacked(data: list[bytes], size: int) -> np.ndarray:
    """Vectors of `size` components, stored as 32-bit numbers where they fit and as doubles otherwise."""
    if not size:
        return np.zeros((len(data), 0))
    return np.stack([np.frombuffer(x, "<i4" if len(x) == 4 * size else "<f8").astype(np.float64) for x in data])


def packed(vector: np.ndarray) -> bytes:
    return vector.astype("<i4").tobytes() if not len(vector) or np.abs(vector).max() < 2**31 else vector.astype("<f8").tobytes()


def exact(anchor: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Whole inner products: by doubles where no sum can pass 2**53, else by unbounded numbers, kept within a long."""
    most = float(np.abs(anchor).max(initial=0)) * float(np.abs(rows).max(initial=0)) * len(anchor)
    if most < 2**53:
        return (rows @ anchor).astype(np.int64)
    a = [int(x) for x in anchor]
    return np.array([max(-(2**63), min(2**63 - 1, sum(int(x) * y for x, y in zip(row, a, strict=True)))) for row in rows], np.int64)


def parts_of(x: np.ndarray, sub: int) -> np.ndarray:
    """rows x subspaces x sub, filled up with zeros."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % sub)))
    return x.reshape(len(x), -1, sub)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def fitted(x: np.ndarray, p: Params) -> np.ndarray:
    """Codebooks (subspaces x centroids x sub) by rounds of k-means, from rows picked by a fixed seed."""
    random, books = np.random.default_rng(p.seed), []
    for points in parts_of(x, p.sub).transpose(1, 0, 2):
        centres = points[random.choice(len(points), p.centroids, replace=len(points) < p.centroids)]
        for _ in range(p.rounds):
            own = nearest(points, centres)
            n = np.bincount(own, minlength=p.centroids)
            sums = np.stack([np.bincount(own, points[:, c], p.centroids) for c in range(p.sub)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        books.append(centres)
    return np.stack(books) if books else np.zeros((0, p.centroids, p.sub))


def encoded(x: np.ndarray, book: np.ndarray | None, sub: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x subspaces) and residual norms, never rounded down; without a book, no code and whole norms."""
    if book is None:
        return np.zeros((len(x), 0), np.uint8), np.sqrt((x**2).sum(axis=1)) * (1 + 1e-12)
    cut = parts_of(x, sub)
    codes, left = np.empty(cut.shape[:2], np.uint8), np.zeros(len(x))
    for m, centres in enumerate(book):
        codes[:, m] = nearest(cut[:, m], centres)
        left += ((cut[:, m] - centres[codes[:, m]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left) * (1 + 1e-9)


class Block:
    """The rows of a block, and bounds of their scores with anchors of the same length."""

    def __init__(self, rows: pd.DataFrame, books: dict[int, np.ndarray], p: Params):
        size = int(rows["size"].iloc[0])
        self.book, self.p, self.size = books.get(size), p, size
        self.x = unpacked(rows["ints"].tolist(), size)
        self.id, self.row, self.label = rows["id"].to_numpy(), rows["row"].to_numpy(), rows["label"].to_numpy()
        self.codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        self.left = rows["residual"].to_numpy()

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper): anchors x rows."""
        near = np.zeros((len(anchors), len(self.x)))
        if self.book is not None:
            tables = np.einsum("qms,mks->mqk", parts_of(anchors, self.p.sub), self.book, optimize=True)
            for m, table in enumerate(tables):
                near += table[:, self.codes[:, m]]
        norm = np.sqrt((anchors**2).sum(axis=1))
        # The slack is far above the rounding of sums of doubles, and far below 1 for vectors near unit length.
        off = norm[:, None] * (self.left + 1e-9 * np.sqrt((self.x**2).sum(axis=1)))[None, :] + 1e-6
        return near - off, near + off


def ordered(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k: highest score, then smallest id. ~score turns the order of whole numbers round without overflow."""
    return np.lexsort((rows, ids, ~scores))[:k]


def block_positives(frame: pd.DataFrame, books: dict[int, np.ndarray], p: Params) -> pd.DataFrame:
    """For each anchor of the block its first rows of the same label in the block."""
    out: list[tuple] = []
    for _, part in frame.groupby("size"):
        anchors, rows = part[part["anchor"]], part[~part["anchor"]]
        if not len(anchors) or not len(rows):
            continue
        block, vectors = Block(rows, books, p), unpacked(anchors["ints"].tolist(), int(rows["size"].iloc[0]))
        for at in range(0, len(anchors), p.at_once):
            some, a = anchors.iloc[at : at + p.at_once], vectors[at : at + p.at_once]
            lower, upper = block.bounds(a)
            own = (some["label"].to_numpy()[:, None] == block.label[None, :]) & (some["row"].to_numpy()[:, None] != block.row[None, :])
            for i, (name, number, label) in enumerate(zip(some["id"], some["row"], some["label"], strict=True)):
                mine = np.flatnonzero(own[i])
                if len(mine) > p.positives:
                    least = np.partition(lower[i, mine], -p.positives)[-p.positives]
                    mine = mine[upper[i, mine] >= least]
                scores = exact(a[i], block.x[mine])
                for j in ordered(scores, block.id[mine], block.row[mine], p.positives):
                    out.append((number, name, label, int(block.row[mine[j]]), block.id[mine[j]], int(scores[j])))
    return pd.DataFrame(out, columns=["anchor", "anchor_id", "label", "positive", "positive_id", "positive_score"])


def block_negatives(frame: pd.DataFrame, books: dict[int, np.ndarray], p: Params) -> pd.DataFrame:
    """For each anchor and positive of the block the first rows of other labels in the positive's window."""
    out: list[tuple] = []
    for _, part in frame.groupby("size"):
        anchors, rows = part[part["anchor"]], part[~part["anchor"]]
        if not len(anchors) or not len(rows):
            continue
        block, vectors = Block(rows, books, p), unpacked(anchors["ints"].tolist(), int(rows["size"].iloc[0]))
        for at in range(0, len(anchors), p.at_once):
            some, a = anchors.iloc[at : at + p.at_once], vectors[at : at + p.at_once]
            lower, upper = block.bounds(a)
            other = some["label"].to_numpy()[:, None] != block.label[None, :]
            for i, (name, number, positives) in enumerate(zip(some["id"], some["row"], some["positives"], strict=True)):
                windows = [(-(-s["positive_score"] * p.low // 100), s["positive_score"] * p.high // 100) for s in positives]
                if not any(low <= high for low, high in windows):
                    continue
                lo, up = lower[i], upper[i]
                mine = np.flatnonzero(other[i] & (up >= min(low for low, _ in windows)) & (lo <= max(high for _, high in windows)))
                lo, up = lo[mine], up[mine]
                for s, (low, high) in zip(positives, windows, strict=True):
                    sure = np.flatnonzero((lo >= low) & (up <= high))
                    least = np.partition(lo[sure], -p.negatives)[-p.negatives] if len(sure) > p.negatives else low
                    found = mine[(up >= max(low, least)) & (lo <= high)]
                    scores = exact(a[i], block.x[found])
                    inside = (scores >= low) & (scores <= high)
                    found, scores = found[inside], scores[inside]
                    for j in ordered(scores, block.id[found], block.row[found], p.negatives):
                        out.append((number, name, s["positive"], s["positive_id"], int(s["positive_score"]), int(block.row[found[j]]), block.id[found[j]], int(scores[j])))
    return pd.DataFrame(out, columns=["anchor", "anchor_id", "positive", "positive_id", "positive_score", "negative", "negative_id", "negative_score"])


def whole_vectors(vectors: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(row, id, label, size, ints) of the rows that take part, with a number for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                ints = [packed(np.floor(256 * np.asarray(x, np.float64))) for x in b.column("v").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "label", "size")), pa.array(ints, pa.binary())], names=["row", "id", "label", "size", "ints"])

    values = F.col(vector).cast("array<double>")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < float("inf")))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), values.alias("v")).where("id is not null and label is not null and v is not null").where(usable)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("v").alias("size"), "v")
    schema = T.StructType([*(rows.schema[c] for c in ("row", "id", "label", "size")), T.StructField("ints", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def codebooks(rows: DataFrame, p: Params) -> dict[int, np.ndarray]:
    """By vector length, from a sample of bounded rows and bytes."""
    width = rows.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    some = rows.orderBy(F.xxhash64("id", "row")).limit(max(1, min(p.sample, p.sample_bytes // max(1, 4 * width)))).select("size", "ints").toPandas()
    often = some["size"].value_counts().head(p.lengths).index
    return {int(n): fitted(unpacked(some.loc[some["size"] == n, "ints"].tolist(), int(n)), p) for n in often if n}


def with_codes(rows: DataFrame, books: dict[int, np.ndarray], p: Params) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                sizes = np.asarray(b.column("size"))
                for n in np.unique(sizes):
                    own = b.take(pa.array(np.flatnonzero(sizes == n)))
                    codes, left = encoded(unpacked(own.column("ints").to_pylist(), int(n)), shared.value.get(int(n)), p.sub)
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array(left)], names=[*own.schema.names, "codes", "residual"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("codes", T.BinaryType()), T.StructField("residual", T.DoubleType())]))


def in_blocks(anchors: DataFrame, rows: DataFrame, part: Column, p: Params) -> DataFrame:
    """Anchors and rows with (part, i, j): every anchor of a part meets each of its rows in one block (i, j), none larger than Params says. A part's blocks are planned from sums, and a row is sent once for each block of anchors."""
    spark = rows.sparkSession
    weigh = lambda side, name: side.groupBy(part.alias("part")).agg(F.greatest(F.ceil(F.count("*") / p.block), F.ceil(F.sum(F.length("ints")) / p.block_bytes)).cast("int").alias(name))
    plan = sized(written(weigh(anchors, "of_anchors").join(weigh(rows, "of_rows"), "part"), "plan"))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    whole = ["row", "id", "label", "size", "ints"]
    extra = [c for c in anchors.columns if c == "positives"]
    a = anchors.withColumn("part", part).join(plan, "part").select("part", deal("of_anchors").alias("i"), each("of_rows").alias("j"), *whole, *extra, F.lit(True).alias("anchor"))
    b = rows.withColumn("part", part).join(plan, "part").select("part", each("of_anchors").alias("i"), deal("of_rows").alias("j"), *whole, "codes", "residual", F.lit(False).alias("anchor"))
    return a.unionByName(b, allowMissingColumns=True)


def first_of(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mined(vectors: DataFrame, anchors: Column, p: Params = Params(), *, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score). anchors: a condition on the column `id`."""
    spark = vectors.sparkSession
    plain = written(whole_vectors(vectors, key, label, vector), "whole")
    books = codebooks(plain, p)
    rows = written(with_codes(plain, books, p), "codes")
    drop_scratch(spark, plain)
    asked = rows.where(anchors).select("row", "id", "label", "size", "ints")
    id_type = rows.schema["id"].dataType.simpleString()

    # Labels by hash in about as many parts as there are blocks of rows.
    parts = max(1, -(-rows.count() // p.block))
    near = in_blocks(asked, rows, F.struct(F.pmod(F.xxhash64("label"), F.lit(parts)).alias("hash"), "size"), p)
    schema = f"anchor long, anchor_id {id_type}, label string, positive long, positive_id {id_type}, positive_score long"
    found = near.groupBy("part", "i", "j").applyInPandas(lambda frame: block_positives(frame, books, p), schema)
    best = first_of(found, ["anchor"], [F.desc("positive_score"), "positive_id", "positive"], p.positives)
    of = written(best.groupBy("anchor").agg(F.collect_list(F.struct("positive", "positive_id", "positive_score")).alias("positives")), "positives")

    asked = asked.join(of.withColumnRenamed("anchor", "row"), "row")
    far = in_blocks(asked, rows, F.col("size"), p)
    schema = f"anchor long, anchor_id {id_type}, positive long, positive_id {id_type}, positive_score long, negative long, negative_id {id_type}, negative_score long"
    found = far.groupBy("part", "i", "j").applyInPandas(lambda frame: block_negatives(frame, books, p), schema)
    return first_of(found, ["anchor", "positive"], [F.desc("negative_score"), "negative_id", "negative"], p.negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors: ids divisible by 50; the labels of ids divisible by 7 are moved on by one first."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return mined(rows, F.col("id") % 50 == 0)


ORACLE_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
"""
