"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Document counts of every hashed n-gram are taken over all labelled training rows. The
log-count ratio r of a bucket compares its smoothed share among toxic documents with that
among the others; a text's features are r where it holds the n-gram. A logistic
regression over the buckets with |r| >= min_ratio and at least min_docs documents is fit
on a bounded sample of training rows (max_train rows for each label, chosen by a hash of
the id), and scores whole texts.

Cases: null and empty texts score as a text without features. An empty table gives no rows. Rows that repeat score
alike. Labels that are null, or ids without a label, are not learned from; an id with
several labels counts as toxic if one of them is. With no toxic or no clean training row
the score is the share of toxic training rows (0 where there are none). Other columns are
never read, and may have any name but that of the result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm import ngrams
from rolesift.llm.common import crc_mod, free_name, sized, slices, texts, written

@dataclass(frozen=True)
class Params:
    sizes: tuple[int, ...] = (5, 6)
    buckets: int = 1 << 20
    smoothing: float = 1.0
    min_ratio: float = 1.5
    min_docs: int = 4
    max_train: int = 8_000
    epochs: int = 12
    rate: float = 0.5
    l2: float = 1e-4
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    params: Params
    weights: np.ndarray  # by bucket, log-count ratio included
    bias: float


def _features(text: str, distinct: ngrams.Distinct, p: Params) -> np.ndarray:
    return distinct(ngrams.hashes(ngrams.codes(text), p.sizes, p.buckets))


def labelled(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str) -> DataFrame:
    """(text, label) of the documents with a label. The labels' size is checked before they are broadcast."""
    known = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__label")).where("__key is not null and __label is not null").groupBy("__key").agg(F.max("__label").alias("__label"))
    return docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(sized(written(known, "labels"), 16), "__key")


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), *, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """docs: the rows that may be learned from."""
    p = params
    rows = labelled(docs, labels, label, key, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, held = ngrams.Distinct(p.buckets), np.zeros((2, p.buckets), np.int32)
        total = np.zeros(2, np.int64)
        for part in slices(batches, text="__text"):
            for x, y in zip(texts(part, "__text"), part.column("__label").to_pylist(), strict=True):
                held[int(y > 0)][_features(x, distinct, p)] += 1
                total[int(y > 0)] += 1
        yield from ngrams.pieces_of(np.concatenate([held[0], held[1], total]))

    sums = ngrams.summed(rows.select("__text", "__label").mapInArrow(count, ngrams.VECTOR_SCHEMA), 2 * p.buckets + 2)
    clean, toxic, n = sums[: p.buckets], sums[p.buckets : 2 * p.buckets], sums[2 * p.buckets :]
    if not n[0] or not n[1]:
        share = float(n[1] > 0)
        return Model(p, np.zeros(p.buckets, np.float32), 40.0 if share else -40.0)
    a = p.smoothing
    ratio = np.log((toxic + a) / (n[1] + 2 * a)) - np.log((clean + a) / (n[0] + 2 * a))
    used = (np.abs(ratio) >= p.min_ratio) & (clean + toxic >= p.min_docs)
    ratio = np.where(used, ratio, 0).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    # A bounded sample of each label, by a hash of the id.
    share = F.when(F.col("__label") > 0, min(1.0, p.max_train / n[1])).otherwise(min(1.0, p.max_train / n[0]))
    sample = rows.where(F.pmod(F.xxhash64("__key", "__text", F.lit(10)), F.lit(1_000_000)) < share * 1_000_000)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, ratio = ngrams.Distinct(p.buckets), shared.value
        for part in slices(batches, text="__text"):
            found = [f[ratio[f] != 0] for f in (_features(x, distinct, p) for x in texts(part, "__text"))]
            yield pa.RecordBatch.from_arrays([part.column("__label"), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32()))], names=["label", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adagrad over the sample in a fixed order, weighted back to the shares of the labels."""
        rows = [(int(y > 0), np.asarray(f, np.int64)) for b in batches for y, f in zip(b.column("label").to_pylist(), b.column("features").to_pylist(), strict=True)]
        rows.sort(key=lambda r: (r[0], len(r[1]), r[1][:8].tolist()))
        ratio = shared.value
        w, g = np.zeros(p.buckets, np.float32), np.full(p.buckets, 1e-6, np.float32)
        seen = [max(1, sum(1 for y, _ in rows if y == k)) for k in (0, 1)]
        back = [n[0] / seen[0], n[1] / seen[1]]
        back = [x / min(back) for x in back]
        bias = float(np.log(n[1] / n[0]))
        bias_g = 1e-6
        random = np.random.default_rng(10)
        for _ in range(p.epochs):
            for i in random.permutation(len(rows)):
                y, f = rows[i]
                r = ratio[f]
                z = bias + float(w[f] @ r)
                d = back[y] * (1 / (1 + np.exp(-max(-40.0, min(40.0, z)))) - y)
                grad = d * r + p.l2 * w[f]
                g[f] += grad * grad
                w[f] -= p.rate * 0.2 * grad / np.sqrt(g[f])
                bias_g += d * d
                bias -= p.rate * 0.2 * d / np.sqrt(bias_g)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([w[at].astype(float).tolist()], pa.list_(pa.float64()))], names=["bias", "at", "w"])

    [fitted] = sample.select("__text", "__label").mapInArrow(select, "label int, features array<int>").coalesce(64).repartition(1).mapInArrow(fit, "bias double, at array<int>, w array<double>").collect()
    weights = np.zeros(p.buckets, np.float32)
    weights[fitted["at"]] = np.asarray(fitted["w"], np.float32) * ratio[fitted["at"]]
    return Model(p, weights, fitted["bias"])


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, into: str = "toxicity") -> DataFrame:
    """The columns in `keep` and the score of every row, in one narrow pass."""
    p, keep = model.params, [c for c in (docs.columns if keep is None else keep) if c != into]
    source = free_name([*keep, into], "__text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(into, T.DoubleType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, (weights, bias) = ngrams.Distinct(p.buckets), shared.value
        for part in slices(batches, text=source):
            z = [bias + float(weights[_features(x, distinct, p)].sum(dtype=np.float64)) for x in texts(part, source)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())], names=[*keep, into])

    return docs.select(*keep, F.col(text).alias(source)).mapInArrow(run, schema)


def learnable(key: str | Column = "doc_id") -> Column:
    """The rows whose labels may be learned."""
    return crc_mod(key, 4) != 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(learnable()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model, keep=["doc_id"], into="score")
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= model.params.threshold).cast("int").alias("predicted"))
