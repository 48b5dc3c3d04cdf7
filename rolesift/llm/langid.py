"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of the hashed n-grams are taken over all training rows. Weights are
trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties on a
bounded sample (max_train rows for each language, chosen by a hash of the id), one part
of which is held back to calibrate a temperature for the softmax.

Cases: a text that is null or has no letter is `und` with score 0; so is every text where
nothing could be learned. Rows whose language is null are not learned from. Equal scores
go to the first language in order. Repeated rows get the same answer. An empty table
gives no rows. Other columns are never read, and may have any name but those of the
results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm import ngrams
from rolesift.llm.common import crc_mod, free_name, slices, texts

LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Params:
    sizes: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    max_train: int = 3_000
    calibrate_every: int = 5
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-3


@dataclass(frozen=True)
class Model:
    params: Params
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    temperature: float


def _counts(text: str, p: Params) -> np.ndarray:
    total = np.zeros(p.buckets, np.int64)
    for h in ngrams.hashes(ngrams.codes(text), p.sizes, p.buckets):
        total += np.bincount(h, minlength=p.buckets)
    return total


def _vector(text: str, p: Params, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = _counts(text, p)
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    size = np.sqrt((x * x).sum())
    return at, x / size if size else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, p: Params) -> np.ndarray:
    z, n = np.zeros((p.buckets, classes)), np.zeros((p.buckets, classes))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) > p.l1, -(z - np.sign(z) * p.l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2), 0.0)

    for y, at, x in rows:
        za, na = z[at], n[at]
        w = weights(za, na)
        d = softmax(x @ w)
        d[y] -= 1
        g = np.outer(x, d)
        sigma = (np.sqrt(na + g * g) - np.sqrt(na)) / p.alpha
        z[at] = za + g - sigma * w
        n[at] = na + g * g
    return weights(z, n)


def _temperature(logits: list[tuple[int, np.ndarray]]) -> float:
    """The temperature with the least negative log-likelihood, by a search over a fixed grid."""
    if not logits:
        return 1.0
    y, z = np.array([a for a, _ in logits]), np.array([b for _, b in logits])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    return min((float(t) for t in np.geomspace(0.02, 10, 120)), key=loss)


def train(docs: DataFrame, params: Params = Params(), *, lang: str = "lang", key: str = "doc_id", text: str = "text") -> Model:
    """docs: the rows that may be learned from."""
    p = params
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))
    sizes = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model(p, [], np.ones(p.buckets), np.zeros((p.buckets, 0)), 1.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, held = ngrams.Distinct(p.buckets), np.zeros(p.buckets + 1, np.int64)
        for part in slices(batches, text="__text"):
            for x in texts(part, "__text"):
                held[distinct(ngrams.hashes(ngrams.codes(x), p.sizes, p.buckets))] += 1
                held[-1] += 1
        yield from ngrams.pieces_of(held)

    sums = ngrams.summed(rows.select("__text").mapInArrow(count, ngrams.VECTOR_SCHEMA), p.buckets + 1)
    idf = np.log((1 + sums[-1]) / (1 + sums[:-1])) + 1
    shared = docs.sparkSession.sparkContext.broadcast((idf, langs))
    share = F.lit(0.0)
    for name in langs:
        share = F.when(F.col("__lang") == name, F.lit(min(1.0, p.max_train / sizes[name]))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("__key", "__text", F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs = shared.value
        found = [(key, langs.index(y), *_vector(x, p, idf)) for part in slices(batches, text="__text") for key, x, y in zip(part.column("__order").to_pylist(), texts(part, "__text"), part.column("__lang").to_pylist(), strict=True) if LETTER.search(x)]
        found.sort(key=lambda r: r[0])
        held = [r[1:] for i, r in enumerate(found) if i % p.calibrate_every == 0]
        used = [r[1:] for i, r in enumerate(found) if i % p.calibrate_every] or held
        w = _ftrl(used, len(langs), p)
        t = _temperature([(y, x @ w[at]) for y, at, x in held])
        yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([w.astype("<f4").tobytes()], pa.binary())], names=["t", "w"])

    [fitted] = sample.select(F.xxhash64("__key", "__text", F.lit(55)).alias("__order"), "__text", "__lang").coalesce(64).repartition(1).mapInArrow(fit, "t double, w binary").collect()
    return Model(p, langs, idf, np.frombuffer(fitted["w"], "<f4").reshape(p.buckets, len(langs)), fitted["t"])


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns in `keep`, the predicted language and its calibrated probability, in one narrow pass."""
    p, keep = model.params, [c for c in (docs.columns if keep is None else keep) if c not in into]
    source = free_name([*keep, *into], "__text")
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.idf, np.ascontiguousarray(model.weights), model.temperature))
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(into[0], T.StringType(), False), T.StructField(into[1], T.DoubleType(), False)])

    def one(text: str, model: tuple) -> tuple[str, float]:
        langs, idf, weights, t = model
        if not langs or not LETTER.search(text):
            return "und", 0.0
        at, x = _vector(text, p, idf)
        share = softmax((x @ weights[at]) / t)
        best = int(share.argmax())
        return langs[best], float(min(1.0, share[best]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, text=source):
            found = [one(x, model) for x in texts(part, source)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], names=[*keep, *into])

    return docs.select(*keep, F.col(text).alias(source)).mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 5) == 0
    model = train(docs.where(~held_out))
    return predict(docs, model, keep=["doc_id"], into=("lang_pred", "score")).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
