"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

Words stand in the order of their endings, and that order is cut into leaves: a frequent
word is a leaf of its own, and the rest is cut where a fair share of the training tokens is
full. Any word, seen or not, falls into one leaf. Leaves are numbered in base 16 (class,
class within it, leaf within that), and

    P(token | history) = P(class | h) P(inner class | class, h) P(leaf | inner class, h) P(token | leaf)

Each of the first three factors is a softmax over 16 outcomes with weights for hashed
features of the history: the token before, the token two before (skip), the pair and the
triple before, each together with the classes chosen so far, in a table of hashed rows.
Its start are the exact log shares of the outcomes, so that without features the model is
the unigram model. Within a leaf a token has its smoothed share of the leaf's training
tokens; a frequent word's leaf holds that word (and words of the same last eight bytes)
alone, so its whole probability comes from the softmaxes. A word that was never seen has
the share of a word seen zero times.

Counts (exact, by a 64-bit hash of the token) and leaf totals cover all training tokens.
The weights are trained by distributed gradient updates: in each round every partition runs
Adagrad over its own part of the training tokens, from the common weights, and the changes
are averaged by tokens; every training token is used once.

Only tables of a fixed size are broadcast: weights, leaf bounds and the most frequent
words. Rarer words' counts are joined by shuffle.

Cases: null and empty texts are one end token. Repeated rows are scored alike, and are
counted as often as they occur. Ties (words of one count) are all frequent or all rarer.
Without training texts every token is unseen. An empty table gives no rows. Other columns
are never read, and may have any name but those of the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm import ngrams
from rolesift.llm.common import crc_mod, free_name, slices, texts, written

END = b" "  # no word can be this
WIDTH = 16  # outcomes of a softmax
LEVELS = 3
ONES = np.ones(WIDTH, np.float32)

#: Bytes of a word up to which it is hashed eight bytes at a time, all words at once.
SHORT = 64

#: Words whose hash a task keeps, as two numbers each; when full it starts anew.
HASHES = 1 << 18


@dataclass(frozen=True)
class Params:
    head_words: int = 1 << 17  # words whose counts are broadcast
    own_leaves: int = 1024  # most frequent words that are leaves of their own
    leaves: int = WIDTH**LEVELS
    rows: int = 1 << 15  # hashed rows of a level's weights, at most 2^16
    rounds: int = 2
    rate: float = 0.1
    batch: int = 4096
    flush: int = 200_000
    tasks_per_core: int = 4  # tasks of a training round; each sends a whole table of changes


class Hashes:
    """The hashes of words met before, by the number that a block groups them by."""

    def __init__(self) -> None:
        self.group, self.hash = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def __call__(self, group: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """group: ascending, a word each, which is data[start:end]."""
        if len(self.group) >= HASHES:
            self.__init__()
        at = np.searchsorted(self.group, group)
        new = np.flatnonzero(np.append(self.group, 0)[at] != group) if len(self.group) else np.arange(len(group))
        fresh = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)), np.uint64, len(new))
        self.hash = np.insert(self.hash, at[new], fresh)
        self.group = np.insert(self.group, at[new], group[new])
        return self.hash[np.searchsorted(self.group, group)]


class Block:
    """The tokens of some texts: ids into the different words of the block, each text after three starts and with its end (word 0)."""

    def __init__(self, rows: list[str], hashes: Hashes):
        coded = [x.encode("utf-8", "surrogatepass") for x in rows]
        pad = b" " * 8
        data = pad + b" ".join(coded).lower() + pad
        raw = np.frombuffer(data, np.uint8)
        space = (raw == 32) | (raw - np.uint8(9) < np.uint8(5))
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        start, end = edge[::2], edge[1::2]
        eights = np.ndarray(len(raw) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
        word, one, group = self._grouped(start, end - start, eights, data)
        left = np.uint64(8) * (8 - np.minimum(end[one] - start[one], 8)).astype(np.uint64)
        self.hash = np.append(np.uint64(xxhash.xxh3_64_intdigest(END)), hashes(group, data, start[one], end[one])).view(np.int64)
        self.ending = np.append(endings([END]), eights[end[one] - 8] >> left << left)
        begins = len(pad) + np.cumsum([0, *(len(x) + 1 for x in coded)])
        size = np.diff(np.searchsorted(start, begins)) + 1
        self.doc = np.repeat(np.arange(len(rows)), size)
        self.at = np.arange(len(self.doc)) + 3 * (self.doc + 1)  # places of tokens
        self.token = np.zeros(len(self.doc), np.int64)
        inner = np.ones(len(self.doc), bool)
        inner[np.cumsum(size) - 1] = False
        self.token[inner] = word + 1
        self.ids = np.full(len(self.doc) + 3 * len(rows), -1)
        self.ids[self.at] = self.token

    @staticmethod
    def _grouped(start: np.ndarray, size: np.ndarray, eights: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each word's group of equal words (by 64 bits, as everywhere), one word of each group and what it is grouped by."""
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for k in range(0, SHORT, 8):
            at = np.flatnonzero(size > k) if k else np.arange(len(size))
            if not at.size:
                break
            there = np.minimum(size[at] - k, 8).astype(np.uint64)
            x = h[at] ^ (eights[start[at] + k] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * there)))
            x *= np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            h[at] = x ^ x >> np.uint64(29)
        for i in np.flatnonzero(size > SHORT).tolist():
            h[i] = xxhash.xxh3_64_intdigest(data[start[i] : start[i] + size[i]])
        order = np.argsort(h)
        there = h[order]
        new = np.ones(len(h), bool)
        new[1:] = there[1:] != there[:-1]
        word = np.empty(len(h), np.int64)
        word[order] = np.cumsum(new) - 1
        return word, order[new], there[new]


def endings(words: list[bytes]) -> np.ndarray:
    """The last eight bytes of each word backwards, as one number: words in the order of their endings."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    last = np.cumsum(size) - 1
    out = np.zeros(len(words), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | np.where(size > k, data[np.maximum(last - k, 0)], np.uint64(0))
    return out


@dataclass(frozen=True)
class Words:
    """The most frequent words by hash with their counts, and the leaves' bounds."""

    hash: np.ndarray  # sorted
    count: np.ndarray
    bounds: np.ndarray  # leaf of an ending: how many bounds are at or below it

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count or 0, whether it is there)"""
        if not len(self.hash):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        there = self.hash[at] == hashes
        return np.where(there, self.count[at], 0), there

    def leaf(self, ending: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, ending, "right")


@dataclass(frozen=True)
class Model:
    params: Params
    words: Words
    start: list[np.ndarray]  # for each level: contexts x WIDTH, log shares
    weights: np.ndarray  # LEVELS x rows x WIDTH
    log_total: np.ndarray  # log10 of each leaf's denominator
    tokens: int
    distinct: int
    counts: DataFrame  # h, c


def history(block: Block) -> np.ndarray:
    """A 32-bit hash of each feature of each token (features x tokens)."""
    h = np.append((block.hash.view(np.uint64) >> np.uint64(32)).astype(np.uint32), np.uint32(0x5EED))[block.ids]  # a start takes the last
    t = block.at
    a, b, c = h[t - 1], h[t - 2], h[t - 3]
    pair = (a * np.uint32(0x9E3779B1)) ^ (b + np.uint32(0x85EBCA6B))
    triple = (pair * np.uint32(0xC2B2AE35)) ^ (c + np.uint32(0x27D4EB2F))
    return np.stack([a, b * np.uint32(3) + np.uint32(1), pair, triple])


def level_rows(features: np.ndarray, context: np.ndarray, level: int, rows: int) -> np.ndarray:
    """The weight rows of each token at a level, given the classes chosen so far."""
    h = features ^ ((context.astype(np.uint32) + np.uint32(level * 65537)) * np.uint32(0x9E3779B1))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    h = (h ^ (h >> np.uint32(12))) * np.uint32(0x297A2D39)
    return (h >> np.uint32(8)).astype(np.uint16) & np.uint16(rows - 1)


def digits(leaf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(context, outcome) of each level."""
    return [(leaf >> (4 * (LEVELS - k)), leaf >> (4 * (LEVELS - 1 - k)) & (WIDTH - 1)) for k in range(LEVELS)]


def logits(start: np.ndarray, weights: np.ndarray, context: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Tokens x WIDTH, before they are made to add up to one. take is several times as fast as indexing; sums beyond 60 either way count as 60, so that no maximum is needed."""
    z = start.take(context, axis=0)
    for k in range(rows.shape[0]):
        z += weights.take(rows[k].astype(np.intp), axis=0)
    return np.clip(z, -60, 60, out=z)


def counts_of(h: np.ndarray, c: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), pa.array((e ^ np.uint64(1 << 63)).view(np.int64))], names=["h", "c", "e"])


def count_tokens(rows: DataFrame, p: Params) -> DataFrame:
    """(h, c, e): exact counts by hash, and the ending (as a long with the sign bit turned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, hashes = [], 0, Hashes()

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h, c, e = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(h)
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[first], np.add.reduceat(c[order], first), e[order[first]]

        for part in slices(batches, text="__text"):
            block = Block(texts(part, "__text"), hashes)
            held.append((block.hash, np.bincount(block.token, minlength=len(block.hash)), block.ending))
            size += len(block.hash)
            if size >= 2 * p.flush:
                held = [merged()]
                size = len(held[0][0])
                if size >= p.flush:
                    yield counts_of(*held[0])
                    held, size = [], 0
        if held:
            yield counts_of(*merged())

    counted = rows.select("__text").mapInArrow(run, "h long, c long, e long")
    return counted.groupBy("h").agg(F.sum("c").alias("c"), F.min("e").alias("e"))


def head_of(counts: DataFrame, p: Params) -> list:
    """The most frequent words, at most p.head_words: those with the least count that leaves so few."""
    sizes = sorted(((r["c"], r["n"]) for r in counts.groupBy(F.least("c", F.lit(4096)).alias("c")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, least = 0, None
    for c, n in sizes:
        total += n
        if total > p.head_words:
            break
        least = c
    if least is None:  # even the most frequent kind is too many: a larger floor, found by doubling
        least = 8192
        while counts.where(F.col("c") >= least).count() > p.head_words:
            least *= 2
    return counts.where(F.col("c") >= least).collect()


def bounds_of(ending: np.ndarray, count: np.ndarray, p: Params) -> np.ndarray:
    """Where leaves begin, in the order of endings: before and after each of the most frequent words, and wherever the tokens since the last bound fill a leaf's share."""
    order = np.argsort(ending, kind="stable")
    ending, count = ending[order], count[order]
    own = np.zeros(len(count), bool)
    own[np.argsort(-count, kind="stable")[: p.own_leaves]] = True
    left = p.leaves - 1 - 2 * int(own.sum())
    share = max(1.0, count[~own].sum() / max(1, left // 2))
    found, held = set(), 0
    for e, c, alone in zip(ending.tolist(), count.tolist(), own.tolist(), strict=True):
        if alone or held >= share:
            found.add(e)
            held = 0
        if alone:
            found.add(e + 1)
        else:
            held += c
    return np.array(sorted(x for x in found if x < 1 << 64), np.uint64)[: p.leaves - 1]


def leaf_totals(counts: DataFrame, words: Words, p: Params) -> np.ndarray:
    """(tokens, different words) of each leaf, over all training words."""
    shared = counts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, p.leaves), np.int64)
        for b in batches:
            leaf = shared.value.leaf(b.column("e").to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63))
            np.add.at(held[0], leaf, b.column("c").to_numpy(zero_copy_only=False))
            held[1] += np.bincount(leaf, minlength=p.leaves)
        yield from ngrams.pieces_of(held.reshape(-1))

    return ngrams.summed(counts.mapInArrow(run, ngrams.VECTOR_SCHEMA), 2 * p.leaves).reshape(2, p.leaves)


def starts_of(totals: np.ndarray) -> list[np.ndarray]:
    """Log shares of the outcomes at each level; an outcome without tokens counts as half a token."""
    out = []
    for k in range(LEVELS):
        n = totals.reshape(WIDTH**k, WIDTH, -1).sum(axis=2) + 0.5
        out.append(np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32))
    return out


def update(w: np.ndarray, seen: np.ndarray, rows: np.ndarray, d: np.ndarray, rate: float) -> None:
    """One Adagrad step on the rows, given each token's gradient (tokens x WIDTH)."""
    # Row and token as one number: sorting them is faster than finding the order.
    bits = (d.shape[0] - 1).bit_length()
    kind = np.uint32 if bits <= 16 else np.uint64
    key = (rows.astype(kind) << kind(bits) | np.arange(d.shape[0], dtype=kind)).reshape(-1)
    key.sort()
    there, token = key >> kind(bits), (key & kind((1 << bits) - 1)).astype(np.intp)
    new = np.concatenate([[True], there[1:] != there[:-1], [True]])
    first = np.flatnonzero(new)
    size, first = np.diff(first), first[:-1]
    # Most rows stand for one token; only the others need sums.
    grad = d.take(token.take(first), axis=0)
    many = np.flatnonzero(size > 1)
    if many.size:
        sums = d.take(token[~(new[1:] & new[:-1])], axis=0).astype(np.float64)
        np.cumsum(sums, axis=0, out=sums)
        sums = sums.take(np.cumsum(size[many]) - 1, axis=0)
        put(grad, many, np.diff(sums, axis=0, prepend=0.0).astype(np.float32))
    at = there.take(first).astype(np.intp)
    total = seen.take(at) + np.einsum("ij,ij->i", grad, grad)
    seen[at] = total
    grad *= (rate / np.sqrt(total))[:, None]
    moved = w.take(at, axis=0)
    moved -= grad
    put(w, at, moved)


def put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """table[at] = rows, a row as one item, which is several times as fast."""
    item = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(item).reshape(-1)[at] = rows.view(item).reshape(-1)


def train_weights(rows: DataFrame, words: Words, start: list[np.ndarray], p: Params) -> np.ndarray:
    """rows: __text and __turn (0 to rounds - 1)."""
    weights = np.zeros((LEVELS, p.rows, WIDTH), np.float32)
    # Neighbouring partitions are read by one task, without a shuffle, so that what is sent grows with the cluster, not with the number of files.
    rows = rows.coalesce(p.tasks_per_core * rows.sparkSession.sparkContext.defaultParallelism)
    for turn in range(p.rounds):
        shared = rows.sparkSession.sparkContext.broadcast((words, start, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            words, start, before = shared.value
            w, seen, tokens = before.copy(), np.full((LEVELS, p.rows), 1e-2, np.float32), 0
            hashes = Hashes()
            for part in slices(batches, text="__text"):
                block = Block(texts(part, "__text"), hashes)
                f, leaf = history(block), words.leaf(block.ending)[block.token]
                for at in range(0, len(leaf), p.batch):
                    g, y = f[:, at : at + p.batch], leaf[at : at + p.batch]
                    for k, (context, outcome) in enumerate(digits(y)):
                        rows_ = level_rows(g, context, k, p.rows)
                        d = logits(start[k], w[k], context, rows_)
                        np.exp(d, out=d)
                        d *= (1 / (d @ ONES))[:, None]
                        d[np.arange(len(y)), outcome] -= 1
                        update(w[k], seen[k], rows_, d, p.rate)
                    tokens += len(y)
            if tokens:
                # Fixed point, so that the sums do not depend on their order.
                change = np.rint((w - before).astype(np.float64) * tokens * 64).astype(np.int64).reshape(-1)
                yield from ngrams.pieces_of(np.append(change, tokens))

        total = ngrams.summed(rows.where(F.col("__turn") == turn).select("__text").mapInArrow(run, ngrams.VECTOR_SCHEMA), weights.size + 1)
        if total[-1]:
            weights = weights + (total[:-1] / (total[-1] * 64.0)).astype(np.float32).reshape(weights.shape)
    return weights


def train(docs: DataFrame, params: Params = Params(), *, key: str = "doc_id", text: str = "text") -> Model:
    """docs: the rows that may be learned from."""
    p = params
    rows = docs.select(F.col(text).alias("__text"), F.pmod(F.xxhash64(F.col(key), F.length(text)), F.lit(p.rounds)).alias("__turn"))
    counts = written(count_tokens(rows, p), "counts")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    head = sorted(head_of(counts, p), key=lambda r: r["h"])
    hashes, count, ending = (np.array([r[k] for r in head], np.int64) for k in "hce")
    words = Words(hashes, count, bounds_of(ending.view(np.uint64) ^ np.uint64(1 << 63), count, p))
    in_leaf = leaf_totals(counts, words, p)
    start = starts_of(in_leaf[0])
    return Model(p, words, start, train_weights(rows, words, start, p), np.log10(in_leaf.sum(axis=0) + 1.0), totals["n"], totals["v"], counts.select("h", "c"))


def token_logs(block: Block, leaf: np.ndarray, start: list[np.ndarray], weights: np.ndarray, p: Params) -> np.ndarray:
    """log10 P(leaf | history) of each token."""
    f = history(block)
    out = np.zeros(len(leaf))
    for at in range(0, len(leaf), p.batch):
        g, y = f[:, at : at + p.batch], leaf[at : at + p.batch]
        for k, (context, outcome) in enumerate(digits(y)):
            z = logits(start[k], weights[k], context, level_rows(g, context, k, p.rows))
            out[at : at + len(y)] += z[np.arange(len(y)), outcome]
            out[at : at + len(y)] -= np.log(np.exp(z, out=z) @ ONES)
    return out / np.log(10)


def score(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` with n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    p, new = model.params, ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    row, known, base, own, rare, source = (free_name(keep, x) for x in ("__row", "__known", "__base", "__own", "__rare", "__source"))
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.start, model.weights, model.log_total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, start, weights, log_total = shared.value
        hashes = Hashes()
        at = TaskContext.get().partitionId() << 33
        for part in slices(batches, text=source):
            block, n = Block(texts(part, source), hashes), part.num_rows
            count, there = words.find(block.hash)
            counted = np.where(there, np.log10(count + 1.0), 0.0)
            leaf = words.leaf(block.ending)
            within = counted - log_total[leaf]
            sums = lambda v, d=block.doc, n=n: np.bincount(d, weights=v, minlength=n)
            left = ~there[block.token]
            cuts = np.concatenate([[0], np.cumsum(sums(left))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(cuts), pa.array(block.hash[block.token[left]]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), pa.array(at + np.arange(n)), pa.array(np.bincount(block.doc, minlength=n)), pa.array(np.rint(sums(~left)).astype(np.int64)), pa.array(sums(counted[block.token])), pa.array(sums(token_logs(block, leaf[block.token], start, weights, p) + within[block.token])), rest],
                names=[*keep, row, "n_tokens", known, base, own, rare],
            )
            at += n

    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(c, kind) for c, kind in ((row, T.LongType()), ("n_tokens", T.LongType()), (known, T.LongType()), (base, T.DoubleType()), (own, T.DoubleType()), (rare, T.ArrayType(T.LongType()))))])
    part = written(docs.select(*keep, F.col(text).alias(source)).mapInArrow(run, schema), "scored")
    # Rarer words: their counts by join; the sum goes into both scores.
    found = part.select(F.col(row).alias("row"), F.explode(rare).alias("h")).groupBy("row", "h").agg(F.count("*").alias("n"))
    found = found.join(model.counts.hint("merge"), "h").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("log"), F.sum("n").alias("seen"))
    log, seen = free_name(part.columns, "__log"), free_name(part.columns, "__seen")
    both = part.drop(rare).join(found.select(F.col("row").alias(row), F.col("log").alias(log), F.col("seen").alias(seen)), row, "left")
    rest, norm = F.coalesce(log, F.lit(0.0)), float(np.log10(model.tokens + model.distinct + 1.0))
    return both.select(*keep, "n_tokens", (F.col(known) + F.coalesce(seen, F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col(base) + rest - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col(own) + rest).alias("score"))


def held_out(key: str | Column = "doc_id") -> Column:
    return crc_mod(key, 7) == 2


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    return score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
