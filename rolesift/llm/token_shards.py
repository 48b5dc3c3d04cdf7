"""Training-order materialisation of token ids as fixed-stride binary shards.

Texts are encoded, each ends with an end token, and is cut into sequences of a fixed
length (the last one filled up with a fill token of its own). Rows are put in the order of
(id, hash of the text, text) by range partitions; sequences are numbered 0 to N-1 in that
order, so that numbers depend on the rows only, not on how they were stored or split. A
keyed Feistel permutation with cycle-walking sends each number to a slot in 0 to N-1: a
global shuffle that needs no sort key, no table and no state, and can be computed for any
slot on any machine. Slots are dealt in ranges, one range a shard; a shard file holds its
sequences one after the other, each of the same number of bytes, so that slot s is at byte
(s mod shard size) * stride of shard s / shard size, and a reader resumes anywhere by
arithmetic.

The shards are made in a few passes over the encoded texts, each for a range of slots, so
that only a part of the sequences is in a shuffle at a time. Shards are written to a name of
their own attempt and then renamed, so that a lost executor or a repeated task leaves whole
files only. A manifest tells the layout.

Cases: a null or empty text is one sequence that starts with the end token. Rows with the
same or no id are each materialised; rows with equal ids and texts are interchangeable. An
empty table makes no shard. Ids may be of any type with an order. Other columns are never
read, and may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from functools import reduce
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm import bpe
from rolesift.llm.common import drop_scratch, scratch_path, slices, written


@dataclass(frozen=True)
class Params:
    length: int = 256
    end: int = 50256  # free in the vocabulary
    fill: int = 50257
    shard: int = 16384  # sequences a shard
    key: int = 0x5EED
    rounds: int = 6
    tasks: int = 100_000  # tasks that write at most
    passes: int = 4  # ranges of slots that are shuffled one after the other

    @property
    def stride(self) -> int:
        return 2 * self.length


def _round(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    x = (x + np.uint64((key + turn * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def feistel(x: np.ndarray, n: int, p: Params) -> np.ndarray:
    """A permutation of 0..n-1: a balanced Feistel network over the next even number of bits, walked along its cycle until it is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while todo.size:
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for turn in range(p.rounds):
            a, b = b, a ^ (_round(b, p.key, turn) & low)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def unfeistel(y: np.ndarray, n: int, p: Params) -> np.ndarray:
    """The inverse: which sequence is in a slot."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = y.astype(np.uint64).copy()
    todo = np.arange(len(out))
    while todo.size:
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for turn in reversed(range(p.rounds)):
            a, b = b ^ (_round(a, p.key, turn) & low), a
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def qualified(spark: SparkSession, folder: str, shared: bool = False) -> str:
    """The folder with its scheme, by Spark's own file systems. A local path is taken in local mode, where it is said to be shared, or with the scheme file: for a mount that all machines share."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if full.startswith("file:") and not shared and not folder.startswith("file:") and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{folder} is local to each machine")
    return full


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    at = urlparse(folder)
    if at.scheme in ("", "file"):
        return pafs.LocalFileSystem(), at.path
    return pafs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


_encoders: dict[int, object] = {}

#: White space in a row that the library's pattern matching surely takes; its stack overflows from 999,999 characters on.
LIBRARY_SPACE = 900_000


def _encoder(ranks: bytes, pattern: str):
    """The compiled library with these ranks."""
    key = hash((ranks, pattern))
    if key not in _encoders:
        import tiktoken

        _encoders.clear()
        known = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
        _encoders[key] = tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=known, special_tokens={})
    return _encoders[key]


def _encode(ranks: bytes, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a whole text, by the library, or by op4's encoder, whose ids are the same, where white space would overflow the library's stack."""
    library = _encoder(ranks, pattern).encode_ordinary

    def run(text: str) -> list[int]:
        if len(text) > LIBRARY_SPACE and any(m.end() - m.start() > LIBRARY_SPACE for m in re.finditer(r"\s+", text)):
            return bpe.worker_encoder(ranks, pattern)(text)
        return library(text)

    return run


def encoded_rows(docs: DataFrame, ranks: bytes, pattern: str, p: Params, *, key: str, text: str) -> DataFrame:
    """(task, within, doc_id, n_tokens, ids), tasks and the rows in them in the order of the corpus: the tokens of each row as little-endian 16-bit numbers, its end token included; within: the sequences of the rows before it in its task."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text")).withColumn("__hash", F.xxhash64("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, within = _encode(shared.value, pattern), TaskContext.get().partitionId(), 0
        for part in slices(batches, rows=1000, chars=2_000_000, text="__text"):
            data = [np.array([*encode(x), p.end], "<u2").tobytes() for x in part.column("__text").to_pylist()]
            size = np.array([len(x) // 2 for x in data], np.int64)
            parts = -(-size // p.length)
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(data), pa.int32()), pa.array(within + np.cumsum(parts) - parts), part.column("doc_id"), pa.array(size), pa.array(data, pa.binary())], names=["task", "within", "doc_id", "n_tokens", "ids"])
            within += int(parts.sum())

    schema = T.StructType([T.StructField("task", T.IntegerType()), T.StructField("within", T.LongType()), rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    ordered = rows.repartitionByRange("doc_id", "__hash").sortWithinPartitions("doc_id", "__hash", "__text")
    return ordered.select("doc_id", "__text").mapInArrow(run, schema)


def materialise(docs: DataFrame, ranks: bytes, pattern: str, p: Params = Params(), *, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the shards and the manifest to `folder` (in the shared folder by default) and returns a row for every sequence: slot, shard, offset (bytes), doc_id, part, n_tokens (fill left out), sha256 of its bytes as read back from the file."""
    spark = docs.sparkSession
    # The folder for scratch tables is shared whatever its scheme.
    folder = qualified(spark, folder or scratch_path(spark, "shards"), shared=folder is None)
    if max(p.end, p.fill) >= 1 << 16:
        raise ValueError("ids of the end and fill tokens must fit 16 bits")
    encoded = written(encoded_rows(docs, ranks, pattern, p, key=key, text=text), "encoded", "zstd")
    # Offsets: a few numbers a task, then positions inside each task's own rows.
    tasks = sorted((r["task"], r["n"]) for r in encoded.groupBy("task").agg(F.sum(F.ceil(F.col("n_tokens") / p.length)).cast("long").alias("n")).collect())
    total = sum(n for _, n in tasks)
    before, starts = 0, {}
    for task, n in tasks:
        starts[task], before = before, before + n
    shared = spark.sparkContext.broadcast(starts)
    shards = -(-total // p.shard)
    id_type = encoded.schema["doc_id"].dataType

    def cut(low: int, high: int):
        """Makes the sequences whose shard is in low..high-1, with their slots."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 500):
                    s = b.slice(at, 500)
                    n = s.column("n_tokens").to_numpy(zero_copy_only=False)
                    parts = -(-n // p.length)
                    row = np.repeat(np.arange(len(n)), parts)
                    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                    first = np.array([shared.value[t] for t in s.column("task").to_pylist()], np.int64) + s.column("within").to_numpy(zero_copy_only=False)
                    slot = feistel(first[row] + part, total, p)
                    mine = np.flatnonzero((slot // p.shard >= low) & (slot // p.shard < high))
                    row, part, slot = row[mine], part[mine], slot[mine]
                    ids = s.column("ids").to_pylist()
                    data = [ids[r][k : k + p.stride] for r, k in zip(row.tolist(), (part * p.stride).tolist(), strict=True)]
                    used = np.minimum(p.length, n[row] - part * p.length)
                    yield pa.RecordBatch.from_arrays([pa.array(slot // p.shard), pa.array(slot), s.column("doc_id").take(pa.array(row)), pa.array(part), pa.array(used), pa.array(data, pa.binary())], names=["shard", "slot", "doc_id", "part", "n_tokens", "data"])

        return run

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One shard after the other, rows sorted by slot."""
        store, base = _store(folder)
        shard, rows, out, name, kind = None, [], None, "", None

        def done() -> Iterator[pa.RecordBatch]:
            if out is None:
                return
            out.close()
            store.move(name, f"{base}/shard-{shard:08d}.bin")
            # What is told of a sequence is read back from the file.
            with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as f:
                for at in range(0, len(rows), 512):
                    group = rows[at : at + 512]
                    got = f.read(len(group) * p.stride)
                    digests = [hashlib.sha256(got[i * p.stride : (i + 1) * p.stride]).hexdigest() for i in range(len(group))]
                    slot, doc, part, n = zip(*group, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array([shard] * len(group), pa.int64()), pa.array([(s % p.shard) * p.stride for s in slot], pa.int64()), pa.array(doc, kind), pa.array(part, pa.int64()), pa.array(n, pa.int64()), pa.array(digests, pa.string())], names=["slot", "shard", "offset", "doc_id", "part", "n_tokens", "sha256"])
            rows.clear()

        fill = np.asarray([p.fill], "<u2").tobytes()
        for b in batches:
            kind = b.schema.field("doc_id").type
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                for number, slot, doc, part, n, data in zip(*(s.column(c).to_pylist() for c in ("shard", "slot", "doc_id", "part", "n_tokens", "data")), strict=True):
                    if number != shard:
                        yield from done()
                        shard, name = number, f"{base}/.{uuid.uuid4().hex}.part"
                        out = store.open_output_stream(name)
                    out.write(data if len(data) == p.stride else data + fill * (p.length - len(data) // 2))
                    rows.append((slot, doc, part, n))
        yield from done()

    long = lambda name: T.StructField(name, T.LongType())
    schema = T.StructType([long("slot"), long("shard"), long("offset"), T.StructField("doc_id", id_type), long("part"), long("n_tokens"), T.StructField("sha256", T.StringType())])
    if not total:
        return spark.createDataFrame([], schema)
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(asdict(p) | {"sequences": total, "shards": shards, "stride": p.stride, "dtype": "<u2"}).encode())
    cut_schema = T.StructType([long("shard"), long("slot"), T.StructField("doc_id", id_type), long("part"), long("n_tokens"), T.StructField("data", T.BinaryType())])
    done = []
    step = -(-shards // p.passes)
    for low in range(0, shards, step):
        # Shard k is the range of slots from k * p.shard on, and one task writes it.
        many = min(step, p.tasks)
        dealt = encoded.mapInArrow(cut(low, low + step), cut_schema).repartitionById(many, F.pmod("shard", F.lit(many)).cast("int")).sortWithinPartitions("slot")
        done.append(written(dealt.mapInArrow(write, schema), "sequences", "zstd"))
    drop_scratch(spark, encoded)
    return reduce(DataFrame.unionByName, done)


class ShardReader:
    """Sequences in training order, from any slot on."""

    def __init__(self, folder: str):
        self.store, self.base = _store(folder)
        with self.store.open_input_file(f"{self.base}/manifest.json") as f:
            self.layout = json.loads(f.read())

    def __len__(self) -> int:
        return self.layout["sequences"]

    def read(self, slot: int, count: int = 1) -> np.ndarray:
        """count x length ids from `slot` on, across shards where need be."""
        count = max(0, min(count, len(self) - slot))
        out, size, stride = [], self.layout["shard"], self.layout["stride"]
        while count:
            inside = min(count, size - slot % size)
            with self.store.open_input_file(f"{self.base}/shard-{slot // size:08d}.bin") as f:
                f.seek(slot % size * stride)
                out.append(np.frombuffer(f.read(inside * stride), self.layout["dtype"]).reshape(inside, self.layout["length"]))
            slot, count = slot + inside, count - inside
        return np.concatenate(out) if out else np.zeros((0, self.layout["length"]), self.layout["dtype"])


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = bpe.default_ranks()
    return materialise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ranks, pattern)
