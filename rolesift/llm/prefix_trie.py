"""The prefix trie of conversations, by radix partitioning of turn ids from the first turn on.

1. Turns (role, text) are dictionary-encoded: a cryptographic digest names a turn, and each
   different one gets a whole number. Places in a conversation are running counts over a range
   partitioning, so that no conversation has to fit a task.
2. Conversations of equal turns are one sequence with a number of copies.
3. Radix rounds: a bucket holds the sequences that share their first turns. A bucket with
   more than Params.local turns is cut by its next digit, the id of the turn after the longest
   common prefix (found from the least and the largest id at each depth). What is small
   enough is finished inside one task by multikey quicksort; the recursion emits the nodes.
   A sequence that is alone in its bucket and longer than that is a chain, made from its rows.
4. Sums over subtrees go up the cut buckets, round by round.

The ids of a node's own conversations are hashed in order as a stream: tasks first join their
runs of ids to pieces, then one task reads a node's pieces in order; SHA-256 allows no other way,
and its memory is that of a piece.

Cases: a null role or text is the empty one. Turns without a number come first; turns of one
number are ordered by role and text, and repeated rows are turns of their own. Rows without a
conversation id are left out. A conversation whose rows all fall away stays in the root. An
empty table has no node. Other columns are never read, and may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm.common import drop_scratch, sized, written

WORDS = r"[^\x20\x09-\x0D]+"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"


@dataclass(frozen=True)
class Params:
    local: int = 20_000  # turns up to which a bucket is finished in one task
    pack: int = 50_000  # turns that a task works on at once, and what its last bucket has besides
    piece: int = 4096  # ids of a piece


def running(rows: DataFrame, key: list[str], order: list, value: str, into: str) -> DataFrame:
    """`rows` with the sum of `value` (longs) over the rows of a key up to and with this one. The key and the order together should name a row.

    Ranges of key and order are dealt to tasks, which add up their own rows; a key that goes on in further ranges gets what stands before from a small table.
    """
    task, sums = "__task", "__sum"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, held = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in key], axis=1)
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            total = np.cumsum(b.column(value).to_numpy(zero_copy_only=False))
            before = np.r_[0, total[first[1:] - 1]]
            if last == tuple(keys[0]):
                before[0] -= held
            total = total - np.repeat(before, np.diff(np.r_[first, len(keys)]))
            last, held = tuple(keys[-1]), int(total[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([number] * len(keys), pa.int32()), pa.array(total)], names=[*b.schema.names, task, sums])

    schema = T.StructType([*rows.schema.fields, T.StructField(task, T.IntegerType()), T.StructField(sums, T.LongType())])
    local = written(rows.repartitionByRange(*key, *order).sortWithinPartitions(*key, *order).mapInArrow(run, schema), into)
    runs = local.groupBy(*key, task).agg(F.sum(value).alias("n"))
    parts = Window.partitionBy(*key)
    before = F.sum("n").over(parts.orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    # Only keys in several ranges; each further range continues one key at most.
    split = runs.join(runs.groupBy(*key).count().where("count > 1").drop("count"), key).select(*key, task, before.alias("__before")).where("__before is not null")
    split = sized(written(split, f"{into}_before"))
    return local.join(split, [*key, task], "left").withColumn(into, F.col(sums) + F.coalesce("__before", F.lit(0))).drop(task, sums, "__before")


def encoded(conversations: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, pos, tid, words): turns in order from 1, by number, their ids and words."""
    role_, text_ = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"), text_.alias("text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 32))
    named = rows.select(F.monotonically_increasing_id().alias("row"), "conv", "turn", digest.alias("digest"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    named = written(named, "turns")
    book = written(named.groupBy("digest").agg(F.max("words").alias("words")).withColumn("tid", F.monotonically_increasing_id()), "book")
    coded = named.select("row", "conv", F.coalesce("turn", F.lit(-(2**63))).alias("turn"), F.col("turn").isNotNull().cast("int").alias("told"), "digest").join(book, "digest")
    # Turns of one number, if there are any with different contents, are told apart by their role and text.
    tied = written(named.groupBy("conv", "turn").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z").select("conv", "turn"), "tied")
    if tied.isEmpty():
        coded = coded.withColumn("place", F.lit(0))
    else:
        same = rows.join(tied, (rows["conv"] == tied["conv"]) & rows["turn"].eqNullSafe(tied["turn"]), "left_semi").withColumn("digest", digest).distinct()
        place = F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))
        same = same.select("conv", "digest", F.coalesce("turn", F.lit(-(2**63))).alias("turn"), F.col("turn").isNotNull().cast("int").alias("told"), place.alias("place"))
        coded = coded.join(same, ["conv", "digest", "turn", "told"], "left").withColumn("place", F.coalesce("place", F.lit(0)))
    rows = written(coded.select("conv", "told", "turn", "place", "row", "tid", "words", F.lit(1).cast("long").alias("one")), "coded")
    return running(rows, ["conv"], ["told", "turn", "place", "row"], "one", "pos").select("conv", "pos", "tid", "words")


def rebuilt(turns: DataFrame, every: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(convs, rows): the conversation ids, and (conv, d, tid, words) with the first h turns of the conversation that begins its group of `every`, then the own ones after the first h; h is the id's crc32 modulo `heads`."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    convs = written(turns.select("conv").distinct().select("conv", h.alias("h"), (F.col("conv") - F.col("conv") % every).alias("base")), "convs")
    first = written(turns.where((F.col("conv") % every == 0) & (F.col("pos") < heads)).withColumnRenamed("conv", "base"), "heads")
    given = convs.join(first, "base").where("pos <= h").select("conv", F.col("pos").alias("d"), "tid", "words")
    has = convs.join(first.groupBy("base").agg(F.max("pos").alias("n")), "base", "left").select("conv", "h", F.least("h", F.coalesce("n", F.lit(0))).alias("got"))
    own = turns.join(has, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("got")).alias("d"), "tid", "words")
    return convs.select("conv"), given.unionByName(own)


def sequences(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(of, seqs): each conversation's sequence as (h1, h2, len), and those with the least conversation and the number of copies."""
    named = rows.groupBy("conv").agg(F.expr("bit_xor(xxhash64(d, tid))").alias("h1"), F.expr("bit_xor(xxhash64(tid, d, 'second'))").alias("h2"), F.count("*").alias("len"))
    zero = F.lit(0).cast("long")
    of = written(convs.join(named, "conv", "left").select("conv", *(F.coalesce(c, zero).alias(c) for c in ("h1", "h2", "len"))), "of")
    return of, written(of.groupBy("h1", "h2", "len").agg(F.min("conv").alias("seq"), F.count("*").alias("n")), "seqs")


def end_hashes(of: DataFrame, p: Params) -> DataFrame:
    """(ends, ends_sha256): for each sequence, named by its least conversation, the hash of its conversations' ids."""
    names = ["h1", "h2", "len"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in names], axis=1)
            conv = b.column("conv").to_numpy()
            first = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            first = [x for a, z in zip(first, [*first[1:], len(keys)], strict=True) for x in range(a, z, p.piece)]
            ids = [",".join(map(str, conv[a:z].tolist())) for a, z in zip(first, [*first[1:], len(keys)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(keys[first, i]) for i in range(3)), pa.array(conv[first]), pa.array(ids, pa.string())], names=[*names, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, state = None, None, None
        done: list[tuple] = []
        for b in batches:
            for *k, first, ids in zip(*(b.column(c).to_pylist() for c in (*names, "first", "ids")), strict=True):
                if k != now:
                    if state:
                        done.append((seq, state.hexdigest()))
                    now, seq, state = k, first, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield told(done)
            done = []
        yield told([(seq, state.hexdigest())] if state else [])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.string())], names=["ends", "ends_sha256"])

    cut = of.repartitionByRange(*names, "conv").sortWithinPartitions(*names, "conv").mapInArrow(pieces, "h1 long, h2 long, len long, first long, ids string")
    return cut.repartition(*names).sortWithinPartitions(*names, "first").mapInArrow(hashed, "ends long, ends_sha256 string")


class Subtrees:
    """The nodes of buckets of sequences, by multikey quicksort."""

    def __init__(self, seq: np.ndarray, n: np.ndarray, start: np.ndarray, length: np.ndarray, tid: np.ndarray, words: np.ndarray):
        self.seq, self.n, self.start, self.length, self.tid, self.words = seq, n, start, length, tid, words
        self.conv: list[int] = []
        self.depth: list[int] = []
        self.above: list[int] = []
        self.parent: list[int] = []
        self.convs: list[int] = []
        self.ends: list[int] = []
        self.own: list[int] = []

    def node(self, conv: int, depth: int, above: int, parent: int, convs: int, ends: int, words: int) -> int:
        """above: the parent's number here (-1: outside), parent: its conversation."""
        for column, x in zip((self.conv, self.depth, self.above, self.parent, self.convs, self.ends, self.own), (conv, depth, above, parent, convs, ends, (convs - 1) * words), strict=True):
            column.append(x)
        return len(self.conv) - 1

    def chain(self, one: int, used: int, depth: int, above: int, parent: int) -> None:
        """A sequence alone: its turns from the one after `used`, each a node."""
        seq, n, at, length = int(self.seq[one]), int(self.n[one]), int(self.start[one]), int(self.length[one])
        for k in range(used, length):
            above = self.node(seq, depth + k - used, above, parent, n, seq if k == length - 1 else -1, int(self.words[at + k]))
            parent = seq

    def bucket(self, rows: np.ndarray, depth: int, parent: int) -> None:
        """All nodes of the sequences `rows`, which share their first turn, of depth `depth`."""
        # To do: sets with equal first `used` turns, told to be a node (True) or yet to be sorted by the next turn.
        work = [(rows, 1, -1, parent, True)]
        while work:
            rows, used, above, parent, settled = work.pop()
            if settled:
                if len(rows) == 1:
                    self.chain(int(rows[0]), used - 1, depth + used - 1, above, parent)
                    continue
                conv = int(self.seq[rows].min())
                over = rows[self.length[rows] == used]
                above = self.node(conv, depth + used - 1, above, parent, int(self.n[rows].sum()), int(self.seq[over[0]]) if len(over) else -1, int(self.words[self.start[rows[0]] + used - 1]))
                parent, rows = conv, rows[self.length[rows] > used]
                if not len(rows):
                    continue
            digit = self.tid[self.start[rows] + used]
            pivot = sorted((digit[0], digit[len(rows) // 2], digit[-1]))[1]
            for part in (rows[digit < pivot], rows[digit > pivot]):
                if len(part):
                    work.append((part, used, above, parent, False))
            work.append((rows[digit == pivot], used + 1, above, parent, True))

    def batch(self) -> pa.RecordBatch:
        """Nodes with the sums of their subtrees; a parent always stands before its children."""
        size = len(self.conv)
        children, leaves, saved = [0] * size, [0] * size, list(self.own)
        for i in range(size - 1, -1, -1):
            leaves[i] = leaves[i] or 1
            if (up := self.above[i]) >= 0:
                children[up] += 1
                leaves[up] += leaves[i]
                saved[up] += saved[i]
        columns = [self.conv, self.depth, self.parent, self.convs, children, leaves, saved]
        ends = pa.array([None if x < 0 else x for x in self.ends], pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns), ends], names=["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"])


def finished(rows: DataFrame, p: Params) -> DataFrame:
    """Nodes of small buckets: (parent, at, top, seq, n, d, tid, words), all rows of a bucket from depth `at` on. parent: the conversation of the node above, top: the bucket's own."""
    order = ["top", "at", "seq", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0

        def nodes(table: pa.Table) -> pa.RecordBatch:
            top, at, seq, parent, n, tid, words = (table.column(c).to_numpy() for c in ("top", "at", "seq", "parent", "n", "tid", "words"))
            new_bucket = np.r_[True, (top[1:] != top[:-1]) | (at[1:] != at[:-1])]
            first = np.flatnonzero(new_bucket | np.r_[True, seq[1:] != seq[:-1]])
            tree = Subtrees(seq[first], n[first], first, np.diff(np.r_[first, len(seq)]), tid, words)
            starts = np.flatnonzero(new_bucket[first])
            for a, z in zip(starts, [*starts[1:], len(first)], strict=True):
                tree.bucket(np.arange(a, z), int(at[first[a]]), int(parent[first[a]]))
            return tree.batch()

        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count < p.pack:
                continue
            table = pa.Table.from_batches(held)
            top, at = table.column("top").to_numpy(), table.column("at").to_numpy()
            last = int(np.flatnonzero((top != top[-1]) | (at != at[-1])).max(initial=-1)) + 1
            if last:
                yield nodes(table.slice(0, last))
                held = table.slice(last).to_batches()
                count -= last
        if held:
            yield nodes(pa.Table.from_batches(held))

    return rows.repartition("top", "at").sortWithinPartitions(*order).mapInArrow(run, NODE)


def chains(rows: DataFrame) -> DataFrame:
    """Nodes of long sequences that are alone in their bucket, a node a row."""
    own = rows.withColumns({"saved": (F.col("n") - 1) * F.col("words"), "back": -F.col("d")})
    summed = running(own, ["seq"], ["back"], "saved", "saved_tokens")
    one = F.lit(1).cast("long")
    return summed.select(
        F.col("seq").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("at"), F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("d") < F.col("len")).cast("long").alias("n_children"), one.alias("n_leaves"), "saved_tokens", F.when(F.col("d") == F.col("len"), F.col("seq")).alias("ends"),
    )


def trie(convs: DataFrame, rows: DataFrame, p: Params = Params()) -> DataFrame:
    """Nodes with the sums of their subtrees and ends_sha256. convs: all conversations; rows: (conv, d, tid, words), the turns with their depth from 1 on."""
    spark = rows.sparkSession
    rows = written(rows, "rebuilt")
    of, seqs = sequences(convs, rows)
    active = rows.withColumnRenamed("conv", "seq").join(seqs.select("seq", "n", "len"), "seq")
    no_id, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    # Buckets to cut: the node they hang on (top, at), its parent, members, words and the sequence that ends there.
    root = seqs.agg(F.min("seq").alias("top"), F.sum("n").alias("convs"), F.count("*").alias("seqs"), F.max(F.when(F.col("len") == 0, F.col("seq"))).alias("ends")).where("top is not null")
    buckets = written(root.select("top", zero.alias("at"), no_id.alias("parent"), "convs", "seqs", zero.alias("words"), "ends"), "buckets")
    least = seqs.agg(F.min("seq")).first()[0]
    active = written(active.withColumns({"top": F.lit(least).cast("long"), "at": zero}), "active")
    rounds, done, files = [], [], active
    while not buckets.isEmpty():
        # Depths at which all sequences of the bucket still agree, and the one (`cut`) at which they part or one has ended.
        depths = active.groupBy("top", "at", "d").agg(F.min("tid").alias("low"), F.max("tid").alias("high"), F.count("*").alias("m"), F.max("words").alias("w"), F.max(F.when(F.col("len") == F.col("d"), F.col("seq"))).alias("e"))
        depths = written(depths.join(buckets.select("top", "at", "seqs"), ["top", "at"]), "depths")
        cuts = written(depths.groupBy("top", "at").agg(F.min(F.when((F.col("low") < F.col("high")) | (F.col("m") < F.col("seqs")), F.col("d"))).alias("cut"), F.max("d").alias("last")).select("top", "at", F.coalesce("cut", F.col("last") + 1).alias("cut")), "cuts")
        placed = active.join(cuts, ["top", "at"])
        kids = placed.where("d = cut").groupBy("top", "at", "cut", "tid").agg(
            F.min("seq").alias("kid"), F.count("*").alias("seqs"), F.sum("n").alias("convs"), F.max("words").alias("words"), F.sum(F.col("len") - F.col("d") + 1).alias("size"), F.max(F.when(F.col("len") == F.col("d"), F.col("seq"))).alias("ends")
        )
        fate = F.when(F.col("size") <= p.local, "local").when(F.col("seqs") == 1, "chain").otherwise("cut")
        kids = written(kids.withColumn("fate", fate), "kids")
        own = placed.where("d = cut").join(kids.select("top", "at", "tid", "kid", "fate"), ["top", "at", "tid"]).select("seq", F.col("top").alias("parent"), F.col("cut").alias("next"), "kid", "fate")
        moved = written(placed.where("d >= cut").join(own, "seq").select("parent", F.col("next").alias("at"), F.col("kid").alias("top"), "fate", "seq", "n", "len", "d", "tid", "words"), "moved")
        drop_scratch(spark, files)
        done.append(written(finished(moved.where("fate = 'local'"), p), "nodes"))
        done.append(written(chains(moved.where("fate = 'chain'")), "chain_nodes"))
        rounds.append((buckets, depths, cuts, kids))
        buckets = kids.where("fate = 'cut'").select(F.col("kid").alias("top"), F.col("cut").alias("at"), F.col("top").alias("parent"), "convs", "seqs", "words", "ends")
        files = moved
        active = moved.where("fate = 'cut' and d > at").select("seq", "d", "tid", "words", "n", "len", "top", "at")

    # Upwards: a cut bucket's branch has its kids' sums, and the nodes of its common prefix add their own.
    upper = None
    for buckets, depths, cuts, kids in reversed(rounds):
        tops = reduce(DataFrame.unionByName, (x.select("conv_id", "depth", "n_leaves", "saved_tokens") for x in ([upper] if upper is not None else []) + done))
        sums = kids.join(tops, (F.col("kid") == F.col("conv_id")) & (F.col("cut") == F.col("depth")), "left").groupBy("top", "at").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("below"))
        shared = depths.join(cuts, ["top", "at"]).where("d < cut").select("top", "at", "d", F.col("w").alias("words"), F.col("e").alias("ends"))
        whole = shared.unionByName(buckets.select("top", "at", F.col("at").alias("d"), "words", "ends"))
        rest = buckets.select("top", "at", "parent", "convs").join(cuts, ["top", "at"]).join(sums, ["top", "at"], "left")
        line = whole.join(rest, ["top", "at"]).withColumns({"own": (F.col("convs") - 1) * F.col("words"), "back": -F.col("d")})
        line = running(line, ["top", "at"], ["back"], "own", "along")
        branch = F.col("d") == F.col("cut") - 1
        nodes = line.select(
            F.col("top").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") == F.col("at"), F.col("parent")).otherwise(F.col("top")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
            F.when(branch, F.coalesce("kids", zero)).otherwise(1).cast("long").alias("n_children"), F.greatest(F.coalesce("leaves", zero), F.lit(1)).alias("n_leaves"), (F.col("along") + F.coalesce("below", zero)).alias("saved_tokens"), "ends",
        )
        nodes = written(nodes, "upper")
        upper = nodes if upper is None else upper.unionByName(nodes)
    if upper is None:
        upper = spark.createDataFrame([], NODE)
    hashes = written(end_hashes(of, p), "ends")
    nothing = hashlib.sha256(b"").hexdigest()
    every = reduce(DataFrame.unionByName, done, upper)
    return every.join(hashes, "ends", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, p: Params = Params(), *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are."""
    turns = written(encoded(conversations, key, turn, role, text), "ordered")
    return trie(turns.select("conv").distinct(), turns.withColumnRenamed("pos", "d"), p)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(encoded(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text"), "ordered")
    return trie(*rebuilt(turns))


# The check sum of an id's decimal digits, bit by bit, since SQL has no crc32.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295)"

ORACLE_SQL = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM t)),
u AS (SELECT i.c, p AS o, r, x FROM i JOIN t ON t.c = i.c - i.c % 20 AND p <= h UNION ALL SELECT i.c, 4 + p, r, x FROM i JOIN t ON t.c = i.c AND p > h),
l AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY o) AS d, length(r) || ':' || r || x AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM u),
s AS (SELECT i.c, coalesce(list(k ORDER BY d) FILTER (k IS NOT NULL), []) AS ks, coalesce(list(w ORDER BY d) FILTER (k IS NOT NULL), []) AS ws FROM i LEFT JOIN l ON i.c = l.c GROUP BY i.c),
e AS (SELECT c, d, ks[1:d] AS pre, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, len(ks) AS n FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS d FROM s)),
v AS (SELECT pre, d, min(c) AS c, count(*) AS convs, max(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM e GROUP BY pre, d),
k AS (SELECT b.pre, b.d, count(a.c) AS kids, any_value(p.c) AS parent FROM v b LEFT JOIN v a ON a.d = b.d + 1 AND a.pre[1:b.d] = b.pre LEFT JOIN v p ON p.d = b.d - 1 AND b.pre[1:b.d - 1] = p.pre GROUP BY b.pre, b.d),
m AS (SELECT v.*, kids, parent FROM v JOIN k ON v.pre = k.pre AND v.d = k.d),
q AS (SELECT pre[1:j] AS pre, j AS d, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((convs - 1) * w) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM m) GROUP BY 1, 2)
SELECT c AS conv_id, m.d AS depth, parent AS parent_conv_id, convs AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, ends AS ends_sha256 FROM m JOIN q ON m.pre = q.pre AND m.d = q.d
"""
