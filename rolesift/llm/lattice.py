"""Near-duplicate embeddings by lattice hashing: random projections decoded to E8 lattice points.

Vectors of unit length are projected, table by table, to eight random directions, scaled,
shifted and decoded to the nearest point of the E8 lattice, which names their cell. Each
vector is also entered into the neighbouring cells whose points are nearly as near
(probing). Vectors that share a cell in some table are candidates; links are verified by
the cosine in double precision.

Equal vectors are one node with a number of copies. In a cell, each node is compared with
the cell's leader, for a few rounds with other leaders; then the nodes outside a cell's
largest component are compared with all others of the cell, in blocks dealt over tasks that
send out verified links only. The number of links is then counted inside each component,
block against block, and no pair is ever a row.

Cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing and are components of their own, and so do vectors of another length than
the compared one. Every row is a vector of its own: rows with one id are told apart, and
link only where their vectors do. Rows without an id link like others, and name no component
(null if nothing in it has an id). Ids may be of any type with an order. Ties (equal vectors)
are one node, and link with each other. An empty table gives no rows.
Other columns are never read, and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolesift.llm.common import drop_scratch, whole_groups, written
from rolesift.llm.components import components
from rolesift.llm.minhash import mix, open_buckets, remaining_blocks


@dataclass(frozen=True)
class Params:
    cosine: float = 0.95
    tables: int = 16
    scale: float = 1.4  # lattice units for a unit vector's projection
    probes: int = 3  # neighbouring cells entered besides the own
    block: int = 2048  # nodes compared with each other at once, and their bytes
    block_bytes: int = 16_000_000
    leader_rounds: int = 1
    seed: int = 7


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8 (whole coordinates with an even sum): round, and if the sum is odd round the worst coordinate the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    d = x[odd] - r[odd]
    worst = np.abs(d).argmax(axis=1)
    r[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 shifted by a half in every coordinate."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(axis=1) < ((x - a) ** 2).sum(axis=1)
    return np.where(closer[:, None], b, a)


def neighbours(x: np.ndarray, count: int, trials: int = 12) -> list[np.ndarray]:
    """Per row up to `count` further lattice points near x, nearest first: the points found by stepping away from the own one along the residual's largest coordinates."""
    own = nearest_e8(x)
    d = x - own
    order = np.argsort(-np.abs(d), axis=1)
    found = []
    rows = np.arange(len(x))
    # Steps by two coordinates (the lattice's shortest vectors), and towards the half-shifted copy.
    for i in range(4):
        for j in range(i + 1, 5):
            step = np.zeros_like(x)
            for k in (i, j):
                c = order[:, k]
                step[rows, c] = np.where(d[rows, c] >= 0, 1.0, -1.0)
            found.append(own + step)
    half = np.where(d >= 0, 0.5, -0.5)
    odd = np.flatnonzero((half < 0).sum(axis=1) % 2)
    half[odd, order[odd, -1]] *= -1
    found.append(own + half)
    away = np.stack([((x - y) ** 2).sum(axis=1) for y in found])
    best = np.argsort(away, axis=0, kind="stable")[:count]
    stacked = np.stack(found)
    return [stacked[best[k], rows] for k in range(min(count, len(found)))]


def directions(dim: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(p.seed)
    return random.standard_normal((p.tables, dim, 8)), random.uniform(0, 2, (p.tables, 8))


def cells(unit: np.ndarray, p: Params) -> np.ndarray:
    """Cell keys (rows x tables x (1 + probes)) of unit vectors."""
    project, shift = directions(unit.shape[1], p)
    out = np.zeros((len(unit), p.tables, 1 + p.probes), np.uint64)
    for t in range(p.tables):
        x = unit @ project[t] * p.scale + shift[t]
        for k, point in enumerate([nearest_e8(x), *neighbours(x, p.probes)]):
            twice, h = (2 * point).astype(np.int64).astype(np.uint64), np.full(len(x), t + 1, np.uint64)
            for c in range(8):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + twice[:, c])
            out[:, t, k] = h
    return out.view(np.int64)


def usable(values: list) -> np.ndarray | None:
    """A vector in double precision at unit length; None if it can link with nothing."""
    if values is None or not len(values) or None in values:
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def units_of(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, row, unit) of every row: its number and its vector at unit length, doubles as bytes (null where it can link with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                units = [usable(x) for x in b.column("v").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array([None if u is None else u.astype("<f8").tobytes() for u in units], pa.binary())], names=["id", "row", "unit"])

    rows = vectors.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("row", T.LongType()), T.StructField("unit", T.BinaryType())]))


def linked(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) of nodes with a cosine at or above the threshold."""
    a, b = (nodes.select(F.col("node").alias(x), F.col("unit").alias(f"u{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                if part.num_rows:
                    keep = [len(x) == len(y) and float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")) >= p.cosine for x, y in zip(part.column("ua").to_pylist(), part.column("ub").to_pylist(), strict=True)]
                    yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "ua", "ub").mapInArrow(run, "a long, b long")


def block_links(blocks: DataFrame, p: Params) -> DataFrame:
    """(a, b): the links of each block (key, x, y) between its outer nodes and the others of different components. Blocks of one cell or many are compared one after the other in a task."""
    keys = ["key", "x", "y", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            node, label, outer = (table.column(c).to_numpy() for c in ("node", "label", "outer"))
            units = table.column("unit").to_pylist()
            links = []
            for at, end in zip(starts, [*starts[1:], len(node)], strict=True):
                own = np.arange(at, end)
                x, y = own[outer[at:end]], own[~outer[at:end]]
                if len(x) and len(y):
                    u, v = (np.frombuffer(b"".join([units[i] for i in side]), "<f8").reshape(len(side), -1) for side in (x, y))
                    i, j = np.nonzero((u @ v.T >= p.cosine) & (label[x][:, None] != label[y][None, :]))
                    if len(i):
                        links.append(np.stack([node[x[i]], node[y[j]]], axis=1))
            pairs = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1, initial=2**62)), pa.array(pairs.max(axis=1, initial=-(2**62)))], names=["a", "b"])

    rows = blocks.withColumn("size", F.length("unit"))
    return rows.select(*keys, "node", "label", "outer", "unit").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def closed(members: DataFrame, label: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The components once all links inside cells are counted in: (node, component), given those by the cells' leaders."""
    for turn in range(1, p.leader_rounds + 1):
        pairs = written(open_buckets(members, label, turn).where("label <> lead.label").select(F.least("lead.node", "node").alias("a"), F.greatest("lead.node", "node").alias("b")).distinct(), "pairs")
        if pairs.isEmpty():  # every cell is one component
            return label
        label = written(components(linked(pairs, nodes, p), known=label), "labels")
    blocks = written(remaining_blocks(members, label, nodes.select("node", F.length("unit").cast("long").alias("bytes")), p), "remaining")
    if blocks.isEmpty():
        return label
    last = block_links(blocks.join(nodes.select("node", "unit").hint("merge"), "node"), p)
    return written(components(last, known=label), "labels")


def link_components(vectors: DataFrame, p: Params, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(ids with their node, nodes with copies, vector and component)"""
    spark = vectors.sparkSession
    units = written(units_of(vectors, key, vector), "units")
    nodes = written(units.where("unit is not null").groupBy("unit").agg(F.min("row").alias("node"), F.count("*").alias("copies")), "nodes")
    ids = units.join(nodes.select("unit", "node"), "unit", "left").select("id", "row", "node")

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                by_size: dict[int, list[int]] = {}
                for i, u in enumerate(b.column("unit").to_pylist()):
                    by_size.setdefault(len(u), []).append(i)
                for rows in by_size.values():
                    part = b.take(pa.array(rows))
                    keys = cells(_matrix(part.column("unit")), p).reshape(len(rows), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column("node")), keys.shape[1])), pa.array(keys.reshape(-1))], names=["node", "key"])

    # A vector's cells differ from table to table and from each other, so no entry repeats.
    entries = written(nodes.select("node", "unit").mapInArrow(enter, "node long, key long"), "entries")
    shared = entries.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    members = written(entries.join(shared, "key"), "members")
    drop_scratch(spark, entries)
    links = linked(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), nodes, p)
    label = closed(members, written(components(links), "labels"), nodes, p)
    drop_scratch(spark, members)
    placed = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return ids, written(placed, "placed")


def link_counts(placed: DataFrame, p: Params) -> DataFrame:
    """(node, n_links): how many other vectors a node's vector links with, its own copies included.

    A component's nodes are dealt into blocks of about p.block by a hash; every pair of
    blocks is one group, so that a group is never larger than two blocks.
    """
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"))
    rows = placed.join(sizes, "component")
    alone = rows.where("n = 1").select("node", (F.col("copies") - 1).alias("n_links"))
    many = rows.where("n > 1").withColumn("blocks", F.ceil(F.col("n") / p.block)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = many.select("component", "node", "copies", "unit", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).select("component", "node", "copies", "unit", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    keys = ["component", "x", "y", "size"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            x, y, block, copies, node = (table.column(c).to_numpy() for c in ("x", "y", "block", "copies", "node"))
            units = table.column("unit").to_pylist()
            links = np.zeros(len(node), np.int64)
            for at, end in zip(starts, [*starts[1:], len(node)], strict=True):
                u = np.frombuffer(b"".join(units[at:end]), "<f8").reshape(end - at, -1)
                near = u @ u.T >= p.cosine
                np.fill_diagonal(near, False)
                own = 0
                if x[at] != y[at]:  # pairs within a block are counted in that block's own group
                    side = block[at:end] == x[at]
                    near &= side[:, None] != side[None, :]
                else:
                    own = copies[at:end] - 1
                links[at:end] = near @ copies[at:end] + own
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links)], names=["node", "links"])

    sized_rows = dealt.withColumn("size", F.length("unit")).select(*keys, "block", "copies", "node", "unit").repartition(*keys).sortWithinPartitions(*keys)
    counted = sized_rows.mapInArrow(compare, "node long, links long").groupBy("node").agg(F.sum("links").alias("n_links"))
    return alone.unionByName(counted)


def near_duplicates(vectors: DataFrame, p: Params = Params(), *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id) for every row."""
    ids, placed = link_components(vectors, p, key, vector)
    counts = placed.select("node", "component").join(link_counts(placed, p), "node")
    known = written(ids.join(counts, "node", "left").select("id", "component", "n_links"), "known")
    least = known.where("component is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    return known.join(least, "component", "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op7_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
