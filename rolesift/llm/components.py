"""Connected components of a link table, by large-star and small-star steps over DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.llm.common import drop_scratch, written

#: Links up to which one task finishes what is left; more are settled by rounds over all tasks. The components are the same.
LOCAL_LINKS = 20_000


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node but the least of a component, hung on the least one."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for b in batches:
        for x, y in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            x, y = top(x), top(y)
            above[max(x, y)] = min(x, y)
    hung = [(x, top(x)) for x in above]
    hung = [(x, y) for x, y in hung if x != y]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hung], pa.int64()), pa.array([y for _, y in hung], pa.int64())], names=["u", "v"])


def stars(edges: DataFrame) -> DataFrame:
    """The same components as stars (u, v) around their least nodes. edges: a written table of different links (u, v), u > v.

    Every step joins each node with the least of its neighbours, which is aggregated before
    the shuffle; the join deals both sides anew, so that the adaptive join can split a node
    with very many links over tasks.
    """
    spark, before = edges.sparkSession, _state(edges)
    # An expression of the key: the aggregate's own partitions, one a key, would keep the join from splitting a hot one.
    dealt_anew = F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u")
    for _ in range(60):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew, F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u is hung on the least one around u.
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        drop_scratch(spark, edges)
        # Small star: u and its smaller neighbours are hung on the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew, "m")
        hung = large.join(least, "u").select("u", "v", "m")
        small = hung.select("u", F.col("m").alias("v")).unionByName(hung.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        drop_scratch(spark, large)
        state = _state(edges)
        if state == before:
            return edges
        before = state
    raise RuntimeError("components did not settle")


def components(links: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, component): the smallest id reachable from every node that has a link. Ids are longs.

    known: the components of earlier links. Only links between different ones of these are
    then settled, so that a few more links cost little however many there were before.
    Links with nulls and links of a node with itself are left out; repeated links count once;
    no links give no rows (or the known ones).
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    if known is not None:
        for side in ("u", "v"):
            label = known.select(F.col("node").alias(side), F.col("component").alias("__label"))
            pairs = pairs.join(label, side, "left").withColumn(side, F.coalesce("__label", side)).drop("__label")
    edges = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    if edges.limit(local + 1).count() <= local:
        edges = written(edges.coalesce(1).mapInArrow(_few, "u long, v long"), "stars")
    else:
        edges = stars(edges)
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if known is None:
        return found
    to = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = known.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return moved.unionByName(found.join(known.select("node"), "node", "left_anti"))
