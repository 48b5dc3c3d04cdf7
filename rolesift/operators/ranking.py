"""Latest rows, first wins, gates, weighted vocabularies and rubric scores over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesift.functions.text import occurrences


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key. max_by is aggregated before the shuffle, so a hot key costs one row a task."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("__r")).select(key, "__r.*")


def first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("__r")).select(key, "__r.*")


def top_k(rows: DataFrame, group: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group; the limit is applied in every task before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)


def vocabulary_score(text: Column, terms: list[tuple[str, float]], cap: int = 3) -> Column:
    """Sum of weight times count, counts capped. The vocabulary is a parameter and part of the plan: no join."""
    return sum((F.least(occurrences(text, t), F.lit(cap)) * F.lit(float(w)) for t, w in terms), F.lit(0.0))


def matched(text: Column, terms: list[tuple[str, float]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(t)), F.lit(t)) for t, _ in sorted(terms))))


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate whose condition holds; null if none does (a null condition doesn't)."""
    return F.coalesce(*(F.when(failed, F.lit(name)) for name, failed in gates))


def weighted_mean(scores: dict[str, float]) -> Column:
    """Mean of the columns by weight, over those that aren't null."""
    have = sum((F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in scores.items()), F.lit(0.0))
    return sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in scores.items()), F.lit(0.0)) / F.nullif(have, F.lit(0.0))


def bucket(tracks: Column) -> Column:
    a, b = F.array_contains(tracks, "a"), F.array_contains(tracks, "b")
    return F.when(a & b, "overlap").when(b, "b_only").otherwise("a_only")
