"""Relevance of postings by weighted vocabularies, and sets of distinct signals.

All terms of all vocabularies are counted in one pass over a text by an automaton, in Arrow
batches: the cost of a text doesn't grow with the number of terms. Scores, names and sides are
then made of the few terms found, by column functions.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mark:
    """A pattern that is named and weighed once, however often it matches."""

    name: str
    pattern: str
    weight: float


@dataclass(frozen=True)
class Vocabulary:
    """Terms with weights in named groups, title terms, marks, and a name and weight for a title that matches all of some patterns while no title term does."""

    groups: dict[str, dict[str, float]]
    titles: dict[str, float] = field(default_factory=dict)
    marks: tuple[Mark, ...] = ()
    split_title: tuple[str, tuple[str, ...], float] | None = None
    cap: int = 3

    @property
    def entries(self) -> list[tuple[str, float]]:
        """Terms in order; one that stands in two groups is two entries."""
        return [(t, w) for group in self.groups.values() for t, w in group.items()]


def rlike(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?idU){pattern}"), F.lit(False))


_automata: dict[tuple[str, ...], tuple] = {}


def automaton(terms: tuple[str, ...]):
    """The automaton of the terms, and the lengths of those that can overlap themselves. Made once a worker."""
    if terms not in _automata:
        found = ahocorasick.Automaton()
        for i, t in enumerate(terms):
            found.add_word(t, i)
        found.make_automaton()
        _automata[terms] = found, {i: len(t) for i, t in enumerate(terms) if any(t.startswith(t[k:]) for k in range(1, len(t)))}
    return _automata[terms]


def counts_of(text: str, terms: tuple[str, ...]) -> dict[int, int]:
    """How often each term occurs, without overlap of a term with itself; different terms may overlap."""
    find, overlapping = automaton(terms)
    seen: dict[int, int] = {}
    until: dict[int, int] = {}
    for end, i in find.iter(text):
        if i in overlapping:
            if end - overlapping[i] < until.get(i, -1):
                continue
            until[i] = end
        seen[i] = seen.get(i, 0) + 1
    return seen


def hits(text: Column, terms: Iterable[str]) -> Column:
    """array<struct<i, n>>: the number of each term found and how often it occurs, in the order of the terms. A null text has none."""
    known = tuple(terms)

    @F.arrow_udf("array<struct<i:int,n:int>>")
    def count(texts: pa.Array) -> pa.Array:
        which: list[int] = []
        counts: list[int] = []
        ends = [0]
        for x in texts:  # one text at a time, so that a batch is never held twice
            found = counts_of(x.as_py() or "", known) if x.is_valid else {}
            for i in sorted(found):
                which.append(i)
                counts.append(found[i])
            ends.append(len(which))
        pairs = pa.StructArray.from_arrays([pa.array(np.asarray(which, np.int32)), pa.array(np.asarray(counts, np.int32))], names=["i", "n"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return count(text)


def _table(values: list) -> Column:
    return F.array(*(F.lit(x) for x in values))


def with_relevance(rows: DataFrame, title: str, body: str, vocabularies: dict[str, Vocabulary]) -> DataFrame:
    """`rows` with score_<name> and matched_<name> (names of terms, marks and title terms, in order) for each vocabulary. Title and body are cleaned texts; null counts as empty."""
    terms = tuple(dict.fromkeys(t for v in vocabularies.values() for t, _ in v.entries))
    titles = tuple(dict.fromkeys(t for v in vocabularies.values() for t in v.titles))
    low, name = F.lower(F.coalesce(body, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    # Lowered once, and each mark looked for once: columns that several others use are not merged into them.
    rows = rows.withColumns({"__low": low, "__name": name})
    rows = rows.withColumns({"__body": hits(F.col("__low"), terms), "__title": hits(F.col("__name"), titles)})
    marks = {f"__{key}_{m.name}": rlike(F.col("__low"), m.pattern) for key, v in vocabularies.items() for m in v.marks}
    rows = rows.withColumns(marks) if marks else rows
    return reduce(lambda frame, item: _scored(frame, *item, terms, titles), vocabularies.items(), rows).drop("__low", "__name", "__body", "__title", *marks)


def _scored(rows: DataFrame, key: str, v: Vocabulary, terms: tuple[str, ...], titles: tuple[str, ...]) -> DataFrame:
    weight = dict.fromkeys(terms, 0.0)
    for t, w in v.entries:
        weight[t] += float(w)
    own = {t for t, _ in v.entries}
    weights, names = _table(list(weight.values())), _table([t if t in own else None for t in terms])
    bonus, told = _table([float(v.titles.get(t, 0.0)) for t in titles]), _table([f"title:{t}" if t in v.titles else None for t in titles])
    score = F.aggregate("__body", F.lit(0.0), lambda total, h: total + F.least(h["n"], F.lit(v.cap)) * F.get(weights, h["i"]))
    matched = F.array_compact(F.transform("__body", lambda h: F.get(names, h["i"])))
    if titles:
        score += F.aggregate("__title", F.lit(0.0), lambda total, h: total + F.get(bonus, h["i"]))
    in_title = F.array_compact(F.transform("__title", lambda h: F.get(told, h["i"]))) if titles else F.array().cast("array<string>")
    holds = {m.name: F.col(f"`__{key}_{m.name}`") for m in v.marks}
    marks = [F.when(holds[m.name], m.name) for m in v.marks]
    score += sum((F.when(holds[m.name], m.weight).otherwise(0.0) for m in v.marks if m.weight), F.lit(0.0))
    if v.split_title:
        mark, patterns, worth = v.split_title
        split = (F.size(in_title) == 0) & reduce(Column.__and__, (rlike(F.col("__name"), p) for p in patterns))
        score += F.when(split, worth).otherwise(0.0)
        marks.append(F.when(split, mark))
    extra = F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>")
    return rows.withColumns({f"score_{key}": score, f"matched_{key}": F.concat(matched, in_title, extra)})


def distinct_hits(text: Column, pattern: str) -> Column:
    """How many different strings of a text the pattern matches, without regard to case."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?idU){pattern}"), F.lit(0))
    return F.size(F.array_distinct(F.transform(found, F.lower)))


def all_hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?idU){pattern}"))


def audience(text: Column, business: str, consumer: str) -> Column:
    """The audience that a text names most often: consumers from two mentions on, else businesses from one."""
    b, c = all_hits(text, business), all_hits(text, consumer)
    return F.when((c > b) & (c >= 2), "b2c_dtc_ecommerce").when(b > 0, "b2b_saas_enterprise").otherwise("b2b_other")


def funnel_side(body: Column, title: Column, creates: str, captures: str, creates_title: str, captures_title: str) -> Column:
    """Whether a role makes traffic or converts it, by different signals; a title that only makes traffic counts for two."""
    creation = distinct_hits(body, creates) + F.when(rlike(title, creates_title) & ~rlike(title, captures_title), 2).otherwise(0)
    more = creation > distinct_hits(body, captures)
    return F.when((creation >= 4) & more, "campaign_creation_heavy").when((creation >= 2) & more, "campaign_creation_mixed").otherwise("capture_balanced")


def seniority_cap(title: Column, note: Column, senior: str, claimable: str, cap: float) -> Column:
    """The most that a senior title may score where the note names no claimable specialism; null: no cap."""
    return F.when(rlike(title, senior) & ~rlike(note, claimable), F.lit(cap))
