"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory. DataFrame functions only.

A licence has several templates: notices, titles, its standard header and its full text.
Units of a text are its lines, pairs of neighbouring lines (titles), its sentences, its
paragraphs (lines up to one without letters and digits, so that comment marks part them too)
and the whole text. A unit is a vector of words (lower case, letters and
digits) weighted by (1 + ln count) times idf. Document frequencies are counted over all texts for
the words of the templates; any other word weighs as one that no text holds, so it needs no
count. Against notices, titles and headers, so does a word of full texts only. A unit carries the licence of the template with the greatest cosine, if that is at
least `similarity`; of equal ones the first name. A unit that holds an SPDX line is decided
by its identifier alone: a known one has cosine 1, another is no licence. The document's own
licence is that of its best unit; reserved rights count only where no licence is granted. A
document whose whole text, or whose name, is that of a licence file is a licence file.

Search: a unit at the threshold holds words of the template with a share of `similarity`
squared of its squared length at least. Which words of the templates a text holds is found in
one pass, which also counts the document frequencies. What a template's rare words (in fewer
than one text of a hundred) must then add to its other words takes at least so many of the
heaviest; only texts that hold as many rare words for some template are read again and cut
into units, and of these only units with one of the template words without which nothing
reaches the threshold are compared. No unit at the threshold is lost.

Inheritance: a document without an own licence gets that of the nearest directory above it
that holds a licence file with a licence; of several in one directory the greatest cosine,
then the least path, decides.

Cases: null and empty texts have no licence of their own but may inherit. A null path
inherits nothing and is no licence file. Rows that share an id are one document: its best
unit counts. Rows without an id come out unscanned, with licence null. No rows give no
rows. Other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.llm.common import sized, written

#: Rows up to which a table of directories or ids is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000

#: Words from which a template counts as a full text.
FULL_WORDS = 150

RESERVED = "All-rights-reserved"


def _gnu(kind: str, version: str, date: str) -> tuple[str, ...]:
    name = f"GNU {kind} General Public License".replace("  ", " ")
    header = (
        "This program is free software: you can redistribute it and/or modify it under the terms of the {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {0} for more details. "
        "You should have received a copy of the {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
    ).format(name, version)
    first = header.split(". ")[0] + "."
    return f"This work is licensed under the {name}, version {version}.", f"{name} Version {version}, {date}", f"Licensed under the {name} v{version}.0", header, first


def _cc(code: str, name: str) -> tuple[str, ...]:
    return f"Licensed under {code} 4.0.", f"Creative Commons {name} 4.0 International", f"This work is licensed under a Creative Commons {name} 4.0 International License."


# The names of public licences with usual notices, titles and standard headers of each.
NOTICES = {
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero", "3", "19 November 2007")[1:]),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "Apache License 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license. BSD 3-Clause License.", "BSD 3-Clause License", "Licensed under the BSD 3-Clause License."),
    "CC-BY-4.0": _cc("CC BY", "Attribution"),
    "CC-BY-NC-4.0": _cc("CC BY-NC", "Attribution-NonCommercial"),
    "CC-BY-SA-4.0": _cc("CC BY-SA", "Attribution-ShareAlike"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal public domain dedication.", "CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GPL-2.0": _gnu("", "2", "June 1991"),
    "GPL-3.0": _gnu("", "3", "29 June 2007"),
    "LGPL-3.0": _gnu("Lesser", "3", "29 June 2007"),
    RESERVED: ("All rights reserved.",),
    "MIT": (
        "Released under the MIT License.",
        "MIT License",
        "The MIT License (MIT)",
        "Licensed under the MIT License.",
        "Use of this source code is governed by an MIT-style license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "The Unlicense"),
}


def templates() -> dict[str, tuple[str, ...]]:
    """The notices and, where the package holds it, the full text of each licence."""
    held = resources.files("rolesift.llm") / "licence_texts"
    return {name: (*forms, *(f.read_text("utf-8") for f in [held / f"{name}.txt"] if f.is_file())) for name, forms in NOTICES.items()}


@dataclass(frozen=True)
class Params:
    similarity: float = 0.8
    templates: dict[str, tuple[str, ...]] = field(default_factory=templates)
    file_name: str = r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
    salts: int = 16


def words_of(text: str | Column) -> Column:
    """Words in order; never an empty one."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def units_of(rows: DataFrame, text: str, anchor: str) -> DataFrame:
    """(doc_id, unit, whole) of the different units of a text that hold an anchor: lines, pairs of lines, sentences, paragraphs, the whole text."""
    # Each step is a column of its own: within a lambda an expression would be computed again for every element.
    rows = rows.select("doc_id", F.regexp_replace(F.col(text), r"\r\n?", "\n").alias("plain"))
    rows = rows.select("*", F.split("plain", "\n").alias("lines"), F.split("plain", r"\n[^\p{L}\p{N}\n]*(?=\n)").alias("paragraphs"))
    pairs = F.zip_with(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))), F.slice("lines", 2, F.size("lines")), lambda x, y: F.concat(x, F.lit("\n"), y))
    sentences = F.flatten(F.transform("paragraphs", lambda x: F.split(x, r"(?<=[.;:!?])\s+")))
    rows = rows.select("doc_id", "plain", F.array_distinct(F.concat("lines", pairs, sentences, "paragraphs", F.array("plain"))).alias("parts"))
    return rows.select("doc_id", "plain", F.explode("parts").alias("unit")).where(F.lower("unit").rlike(anchor)).select("doc_id", "unit", (F.col("unit") == F.col("plain")).alias("whole"))


@dataclass(frozen=True)
class Weights:
    names: list[str]  # the licence of each template
    own: list[dict[str, float]]  # weights of each template's words at unit length
    idf: dict[str, float]  # of the templates' words
    unseen: float  # idf of a word that no text holds
    held: dict[str, int]  # texts that hold a word
    full: list[bool]  # whether a template is a full text


def template_counts(p: Params, spark: SparkSession) -> tuple[list[tuple[str, str]], list[dict[str, int]]]:
    """(licence, form) of each template, and its words' counts."""
    forms = [(name, form) for name in sorted(p.templates) for form in p.templates[name]]
    table = spark.createDataFrame(pa.table({"i": range(len(forms)), "form": [form for _, form in forms]}))
    counts: list[dict[str, int]] = [{} for _ in forms]
    for r in table.select("i", F.explode(words_of("form")).alias("word")).groupBy("i", "word").count().collect():
        counts[r["i"]][r["word"]] = r["count"]
    return forms, counts


def held_terms(docs: DataFrame, terms: list[str], key: str, text: str) -> DataFrame:
    """(doc_id, terms): the different words of templates that each row's text holds."""
    return docs.select(F.col(key).alias("doc_id"), F.array_intersect(words_of(text), F.lit(terms)).alias("terms"))


def template_weights(terms_of: DataFrame, forms: list[tuple[str, str]], counts: list[dict[str, int]]) -> Weights:
    """As many rows as the templates have words come to the driver."""
    terms = sorted({w for own in counts for w in own})
    n = terms_of.count()
    held = {r["word"]: r["count"] for r in terms_of.select(F.explode("terms").alias("word")).groupBy("word").count().collect()}
    idf = {t: math.log((1 + n) / (1 + held.get(t, 0))) + 1 for t in terms}
    own = []
    for c in counts:
        c = {w: 1 + math.log(k) for w, k in c.items()}  # a word that fills a full text must not outweigh all others
        size = math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items()))
        own.append({w: k * idf[w] / size for w, k in c.items()})
    return Weights([name for name, _ in forms], own, idf, math.log(1 + n) + 1, held, [sum(c.values()) >= FULL_WORDS for c in counts])


def _least(weights: list[float], need: float) -> int:
    """How many of the heaviest words make up `need` of the squared length."""
    least = 0
    for x in sorted(weights, reverse=True):
        if need <= 1e-9:
            break
        need -= x * x
        least += 1
    return least


def possible(terms: str, rare: str, rare_words: set[str], weights: Weights, similarity: float) -> Column:
    """Whether a text with these template words, and these rare ones among them, may hold a unit at the threshold."""
    found = F.lit(False)
    for own, full in zip(weights.own, weights.full, strict=True):
        mine = {w: x for w, x in own.items() if w in rare_words}
        common = sum(x * x for w, x in own.items() if w not in rare_words)
        column, words, least = (rare, mine, k) if (k := _least(list(mine.values()), similarity**2 - common)) else (terms, own, _least(list(own.values()), similarity**2))
        enough = F.size(column) >= least
        # A short template's own words are counted; a full text's are too many for that, and the size alone decides.
        found |= enough if full else enough & (F.size(F.array_intersect(column, F.lit(sorted(words)))) >= least)
    return found


def anchors_of(weights: Weights, similarity: float) -> list[str]:
    """Words one of which any unit at the threshold must hold: of each template those that are in the fewest texts for their weight."""
    found: set[str] = set()
    for own in weights.own:
        left = 1.0
        for word, x in sorted(own.items(), key=lambda r: ((1 + weights.held.get(r[0], 0)) / r[1] ** 2, r[0])):
            if math.sqrt(max(left, 0.0)) < similarity - 1e-9:
                break
            found.add(word)
            left -= x * x
    return sorted(found | {"spdx"})


def own_licences(docs: DataFrame, p: Params = Params(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licence, cosine, whole) of each document with a licence of its own; whole: its whole text is the notice."""
    spark = docs.sparkSession
    forms, counts = template_counts(p, spark)
    terms = sorted({w for c in counts for w in c} | {"spdx"})
    terms_of = written(held_terms(docs, terms, key, text), "terms")
    weights = template_weights(terms_of, forms, counts)
    anchors = anchors_of(weights, p.similarity)
    anchor = r"(?<![\p{L}\p{N}])(" + "|".join(anchors) + r")(?![\p{L}\p{N}])"
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("__text"))
    most = terms_of.count() / 100
    rare = sorted(w for w in weights.idf if weights.held.get(w, 0) < most)
    with_rare = written(terms_of.where("doc_id is not null").where(F.arrays_overlap("terms", F.lit(anchors))).select("doc_id", "terms", (F.array_intersect("terms", F.lit(rare)) if rare else F.array().cast("array<string>")).alias("rare")), "rare")
    ids = with_rare.where(F.array_contains("terms", "spdx") | possible("terms", "rare", set(rare), weights, p.similarity)).select("doc_id").distinct()
    ids = written(ids, "held")
    held = rows.join(sized(ids), "doc_id", "left_semi")
    units = units_of(held, "__text", anchor).select("doc_id", F.xxhash64("unit", F.length("unit")).alias("no"), "whole", "unit")
    tag = r"(?i)spdx-license-identifier:[ \t(]*([a-z0-9.+-]+)"
    known = F.create_map(*(F.lit(x) for name in sorted(p.templates) if name != RESERVED for form in (name, f"{name}-only", f"{name}-or-later", f"{name}+") for x in (form.lower(), name)))
    # An SPDX line speaks for itself; a whole text with one is still compared. It goes along as one more word, of a kind
    # that no text has (with a blank), so that units are made once: 1 where it is the whole text, then the licence.
    tagged = F.col("unit").rlike(tag)
    found = F.concat(F.when(F.col("whole") & ~F.trim("unit").contains("\n"), " 1").otherwise(" 0"), known[F.lower(F.regexp_extract("unit", tag, 1))])
    words = units.select("doc_id", "no", "whole", F.concat(F.when(F.col("whole") | ~tagged, words_of("unit")).otherwise(F.array().cast("array<string>")), F.array_compact(F.array(F.when(tagged, found)))).alias("w"))
    # A unit is counted in the task that holds its text; only its different words are shuffled.
    counted = words.select("doc_id", "no", "whole", F.explode("w").alias("word")).groupBy("doc_id", "no", "whole", "word").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))
    # As many rows as the templates have words.
    short = {w for own, full in zip(weights.own, weights.full, strict=True) if not full for w in own}
    table = spark.createDataFrame(pa.table({"word": list(weights.idf), "idf": list(weights.idf.values()), "short": [x if w in short else weights.unseen for w, x in weights.idf.items()], "own": [[own.get(w, 0.0) for own in weights.own] for w in weights.idf]}))
    is_tag = F.col("word").startswith(" ")
    weight = lambda c: F.when(is_tag, 0.0).otherwise(F.col("tf") * F.coalesce(c, F.lit(weights.unseen)))
    vector = counted.join(F.broadcast(table), "word", "left").select("doc_id", "no", "whole", weight("idf").alias("x"), weight("short").alias("y"), "own", F.when(is_tag, F.col("word")).alias("tag"))
    dots = [F.coalesce(F.sum(F.col("x") * F.col("own")[i]), F.lit(0.0)).alias(f"d{i}") for i in range(len(weights.own))]
    scored = vector.groupBy("doc_id", "no", "whole").agg(*(F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"__{c}") for c in "xy"), F.max("tag").alias("tag"), *dots)
    cosines = F.array(*(F.struct(F.round(F.try_divide(F.col(f"d{i}"), F.col("__x" if weights.full[i] else "__y")), 6).alias("cosine"), F.lit(-i).alias("first"), F.lit(name).alias("licence"), F.col("whole").alias("whole")) for i, name in enumerate(weights.names)))
    by_tag = F.when(F.col("tag").isNotNull(), F.struct(F.lit(1.0).alias("cosine"), F.lit(1).alias("first"), F.substring("tag", 3, 1000).alias("licence"), F.substring("tag", 2, 1).eqNullSafe("1").alias("whole")))
    top = scored.select("doc_id", F.explode(F.array_compact(F.array(F.array_max(cosines), by_tag))).alias("b")).select("doc_id", "b.*").where(F.col("cosine") >= p.similarity)
    best = F.struct((F.col("licence") != RESERVED).alias("granted"), "cosine", "first", "licence")
    return top.groupBy("doc_id").agg(F.max(best).alias("b"), F.max("whole").alias("whole")).select("doc_id", "b.licence", "b.cosine", "whole")


def directory(path: str) -> Column:
    """What is before the last slash; empty for a name alone."""
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), r"/+$", "")


def _sized_join(left: DataFrame, right: DataFrame, on: str, salt_by: str, salts: int) -> DataFrame:
    """A left join with a table of one row a key: broadcast if small, else with hot keys dealt over salts."""
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, "left")
    spread = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).join(spread, [on, "__salt"], "left").drop("__salt")


def scan(docs: DataFrame, p: Params = Params(), *, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """(doc_id, licence, cosine, origin, licence_path) for every row: origin is own, inherited or none."""
    own = written(own_licences(docs, p, key=key, text=text), "licences")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(path).alias("path")).withColumn("dir", directory("path"))
    found = rows.where("doc_id is not null").join(own, "doc_id")
    files = found.where(F.col("path").isNotNull() & (F.col("whole") | F.col("path").rlike(p.file_name)))
    ranked = files.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("less"), F.col("path").alias("path"), F.col("licence").alias("licence"))).alias("f"))
    holders = written(ranked.select(F.col("dir").alias("above"), F.col("f.licence").alias("up_licence"), F.col("f.path").alias("up_path")), "holders")

    # Each different directory once, with all directories above it.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("above")))
    ladder = rows.where("dir is not null").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.above")
    near = _sized_join(ladder, holders, "above", "dir", p.salts).where("up_licence is not null")
    near = written(near.groupBy("dir").agg(F.max_by(F.struct("up_licence", "up_path"), "depth").alias("n")).select("dir", "n.up_licence", "n.up_path"), "nearest")
    return (
        _sized_join(rows.join(own.drop("whole"), "doc_id", "left"), near, "dir", "doc_id", p.salts)
        .select(
            "doc_id",
            F.coalesce("licence", F.when(F.col("doc_id").isNotNull(), F.col("up_licence"))).alias("licence"),
            "cosine",
            F.when(F.col("licence").isNotNull(), "own").when(F.col("doc_id").isNotNull() & F.col("up_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
            F.when(F.col("licence").isNotNull(), F.col("path")).otherwise(F.when(F.col("doc_id").isNotNull(), F.col("up_path"))).alias("licence_path"),
        )
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand at source/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.concat_ws("/", F.col("source"), F.col("doc_id").cast("string")).alias("path"), "source")
    return scan(docs.withColumn("path", F.when(F.col("source").isNotNull(), F.col("path"))))
