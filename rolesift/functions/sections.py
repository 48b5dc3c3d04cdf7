"""Sections of a posting's text: which kind of section a line opens, and the text under each kind. Columns only, but for the repair of mojibake."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions.text import cleaned, normalised

OVERVIEW, DUTIES, DEMANDS, STOP = "overview", "responsibilities", "requirements", "stop"
LONGEST_HEADING = 90
LEAST_BULLETS = 3

# Headings of each kind, then patterns of headings (demands are tried before duties), then verbs that open a duty.
HEADINGS = {
    OVERVIEW: [
        "role overview", "an overview of this role", "about the role", "about this role",
        "the role", "the opportunity", "position summary", "job summary", "role summary",
        "overview", "job description", "about the job", "the position", "your mission",
        "why this role", "role purpose", "purpose of the role",
    ],
    DUTIES: [
        "responsibilities", "key responsibilities", "core responsibilities",
        "primary responsibilities", "essential responsibilities", "duties",
        "duties and responsibilities", "essential duties",
        "what you'll do", "what you will do", "what youll do", "what you do",
        "what you'll be doing", "what you will be doing",
        "what you'll own", "what you will own", "what you'll drive",
        "what you'll work on", "what you will work on",
        "in this role you will", "in this role, you will", "in this role",
        "what you will do in this role", "what you'll do in this role",
        "your impact", "the impact you'll have", "how you'll make an impact",
        "how you will make an impact", "what success looks like",
        "your responsibilities", "you will", "you'll", "day to day", "day-to-day",
        "a day in the life", "what the job involves", "scope of the role",
        "what we're looking for you to do",
        "accountabilities", "key accountabilities", "your accountabilities",
    ],
    DEMANDS: [
        "requirements", "qualifications", "basic qualifications",
        "minimum qualifications", "preferred qualifications", "required qualifications",
        "what you have", "what you'll have", "what you'll bring", "what you will bring",
        "what you bring", "who you are", "about you", "what we're looking for",
        "what we are looking for", "skills and experience", "experience",
        "required skills", "preferred skills", "nice to have", "nice-to-have",
        "bonus points", "bonus points if", "to be successful in this role, you will have",
        "to be successful in this role you will have", "you might be a good fit if",
        "we're looking for", "desired qualifications", "your background",
        "skills & experience", "required experience", "preferred experience",
    ],
    STOP: [
        "compensation", "salary", "pay range", "salary range", "compensation range",
        "base pay", "base salary", "pay transparency", "benefits", "perks",
        "perks and benefits", "benefits and perks", "what we offer", "our offer",
        "equal opportunity", "equal employment opportunity", "eeo", "eeoc",
        "accommodations", "accommodation", "export control", "work personas",
        "privacy", "privacy notice", "e-verify", "our mission", "our solution",
        "our culture", "our culture & values", "our values", "about us",
        "about the company", "about the team", "the team", "who we are",
        "how we work", "our stack", "interview process", "hiring process",
        "next steps", "location", "travel", "disclaimer", "note",
    ],
}
HEADING_PATTERNS = [
    (DEMANDS, r"^what\s+you\W?(ll\s+)?(bring|need|have|should\s+have)\b"),
    (DEMANDS, r"^(minimum|preferred|basic|required|desired)\b.*\bqualification"),
    (DEMANDS, r"^you\s+(might|may|could)\s+be\s+a\s+\w+\s+fit\b"),
    (DEMANDS, r"^(skills|experience|background)\s*(and|&|/)?\s*\w*\s*(required|preferred)?:?$"),
    (DUTIES, r"^as\s+(a|an|the)\b.*\byou\W?ll\b"),
    (DUTIES, r"^in\s+this\s+(role|position)\b.*\byou\b"),
    (DUTIES, r"^you\W?ll\s+(be\s+)?(do|own|lead|driv|build|partner|work|help|focus)"),
    (DUTIES, r"^(here\W?s\s+)?what\s+you\W?ll\b"),
    (DUTIES, r"^what\s+you\s+will\b"),
    (STOP, r"^.*\b(salary|pay|compensation)\s+range\b"),
    (STOP, r"^why\s+\w+"),
    (STOP, r"^how\s+\w+\s+(will\s+)?supports?\b"),
    (STOP, r"^life\s+at\s+\w+"),
    (STOP, r"^working\s+at\s+\w+"),
    (STOP, r"^join\s+\w+"),
]
VERBS = (
    "lead", "own", "build", "partner", "drive", "define", "manage", "develop",
    "collaborate", "design", "create", "deliver", "execute", "support", "run",
    "launch", "scale", "establish", "identify", "translate", "implement",
    "coordinate", "analyze", "analyse", "optimize", "optimise", "champion",
    "evangelize", "enable", "measure", "report", "work", "act", "serve",
    "oversee", "guide", "shape", "craft", "maintain", "monitor", "produce",
    "find", "turn", "make", "help", "ship", "grow", "improve", "automate",
)
BULLET = r"(?sU)^[-*•]\s*(.+)$"


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def _keys(phrases: list[str]) -> list[str]:
    return sorted({" ".join(re.sub("[^a-z0-9]+", " ", x).split()) for x in phrases})


def heading_kind(line: Column) -> Column:
    """The kind of section a line opens; null for body text. Only short lines that are not bullets count; unknown headings are body."""
    raw = stripped(line)
    key = normalised(raw)
    kinds = [F.when(key.isin(*_keys(phrases)), kind) for kind, phrases in HEADINGS.items()]
    kinds += [F.when(raw.rlike("(?iU)" + pattern), kind) for kind, pattern in HEADING_PATTERNS]
    return F.when((F.length(raw) <= LONGEST_HEADING) & ~raw.rlike("^[-*•]") & (key != ""), F.coalesce(*kinds))


def _opens_with_verb(x: Column) -> Column:
    return F.btrim(F.lower(F.substring_index(x, " ", 1)), F.lit(",:;")).isin(*VERBS)


def _commands(x: Column) -> Column:
    """Whether a line is a heading in the imperative, of three words or more."""
    return (F.length(x) <= LONGEST_HEADING) & ~x.rlike("^[-*•]") & ~x.rlike("[.,;]$") & _opens_with_verb(x) & x.rlike(r"(?U)\S\s+\S+\s+\S")


def _bullet_block(lines: Column) -> Column:
    """The longest run of bullets from one that opens with a verb, the first of equal ones; empty below LEAST_BULLETS."""
    marked = F.transform(lines, lambda x: F.when(stripped(x).rlike(BULLET), stripped(x)).otherwise(""))

    def run(block: Column) -> Column:
        items = F.filter(F.split(block, "\n"), lambda x: x != "")
        first = F.array_position(F.transform(items, lambda x: _opens_with_verb(stripped(F.regexp_extract(x, BULLET, 1)))), True).cast("int")
        return F.when(first > 0, F.slice(items, F.greatest(first, F.lit(1)), F.greatest(F.size(items), F.lit(0)))).otherwise(F.array().cast("array<string>"))

    runs = F.transform(F.split(F.array_join(marked, "\n"), "\n\n+"), run)
    best = F.aggregate(runs, F.array().cast("array<string>"), lambda a, b: F.when(F.size(b) > F.size(a), b).otherwise(a))
    return F.when(F.size(best) >= LEAST_BULLETS, F.array_join(best, "\n")).otherwise("")


def with_sections(rows: DataFrame, text: str, into: str = "sections") -> DataFrame:
    """Adds a struct (overview, responsibilities, requirements, full, via).

    A section goes from its heading to the next one of another kind; a further heading of
    the same kind is a line of it. Without duties, an overview is cut at its first heading in
    the imperative; without any section the longest run of bullets counts as duties, and
    without that `full` is the whole text. via says how they were found. A null text is empty.
    """
    out = rows.withColumn("__body", F.replace(cleaned(text), F.lit("\r\n"), F.lit("\n")))
    out = out.withColumn("__lines", F.split("__body", "\n"))
    kinds = F.transform("__lines", lambda x, i: F.struct(i.alias("at"), heading_kind(x).alias("kind"), stripped(x).alias("head")))
    out = out.withColumn("__heads", F.filter(kinds, lambda x: x["kind"].isNotNull()))

    def part(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get("__heads", i + 1)["at"], F.size("__lines"))
        body = F.slice("__lines", h["at"] + 2, end - h["at"] - 1)
        again = F.get("__heads", i - 1)["kind"].eqNullSafe(h["kind"])
        return F.struct(h["kind"].alias("kind"), h["head"].alias("head"), F.when(again, F.concat(F.array(h["head"]), body)).otherwise(body).alias("lines"))

    out = out.withColumn("__parts", F.transform("__heads", part))
    of = lambda kind: F.filter("__parts", lambda p: p["kind"] == kind)

    def under(kind: str) -> Column:
        lines = F.flatten(F.transform(of(kind), lambda p: p["lines"]))
        joined = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+(?=[-*•]\s)", "")), "\n")
        return stripped(F.regexp_replace(joined, "\n{3,}", "\n\n"))

    head = lambda kind: F.get(of(kind), F.lit(0))["head"]
    out = out.withColumns({"__overview": under(OVERVIEW), "__duties": under(DUTIES), "__demands": under(DEMANDS), "__block": _bullet_block(F.col("__lines"))})
    overview, duties, demands, block = (F.col(x) for x in ("__overview", "__duties", "__demands", "__block"))
    out = out.withColumn("__command", F.get(F.filter(F.transform(F.split(overview, "\n"), stripped), _commands), F.lit(0)))
    command = F.col("__command")
    cut = F.position(command, overview)
    tail = F.substring(overview, cut + F.length(command), F.length(overview))

    def found(o: Column | str, d: Column | str, r: Column | str, full: Column | str, via: Column) -> Column:
        column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(column(o).alias(OVERVIEW), column(d).alias(DUTIES), column(r).alias(DEMANDS), column(full).alias("full"), via.alias("via"))

    quoted = lambda before, name, after="": F.concat(F.lit(before + '"'), name, F.lit('"' + after))
    result = (
        F.when(F.col("__body") == "", found("", "", "", "", F.lit("no description stored")))
        .when((duties == "") & (stripped(tail) != ""), found(stripped(F.substring(overview, F.lit(1), cut - 1)), stripped(F.concat(command, tail)), demands, "", quoted("unlabelled duties under ", head(OVERVIEW))))
        .when(duties != "", found(overview, duties, demands, "", quoted("heading ", head(DUTIES))))
        .when((overview != "") | (demands != ""), found(overview, duties, demands, "", quoted("no responsibilities heading found - captured ", F.coalesce(head(OVERVIEW), head(DEMANDS)), " instead")))
        .when(block != "", found("", block, "", "", F.lit("unlabelled bullet list (no headings matched)")))
        .otherwise(found("", "", "", F.col("__body"), F.lit("full-text fallback - no headings matched, whole posting saved")))
    )
    return out.withColumn(into, result).select(*rows.columns, into)
