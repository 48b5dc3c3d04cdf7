"""Fields, blocks and lists of a report as columns: every line is a text or null, and null lines are left out.

The postings of a report are few (each list is cut at its cap), so a list is one text a
bucket; fields and lines alone work on any number of rows. The profile's names (resellers,
platforms, minutes to a city, home) are parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import text, work

NOT_STATED, REMOTE = "Not stated", "Remote"
# What a summary of fit needs.
LEAST_QUOTES, MOST_SENTENCES, LEAST_SUMMARY = 2, 6, 320
QUOTED = r'"[^"]{12,}"|“[^”]{12,}”'
LEAST_STACK, MOST_EARLIER = 3, 3


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _said(c: Column | str) -> Column:
    """Trimmed, and null where nothing is left."""
    return F.nullif(text.trimmed(_col(c)), F.lit(""))


def pay_range(low: Column | str, high: Column | str) -> Column:
    """"$90,000 - $120,000", one amount where both are the same or one is missing, null where both are."""
    a, b = (F.concat(F.lit("$"), F.format_number(_col(c), 0)) for c in (low, high))
    return F.when(_col(low) == _col(high), a).otherwise(F.nullif(F.concat_ws(" - ", a, b), F.lit("")))


def pay_field(low: Column | str, high: Column | str) -> Column:
    return F.coalesce(pay_range(low, high), F.lit("Not listed"))


def posted_field(published: Column | str, as_of: Column) -> Column:
    """The day and, rounded half to even, the days since."""
    day = F.date_format(_col(published), "yyyy-MM-dd")
    days = F.bround(work.age_days(_col(published), as_of), 0).cast("long").cast("string")
    return F.coalesce(F.concat(day, F.lit(" ("), days, F.lit(" days ago)")), F.lit(NOT_STATED))


def is_reseller(slug: Column | str, resellers: list[str]) -> Column:
    """Whether a board belongs to one who lists others' openings; the first segment of its slug tells."""
    known = [r.strip().lower() for r in resellers if r.strip()]
    return F.coalesce(F.split_part(F.lower(F.trim(_col(slug))), F.lit(":"), F.lit(1)).isin(known), F.lit(False))


def company_field(company: Column | str, reseller: Column) -> Column:
    name = F.coalesce(_said(company), F.lit(NOT_STATED))
    return F.when(reseller, F.concat(name, F.lit(" (job board - actual employer not named)"))).otherwise(name)


def minutes_to(city: Column | str, minutes: dict[str, int]) -> Column:
    """Minutes to a city of the profile's table, whatever its case; null for others."""
    if not minutes:
        return F.lit(None).cast("int")
    known = F.create_map(*(F.lit(x) for c, m in sorted(minutes.items()) for x in (c.strip().lower(), m)))
    return known[F.lower(F.trim(_col(city)))]


def commute(city: Column | str, model: Column | str, minutes: dict[str, int], bands: list[tuple[float, float]], *, past: float = 1.0, remote: float = 5.0, unknown: float = 3.0) -> Column:
    """A struct of minutes, score and known: remote work has no way, and a city not in the table has a middling score."""
    away, way = F.coalesce(_col(model) == REMOTE, F.lit(False)), minutes_to(city, minutes)
    score = F.when(away, F.lit(remote)).when(way.isNull(), F.lit(unknown)).otherwise(work.banded(way, bands, past))
    return F.struct(F.when(away, F.lit(0)).otherwise(way).alias("minutes"), score.alias("score"), (away | way.isNotNull()).alias("known"))


def too_far(city: Column | str, model: Column | str, minutes: dict[str, int], most: int) -> Column:
    """Whether the way alone rules a posting out; never for remote work and unknown cities."""
    return F.coalesce((_col(model) != REMOTE) | _col(model).isNull(), F.lit(True)) & F.coalesce(minutes_to(city, minutes) > most, F.lit(False))


def commute_line(city: Column | str, place: Column | str, model: Column | str, minutes: dict[str, int], home: str) -> Column:
    way = minutes_to(city, minutes).cast("string")
    where = F.coalesce(_said(city), _said(place), F.lit("this location"))
    line = F.when(way.isNull(), F.concat(F.lit("Estimated Commute: unknown for "), where)).otherwise(F.concat(F.lit("Estimated Commute: "), way, F.lit(f" min door-to-door from {home}")))
    return F.when(F.coalesce(_col(model) == REMOTE, F.lit(False)), F.lit(None)).otherwise(line)


def connection_line(bonus: Column | str, company: Column | str) -> Column:
    line = F.concat(F.lit("Connection: you know someone at "), _col(company), F.format_string(" - score includes a +%.1f bump for the warm intro", _col(bonus).cast("double")))
    return F.when(_col(bonus) != 0, line)


def nudge_line(adjustment: Column | str, note: Column | str) -> Column:
    line = F.format_string("Tiebreak: this was a close call and I moved it %+.2f after reading the full posting", _col(adjustment).cast("double"))
    return F.when(_col(adjustment) != 0, F.concat_ws(" - ", line, _said(note)))


def stack_line(body: Column | str, reseller: Column, platforms: list[str]) -> Column:
    """Platforms that a reseller's posting names, at least three different ones, as first spelled."""
    if not platforms:
        return F.lit(None).cast("string")
    pattern = r"(?iU)\b(" + "|".join(re.escape(p) for p in platforms) + r")\b"
    spelled = F.array_distinct(F.regexp_extract_all(_col(body), F.lit(pattern), F.lit(1)))
    folded = F.transform(spelled, F.lower)
    first = F.filter(spelled, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)
    names = F.transform(F.array_sort(F.transform(first, lambda x: F.struct(F.lower(x).alias("l"), x.alias("x")))), lambda s: s["x"])
    line = F.concat(F.lit("Stack named in the posting: "), F.array_join(names, ", "), F.lit(" - use this to work out who is actually hiring"))
    return F.when(reseller & (F.size(names) >= LEAST_STACK), line)


def flag_line(verdict: Column | str, flags: Column | str) -> Column:
    told = F.coalesce(F.nullif(F.array_join(_col(flags), "; "), F.lit("")), F.lit("see run report"))
    return F.when(_col(verdict) == "FLAG", F.concat(F.lit("⚠ Legitimacy flag: "), told))


def _listed(roles: Column) -> Column:
    return F.array_join(roles, "; ")


def _quoted(title: Column) -> Column:
    return F.concat(F.lit('"'), title, F.lit('"'))


def siblings_line(rows: DataFrame, *, key: str = "posting_id", company: str = "company", title: str = "title", place: str = "place", into: str = "also_hiring") -> DataFrame:
    """The rows of one report with a line of the company's other roles in it, in the report's order."""
    named = rows.withColumn("__company", text.company_key(company))
    roles = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(key).alias("k"), F.coalesce(title, F.lit("")).alias("t"))))
    others = F.filter("__roles", lambda r: r["k"] != F.col(key))
    line = F.concat(F.lit("Also in this report from "), F.col(company), F.lit(": "), _listed(F.transform(others, lambda r: _quoted(r["t"]))), F.lit(" - read "), F.when(F.size(others) == 1, "both").otherwise("all"), F.lit(" before applying"))
    return named.join(named.groupBy("__company").agg(roles.alias("__roles")), "__company", "left").withColumn(into, F.when(F.size(others) > 0, line)).drop("__company", "__roles")


def applied_line(rows: DataFrame, applications: DataFrame, *, company: str = "company", title: str = "title", into: str = "already_applied") -> DataFrame:
    """Rows with a line of earlier applications at the same company, not for the same title. applications: company_key, applications as of store.prior_applications."""
    others = F.filter("applications", lambda a: a["title"] != F.col(title))
    first = F.transform(F.slice(others, 1, MOST_EARLIER), lambda a: F.concat(_quoted(a["title"]), F.lit(" on "), a["day"]))
    more = F.when(F.size(others) > MOST_EARLIER, F.concat(F.lit(" (+"), (F.size(others) - MOST_EARLIER).cast("string"), F.lit(" more)"))).otherwise("")
    line = F.concat(F.lit("Already applied at "), F.col(company), F.lit(": "), _listed(first), more)
    keyed = rows.withColumn("__company", text.company_key(company))
    known = applications.select(F.col("company_key").alias("__company"), "applications")
    return keyed.join(known, "__company", "left").withColumn(into, F.when(F.size(others) > 0, line)).drop("__company", "applications")


def summary_problems(summary: Column | str) -> Column:
    """What is wrong with a summary of fit; an empty array if nothing is."""
    body = text.trimmed(F.coalesce(_col(summary), F.lit("")))
    paragraphs = F.size(F.filter(F.split(body, r"\n(?U)\s*\n"), lambda x: text.trimmed(x) != ""))
    quotes = F.size(F.regexp_extract_all(body, F.lit(QUOTED), F.lit(0)))
    sentences = F.size(F.regexp_extract_all(body, F.lit(r"[.!?](?U:\s|\z)"), F.lit(0)))
    told = lambda n, what: F.concat(n.cast("string"), F.lit(what))
    problems = F.array_compact(
        F.array(
            F.when(paragraphs != 2, told(paragraphs, " paragraph(s), needs exactly 2")),
            F.when(quotes < LEAST_QUOTES, told(quotes, f" verbatim quote(s), needs at least {LEAST_QUOTES}")),
            F.when(sentences > MOST_SENTENCES, told(sentences, f" sentences, cap is {MOST_SENTENCES}")),
            F.when(F.char_length(body) < LEAST_SUMMARY, told(F.char_length(body), " characters, too thin")),
        )
    )
    return F.when(body == "", F.array(F.lit("no fit summary written"))).otherwise(problems)


def block(lines: list[Column]) -> Column:
    """The lines of a posting that are there."""
    return F.concat_ws("\n", *lines)


def labelled(label: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{label}: "), F.coalesce(_col(value), F.lit("")))


def worth_knowing_line(score: Column | str, title: Column | str, company: Column | str, reseller: Column, model: Column | str, way: Column, published: Column | str, url: Column | str, summary: Column | str) -> Column:
    """One entry under the bar: score, role, work model with the way, day, address, and the summary's first sentence."""
    known = F.concat(F.lit(" "), way["minutes"].cast("string"), F.lit(" min"))
    where = F.concat(F.coalesce(_col(model), F.lit("?")), F.when(F.coalesce(_col(model) == REMOTE, F.lit(False)), "").when(way["known"], known).otherwise(" commute unknown"))
    who = F.concat(F.coalesce(_col(company), F.lit("")), F.when(reseller, " (job board, employer not named)").otherwise(""))
    day = F.coalesce(F.date_format(_col(published), "yyyy-MM-dd"), F.lit(""))
    head = F.concat(F.format_string("  - %.2f  ", _col(score).cast("double")), _col(title), F.lit(" @ "), who, F.lit("  ["), where, F.lit(", posted "), day, F.lit("]"))
    first = F.concat(F.lit("      "), F.regexp_replace(F.split_part(_said(summary), F.lit(". "), F.lit(1)), r"\.+\z", ""), F.lit("."))
    return F.concat_ws("\n", head, F.concat(F.lit("      "), _col(url)), first)


def near_miss_line(company: Column | str, n: Column | str, best: Column | str, title: Column | str) -> Column:
    return F.concat(F.lit("  - "), _col(company), F.lit(" - "), _col(n).cast("string"), F.lit(" role(s) evaluated, best was "), F.format_string("%.1f", _col(best).cast("double")), F.lit(" ("), _col(title), F.lit(")"))


def lists(rows: DataFrame, buckets: DataFrame, *, bucket: str = "bucket", place: str = "place", told: str = "block") -> DataFrame:
    """(bucket, report): a titled list a bucket, its blocks in order; one that has none says so. rows are cut at the list's cap before. buckets: bucket, label, blurb, bar."""
    title = F.concat("label", F.format_string("  (bar %.2f)", F.col("bar").cast("double")))
    rule = F.repeat(F.lit("="), F.greatest(F.char_length(title), F.lit(44)))
    joined = rows.groupBy(bucket).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(told).alias("b")))).alias("__blocks"))
    body = F.array_join(F.transform("__blocks", lambda x: x["b"]), "\n\n---\n\n")
    none = F.format_string("Nothing scored %.2f or higher this run.", F.col("bar").cast("double"))
    head = F.concat_ws("\n", rule, title, rule, F.lit(""), _said("blurb"), F.when(_said("blurb").isNotNull(), ""))
    return buckets.join(joined, bucket, "left").select(bucket, F.concat(head, F.lit("\n"), F.coalesce(body, none)).alias("report"))
