"""The worksheet of a run: what an evaluator needs to score each posting, as one text a posting and one record of answers to fill in.

Blocks are rows: a worksheet of any length is a table sorted by its place, never one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.functions import pay, text, work
from rolesift.operators import report

# The longest text of a posting that is shown whole, and how much of its end stays when the middle is left out.
LONGEST, END = 24_000, 6_000


def shortened(body: Column | str, longest: int = LONGEST, end: int = END) -> Column:
    """The trimmed text, without its middle beyond `longest` characters: duties open a posting and pay closes it. Empty for a null."""
    whole = text.trimmed(F.coalesce(F.col(body) if isinstance(body, str) else body, F.lit("")))
    n = F.char_length(whole)
    note = F.concat(F.lit("\n\n[..."), F.format_number(n - longest, 0), F.lit(" characters omitted from the middle...]\n\n"))
    return F.when(n <= longest, whole).otherwise(F.concat(F.left(whole, F.lit(longest - end)), note, F.right(whole, F.lit(end))))


def modelled_pay(low: Column | str, high: Column | str, equity: Column | str, *, bonus: float = 0.10, grant: int = 35_000) -> Column:
    """struct(base, bonus, equity, total): the top of the stated band, its bonus, and a grant where equity is named; null fields without a band."""
    low, high, equity = (F.col(c) if isinstance(c, str) else c for c in (low, high, equity))
    base = F.coalesce(high, low)
    total = pay.total_pay(low, high, F.coalesce(equity, F.lit(False)), bonus=bonus, grant=grant)
    granted = F.when(base.isNotNull(), F.when(equity, grant).otherwise(0))
    return F.struct(base.alias("base"), F.bround(base * bonus).cast("int").alias("bonus"), granted.alias("equity"), total.alias("total"))


def pay_line(low: Column | str, high: Column | str, equity: Column | str, **model: float) -> Column:
    """The stated band, and what it comes to."""
    x = modelled_pay(low, high, equity, **model)
    dollars = lambda f: F.concat(F.lit("$"), F.format_number(x[f], 0))
    made = F.concat(F.lit("  ->  modeled: base "), dollars("base"), F.lit(" + bonus "), dollars("bonus"), F.lit(" + equity "), dollars("equity"), F.lit(" = TC "), dollars("total"))
    return F.concat(F.coalesce(report.pay_range(low, high), F.lit("not listed")), F.when(x["total"] != 0, made).otherwise(""))


def _or(c: str, missing: str) -> Column:
    return F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(missing))


def with_block(rows: DataFrame, as_of: Column, minutes: dict[str, int], bands: list[tuple[float, float]], home: str, into: str = "block") -> DataFrame:
    """Adds the block of each posting, without its number, which is the place in the worksheet.

    rows: posting_id, title, company, url, apply_url, location_raw, city, work_model,
    salary_min, salary_max, equity, bonus, published, date_confidence, department, team, ats,
    source_slug, source_id, description, and ids, dates, perpetual of its repeated sightings.
    """
    way = report.commute("city", "work_model", minutes, bands)
    city = F.coalesce(F.concat(F.lit("'"), F.col("city"), F.lit("'")), F.lit("None"))
    note = F.when(way["minutes"].isNull(), F.concat(F.lit("Commute time unknown for "), city, F.lit(". Add it to the profile to score this location properly."))).when(F.col("work_model") == report.REMOTE, "Fully remote - no commute.").otherwise(F.concat(way["minutes"].cast("string"), F.lit(f" min door-to-door from {home}.")))
    age = F.bround(work.age_days(F.col("published"), as_of), 0).cast("long").cast("string")
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    flag = lambda c, said: F.when(c, f"  **[{said}]**").otherwise("")
    lines = [
        F.concat(_or("title", ""), F.lit(" - "), _or("company", "")),
        F.lit(""),
        F.concat(F.lit("- **posting_id**: `"), F.col("posting_id").cast("string"), F.lit("`")),
        F.concat(F.lit("- **URL**: "), _or("url", "")),
        F.concat(F.lit("- **Apply URL**: "), _or("apply_url", "(same)")),
        F.concat(F.lit("- **Location**: "), _or("location_raw", "unstated"), F.lit("  |  city: "), _or("city", "unknown"), F.lit("  |  work model: **"), _or("work_model", "unknown"), F.lit("**")),
        F.concat(F.lit("- **Commute**: "), note, F.lit("  (dimension 5 raw score "), F.format_string("%.1f", way["score"]), F.lit(")"), flag(~way["known"], "UNKNOWN CITY - resolve before scoring")),
        F.concat(F.lit("- **Salary**: "), pay_line("salary_min", "salary_max", "equity")),
        F.concat(F.lit("- **Equity mentioned**: "), yes("equity"), F.lit("  |  **Bonus mentioned**: "), yes("bonus")),
        F.concat(F.lit("- **Published**: "), F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit("unknown")), F.lit("  ("), F.coalesce(F.concat(age, F.lit(" days ago")), F.lit("age unknown")), F.lit(")  |  date confidence: "), _or("date_confidence", "unknown")),
        F.concat(F.lit("- **Department / team**: "), _or("department", "-"), F.lit(" / "), _or("team", "-")),
        F.concat(F.lit("- **Source**: "), _or("ats", ""), F.lit("/"), _or("source_slug", ""), F.lit("  id="), _or("source_id", "")),
        F.concat(F.lit("- **Repost history**: "), F.coalesce("ids", F.lit(0)).cast("string"), F.lit(" distinct ATS id(s), "), F.coalesce("dates", F.lit(0)).cast("string"), F.lit(" distinct publish date(s)"), flag(F.coalesce("perpetual", F.lit(False)), "PERPETUAL REPOST SIGNAL")),
        F.lit("\n<details><summary>Full description</summary>\n\n```text"),
        shortened("description"),
        F.lit("```\n\n</details>\n"),
    ]
    return rows.withColumn(into, report.block(lines))


def answers(rows: DataFrame, rubrics: dict[str, str], bucket: str = "bucket") -> DataFrame:
    """(posting_id, answer): the record to fill in for each posting, as JSON. Each is judged by the rubric of its own bucket; an unknown bucket's is null."""
    known = F.create_map(*(F.lit(x) for pair in sorted(rubrics.items()) for x in pair)) if rubrics else F.create_map().cast("map<string,string>")
    fields = F.struct(
        "posting_id", "company", "title", known[F.col(bucket)].alias("track"), F.col(bucket).alias("bucket"),
        F.create_map().cast("map<string,double>").alias("dimension_scores"), F.create_map().cast("map<string,string>").alias("block_notes"),
        F.lit("PASS").alias("block_g_verdict"), F.array().cast("array<string>").alias("block_g_flags"), F.lit("").alias("fit_summary"),
    )
    return rows.select("posting_id", F.to_json(fields, {"ignoreNullFields": "false"}).alias("answer"))
