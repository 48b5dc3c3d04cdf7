"""Postings from landed pages of portals and boards whose records are inside markup or scripts.

Pages are columns: records are cut out by patterns that look ahead, so that a page's list is an
array and needs no shuffle. Only a script's JSON object is found by a small Python helper,
which lets the JSON reader say where an object ends; it is then read as VARIANT, since
fields come as one object or as a list of them.

Cases: a null, empty or foreign page has no records. Records repeated on a page count once, at
their first place. A record without a title is left out, and so is a posting without id,
title or body.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from rolesift.functions.text import cleaned, html_text, trimmed, unescaped
from rolesift.sources import feeds

# Addresses, escapes, markers, patterns and widths of the pages.
APPLE_DETAIL = "https://jobs.apple.com/en-us/details/"
GOOGLE_DETAIL = "https://www.google.com/about/careers/applications/jobs/results/"
THREAD_ITEM = "https://news.ycombinator.com/item?id="
APPLE_ESCAPES = (('\\\\"', '"'), ('\\"', '"'), ("\\u0026", "&"), ("\\u002F", "/"), ("\\u003C", "<"), ("\\u003E", ">"), ("\\/", "/"), ("\\n", "\n"), ("\\\\n", "\n"), ("\\t", " "))
APPLE_RECORD = r'(?s)"positionId":"(\d+)"(?=(.{0,4000}))'
APPLE_TITLE = r'(?s)"postingTitle":"((?:[^"\\]|\\.)*)"'
APPLE_POSTED = r'"postDateInGMT":"([^"]+)"'
APPLE_SLUG = r'"transformedPostingTitle":"([^"]*)"'
APPLE_VALUE_END = r'","|"\}|"\]'
GOOGLE_RESULT = r"jobs/results/(\d{6,})-([a-z0-9\-]+)"
GOOGLE_PREFERRED = r"(?s)preferred working location from the following:\s*(.+?)\s*(?:\.|Minimum qualifications)"
GOOGLE_BODY = ("Minimum qualifications:", "Information collected and processed as part of your Google Careers")
LEAST_BODY = 200
LEAST_LEAD = 80


def _first_of_each(records: Column, key: str) -> Column:
    """The records whose key stands at no earlier place."""
    keep = lambda all_: F.filter(all_, lambda x, i: F.array_position(all_.getField(key), x[key]) == i + 1)
    return F.flatten(F.transform(F.array(records), keep))


def _or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def apple_text(markup: Column | str) -> Column:
    """A page whose embedded records are escaped twice, with plain quotes."""
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), APPLE_ESCAPES, _or_empty(markup))


def apple_records(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """`rows` without the page, a row for each record of a results page: place, position_id, posting_title, posted_at, title_slug."""
    page = apple_text(payload)
    found = F.arrays_zip(F.regexp_extract_all(page, F.lit(APPLE_RECORD), F.lit(1)).alias("position_id"), F.regexp_extract_all(page, F.lit(APPLE_RECORD), F.lit(2)).alias("rest"))
    read = lambda x: F.struct(
        x["position_id"].alias("position_id"), F.when(x["rest"].rlike(APPLE_TITLE), F.regexp_extract(x["rest"], APPLE_TITLE, 1)).alias("posting_title"),
        F.regexp_extract(x["rest"], APPLE_POSTED, 1).alias("posted_at"), F.regexp_extract(x["rest"], APPLE_SLUG, 1).alias("title_slug"),
    )
    jobs = _first_of_each(F.filter(F.transform(found, read), lambda x: x["posting_title"].isNotNull()), "position_id")
    others = [c for c in rows.columns if c != payload]
    return rows.select(*others, F.posexplode(jobs).alias("place", "job")).select(*others, "place", "job.*").withColumn("posting_title", unescaped("posting_title"))


def _apple_field(text: Column, key: str) -> Column:
    """A string field of an unescaped record: up to the next border of a field, or 20,000 characters where there is none."""
    marker = f'"{key}":"'
    after = F.substr(text, F.instr(text, marker) + len(marker))
    cut = F.split(after, APPLE_VALUE_END, 2)
    return F.when(F.instr(text, marker) > 0, F.when(F.size(cut) > 1, cut[0]).otherwise(F.left(after, F.lit(20_000)))).otherwise("")


def apple(rows: DataFrame) -> DataFrame:
    """Postings of (company, slug, payload, position_id, posting_title, posted_at): payload is the detail page, whose record begins at its summary; what stands before it may repeat names of fields."""
    rows = rows.withColumn("__page", apple_text("payload"))
    at = F.instr("__page", '"jobSummary":"')
    back = F.regexp_extract(F.substr("__page", F.lit(1), F.greatest(at - 1, F.lit(0))), r'(?s)^.*("postingTitle":".*)$', 1)
    rows = rows.withColumns({"__job": F.when(at > 0, F.substr("__page", at)).otherwise(F.col("__page")), "__before": F.when(back != "", F.substr("__page", at - F.char_length(back))).otherwise(F.col("__page"))})
    job, page = F.col("__job"), F.col("__page")
    given = cleaned("posting_title")
    entries = F.split(F.regexp_extract(job, r'(?s)"locations":\[(.*?)\]', 1), r'\{"id":"')
    site = lambda e: F.concat_ws(", ", F.coalesce(F.nullif(_apple_field(e, "city"), F.lit("")), F.nullif(_apple_field(e, "name"), F.lit(""))), F.nullif(_apple_field(e, "stateProvince"), F.lit("")))
    named = F.filter(F.transform(F.filter(entries, lambda e: (_apple_field(e, "city") != "") | (_apple_field(e, "name") != "")), site), lambda x: x != "")
    place = F.coalesce(F.get(F.filter(named, lambda x: F.contains(x, F.lit("California"))), F.lit(0)), F.get(named, F.lit(0)), F.lit(""))
    footer = F.regexp_extract(page, r'(?s)"postingFooters":\[(.*?)\}\]', 1)
    told = [html_text(unescaped(_apple_field(job, k))) for k in ("jobSummary", "description", "minimumQualifications", "preferredQualifications")]
    rows = rows.withColumns({"__title": F.when(given != "", given).otherwise(cleaned(unescaped(_apple_field(F.col("__before"), "postingTitle")))), "__id": _or_empty(F.col("position_id").cast("string"))})
    rows = rows.where("__id <> '' and __title <> ''")
    link = F.concat(F.lit(APPLE_DETAIL), "__id")
    no = F.lit(None).cast("string")
    made = {
        "source_id": F.col("__id"), "title": F.col("__title"), "url": link, "apply_url": link, "location_raw": unescaped(place), "department": no, "team": no, "employment_type": no, "salary_raw": no,
        "published": F.coalesce(F.nullif(_or_empty("posted_at"), F.lit("")), F.nullif(_apple_field(page, "postDateInGMT"), F.lit(""))), "description": F.array_join(F.filter(F.array(*told, html_text(footer)), lambda x: x != ""), "\n\n"),
    }
    return _at_home(feeds._posting(rows, "apple", made, flag=F.regexp_extract(page, r'"homeOffice":(true|false)', 1) == "true"))


def _at_home(postings: DataFrame) -> DataFrame:
    """Portals of one country say it only by naming a place."""
    return postings.withColumn("country", F.when(F.col("location_raw") != "", "United States"))


def google_records(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """`rows` without the page, a row for each result of a page: place, job_id, title_slug, title."""
    found = F.arrays_zip(*(F.regexp_extract_all(_or_empty(payload), F.lit(GOOGLE_RESULT), F.lit(i)).alias(n) for i, n in ((1, "job_id"), (2, "title_slug"))))
    others = [c for c in rows.columns if c != payload]
    rows = rows.select(*others, F.posexplode(_first_of_each(found, "job_id")).alias("place", "job")).select(*others, "place", "job.*")
    return rows.withColumn("title", trimmed(F.replace("title_slug", F.lit("-"), F.lit(" "))))


def google_text(markup: Column | str) -> Column:
    """The text of a page whose scripts write markup as escapes: these are decoded first, then tags go, then references."""
    escaped = F.regexp_replace(F.replace(_or_empty(markup), F.lit("&"), F.lit("&amp;")), r"\\u([0-9a-fA-F]{4})", "&#x$1;")
    return trimmed(F.regexp_replace(unescaped(F.regexp_replace(unescaped(escaped), "<[^>]+>", " ")), r"(?U)\s+", " "))


def google(rows: DataFrame) -> DataFrame:
    """Postings of (company, slug, payload, job_id, title_slug): payload is the detail page. There is no date."""
    title = cleaned(unescaped(F.regexp_extract("payload", "(?s)<title>(.*?)</title>", 1)))
    rows = rows.withColumns({"__title": trimmed(F.regexp_replace(title, r"(?: — | - |— )Google Careers$", "")), "__text": google_text("payload"), "__id": _or_empty(F.col("job_id").cast("string"))})
    start, end = (F.instr("__text", x) for x in GOOGLE_BODY)
    rows = rows.where((F.col("__id") != "") & (start > 0) & (F.col("__title") != "") & ~F.startswith(F.lower("__title"), F.lit("google careers")))
    head = F.right(F.left("__text", start - 1), F.lit(2500))
    listed = lambda c: F.filter(F.transform(F.split(c, ";"), trimmed), lambda x: x != "")
    preferred = listed(F.regexp_extract(head, GOOGLE_PREFERRED, 1))
    shown = listed(F.get(F.split(F.regexp_extract(head, r"(?s)^.*place (.*)$", 1), r"\bbar_chart\b|\+\d+\s+more"), F.lit(0)))
    options = F.filter(F.when(F.size(preferred) > 0, preferred).otherwise(shown), lambda x: F.char_length(x) < 80)
    place = F.coalesce(F.get(F.filter(options, lambda x: x.rlike(r",\s*CA\b")), F.lit(0)), F.get(options, F.lit(0)), F.lit(""))
    link = F.when(_or_empty("title_slug") != "", F.concat(F.lit(GOOGLE_DETAIL), "__id", F.lit("-"), "title_slug")).otherwise("")
    no = F.lit(None).cast("string")
    made = {
        "source_id": F.col("__id"), "title": F.col("__title"), "url": link, "apply_url": link, "location_raw": place, "department": no, "team": no, "employment_type": no, "salary_raw": no,
        "published": no, "description": trimmed(F.substr("__text", start, F.when(end > start, end - start).otherwise(12_000))),
    }
    return _at_home(feeds._posting(rows, "google", made, flag=F.lit(False)))


def job_object(page: str | None, hops: int = 40) -> str | None:
    """The JSON object of a page that says it is a JobPosting, as text: looked for outwards from its mention, brace by brace, where each time the JSON reader decides whether an object begins and where it ends."""
    if not page:
        return None
    at = page.find('"JobPosting"')
    at = page.find("hiringOrganization") if at < 0 else at
    read = json.JSONDecoder().raw_decode
    for _ in range(hops):
        at = page.rfind("{", 0, max(at, 0))
        if at < 0:
            return None
        try:
            found, end = read(page, at)
        except (ValueError, RecursionError):
            continue
        if isinstance(found, dict) and found.get("@type") == "JobPosting":
            return page[at:end]
    return None


@F.pandas_udf(StringType())
def job_objects(pages: pd.Series) -> pd.Series:
    return pages.map(job_object)


def builtin(rows: DataFrame) -> DataFrame:
    """Postings of (url, lead_title, payload): payload is a page with a schema.org JobPosting in a script."""
    rows = rows.withColumn("__job", F.try_parse_json(job_objects("payload"))).where("__job is not null")
    get = lambda path, kind="string": F.try_variant_get("__job", f"$.{path}", kind)
    # A field of one object or a list of them; an employer may be a bare name.
    company = F.coalesce(get("hiringOrganization.name"), F.when(get("hiringOrganization", "map<string,variant>").isNull(), get("hiringOrganization")))
    places = F.coalesce(get("jobLocation", "array<variant>"), F.array(get("jobLocation", "variant")))
    part = lambda v, name: F.nullif(F.try_variant_get(v, f"$.address.{name}", "string"), F.lit(""))
    cities = F.filter(F.transform(F.filter(places, lambda v: part(v, "addressLocality").isNotNull()), lambda v: F.concat_ws(", ", *(part(v, n) for n in ("addressLocality", "addressRegion", "addressCountry")))), lambda x: x != "")
    low, high = (F.floor(get(f"baseSalary.value.{n}", "double")).cast("int") for n in ("minValue", "maxValue"))
    rows = rows.select(
        "url", trimmed(cleaned(company)).alias("company"), F.lit("builtin").alias("slug"), cleaned(F.coalesce(F.nullif(get("title"), F.lit("")), "lead_title")).alias("__title"), html_text(get("description")).alias("__body"), low.alias("__low"), high.alias("__high"),
        F.coalesce(get("baseSalary.currency"), F.lit("USD")).alias("__currency"), F.array_join(F.array_distinct(cities), " / ").alias("__places"), (F.upper(_or_empty(get("jobLocationType"))) == "TELECOMMUTE").alias("__far"), F.left(_or_empty(get("datePosted")), F.lit(10)).alias("__posted"),
        cleaned(_or_empty(get("employmentType"))).alias("__kind"),
    ).where((F.col("company") != "") & (F.col("__title") != "") & (F.char_length("__body") >= LEAST_BODY))
    told = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, F.col(c).cast("string")).otherwise("")
    salary = F.when((told("__low") != "") | (told("__high") != ""), F.trim(F.concat("__currency", F.lit(" "), told("__low"), F.lit(" - "), told("__high")))).otherwise("")
    no = F.lit(None).cast("string")
    made = {
        "source_id": F.concat(F.lit("builtin:"), F.regexp_extract("url", "([^/]*)$", 1)), "title": F.col("__title"), "url": F.col("url"), "apply_url": F.col("url"), "location_raw": F.when(F.col("__far") & (F.col("__places") == ""), "Remote").otherwise(F.col("__places")),
        "department": no, "team": no, "employment_type": F.col("__kind"), "salary_raw": salary, "published": F.nullif("__posted", F.lit("")), "description": F.col("__body"),
    }
    return feeds._posting(rows, "builtin", made, flag=F.col("__far"), own_pay=(F.col("__low"), F.col("__high")), pay_texts=("salary_raw",))


def thread_leads(rows: DataFrame) -> DataFrame:
    """Leads of landed threads (thread_id, payload): company, title, url, location, board, text of every comment that begins `company | title | ...`."""
    child = F.explode(F.from_json("payload", "struct<children: array<struct<id: long, text: string>>>")["children"]).alias("c")
    plain = trimmed(F.regexp_replace(unescaped(F.regexp_replace(_or_empty("c.text"), "<[^>]+>", " ")), r"(?U)\s+", " "))
    rows = rows.select("thread_id", child).select(F.coalesce("c.id", "thread_id").alias("id"), plain.alias("text"))
    parts = F.transform(F.split(F.left("text", F.lit(400)), r"\|"), trimmed)
    rows = rows.where(F.char_length("text") >= LEAST_LEAD).withColumn("__parts", parts).where("size(__parts) >= 2")
    no_link = lambda c: F.regexp_replace(c, r"https?://\S+", "")
    company = cleaned(F.regexp_replace(F.regexp_replace(no_link(F.col("__parts")[0]), r"[()\[\]]", " "), r"(?U)\s+", " "))
    company = trimmed(F.get(F.split(company, r"\s+[-–—]\s+"), F.lit(0)))
    where = F.get(F.filter(F.slice("__parts", 3, 3), lambda x: x.rlike(r"remote|onsite|on-site|hybrid|[A-Z]{2}\b|,")), F.lit(0))
    rows = rows.withColumns({"company": company, "title": F.left(cleaned(no_link(F.col("__parts")[1])), F.lit(120)), "location": F.left(cleaned(where), F.lit(80))})
    return rows.where("char_length(company) between 2 and 60").select("company", F.when(F.col("title") != "", F.col("title")).otherwise("(see posting)").alias("title"), F.concat(F.lit(THREAD_ITEM), "id").alias("url"), "location", F.lit("hn").alias("board"), "text")
