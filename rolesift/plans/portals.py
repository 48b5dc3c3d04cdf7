"""Queries over pages with planted portal records, and over texts with planted pay and work models.

The tables hold neither, so that records are put around the pages by page_id; the SQL builds
what has to come out from the same numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rolesift.functions import location, pay, work
from rolesift.plans.catalogue import query
from rolesift.session import table
from rolesift.sources import portals

# Two records a page, the first one twice, and one without a title.
_RECORD = r"""'\\"positionId\\":\\"' || {id} || '\\",\\"x\\":1,\\"postingTitle\\":\\"Lead ' || {id} || ' & more\\",\\"postDateInGMT\\":\\"2026-08-05\\",\\"transformedPostingTitle\\":\\"lead-' || {id} || '\\",'"""
_UNTITLED = r"""'\\"positionId\\":\\"99\\",\\"x\\":1' || repeat('-', 4100)"""


def _spark(sql: str) -> str:
    return sql.replace("\\", "\\\\")


@query("portal_records", "SELECT page_id, place, CAST(id AS VARCHAR) AS position_id, 'Lead ' || id || ' & more' AS title, 'lead-' || id AS slug FROM (SELECT page_id, 0 AS place, page_id * 10 + 1000 AS id FROM pages UNION ALL SELECT page_id, 1, page_id * 10 + 1001 FROM pages)")
def portal_records(spark, d):
    """Records of a results page, escaped twice inside its markup: in page order, the repeated one once, the untitled one not."""
    first, second = (_RECORD.format(id=f"CAST(page_id * 10 + {n} AS STRING)") for n in (1000, 1001))
    pages = table(spark, d, "pages").select("page_id", F.expr(_spark(f"coalesce(html, '') || {_UNTITLED} || {first} || {second} || {first}")).alias("payload"))
    return portals.apple_records(pages).select("page_id", "place", "position_id", F.col("posting_title").alias("title"), F.col("title_slug").alias("slug"))


@query("portal_results", "SELECT page_id, place, CAST(1000000 + page_id * 10 + n AS VARCHAR) AS job_id, CASE n WHEN 0 THEN 'program manager' ELSE 'lead ai tools' END AS title FROM (SELECT page_id, 0 AS place, 0 AS n FROM pages UNION ALL SELECT page_id, 1, 1 FROM pages)")
def portal_results(spark, d):
    """Results of a page by their links, each once."""
    link = "'<a href=\"./jobs/results/' || CAST(1000000 + page_id * 10 + {n} AS STRING) || '-{slug}?q=x\">'"
    first, second = link.format(n=0, slug="program-manager"), link.format(n=1, slug="lead-ai-tools")
    pages = table(spark, d, "pages").select("page_id", F.expr(f"{first} || coalesce(html, '') || {second} || {first}").alias("payload"))
    return portals.google_records(pages).select("page_id", "place", "job_id", "title")


_CITY = "CASE page_id % 3 WHEN 0 THEN 'Boston' WHEN 1 THEN 'Austin' ELSE '' END"
_PLACES = """CASE page_id % 3 WHEN 2 THEN '{"address":{"addressCountry":"USA"}}' WHEN 1 THEN '[{"address":{"addressLocality":"Austin","addressRegion":"Texas"}},{"address":{"addressLocality":"Boston","addressRegion":"Massachusetts"}}]'
 ELSE '{"address":{"addressLocality":"Boston","addressRegion":"Massachusetts"}}' END"""


@query("board_postings", """SELECT page_id, 'Acme ' || page_id AS company, 'Lead {x}' AS title, CASE page_id % 3 WHEN 0 THEN 'Boston, Massachusetts' WHEN 1 THEN 'Austin, Texas / Boston, Massachusetts' ELSE 'Remote' END AS location_raw,
 CASE page_id % 3 WHEN 0 THEN 'Boston' WHEN 1 THEN 'Austin' END AS city, CAST(100000 + page_id AS INT) AS salary_min, CAST(150000 + page_id AS INT) AS salary_max, CASE page_id % 3 WHEN 2 THEN 'Remote' ELSE 'On-site' END AS work_model FROM pages""")
def board_postings(spark, d):
    """The JobPosting in a page's script, among siblings and braces in strings; places are one object or a list."""
    job = f"""'window.j = {{"@type":"Other"}}; x = {{"@type":"JobPosting","title":"Lead {{x}}","hiringOrganization":{{"@type":"Organization","name":"Acme ' || page_id || '"}},"jobLocationType":"' || CASE page_id % 3 WHEN 2 THEN 'TELECOMMUTE' ELSE '' END
 || '","jobLocation":' || {_PLACES} || ',"baseSalary":{{"currency":"USD","value":{{"minValue":' || (100000 + page_id) || ',"maxValue":' || (150000 + page_id) || '}}}},"description":"<p>' || repeat('plain words ', 40) || '</p>"}};'"""
    pages = table(spark, d, "pages").select(F.concat(F.lit("https://b.example/job/"), "page_id").alias("url"), F.lit("lead").alias("lead_title"), F.concat(F.coalesce("html", F.lit("")), F.expr(job)).alias("payload"))
    found = portals.builtin(pages)
    return found.select(F.regexp_extract("source_id", r"(\d+)$", 1).cast("long").alias("page_id"), "company", "title", "location_raw", "city", "salary_min", "salary_max", "work_model")


_LOW, _HIGH = "(60000 + doc_id % 90 * 1000)", "(60000 + doc_id % 90 * 1000 + 15000)"
_PAY = f"""CASE doc_id % 8 WHEN 0 THEN '$' || {_LOW} || ' - $' || {_HIGH} WHEN 1 THEN '$' || ({_LOW} / 1000) || 'K to $' || ({_HIGH} / 1000) || 'k' WHEN 2 THEN {_LOW} || ' USD - ' || {_HIGH} || ' USD' WHEN 3 THEN 'The pay range is ' || {_LOW} || ' - ' || {_HIGH} || ' USD'
 WHEN 4 THEN 'The base salary is $' || {_LOW} WHEN 5 THEN 'Tier 3: $50,000 - $60,000. Tier 1: $' || {_LOW} || ' - $' || {_HIGH} || '. Elsewhere $90,000 - $400,000.' WHEN 6 THEN '$' || (30 + doc_id % 50) || ' - $' || (40 + doc_id % 50) || ' per hour' ELSE 'We raised $' || {_LOW} || ' once' END"""
_PAID = "CASE doc_id % 8 WHEN 4 THEN ' plus RSUs' WHEN 5 THEN ' and commission' WHEN 6 THEN ' with a 15% target bonus' ELSE '' END"
_SPARK_PAY = _PAY.replace("/ 1000)", "DIV 1000)")


@query("pay_stated", f"""SELECT doc_id, CAST(CASE WHEN doc_id % 8 = 6 THEN (30 + doc_id % 50) * 2080 WHEN doc_id % 8 < 6 THEN {_LOW} END AS INT) AS low, CAST(CASE WHEN doc_id % 8 = 6 THEN (40 + doc_id % 50) * 2080 WHEN doc_id % 8 = 4 THEN {_LOW} WHEN doc_id % 8 < 6 THEN {_HIGH} END AS INT) AS high,
 doc_id % 8 = 4 AS equity, doc_id % 8 IN (5, 6) AS bonus, CASE WHEN doc_id % 8 = 6 THEN 0.15::DOUBLE END AS rate FROM documents""")
def pay_stated(spark, d):
    """Pay in every way of writing it, put behind the text; the texts themselves name none."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(f"coalesce(text, '') || repeat(' .', 100) || {_SPARK_PAY} || {_PAID}").alias("body"))
    return rows.withColumn("r", pay.pay_range("body")).select("doc_id", "r.low", "r.high", pay.names_equity("body").alias("equity"), pay.names_bonus("body").alias("bonus"), pay.stated_bonus("body").alias("rate"))


_MODELS = (("Hybrid role", "", "", "Hybrid"), ("", "", " #LI-Remote", "Remote"), ("", "Remote - US", "", "Remote"), ("", "United States", "", "Remote"), ("", "Austin, TX", " in a hybrid environment", "Hybrid"), ("", "Austin, TX", " three days per week", "Hybrid"), ("Office", "Remote", "", "On-site"), ("", "Austin, TX", "", "On-site"))


@query("work_model_stated", "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN '{m[3]}'" for i, m in enumerate(_MODELS)) + " END AS work_model, CASE WHEN doc_id % 8 IN (4, 5, 7) THEN 'Austin' END AS city, CASE WHEN doc_id % 8 IN (4, 5, 7) THEN 'TX' END AS region, CASE WHEN doc_id % 8 IN (2, 3, 4, 5, 7) THEN 'United States' END AS country FROM documents")
def work_model_stated(spark, d):
    """Work model and place, told by a stated kind, a location or a phrase behind the text."""
    pick = lambda i: F.element_at(F.array(*(F.lit(m[i]) for m in _MODELS)), (F.col("doc_id") % 8 + 1).cast("int"))
    rows = table(spark, d, "documents").select("doc_id", pick(0).alias("stated"), pick(1).alias("place_raw"), F.concat(F.coalesce("text", F.lit("")), F.lit("."), pick(2)).alias("body"))
    model = work.work_model(F.nullif("stated", F.lit("")), F.lit(False), F.col("place_raw"), F.col("body"))
    return location.with_place(rows.withColumn("work_model", model), "place_raw").select("doc_id", "work_model", "place.*")
