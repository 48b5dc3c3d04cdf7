"""Registered queries of report fields and lists, boards of names, snapshots and refreshed texts. Orders stand for postings with the customer as company and the nation as city; 25 cities have minutes but for five."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.functions import links, text
from rolesift.operators import report, store
from rolesift.plans.catalogue import query
from rolesift.session import table

MINUTES = {f"NATION_{n}": 5 * n + 10 for n in range(20)}
WAY_BANDS = [(20.0, 5.0), (40.0, 4.0), (60.0, 2.5)]
MOST_MINUTES = 60
RESELLERS = ["Machinery"]
HOME = "the centre"
TODAY = "2001-08-02"
BAR, CAP = 4.0, 12
BUCKETS = [("F", "LIST 1 - CLOSED", "Those that are done.", 4.0), ("O", "LIST 2 - OPEN", "", 3.75), ("P", "LIST 3 - PARTS", "", 4.25), ("X", "LIST 4 - OTHERS", "", 4.5)]

# The columns of a posting of the report, the same in both dialects.
_FIELDS = {
    "posting_id": "o_orderkey",
    "company": "c_name",
    "title": "o_orderpriority",
    "bucket": "o_orderstatus",
    "source_slug": "c_mktsegment || ':t:b'",
    "city": "CASE WHEN c_nationkey <> 3 THEN n_name END",
    "location_raw": "CASE WHEN o_orderkey % 2 = 0 THEN 'Region ' || CAST(n_regionkey AS VARCHAR(9)) END",
    "salary_min": "CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(o_totalprice / 4) AS BIGINT) END",
    "salary_max": "CASE o_orderkey % 3 WHEN 0 THEN CAST(floor(o_totalprice / 4) AS BIGINT) WHEN 1 THEN CAST(floor(o_totalprice / 3) AS BIGINT) END",
    "work_model": "CASE o_orderkey % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' WHEN 2 THEN 'On-site' END",
    "published": "CASE WHEN o_orderkey % 11 > 0 THEN o_orderdate END",
    "bonus": "CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END",
    "adjustment": "CASE o_orderkey % 13 WHEN 0 THEN 10 WHEN 1 THEN -15 ELSE 0 END / 100.0",
    "note": "CASE o_orderkey % 3 WHEN 0 THEN ' fits ' WHEN 1 THEN ' ' END",
    "score": "round(o_totalprice / 100000, 2)",
}
_ROWS = "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _FIELDS.items()) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_WAY = "CASE WHEN starts_with(city, 'NATION_') AND CAST(substr(city, 8) AS INT) < 20 THEN 5 * CAST(substr(city, 8) AS INT) + 10 END"
_RESELLER = "lower(string_split(source_slug, ':')[1]) = 'machinery'"
_USD = "'$' || format('{{:,}}', {0})"
_LINES = {
    "company_field": f"company || CASE WHEN {_RESELLER} THEN ' (job board - actual employer not named)' ELSE '' END",
    "pay_field": f"CASE WHEN salary_min = salary_max OR salary_max IS NULL AND salary_min IS NOT NULL THEN {_USD.format('salary_min')} WHEN salary_min IS NULL AND salary_max IS NOT NULL THEN {_USD.format('salary_max')} WHEN salary_min IS NULL THEN 'Not listed' ELSE {_USD.format('salary_min')} || ' - ' || {_USD.format('salary_max')} END",
    "posted_field": f"CASE WHEN published IS NULL THEN 'Not stated' ELSE strftime(published, '%Y-%m-%d') || ' (' || date_diff('day', published, TIMESTAMP '{TODAY}') || ' days ago)' END",
    "commute_line": f"CASE WHEN work_model = 'Remote' THEN NULL WHEN {_WAY} IS NOT NULL THEN 'Estimated Commute: ' || {_WAY} || ' min door-to-door from {HOME}' ELSE 'Estimated Commute: unknown for ' || coalesce(city, location_raw, 'this location') END",
    "connection_line": "CASE WHEN bonus > 0 THEN 'Connection: you know someone at ' || company || ' - score includes a +1.0 bump for the warm intro' END",
    "nudge_line": "CASE WHEN adjustment <> 0 THEN 'Tiebreak: this was a close call and I moved it ' || CASE WHEN adjustment > 0 THEN '+0.10' ELSE '-0.15' END || ' after reading the full posting' || CASE WHEN note = ' fits ' THEN ' - fits' ELSE '' END END",
}


def postings(spark: SparkSession, d: str) -> DataFrame:
    orders, customers, nations = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(*(F.expr(sql).alias(name) for name, sql in _FIELDS.items()))


def _lines() -> dict:
    reseller = report.is_reseller("source_slug", RESELLERS)
    return {
        "company_field": report.company_field("company", reseller),
        "pay_field": report.pay_field("salary_min", "salary_max"),
        "posted_field": report.posted_field("published", F.lit(TODAY)),
        "commute_line": report.commute_line("city", "location_raw", "work_model", MINUTES, HOME),
        "connection_line": report.connection_line("bonus", "company"),
        "nudge_line": report.nudge_line("adjustment", "note"),
    }


@query("report_fields", f"SELECT posting_id, {', '.join(f'{sql} AS {name}' for name, sql in _LINES.items())} FROM ({_ROWS})")
def report_fields(spark, d):
    return postings(spark, d).select("posting_id", *(c.alias(name) for name, c in _lines().items()))


@query("commute_estimates", f"SELECT posting_id, CASE WHEN work_model = 'Remote' THEN 0 ELSE way END AS minutes, CASE WHEN work_model = 'Remote' THEN 5.0 WHEN way IS NULL THEN 3.0 WHEN way <= 20 THEN 5.0 WHEN way <= 40 THEN 4.0 WHEN way <= 60 THEN 2.5 ELSE 1.0 END::DOUBLE AS score, coalesce(work_model, '') = 'Remote' OR way IS NOT NULL AS known, coalesce(work_model, '') <> 'Remote' AND coalesce(way, 0) > 60 AS too_far FROM (SELECT *, {_WAY} AS way FROM ({_ROWS}))")
def commute_estimates(spark, d):
    way = report.commute("city", "work_model", MINUTES, WAY_BANDS)
    return postings(spark, d).select("posting_id", way.alias("way"), report.too_far("city", "work_model", MINUTES, MOST_MINUTES).alias("too_far")).select("posting_id", "way.*", "too_far")


def shown(spark: SparkSession, d: str) -> DataFrame:
    """The best of each bucket at or above its bar, cut at the cap, with their place."""
    bars = spark.createDataFrame([(b, bar) for b, _, _, bar in BUCKETS], "bucket string, bar double")
    order = Window.partitionBy("bucket").orderBy(F.desc("score"), "posting_id")
    return postings(spark, d).join(F.broadcast(bars), "bucket").where(F.col("score") >= F.col("bar")).withColumn("place", F.row_number().over(order)).where(F.col("place") <= CAP).drop("bar")


_BARS = "(VALUES " + ", ".join(f"('{b}', '{label}', '{blurb}', {bar})" for b, label, blurb, bar in BUCKETS) + ") AS buckets(bucket, label, blurb, bar)"
_SHOWN = f"SELECT r.*, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, posting_id) AS place FROM ({_ROWS}) r JOIN {_BARS} USING (bucket) WHERE score >= bar QUALIFY place <= {CAP}"
_BLOCK = f"""concat_ws(chr(10), 'Company: ' || {_LINES['company_field']}, 'Job Title: ' || title, 'City: ' || coalesce(city, location_raw, 'Not stated'), 'Salary Range: ' || {_LINES['pay_field']}, 'Work Model: ' || coalesce(work_model, 'Not stated'), {_LINES['commute_line']}, 'Posted: ' || {_LINES['posted_field']}, {_LINES['connection_line']}, {_LINES['nudge_line']})"""


def _block() -> Column:
    x = _lines()
    return report.block([
        report.labelled("Company", x["company_field"]),
        report.labelled("Job Title", "title"),
        report.labelled("City", F.coalesce("city", "location_raw", F.lit(report.NOT_STATED))),
        report.labelled("Salary Range", x["pay_field"]),
        report.labelled("Work Model", F.coalesce("work_model", F.lit(report.NOT_STATED))),
        x["commute_line"],
        report.labelled("Posted", x["posted_field"]),
        x["connection_line"],
        x["nudge_line"],
    ])


@query("report_lists", f"""SELECT bucket, concat_ws(chr(10), rule, head, rule, '', CASE WHEN blurb <> '' THEN blurb || chr(10) END) || coalesce(chr(10) || body, chr(10) || 'Nothing scored ' || printf('%.2f', bar::DOUBLE) || ' or higher this run.') AS report FROM
 (SELECT *, label || '  (bar ' || printf('%.2f', bar::DOUBLE) || ')' AS head, repeat('=', greatest(length(label || '  (bar 0.00)'), 44)) AS rule FROM {_BARS}) LEFT JOIN
 (SELECT bucket, string_agg({_BLOCK}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS body FROM ({_SHOWN}) GROUP BY 1) USING (bucket)""")
def report_lists(spark, d):
    """A text a bucket; the fourth bucket is empty."""
    buckets = spark.createDataFrame(BUCKETS, "bucket string, label string, blurb string, bar double")
    return report.lists(shown(spark, d).select("bucket", "place", _block().alias("block")), F.broadcast(buckets))


@query("report_context", f"""WITH s AS (SELECT *, CASE bucket WHEN 'F' THEN 0 WHEN 'O' THEN 100 ELSE 200 END + place AS at FROM ({_SHOWN})), p AS (SELECT DISTINCT c_name AS company, o_orderpriority AS title, max(o_orderdate) OVER (PARTITION BY c_name, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d')) AS day FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'),
 o AS (SELECT x.posting_id, x.company, string_agg('"' || y.title || '"', '; ' ORDER BY y.at) AS l, count(*) AS n FROM s x JOIN s y ON x.company = y.company AND x.posting_id <> y.posting_id GROUP BY 1, 2),
 a AS (SELECT posting_id, company, string_agg('"' || title || '" on ' || strftime(day, '%Y-%m-%d'), '; ' ORDER BY day DESC, title DESC) FILTER (n <= 3) AS l, count(*) AS n FROM (SELECT s.posting_id, s.company, p.title, p.day, row_number() OVER (PARTITION BY s.posting_id ORDER BY p.day DESC, p.title DESC) AS n FROM s JOIN p ON p.company = s.company AND p.title <> s.title) GROUP BY 1, 2)
 SELECT s.posting_id, 'Also in this report from ' || o.company || ': ' || o.l || ' - read ' || CASE WHEN o.n = 1 THEN 'both' ELSE 'all' END || ' before applying' AS also_hiring, 'Already applied at ' || a.company || ': ' || a.l || CASE WHEN a.n > 3 THEN ' (+' || (a.n - 3) || ' more)' ELSE '' END AS already_applied FROM s LEFT JOIN o USING (posting_id) LEFT JOIN a USING (posting_id)""")
def report_context(spark, d):
    """Other roles of the company in the report, and earlier applications there."""
    at = F.when(F.col("bucket") == "F", 0).when(F.col("bucket") == "O", 100).otherwise(200) + F.col("place")
    rows = report.siblings_line(shown(spark, d).withColumn("at", at), place="at")
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    told = orders.select(F.col("o_orderkey").alias("posting_id"), text.company_key("c_name").alias("company_key"), F.col("o_orderpriority").alias("title"), "o_orderdate", "o_orderstatus")
    # Only companies of the report: a few dozen.
    told = told.join(F.broadcast(rows.select(text.company_key("company").alias("company_key")).distinct()), "company_key", "left_semi")
    verdicts = told.where("o_orderstatus = 'F'").select("posting_id", F.lit("applied").alias("verdict"), F.col("o_orderdate").alias("created_at"))
    return report.applied_line(rows, store.prior_applications(told, verdicts)).select("posting_id", "also_hiring", "already_applied")


_SUMMARY = "CASE doc_id % 3 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN '' ELSE '\"' || substr(coalesce(text, ''), 1, 40) || '\" and \"' || substr(coalesce(text, ''), 1, 12) || '\" then' || chr(10) || chr(10) || coalesce(text, '') END"


@query("summary_problems", f"""SELECT doc_id, CASE WHEN b = '' THEN 'no fit summary written' ELSE concat_ws('; ', CASE WHEN p <> 2 THEN p || ' paragraph(s), needs exactly 2' END, CASE WHEN q < 2 THEN q || ' verbatim quote(s), needs at least 2' END, CASE WHEN s > 6 THEN s || ' sentences, cap is 6' END, CASE WHEN length(b) < 320 THEN length(b) || ' characters, too thin' END) END AS problems FROM
 (SELECT doc_id, b, len(list_filter(regexp_split_to_array(b, '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS p, len(regexp_extract_all(b, '"[^"]{{12,}}"|“[^”]{{12,}}”')) AS q, len(regexp_extract_all(b, '[.!?](\\s|$)')) AS s FROM (SELECT doc_id, regexp_replace({_SUMMARY}, '^\\s+|\\s+$', '', 'g') AS b FROM documents))""")
def summary_problems(spark, d):
    """What summaries lack: whole texts, none, and texts after two quotations in a paragraph of their own."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(_SUMMARY).alias("summary"))
    return rows.select("doc_id", F.array_join(report.summary_problems("summary"), "; ").alias("problems"))


@query("live_status", """SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'TAKEN DOWN' WHEN a.doc_id IS NULL THEN 'not saved' WHEN trim(a.text, chr(9) || chr(10) || ' ') = trim(b.text, chr(9) || chr(10) || ' ') THEN 'same as saved' ELSE 'UPDATED' END AS status FROM
 (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 7) a FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE '  ' || text || chr(10) END AS text FROM documents WHERE doc_id % 5 <> 1 AND text <> '') b ON a.doc_id = b.doc_id""")
def live_status(spark, d):
    """The documents against a later landing of them, of which a fifth is gone, a third has more text and some were not saved."""
    docs = table(spark, d, "documents")
    later = docs.where("doc_id % 5 <> 1 and text <> ''").select("doc_id", F.expr("CASE WHEN doc_id % 3 = 0 THEN text || ' more' ELSE '  ' || text || chr(10) END").alias("description"))
    return store.live_status(docs.where("doc_id % 10 <> 7").select("doc_id", F.col("text").alias("description")), later, "doc_id")


_SQUASH = "regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')"
_BOARD_LIST = "SELECT DISTINCT {0} AS slug, p_brand AS board FROM part UNION SELECT DISTINCT {1} || '|wd1|Jobs', 'workday' FROM part UNION SELECT DISTINCT p_name || '|wd1', 'workday' FROM part"


@query("board_matches", f"""WITH n AS (SELECT DISTINCT {_SQUASH} AS name FROM part), i AS (SELECT DISTINCT CASE WHEN board = 'workday' THEN regexp_replace(lower(string_split(slug, '|')[1]), '[^a-z0-9]', '', 'g') ELSE regexp_replace(lower(slug), '[^a-z0-9]', '', 'g') END AS key, board, replace(slug, '|', CASE WHEN board = 'workday' THEN ':' ELSE '|' END) AS slug FROM ({_BOARD_LIST.format("substr(p_name, 1, 7 + length(p_name) % 3)", "p_name")}) WHERE board <> 'workday' OR len(string_split(slug, '|')) = 3)
 SELECT name, board, slug, row_number() OVER (PARTITION BY name ORDER BY same DESC, length(key) DESC, key, board, slug) AS rank FROM (SELECT name, key, board, slug, CASE WHEN name = key THEN 1 ELSE 0 END AS same FROM n JOIN i ON name = key OR (length(name) >= 6 AND length(key) >= 6 AND (starts_with(name, key) OR (starts_with(key, name) AND length(key) - length(name) <= 2)))) QUALIFY rank <= 6""")
def board_matches(spark, d):
    """Boards whose slugs a name starts with; those of one kind are packed of three parts, and those of two are left out."""
    parts = table(spark, d, "part")
    listed = parts.select(F.expr("substr(p_name, 1, CAST(7 + length(p_name) % 3 AS INT))").alias("slug"), F.col("p_brand").alias("board"))
    for form in ("|wd1|Jobs", "|wd1"):
        listed = listed.union(parts.select(F.concat("p_name", F.lit(form)), F.lit("workday")))
    names = parts.select(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "").alias("name"))
    return store.board_matches(names, store.slug_index(listed))


_HITS = "SELECT o_custkey AS name, o_orderpriority AS board, CAST(o_orderkey AS VARCHAR(20)) AS slug, o_orderstatus = 'F' AS verified, o_orderkey % 7 AS slug_rank, substr(o_orderpriority, 1, 1) AS board_rank FROM orders"


@query("best_boards", f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY verified DESC, slug_rank, board_rank, board, slug) AS n FROM ({_HITS}))
 SELECT name, arg_min(board, n) AS board, arg_min(slug, n) AS slug, arg_min(verified, n) AS verified, CASE WHEN bool_or(verified) THEN 'live' ELSE 'unverified' END AS status, CASE WHEN bool_or(verified) THEN coalesce(string_agg(board || '/' || slug, ', ' ORDER BY n) FILTER (n BETWEEN 2 AND 4), '') ELSE '' END AS also_live FROM h GROUP BY 1""")
def best_boards(spark, d):
    """Of several live boards the verified one with the most telling slug."""
    found = table(spark, d, "orders").selectExpr("o_custkey AS name", "o_orderpriority AS board", "CAST(o_orderkey AS STRING) AS slug", "o_orderstatus = 'F' AS verified", "o_orderkey % 7 AS slug_rank", "substr(o_orderpriority, 1, 1) AS board_rank")
    return store.best_board(found)


@query("posting_refresh_merged", "SELECT user_id AS posting_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen FROM events GROUP BY 1")
def posting_refresh_merged(spark, d):
    """The present from a view of the events of the first half of January and the events since, as after a snapshot."""
    log = table(spark, d, "events").select(F.col("user_id").alias("posting_id"), F.col("event_id").alias("seq"), F.col("ts").alias("seen_at"), "event_type", "value")
    early = log.where("seen_at < timestamp '2024-01-16'")
    return store.current(log.where("seen_at >= timestamp '2024-01-16' or seen_at is null"), known=store.view(early))


# Links put around a page by its page_id: two of one board, one of a board's maker, a packed one.
_LINKED = """coalesce(html, '') || '<a href="https://boards.greenhouse.io/embed/job_board?for=Org' || CAST(page_id % 9 AS VARCHAR(9)) || '">' || CASE page_id % 3 WHEN 0 THEN '<a href="https://jobs.lever.co/Team-' || CAST(page_id AS VARCHAR(9)) || '/1"><a href="https://jobs.lever.co/search">' WHEN 1 THEN 'https://Big.wd5.myworkdayjobs.com/wday/cxs/big/Careers' || CAST(page_id AS VARCHAR(9)) || '/job https://jobs.lever.co/a' ELSE ' boards.greenhouse.io/zz_9 boards.greenhouse.io/embed boards.greenhouse.io/ZZ_9' END"""


@query("board_links", """SELECT page_id, 'greenhouse/org' || (page_id % 9) || CASE page_id % 3 WHEN 0 THEN ' lever/team-' || page_id WHEN 1 THEN ' workday/big:wd5:Careers' || page_id ELSE ' greenhouse/zz_9' END AS links FROM pages""")
def board_links(spark, d):
    """Boards that pages link to; the tables' own pages link to none, so that the planted ones must come out alone."""
    pages = table(spark, d, "pages").select("page_id", links.board_links(F.expr(_LINKED)).alias("found"))
    return pages.select("page_id", F.array_join(F.transform("found", lambda x: F.concat(x["board"], F.lit("/"), x["slug"])), " ").alias("links"))
