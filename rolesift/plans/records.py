"""Registered queries of archives, worksheets and screening once more. Documents and orders stand for postings; their fields are made by the id, their texts are the tables' own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.operators import archive, store, worksheet
from rolesift.plans import reporting, screening
from rolesift.plans.catalogue import _POSTED_BODY, ORACLE_SQL, query
from rolesift.plans.history import KIND
from rolesift.session import table

AS_OF = "2024-04-20 00:00:00"


def _slug(x: str, n: int) -> str:
    return f"coalesce(nullif(rtrim(left(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-'), {n}), '-'), ''), 'role')"


# A company is a market segment and a day a month, so that names meet; a fourth of the titles end in a number.
_TITLE = "o_orderpriority || CASE WHEN o_orderkey % 4 = 0 THEN ' 2' ELSE '' END"
_NAMED = "CASE WHEN n = 1 AND NOT regexp_matches(base, '-[0-9]+$') THEN base ELSE base || '-' || n END"


@query("archive_names", f"""WITH o AS (SELECT o_orderkey AS posting_id, o_orderkey % 3 = 0 AS early, strftime(o_orderdate, '%Y-%m-01') || '-' || {_slug("c_mktsegment", archive.COMPANY_LENGTH)} || '-' || {_slug(_TITLE, archive.TITLE_LENGTH)} AS base FROM orders JOIN customer ON o_custkey = c_custkey),
 n AS (SELECT posting_id, early, base, row_number() OVER (PARTITION BY base ORDER BY NOT early, posting_id % 64, posting_id) AS n FROM o) SELECT posting_id, {_NAMED} AS name FROM n""")
def archive_names(spark, d):
    """A third of the orders have names already; the others count on from these."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    base = archive.base_name(F.date_format("o_orderdate", "yyyy-MM-01"), "c_mktsegment", F.expr(_TITLE))
    rows = rows.select(F.col("o_orderkey").alias("posting_id"), base.alias("base"))
    early = archive.named(rows.where("posting_id % 3 = 0"))
    return archive.named(rows, early.select("posting_id", "name")).select("posting_id", "name")


# The fields of an application, the same in both dialects.
_FILED = {
    "posting_id": "doc_id",
    "title": "'Role ' || CAST(doc_id % 13 AS VARCHAR(9))",
    "company": "source",
    "applied_on": "'2024-04-' || CASE WHEN doc_id % 2 = 0 THEN '11' ELSE '12' END",
    "reason": "CASE WHEN doc_id % 3 = 0 THEN 'Fits well' WHEN doc_id % 3 = 1 THEN '' END",
    "score": "CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 40 AS DOUBLE) / 10 + 1 END",
    "connection_bonus": "CASE WHEN doc_id % 4 = 0 THEN 1.0 WHEN doc_id % 4 = 1 THEN 0.0 END",
    "fit_summary": "CASE WHEN doc_id % 6 = 0 THEN '  It fits ' || coalesce(lang, 'anyone') || ' ' END",
    "published": "CASE WHEN doc_id % 7 > 0 THEN CAST('2024-03-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR(9)), 2, '0') || ' 00:00:00' AS TIMESTAMP) END",
    "city": "CASE WHEN doc_id % 4 <> 3 THEN 'NATION_' || CAST(doc_id % 25 AS VARCHAR(9)) END",
    "location_raw": "CASE WHEN doc_id % 3 = 0 THEN 'Region ' || CAST(doc_id % 9 AS VARCHAR(9)) || ' hybrid' END",
    "work_model": "CASE doc_id % 4 WHEN 0 THEN 'Remote' WHEN 1 THEN 'On-site' WHEN 3 THEN 'Hybrid' END",
    "salary_min": "CASE WHEN doc_id % 5 > 1 THEN CAST(90000 + doc_id % 101 * 999 AS INT) END",
    "salary_max": "CASE WHEN doc_id % 3 > 0 THEN CAST(191000 + doc_id % 89 * 1001 AS INT) END",
    "url": "'https://x.example/' || CAST(doc_id AS VARCHAR(20))",
}
_FILED_SQL = ", ".join(f"{sql} AS {name}" for name, sql in _FILED.items())
_PAY = reporting._LINES["pay_field"]
_PLACE = "coalesce(nullif(city, ''), nullif(location_raw, ''), 'Not stated')"
_FILE = f"""concat_ws(chr(10), '# ' || title || ' - ' || coalesce(company, '') || chr(10), '- **Applied:** ' || applied_on, '- **Posted:** ' || coalesce(strftime(published, '%Y-%m-%d'), 'Not stated'),
 '- **Score:** ' || printf('%.1f', score) || CASE WHEN connection_bonus > 0 THEN ' (includes +1.0 connection bump)' ELSE '' END,
 '- **Location:** ' || {_PLACE} || CASE WHEN work_model IS NULL OR contains(lower({_PLACE}), lower(work_model)) THEN '' ELSE ' - ' || work_model END,
 '- **Salary:** ' || {_PAY}, '- **Posting:** ' || url, '- **Why I applied:** ' || nullif(reason, ''), chr(10) || '{archive.SNAPSHOT_NOTE}' || chr(10), '_Captured via: ' || s.via || '._' || chr(10), '_Posting id ' || posting_id || '._' || chr(10),
 {", ".join(f"'## {h}' || chr(10) || chr(10) || nullif(s.{c}, '') || chr(10)" for h, c in archive.HEADINGS)}, '## Fit summary at time of scan' || chr(10) || chr(10) || trim(fit_summary) || chr(10))"""


@query("archive_files", f"SELECT posting_id, regexp_replace({_FILE}, '\\s+$', '') || chr(10) AS file FROM (SELECT {_FILED_SQL} FROM documents) JOIN ({ORACLE_SQL['section_extract']}) s ON posting_id = s.doc_id")
def archive_files(spark, d):
    """The text of each application's file; the sections of the posting are whole."""
    rows = table(spark, d, "documents").select(F.expr(_POSTED_BODY).alias("description"), *(F.expr(sql).alias(name) for name, sql in _FILED.items()))
    return archive.with_file(rows).select("posting_id", "file")


_SHEET = _FILED | {
    "apply_url": "CASE WHEN doc_id % 2 = 0 THEN 'https://a.example/' || lang END",
    "equity": "doc_id % 4 = 1",
    "bonus": "doc_id % 6 = 0",
    "date_confidence": "CASE WHEN doc_id % 2 = 0 THEN 'high' END",
    "department": "lang",
    "team": "CASE WHEN doc_id % 3 = 0 THEN 'Team' END",
    "ats": "'ashby'",
    "source_slug": "source",
    "source_id": "CAST(doc_id AS VARCHAR(20))",
    "description": "text",
}
_TRIM = "regexp_replace(coalesce(description, ''), '^\\s+|\\s+$', '', 'g')"
_BASE = "coalesce(salary_max, salary_min)"
_USD = reporting._USD
_WAY = reporting._WAY
_BLOCK = f"""concat_ws(chr(10), title || ' - ' || coalesce(company, ''), '', '- **posting_id**: `' || posting_id || '`', '- **URL**: ' || url, '- **Apply URL**: ' || coalesce(apply_url, '(same)'),
 '- **Location**: ' || coalesce(location_raw, 'unstated') || '  |  city: ' || coalesce(city, 'unknown') || '  |  work model: **' || coalesce(work_model, 'unknown') || '**',
 '- **Commute**: ' || CASE WHEN work_model = 'Remote' THEN 'Fully remote - no commute.' WHEN {_WAY} IS NULL THEN 'Commute time unknown for ' || coalesce('''' || city || '''', 'None') || '. Add it to the profile to score this location properly.' ELSE {_WAY} || ' min door-to-door from {reporting.HOME}.' END || '  (dimension 5 raw score '
  || CASE WHEN work_model = 'Remote' THEN '5.0' WHEN {_WAY} IS NULL THEN '3.0' WHEN {_WAY} <= 20 THEN '5.0' WHEN {_WAY} <= 40 THEN '4.0' WHEN {_WAY} <= 60 THEN '2.5' ELSE '1.0' END || ')' || CASE WHEN coalesce(work_model, '') <> 'Remote' AND {_WAY} IS NULL THEN '  **[UNKNOWN CITY - resolve before scoring]**' ELSE '' END,
 '- **Salary**: ' || CASE WHEN {_BASE} IS NULL THEN 'not listed' ELSE {_PAY} || '  ->  modeled: base ' || {_USD.format(_BASE)} || ' + bonus ' || {_USD.format(f"round_even({_BASE} * 0.1::DOUBLE, 0)::INT")} || ' + equity ' || CASE WHEN equity THEN '$35,000' ELSE '$0' END || ' = TC ' || {_USD.format(f"({_BASE} + round_even({_BASE} * 0.1::DOUBLE, 0)::INT + CASE WHEN equity THEN 35000 ELSE 0 END)")} END,
 '- **Equity mentioned**: ' || CASE WHEN equity THEN 'yes' ELSE 'no' END || '  |  **Bonus mentioned**: ' || CASE WHEN bonus THEN 'yes' ELSE 'no' END,
 '- **Published**: ' || coalesce(strftime(published, '%Y-%m-%d'), 'unknown') || '  (' || coalesce(date_diff('day', published, TIMESTAMP '{AS_OF}') || ' days ago', 'age unknown') || ')  |  date confidence: ' || coalesce(date_confidence, 'unknown'),
 '- **Department / team**: ' || coalesce(nullif(department, ''), '-') || ' / ' || coalesce(team, '-'), '- **Source**: ' || ats || '/' || coalesce(source_slug, '') || '  id=' || source_id,
 '- **Repost history**: ' || coalesce(ids, 0) || ' distinct ATS id(s), ' || coalesce(dates, 0) || ' distinct publish date(s)' || CASE WHEN perpetual THEN '  **[PERPETUAL REPOST SIGNAL]**' ELSE '' END,
 chr(10) || '<details><summary>Full description</summary>' || chr(10) || chr(10) || '```text',
 CASE WHEN length({_TRIM}) <= {worksheet.LONGEST} THEN {_TRIM} ELSE left({_TRIM}, {worksheet.LONGEST - worksheet.END}) || chr(10) || chr(10) || '[...' || format('{{:,}}', length({_TRIM}) - {worksheet.LONGEST}) || ' characters omitted from the middle...]' || chr(10) || chr(10) || right({_TRIM}, {worksheet.END}) END,
 '```' || chr(10) || chr(10) || '</details>' || chr(10))"""


def sheet_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(*(F.expr(sql).alias(name) for name, sql in _SHEET.items()))


@query("worksheet_blocks", f"SELECT posting_id, {_BLOCK} AS block FROM (SELECT {', '.join(f'{sql} AS {name}' for name, sql in _SHEET.items())} FROM documents) LEFT JOIN ({ORACLE_SQL['repost_signals']}) ON posting_id = user_id")
def worksheet_blocks(spark, d):
    """What an evaluator reads of each document; its repeated sightings are a user's events."""
    seen = table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day"))
    ids, dates = F.count_distinct("event_type"), F.count_distinct("day")
    signals = seen.groupBy(F.col("user_id").alias("posting_id")).agg(ids.alias("ids"), dates.alias("dates"), ((ids > 1) | (dates > 1)).alias("perpetual"))
    rows = sheet_rows(spark, d).join(signals, "posting_id", "left")
    return worksheet.with_block(rows, F.lit(AS_OF), reporting.MINUTES, reporting.WAY_BANDS, reporting.HOME).select("posting_id", "block")


# Every second posting has three events and so a state, the others are new; lists as they were recorded before the rules of today.
_STATES = "SELECT 2 * posting_id AS doc_id, state FROM (" + ORACLE_SQL["posting_states"] + ")"
_RECORDED = "CASE doc_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'a,b' WHEN 3 THEN '' END"
_ON_RECORD = screening._SCREENED.replace("l.doc_id2 IS NOT NULL THEN", "false THEN").replace("age IS NULL AND NOT (n = 1 AND watched IS NULL) THEN", "false THEN").replace("age > 60 THEN", "false THEN")


def recorded(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in KIND.items() for x in pair))
    log = table(spark, d, "events").select((2 * F.floor(F.col("event_id") / 3)).cast("long").alias("doc_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("state"))
    rows = table(spark, d, "documents").select("doc_id", F.expr(_RECORDED).alias("tracks"))
    return rows.join(store.states(log, "doc_id"), "doc_id", "left").withColumn("state", F.coalesce("state", F.lit(store.NEW)))


@query("screening_events", f"""SELECT doc_id, CASE WHEN reason IS NULL THEN 'prefiltered' ELSE 'rejected_prefilter' END AS state, CASE WHEN reason IS NULL THEN 'relevance ' || printf('%.1f', score_a) ELSE reason END AS reason, CASE WHEN reason IS NULL THEN tracks END AS tracks
 FROM ({screening._SCREENED}) WHERE doc_id NOT IN (SELECT doc_id FROM ({_STATES}))""")
def screening_events(spark, d):
    """What is appended for the postings still new, once the whole cascade has judged them."""
    return store.screening_events(recorded(spark, d), screening.outcomes(spark, d), "doc_id")


@query("moved_tracks", f"""SELECT doc_id, before, tracks AS after FROM (SELECT *, coalesce({_RECORDED}, '') AS before FROM ({_ON_RECORD})) JOIN ({_STATES}) USING (doc_id) WHERE state IN ('evaluated', 'presented') AND reason IS NULL AND tracks <> '' AND before <> tracks""")
def moved_tracks(spark, d):
    """Scored postings that today's rules put on another list; only their texts are read."""
    known = recorded(spark, d).where(F.col("state").isin(store.EVALUATED, store.PRESENTED))
    return store.moved_tracks(known, screening.outcomes(spark, d, known, on_record=True), "doc_id")
