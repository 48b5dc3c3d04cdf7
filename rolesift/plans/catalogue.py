"""The registered queries and their oracle SQL. Documents stand for postings, events for the log of their states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions import pay, sections, text, work
from rolesift.operators import gates, ranking
from rolesift.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"
#: The vocabularies of the two tracks of the sample profile.
TERMS_A = [("tion", 1.0), ("ment", 2.5), ("license", 4.0), ("that", 0.5)]
TERMS_B = [("eau", 1.5), ("ung", 2.0), ("with", 0.5), ("que", 1.0)]
FLOOR = 4.0
#: Terms of each side of track A, and the core of track B.
SIDES = (["license", "ment"], ["that", "tion"])
CORE = ["eau", "ung"]
BARS = {"overlap": 6.0, "a_only": 7.0, "b_only": 8.0}
BANDS = [(20.0, 5.0), (40.0, 4.0), (60.0, 2.5)]

_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_COUNT = "CAST((length(lower(text)) - length(replace(lower(text), '{0}', ''))) / {1} AS INT)"


def _sql_score(terms: list[tuple[str, float]]) -> str:
    return " + ".join(f"least({_COUNT.format(t, len(t))}, 3) * CAST({w} AS DOUBLE)" for t, w in terms)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("text_normalize", f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalised("text").alias("norm"))


@query("doc_description_hash", f"SELECT doc_id, sha256({_NORM.format('text')}) AS body_hash FROM documents")
def doc_description_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", text.body_hash("text").alias("body_hash"))


_NO_COMPANY = r"trim(regexp_replace(regexp_replace({0}, '\b(inc|llc|ltd|corp|corporation|co|company|holdings|group|technologies|technology|labs|hq|usa|us)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_NO_TITLE = r"trim(regexp_replace(regexp_replace({0}, '\b(full.?time|part.?time|contract|remote|hybrid|on.?site|onsite|us|usa|united states|new|urgent|hiring|open|f\/?m\/?d|m\/?f\/?d)\b', ' ', 'g'), '\s+', ' ', 'g'))"
# The table has no company and title of its own: made from source and language, with legal forms and decorations.
_COMPANY = "source || CASE doc_id % 4 WHEN 0 THEN ' Holdings, Inc.' WHEN 1 THEN ' Labs HQ' WHEN 2 THEN ' Technologies Group' ELSE ' US Co' END"
_TITLE = "lang || CASE doc_id % 4 WHEN 0 THEN ' engineer (Remote)' WHEN 1 THEN ' Urgent: full-time writer' WHEN 2 THEN ' on-site lead, United States' ELSE ' clerk m/f/d' END"


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("company", F.expr(_COMPANY)).withColumn("title", F.expr(_TITLE))


@query("doc_fingerprint", f"SELECT doc_id, sha256(concat_ws('|', {_NO_COMPANY.format(_NORM.format(_COMPANY))}, {_NO_TITLE.format(_NORM.format(_TITLE))}, substr({_NORM.format('text')}, 1, 400))) AS fingerprint FROM documents")
def doc_fingerprint(spark, d):
    return named(table(spark, d, "documents")).select("doc_id", text.posting_key("company", "title", "text").alias("fingerprint"))


@query("clone_keys", f"SELECT doc_id, sha256(concat_ws('|', {_NO_COMPANY.format(_NORM.format(_COMPANY))}, {_NO_TITLE.format(_NORM.format(_TITLE))}, regexp_replace({_NORM.format('text')}, '^this position is listed on behalf of a partner company.{{{{0,200}}}}?\\bbased in\\b[a-z ]{{{{0,40}}}}?(this is|the role|you will|our)\\b', ''))) AS clone_key FROM documents".replace("{{", "{").replace("}}", "}"))
def clone_keys(spark, d):
    """No text of the test tables has a reseller's opening; tests/test_feeds.py has some."""
    return named(table(spark, d, "documents")).select("doc_id", text.clone_key("company", "title", "text").alias("clone_key"))


@query("first_wins_dedupe", f"SELECT sha256({_NORM.format('text')}) AS body_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def first_wins_dedupe(spark, d):
    return doc_description_hash(spark, d).groupBy("body_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def _sql_any(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + ")"


_SCORED = f"SELECT doc_id, source, {_sql_score(TERMS_A)} AS score_a, {_sql_score(TERMS_B)} AS score_b, coalesce({_sql_any(SIDES[0])} AND {_sql_any(SIDES[1])}, false) AS sides, coalesce({_sql_any(CORE)}, false) AS core FROM documents"


def scored(spark: SparkSession, d: str) -> DataFrame:
    body = F.lower("text")
    sides = gates.both_sides(ranking.matched(body, TERMS_A), *SIDES).alias("sides")
    core = F.coalesce(F.arrays_overlap(ranking.matched(body, TERMS_B), F.lit(CORE)), F.lit(False)).alias("core")
    return table(spark, d, "documents").select("doc_id", "source", ranking.vocabulary_score(body, TERMS_A).alias("score_a"), ranking.vocabulary_score(body, TERMS_B).alias("score_b"), sides, core, text.body_hash("text").alias("body_hash"))


@query("both_sides", f"SELECT doc_id, sides, core FROM ({_SCORED})")
def both_sides(spark, d):
    return scored(spark, d).select("doc_id", "sides", "core")


@query("term_score_capped", f"SELECT doc_id, score_a, score_b FROM ({_SCORED})")
def term_score_capped(spark, d):
    return scored(spark, d).select("doc_id", "score_a", "score_b")


@query("matched_terms", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN '{t}' END" for t, _ in sorted(TERMS_A)) + ") AS terms FROM documents")
def matched_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(ranking.matched(F.lower("text"), TERMS_A), ",").alias("terms"))


_BUCKET = f"CASE WHEN score_a >= {FLOOR} AND score_b >= {FLOOR} THEN 'overlap' WHEN score_b >= {FLOOR} THEN 'b_only' ELSE 'a_only' END"


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    tracks = F.array_compact(F.array(F.when(F.col("score_a") >= FLOOR, "a"), F.when(F.col("score_b") >= FLOOR, "b")))
    return scored(spark, d).withColumn("bucket", ranking.bucket(tracks)).withColumn("score", F.greatest("score_a", "score_b"))


_BUCKETED = f"SELECT *, {_BUCKET} AS bucket, greatest(score_a, score_b) AS score FROM ({_SCORED})"


@query("track_bucket", f"SELECT doc_id, bucket FROM ({_BUCKETED})")
def track_bucket(spark, d):
    return bucketed(spark, d).select("doc_id", "bucket")


# A posting's date comes from its id here, since the table has none; a fifth are undated.
_PUBLISHED = f"CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '{AS_OF}' - to_hours(CAST(doc_id % 2000 AS INT)) END"


def dated(rows: DataFrame) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp")
    at = F.when(F.col("doc_id") % 5 != 0, F.timestamp_seconds(F.unix_timestamp(as_of) - (F.col("doc_id") % 2000) * 3600))
    return rows.withColumn("age", work.age_days(at, as_of))


_AGE = "CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 2000) * 3600000000 / 86400000000.0::DOUBLE END"


@query("freshness_age_days", f"SELECT doc_id, {_AGE} AS age FROM documents")
def freshness_age_days(spark, d):
    return dated(table(spark, d, "documents").select("doc_id"))


_FIRST_SEEN = f"SELECT user_id AS doc_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS watched FROM events GROUP BY 1"


def watched(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(work.age_days(F.min("ts"), F.lit(AS_OF)).alias("watched"))


@query("evergreen_flag", f"SELECT d.doc_id, watched > 25 AND watched - age > 12.5 AS evergreen FROM (SELECT doc_id, {_AGE} AS age FROM documents) d JOIN ({_FIRST_SEEN}) w ON d.doc_id = w.doc_id")
def evergreen_flag(spark, d):
    rows = freshness_age_days(spark, d).join(watched(spark, d), "doc_id")
    return rows.select("doc_id", ((F.col("watched") > 25) & (F.col("watched") - F.col("age") > 12.5)).alias("evergreen"))


# Roles, places, pay and demands come from the id, since the table has none; most rows hold nothing that a gate rejects.
_ROLE = "CASE doc_id % 23 WHEN 0 THEN 'Vice President, Growth' WHEN 1 THEN 'Owner of change, CRO' WHEN 2 THEN 'VP, CMO' WHEN 3 THEN 'Manager, web and CRO' WHEN 4 THEN 'Senior software engineer' WHEN 5 THEN 'Head of growth' ELSE 'Programme lead' END"
_PLACE = "CASE doc_id % 19 WHEN 0 THEN 'London, United Kingdom' WHEN 1 THEN 'Newark, NJ; Denver' WHEN 2 THEN 'CA - San Francisco' WHEN 3 THEN 'Austin, TX (Belmont Campus)' ELSE 'Newark, CA' END"
_PAY = "CASE WHEN doc_id % 7 < 3 THEN CAST(145000 + doc_id % 101 * 1000 AS INT) END"
_DEMAND = "CASE doc_id % 17 WHEN 0 THEN 'A PhD is required.' WHEN 1 THEN 'An MS or PhD in physics.' WHEN 2 THEN 'PhD in physics.' WHEN 3 THEN 'You must relocate.' ELSE 'Any degree.' END"
PROFILE = gates.Profile(cities={"San Francisco": 35, "Belmont": 10, "Newark": 45, "Sacramento": 120}, floor_a=FLOOR, floor_b=FLOOR)


def posted(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"role": F.expr(_ROLE), "place": F.expr(_PLACE), "pay_max": F.expr(_PAY), "demand": F.expr(_DEMAND)})


def _bands(bands: tuple[str, ...]) -> str:
    return rf"(?i)\b({'|'.join(bands)})\b"


# A code of a chief after the last comma is the organisation's, unless what stands before holds a band; CRO may be conversion.
_OTHER_BANDS = tuple(b for b in gates.BANDS if b not in ("cro", "cmo", "cto", "coo"))
_CODE = rf"(regexp_matches(role, '{_bands(('cmo', 'cto', 'coo'))}') OR (regexp_matches(role, '{_bands(('cro',))}') AND NOT regexp_matches(role, '(?i){gates.CONVERSION}')))"
_ORG = rf"(regexp_matches(role, '(?i),\s*(cro|cmo|cto|coo|cio){gates.ORG_WORDS}$') AND NOT regexp_matches(regexp_replace(role, ',[^,]*$', ''), '{_bands(gates.BANDS)}'))"
_BANDED = f"(regexp_matches(role, '{_bands(_OTHER_BANDS)}') OR ({_CODE} AND NOT {_ORG}))"
_EXEMPT = "(" + " OR ".join(f"regexp_matches(demand, '(?i){p}')" for p in gates.OPTIONAL_DEGREE) + ")"
_KILLER = "CASE " + " ".join(f"WHEN regexp_matches(demand, '(?i){p}') AND NOT {_EXEMPT if name in gates.EXEMPTIONS else 'false'} THEN '{name}'" for name, p in gates.KILLERS.items()) + " END"
_TRACK_A = f"coalesce(sides AND score_a >= {FLOOR}, false)"
_TRACK_B = f"coalesce(core AND score_b >= {FLOOR}, false) AND NOT {_BANDED} AND NOT regexp_matches(role, '(?i)head of')"
_GATES = f"""SELECT b.doc_id, b.bucket, b.score, CASE WHEN l.doc_id IS NOT NULL THEN 'suppressed' WHEN age > 60 THEN 'stale' WHEN {_BANDED} THEN 'title_band'
 WHEN regexp_matches(role, '(?i)\\b({"|".join(gates.OTHER_TRADES)})\\b') THEN 'other_trade' WHEN regexp_matches(place, 'London|, NJ|, TX') THEN 'too_far'
 WHEN pay_max < 150000 THEN 'pay_floor' WHEN {_KILLER} IS NOT NULL THEN {_KILLER} WHEN NOT ({_TRACK_A}) AND NOT ({_TRACK_B}) THEN 'irrelevant' END AS reason
FROM (SELECT *, {_AGE} AS age, {_ROLE} AS role, {_PLACE} AS place, {_PAY} AS pay_max, {_DEMAND} AS demand FROM ({_BUCKETED})) b LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l ON b.doc_id = l.doc_id"""


def gated(spark: SparkSession, d: str) -> DataFrame:
    """The first gate that a posting fails, in the order of the cascade: suppressed, stale, title, trade, geography, pay, demands, relevance."""
    skip = table(spark, d, "labels").where("quality = 0").select("doc_id").distinct().withColumn("skip", F.lit(True))
    rows = posted(dated(bucketed(spark, d))).join(skip, "doc_id", "left")
    role, nothing = F.col("role"), F.lit(None).cast("string")
    found = gates.tracks(F.col("score_a"), F.col("sides"), F.col("score_b"), F.col("core"), role, PROFILE)
    checks = [
        ("suppressed", F.col("skip")),
        ("stale", F.col("age") > PROFILE.freshness_days),
        ("title_band", gates.title_band(role, PROFILE.bands).isNotNull()),
        ("other_trade", gates.out_of_domain(role)),
        ("too_far", gates.too_far(nothing, nothing, F.col("place"), F.array().cast("array<string>"), PROFILE)),
        ("pay_floor", F.col("pay_max") < PROFILE.pay_floor),
    ]
    return rows.withColumn("reason", F.coalesce(ranking.first_reason(checks), gates.killer(F.col("demand")), F.when(F.size(found) == 0, "irrelevant")))


@query("gate_reason_cascade", f"SELECT doc_id, reason FROM ({_GATES})")
def gate_reason_cascade(spark, d):
    return gated(spark, d).select("doc_id", "reason")


@query("funnel_counts", f"SELECT coalesce(reason, 'passed') AS outcome, count(*) AS n FROM ({_GATES}) GROUP BY 1")
def funnel_counts(spark, d):
    return gated(spark, d).groupBy(F.coalesce("reason", F.lit("passed")).alias("outcome")).agg(F.count("*").alias("n"))


@query("clone_collapse", f"SELECT min(g.doc_id) AS doc_id, h.body_hash FROM ({_GATES}) g JOIN (SELECT doc_id, sha256({_NORM.format('text')}) AS body_hash FROM documents) h ON g.doc_id = h.doc_id WHERE g.reason IS NULL GROUP BY 2")
def clone_collapse(spark, d):
    """The hash is made where the text is read, so nothing is joined to fetch it again."""
    return gated(spark, d).where("reason is null").groupBy("body_hash").agg(F.min("doc_id").alias("doc_id"))


@query("clone_claimants", f"""WITH h AS (SELECT doc_id, sha256({_NORM.format('text')}) AS body_hash FROM documents),
 g AS (SELECT h.doc_id, h.body_hash, l.doc_id IS NOT NULL AS scored, reason IS NULL AS passed FROM h JOIN ({_GATES}) q ON q.doc_id = h.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = h.doc_id)
 SELECT doc_id, body_hash FROM (SELECT *, row_number() OVER (PARTITION BY body_hash ORDER BY doc_id) AS r FROM g WHERE scored OR passed) WHERE r = 1 AND passed AND NOT scored""")
def clone_claimants(spark, d):
    """A passed posting stays if no earlier one of its clone key passed or was already scored: the first claimant of each key, kept if it is a passed one. One aggregation, with partial minima before the shuffle."""
    scored = table(spark, d, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("scored", F.lit(True))
    rows = gated(spark, d).join(scored, "doc_id", "left").where("scored or reason is null")
    first = rows.groupBy("body_hash").agg(F.min(F.struct("doc_id", F.coalesce("scored", F.lit(False)).alias("scored"), F.col("reason").isNull().alias("passed"))).alias("r"))
    return first.where("r.passed and not r.scored").select("r.doc_id", "body_hash")


@query("rank_unseen", f"SELECT doc_id, bucket, score, rank FROM (SELECT doc_id, bucket, score, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, doc_id) AS rank FROM ({_GATES}) WHERE reason IS NULL) WHERE rank <= 12")
def rank_unseen(spark, d):
    rows = gated(spark, d).where("reason is null").select("doc_id", "bucket", "score")
    return ranking.top_k(rows, "bucket", [F.desc("score"), F.asc("doc_id")], 12)


_BAR = "CASE bucket " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in BARS.items()) + " END"


def barred(spark: SparkSession, d: str) -> DataFrame:
    bar = F.coalesce(*(F.when(F.col("bucket") == k, F.lit(v)) for k, v in BARS.items()))
    return gated(spark, d).where("reason is null").withColumn("bar", bar)


@query("worth_knowing_band", f"SELECT * FROM (SELECT doc_id, bucket, score, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, doc_id) AS rank FROM ({_GATES}) WHERE reason IS NULL AND score < {_BAR} AND score >= {_BAR} - 2) WHERE rank <= 3")
def worth_knowing_band(spark, d):
    rows = barred(spark, d).where("score < bar and score >= bar - 2").select("doc_id", "bucket", "score")
    return ranking.top_k(rows, "bucket", [F.desc("score"), F.asc("doc_id")], 3)


@query("closest_to_bar_topk", f"SELECT doc_id, bucket, abs(score - {_BAR}) AS distance FROM ({_GATES}) WHERE reason IS NULL ORDER BY 3, 1 LIMIT 30")
def closest_to_bar_topk(spark, d):
    return barred(spark, d).select("doc_id", "bucket", F.abs(F.col("score") - F.col("bar")).alias("distance")).orderBy("distance", "doc_id").limit(30)


@query("near_miss_max_by", f"SELECT source, arg_max(doc_id, score * 1e9 - doc_id) AS doc_id, max(score) AS score, count(*) AS n FROM ({_BUCKETED}) WHERE score < 7 GROUP BY 1")
def near_miss_max_by(spark, d):
    best = F.max_by("doc_id", F.struct("score", -F.col("doc_id"))).alias("doc_id")
    return bucketed(spark, d).where("score < 7").groupBy("source").agg(best, F.max("score").alias("score"), F.count("*").alias("n"))


@query("suppressed_anti_join", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)")
def suppressed_anti_join(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_anti")


@query("already_scored_semi", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def already_scored_semi(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("composite_role_semi", "SELECT doc_id FROM documents x WHERE EXISTS (SELECT 1 FROM documents y JOIN labels l USING (doc_id) WHERE l.toxic = 1 AND lower(trim(x.source)) = lower(trim(y.source)) AND lower(trim(x.lang)) = lower(trim(y.lang)))")
def composite_role_semi(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lower(F.trim("source")).alias("s"), F.lower(F.trim("lang")).alias("l"))
    shown = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("s", "l").distinct()
    return docs.join(shown, ["s", "l"], "left_semi").select("doc_id")


_LATEST = "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query("latest_state_per_key", _LATEST)
def latest_state_per_key(spark, d):
    return ranking.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", ["ts", "event_id"]).drop("ts")


@query("latest_join_left", f"SELECT c.c_custkey, c.c_mktsegment, l.event_type FROM customer c LEFT JOIN ({_LATEST}) l ON c.c_custkey = l.user_id")
def latest_join_left(spark, d):
    state = latest_state_per_key(spark, d).select(F.col("user_id").alias("c_custkey"), "event_type")
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(state, "c_custkey", "left")


@query("repost_signals", "SELECT user_id, count(DISTINCT event_type) AS ids, count(DISTINCT CAST(ts AS DATE)) AS dates, count(DISTINCT event_type) > 1 OR count(DISTINCT CAST(ts AS DATE)) > 1 AS perpetual FROM events GROUP BY 1")
def repost_signals(spark, d):
    ids, dates = F.count_distinct("event_type"), F.count_distinct(F.to_date("ts"))
    return table(spark, d, "events").groupBy("user_id").agg(ids.alias("ids"), dates.alias("dates"), ((ids > 1) | (dates > 1)).alias("perpetual"))


@query("stats_by_state", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stats_by_state(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("weighted_mean_null_renorm", "SELECT d.doc_id, (coalesce(quality * 2.0::DOUBLE, 0) + coalesce(toxic * 1.0::DOUBLE, 0) + 0.5) / (CASE WHEN quality IS NULL THEN 0 ELSE 2 END + CASE WHEN toxic IS NULL THEN 0 ELSE 1 END + 1)::DOUBLE AS mean FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def weighted_mean_null_renorm(spark, d):
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").withColumn("prior", F.lit(0.5))
    return rows.select("doc_id", ranking.weighted_mean({"quality": 2.0, "toxic": 1.0, "prior": 1.0}).alias("mean"))


@query("score_caps_modifiers", f"SELECT doc_id, least(5.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN bucket = 'a_only' THEN least(score, 3.5::DOUBLE) ELSE score END - CASE WHEN source = 'src1' THEN 0.5::DOUBLE ELSE 0 END)) AS final FROM ({_BUCKETED})")
def score_caps_modifiers(spark, d):
    capped = F.when(F.col("bucket") == "a_only", F.least("score", F.lit(3.5))).otherwise(F.col("score"))
    moved = capped - F.when(F.col("source") == "src1", 0.5).otherwise(0.0)
    return bucketed(spark, d).select("doc_id", F.least(F.lit(5.0), F.greatest(F.lit(1.0), moved)).alias("final"))


_REPORT = f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ({_BUCKETED})) WHERE r <= 40"


@query("siblings_in_report", f"SELECT a.doc_id, string_agg(CAST(b.doc_id AS VARCHAR), ',' ORDER BY b.doc_id) AS siblings FROM ({_REPORT}) a LEFT JOIN ({_REPORT}) b ON a.source = b.source AND a.doc_id <> b.doc_id GROUP BY 1")
def siblings_in_report(spark, d):
    """Other roles of the same company within the report, which holds 40 rows."""
    report = bucketed(spark, d).orderBy(F.desc("score"), "doc_id").limit(40).select("doc_id", "source")
    lists = report.groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("all"))
    rows = report.join(lists, "source", "left").withColumn("others", F.filter("all", lambda x: x != F.col("doc_id")))
    return rows.select("doc_id", F.when(F.size("others") > 0, F.array_join(F.col("others").cast("array<string>"), ",")).alias("siblings"))


@query("prior_applications", "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_at, arg_max(o_orderkey, epoch_us(o_orderdate)::HUGEINT * 1000000000 + o_orderkey) AS last_key FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def prior_applications(spark, d):
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("last_at"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("last_key"))


@query("range_band_lookup", "SELECT p_partkey, CASE WHEN p_size <= 20 THEN 5.0::DOUBLE WHEN p_size <= 40 THEN 4.0::DOUBLE WHEN p_size <= 60 THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS band FROM part")
def range_band_lookup(spark, d):
    return table(spark, d, "part").select("p_partkey", work.banded(F.col("p_size"), BANDS, 1.0).alias("band"))


_BACKLOG = "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1"


@query("backlog_upsert_counts", _BACKLOG)
def backlog_upsert_counts(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("times_seen"), F.count_if(F.col("event_type") == "error").alias("attempts"))


@query("backlog_drain_order", f"SELECT user_id, attempts, times_seen FROM ({_BACKLOG}) ORDER BY attempts, first_seen, times_seen DESC, user_id LIMIT 25")
def backlog_drain_order(spark, d):
    return backlog_upsert_counts(spark, d).orderBy("attempts", "first_seen", F.desc("times_seen"), "user_id").limit(25).select("user_id", "attempts", "times_seen")


@query("html_drop_script_style", r"SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS plain FROM pages")
def html_drop_script_style(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_without_code("html").alias("plain"))


@query("html_strip_tags", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def html_strip_tags(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_tags_stripped("html").alias("plain"))


@query("ats_link_extract", "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1))), ' ') AS links FROM pages")
def ats_link_extract(spark, d):
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))))
    return table(spark, d, "pages").select("page_id", F.array_join(links, " ").alias("links"))


@query("section_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS heading FROM conversations")
def section_carry_forward(spark, d):
    from pyspark.sql import Window

    lines = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), True).over(lines).alias("heading"))


# The table's texts have no headings: four kinds of posting are made around them.
_BODY = "coalesce(text, '')"
_POSTED_BODY = f"""CASE doc_id % 4 WHEN 0 THEN 'About the role' || chr(10) || {_BODY} || chr(10) || 'Your impact' || chr(10) || lang || chr(10) || 'Boston Pay Range' || chr(10) || source
 WHEN 1 THEN 'Requirements' || chr(10) || {_BODY} || chr(10) || 'Nice to have' || chr(10) || lang || chr(10) || 'Perks' || chr(10) || source
 WHEN 2 THEN {_BODY} || chr(10) || '- Build ' || lang || chr(10) || '- ' || lang || chr(10) || '- ' || source ELSE {_BODY} END"""
_BARE = f"regexp_replace({_BODY}, '^\\s+|\\s+$', '', 'g')"


@query("section_extract", f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {_BARE} ELSE '' END AS overview,
 CASE doc_id % 4 WHEN 0 THEN lang WHEN 2 THEN '- Build ' || lang || chr(10) || '- ' || lang || chr(10) || '- ' || source ELSE '' END AS responsibilities,
 CASE doc_id % 4 WHEN 1 THEN {_BARE} || chr(10) || 'Nice to have' || chr(10) || lang ELSE '' END AS requirements, CASE doc_id % 4 WHEN 3 THEN {_BARE} ELSE '' END AS "full",
 CASE doc_id % 4 WHEN 0 THEN 'heading "Your impact"' WHEN 1 THEN 'no responsibilities heading found - captured "Requirements" instead' WHEN 2 THEN 'unlabelled bullet list (no headings matched)'
 ELSE CASE WHEN {_BARE} = '' THEN 'no description stored' ELSE 'full-text fallback - no headings matched, whole posting saved' END END AS via FROM documents""")
def section_extract(spark, d):
    """No shuffle: a text's lines are an array, and a section is a slice of it."""
    rows = table(spark, d, "documents").select("doc_id", F.expr(_POSTED_BODY).alias("body"))
    return sections.with_sections(rows, "body").select("doc_id", "sections.*")


@query("heading_kinds", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'responsibilities' WHEN 1 THEN 'requirements' WHEN 2 THEN 'stop' WHEN 3 THEN 'overview' END AS kind FROM documents")
def heading_kinds(spark, d):
    """Headings made around the source, since the table has none."""
    line = F.expr("CASE doc_id % 5 WHEN 0 THEN '## In this role as ' || source || ', you will:' WHEN 1 THEN 'Preferred ' || source || ' qualifications' WHEN 2 THEN source || ' salary range' WHEN 3 THEN ' *Overview*' ELSE '- ' || source END")
    return table(spark, d, "documents").select("doc_id", sections.heading_kind(F.regexp_replace(line, r"[#*]", "")).alias("kind"))


@query("salary_parse")
def salary_parse(spark, d):
    return table(spark, d, "documents").select("doc_id", pay.pay_range("text").alias("r")).select("doc_id", "r.low", "r.high")


@query("work_model")
def work_model(spark, d):
    return table(spark, d, "documents").select("doc_id", work.work_model(F.lit(None).cast("string"), F.lit(False), F.col("source"), F.col("text")).alias("work_model"))
