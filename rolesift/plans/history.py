"""Registered queries over logs: the event table stands for the store's logs, a user for a posting. Views are scores, clicks presentations, sign-ups and purchases verdicts, errors failed tries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.operators import ranking, store
from rolesift.plans.catalogue import query
from rolesift.session import table

KIND = {"view": store.EVALUATED, "click": store.PRESENTED, "signup": "interested", "purchase": "applied", "error": store.REJECTED}
_STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items()) + " END"
_SHOWN = "event_type IN ('click', 'signup', 'purchase')"
BAR = 3.85


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumnRenamed("user_id", "posting_id")


def evaluations(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type = 'view'")
    return rows.select("posting_id", F.col("event_id").alias("eval_id"), (F.col("event_id") % 3).alias("run_id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("track"), (1 + (F.col("event_id") % 401) / 100).alias("score"), F.when(F.col("event_id") % 7 == 0, "FAIL").otherwise("PASS").alias("verdict"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type in ('signup', 'purchase')")
    return rows.select("posting_id", F.col("event_id").alias("verdict_id"), F.when(F.col("event_type") == "purchase", "applied").otherwise("interested").alias("verdict"), F.lit(None).cast("string").alias("reason"), F.col("ts").alias("created_at"))


_EVAL = "SELECT user_id AS posting_id, event_id AS eval_id, event_id % 3 AS run_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS track, 1 + (event_id % 401) / 100::DOUBLE AS score, CASE WHEN event_id % 7 = 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM events WHERE event_type = 'view'"
_VERD = "SELECT user_id AS posting_id, event_id AS verdict_id, CASE WHEN event_type = 'purchase' THEN 'applied' ELSE 'interested' END AS verdict, ts AS created_at FROM events WHERE event_type IN ('signup', 'purchase')"
_LAST_EVAL = f"SELECT * FROM ({_EVAL}) QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY eval_id DESC) = 1"


@query("posting_states", f"""WITH e AS (SELECT event_id // 3 AS posting_id, event_id AS seq, {_STATE} AS state, {_SHOWN} AS shown FROM events),
 s AS (SELECT posting_id, max(seq) FILTER (shown) AS at FROM e GROUP BY 1)
 SELECT s.posting_id, coalesce((SELECT state FROM e WHERE e.posting_id = s.posting_id AND e.seq = s.at), max(CASE WHEN e.state = 'evaluated' THEN 'evaluated' END), 'rejected_prefilter') AS state FROM s JOIN e ON e.posting_id = s.posting_id GROUP BY s.posting_id, s.at""")
def posting_states(spark, d):
    kinds = F.create_map(*(F.lit(x) for pair in KIND.items() for x in pair))
    # Three events a posting, so that every path through the states occurs.
    return store.states(table(spark, d, "events").select(F.floor(F.col("event_id") / 3).cast("long").alias("posting_id"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("state")))


@query("posting_refresh", "SELECT user_id AS posting_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS times_seen FROM events GROUP BY 1")
def posting_refresh(spark, d):
    return store.current(events(spark, d).select("posting_id", F.col("event_id").alias("seq"), F.col("ts").alias("seen_at"), "event_type", "value"))


@query("latest_evaluation_track", f"SELECT * FROM ({_EVAL}) WHERE track = 'a' QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY eval_id DESC) = 1")
def latest_evaluation_track(spark, d):
    return store.latest_evaluation(evaluations(spark, d), "a")


_JUDGED = f"""SELECT c_custkey AS posting_id, e.score, v.verdict AS judged, v.created_at FROM customer c LEFT JOIN ({_LAST_EVAL}) e ON e.posting_id = c_custkey
 LEFT JOIN (SELECT * FROM ({_VERD}) {{0}} QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY verdict_id DESC) = 1) v ON v.posting_id = c_custkey"""


def judged(spark: SparkSession, d: str, only: str | None = None) -> DataFrame:
    postings = table(spark, d, "customer").select(F.col("c_custkey").alias("posting_id"))
    return store.with_judgement(postings, evaluations(spark, d), verdicts(spark, d), only).drop("judged_reason")


@query("shortlist", _JUDGED.format(""))
def shortlist(spark, d):
    return judged(spark, d)


@query("applied_postings", f"SELECT * FROM ({_JUDGED.format(chr(32) + 'WHERE verdict = ' + chr(39) + 'applied' + chr(39))}) WHERE judged IS NOT NULL")
def applied_postings(spark, d):
    return judged(spark, d, "applied").where("judged is not null")


@query("awaiting_verdict", f"SELECT e.posting_id, e.score FROM ({_LAST_EVAL}) e WHERE e.posting_id IN (SELECT user_id FROM events WHERE event_type = 'click') AND e.posting_id NOT IN (SELECT posting_id FROM ({_VERD}) WHERE created_at > TIMESTAMP '2024-01-25')")
def awaiting_verdict(spark, d):
    shown = events(spark, d).where("event_type = 'click'").select("posting_id")
    told = verdicts(spark, d).where("created_at > timestamp '2024-01-25'").select("posting_id")
    return store.latest_evaluation(evaluations(spark, d)).join(shown, "posting_id", "left_semi").join(told, "posting_id", "left_anti").select("posting_id", "score")


@query("regression_scores", f"SELECT posting_id, score, run_id AS version, score < {BAR}::DOUBLE AS below_bar, run_id <> 2 AS stale FROM ({_LAST_EVAL})")
def regression_scores(spark, d):
    rows = store.latest_evaluation(evaluations(spark, d))
    return rows.select("posting_id", "score", F.col("run_id").alias("version"), (F.col("score") < BAR).alias("below_bar"), (F.col("run_id") != 2).alias("stale"))


@query("regression_counts", f"SELECT count(*) FILTER (verdict = 'FAIL') AS blocked, count(*) FILTER (verdict <> 'FAIL' AND score < {BAR}) AS under, count(*) FILTER (run_id <> 2) AS stale, count(*) AS checked FROM ({_LAST_EVAL})")
def regression_counts(spark, d):
    rows = store.latest_evaluation(evaluations(spark, d))
    fail = F.col("verdict") == "FAIL"
    return rows.agg(F.count_if(fail).alias("blocked"), F.count_if(~fail & (F.col("score") < BAR)).alias("under"), F.count_if(F.col("run_id") != 2).alias("stale"), F.count("*").alias("checked"))


@query("regression_listing", f"SELECT posting_id, verdict <> 'FAIL' AS passed, score FROM ({_LAST_EVAL})")
def regression_listing(spark, d):
    return store.latest_evaluation(evaluations(spark, d)).select("posting_id", (F.col("verdict") != "FAIL").alias("passed"), "score").orderBy("passed", "score", "posting_id")


_NUDGE = f"SELECT e.*, round(n.adj, 3) AS adjustment FROM ({_EVAL}) e LEFT JOIN (SELECT event_id + 1 AS eval_id, ((event_id % 31) - 15) / 100::DOUBLE AS adj FROM events WHERE event_type = 'click') n ON n.eval_id = e.eval_id"


def nudged(spark: SparkSession, d: str) -> DataFrame:
    clicks = events(spark, d).where("event_type = 'click'")
    nudges = clicks.select((F.col("event_id") + 1).alias("eval_id"), F.col("event_id").alias("seq"), (((F.col("event_id") % 31) - 15) / 100).alias("adjustment"), F.lit("note").alias("note"), F.array(F.lit("quote")).alias("quotes"))
    return store.nudged(evaluations(spark, d), nudges)


@query("nudged_scores", f"SELECT eval_id, adjustment, round(CASE WHEN adjustment IS NULL THEN score ELSE least(5.0::DOUBLE, greatest(1.0::DOUBLE, score + adjustment)) END, 6) AS final FROM ({_NUDGE})")
def nudged_scores(spark, d):
    return nudged(spark, d).select("eval_id", "adjustment", F.round("final", 6).alias("final"))


@query("nudge_audit", f"SELECT posting_id, eval_id, adjustment FROM ({_NUDGE}) QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY eval_id DESC) = 1 AND coalesce(adjustment, 0) <> 0")
def nudge_audit(spark, d):
    last = store.latest_evaluation(nudged(spark, d))
    return last.where(F.coalesce("adjustment", F.lit(0.0)) != 0).select("posting_id", "eval_id", "adjustment").orderBy(F.desc("eval_id"))


@query("close_calls", f"SELECT posting_id, score FROM ({_LAST_EVAL}) WHERE verdict <> 'FAIL' AND score >= {round(BAR - 0.2, 4)} AND score <= {round(BAR + 0.2, 4)} ORDER BY abs(score - {BAR}), posting_id LIMIT 30")
def close_calls(spark, d):
    rows = store.latest_evaluation(evaluations(spark, d)).where("verdict <> 'FAIL'").where(store.close_call(F.col("score"), F.lit(BAR)))
    return rows.orderBy(F.abs(F.col("score") - BAR), "posting_id").limit(30).select("posting_id", "score")


_WAITING = "SELECT user_id AS company, min(event_id) AS first_seen, count(*) FILTER (NOT tried) + CASE WHEN arg_min(tried, event_id) THEN 1 ELSE 0 END AS times_seen, count(*) FILTER (tried) AS attempts FROM (SELECT *, event_type = 'error' AND value > 95 AS tried FROM events) GROUP BY 1"


def waiting(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return store.backlog(rows.select(F.col("posting_id").cast("string").alias("company"), F.col("posting_id").cast("string").alias("display"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"), F.when((F.col("event_type") == "error") & (F.col("value") > 95), "tried").otherwise("seen").alias("kind")))


@query("backlog_rows", f"SELECT CAST(company AS VARCHAR) AS company, first_seen, times_seen, attempts FROM ({_WAITING})")
def backlog_rows(spark, d):
    return waiting(spark, d).select("company", "first_seen", "times_seen", "attempts")


@query("backlog_next", f"SELECT CAST(company AS VARCHAR) AS company FROM ({_WAITING}) WHERE attempts < 3 ORDER BY attempts, first_seen, times_seen DESC LIMIT 25")
def backlog_next(spark, d):
    return store.backlog_to_try(waiting(spark, d), 25)


@query("backlog_exhausted", f"SELECT CAST(company AS VARCHAR) AS company FROM ({_WAITING}) WHERE attempts >= 3")
def backlog_exhausted(spark, d):
    return store.backlog_exhausted(waiting(spark, d))


@query("backlog_size", f"SELECT count(*) AS n FROM ({_WAITING}) WHERE attempts < 3")
def backlog_size(spark, d):
    return waiting(spark, d).where(F.col("attempts") < store.MOST_ATTEMPTS).agg(F.count("*").alias("n"))


@query("store_totals", "SELECT (SELECT count(*) FROM documents) AS postings, (SELECT count(DISTINCT o_custkey) FROM orders) AS runs, (SELECT count(*) FROM labels WHERE quality = 1) AS rules")
def store_totals(spark, d):
    parts = [table(spark, d, "documents").agg(F.count("*").alias("n")).withColumn("what", F.lit("postings")), table(spark, d, "orders").agg(F.count_distinct("o_custkey").alias("n")).withColumn("what", F.lit("runs")), table(spark, d, "labels").where("quality = 1").agg(F.count("*").alias("n")).withColumn("what", F.lit("rules"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.agg(*(F.max(F.when(F.col("what") == k, F.col("n"))).alias(k) for k in ("postings", "runs", "rules")))


@query("fetch_counts_with_zeros", "SELECT c_custkey, count(o_orderkey) AS fetched, count(o_orderkey) = 0 AS nothing FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def fetch_counts_with_zeros(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "customer").select("c_custkey").join(counts, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("fetched"), F.col("n").isNull().alias("nothing"))


@query("board_groups", "SELECT lang, source, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2")
def board_groups(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("anchor_check", f"SELECT s_suppkey AS anchor, CASE WHEN score IS NULL THEN 'NOT SCORED' WHEN score BETWEEN 2 AND 4 THEN 'pass' ELSE 'fail' END AS outcome FROM supplier LEFT JOIN ({_LAST_EVAL}) ON posting_id = s_suppkey * 3")
def anchor_check(spark, d):
    scores = store.latest_evaluation(evaluations(spark, d)).select("posting_id", "score")
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("anchor"), (F.col("s_suppkey") * 3).alias("posting_id")).join(scores, "posting_id", "left")
    return rows.select("anchor", F.when(F.col("score").isNull(), "NOT SCORED").when(F.col("score").between(2, 4), "pass").otherwise("fail").alias("outcome"))


@query("anchor_counts", f"SELECT count(*) FILTER (score BETWEEN 2 AND 4) AS passed, count(*) FILTER (NOT score BETWEEN 2 AND 4) AS failed, count(*) FILTER (score IS NULL) AS missing FROM supplier LEFT JOIN ({_LAST_EVAL}) ON posting_id = s_suppkey * 3")
def anchor_counts(spark, d):
    is_ = lambda x: F.count_if(F.col("outcome") == x)
    return anchor_check(spark, d).agg(is_("pass").alias("passed"), is_("fail").alias("failed"), is_("NOT SCORED").alias("missing"))


@query("exemption_lookup", f"SELECT e.posting_id, e.verdict, CASE WHEN e.verdict = 'FAIL' THEN c_mktsegment END AS exempt FROM ({_LAST_EVAL}) e LEFT JOIN customer ON c_custkey = e.posting_id")
def exemption_lookup(spark, d):
    notes = table(spark, d, "customer").select(F.col("c_custkey").alias("posting_id"), "c_mktsegment")
    rows = store.latest_evaluation(evaluations(spark, d)).join(notes, "posting_id", "left")
    return rows.select("posting_id", "verdict", F.when(F.col("verdict") == "FAIL", F.col("c_mktsegment")).alias("exempt"))


@query("prior_applications_by_company", "SELECT o_custkey AS company, string_agg(day || ' ' || title, '; ' ORDER BY day DESC, title DESC) AS applications FROM (SELECT DISTINCT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS title FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def prior_applications_by_company(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"), F.col("o_custkey").cast("string").alias("company_key"), F.col("o_orderpriority").alias("title"), "o_orderdate", "o_orderstatus")
    told = rows.where("o_orderstatus = 'F'").select("posting_id", F.lit("applied").alias("verdict"), F.to_date("o_orderdate").alias("created_at"))
    lists = store.prior_applications(rows, told)
    return lists.select(F.col("company_key").cast("long").alias("company"), F.array_join(F.transform("applications", lambda x: F.concat(x["day"], F.lit(" "), x["title"])), "; ").alias("applications"))


@query("earlier_titles", "SELECT o_orderkey, string_agg(p.o_orderpriority, ',' ORDER BY p.o_orderpriority) AS others FROM orders x JOIN (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') p ON p.o_custkey = x.o_custkey AND p.o_orderpriority <> x.o_orderpriority GROUP BY 1")
def earlier_titles(spark, d):
    """Other titles applied to at the same company."""
    orders = table(spark, d, "orders")
    lists = orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("all"))
    rows = orders.join(lists, "o_custkey").withColumn("others", F.filter("all", lambda t: t != F.col("o_orderpriority")))
    return rows.where(F.size("others") > 0).select("o_orderkey", F.array_join("others", ",").alias("others"))


@query("unswept_anti", "SELECT doc_id, source, lang FROM documents x WHERE NOT EXISTS (SELECT 1 FROM documents y JOIN labels USING (doc_id) WHERE lower(trim(y.source)) = lower(trim(x.source)) AND lower(trim(y.lang)) = lower(trim(x.lang)) AND toxic = 1)")
def unswept_anti(spark, d):
    key = [F.lower(F.trim("source")).alias("s"), F.lower(F.trim("lang")).alias("l")]
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", *key)
    swept = docs.join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select("s", "l").distinct()
    return docs.join(swept, ["s", "l"], "left_anti").select("doc_id", "source", "lang")


@query("new_targets_anti", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer EXCEPT SELECT s_nationkey, 'BUILDING' FROM supplier")
def new_targets_anti(spark, d):
    known = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct().join(known, ["c_nationkey", "c_mktsegment"], "left_anti")


@query("uncovered_leads_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def uncovered_leads_anti(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("skip_set_union", "SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def skip_set_union(spark, d):
    rows = table(spark, d, "labels")
    return rows.where("quality = 0").select("doc_id").union(rows.where("toxic = 1").select("doc_id")).distinct()


@query("bag_union", "SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer")
def bag_union(spark, d):
    rows = [table(spark, d, t).select(F.col(c).alias("nation"), F.lit(t).alias("kind")) for t, c in (("supplier", "s_nationkey"), ("customer", "c_nationkey"))]
    return rows[0].unionByName(rows[1])


@query("missing_dimensions", "SELECT p_partkey, concat_ws(',', " + ", ".join(f"CASE WHEN NOT list_contains(string_split(p_name, ' '), '{x}') THEN '{x}' END" for x in ("red", "small", "widget")) + ") AS missing FROM part")
def missing_dimensions(spark, d):
    need = F.array(*(F.lit(x) for x in ("red", "small", "widget")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_except(need, F.split("p_name", " ")), ",").alias("missing"))


@query("priority_then_cap", "SELECT p_partkey, place FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_name LIKE '%red%' THEN 0 ELSE 1 END, p_partkey) AS place FROM part) WHERE place <= 50")
def priority_then_cap(spark, d):
    order = [F.when(F.col("p_name").contains("red"), 0).otherwise(1), F.col("p_partkey")]
    first = table(spark, d, "part").orderBy(*order).limit(50)  # the order below is over these rows only
    return first.select("p_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


@query("carried_then_fresh", "SELECT key, fresh FROM (SELECT s_suppkey AS key, 0 AS fresh FROM supplier UNION ALL SELECT c_custkey, 1 FROM customer) ORDER BY fresh, key LIMIT 140")
def carried_then_fresh(spark, d):
    """A run's work list of 140: what was carried over first, then what is new; the rest waits for the next run."""
    carried = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(0).alias("fresh"))
    new = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(1).alias("fresh"))
    return carried.unionByName(new).orderBy("fresh", "key").limit(140)


@query("latest_run_of_mode", "SELECT max(o_orderkey) AS run_id, '1-URGENT' AS mode FROM orders WHERE o_orderpriority = '1-URGENT'")
def latest_run_of_mode(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("mode"))
    return store.latest_run(runs, "1-URGENT")


@query("index_newest_first", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P'")
def index_newest_first(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("survivors_by_company", "SELECT doc_id, source FROM documents WHERE lang = 'en'")
def survivors_by_company(spark, d):
    return table(spark, d, "documents").where("lang = 'en'").select("doc_id", "source").orderBy("source", "doc_id")


@query("detail_by_url", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1")
def detail_by_url(spark, d):
    detail = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    return table(spark, d, "orders").select("o_orderkey").join(detail, "o_orderkey", "left")


_SQUASH = "regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')"


@query("prefix_lookup", f"""WITH n AS (SELECT DISTINCT {_SQUASH} AS name FROM part), s AS (SELECT DISTINCT substr(name, 1, CAST(7 + length(name) % 3 AS INT)) AS slug FROM n UNION SELECT DISTINCT name || 's' FROM n),
 m AS (SELECT name, slug, CASE WHEN name = slug THEN 1 ELSE 0 END AS same FROM n JOIN s ON name = slug OR (length(name) >= 6 AND length(slug) >= 6 AND (starts_with(name, slug) OR (starts_with(slug, name) AND length(slug) - length(name) <= 2))))
 SELECT name, slug, rank FROM (SELECT name, slug, row_number() OVER (PARTITION BY name ORDER BY same DESC, length(slug) DESC, slug) AS rank FROM m) WHERE rank <= 6""")
def prefix_lookup(spark, d):
    names = table(spark, d, "part").select(F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "").alias("name")).distinct()
    slugs = names.select(F.substring("name", F.lit(1), (7 + F.length("name") % 3).cast("int")).alias("slug")).union(names.select(F.concat("name", F.lit("s"))))
    return store.prefix_matches(names, slugs)


@query("per_group_first", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def per_group_first(spark, d):
    return ranking.first(table(spark, d, "documents").select("source", "doc_id", F.col("doc_id").alias("o")), "source", ["o"]).select("source", "doc_id")
