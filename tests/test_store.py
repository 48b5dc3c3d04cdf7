"""The append-log store against a keyed store in SQLite that runs the same steps row by row."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from rolesift.operators import store


def test_fields_and_sightings(spark, tmp_path):
    schema = "posting_id long, seq long, seen_at int, run_id long, title string"
    log = [(1, 1, 10, 1, "a"), (2, 2, 11, 1, "b"), (1, 3, 12, 2, "a2")]
    for row in log:
        store.append(spark.createDataFrame([row], schema), str(tmp_path), "postings")
    got = {r.posting_id: (r.title, r.run_id, r.first_seen, r.last_seen, r.times_seen) for r in store.current(store.read_log(spark, str(tmp_path), "postings", schema)).collect()}
    assert got == {1: ("a2", 2, 10, 12, 2), 2: ("b", 1, 11, 11, 1)}
    wider = store.read_log(spark, str(tmp_path), "postings", schema + ", region string")
    assert wider.count() == 3 and wider.where("region is null").count() == 3
    assert store.read_log(spark, str(tmp_path), "none", schema).count() == 0


def test_states_match_a_keyed_store(spark):
    r = random.Random(1)
    kinds = [store.NEW, store.PREFILTERED, store.REJECTED, store.EVALUATED, *store.SUPPRESSED]
    events, want = [], {}
    for seq in range(4000):
        key, kind = r.randrange(300), r.choice(kinds[1:])
        at = want.get(key, store.NEW)
        if not (kind == store.EVALUATED and at in store.SUPPRESSED or kind == store.REJECTED and at not in (store.NEW, store.PREFILTERED, store.REJECTED)):
            want[key] = kind
        else:
            want.setdefault(key, at)
        events.append((key, seq, kind))
    r.shuffle(events)
    assert {x.posting_id: x.state for x in store.states(spark.createDataFrame(events, "posting_id long, seq long, state string")).collect()} == want


def test_backlog_matches_a_keyed_store(spark):
    con = sqlite3.connect(":memory:")
    con.execute("create table b (company text primary key, display text, first_seen int, last_seen int, times_seen int default 1, attempts int default 0)")
    r, log = random.Random(2), []
    for seq in range(1500):
        key, kind = f"c{r.randrange(60)}", r.choices(["seen", "tried", "cleared"], [5, 3, 1])[0]
        log.append((key, key.upper() + str(seq % 3), seq, seq, kind))
        if kind == "cleared":
            con.execute("delete from b where company = ?", (key,))
        else:
            grow = "times_seen = times_seen + 1" if kind == "seen" else "attempts = attempts + 1"
            con.execute(f"insert into b (company, display, first_seen, last_seen, attempts) values (?, ?, ?, ?, ?) on conflict (company) do update set last_seen = excluded.last_seen, {grow}", (key, log[-1][1], seq, seq, int(kind == "tried")))
    waiting = store.backlog(spark.createDataFrame(log, "company string, display string, seq long, at int, kind string")).cache()
    assert sorted(tuple(x) for x in waiting.collect()) == sorted(con.execute("select * from b"))
    want = con.execute("select display from b where attempts < 3 order by attempts, first_seen, times_seen desc, company limit 7").fetchall()
    assert [x.company for x in store.backlog_to_try(waiting, 7).collect()] == [x for (x,) in want]
    assert [x.company for x in store.backlog_exhausted(waiting).collect()] == [x for (x,) in con.execute("select display from b where attempts >= 3 order by company")]
    assert store.backlog_to_try(waiting, 0).count() == 0


@pytest.fixture(scope="module")
def judged(spark):
    r = random.Random(3)
    postings = [(i, f"f{i % 40}", f"co{i % 9}" if i % 10 else "", f"t{i % 5}", r.choice(["evaluated", "presented", "saved", "applied", "new"]), r.random() < 0.8, r.choice("ab")) for i in range(120)]
    evaluations = [(k, r.randrange(130), k % 4, r.choice(["x", "y"]), r.choice(["r1", "r2"]), round(1 + 4 * r.random(), 3), r.choice(["PASS", "FLAG", "FAIL"])) for k in range(300)]
    verdicts = [(k, r.randrange(120), r.choice(store.VERDICTS), "why", f"2024-01-{1 + k % 28:02d} 00:00:00") for k in range(90)]
    con = sqlite3.connect(":memory:")
    for name, columns, rows in (("p", "posting_id, fingerprint, company_key, title, state, is_live, bucket", postings), ("e", "eval_id, posting_id, run_id, track, rubric, score, verdict", evaluations), ("v", "verdict_id, posting_id, verdict, reason, created_at", verdicts)):
        con.execute(f"create table {name} ({columns})")
        con.executemany(f"insert into {name} values ({','.join('?' * len(rows[0]))})", rows)
    return (
        con,
        spark.createDataFrame(postings, "posting_id long, fingerprint string, company_key string, title string, state string, is_live boolean, bucket string"),
        spark.createDataFrame(evaluations, "eval_id long, posting_id long, run_id long, track string, rubric string, score double, verdict string"),
        spark.createDataFrame(verdicts, "verdict_id long, posting_id long, verdict string, reason string, created_at string"),
    )


LAST = "(select eval_id from e where e.posting_id = p.posting_id order by eval_id desc limit 1)"


def test_reports_match_sql(judged):
    con, p, e, v = judged
    base = f"from p join e on e.eval_id = {LAST} where state = 'evaluated' and is_live and e.verdict <> 'FAIL'"
    ids = lambda sql: [x for (x,) in con.execute(sql)]
    got = lambda frame: [r.posting_id for r in frame.collect()]
    assert got(store.presentable(p, e, 3.0)) == ids(f"select p.posting_id {base} and score >= 3 order by score desc, p.posting_id")
    assert got(store.presentable(p, e, 3.0, bucket="a", floor=2.0, limit=3)) == ids(f"select p.posting_id {base} and score < 3 and score >= 2 and bucket = 'a' order by score desc, p.posting_id limit 3")
    assert sorted(r.fingerprint for r in store.suppressed_keys(p).collect()) == sorted(ids("select distinct fingerprint from p where state not in ('evaluated', 'new')"))
    assert sorted(r.fingerprint for r in store.already_evaluated(p, e, "r1").collect()) == sorted(ids("select distinct fingerprint from p join e using (posting_id) where rubric = 'r1'"))
    for only in (None, "applied"):
        want = con.execute(f"select p.posting_id, score, v.verdict, v.created_at from p left join e on e.eval_id = {LAST} left join v on v.verdict_id = (select verdict_id from v where v.posting_id = p.posting_id and {'1' if only is None else 'verdict = ' + repr(only)} order by verdict_id desc limit 1)")
        assert sorted(map(str, ((r.posting_id, r.score, r.judged, r.created_at) for r in store.with_judgement(p, e, v, only).collect()))) == sorted(map(str, want))


def test_prior_applications(judged):
    con, p, _, v = judged
    want = {}
    for company, at, title in con.execute("select company_key, created_at, title from p join v using (posting_id) where verdict = 'applied' and company_key <> '' order by created_at desc, title desc"):
        if (at[:10], title) not in want.setdefault(company, []):
            want[company].append((at[:10], title))
    assert {r.company_key: [(x.day, x.title) for x in r.applications] for r in store.prior_applications(p, v).collect()} == want


def test_nudges_replace_each_other(spark):
    e = spark.createDataFrame([(1, 3.9), (2, 4.95), (3, 2.0)], "eval_id long, score double")
    n = spark.createDataFrame([(1, 1, 0.1, "n", ["q"]), (1, 2, -0.05, "m", ["q"]), (2, 1, 0.15, "o", [])], "eval_id long, seq long, adjustment double, note string, quotes array<string>")
    assert {r.eval_id: (r.final, r.adjustment) for r in store.nudged(e, n).collect()} == {1: (3.85, -0.05), 2: (5.0, 0.15), 3: (2.0, None)}


def test_nudges_are_refused_with_reasons(spark):
    body = "We need someone who has run\n large systems for years. You will own the whole pipeline end to end."
    a, b = "someone who has run large systems", "own the whole pipeline END to end"
    rows = [(0.1, [a, b], 3.9, []), (0.2, [a, b], 3.9, ["too large"]), (0.1, [a, "short"], 3.9, ["too few quotes"]), (0.1, [a, b + " and more of it"], 3.9, ["quote not in the posting"]), (0.1, [a, b], 3.5, ["outside the band"]), (0.1, None, None, ["outside the band", "too few quotes"])]
    frame = spark.createDataFrame([(i, *r[:3], body) for i, r in enumerate(rows)], "i int, adj double, quotes array<string>, base double, body string")
    got = frame.select("i", store.nudge_problems(F.col("adj"), F.col("quotes"), F.col("body"), F.col("base"), F.lit(3.85)).alias("p")).orderBy("i").collect()
    assert [r.p for r in got] == [r[3] for r in rows]


def test_rubric_score(spark):
    rows = [({"a": 4.0, "b": 2.0}, {"A": 'says "x"'}, 0.0, False, 3.333), ({"a": 4.0, "b": 2.0}, {"A": "plain"}, 0.0, False, 2.667), ({"a": 4.0, "b": None}, {"A": "it's"}, 0.0, False, 4.0), ({"a": 4.0}, {}, 0.0, False, None), ({"a": 1.0, "b": 1.0}, {}, -0.5, False, 1.0), ({"a": 5.0, "b": 5.0}, {"A": '"'}, 0.0, True, 5.0)]
    frame = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, s map<string,double>, n map<string,string>, m double, c boolean")
    got = frame.select("i", store.rubric_score(F.col("s"), F.col("n"), {"a": 2.0, "b": 1.0}, evidence=("A",), blocks={"a": "A", "b": "D"}, modifier=F.col("m"), connected=F.col("c")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [r[4] for r in rows]


def test_prefix_matches(spark):
    names = spark.createDataFrame([("lanternsoftware",), ("zipper",), ("quarks",), ("ab",), ("",)], "name string")
    slugs = spark.createDataFrame([("lantern",), ("lanterns",), ("zippers",), ("zipperette",), ("quarks",), ("ab",), ("abc",), ("lanternsoftwareinc",)], "slug string")
    got = sorted((r.name, r.rank, r.slug) for r in store.prefix_matches(names, slugs).collect())
    assert got == [("ab", 1, "ab"), ("lanternsoftware", 1, "lanterns"), ("lanternsoftware", 2, "lantern"), ("quarks", 1, "quarks"), ("zipper", 1, "zippers")]
    assert len(store.slug_guesses(spark.createDataFrame([("Acme Blue, Inc",)], "name string"), ["x", "y"]).collect()) == 6


def test_cities_nearest_first(spark):
    cities = spark.createDataFrame([("Oak Park", 30), ("Elm", 10), ("Far", 90)], "city string, minutes int")
    rows = spark.createDataFrame([(1, "Offices in oak park, Far and Elm."), (2, "Elmwood"), (3, None)], "posting_id long, body string")
    got = {r.posting_id: r.cities for r in store.cities_in(rows, cities, "body", most=60).collect()}
    assert got[1] == ["Elm", "Oak Park"] and not got[2] and not got[3]


def test_runs_and_latest(spark):
    log = spark.createDataFrame([(1, 1, "scan", None), (1, 2, None, 40), (2, 3, "watch", None)], "run_id long, seq long, mode string, raw long")
    rows = store.runs(log)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "scan", 40), (2, "watch", None)]
    assert store.latest_run(rows).first().run_id == 2 and store.latest_run(rows, "scan").first().run_id == 1
