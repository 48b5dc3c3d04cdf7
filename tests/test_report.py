"""Report fields, boards of names, snapshots of logs and refreshed texts on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rolesift.functions import links
from rolesift.operators import report, store


def value(spark, column, **fields):
    row = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*(F.lit(x) for x in v)).alias(k) for k, v in fields.items()))
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("low, high, want", [(90000, 120000, "$90,000 - $120,000"), (5, 5, "$5"), (7000, None, "$7,000"), (None, 8000, "$8,000"), (None, None, "Not listed")])
def test_pay(spark, low, high, want):
    rows = spark.createDataFrame([(low, high)], "low int, high int")
    assert rows.select(report.pay_field("low", "high")).first()[0] == want


def test_posted(spark):
    day = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(day,), (None,), (day - dt.timedelta(hours=12),)], "at timestamp")
    assert [r[0] for r in rows.select(report.posted_field("at", F.lit("2024-01-04"))).collect()] == ["2024-01-01 (3 days ago)", "Not stated", "2023-12-31 (4 days ago)"]


def test_company_and_reseller(spark):
    seller = report.is_reseller("slug", [" Hirely ", ""])
    assert value(spark, report.company_field("name", seller), slug="HIRELY:a:b", name=" Acme ") == "Acme (job board - actual employer not named)"
    assert value(spark, report.company_field("name", seller), slug="hirelyx", name="") == "Not stated"
    assert value(spark, report.is_reseller(F.lit(None).cast("string"), ["x"])) is False


def test_stack(spark):
    line = report.stack_line("body", F.col("seller"), ["Slack", "C++", "Gong", "Seismic"])
    assert value(spark, line, body="slack, Gong and SLACK; Seismic, slackers", seller=True) == "Stack named in the posting: Gong, Seismic, slack - use this to work out who is actually hiring"
    assert value(spark, line, body="slack and Gong, Slack", seller=True) is None
    assert value(spark, line, body="slack Gong Seismic", seller=False) is None
    assert value(spark, report.stack_line("body", F.lit(True), []), body="x") is None


def test_flags_and_nudges(spark):
    assert value(spark, report.flag_line("v", "f"), v="FLAG", f=["a", "b"]) == "⚠ Legitimacy flag: a; b"
    assert value(spark, report.flag_line("v", F.array().cast("array<string>")), v="FLAG") == "⚠ Legitimacy flag: see run report"
    assert value(spark, report.flag_line("v", "f"), v="PASS", f=["a"]) is None
    assert value(spark, report.nudge_line("a", "n"), a=0.1, n="").endswith("moved it +0.10 after reading the full posting")
    assert value(spark, report.nudge_line("a", "n"), a=-0.15, n=" why ").endswith("-0.15 after reading the full posting - why")
    assert value(spark, report.nudge_line("a", "n"), a=0.0, n="x") is None


def test_commute(spark):
    minutes, bands = {"Old Town": 25, "Far": 90}, [(20.0, 5.0), (40.0, 4.0)]
    way = lambda city, model: tuple(value(spark, report.commute("c", "m", minutes, bands), c=city, m=model))
    assert [way(" old town", "Hybrid"), way("Far", "On-site"), way("Nowhere", "Hybrid"), way("Far", "Remote")] == [(25, 4.0, True), (90, 1.0, True), (None, 3.0, False), (0, 5.0, True)]
    assert [value(spark, report.too_far("c", "m", minutes, 60), c=c, m=m) for c, m in (("Far", "On-site"), ("Far", "Remote"), ("Nowhere", "On-site"), ("Old Town", "Hybrid"))] == [True, False, False, False]
    assert value(spark, report.commute_line(F.lit(None).cast("string"), "p", "m", minutes, "home"), p="Bay", m="Hybrid") == "Estimated Commute: unknown for Bay"


def test_lines_under_the_bar(spark):
    way = report.commute("c", "m", {"x": 25}, [(40.0, 4.0)])
    line = report.worth_knowing_line("s", "t", "co", F.lit(True), "m", way, F.lit(dt.date(2024, 1, 2)), "u", "fit")
    assert value(spark, line, s=3.9, t="Lead", co="Acme", m="Hybrid", c="X", u="http://a", fit="Good fit. More.") == "  - 3.90  Lead @ Acme (job board, employer not named)  [Hybrid 25 min, posted 2024-01-02]\n      http://a\n      Good fit."
    assert value(spark, report.near_miss_line("co", "n", "b", "t"), co="Acme", n=3, b=3.75, t="Lead") in ("  - Acme - 3 role(s) evaluated, best was 3.8 (Lead)",)


def test_siblings_and_applications(spark):
    rows = spark.createDataFrame([(1, "Acme Inc", "a", 1), (2, "ACME", "b", 2), (3, "Acme", "c", 3), (4, "Other", "d", 4), (5, None, "e", 5)], "posting_id long, company string, title string, place int")
    got = {r.posting_id: r.also_hiring for r in report.siblings_line(rows).collect()}
    assert got == {1: 'Also in this report from Acme Inc: "b"; "c" - read all before applying', 2: 'Also in this report from ACME: "a"; "c" - read all before applying', 3: 'Also in this report from Acme: "a"; "b" - read all before applying', 4: None, 5: None}
    past = spark.createDataFrame([("acme", [("2024-01-0%d" % n, t) for n, t in zip((5, 4, 3, 2, 1), "abcde")])], "company_key string, applications array<struct<day string, title string>>")
    told = {r.posting_id: r.already_applied for r in report.applied_line(rows, past).collect()}
    assert told[1] == 'Already applied at Acme Inc: "b" on 2024-01-04; "c" on 2024-01-03; "d" on 2024-01-02 (+1 more)' and told[4] is None


def test_snapshots(spark, tmp_path):
    schema, root = "posting_id long, seq long, seen_at int, title string", str(tmp_path)
    add = lambda *rows: store.append(spark.createDataFrame(rows, schema), root, "postings")
    now = lambda: {tuple(r) for r in store.current_of(spark, root, "postings", schema).collect()}
    whole = lambda: {tuple(r) for r in store.current(store.read_log(spark, root, "postings", schema)).collect()}
    store.snapshot(spark, root, "postings", schema)
    assert now() == set()
    add((1, 1, 10, "a"), (2, 2, 11, "b"), (1, 3, 12, None))
    store.snapshot(spark, root, "postings", schema)
    assert now() == whole() == {(1, None, 10, 12, 2), (2, "b", 11, 11, 1)}
    add((2, 4, 9, "b2"), (3, 5, 20, "c"))
    assert now() == whole() and len(now()) == 3
    # A snapshot that was cut off: rows are there, the mark of success isn't.
    spark.createDataFrame([(9, 5, "x", 1, 1, 1)], "posting_id long, seq long, title string, first_seen int, last_seen int, times_seen long").write.parquet(f"{root}/_snapshots/postings/5")
    (tmp_path / "_snapshots/postings/5/_SUCCESS").unlink()
    assert now() == whole()
    store.snapshot(spark, root, "postings", schema)
    store.snapshot(spark, root, "postings", schema)
    assert now() == whole()


def test_refreshed(spark):
    schema = "posting_id long, description string, title string"
    saved = spark.createDataFrame([(1, "same ", "a"), (2, "old", "b"), (3, "gone", "c"), (4, "emptied", "d"), (5, None, "e")], schema)
    live = spark.createDataFrame([(1, "\nsame", ""), (2, "new", ""), (4, "", ""), (5, "now", ""), (6, "other", "")], schema)
    got = {r.posting_id: (r.description, r.title, r.status, r.is_live) for r in store.refreshed(saved, live).collect()}
    assert got == {1: ("same ", "a", "same as saved", True), 2: ("new", "b", "UPDATED", True), 3: ("gone", "c", "TAKEN DOWN", False), 4: ("emptied", "d", "TAKEN DOWN", False), 5: ("now", "e", "UPDATED", True)}
    assert store.live_status(saved, live).where("status = 'not saved'").first().posting_id == 6


def test_boards_of_names(spark):
    boards = spark.createDataFrame([("lever", "guide-wire"), ("workday", "guidewire|wd5|External"), ("workday", "broken|x"), ("ashby", "ziplines"), ("ashby", "qualysoft"), ("lever", "gui")], "board string, slug string")
    names = spark.createDataFrame([("guidewiresoftware",), ("zipline",), ("qualys",), ("gui",), ("",)], "name string")
    got = sorted((r.name, r["rank"], r.board, r.slug) for r in store.board_matches(names, store.slug_index(boards)).collect())
    assert got == [("gui", 1, "lever", "gui"), ("guidewiresoftware", 1, "lever", "guide-wire"), ("guidewiresoftware", 2, "workday", "guidewire:wd5:External"), ("zipline", 1, "ashby", "ziplines")]


def test_best_board(spark):
    hits = spark.createDataFrame([("a", "lever", "x", False, 0, 0), ("a", "ashby", "y", True, 1, 1), ("a", "lever", "z", True, 1, 0), ("b", "lever", "q", False, 0, 0)], "name string, board string, slug string, verified boolean, slug_rank int, board_rank int")
    got = {r.name: (r.board, r.slug, r.status, r.also_live) for r in store.best_board(hits).collect()}
    assert got == {"a": ("lever", "z", "live", "ashby/y, lever/x"), "b": ("lever", "q", "unverified", "")}


@pytest.mark.parametrize(
    "company, board, declared, body, want",
    [
        ("Gong", "lever", None, "apply at https://x/gong/1 now", False),
        ("Gong", "lever", None, "About Gong: we", True),
        ("Weights & Biases", "lever", None, "the weight-s team", True),
        ("Acme", "smartrecruiters", "Acme Corp", "", True),
        ("Acme", "smartrecruiters", "Other", "acme", False),
        ("Acme", "apple", None, None, True),
        ("", "lever", None, None, True),
        ("Acme", "lever", None, None, False),
    ],
)
def test_names_company(spark, company, board, declared, body, want):
    row = spark.createDataFrame([(company, board, declared, body)], "company string, board string, declared string, body string")
    assert row.select(store.names_company(*(F.col(c) for c in row.columns))).first()[0] is want


def test_board_links(spark):
    page = "job-boards.greenhouse.io/acme jobs.lever.co/A jobs.lever.co/Acme jobs.lever.co/acme/1 https://x.WD3.myworkdayjobs.com/Site_A careers.smartrecruiters.com/Big jobs.workable.com/api apply.workable.com/w-1 jobs.ashbyhq.com/q"
    rows = spark.createDataFrame([(page,), (None,)], "html string").select(links.board_links("html").alias("l")).collect()
    assert [tuple(x) for x in rows[0].l] == [("greenhouse", "acme"), ("lever", "acme"), ("smartrecruiters", "big"), ("workable", "w-1"), ("workday", "x:wd3:Site_A")] and rows[1].l == []
