"""Archives, worksheets and screening once more on small cases."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from rolesift.operators import archive, store, worksheet

FIELDS = "posting_id bigint, title string, company string, published timestamp, city string, location_raw string, work_model string, salary_min int, salary_max int, url string, description string"
BODY = "About us\nWe sell.\nResponsibilities\n- Run it\nRequirements\n- Know it"


def postings(spark, *rows):
    return spark.createDataFrame([(i, title, company, dt.datetime(2024, 1, 2), None, "Bay, Hybrid", "hybrid", 90000, None, f"u/{i}", body) for i, title, company, body in rows], FIELDS)


def applied(spark, rows, days):
    verdicts = spark.createDataFrame([(n, i, "applied", why, at) for n, (i, at, why) in enumerate(days)], "verdict_id long, posting_id long, verdict string, reason string, created_at timestamp")
    scores = spark.createDataFrame([(1, 7, 3.25, 0.0, ""), (2, 1, 4.12, 1.0, " Good \n")], "eval_id long, posting_id long, score double, connection_bonus double, fit_summary string")
    return archive.applications(rows, verdicts, scores)


def test_files(spark, tmp_path):
    path, day = str(tmp_path / "archive"), dt.datetime(2024, 3, 1)
    first = postings(spark, (1, "Lead, Web & CRO", "Acme Inc.", BODY), (2, "Lead - Web  CRO", "ACME, Inc", ""), (3, "Engineer 2", None, "Some words."))
    archive.archive(applied(spark, first, [(1, day, "why"), (2, day, None), (3, None, "")]), path)
    assert sorted(os.listdir(path)) == ["2024-03-01-acme-inc-lead-web-cro-2.md", "2024-03-01-acme-inc-lead-web-cro.md", "unknown-role-engineer-2-1.md"]
    text = (tmp_path / "archive" / "2024-03-01-acme-inc-lead-web-cro.md").read_text()
    assert text.startswith("# Lead, Web & CRO - Acme Inc.\n\n- **Applied:** 2024-03-01\n- **Posted:** 2024-01-02\n- **Score:** 4.1 (includes +1.0 connection bump)\n- **Location:** Bay, Hybrid\n- **Salary:** $90,000\n- **Posting:** u/1\n- **Why I applied:** why\n\n> The posting")
    assert text.endswith("## Requirements / qualifications (verbatim)\n\n- Know it\n\n## Fit summary at time of scan\n\nGood\n")
    assert "## What this job asks you to do (verbatim)\n\n- Run it\n" in text and "_Posting id 1._" in text
    # Again with a changed text, and a new posting of the same name: names stay.
    more = postings(spark, (1, "Lead, Web & CRO", "Acme Inc.", "Other words."), (9, "lead web cro", "acme inc", "New."))
    archive.archive(applied(spark, more, [(1, day, None), (9, day, None)]), path)
    files = {r.posting_id: r for r in archive.read(spark, path).collect()}
    assert {i: r.name for i, r in files.items()} == {1: "2024-03-01-acme-inc-lead-web-cro", 2: "2024-03-01-acme-inc-lead-web-cro-2", 3: "unknown-role-engineer-2-1", 9: "2024-03-01-acme-inc-lead-web-cro-3"}
    assert "Other words." in files[1].file and "no description stored" in files[2].file
    assert [r.line for r in archive.index_lines(archive.read(spark, path)).collect()] == [
        "- unknown - [Engineer 2 -](unknown-role-engineer-2-1.md)",
        "- 2024-03-01 - [lead web cro - acme inc](2024-03-01-acme-inc-lead-web-cro-3.md)",
        "- 2024-03-01 - [Lead, Web & CRO - Acme Inc.](2024-03-01-acme-inc-lead-web-cro.md) - scored 4.1",
        "- 2024-03-01 - [Lead - Web  CRO - ACME, Inc](2024-03-01-acme-inc-lead-web-cro-2.md)",
    ]


def test_repeated_write_leaves_the_same_files(spark, tmp_path):
    path = str(tmp_path / "archive")
    rows = spark.range(200).select(F.concat(F.lit("n"), F.col("id")).alias("name"), F.repeat(F.lit("é\n"), F.col("id").cast("int")).alias("file")).repartition(7)
    for _ in range(2):
        archive.write(rows, path)
    assert len(os.listdir(path)) == 200 and (tmp_path / "archive" / "n3.md").read_text() == "é\né\né\n"
    assert archive.read(spark, str(tmp_path / "none")).count() == 0


def test_names_never_meet(spark):
    """One base has most rows; bases that end in numbers look like numbered ones."""
    rows = spark.range(3000).select(F.col("id").alias("posting_id"), F.when(F.col("id") % 10 > 0, "a-role").when(F.col("id") % 20 == 0, "a-role-2").otherwise("a-role-2-1").alias("base"))
    early = archive.named(rows.where("posting_id < 1000"), spread=8)
    late = archive.named(rows, early.select("posting_id", "name"), spread=8).collect()
    names = {r.posting_id: r.name for r in late}
    assert len(late) == len(set(names.values())) == 3000
    assert all(names[r.posting_id] == r.name for r in early.collect())
    assert {"a-role", "a-role-2", "a-role-2700", "a-role-2-1", "a-role-2-150", "a-role-2-1-1", "a-role-2-1-150"} <= set(names.values()) and "a-role-2701" not in names.values()


@pytest.mark.parametrize("n", [0, 23999, 24000, 24001, 60000])
def test_shortened(spark, n):
    body = ("0123456789" * 6000)[:n]
    got = spark.range(1).select(worksheet.shortened(F.lit(f" \n{body}\t"))).first()[0]
    assert got == (body if n <= 24000 else body[:18000] + f"\n\n[...{n - 24000:,} characters omitted from the middle...]\n\n" + body[-6000:])


def test_pay_and_answers(spark):
    rows = spark.createDataFrame([(1, 100000, 150005, True, "x"), (2, None, None, True, "y"), (3, 90000, None, None, None)], "posting_id long, low int, high int, equity boolean, bucket string")
    assert [r[0] for r in rows.orderBy("posting_id").select(worksheet.pay_line("low", "high", "equity")).collect()] == [
        "$100,000 - $150,005  ->  modeled: base $150,005 + bonus $15,000 + equity $35,000 = TC $200,005",
        "not listed",
        "$90,000  ->  modeled: base $90,000 + bonus $9,000 + equity $0 = TC $99,000",
    ]
    named = rows.withColumns({"company": F.lit('A "B"'), "title": F.lit(None).cast("string")})
    got = {r.posting_id: json.loads(r.answer) for r in worksheet.answers(named, {"x": "ai"}).collect()}
    assert got[1] == {"posting_id": 1, "company": 'A "B"', "title": None, "track": "ai", "bucket": "x", "dimension_scores": {}, "block_notes": {}, "block_g_verdict": "PASS", "block_g_flags": [], "fit_summary": ""}
    assert got[2]["track"] is None and got[3]["bucket"] is None


def test_screening_once_more(spark):
    on_record = spark.createDataFrame([(1, "new", None), (2, "new", None), (3, "evaluated", "a"), (4, "presented", None), (5, "evaluated", "a"), (6, "applied", "a"), (7, "evaluated", "b")], "posting_id long, state string, tracks string")
    outcomes = spark.createDataFrame([(1, None, "a", 4.0), (2, "stale", "", None), (3, None, "b", 1.0), (4, None, "a,b", 1.0), (5, "too_far", "", None), (6, None, "b", 1.0), (7, None, "b", 1.0)], "posting_id long, reason string, tracks string, score double")
    assert sorted(tuple(r) for r in store.screening_events(on_record, outcomes).collect()) == [(1, "prefiltered", "relevance 4.0", "a"), (2, "rejected_prefilter", "stale", None)]
    assert sorted(tuple(r) for r in store.moved_tracks(on_record, outcomes).collect()) == [(3, "a", "b"), (4, "", "a,b")]
