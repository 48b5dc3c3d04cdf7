"""Vocabularies, marks, signals, sightings and the order of the cascade, case by case."""

import random

import pytest
from pyspark.sql import functions as F

from rolesift.operators import gates, relevance
from rolesift.plans import profile


def scored(spark, rows):
    frame = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "id int, title string, body string")
    found = relevance.with_relevance(frame, "title", "body", {"a": profile.TRACK_A, "b": profile.TRACK_B}).orderBy("id").collect()
    return [(r.score_a, r.matched_a, r.score_b, r.matched_b) for r in found]


def test_scores_marks_and_titles(spark):
    rows = [
        ("Clerk", "Agentic agentic AGENTIC agentic"),  # three count
        (None, None),
        ("Manager", "Enable our marketers with tools."),
        ("Manager", "Help business users build and deploy AI agents themselves."),
        ("Manager", "Help non-technical users read reports."),
        ("Program Manager, AI and Gemini App Marketing", ""),
        ("AI Marketing Technologist Lead", ""),
        ("Clerk", "conversion rate"),  # stands in two groups of track b
        ("Growth Marketing Manager", "growth marketing"),
        ("Clerk", "Sellers"),
    ]
    got = scored(spark, rows)
    assert got[0][:2] == (15.0, ["agentic"])
    assert got[1] == (0.0, [], 0.0, [])
    assert got[2][:2] == (5.0, ["equips-marketers"])
    assert got[3][0] == 4.0 + 4.5 and set(got[3][1]) == {"ai agent", "teaches-nontechnical-to-build"}
    assert got[4][1] == []
    assert got[5][:2] == (4.0, ["title:ai+marketing"])
    assert got[6][0] == 12.0 and set(got[6][1]) == {"title:marketing technologist", "title:ai marketing"}
    assert got[7][2] == 7.5
    assert got[8][2] == 5.0 + 6.0 + 2.5
    assert got[9][:2] == (0.0, ["sales-context"])


def test_counts_match_str_count():
    r = random.Random(1)
    terms = ("aa", "aba", "ab", "b a", "aaa", "é", "abab")
    for _ in range(500):
        text = "".join(r.choices("ab é", k=r.randint(0, 40)))
        assert {terms[i]: n for i, n in relevance.counts_of(text, terms).items()} == {t: text.count(t) for t in terms if t in text}


@pytest.fixture(scope="module")
def signals(spark):
    rows = [
        ("Director - GTM Systems Architecture", "Operating-model and architecture design.", ""),
        ("Director, DTC Growth and Web Experience", "named specialism is growth and web", ""),
        ("Senior Director, Applied AI", "AI enablement shape, roadmap and governance", ""),
        ("Director, Global Campaigns", "a Director title in demand generation", ""),
        ("VP, Marketing", "vp seat", ""),
        ("Senior Manager, Web", "Senior Manager, real scope", ""),
        (None, None, None),
        ("Lead", "", "Paid search, paid search, PAID SEARCH"),
        ("Demand generation lead", "", "Paid search and webinars"),
        ("Web and media lead", "", "Paid search and webinars; A/B test, landing page"),
        ("Lead", "", "Shopify retail, B2B"),
        ("Lead", "", "Shopify only"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, title string, note string, body string")
    title, body = F.col("title"), F.col("body")
    return frame.select(
        "id",
        relevance.seniority_cap(title, F.col("note"), profile.SENIOR_TITLE, profile.CLAIMABLE, 3.5).alias("cap"),
        relevance.funnel_side(body, title, profile.CREATES, profile.CAPTURES, profile.CREATES_TITLE, profile.CAPTURES_TITLE).alias("side"),
        relevance.audience(F.concat_ws(" ", title, body), profile.B2B, profile.B2C).alias("audience"),
    ).orderBy("id").collect()


def test_seniority_cap(signals):
    assert [r.cap for r in signals][:7] == [3.5, None, None, 3.5, 3.5, None, None]


def test_funnel_side_counts_different_signals(signals):
    assert [r.side for r in signals][7:10] == ["capture_balanced", "campaign_creation_heavy", "capture_balanced"]


def test_audience(signals):
    assert [r.audience for r in signals][10:] == ["b2c_dtc_ecommerce", "b2b_other"]


def test_first_sightings(spark):
    rows = spark.createDataFrame([(1, "s", 5), (2, "s", 5), (3, "t", 5), (4, "s", 6), (5, None, 7)], "id int, source string, n int")
    log = spark.createDataFrame([(6, 80.0)], "n int, watched double")
    found = {r.id: (r.first_sighting, r.watched) for r in gates.with_sightings(rows, ["source", "n"], "id", log, ["n"]).where("source is not null").collect()}
    assert found == {1: (True, None), 2: (False, None), 3: (True, None), 4: (False, 80.0)}


def test_undated_stale_and_flags(spark):
    rows = [(1, None, True, None), (2, None, False, None), (3, 61.0, True, None), (4, 10.0, False, 80.0), (5, 50.0, False, 80.0), (6, 10.0, False, 75.0)]
    frame = spark.createDataFrame(rows, "id int, age double, first_sighting boolean, watched double")
    frame = frame.select("*", F.lit(None).cast("boolean").alias("skip"), F.lit("Lead").alias("role"), F.lit("Remote").alias("model"), F.lit("").alias("place"), F.lit(None).cast("int").alias("pay_max"), F.lit("").alias("demand"))
    found = {r.id: (r.reason, r.flags) for r in gates.early_gates(frame, gates.Profile(), 75.0).collect()}
    assert found == {1: (None, ["no_publish_date"]), 2: ("undated", []), 3: ("stale", []), 4: (None, ["evergreen_or_reposted"]), 5: (None, []), 6: (None, [])}


def test_cities_nearest_first_and_overlapping(spark):
    p = gates.Profile(cities={"San Francisco": 35, "South San Francisco": 27, "San": 50, "Belmont": 10, "Far": 90})
    rows = ["South San Francisco, CA", "Belmont, MA; Belmont, CA", "Belmont; San Francisco", "Far", None, "San / Belmont"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "id int, place string")
    found = [[c.city for c in r.c] for r in frame.select("id", gates.reachable_cities(F.col("place"), p).alias("c")).orderBy("id").collect()]
    # "San" is followed by a word that belongs to it in the first row; the first mention of Belmont decides in the second.
    assert found == [["South San Francisco", "San Francisco"], [], ["Belmont", "San Francisco"], [], [], ["Belmont", "San"]]
