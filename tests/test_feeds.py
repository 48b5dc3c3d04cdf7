"""Feed adapters over invented payloads, and the scalars that they share."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from rolesift.functions import location, text
from rolesift.sources import feeds

PLACES = [
    ("US-CA-Menlo Park", ("Menlo Park", "CA", "United States")), ("GB-London", ("London", None, "United Kingdom")), ("Bellevue, Washington; Chicago, Illinois;", ("Bellevue", "WA", "United States")),
    ("United States, San Mateo, CA", ("San Mateo", "CA", "United States")), ("United States - California - Foster City", ("Foster City", "CA", "United States")), ("US, CA, Santa Clara", ("Santa Clara", "CA", "United States")),
    ("Remote - Austin, TX", ("Austin", "TX", "United States")), ("Remote", (None, None, None)), ("Remote - USA", (None, None, "United States")), ("Hybrid: sf", ("San Francisco", None, None)), ("new york", (None, "NY", "United States")),
    ("US / Canada", (None, None, "Canada")), ("Singapore", (None, None, "Singapore")), ("Oregon, WI", ("Oregon, WI".split(",")[0], None, None)), ("", (None, None, None)), (None, (None, None, None)), ("Paris, France", ("Paris", None, "France")), ("United States", (None, None, "United States")),
]


def test_places(spark):
    rows = spark.createDataFrame([(i, written) for i, (written, _) in enumerate(PLACES)], "i int, written string")
    got = {r.i: tuple(r.place) for r in location.with_place(rows, "written").collect()}
    assert [(PLACES[i], got[i]) for i in sorted(got) if got[i] != PLACES[i][1]] == []


def test_based(spark):
    body = "This role may travel to hub cities including Dallas; however will be based out of Elm or Oak. We visit offices located in Rome as needed. Reporting to our Ash office."
    rows = spark.createDataFrame([(1, body), (2, None)], "i int, body string")
    got = {r.i: r.c for r in rows.select("i", location.based_at("body").alias("c")).collect()}
    assert [x.strip() for x in got[1]] == ["will be based out of Elm or Oak", "Reporting to our Ash office"]
    assert got[2] == []


def test_scalars(spark):
    rows = spark.createDataFrame([("Acme Labs, Inc.", "Engineer (Remote) - Full-time", "<p>A &lt;b&gt;</p><script>x</script>one<br/>two<ul><li>three</li></ul>&mdash;"), (None, None, None), ("Inc", "New", "")], "c string, t string, m string")
    got = rows.select(text.company_name("c").alias("name"), text.company_key("c").alias("key"), text.title_name("t").alias("title"), text.html_text("m").alias("plain"), text.cleaned("c").alias("clean")).collect()
    assert tuple(got[0]) == ("acme", "acmelabs", "engineer", "A <b>\n one\ntwo - three\n —", "Acme Labs, Inc.")
    assert tuple(got[1]) == ("", "", "", "", "") and tuple(got[2])[:3] == ("", "", "")
    assert rows.select(text.repaired(F.lit("100â€“200")).alias("t")).first().t == "100–200"


def test_clone_keys(spark):
    body = "This position is listed on behalf of a partner company. They are looking for people based in {} This is a role for builders. You will build."
    rows = spark.createDataFrame([("Acme", "Dev", body.format(x)) for x in ("Chile", "Costa Rica")] + [("Acme", "Dev", "You will build.")], "c string, t string, b string")
    keys = [r.k for r in rows.select(text.clone_key("c", "t", "b").alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]


def landed(spark, payload, slug="acme"):
    return spark.createDataFrame([("Acme", slug, payload if isinstance(payload, str) else json.dumps(payload)), ("Bad", "bad", "no json"), ("Bad", "none", "{}")], "company string, slug string, payload string")


def one(frame):
    assert frame.columns == feeds.COLUMNS
    [row] = frame.collect()
    return row


def test_greenhouse(spark):
    job = {"id": 7, "title": " Dev ", "absolute_url": "https://x/7", "content": "&lt;p&gt;Build &amp;amp; run. Stock options and bonus.&lt;/p&gt;", "location": {"name": "US-CA-Menlo Park"}, "metadata": [{"name": "Level", "value": ["L4", "L5"]}, {"name": "None", "value": None}], "pay_input_ranges": [{"min_cents": 12000000, "max_cents": 15000000}, {"min_cents": 11000000, "max_cents": None}], "updated_at": "2024-01-05T10:00:00Z", "departments": [{"name": "Eng"}], "offices": []}
    r = one(feeds.greenhouse(landed(spark, {"jobs": [job]})))
    assert (r.source_id, r.title, r.city, r.region, r.salary_min, r.salary_max, r.salary_raw, r.department, r.team) == ("7", "Dev", "Menlo Park", "CA", 110000, 150000, "Level: L4, L5", "Eng", None)
    assert r.description == "Build & run. Stock options and bonus." and r.equity_mentioned and r.bonus_mentioned and r.published_at == datetime(2024, 1, 5, 10) and r.date_confidence == "high"


def test_ashby(spark):
    job = {"id": "a", "title": "Dev", "jobUrl": "https://x/a", "isRemote": True, "workplaceType": "Remote", "location": "", "address": {"postalAddress": {"addressLocality": "Elm", "addressRegion": "OR", "addressCountry": "US"}}, "descriptionHtml": "<p>Body</p>", "compensation": {"compensationTierSummary": "$136K – $204K • Offers Equity"}}
    r = one(feeds.ashby(landed(spark, {"jobs": [job, {**job, "id": "b", "isListed": False}]})))
    assert (r.source_id, r.apply_url, r.city, r.region, r.work_model, r.is_remote, r.salary_min, r.salary_max, r.date_confidence) == ("a", "https://x/a", "Elm", "OR", "Remote", True, 136000, 204000, "none")


def test_lever(spark):
    job = {"id": "l", "text": "Dev", "hostedUrl": "https://x/l", "createdAt": 1704067200000, "descriptionPlain": "Plain.", "additional": "<p>More</p>", "lists": [{"text": "Needs", "content": "<li>one</li><li>two</li>"}, {"text": "Empty", "content": ""}], "categories": {"location": "Austin, TX", "commitment": "Full-time"}, "salaryRange": {"min": 100000, "max": 120000}, "workplaceType": "hybrid"}
    r = one(feeds.lever(landed(spark, [job]).where("slug = 'acme'")))
    assert (r.city, r.work_model, r.salary_min, r.salary_max, r.employment_type, r.published_at) == ("Austin", "Hybrid", 100000, 120000, "Full-time", datetime(2024, 1, 1))
    assert r.description.startswith("Plain.\n\nMore\n\nNeeds\n") and "- one" in r.description and "Empty" not in r.description


def test_smartrecruiters(spark):
    job = {"id": "s1", "name": "Dev", "releasedDate": "2024-02-01T00:00:00.000Z", "location": {"city": "Elm", "region": "OR", "country": "us", "remote": False}, "function": {"label": "IT"}}
    details = spark.createDataFrame([("acme", "s1", json.dumps({"applyUrl": "https://x/s1", "jobAd": {"sections": {"jobDescription": {"text": "<p>Do</p>"}, "qualifications": {"text": "Know"}}}}))], "slug string, posting_id string, payload string")
    rows = landed(spark, {"totalFound": 2, "content": [job, {**job, "id": "s2"}]})
    a, b = sorted(feeds.smartrecruiters(rows, details).collect(), key=lambda r: r.source_id)
    assert (a.description, a.url, a.team, a.city, a.region) == ("Do\n\nKnow", "https://x/s1", "IT", "Elm", "OR") and (b.description, b.url) == ("", "https://jobs.smartrecruiters.com/acme/s2")
    assert {r.slug: r.total for r in feeds.total_found(rows).collect()} == {"acme": 2, "bad": None, "none": None}


def test_workable(spark):
    jobs = [{"shortcode": "w1", "title": "Dev", "url": "https://x/w", "location": {"city": "Elm", "country": "Canada"}, "telecommuting": True, "description": "<p>Do</p>", "benefits": "Tea", "published_on": "2024-03-01"}, {"id": 2, "title": "Ops", "application_url": "https://x/o", "location": "Oak, TX", "description": "In-office."}]
    a, b = sorted(feeds.workable(landed(spark, {"jobs": jobs})).collect(), key=lambda r: r.title)
    assert (a.source_id, a.city, a.country, a.work_model, a.is_remote, a.description) == ("w1", "Elm", "Canada", "Remote", True, "Do\n\nTea")
    assert (b.source_id, b.url, b.apply_url, b.city, b.region, b.work_model) == ("2", "https://x/o", "https://x/o", "Oak", "TX", "On-site")


def test_workday(spark):
    jobs = [{"title": "Dev", "externalPath": "/job/Elm/Dev_R1", "locationsText": "2 places", "postedOn": "Posted 5 Days Ago", "bulletFields": ["R-1"]}, {"title": "Ops", "externalPath": "/job/Oak/Ops_R2", "locationsText": "Oak, TX", "postedOn": "Posted Today"}, {"title": "Old", "externalPath": "/job/o/R3", "postedOn": "Posted Long Ago"}]
    details = spark.createDataFrame([("t:wd1:site", "/job/Elm/Dev_R1", json.dumps({"jobPostingInfo": {"jobDescription": "<p>Pay $100,000 - $120,000</p>", "location": "US-CA-Menlo Park", "remoteType": "Hybrid", "timeType": "Full time"}}))], "slug string, posting_id string, payload string")
    frame = feeds.workday(landed(spark, {"jobPostings": jobs}, "t:wd1:site"), details, "2024-03-10 12:00:00")
    assert frame.columns == feeds.COLUMNS
    a, c, b = sorted(frame.collect(), key=lambda r: r.title)
    assert (a.source_id, a.url, a.city, a.work_model, a.employment_type, a.salary_min, a.published_at) == ("R-1", "https://t.wd1.myworkdayjobs.com/site/job/Elm/Dev_R1", "Menlo Park", "Hybrid", "Full time", 100000, datetime(2024, 3, 5, 12))
    assert (b.source_id, b.city, b.published_at, b.date_confidence) == ("Ops_R2", "Oak", datetime(2024, 3, 10, 12), "high")
    assert (c.title, c.published_at, c.date_confidence) == ("Old", None, "none")
    got = spark.createDataFrame([("t:wd1:site",), ("t:site",), (None,)], "slug string").select(feeds.workday_address("slug").alias("a"), feeds.workday_address("slug", "workday_detail", "job/x").alias("b")).collect()
    assert [tuple(r) for r in got] == [("https://t.wd1.myworkdayjobs.com/wday/cxs/t/site/jobs", "https://t.wd1.myworkdayjobs.com/wday/cxs/t/site/job/x"), ("", ""), ("", "")]


def test_eightfold(spark):
    jobs = [{"id": 5, "displayJobId": "J5", "name": "Dev", "standardizedLocations": ["Austin, TX, US"], "postedTs": 1704067200}, {"id": 6, "name": "Ops", "locations": ["US, CA, Santa Clara"], "creationTs": 1704067200}, {"id": 7, "name": ""}]
    details = spark.createDataFrame([("acme:acme.com", "5", json.dumps({"job_description": "<p>Do</p>", "work_location_option": "remote", "custom_JD": {"data_fields": {"timeType": ["Full time"]}}}))], "slug string, posting_id string, payload string")
    frame = feeds.eightfold(landed(spark, {"data": {"positions": jobs, "count": 3}}, "acme:acme.com"), details)
    assert frame.columns == feeds.COLUMNS
    a, b = sorted(frame.collect(), key=lambda r: r.title)
    assert (a.source_id, a.url, a.city, a.region, a.work_model, a.employment_type, a.description, a.published_at, a.date_confidence) == ("J5", "https://acme.eightfold.ai/careers/job/5", "Austin", "TX", "Remote", "Full time", "Do", datetime(2024, 1, 1), "high")
    assert (b.source_id, b.city, b.region, b.date_confidence) == ("6", "Santa Clara", "CA", "low")
    got = spark.createDataFrame([("acme:acme.com",), ("-bad:acme.com",), ("acme",)], "slug string").select(feeds.eightfold_address("slug", start=10).alias("a")).collect()
    assert [r.a for r in got] == ["https://acme.eightfold.ai/api/pcsx/search?domain=acme.com&query=&start=10&num=10", "", ""]


def test_addresses(spark):
    row = spark.createDataFrame([("acme",)], "slug string").select(feeds.address("lever", "slug").alias("a"), feeds.address("smartrecruiters", "slug", limit=100, offset=200).alias("b")).first()
    assert row.a == "https://api.lever.co/v0/postings/acme?mode=json" and row.b.endswith("acme/postings?limit=100&offset=200")


def test_landed_files(spark, tmp_path):
    at = tmp_path / "company=Acme" / "slug=acme"
    at.mkdir(parents=True)
    (at / "1.json").write_text(json.dumps({"jobs": [{"id": 1, "title": "Dev"}]}, indent=1))
    r = one(feeds.greenhouse(feeds.landed(spark, str(tmp_path))))
    assert (r.company, r.source_slug, r.title) == ("Acme", "acme", "Dev")
