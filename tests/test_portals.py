"""Portals, boards and threads over invented pages with the traps of real ones."""

import json
from datetime import datetime

from rolesift.sources import feeds, portals

RECORD = (
    'x\\"positionId\\":\\"200671933\\",\\"postingDate\\":\\"Aug 05, 2026\\",\\"postingTitle\\":\\"Agentic AI Manager, Platform \\",\\"postDateInGMT\\":\\"2026-08-05T16:49:55.229+00:00\\",\\"transformedPostingTitle\\":\\"agentic-ai-manager\\",'
)
DETAIL = (
    '\\"description\\":\\"PAGE META, NOT THE JOB\\",' + "x" * 500 + '\\"postingTitle\\":\\"Agentic AI Manager\\",\\"jobSummary\\":\\"Owns the &amp; platform.\\",\\"description\\":\\"THE REAL \\"JOB\\" BODY\\",'
    '\\"minimumQualifications\\":\\"8 years of product management.\\",\\"preferredQualifications\\":\\"Experience with MCP.\\",\\"locations\\":[{\\"id\\":\\"post-A\\",\\"city\\":\\"Austin\\",\\"stateProvince\\":\\"Texas\\"},'
    '{\\"id\\":\\"post-C\\",\\"city\\":\\"Cupertino\\",\\"stateProvince\\":\\"California\\"}],\\"homeOffice\\":false,\\"postingFooters\\":[{\\"content\\":\\"base pay between $207,400 and $311,700.\\"}]'
)
RESULTS = '<a href="./jobs/results/137435049938035398-principal-lead?q=AI">x</a><a href="./jobs/results/137435049938035398-principal-lead">y</a><a href="./jobs/results/106281886908588742-program-manager">z</a>'
PAGE = (
    "<title>Principal Lead, AI Tools — Google Careers</title><body>Note: share your preferred working location from the following: Atlanta, GA, USA; \\u003cb\\u003eSan Francisco, CA, USA; New York, NY, USA . "
    "Minimum qualifications: Bachelor's degree &amp; more. US: $186000 - $269000 (USD) + 20% bonus target Information collected and processed as part of your Google Careers profile; preferred working location from the following: Tokyo, CA, Japan.</body>"
)
BODY = "<p>Braces {like this} inside, a \\\"quote\\\" and }</p>" + "long " * 60


def test_apple_records(spark):
    rows = spark.createDataFrame([(1, RECORD + RECORD + RECORD.replace("200671933", "7").replace("postingTitle", "other") + RECORD.replace("200671933", "8")), (2, None), (3, "")], "page int, payload string")
    found = portals.apple_records(rows).orderBy("place").collect()
    assert [(r.page, r.position_id, r.posting_title.strip(), r.title_slug) for r in found] == [(1, "200671933", "Agentic AI Manager, Platform", "agentic-ai-manager"), (1, "7", "Agentic AI Manager, Platform", "agentic-ai-manager"), (1, "8", "Agentic AI Manager, Platform", "agentic-ai-manager")]
    assert found[0].posted_at.startswith("2026-08-05")


def test_apple_postings(spark):
    rows = [("Apple", "apple", DETAIL, "200671933", "Agentic AI Manager", "2026-08-05T16:49:55.229+00:00"), ("Apple", "apple", DETAIL, None, "x", None), ("Apple", "apple", DETAIL, "5", None, None), ("Apple", "apple", None, "6", None, None)]
    found = portals.apple(spark.createDataFrame(rows, "company string, slug string, payload string, position_id string, posting_title string, posted_at string"))
    assert found.columns == feeds.COLUMNS
    r, untitled = found.orderBy("source_id").collect()
    assert r.description == 'Owns the & platform.\n\nTHE REAL "JOB" BODY\n\n8 years of product management.\n\nExperience with MCP.\n\n{"content":"base pay between $207,400 and $311,700."'
    assert (r.location_raw, r.city, r.region, r.country, r.salary_min, r.salary_max) == ("Cupertino, California", "Cupertino", "CA", "United States", 207400, 311700)
    assert r.published_at == datetime(2026, 8, 5, 16, 49, 55, 229000) and r.url == "https://jobs.apple.com/en-us/details/200671933"
    assert untitled.title == "Agentic AI Manager" and untitled.published_at is None


def test_google(spark):
    rows = spark.createDataFrame([(1, RESULTS), (2, None)], "page int, payload string")
    assert [(r.job_id, r.title) for r in portals.google_records(rows).orderBy("place").collect()] == [("137435049938035398", "principal lead"), ("106281886908588742", "program manager")]
    rows = [("Google", "google", PAGE, "137435049938035398", "principal-lead"), ("Google", "google", "<title>Google Careers</title>Minimum qualifications: x", "1", "x"), ("Google", "google", "<title>No body</title>", "1", "x"), ("Google", "google", None, "1", "x")]
    [r] = portals.google(spark.createDataFrame(rows, "company string, slug string, payload string, job_id string, title_slug string")).collect()
    assert (r.title, r.location_raw, r.city, r.salary_min, r.salary_max, r.published_at, r.date_confidence) == ("Principal Lead, AI Tools", "San Francisco, CA, USA", "San Francisco", 186000, 269000, None, "none")
    assert r.description.startswith("Minimum qualifications: Bachelor's degree & more.") and r.description.endswith("bonus target") and r.bonus_mentioned


def test_job_object_among_siblings():
    page = 'var x = {"@type":"Other"}; w.job = {"@type":"JobPosting","title":"Lead","applicantLocationRequirements":{"@type":"Country"},"hiringOrganization":{"@type":"Organization","name":"Acme"},"description":"' + BODY + '"};'
    assert json.loads(portals.job_object(page))["hiringOrganization"]["name"] == "Acme"
    assert portals.job_object('{"@type":"Organization","name":"x"}') is None and portals.job_object(None) is None and portals.job_object("{" * 2000 + '"JobPosting"') is None
    deep = '{"@type":"JobPosting","a":' + '{"b":' * 38 + '"hiringOrganization"' + "}" * 39
    assert portals.job_object(deep.replace('"JobPosting"', '"JobPosting" ').replace('"@type":"JobPosting" ', '"@type": "JobPosting"')) is not None


def test_builtin(spark):
    def page(**more):
        return "let a = {}; x = " + json.dumps({"@type": "JobPosting", "title": "Lead", "hiringOrganization": {"name": "Acme"}, "datePosted": "2026-08-01T10", "description": "<p>" + "long " * 60 + "</p>", **more}) + ";"

    place = lambda **a: {"@type": "Place", "address": a}
    pages = [
        page(jobLocation=place(addressLocality="Foster City", addressRegion="California", addressCountry="USA"), baseSalary={"currency": "USD", "value": {"minValue": 150000, "maxValue": 190000.0}}),
        page(jobLocation=[place(addressLocality="Newton", addressRegion="Massachusetts"), place(addressCountry="USA"), place(addressLocality="Newton", addressRegion="Massachusetts"), place(addressLocality="San Francisco", addressRegion="California")], hiringOrganization="Bare name"),
        page(jobLocation=[place(addressCountry="CAN")], jobLocationType="telecommute", title=""),
        page(description="short"), "no object", None,
    ]
    rows = [(f"https://builtin.com/job/lead/{i}", "From the lead", p) for i, p in enumerate(pages)]
    found = portals.builtin(spark.createDataFrame(rows, "url string, lead_title string, payload string"))
    assert found.columns == feeds.COLUMNS
    a, b, c = found.orderBy("source_id").collect()
    assert (a.source_id, a.company, a.location_raw, a.salary_min, a.salary_max, a.salary_raw, a.published_at) == ("builtin:0", "Acme", "Foster City, California, USA", 150000, 190000, "USD 150000 - 190000", datetime(2026, 8, 1))
    assert (b.company, b.location_raw, b.salary_min) == ("Bare name", "Newton, Massachusetts / San Francisco, California", None)
    assert (c.title, c.location_raw, c.work_model, c.is_remote) == ("From the lead", "Remote", "Remote", True)


def test_thread_leads(spark):
    texts = ["<p>Acme AI | Head of AI | Remote (US) | Full Time</p><p>" + "We build workflows for teams. " * 4 + "</p>", "<p>hiring</p>", "we are hiring engineers " * 8, "Acme - we make x (https://a.example) | Dev https://b.example | now | Berlin, DE | " + "more text " * 10, None]
    rows = spark.createDataFrame([(9, json.dumps({"children": [{"id": i, "text": t} for i, t in enumerate(texts)] + [None]})), (10, "no json")], "thread_id long, payload string")
    found = {r.url[-1]: (r.company, r.title, r.location) for r in portals.thread_leads(rows).collect()}
    assert found == {"0": ("Acme AI", "Head of AI", "Remote (US)"), "3": ("Acme", "Dev", "Berlin, DE")}
