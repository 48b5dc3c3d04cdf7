"""Headings and sections of postings against cases of known outcome."""

from pyspark.sql import functions as F

from rolesift.functions.sections import heading_kind, with_sections

KINDS = {
    "WHAT YOU'LL DO": "responsibilities",
    "What You’ll Do": "responsibilities",
    "What you'll bring": "requirements",
    "What you will do in this role:": "responsibilities",
    "## ROLE OVERVIEW": "overview",
    "**ROLE OVERVIEW**": None,
    "As a Senior Manager, Web Growth, you'll:": "responsibilities",
    "Preferred Qualifications (a plus)": "requirements",
    "You might be a great fit if": "requirements",
    "United States Salary Range": "stop",
    "WHY BOX NEEDS YOU": "stop",
    "How Acme will support you": "stop",
    "- Responsibilities": None,
    "Some words of a body": None,
    "Responsibilities " + "x" * 90: None,
    "   ": None,
    "…": None,
}

BODIES = {
    "sections": "Intro\nAbout the role\nWe sell.\nWhat You’ll Do\n - Lead it\n\n\n\nMore\nRequirements\nSQL\nNice to have\nPython\nBenefits\nFood\nRequirements\nLate",
    "command": "About the role\nWe sell.\nDesign the future state\nDraw it.",
    "overview": "About the role\nWe sell things.",
    "demands": "Requirements\nSQL",
    "bullets": "Hello\n- Soup\n- Lead a\n• Own b\n* drive: c\nend\n- Build x\n- y",
    "full": " Hello\nworld ",
    "windows": "Duties\r\nRun it",
    "empty": "",
    "null": None,
    "late_command": "About the role\nDesign the future state",
}
WANT = {
    "sections": ("We sell.", "- Lead it\n\nMore", "SQL\nNice to have\nPython\nLate", "", 'heading "What You’ll Do"'),
    "command": ("We sell.", "Design the future state\nDraw it.", "", "", 'unlabelled duties under "About the role"'),
    "overview": ("We sell things.", "", "", "", 'no responsibilities heading found - captured "About the role" instead'),
    "demands": ("", "", "SQL", "", 'no responsibilities heading found - captured "Requirements" instead'),
    "bullets": ("", "- Lead a\n• Own b\n* drive: c", "", "", "unlabelled bullet list (no headings matched)"),
    "full": ("", "", "", "Hello\nworld", "full-text fallback - no headings matched, whole posting saved"),
    "windows": ("", "Run it", "", "", 'heading "Duties"'),
    "empty": ("", "", "", "", "no description stored"),
    "null": ("", "", "", "", "no description stored"),
    "late_command": ("Design the future state", "", "", "", 'no responsibilities heading found - captured "About the role" instead'),
}


def test_kinds(spark):
    rows = spark.createDataFrame([(k,) for k in KINDS], "line string").select("line", heading_kind(F.col("line")).alias("kind"))
    assert {r["line"]: r["kind"] for r in rows.collect()} == KINDS


def test_sections(spark):
    rows = with_sections(spark.createDataFrame(list(BODIES.items()), "name string, body string"), "body")
    assert {r["name"]: tuple(r["sections"]) for r in rows.collect()} == WANT


def test_no_rows(spark):
    assert with_sections(spark.createDataFrame([], "body string"), "body").collect() == []
