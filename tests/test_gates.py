"""Gates against cases of known outcome."""

from pyspark.sql import functions as F

from rolesift.operators import gates

PROFILE = gates.Profile(cities={"San Mateo": 5, "Belmont": 10, "San Francisco": 35, "Palo Alto": 33, "Newark": 45, "Sacramento": 120}, floor_a=4.0, floor_b=6.0)

TITLES = {
    "Vice President, Growth": "vice president",
    "SVP Marketing": "svp",
    "Transformation Owner, CRO": None,
    "Transformation Owner, CRO office": None,
    "VP, CMO": "vp",
    "CRO": "cro",
    "Growth Marketing Manager, Web & CRO": None,
    "Enablement Lead - Vice President": "vice president",
    "Mischief Manager": None,
    None: None,
    "": None,
}
TRADES = {"Senior Software Engineer": True, "Marketing Engineer": False, "Internal tools lead": False, "Account Manager": True, None: False}
KILLERS = {
    "A PhD is required.": "requires_phd",
    "PhD in Machine Learning required": "requires_phd",
    "PhD in physics": "phd_in_field",
    "A BS, MS, or PhD in Computer Science, or equivalent experience.": None,
    "PhD in statistics preferred.": None,
    "You train large language models": "trains_models",
    "Kubernetes. Nothing is required": None,
    "You carry a quota": "carries_quota",
    "part of the on-call rotation": "oncall",
    "You must relocate and join the oncall rotation": "relocation_required",
    "": None,
    None: None,
}
PLACES = [
    (("San Mateo", "On-site", "San Mateo, CA", None), False),
    (("Sacramento", "On-site", "Sacramento, CA", None), True),
    ((None, "On-site", "CA - San Francisco", None), False),
    (("Newark", "Hybrid", "Newark, CA", None), False),
    ((None, "On-site", "Newark, NJ; Denver, CO", None), True),
    ((None, "On-site", "Austin, TX (Belmont Campus)", None), True),
    ((None, "On-site", "Austin | Chicago | New York City | San Francisco", None), False),
    ((None, "Remote", "Remote - India", None), True),
    ((None, "Remote", "Remote, US or Canada", None), False),
    ((None, "Remote", None, None), False),
    (("London", "On-site", "London, UK", ["based in Palo Alto"]), True),
    (("Los Angeles", "On-site", "Los Angeles, California", ["will be based out of LA, Palo Alto"]), False),
    ((None, None, None, None), True),
]


def outcomes(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return dict(rows.select("i", column(F.col("v"))).collect())


def test_title_bands_trades_and_killers(spark):
    for cases, column in ((TITLES, gates.title_band), (TRADES, gates.out_of_domain), (KILLERS, gates.killer)):
        got = outcomes(spark, list(cases), column)
        assert [(v, got[i], want) for i, (v, want) in enumerate(cases.items()) if got[i] != want] == []
    assert outcomes(spark, ["Head of Growth"], lambda c: gates.title_band(c, PROFILE.growth_bands)) == {0: "head of"}


def test_geography(spark):
    rows = spark.createDataFrame([(i, *case) for i, (case, _) in enumerate(PLACES)], "i int, city string, model string, places string, clauses array<string>")
    got = dict(rows.select("i", gates.too_far(F.col("city"), F.col("model"), F.col("places"), F.col("clauses"), PROFILE)).collect())
    assert [(case, got[i]) for i, (case, want) in enumerate(PLACES) if got[i] != want] == []


def test_tracks(spark):
    cases = [((5.0, True, 7.0, True, "Lead"), ["a", "b"]), ((5.0, True, 8.0, True, "Lead"), ["b"]), ((5.0, True, 8.0, True, "Head of X"), ["a"]), ((5.0, False, 1.0, True, "Lead"), []), ((None, None, None, None, None), [])]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, a double, sides boolean, b double, core boolean, title string")
    got = dict(rows.select("i", gates.tracks(*(F.col(c) for c in ("a", "sides", "b", "core", "title")), PROFILE)).collect())
    assert [(c, got[i]) for i, (c, want) in enumerate(cases) if got[i] != want] == []
