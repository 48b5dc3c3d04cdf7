"""Screening with the whole sample profile: vocabularies, marks, signals and the cascade with every reason and flag.

The tables have no titles, places, pay or trade words, so that postings are made around the
texts: titles, places and sentences come from lists by the id, and each body gets terms of the
vocabularies, repeated up to five times. The SQL states the rules, not the outcomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions import work
from rolesift.operators import gates, relevance
from rolesift.plans import profile
from rolesift.plans.catalogue import _BANDED, _KILLER, query
from rolesift.session import table

AS_OF = "2024-04-20 00:00:00"
TITLES = (
    "Manager, Marketing AI Enablement", "Program Manager, AI and Gemini App Marketing", "Growth Marketing Manager, Web & CRO", "AI Transformation Owner, CRO", "Head of Growth Marketing", "Director, Demand Generation",
    "Vice President, AI Strategy", "Senior Software Engineer", "Marketing Engineer", "Performance Marketing Lead", "Agentic Programs Lead", "Martech Lead - Vice President", "VP, CMO", "Web Growth Manager",
    "Director, AI Adoption", "Events and Media Coordinator", "Chief of Staff, AI Operations", "Lifecycle Marketing Manager", "Digital Marketing Manager", "Data Engineer, GTM", "Programme lead", "GTM Engineer", "Clerk",
)
PLACES = (
    "San Francisco, CA", "San Mateo - Bovet", "CA - San Francisco", "San Francisco Bay Area", "Denver, CO; New York City, NY; San Francisco, CA", "Newark, NJ", "Newark, CA", "Austin, TX (Belmont Campus)",
    "Belmont St, Boston", "Belmont, Massachusetts", "London, United Kingdom", "Dublin, CA", "Dublin, Ireland", "Remote - US", "Remote - India", "Palo Alto", "Palo Alto | London", "East Palo Alto, California",
    "Sunnyvale HQ", "Sunnyvale or Remote", "Sacramento, CA", "New York, NY", "Fremont, Ohio", "Fremont (Warm Springs)", "Menlo Park / Seattle", "Menlo Parkway, Dallas", "Toronto, Canada", "Anywhere in the US",
    "Paris, Texas, USA", "Mountain View;", "Oakland, CA", "San Jose, Costa Rica", "San Jose Calif", "Campbell-Cupertino", "Redwood City, CA 94065", "Nationwide", "",
)
CITIES = {"San Francisco": 35, "San Mateo": 5, "Belmont": 10, "Palo Alto": 33, "East Palo Alto": 25, "Newark": 45, "Sunnyvale": 43, "Fremont": 48, "Menlo Park": 25, "Mountain View": 38, "San Jose": 55, "Campbell": 55, "Cupertino": 42, "Redwood City": 18, "Dublin": 70, "Oakland": 65, "Sacramento": 120}
DEMANDS = (
    "A PhD is required.", "An MS or PhD in physics.", "PhD in physics.", "You must relocate.", "You train large language models daily.", "You will publish papers.", "Kubernetes is required.", "You carry a quota.",
    "You join the on-call rotation.", "A PhD in statistics is a plus.",
)
SENTENCES = (
    "Equip our marketers with tools.", "Enable the GTM team daily.", "Help business users build and deploy AI agents themselves.", "An agent we ship to citizen developers.", "Work with the sales organization.", "Sellers rely on you.",
    "Shopify retail and ecommerce for the consumer brand.", "B2B SaaS for the enterprise.", "Paid search, paid social, webinars and media buying.", "Landing page work, A/B test plans and organic search.", "Be comfortable with AI tools.", "Nothing more.",
)
TERMS = tuple(dict.fromkeys(t for v in (profile.TRACK_A, profile.TRACK_B) for t, _ in v.entries))
PROFILE = gates.Profile(cities=CITIES, freshness_days=60.0, floor_a=profile.FLOOR_A, floor_b=profile.FLOOR_B, growth_share=profile.GROWTH_SHARE)
EVERGREEN_DAYS = 75.0


def _strings(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pick(values: tuple[str, ...], at: str) -> str:
    """The value at a place, told the same way in both engines."""
    return f"element_at(array({_strings(values)}), CAST({at} % {len(values)} AS INT) + 1)"


# Six terms of the vocabularies go to a body, each repeated up to five times.
_PLANTED = " || ".join(f"repeat({_pick(TERMS, f'(doc_id * {k} + {k * k})')} || '; ', CAST((doc_id + {k}) % 6 AS INT))" for k in (1, 7, 11, 13, 17, 23))
_DEMAND = f"CASE WHEN doc_id % 3 = 0 THEN {_pick(DEMANDS, "(doc_id / 3)")} ELSE 'Any degree.' END".replace("doc_id / 3", "CAST(floor(doc_id / 3) AS BIGINT)")
_BODY = f"coalesce(text, '') || ' ' || {_PLANTED} || {_pick(SENTENCES, '(doc_id * 5)')} || ' ' || {_pick(SENTENCES, '(doc_id * 7 + 3)')}"
_SQL_POSTED = f"""SELECT *, {_BODY} || ' ' || demand AS body FROM (SELECT doc_id, text, source, lang, {_pick(TITLES, 'doc_id')} AS role, {_pick(PLACES, '(doc_id * 3)')} AS place, CASE doc_id % 9 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' END AS model,
 CASE WHEN doc_id % 7 < 3 THEN CAST(145000 + doc_id % 101 * 1000 AS INT) END AS pay_max, {_DEMAND} AS demand, CAST(doc_id % 700 AS BIGINT) AS source_id, CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id * 37 % 90 AS DOUBLE) END AS age FROM documents) p"""
_DUCK_POSTED = _SQL_POSTED.replace("element_at(array(", "list_extract(list_value(")


def posted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    made = docs.select("doc_id", "text", "source", "lang", *(F.expr(x).alias(n) for n, x in {
        "role": _pick(TITLES, "doc_id"), "place": _pick(PLACES, "(doc_id * 3)"), "model": "CASE doc_id % 9 WHEN 0 THEN 'Remote' WHEN 1 THEN 'Hybrid' END",
        "pay_max": "CASE WHEN doc_id % 7 < 3 THEN CAST(145000 + doc_id % 101 * 1000 AS INT) END", "demand": _DEMAND, "source_id": "CAST(doc_id % 700 AS BIGINT)", "age": "CASE WHEN doc_id % 5 <> 0 THEN CAST(doc_id * 37 % 90 AS DOUBLE) END",
    }.items()))
    return made.withColumn("body", F.expr(f"{_BODY} || ' ' || demand"))


def _sql_terms(groups: dict[str, dict[str, float]]) -> str:
    return " + ".join(f"least(CAST((length(low) - length(replace(low, '{t}', ''))) / {len(t)} AS INT), 3) * {w}::DOUBLE" for g in groups.values() for t, w in g.items())


def _sql_any(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _re(pattern: str) -> str:
    return "(?i)" + pattern.replace("'", "''")


_A, _B = profile.TRACK_A, profile.TRACK_B
_MARK = {m.name: f"regexp_matches(low, '{_re(m.pattern)}')" for m in _A.marks}
_SPLIT = f"(NOT {_sql_any('name', _A.titles)} AND regexp_matches(name, '{_re(profile.TITLE_AI)}') AND regexp_matches(name, '{_re(profile.TITLE_MARKETING)}'))"
_SQL_TITLES = lambda v: " + ".join(f"CASE WHEN contains(name, '{t}') THEN {w}::DOUBLE ELSE 0 END" for t, w in v.titles.items())
_SCORED = f"""SELECT *, {_sql_terms(_A.groups)} + {_SQL_TITLES(_A)} + {" + ".join(f"CASE WHEN {_MARK[m.name]} THEN {m.weight}::DOUBLE ELSE 0 END" for m in _A.marks)} + CASE WHEN {_SPLIT} THEN {_A.split_title[2]}::DOUBLE ELSE 0 END AS score_a,
 {_sql_terms(_B.groups)} + {_SQL_TITLES(_B)} AS score_b,
 ({_sql_any("low", profile.ENABLEMENT)} OR {_sql_any("name", _A.titles)} OR {_MARK["equips-marketers"]} OR {_MARK["teaches-nontechnical-to-build"]} OR {_SPLIT})
 AND ({_sql_any("low", (*profile.MARKETING, *profile.ENTERPRISE))} OR {_MARK["sales-context"]} OR {_sql_any("name", [t for t in _A.titles if "marketing" in t])} OR {_SPLIT}) AS sides,
 {_sql_any("low", (*profile.CAPTURE, *profile.GROWTH, *profile.CREATION))} OR {_sql_any("name", _B.titles)} AS core
FROM (SELECT *, lower(body) AS low, lower(role) AS name FROM ({_DUCK_POSTED}))"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    rows = relevance.with_relevance(posted(spark, d), "role", "body", {"a": _A, "b": _B})
    sides = gates.both_sides(F.col("matched_a"), list(profile.SIDE_FIRST), list(profile.SIDE_SECOND))
    return rows.withColumns({"sides": sides, "core": F.arrays_overlap("matched_b", F.lit(list(profile.CORE_B)))})


@query("relevance_scores", f"SELECT doc_id, score_a, score_b, sides, core FROM ({_SCORED})")
def relevance_scores(spark, d):
    """All terms, title bonuses and marks of both vocabularies; one pass over each text."""
    return scored(spark, d).select("doc_id", "score_a", "score_b", "sides", "core")


@query("relevance_matches", f"""SELECT doc_id, list_aggregate(list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN contains(low, '{t}') THEN '{t}' END" for t, _ in _A.entries)}, {", ".join(f"CASE WHEN contains(name, '{t}') THEN 'title:{t}' END" for t in _A.titles)},
 {", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _MARK.items())}, CASE WHEN {_SPLIT} THEN '{_A.split_title[0]}' END], lambda x: x IS NOT NULL))), 'string_agg', '|') AS matched FROM ({_SCORED})""")
def relevance_matches(spark, d):
    """Names of what was found for track A."""
    names = F.array_join(F.array_sort(F.array_distinct("matched_a")), "|")
    return scored(spark, d).select("doc_id", F.when(F.size("matched_a") > 0, names).alias("matched"))


_HITS = lambda p: f"len(list_distinct(list_transform(regexp_extract_all(body, '{_re(p)}'), lambda x: lower(x))))"
_CREATION = f"({_HITS(profile.CREATES)} + CASE WHEN regexp_matches(role, '{_re(profile.CREATES_TITLE)}') AND NOT regexp_matches(role, '{_re(profile.CAPTURES_TITLE)}') THEN 2 ELSE 0 END)"
_MENTIONS = lambda p: f"len(regexp_extract_all(role || ' ' || body, '{_re(p)}'))"


@query("posting_signals", f"""SELECT doc_id, CASE WHEN {_MENTIONS(profile.B2C)} > {_MENTIONS(profile.B2B)} AND {_MENTIONS(profile.B2C)} >= 2 THEN 'b2c_dtc_ecommerce' WHEN {_MENTIONS(profile.B2B)} > 0 THEN 'b2b_saas_enterprise' ELSE 'b2b_other' END AS audience,
 CASE WHEN {_CREATION} >= 4 AND {_CREATION} > {_HITS(profile.CAPTURES)} THEN 'campaign_creation_heavy' WHEN {_CREATION} >= 2 AND {_CREATION} > {_HITS(profile.CAPTURES)} THEN 'campaign_creation_mixed' ELSE 'capture_balanced' END AS funnel_side,
 regexp_matches(body, '{_re(profile.FLUENCY)}') AS ai_fluency, CASE WHEN regexp_matches(role, '{_re(profile.SENIOR_TITLE)}') AND NOT regexp_matches(demand, '{_re(profile.CLAIMABLE)}') AND NOT regexp_matches(role, '{_re(profile.CLAIMABLE)}') THEN {profile.SENIORITY_CAP}::DOUBLE END AS cap FROM ({_DUCK_POSTED})""")
def posting_signals(spark, d):
    """Audience, side of the funnel, asked fluency, and the cap of a senior title; title and demand stand for the note."""
    rows = posted(spark, d)
    role, body = F.col("role"), F.col("body")
    return rows.select(
        "doc_id", relevance.audience(F.concat_ws(" ", role, body), profile.B2B, profile.B2C).alias("audience"),
        relevance.funnel_side(body, role, profile.CREATES, profile.CAPTURES, profile.CREATES_TITLE, profile.CAPTURES_TITLE).alias("funnel_side"),
        relevance.rlike(body, profile.FLUENCY).alias("ai_fluency"), relevance.seniority_cap(role, F.concat_ws(" ", "demand", role), profile.SENIOR_TITLE, profile.CLAIMABLE, profile.SENIORITY_CAP).alias("cap"),
    )


# Geography: what follows the first mention of a city within the limit decides.
_NEAR = {c: m for c, m in CITIES.items() if m <= PROFILE.commute_limit}
_AFTER = lambda c: f"regexp_extract(lower(place), '\\b{c.lower()}\\b(.{{0,40}})', 1, 's')"
_STANDS = lambda c: f"""(regexp_matches(lower(place), '\\b{c.lower()}\\b') AND (regexp_matches({_AFTER(c)}, '^,?\\s*(ca|calif|california)\\b') OR (NOT regexp_matches({_AFTER(c)}, '^,\\s*({"|".join(gates.STATE_CODES)})\\b')
 AND NOT regexp_matches({_AFTER(c)}, '^,?\\s*({"|".join(gates.STATE_NAMES)})\\b') AND (regexp_matches({_AFTER(c)}, '^\\s*($|[|;/,)(\\-])') OR regexp_matches({_AFTER(c)}, '{gates.AFTER_CITY}')))))"""  # noqa: E731
_CITIES = "list_filter([" + ", ".join(f"CASE WHEN {_STANDS(c)} THEN lpad('{m}', 3, '0') || ' {c}' END" for c, m in _NEAR.items()) + "], lambda x: x IS NOT NULL)"


@query("reachable_cities", f"SELECT doc_id, place, list_aggregate(list_sort({_CITIES}), 'string_agg', '|') AS cities FROM ({_DUCK_POSTED})")
def reachable_cities(spark, d):
    """The cities within the limit that a written location names, nearest first."""
    found = gates.reachable_cities(F.col("place"), PROFILE)
    told = F.transform(found, lambda c: F.concat(F.lpad(c["minutes"].cast("string"), 3, "0"), F.lit(" "), c["city"]))
    return posted(spark, d).select("doc_id", "place", F.when(F.size(found) > 0, F.array_join(told, "|")).alias("cities"))


_FAR = f"""(regexp_matches(place, '(?i)\\b({"|".join(gates.ABROAD)})\\b') AND NOT regexp_matches(place, '(?i){gates.HOME}')) OR (coalesce(model, '') <> 'Remote' AND len({_CITIES}) = 0)"""
_GROWTH_BANDED = f"({_BANDED} OR regexp_matches(role, '(?i)\\bhead of\\b|\\bhead,'))"
_TRACK_A = f"(sides AND score_a >= {profile.FLOOR_A})"
_TRACK_B = f"(core AND score_b >= {profile.FLOOR_B})"
_SEEN = f"SELECT user_id, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS watched FROM events GROUP BY 1"
_SCREENED = f"""SELECT doc_id, score_a, score_b, CASE WHEN l.doc_id2 IS NOT NULL THEN 'suppressed' WHEN age IS NULL AND NOT (n = 1 AND watched IS NULL) THEN 'undated' WHEN age > 60 THEN 'stale' WHEN {_BANDED} THEN 'title_band'
 WHEN regexp_matches(role, '(?i)\\b({"|".join(gates.OTHER_TRADES)})\\b') THEN 'other_trade' WHEN {_FAR} THEN 'too_far' WHEN pay_max < 150000 THEN 'pay_floor' WHEN {_KILLER} IS NOT NULL THEN {_KILLER}
 WHEN {_TRACK_A} OR ({_TRACK_B} AND NOT {_GROWTH_BANDED}) THEN NULL WHEN {_TRACK_B} THEN 'growth_title' WHEN NOT sides THEN 'one_sided' ELSE 'below_floor' END AS reason,
 CASE WHEN {_TRACK_A} AND NOT ({_TRACK_B} AND NOT {_GROWTH_BANDED} AND score_b >= {profile.GROWTH_SHARE} * score_a) THEN CASE WHEN {_TRACK_B} AND NOT {_GROWTH_BANDED} THEN 'a,b' ELSE 'a' END WHEN {_TRACK_B} AND NOT {_GROWTH_BANDED} THEN 'b' ELSE '' END AS tracks,
 concat_ws(',', CASE WHEN age IS NULL AND n = 1 AND watched IS NULL THEN 'no_publish_date' END, CASE WHEN watched > {EVERGREEN_DAYS} AND watched - age > {EVERGREEN_DAYS} / 2 THEN 'evergreen_or_reposted' END) AS flags
FROM (SELECT *, row_number() OVER (PARTITION BY source, source_id ORDER BY doc_id) AS n FROM ({_SCORED})) s LEFT JOIN (SELECT DISTINCT doc_id AS doc_id2 FROM labels WHERE quality = 0) l ON s.doc_id = l.doc_id2 LEFT JOIN ({_SEEN}) w ON s.source_id = w.user_id"""


def screened(spark: SparkSession, d: str, only: DataFrame | None = None, on_record: bool = False) -> DataFrame:
    """Rows with reason (null: passed), tracks and flags. Gates of ids and dates come first, so that the texts of what they reject are never scored; what is on record already (`on_record`) isn't asked for them. `only`: the doc_ids to screen."""
    rows = posted(spark, d)
    rows = rows if only is None else rows.join(only.select("doc_id"), "doc_id", "left_semi")
    if on_record:
        known = {"skip": F.lit(False), "age": F.lit(0.0), "watched": F.lit(None).cast("double"), "first_sighting": F.lit(True)}
        return gates.early_gates(rows.withColumns(known), PROFILE, EVERGREEN_DAYS)
    skip = table(spark, d, "labels").where("quality = 0").select("doc_id").distinct().withColumn("skip", F.lit(True))
    log = table(spark, d, "events").groupBy(F.col("user_id").alias("source_id")).agg(work.age_days(F.min("ts"), F.lit(AS_OF)).alias("watched"))
    seen = gates.with_sightings(rows, ["source", "source_id"], "doc_id", log, ["source_id"])
    return gates.early_gates(seen.join(skip, "doc_id", "left"), PROFILE, EVERGREEN_DAYS)


def outcomes(spark: SparkSession, d: str, only: DataFrame | None = None, on_record: bool = False) -> DataFrame:
    """(doc_id, reason, tracks, flags, score): the whole cascade; tracks and flags are comma-joined. Of what is on record only the rows that get as far as relevance are returned: others keep their tracks."""
    rows = screened(spark, d, only, on_record)
    out, rest = rows.where("reason is not null"), rows.where("reason is null")
    rest = relevance.with_relevance(rest, "role", "body", {"a": _A, "b": _B})
    sides = gates.both_sides(F.col("matched_a"), list(profile.SIDE_FIRST), list(profile.SIDE_SECOND))
    core = F.arrays_overlap("matched_b", F.lit(list(profile.CORE_B)))
    rest = gates.with_tracks(rest.withColumns({"sides": sides, "core": core}), F.col("role"), PROFILE)
    columns = ["doc_id", "reason", F.when(F.col("reason").isNull(), F.array_join("tracks", ",")).otherwise("").alias("tracks"), F.array_join("flags", ",").alias("flags")]
    judged = rest.select(*columns, F.col("score_a").cast("double").alias("score"))
    if on_record:
        return judged
    return out.withColumn("tracks", F.array().cast("array<string>")).select(*columns, F.lit(None).cast("double").alias("score")).unionByName(judged)


@query("screening_reasons", f"SELECT doc_id, coalesce(reason, 'passed') AS reason, CASE WHEN reason IS NULL THEN tracks ELSE '' END AS tracks, flags FROM ({_SCREENED})")
def screening_reasons(spark, d):
    return outcomes(spark, d).select("doc_id", F.coalesce("reason", F.lit("passed")).alias("reason"), "tracks", "flags")


@query("screening_funnel", f"SELECT coalesce(reason, 'passed') AS outcome, count(*) AS n FROM ({_SCREENED}) GROUP BY 1")
def screening_funnel(spark, d):
    return screening_reasons(spark, d).groupBy(F.col("reason").alias("outcome")).agg(F.count("*").alias("n"))
