"""The gates that postings pass one after another, as columns. Lists, floors and cities are parameters of a profile."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesift.operators.ranking import first_reason

# Title bands, out-of-domain titles, disqualifying phrases and place names.
BANDS = ("vp", "vice president", "svp", "senior vice president", "evp", "chief", "cmo", "cto", "ceo", "coo", "cro", "president", "board member")
HEADS = ("head of", "head,")
ORG_CODES = ("cro", "cmo", "cto", "coo", "cio")
ORG_WORDS = r"( org| organi[sz]ation| office| team)?"
CONVERSION = r"(conversion|optimi[sz]ation|\bweb\b|website|landing page|experimentation|a/b test|growth marketing)"
OTHER_TRADES = (
    "software engineer", "backend engineer", "back-end engineer", "frontend engineer", "front-end engineer", "full.?stack engineer", "data engineer", "ml engineer",
    "machine learning engineer", "infrastructure engineer", "platform engineer", "security engineer", "network engineer", "qa engineer", "test engineer",
    "site reliability", "devops", "hardware", "firmware", "embedded", "silicon", "asic", "research scientist", "data scientist",
    "member of technical staff", "android engineer", "ios engineer", "mobile engineer", "computer vision", "systems engineer, ", "engineer, computer",
    "nurse", "physician", "therapist", "clinician", "pharmacist", "dental", "driver", "warehouse", "forklift", "technician", "custodian", "janitor",
    "barista", "cook", "chef", "server", "bartender", "cashier", "retail associate", "attorney", "paralegal", "counsel", "accountant", "auditor", "bookkeeper",
    "account executive", "sales development", "sdr", "bdr", "account manager", "customer success manager", "support specialist",
    "intern", "internship", "apprentice", "contractor", "temporary",
)
KILLERS = {
    "requires_phd": r"\bph\.?\s?d\.?\b[^.]{0,60}\b(required|require)\b",
    "phd_in_field": r"\bph\.?\s?d\.?\s+in\s+(computer science|machine learning|statistics|physics|mathematics)",
    "trains_models": r"\b(train|training|pretrain|fine.?tun\w+)\s+(foundation|large language|deep learning)\s+models?\b",
    "publishes_research": r"\bpublish(ing|ed)?\s+(research|papers?)\b|\bneurips\b|\bicml\b",
    "distributed_systems": r"\bdistributed systems at scale\b|\bkubernetes\b[^.]{0,40}\brequired\b",
    "carries_quota": r"\b(sales quota|carry a quota|quota.carrying|book of business|close deals)\b",
    "relocation_required": r"\b(relocation is required|must relocate|required to relocate)\b",
    "oncall": r"\bon.?call rotation\b",
}
OPTIONAL_DEGREE = (
    r"\b(b\.?s\.?c?|b\.?a\.?|m\.?s\.?c?|m\.?a\.?|bachelor\w*|master\w*|undergraduate)\b[^.]{0,120}?\bph\.?\s?d",
    r"\bph\.?\s?d\b[^.]{0,160}\b(or\s+)?equivalent\s+(practical\s+)?experience\b",
    r"\bph\.?\s?d\b[^.]{0,120}\b(preferred|a plus|nice.to.have|desirable|advantageous|bonus)\b",
    r"\b(preferred|nice.to.have|desirable)\b[^.]{0,120}\bph\.?\s?d\b",
)
EXEMPTIONS = {"requires_phd": OPTIONAL_DEGREE, "phd_in_field": OPTIONAL_DEGREE}
ABROAD = (
    "india", "united kingdom", "london", "dublin", "ireland", "germany", "berlin", "munich", "france", "paris", "spain", "madrid", "barcelona", "netherlands", "amsterdam", "poland",
    "krakow", "warsaw", "singapore", "japan", "tokyo", "australia", "sydney", "melbourne", "canada", "toronto", "vancouver", "montreal", "brazil", "sao paulo", "mexico", "israel",
    "tel aviv", "emea", "apac", "latam", "philippines", "manila", "romania", "bucharest", "portugal", "lisbon", "sweden", "stockholm", "switzerland", "zurich", "italy", "milan",
)
HOME = r"\b(united states|usa|u\.s\.|\bus\b|remote.{0,10}us|nationwide|anywhere in the us)\b"
STATE_CODES = "al ak az ar co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc".split()
STATE_NAMES = (
    "alabama", "alaska", "arizona", "arkansas", "colorado", "connecticut", "delaware", "florida", "georgia", "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana",
    "maine", "maryland", "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire", "new jersey", "new mexico", "new york", "north carolina",
    "north dakota", "ohio", "oklahoma", "oregon", "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont", "virginia", "washington", "west virginia",
    "wisconsin", "wyoming",
)
AFTER_CITY = r"^\s*(bay area|area|metro|region|office|offices|hq|headquarters|usa|us|united states|remote|hybrid|or|and)\b"


@dataclass(frozen=True)
class Profile:
    bands: tuple[str, ...] = BANDS
    growth_bands: tuple[str, ...] = BANDS + HEADS
    freshness_days: float = 60.0
    pay_floor: int = 150_000
    commute_limit: int = 60
    cities: dict[str, int] = field(default_factory=dict)  # minutes to each city; bounded by the profile, so part of the plan
    floor_a: float = 40.0
    floor_b: float = 65.0
    growth_share: float = 1.6  # from this ratio of the scores on, a posting of both tracks is of b only


def _has(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?idU){pattern}"), F.lit(False))


def _any(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def title_band(title: Column, bands: tuple[str, ...] = BANDS) -> Column:
    """The first band that a title holds as whole words, else null. CRO in a title about conversion is none, nor is a code of a chief after the last comma (whose organisation it is) if what stands before holds no band."""

    def plain(text: Column, org: Column) -> Column:
        def holds(band: str) -> Column:
            found = _has(text, rf"\b{re.escape(band)}\b")
            if band == "cro":
                found &= ~_has(text, CONVERSION)
            return found & ~org if band in ORG_CODES else found

        return first_reason([(band, holds(band)) for band in bands])

    # Only text before a comma counts as such; without one the tail is empty and matches no code.
    head, tail = F.regexp_extract(title, r"(?s)^(.*),[^,]*$", 1), F.trim(F.regexp_extract(title, r"(?s)^.*,([^,]*)$", 1))
    return plain(title, _has(tail, f"^({'|'.join(ORG_CODES)}){ORG_WORDS}$") & plain(head, F.lit(False)).isNull())


def out_of_domain(title: Column) -> Column:
    return _has(title, rf"\b({'|'.join(OTHER_TRADES)})\b")


def _layers(cities: list[str]) -> list[list[str]]:
    """Cities in sets of which none begins another, so that one alternation finds all of a set."""
    layers: list[list[str]] = []
    for city in sorted(cities, key=lambda c: (len(c), c)):
        free = next((x for x in layers if not any(city.startswith(y) for y in x)), None)
        if free is None:
            layers.append(free := [])
        free.append(city)
    return layers


def reachable_cities(places: Column, profile: Profile) -> Column:
    """array<struct<minutes, city>>, nearest first: the cities within the limit that a written location names. What follows the first mention decides: California, a separator or a word that leaves the city as it is, and not another state.

    One alternation over all cities looks ahead, so that cities may overlap and each brings the 40 characters after it.
    """
    near = {city.lower(): (minutes, city) for city, minutes in profile.cities.items() if minutes <= profile.commute_limit}
    kind = "array<struct<minutes:int,city:string>>"
    if not near:
        return F.array().cast(kind)
    text = F.lower(F.coalesce(places, F.lit("")))
    known = F.create_map(*(x for low, (minutes, city) in near.items() for x in (F.lit(low), F.struct(F.lit(int(minutes)).alias("minutes"), F.lit(city).alias("city")))))

    def stands(after: Column) -> Column:
        state = _has(after, rf"^,\s*({'|'.join(STATE_CODES)})\b") | _has(after, rf"^,?\s*({'|'.join(STATE_NAMES)})\b")
        alone = _has(after, r"^\s*($|[|;/,)(\-])") | _has(after, AFTER_CITY)
        return _has(after, r"^,?\s*(ca|calif|california)\b") | (~state & alone)

    found = []
    for layer in _layers(list(near)):
        pattern = rf"(?sU)(?=\b({'|'.join(re.escape(c) for c in layer)})\b(.{{0,40}}))"
        named = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("city"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("after"))
        # Later mentions of a city say nothing. The outer array of one binds the matches to a name.
        kept = F.flatten(F.transform(F.array(named), lambda n: F.filter(n, lambda x, i: (F.array_position(n.getField("city"), x["city"]) == i + 1) & stands(x["after"]))))
        found.append(F.transform(kept, lambda x: F.element_at(known, x["city"])))
    return F.array_sort(F.flatten(F.array(*found)).cast(kind))


def reachable(places: Column, profile: Profile) -> Column:
    """Whether a written location names a city within the limit."""
    return F.size(reachable_cities(places, profile)) > 0


def based_within(clauses: Column, profile: Profile) -> Column:
    """Whether a clause on where the role is based names a city within the limit."""
    names = [re.escape(city) for city, minutes in profile.cities.items() if minutes <= profile.commute_limit]
    return F.exists(clauses, lambda c: _has(c, rf"\b({'|'.join(names)})\b")) if names else F.lit(False)


def too_far(city: Column, model: Column, places: Column, clauses: Column, profile: Profile) -> Column:
    """Abroad without a mark of the home country; else, unless remote, neither the city nor the written location nor a clause of basing is within the limit."""
    abroad = _has(places, rf"\b({'|'.join(ABROAD)})\b") & ~_has(places, HOME)
    near = F.lower(F.trim(city)).isin([c.lower() for c, minutes in profile.cities.items() if minutes <= profile.commute_limit])
    close = F.coalesce(near, F.lit(False)) | reachable(places, profile) | F.coalesce(based_within(clauses, profile), F.lit(False))
    return abroad | (~model.eqNullSafe("Remote") & ~close)


def killer(body: Column) -> Column:
    """The first disqualifying phrase that no exemption takes back, else null."""
    return first_reason([(name, _has(body, pattern) & ~_any([_has(body, p) for p in EXEMPTIONS.get(name, ())])) for name, pattern in KILLERS.items()])


def both_sides(matched: Column, first: list[str], second: list[str]) -> Column:
    """Whether terms of either side are among the matched ones."""
    return F.coalesce(F.arrays_overlap(matched, F.lit(first)) & F.arrays_overlap(matched, F.lit(second)), F.lit(False))


def tracks(score_a: Column, sides: Column, score_b: Column, core: Column, title: Column, profile: Profile) -> Column:
    """The tracks a posting belongs to: a needs both sides and its floor, b its core, its floor and a title below its bands; a goes where b outweighs it."""
    b = F.coalesce(core & (score_b >= profile.floor_b), F.lit(False)) & title_band(title, profile.growth_bands).isNull()
    a = F.coalesce(sides & (score_a >= profile.floor_a), F.lit(False))
    outweighed = b & F.coalesce((score_a != 0) & (score_b >= profile.growth_share * score_a), F.lit(False))
    return F.array_compact(F.array(F.when(a & ~outweighed, "a"), F.when(b, "b")))


def with_sightings(rows: DataFrame, key: list[str], order: str, log: DataFrame, log_key: list[str]) -> DataFrame:
    """`rows` with first_sighting: the first row of its key in the batch, of a key that the log doesn't know. log: a row for each known key, with `watched`, the days since it was first seen.

    The first row of a key is a minimum, taken before the shuffle, and not a sort of the key's rows.
    """
    first = rows.groupBy(*key).agg(F.min(order).alias("__first"))
    joined = rows.join(first, key, "left").join(log, log_key, "left")
    return joined.withColumn("first_sighting", (F.col(order) == F.col("__first")) & F.col("watched").isNull()).drop("__first")


def flags(age: Column, first_sighting: Column, watched: Column, evergreen_days: float) -> Column:
    """What a posting is told to be without being rejected for it: undated, or watched for much longer than its date says."""
    undated = F.when(age.isNull() & first_sighting, "no_publish_date")
    reposted = F.when((watched > evergreen_days) & (watched - age > evergreen_days / 2), "evergreen_or_reposted")
    return F.array_compact(F.array(undated, reposted))


def early_gates(rows: DataFrame, profile: Profile, evergreen_days: float) -> DataFrame:
    """`rows` (skip, age, first_sighting, watched, role, model, place, pay_max, demand) with the reason of the first gate before relevance, and flags."""
    role, nothing = F.col("role"), F.lit(None).cast("string")
    checks = [
        ("suppressed", F.col("skip")),
        ("undated", F.col("age").isNull() & ~F.col("first_sighting")),
        ("stale", F.col("age") > profile.freshness_days),
        ("title_band", title_band(role, profile.bands).isNotNull()),
        ("other_trade", out_of_domain(role)),
        ("too_far", too_far(nothing, F.col("model"), F.col("place"), F.array().cast("array<string>"), profile)),
        ("pay_floor", F.col("pay_max") < profile.pay_floor),
    ]
    reason = F.coalesce(first_reason(checks), killer(F.col("demand")))
    return rows.withColumns({"reason": reason, "flags": flags(F.col("age"), F.col("first_sighting"), F.col("watched"), evergreen_days)})


def with_tracks(rows: DataFrame, title: Column, profile: Profile) -> DataFrame:
    """`rows` (score_a, sides, score_b, core) with tracks, and the reason where there is none: a growth match whose title is above the band, one side missing, or a score below its floor."""
    found = tracks(F.col("score_a"), F.col("sides"), F.col("score_b"), F.col("core"), title, profile)
    growth = F.coalesce(F.col("core") & (F.col("score_b") >= profile.floor_b), F.lit(False))
    reason = F.when(F.size(found) == 0, F.when(growth, "growth_title").when(~F.coalesce("sides", F.lit(False)), "one_sided").otherwise("below_floor"))
    return rows.withColumns({"tracks": found, "reason": reason})
