"""Work model, dates and commute, as columns. The time of reference is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


_HYBRID = r"\bhybrid\b"
_REMOTE = r"\b(remote|work from home|wfh|distributed|anywhere)\b"
_ON_SITE = r"\b(on.?site|in.?office|in.?person)\b"
_TAG = r"#LI-(Hybrid|Remote|Onsite|On-?site)\b"
_COUNTRY_ONLY = r"^\s*(united states(?: of america)?|usa?|u\.s\.a?\.?|nationwide|anywhere|multiple locations|various locations)\s*$"
# Phrases that name the work model; a bare "hybrid" may be a hybrid cloud.
_HYBRID_WORK = (
    r"\bhybrid\s+(environment|work|working|schedule|role|position|model|setup|arrangement|approach|policy|workplace)\b"
    r"|\bwe\s+are\s+(a\s+)?hybrid\b|\bhybrid\s+\("
)
_CADENCE = (
    r"\b(?:one|two|three|four|1|2|3|4)\s*\+?\s*days?\s+(?:a|per)\s+week\b"
    r"|\b(?:office|onsite|on-site|in-office)\b[^.]{0,40}\b(?:one|two|three|four|1|2|3|4)\s*\+?\s*days?\b"
    r"|\b(?:onsite|on-site|in.office|in the office)\b[^.]{0,30}\b(?:monday|tuesday|wednesday|thursday|friday)\b"
)


def work_model(stated: Column, remote_flag: Column, location: Column, body: Column) -> Column:
    """Remote, Hybrid or On-site: what is stated comes first, then the body's #LI tag, the location (a country alone is remote), phrases of hybrid work and days in the office, on-site wording near the start, and the flag where remote wording is near the start."""
    has = lambda c, pattern: F.coalesce(c.rlike(f"(?idU){pattern}"), F.lit(False))
    tag = F.lower(F.regexp_extract(body, f"(?idU){_TAG}", 1))
    start = F.concat_ws(" ", F.coalesce(location, F.lit("")), F.substring(F.regexp_replace(F.coalesce(body, F.lit("")), r"^(?U)\s+", ""), 1, 1500))
    return (
        F.when(has(stated, "hybrid"), "Hybrid")
        .when(has(stated, "remote"), "Remote")
        .when(has(stated, "onsite|on-site|on site|office"), "On-site")
        .when(tag == "hybrid", "Hybrid")
        .when(tag == "remote", "Remote")
        .when(tag != "", "On-site")
        .when(has(location, _HYBRID), "Hybrid")
        .when(has(location, _REMOTE) | has(location, _COUNTRY_ONLY), "Remote")
        .when(has(body, _HYBRID_WORK) | has(body, _CADENCE), "Hybrid")
        .when(has(start, _ON_SITE), "On-site")
        .when(F.coalesce(remote_flag, F.lit(False)) & has(start, _REMOTE), "Remote")
        .otherwise("On-site")
    )


def moment(value: Column) -> Column:
    """A timestamp from seconds or milliseconds since 1970, or from a usual way of writing one; null if it is none."""
    number = value.try_cast("double")
    return F.coalesce(
        F.when(number > 1e11, F.timestamp_millis(number.cast("long"))).when(number.isNotNull(), F.timestamp_seconds(number.cast("long"))),
        F.try_to_timestamp(value),
        F.try_to_timestamp(value, F.lit("MMM d, yyyy")),
        F.try_to_timestamp(value, F.lit("MMMM d, yyyy")),
        F.try_to_timestamp(value, F.lit("M/d/yyyy")),
    )


def age_days(at: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400_000_000.0)


def banded(value: Column, bands: list[tuple[float, float]], otherwise: float) -> Column:
    """The score of the first band whose upper end the value doesn't pass."""
    out = None
    for most, score in bands:
        out = (F if out is None else out).when(value <= most, F.lit(score))
    return out.otherwise(F.lit(otherwise))
