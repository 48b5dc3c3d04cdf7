"""Postings from landed feed files: each adapter maps one feed's JSON to the canonical row, as a DataFrame.

Input: one row a landed payload, with company, slug and payload (the JSON as text). Fetching is not
part of this: a crawler lands files, Spark reads them. Output: one row a posting with the
columns of COLUMNS. A payload that is no JSON of the feed's shape gives no rows; a missing
field is null, or empty where the canonical row has text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesift.functions import location, pay, text, work

COLUMNS = ["ats", "source_slug", "source_id", "company", "title", "url", "apply_url", "location_raw", "city", "region", "country", "work_model", "is_remote", "department", "team", "employment_type", "salary_min", "salary_max", "salary_raw", "equity_mentioned", "bonus_mentioned", "published_at", "date_confidence", "description"]

# The feeds' public addresses.
URLS = {
    "greenhouse": "https://boards-api.greenhouse.io/v1/boards/{slug}/jobs?content=true",
    "ashby": "https://api.ashbyhq.com/posting-api/job-board/{slug}?includeCompensation=true",
    "lever": "https://api.lever.co/v0/postings/{slug}?mode=json",
    "smartrecruiters": "https://api.smartrecruiters.com/v1/companies/{slug}/postings?limit={limit}&offset={offset}",
    "smartrecruiters_detail": "https://api.smartrecruiters.com/v1/companies/{slug}/postings/{posting_id}",
    "workable": "https://apply.workable.com/api/v1/widget/accounts/{slug}?details=true",
    "workday": "https://{tenant}.{instance}.myworkdayjobs.com/wday/cxs/{tenant}/{site}/jobs",
    "workday_page": "https://{tenant}.{instance}.myworkdayjobs.com/{site}{path}",
    "workday_detail": "https://{tenant}.{instance}.myworkdayjobs.com/wday/cxs/{tenant}/{site}{path}",
    "eightfold": "https://{sub}.eightfold.ai/api/pcsx/search?domain={domain}&query=&start={start}&num=10",
    "eightfold_detail": "https://{sub}.eightfold.ai/api/apply/v2/jobs/{posting_id}?domain={domain}",
    "eightfold_page": "https://{sub}.eightfold.ai/careers/job/{posting_id}",
    "eightfold_path": "https://{sub}.eightfold.ai{path}",
}


def address(feed: str, slug: Column | str, **parts: Column | str | int) -> Column:
    """The feed's address for a slug, as a column."""
    out = F.lit(URLS[feed])
    for name, value in {"slug": slug, **parts}.items():
        by = value if isinstance(value, Column) else F.col(value) if name in ("slug", "posting_id") else F.lit(str(value))
        out = F.replace(out, F.lit(f"{{{name}}}"), by.cast("string"))
    return out


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(company, slug, payload) of files that lie at .../company=<name>/slug=<slug>/<file>, one payload a file."""
    return spark.read.text(path, wholetext=True).select("company", "slug", F.col("value").alias("payload"))


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _text(c: str | Column) -> Column:
    return text.cleaned((F.col(c) if isinstance(c, str) else c).cast("string"))


def _jobs(rows: DataFrame, schema: str) -> DataFrame:
    """One row a job of payloads with a list named jobs (or the schema's only field)."""
    name = schema.split(":")[0].strip()
    return rows.select("company", "slug", F.explode(F.from_json("payload", f"struct<{schema}>")[name]).alias("job")).where("job is not null").select("company", "slug", "job.*")


def _posting(rows: DataFrame, ats: str, made: dict[str, Column], *, stated: Column | None = None, flag: Column | None = None, own_pay: tuple[Column, Column] | None = None, pay_texts: tuple[str, ...] = ("description",), remote: Column | None = None, address_: dict[str, Column] | None = None, sure: Column | None = None) -> DataFrame:
    """The canonical row, with what every feed derives alike: place, work model, pay, mentions, date."""
    out = rows.select("company", "slug", *(c.alias(n) for n, c in made.items()), (sure if sure is not None else F.lit(True)).alias("sure"), (stated if stated is not None else F.lit(None).cast("string")).alias("stated"), (flag if flag is not None else F.lit(None).cast("boolean")).alias("flag"), *(c.alias(n) for c, n in zip(own_pay or (F.lit(None).cast("int"),) * 2, ("own_low", "own_high"), strict=True)), (remote if remote is not None else F.lit(None).cast("boolean")).alias("remote_flag"), *(c.alias(f"own_{n}") for n, c in (address_ or {}).items()))
    out = location.with_place(out, "location_raw").withColumn("model", work.work_model(F.col("stated"), F.col("flag"), F.col("location_raw"), F.col("description")))
    for i, c in enumerate(pay_texts):
        out = out.withColumn(f"pay{i}", pay.pay_range(c))
    found = F.coalesce(*(F.when(F.col(f"pay{i}.low").isNotNull(), F.col(f"pay{i}")) for i in range(len(pay_texts))))
    said = F.concat_ws(" ", "salary_raw", "description")
    own = lambda n: F.coalesce(f"place.{n}", _blank(F.col(f"own_{n}"))) if f"own_{n}" in out.columns else F.col(f"place.{n}")
    return out.select(
        F.lit(ats).alias("ats"),
        F.col("slug").alias("source_slug"),
        F.coalesce("source_id", F.lit("")).alias("source_id"),
        "company",
        "title",
        "url",
        F.coalesce(_blank(F.col("apply_url")), "url").alias("apply_url"),
        "location_raw",
        *(own(n).alias(n) for n in ("city", "region", "country")),
        F.col("model").alias("work_model"),
        F.coalesce("remote_flag", F.col("model") == "Remote").alias("is_remote"),
        *(_blank(F.col(n)).alias(n) for n in ("department", "team", "employment_type")),
        F.when(F.col("own_low").isNotNull(), F.col("own_low")).otherwise(found["low"]).alias("salary_min"),
        F.when(F.col("own_low").isNotNull(), F.col("own_high")).otherwise(found["high"]).alias("salary_max"),
        _blank(F.col("salary_raw")).alias("salary_raw"),
        pay.names_equity(said).alias("equity_mentioned"),
        pay.names_bonus(said).alias("bonus_mentioned"),
        work.moment(F.col("published")).alias("published_at"),
        F.when(work.moment(F.col("published")).isNotNull(), F.when(F.col("sure"), "high").otherwise("low")).otherwise("none").alias("date_confidence"),
        "description",
    )


def greenhouse(rows: DataFrame) -> DataFrame:
    """Content is escaped twice; pay ranges are in cents; metadata is kept as the written pay."""
    jobs = _jobs(rows, "jobs: array<struct<id: string, title: string, absolute_url: string, content: string, location: struct<name: string>, metadata: array<struct<name: string, value: string>>, pay_input_ranges: array<struct<min_cents: double, max_cents: double>>, first_published: string, updated_at: string, departments: array<struct<name: string>>, offices: array<struct<name: string>>>>")
    jobs = jobs.withColumn("plain", text.html_text(text.unescaped("content")))
    values = F.filter("metadata", lambda m: F.coalesce(m["value"], F.lit("")) != "")
    # A list of values comes as JSON text: ["a","b"] reads a, b.
    told = lambda v: F.when(F.startswith(v, F.lit("[")), F.array_join(F.from_json(v, "array<string>"), ", ")).otherwise(v)
    meta = F.array_join(F.filter(F.transform(values, lambda m: F.concat(m["name"], F.lit(": "), told(m["value"]))), lambda x: ~F.endswith(x, F.lit(": "))), " | ")
    cents = lambda n: F.filter(F.transform("pay_input_ranges", lambda r: r[n]), lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    lows, highs = cents("min_cents"), cents("max_cents")
    both = (F.size(lows) > 0) & (F.size(highs) > 0)
    made = {
        "source_id": F.col("id"), "title": _text("title"), "url": _text("absolute_url"), "apply_url": _text("absolute_url"), "location_raw": _text("location.name"),
        "department": _text(F.get("departments", F.lit(0))["name"]), "team": _text(F.get("offices", F.lit(0))["name"]), "employment_type": F.lit(""),
        "salary_raw": F.coalesce(meta, F.lit("")), "published": F.coalesce(_blank(F.col("first_published")), "updated_at"),
        "description": F.coalesce(_blank(F.col("plain")), _text("content")),
    }
    return _posting(jobs, "greenhouse", made, own_pay=(F.when(both, F.array_min(lows) / 100).cast("int"), F.when(both, F.array_max(highs) / 100).cast("int")))


def ashby(rows: DataFrame) -> DataFrame:
    """Unlisted jobs are left out; the compensation block counts before the body; the postal address fills what the location lacks."""
    jobs = _jobs(rows, "jobs: array<struct<id: string, title: string, jobUrl: string, applyUrl: string, isListed: boolean, isRemote: boolean, workplaceType: string, location: string, address: struct<postalAddress: struct<addressLocality: string, addressRegion: string, addressCountry: string>>, descriptionPlain: string, descriptionHtml: string, department: string, team: string, employmentType: string, publishedAt: string, updatedAt: string, compensation: struct<compensationTierSummary: string, scrapeableCompensationSalarySummary: string, compensationTiers: array<struct<tierSummary: string, additionalInformation: string>>>>>").where("isListed is null or isListed")
    tiers = F.flatten(F.transform(F.coalesce("compensation.compensationTiers", F.array()), lambda t: F.array(t["tierSummary"], t["additionalInformation"])))
    said = F.array_join(F.filter(F.concat(F.array("compensation.compensationTierSummary", "compensation.scrapeableCompensationSalarySummary"), tiers), lambda x: F.coalesce(x, F.lit("")) != ""), " ")
    at = "address.postalAddress"
    made = {
        "source_id": F.col("id"), "title": _text("title"), "url": _text("jobUrl"), "apply_url": _text("applyUrl"), "location_raw": _text("location"),
        "department": _text("department"), "team": _text("team"), "employment_type": _text("employmentType"), "salary_raw": _text(said),
        "published": F.coalesce(_blank(F.col("publishedAt")), "updatedAt"), "description": F.coalesce(_blank(_text("descriptionPlain")), text.html_text("descriptionHtml")),
    }
    return _posting(jobs, "ashby", made, stated=F.col("workplaceType"), flag=F.col("isRemote"), remote=F.coalesce("isRemote", F.lit(False)), pay_texts=("salary_raw", "description"), address_={"city": _text(f"{at}.addressLocality"), "region": _text(f"{at}.addressRegion"), "country": _text(f"{at}.addressCountry")})


def lever(rows: DataFrame) -> DataFrame:
    """A bare list of jobs; the description is the body, the additional part and the titled lists."""
    wrapped = rows.withColumn("payload", F.concat(F.lit('{"jobs":'), F.col("payload"), F.lit("}")))
    jobs = _jobs(wrapped, "jobs: array<struct<id: string, text: string, hostedUrl: string, applyUrl: string, createdAt: string, descriptionPlain: string, description: string, additionalPlain: string, additional: string, lists: array<struct<text: string, content: string>>, categories: struct<location: string, department: string, team: string, commitment: string>, workplaceType: string, salaryRange: struct<min: double, max: double>>>")
    # The lists are put into markup, so that one pass makes text of all of them.
    listed = F.transform(F.filter("lists", lambda x: F.coalesce(x["content"], F.lit("")) != ""), lambda x: F.concat(F.lit("<p>"), F.coalesce(x["text"], F.lit("")), F.lit("</p>"), x["content"]))
    body = [F.coalesce(_blank(_text("descriptionPlain")), text.html_text("description")), F.coalesce(_blank(_text("additionalPlain")), text.html_text("additional")), text.html_text(F.array_join(listed, "<br><br>"))]
    made = {
        "source_id": F.col("id"), "title": _text("text"), "url": _text("hostedUrl"), "apply_url": _text("applyUrl"), "location_raw": _text("categories.location"),
        "department": _text("categories.department"), "team": _text("categories.team"), "employment_type": _text("categories.commitment"), "salary_raw": F.lit(""),
        "published": F.col("createdAt"), "description": F.array_join(F.filter(F.array(*body), lambda x: x != ""), "\n\n"),
    }
    return _posting(jobs, "lever", made, stated=F.col("workplaceType"), own_pay=(F.col("salaryRange.min").cast("int"), F.col("salaryRange.max").cast("int")))


def _last_landed(details: DataFrame) -> DataFrame:
    """(d_slug, d_id, payload): of details that landed more than once the last one, by landed_at where the input has it; ties go to the greater payload."""
    at = F.col("landed_at") if "landed_at" in details.columns else F.lit(None).cast("timestamp")
    last = F.max(F.struct(at.alias("at"), "payload"))["payload"]
    return details.groupBy(F.col("slug").alias("d_slug"), F.col("posting_id").alias("d_id")).agg(last.alias("payload"))


def smartrecruiters(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Lists hold summaries; details (slug, posting_id, payload) are joined by id. A job without detail has no description."""
    jobs = _jobs(rows, "content: array<struct<id: string, name: string, releasedDate: string, createdOn: string, location: struct<city: string, region: string, country: string, remote: boolean>, department: struct<label: string>, `function`: struct<label: string>, typeOfEmployment: struct<label: string>>>")
    part = "struct<text: string>"
    parsed = F.from_json("payload", f"struct<applyUrl: string, jobAd: struct<sections: struct<companyDescription: {part}, jobDescription: {part}, qualifications: {part}, additionalInformation: {part}>>>")
    told = _last_landed(details).withColumn("d", parsed).drop("payload")
    jobs = jobs.join(told, (F.col("slug") == F.col("d_slug")) & (F.col("id") == F.col("d_id")), "left")
    sections = [text.html_text(f"d.jobAd.sections.{x}.text") for x in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")]
    places = F.array_join(F.filter(F.array("location.city", "location.region", "location.country"), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    link = F.coalesce(_blank(_text("d.applyUrl")), F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("slug"), F.lit("/"), F.coalesce("id", F.lit(""))))
    remote = F.coalesce("location.remote", F.lit(False))
    made = {
        "source_id": F.col("id"), "title": _text("name"), "url": link, "apply_url": link, "location_raw": _text(places),
        "department": _text("department.label"), "team": _text(F.col("function")["label"]), "employment_type": _text("typeOfEmployment.label"), "salary_raw": F.lit(""),
        "published": F.coalesce(_blank(F.col("releasedDate")), "createdOn"), "description": F.array_join(F.filter(F.array(*sections), lambda x: x != ""), "\n\n"),
    }
    return _posting(jobs, "smartrecruiters", made, stated=F.when(remote, "Remote"), flag=remote, remote=remote)


def total_found(rows: DataFrame) -> DataFrame:
    """(slug, total): how many postings the feed says there are."""
    return rows.select("slug", F.get_json_object("payload", "$.totalFound").try_cast("int").alias("total"))


def workable(rows: DataFrame) -> DataFrame:
    """The location is a text or a struct; either of two remote flags counts."""
    jobs = _jobs(rows, "jobs: array<struct<id: string, shortcode: string, title: string, url: string, application_url: string, shortlink: string, location: string, city: string, telecommuting: boolean, remote: boolean, description: string, requirements: string, benefits: string, published_on: string, created_at: string, department: string, employment_type: string>>")
    parts = F.from_json("location", "struct<city: string, region: string, country: string>")
    inside = F.array_join(F.filter(F.array(parts["city"], parts["region"], parts["country"]), lambda x: F.coalesce(x, F.lit("")) != ""), ", ")
    where = F.when(F.startswith("location", F.lit("{")), inside).otherwise(F.coalesce(_blank(F.col("location")), "city"))
    remote = F.coalesce("telecommuting", F.lit(False)) | F.coalesce("remote", F.lit(False))
    made = {
        "source_id": F.coalesce(_blank(F.col("id")), "shortcode"), "title": _text("title"), "url": _text(F.coalesce(_blank(F.col("url")), _blank(F.col("application_url")), "shortlink")), "apply_url": _text("application_url"), "location_raw": _text(where),
        "department": _text("department"), "team": F.lit(""), "employment_type": _text("employment_type"), "salary_raw": F.lit(""),
        "published": F.coalesce(_blank(F.col("published_on")), "created_at"), "description": F.array_join(F.filter(F.array(*(text.html_text(c) for c in ("description", "requirements", "benefits"))), lambda x: x != ""), "\n\n"),
    }
    return _posting(jobs, "workable", made, stated=F.when(remote, "Remote"), flag=remote, remote=remote)


def _slug_parts(slug: Column | str, names: tuple[str, ...]) -> tuple[Column, dict[str, Column]]:
    """(whether the slug has just these parts, none empty; the parts by name). Parts stand between colons."""
    parts = F.split(F.coalesce(F.col(slug) if isinstance(slug, str) else slug, F.lit("")), ":")
    whole = (F.size(parts) == len(names)) & ~F.exists(parts, lambda x: F.trim(x) == "")
    return whole, {n: F.trim(F.get(parts, F.lit(i))) for i, n in enumerate(names)}


def workday_address(slug: Column | str, feed: str = "workday", path: Column | str = "") -> Column:
    """The address of a slug tenant:instance:site; empty for another form of slug. Pages and details need the posting's path."""
    whole, parts = _slug_parts(slug, ("tenant", "instance", "site"))
    at = path if isinstance(path, Column) else F.lit(path)
    rooted = F.when((feed == "workday_detail") & ~F.startswith(at, F.lit("/")), F.concat(F.lit("/"), at)).otherwise(at)
    return F.when(whole, address(feed, slug, **parts, path=F.coalesce(rooted, F.lit("")))).otherwise("")


def eightfold_address(slug: Column | str, feed: str = "eightfold", **more: Column | str | int) -> Column:
    """The address of a slug subdomain:domain; empty where the first part can't be a host name's label."""
    whole, parts = _slug_parts(slug, ("sub", "domain"))
    label = parts["sub"].rlike("(?i)^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$")
    return F.when(whole & label, address(feed, slug, **parts, **more)).otherwise("")


def _with_details(jobs: DataFrame, details: DataFrame, key: str, schema: str) -> DataFrame:
    """The jobs with a struct d from details (slug, posting_id, payload), one row a job."""
    told = _last_landed(details).withColumn("d", F.from_json("payload", schema)).drop("payload")
    return jobs.join(told, (F.col("slug") == F.col("d_slug")) & (F.col(key) == F.col("d_id")), "left")


def workday(rows: DataFrame, details: DataFrame, as_of: Column | str) -> DataFrame:
    """Details are joined by externalPath. 'Posted 5 Days Ago' is counted back from as_of, the time at which the list was landed."""
    jobs = _jobs(rows, "jobPostings: array<struct<title: string, externalPath: string, locationsText: string, postedOn: string, bulletFields: array<string>>>")
    jobs = _with_details(jobs, details, "externalPath", "struct<jobPostingInfo: struct<jobDescription: string, location: string, startDate: string, postedOn: string, externalUrl: string, remoteType: string, jobPostingTitle: string, timeType: string>>")
    info = lambda n: F.col(f"d.jobPostingInfo.{n}")
    now = (F.lit(as_of) if isinstance(as_of, str) else as_of).cast("timestamp")
    stated = F.coalesce(_blank(info("startDate")), info("postedOn"))
    told = F.coalesce(_blank(F.col("postedOn")), info("postedOn"))
    ago = F.when(F.contains(F.lower(told), F.lit("today")), 0).otherwise(F.regexp_extract(told, r"(?i)(\d+)\+?\s*days?\s+ago", 1).try_cast("int"))
    back = F.timestamp_seconds(F.unix_timestamp(now) - ago * 86_400).cast("string")
    where, path = F.coalesce(_blank(info("location")), "locationsText"), F.coalesce("externalPath", F.lit(""))
    link = F.coalesce(_blank(workday_address("slug", "workday_page", path)), _text(info("externalUrl")))
    made = {
        "source_id": F.coalesce(_blank(_text(F.get("bulletFields", F.lit(0)))), F.regexp_extract(path, "([^/]*)/*$", 1)), "title": _text(F.coalesce(_blank(F.col("title")), info("jobPostingTitle"))), "url": link, "apply_url": link, "location_raw": _text(where),
        "department": F.lit(""), "team": F.lit(""), "employment_type": _text(info("timeType")), "salary_raw": F.lit(""),
        "published": F.when(work.moment(stated).isNotNull(), stated).otherwise(back), "description": text.html_text(info("jobDescription")),
    }
    remote = _blank(_text(info("remoteType")))
    return _posting(jobs, "workday", made, stated=remote, flag=remote.isNotNull() | F.coalesce(F.contains(F.lower(where), F.lit("remote")), F.lit(False)))


def eightfold(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Details are joined by id. Without a time of posting the time at which the job was made counts, with low confidence; jobs without a title are left out."""
    inner = rows.withColumn("payload", F.get_json_object("payload", "$.data"))
    jobs = _jobs(inner, "positions: array<struct<id: string, displayJobId: string, name: string, positionUrl: string, standardizedLocations: array<string>, locations: array<string>, location: string, postedTs: string, creationTs: string, workLocationOption: string>>")
    jobs = _with_details(jobs, details, "id", "struct<id: string, display_job_id: string, name: string, posting_name: string, job_description: string, canonicalPositionUrl: string, locations: array<string>, location: string, t_create: string, work_location_option: string, custom_JD: struct<data_fields: struct<timeType: array<string>>>>")
    first = lambda c: F.when(F.size(c) > 0, F.coalesce(F.get(c, F.lit(0)), F.lit("")))
    where = F.coalesce(first("standardizedLocations"), first("locations"), _blank(F.col("location")), first("d.locations"), F.col("d.location"))
    positive = lambda c: F.when(F.col(c).try_cast("double") > 0, F.col(c))
    posted, number = positive("postedTs"), F.coalesce(_blank(F.col("id")), "d.id")
    page = F.when(F.coalesce(number, F.lit("")) != "", eightfold_address("slug", "eightfold_page", posting_id=number))
    by_path = F.when(F.coalesce("positionUrl", F.lit("")) != "", eightfold_address("slug", "eightfold_path", path=F.col("positionUrl")))
    link = F.coalesce(_blank(_text("d.canonicalPositionUrl")), _blank(page), _blank(by_path), F.lit(""))
    made = {
        "source_id": F.coalesce(_blank(_text(F.coalesce(_blank(F.col("displayJobId")), "d.display_job_id"))), number), "title": _text(F.coalesce(_blank(F.col("name")), _blank(F.col("d.name")), "d.posting_name")), "url": link, "apply_url": link, "location_raw": _text(where),
        "department": F.lit(""), "team": F.lit(""), "employment_type": _text(F.get("d.custom_JD.data_fields.timeType", F.lit(0))), "salary_raw": F.lit(""),
        "published": F.coalesce(posted, positive("d.t_create"), positive("creationTs")), "description": text.html_text("d.job_description"),
    }
    option = _blank(_text(F.coalesce(_blank(F.col("workLocationOption")), "d.work_location_option")))
    out = _posting(jobs, "eightfold", made, stated=option, flag=F.coalesce(F.contains(F.lower(where), F.lit("remote")), F.lit(False)), sure=posted.isNotNull())
    return out.where("title <> ''")


ADAPTERS = {"greenhouse": greenhouse, "ashby": ashby, "lever": lever, "workable": workable}
