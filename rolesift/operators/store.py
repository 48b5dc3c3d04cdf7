"""The posting store as append-only logs: what a keyed store updates in place is an event here, and the present is a view.

Logs (columns beside their own):
- postings: posting_id, seq, seen_at, run_id and the posting's fields: one row a sighting.
- states: posting_id, seq, state, reason. liveness: posting_id, seq, is_live. tracks: posting_id, seq, tracks.
- evaluations: eval_id, posting_id, run_id, track, score, verdict. nudges: eval_id, seq, base, adjustment, note, quotes.
- verdicts: verdict_id, posting_id, verdict, reason, created_at. presentations: posting_id, run_id, shown_at.
- runs: run_id, seq, mode, counts. rules: rule_id, rule, active. backlog: company, display, seq, at, kind.

seq orders a key's events; a later one wins. Every view is one aggregation by key with
partial sums before the shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# The states of a posting.
NEW, PREFILTERED, REJECTED, EVALUATED, PRESENTED = "new", "prefiltered", "rejected_prefilter", "evaluated", "presented"
VERDICTS = ("interested", "saved", "not_interested", "applied")
SUPPRESSED = (PRESENTED, *VERDICTS)
MOST_ATTEMPTS = 3


def append(rows: DataFrame, root: str, log: str) -> None:
    """Adds rows to a log. Spark commits a batch whole or not at all."""
    rows.write.mode("append").parquet(f"{root.rstrip('/')}/{log}")


def read_log(spark: SparkSession, root: str, log: str, schema: str | StructType) -> DataFrame:
    """A log with the given columns; a column that older files lack is null, and a log not yet written has no rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{log}")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path.toString())


def posting_id(ats: Column | str, slug: Column | str, source_id: Column | str) -> Column:
    """The same for the same natural key, whichever run sees it."""
    return F.xxhash64(*(F.col(c) if isinstance(c, str) else c for c in (ats, slug, source_id)))


def _sightings(log: DataFrame) -> DataFrame:
    """A log's rows as views of one event each."""
    return log.withColumnsRenamed({"seen_at": "first_seen"}).withColumns({"last_seen": F.col("first_seen"), "times_seen": F.lit(1).cast("long")})


def _merged(views: DataFrame, key: str) -> DataFrame:
    """Views of the same keys made one: the latest fields, the ends of the time, the sum of the sightings."""
    fields = [c for c in views.columns if c not in (key, "seq", "first_seen", "last_seen", "times_seen")]
    out = views.groupBy(key).agg(F.max_by(F.struct(*fields), "seq").alias("r"), F.max("seq").alias("seq"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"))
    return out.select(key, "seq", "r.*", "first_seen", "last_seen", "times_seen")


def view(log: DataFrame, key: str = "posting_id") -> DataFrame:
    """The present with the seq of each key's last event, to be merged with later events."""
    return _merged(_sightings(log), key)


def current(log: DataFrame, key: str = "posting_id", known: DataFrame | None = None) -> DataFrame:
    """Each key's latest fields with first_seen, last_seen and times_seen: insert or refresh. `known` is an earlier view with its seq; the log then has later events only."""
    rows = _sightings(log)
    return _merged(rows if known is None else known.unionByName(rows), key).drop("seq")


def _snapshot(spark: SparkSession, root: str, log: str) -> tuple[int, str] | None:
    """(last seq, path) of the newest finished snapshot of a log. One that was cut off has no mark of success and doesn't count."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_snapshots/{log}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in files.listStatus(path)] if files.exists(path) else []
    done = [(int(x.getName()), x.toString()) for x in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return max(done, default=None)


def _known_and_tail(spark: SparkSession, root: str, log: str, schema: str | StructType) -> tuple[DataFrame | None, DataFrame]:
    last, rows = _snapshot(spark, root, log), read_log(spark, root, log, schema)
    return (None, rows) if last is None else (spark.read.parquet(last[1]), rows.where(F.col("seq") > last[0]))


def snapshot(spark: SparkSession, root: str, log: str, schema: str | StructType, key: str = "posting_id") -> None:
    """Writes the view of a log up to its last event, from the snapshot before and the events since. seq grows over all appends of the log.

    Readers see it when all of it is there; the log stays, and a snapshot that is cut off can be written again.
    """
    known, tail = _known_and_tail(spark, root, log, schema)
    last = tail.agg(F.max("seq")).first()[0]
    if last is not None:
        rows = _sightings(tail)
        _merged(rows if known is None else known.unionByName(rows), key).write.mode("overwrite").parquet(f"{root.rstrip('/')}/_snapshots/{log}/{last}")


def current_of(spark: SparkSession, root: str, log: str, schema: str | StructType, key: str = "posting_id") -> DataFrame:
    """The present of a log: its newest snapshot and the events since; only these are read from the log."""
    known, tail = _known_and_tail(spark, root, log, schema)
    return current(tail, key, known)


# ---- saved and live texts

UPDATED, SAME, TAKEN_DOWN, UNSAVED = "UPDATED", "same as saved", "TAKEN DOWN", "not saved"


def live_status(saved: DataFrame, live: DataFrame, key: str = "posting_id", body: str = "description") -> DataFrame:
    """(key, status) of every key of either side, one row a key each: by digests of the trimmed texts, so that no text is shuffled. An empty live text is none."""
    digest = lambda c: F.sha2(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), 256)
    here = saved.select(key, digest(F.coalesce(body, F.lit(""))).alias("a"))
    there = live.where(F.col(body) != "").select(key, digest(F.col(body)).alias("b"))
    status = F.when(F.col("b").isNull(), TAKEN_DOWN).when(F.col("a").isNull(), UNSAVED).when(F.col("a") == F.col("b"), SAME).otherwise(UPDATED)
    return here.join(there, key, "full").select(key, status.alias("status"))


def refreshed(saved: DataFrame, live: DataFrame, key: str = "posting_id", body: str = "description") -> DataFrame:
    """The saved rows with status, is_live, and the live text where it is another; what is taken down keeps its saved text."""
    status = live_status(saved, live, key, body).where(F.col("status") != UNSAVED)
    fresh = live.join(status.where(F.col("status") == UPDATED), key, "left_semi").select(key, F.col(body).alias("__fresh"))
    out = saved.join(status, key, "left").join(fresh, key, "left")
    return out.withColumns({body: F.coalesce("__fresh", body), "is_live": F.col("status") != TAKEN_DOWN}).drop("__fresh")


def states(log: DataFrame, key: str = "posting_id") -> DataFrame:
    """(key, state) of every key with an event.

    A score never takes a shown posting back, and a reject counts for postings that are not
    yet scored only; anything else sets the state. So the last setting event tells, and
    whether a score or else a reject came after it.
    """
    kind = F.col("state")
    at = lambda which: F.max(F.when(which, F.col("seq")))
    setting = ~kind.isin(EVALUATED, REJECTED)
    last = log.groupBy(key).agg(F.max_by(F.when(setting, kind), F.when(setting, F.col("seq"))).alias("s"), at(setting).alias("at"), at(kind == EVALUATED).alias("scored"), at(kind == REJECTED).alias("refused"))
    after = lambda c: F.coalesce(F.col(c) > F.col("at"), F.col("at").isNull() & F.col(c).isNotNull())
    state = F.when(F.col("s").isin(*SUPPRESSED), F.col("s")).when(after("scored"), EVALUATED).when(after("refused"), REJECTED).otherwise(F.coalesce("s", F.lit(NEW)))
    return last.select(key, state.alias("state"))


def latest_value(log: DataFrame, value: str, key: str = "posting_id", order: str = "seq") -> DataFrame:
    return log.groupBy(key).agg(F.max_by(value, order).alias(value))


def latest_evaluation(evaluations: DataFrame, track: str | None = None, order: str = "eval_id") -> DataFrame:
    """Each posting's last evaluation, of one track if named."""
    rows = evaluations if track is None else evaluations.where(F.col("track") == track)
    fields = [c for c in rows.columns if c != "posting_id"]
    return rows.groupBy("posting_id").agg(F.max_by(F.struct(*fields), order).alias("r")).select("posting_id", "r.*")


def nudged(evaluations: DataFrame, nudges: DataFrame, most: float = 5.0) -> DataFrame:
    """Evaluations with adjustment and final: the last nudge replaces earlier ones, from the base score, within 1 and `most`."""
    last = nudges.groupBy("eval_id").agg(F.max_by(F.struct("adjustment", "note", "quotes"), "seq").alias("n")).select("eval_id", F.round("n.adjustment", 3).alias("adjustment"), "n.note", "n.quotes")
    moved = F.least(F.lit(most), F.greatest(F.lit(1.0), F.round(F.col("score") + F.col("adjustment"), 3)))
    return evaluations.join(last, "eval_id", "left").withColumn("final", F.when(F.col("adjustment").isNotNull(), moved).otherwise(F.col("score")))


def backlog(log: DataFrame) -> DataFrame:
    """(company, display, first_seen, last_seen, times_seen, attempts) of the companies waiting for a board.

    log: company (key), display, seq, at, kind: seen, tried or cleared. Events up to a
    company's last clearing are gone. The first event makes the row, seen once; a later
    sighting counts one more, a try one attempt.
    """
    told = log.where("company is not null and company <> ''")
    gone = told.where("kind = 'cleared'").groupBy("company").agg(F.max("seq").alias("gone"))
    rows = told.where("kind <> 'cleared'").join(gone, "company", "left").where("gone is null or seq > gone")
    tried_first = F.when(F.min_by("kind", "seq") == "tried", 1).otherwise(0)
    return rows.groupBy("company").agg(F.min_by("display", "seq").alias("display"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), (F.count_if(F.col("kind") == "seen") + tried_first).alias("times_seen"), F.count_if(F.col("kind") == "tried").alias("attempts"))


def backlog_to_try(waiting: DataFrame, limit: int) -> DataFrame:
    return waiting.where(F.col("attempts") < MOST_ATTEMPTS).orderBy("attempts", "first_seen", F.desc("times_seen"), "company").limit(max(0, limit)).select(F.coalesce("display", "company").alias("company"))


def backlog_exhausted(waiting: DataFrame) -> DataFrame:
    return waiting.where(F.col("attempts") >= MOST_ATTEMPTS).orderBy("company").select(F.coalesce("display", "company").alias("company"))


def runs(log: DataFrame) -> DataFrame:
    """One row a run: what was told last of each count."""
    fields = [c for c in log.columns if c not in ("run_id", "seq")]
    return log.groupBy("run_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields))


def latest_run(run_rows: DataFrame, mode: str | None = None) -> DataFrame:
    return (run_rows if mode is None else run_rows.where(F.col("mode") == mode)).orderBy(F.desc("run_id")).limit(1)


def suppressed_keys(postings: DataFrame, key: str = "fingerprint") -> DataFrame:
    return postings.where(F.col("state").isin(*SUPPRESSED)).select(key).distinct()


def already_evaluated(postings: DataFrame, evaluations: DataFrame, rubric: str | None = None, key: str = "fingerprint") -> DataFrame:
    rows = evaluations if rubric is None else evaluations.where(F.col("rubric") == rubric)
    return postings.join(rows.select("posting_id"), "posting_id", "left_semi").select(key).distinct()


def presentable(postings: DataFrame, evaluations: DataFrame, bar: float, bucket: str | None = None, floor: float | None = None, limit: int | None = None) -> DataFrame:
    """Scored, live and unseen postings at or above the bar, best first; with a floor those from it up to the bar instead. The bucket is filtered before the limit."""
    rows = postings.where((F.col("state") == EVALUATED) & F.col("is_live")).join(latest_evaluation(evaluations), "posting_id").where("verdict <> 'FAIL'")
    rows = rows.where(F.col("score") >= bar) if floor is None else rows.where((F.col("score") < bar) & (F.col("score") >= floor))
    rows = (rows if bucket is None else rows.where(F.col("bucket") == bucket)).orderBy(F.desc("score"), "posting_id")
    return rows if limit is None else rows.limit(limit)


def with_judgement(postings: DataFrame, evaluations: DataFrame, verdicts: DataFrame, only: str | None = None) -> DataFrame:
    """Postings with their last evaluation and last verdict (of one kind if named); neither need be there."""
    told = verdicts if only is None else verdicts.where(F.col("verdict") == only)
    last = told.groupBy("posting_id").agg(F.max_by(F.struct(F.col("verdict").alias("judged"), F.col("reason").alias("judged_reason"), "created_at"), "verdict_id").alias("v")).select("posting_id", "v.*")
    return postings.join(latest_evaluation(evaluations).select("posting_id", "score"), "posting_id", "left").join(last, "posting_id", "left")


def prior_applications(postings: DataFrame, verdicts: DataFrame, company: str = "company_key") -> DataFrame:
    """(company, applications): the different (day, title) pairs, newest first."""
    rows = postings.join(verdicts.where("verdict = 'applied'").select("posting_id", "created_at"), "posting_id").where(F.col(company) != "")
    each = rows.groupBy(company, F.substring(F.col("created_at").cast("string"), 1, 10).alias("day"), "title").agg(F.max("created_at").alias("at"))
    pairs = F.reverse(F.array_sort(F.collect_list(F.struct("at", "day", "title"))))
    return each.groupBy(company).agg(F.transform(pairs, lambda x: F.struct(x["day"].alias("day"), x["title"].alias("title"))).alias("applications"))


# ---- the tie-break

BAND, MOST_NUDGE, LEAST_QUOTES, LEAST_QUOTE = 0.20, 0.15, 2, 25


def close_call(score: Column, bar: Column) -> Column:
    """Whether a score is near enough to the bar for a nudge."""
    return F.coalesce((score >= F.round(bar - BAND, 4)) & (score <= F.round(bar + BAND, 4)), F.lit(False))


def _flat(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def nudge_problems(adjustment: Column, quotes: Column, body: Column, base: Column, bar: Column) -> Column:
    """An array of the reasons to refuse a nudge: band, size, too few quotes, a quote that is not in the body."""
    real = F.filter(F.coalesce(quotes, F.array().cast("array<string>")), lambda q: F.length(F.trim(q)) >= LEAST_QUOTE)
    return F.array_compact(
        F.array(
            F.when(~close_call(base, bar), F.lit("outside the band")),
            F.when(F.abs(adjustment) > MOST_NUDGE + 1e-9, F.lit("too large")),
            F.when(F.size(real) < LEAST_QUOTES, F.lit("too few quotes")),
            F.when(F.exists(real, lambda q: ~F.contains(_flat(body), _flat(q))), F.lit("quote not in the posting")),
        )
    )


# ---- the rubric's score


def rubric_score(scores: Column, notes: Column, weights: dict[str, float], *, evidence: tuple[str, ...] = (), blocks: dict[str, str] | None = None, modifier: Column | float = 0.0, connected: Column | bool = False) -> Column:
    """The score of a map dimension -> number: null where a weighted dimension is missing (a null one leaves the mean).

    Dimensions of the blocks in `evidence` count 3 at most without a quotation mark in the
    block's note. A modifier that isn't 0 leaves 1 at least, a connection adds 1, and 5 is the most.
    """
    have, total = F.lit(0.0), F.lit(0.0)
    for name, w in sorted(weights.items()):
        s = scores[name]
        if (block := (blocks or {}).get(name)) in evidence:
            quoted = F.coalesce(F.contains(notes[block], F.lit('"')) | F.contains(notes[block], F.lit("'")), F.lit(False))
            s = F.when((s > 3.0) & ~quoted, F.lit(3.0)).otherwise(s)
        have += F.when(s.isNotNull(), F.lit(float(w))).otherwise(0.0)
        total += F.coalesce(s * float(w), F.lit(0.0))
    mean = total / F.nullif(have, F.lit(0.0))
    shift = modifier if isinstance(modifier, Column) else F.lit(float(modifier))
    moved = F.when(shift != 0, F.greatest(F.lit(1.0), mean + shift)).otherwise(mean)
    linked = connected if isinstance(connected, Column) else F.lit(connected)
    all_there = reduce(lambda a, b: a & b, (F.map_contains_key(scores, n) for n in weights), F.lit(True))
    return F.when(all_there, F.round(F.when(linked, F.least(F.lit(5.0), moved + 1.0)).otherwise(moved), 3))


# ---- lookups


def prefix_matches(names: DataFrame, index: DataFrame, *, name: str = "name", slug: str = "slug", limit: int = 6, block: int = 6) -> DataFrame:
    """(name, slug, rank): for each squashed name the equal slug first, then the longest slugs that the name starts with, or that add at most two characters to it.

    Each name stands under all its beginnings of `block` characters or more, and each slug
    under itself without its last one or two: equal joins on whole strings, in which a
    common beginning meets one slug. Shorter ones match as a whole only.
    """
    names, index = names.select(F.col(name).alias("name")).where("name <> ''").distinct(), index.select(F.col(slug).alias("slug")).where("slug <> ''").distinct()
    starts = names.where(F.length("name") > block).select("name", F.explode(F.transform(F.sequence(F.lit(block), F.length("name") - 1), lambda n: F.substring("name", F.lit(1), n))).alias("slug"))
    longer = index.where(F.length("slug") > block).select("slug", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).where(F.length("slug") - F.col("n") >= block)
    longer = longer.select("slug", F.substring("slug", F.lit(1), F.length("slug") - F.col("n")).alias("name"))
    found = names.join(index, F.col("name") == F.col("slug")).select("name", "slug", F.lit(1).alias("same"))
    for near in (starts.join(index, "slug"), longer.join(names, "name")):
        found = found.unionByName(near.select("name", "slug", F.lit(0).alias("same")))
    order = Window.partitionBy("name").orderBy(F.desc("same"), F.desc(F.length("slug")), "slug")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("same")


def slug_index(boards: DataFrame, *, board: str = "board", slug: str = "slug", packed: str = "workday") -> DataFrame:
    """(key, board, slug) of listed boards: the key is the squashed slug; of the `packed` board it is the tenant of tenant|instance|site, and others of it are left out."""
    parts = F.split(F.col(slug), r"\|")
    is_packed = F.col(board) == packed
    rows = boards.select(F.regexp_replace(F.lower(F.when(is_packed, parts[0]).otherwise(F.col(slug))), "[^a-z0-9]", "").alias("key"), F.col(board).alias("board"), F.when(is_packed, F.array_join(parts, ":")).otherwise(F.col(slug)).alias("slug"), (~is_packed | (F.size(parts) == 3)).alias("whole"))
    return rows.where("whole and key <> ''").drop("whole").distinct()


def board_matches(names: DataFrame, index: DataFrame, *, name: str = "name", limit: int = 6, block: int = 6) -> DataFrame:
    """(name, board, slug, rank): the boards of the keys that match each name, best key first, then by board and slug; `limit` counts boards."""
    keys = prefix_matches(names, index, name=name, slug="key", limit=limit, block=block).withColumnsRenamed({"slug": "key", "rank": "key_rank"})
    order = Window.partitionBy("name").orderBy("key_rank", "board", "slug")
    return keys.join(index, "key").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("name", "board", "slug", "rank")


def best_board(hits: DataFrame, name: str = "name") -> DataFrame:
    """(name, board, slug, verified, status, also_live) of each name's hits: verified ones first, then by slug_rank and board_rank; the next three are also_live.

    hits: name, board, slug, verified, slug_rank, board_rank. Without a verified one the status is unverified and nothing is also_live.
    """
    order = Window.partitionBy(name).orderBy(F.desc("verified"), "slug_rank", "board_rank", "board", "slug")
    first = hits.withColumn("n", F.row_number().over(order)).where("n <= 4")
    told = F.array_sort(F.collect_list(F.struct("n", "board", "slug", "verified")))
    out = first.groupBy(name).agg(told.alias("h"))
    best = F.col("h")[0]
    others = F.array_join(F.transform(F.slice("h", 2, 3), lambda x: F.concat(x["board"], F.lit("/"), x["slug"])), ", ")
    return out.select(name, best["board"].alias("board"), best["slug"].alias("slug"), best["verified"].alias("verified"), F.when(best["verified"], "live").otherwise("unverified").alias("status"), F.when(best["verified"], others).otherwise("").alias("also_live"))


def names_company(company: Column, board: Column, declared: Column, body: Column, *, trusted: tuple[str, ...] = ("eightfold", "apple", "google"), declaring: str = "smartrecruiters") -> Column:
    """Whether a board's text is of a company. Boards known by their host are trusted; a declared employer decides where there is one; else the squashed name, or its first six characters, must stand in the text outside addresses."""
    squash = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    wanted, told, blob = squash(company), squash(declared), squash(F.regexp_replace(F.coalesce(body, F.lit("")), r"https?://\S+", " "))
    stated = F.contains(told, wanted) | F.contains(wanted, told)
    return (wanted == "") | board.isin(*trusted) | F.when((board == declaring) & (told != ""), stated).otherwise(F.contains(blob, wanted) | (F.length(wanted) > 5) & F.contains(blob, F.substring(wanted, 1, 6)))


def slug_guesses(names: DataFrame, boards: list[str], *, name: str = "name") -> DataFrame:
    """(name, slug, board): each name's squashed and hyphened forms on every board, from a list of boards and without a join."""
    plain = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    forms = F.array_distinct(F.array(F.replace(plain, F.lit(" "), F.lit("")), F.replace(plain, F.lit(" "), F.lit("-")), F.element_at(F.split(plain, " "), 1)))
    rows = names.select(F.col(name).alias("name"), F.explode(forms).alias("slug")).where("slug <> ''")
    return rows.select("name", "slug", F.explode(F.array(*(F.lit(b) for b in boards))).alias("board"))


def cities_in(rows: DataFrame, cities: DataFrame, text: str, *, key: str = "posting_id", most: int | None = None) -> DataFrame:
    """(key, cities): the cities named in a text as whole words, nearest first. cities: city, minutes; a small profile table.

    The cities are one pattern in the plan, so that each text is read once and no pairs are made.
    """
    known = [(r["city"], r["minutes"]) for r in cities.where("city is not null").collect()]
    known = sorted((c, m) for c, m in known if most is None or m is not None and m <= most)
    if not known:
        return rows.select(key, F.array().cast("array<string>").alias("cities"))
    minutes = F.create_map(*(x for c, m in known for x in (F.lit(c.lower()), F.struct(F.lit(m).alias("m"), F.lit(c).alias("c")))))
    pattern = r"\b(" + "|".join(sorted((re.escape(c.lower()) for c, _ in known), key=lambda x: (-len(x), x))) + r")\b"
    hits = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    return rows.select(key, F.transform(F.array_sort(F.transform(hits, lambda h: minutes[h])), lambda x: x["c"]).alias("cities"))


# ---- screening what waits, and what is on record once more


def screening_events(postings: DataFrame, outcomes: DataFrame, key: str = "posting_id") -> DataFrame:
    """(key, state, reason, tracks) to append for the postings still new: screened, or rejected for a reason. outcomes: key, reason (null: passed), tracks, score."""
    told = postings.where(F.col("state") == NEW).select(key).join(outcomes, key)
    passed = F.col("reason").isNull()
    why = F.when(passed, F.format_string("relevance %.1f", F.coalesce("score", F.lit(0.0)))).otherwise(F.col("reason"))
    return told.select(key, F.when(passed, PREFILTERED).otherwise(REJECTED).alias("state"), why.alias("reason"), F.when(passed, F.col("tracks")).alias("tracks"))


def moved_tracks(postings: DataFrame, outcomes: DataFrame, key: str = "posting_id") -> DataFrame:
    """(key, before, after) of scored and shown postings that today's rules put on another list; those that no longer pass keep theirs. postings: key, state, tracks; tracks are comma-joined."""
    known = postings.where(F.col("state").isin(EVALUATED, PRESENTED)).select(key, F.coalesce("tracks", F.lit("")).alias("before"))
    fresh = outcomes.where("tracks <> ''").select(key, F.col("tracks").alias("after"))
    return known.join(fresh, key).where("before <> after")
