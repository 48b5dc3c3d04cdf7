"""Secret scans by linking the parts of a credential. DataFrame functions only.

Base kinds are reported wherever they stand: assignments to a password, secret, token or key,
access identifiers, and runs of hexadecimal digits. Other kinds are weak alone: an identifier
with a less telling name, a long mixed run of letters and digits (secret), an address
(endpoint). These are reported only when the other parts of a credential stand in the same
scope: a secret needs an identifier (access or ident), an identifier needs a secret (assign,
hex or secret), and an endpoint needs both. A scope reaches Params.reach code points to both
sides and never across a blank line.

The join of the parts is an interval join by sweep: the parts of a text, sorted by place, each
look for the nearest complementary part before and after them by running maxima and minima.
No pair of parts is ever a row, so that a text with very many parts costs a sort. Texts are
read once; only the found parts, a few numbers each, are shuffled.

A part's place is found from the lengths of the pieces that its pattern cuts the text into.
Matches of a kind are leftmost and don't overlap; those of different kinds may, but a weak
secret that overlaps a base span is not reported beside it.

Cases: a null text is an empty one and has no span. Rows with one id, or none, are rows
of their own. Repeated rows and ties (parts that begin together, told in the order of
KINDS) all stay. An empty table gives no rows. Other columns are never read, and may have any
name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolesift.llm.common import written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BREAK = r"\n[\x20\t\r]*\n"

#: Patterns by kind, in the order in which kinds are listed. A run that is too short has no part that is long enough, so the least length of access and hex can stand in the pattern.
KINDS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "ident": r"""(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{16,}|(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""",
    "secret": r"[A-Za-z0-9+/_=-]{32,}",
    "endpoint": r"""[a-z][a-z0-9+.-]{1,20}://[^\x00-\x20"'<>]+|(?i:end_?point|host_?name|host|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9._:/-]{3,}""",
}
BASE = ("assign", "access", "hex")


@dataclass(frozen=True)
class Params:
    reach: int = 400  # code points from a part to its complement
    value: int = 6  # least length of an assigned value


def cut_by(text: Column, kind: str, pattern: str) -> Column:
    """{kind, cuts}: each match with the length of the piece before it. The last piece has no match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x)).alias("gap")
    return F.struct(F.lit(kind).alias("kind"), F.arrays_zip(found, gaps).alias("cuts"))


def cut_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, kinds): a number for each row, and its matches by kind. Weak kinds and breaks are looked for only where their complement may be."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    body = F.col("__text")
    flags = {k: body.rlike(p) for k, p in KINDS.items() if k not in ("secret", "endpoint")}
    rows = rows.withColumns({f"__{k}": v for k, v in flags.items()})
    named = F.col("__access") | F.col("__ident")
    rows = rows.withColumn("__secret", named & body.rlike(KINDS["secret"]))
    whole = named & (F.col("__assign") | F.col("__hex") | F.col("__secret"))
    rows = rows.withColumn("__endpoint", whole & body.rlike(KINDS["endpoint"]))
    weak = whole & (F.col("__ident") | F.col("__secret") | F.col("__endpoint"))
    wanted = {k: F.col(f"__{k}") for k in KINDS} | {"ident": whole & F.col("__ident"), "break": weak}
    patterns = KINDS | {"break": BREAK}
    return rows.select("row", "id", F.array_compact(F.array(*(F.when(wanted[k], cut_by(body, k, p)) for k, p in patterns.items()))).alias("kinds"))


def placed(cut: DataFrame, p: Params) -> DataFrame:
    """(row, id, kind, rank, start, end, found, valid): the matches with their places. One shuffle by row; all that follows stays in it."""
    each = cut.select("row", "id", F.explode("kinds").alias("k")).select("row", "id", "k.kind", F.posexplode("k.cuts").alias("i", "cut")).where("cut.found is not null")
    until = F.sum(F.col("cut.gap") + F.char_length("cut.found")).over(Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    found = F.col("cut.found")
    mixed = found.rlike("[0-9]") & found.rlike("[a-z]") & found.rlike("[A-Z]")
    valid = F.when(F.col("kind") == "assign", F.char_length(F.regexp_extract(found, ASSIGN, 2)) >= p.value).when(F.col("kind") == "secret", mixed).otherwise(True)
    rows = each.repartition("row").select("row", "id", "kind", rank.alias("rank"), found.alias("found"), valid.alias("valid"), until.alias("end"))
    return rows.withColumn("start", F.col("end") - F.char_length("found")).where("valid")


def linked(parts: DataFrame, p: Params) -> DataFrame:
    """The parts with the start of the nearest identifier and secret in their scope (null: none) and whether they are reported."""
    order = Window.partitionBy("row")
    up = order.orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    down = order.orderBy(F.desc("start"), F.desc("rank"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("kind")
    base = kind.isin(*BASE)
    # A part that begins no later ends at the furthest of those before; one that begins later begins at the nearest of those after.
    rows = parts.withColumns({"base_before": F.max(F.when(base, F.col("end"))).over(up), "base_after": F.min(F.when(base, F.col("start"))).over(down)})
    overlaps = F.coalesce(F.col("base_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_after") < F.col("end"), F.lit(False))
    rows = rows.where((kind != "secret") | ~overlaps)
    roles = {"identifier": kind.isin("access", "ident"), "secret": kind.isin("assign", "hex", "secret")}
    seen = {f"{role}_before": F.max(F.when(is_one, F.struct("end", "start"))).over(up) for role, is_one in roles.items()}
    seen |= {f"{role}_after": F.min(F.when(is_one, F.col("start"))).over(down) for role, is_one in roles.items()}
    seen |= {"break_before": F.max(F.when(kind == "break", F.col("end"))).over(up), "break_after": F.min(F.when(kind == "break", F.col("start"))).over(down)}
    rows = rows.withColumns(seen)

    def nearest(role: str) -> Column:
        before, after = F.col(f"{role}_before"), F.col(f"{role}_after")
        back, ahead = F.greatest(F.col("start") - before["end"], F.lit(0)), F.greatest(after - F.col("end"), F.lit(0))
        back = F.when((back <= p.reach) & (before["start"] >= F.coalesce("break_before", F.lit(0))), back)
        ahead = F.when((ahead <= p.reach) & (after < F.coalesce("break_after", after + 1)), ahead)
        return F.when(F.coalesce(back <= ahead, back.isNotNull()), before["start"]).when(ahead.isNotNull(), after)

    rows = rows.withColumns({"identifier": nearest("identifier"), "secret": nearest("secret")})
    has_id, has_secret = F.col("identifier").isNotNull(), F.col("secret").isNotNull()
    reported = F.when(kind == "secret", has_id).when(kind == "ident", has_secret).when(kind == "endpoint", has_id & has_secret).otherwise(base)
    return rows.select("row", "id", "kind", "rank", "start", "end", "found", "identifier", "secret", reported.alias("reported"))


def parts(docs: DataFrame, p: Params = Params(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, key, kind, start, end, found, identifier, secret) of every reported span; identifier and secret: where the nearest of the scope begin."""
    rows = linked(placed(written(cut_texts(docs, key, text), "parts"), p), p).where("reported")
    return rows.select("row", F.col("id").alias(key), "kind", "start", "end", "found", "identifier", "secret")


def scan(docs: DataFrame, p: Params = Params(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_<base kind>, spans, base, n_linked) of every row: spans as kind:start:end in order, those of base kinds apart."""
    cut = written(cut_texts(docs, key, text), "parts")
    span = F.when(F.col("reported"), F.struct("start", "rank", F.concat_ws(":", "kind", "start", "end").alias("told")))
    counts = [F.count_if(F.col("reported") & (F.col("kind") == k)).alias(f"n_{k}") for k in BASE]
    found = linked(placed(cut, p), p).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"), *counts, F.count_if(F.col("reported") & ~F.col("kind").isin(*BASE)).alias("n_linked"))
    told = lambda x: F.array_join(F.transform(x, lambda s: s["told"]), ",")
    only = F.filter("all", lambda s: s["rank"] <= len(BASE))
    found = found.select("row", *(f"n_{k}" for k in BASE), told(F.col("all")).alias("spans"), told(only).alias("base"), "n_linked")
    # Most rows have no match and need no join.
    zero = F.lit(0).cast("long")
    clean = cut.where(F.size("kinds") == 0).select(F.col("id").alias(key), *(zero.alias(f"n_{k}") for k in BASE), F.lit("").alias("spans"), F.lit("").alias("base"), zero.alias("n_linked"))
    held = cut.where(F.size("kinds") > 0).select("row", "id").join(found, "row", "left")
    return clean.unionByName(held.select(F.col("id").alias(key), *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in BASE), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("base", F.lit("")).alias("base"), F.coalesce("n_linked", zero).alias("n_linked")))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_linked")


def _oracle(p: Params = Params()) -> str:
    quote = lambda x: x.replace("'", "''")
    cut = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {r} AS rank, unnest(regexp_extract_all(t, '{quote(x)}', 0)) AS found, unnest(list_transform(string_split_regex(t, '{quote(x)}')[:-2], lambda y: length(y))) AS gap, generate_subscripts(regexp_extract_all(t, '{quote(x)}', 0), 1) AS i FROM d"
        for r, (k, x) in enumerate((KINDS | {"break": BREAK}).items(), 1)
    )
    near = lambda r: f"""CASE WHEN greatest(start - {r}_before.e, 0) <= {p.reach} AND {r}_before.s >= coalesce(break_before, 0) THEN greatest(start - {r}_before.e, 0) END AS {r}_back,
 CASE WHEN greatest({r}_after - "end", 0) <= {p.reach} AND {r}_after < coalesce(break_after, {r}_after + 1) THEN greatest({r}_after - "end", 0) END AS {r}_ahead"""  # noqa: E731
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS ({cut}),
q AS (SELECT doc_id, kind, rank, found, sum(gap + length(found)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS "end" FROM c),
v AS (SELECT doc_id, kind, rank, CAST("end" AS BIGINT) AS "end", CAST("end" - length(found) AS BIGINT) AS start, kind IN ('assign', 'access', 'hex') AS base FROM q
 WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(found, '{quote(ASSIGN)}', 2)) >= {p.value} WHEN 'secret' THEN regexp_matches(found, '[0-9]') AND regexp_matches(found, '[a-z]') AND regexp_matches(found, '[A-Z]') ELSE true END),
o AS (SELECT * FROM v a WHERE kind <> 'secret' OR NOT EXISTS (SELECT 1 FROM v b WHERE b.doc_id = a.doc_id AND b.base AND b.start < a."end" AND b."end" > a.start)),
w AS (SELECT *, max(CASE WHEN kind IN ('access', 'ident') THEN {{'e': "end", 's': start}} END) OVER up AS identifier_before, min(CASE WHEN kind IN ('access', 'ident') THEN start END) OVER down AS identifier_after,
 max(CASE WHEN kind IN ('assign', 'hex', 'secret') THEN {{'e': "end", 's': start}} END) OVER up AS secret_before, min(CASE WHEN kind IN ('assign', 'hex', 'secret') THEN start END) OVER down AS secret_after,
 max(CASE WHEN kind = 'break' THEN "end" END) OVER up AS break_before, min(CASE WHEN kind = 'break' THEN start END) OVER down AS break_after FROM o
 WINDOW up AS (PARTITION BY doc_id ORDER BY start, rank, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), down AS (PARTITION BY doc_id ORDER BY start, rank, "end" ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
n AS (SELECT *, {near("identifier")}, {near("secret")} FROM w),
r AS (SELECT * FROM n WHERE CASE kind WHEN 'secret' THEN coalesce(identifier_back, identifier_ahead) IS NOT NULL WHEN 'ident' THEN coalesce(secret_back, secret_ahead) IS NOT NULL
 WHEN 'endpoint' THEN coalesce(identifier_back, identifier_ahead) IS NOT NULL AND coalesce(secret_back, secret_ahead) IS NOT NULL WHEN 'break' THEN false ELSE true END),
f AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (NOT base) AS n_linked,
 string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) FILTER (base) AS base FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(f.base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN f ON d.doc_id = f.doc_id"""


ORACLE_SQL = _oracle()
