"""Archives of applications: stable names, the text of each file as a column, a sink and the index of what is on disk.

A posting may be taken down, so that what it asked for is kept as a file of its own on the
day of application. The files are the truth: names and index are read back from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from rolesift.functions import sections, text
from rolesift.operators import report, store

COMPANY_LENGTH, TITLE_LENGTH = 24, 48
# Lines of a file that are read back, and its headings.
ID_LINE = r"(?m)^_Posting id (-?\d+)\._$"
HEAD_LINE, APPLIED_LINE, SCORE_LINE = r"(?m)^#\s+(.*?)\s*$", r"(?m)^- \*\*Applied:\*\* (.+)$", r"(?m)^- \*\*Score:\*\* ([0-9.]+)"
SNAPSHOT_NOTE = "> The posting may be taken down. Everything below is a verbatim snapshot of it, saved on the day of application."
HEADINGS = (
    ("Role overview (verbatim)", "overview"),
    ("What this job asks you to do (verbatim)", "responsibilities"),
    ("Requirements / qualifications (verbatim)", "requirements"),
    ("Full posting - no section headings found (verbatim)", "full"),
)


def applications(postings: DataFrame, verdicts: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row a posting applied to: its fields, the day and reason of the last application, and score, connection_bonus and fit_summary of its last evaluation, if any."""
    told = verdicts.where("verdict = 'applied'").groupBy("posting_id").agg(F.max_by(F.struct(F.col("created_at").alias("at"), F.col("reason").alias("reason")), "verdict_id").alias("v"))
    day = F.coalesce(F.date_format("v.at", "yyyy-MM-dd"), F.lit("unknown"))
    last = store.latest_evaluation(evaluations).select("posting_id", "score", "connection_bonus", "fit_summary")
    return postings.join(told.select("posting_id", day.alias("applied_on"), "v.reason"), "posting_id").join(last, "posting_id", "left")


def base_name(applied_on: Column | str, company: Column | str, title: Column | str) -> Column:
    """Day, company and title: names are for people who browse the folder."""
    day = F.coalesce(F.col(applied_on) if isinstance(applied_on, str) else applied_on, F.lit("unknown"))
    return F.concat_ws("-", day, text.slug(company, COMPANY_LENGTH), text.slug(title, TITLE_LENGTH))


def named(rows: DataFrame, taken: DataFrame | None = None, *, key: str = "posting_id", base: str = "base", spread: int = 64) -> DataFrame:
    """Adds `name`: the base for the first posting of it, base-2, base-3 ... for others of the same company, title and day.

    taken: (key, name) of the files there are. A posting that has a name of its base keeps it,
    others count on from the highest number of the base. A base that ends in a number is
    numbered from 1, so that a name says which base and number it is of, and no two meet.

    key is an integer, one row each. A base that very many share is numbered in `spread`
    groups by the key, from the sums of the groups before: no task gets all rows of a base.
    """
    told = rows.select(key, base).withColumn("__group", F.pmod(F.col(key), F.lit(spread)).cast("int"))
    kept, highest = F.lit(None).cast("string"), F.lit(0)
    if taken is not None:
        mine = taken.select(F.col(key), _base_of("name").alias(base), F.col("name").alias("__kept")).dropDuplicates([key, base])
        told, kept = told.join(mine, [key, base], "left"), F.col("__kept")
    sums = told.where(kept.isNull()).groupBy(base, "__group").agg(F.count("*").alias("__n"))
    if taken is not None:
        sums = sums.join(taken.groupBy(_base_of("name").alias(base)).agg(F.max(_number_of("name")).alias("__highest")), base, "left")
        highest = F.coalesce("__highest", F.lit(0))
    before = F.sum("__n").over(Window.partitionBy(base).orderBy("__group")) - F.col("__n") + highest
    n = F.col("__before") + F.sum(F.when(kept.isNull(), 1).otherwise(0)).over(Window.partitionBy(base, "__group").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    name = F.when((n == 1) & ~F.col(base).rlike(r"-\d+$"), F.col(base)).otherwise(F.concat_ws("-", base, n.cast("string")))
    made = told.join(sums.select(base, "__group", before.alias("__before")), [base, "__group"], "left").select(key, F.coalesce(kept, name).alias("name"))
    return rows.join(made, key)


def _base_of(name: str) -> Column:
    return F.regexp_replace(name, r"-\d+$", "")


def _number_of(name: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(name, r"-(\d+)$", 1), F.lit("")).cast("long"), F.lit(1))


def with_file(rows: DataFrame, into: str = "file") -> DataFrame:
    """Adds the whole text of each application's file. Columns as of `applications`, with title, company, published, city, location_raw, work_model, salary_min, salary_max, url and description; a null is left out or said to be missing."""
    said = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    field = lambda label, value: F.concat(F.lit(f"- **{label}:** "), said(value))
    bump = F.when(F.col("connection_bonus") != 0, F.format_string(" (includes +%.1f connection bump)", F.col("connection_bonus").cast("double"))).otherwise("")
    score = F.when(F.col("score") != 0, F.concat(F.format_string("%.1f", F.col("score").cast("double")), bump))
    place, model = F.coalesce(said(F.col("city")), said(F.col("location_raw")), F.lit(report.NOT_STATED)), said(F.col("work_model"))
    place = F.when(model.isNull() | F.contains(F.lower(place), F.lower(model)), place).otherwise(F.concat_ws(" - ", place, model))
    found = sections.with_sections(rows, "description", "__sections")
    parts = [F.concat(F.lit(f"## {heading}\n\n"), F.nullif(F.col("__sections")[name], F.lit("")), F.lit("\n")) for heading, name in HEADINGS]
    lines = [
        F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit(" - "), F.coalesce("company", F.lit("")), F.lit("\n")),
        field("Applied", F.col("applied_on")),
        field("Posted", F.coalesce(F.date_format("published", "yyyy-MM-dd"), F.lit(report.NOT_STATED))),
        field("Score", score),
        field("Location", place),
        field("Salary", report.pay_field("salary_min", "salary_max")),
        field("Posting", F.col("url")),
        field("Why I applied", F.col("reason")),
        F.lit(f"\n{SNAPSHOT_NOTE}\n"),
        F.concat(F.lit("_Captured via: "), F.col("__sections.via"), F.lit("._\n")),
        F.concat(F.lit("_Posting id "), F.col("posting_id").cast("string"), F.lit("._\n")),
        *parts,
        F.concat(F.lit("## Fit summary at time of scan\n\n"), F.nullif(text.trimmed(F.col("fit_summary")), F.lit("")), F.lit("\n")),
    ]
    whole = F.concat(F.regexp_replace(report.block(lines), r"(?U)\s+$", ""), F.lit("\n"))
    return found.withColumn(into, whole).drop("__sections")


def write(rows: DataFrame, path: str) -> None:
    """Writes `file` of each row to path/name.md. The folder must be one that all executors see."""
    rows.sparkSession.dataSource.register(ArchiveFiles)
    rows.select(F.col("name").cast("string").alias("name"), F.col("file").cast("string").alias("file")).write.format("archive").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(posting_id, name, applied, title, score, file) of the files there are. A folder that isn't there has none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "posting_id bigint, name string, applied string, title string, score string, file string")
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.md$", "").alias("name"), F.col("value").alias("file"))
    told = lambda pattern: F.nullif(F.regexp_extract("file", pattern, 1), F.lit(""))
    return files.select(
        told(ID_LINE).cast("bigint").alias("posting_id"),
        "name",
        F.coalesce(F.trim(told(APPLIED_LINE)), F.substring("name", 1, 10)).alias("applied"),
        F.coalesce(told(HEAD_LINE), F.col("name")).alias("title"),
        told(SCORE_LINE).alias("score"),
        "file",
    )


def index_lines(files: DataFrame) -> DataFrame:
    """(line) of the index, the newest first. It is a sorted table and not one text, so that it may be of any length."""
    scored = F.coalesce(F.concat(F.lit(" - scored "), F.col("score")), F.lit(""))
    line = F.concat(F.lit("- "), F.col("applied"), F.lit(" - ["), F.col("title"), F.lit("]("), F.col("name"), F.lit(".md)"), scored)
    return files.orderBy(F.desc("applied"), F.desc("title"), F.desc("name")).select(line.alias("line"))


def archive(rows: DataFrame, path: str) -> None:
    """Adds applications to an archive: those that are there under their day keep their names and are written anew."""
    taken = read(rows.sparkSession, path).where("posting_id is not null").select("posting_id", "name")
    based = rows.withColumn("base", base_name("applied_on", "company", "title"))
    write(with_file(named(based, taken)), path)


# ---- the sink


@dataclass
class Written(WriterCommitMessage):
    files: int


class ArchiveFiles(DataSource):
    """Rows of (name, file) as a file each."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


class ArchiveWriter(DataSourceArrowWriter):
    """Each file is written under a name of its attempt and then moved, so that readers see whole files only.

    Names come from the rows alone: an attempt that is repeated, or runs twice, leaves the
    same files. A job that fails leaves some of its files, whole, and running it again adds
    the others.
    """

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Written:
        files, root = pyarrow.fs.FileSystem.from_uri(self.path)
        attempt, done = TaskContext.get().taskAttemptId(), 0
        files.create_dir(f"{root}/_attempts", recursive=True)
        for batch in iterator:
            for name, content in zip(batch["name"].to_pylist(), batch["file"].to_pylist()):
                part = f"{root}/_attempts/{attempt}-{name}"
                with files.open_output_stream(part) as out:
                    out.write((content or "").encode())
                files.move(part, f"{root}/{name}.md")
                done += 1
        return Written(done)

    def commit(self, messages: list) -> None:
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        files, root = pyarrow.fs.FileSystem.from_uri(self.path)
        if files.get_file_info(f"{root}/_attempts").type == pyarrow.fs.FileType.Directory:
            files.delete_dir(f"{root}/_attempts")
