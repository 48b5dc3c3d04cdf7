"""What the corpus operators share: shared scratch tables, batch slicing and tokenizing."""

from __future__ import annotations

import contextlib
import gc
import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Only in local mode one is made where it is unset; elsewhere that is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rolesift-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder and read again: it cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        df.write.option("compression", compression).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a command's shuffle files when the command ends, not when the driver's garbage is collected."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def free_name(taken: Iterable[str], name: str) -> str:
    """`name`, or the first of name_1, name_2, ... that no column has (column names compare without case)."""
    known = {x.lower() for x in taken}
    return next(x for x in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if x.lower() not in known)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Removes the files of a table that written() returned, once nothing reads it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, chars: int = 4_000_000, text: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into pieces of at most `rows` rows and, where a text column is named, about `chars` bytes (one row may be longer), to bound a Python worker's memory."""
    for batch in batches:
        if text is None or not batch.num_rows:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        start = held = 0
        for at, n in enumerate(sizes):
            if at > start and (at - start >= rows or held + n > chars):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += n
        yield batch.slice(start)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 20_000, size: int = 16_000_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts): rows sorted by `keys` in tables of whole groups, with the places at which a group begins. A table has about `rows` rows or `size` bytes, and its last group besides: many small groups cost one step."""

    def starts(table: pa.Table) -> np.ndarray:
        columns = [table.column(k).to_numpy() for k in keys]
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in columns], axis=0)])

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) < rows and sum(x.nbytes for x in held) < size:
            continue
        table = pa.Table.from_batches(held)
        found = starts(table)
        if len(found) > 1:
            yield table.slice(0, int(found[-1])), found[:-1]
            held = table.slice(int(found[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


#: The one large thing that a worker process keeps from task to task, by its name.
_kept: dict = {}


def kept_in_worker(name: tuple, make: Callable[[], T]) -> T:
    """What `make` returns, made once for all tasks of a worker that follow each other; something else takes its place."""
    if name not in _kept:
        forget_in_worker()
        _kept[name] = make()
    return _kept[name]


def forget_in_worker() -> None:
    """Gives up what another operator kept: Spark uses workers again, and two operators' tables need not fit one."""
    if _kept:
        _kept.clear()
        gc.collect()


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of the value written as text, modulo `modulus`: the fold of a row. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit("")).cast("binary")) % modulus


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """The texts of a column, null as the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


#: Bytes of a table of ids (as estimated from its rows) up to which it is broadcast; larger ones are joined by shuffle. The rows found are the same.
BROADCAST_BYTES = 16_000_000


def sized(rows: DataFrame, width: int = 64) -> DataFrame:
    """Marks a written table for broadcast where its rows, of about `width` bytes each, fit BROADCAST_BYTES."""
    most = BROADCAST_BYTES // width
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
