"""What the corpus operators share: input columns, the shared scratch folder, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, U+0020 and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"


def load(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read. Other columns, whatever their names, never meet an operator's own; null texts are empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see: spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one; on a cluster that is an error, as executors would not see it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if configured is None and jsc.getCheckpointDir().isDefined():
        configured = jsc.getCheckpointDir().get()
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="sievetree-")
        spark.sparkContext.setCheckpointDir(configured)
        configured = jsc.getCheckpointDir().get()
    return configured.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sievetree/{label}-{uuid.uuid4().hex}"


#: Tables of the steps that are under way, innermost last: see `temporary`.
_steps: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end, but for those written with `kept`, which belong to the step around it, if any. What leaves the step must not read removed ones."""
    _steps.append([])
    try:
        yield
    finally:
        for path in _steps.pop():
            remove(spark, path)


@contextmanager
def small_batches(spark: SparkSession, most: str = "4m") -> Iterator[None]:
    """What runs inside passes batches of at most so many bytes to Python and back; by default they may have 64 MB each, and grow by doubling, in every task and its worker. The session's own setting comes back at the end."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, label: str, path: str | None = None, kept: bool = False) -> DataFrame:
    """df as Parquet in the shared folder, read again: lineage ends there, and a lost executor costs nothing that is behind it. Tables at a path of the caller's are the caller's to remove."""
    owner = len(_steps) - 1 - kept
    if path is None:
        path = scratch(df.sparkSession, label)
        if owner >= 0:
            _steps[owner].append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Rows up to which one side of a join is sent to every task.
FEW = 20_000


def side(df: DataFrame, rows: int) -> DataFrame:
    """df, narrow rows, as a side of a join that is sent to every task where `rows`, which bounds its rows, is at most FEW, and sorted and merged otherwise. Spark's own choice goes by the bytes of the files a side is made from: it knows nothing of what `explode` makes of them, and may collect millions of rows at the driver."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose doc_id is not in ids (one column doc_id); rows without an id stay. Whatever docs' columns are called, they never meet the other side's."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(side(ids.select("doc_id").distinct(), ids.count()), F.col("id") == F.col("doc_id"), "left_anti").select("row.*")


def crc32_of_id(doc_id: Column) -> Column:
    """crc32 of the id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
