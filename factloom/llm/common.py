"""What the operators share: tables, scratch space on the shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
SHARED_DIR = "spark.checkpoint.dir"
#: Up to so many row numbers (8 bytes each, some 50 MB in a hash table) are sent to the texts; beyond, texts are shuffled to them.
BROADCAST_ROWS = 2_000_000

_local_dir: list[str] = []
_written: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("written", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; F.lower would also fold other alphabets."""
    return F.translate(text, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and is local."""
    base = spark.conf.get(SHARED_DIR, None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SHARED_DIR} to a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="factloom-"))
    return f"file://{_local_dir[0]}"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 128, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows and about so many bytes (a longer row is a part by itself), so that
    what Python makes of a part stays small, whatever the batch is."""
    for batch in batches:
        at, n = 0, max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        while at < batch.num_rows:
            part = batch.slice(at, n)
            while part.num_rows > 1 and part.nbytes > size:
                part = part.slice(0, part.num_rows // 2)
            yield part
            at += part.num_rows


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factloom-{name}-{uuid.uuid4().hex}"


def persisted(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: cuts lineage and survives lost executors. Within
    scratch() the table goes at its end, unless it is to be kept."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if (written := _written.get()) is not None and not keep:
        written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end what persisted() wrote within, so that disk is held only while it is needed. What is to outlive
    it must be written with keep."""
    mark = _written.set([])
    try:
        yield
    finally:
        written = _written.get()
        _written.reset(mark)
        for spark, path in written:
            remove(spark, path)


def numbered(documents: DataFrame, name: str = "numbered") -> DataFrame:
    """(row, doc): each row under a number of its own, with all its columns in one struct, so that repeated or null ids
    don't mix up rows and no column clashes with an operator's own. Written once, so that the numbers stay."""
    return persisted(documents.select(F.monotonically_increasing_id().alias("row"), F.struct(*documents.columns).alias("doc")), name, keep=True)


def keyed(documents: DataFrame) -> tuple[DataFrame, bool]:
    """(row, doc) as numbered() gives them, and whether row is the doc_id. That it is where no id is null or occurs twice;
    then nothing is written, and documents are read again wherever they are needed."""
    doc_id = F.col("doc_id").cast("long")
    n, ids = documents.select(F.count("*"), F.countDistinct(doc_id)).first()
    if n > ids:
        return numbered(documents), False
    return documents.select(doc_id.alias("row"), F.struct(*documents.columns).alias("doc")), True


def broadcast_if_small(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """A broadcast hint only where the counted rows stay under the bound; Spark shuffles both sides otherwise."""
    return F.broadcast(df) if rows <= most_rows else df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop's file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
