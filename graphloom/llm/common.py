"""What the operators share: the shared work folder, written intermediates and row numbers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the text contracts name, as a character class of Java regular expressions.
ASCII_SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can reach: `spark.checkpoint.dir`.

    Where the session names none, a temporary folder is set for the context on a local master (tests, a laptop). A
    cluster must name one, as its executors do not share the driver's disk.
    """
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext._jsc.sc().getCheckpointDir()
    if not isinstance(where, str):
        where = where.get() if where.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-graphloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch that `small_batches` asks for.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Whole texts go to Python workers in batches of a few MB while this holds.

    By default a batch holds 10,000 texts, once in the JVM, where vectors double as they grow, and once in the worker.
    """
    before = {k: spark.conf.get(k) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(df: DataFrame) -> None:
    """Delete the files of a written intermediate that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions, which follows the size of the cluster and the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_order(key: str = "key", rid: str = "rid") -> Column:
    """A number by which rows sort by key (null last), then by row number. It fits a hash aggregation's buffer."""
    k = F.coalesce(F.col(key).cast("long"), F.lit(2**63 - 1)).cast("decimal(19,0)")
    return (k * F.lit(2**62).cast("decimal(19,0)") + F.col(rid).cast("decimal(19,0)")).cast("decimal(38,0)")


#: At most so many row numbers of 8 bytes are broadcast.
BROADCAST_ROWS = 500_000


def numbered(docs: DataFrame) -> DataFrame:
    """`rid` and `row` (a struct of all columns) for each row of `docs`, written once.

    The number travels with its row: a later job reads it and never numbers a scan again, whose splits would follow
    the executors that are left. The struct keeps the columns' names apart from those of an operator.
    """
    return written(docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")


def field(name: str) -> Column:
    """A column of the rows that `numbered` wrote."""
    return F.col("row").getField(name)


def without_rows(rows: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows that `numbered` wrote, without those whose numbers `drop.rid` holds.

    Up to BROADCAST_ROWS numbers are broadcast, so that no text is shuffled; beyond that they are joined by a shuffle.
    """
    drop = written(drop.select("rid"), "drop")
    if drop.count() <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    return rows.join(drop, "rid", "left_anti").select("row.*")


#: Caches of large objects that a Python worker keeps from task to task.
_KEPT: list = []


def kept(make: Callable):
    """`functools.cache` for a large object (a tokenizer and the words it met): tasks of another kind drop it."""
    found = cache(make)
    _KEPT.append(found)
    return found


def give_back(*keep) -> None:
    """Drop all kept objects but those of the caches `keep`, and return freed memory to the system.

    Spark keeps its Python workers for later tasks; without this each holds the most that any earlier task took.
    """
    import pyarrow

    for found in _KEPT:
        if found not in keep:
            found.cache_clear()
    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def tidy(*keep) -> Callable:
    """Decorator for an Arrow function from batches to batches: gives memory back before its first batch and after its last."""

    def decorate(run: Callable) -> Callable:
        @wraps(run)
        def tidied(batches: Iterator) -> Iterator:
            give_back(*keep)
            yield from run(batches)
            give_back(*keep)

        return tidied

    return decorate
