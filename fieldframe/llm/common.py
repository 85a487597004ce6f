"""Helpers that the text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ``bytes.split()`` without arguments splits at the six characters that part
# words: blank, tab, line feed, vertical tab, form feed, carriage return.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where the setting is absent a folder under /tmp serves a local master (its
    one process is driver and executors); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/fieldframe-shared"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage.

    Lost executors do not matter afterwards, and no part is computed twice.
    Files lie under <shared>/fieldframe/<application id>/ and may be deleted
    when the application has ended.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark).rstrip('/')}/fieldframe/{app}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Delete the files behind a stash that no plan reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Most rows in an Arrow batch of texts (Spark's own default is 10,000).
BATCH_ROWS = 1_000


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small on both sides of the worker's pipe.

    Texts differ in length by orders of magnitude; ten thousand rows of them
    are too much at once. A smaller setting of the session's own stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: A key with more rows than this, and than its share of all rows, is hot.
HOT_ROWS = 1_000
#: Most keys that can be hot: those with over 1/MAX_HOT of all rows (some 30 bytes each).
MAX_HOT = 100_000


def spread_join(rows: DataFrame, classes: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with classes, one row a key (key, n, others), where a key may hold most rows.

    n is the key's number of rows in `rows`, total that of all (or more).
    Keys with over total / MAX_HOT rows are broadcast, MAX_HOT at most by
    that bound, so their rows stay where they are; the others are shuffled.
    Gives the columns of rows and the others of classes.
    """
    limit = max(HOT_ROWS, total // MAX_HOT)
    slim = classes.select(F.col(key).alias("__k"), *[c for c in classes.columns if c != key])
    hot, cold = F.broadcast(slim.where(F.col("n") > limit).drop("n")), slim.where(F.col("n") <= limit).drop("n")
    same = F.col(key) == F.col("__k")
    heavy = rows.join(hot, same).drop("__k")
    light = rows.join(F.broadcast(slim.where(F.col("n") > limit).select("__k")), same, "left_anti").join(cold, same).drop("__k")
    return heavy.unionByName(light)


def as_bytes(column: str):
    """A text column as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


def crc_mod(column: str, modulus: int):
    """crc32 of the column's text form, modulo modulus; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


_holder: tuple[str, object] | None = None


def sole(owner: str, release) -> None:
    """Give a worker's large memory to one owner: what another held is let go first.

    Spark uses Python workers again for later stages, and a dictionary that
    an operator keeps from task to task would stay beside the next one's.
    """
    global _holder
    if _holder is not None and _holder[0] != owner:
        _holder[1]()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # give it back to the system where the C library can
            ctypes.CDLL(None).malloc_trim(0)
    _holder = (owner, release)


def records(columns: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def blocks(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch that hold about `limit` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield batch.slice(first)
