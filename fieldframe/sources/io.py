"""Reading, merging and writing fields in long form."""

from __future__ import annotations

import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..schema import require_columns

# First bytes of file formats.
MAGIC = {b"PAR1": "parquet", b"CDF\x01": "netcdf", b"CDF\x02": "netcdf", b"\x89HDF": "hdf5", b"GRIB": "grib", b"ORC": "orc"}
SUFFIXES = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc", ".nc": "netcdf", ".grib": "grib", ".grb": "grib"}


def file_type(path: str) -> str | None:
    """Format of a local file by its first bytes, else by its suffix."""
    p = Path(path.removeprefix("file://"))
    if p.is_file():
        head = p.open("rb").read(4)
        for magic, kind in MAGIC.items():
            if head.startswith(magic):
                return kind
    return SUFFIXES.get(p.suffix.lower())


def read_field(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A field from any format that Spark reads."""
    kind = kind or SUFFIXES.get(Path(path).suffix.lower(), "parquet")
    if kind in ("netcdf", "grib", "hdf5"):
        raise ValueError(f"{kind} files must be turned into Parquet first")
    reader = spark.read.option("header", "true").option("inferSchema", "true") if kind == "csv" else spark.read
    return reader.format(kind).load(path)


def merge_time(frames: list[DataFrame], time: str = "time") -> DataFrame:
    """Rows of all frames (same columns), range-partitioned and sorted by time; equal times are kept."""
    if not frames:
        raise ValueError("nothing to merge")
    for f in frames:
        require_columns(f, time)
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=False), frames)
    return whole.repartitionByRange(time).sortWithinPartitions(time)


def _path(spark: SparkSession, path: str):
    """A path's file system and the path, as Hadoop has them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, system.makeQualified(found)


def merge_time_files(spark: SparkSession, infiles: list[str], outfile: str, time: str = "time", delete_input: bool = False, overwrite: bool = True) -> str:
    """Merge files along time into zstd Parquet; returns the path. Failures raise.

    An outfile that is one of the inputs is an error; other files are
    replaced unless overwrite is off. delete_input removes the inputs once
    the outfile is there.
    """
    system, target = _path(spark, outfile)
    inputs = [_path(spark, p) for p in sorted(infiles)]
    if any(str(p) == str(target) for _, p in inputs):
        raise ValueError("the outfile is one of the inputs")
    merged = merge_time([read_field(spark, p) for p in sorted(infiles)], time)
    merged.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(outfile)
    if delete_input and system.exists(target):
        for fs, p in inputs:
            fs.delete(p, True)
    return outfile


def temp_path(spark: SparkSession, folder: str, label: str = "tmp") -> str:
    """A new path in a folder that driver and executors share; it is deleted when the driver ends."""
    system, path = _path(spark, f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}")
    system.deleteOnExit(path)
    return path.toString()


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """Sparse weights (row, col, s)."""
    df = spark.read.parquet(path)
    require_columns(df, "row", "col", "s")
    return df.select("row", "col", "s")


def melt(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Wide variables as rows: keys, variable, value."""
    return df.unpivot(keys, names, "variable", "value")
