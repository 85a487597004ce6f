"""Places in the order of a whole column, without a window that takes all rows to one task.

An axis of few values is numbered by one window. Others are cut into buckets
of about equal size; rows are numbered within their bucket, and the sums of
the buckets before are a table of at most BUCKETS numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import require_columns, value

#: Different values that one task numbers by itself.
SMALL = 10_000
BUCKETS = 256


def _bucket(values: DataFrame, name: str, n: int) -> Column:
    """Number of a value's bucket. Cuts are values that a hash picks, so they do not depend on the order of rows."""
    kind = values.schema[name].dataType.simpleString()
    step = max(1, n // (8 * BUCKETS))
    some = values.where(F.pmod(F.xxhash64(name), F.lit(step)) == 0).orderBy(name).select(F.col(name).cast("string").alias("v")).limit(64 * BUCKETS).collect()
    cuts = [some[k * len(some) // BUCKETS][0] for k in range(1, BUCKETS)] if some else []
    lits = [F.lit(c).cast(kind) for c in dict.fromkeys(cuts)]
    return F.size(F.filter(F.array(*lits), lambda c: c <= F.col(name))) if lits else F.lit(0)


def _before(rows: DataFrame, bucket: str, size: Column) -> Column:
    """Sum of size over the buckets before."""
    sums = {r[0]: r[1] for r in rows.groupBy(bucket).agg(size).collect()}
    total, out = 0, []
    for k in range(max(sums, default=0) + 1):
        out.append(F.lit(total).cast("bigint"))
        total += sums.get(k, 0)
    return F.array(*out)[F.col(bucket)]


def places(df: DataFrame, dim: str) -> DataFrame:
    """dim, place: the different values of a column, without NULL, and their places from 0 in ascending order."""
    require_columns(df, dim)
    values = df.select(dim).where(F.col(dim).isNotNull()).distinct()
    n = values.count()
    if n <= SMALL:
        return values.withColumn("place", F.row_number().over(Window.orderBy(dim)).cast("bigint") - 1)
    values = values.withColumn("__bucket", _bucket(values, dim, n))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(dim))
    return values.withColumn("place", _before(values, "__bucket", F.count(F.lit(1))) + inside - 1).drop("__bucket")


def percentiles(df: DataFrame, name: str, shares: list[float]) -> DataFrame:
    """One row with q0, q1, ...: exact percentiles of a numeric column, linear between neighbours; NULL without values."""
    require_columns(df, name)
    counts = df.select(value(name).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    size = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size[0] <= SMALL:
        both = df.agg(F.percentile(value(name), F.array(*map(F.lit, shares))).alias("q"))
        return both.select(*[F.col("q")[i].alias(f"q{i}") for i in range(len(shares))])
    counts = counts.withColumn("__bucket", _bucket(counts, "v", size[0]))
    inside = Window.partitionBy("__bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("first", _before(counts, "__bucket", F.sum("n")) + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("v")))
    places_of = [share * (size[1] - 1) for share in shares]
    found = ranked.agg(*[x for i, p in enumerate(places_of) for x in (at(int(p)).alias(f"l{i}"), at(min(int(p) + 1, size[1] - 1)).alias(f"h{i}"))])
    return found.select(*[(F.col(f"l{i}") + (F.col(f"h{i}") - F.col(f"l{i}")) * (p - int(p))).alias(f"q{i}") for i, p in enumerate(places_of)])
