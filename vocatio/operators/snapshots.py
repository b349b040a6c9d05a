"""Incremental tables as snapshots: what a load adds, replaces or leaves, and surrogate ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that rows are counted in: as many as shuffle partitions, within these bounds; and rows looked
#: at for each range to find its bounds.
LEAST_RANGES, MOST_RANGES, LOOKED_AT = 64, 1024, 32


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace those of equal keys (nulls equal nulls); all others stay."""
    n = new.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        same = existing[k].eqNullSafe(n[f"__{k}"])
        on = same if on is None else on & same
    return existing.join(n, on, "left_anti").unionByName(new.select(*existing.columns))


def insert_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows as they are, and new rows of keys that aren't there yet, one for each key."""
    return existing.unionByName(unseen(existing, new, keys).dropDuplicates(keys).select(*existing.columns))


def unseen(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def numbered(rows: DataFrame, order: list[str], col: str) -> DataFrame:
    """The rows with consecutive numbers from 1 in ascending order of the columns, nulls first.

    Rows are dealt to ranges, so that no task sorts them all: a bounded look at the rows gives the
    ranges' bounds, the ranges' sizes give each one's first number. Rows equal in all columns of the
    order are in one range, in any order.
    """
    ranges = min(max(LEAST_RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), MOST_RANGES)
    keyed = rows.withColumn("__key", F.struct(*order))
    looked = keyed.select("__key").orderBy(F.xxhash64("__key"), "__key").limit(ranges * LOOKED_AT).agg(F.sort_array(F.collect_list("__key")).alias("__all"))
    step = F.greatest(F.floor(F.size("__all") / ranges), F.lit(1)).cast("int")
    bounds = looked.select(F.filter("__all", lambda x, i: (i > 0) & (i % step == 0)).alias("__bounds"))  # one row of as many bounds as ranges, or so
    # bisection: fewer than twice as many bounds as ranges
    strides = F.array(*[F.lit(1 << i) for i in range((2 * ranges).bit_length() - 1, -1, -1)])
    at = F.aggregate(strides, F.lit(0), lambda n, s: F.when(F.get("__bounds", n + s - 1) <= F.col("__key"), n + s).otherwise(n))
    dealt = keyed.crossJoin(F.broadcast(bounds)).withColumn("__range", at).drop("__bounds")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))  # a row for each range
    rn = F.row_number().over(Window.partitionBy("__range").orderBy("__key"))
    out = dealt.withColumn("__rn", rn).join(F.broadcast(firsts), "__range")
    return out.withColumn(col, F.col("__first") + F.col("__rn")).drop("__key", "__range", "__rn", "__first")


def with_ids(names: DataFrame, name: str, id_col: str, existing: DataFrame | None = None) -> DataFrame:
    """Distinct names with ids in their order, after the largest of the existing ids."""
    out = numbered(names.select(name), [name], "__number")
    next_id = F.col("__number")
    if existing is not None:
        top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("__top"))
        out = out.crossJoin(F.broadcast(top))  # one row
        next_id = next_id + F.col("__top")
    return out.select(next_id.cast("long").alias(id_col), name)


def dimension(names: DataFrame, name: str, id_col: str, existing: DataFrame | None = None) -> DataFrame:
    """A dimension's snapshot: existing rows, and new names with ids that go on from the largest."""
    names = names.select(name).distinct()
    if existing is None:
        return with_ids(names, name, id_col)
    return existing.unionByName(with_ids(unseen(existing, names, [name]), name, id_col, existing).select(*existing.columns))


def batches(rows: DataFrame, order: list[str], size: int, col: str = "batch_no") -> DataFrame:
    """Consecutive numbers of batches of ``size`` rows, from 0, in ascending order of the columns."""
    return numbered(rows, order, "__number").withColumn(col, F.expr(f"(__number - 1) div {size}").cast("int")).drop("__number")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the keys to as many tasks as the cluster runs at once, or as shuffle partitions
    if those are more: for work that takes long for its bytes, which Spark would put into few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
