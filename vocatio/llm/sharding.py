"""Operator 7: contiguous shards of nearly equal bytes, by global prefix sums.

Rows are dealt to ranges of the order column, each range sums its bytes and rows, a prefix sum
over these few totals gives every range its offsets, and a running sum within the range gives
every row its global byte offset. Cutting the offsets at equal targets yields contiguous shards.
Texts never move: only the key, the size and the checksum of a row are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, helper, table

#: Rows of one range of the order column, about.
RANGE_ROWS = 250_000


def assign_shards(rows: DataFrame, order: list[str], size: str, shards: int, ranges: int | None = None) -> DataFrame:
    """The rows with ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    Shards are contiguous in the order given; a row belongs to the shard in which the middle of
    its bytes falls, so a shard's bytes differ from the mean by one row's size at most at either end.
    Nulls come first in the order. Rows that tie in it are told apart by the size and by their
    place in the input, so a key that holds a third of all rows still spreads over many ranges.
    An empty table gives an empty result. A null size counts as 0. ``shard`` and ``slot`` columns
    of the input are replaced.
    """
    spark = rows.sparkSession
    n = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    order_by: list[Column] = [F.col(f"row.{c}") for c in order]
    packed = rows.select(F.struct(*kept).alias("row"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("w"), F.monotonically_increasing_id().alias("at"))
    ranged = cut(packed.repartitionByRange(n, *order_by, "w", "at").withColumn("rng", F.spark_partition_id()))

    totals = ranged.groupBy("rng").agg(F.sum("w").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # one row for each range: a few hundred to a few thousand, whatever the input
    starts = totals.select("rng", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row0"), F.sum("bytes").over(whole).alias("total"))

    local = Window.partitionBy("rng").orderBy(*order_by, "w", "at")
    running = ranged.withColumns({"upto": F.sum("w").over(local.rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(local)})
    placed = running.join(F.broadcast(starts), "rng").withColumns(
        {
            "shard": F.when(F.col("total") == 0, F.lit(0)).otherwise(F.expr(f"least({shards - 1}, ((2 * (byte0 + upto) - w) * {shards}) div greatest(2 * total, 1))")).cast("int"),
            "at_row": F.col("row0") + F.col("rn") - 1,
        }
    )
    # one row for each shard
    firsts = placed.groupBy("shard").agg(F.min("at_row").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select("row.*", "shard", (F.col("at_row") - F.col("first_row")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every document, in the order of doc_id.

    The size is the text's UTF-8 bytes plus 1; a null text has no bytes and the checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(rows, ["doc_id", "text_crc32"], "size", shards)


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """The documents as Parquet, one folder for each shard, rows sorted by slot in each file.

    ``placed`` is what shard_documents made of the same rows. Rows meet by doc_id, a null one too, and
    the text's checksum; of those equal in both, the n-th text in order meets the n-th place, so every
    row is written once whatever ids repeat. ``shard`` and ``slot`` columns of the documents are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    crc, rank = helper(docs), helper(docs, helper(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*kept, F.crc32(text.cast("binary")).alias(crc))
    rows = rows.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", crc).orderBy(text)))
    places = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), "shard", "slot")
    places = places.withColumn("_rank", F.row_number().over(Window.partitionBy("_id", "_crc").orderBy("shard", "slot"))).select("_id", "_crc", "_rank", F.struct("shard", "slot").alias("_place"))
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(crc) == F.col("_crc")) & (F.col(rank) == F.col("_rank"))
    joined = rows.join(places, on).select(*kept, "_place.shard", "_place.slot")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined.repartitionByRange(n, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_prefix_sum_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
