"""Labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
FIT_ROWS = 12_000


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves that rest: such rows' labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod == rest


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, rest: int, limit: int = FIT_ROWS) -> DataFrame:
    """text and label (0 or 1) of at most ``limit`` labelled documents outside the held-out part:
    those with the smallest hash of the id, whatever the order of rows.

    Null labels and ids don't count; of an id labelled twice, the larger label holds. The ids are
    broadcast, being ``limit`` at most, so that no text is shuffled.
    """
    some = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    some = some.groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("label"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null")
