"""Long sleeps and session resets from a request log: sums that restart, counted in parallel.

A collector counts the weight of its requests. Before a request, the count starts again at zero if it
has reached the limit (then it pauses, or takes a new session), or if the request is a retry. So each
count hangs on all before it. Rows are dealt to ranges; for each count that a range may begin with, it
tells the one that it ends with. These functions are composed, first within blocks of ranges, then
block by block; then every range knows what it begins with and finishes its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.operators.snapshots import numbered
from vocatio.sources.store import scratch

#: Rows of a range, and ranges of a block; both are held by one task.
RANGE_ROWS, BLOCK_RANGES = 100_000, 512

#: Requests that a collector may make until it pauses, and until it takes a new session. Fixed value.
REQUEST_LIMIT = 3_300


def _next(sums: np.ndarray, forced: np.ndarray, limit: int) -> np.ndarray:
    """Where a count that starts at each row starts again; the number of rows if it doesn't."""
    n = len(forced)
    at = np.append(np.flatnonzero(forced), n)
    by_force = at[np.searchsorted(at, np.arange(n), side="right")]
    return np.minimum(by_force, np.searchsorted(sums[:-1], sums[:-1] + limit))


def _first(sums: np.ndarray, forced: np.ndarray, begin: np.ndarray, limit: int) -> np.ndarray:
    """The first row at which a count that comes in starts again."""
    by_force = int(forced.argmax()) if forced.any() else len(forced)
    return np.minimum(by_force, np.searchsorted(sums[:-1], limit - begin))


def transition(weights: np.ndarray, forced: np.ndarray, limit: int) -> np.ndarray:
    """The count after the rows for each count from 0 to the limit before them; the limit stands for
    all counts from there on, as the first row starts again for all of them."""
    n, sums = len(weights), np.concatenate([[0], np.cumsum(weights)])
    nxt = _next(sums, forced, limit)
    last = np.where(nxt == n, np.arange(n), nxt)
    while (last != last[last]).any():
        last = last[last]
    begin = np.arange(limit + 1)
    first = _first(sums, forced, begin, limit)
    return np.where(first == n, begin + sums[n], sums[n] - sums[last[np.minimum(first, n - 1)]])


def counts(weights: np.ndarray, forced: np.ndarray, begin: int, limit: int) -> np.ndarray:
    """The count that each row finds."""
    n, sums = len(weights), np.concatenate([[0], np.cumsum(weights)])
    nxt, starts = _next(sums, forced, limit), []
    at = int(_first(sums, forced, np.array([begin]), limit)[0])
    while at < n:
        starts.append(at)
        at = int(nxt[at])
    base = np.concatenate([[-begin], sums[starts]])
    return sums[:-1] - base[np.searchsorted(np.array(starts, np.int64), np.arange(n), side="left")]


def restarting_sum(log: DataFrame, run: list[str], order: list[str], weight: Column, restart: Column, limit: int, count: str, restarts: str, range_rows: int = RANGE_ROWS, block_ranges: int = BLOCK_RANGES) -> DataFrame:
    """The log with two more columns: ``count``, the weight of the run's rows before this one since its
    last restart, and ``restarts``, whether it starts again here: if the count has reached the limit or
    ``restart`` holds.

    Rows of a run are taken in ascending order of ``order``, nulls first; of rows equal in it those of
    smaller weight, then those that don't restart, come first. Weights are whole numbers, 0 for null and
    negative ones; null doesn't restart. A run of any size is dealt to ranges like all others. An empty
    log gives no rows. The dealt rows and the ranges' functions are written to a scratch store, once.
    """
    if limit < 1:
        raise ValueError("the limit must be positive")
    rows = log.withColumns({"__w": F.greatest(F.coalesce(weight.cast("long"), F.lit(0)), F.lit(0)), "__r": F.coalesce(restart, F.lit(False))})
    rows = numbered(rows, [*run, *order, "__w", "__r"], "__n").withColumn("__range", F.expr(f"(__n - 1) div {range_rows}"))
    # the first row of a run begins at zero, whatever came before; within a range that is seen by its neighbour
    key = F.struct(*run) if run else F.lit(0)
    steps = scratch(log.sparkSession, "restarting_sum").begin()
    rows = rows.withColumn("__head", F.coalesce(~key.eqNullSafe(F.lag(key).over(Window.partitionBy("__range").orderBy("__n"))), F.lit(True)))
    rows = steps.append(rows, "rows")
    edges = rows.groupBy("__range").agg(F.min_by(key, "__n").alias("__first"), F.max_by(key, "__n").alias("__last"))
    before = edges.select((F.col("__range") + 1).alias("__range"), F.col("__last").alias("__before"), F.lit(True).alias("__there"))
    heads = edges.join(before, "__range", "left").select("__range", (F.col("__there").isNull() | ~F.col("__first").eqNullSafe(F.col("__before"))).alias("__new"))

    def forced(pdf: pd.DataFrame, new: bool) -> np.ndarray:
        head = pdf["__head"].to_numpy(bool).copy()
        head[0] = new  # a range's first row has no neighbour in it
        return head

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n")
        head = forced(pdf, bool(pdf["__new"].iloc[0]))
        ends = transition(pdf["__w"].to_numpy(), head | pdf["__r"].to_numpy(bool), limit)
        return pd.DataFrame({"__range": pdf["__range"].iloc[:1], "__ends": [ends]})

    slim = rows.select("__range", "__n", "__w", "__r", "__head").join(heads, "__range")
    tables = slim.groupBy("__range").applyInPandas(table, "__range long, __ends array<long>").withColumn("__block", F.expr(f"__range div {block_ranges}"))
    tables = steps.append(tables, "tables")

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.arange(limit + 1)
        for ends in pdf.sort_values("__range")["__ends"]:
            out = np.asarray(ends)[np.minimum(out, limit)]
        return pd.DataFrame({"__block": pdf["__block"].iloc[:1], "__ends": [out]})

    def starts(pdf: pd.DataFrame, by: str, begin: int) -> pd.DataFrame:
        pdf, found = pdf.sort_values(by), []
        for ends in pdf["__ends"]:
            found.append(begin)
            begin = int(ends[min(begin, limit)])
        return pd.DataFrame({by: pdf[by], "__begin": found})

    # a row for each block of ranges
    blocks = tables.groupBy("__block").applyInPandas(compose, "__block long, __ends array<long>")
    blocks = blocks.groupBy(F.lit(0).alias("__all")).applyInPandas(lambda pdf: starts(pdf, "__block", 0), "__block long, __begin long")
    begun = tables.join(blocks.withColumnRenamed("__begin", "__b"), "__block")
    begun = begun.groupBy("__block").applyInPandas(lambda pdf: starts(pdf, "__range", int(pdf["__b"].iloc[0])), "__range long, __begin long")

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__n")
        head, own = forced(pdf, bool(pdf["__new"].iloc[0])), pdf["__r"].to_numpy(bool)
        found = counts(pdf["__w"].to_numpy(), head | own, int(pdf["__begin"].iloc[0]), limit)
        found = np.where(head, 0, found)
        return pd.DataFrame({"__n": pdf["__n"], "__count": found, "__restarts": own | (found >= limit)})

    ended = slim.join(begun, "__range").groupBy("__range").applyInPandas(finish, "__n long, __count long, __restarts boolean")
    out = rows.join(ended, "__n")
    return out.select(*log.columns, F.col("__count").alias(count), F.col("__restarts").alias(restarts))


def pauses(log: DataFrame, run: list[str], order: list[str], weight: Column, retry: Column, sleep_limit: int = REQUEST_LIMIT, session_limit: int = REQUEST_LIMIT) -> DataFrame:
    """The log with since_sleep, sleeps, since_reset and resets: before which requests a collector
    pauses for long, as REQUEST_LIMIT is reached or the request is a retry (retry > 0), and before which
    it takes a new session, as the session's limit is reached."""
    slept = restarting_sum(log, run, order, weight, retry > 0, sleep_limit, "since_sleep", "sleeps")
    return restarting_sum(slept, run, order, weight, F.lit(False), session_limit, "since_reset", "resets")
