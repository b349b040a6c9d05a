"""Fuzzy matching of keys: the most similar candidate at or above a threshold.

The similarity is difflib's ratio of both strings with their words sorted, which is neither
symmetric nor an edit distance, so it runs in Arrow batches. As ratio = 2 M / (la + lb) with M at
most the shorter length, only candidates in a band of lengths can reach the threshold; and as M is
at most the number of letters in common, strings that reach it share one of their rarest letters, as
many of them as can be missing. Keys and candidates meet by an equi-join on both, and the letters in
common are counted before the ratio is computed. Nothing that could be accepted is dropped.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vocatio.functions.text import token_sort

VALUE_THRESHOLD, KEY_THRESHOLD = 0.90, 0.94

#: Lengths of one band.
BAND = 8

#: Letters from rare to frequent ones, after all others. Results don't depend on it.
RARE_FIRST = "zqjxkvbwygpfmucdlhrsnioate "


@F.pandas_udf(DoubleType())
def ratio_at_least(a: pd.Series, b: pd.Series, least: pd.Series) -> pd.Series:
    """The ratio, or null where it is below."""
    out = []
    matcher = SequenceMatcher()
    seen = None
    for x, y, t in zip(a, b, least, strict=True):
        if y != seen:
            matcher.set_seq2(y)
            seen = y
        matcher.set_seq1(x)
        r = matcher.ratio() if matcher.real_quick_ratio() >= t and matcher.quick_ratio() >= t else None
        out.append(r if r is not None and r >= t else None)
    return pd.Series(out, dtype="float64")


def _letters(df: DataFrame, text: str, out: str) -> DataFrame:
    """With the text's letters as numbers of (letter, how many-th of its kind), rarest first."""
    df = df.withColumn(out, F.array_sort(F.filter(F.split(text, ""), lambda x: x != "")))
    number = f"instr('{RARE_FIRST}', x) * bigint(1125899906842624) + ascii(x) * bigint(268435456) + i + 2 - array_position({out}, x)"
    return df.withColumn(out, F.expr(f"array_sort(transform({out}, (x, i) -> {number}))"))


def _rarest(letters: str, n: str, threshold: float) -> Column:
    """The rarest letters of a text of n, of which any text that reaches the threshold with it has one
    among its own: fewer than those can be missing. A text without letters has a mark instead."""
    least = F.ceil(F.col(n) * threshold / (2 - threshold) - 1e-6)
    common = F.ceil((F.col(n) + least) * (threshold / 2) - 1e-6)
    return F.when(F.col(n) == 0, F.array(F.lit(0).cast("long"))).otherwise(F.slice(letters, 1, F.greatest(F.col(n) - common + 1, F.lit(1)).cast("int")))


def best_match(keys: DataFrame, candidates: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """key, candidate, score (and the columns of ``by``): the best candidate of each key, ties to
    the smallest string. ``by`` are columns in which both sides must agree."""
    pairs = possible_pairs(keys, candidates, threshold, by)
    by = by or []
    pairs = pairs.withColumn("score", ratio_at_least("ka", "cb", F.lit(threshold))).where("score is not null")
    # the best score, then the least string, in one aggregate
    best = pairs.groupBy(*by, "key").agg(F.min(F.struct((-F.col("score")).alias("minus"), "candidate")).alias("b"))
    return best.select(*by, "key", "b.candidate", (-F.col("b.minus")).alias("score"))


def possible_pairs(keys: DataFrame, candidates: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """key, ka, candidate, cb (and ``by``), once each: pairs whose lengths and letters in common allow
    the threshold. ka and cb have their words sorted."""
    by = by or []
    k = keys.select(*by, "key").distinct().withColumn("ka", token_sort(F.col("key"))).withColumn("la", F.length("ka"))
    c = candidates.select(*by, "candidate").distinct().withColumn("cb", token_sort(F.col("candidate"))).withColumn("lb", F.length("cb"))
    k = _letters(k, "ka", "ta").withColumn("pa", _rarest("ta", "la", threshold))
    c = _letters(c, "cb", "tb").withColumn("pb", _rarest("tb", "lb", threshold))
    # 2 min / (la + lb) >= t means lb between la t / (2 - t) and la (2 - t) / t
    span = (2 - threshold) / threshold
    lo, hi = F.floor(F.col("la") / span / BAND), F.floor(F.col("la") * span / BAND)
    k = k.withColumn("band", F.explode(F.sequence(lo, hi))).withColumn("letter", F.explode("pa"))
    c = c.withColumn("band", F.floor(F.col("lb") / BAND)).withColumn("letter", F.explode("pb"))
    need = (F.lit(threshold) - 1e-9) * (F.col("la") + F.col("lb"))
    once = F.array_min(F.array_intersect("pa", "pb")) == F.col("letter")  # a pair meets at each rare letter in common
    met = k.join(c, [*by, "band", "letter"]).where((2 * F.least("la", "lb")) >= need).where(once).where(2 * F.size(F.array_intersect("ta", "tb")) >= need)
    return met.select(*by, "key", "ka", "candidate", "cb")


def resolve(keys: DataFrame, mapping: DataFrame, by: list[str] | None = None) -> DataFrame:
    """key, value, ref_key (and ``by``): a key takes a map's value that it resembles, else the
    value of a map's key that it resembles still more; the map is taken as it was at the start."""
    by = by or []
    values = mapping.select(*by, F.col("value_normalized").alias("candidate"))
    first = best_match(keys, values, VALUE_THRESHOLD, by).select(*by, "key", F.col("candidate").alias("value"), F.lit(None).cast("string").alias("ref_key"))
    rest = keys.select(*by, "key").distinct().join(first.select(*by, "key"), [*by, "key"], "left_anti")
    own = mapping.select(*by, F.col("key_normalized").alias("candidate"), F.col("value_normalized").alias("value"))
    second = best_match(rest, own, KEY_THRESHOLD, by).join(own, [*by, "candidate"]).select(*by, "key", "value", F.col("candidate").alias("ref_key"))
    return first.unionByName(second)
