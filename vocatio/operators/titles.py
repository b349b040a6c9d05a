"""Titles by rules: ordered rewrites of words, run until nothing changes, then the first occupation.

Rules and occupations are tables. The rules go to the tasks as one row, whose number is checked; the
rewriting is a fold over them inside the JVM. Occupations are met as phrases, by equi-joins, so their
table may have any size. What is looked up are distinct titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.functions.text import NO_TITLE, clean_key
from vocatio.operators.phrases import phrase_spans, words_of

RULES = "place int, before string, after string"
OCCUPATIONS = "phrase string, occupation string"
UNKNOWN = "Unknown"

#: Rules that a fold may have, and passes over them; a title that still changes then is unknown.
MOST_RULES, PASSES = 2_000, 8

# --- fixed values ---

#: Words that tell a level and no occupation.
LEVELS = ("senior", "sr", "junior", "jr", "lead", "principal", "staff", "intern", "i", "ii", "iii", "iv", "vp", "director")

#: Abbreviations, in the order in which they are tried.
ABBREVIATIONS = (("rn", "registered nurse"), ("hr", "human resources"), ("swe", "software engineer"), ("dev", "developer"), ("mgr", "manager"), ("sw", "software"), ("ml", "machine learning"))


def fixed_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *x) for n, x in enumerate(ABBREVIATIONS)], RULES)


def _spaced(words: Column) -> Column:
    """Each word between two spaces of its own, so that neighbours can be replaced side by side."""
    return F.concat_ws("", F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))))


def _words(spaced: Column) -> Column:
    return F.array_remove(F.split(spaced, " +"), "")


def rewritten(titles: DataFrame, rules: DataFrame, words_col: str, most_rules: int = MOST_RULES, passes: int = PASSES) -> DataFrame:
    """The table with words_col rewritten by rules, in order of place (then of before, after), until
    nothing changes; null where something still does after so many passes.

    A pass takes each rule in turn and replaces every occurrence of its words, from left to right.
    Rules without words before, or that change nothing, don't count; a rule may have none after.
    More than ``most_rules`` of them are an error, as they are sent to every task.
    """
    spelt = rules.select("place", _spaced(words_of(F.col("before"))).alias("old"), _spaced(words_of(F.coalesce("after", F.lit("")))).alias("new"))
    spelt = spelt.where("old <> '' and old <> new").distinct()
    if (n := spelt.count()) > most_rules:
        raise ValueError(f"{n} rules; {most_rules} can be sent to every task")
    # one row of a checked size
    folded = spelt.agg(F.array_sort(F.collect_list(F.struct("place", "old", "new"))).alias("__rules"))
    once = lambda t: F.aggregate("__rules", t, lambda acc, r: F.replace(acc, r["old"], r["new"]))
    state = F.struct(_spaced(F.col(words_col)).alias("now"), F.lit(True).alias("moved"))

    def step(s: Column, _: Column) -> Column:
        after = F.when(s["moved"], once(s["now"])).otherwise(s["now"])
        return F.struct(after.alias("now"), (after != s["now"]).alias("moved"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), state, step)
    out = titles.crossJoin(F.broadcast(folded)).withColumn("__end", end)
    return out.withColumn(words_col, F.when(~F.col("__end.moved"), _words(F.col("__end.now")))).drop("__rules", "__end")


def titles_by_rules(titles: DataFrame, rules: DataFrame, occupations: DataFrame, text_col: str = "title") -> DataFrame:
    """text_col, value: each distinct title with the occupation it stands for, else Unknown.

    Words are rewritten by the rules first. Then the first phrase of the occupations is taken, the
    longest at its place, of the title as it is and of the title without LEVELS; of the two the
    longer phrase, and the title as it is where they are equally long. So levels go, unless an
    occupation is named by them. Of a phrase with several occupations the first by name holds.
    Texts that are no titles, null and blank ones, and those whose rewriting doesn't end are Unknown.
    Repeated rows count once; empty tables rewrite and know nothing.
    """
    own = titles.select(F.col(text_col).alias("text")).distinct()
    sound = own.where(F.col("text").isNotNull() & ~clean_key(F.col("text")).rlike(f"(^|[^a-z])({NO_TITLE})([^a-z]|$)"))
    ended = rewritten(sound.withColumn("words", words_of(F.col("text"))), rules, "words").where("words is not null")
    stripped = F.filter("words", lambda w: ~w.isin(*LEVELS))
    both = ended.select("text", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("words").alias("w")), F.struct(F.lit(1).alias("way"), stripped.alias("w")))).alias("x"))
    both = both.where("x.way = 0 or size(x.w) > 0").select(F.struct("text", "x.way").alias("id"), F.array_join("x.w", " ").alias("said"))
    spans = phrase_spans(both, occupations.select("phrase").distinct(), "id", "said")
    first = spans.groupBy("id").agg(F.min_by(F.struct("n", "phrase"), "at").alias("x"))
    best = first.groupBy("id.text").agg(F.min_by("x.phrase", F.struct(-F.col("x.n"), F.col("id.way"))).alias("phrase"))
    names = occupations.select(F.array_join(words_of(F.col("phrase")), " ").alias("phrase"), "occupation").groupBy("phrase").agg(F.min("occupation").alias("occupation"))
    found = best.join(names, "phrase").select("text", "occupation")
    return own.join(found, "text", "left").select(F.col("text").alias(text_col), F.coalesce("occupation", F.lit(UNKNOWN)).alias("value"))
