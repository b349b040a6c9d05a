"""Phrases of a vocabulary table in texts: leftmost first, the longest at each place, none overlapping.

A phrase is met by its first two words (or its only one) in an equi-join, and then compared word by
word with what follows in the text. So neither the vocabulary is a part of the plan, nor is every run
of words of a text looked up. The book of phrases is written first, so that Spark knows its size: a
small one is broadcast, and then nothing but matches is shuffled, once, or not at all where the texts
are dealt by their ids already; a larger one is joined by shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocatio.functions.text import clean_key
from vocatio.operators.resolvers import SKILLS
from vocatio.sources.store import scratch


def words_of(text: Column) -> Column:
    """Words in lower case: runs of letters, digits, + and #; none for null."""
    return F.array_remove(F.split(clean_key(F.regexp_replace(text, r"[^\p{L}\p{N}+#]+", " ")), " "), "")


def _first_words(words: Column, n: int) -> Column:
    return F.array_join(F.slice(words, 1, n), " ")


def phrase_book(vocabulary: DataFrame, phrase: str = "phrase") -> DataFrame:
    """key, words, n, phrase: each phrase once, in its words' spelling. Phrases without words don't count."""
    book = vocabulary.select(words_of(F.col(phrase)).alias("words")).where(F.size("words") > 0).distinct()
    return book.select(_first_words(F.col("words"), 2).alias("key"), "words", F.size("words").alias("n"), F.array_join("words", " ").alias("phrase"))


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _leftmost(starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Which of a text's matches, in ascending places, are taken: each that begins where the last one
    taken has ended, or later."""

    def one(at, n) -> list[bool]:
        out, end = [], -1
        for a, size in zip(at, n, strict=True):
            out.append(bool(a >= end))
            if a >= end:
                end = a + size
        return out

    return pd.Series([one(a, n) for a, n in zip(starts, sizes, strict=True)])


def phrase_spans(texts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, phrase: str = "phrase") -> DataFrame:
    """id, at, n, phrase: the phrases taken from each text, from left to right, by place and number of
    words; ``id`` is id_col.

    Case and what stands between words don't count. Of matches at one place the longest is taken, and
    no match overlaps the one taken before. Null texts have none. Texts of one id are texts of their
    own, equal ones count once. An empty vocabulary or table gives an empty result.
    """
    book = scratch(texts.sparkSession, "phrases").begin().append(phrase_book(vocabulary, phrase), "book")
    longest = book.agg(F.max("n")).first()[0] or 1
    w = texts.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text"), words_of(F.col(text_col)).alias("w"))
    ahead = F.transform("w", lambda _, i: F.slice("w", i + 1, longest))
    places = w.select("id", "text", F.posexplode(ahead).alias("at", "ahead"))
    two = _first_words(F.col("ahead"), 2)
    # a place is met by its word and by its two words, where there are two
    keys = F.array_distinct(F.array(F.col("ahead")[0], two))
    met = places.select("id", "text", "at", "ahead", F.explode(keys).alias("key")).join(book, "key")
    met = met.where(F.slice("ahead", 1, F.col("n")) == F.col("words"))
    # the matches of one text, in its order, the longest first at each place; the rest there overlap it
    lists = met.groupBy("id", "text").agg(F.array_sort(F.collect_set(F.struct("at", (-F.col("n")).alias("less"), "phrase"))).alias("all"))
    taken = lists.withColumn("taken", _leftmost(F.col("all.at"), F.transform("all", lambda x: -x["less"])))
    return taken.select("id", F.explode(F.arrays_zip("all", "taken")).alias("x")).where("x.taken").select("id", "x.all.at", (-F.col("x.all.less")).alias("n"), "x.all.phrase")


def skills_by_vocabulary(texts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, most: int = SKILLS) -> DataFrame:
    """id_col, skills: the first ``most`` different phrases of each text that has any, in its order."""
    spans = phrase_spans(texts, vocabulary, id_col, text_col, vocabulary.columns[0])
    lists = spans.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("at", "phrase"))).alias("all"))
    return lists.select(F.col("id").alias(id_col), F.slice(F.array_distinct("all.phrase"), 1, most).alias("skills"))
