"""Resolvers: what decides on keys that neither maps nor fuzzy matching know.

A hosted language model can't be reproduced; its contract can: batches of a fixed size, as many
answers as keys or a retry, answers in lower case from a closed list where there is one. Any
callable on a list of keys plugs in; the rules here are the deterministic ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.functions.text import clean_key, distinct_skills, seniority_from_raw, seniority_from_title

BATCH, RETRIES, SKILLS = 3, 1, 10


def by_rules(keys: DataFrame, titles: DataFrame | None = None, locations: DataFrame | None = None) -> DataFrame:
    """Seniorities by the rules of labels and titles; titles and locations by dictionaries
    (key, value), which default to unknown."""
    seniority = keys.where("domain = 'seniority'").withColumn("value", F.when(F.col("use_title_key"), seniority_from_title(F.col("key"))).otherwise(seniority_from_raw(F.col("key"))))
    out = seniority
    for domain, book in (("title", titles), ("location", locations)):
        own = keys.where(F.col("domain") == domain)
        known = own.withColumn("value", F.lit(None).cast("string")) if book is None else own.join(book.select("key", "value"), "key", "left")
        out = out.unionByName(known.select(*keys.columns, F.coalesce("value", F.lit("unknown")).alias("value")))
    return out


def in_batches(keys: DataFrame, answer: Callable[[str, list[str]], list[str]], batch: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """Each domain's keys in batches through ``answer(domain, keys)``, in tasks. A batch whose
    answers don't match its keys in number is asked again, then fails the job."""

    def ask(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for (domain, _), group in pdf.groupby(["domain", "use_title_key"], dropna=False):
                for at in range(0, len(group), batch):
                    part = group.iloc[at : at + batch]
                    asked = part["key"].tolist()
                    for _attempt in range(retries + 1):
                        answers = answer(domain, asked)
                        if len(answers) == len(asked):
                            break
                    else:
                        raise ValueError(f"{domain}: {len(answers)} answers for {len(asked)} keys")
                    yield part.assign(value=[a.lower() for a in answers])

    return keys.select("domain", "use_title_key", "key").sortWithinPartitions("domain", "key").mapInPandas(ask, "domain string, use_title_key boolean, key string, value string")


def extract_skills(texts: Column, vocabulary: list[str]) -> Column:
    """The vocabulary's words and phrases (lower case, one space between words) in a text, in the
    text's order, a longer one before those that begin it, once each, SKILLS at most; an empty array
    for null and blank texts. A phrase may stand across punctuation."""
    words = F.split(clean_key(F.regexp_replace(texts, r"[^\p{L}\p{N}+#]+", " ")), " ")
    longest = max((len(v.split(" ")) for v in vocabulary), default=1)
    found = words
    if longest > 1:
        found = F.flatten(F.transform(words, lambda w, i: F.array(*[F.array_join(F.slice(words, i + 1, n), " ") for n in range(longest, 0, -1)])))
    return distinct_skills(F.array_distinct(F.filter(found, lambda w: w.isin(*vocabulary))), SKILLS)
