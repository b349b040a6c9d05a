"""The normalization cascade: map lookup, fuzzy match, resolver; and which postings are ready.

Keys are looked at once each, whatever number of postings has them. Maps are ordinary DataFrames:
Spark broadcasts them while its statistics say they are small, and joins by shuffle beyond.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.functions.text import clean_key
from vocatio.operators import fuzzy
from vocatio.operators.snapshots import upsert

NOT_APPLICABLE = "not applicable"


def posting_keys(postings: DataFrame, clean: Callable[[Column], Column] = clean_key) -> DataFrame:
    """scrape_run_id, job_posting_raw_id and the three keys, of postings that have all three."""
    keys = postings.select("scrape_run_id", "job_posting_raw_id", clean(F.col("title_raw")).alias("title_key"), clean(F.col("location_raw")).alias("location_key"), clean(F.col("seniority_level_raw")).alias("seniority_key"))
    return keys.where("title_key <> '' and location_key <> '' and seniority_key <> ''")


def distinct_keys(postings: DataFrame) -> DataFrame:
    """The three keys of postings that have all three, once each. Raw values are told apart before they
    are cleaned, so that each is cleaned once, whatever number of postings has it."""
    raw = postings.select("title_raw", "location_raw", "seniority_level_raw").distinct()
    none = F.lit(None).cast("long")
    return posting_keys(raw.select(none.alias("scrape_run_id"), none.alias("job_posting_raw_id"), "*")).select("title_key", "location_key", "seniority_key").distinct()


def seniority_lookup(keys: DataFrame) -> DataFrame:
    """The map key of a posting's seniority: the label, or the title where the label doesn't apply."""
    by_title = F.col("seniority_key") == NOT_APPLICABLE
    return keys.withColumns({"use_title_key": by_title, "source_key": F.when(by_title, F.col("title_key")).otherwise(F.col("seniority_key"))})


def candidates(postings: DataFrame, runs: DataFrame, staged: DataFrame | None) -> DataFrame:
    """Postings of the runs (scrape_run_id) that aren't staged yet; of all, if nothing ever was."""
    own = postings.join(runs.select("scrape_run_id").distinct(), "scrape_run_id", "left_semi")
    return own if staged is None else own.join(staged, ["scrape_run_id", "job_posting_raw_id"], "left_anti")


def unresolved(keys: DataFrame, titles: DataFrame, locations: DataFrame, seniorities: DataFrame, strict: bool = False) -> DataFrame:
    """domain, use_title_key (null but for seniority), key: keys without a map row, once each.

    A seniority counts as resolved if the map has the label's row or the title's row, although a
    posting is ready only by the row of its own kind: with ``strict``, it is the complement of
    readiness instead.
    """
    none = F.lit(None).cast("boolean")

    def missing(name: str, mapping: DataFrame) -> DataFrame:
        k = keys.select(F.col(f"{name}_key").alias("key")).distinct()
        return k.join(mapping.select(F.col("key_normalized").alias("key")), "key", "left_anti").select(F.lit(name).alias("domain"), none.alias("use_title_key"), "key")

    s = keys.select("title_key", "seniority_key").distinct()
    if strict:
        wanted = seniority_lookup(s).join(seniorities, ["use_title_key", "source_key"], "left_anti")
    else:
        labels = seniorities.where("not use_title_key").select(F.col("source_key").alias("seniority_key"))
        by_title = seniorities.where("use_title_key").select(F.col("source_key").alias("title_key"))
        wanted = seniority_lookup(s.join(labels, "seniority_key", "left_anti").join(by_title, "title_key", "left_anti"))
    wanted = wanted.select(F.lit("seniority").alias("domain"), "use_title_key", F.col("source_key").alias("key")).distinct()
    return missing("title", titles).unionByName(missing("location", locations)).unionByName(wanted)


def readiness(postings: DataFrame, titles: DataFrame, locations: DataFrame, seniorities: DataFrame) -> DataFrame:
    """Keys of postings whose title, location and seniority all have their map rows."""
    keys = seniority_lookup(posting_keys(postings))
    keys = keys.join(titles.select(F.col("key_normalized").alias("title_key")), "title_key", "left_semi")
    keys = keys.join(locations.select(F.col("key_normalized").alias("location_key")), "location_key", "left_semi")
    return keys.join(seniorities.select("use_title_key", "source_key"), ["use_title_key", "source_key"], "left_semi")


def fuzzy_rows(missing: DataFrame, titles: DataFrame, locations: DataFrame, seniorities: DataFrame) -> DataFrame:
    """domain, use_title_key, key, value, ref_key for keys that fuzzy matching resolves."""
    none = F.lit(None).cast("boolean")
    parts = []
    for domain, mapping in (("title", titles), ("location", locations)):
        found = fuzzy.resolve(missing.where(F.col("domain") == domain), mapping)
        parts.append(found.select(F.lit(domain).alias("domain"), none.alias("use_title_key"), "key", "value", "ref_key"))
    own = seniorities.select("use_title_key", F.col("source_key").alias("key_normalized"), "value_normalized")
    found = fuzzy.resolve(missing.where("domain = 'seniority'"), own, ["use_title_key"])
    parts.append(found.select(F.lit("seniority").alias("domain"), "use_title_key", "key", "value", "ref_key"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def summary(keys: DataFrame, missing: DataFrame, ready: DataFrame) -> DataFrame:
    """One row: postings looked at, ready, keys unresolved by domain, keys that the maps resolved."""
    total = keys.agg(F.count("*").alias("total"), F.countDistinct("title_key").alias("titles"), F.countDistinct("location_key").alias("locations"), F.countDistinct(F.when(F.col("seniority_key") == NOT_APPLICABLE, F.concat(F.lit("t:"), F.col("title_key"))).otherwise(F.concat(F.lit("s:"), F.col("seniority_key")))).alias("seniorities"))
    count = lambda d: F.sum((F.col("domain") == d).cast("long"))
    open_ = missing.agg(*[F.coalesce(count(d), F.lit(0)).alias(f"unresolved_{d}") for d in ("title", "location", "seniority")])
    done = ready.agg(F.count("*").alias("ready"))
    by_map = sum((F.greatest(F.col(n) - F.col(f"unresolved_{d}"), F.lit(0)) for n, d in (("titles", "title"), ("locations", "location"), ("seniorities", "seniority"))), F.lit(0))
    # three rows of one value each
    return total.crossJoin(open_).crossJoin(done).select("total", "ready", "unresolved_title", "unresolved_location", "unresolved_seniority", by_map.cast("long").alias("resolved_by_map"))


def left_over(missing: DataFrame, resolved: DataFrame) -> DataFrame:
    """Keys that aren't resolved yet."""
    done = resolved.select(F.col("domain").alias("d"), F.col("use_title_key").alias("u"), F.col("key").alias("k"))
    return missing.join(done, (F.col("domain") == F.col("d")) & F.col("use_title_key").eqNullSafe(F.col("u")) & (F.col("key") == F.col("k")), "left_anti")


def all_keys(keys: DataFrame) -> DataFrame:
    """domain, use_title_key (null but for seniority), key: what the keys of postings ask for, once each."""
    none = F.lit(None).cast("boolean")
    own = [keys.select(F.lit(d).alias("domain"), none.alias("use_title_key"), F.col(f"{d}_key").alias("key")) for d in ("title", "location")]
    own.append(seniority_lookup(keys).select(F.lit("seniority").alias("domain"), "use_title_key", F.col("source_key").alias("key")))
    return own[0].unionByName(own[1]).unionByName(own[2]).distinct()


def resolved_by_method(rows: DataFrame, keys: DataFrame | None = None, missing: DataFrame | None = None) -> DataFrame:
    """domain, method, n: how many keys (domain, method) each way resolved. With the keys of postings and
    those of them that are missing from the maps, also how many the maps resolved: all others."""
    if keys is not None and missing is not None:
        rows = left_over(all_keys(keys), missing).select("domain", F.lit("map").alias("method")).unionByName(rows.select("domain", "method"))
    return rows.groupBy("domain", "method").agg(F.count("*").alias("n"))


def map_upsert(mapping: DataFrame, rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The map with the rows in: the last write of a key holds."""
    return upsert(mapping, rows, keys or ["key_normalized"])


def run(postings: DataFrame, titles: DataFrame, locations: DataFrame, seniorities: DataFrame, resolver: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three maps after lookup, fuzzy matching and the resolver, which takes
    (domain, use_title_key, key) and returns these with ``value``."""
    keys = posting_keys(postings)
    missing = unresolved(keys, titles, locations, seniorities)
    near = fuzzy_rows(missing, titles, locations, seniorities).select("domain", "use_title_key", "key", "value").withColumn("method", F.lit("fuzzy"))
    answered = resolver(left_over(missing, near)).select("domain", "use_title_key", "key", "value").withColumn("method", F.lit("llm"))
    new = near.unionByName(answered)
    simple = lambda d: new.where(F.col("domain") == d).select(F.col("key").alias("key_normalized"), F.col("value").alias("value_normalized"), "method")
    third = new.where("domain = 'seniority'").select("use_title_key", F.col("key").alias("source_key"), F.col("value").alias("value_normalized"), "method")
    return map_upsert(titles, simple("title")), map_upsert(locations, simple("location")), map_upsert(seniorities, third, ["use_title_key", "source_key"])
