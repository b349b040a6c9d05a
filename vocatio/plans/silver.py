"""The star schema: standardized postings, dimensions, facts, skills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocatio.functions.text import clean_key
from vocatio.operators.cascade import seniority_lookup
from vocatio.operators.snapshots import dimension, insert_new, unseen, with_ids

STG_KEY = ["scrape_run_id", "job_posting_raw_id"]


def stg_job_postings(postings: DataFrame, ready: DataFrame, titles: DataFrame, locations: DataFrame, seniorities: DataFrame) -> DataFrame:
    """Ready postings with their normalized names. The seniority's either-or join condition is one
    equality of a computed key pair, so it is a hash join."""
    return _standardized(_keyed(postings.join(ready.select(*STG_KEY), STG_KEY)), titles, locations, seniorities)


def stg_of_ready(postings: DataFrame, titles: DataFrame, locations: DataFrame, seniorities: DataFrame) -> DataFrame:
    """What stg_job_postings gives for the postings that the same maps make ready, without joining all
    postings with themselves: rows of a key come as often as the key has rows that are ready."""
    known = lambda m, of, to: m.select(F.col(of).alias(to)).distinct().withColumn(f"__{to}", F.lit(True))
    own = _keyed(postings).join(known(titles, "key_normalized", "title_key"), "title_key", "left").join(known(locations, "key_normalized", "location_key"), "location_key", "left")
    labels = seniorities.select("use_title_key", "source_key").distinct().withColumn("__label", F.lit(True))
    own = seniority_lookup(own).join(labels, ["use_title_key", "source_key"], "left").drop("use_title_key", "source_key")
    filled = (F.col("title_key") != "") & (F.col("location_key") != "") & (F.col("seniority_key") != "")
    is_ready = F.col("__title_key").isNotNull() & F.col("__location_key").isNotNull() & F.col("__label").isNotNull() & filled
    # a run's posting is a row or so
    counted = own.withColumn("__n", F.sum(is_ready.cast("int")).over(Window.partitionBy(*STG_KEY))).where("__n > 0 and job_posting_raw_id is not null and scrape_run_id is not null")
    often = counted.withColumn("__each", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))))
    return _standardized(often.drop("__title_key", "__location_key", "__label", "__n", "__each"), titles, locations, seniorities)


def _keyed(postings: DataFrame) -> DataFrame:
    return postings.withColumns({"title_key": clean_key(F.col("title_raw")), "location_key": clean_key(F.col("location_raw")), "seniority_key": clean_key(F.col("seniority_level_raw"))})


def _standardized(keyed: DataFrame, titles: DataFrame, locations: DataFrame, seniorities: DataFrame) -> DataFrame:
    t = titles.select(F.col("key_normalized").alias("title_key"), F.col("value_normalized").alias("title_normalized"))
    loc = locations.select(F.col("key_normalized").alias("location_key"), F.col("value_normalized").alias("location_normalized"))
    s = seniorities.select("use_title_key", "source_key", F.col("value_normalized").alias("seniority_normalized"))
    joined = seniority_lookup(keyed).join(t, "title_key", "left").join(loc, "location_key", "left").join(s, ["use_title_key", "source_key"], "left")
    return joined.select(*STG_KEY, "job_id", "title_raw", "company_raw", "location_raw", "source_url", "scraped_at", "seniority_level_raw", "employment_type_raw", "job_function_raw", "industry_raw", "description_raw", "title_normalized", "location_normalized", "seniority_normalized")


def _known(name: str) -> Column:
    return F.nullif(F.trim(F.col(name)), F.lit("")).isNotNull() & (F.lower(F.trim(F.col(name))) != "unknown")


def _named(name: str) -> Column:
    return F.nullif(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), r"\s+", " "), F.lit("")).isNotNull()


def dim_titles(stg: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return dimension(stg.where(_known("title_normalized")).select(F.col("title_normalized").alias("title_name")), "title_name", "title_id", existing)


def dim_locations(stg: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return dimension(stg.where(_known("location_normalized")).select(F.col("location_normalized").alias("location_name")), "location_name", "location_id", existing)


def dim_companies(stg: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Companies keep their raw spelling; only blank ones are left out."""
    return dimension(stg.where(_named("company_raw")).select(F.col("company_raw").alias("company_name")), "company_name", "company_id", existing)


def names(stg: DataFrame, name: str) -> DataFrame:
    """Each name of the column once, with the time it was first scraped at: dimensions of all postings
    and of those before a time are made from it, so that the postings are read once."""
    return stg.groupBy(name).agg(F.min("scraped_at").alias("scraped_at"))


def _told(stg: DataFrame) -> DataFrame:
    told = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", "unknown")
    return stg.where(told("title_normalized") & told("location_normalized") & told("seniority_normalized"))


def fact_rows(stg: DataFrame) -> DataFrame:
    """The standardized rows that fact_job_postings takes with dimensions of the same table, for views
    that need none of the dimensions' ids."""
    return _told(stg).where(_known("title_normalized") & _known("location_normalized") & _named("company_raw"))


def fact_job_postings(stg: DataFrame, titles: DataFrame, companies: DataFrame, locations: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row for each run and posting whose names are all known. Rows that are there already stay
    as they are, whatever has changed in maps since."""
    base = _told(stg)
    if existing is not None:
        base = unseen(existing, base, STG_KEY)
    joined = base.join(titles, F.col("title_normalized") == F.col("title_name")).join(companies, F.col("company_raw") == F.col("company_name")).join(locations, F.col("location_normalized") == F.col("location_name"))
    new = joined.select(
        *STG_KEY, "job_id", "title_id", "company_id", "location_id", F.col("title_raw").alias("title"), "title_normalized", F.col("company_raw").alias("company"), F.col("location_normalized").alias("location"),
        F.col("seniority_normalized").alias("seniority"), F.col("employment_type_raw").alias("employment_type"), F.col("industry_raw").alias("industry"), F.col("description_raw").alias("description"), "source_url", "scraped_at",
    )
    return new if existing is None else existing.unionByName(new)


def dim_skills(names: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """skill_id, skill_name: cleaned names, those that are there keep their ids."""
    cleaned = names.select(clean_key(F.col("skill_name")).alias("skill_name")).where("skill_name <> ''").distinct()
    if existing is None:
        return with_ids(cleaned, "skill_name", "skill_id")
    return existing.unionByName(with_ids(unseen(existing, cleaned, ["skill_name"]), "skill_name", "skill_id", existing).select(*existing.columns))


def skill_bridge(found: DataFrame, skills: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """job_posting_raw_id, skill_id: once each; names that the dimension lacks are dropped."""
    pairs = found.select("job_posting_raw_id", clean_key(F.col("skill_name")).alias("skill_name")).distinct().join(skills, "skill_name").select("job_posting_raw_id", "skill_id")
    return pairs if existing is None else insert_new(existing, pairs, ["job_posting_raw_id", "skill_id"])


def unprocessed_descriptions(facts: DataFrame, ids: DataFrame, bridge: DataFrame) -> DataFrame:
    """Facts of the ids with a description that isn't blank and without skills yet."""
    own = facts.join(ids.select("job_posting_raw_id").distinct(), "job_posting_raw_id", "left_semi")
    return own.where(F.trim(F.coalesce("description", F.lit(""))) != "").join(bridge, "job_posting_raw_id", "left_anti").select("job_posting_raw_id", "description")
