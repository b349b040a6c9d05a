"""Import of a legacy table of jobs: what is new, in batches, each as a run of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.operators.snapshots import batches

BATCH_ROWS = 10

_COLUMNS = {"source_url": "source_url", "title": "title_raw", "company": "company_raw", "location": "location_raw", "posted": "posted_raw", "applicants": "applicants_raw", "seniority_level": "seniority_level_raw", "employment_type": "employment_type_raw", "job_function": "job_function_raw", "industry": "industry_raw", "description": "description_raw"}


def to_import(legacy: DataFrame, postings: DataFrame, now: Column, size: int = BATCH_ROWS) -> DataFrame:
    """Legacy jobs with an id that bronze lacks, with batch_no by creation time, then id; the time
    of one without is now.
    """
    new = legacy.where("job_id is not null").join(postings.select("job_id").distinct(), "job_id", "left_anti").withColumn("__at", F.coalesce("created_at", now))
    return batches(new, ["__at", "job_id"], size)


def import_runs(jobs: DataFrame, first_id: Column | int = 1, size: int = BATCH_ROWS) -> DataFrame:
    """A successful scrape run for each batch. Ids follow the batches' numbers."""
    per = jobs.groupBy("batch_no").agg(F.count("*").cast("int").alias("jobs_seen_count"), F.min("__at").alias("started_at"), F.max("__at").alias("finished_at"))
    return per.select((F.col("batch_no") + first_id).cast("long").alias("scrape_run_id"), "batch_no", F.lit("").alias("keywords"), F.lit("successful").alias("status"), "started_at", "finished_at", "jobs_seen_count", F.col("jobs_seen_count").alias("jobs_inserted_count"), (F.col("batch_no") * size).alias("start_index"))


def imported_postings(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Bronze postings of the imported jobs, with the run of their batch."""
    j = jobs.join(runs.select("batch_no", "scrape_run_id"), "batch_no")
    return j.select("scrape_run_id", "job_id", *[F.col(a).alias(b) for a, b in _COLUMNS.items() if a in jobs.columns], F.col("__at").alias("scraped_at"))
