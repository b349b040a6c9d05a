"""Search requests as data: links, paging, batches, and what a response's status means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vocatio.operators.snapshots import numbered

#: Values of the search parameters. Fixed values.
TIME_RANGES = {"past_24h": "r86400", "past_week": "r604800", "past_month": "r2592000"}
WORKPLACES = {"on_site": "1", "remote": "2", "hybrid": "3"}
EXPERIENCES = {"intern": "1", "entry_level": "2", "associate": "3", "mid_senior": "4", "director": "5", "executive": "6"}
JOB_TYPES = {"full_time": "F", "part_time": "P", "contract": "C", "temporary": "T", "internship": "I"}
SORTS = {"most_recent": "DD", "most_relevant": "R"}
GEO_IDS = {"united_states": "103644278", "west_virginia": "106420769", "vietnam": "104195383", "california": "102095887"}

PAGE_STEP, MAX_START, BATCH_PAGES = 10, 1000, 10


def search_url(base: str, keywords: Column, start: Column, geo_id: Column | None = None, **filters: Column) -> Column:
    """A search link: keywords and area always (the default area where it is null), each filter
    (f_TPR, f_WT, f_E, f_JT, sortBy) only where it isn't null, the start last."""
    area = F.lit(GEO_IDS["united_states"]) if geo_id is None else F.coalesce(geo_id, F.lit(GEO_IDS["united_states"]))
    parts = [F.concat(F.lit("keywords="), F.url_encode(keywords)), F.concat(F.lit("geoId="), area)]
    for name in ("f_TPR", "f_WT", "f_E", "f_JT", "sortBy"):
        if name in filters:
            parts.append(F.concat(F.lit(f"{name}="), F.url_encode(filters[name])))
    parts.append(F.concat(F.lit("start="), start.cast("string")))
    return F.concat(F.lit(f"{base}?"), F.concat_ws("&", *parts))


def detail_url(base: str, job_id: Column) -> Column:
    return F.concat(F.lit(f"{base}/"), job_id.cast("string"))


def pages(spark: SparkSession, end: int = MAX_START) -> DataFrame:
    """batch_no, start: result pages by PAGE_STEP below the bound, BATCH_PAGES to a batch."""
    starts = spark.range(0, min(end, MAX_START), PAGE_STEP).select(F.col("id").alias("start"))
    return starts.select((F.col("start") / (PAGE_STEP * BATCH_PAGES)).cast("long").alias("batch_no"), "start")


def response_class(code: Column) -> Column:
    """successful for 200, failed for 404 and for no response (null), else retry."""
    return F.when(code.isNull() | (code == 404), "failed").when(code == 200, "successful").otherwise("retry")


def runs_until_dry(batches: DataFrame, dry: int = 2) -> DataFrame:
    """The batches (batch_no, inserted) up to the one with which ``dry`` in a row brought nothing new."""
    rows = numbered(batches.select("batch_no", "inserted"), ["batch_no"], "__number")
    # a batch without anything new is one of the last ``dry`` of itself and of the next ones
    ends = rows.where("inserted = 0").select(F.explode(F.sequence(F.col("__number"), F.col("__number") + (dry - 1))).alias("__end"))
    stop = ends.groupBy("__end").agg(F.count("*").alias("__n")).where(F.col("__n") == dry).agg(F.min("__end").alias("__stop"))  # one row
    return rows.crossJoin(F.broadcast(stop)).where("__stop is null or __number <= __stop").select("batch_no", "inserted")
