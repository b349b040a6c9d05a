"""Captured pages as a stream: each batch of responses becomes cards, postings and finished runs.

The responses are those of a collector that asks one after the other: search pages, a run each, then
the pages of the jobs found. ``at`` numbers them in the order in which they were asked for. All that
comes of a batch of the stream is committed at once, under the batch's number, so a batch that is run
again after a failure, wherever it failed, adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vocatio.functions.requests import response_class
from vocatio.sources.html import job_posts, merged, search_cards
from vocatio.sources.store import Store, Transaction

#: A response: ``job_id`` is null for search pages; ``status`` is null where there was no response.
RESPONSE = "at long, scrape_run_id long, job_id long, status int, html string"

RUNS, CARDS, POSTINGS = "scrape_runs", "job_search_cards_raw", "job_postings_raw"


def outcomes(responses: DataFrame) -> DataFrame:
    """scrape_run_id, began, result (successful, failed, retry), block (the first response that was
    refused for good, of the whole batch), of each search page.

    A refused response ends the collecting: no run that hadn't ended by then is successful. A run has
    ended when the pages of its jobs are read, which happens after all searches, run by run.
    """
    known = responses.withColumn("result", response_class(F.col("status")))
    block = known.where("result = 'retry'").agg(F.min(F.struct("at", "job_id", "scrape_run_id", "status")).alias("block"))  # one row
    searches = known.where("job_id is null").groupBy("scrape_run_id").agg(F.min(F.struct("at", "result")).alias("own"))
    return searches.crossJoin(F.broadcast(block)).select("scrape_run_id", F.col("own.at").alias("began"), "own.result", "block")


def ingested(responses: DataFrame, stored: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cards, new postings and runs of a batch of responses (RESPONSE). ``stored``: job_ids of postings
    that are there already. ``keep(rows, table)`` may store rows and return the stored ones, so that
    no page is parsed again for what follows.

    Cards come from successful searches, those without a job id too, each with its run; postings from
    successful pages of jobs that aren't stored, once for each run that found them. A failed page of a
    job is passed over. A failed search fails its run. After a refused search all runs have failed and
    no posting is read; after a refused page of a job those of its run and later ones, and postings read
    before stay. Responses beyond the refused one count as not asked for. ``seen`` counts a run's cards,
    ``inserted`` its postings. Null and empty pages give no cards; an empty batch gives nothing. Runs and
    stored jobs meet the rest by shuffle: only single rows are broadcast, as broadcasts are built in the driver.
    """
    runs = outcomes(responses)
    limit = F.coalesce(F.col("block.at"), F.lit(2**63 - 1))
    asked = responses.join(runs.select("scrape_run_id", "began", limit.alias("limit"), (F.col("block").isNotNull() & F.col("block.job_id").isNull()).alias("closed")).hint("merge"), "scrape_run_id").where(F.col("at") < F.col("limit"))
    good = asked.where(response_class(F.col("status")) == "successful")
    cards = keep(search_cards(good.where("job_id is null").select("scrape_run_id", "html")), CARDS)
    pages = good.where("job_id is not null and not closed").select("scrape_run_id", F.col("job_id").alias("post_id"), "html").dropDuplicates(["scrape_run_id", "post_id"])
    posts = job_posts(pages).withColumnRenamed("post_id", "job_id").withColumnRenamed("scrape_run_id", "post_run")
    # a run's cards meet the pages read for that run
    once = cards.dropDuplicates(["scrape_run_id", "job_id"])
    postings = keep(merged(once, posts, stored, run="scrape_run_id", post_run="post_run"), POSTINGS)
    seen = cards.groupBy("scrape_run_id").agg(F.count("*").alias("seen"))
    inserted = postings.groupBy("scrape_run_id").agg(F.count("*").alias("inserted"))
    # the run whose job's page was refused, and all that began later, hadn't ended
    first_open = runs.where("block.scrape_run_id = scrape_run_id").agg(F.min("began").alias("open"))  # one row
    told = runs.crossJoin(F.broadcast(first_open)).join(seen.hint("merge"), "scrape_run_id", "left").join(inserted.hint("merge"), "scrape_run_id", "left")
    stopped = F.col("block").isNotNull() & (F.col("block.job_id").isNull() | (F.col("began") >= F.coalesce("open", F.lit(0))))
    failed = (F.col("result") == "failed") | stopped
    error = F.when(F.col("result") == "failed", "search failed").when(stopped, F.concat(F.lit("blocked: "), F.coalesce(F.col("block.status").cast("string"), F.lit("none"))))
    ended = keep(told.where("block.at is null or began <= block.at").select(
        "scrape_run_id", F.when(failed, "failed").otherwise("successful").alias("status"), F.coalesce("seen", F.lit(0)).cast("long").alias("jobs_seen_count"), F.coalesce("inserted", F.lit(0)).cast("long").alias("jobs_inserted_count"), error.alias("error_message")
    ), RUNS)
    return cards, postings, ended


def add_batch(store: Store, responses: DataFrame, stream: str, number: int) -> None:
    """Commits a batch's cards, postings and runs together, once."""

    def change(tx: Transaction) -> None:
        there = tx.exists(POSTINGS, "bronze")
        stored = tx.read(POSTINGS, "bronze").select("job_id") if there else responses.select("job_id").limit(0)
        ingested(responses, stored, lambda rows, name: tx.append(rows, name, "bronze"))

    store.update(change, (stream, number))


def ingest_pages(spark: SparkSession, folder: str, store: Store, checkpoint: str, stream: str = "ingest") -> StreamingQuery:
    """Reads all Parquet files of responses that are new in the folder, and stops. A job that is stored
    is not stored again."""
    pages = spark.readStream.schema(RESPONSE).parquet(folder)
    add = lambda batch, number: add_batch(store, batch, stream, number)
    return pages.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
