"""The run ledger: what is to be done, and how runs went.

The functions on tables change a ledger as a whole; those on a store commit the change, so that two
processes neither overwrite each other's entries nor take the same runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocatio.operators.snapshots import batches, upsert
from vocatio.sources.store import Store, Transaction

RUN_STATUSES = ("running", "successful", "failed")
STAGES = ("normalization", "dbt", "skill_extraction")
ENDED = ("successful", "failed")


def runs_to_process(runs: DataFrame, postings: DataFrame, ledger: DataFrame) -> DataFrame:
    """scrape_run_id of successful runs with postings that no successful process run covers. The
    ledger's arrays are exploded, so that the anti join is an equi-join."""
    done = ledger.where("status = 'successful'").select(F.explode("scrape_run_ids").alias("scrape_run_id"))
    some = postings.select("scrape_run_id")
    return runs.where("status = 'successful'").select("scrape_run_id").join(some, "scrape_run_id", "left_semi").join(done, "scrape_run_id", "left_anti")


def in_process_batches(runs: DataFrame, size: int = 3) -> DataFrame:
    return batches(runs, ["scrape_run_id"], size)


def unextracted_ready(postings: DataFrame, ready: DataFrame, bridge: DataFrame, runs: DataFrame) -> DataFrame:
    """Staged postings of the runs that have no skills yet, once each."""
    own = postings.join(runs.select("scrape_run_id").distinct(), "scrape_run_id", "left_semi")
    return own.join(ready, ["scrape_run_id", "job_posting_raw_id"], "left_semi").join(bridge, "job_posting_raw_id", "left_anti").select("job_posting_raw_id").distinct()


def to_extract(ready_ids: DataFrame, unextracted: DataFrame) -> DataFrame:
    return ready_ids.select("job_posting_raw_id").union(unextracted.select("job_posting_raw_id")).distinct()


def append_run(ledger: DataFrame, scrape_run_ids: Column, started_at: Column) -> DataFrame:
    """The ledger with a new running entry, in the first stage."""
    top = ledger.agg((F.coalesce(F.max("normalization_process_run_id"), F.lit(0)) + 1).cast("long").alias("normalization_process_run_id"))
    new = top.select("normalization_process_run_id", scrape_run_ids.alias("scrape_run_ids"), F.lit("running").alias("status"), F.lit(STAGES[0]).alias("stage"), F.lit(None).cast("string").alias("error"), started_at.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"))
    return ledger.unionByName(new.select(*ledger.columns))


def update_run(ledger: DataFrame, run_id: int, at: Column, status: str | None = None, stage: str | None = None, error: str | None = None) -> DataFrame:
    """The ledger with one entry changed; it is finished once its status says so."""
    own = F.col("normalization_process_run_id") == run_id
    out = ledger
    if stage is not None:
        out = out.withColumn("stage", F.when(own, F.lit(stage)).otherwise(F.col("stage")))
    if status is not None:
        out = out.withColumn("status", F.when(own, F.lit(status)).otherwise(F.col("status")))
        out = out.withColumn("error", F.when(own, F.lit(error)).otherwise(F.col("error")))
        if status in ENDED:
            out = out.withColumn("finished_at", F.when(own, at).otherwise(F.col("finished_at")))
    return out


def finish_scrape_runs(runs: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """Scrape runs with their outcomes (scrape_run_id, status, seen, inserted, error) written in."""
    o = outcomes.select("scrape_run_id", F.col("status").alias("o_status"), "seen", "inserted", "error")
    j = runs.join(o, "scrape_run_id", "left")
    done = F.col("o_status").isNotNull()
    new = {"status": F.coalesce("o_status", "status"), "jobs_seen_count": F.coalesce(F.col("seen"), F.col("jobs_seen_count")), "jobs_inserted_count": F.coalesce(F.col("inserted"), F.col("jobs_inserted_count")), "error_message": F.coalesce("error", "error_message"), "finished_at": F.when(done, at).otherwise(F.col("finished_at"))}
    return j.withColumns(new).select(*runs.columns)


def fail_running(runs: DataFrame, error: str, at: Column) -> DataFrame:
    """After a hard block every run that still runs has failed."""
    on = F.col("status") == "running"
    return runs.withColumns({"error_message": F.when(on, F.lit(error)).otherwise(F.col("error_message")), "finished_at": F.when(on, at).otherwise(F.col("finished_at")), "status": F.when(on, "failed").otherwise(F.col("status"))})


def staging_upsert(staged: DataFrame, sent: DataFrame, at: Column) -> DataFrame:
    """Sent pairs with a new ready_at; all others keep theirs."""
    new = sent.select("scrape_run_id", "job_posting_raw_id").distinct().withColumn("ready_at", at)
    return upsert(staged, new, ["scrape_run_id", "job_posting_raw_id"])


def staging_ready(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """scrape_run_id, job_posting_raw_id of the ids sent; none for no ids."""
    return postings.join(ids.select("job_posting_raw_id").distinct(), "job_posting_raw_id", "left_semi").select("scrape_run_id", "job_posting_raw_id").distinct()


LEDGER, LEDGER_LAYER = "normalization_process_runs", "bronze"
LEDGER_SCHEMA = "normalization_process_run_id long, scrape_run_ids array<long>, status string, stage string, error string, started_at timestamp, finished_at timestamp"


def _ledger(tx: Transaction) -> DataFrame:
    return tx.read(LEDGER, LEDGER_LAYER) if tx.exists(LEDGER, LEDGER_LAYER) else tx.store.spark.createDataFrame([], LEDGER_SCHEMA)


def claimable(runs: DataFrame, postings: DataFrame, ledger: DataFrame) -> DataFrame:
    """scrape_run_id of runs to process that no running entry holds."""
    held = ledger.where("status = 'running'").select(F.explode("scrape_run_ids").alias("scrape_run_id"))
    return runs_to_process(runs, postings, ledger).distinct().join(held, "scrape_run_id", "left_anti")


def claim_runs(store: Store, runs: DataFrame, postings: DataFrame, at: Column, size: int = 3) -> tuple[int, list[int]] | None:
    """The id of a new running entry and the runs it holds: the first ``size`` that no successful entry
    covers and no running one holds; None if there are none. Of several processes that claim at once,
    each gets runs and an id of its own, as the ledger's change is committed against what it was."""

    def change(tx: Transaction) -> tuple[int, list[int]] | None:
        ledger = _ledger(tx)
        mine = [r[0] for r in claimable(runs, postings, ledger).orderBy("scrape_run_id").limit(size).collect()]  # ``size`` rows
        if not mine:
            return None
        grown = append_run(ledger, F.array(*[F.lit(i).cast("long") for i in mine]), at)
        tx.write(grown, LEDGER, LEDGER_LAYER)
        return tx.read(LEDGER, LEDGER_LAYER).agg(F.max("normalization_process_run_id")).first()[0], mine

    return store.update(change)


def commit_run(store: Store, run_id: int, at: Column, status: str | None = None, stage: str | None = None, error: str | None = None) -> None:
    """One entry's new status or stage, whatever others write to the ledger meanwhile."""
    store.update(lambda tx: tx.write(update_run(_ledger(tx), run_id, at, status, stage, error), LEDGER, LEDGER_LAYER))
