"""Answers of a resolver that may fail, each wave of batches stored before the next is asked.

Tasks never fail for a bad answer: every key gets a row that tells its value or its error. A wave's
rows, and what follows from them, are one commit. So what was answered stays answered when a later
batch fails or the job dies, and a rerun asks only keys that have no value yet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vocatio.functions.text import clean_key, clean_seniority
from vocatio.operators.snapshots import batches
from vocatio.plans.silver import dim_skills, skill_bridge
from vocatio.sources.store import Store, Transaction

#: What resolvers can be asked for; an input more in every question, whose answer is dropped, so that a
#: question of one key has two answers to count.
DOMAINS, SENTINEL = ("title", "location", "seniority"), "unknown"

OUTCOMES = "resolver_outcomes"
OUTCOME = "domain string, use_title_key boolean, key string, value string, error string, attempts int"

#: Answers that a task hands over at once.
ROWS_OUT = 10_000

#: answer(domain, inputs, the answers before, if there were too many or too few) -> answers
Answer = Callable[[str, list[str], list[str] | None], list[str]]


def asked(domain: str, keys: list[str], answer: Answer, retries: int = 1) -> tuple[list[str | None], str | None, int]:
    """Values of the keys, or none and why, and how often the resolver was asked.

    Every question holds the keys and SENTINEL. If answers aren't as many as inputs, the next question
    is a corrective one: it gets these answers too. Answers come back trimmed, in lower case. A
    resolver that raises an error isn't asked again. A domain that isn't one of DOMAINS isn't asked for.
    """
    if domain not in DOMAINS:
        return [None] * len(keys), f"unsupported domain: {domain}", 0
    inputs, before = [*keys, SENTINEL], None
    for attempt in range(1, retries + 2):
        try:
            found = answer(domain, inputs, before)
        except Exception as e:  # the resolver's own errors are outcomes, whatever they are
            return [None] * len(keys), str(e) or type(e).__name__, attempt
        if len(found) == len(inputs):
            return [a.strip().lower() for a in found[:-1]], None, attempt
        before = found
    return [None] * len(keys), f"{len(before)} answers for {len(inputs)} inputs", retries + 1


def in_groups(rows: DataFrame, group: list[str], order: str, run: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """What ``run`` makes of each group's rows, in ascending order (nulls last). Groups are dealt to as many
    tasks as the cluster runs at once, however few bytes they have, and follow one on the other in a task: a group of a few rows
    costs no table of its own."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def all_groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, own in groupby((r for b in it for r in b.to_pylist()), key=lambda r: [r[c] for c in group]):
            out += run(list(own))
            if len(out) >= ROWS_OUT:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(tasks, *group).sortWithinPartitions(*group, F.asc_nulls_last(order)).mapInArrow(all_groups, schema)


def outcome_rows(keys: DataFrame, answer: Answer, retries: int = 1) -> DataFrame:
    """OUTCOME for each row of (domain, use_title_key, key, batch_no); a batch is asked at once, in one
    task. Seniorities outside their closed list become unknown."""

    def run(group: list[dict]) -> list[dict]:
        domain, by_title = group[0]["domain"], group[0]["use_title_key"]
        values, error, n = asked(domain, [r["key"] for r in group], answer, retries)
        return [{"domain": domain, "use_title_key": by_title, "key": r["key"], "value": v, "error": error, "attempts": n} for r, v in zip(group, values, strict=True)]

    rows = in_groups(keys.select("batch_no", "domain", "use_title_key", "key"), ["batch_no", "domain", "use_title_key"], "key", run, OUTCOME)
    return rows.withColumn("value", F.when((F.col("domain") == "seniority") & F.col("value").isNotNull(), clean_seniority(F.col("value"))).otherwise(F.col("value")))


def to_ask(keys: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """Keys (domain, use_title_key, key) without a value, once each."""
    keys = keys.select("domain", "use_title_key", "key").distinct()
    if outcomes is None:
        return keys
    done = outcomes.where("value is not null").select(F.col("domain").alias("d"), F.col("use_title_key").alias("u"), F.col("key").alias("k")).distinct()
    return keys.join(done, (F.col("domain") == F.col("d")) & F.col("use_title_key").eqNullSafe(F.col("u")) & (F.col("key") == F.col("k")), "left_anti")


def _waves(store: Store, work: DataFrame, order: list[str], batch: int, parallel: int, name: str) -> Iterator[DataFrame]:
    """The work in waves of ``parallel`` batches. Batches are numbered once, in a table beside the
    store's own ones that is deleted at the end, so several processes may ask at the same time."""
    tx = store.begin()
    try:
        # a wave's rows lie in a folder of their own: no wave reads another one's
        numbered = batches(work, order, batch).withColumn("wave", F.expr(f"batch_no div {parallel}").cast("int"))
        numbered = tx.append(numbered.repartition("wave"), name, "bronze", ("wave",))
        last = numbered.agg(F.max("wave")).first()[0]
        for wave in range(0 if last is None else last + 1):
            yield numbered.where(F.col("wave") == wave).drop("wave")
    finally:
        tx.discard()


def ask_in_waves(store: Store, keys: DataFrame, answer: Answer, batch: int = 3, parallel: int = 1, retries: int = 1, maps: Mapping[str, tuple[str, str]] | None = None) -> str | None:
    """Asks for all keys without a value, in ascending order, batch by batch; returns the first error.

    Each wave is asked in tasks, as many batches as ``parallel`` at once, and committed: its outcomes,
    and the new rows of ``maps`` (domain: table and layer, of key and value). After a wave with an error
    no further one is asked. A killed job loses the wave that was being asked, none before.
    """
    there = store.read(OUTCOMES, "bronze") if store.exists(OUTCOMES, "bronze") else None
    for wave in _waves(store, to_ask(keys, there), ["domain", "use_title_key", "key"], batch, parallel, f"{OUTCOMES}_work"):
        tx = store.begin()
        try:
            rows = tx.append(outcome_rows(wave, answer, retries), OUTCOMES, "bronze")  # asked here, once
            for domain, (name, layer) in (maps or {}).items():
                found = rows.where((F.col("domain") == domain) & F.col("value").isNotNull())
                extra = ["use_title_key", F.col("key").alias("source_key")] if domain == "seniority" else [F.col("key").alias("key_normalized")]
                tx.append(found.select(*extra, F.col("value").alias("value_normalized"), F.lit("llm").alias("method")), name, layer)
            tx.commit()
        except BaseException:
            tx.discard()
            raise
        bad = rows.where("error is not null").agg(F.min(F.struct("domain", "key", "error"))).first()[0]
        if bad:
            return bad.error
    return None


SKILL_OUTCOMES, SKILLS, BRIDGE = "skill_outcomes", "dim_skills", "job_posting_skills"


def extract_in_waves(store: Store, descriptions: DataFrame, extract: Callable[[str], list[str]], batch: int = 3, parallel: int = 1) -> str | None:
    """Skills of (job_posting_raw_id, description), batch by batch; returns the first error.

    Each wave commits together what was extracted, new skills, and postings' links to skills; postings
    with an outcome aren't asked for again, those that failed are. A batch ends at its first failure:
    the rest of it isn't asked for. Names are compared as keys; blank ones don't count.
    """

    def run(group: list[dict]) -> list[dict]:
        out = []
        for r in group:
            found, error = None, None
            try:
                found = list(extract(r["description"]))
            except Exception as e:
                error = str(e) or type(e).__name__
            out.append({"job_posting_raw_id": r["job_posting_raw_id"], "skills": found, "error": error})
            if error is not None:
                break
        return out

    work = descriptions.select("job_posting_raw_id", "description").dropDuplicates(["job_posting_raw_id"])
    if store.exists(SKILL_OUTCOMES):
        work = work.join(store.read(SKILL_OUTCOMES).where("error is null").select("job_posting_raw_id"), "job_posting_raw_id", "left_anti")
    for wave in _waves(store, work, ["job_posting_raw_id"], batch, parallel, f"{SKILL_OUTCOMES}_work"):
        ordered = in_groups(wave, ["batch_no"], "job_posting_raw_id", run, "job_posting_raw_id long, skills array<string>, error string")
        asked_once = store.begin()
        rows = asked_once.append(ordered, f"{SKILL_OUTCOMES}_wave")  # asked here, once, whatever the commit below meets

        def change(tx: Transaction, rows: DataFrame = rows) -> None:
            found = rows.where("error is null").select("job_posting_raw_id", F.explode("skills").alias("skill_name")).where(clean_key(F.col("skill_name")) != "")
            tx.append(rows, SKILL_OUTCOMES)
            tx.write(dim_skills(found, tx.read(SKILLS) if tx.exists(SKILLS) else None), SKILLS)
            tx.write(skill_bridge(found, tx.read(SKILLS), tx.read(BRIDGE) if tx.exists(BRIDGE) else None), BRIDGE)

        store.update(change)
        bad = rows.where("error is not null").agg(F.min(F.struct("job_posting_raw_id", "error"))).first()[0]
        asked_once.discard()
        if bad:
            return f"skill extraction failed for job_posting_raw_id={bad.job_posting_raw_id}: {bad.error}"
    return None
