"""Commits of several tables, and what is built on them: ingest, claims, published tables, waves of answers."""

import threading

import pytest
from pyspark.sql import functions as F

from test_sources import POST, SEARCH
from vocatio.operators import ledger, outcomes
from vocatio.sources.store import QUARANTINE, Conflict, Rejected, Store, Transaction
from vocatio.streaming import ingest



def now():
    return F.lit("2024-01-01").cast("timestamp")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def rows(store, name, layer=None):
    return sorted(map(tuple, store.read(name, layer).collect()), key=str) if store.exists(name, layer) else []


def together(*jobs):
    errors = []

    def run(job):
        try:
            job()
        except BaseException as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(j,)) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join(180)
    return errors


# --- the store ---


def test_no_update_of_two_writers_is_lost(spark, store):
    store.write(spark.createDataFrame([(0,)], "n long"), "counter")

    def add():
        for _ in range(3):
            store.update(lambda tx: tx.write(tx.read("counter").select((F.col("n") + 1).alias("n")), "counter"), attempts=50)

    assert together(add, add) == []
    assert rows(store, "counter") == [(6,)] and store.version().number == 7


def test_what_was_read_or_replaced_must_be_as_it_was(spark, store):
    store.write(spark.range(2), "a")
    reader, appender, other = store.begin(), store.begin(), store.begin()
    reader.write(reader.read("a").where("id = 0"), "b")
    appender.append(spark.range(7, 8), "a")
    other.write(spark.range(5), "c")
    store.update(lambda tx: tx.append(spark.range(9, 10), "a"))
    with pytest.raises(Conflict):
        reader.commit()
    reader.discard()
    appender.commit()
    other.commit()
    assert rows(store, "a") == [(0,), (1,), (7,), (9,)] and len(rows(store, "c")) == 5 and not store.exists("b")
    with pytest.raises(Conflict):
        store.update(lambda tx: (tx.read("a"), store.update(lambda t: t.append(spark.range(1), "a"))), attempts=2)


def test_a_batch_of_a_stream_is_committed_once(spark, store):
    for number in (0, 0, 1, 0):
        store.update(lambda tx: tx.append(spark.range(1), "t"), batch=("s", number))
    store.update(lambda tx: tx.append(spark.range(1), "t"), batch=("other", 0))
    assert len(rows(store, "t")) == 3
    late = store.begin()
    late.append(spark.range(1), "t")
    store.update(lambda tx: tx.append(spark.range(1), "t"), batch=("s", 2))
    assert late.commit(("s", 2)) is False and len(rows(store, "t")) == 4


def test_a_version_is_created_once_in_other_file_systems_too(spark, tmp_path):
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.elsewhere.link./in", f"file://{tmp_path}")
    there = Store(spark, "viewfs://elsewhere/in/store")
    assert there._create(1, "{}") and not there._create(1, '{"x": 1}')
    there = Store(spark, "viewfs://elsewhere/in/other")
    there.write(spark.range(3), "t")
    there.update(lambda tx: tx.append(spark.range(1), "t"))
    assert len(rows(there, "t")) == 4


def test_published_only_if_checks_find_nothing(spark, store):
    checks = {"negative": lambda tx: tx.read("t").where("n < 0"), "odd": lambda tx: tx.read("t").where("n % 2 <> 0")}
    make = lambda *n: spark.createDataFrame([(x,) for x in n], "n long")
    store.publish(make(2, 4), "t", None, checks)
    with pytest.raises(Rejected) as e:
        store.publish(make(2, -2, -4, 3), "t", None, checks)
    assert e.value.found == {"negative": 2, "odd": 1} and rows(store, "t") == [(2,), (4,)]
    assert [r[:1] + r[2:] for r in rows(store, *QUARANTINE)] == [("negative", '{"n":-2}'), ("negative", '{"n":-4}'), ("odd", '{"n":3}')]
    store.publish(make(), "t", None, checks)
    store.publish(make(1), "t", None, {})
    assert rows(store, "t") == [(1,)]


# --- claims ---


def test_processes_that_claim_at_once_get_runs_and_ids_of_their_own(spark, store):
    runs = spark.createDataFrame([(i, "successful" if i != 4 else "failed") for i in range(8)], "scrape_run_id long, status string")
    postings, got = runs.select("scrape_run_id").where("scrape_run_id <> 6"), []
    claim = lambda: got.append(ledger.claim_runs(store, runs, postings, now()))
    assert together(claim, claim, claim) == []
    assert sorted(c[0] for c in got if c) == [1, 2] and sorted(i for c in got if c for i in c[1]) == [0, 1, 2, 3, 5, 7]
    assert ledger.claim_runs(store, runs, postings, now()) is None
    ledger.commit_run(store, 2, now(), status="successful", stage="skill_extraction")
    ledger.commit_run(store, 1, now(), status="failed", error="x")
    assert ledger.claim_runs(store, runs, postings, now()) == (3, next(c[1] for c in got if c and c[0] == 1))
    entries = {r.normalization_process_run_id: r for r in store.read(ledger.LEDGER, ledger.LEDGER_LAYER).collect()}
    assert entries[2].finished_at and entries[1].error == "x" and entries[3].status == "running" and entries[3].finished_at is None


# --- ingest ---


def response(at, run, job=None, status=200, html=None):
    return (at, run, job, status, html or (POST if job else SEARCH))


def batch_of(spark, *responses):
    return spark.createDataFrame(responses, ingest.RESPONSE)


def test_cards_postings_and_runs_of_a_batch(spark, store):
    ingest.add_batch(store, batch_of(spark, response(0, 1), response(1, 2, status=404), response(2, 3, html="<p>"), response(3, 1, 91), response(4, 1, 92, 404)), "s", 0)
    assert rows(store, ingest.RUNS, "bronze") == [(1, "successful", 2, 1, None), (2, "failed", 0, 0, "search failed"), (3, "successful", 0, 0, None)]
    assert [(r.scrape_run_id, r.job_id, r.industry_raw) for r in store.read(ingest.POSTINGS, "bronze").collect()] == [(1, 91, "IT")]
    # the job that is stored isn't stored again; the other one is found by two runs
    ingest.add_batch(store, batch_of(spark, response(0, 4), response(1, 5), response(2, 4, 91), response(3, 4, 92), response(4, 5, 92), response(5, 5, 92)), "s", 1)
    assert sorted((r.scrape_run_id, r.job_id) for r in store.read(ingest.POSTINGS, "bronze").collect()) == [(1, 91), (4, 92), (5, 92)]
    assert len(rows(store, ingest.CARDS, "bronze")) == 6
    ingest.add_batch(store, batch_of(spark), "s", 2)
    assert len(rows(store, ingest.RUNS, "bronze")) == 5


def test_a_refused_response_ends_the_collecting(spark, store):
    stored = spark.createDataFrame([], "job_id long")
    of = lambda *r: [sorted(map(tuple, x.collect()), key=str) for x in ingest.ingested(batch_of(spark, *r), stored)]
    # a search: runs before it fail as well, what lies behind it isn't there
    cards, postings, runs = of(response(0, 1), response(1, 2, status=429), response(2, 3), response(3, 1, 91))
    assert len(cards) == 2 and postings == []
    assert runs == [(1, "failed", 2, 0, "blocked: 429"), (2, "failed", 0, 0, "blocked: 429")]
    # a job's page: runs that had ended stay, postings read before it stay
    cards, postings, runs = of(response(0, 1), response(1, 2), response(2, 3, status=None), response(3, 4), response(10, 1, 91), response(11, 2, 91), response(12, 2, 92, 503), response(13, 4, 91))
    assert [p[:2] for p in postings] == [(1, 91), (2, 91)]
    assert runs == [(1, "successful", 2, 1, None), (2, "failed", 2, 1, "blocked: 503"), (3, "failed", 0, 0, "search failed"), (4, "failed", 2, 0, "blocked: 503")]


@pytest.mark.parametrize("at", [0, 1, 2, "commit", "after"])
def test_a_batch_killed_anywhere_and_run_again_adds_nothing_twice(spark, store, tmp_path, monkeypatch, at):
    """The first run of the stream's batch dies after so many tables, before the commit, or just after it."""
    pages = str(tmp_path / "pages")
    batch_of(spark, response(0, 1), response(1, 1, 91), response(2, 1, 92)).write.parquet(pages)
    start = lambda: ingest.ingest_pages(spark, pages, store, str(tmp_path / "cp"))
    calls, append, commit = [], Transaction.append, Transaction.commit

    def dying_append(tx, *a):
        calls.append(a[1])
        if len(calls) - 1 == at:
            raise RuntimeError("killed")
        return append(tx, *a)

    def dying_commit(tx, *a):
        if at == "after":
            commit(tx, *a)
        if at in ("commit", "after"):
            raise RuntimeError("killed")
        return commit(tx, *a)

    with monkeypatch.context() as m:
        m.setattr(Transaction, "append", dying_append)
        m.setattr(Transaction, "commit", dying_commit)
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination(120)
    assert store.version().number == (1 if at == "after" else 0)
    start().awaitTermination(120)
    assert rows(store, ingest.RUNS, "bronze") == [(1, "successful", 2, 2, None)]
    assert len(rows(store, ingest.CARDS, "bronze")) == 2 and len(rows(store, ingest.POSTINGS, "bronze")) == 2
    batch_of(spark, response(5, 2), response(6, 2, 91)).write.mode("append").parquet(pages)
    start().awaitTermination(120)
    assert len(rows(store, ingest.RUNS, "bronze")) == 2 and len(rows(store, ingest.POSTINGS, "bronze")) == 2


# --- answers in waves ---


def resolvers():
    """Made here, so that tasks needn't import this module."""

    def shout(domain, inputs, before):
        if any("bad" in x for x in inputs):
            raise ConnectionError("unavailable")
        if any("short" in x for x in inputs) and before is None:
            return ["x"]
        if any("never" in x for x in inputs):
            return ["x"] * 9
        assert inputs[-1] == "unknown"
        return [f" {x.upper()}! " for x in inputs]

    def quiet(domain, inputs, before):
        return [x if x != "k09 bad" else "Mid Level" for x in inputs]

    return shout, quiet


def test_batches_before_a_failed_one_are_stored_and_not_asked_again(spark, store):
    shout, quiet = resolvers()
    keys = spark.createDataFrame([("title", None, f"k{i:02d}" + {4: " short", 7: " bad"}.get(i, "")) for i in range(10)] + [("title", None, "k00")], "domain string, use_title_key boolean, key string")
    maps = {"title": ("title_map", "bronze")}
    assert outcomes.ask_in_waves(store, keys, shout, maps=maps) == "unavailable"
    got = {r.key: (r.value, r.error, r.attempts) for r in store.read(outcomes.OUTCOMES, "bronze").collect()}
    assert got["k00"] == ("k00!", None, 1) and got["k03"] == ("k03!", None, 2) and got["k04 short"] == ("k04 short!", None, 2)
    assert {k: v for k, v in got.items() if v[0] is None} == {k: (None, "unavailable", 1) for k in ("k06", "k07 bad", "k08")} and "k09" not in got
    assert len(rows(store, "title_map", "bronze")) == 6
    assert sorted(r.key for r in outcomes.to_ask(keys, store.read(outcomes.OUTCOMES, "bronze")).collect()) == ["k06", "k07 bad", "k08", "k09"]
    assert outcomes.ask_in_waves(store, keys, quiet, maps=maps) is None
    assert len(rows(store, "title_map", "bronze")) == 10
    before = store.version().number
    assert outcomes.ask_in_waves(store, keys, shout, maps=maps) is None and store.version().number == before


def test_answers_of_domains_and_of_wrong_number(spark, store):
    shout, quiet = resolvers()
    keys = spark.createDataFrame([("seniority", True, "a"), ("seniority", False, "k09 bad"), ("location", None, "never"), ("colour", None, "red")], "domain string, use_title_key boolean, key string")
    first = outcomes.ask_in_waves(store, keys.where("key <> 'k09 bad'"), shout, batch=1, parallel=9)
    got = {r.key: (r.value, r.error, r.attempts) for r in store.read(outcomes.OUTCOMES, "bronze").collect()}
    assert got == {"a": ("unknown", None, 1), "never": (None, "9 answers for 2 inputs", 2), "red": (None, "unsupported domain: colour", 0)}
    assert first == "unsupported domain: colour"
    assert outcomes.ask_in_waves(store, keys.where("key = 'k09 bad'"), quiet, maps={"seniority": ("seniority_map", "bronze")}) is None
    assert rows(store, "seniority_map", "bronze") == [(False, "k09 bad", "unknown", "llm")]
    assert outcomes.ask_in_waves(store, keys.limit(0), shout) is None


def extractors():
    def listed(text):
        if text == "broken":
            raise ValueError("no answer")
        return text.split(";")

    return listed, lambda text: ["Rust"] if text == "broken" else listed(text)


def test_skills_of_batches_before_a_failure_stay(spark, store):
    listed, whole = extractors()
    texts = ["SQL;Python", "sql; ", "Go", "Spark;SQL", "broken", "Java", "Python"]
    work = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "job_posting_raw_id long, description string")
    assert outcomes.extract_in_waves(store, work, listed) == "skill extraction failed for job_posting_raw_id=4: no answer"
    links = lambda: sorted((r.job_posting_raw_id, r.skill_name) for r in store.read(outcomes.BRIDGE).join(store.read(outcomes.SKILLS), "skill_id").collect())
    assert links() == [(0, "python"), (0, "sql"), (1, "sql"), (2, "go"), (3, "spark"), (3, "sql")]
    ids = dict(store.read(outcomes.SKILLS).select("skill_name", "skill_id").collect())
    assert outcomes.extract_in_waves(store, work, whole, parallel=2) is None
    assert links()[6:] == [(4, "rust"), (5, "java"), (6, "python")]
    after = dict(store.read(outcomes.SKILLS).select("skill_name", "skill_id").collect())
    assert {k: after[k] for k in ids} == ids and sorted(after.values()) == list(range(1, 7))
    assert outcomes.extract_in_waves(store, work, listed) is None


def test_a_wave_of_few_bytes_is_asked_by_all_tasks_and_reads_no_other(spark, store):
    work = spark.range(300).selectExpr("'title' AS domain", "cast(null AS boolean) AS use_title_key", "concat('k', id) AS key", "cast(id div 3 AS int) AS batch_no")
    asked = outcomes.outcome_rows(work, lambda domain, inputs, before: inputs)
    assert asked.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
    for i, wave in enumerate(outcomes._waves(store, work.drop("batch_no"), ["key"], 3, 40, "work")):
        assert all(f"wave={i}/" in f for f in {r[0] for r in wave.select(F.input_file_name()).distinct().collect()})
        assert wave.count() == (120, 120, 60)[i]


def test_a_version_known_is_not_read_again(spark, store):
    other = Store(spark, store.root)
    for n in range(12):
        (store if n % 2 else other).write(spark.range(1), f"t{n}")
        assert other.version().number == store.version().number == n + 1 and other.exists(f"t{n}")
    assert store.version() is store.version()
