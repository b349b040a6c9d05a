import datetime as dt

import pytest
from pyspark.sql import functions as F

from vocatio.operators import backfill, cascade, checks, ledger
from vocatio.operators.snapshots import batches, dimension, insert_new, numbered, upsert, with_ids
from vocatio.plans import gold, silver

AT = dt.datetime(2024, 1, 1)
RAW = "scrape_run_id long, job_posting_raw_id long, job_id long, title_raw string, company_raw string, location_raw string, source_url string, scraped_at timestamp, seniority_level_raw string, employment_type_raw string, job_function_raw string, industry_raw string, description_raw string"


def posting(run, i, title="Dev", company="Acme", location="Here", level="Senior", industry="IT", job=None, text="x"):
    return (run, i, job or i, title, company, location, f"u{i}", AT + dt.timedelta(days=i), level, "Full-time", None, industry, text)


@pytest.fixture(scope="module")
def world(spark):
    rows = [posting(1, 1), posting(1, 2, company="Acme "), posting(1, 3, company="  "), posting(1, 4, title="Odd"), posting(1, 5, industry=" "), posting(2, 6, job=1), posting(2, 7, level="Not Applicable", industry=None)]
    p = spark.createDataFrame(rows, RAW)
    ready = p.select("scrape_run_id", "job_posting_raw_id")
    t = spark.createDataFrame([("dev", "Developers"), ("odd", "unknown")], "key_normalized string, value_normalized string")
    loc = spark.createDataFrame([("here", "Here, ST")], "key_normalized string, value_normalized string")
    s = spark.createDataFrame([(False, "senior", "senior"), (True, "dev", "mid"), (True, "senior", "x")], "use_title_key boolean, source_key string, value_normalized string")
    stg = silver.stg_job_postings(p, ready, t, loc, s)
    return p, ready, t, loc, s, stg


def facts_of(stg, existing=None):
    return silver.fact_job_postings(stg, silver.dim_titles(stg), silver.dim_companies(stg), silver.dim_locations(stg), existing)


def test_stg_and_facts(world):
    stg = world[-1]
    by = {r.job_posting_raw_id: r for r in stg.collect()}
    assert by[1].seniority_normalized == "senior" and by[7].seniority_normalized == "mid" and len(by) == 7
    assert {r.company_name for r in silver.dim_companies(stg).collect()} == {"Acme", "Acme "}
    assert {r.job_posting_raw_id for r in facts_of(stg).collect()} == {1, 2, 5, 6, 7}


def test_facts_stay_but_stg_follows_the_maps(spark, world):
    p, ready, _, loc, s, stg = world
    first = facts_of(stg.where("scrape_run_id = 1"))
    changed = spark.createDataFrame([("dev", "Engineers"), ("odd", "unknown")], "key_normalized string, value_normalized string")
    again = silver.stg_job_postings(p, ready, changed, loc, s)
    rows = facts_of(again, first).collect()
    assert {(r.job_posting_raw_id, r.title_normalized) for r in rows} == {(1, "Developers"), (2, "Developers"), (5, "Developers"), (6, "Engineers"), (7, "Engineers")}
    assert {r.title_normalized for r in again.where("title_raw = 'Dev'").collect()} == {"Engineers"}
    assert facts_of(stg, facts_of(stg)).count() == facts_of(stg).count()


def test_stg_without_joining_postings_with_themselves(spark, world):
    p, _, t, loc, s, _ = world
    # a key of two ready rows, one of a ready row and one that isn't, and rows without keys
    p = p.union(spark.createDataFrame([posting(1, 1, title="dev "), posting(1, 4), posting(1, 4, title="New"), posting(3, 8, level=" "), posting(3, 9, location="Gone"), (None, *posting(3, 10)[1:])], RAW))
    ready = cascade.readiness(p, t, loc, s)
    once = silver.stg_of_ready(p, t, loc, s)
    assert sorted(once.collect(), key=str) == sorted(silver.stg_job_postings(p, ready, t, loc, s).collect(), key=str)
    assert sum(r.job_posting_raw_id == 1 for r in once.collect()) == 4
    # nothing but the maps is joined: postings are read once
    assert not any(k in once._jdf.queryExecution().optimizedPlan().toString() for k in ("LeftSemi", "Join Inner"))


def test_fact_rows_are_those_of_the_facts(spark, world):
    stg = world[-1]
    odd = stg.where("job_posting_raw_id < 4").withColumn("job_posting_raw_id", F.col("job_posting_raw_id") + 20)
    stg = stg.union(odd.withColumn("title_normalized", F.lit(" "))).union(odd.withColumn("location_normalized", F.lit("Unknown"))).union(odd.withColumn("seniority_normalized", F.lit("unknown")))
    assert sorted(r.job_posting_raw_id for r in silver.fact_rows(stg).collect()) == sorted(r.job_posting_raw_id for r in facts_of(stg).collect())


def test_dimensions_of_names_are_those_of_postings(world):
    stg = world[-1]
    for dim, name in ((silver.dim_titles, "title_normalized"), (silver.dim_companies, "company_raw"), (silver.dim_locations, "location_normalized")):
        for when in ("true", "scraped_at < timestamp'2024-01-03'"):
            assert sorted(dim(silver.names(stg, name).where(when)).collect()) == sorted(dim(stg.where(when)).collect())


def test_gold(spark, world):
    facts = facts_of(world[-1])
    skills = silver.dim_skills(spark.createDataFrame([("SQL",), (" sql",), ("Python",)], "skill_name string"))
    found = spark.createDataFrame([(1, "sql"), (1, "SQL "), (2, "python"), (5, "sql"), (7, "sql"), (99, "sql"), (1, "no such")], "job_posting_raw_id long, skill_name string")
    bridge = silver.skill_bridge(found, skills)
    assert bridge.count() == 5
    top = [(r.skill_name, r.job_posting_count, r.company_count) for r in gold.top_skills(facts, bridge, skills).collect()]
    assert top == [("sql", 3, 1), ("python", 1, 1)]
    by = [(r.industry, r.skill_rank, r.skill_name, r.job_posting_count) for r in gold.top_skills_by_industry(facts, bridge, skills).collect()]
    assert by == [("IT", 1, "python", 1), ("IT", 2, "sql", 1), ("Unknown", 1, "sql", 2)]
    assert [r.skill_name for r in gold.top_skills_by_industry(facts, bridge, skills, top=1).collect()] == ["python", "sql"]
    demand = gold.company_hiring_demand(facts).collect()
    assert (demand[0].company, demand[0].job_posting_count, demand[0].distinct_seniority_levels) == ("Acme", 4, 2)
    assert gold.location_demand(facts).first().job_posting_count == 5
    assert gold.job_market_summary(facts).where("industry is null").first().job_posting_count == 1
    assert gold.skills_by_role(facts, bridge, skills).count() == 3


def test_ids_are_dense_in_order_and_go_on(spark):
    names = [f"n{i:05d}" for i in range(5000)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rows = with_ids(df, "name", "id").orderBy("name").collect()
    assert [(r.id, r.name) for r in rows] == [(i + 1, n) for i, n in enumerate(names)]
    old = spark.createDataFrame([(7, "n00002"), (9, "zz")], "id long, name string")
    new = {r.name: r.id for r in dimension(df.where("name < 'n00004'"), "name", "id", old).collect()}
    assert new == {"n00002": 7, "zz": 9, "n00000": 10, "n00001": 11, "n00003": 12}
    assert dimension(df.limit(0), "name", "id").count() == 0


def test_upsert_and_insert_new(spark):
    a = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "k int, l string, v string")
    b = spark.createDataFrame([(1, None, "A"), (3, "y", "c")], "k int, l string, v string")
    assert sorted(r.v for r in upsert(a, b, ["k", "l"]).collect()) == ["A", "b", "c"]
    assert sorted(r.v for r in insert_new(a, b.union(b), ["k"]).collect()) == ["a", "b", "c"]


def test_ledger(spark):
    runs = spark.createDataFrame([(i, "failed" if i == 4 else "successful") for i in range(6)], "scrape_run_id long, status string")
    posts = spark.createDataFrame([(i, i, i) for i in range(5)], "scrape_run_id long, job_posting_raw_id long, job_id long")
    led = spark.createDataFrame([(1, [0, 1], "successful", "dbt", None, AT, AT), (2, [2], "failed", "dbt", "e", AT, AT)], "normalization_process_run_id long, scrape_run_ids array<long>, status string, stage string, error string, started_at timestamp, finished_at timestamp")
    todo = ledger.runs_to_process(runs, posts, led)
    assert sorted(r[0] for r in todo.collect()) == [2, 3]
    more = ledger.append_run(led, F.array(F.lit(2).cast("long"), F.lit(3).cast("long")), F.lit(AT))
    done = ledger.update_run(more, 3, F.lit(AT), status="successful", stage="skill_extraction")
    row = done.where("normalization_process_run_id = 3").first()
    assert (row.status, row.stage, row.finished_at) == ("successful", "skill_extraction", AT) and more.where("finished_at is null").count() == 1
    assert ledger.runs_to_process(runs, posts, done).count() == 0
    assert [r.batch_no for r in ledger.in_process_batches(spark.range(7).withColumnRenamed("id", "scrape_run_id")).orderBy("scrape_run_id").collect()] == [0, 0, 0, 1, 1, 1, 2]
    staged = ledger.staging_upsert(spark.createDataFrame([(1, 1, "old"), (1, 2, "old")], "scrape_run_id long, job_posting_raw_id long, ready_at string"), spark.createDataFrame([(1, 2), (1, 3)], "scrape_run_id long, job_posting_raw_id long"), F.lit("new"))
    assert {(r.job_posting_raw_id, r.ready_at) for r in staged.collect()} == {(1, "old"), (2, "new"), (3, "new")}
    bridge = spark.createDataFrame([(0, 1)], "job_posting_raw_id long, skill_id long")
    got = ledger.unextracted_ready(posts, posts.select("scrape_run_id", "job_posting_raw_id").where("job_posting_raw_id < 2"), bridge, runs)
    assert [r[0] for r in got.collect()] == [1]


def test_scrape_run_outcomes(spark):
    runs = spark.createDataFrame([(1, "running", None, None, None, None), (2, "running", None, None, None, None)], "scrape_run_id long, status string, jobs_seen_count int, jobs_inserted_count int, error_message string, finished_at timestamp")
    out = ledger.finish_scrape_runs(runs, spark.createDataFrame([(1, "successful", 9, 4, None)], "scrape_run_id long, status string, seen int, inserted int, error string"), F.lit(AT))
    rows = {r.scrape_run_id: r for r in ledger.fail_running(out, "blocked", F.lit(AT)).collect()}
    assert (rows[1].status, rows[1].jobs_seen_count, rows[2].status, rows[2].error_message) == ("successful", 9, "failed", "blocked")


def test_checks(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "z")], "k int, v string")
    assert [(r.k, r.n) for r in checks.duplicates(a, ["k"]).collect()] == [(1, 2)]
    assert [(r["column"], r.n) for r in checks.nulls(a, ["k", "v"]).collect()] == [("k", 1), ("v", 1)]
    assert [r.k for r in checks.orphans(a, spark.createDataFrame([(1,)], "k int"), ["k"]).collect()] == [2]
    assert sorted(r.value for r in checks.not_accepted(a, "v", ("x",)).collect()) == ["y", "z"]


def test_backfill(spark):
    legacy = spark.createDataFrame([(i, AT + dt.timedelta(hours=i) if i % 5 else None, f"t{i}") for i in range(1, 26)] + [(None, AT, "n")], "job_id long, created_at timestamp, title string")
    stored = spark.createDataFrame([(3,)], "job_id long")
    jobs = backfill.to_import(legacy, stored, F.lit(AT + dt.timedelta(days=99)))
    runs = backfill.import_runs(jobs)
    assert [(r.batch_no, r.jobs_seen_count) for r in runs.orderBy("batch_no").collect()] == [(0, 10), (1, 10), (2, 4)]
    posts = backfill.imported_postings(jobs, runs)
    # those without a time come last
    assert {r.job_id for r in posts.where("scrape_run_id = 3").collect()} == {10, 15, 20, 25} and "title_raw" in posts.columns


def test_batches(spark):
    assert sorted(r.batch_no for r in batches(spark.range(5), ["id"], 2).collect()) == [0, 0, 1, 1, 2]


def test_numbers_follow_the_order(spark):
    rows = [(i * 7919 % 3001 % 50 if i % 9 else None, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = [(r.a, r.b) for r in sorted(numbered(df, ["a", "b"], "n").collect(), key=lambda r: r.n)]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(r.n for r in numbered(df, ["a"], "n").collect()) == list(range(1, 3001))
    assert numbered(df.limit(0), ["a"], "n").count() == 0


def test_numbers_find_their_range_by_bisection(spark):
    names = spark.range(5000).selectExpr("if(id % 50 = 0, null, concat('n', id % 4000)) AS name")
    out = numbered(names, ["name"], "n")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and "filter(__bounds" not in plan  # not every bound for every row
    got = sorted((r.n, r.name is not None, r.name or "") for r in out.collect())
    assert [x[0] for x in got] == list(range(1, 5001)) and got == sorted(got, key=lambda x: (x[1:], x[0]))
