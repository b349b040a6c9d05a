import os
from pathlib import Path

import duckdb
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vocatio.plans import catalogue, oracle

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


def canon(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([canon(x) for x in v])
    if v is None or v != v:
        return "null"
    return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(catalogue.oracle_sql()[name]).df().astype(object)
    got = catalogue.queries()[name](spark, SMALL).toPandas().astype(object)
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = lambda d: sorted(tuple(canon(v) for v in r) for r in d[cols].where(d[cols].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


@needs_data
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "industry"


@needs_data
def test_overlap_has_every_candidate(spark):
    """The query searches for those whose id is divisible by 100; all of them, here."""
    con = duckdb.connect()
    for t in ("orders", "lineitem", "part", "customer", "supplier", "nation", "region", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = con.execute(oracle.sql("SELECT o.o_custkey AS candidate, b.job_posting_raw_id, count(*) AS matched FROM bridge b JOIN (SELECT DISTINCT o_custkey, skill_id FROM orders JOIN bridge ON job_posting_raw_id = o_orderkey) o USING (skill_id) GROUP BY 1, 2", "bridge")).fetchall()
    m = catalogue.mart(spark, SMALL)
    got = catalogue._overlap(m, 1).select("candidate", "job_posting_raw_id", "matched").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == set(want)
    found = catalogue.queries()["candidate_skill_overlap"](spark, SMALL).select("candidate", "job_posting_raw_id", "matched")
    got = found.collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == {r for r in want if r[0] % 100 == 0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("NestedLoop") < plan.index("Aggregate") if "NestedLoop" in plan else plan.index("CartesianProduct") < plan.index("Aggregate")  # no pair is shuffled


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_optional_parts():
    root = Path(__file__).resolve().parents[1] / "vocatio"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "vocatio.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p


@needs_data
def test_pages_of_a_small_file_are_parsed_by_all_tasks(spark):
    for name in ("parse_job_post", "parse_search_cards"):
        assert catalogue.queries()[name](spark, SMALL).select(F.spark_partition_id()).distinct().count() >= 4, name
