import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vocatio.operators import cascade, fuzzy, resolvers
from vocatio.plans import catalogue
from vocatio.settings import DEFAULT

POSTINGS = [
    (1, 1, "Dev", "Here", "Senior"), (1, 2, " dev ", "HERE", "Not Applicable"), (1, 3, None, "Here", "Senior"), (1, 4, "Dev", " ", "Senior"), (2, 5, "Cook", "There", "Junior"),
    (2, 6, "Dev", "Here", "Lead"), (2, 7, "\tDev", "Here", "Senior"),
]


@pytest.fixture(scope="module")
def mart(spark):
    p = spark.createDataFrame(POSTINGS, "scrape_run_id long, job_posting_raw_id long, title_raw string, location_raw string, seniority_level_raw string")
    t = spark.createDataFrame([("dev", "Developers", "llm")], "key_normalized string, value_normalized string, method string")
    loc = spark.createDataFrame([("here", "Here, ST", "llm")], "key_normalized string, value_normalized string, method string")
    s = spark.createDataFrame([(False, "senior", "senior", "llm"), (True, "dev", "mid", "llm")], "use_title_key boolean, source_key string, value_normalized string, method string")
    return p, t, loc, s


def ids(df):
    return sorted(r.job_posting_raw_id for r in df.collect())


def test_rows_without_a_key_are_dropped(mart):
    assert ids(cascade.posting_keys(mart[0])) == [1, 2, 5, 6, 7]


def test_readiness_and_the_stuck_posting(mart):
    p, t, loc, s = mart
    assert ids(cascade.readiness(p, t, loc, s)) == [1, 2, 7]
    keys = cascade.posting_keys(p)
    found = {(r.domain, r.use_title_key, r.key) for r in cascade.unresolved(keys, t, loc, s).collect()}
    # "lead" counts as resolved by the title's row, although posting 6 is not ready
    assert found == {("title", None, "cook"), ("location", None, "there"), ("seniority", False, "junior")}
    strict = {(r.domain, r.use_title_key, r.key) for r in cascade.unresolved(keys, t, loc, s, strict=True).collect()}
    assert strict == found | {("seniority", False, "lead")}


def test_distinct_keys_give_the_same_unresolved_keys(mart):
    p, t, loc, s = mart
    once = cascade.distinct_keys(p)
    assert sorted(once.collect()) == sorted(cascade.posting_keys(p).select(*once.columns).distinct().collect())
    for strict in (False, True):
        assert set(cascade.unresolved(once, t, loc, s, strict).collect()) == set(cascade.unresolved(cascade.posting_keys(p), t, loc, s, strict).collect())


def test_resolved_by_method_keeps_no_postings(spark):
    m = catalogue.Mart(spark, "/root/testdata/sf0.001")
    try:
        m.unresolved.count()
        assert "postings" not in m._made and "kinds" in m._made
    finally:
        m.release()


def test_summary(mart):
    p, t, loc, s = mart
    keys = cascade.posting_keys(p)
    r = cascade.summary(keys, cascade.unresolved(keys, t, loc, s), cascade.readiness(p, t, loc, s)).first()
    assert (r.total, r.ready, r.unresolved_title, r.unresolved_location, r.unresolved_seniority) == (5, 3, 1, 1, 1)


def test_run_resolves_what_is_left(mart):
    p, t, loc, s = mart
    titles, locations, seniorities = cascade.run(p, t, loc, s, resolvers.by_rules)
    assert {(r.key_normalized, r.value_normalized, r.method) for r in titles.collect()} == {("dev", "Developers", "llm"), ("cook", "unknown", "llm")}
    assert ("junior", "junior") in {(r.source_key, r.value_normalized) for r in seniorities.collect()}
    assert locations.count() == 2


def test_resolved_by_method(spark):
    rows = spark.createDataFrame([("title", "llm"), ("title", "llm"), ("seniority", "fuzzy")], "domain string, method string")
    assert {(r.domain, r.method): r.n for r in cascade.resolved_by_method(rows).collect()} == {("title", "llm"): 2, ("seniority", "fuzzy"): 1}


def test_resolved_by_method_counts_what_the_maps_resolve(spark, mart):
    """The map is the first method: keys that it has count as its own, "lead" by its title's row."""
    p, t, loc, s = mart
    keys = cascade.posting_keys(p)
    missing = cascade.unresolved(keys, t, loc, s)
    rows = resolvers.by_rules(missing).select("domain", F.lit("llm").alias("method"))
    got = {(r.domain, r.method): r.n for r in cascade.resolved_by_method(rows, keys, missing).collect()}
    assert got == {("title", "map"): 1, ("location", "map"): 1, ("seniority", "map"): 3, ("title", "llm"): 1, ("location", "llm"): 1, ("seniority", "llm"): 1}


def test_resolved_by_method_over_tables_accounts_for_every_key(spark):
    m = catalogue.Mart(spark, "/root/testdata/sf0.001")
    try:
        got = {(r.domain, r.method): r.n for r in catalogue._resolved(m).collect()}
        total = {r.domain: r["count"] for r in cascade.all_keys(m.kinds).groupBy("domain").count().collect()}
        assert {d for d, method in got if method == "map"} == {"title", "location", "seniority"}
        assert {d: sum(n for (x, _), n in got.items() if x == d) for d in total} == total
    finally:
        m.release()


def test_sleep_grows_with_retries():
    assert DEFAULT.next_sleep(0, 0.5) == 210 and DEFAULT.next_sleep(1, 0.0) == 420


def test_candidates(spark, mart):
    runs = spark.createDataFrame([(1,)], "scrape_run_id long")
    staged = spark.createDataFrame([(1, 2)], "scrape_run_id long, job_posting_raw_id long")
    assert ids(cascade.candidates(mart[0], runs, staged)) == [1, 3, 4]
    assert ids(cascade.candidates(mart[0], runs, None)) == [1, 2, 3, 4]


def test_batches_need_as_many_answers_as_keys(spark):
    keys = spark.createDataFrame([("title", None, f"k{i}") for i in range(7)], "domain string, use_title_key boolean, key string")
    got = resolvers.in_batches(keys, lambda domain, ks: [k.upper() for k in ks]).collect()
    assert {(r.key, r.value) for r in got} == {(f"k{i}", f"k{i}") for i in range(7)}
    with pytest.raises(Exception, match="answers for"):
        resolvers.in_batches(keys, lambda domain, ks: ks[:1]).collect()


def test_fuzzy_equals_brute_force(spark):
    rnd = random.Random(4)
    words = ["data", "engineer", "senior", "analyst", "sr", "dev", "developer", "ops", "of", "cloud"]
    make = lambda: " ".join(rnd.choice(words)[: rnd.randint(2, 9)] for _ in range(rnd.randint(1, 4)))
    keys, cands = sorted({make() for _ in range(60)}), sorted({make() for _ in range(80)})
    ts = lambda x: " ".join(sorted(x.split()))
    for t in (0.9, 0.94, 0.6):
        want = {}
        for k in keys:
            scored = [(-SequenceMatcher(None, ts(k), ts(c)).ratio(), c) for c in cands]
            best = min(scored)
            if -best[0] >= t:
                want[k] = best[1]
        got = fuzzy.best_match(spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(c,) for c in cands], "candidate string"), t)
        assert {r.key: r.candidate for r in got.collect()} == want


def test_pairs_are_those_that_letters_allow_once_each(spark):
    rnd = random.Random(5)
    names = sorted({"".join(rnd.choice("aabcde éßx") for _ in range(rnd.randint(0, 14))).strip() for _ in range(120)})
    ts = lambda x: " ".join(sorted(x.split()))
    for t in (0.9, 0.6):
        want = sorted((a, b) for a in names for b in names if SequenceMatcher(None, ts(a), ts(b)).quick_ratio() >= t)
        pairs = fuzzy.possible_pairs(spark.createDataFrame([(k,) for k in [*names, None]], "key string"), spark.createDataFrame([(c,) for c in names], "candidate string"), t)
        assert sorted((r.key, r.candidate) for r in pairs.collect()) == want


def test_resolve_prefers_values_then_keys(spark):
    m = spark.createDataFrame([("data engineers of clouds", "Cloud people"), ("cooks", "Cooking staff")], "key_normalized string, value_normalized string")
    keys = spark.createDataFrame([("cooking stafff",), ("data engineers of cloud",), ("zzz",)], "key string")
    got = {r.key: (r.value, r.ref_key) for r in fuzzy.resolve(keys, m.withColumn("value_normalized", F.lower("value_normalized"))).collect()}
    assert got == {"cooking stafff": ("cooking staff", None), "data engineers of cloud": ("cloud people", "data engineers of clouds")}


def test_extract_skills(spark):
    df = spark.createDataFrame([("SQL, python and C++; python",), ("  ",), (None,)], "t string")
    assert [r[0] for r in df.select(resolvers.extract_skills(F.col("t"), ["python", "sql", "c++"])).collect()] == [["sql", "python", "c++"], [], []]


def test_extract_phrases(spark):
    df = spark.createDataFrame([("Machine-learning, deep learning; learning C++",), ("machine",), (None,)], "t string")
    found = resolvers.extract_skills(F.col("t"), ["machine learning", "learning", "c++", "learning c++ today"])
    assert [r[0] for r in df.select(found).collect()] == [["machine learning", "learning", "c++"], [], []]
