import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocatio.operators import pacing, places, rules, titles

CITIES = [
    ("New York", "city", "New York", "NY", "United States", 8.0),
    ("NYC", "city", "New York", "NY", "United States", 8.0),
    ("New York City", "city", "New York", "NY", "United States", 8.0),
    ("Manhattan", "city", "New York", "NY", "United States", 8.0),
    ("LA", "city", "Los Angeles", "CA", "United States", 4.0),
    ("London", "city", "London", None, "United Kingdom", 9.0),
    ("London", "city", "London", "KY", "United States", 0.1),
    ("Toronto", "city", "Toronto", None, "Canada", 3.0),
    ("Paris", "city", "Paris", None, "France", 9.0),
    ("Paris", "city", "Paris", "TX", "United States", None),
    ("Charleston", "city", "Charleston", "SC", "United States", 0.2),
    ("Charleston", "city", "Charleston", "WV", "United States", 0.1),
    ("Morgantown", "city", "Morgantown", "WV", "United States", 0.1),
    ("Buckhannon", "city", "Buckhannon", "WV", "United States", 0.1),
    ("UK", "country", "United Kingdom", None, "United Kingdom", 0.0),
    ("England", "country", "United Kingdom", None, "United Kingdom", 0.0),
    ("Canada", "country", "Canada", None, "Canada", 0.0),
    (" - ", "city", "Nowhere", None, "Canada", 99.0),
]
PLACES = [
    *[(x, "New York, NY") for x in ("New York", "NYC", "New York City", "Manhattan NY", "10001 New York", "new   YORK, ny")],
    *[(x, "London, United Kingdom") for x in ("London", "London UK", "London England", "Greater London", "12 Main St, Floor 3, London")],
    *[(x, "Toronto, Canada") for x in ("Toronto", "Toronto ON", "Toronto Ontario", "Toronto Canada")],
    *[(x, "Unknown") for x in ("Location, WV", "location wv", "Remote", "Multiple Locations", "TBD", "N/A", "", None, "Atlantis", "UK", "!!", "x " * 30000)],
    ("Charleston, WV", "Charleston, WV"), ("Charleston", "Charleston, SC"), ("Morgantown WV", "Morgantown, WV"), ("Buckhannon, West Virginia", "Buckhannon, WV"),
    ("London, Kentucky", "London, KY"), ("Paris", "Paris, France"), ("Paris, TX", "Paris, TX"), ("Paris, USA", "Paris, TX"), ("Hybrid - Paris or London", "Paris, France"),
    ("WV", "West Virginia, United States"), ("West Virginia, USA", "West Virginia, United States"), ("LA", "Los Angeles, CA"), ("Remote, Toronto", "Toronto, Canada"),
]


def gazetteer(spark):
    return places.fixed_places(spark).union(spark.createDataFrame(CITIES, places.GAZETTEER))


def test_locations(spark):
    df = spark.createDataFrame([(x, 1) for x, _ in PLACES + PLACES[:3]], "location string, phrase int").repartition(3)
    twice = gazetteer(spark).union(gazetteer(spark))
    assert {r.location: r.value for r in places.locations_by_rules(df, twice).collect()} == dict(PLACES)


def test_locations_of_empty_tables(spark):
    df = spark.createDataFrame([("Paris",)], "location string")
    assert [tuple(r) for r in places.locations_by_rules(df, gazetteer(spark).limit(0)).collect()] == [("Paris", "Unknown")]
    assert places.locations_by_rules(df.limit(0), gazetteer(spark)).collect() == []


RULES = [(1, "gizmo", "widget"), (0, "widget", "small  ring"), (2, "engineer", "developer"), (3, "dev", "developer"), (4, "of the", None), (5, "", "x"), (6, "same", "Same")]
JOBS = [("Software Developer", "Software Developers"), ("Registered Nurse", "Registered Nurses"), ("nurse", "Registered Nurses"), ("Accountant", "Accountants and Auditors"), ("marketing manager", "Marketing Managers"), ("data scientist", "Data Scientists"), ("ring", "Ring Makers"), ("Lead Bolt", "Lead Bolts"), ("bolt", "Bolts"), ("ring", "Zzz"), ("?", "Nothing")]
TITLES = [
    *[(x, "Software Developers") for x in ("Software Developer", "Software Engineer", "Sr. Software Engineer", "Junior Software Dev", "software senior engineer", "SOFTWARE of the dev of the")],
    *[(x, "Registered Nurses") for x in ("Registered Nurse", "RN", "Staff Nurse", "ICU Nurse - Boston")],
    *[(x, "Accountants and Auditors") for x in ("Accountant", "Accountant, Finance Department", "Senior Accountant", "Accountant / Software Developer")],
    ("Growth Marketing Manager", "Marketing Managers"), ("Sr Data Scientist", "Data Scientists"), ("gizmo gizmo", "Ring Makers"), ("lead bolt", "Lead Bolts"), ("Senior bolt", "Bolts"),
    *[(x, "Unknown") for x in ("Open to Work", "Various Roles", "TBD", "Analyst", "", None, "Senior", "?!", "Don't See A Career Match? Submit Your Resume for Future Opportunities!", "loop", "word " * 30000)],
]


def tables(spark, extra=()):
    made = spark.createDataFrame([*RULES, *extra], titles.RULES).union(titles.fixed_rules(spark).withColumn("place", F.col("place") + 100))
    return made, spark.createDataFrame(JOBS, titles.OCCUPATIONS)


def test_titles(spark):
    df = spark.createDataFrame([(x, 1) for x, _ in TITLES + TITLES[:4]], "title string, words int").repartition(3)
    # a rule that never ends makes its titles unknown, and no others
    made, jobs = tables(spark, [(7, "loop", "loop loop")])
    assert {r.title: r.value for r in titles.titles_by_rules(df, made, jobs).collect()} == dict(TITLES)


def test_titles_of_empty_tables_and_too_many_rules(spark):
    df = spark.createDataFrame([("Accountant",)], "title string")
    made, jobs = tables(spark)
    assert [tuple(r) for r in titles.titles_by_rules(df, made.limit(0), jobs).collect()] == [("Accountant", "Accountants and Auditors")]
    assert [tuple(r) for r in titles.titles_by_rules(df, made, jobs.limit(0)).collect()] == [("Accountant", "Unknown")]
    assert titles.titles_by_rules(df.limit(0), made, jobs).collect() == []
    with pytest.raises(ValueError):
        titles.rewritten(df.withColumn("w", F.array("title")), made, "w", most_rules=3)


@pytest.mark.parametrize("seed", range(3))
def test_rewriting_equals_plain_passes(spark, seed):
    rnd = random.Random(seed)
    letters = "abcd"
    made = [(rnd.randrange(4), " ".join(rnd.choices(letters, k=rnd.choice([1, 2]))), " ".join(rnd.choices("bcdef", k=rnd.choice([0, 1, 2])))) for _ in range(6)]
    texts = [" ".join(rnd.choices(letters, k=rnd.randrange(9))) for _ in range(80)]

    def once(w):
        for _, old, new in sorted(set(made), key=lambda r: (r[0], "".join(f" {x} " for x in r[1].split()), "".join(f" {x} " for x in r[2].split()))):
            old, new, out = old.split(), new.split(), []
            at = 0
            while old != new and at < len(w):
                hit = w[at : at + len(old)] == old
                out += new if hit else w[at : at + 1]
                at += len(old) if hit else 1
            w = out if old != new else w
        return w

    df = spark.createDataFrame([(t, t.split()) for t in set(texts)], "t string, w array<string>")
    for r in titles.rewritten(df, spark.createDataFrame(made, titles.RULES), "w").collect():
        w = r.t.split()
        for _ in range(titles.PASSES):
            before, w = w, once(w)
        assert r.w == (w if w == before else None), (made, r.t)


def test_all_three_domains(spark):
    keys = spark.createDataFrame([("title", None, "rn"), ("location", None, "paris, tx"), ("location", None, "moon"), ("seniority", False, "senior level"), ("seniority", True, "vp of sales"), ("title", None, "paris")], "domain string, use_title_key boolean, key string")
    made, jobs = tables(spark)
    got = {(r.domain, r.key): r.value for r in rules.by_tables(keys, made, jobs, gazetteer(spark)).collect()}
    assert got == {("title", "rn"): "registered nurses", ("title", "paris"): "unknown", ("location", "paris, tx"): "paris, tx", ("location", "moon"): "unknown", ("seniority", "senior level"): "senior", ("seniority", "vp of sales"): "executive"}


LOG = "run int, at int, w int, retry int, note string"


def plain_counts(rows, limit):
    out, run, n = {}, object(), 0
    for r in sorted(rows, key=lambda r: ((r[0] is not None, r[0] or 0), r[1], max(r[2] or 0, 0), (r[3] or 0) > 0)):
        if r[0] != run:
            run, n = r[0], 0
        again = n >= limit or (r[3] or 0) > 0
        out[r[4]] = (n, again)
        n = (0 if again else n) + max(r[2] or 0, 0)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_restarting_sums_equal_one_pass(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice([None, 1, 1, 1, 2, 3]), n if seed else n // 3, rnd.choice([None, -1, 0, 1, 1, 2, 5]), rnd.choice([None, 0, 0, 0, 0, 0, 0, 1]), str(n)) for n in range(400)]
    df = spark.createDataFrame(rows, LOG).repartition(5)
    for size, block in ((7, 3), (1000, 1)):
        got = pacing.restarting_sum(df, ["run"], ["at"], F.col("w"), F.col("retry") > 0, 9, "n", "again", size, block)
        want = plain_counts(rows, 9)
        if seed:
            assert {r.note: (r.n, r.again) for r in got.collect()} == want
        else:  # rows of one place are told apart by weight and restart alone
            assert sorted((r.n, r.again) for r in got.collect()) == sorted(want.values())
        assert got.columns == [*df.columns, "n", "again"]


def test_transitions(spark):
    rng = np.random.default_rng(5)
    for _ in range(50):
        w, forced, limit = rng.integers(0, 4, rng.integers(1, 30)), rng.random(1) < 0, int(rng.integers(1, 12))
        forced = rng.random(len(w)) < 0.1
        for begin, end in enumerate(pacing.transition(w, forced, limit)):
            n = begin
            for x, f in zip(w, forced, strict=True):
                n = (0 if f or n >= limit else n) + x
            assert end == n


def test_pauses_of_an_empty_log(spark):
    df = spark.createDataFrame([], LOG)
    assert pacing.pauses(df, ["run"], ["at"], F.col("w"), F.col("retry")).collect() == []
    with pytest.raises(ValueError):
        pacing.restarting_sum(df, [], ["at"], F.col("w"), F.col("retry") > 0, 0, "n", "again")
