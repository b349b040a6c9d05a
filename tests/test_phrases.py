import random
import re

import pytest

from vocatio.operators import phrases

TEXTS = "id long, text string, phrase string, at int"


def plain(text, book):
    """At each word, the longest phrase that begins there, or the next word."""
    w = [x for x in re.sub(r"[^\w+#]+|_", " ", (text or "").lower()).split(" ") if x]
    out, at = [], 0
    while at < len(w):
        n = max((len(p) for p in book if tuple(w[at : at + len(p)]) == p), default=0)
        if n:
            out.append((at, n, " ".join(w[at : at + n])))
        at += n or 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_a_scan_from_left_to_right(spark, seed):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "C++", "d#", "é", "7"][: 3 + seed]
    entries = [" ".join(rnd.choices(words, k=rnd.choice([1, 1, 2, 3, 4, 6]))) for _ in range(12 * (seed + 1))] + ["", " - ", None, "A  b", "a-B"]
    book = {tuple(re.sub(r"[^\w+#]+", " ", e.lower()).split()) for e in entries if e} - {()}
    texts = [(i, rnd.choice([" ", ", ", "\n\t"]).join(rnd.choices(words, k=rnd.randrange(40))), "p", i) for i in range(60)]
    texts += [(100, None, "p", 1), (101, "", "p", 1), (102, "b a " * 3000, "p", 1), (1, texts[1][1], "p", 1), (2, "a b c", "q", 2)]
    got = {}
    for r in phrases.phrase_spans(spark.createDataFrame(texts, TEXTS).repartition(3), spark.createDataFrame([(e,) for e in entries], "phrase string"), "id", "text").collect():
        got.setdefault(r.id, []).append((r.at, r.n, r.phrase))
    want = {}
    for i, text, *_ in {t[:2]: t for t in texts}.values():
        want.setdefault(i, []).extend(plain(text, book))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_first_skills_of_a_text_and_of_none(spark):
    book = spark.createDataFrame([("machine learning",), ("learning",), ("SQL",), ("python",)], "skill string")
    texts = spark.createDataFrame([(1, "Learning SQL; Machine-Learning, sql, python", "", 0), (2, "none", "", 0), (3, None, "", 0)], TEXTS)
    assert [tuple(r) for r in phrases.skills_by_vocabulary(texts, book, "id", "text", 3).collect()] == [(1, ["learning", "sql", "machine learning"])]
    assert phrases.skills_by_vocabulary(texts, book.limit(0), "id", "text").collect() == []
    assert phrases.skills_by_vocabulary(texts.limit(0), book, "id", "text").collect() == []


def test_a_large_vocabulary(spark):
    book = spark.range(100_000).selectExpr("concat('skill ', id, ' of ', id % 7) as phrase")
    texts = spark.createDataFrame([(i, f"x skill {i} of {i % 7} skill {i} of 9", "", 0) for i in range(0, 100_000, 5000)], TEXTS)
    assert sorted(tuple(r) for r in phrases.phrase_spans(texts, book, "id", "text").collect()) == [(i, 1, 4, f"skill {i} of {i % 7}") for i in range(0, 100_000, 5000)]


def test_a_small_vocabulary_shuffles_no_text(spark):
    """Whatever size the tables it comes of seem to have."""
    book = spark.range(400_000).selectExpr("concat('w', id % 9, ' x') as phrase")
    texts = spark.range(20_000).selectExpr("id % 5000 as k", "concat('w', id % 9) as w").groupBy("k").agg({"w": "max"}).selectExpr("k as id", "concat(`max(w)`, ' X, y') as text")
    found = phrases.skills_by_vocabulary(texts, book, "id", "text")
    assert found.count() == 5000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan  # the texts were dealt by one before; and the skills
