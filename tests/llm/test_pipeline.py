import os
import random
import re

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from vocatio.llm import bpe, quality
from vocatio.llm import entry as llm_entry

SMALL = "/root/testdata/sf0.001"


def make(spark, tmp_path, docs, benchmark, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_equal_a_plain_version(spark, tmp_path):
    rnd = random.Random(1)
    prose = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(n))
    item = prose(15)
    docs, labels = [], []
    for i in range(300):
        junk = i % 5 == 0
        t = prose(rnd.randrange(40, 120))
        if junk:
            t = "### ".join(t.upper().split())
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(not junk), 0))
    put = lambda i, t: docs.append((i, t, "en", "s", len(t)))
    put(400, docs[1][1])
    put(401, docs[2][1] + " end")
    put(402, prose(60) + " " + item + " " + prose(60))
    put(403, prose(60) + " me.1@mail.example.org " + prose(30))
    put(404, "")
    docs.append((405, None, None, None, None))
    folder = make(spark, tmp_path, docs, [(1, item)], labels)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}

    # the plain version: the same model's scores, all else by hand
    whole = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(whole, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {r.doc_id for r in quality.score_quality(whole, model).where("quality_score >= 0.5").collect()}
    left = [(d[0], d[1]) for d in docs if d[0] in good and d[0] not in (400, 401, 402)]
    assert {1, 2, 403} <= good and not {0, 5, 10} & good
    assert set(got) == {i for i, _ in left}
    e = bpe.Encoder(bpe.default_path())
    for i, t in left:
        t = re.sub(r"me\.1@mail\.example\.org", "[EMAIL]", t) if t else t
        r = got[i]
        assert r.text == t and r.n_chars == (None if t is None else len(t)) and r.round_trip
        assert r.token_ids == e.tokenizer.encode(t or "", add_special_tokens=False).ids and r.n_tokens == len(r.token_ids)


def test_near_duplicate_stage_decides_by_row(spark):
    """No text is lost with another one of its id; of equal rows one stays."""
    x, y, z = (f"{c}1 {c}2 {c}3 {c}4 {c}5 {c}6 {c}7" for c in "xyz")
    docs = spark.createDataFrame([(1, x), (50, x), (50, y), (60, y), (70, z), (70, z), (50, None), (50, None), (None, x), (None, "only here by far"), (None, None)], "doc_id long, text string").withColumns({"__helper0": F.lit(3), "kept": F.lit("own")})
    out = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, x), (60, y), (70, z), (50, None), (None, "only here by far"), (None, None)], key=str)
    assert all(r["__helper0"] == 3 and r.kept == "own" for r in out.collect())


def test_near_duplicate_stage_keeps_the_least_of_rows_that_differ_elsewhere(spark):
    """Whatever the order of rows and partitions."""
    x, z = "a b c d e f g", "t u v w x y z"
    rows = [(7, z, "b"), (7, z, "a"), (7, z, None), (8, x, "d"), (8, x, "c"), (8, "other words than those before here", "e"), (9, x, "a")]
    for n in (1, 3):
        for ordered in (rows, rows[::-1]):
            docs = spark.createDataFrame(ordered, "doc_id long, text string, source string").repartition(n)
            out = corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()
            assert sorted((r.doc_id, r.text, r.source or "") for r in out) == [(7, z, ""), (8, "other words than those before here", "e"), (9, x, "a")]


def test_stages_on_long_and_repeated_texts(spark, tmp_path):
    long = " ".join(f"word{i % 997}x{i}" for i in range(60_000))
    rows = [(1, long, "en", "s", 5), (1, long, "en", "s", 5), (2, long + " end", "en", "s", 5), (3, "", None, None, None)]
    folder = make(spark, tmp_path, rows, [(1, "no such words")], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"__quality": F.lit(1), "__tokens": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    got = docs.collect()
    assert sorted(r.doc_id for r in got) == [1, 3] and all(r.round_trip and r["__quality"] == 1 and r["__tokens"] == 2 for r in got)


def test_stages_name_their_columns(spark, tmp_path):
    folder = make(spark, tmp_path, [(1, "a b c", "en", "s", 5)], [], [])
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("personal", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == docs.columns
        assert stage(spark, docs.limit(0), folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_every_operator_has_its_query():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in llm_entry.queries())] == []


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", sorted(llm_entry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    keys = lambda df: [c for c in ("doc_id", "part", "filter_order", "step") if c in df.columns]
    plain = lambda df: df.astype(object).where(df.notna(), None).sort_values(keys(df)).values.tolist()
    want = con.execute(llm_entry.oracle_sql()[name]).df()
    got = llm_entry.queries()[name](spark, SMALL).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got[want.columns]) == plain(want)
