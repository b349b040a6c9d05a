from vocatio.streaming import ingest


def test_only_single_rows_are_sent_through_the_driver(spark):
    """Runs and stored jobs are as many as the batch has: Spark, which takes them for small here, broadcasts none of them."""
    responses = spark.createDataFrame([(i, i, None, 200, "<ul></ul>") for i in range(3)] + [(10 + i, i, 100 + i, 200, "<h1>t</h1>") for i in range(3)], ingest.RESPONSE)
    stored = spark.createDataFrame([(101,)], "job_id long")
    for df in ingest.ingested(responses, stored):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the refused response, one row, is sent by hint
        assert "SortMergeJoin" in plan and all("_extract_scrape_run_id" in line for line in plan.splitlines() if "BroadcastHashJoin" in line)
    assert sorted(r.scrape_run_id for r in df.collect()) == [0, 1, 2]
