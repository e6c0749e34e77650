"""The token budget of a query that has very many chunks."""

import random

from pyspark.sql import functions as F

from corpusflow.operators import answer


def test_budget_is_exact_over_dealt_chunks(spark):
    chance = random.Random(7)
    rows = [(q, r, None if chance.random() < 0.05 else chance.choice([0, 1, 5, 30, 30, 200, 5000 if r % 37 == 0 else 7])) for q in range(12) for r in range(chance.choice([1, 40, 900]))]
    want, used = set(), {}
    for q, r, n in rows:
        if n is not None or q in used:
            used[q] = used.get(q, 0) + (n or 0)
            if used[q] <= 1000:
                want.add((q, r, used[q]))
    got = answer.within_budget(spark.createDataFrame(rows, "query_id long, rank long, token_count long").orderBy("token_count"), 1000)
    assert got.columns == ["query_id", "rank", "token_count", "used"]
    assert {(r["query_id"], r["rank"], r["used"]) for r in got.collect()} == want


def most_rows_of_a_task(spark, run):
    sc = spark.sparkContext
    sc.setJobGroup("most-rows", "")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, most = sc._jsc.sc().statusStore(), 0
    stages = {i for job in sc.statusTracker().getJobIdsForGroup("most-rows") for i in sc.statusTracker().getJobInfo(job).stageIds}
    assert stages
    for stage in stages:
        tasks = store.taskList(stage, 0, 10_000)
        for i in range(tasks.size()):
            m = tasks.apply(i).taskMetrics()
            most = max(most, m.get().shuffleReadMetrics().recordsRead() if m.isDefined() else 0)
    return most


def test_no_task_reads_all_chunks_of_a_query(spark):
    rows = spark.range(20_000).select(F.lit(0).alias("query_id"), F.col("id").alias("rank"), F.lit(100).cast("long").alias("token_count"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = most_rows_of_a_task(spark, lambda: answer.within_budget(rows, 4000).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 0 < most < 6000
