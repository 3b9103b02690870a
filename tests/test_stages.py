"""Counts of stages without jobs of their own, and the evidence threshold over a stream."""

import random
import time

import pytest
from pyspark.sql import functions as F

from stancemill.operators import relational as R
from stancemill.plans import pipeline
from stancemill.streaming import evidence


def test_stage_counts_need_no_job(spark):
    pages = spark.createDataFrame([(k, f"q{k % 3}") for k in range(60)] + [(60, "rare")], "answer_id long, search_query string")
    first = pages.select("answer_id", F.when(F.col("answer_id") % 4 == 0, "no").otherwise("yes").alias("answer"))
    second = pages.select("answer_id", F.when(F.col("answer_id") % 5 == 0, "no").otherwise("hm\nyes").alias("answer"))
    jobs, got, tracker = [], [], spark.sparkContext.statusTracker()
    for counts in (None, R.StageCounts()):
        spark.sparkContext.setJobGroup(f"stages-{counts}", "")
        out = pipeline.ensemble_filter(pages, first, second, 5, counts)
        out = pipeline.dedup_filter(out, spark.createDataFrame([("q1",)], "search_query string"), 5, counts=counts)
        got.append(sorted(map(tuple, out.collect())))
        rows = counts.rows() if counts else None
        jobs.append(len(tracker.getJobIdsForGroup(f"stages-{counts}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    agreed = [k for k in range(61) if (k % 4 == 0) == (k % 5 == 0)]
    assert rows["pages"] == 61 and rows["agreed"] == len(agreed) and rows["ensemble"] == len([k for k in agreed if k < 60])
    assert rows["deduplicated"] == len([k for k in agreed if k < 60 and k % 3 != 1]) == rows["enough"] == len(got[0])
    assert got[0] == got[1] and jobs[0] == jobs[1]


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, evidence.PROVIDER)
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.unset(key) if old is None else spark.conf.set(key, old)


SCHEMA = "answer_id long, search_query string, stance string, extra string"


def streamed(spark, tmp_path, batches, least, patience=None, wait=0):
    source, name = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = evidence.evidence_stream(stream, least, patience).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(**({"availableNow": True} if patience is None else {"once": True})).start(name)  # with timers availableNow goes on
        ended = query.awaitTermination(60)
        query.stop()
        assert ended and query.exception() is None
        time.sleep(wait)
    return sorted(map(tuple, spark.read.schema(evidence.OUTPUT).parquet(name).collect()))


def test_stream_gives_the_batch_result(rocks, tmp_path):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", "c", "d", None]) if k % 17 else "rare", rng.choice(["yes", "no", "not", None]), "x") for k in range(80)]
    batches = [rows[:30], rows[30:]]
    got = streamed(rocks, tmp_path, batches, 6)
    df = rocks.createDataFrame(rows, SCHEMA)
    ids = {r[0] for r in R.evidence_ids(df, 6, "stance").collect()}
    assert {i for _, i, _ in got} == ids and len(got) == len(ids) and 0 < len(ids) < 80
    assert got == sorted((q, i, s) for i, q, s, _ in rows if i in ids)


def test_patience_ends(rocks, tmp_path):
    """A query without enough pages in time starts anew."""
    batches = [[(1, "late", "yes", "x"), (2, "done", "no", "x"), (3, "done", "no", "x")], [(4, "other", "no", "x")], [(5, "late", "yes", "x"), (6, "done", "yes", "x")]]
    got = streamed(rocks, tmp_path, batches, 2, patience=1, wait=0.1)
    assert got == [("done", 2, "no"), ("done", 3, "no"), ("done", 6, "yes")]
