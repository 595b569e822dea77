"""The stream of references: answers remembered and let go, rows that wait too long."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from citeweave.streaming import answers


def until(test, seconds=90):
    end = time.time() + seconds
    while not test() and time.time() < end:
        time.sleep(0.5)
    return test()


def test_answers_are_remembered_let_go_and_late(spark, tmp_path):
    asked: list[str] = []

    def lookup(df):
        asked.extend(sorted(r.text or "" for r in df.collect()))
        return df.filter("text like 'known%'").select("key", F.lit(7).alias("id"), F.lit("good").alias("grade"))

    folder, inbox = f"{tmp_path}/out", f"{tmp_path}/in"

    def put(*rows):
        spark.createDataFrame(list(rows), "ref_id bigint, text string").coalesce(1).write.mode("append").parquet(inbox)

    def got():
        return {r.ref_id: (r.id, r.grade) for r in spark.read.schema("ref_id bigint, id bigint, grade string").parquet(f"{folder}/answers").collect()}

    put((1, "known a"), (2, "known a"), (3, "other"), (4, None))
    stream = spark.readStream.schema("ref_id bigint, text string").parquet(inbox)
    query = answers.answer_stream(stream, lookup, folder, hit=3600, miss=4, wait=60)
    try:
        assert until(lambda: len(got()) == 4), (got(), query.exception())
        assert got() == {1: (7, "good"), 2: (7, "good"), 3: (None, "none"), 4: (None, "none")} and sorted(asked) == ["", "known a", "other"]
        time.sleep(6)  # the misses are let go, the hit stays
        put((5, "known a"), (6, "other"))
        assert until(lambda: len(got()) == 6), (got(), query.exception())
        assert got()[5] == (7, "good") and got()[6] == (None, "none") and asked.count("known a") == 1 and asked.count("other") == 2
    finally:
        query.stop()


def test_rows_that_wait_too_long_say_retry(spark, tmp_path):
    """A stream whose answers never come, then come: state is read without a sink that looks up."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", answers.ROCKS)
    inbox, found = f"{tmp_path}/in", f"{tmp_path}/found"
    spark.createDataFrame([], answers.FOUND).coalesce(1).write.parquet(f"{found}/a")
    spark.createDataFrame([(1, "late"), (2, "late")], "ref_id bigint, text string").coalesce(1).write.parquet(inbox)
    refs, told = spark.readStream.schema("ref_id bigint, text string").parquet(inbox), spark.readStream.schema(answers.FOUND).parquet(f"{found}/*")
    query = answers.given(refs, told, wait=1).writeStream.format("memory").queryName("given").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    rows = lambda: sorted((r.ref_id or 0, r.status, r.id) for r in spark.table("given").collect())
    try:
        assert until(lambda: len(rows()) == 3), (rows(), query.exception())
        assert rows() == [(0, "ask", None), (1, "Retry", None), (2, "Retry", None)]
        key = spark.sql("SELECT sha2('late', 256) AS k").first().k
        spark.createDataFrame([(key, 9, "check")], answers.FOUND).coalesce(1).write.parquet(f"{found}/b")
        spark.createDataFrame([(3, " late ")], "ref_id bigint, text string").coalesce(1).write.mode("append").parquet(inbox)
        assert until(lambda: any(r[0] == 3 and r[1] == "check" for r in rows())), (rows(), query.exception())
    finally:
        query.stop()
