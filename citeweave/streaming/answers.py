"""A stream of references answered from state: what was found is remembered for a time, and who waits too long is told so.

Rows of references and rows of answers meet by key (a digest of the text) in one stateful
operator. Its state holds, for each key, a hit (remembered for ``HIT_SECONDS``) or a miss
(``MISS_SECONDS``), which the state store lets go by itself, and the rows that wait. A key
that is not known is asked for once; a row that is not answered within ``WAIT_SECONDS`` gives
``Retry``, and a later answer still counts for the rows that come then.

Questions leave through the sink, which looks each batch's keys up together and writes what it
finds to a folder that the stream reads as its second source. A batch that is repeated after a
failure writes its own part again; an answer that comes twice is the same answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

HIT_SECONDS, MISS_SECONDS, WAIT_SECONDS = 6 * 3600, 600, 25
FOUND = "key string, id bigint, grade string"
#: What the operator gives: an answer to a row, or a key to look up (status ``ask``, with its text).
GIVEN = "key string, ref_id bigint, text string, id bigint, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Remembered(StatefulProcessor):
    """The state of one key: its answer while that is fresh, and the rows that wait for one."""

    def __init__(self, hit: float = HIT_SECONDS, miss: float = MISS_SECONDS, wait: float = WAIT_SECONDS):
        self.lives, self.wait = (int(hit * 1000), int(miss * 1000)), int(wait * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.hit = handle.getValueState("hit", "id bigint, grade string", self.lives[0])
        self.miss = handle.getValueState("miss", "grade string", self.lives[1])
        self.waiting = handle.getListState("waiting", "ref_id bigint")

    def _known(self) -> tuple | None:
        if self.hit.exists():
            return tuple(self.hit.get())
        return (None, "none") if self.miss.exists() else None

    def _rows(self, key: str, refs: list, number, status: str) -> pd.DataFrame:
        return pd.DataFrame({"key": key, "ref_id": refs, "text": None, "id": pd.array([number] * len(refs), "Int64"), "status": status})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        found, asked = every[every.grade.notna()], every[every.grade.isna()]
        for number, grade in zip(found.id, found.grade, strict=True):
            if grade == "none":
                self.miss.update(("none",))
            else:
                self.hit.update((int(number), grade))
        known = self._known()
        before = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        refs = before + [int(r) for r in asked.ref_id]
        if known is not None:
            self._forget()
            if refs:
                yield self._rows(key[0], refs, *known)
        elif len(asked):
            self.waiting.appendList([(int(r),) for r in asked.ref_id])
            if not before:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
                question = self._rows(key[0], [None], None, "ask")
                question["text"] = asked.text.iloc[0]
                yield question

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        refs = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        self.waiting.clear()
        if refs:
            yield self._rows(key[0], refs, None, "Retry")

    def _forget(self) -> None:
        self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def close(self) -> None:
        pass


def key_of(text: F.Column) -> F.Column:
    return F.sha2(F.trim(F.coalesce(text, F.lit(""))), 256)


def given(refs: DataFrame, found: DataFrame, hit: float = HIT_SECONDS, miss: float = MISS_SECONDS, wait: float = WAIT_SECONDS) -> DataFrame:
    """Answers and questions (``GIVEN``) to streams of references (ref_id, text) and of what was found (``FOUND``)."""
    asked = refs.select(key_of(F.col("text")).alias("key"), F.col("ref_id").cast("bigint").alias("ref_id"), "text", F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("string").alias("grade"))
    told = found.select("key", F.lit(None).cast("bigint").alias("ref_id"), F.lit(None).cast("string").alias("text"), F.col("id").cast("bigint").alias("id"), F.coalesce("grade", F.lit("none")).alias("grade"))
    return asked.union(told).groupBy("key").transformWithStateInPandas(Remembered(hit, miss, wait), GIVEN, "Append", "ProcessingTime")


def answer_stream(
    refs: DataFrame, lookup: Callable[[DataFrame], DataFrame], folder: str, every: str = "1 second", hit: float = HIT_SECONDS, miss: float = MISS_SECONDS, wait: float = WAIT_SECONDS
) -> StreamingQuery:
    """Answers (ref_id, id, grade) appended to ``folder``/answers as references arrive; ``lookup`` takes (key, text) and gives (key, id, grade).

    State stores are RocksDB's, which hold what doesn't fit in memory on disk; the session's
    setting is changed to that.
    """
    spark = refs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    _begin(spark, folder)
    found = spark.readStream.schema(FOUND).parquet(f"{folder}/found/*")

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            answers = batch.filter("status <> 'ask'").select("ref_id", "id", F.col("status").alias("grade"))
            answers.write.mode("overwrite").parquet(f"{folder}/answers/batch={number}")
            asked = batch.filter("status = 'ask'").select("key", "text")
            if asked.limit(1).count():
                got = asked.join(lookup(asked).select("key", F.col("id").cast("bigint").alias("id"), "grade"), "key", "left")
                got.select("key", "id", F.coalesce("grade", F.lit("none")).alias("grade")).write.mode("overwrite").parquet(f"{folder}/found/batch={number}")
        finally:
            batch.unpersist()

    stream = given(refs, found, hit, miss, wait).writeStream.outputMode("append").foreachBatch(each)
    return stream.option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime=every).start()


def _begin(spark: SparkSession, folder: str) -> None:
    """First, empty parts, so that both folders can be read."""
    spark.createDataFrame([], FOUND).coalesce(1).write.mode("overwrite").parquet(f"{folder}/found/batch=-1")
    spark.createDataFrame([], "ref_id bigint, id bigint, grade string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/answers/batch=-1")
