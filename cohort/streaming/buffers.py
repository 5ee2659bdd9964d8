"""The bounded conversation buffer, kept up to date over a stream of messages."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from cohort import fixed_values as fv
from cohort.session import shared_folder, written

# functions that run in Python workers travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MESSAGE = "struct<turn: bigint, role: string, text: string>"
MESSAGES = f"array<{MESSAGE}>"
BUFFERS = f"conv_id bigint, seen bigint, messages {MESSAGES}"


def _reduced(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """Keep what a buffer can need from each batch: the first system message and the last n of every conversation."""
    for batch in batches:
        ordered = batch.sort_values(["conv_id", "turn"], kind="stable")
        back = ordered.groupby("conv_id", sort=False).cumcount(ascending=False)
        system = ordered["role"] == "system"
        first = system & (ordered["turn"] == ordered["turn"].where(system).groupby(ordered["conv_id"]).transform("min"))
        yield ordered[(back < n) | first]


def _held(known: dict[int, tuple[str, str]], n: int) -> tuple[list[int], list[int]]:
    """Turns to remember, and turns in the buffer: the last n, or the first system message and the last n - 1."""
    last = sorted(known)[-n:]
    head = min((t for t, (role, _) in known.items() if role == "system"), default=None)
    if head is None or head >= last[0]:
        return last, last
    return [head, *last], [head, *(last[1:] if len(last) == n else last)]


class _Buffers(StatefulProcessor):
    """Keeps the messages a buffer can need as a list, and the number of updates."""

    def __init__(self, n: int, idle_ms: int | None):
        self.n, self.idle_ms = n, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", "turn bigint, role string, text string", self.idle_ms)
        self.seen = handle.getValueState("seen", "seen bigint", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = {t: (r, x) for t, r, x in self.messages.get()} if self.messages.exists() else {}
        for frame in rows:
            known.update({int(t): (r, x) for t, r, x in zip(frame["turn"], frame["role"], frame["text"])})
            known = {t: known[t] for t in _held(known, self.n)[0]}
        kept, shown = _held(known, self.n)
        self.messages.put([(t, *known[t]) for t in kept])
        seen = (self.seen.get()[0] if self.seen.exists() else 0) + 1
        self.seen.update((seen,))
        yield pd.DataFrame({"conv_id": [key[0]], "seen": [seen], "messages": [[{"turn": t, "role": known[t][0], "text": known[t][1]} for t in shown]]})

    def close(self) -> None:
        pass


def buffer_stream(messages: DataFrame, n: int = fv.BUFFER_MESSAGES, idle: timedelta | None = None) -> DataFrame:
    """After every micro-batch the current buffer of the conversations it touched: conv_id, seen, messages.

    The state of a conversation is a list of its first system message and its last n messages by turn, so late messages find
    their place and the state stays bounded. Batches are reduced before the shuffle, which takes the weight off a busy
    conversation. With idle, the state of a conversation without messages for so long expires, and what comes later begins anew;
    its last buffer stays in the table. Such a stream runs batches for the clock alone, so it needs a trigger by processing time; one
    that ends with the available data would not end. seen counts the updates of the state. The state needs the RocksDB store, see start_buffer_table.
    """
    if n < 2:
        raise ValueError("A buffer needs at least 2 places.")
    columns = messages.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        F.col("text").cast("string"),
    )
    reduced = columns.mapInPandas(lambda batches: _reduced(batches, n), "conv_id bigint, turn bigint, role string, text string")
    idle_ms = None if idle is None else max(1, int(idle.total_seconds() * 1000))
    return reduced.groupBy("conv_id").transformWithStateInPandas(
        _Buffers(n, idle_ms), StructType.fromDDL(BUFFERS), "Update", "None" if idle is None else "ProcessingTime")


def _exists(spark: SparkSession, pattern: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _merge(batch: DataFrame, path: str, buckets: int, batch_id: int) -> None:
    """Replace the buckets of a table that a batch of buffers touches, one file each.

    The new content is staged first. When a batch is repeated after a failure, complete staged content is used as it is, so a
    bucket that was lost on the way to its place comes back.
    """
    spark, staged = batch.sparkSession, f"{path}/_staged/batch={batch_id}"
    if not _exists(spark, f"{staged}/_SUCCESS"):
        fresh = written(batch.select(F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int").alias("bucket"), "*"), "updates")
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
        if not touched:
            return
        merged = fresh
        if _exists(spark, f"{path}/bucket=*"):
            old = spark.read.schema(fresh.schema).parquet(path).select(fresh.columns).where(F.col("bucket").isin(touched))
            merged = old.join(fresh.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_anti").unionByName(fresh)
        merged.write.mode("overwrite").parquet(staged)
    rows = spark.read.schema(f"bucket int, {BUFFERS}").parquet(staged)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    _delete(spark, f"{path}/_staged/batch={batch_id - 1}")


def start_buffer_table(buffers: DataFrame, path: str, checkpoint: str, buckets: int = 64, **trigger) -> StreamingQuery:
    """Keep the table of current buffers up to date: a file for each of so many buckets of conversations, whatever the age of the stream.

    A micro-batch rewrites the buckets that it touches; a repeated batch gives the same table. Choose buckets so that one fits a task. Read the
    table between micro-batches.
    """
    spark = buffers.sparkSession
    if not _exists(spark, checkpoint):
        _delete(spark, f"{path}/_staged")   # of another stream

    def save(batch: DataFrame, batch_id: int) -> None:
        _merge(batch, path, buckets, batch_id)

    writer = buffers.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)     # a query keeps the settings that it is started with
    try:
        return writer.trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(name, before)


def current_buffers(spark: SparkSession, path: str) -> DataFrame:
    """The latest buffer of every conversation as rows: conv_id, turn, role, text. Costs one row for each conversation."""
    if not _exists(spark, f"{path}/bucket=*"):
        return spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    return spark.read.schema(f"{BUFFERS}, bucket int").parquet(path).select("conv_id", F.inline("messages"))


def replay(messages: DataFrame, n: int = fv.BUFFER_MESSAGES) -> DataFrame:
    """Run a stream over everything that is there now and return the buffers it ends with."""
    spark = messages.sparkSession
    path, checkpoint = shared_folder(spark, "buffers"), shared_folder(spark, "buffers-state")
    query = start_buffer_table(buffer_stream(messages, n), path, checkpoint)
    query.awaitTermination()
    return current_buffers(spark, path)
