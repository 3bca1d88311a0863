"""Task states as a stream with timers (M1, M2, M4, M5): a state a task in the state store, silence told by event time.

Moves come in order of `seq`; terminal states stay, progress never falls, repeats change nothing. A task that has been running without a move for `silence`
becomes interrupted when the watermark passes; its next move puts it back. The states are read back from the store's own files, for the
recovery summary at start-up.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOVE = "task_id string, seq long, status string, progress int, at timestamp"
STATE = "status string, progress int, updates long, seq long"
CHANGE = "task_id string, status string, progress int, updates long, seq long"
WAITING, RUNNING, INTERRUPTED = "待处理", "处理中", "已中断"
#: States that nothing changes any more (fixed values).
TERMINAL = ("成功", "失败", "已取消")
#: Which actions a state allows, and where they lead (fixed values).
ACTIONS = {
    "retry": (("失败", "已取消", "已中断"), WAITING),
    "cancel": (("待处理", "处理中", "已暂停", "已中断", "待确认"), "已取消"),
    "pause": (("待处理", "处理中"), "已暂停"),
    "resume": (("已暂停", "已中断"), WAITING),
}
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def acted(tasks: DataFrame, action: str = "action", status: str = "status") -> DataFrame:
    """Tasks with the state that an asked-for action leads to and whether it is allowed; one that isn't changes nothing."""
    moves = [F.struct(F.lit(a).alias("a"), F.lit(s).alias("s"), F.lit(to).alias("to")) for a, (states, to) in ACTIONS.items() for s in states]
    to = F.get(F.filter(F.array(*moves), lambda m: (m["a"] == F.col(action)) & (m["s"] == F.col(status))), F.lit(0))["to"]
    return tasks.withColumns({"next_status": F.coalesce(to, F.col(status)), "allowed": to.isNotNull()})


class Settle(StatefulProcessor):
    """One task: moves after the last one seen, in order; a timer that each move of a running task sets anew."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()
        status, progress, updates, last = now if now is not None else (WAITING, 0, 0, -1)
        seen = None
        moves = sorted({t for b in rows for t in zip(b["seq"].tolist(), b["status"].tolist(), b["progress"].tolist(), b["at"].tolist())})
        for seq, to, p, at in moves:
            if status in TERMINAL or seq <= last:
                continue
            status, progress, updates, last, seen = to, max(progress, p), updates + 1, seq, at
        if seen is None:
            return iter(())
        self.state.update((status, progress, updates, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == RUNNING:
            self.handle.registerTimer(int(pd.Timestamp(seen).timestamp() * 1000) + self.silence_ms)
        return iter([pd.DataFrame({"task_id": [key[0]], "status": [status], "progress": [progress], "updates": [updates], "seq": [last]})])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, progress, updates, last = self.state.get()
        if status != RUNNING:
            return iter(())
        self.state.update((INTERRUPTED, progress, updates, last))
        return iter([pd.DataFrame({"task_id": [key[0]], "status": [INTERRUPTED], "progress": [progress], "updates": [updates], "seq": [last]})])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The store that timers need, for queries started inside."""
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before)


def states(moves: DataFrame, silence: datetime.timedelta, late: str = "1 minute") -> DataFrame:
    """The stream of changed states. moves: a stream of MOVE rows."""
    dealt = moves.withWatermark("at", late).groupBy("task_id")
    return dealt.transformWithStateInPandas(Settle(int(silence.total_seconds() * 1000)), CHANGE, "update", "EventTime")


def follow(moves: DataFrame, silence: datetime.timedelta, checkpoint: str, sink: str, late: str = "1 minute"):
    """Runs over all that has landed, then stops; changes are appended to `sink` by batch, a repeated batch replacing its own. A later run
    goes on from the checkpoint."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/batch={number:08d}")

    with state_store(moves.sparkSession):
        return states(moves, silence, late).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()


def stored(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(task_id, status, progress, updates, seq) as the state store holds it."""
    with state_store(spark):
        kept = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
        return kept.select(F.col("key.task_id").alias("task_id"), "value.*")


def recovered(now: DataFrame) -> DataFrame:
    """Counts of states at start-up, and of what can be tried again."""
    return now.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*ACTIONS["retry"][0])).alias("retryable"))
