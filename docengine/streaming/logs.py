"""Log ingest, retention and task state as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "id long, task_id string, message string, level string, category string, created_at timestamp"
#: Categories and the settings that gate them (fixed values).
GATES = {"macro": "logMacro", "conversion": "logConversion", "recognition": "logRecognition", "system": "logSystem"}
LEVELS = ["debug", "info", "warning", "error"]


def read_logs(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def gated(logs: DataFrame, settings: dict[str, str]) -> DataFrame:
    """What the level, category and history settings let through; works on streams and tables alike."""
    if settings.get("keepHistory", "true") == "false":
        return logs.filter(F.lit(False))
    least = LEVELS.index(settings.get("logLevel", "info"))
    level = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.lower("level")), F.lit(2)) - 1
    off = [c for c, key in GATES.items() if settings.get(key, "true") == "false"]
    return logs.filter((level >= least) & ~F.coalesce(F.col("category"), F.lit("")).isin(off))


def append(logs: DataFrame, path: str, checkpoint: str):
    """Exactly-once append, partitioned by day so that retention drops whole folders."""
    day = logs.withColumn("day", F.to_date("created_at"))
    return day.writeStream.format("parquet").partitionBy("day").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def rollup(logs: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by level in tumbling windows, late rows dropped after the watermark (an extension)."""
    return logs.withWatermark("created_at", late).groupBy(F.window("created_at", window), "level").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "level", "n")


def heartbeats(beats: DataFrame, late: str = "1 hour") -> DataFrame:
    """M5: (client_id, beat_id) once each within the watermark; the latest by client is max_by over the result."""
    return beats.withWatermark("at", late).dropDuplicatesWithinWatermark(["client_id", "beat_id"])


EVENT = "task_id string, seq long, status string, progress int"
STATE = "task_id string, status string, progress int, updates long"
#: States that nothing changes any more, and what may follow the others (fixed values).
TERMINAL = ("成功", "失败", "已取消")


def settle(status: str, progress: int, events: list[tuple[int, str, int]]) -> tuple[str, int, int]:
    """M2: state after events in order: terminal states stay, progress never falls, repeats change nothing."""
    n = 0
    for _, to, p in sorted(set(events)):
        if status in TERMINAL:
            break
        status, progress, n = to, max(progress, p), n + 1
    return status, progress, n


def task_states(events: DataFrame) -> DataFrame:
    """M1, M2: the stream of changed task states, keyed by task."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, progress, n = state.get if state.exists else ("待处理", 0, 0)
        some = [t for b in batches for t in zip(b["seq"].tolist(), b["status"].tolist(), b["progress"].tolist())]
        status, progress, k = settle(status, progress, some)
        state.update((status, progress, n + k))
        yield pd.DataFrame({"task_id": [key[0]], "status": [status], "progress": [progress], "updates": [n + k]})

    return events.groupBy("task_id").applyInPandasWithState(step, STATE, "status string, progress int, updates long", "update", "NoTimeout")


def task_states_batch(events: DataFrame) -> DataFrame:
    """The same over a table, natively: events up to and including the first terminal one decide."""
    e = events.distinct()
    order = F.struct("seq", "status", "progress")
    end = e.groupBy("task_id").agg(F.min(F.when(F.col("status").isin(*TERMINAL), order)).alias("end"))
    valid = e.withColumn("o", order).join(end, "task_id").filter(F.col("end").isNull() | (F.col("o") <= F.col("end")))
    return valid.groupBy("task_id").agg(F.max_by("status", "o").alias("status"), F.greatest(F.max("progress"), F.lit(0)).alias("progress"), F.count(F.lit(1)).alias("updates"))


