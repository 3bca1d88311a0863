"""Task states by a stream in several batches, with timers, against a loop."""

import datetime
import random

from docengine.streaming import taskstates as S
from pyspark.sql import functions as F

T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, S.MOVE).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, tmp_path, silence=30):
    moves = spark.readStream.schema(S.MOVE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    S.follow(moves, datetime.timedelta(minutes=silence), f"{tmp_path}/checkpoint", f"{tmp_path}/out").awaitTermination()
    return {r.task_id: (r.status, r.progress, r.updates) for r in S.stored(spark, f"{tmp_path}/checkpoint").collect()}


def test_states_timers_and_restarts(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, "a", [("t1", 1, "处理中", 10, at(0)), ("t1", 1, "处理中", 10, at(0)), ("t2", 1, "处理中", 50, at(1)), ("t3", 1, "处理中", 5, at(2)), ("t3", 2, "成功", 100, at(3)), ("t4", 1, "已暂停", 7, at(3))])
    land(spark, folder, "b", [("t1", 2, "处理中", 5, at(40)), ("t3", 3, "处理中", 0, at(41)), ("t5", 1, "处理中", 1, at(80))])
    got = run(spark, tmp_path)
    assert got == {"t1": ("已中断", 10, 2), "t2": ("已中断", 50, 1), "t3": ("成功", 100, 2), "t4": ("已暂停", 7, 1), "t5": ("处理中", 1, 1)}
    assert run(spark, tmp_path) == got  # nothing new
    land(spark, folder, "c", [("t2", 2, "处理中", 60, at(90)), ("t4", 2, "待处理", 3, at(91)), ("t6", 1, "处理中", 2, at(92))])
    got = run(spark, tmp_path)
    assert got["t2"] == ("处理中", 60, 2) and got["t4"] == ("待处理", 7, 2) and got["t6"] == ("处理中", 2, 1)
    changes = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.task_id, r.status) for r in changes.filter("task_id = 't2'").collect()} == {("t2", "处理中"), ("t2", "已中断")}
    assert {r.status: (r.n, r.retryable) for r in S.recovered(S.stored(spark, str(tmp_path / "checkpoint"))).collect()}["已中断"] == (1, 1)


def test_batches_equal_a_loop(spark, tmp_path):
    rng = random.Random(3)
    moves = [(f"t{rng.randrange(12)}", i, rng.choice(["处理中"] * 6 + ["成功", "失败", "已暂停"]), rng.randrange(100), at(i)) for i in range(200)]
    for k in range(4):
        land(spark, str(tmp_path / "in"), f"p{k}", moves[k * 50 : k * 50 + 50])
    want = {}
    for t, _, status, p, _ in moves:
        now = want.get(t, ("待处理", 0, 0))
        if now[0] not in S.TERMINAL:
            want[t] = (status, max(now[1], p), now[2] + 1)
    assert run(spark, tmp_path, silence=100_000) == want


def test_actions(spark):
    asked = [(a, s) for a in [*S.ACTIONS, "other", None] for s in ("待处理", "处理中", "已暂停", "已中断", "待确认", "成功", "失败", "已取消", None)]
    got = {(r.action, r.status): (r.next_status, r.allowed) for r in S.acted(spark.createDataFrame(asked, "action string, status string")).collect()}
    for a, s in asked:
        states, to = S.ACTIONS.get(a, ((), None))
        assert got[a, s] == ((to, True) if s in states else (s, False))
    assert S.acted(spark.createDataFrame(asked, "action string, status string").limit(0)).select(F.count("*")).first()[0] == 0
