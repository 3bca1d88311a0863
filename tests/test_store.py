import random

import pytest
from docengine.operators.upkeep import Report, rollup
from docengine.sources.store import Conflict, Store, read_json_objects
from pyspark.sql import functions as F


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    row = lambda *r: spark.createDataFrame([r], "id string, v int, created_at string, seq int")
    s.save("tasks", row("a", 1, "2024-01-01", 1), ["id"])
    s.save("tasks", row("b", 2, "2024-01-02", 2), ["id"])
    s.save("tasks", row("a", 3, "2024-01-03", 3), ["id"], ["created_at"])
    assert [(r.id, r.v, r.created_at) for r in s.newest("tasks").collect()] == [("b", 2, "2024-01-02"), ("a", 3, "2024-01-01")]
    s.save("tasks", spark.createDataFrame([("c", "note")], "id string, extra string"), ["id"])
    assert s.read("tasks").filter("id = 'c'").first().extra == "note" and s.read("tasks").count() == 3
    s.save("logs", spark.createDataFrame([("a", 1), ("b", 2)], "task_id string, n int"), ["n"])
    assert s.cascade({"tasks": "id", "logs": "task_id"}, spark.createDataFrame([("a",)], "id string"), "id") == {"tasks": 1, "logs": 1}
    assert s.read("tasks").count() == 2 and s.read("logs").count() == 1
    s.delete("logs", spark.createDataFrame([(2,)], "n int"), "n")
    assert s.read("logs").count() == 0
    s.compact("tasks")
    s.vacuum("tasks", 1)
    assert len(s.versions("tasks")) == 1
    (tmp_path / "tasks" / "s-99").mkdir()  # a write that never ended
    assert s.read("tasks").count() == 2
    staged = {n: s.stage(n, s.read(n).limit(0)) for n in ("tasks", "logs")}  # a cascade that broke off before its commit
    assert s.read("tasks").count() == 2
    s.publish(staged)
    assert s.read("tasks").count() == 0 and s.read("logs").count() == 0
    s.vacuum("tasks", 1)
    assert s.exists("tasks") and not s.exists("other")


KV = "k long, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), KV)


def content(df):
    return sorted(map(tuple, df.select("k", "v").collect()), key=repr)


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("t", rows(spark, (1, "a"), (2, "b"), (3, "c"), (None, "n")))
    late = s.begin()
    assert content(late.read("t"))[0] == (1, "a")
    s.save("t", rows(spark, (1, "A")), ["k"])  # another writer, after late has read
    late.save("t", rows(spark, (2, "B"), (4, "D")), ["k"])
    late.commit()
    assert content(s.read("t")) == [(1, "A"), (2, "B"), (3, "c"), (4, "D"), (None, "n")]
    late = s.begin()
    s.save("t", rows(spark, (3, "C")), ["k"])
    late.save("t", rows(spark, (3, "lost?"), (5, "E")), ["k"])
    with pytest.raises(Conflict):
        late.commit()
    assert content(s.read("t")) == [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (None, "n")]
    for mine, other in (("delete", "save"), ("save", "delete"), ("write", "save"), ("save", "write")):
        late = s.begin()
        getattr(s, other)("t", *{"save": (rows(spark, (4, other + mine)), ["k"]), "delete": (rows(spark, (4, "")), "k"), "write": (rows(spark, (4, "w")),)}[other])
        if mine == "write":
            late.put("write", "t", s.stage("t", rows(spark, (9, "x"))))
        else:
            getattr(late, mine)("t", *{"save": (rows(spark, (4, "m")), ["k"]), "delete": (rows(spark, (4, "")), "k")}[mine])
        with pytest.raises(Conflict):
            late.commit()
    assert content(s.read("t")) == [(4, "w")]


def test_both_may_delete_and_compaction_rebases(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("t", rows(spark, *[(i, "x") for i in range(6)]))
    s.save("t", rows(spark, (0, "y")), ["k"])
    late = s.begin()
    late.put("compact", "t", s.stage("t", late.read("t")))
    s.delete("t", rows(spark, (1, "")), "k")
    with s.begin() as tx:
        s.save("t", rows(spark, (2, "z")), ["k"])
        tx.delete("t", rows(spark, (1, ""), (3, "")), "k")
    late.commit()
    assert content(s.read("t")) == [(0, "y"), (2, "z"), (4, "x"), (5, "x")]
    assert [x["kind"] for x in s.current()["t"]] == ["rows", "gone", "rows", "gone"]
    again = s.begin()
    s.compact("t")
    again.put("compact", "t", s.stage("t", again.read("t")))
    with pytest.raises(Conflict):
        again.commit()
    with pytest.raises(RuntimeError, match="stop"), s.begin() as tx:
        tx.save("t", rows(spark, (0, "never")), ["k"])
        raise RuntimeError("stop")
    assert content(s.read("t"))[0] == (0, "y")


def test_an_upsert_writes_what_it_changes(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.write("t", spark.range(10_000).select(F.col("id").alias("k"), F.concat(F.lit("value "), F.col("id").cast("string")).alias("v")))
    first = s.current()["t"]
    s.save("t", s.read("t").filter("k % 100 = 7").withColumn("v", F.lit("new")), ["k"])
    now = s.current()["t"]
    assert now[0] == first[0] and len(now) == 2 and now[1]["rows"] == 100
    size = lambda seg: sum(f.stat().st_size for f in (tmp_path / seg["path"]).rglob("*.parquet"))
    assert size(now[1]) < 0.1 * size(now[0])
    assert s.read("t").count() == 10_000 and s.read("t").filter("v = 'new'").count() == 100
    assert s.read("t", at=1).filter("v = 'new'").count() == 0
    for i in range(3):
        s.save("t", s.read("t").filter(f"k % 3 = {i}").withColumn("v", F.lit(f"w{i}")), ["k"])
    assert len(s.current()["t"]) <= 2  # deltas of half the rows are folded in
    assert {r.v: r.n for r in s.read("t").groupBy("v").agg(F.count("*").alias("n")).collect()} == {"w0": 3334, "w1": 3333, "w2": 3333}


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng, s = random.Random(7), Store(spark, str(tmp_path), most_deltas=4)
    want = {i: f"a{i % 3}" for i in range(40)}
    s.write("t", rows(spark, *want.items()))
    report = Report(s, "r", "t", ["v"], {"ks": F.col("k")}, {"low": F.col("k")}, {"high": F.col("k")})
    report.build()
    for step in range(7):
        some = {rng.randrange(60): f"a{rng.randrange(5)}" for _ in range(8)}
        s.save("t", rows(spark, *some.items()), ["k"])
        want |= some
        gone = rng.sample(sorted(want), 4)
        s.delete("t", rows(spark, *[(k, "") for k in gone]), "k")
        want = {k: v for k, v in want.items() if k not in gone}
        if step % 3 == 2:
            s.compact("t")
        assert content(s.read("t")) == sorted(want.items(), key=repr)
        if step % 2:
            report.refresh()
            got, built = s.read("r"), rollup(s.read("t"), ["v"], *report.measures)
            assert sorted(map(tuple, got.select(*built.columns).collect())) == sorted(map(tuple, built.collect()))
    report.refresh()
    assert report.refresh() == 0  # nothing has changed since
    s.write("t", rows(spark, (1, "a1"), (2, "z")))
    report.refresh()
    assert sorted(map(tuple, s.read("r").select("v", "n", "ks", "low", "high").collect())) == [("a1", 1, 1, 1, 1), ("z", 1, 2, 2, 2)]


def test_commits_of_dead_writers_are_passed(spark, tmp_path):
    s = Store(spark, str(tmp_path), grace_seconds=0.5)
    s.write("t", rows(spark, (1, "a")))
    (tmp_path / "_manifest" / "2.json").write_text("{")  # its writer died
    assert content(s.read("t")) == [(1, "a")]
    s.save("t", rows(spark, (2, "b")), ["k"])
    assert content(s.read("t")) == [(1, "a"), (2, "b")] and s.manifests() == [1, 2]


def test_json_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1,\n "b": {"c": "x"}}')
    assert read_json_objects(spark, str(tmp_path / "a.json"), "a int, b struct<c:string>").first().b.c == "x"
    (tmp_path / "b.json").write_text("[oops")
    with pytest.raises(Exception):
        read_json_objects(spark, str(tmp_path / "b.json"), "a int").collect()


def test_written_tables_are_swept(spark):
    import os

    from docengine.operators import lineage

    before = lineage.written(spark.range(3))
    with lineage.scratch(spark) as keep:
        inner = lineage.written(spark.range(4))
        keep.append(lineage.written(inner))
    assert not os.path.exists(inner._written_path) and keep[0].count() == 4 and before.count() == 3
    lineage.sweep(spark, keep=(before,))
    assert before.count() == 3 and not os.path.exists(keep[0]._written_path)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from docengine.operators import lineage

    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Session)
