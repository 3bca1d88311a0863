"""Functions, operators and streams on small cases."""

import pytest
from docengine.functions import arrays, maths, nulls, temporal, text
from docengine.operators import layout, relational as R
from docengine.streaming import logs
from pyspark.sql import functions as F


def one(spark, column, **values):
    row = {k: v for k, v in values.items()} or {"x": 1}
    return spark.createDataFrame([row]).select(column.alias("v")).first().v


@pytest.mark.parametrize(("name", "want"), [("CON.docx", "_CON.docx"), ("nul.txt", "_nul.txt"), ("normal.docx. ", "normal.docx"), ("C:\\folder\\课件.docx", "课件.docx"), ("a/b:c?.txt", "b_c_.txt"), ("...", "_")])
def test_safe_names(spark, name, want):
    assert one(spark, text.safe_file_name("n"), n=name) == want


def test_text(spark):
    assert one(spark, text.clean_text("x"), x=" a&amp;lt;b\u3000c\n") == "a&lt;b c"
    assert one(spark, text.unescape(text.escape("x")), x="<a href=\"x\">'&amp;'") == "<a href=\"x\">'&amp;'"
    assert one(spark, text.redact_paths("x"), x=r"open C:\u\me\a.docx and /home/me/b.txt, /x") == "open a.docx and b.txt, /x"
    assert one(spark, text.display_width("x"), x="ab中文！") == 8
    assert [one(spark, text.resolve_part(F.lit("word/document.xml"), F.lit(t))) for t in ("media/a.png", "/ppt/x.xml", "../y.xml", "../../z", "#frag", "./a/../b.xml")] == ["word/media/a.png", "ppt/x.xml", "y.xml", None, "word/document.xml", "word/b.xml"]
    assert [one(spark, text.column_letters(F.lit(n))) for n in (1, 26, 27, 702, 703, 16384)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert one(spark, text.heading_level(F.lit("Heading 3"), F.lit(5))) == 3 and one(spark, text.heading_level(F.lit(""), F.lit(1))) == 1
    assert one(spark, text.tag_count("x", "p"), x="<w:p><w:pPr/></w:p><p/>") == 2
    assert [one(spark, text.script_of(F.lit(t))) for t in ("zh-TW", "zh-SG", "zh", "az-Cyrl", "zh-Hans-TW", "EN_us", "ru", "ja")] == ["Hant", "Hans", None, "Cyrl", "Hans", "Latn", None, "Jpan"]
    assert one(spark, text.alias_of(F.lit(" WIN "), {"win": "windows"}, "other")) == "windows"
    assert one(spark, text.id_list(F.lit("a, b,,a"))) == ["a", "b"]
    assert one(spark, text.pdf_escape(F.lit("(中)"))) == "\\(?\\)"


def test_references_equal_the_library(spark):
    import html
    import random

    rng = random.Random(1)
    names = [*html.entities.html5, "amp", "bogus", "notit", "eacutes"]
    bits = ["&", ";", " ", "#", "x", "a", "é", "<", "\n"]
    said = ["".join(rng.choice([f"&{rng.choice(names)}", f"&#{rng.choice([0, 9, 13, 38, 128, 150, 159, 233, 8364, 55296, 64976, 65534, 128512, 1114111, 1114112, 10**12, 10**20])};", f"&#x{rng.choice(['26', 'E9', '1f600', 'D800', '110000', '0', 'ffffffffffffffff', '000000000000041'])}", rng.choice(bits)]) for _ in range(8)) for _ in range(400)]
    said += ["caf&eacute; &#233; &copy;", "&amp;lt;", "&copy中文;", "&", "", "&#;", "&#x;", "no"]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, x string").select("i", text.unescape("x").alias("y")).collect()
    for r in rows:
        assert r.y == html.unescape(said[r.i]).encode("utf-8", "replace").decode(), said[r.i]


def test_numbers(spark):
    assert one(spark, maths.half_up(F.lit("0.125"), 100)) == 13 and one(spark, maths.half_up(F.lit("-0.125"), 100)) == -13
    assert one(spark, maths.angle_60000(F.lit(-90))) == 16_200_000
    assert [one(spark, maths.to_emu(F.lit(x))) for x in ("1in", "2.5cm", "12pt", "96", "50%", "")] == [914400, 900000, 152400, 0, 0, 0]
    assert str(one(spark, maths.finite_decimal(F.lit("12345678901234567890.123")))).startswith("12345678901234567890.123")
    assert [one(spark, maths.finite_decimal(F.lit(x))) for x in ("NaN", "Infinity", "abc", "")] == [None] * 4
    assert [one(spark, nulls.safe_int(F.lit(x))) for x in ("7", "-3", "junk", None)] == [7, 0, 0, 0]


def test_times(spark):
    assert [one(spark, temporal.duration_label(F.lit(n))) for n in (5, 65, 3725)] == ["5秒", "1分5秒", "1小时2分5秒"]
    assert one(spark, temporal.expired(F.lit(None).cast("timestamp"), F.current_timestamp())) is False


def test_arrays(spark):
    assert one(spark, arrays.padded(F.array(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("c"))))) == [["a", ""], ["b", "c"]]
    assert one(spark, arrays.dense(F.create_map(F.lit(0), F.lit("0"), F.lit(2), F.lit("98")))) == ["0", "", "98"]
    assert one(spark, arrays.merged(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))) == {"a": 1, "b": 3}


def test_overlays(spark):
    items = spark.createDataFrame([(1, "x", 7), (2, "y", 8)], "id int, latex string, file_id int")
    notes = spark.createDataFrame([(1, ""), (2, "z")], "id int, latex string")
    assert {r.id: r.latex for r in R.overlaid(items, notes, "id", ["latex"]).collect()} == {1: "x", 2: "z"}
    assert {r.file_name for r in R.named(items, spark.createDataFrame([(7, "f")], "file_id int, file_name string")).collect()} == {"f", "8"}


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, v string, created int")
    new = spark.createDataFrame([(2, "c", 99), (3, "d", 30)], "id int, v string, created int")
    once = R.upsert(old, new, ["id"], ["created"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 10), (2, "c", 20), (3, "d", 30)]
    assert sorted(map(tuple, R.upsert(once, new, ["id"], ["created"]).collect())) == sorted(map(tuple, once.collect()))


def test_ancestors(spark):
    rows = [(0, None)] + [(i, i - 1) for i in range(1, 40)] + [(100, 999)]
    got = {r.id: (r.root, r.depth) for r in R.ancestors(spark.createDataFrame(rows, "id int, parent_id int")).collect()}
    assert got[39] == (0, 39) and got[0] == (0, 0) and got[100][0] is None
    with pytest.raises(Exception, match="cycle"):
        R.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent_id int")).collect()


def test_pages_lose_nothing(spark):
    blocks = [(1, 0, "标题" * 20), (1, 1, "x" * 412), (1, 2, ""), (2, 0, "y" * 60)]
    got = layout.budget_pages(spark.createDataFrame(blocks, "doc_id int, pos int, text string"), 60).orderBy("doc_id", "page", "pos").collect()
    for d in (1, 2):
        assert "".join(r.piece for r in got if r.doc_id == d) == "".join(t for i, _, t in blocks if i == d)
    by = {}
    for r in got:
        by[r.doc_id, r.page] = by.get((r.doc_id, r.page), 0) + len(r.piece)
    assert max(by.values()) <= 60


def test_merge_pages():
    assert layout.merge_pages([1] * 25, [], 12) == [(0, 12), (12, 24), (24, 25)]
    assert layout.merge_pages([1] * 25, [(10, 5)], 12) == [(0, 10), (10, 22), (22, 25)]
    assert layout.merge_pages([1] * 30, [(0, 20)], 12) == [(0, 20), (20, 30)]
    assert layout.spread_deficit([10, 10, 10], 35) == [12, 12, 11]


def test_regions(spark):
    cells = spark.createDataFrame([(1, 1), (5, 2), (130, 2), (700, 9)], "row int, col int")
    regions = spark.createDataFrame([(1, 1, 1, 5, 2), (2, 4, 2, 600, 3)], "id int, top int, left int, bottom int, right int")
    assert {(r.row, r.region) for r in R.within_regions(cells, regions, []).collect()} == {(1, 1), (5, 1), (130, 2), (700, None)}


def test_task_states(spark, tmp_path):
    e = [("a", 1, "处理中", 10), ("a", 3, "成功", 100), ("a", 2, "处理中", 50), ("a", 4, "处理中", 60), ("b", 1, "处理中", 30), ("b", 2, "已暂停", 20), ("b", 2, "已暂停", 20)]
    events = spark.createDataFrame(e, logs.EVENT)
    want = {("a", "成功", 100, 3), ("b", "已暂停", 30, 2)}
    assert {tuple(r) for r in logs.task_states_batch(events).collect()} == want
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = logs.task_states(spark.readStream.schema(logs.EVENT).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select * from states").collect()} == want


def test_log_gate_and_windows(spark, tmp_path):
    rows = [(i, "t", "m", level, cat) for i, (level, cat) in enumerate([("debug", "macro"), ("info", "macro"), ("error", "system"), ("info", None), (None, "system")])]
    df = spark.createDataFrame(rows, "id long, task_id string, message string, level string, category string").withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id)"))
    assert {r.id for r in logs.gated(df, {}).collect()} == {1, 2, 3, 4}
    assert {r.id for r in logs.gated(df, {"logMacro": "false", "logLevel": "error"}).collect()} == {2}
    assert logs.gated(df, {"keepHistory": "false"}).count() == 0
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    logs.append(logs.gated(logs.read_logs(spark, str(tmp_path / "in")), {}), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    q = logs.rollup(logs.read_logs(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("rolled").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) as n from rolled").first().n == 5


def test_sql_functions_equal_the_library(spark):
    from docengine.functions import surface

    surface.register(spark)
    numbers = spark.range(1, 16385).select(F.col("id").alias("n"), F.expr("column_letters(id)").alias("a"), text.column_letters("id").alias("b"))
    assert numbers.filter("a <> b or column_number(a) <> n").count() == 0
    targets = ["media/a.png", "/ppt/x.xml", "../y.xml", "../../z", "#frag", "./a/../b.xml", "", "..", "a//b", None]
    df = spark.createDataFrame([(b, t) for b in ("word/document.xml", "top.xml", "a/b/c.xml") for t in targets], "base string, target string")
    assert df.filter(~F.expr("resolve_part(base, target)").eqNullSafe(text.resolve_part("base", "target"))).count() == 0
    assert spark.sql("SELECT base_name('C:\\\\u\\\\x.docx'), base_name('/a/b')").first() == ("x.docx", "b")
    bad = spark.sql("SELECT * FROM zip_parts(TABLE(SELECT 'n' AS name, x'00' AS content) PARTITION BY name)").collect()
    assert len(bad) == 1 and bad[0].archive == "n" and bad[0].error


def test_ranks_and_progress_of_hot_keys(spark):
    import random

    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None, "b"]), i, rng.randrange(50)) for i in range(600)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, at int, v int")
    want = {}
    for k, at, v in sorted(rows, key=lambda r: r[1]):
        n, most = want.get(k, (0, [], 0))[0], want.get(k, (0, [], -1))[2]
        want[k] = (n + 1, [*want.get(k, (0, [], 0))[1], (at, n + 1, max(most, v))], max(most, v))
    flat = sorted((str(k), *x) for k, (_, xs, _) in want.items() for x in xs)
    ranks = {(r.k, r.at): r["rank"] for r in layout.ranked(df, ["k"], ["at"]).collect()}
    got = layout.monotone(df, "k", ["at"], "v").collect()
    assert sorted((str(r.k), r["at"], ranks[r.k, r["at"]], r.progress) for r in got) == flat
