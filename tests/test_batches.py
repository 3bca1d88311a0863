"""Files made and read in common batches: many small ones are few batches, and large groups, bad files and nulls are as they were."""

from docengine.sources import archive, writers
from pyspark.sql import functions as F


def test_small_files_share_batches(spark):
    files = spark.range(5000, numPartitions=1).select(F.col("id").cast("string").alias("path"), F.encode(F.lit("x"), "UTF-8").alias("content"))

    def parse(name, content):
        if name == "7":
            raise ValueError("bad")
        yield name, len(content), None

    got = archive.per_file(files, parse, "doc_id string, size int, error string")
    batches = got.mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), got.schema).count()
    assert batches <= 10 and got.count() == 5000
    assert [tuple(r) for r in got.filter("error is not null").collect()] == [("7", None, "ValueError: bad")]


def test_groups_in_order_over_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(3000).select(F.when(F.col("id") < 100, F.lit(None)).otherwise(F.col("id") % 40).alias("k"), (F.lit(3000) - F.col("id")).alias("pos"))
        made = writers.per_group(rows, "k", ["pos"], lambda rs: ",".join(str(r["pos"]) for r in rs).encode(), str)
        got = {r["name"]: bytes(r["content"]).decode() for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for i in sorted(range(3000), reverse=True):
        want.setdefault("None" if i < 100 else str(i % 40), []).append(str(3000 - i))
    assert got == {k: ",".join(v) for k, v in want.items()}
    assert "FlatMapGroups" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_a_tables_width_is_found_once():
    """Reading a table takes time in proportion to its cells, not to its cells times its rows."""
    import time

    from docengine.sources import ooxml

    def seconds(n):
        made = writers.docx([{"tbl": [[f"{i}", "", "x"] for i in range(n)]}])
        start = time.perf_counter()
        (block,) = ooxml.docx_blocks("t.docx", made)
        assert block[6][n - 1] == [f"{n - 1}", "", "x"]
        return time.perf_counter() - start

    assert seconds(4000) < 14 * min(seconds(500) for _ in range(3))


def test_files_are_dealt_out_after_a_window_by_their_key(spark):
    """Rows that already lie by the key aren't left in the few tasks that their bytes ask for."""
    from pyspark.sql import Window

    rows = spark.range(400).select((F.col("id") % 80).alias("k"), F.col("id").alias("pos"))
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("pos")))
    made = writers.per_group(ranked, "k", ["pos"], lambda rs: ",".join(str(r["pos"]) for r in rs).encode(), str)
    got = made.withColumn("task", F.spark_partition_id()).groupBy("name").agg(F.count("*").alias("n"), F.first("task").alias("task"), F.first("content").alias("content")).collect()
    assert len(got) == 80 and all(r["n"] == 1 and bytes(r["content"]) == b"1,2,3,4,5" for r in got)
    assert len({r["task"] for r in got}) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_slides_tags_are_counted_in_one_walk(monkeypatch):
    from docengine.sources import ooxml

    made = writers.pptx([{"title": "t", "body": [f"line {i}" for i in range(50)], "notes": ["n"], "tables": [], "charts": []}] * 5)
    asked, plain = [], ooxml.local
    monkeypatch.setattr(ooxml, "local", lambda node: asked.append(1) or plain(node))
    got = list(ooxml.pptx_slides("d", made))
    assert [(x[2], len(x[3]), x[4], x[5], x[6], x[7], x[10]) for x in got] == [("t", 50, ["n"], 2, 2, 0, 0)] * 5
    assert len(asked) < 5 * 50  # before, five times for each of a slide's 200 nodes


def test_a_plain_tables_cells_are_written_and_read_at_once(spark, monkeypatch):
    """A table without merges makes no walk for every cell, reads as before, and merges, blanks and short rows are as they were."""
    from docengine.plans import conversions as C
    from docengine.sources import ooxml

    tbl = [[f"{i % 3}" if j == i % 20 else "" for j in range(20)] for i in range(50)]
    asked, plain = [], ooxml.first
    monkeypatch.setattr(ooxml, "first", lambda *a: asked.append(1) or plain(*a))
    (block,) = ooxml.docx_blocks("t.docx", writers.docx([{"tbl": tbl}]))
    assert block[6] == tbl and block[7] == [] and len(asked) < 100  # before, twice a cell
    merged = [["a", "", "b"], ["", "", "c\nd"]]
    (block,) = ooxml.docx_blocks("t.docx", writers.docx([{"tbl": merged, "merges": [[0, 0, 2, 2]]}]))
    assert block[6] == merged and block[7] == [[0, 0, 2, 2]]
    w = f'xmlns:w="{writers.NS["w"]}"'
    cell = lambda *ps: f"<w:tc>{''.join(f'<w:p><w:r><w:t>{p}</w:t></w:r></w:p>' if p else '<w:p/>' for p in ps)}</w:tc>"
    markup = f"<w:document {w}><w:body><w:tbl><w:tr>{cell('x', '', 'y')}{cell('')}</w:tr><w:tr>{cell('z')}</w:tr></w:tbl></w:body></w:document>"
    for encoding in ("utf-8", "utf-16"):
        (block,) = ooxml.docx_blocks("t.docx", writers.zipped({"word/document.xml": f'<?xml version="1.0" encoding="{encoding}"?>{markup}'.encode(encoding)}))
        assert block[6] == [["x\ny", ""], ["z", ""]] and block[7] == []
    # a sheet of 70 columns is two tables; cells are shuffled once
    cells = spark.createDataFrame([("d", 1, r, c, f"{r}.{c}") for r in (9, 2) for c in range(3, 73) if (r + c) % 2 or c > 70], "doc_id string, sheet_index int, row int, col int, value string")
    made = C.sheet_tables(cells)
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    parts = {r.part: [list(x) for x in r.tbl] for r in made.collect()}
    assert [[len(x) for x in parts[p]] for p in (0, 1)] == [[61] * 3, [11] * 3] and parts[0][0][:2] == ["行号", "C"]
    assert parts[0][1][:3] == ["2", "2.3", ""] and parts[0][2][:3] == ["9", "", "9.4"] and parts[1][1][-2:] == ["2.71", "2.72"]


def test_nested_columns_as_python_values():
    import pyarrow as pa

    b = pa.record_batch({"k": pa.array(["a", None, "c"]), "t": pa.array([[["x", None], None, []], None, [["y"]]], pa.list_(pa.list_(pa.string()))), "n": pa.array([1, None, 3]), "s": pa.array([[{"a": "x"}], None, []])})
    for i in range(3):
        assert list(writers._rows(b.slice(i, 2))) == b.slice(i, 2).to_pylist()
