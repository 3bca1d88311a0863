"""Growing folders and ageing tables over a store."""

import datetime
import hashlib

import pytest
from docengine.plans import workbench as W
from docengine.sources.store import Store
from docengine.streaming import ingest
from docengine.streaming.retention import DayTable


def test_two_runs_over_a_growing_folder(spark, tmp_path):
    folder, store = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    put = lambda **f: [(folder / k.replace("_", ".")).write_bytes(v) for k, v in f.items()]
    run = lambda: ingest.follow(ingest.landed(spark, str(folder), most_bytes=100, files_a_batch=2), store, str(tmp_path / "cp"), W.ingest).awaitTermination()
    put(a_pdf=b"%PDF-1 x %%EOF", b_docx=b"not a zip", c_pdf=b"%PDF-1 x %%EOF", big_png=b"x" * 101)
    run()
    put(d_docx=b"not a zip", e_xyz=b"e", f_xyz=b"")
    run()
    run()
    files = {r.sha256: r for r in store.read("files").collect()}
    want = {hashlib.sha256(x).hexdigest() for x in (b"%PDF-1 x %%EOF", b"not a zip", b"e")}
    assert set(files) == want and store.read("files").count() == 3
    assert {bytes(r.content) for r in store.read("contents").collect()} == {b"%PDF-1 x %%EOF", b"not a zip", b"e"} and store.read("contents").count() == 3
    assert sorted(r.file_path.rsplit("/", 1)[-1] for r in store.read("arrivals").collect()) == ["a.pdf", "b.docx", "c.pdf", "d.docx", "e.xyz"]
    before = store.latest()[0]
    batch = spark.createDataFrame([("/x/f.pdf", b"new")], "path string, content binary")
    assert not ingest.register(store, batch, 0, W.ingest, f"batches of {tmp_path / 'cp'}") and store.latest()[0] == before  # a repeated batch
    assert ingest.register(store, batch, 0, W.ingest, "another stream") and store.read("files").count() == 4


def test_retention(spark, tmp_path):
    t = DayTable(Store(spark, str(tmp_path)), "logs")
    at = lambda d, h: datetime.datetime(2024, 1, d, h)
    rows = [(i, at(d, h)) for i, (d, h) in enumerate([(1, 0), (1, 23), (2, 5), (2, 12), (2, 13), (3, 0), (5, 9)])]
    t.append(spark.createDataFrame(rows[:4], "id long, created_at timestamp"))
    t.append(spark.createDataFrame(rows[4:], "id long, created_at timestamp"))
    assert t.read().count() == 7 and t.read(since=datetime.date(2024, 1, 3)).count() == 2
    kept = {n: s for n, s in t.store.current().items() if n.endswith(("03", "05"))}
    assert t.retain(at(9, 12), 7) == {"days_dropped": 1, "days_rewritten": 1, "rows_deleted": 4}
    assert sorted(r.id for r in t.read().collect()) == [4, 5, 6]
    assert {n: s for n, s in t.store.current().items() if n.endswith(("03", "05"))} == kept  # other days aren't touched
    assert t.retain(at(10, 11), 0) is None and t.store.notes()["logs lastCleanupAt"] == "2024-01-09T12:00:00"
    assert t.retain(at(10, 12), 7) == {"days_dropped": 1, "days_rewritten": 1, "rows_deleted": 2}
    t.vacuum(1)
    assert t.read().count() == 1 and not list(tmp_path.glob("logs/s-*/day=2024-01-01"))
    with pytest.raises(ValueError, match="without created_at"):
        t.append(spark.createDataFrame([(1, None)], "id long, created_at timestamp"))
    assert t.retain(at(20, 0), 0)["days_dropped"] >= 1
    with pytest.raises(ValueError, match="no such days"):
        t.read()
