"""Report building, ingest, redaction, verification, reconciliation."""

import datetime

import pytest
from docengine import schemas as S
from docengine.plans import report_build as B
from docengine.plans import workbench as W
from docengine.sources import ooxml, writers


@pytest.fixture(scope="module")
def report(spark):
    now = datetime.datetime(2024, 1, 1)
    return {
        "reports": spark.createDataFrame([("r", "t", "convert", now, 1), ("b", "t2", "batch_process", now, 2), ("e", "t3", "convert", now, 3)], S.REPORTS),
        "files": spark.createDataFrame([("r", "f1", "a.docx", ["坏"], False), ("r", "f2", "b.docx", [], True), ("r", "f3", "c.docx", None, None), ("r", "f4", "d.docx", [], False), ("b", "g", "g.docx", [], False)], S.REPORT_FILES),
        "artifacts": spark.createDataFrame([("r", "f2", "o", "p", "待本地客户端执行", 1, "", now), ("r", "f3", "o3", "p", None, 1, "", now), ("r", "f1", "o1", "p", "local_execution_cancelled", 1, "", now), ("r", "f4", "o4", "p", "成功", 1, "", now), ("r", "", "x", "p", "失败", 1, "", now)], S.ARTIFACTS),
        "image_errors": spark.createDataFrame([("r", None, "m")], S.IMAGE_ERRORS),
        "batch": spark.createDataFrame([("b", "g", "成功", False), ("b", "h", "成功", None), ("b", "i", "失败", False), ("b", "j", "成功", True)], S.BATCH),
        "formulas": spark.createDataFrame([("r", "x1", "f1", 1, "", "OMML", "a", None, 80, "成功", "已格式化"), ("r", "x2", "f1", 1, "", "OMML", "b", None, None, "待确认", "")], S.FORMULAS),
        "macros": spark.createDataFrame([("r", "m1", "Run", 1, "f1", "失败", "stop", True), ("r", "m2", "Go", 2, "f1", "待确认", "stop", False)], S.MACROS),
        "images": spark.createDataFrame([], S.IMAGES),
        "omml": spark.createDataFrame([("r", "d", "f1", "n", "已找到", "成功")], S.OMML),
    }


def test_counters(report):
    got = {r.report_id: r for r in B.counters(**report).collect()}
    r = got["r"]
    assert (r.success_count, r.fail_count, r.pending_count, r.cancelled_count) == (1, 2, 1, 0)
    assert r.success_count + r.fail_count + r.pending_count + r.cancelled_count == r.file_count
    assert r.failed_file_ids == ["f1", "f3"]
    assert (r.formula_count, r.omml_converted_count, r.low_confidence_count, r.macro_fail_count, r.macro_queued_count, r.artifact_count, r.artifact_failure_count) == (2, 1, 1, 1, 1, 1, 2)
    assert (got["b"].success_count, got["b"].fail_count, got["b"].batch_skipped_count) == (3, 1, 1)
    assert got["e"].success_count == 0 and got["e"].failed_file_ids == []


def test_failures_and_json(report):
    rows = B.failures(report["files"], report["artifacts"], report["image_errors"], report["macros"], report["omml"])
    got = {(r.category, r.file_id, r.status) for r in rows.collect()}
    assert got == {("文件校验", "f1", "失败"), ("输出文件", "f3", ""), ("输出文件", "", "失败"), ("图片提取", None, "失败"), ("宏执行", "f1", "失败"), ("公式依赖", "f2", "缺失")}
    j = {r.report_id: r.json for r in B.report_json(B.counters(**report), rows, report["formulas"]).collect()}
    assert '"failureRows"' in j["r"] and '"latex":"a"' in j["r"]


def test_ingest(spark):
    word = writers.docx([{"text": "x", "level": 1}])
    rows = [("/in/CON.docx", bytearray(word)), ("/in/a.pdf", bytearray(b"%PDF-1.4 %%EOF")), ("/in/b.pdf", bytearray(b"%PDF")), ("/in/c.docx", bytearray(b"zz")), ("/in/d.doc", bytearray(b"")), ("/in/e.xyz", bytearray(b"1"))]
    f = spark.createDataFrame(rows, "path string, content binary")
    got = {r.file_path[4:]: (r.file_name, r.file_type, r.validation_errors) for r in W.ingest(f).collect()}
    assert got["CON.docx"] == ("_CON.docx", "Word", []) and got["a.pdf"][2] == [] and got["b.pdf"][2] == ["PDF 不完整"]
    assert got["c.docx"][2] == ["内容与扩展名不符"] and got["d.doc"][2] == ["空文件", "旧版文件头无效"] and got["e.xyz"][2] == ["不支持的类型"]
    assert W.object_summary(f.limit(1)).first().paragraphs == 1
    names = spark.createDataFrame([("1", "a.b.docx"), ("2", "a.b.docx"), ("3", "x")], "id string, file_name string")
    assert [r.file_name for r in W.renamed(names).orderBy("id").collect()] == ["a.b.docx", "a.b-1.docx", "x"]


def test_verification(spark):
    t0, t1 = datetime.datetime(2024, 1, 1), datetime.datetime(2024, 1, 2)
    import hashlib

    h = hashlib.sha256(b"x").hexdigest()
    want = spark.createDataFrame([("/o/a", 1, h, t0), ("/o/b", 2, h, t0), ("/p/c", 1, h, t0), ("/o/d", 1, h, t1), ("/o/e", 1, "zz", t0), ("/o/f", 1, h, t0)], "path string, size long, sha256 string, started_at timestamp")
    found = spark.createDataFrame([(p, t0, bytearray(b"x")) for p in ("/o/a", "/o/b", "/p/c", "/o/d", "/o/e")], "path string, modificationTime timestamp, content binary")
    ok, bad = W.verified(want, found, "/o")
    assert [r.path for r in ok.collect()] == ["/o/a"]
    assert {r.path: r.reason for r in bad.collect()} == {"/o/b": "changed", "/p/c": "outside", "/o/d": "stale", "/o/e": "bad digest", "/o/f": "missing"}


def test_images_and_tex(spark):
    rows = [("r", str(i), "f", 1, "", w, h, "", 0, True, i == 1, False, False, False, "h" if i < 2 else "i", "") for i, (w, h) in enumerate([(96, 96), (10, 10), (97, 10)])]
    df = spark.createDataFrame(rows, S.IMAGES)
    assert {r.id for r in W.small_images(df).collect()} == {"0", "1"} and {r.id for r in W.small_images(df, header_footer=False).collect()} == {"0"}
    assert {r.id: r.is_duplicate for r in W.marked_duplicates(df).collect()} == {"0": True, "1": True, "2": False}
    tex = spark.createDataFrame([("d", r"a $x$ \(y\) $$z$$ \begin{align}q\end{align} \$5 \[w\]")], "doc_id string, text string")
    assert [r.latex for r in W.tex_formulas(tex).orderBy("pos").collect()] == ["$x$", r"\(y\)", "$$z$$", r"\begin{align}q\end{align}", r"\[w\]"]


def test_locations(spark):
    r = writers.rels
    parts = {"_rels/.rels": r([("rId1", "officeDocument", "word/document.xml")]), "word/document.xml": "<x/>", "word/_rels/document.xml.rels": r([("rId1", "image", "media/a.png"), ("rId2", "header", "header1.xml")]), "word/header1.xml": "<x/>", "word/_rels/header1.xml.rels": r([("rId1", "image", "media/a.png")]), "word/media/a.png": "1"}
    f = spark.createDataFrame([("p.docx", bytearray(writers.zipped(parts)))], "path string, content binary")
    e = ooxml.read_relations(f)
    assert W.image_locations(e, W.part_labels(e)).first().locations == ["正文 · word/document.xml", "页眉 · word/header1.xml"]


def test_tasks(spark):
    tasks = spark.createDataFrame([("t1", "macro_run", None, ["a", "b"], None, "待处理", 0, None, None, None, None), ("t2", "convert", None, ["c"], None, "处理中", 0, None, None, None, None)], S.TASKS)
    assert {r.id: r.action for r in W.planned_actions(tasks, []).collect()} == {"t1": "wait", "t2": "skip"}
    results = spark.createDataFrame([("t1", "a", "失败", 1), ("t1", "a", "成功", 2), ("t1", "b", "成功", 1), ("zz", "q", "成功", 1)], "task_id string, file_id string, status string, seq int")
    assert {tuple(r) for r in W.reconciled(tasks, results).collect()} == {("t1", 2, 0, 0, "成功"), ("t2", 0, 0, 1, "处理中")}
    assert tuple(W.recovery(tasks).first()) == (1, 0, 0, 1)
    users = spark.createDataFrame([("u", "viewer", None), ("v", "x", ["b", "a", "b"])], "id string, role string, permissions array<string>")
    assert {r.id: r.permissions for r in W.permissions(users, {"viewer": ["read"]}).collect()} == {"u": ["read"], "v": ["b", "a"]}
    saved = spark.createDataFrame([("a", "2"), ("zz", "9"), ("k", "off")], "key string, value string")
    assert {r.key: r.value for r in W.settings(saved, {"a": "1", "b": "1", "k": "on"}, {"k": "on"}).collect()} == {"a": "2", "b": "1", "k": "on"}
    assert W.preserved(spark.createDataFrame([("table",), ("p",)], "kind string"), tables=False).count() == 1
