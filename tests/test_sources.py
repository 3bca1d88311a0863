"""Readers and writers on files made here."""

import struct
import zlib

import pytest
from docengine.functions import binary
from docengine.plans import conversions as C
from docengine.sources import archive, images, ooxml, pdf, vba, writers
from pyspark.sql import functions as F

FILES = "path string, content binary"


def files(spark, **named):
    return spark.createDataFrame([(k.replace("_", "."), bytearray(v)) for k, v in named.items()], FILES)


def sheet_package(sheets, extra=None, rels=None):
    """sheets: (title, body xml) in display order; stored under reversed numbers."""
    n = len(sheets)
    parts = {"xl/workbook.xml": f'<workbook xmlns="{writers.NS["s"]}" xmlns:r="{writers.NS["r"]}"><sheets>' + "".join(f'<sheet name="{t}" sheetId="{i}" r:id="rId{i}"/>' for i, (t, _) in enumerate(sheets, 1)) + "</sheets></workbook>"}
    parts["xl/_rels/workbook.xml.rels"] = writers.rels([(f"rId{i}", "worksheet", f"worksheets/sheet{n + 1 - i}.xml") for i in range(1, n + 1)] + (rels or []))
    for i, (_, body) in enumerate(sheets, 1):
        parts[f"xl/worksheets/sheet{n + 1 - i}.xml"] = f'<worksheet xmlns="{writers.NS["s"]}" xmlns:r="{writers.NS["r"]}">{body}</worksheet>'
    return writers.zipped(parts | (extra or {}))


def test_docx_round_trip(spark):
    blocks = [{"text": "标题", "level": 1}, {"text": "a <b> & c", "level": 0, "runs": [{"text": "a <b>", "b": True, "size": 24, "color": "FF0000"}, {"text": " & c"}]}, {"text": "", "tbl": [["x", "", "y"], ["", "", "z"]], "merges": [[0, 0, 2, 2]]}]
    got = ooxml.read_docx(files(spark, t_docx=writers.docx(blocks))).collect()
    assert [(r.kind, r.text, r.level) for r in got] == [("paragraph", "标题", 1), ("paragraph", "a <b> & c", 0), ("table", "x\t\ty\n\t\tz", 0)]
    assert got[1].runs[0].b and got[1].runs[0].size == 24 and got[1].runs[0].color == "FF0000" and not got[1].runs[1].b
    assert got[2].tbl == [["x", "", "y"], ["", "", "z"]] and got[2].merges == [[0, 0, 2, 2]]
    with pytest.raises(ValueError):
        writers.Merges([[0, 0, 2, 1]], 1, 1)


def test_tables_with_late_rows_and_broken_merges():
    ns = f'xmlns:w="{writers.NS["w"]}"'
    cell = lambda t, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    go, start = '<w:vMerge/>', '<w:vMerge w:val="restart"/>'
    rows = [cell("a", start) + cell("b"), '<w:trPr><w:gridBefore w:val="1"/></w:trPr>' + cell("c", go), cell("", go) + cell("", go), cell("d") + cell("", go), cell("", go) + cell("e", '<w:gridSpan w:val="2"/>')]
    grid, merges = ooxml.table_grid(ooxml.parse(f"<w:tbl {ns}>{''.join(f'<w:tr>{r}</w:tr>' for r in rows)}</w:tbl>".encode()))
    assert grid == [["a", "b", ""], ["", "c", ""], ["", "", ""], ["d", "", ""], ["", "e", ""]]
    # the second row begins in the second column, so nothing there goes on from "a"; "c" itself goes on for two rows
    assert merges == [[1, 1, 3, 1], [4, 1, 1, 2]]


def test_broken_files_are_rows(spark):
    got = ooxml.read_docx(files(spark, bad_docx=b"nothing")).collect()
    assert len(got) == 1 and got[0].error.startswith("BadZipFile")


def test_docx_without_namespaces_and_empty(spark):
    raw = writers.zipped({"word/document.xml": '<w:document><w:p><w:pStyle w:val="heading2"/><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p>'})
    got = ooxml.read_docx(files(spark, old_docx=raw, empty_docx=writers.docx([]))).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.text, r.level) for r in got] == [("empty.docx", "empty", 1), ("old.docx", "one", 2), ("old.docx", "two", 0)]


def test_pptx_round_trip_and_order(spark):
    slides = [{"title": "一", "body": ["b1", "b2"], "notes": ["n"]}, {"title": "二", "body": [], "notes": []}]
    got = ooxml.read_pptx(files(spark, s_pptx=writers.pptx(slides))).orderBy("idx").collect()
    assert [(r.title, r.body, r.notes, r.shape_count) for r in got] == [("一", ["b1", "b2"], ["n"], 2), ("二", [], [], 2)]


def test_packages_close(spark):
    f = files(spark, s_pptx=writers.pptx([{"title": "x", "notes": ["n"]}]))
    assert ooxml.invalid_packages(archive.entries(f), ooxml.read_relations(f), "pptx").count() == 0
    cut = files(spark, s_pptx=writers.zipped({"ppt/presentation.xml": "<x/>", "ppt/_rels/presentation.xml.rels": writers.rels([("rId1", "slide", "slides/slide1.xml#a"), ("rId2", "slide", "#b")])}))
    problems = {r.problem for r in ooxml.invalid_packages(archive.entries(cut), ooxml.read_relations(cut), "pptx").collect()}
    assert problems == {"missing [Content_Types].xml", "missing _rels/.rels", "dangling ppt/slides/slide1.xml"}


def test_alternate_content():
    xml = b'<r xmlns:mc="m"><mc:AlternateContent><mc:Choice Requires="zz"><a/></mc:Choice><mc:Choice Requires="wps"><b/></mc:Choice><mc:Fallback><c/></mc:Fallback></mc:AlternateContent></r>'
    assert [ooxml.local(n) for n in ooxml.parse(xml)] == ["b"]
    assert [ooxml.local(n) for n in ooxml.parse(xml.replace(b"wps", b"yy"))] == ["c"]
    with pytest.raises(ValueError):
        ooxml.parse(b'<r xmlns:mc="m"><mc:AlternateContent><mc:Choice Requires="zz"/></mc:AlternateContent></r>')


def test_cells_shared_strings_and_order(spark):
    strings = f'<sst xmlns="{writers.NS["s"]}"><si><r><t>第一段</t></r><r><t> 第二段</t></r></si><si><t>&amp;lt;文字</t></si></sst>'
    body = '<sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2"><f>1-1</f><v>0</v></c><c r="E2"><f>A1</f></c></row></sheetData><mergeCells><mergeCell ref="B2:C3"/></mergeCells>'
    f = files(spark, b_xlsx=sheet_package([("甲", body), ("乙", "<sheetData/>")], {"xl/sharedStrings.xml": strings}))
    got = {r.ref: r for r in ooxml.read_cells(f).collect()}
    assert {k: v.value for k, v in got.items()} == {"B2": "第一段 第二段", "C2": "&lt;文字", "D2": "0 (=1-1)", "E2": "=A1"} and got["B2"].sheet_name == "甲"
    assert {r.ref: r.value for r in C.formula_mode(ooxml.read_cells(f)).collect()} == {"B2": "第一段 第二段", "C2": "&lt;文字", "D2": "0", "E2": "计算结果未保存"}
    merges = ooxml.read_merges(f)
    assert C.select_merges(merges, ["B2:C3"]).count() == 1 and C.select_merges(merges, ["B2"]).count() == 0
    cells = ooxml.read_cells(f)
    assert C.select_sheets(cells, [" 甲 "]).count() == 4 and C.select_sheets(cells, ["1"]).count() == 4
    with pytest.raises(Exception, match="no such sheet"):
        C.select_sheets(cells, ["丙"]).collect()
    assert {r.ref for r in C.select_cells(cells, ["b2:c9", "D1:D2"]).collect()} == {"B2", "C2", "D2"} and C.select_cells(cells, None, 0).count() == 1
    bad = files(spark, b_xlsx=sheet_package([("甲", body.replace("<v>1</v>", "<v>99</v>"))], {"xl/sharedStrings.xml": strings}))
    assert "99" in ooxml.read_cells(bad).collect()[0].error


def test_ranges():
    assert ooxml.expand_ranges(["a1:b2", "B2"]) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    for bad in ("B2:A1", "XFE1", "A1048577", "A0", "A1:XFD1048576"):
        with pytest.raises(ValueError):
            ooxml.expand_ranges([bad])


def test_sparse_tables(spark):
    rows = [("d", 1, "s", r, c, v, v, "", None) for r, c, v in [(2, 2, "B2"), (2, 4, "D2"), (9, 2, "B9"), (9, 4, "D9"), (1048576, 16384, "last")]]
    cells = spark.createDataFrame(rows, "doc_id string, sheet_index int, sheet_name string, row int, col int, value string, result string, formula string, error string")
    (t,) = [r.tbl for r in C.sheet_tables(cells).collect()]
    assert t == [["行号", "B", "D", "XFD"], ["2", "B2", "D2", ""], ["9", "B9", "D9", ""], ["1048576", "", "", "last"]]


def test_every_selected_cell_is_exported_once(spark):
    data = writers.xlsx([[f"CELL_{i:03}_END"] for i in range(75)])
    cells = ooxml.read_cells(files(spark, c_xlsx=data))
    marks = [f"CELL_{i:03}_END" for i in range(75)]
    word = ooxml.read_docx(C.excel_to_word(cells).select(F.col("name").alias("path"), "content")).collect()
    deck = ooxml.read_pptx(C.write_pptx(C.excel_to_slides(cells, ooxml.read_points(files(spark, c_xlsx=data)))).select(F.col("name").alias("path"), "content")).collect()
    pages = pdf.read_pdf(C.excel_to_pdf(cells).select(F.col("name").alias("path"), "content")).collect()
    for said in ("\n".join(r.text for r in word), "\n".join(x for r in deck for x in r.body), "\n".join(r.text for r in pages)):
        assert all(said.count(m) == 1 for m in marks)
    assert len(deck) == 7


COMMENT = f'<comments xmlns="{writers.NS["s"]}"><authors><author>老师</author><author>tc={{R1}}</author><author>tc={{GONE}}</author></authors><commentList><comment ref="A1" authorId="0"><text><t>own</t></text></comment><comment ref="C3" authorId="1"><text><t>copy</t></text></comment><comment ref="B2" authorId="8"><text><t>lost</t></text></comment><comment ref="D4" authorId="2"><text><t>kept</t></text></comment></commentList></comments>'


def threads(extra):
    return '<ThreadedComments xmlns="t">' + "".join(f'<threadedComment id="{i}" parentId="{p}" ref="{r}" personId="P" done="{d}"><text>{t}</text></threadedComment>' if p else f'<threadedComment id="{i}" ref="{r}" personId="P" done="{d}"><text>{t}</text></threadedComment>' for i, p, r, d, t in extra) + "</ThreadedComments>"


def commented(spark, extra):
    rel = {"xl/worksheets/_rels/sheet1.xml.rels": writers.rels([("rId1", "comments", "../comments1.xml"), ("rId2", "threadedComment", "../threads/t1.xml")]), "xl/comments1.xml": COMMENT, "xl/threads/t1.xml": threads(extra), "xl/persons/p.xml": '<personList xmlns="t"><person id="p" displayName="王"/></personList>'}
    return files(spark, k_xlsx=sheet_package([("s", "<sheetData/>")], rel, [("rId9", "person", "persons/p.xml")]))


def test_comments(spark):
    f = commented(spark, [("{R1}", "", "C3", 1, "root"), ("{R2}", "{r1}", "", 0, "reply"), ("{R3}", "{R2}", "", 0, "deep")])
    got = {r.text: r for r in ooxml.resolve_comments(ooxml.read_comments(f)).collect()}
    assert set(got) == {"own", "lost", "kept", "root", "reply", "deep"}
    assert got["reply"].ref == got["deep"].ref == "C3" and got["reply"].display_text == "回复：reply" and got["root"].display_text == "root（已解决）"
    assert got["own"].author == "老师" and got["lost"].author == "" and got["root"].author == "王"
    for bad in ([("{A}", "{B}", "", 0, "x"), ("{B}", "{A}", "", 0, "y")], [("{A}", "{Z}", "", 0, "x")]):
        with pytest.raises(Exception, match="cycle|no cell"):
            ooxml.resolve_comments(ooxml.read_comments(commented(spark, bad))).collect()


def test_chart_points(spark):
    chart = writers.chart_xml("bar", [{"name": "分", "categories": ["一", "", "三"], "values": ["0", "", "98"]}])
    bare = f'<c:chartSpace xmlns:c="{writers.NS["c"]}"><c:ser><c:val><c:numRef><c:f>\'教\'\'学\'!$A$1:$A$2</c:f></c:numRef></c:val></c:ser></c:chartSpace>'
    extra = {"xl/worksheets/_rels/sheet1.xml.rels": writers.rels([("rId1", "drawing", "../drawings/d.xml")]), "xl/drawings/d.xml": "<x/>", "xl/drawings/_rels/d.xml.rels": writers.rels([("rId1", "chart", "../charts/c1.xml"), ("rId2", "chart", "../charts/c2.xml")]), "xl/charts/c1.xml": chart, "xl/charts/c2.xml": bare}
    f = files(spark, g_xlsx=sheet_package([("教'学", '<sheetData><row r="1"><c r="A1"><v>0</v></c></row><row r="2"><c r="A2"><v>7</v></c></row></sheetData>')], extra))
    points = ooxml.read_points(f)
    assert [(r.idx, r.category, r.value) for r in ooxml.chart_table(points).orderBy("idx").collect()] == [(0, "一", "0"), (2, "三", "98")]
    assert [(r.idx, r.value) for r in ooxml.sourced_points(points, ooxml.read_cells(f)).orderBy("idx").collect()] == [(0, "0"), (1, "7")]


def test_pdf(spark):
    data = writers.pdf(["中文导出测试", "Hello 123", "", "Hello 123"] + [f"line {i}" for i in range(100)])
    assert pdf.text_lines(data)[:3] == ["中文导出测试", "Hello 123", "line 0"] and len(pdf.text_lines(data)) == 102
    plain = b"%PDF-1.4\n1 0 obj\n<</Length 9>>\nstream\nBT (a\\(b\\)\\101) Tj [(x) -20 (y)] TJ <FEFF4E2D> Tj ET\nBT (caf\xe9) Tj ET\nendstream\nendobj"
    assert pdf.text_lines(plain) == ["a(b)A xy 中", "café"]
    packed = b"<</Filter/FlateDecode>>\nstream\n" + zlib.compress(b"BT (" + b"z" * 5000 + b") Tj ET") + b"\nendstream"
    assert pdf.text_lines(packed, pdf.Limits(stream=100)) == [] and len(pdf.text_lines(packed)) == 1
    assert pdf.text_lines(plain, pdf.Limits(source=10)) == [] and pdf.text_lines(plain * 3, pdf.Limits(streams=2)) == [] and pdf.text_lines(plain, pdf.Limits(total=5)) == []


BMP = b"BM" + bytes(12) + struct.pack("<Iii", 40, 8, -4) + bytes(28)
IMAGES = {
    "png": (b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 8, 4), (8, 4)),
    "gif": (b"GIF89a" + struct.pack("<HH", 8, 4), (8, 4)),
    "bmp": (BMP, (8, 4)),
    "core": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 8, 4), (8, 4)),
    "jpeg": (b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 4, 8) + bytes(6), (8, 4)),
    "tiff": (b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHIHH", 256, 3, 1, 8, 0) + struct.pack("<HHII", 257, 4, 1, 4), (8, 4)),
    "tiffbe": (b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, 8, 0) + struct.pack(">HHII", 257, 4, 1, 4), (8, 4)),
    "svg": (b'<svg xmlns="http://www.w3.org/2000/svg" width="1in" height="12pt"/>', (96, 16)),
    "box": (b'<svg viewBox="0 0 30 20" width="100%"/>', (30, 20)),
    "dtd": (b'<!DOCTYPE svg><svg width="1" height="1"/>', None),
    "none": (b"plain", None),
    "short": (b"\x89PNG\r\n\x1a\n", None),
}


def test_images(spark):
    for data, size in IMAGES.values():
        got = images.image_size(data)
        assert (got and got[1:]) == size
    df = files(spark, **{k: v[0] for k, v in IMAGES.items()})
    sql = {r.path: r.s for r in df.select("path", binary.raster_size("content").alias("s")).collect()}
    assert {k: sql[k] and tuple(sql[k]) for k in ("png", "gif", "bmp", "core", "none", "short")} == {k: IMAGES[k][1] for k in ("png", "gif", "bmp", "core", "none", "short")}
    assert images.read_sizes(df).filter("error is null").count() == 9


def test_legacy_header(spark):
    head = bytearray(512)
    head[:8] = bytes.fromhex("d0cf11e0a1b11ae1")
    head[24:34] = struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6)
    bad = bytearray(head)
    bad[26] = 9
    got = {r.path: r.ok for r in files(spark, a=head, b=bad, c=head[:100]).select("path", binary.is_legacy_office("content").alias("ok")).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_vba(spark):
    source = 'Attribute VB_Name = "模块1"\r\nPublic Sub One() \' Sub No()\r\nSub Two _\r\n  ()\r\nPrivate Sub P()\r\nSub WithArg(x)\r\nx = "Sub Three()": Static Sub Four()\r\nRem Sub Five()\r\nFriend Sub Six()'
    assert vba.macros(source) == [("One", "模块1", 2, "模块1.One"), ("Two", "模块1", 3, "模块1.Two"), ("Four", "模块1", 7, "模块1.Four")]
    assert vba.macros("Option Private Module\nSub A()") == [] and vba.macros("Sub _Hidden()") == [] and vba.macros("") == []
    faked = "' Sub Fake()\nRem comment: Sub FakeTwo()\nvalue = \"Sub FakeThree(): Public Sub FakeFour()\"\nPublic _\nSub Real(): End Sub"
    assert vba.macros(faked) == [("Real", "", 4, "Real")]
    assert vba.macros("\ufeffAttribute VB_Name = \"Module_1\"\nSub Prepare()")[0][3] == "Module_1.Prepare"
    assert [m[0] for m in vba.macros("Public Sub 整理标题()\nEnd Sub\nSub NeedsArgument(value As String)\nPublic Function Value() As String\nSub Refresh\nEnd Sub\nPublic Static Sub Kept()\nREM\nremember = 1: Sub Last() ' Sub No() _\nSub Joined()\n' x _\ny: Sub Not()\nSub A_1()")] == ["整理标题", "Refresh", "Kept", "Last", "A_1"]
    for module in ("bad.name", "bad name", "123Module", "Module[1]", "_Module", "M" * 256, ""):
        with pytest.raises(ValueError, match="module"):
            vba.macros(f'Attribute VB_Name = "{module}"\nPublic Sub Prepare()')
    with pytest.raises(ValueError, match="too long"):
        vba.macros("Sub " + "M" * 256 + "()")
    for bad in ("Sub A()\nSub a()", "Sub A _", "Public _", "Sub A _\n", "x\0", 'Attribute VB_Name = "A"\nAttribute VB_Name = "B"'):
        with pytest.raises(ValueError):
            vba.macros(bad)
    assert vba.read_macros(files(spark, a_bas=b"Sub A()", b_bas=b"\xff\xfe")).filter("error is null").count() == 1


def test_archives(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("../up.txt", "x")
        z.writestr("big.txt", "0" * 1_000_000)
    good = writers.zipped({"a/b.txt": "hello"})
    e = archive.entries(files(spark, bad_zip=out.getvalue(), good_zip=good))
    assert {(r.doc_id, r.reason) for r in archive.unsafe(e).collect()} == {("bad.zip", "traversal"), ("bad.zip", "ratio")}
    assert archive.preview(e, 1).count() == 2
    paths = spark.createDataFrame([("/r/a/b",), ("/r/../x",), ("/rx/a",), (None,)], "p string").select(archive.contained(F.col("p"), "/r").alias("ok")).collect()
    assert [r.ok for r in paths] == [True, False, False, False]


def test_landing_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(writers.docx([{"text": "x", "level": 1}]))
    (tmp_path / "big.docx").write_bytes(bytes(5000))
    got = ooxml.read_docx(archive.landed(spark, str(tmp_path), "*.docx", 4000)).collect()
    assert [r.text for r in got] == ["x"]


def test_reports(spark):
    rows = spark.createDataFrame([(1, 2, 'a"<b'), (1, 1, "c")], "g int, o int, x string")
    html = writers.html_report("报告", rows, "g", ["x"], ["o"]).first().html
    assert html.index("<td>c</td>") < html.index("a&quot;&lt;b")
    assert writers.text_report(rows, "g", F.col("x"), ["o"]).first().text == 'c\na"<b'
    assert rows.select(writers.csv_line(F.col("o"), F.col("x")).alias("c")).collect()[0].c == '"2","a""<b"'
    m = spark.createDataFrame([("<math/>", "x"), (" ", "a<b")], "m string, l string").select(writers.mathml(F.col("m"), F.col("l")).alias("m"), writers.tex_item(F.col("l")).alias("t")).collect()
    assert m[0].m == "<math/>" and "a&lt;b" in m[1].m and m[1].t == "\\[\na<b\n\\]"


def test_slides_and_modes(spark):
    b = [("d", i, f"H{i}" if i % 20 == 0 else f"t{i}", 1 if i % 20 == 0 else 0, None) for i in range(50)]
    blocks = spark.createDataFrame(b, "doc_id string, pos int, text string, level int, error string")
    slides = C.word_to_slides(blocks).orderBy("idx").collect()
    assert [r.title for r in slides] == ["H0", "H0", "H20", "H20", "H40"] and [len(r.body) for r in slides] == [12, 7, 12, 7, 9]
    assert [x for r in slides for x in r.body] == [t for _, _, t, lv, _ in b if not lv]
    made = spark.createDataFrame([("d", i, f"T{i}", ["b"], ["n"]) for i in range(1, 26)], "doc_id string, idx int, title string, body array<string>, notes array<string>")
    assert C.contents_pages(made).count() == 2
    first = lambda mode: [r.text for r in C.slides_to_blocks(made, mode).orderBy("pos").limit(3).collect()]
    assert first("notes-first") == ["T1", "讲者备注", "n"] and first("handout") == ["T1", "b", "备注"] and first("outline") == ["T1", "b", "T2"] and first("mixed") == ["T1", "幻灯片缩略图占位：第 1 页", "b"]
    told = C.slides_to_blocks(made, "outline", contents=True).orderBy("pos").collect()
    assert [r.text for r in told[:3]] == ["目录", "1. T1", "2. T2"] and len(told) == 76


def test_pictures(spark):
    head = f'xmlns:w="{writers.NS["w"]}" xmlns:a="{writers.NS["a"]}" xmlns:r="{writers.NS["r"]}"'
    body = '<w:p><w:drawing><wp:inline xmlns:wp="wp"><wp:extent cx="914400" cy="457200"/><a:pic><a:blipFill><a:blip r:embed="rId1"><asvg:svgBlip xmlns:asvg="s" r:embed="rId2"/></a:blip><a:srcRect l="10000" b="5"/></a:blipFill><a:spPr><a:xfrm rot="-5400000" flipH="1"/></a:spPr></a:pic></wp:inline></w:drawing></w:p>'
    parts = {"word/document.xml": f"<w:document {head}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": writers.rels([("rId1", "image", "media/a.png"), ("rId2", "image", "media/a.svg")])}
    (r,) = ooxml.read_pictures(files(spark, p_docx=writers.zipped(parts))).collect()
    assert (r.media, r.svg, r.width, r.height, r.crop, r.rotation, r.flip_h, r.flip_v, r.error) == ("word/media/a.png", "word/media/a.svg", 914400, 457200, [10000, 0, 0, 5], 16_200_000, True, False, None)


def styled(spark, body):
    xml = f'<w:styles xmlns:w="{writers.NS["w"]}"><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="20"/><w:rFonts w:ascii="Serif"/></w:rPr></w:rPrDefault></w:docDefaults>{body}</w:styles>'
    return ooxml.read_styles(files(spark, s_docx=writers.zipped({"word/styles.xml": xml})))


def test_styles_inherit(spark):
    style = lambda i, up, props, kind="paragraph": f'<w:style w:type="{kind}" w:styleId="{i}">' + (f'<w:basedOn w:val="{up}"/>' if up else "") + f"<w:rPr>{props}</w:rPr></w:style>"
    got = {r.style_id: r.props for r in ooxml.resolved_styles(styled(spark, style("A", "", '<w:b/><w:sz w:val="22"/>') + style("B", "A", '<w:sz w:val="30"/>') + style("C", "B", "<w:i/>") + style("X", "A", "", "character"))).collect()}
    assert got["C"] == {"b": "1", "i": "1", "sz": "30", "rFonts": "Serif"} and got["A"]["sz"] == "22"
    assert got["X"] == {"sz": "20", "rFonts": "Serif"}  # a parent of another kind hands nothing on
    with pytest.raises(Exception, match="style cycle"):
        ooxml.resolved_styles(styled(spark, style("A", "B", "") + style("B", "A", ""))).collect()


def test_big_table_pages():
    tbl = [[f"{r}.{c}" for c in range(15)] for r in range(25)]
    pages = list(ooxml.table_pages("d", 0, tbl, []))
    assert len(pages) == 6 and sorted(x for p in pages for row in p[3] for x in row) == sorted(x for row in tbl for x in row)
    cut = list(ooxml.table_pages("d", 0, tbl, [[10, 2, 5, 2]]))
    assert [len(p[3]) for p in cut if p[3][0][0].endswith(".0")] == [10, 12, 3] and sum(len(p[4]) for p in cut) == 1


def test_broken_word_parts_keep_their_text():
    xml = '<w:document><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p w:rsid="1"><w:r><w:t>a</w:t><w:t> b</w:t></w:r></w:p><w:p/><w:pict>no</w:pict><w:p><w:t>open'
    assert list(ooxml.loose_paragraphs(xml)) == [("One & two", 2), ("a b", None)]
    assert list(ooxml.loose_paragraphs("")) == [] and list(ooxml.loose_paragraphs("<>< /><p>x</p>")) == [("x", None)]


def test_a_wrong_checksum_is_an_error(spark):
    import io
    import zipfile

    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        z.writestr("_rels/.rels", '<Relationships><Relationship Id="a" Type="x/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", "<w:p/>" * 9)
    whole = made.getvalue()
    at = whole.index(b"<w:p/>")
    broken = whole[:at] + b"<w:q/>" + whole[at + 6 :]
    got = {r.doc_id: r.error for r in ooxml.read_relations(files(spark, a=whole, b=broken)).collect()}
    assert got["a"] is None and "word/document.xml" in got["b"]
