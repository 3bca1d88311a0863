"""Word, PowerPoint and Excel packages as rows: blocks, slides, sheets, cells, comments, chart points, relations."""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from xml.etree import ElementTree as ET

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.operators import relational as R
from docengine.operators.lineage import written
from docengine.sources.archive import per_file

BLOCK = "doc_id string, pos int, kind string, text string, level int, runs array<struct<text:string,b:boolean,i:boolean,size:int,font:string,color:string>>, tbl array<array<string>>, merges array<array<int>>, error string"
SLIDE = "doc_id string, idx int, title string, body array<string>, notes array<string>, text_box_count int, shape_count int, table_count int, image_count int, chart_count int, formula_count int, tables array<array<array<string>>>, error string"
CELL = "doc_id string, sheet_index int, sheet_name string, row int, col int, ref string, value string, result string, formula string, error string"
MERGE = "doc_id string, sheet_index int, ref string, top int, left int, bottom int, right int, error string"
COMMENT = "doc_id string, sheet_index int, id string, parent_id string, ref string, person_id string, author string, text string, date string, resolved boolean, threaded boolean, error string"
POINT = "doc_id string, sheet_index int, chart int, series int, name string, idx int, category string, value string, category_formula string, value_formula string, error string"
RELATION = "doc_id string, src_part string, rel_id string, type string, target string, external boolean, error string"

#: Markup namespaces whose Choice branches are understood (fixed values).
UNDERSTOOD = {"wps", "wpg", "a14", "p14", "x14", "w14", "asvg"}


@lru_cache(4096)
def _bare(tag: object) -> str:
    return tag.rsplit("}", 1)[-1] if isinstance(tag, str) else ""


def local(node: ET.Element) -> str:
    return _bare(node.tag)


def attr(node: ET.Element, name: str, default: str = "") -> str:
    """An attribute by local name."""
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), default)


def first(node: ET.Element | None, name: str) -> ET.Element | None:
    if node is None or not len(node):
        return None
    for n in node.iter():
        if _bare(n.tag) == name and n is not node:
            return n
    return None


def parse(xml: bytes) -> ET.Element:
    """Markup with every AlternateContent replaced by its first understood Choice, else its Fallback."""
    root = ET.fromstring(xml)
    if b"AlternateContent" not in xml and b"<!" not in xml and b"\0" not in xml:  # nor by an entity, nor in UTF-16
        return root
    for parent in list(root.iter()):
        for i, child in reversed(list(enumerate(parent))):
            if local(child) == "AlternateContent":
                pick = next((c for c in child if local(c) == "Choice" and set(c.get("Requires", "").split()) <= UNDERSTOOD), None)
                pick = pick if pick is not None else next((c for c in child if local(c) == "Fallback"), None)
                if pick is None:
                    raise ValueError("no understood branch of alternate content")
                parent[i : i + 1] = list(pick)
    return parse_again(root) if any(local(n) == "AlternateContent" for n in root.iter()) else root


def parse_again(root: ET.Element) -> ET.Element:
    return parse(ET.tostring(root))


class Package:
    """One OOXML file."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()
        self.held = set(self.names)

    def xml(self, part: str) -> ET.Element:
        return parse(self.zip.read(part))

    def relations(self, part: str) -> list[tuple[str, str, str, bool]]:
        """(id, type's last word, target part or URI, external)."""
        folder, name = posixpath.split(part)
        path = posixpath.join(folder, "_rels", f"{name}.rels")
        if path not in self.held:
            return []
        out = []
        for r in ET.fromstring(self.zip.read(path)):
            external = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not external:
                bare = target.split("#")[0]
                target = part if not bare else posixpath.normpath(bare.lstrip("/") if bare.startswith("/") else posixpath.join(folder, bare))
            out.append((r.get("Id", ""), r.get("Type", "").rsplit("/", 1)[-1], target, external))
        return out

    def ordered(self, part: str, item: str, kind: str) -> list[tuple[str, str]]:
        """(name attribute, part) of listed items in document order: order follows relationships, not file numbers."""
        targets = {i: (t, x) for i, k, t, x in self.relations(part) if k == kind}
        out = []
        for node in self.xml(part).iter():
            rid = next((v for k, v in node.attrib.items() if k.endswith("relationships}id")), None)
            if local(node) == item and rid in targets:
                target, external = targets[rid]
                if external:
                    raise ValueError(f"{item} is outside the package")
                out.append((node.get("name", ""), target))
        return out


def visible(node: ET.Element) -> str:
    """Text with tabs and breaks; a nested table's text isn't the paragraph's."""
    out: list[str] = []
    _say(node, out)
    return "".join(out).strip()


def _say(n: ET.Element, out: list[str]) -> None:
    name = _bare(n.tag)
    if name == "t":
        out.append(n.text or "")
    elif name == "tab" and len(n.attrib) == 0:
        out.append("\t")
    elif name in ("br", "cr"):
        out.append("\n")
    for c in n:
        if _bare(c.tag) != "tbl":
            _say(c, out)


def _on(node: ET.Element | None, name: str) -> bool:
    found = first(node, name)
    return found is not None and attr(found, "val", "1") not in ("0", "false", "off")


def _runs(p: ET.Element) -> list[dict]:
    out = []
    for r in (n for n in p.iter() if local(n) == "r"):
        props = first(r, "rPr")
        size, font, color = first(props, "sz"), first(props, "rFonts"), first(props, "color")
        out.append({"text": visible(r), "b": _on(props, "b"), "i": _on(props, "i"), "size": int(attr(size, "val")) if size is not None and attr(size, "val").isdigit() else None, "font": attr(font, "ascii") or None if font is not None else None, "color": attr(color, "val") or None if color is not None else None})
    return out


def _table_cells(tbl: ET.Element) -> Iterator[tuple[int, int, int, str, str]]:
    """(column, span, row, vertical mark, text) of a table's cells; a row may begin some grid columns in."""
    number = lambda node, default: int(attr(node, "val", "")) if node is not None and attr(node, "val", "").isdigit() else default
    own = lambda node, name: [n for n in node if local(n) == name]
    for row, tr in enumerate(own(tbl, "tr")):
        column = sum(number(first(pr, "gridBefore"), 0) for pr in own(tr, "trPr"))
        for tc in own(tr, "tc"):
            pr, said = None, []
            for n in tc:
                kind = _bare(n.tag)
                if kind == "p":
                    said.append(visible(n))
                elif kind == "tcPr" and pr is None:
                    pr = n
            span, merge = max(1, number(first(pr, "gridSpan"), 1)), first(pr, "vMerge")
            mark = "" if merge is None else attr(merge, "val", "continue")
            yield column, span, row, mark, "\n".join(filter(None, said))
            column += span


#: What makes a table's cells more or less than one place of their row.
SPANS = {"gridSpan", "vMerge", "gridBefore"}


def _plain_grid(tbl: ET.Element) -> list[list[str]]:
    """The grid of a table without merges: a row's cells in their order, and blanks up to the widest row."""
    grid = []
    for tr in tbl:
        if _bare(tr.tag) == "tr":
            line = []
            for tc in tr:
                if _bare(tc.tag) == "tc":
                    said = [visible(p) for p in tc if len(p) and _bare(p.tag) == "p"]  # an empty paragraph says nothing
                    line.append("" if not said else said[0] if len(said) == 1 else "\n".join(filter(None, said)))
            grid.append(line)
    columns = max(map(len, grid), default=0)
    return [line + [""] * (columns - len(line)) for line in grid]


def table_grid(tbl: ET.Element, tags: set[str] | None = None) -> tuple[list[list[str]], list[list[int]]]:
    """A full grid of texts, and merges [top, left, height, width].

    Cells of the same column and span are looked at from top to bottom: one that is marked as going on, right below a marked one,
    belongs to the island above it. An island shows its first text. tags: those of SPANS that the table may hold, if that is known.
    """
    if not SPANS & (tags if tags is not None else {_bare(t) for t in {n.tag for n in tbl.iter()}}):
        return _plain_grid(tbl), []
    cells = sorted(_table_cells(tbl))
    rows = sum(local(n) == "tr" for n in tbl)
    columns = max((c + span for c, span, *_ in cells), default=0)
    grid = [[""] * columns for _ in range(rows)]
    merges = []
    for (left, width), place in groupby(cells, key=lambda x: x[:2]):
        islands: list[list[tuple]] = []
        for cell in place:
            above = islands[-1][-1] if islands else None
            if above and cell[3] == "continue" and above[3] and above[2] == cell[2] - 1:
                islands[-1].append(cell)
            else:
                islands.append([cell])
        for island in islands:
            top = island[0][2]
            grid[top][left] = island[0][4]
            if len(island) * width > 1:
                merges.append([top, left, len(island), width])
    return grid, sorted(merges)


def _level(p: ET.Element, index: int) -> int:
    style = first(first(p, "pPr"), "pStyle")
    name = re.sub(r"[\s_-]", "", attr(style, "val").lower()) if style is not None else ""
    m = re.fullmatch("heading([1-9])", name)
    return int(m[1]) if m else 1 if name == "title" or index == 1 else 0


def loose_paragraphs(xml: str) -> Iterator[tuple[str, int | None]]:
    """(text, heading level) of a part that no parser takes: one walk from tag to tag; what stands between a paragraph's tags is its text."""
    said: list[str] | None = None
    level, at = None, 0
    while (opened := xml.find("<", at)) >= 0:
        if said is not None:
            said.append(xml[at:opened])
        closed = xml.find(">", opened)
        if closed < 0:
            return
        tag, at = xml[opened + 1 : closed], closed + 1
        kind = tag.strip("/ ").split(None, 1)[0].rsplit(":", 1)[-1] if tag.strip("/ ") else ""
        if kind == "p" and tag.startswith("/") and said is not None:
            yield " ".join(html.unescape("".join(said)).split()), level
            said = None
        elif kind == "p" and not tag.startswith("/") and not tag.endswith("/"):
            said, level = [], None
        elif kind == "pStyle" and (style := tag.partition("val=")[2][1:].lower()).startswith("heading") and style[7:8] in set("123456789"):
            level = int(style[7])


def docx_blocks(name: str, content: bytes) -> Iterator[tuple]:
    package = Package(content)
    xml = package.zip.read("word/document.xml")
    out: list[tuple] = []
    try:
        root = parse(xml)
    except ET.ParseError:
        for i, (text, level) in enumerate(loose_paragraphs(xml.decode("utf-8", "ignore")), 1):
            if text:
                out.append(("paragraph", text, int(i == 1) if level is None else level, None, None, None))
        root = None
    index = 0
    # names stand in the markup as they are, but by an entity or in UTF-16
    plain = set() if b"tbl" in xml and b"<!" not in xml and not any(x.encode() in xml for x in SPANS) else None

    def walk(node: ET.Element) -> None:
        nonlocal index
        for child in node:
            kind = local(child)
            if kind == "p":
                index += 1
                text = visible(child)
                if text:
                    out.append(("paragraph", text, _level(child, index), _runs(child), None, None))
            elif kind == "tbl":
                index += first(child, "p") is not None  # it tells whether a paragraph is the first, no more
                grid, merges = table_grid(child, plain)
                if grid:
                    out.append(("table", "\n".join("\t".join(r) for r in grid), 0, None, grid, merges))
            else:
                walk(child)

    if root is not None:
        walk(root)
    stem = posixpath.splitext(posixpath.basename(name))[0]
    for pos, b in enumerate(out or [("paragraph", stem, 1, None, None, None)]):
        yield name, pos, b[0], b[1], b[2], b[3], b[4], b[5], None


PLACEHOLDERS = {"hdr", "ftr", "dt", "sldNum", "sldImg"}


def _paragraphs(root: ET.Element, skip_tables: bool) -> list[str]:
    out = []

    def walk(n: ET.Element) -> None:
        name = _bare(n.tag)
        if skip_tables and name == "tbl":
            return
        if name == "sp":
            ph = first(n, "ph")
            if ph is not None and ph.get("type") in PLACEHOLDERS:
                return
        if name == "p":
            text = visible(n)
            if text:
                out.append(text)
            return
        for c in n:
            walk(c)

    walk(root)
    return out


def pptx_slides(name: str, content: bytes) -> Iterator[tuple]:
    package = Package(content)
    for i, (_, part) in enumerate(package.ordered("ppt/presentation.xml", "sldId", "slide"), 1):
        root = package.xml(part)
        count = Counter(_bare(n.tag) for n in root.iter())  # one walk for all of them
        texts = _paragraphs(root, True)
        related = package.relations(part)
        notes = [t for _, k, target, x in related if k == "notesSlide" and not x for t in _paragraphs(package.xml(target), True)]
        tables = [[[" ".join(_paragraphs(tc, False)) for tc in tr if local(tc) == "tc"] for tr in tbl if local(tr) == "tr"] for tbl in root.iter() if local(tbl) == "tbl"] if count["tbl"] else []
        media, charts = {t for _, k, t, _ in related if "/media/" in f"/{t.lower()}"}, {t for _, _, t, _ in related if "/charts/" in f"/{t.lower()}"}
        yield name, i, texts[0] if texts else f"幻灯片 {i}", texts[1:], notes, count["txBody"], count["sp"], len(tables), len(media), len(charts), count["oMath"], tables, None


SLIDE_TABLE = "doc_id string, idx int, pos int, tbl array<array<string>>, merges array<array<int>>, widths array<bigint>, heights array<bigint>, alignments array<array<string>>, error string"


def slide_tables(name: str, content: bytes) -> Iterator[tuple]:
    """Tables on slides: texts, merges [top, left, height, width], sizes in EMU, alignments; what a merge covers has no text."""
    package = Package(content)
    number = lambda node, key, default: int(node.get(key)) if (node.get(key) or "").isdigit() else default
    for i, (_, part) in enumerate(package.ordered("ppt/presentation.xml", "sldId", "slide"), 1):
        for pos, tbl in enumerate(n for n in package.xml(part).iter() if local(n) == "tbl"):
            rows = [[tc for tc in tr if local(tc) == "tc"] for tr in tbl if local(tr) == "tr"]
            spot = [(r, c, tc) for r, line in enumerate(rows) for c, tc in enumerate(line)]
            merges = [[r, c, h, w] for r, c, tc in spot if (h := number(tc, "rowSpan", 1)) * (w := number(tc, "gridSpan", 1)) > 1]
            texts = [["" if tc.get("hMerge") or tc.get("vMerge") else " ".join(_paragraphs(tc, False)) for tc in line] for line in rows]
            align = [[next((attr(p, "algn") for p in tc.iter() if local(p) == "pPr" and attr(p, "algn")), "") for tc in line] for line in rows]
            yield name, i, pos, texts, merges, [number(g, "w", 0) for g in tbl.iter() if local(g) == "gridCol"], [number(tr, "h", 0) for tr in tbl if local(tr) == "tr"], align, None


def read_slide_tables(files: DataFrame) -> DataFrame:
    return per_file(files, slide_tables, SLIDE_TABLE)


SLIDE_POINT = "doc_id string, idx int, chart int, series int, name string, point int, category string, value string, error string"


def slide_points(name: str, content: bytes) -> Iterator[tuple]:
    """Cached points of charts on slides; a gap is no row."""
    package = Package(content)
    for i, (_, part) in enumerate(package.ordered("ppt/presentation.xml", "sldId", "slide"), 1):
        for n, target in enumerate((t for _, k, t, external in package.relations(part) if k == "chart" and not external), 1):
            for s, ser in enumerate((x for x in package.xml(target).iter() if local(x) == "ser"), 1):
                held = {local(c): {int(p.get("idx", "0")): (first(p, "v").text or "") for p in c.iter() if local(p) == "pt"} for c in ser if local(c) in ("tx", "cat", "val")}
                for at, value in sorted(held.get("val", {}).items()):
                    yield name, i, n, s, held.get("tx", {}).get(0, ""), at, held.get("cat", {}).get(at), value, None


def read_slide_points(files: DataFrame) -> DataFrame:
    return per_file(files, slide_points, SLIDE_POINT)


def notes_lines(name: str, content: bytes) -> Iterator[tuple]:
    """what a notes page says, without its placeholders for header, footer, date, number and picture."""
    yield name, _paragraphs(parse(content), True), None


def letters_number(letters: str) -> int:
    n = 0
    for c in letters.upper():
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    """1 -> A, 27 -> AA."""
    return (column_letters((n - 1) // 26) if n > 26 else "") + chr(65 + (n - 1) % 26) if n > 0 else ""


REF = re.compile(r"\$?([A-Za-z]{1,3})\$?([0-9]{1,7})")


def ref_at(ref: str) -> tuple[int, int]:
    """(row, column) of a reference on the 16384 x 1048576 grid."""
    m = REF.fullmatch(ref.strip())
    at = (int(m[2]), letters_number(m[1])) if m else (0, 0)
    if not (1 <= at[0] <= 1_048_576 and 1 <= at[1] <= 16_384):
        raise ValueError(f"bad reference {ref!r}")
    return at


def range_at(ref: str) -> tuple[int, int, int, int]:
    """(top, left, bottom, right) of A1 or A1:B3."""
    a, _, b = ref.partition(":")
    (r1, c1), (r2, c2) = ref_at(a), ref_at(b or a)
    if r2 < r1 or c2 < c1:
        raise ValueError(f"bad range {ref!r}")
    return r1, c1, r2, c2


def expand_ranges(refs: list[str], most: int = 200_000) -> set[tuple[int, int]]:
    """the cells of a selection, never more than `most`."""
    boxes = [range_at(r) for r in refs]
    if sum((b[2] - b[0] + 1) * (b[3] - b[1] + 1) for b in boxes) > most:
        raise ValueError("selection is too large")
    return {(r, c) for t, l, b, rt in boxes for r in range(t, b + 1) for c in range(l, rt + 1)}


def _sheets(package: Package) -> list[tuple[str, str]]:
    return package.ordered("xl/workbook.xml", "sheet", "worksheet")


def xlsx_cells(name: str, content: bytes) -> Iterator[tuple]:
    package = Package(content)
    shared = []
    if "xl/sharedStrings.xml" in package.names:
        shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in package.xml("xl/sharedStrings.xml") if local(si) == "si"]
    for i, (title, part) in enumerate(_sheets(package), 1):
        for c in (n for n in package.xml(part).iter() if local(n) == "c"):
            ref, kind = c.get("r", ""), c.get("t", "")
            v, f = first(c, "v"), first(c, "f")
            raw = (v.text or "") if v is not None else ""
            if kind == "s" and raw:
                if not 0 <= int(raw) < len(shared):
                    raise ValueError(f"shared string {raw} is missing")
                raw = shared[int(raw)]
            elif kind == "inlineStr":
                raw = "".join(t.text or "" for t in c.iter() if local(t) == "t")
            formula = (f.text or "") if f is not None else ""
            if not raw and not formula:
                continue
            row, col = ref_at(ref)
            value = f"{raw} (={formula})" if formula and raw else f"={formula}" if formula else raw
            yield name, i, title, row, col, ref.upper(), value, raw, formula, None


def xlsx_merges(name: str, content: bytes) -> Iterator[tuple]:
    package = Package(content)
    for i, (_, part) in enumerate(_sheets(package), 1):
        for m in (n for n in package.xml(part).iter() if local(n) == "mergeCell"):
            ref = m.get("ref", "")
            top, left, bottom, right = range_at(ref)
            yield name, i, ref, top, left, bottom, right, None


def xlsx_comments(name: str, content: bytes) -> Iterator[tuple]:
    """Legacy and threaded comments as they're stored; resolve_comments() relates them."""
    package = Package(content)
    people = {}
    for _, k, target, external in package.relations("xl/workbook.xml"):
        if k == "person" and not external and target in package.names:
            people |= {p.get("id", "").lower(): p.get("displayName", "") for p in package.xml(target).iter() if local(p) == "person"}
    for i, (_, part) in enumerate(_sheets(package), 1):
        for _, k, target, external in package.relations(part):
            if external:
                continue
            if k == "comments":
                root = package.xml(target)
                authors = [a.text or "" for a in root.iter() if local(a) == "author"]
                for c in (n for n in root.iter() if local(n) == "comment"):
                    a = int(c.get("authorId", "-1"))
                    text = "".join(t.text or "" for t in c.iter() if local(t) == "t")
                    yield name, i, "", None, c.get("ref", "").upper(), "", authors[a] if 0 <= a < len(authors) else "", text, "", False, False, None
            elif k == "threadedComment":
                for c in (n for n in package.xml(target).iter() if local(n) == "threadedComment"):
                    text = first(c, "text")
                    pid = c.get("personId", "").lower()
                    yield name, i, c.get("id", "").lower(), c.get("parentId", "").lower() or None, c.get("ref", "").upper(), pid, people.get(pid, ""), (text.text or "") if text is not None else "", c.get("dT", ""), c.get("done") in ("1", "true"), True, None


def resolve_comments(comments: DataFrame) -> DataFrame:
    """Replies take their root's cell, legacy placeholders of a thread go, labels say what's a reply and what's resolved.

    A reply whose parent is missing, or a cycle, raises.
    """
    c = comments.filter(F.col("error").isNull())
    key = F.concat_ws("|", "doc_id", F.col("sheet_index").cast("string"), "id")
    up = F.when(F.col("parent_id").isNotNull(), F.concat_ws("|", "doc_id", F.col("sheet_index").cast("string"), "parent_id"))
    threaded = c.filter("threaded").withColumns({"k": key, "u": up})
    legacy = c.filter("not threaded")
    roots = R.ancestors(threaded.select(F.col("k").alias("id"), F.col("u").alias("parent_id"))).select(F.col("id").alias("k"), "root")
    at = threaded.select(F.col("k").alias("root"), F.col("ref").alias("root_ref"))
    placed = threaded.join(roots, "k").join(at, "root", "left")
    where = F.coalesce(F.nullif("ref", F.lit("")), F.nullif("root_ref", F.lit("")))
    placed = placed.withColumn("ref", F.when(where.isNotNull(), where).otherwise(F.raise_error(F.concat(F.lit("no cell for comment "), "k")).cast("string")))
    label = F.concat(F.when(F.col("parent_id").isNotNull(), "回复：").otherwise(""), "text", F.when(F.col("resolved"), "（已解决）").otherwise(""))
    mark = F.lower(F.regexp_extract("author", r"^tc=(\{[^}]*\})$", 1))
    ids = threaded.select(F.col("doc_id").alias("d"), F.col("sheet_index").alias("s"), F.col("id").alias("i"))
    tagged = legacy.withColumn("mark", mark)
    own = tagged.join(ids, (F.col("doc_id") == F.col("d")) & (F.col("sheet_index") == F.col("s")) & (F.col("mark") == F.col("i")), "left_anti")
    cols = ["doc_id", "sheet_index", "id", "parent_id", "ref", "author", "text", "date", "resolved", "threaded"]
    return placed.select(*cols, label.alias("display_text")).unionByName(own.select(*cols, F.col("text").alias("display_text")))


def xlsx_points(name: str, content: bytes) -> Iterator[tuple]:
    """Chart points as cached; a gap is no row, a zero is one."""
    package = Package(content)

    def cached(node: ET.Element | None) -> dict[int, str]:
        return {int(p.get("idx", "0")): (first(p, "v").text or "") if first(p, "v") is not None else "" for p in (node.iter() if node is not None else ()) if local(p) == "pt" and int(p.get("idx", "0")) < 200_000}

    for i, (_, part) in enumerate(_sheets(package), 1):
        drawings = [t for _, k, t, x in package.relations(part) if k == "drawing" and not x]
        charts = [t for d in drawings for _, k, t, x in package.relations(d) if k == "chart" and not x]
        for n, chart in enumerate(charts, 1):
            for s, ser in enumerate((x for x in package.xml(chart).iter() if local(x) == "ser"), 1):
                part_of = lambda tag: next((c for c in ser if local(c) in tag), None)  # noqa: E731, B023
                cat, val, tx = part_of(("cat", "xVal")), part_of(("val", "yVal")), part_of(("tx",))
                title = first(tx, "v")
                formula = lambda node: (f.text or "") if (f := first(node, "f")) is not None else ""
                categories, values = cached(cat), cached(val)
                for idx in sorted(set(categories) | set(values)) or [None]:
                    yield name, i, n, s, (title.text or "") if title is not None else "", idx, categories.get(idx), values.get(idx), formula(cat), formula(val), None


def chart_table(points: DataFrame) -> DataFrame:
    """A point's category defaults to its index from 1, its value to blank."""
    return points.filter(F.col("idx").isNotNull()).select("doc_id", "sheet_index", "chart", "series", "name", "idx", F.coalesce("category", (F.col("idx") + 1).cast("string")).alias("category"), F.coalesce("value", F.lit("")).alias("value"))


def sourced_points(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points of series without a cache, from the cells that their formula names ('Sheet'!$A$1:$A$9, one row or column)."""
    bare = points.filter(F.col("idx").isNull() & (F.col("value_formula") != ""))
    sheet = F.lower(F.replace(F.regexp_replace(F.regexp_extract("value_formula", r"^(.*)!", 1), "^'|'$", ""), F.lit("''"), F.lit("'")))
    area = F.regexp_replace(F.regexp_extract("value_formula", r"!(.*)$", 1), r"\$", "")
    from docengine.functions.text import column_number

    a, b = F.split_part(area, F.lit(":"), F.lit(1)), F.coalesce(F.nullif(F.split_part(area, F.lit(":"), F.lit(2)), F.lit("")), F.split_part(area, F.lit(":"), F.lit(1)))
    r = lambda x: F.regexp_extract(x, "([0-9]+)$", 1).cast("int")
    c = lambda x: column_number(F.regexp_extract(x, "^([A-Za-z]+)", 1))
    boxes = bare.select("doc_id", "sheet_index", "chart", "series", "name", sheet.alias("sheet"), r(a).alias("top"), c(a).alias("left"), r(b).alias("bottom"), c(b).alias("right"))
    boxes = boxes.filter((F.col("top") == F.col("bottom")) | (F.col("left") == F.col("right")))
    spots = boxes.withColumn("row", F.explode(F.sequence("top", "bottom"))).withColumn("col", F.explode(F.sequence("left", "right"))).withColumn("idx", F.col("row") - F.col("top") + F.col("col") - F.col("left"))
    held = cells.select(F.col("doc_id").alias("d"), F.lower("sheet_name").alias("sn"), F.col("row").alias("r"), F.col("col").alias("c"), "result")
    found = spots.join(held, (F.col("doc_id") == F.col("d")) & (F.col("sheet") == F.col("sn")) & (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")))
    return found.select("doc_id", "sheet_index", "chart", "series", "name", "idx", F.lit(None).cast("string").alias("category"), F.col("result").alias("value"))


def relations(name: str, content: bytes) -> Iterator[tuple]:
    """A package's relations; one with an entry whose checksum is wrong has none."""
    package = Package(content)
    broken = package.zip.testzip()
    if broken is not None:
        raise ValueError(f"the checksum of {broken} is wrong")
    for part in [n for n in package.names if "_rels/" not in n] + [""]:
        for rid, kind, target, external in package.relations(part):
            yield name, part, rid, kind, target, external, None


def read_docx(files: DataFrame) -> DataFrame:
    return per_file(files, docx_blocks, BLOCK)


def read_pptx(files: DataFrame) -> DataFrame:
    return per_file(files, pptx_slides, SLIDE)


def read_cells(files: DataFrame) -> DataFrame:
    return per_file(files, xlsx_cells, CELL)


def read_merges(files: DataFrame) -> DataFrame:
    return per_file(files, xlsx_merges, MERGE)


def read_comments(files: DataFrame) -> DataFrame:
    return per_file(files, xlsx_comments, COMMENT)


def read_points(files: DataFrame) -> DataFrame:
    return per_file(files, xlsx_points, POINT)


def read_relations(files: DataFrame) -> DataFrame:
    return per_file(files, relations, RELATION)


#: Parts that a package of each kind can't do without (fixed values).
REQUIRED = {"docx": ["[Content_Types].xml", "_rels/.rels", "word/document.xml"], "pptx": ["[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml"], "xlsx": ["[Content_Types].xml", "_rels/.rels", "xl/workbook.xml"]}


def invalid_packages(entries: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """I4: (doc_id, problem) for missing or doubled parts and internal relations that end nowhere."""
    parts = entries.filter(F.col("error").isNull())
    have = parts.groupBy("doc_id").agg(F.collect_set("part").alias("names"))
    missing = have.select("doc_id", F.explode(F.array_except(F.array(*[F.lit(p) for p in REQUIRED[kind]]), "names")).alias("p")).select("doc_id", F.concat(F.lit("missing "), "p").alias("problem"))
    doubled = parts.groupBy("doc_id", "part").count().filter("count > 1").select("doc_id", F.concat(F.lit("doubled "), "part").alias("problem"))
    inner = edges.filter(F.col("error").isNull() & ~F.col("external"))
    dangling = inner.join(parts.select("doc_id", F.col("part").alias("target")), ["doc_id", "target"], "left_anti").select("doc_id", F.concat(F.lit("dangling "), "target").alias("problem"))
    broken = entries.filter(F.col("error").isNotNull()).select("doc_id", F.concat(F.lit("unreadable "), "error").alias("problem"))
    return R.union_all([missing, doubled, dangling, broken])


PICTURE = "doc_id string, part string, pos int, media string, svg string, width bigint, height bigint, crop array<int>, rotation int, flip_h boolean, flip_v boolean, error string"


def pictures(name: str, content: bytes) -> Iterator[tuple]:
    """Drawn images of Word stories and slides: media part, SVG twin, extent in EMU, crop in 1/100000, rotation in 1/60000 degree."""
    package = Package(content)
    for part in (p for p in package.names if p.endswith(".xml") and p.startswith(("word/", "ppt/slides/")) and "_rels/" not in p):
        targets = {i: t for i, k, t, external in package.relations(part) if k == "image" and not external}
        if not targets:
            continue
        root = package.xml(part)
        pos = 0
        # a drawing's own picture is told by the drawing
        inner = {id(n) for h in root.iter() if local(h) in ("inline", "anchor") for n in h.iter() if local(n) == "pic"} if part.startswith("word/") else set()
        for holder in (n for n in root.iter() if local(n) in ("inline", "anchor", "pic", "pict") and id(n) not in inner):
            blip = first(holder, "blip")
            blip = blip if blip is not None else first(holder, "imagedata")
            if blip is None:
                continue
            svg = first(blip, "svgBlip")
            media = targets.get(attr(blip, "embed") or attr(blip, "id"))
            twin = targets.get(attr(svg, "embed")) if svg is not None else None
            if media is None and twin is None:
                continue
            size = first(holder, "extent")
            size = size if size is not None else first(holder, "ext")
            rect, turn = first(holder, "srcRect"), first(holder, "xfrm")
            number = lambda node, key: int(node.get(key, "0")) if node is not None and re.fullmatch(r"-?\d+", node.get(key, "0")) else 0
            flag = lambda key: turn is not None and turn.get(key) in ("1", "true")  # noqa: E731, B023
            yield name, part, pos, media or twin, twin, number(size, "cx") or None, number(size, "cy") or None, [number(rect, k) for k in "ltrb"], number(turn, "rot") % 21_600_000, flag("flipH"), flag("flipV"), None
            pos += 1


def read_pictures(files: DataFrame) -> DataFrame:
    return per_file(files, pictures, PICTURE)


PLACE = "doc_id string, pos int, media string, location string, error string"
#: What the stories of a document are called (fixed values).
STORIES = {"document": "正文（页码待排版定位）", "header": "页眉", "footer": "页脚"}
UNANCHORED = "绝对位置（无单元格锚点）"


def picture_places(name: str, content: bytes) -> Iterator[tuple]:
    """Where each media part is shown: story and paragraph in Word, slide in PowerPoint, sheet and anchor cell in Excel."""
    package = Package(content)
    has = set(package.names)
    linked = lambda part, kind: {i: t for i, k, t, external in package.relations(part) if k == kind and not external}
    shown: list[tuple[str, str]] = []

    def story(part: str, label: str, numbered: bool) -> None:
        images = linked(part, "image")
        root = package.xml(part) if images else None
        paragraph = {id(n): i for i, p in enumerate((n for n in root.iter() if local(n) == "p"), 1) for n in p.iter()} if images and numbered else {}
        for node in root.iter() if images else ():
            media = images.get(attr(node, "embed") or attr(node, "id")) if local(node) in ("blip", "imagedata", "svgBlip") else None
            if media:
                at = paragraph.get(id(node))
                shown.append((media, f"{label} · {part}" + (f" · 第 {at} 段" if at else "")))

    if "word/document.xml" in has:
        story("word/document.xml", STORIES["document"], True)
        used = {attr(n, "id"): local(n).removesuffix("Reference") for n in package.xml("word/document.xml").iter() if local(n) in ("headerReference", "footerReference")}
        for rid, kind in used.items():
            if rid in (parts := linked("word/document.xml", kind)):
                story(parts[rid], STORIES[kind], True)
    if "ppt/presentation.xml" in has:
        for i, (_, part) in enumerate(package.ordered("ppt/presentation.xml", "sldId", "slide"), 1):
            story(part, f"幻灯片第 {i} 页", False)
    if "xl/workbook.xml" in has:
        for title, part in _sheets(package):
            for drawing in linked(part, "drawing").values():
                images = linked(drawing, "image")
                for anchor in package.xml(drawing):
                    corner = next((n for n in anchor if local(n) == "from"), None)
                    number = {local(n): int(n.text or -1) for n in corner if local(n) in ("row", "col")} if corner is not None else {}
                    cell = UNANCHORED if not number else f"{column_letters(number['col'] + 1)}{number['row'] + 1}"
                    if number:
                        ref_at(cell)  # on the grid
                    shown += [(images[e], f"工作表 {title} · {cell}") for n in anchor.iter() if local(n) == "blip" and (e := attr(n, "embed")) in images]
    for pos, (media, location) in enumerate(dict.fromkeys(shown)):
        yield name, pos, media, location, None


def read_picture_places(files: DataFrame) -> DataFrame:
    """(doc_id, media, locations), in order."""
    places = per_file(files, picture_places, PLACE).filter(F.col("error").isNull())
    return places.groupBy("doc_id", "media").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "location"))), lambda x: x["location"]).alias("locations"))


STYLE = "doc_id string, style_id string, kind string, parent_id string, props map<string,string>, error string"
#: Run properties that styles hand on, and the attribute that holds each (fixed values).
RUN_PROPS = {"b": "val", "i": "val", "u": "val", "sz": "val", "color": "val", "rFonts": "ascii", "vertAlign": "val"}
#: Properties that switch: a style that sets one turns what it inherits (fixed values).
TOGGLES = ("b", "i")
OFF = ("0", "false", "off")


def styles(name: str, content: bytes) -> Iterator[tuple]:
    """A Word document's styles and document defaults (style id empty), each with the run properties it sets itself."""
    package = Package(content)
    if "word/styles.xml" not in package.names:
        return
    root = package.xml("word/styles.xml")

    def props(node: ET.Element | None) -> list[tuple[str, str]]:
        found, out = first(node, "rPr"), []
        for p in found if found is not None else ():
            name = local(p)
            if name in TOGGLES:
                out.append((name, "0" if attr(p, "val", "1") in OFF else "1"))
            elif name in RUN_PROPS:
                value = attr(p, RUN_PROPS[name], "1")
                if name in ("rFonts", "color"):  # an own value ends a theme's that was inherited, and the other way round
                    value = "" if attr(p, RUN_PROPS[name]) in ("", "auto") else value
                    theme = attr(p, "asciiTheme" if name == "rFonts" else "themeColor")
                    out.append((f"{name}Theme", "" if attr(p, "themeTint") + attr(p, "themeShade") else theme))
                out.append((name, value))
        return out

    defaults = first(root, "rPrDefault")
    yield name, "", "default", None, props(defaults), None
    for s in (n for n in root if local(n) == "style"):
        up = next((c for c in s if local(c) == "basedOn"), None)
        yield name, attr(s, "styleId"), attr(s, "type"), attr(up, "val") or None if up is not None else None, props(s), None


def read_styles(files: DataFrame) -> DataFrame:
    return per_file(files, styles, STYLE)


def resolved_styles(rows: DataFrame, most: int = 64) -> DataFrame:
    """J14, AR4, XM4: (doc_id, style_id, kind, props) with what each style inherits, by pointer doubling over maps.

    A parent of another kind or a missing one ends the chain; a cycle raises; document defaults come last. Bold and italics switch:
    of the styles in a chain that turn them on, an odd number leaves them turned.
    """
    from docengine.functions.arrays import merged as plain

    def merged(below: str, above: str) -> Column:
        turned = lambda k: (F.coalesce(F.try_element_at(F.col(below), F.lit(k)), F.lit("0")) != F.coalesce(F.try_element_at(F.col(above), F.lit(k)), F.lit("0"))).cast("int").cast("string")
        there = lambda k: F.map_contains_key(below, k) | F.map_contains_key(above, k)
        switched = F.map_filter(F.create_map(*[x for k in TOGGLES for x in (F.lit(k), F.when(there(k), turned(k)))]), lambda k, v: v.isNotNull())
        return plain(plain(below, above), switched)

    s = rows.filter(F.col("error").isNull())
    own = s.filter("kind <> 'default'")
    parents = own.select(F.col("doc_id").alias("d"), F.col("style_id").alias("p"), F.col("kind").alias("k"))
    linked = own.join(parents, (F.col("doc_id") == F.col("d")) & (F.col("parent_id") == F.col("p")) & (F.col("kind") == F.col("k")), "left")
    now = linked.select("doc_id", "style_id", "kind", F.col("p").alias("up"), "props")
    for _ in range(max(1, most.bit_length())):
        above = now.select(F.col("doc_id").alias("d"), F.col("style_id").alias("p"), F.col("kind").alias("k"), F.col("up").alias("up2"), F.col("props").alias("inherited"))
        j = now.join(above, (F.col("doc_id") == F.col("d")) & (F.col("up") == F.col("p")) & (F.col("kind") == F.col("k")), "left")
        now = written(j.select("doc_id", "style_id", "kind", F.col("up2").alias("up"), F.when(F.col("inherited").isNull(), F.col("props")).otherwise(merged("inherited", "props")).alias("props")))
        if not now.filter(F.col("up").isNotNull()).limit(1).count():
            break
    base = s.filter("kind = 'default'").select(F.col("doc_id").alias("d"), F.col("props").alias("defaults"))
    out = now.join(base, F.col("doc_id") == F.col("d"), "left")
    done = F.when(F.col("up").isNotNull(), F.raise_error(F.concat(F.lit("style cycle at "), "style_id")).cast("string")).otherwise(F.col("style_id"))
    whole = F.when(F.col("defaults").isNull(), F.col("props")).otherwise(merged("defaults", "props"))
    return out.select("doc_id", done.alias("style_id"), "kind", F.map_filter(whole, lambda k, v: v != "").alias("props"))


THEME = "doc_id string, name string, value string, error string"
#: A theme's colours by the names that texts use (fixed values).
THEME_COLORS = {"text1": "dk1", "dark1": "dk1", "text2": "dk2", "dark2": "dk2", "background1": "lt1", "light1": "lt1", "background2": "lt2", "light2": "lt2", "hyperlink": "hlink", "followedHyperlink": "folHlink", **{f"accent{i}": f"accent{i}" for i in range(1, 7)}}


def themes(name: str, content: bytes) -> Iterator[tuple]:
    """XM4: a Word document's theme as names and values: fonts (minorAscii, majorEastAsia:Hans), colours, languages (lang:Ascii)."""
    package = Package(content)
    parts = {k: t for _, k, t, external in package.relations("word/document.xml") if not external and t in package.names}
    if "theme" in parts:
        root = package.xml(parts["theme"])
        for group in ("major", "minor"):
            fonts = first(root, f"{group}Font")
            for node in fonts if fonts is not None else ():
                kind = {"latin": ("Ascii", "HAnsi"), "ea": ("EastAsia",)}.get(local(node), ())
                for k in ("Ascii", "HAnsi", "EastAsia") if local(node) == "font" else kind:
                    if node.get("typeface"):
                        yield name, f"{group}{k}" + (f":{node.get('script')}" if local(node) == "font" else ""), node.get("typeface"), None
        scheme = first(root, "clrScheme")
        held = {local(c): next(iter(c), None) for c in (scheme if scheme is not None else ())}
        for said, own in THEME_COLORS.items():
            node = held.get(own)
            value = (node.get("val") if local(node) == "srgbClr" else node.get("lastClr")) if node is not None and not len(node) else None
            if value and re.fullmatch("[0-9A-Fa-f]{6}", value):
                yield name, said, value.upper(), None
    if "settings" in parts:
        lang = first(package.xml(parts["settings"]), "themeFontLang")
        for key, k in (("val", "Ascii"), ("val", "HAnsi"), ("eastAsia", "EastAsia")):
            if lang is not None and attr(lang, key):
                yield name, f"lang:{k}", attr(lang, key), None


def read_themes(files: DataFrame) -> DataFrame:
    return per_file(files, themes, THEME)


def themed(styles_: DataFrame, themes_: DataFrame) -> DataFrame:
    """XM4: resolved styles with their theme's fonts, by language first, and colours; what the theme lacks stays as its name."""
    from docengine.functions.arrays import merged
    from docengine.functions.text import script_of

    t = themes_.filter(F.col("error").isNull()).groupBy(F.col("doc_id").alias("d")).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("theme"))
    both = styles_.join(t, F.col("doc_id") == F.col("d"), "left")
    said = lambda key: F.try_element_at("theme", key)
    font, color = F.try_element_at("props", F.lit("rFontsTheme")), F.try_element_at("props", F.lit("colorTheme"))
    lang = said(F.concat(F.lit("lang:"), F.regexp_extract(font, "^(?:major|minor)(.*)$", 1)))
    found = F.create_map(F.lit("rFonts"), F.coalesce(said(F.concat_ws(":", font, script_of(lang))), said(font)), F.lit("color"), said(color))
    props = merged("props", F.map_filter(found, lambda k, v: v.isNotNull()))
    done = F.map_filter(props, lambda k, v: ~((k == "rFontsTheme") & F.map_contains_key(props, "rFonts") | (k == "colorTheme") & F.map_contains_key(props, "color")))
    return both.select("doc_id", "style_id", "kind", done.alias("props"))


PAGE = "doc_id string, pos int, page int, tbl array<array<string>>, merges array<array<int>>, error string"


def table_pages(name: str, pos: int, tbl: list[list[str]], merges: list[list[int]], rows: int = 12, columns: int = 12) -> Iterator[tuple]:
    """E5, AR2, W13: pages of at most rows x columns that cut no merge; a merge that fits no page is kept whole."""
    from docengine.operators.layout import merge_pages

    down = merge_pages([1] * len(tbl), [(m[0], m[2]) for m in merges], rows)
    across = merge_pages([1] * len(tbl[0]), [(m[1], m[3]) for m in merges], columns)
    for page, (r, c) in enumerate((r, c) for r in down for c in across):
        part = [line[c[0] : c[1]] for line in tbl[r[0] : r[1]]]
        inside = [[m[0] - r[0], m[1] - c[0], m[2], m[3]] for m in merges if r[0] <= m[0] < r[1] and c[0] <= m[1] < c[1]]
        yield name, pos, page, part, inside, None


def paged(tables: DataFrame, rows: int = 12, columns: int = 12) -> DataFrame:
    """tables (doc_id, pos, tbl, merges) as their pages."""
    import pyarrow as pa
    from pyspark.sql import types as T

    from docengine.sources.archive import arrow_schema

    schema = arrow_schema(T.StructType.fromDDL(PAGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, p)) for p in table_pages(t["doc_id"], t["pos"], t["tbl"], t["merges"], rows, columns)], schema=schema)

    return tables.select("doc_id", "pos", "tbl", "merges").mapInArrow(run, PAGE)
