"""Document conversions as plans: readers, then native layout, then a writer per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.arrays import dense
from docengine.operators import layout, relational as R
from docengine.sources import archive, ooxml, pdf, writers


def _named(extension: str):
    return lambda path: f"{str(path).rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{extension}"


def word_to_slides(blocks: DataFrame, most_lines: int = 12) -> DataFrame:
    """Headings open slides, `most_lines` lines a slide, the title carried on."""
    text = blocks.filter(F.col("error").isNull())
    s = layout.sections(text).withColumn("body", F.when(F.col("level").between(1, 2), F.array().cast("array<string>")).otherwise(F.split("text", "\n")))
    lines = s.select("doc_id", "pos", "section", "section_title", F.posexplode_outer("body").alias("k", "line"))
    numbered = lines.withColumn("part", F.floor((F.sum(F.when(F.col("line").isNotNull(), 1).otherwise(0)).over(Window.partitionBy("doc_id", "section").orderBy("pos", "k")) - 1) / most_lines))
    slides = numbered.groupBy("doc_id", "section", F.greatest("part", F.lit(0)).alias("part")).agg(F.first("section_title", ignorenulls=True).alias("title"), F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "k", "line")))), lambda x: x["line"]).alias("body"))
    order = Window.partitionBy("doc_id").orderBy("section", "part")
    return slides.select("doc_id", F.row_number().over(order).alias("idx"), F.coalesce("title", F.lit("正文")).alias("title"), "body", F.array().cast("array<string>").alias("notes"))


def contents_pages(slides: DataFrame, per_page: int = 18) -> DataFrame:
    """(doc_id, toc_page, entries): titles by first occurrence, `per_page` a page."""
    titles = slides.groupBy("doc_id", "title").agg(F.min("idx").alias("idx"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx"))
    return titles.withColumn("toc_page", F.floor((n - 1) / per_page).cast("int")).groupBy("doc_id", "toc_page").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "title"))), lambda x: x["title"]).alias("entries"))


#: What each mode of slides -> document tells of a slide, in order, and the line that leads its notes (fixed values).
MODES = {"outline": (("title", "body"), ""), "handout": (("title", "body", "notes"), "备注"), "notes-first": (("title", "notes", "body"), "讲者备注"), "mixed": (("title", "place", "body", "notes"), "备注")}
PLACE, CONTENTS = "幻灯片缩略图占位：第 %d 页", "目录"


def slides_to_blocks(slides: DataFrame, mode: str = "outline", contents: bool = False) -> DataFrame:
    """Blocks in the mode's order; with a table of contents first if asked."""
    order, lead = MODES[mode]
    line = lambda x, level=0: F.struct(x.alias("text"), F.lit(level).alias("level"))
    lines = lambda c: F.transform(F.filter(c, lambda x: x != ""), lambda x: line(x))
    notes = lines("notes")
    part = {"title": F.array(line(F.col("title"), 1)), "place": F.array(line(F.format_string(PLACE, "idx"))), "body": lines("body"), "notes": F.when(F.size(notes) > 0, F.concat(F.array(line(F.lit(lead))), notes)).otherwise(notes)}
    ok = slides.filter(F.col("error").isNull()) if "error" in slides.columns else slides
    told = ok.select("doc_id", "idx", F.posexplode(F.concat(*[part[p] for p in order])).alias("k", "b")).select("doc_id", (F.col("idx").cast("long") * 100_000 + F.col("k")).alias("pos"), "b.text", "b.level")
    if not contents:
        return told
    entries = ok.select("doc_id", F.col("idx").cast("long").alias("pos"), F.concat_ws(". ", F.col("idx").cast("string"), "title").alias("text"), F.lit(0).alias("level"))
    heads = ok.select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("pos"), F.lit(CONTENTS).alias("text"), F.lit(1).alias("level"))
    return R.union_all([heads, entries, told])


def write_docx(blocks: DataFrame) -> DataFrame:
    return writers.per_group(blocks, "doc_id", ["pos"], writers.docx, _named("docx"))


def write_pptx(slides: DataFrame) -> DataFrame:
    return writers.per_group(slides, "doc_id", ["idx"], writers.pptx, _named("pptx"))


def pdf_to_word(files: DataFrame) -> DataFrame:
    """C3."""
    lines = pdf.read_pdf(files).filter(F.col("error").isNull())
    return write_docx(lines.select("doc_id", "pos", "text", F.lit(0).alias("level")))


def sheet_lines(cells: DataFrame) -> DataFrame:
    """(doc_id, sheet_index, row, line): a row's values by column."""
    per = cells.groupBy("doc_id", "sheet_index", "sheet_name", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"]), "  ").alias("line"))
    return per


def excel_to_pdf(cells: DataFrame) -> DataFrame:
    """C4: one line a row."""
    lines = sheet_lines(cells)
    return writers.per_group(lines, "doc_id", ["sheet_index", "row"], lambda rows: writers.pdf([r["line"] for r in rows]), _named("pdf"))


def sheet_tables(cells: DataFrame, group: int = 60) -> DataFrame:
    """(doc_id, sheet_index, part, tbl): existing rows and columns only, `group` columns a table, row numbers first."""
    from docengine.functions.text import column_letters

    sheet = ["doc_id", "sheet_index"]  # cells are shuffled once, by sheet; all that follows stays where it lies
    at = F.dense_rank().over(Window.partitionBy(*sheet).orderBy("col")) - 1
    placed = cells.select(*sheet, "row", "col", "value", at.alias("at")).withColumn("part", F.floor(F.col("at") / group).cast("int")).withColumn("at", F.col("at") % group)
    rows = placed.groupBy(*sheet, "part", "row").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("m"), F.collect_list("col").alias("cols"), F.max("at").alias("last"))
    filled = F.transform(F.array("m"), lambda m: F.transform(F.sequence(F.lit(0), "last"), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(""))))  # as an item, the map is made once a row
    wide = rows.select(*sheet, "part", "row", "cols", "last", F.concat(F.array(F.col("row").cast("string")), F.get(filled, F.lit(0))).alias("cells"))
    body = wide.groupBy(*sheet, "part").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cols")))).alias("cols"), F.max("last").alias("last"), F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("body"))
    lines = F.transform("body", lambda x: F.concat(x["cells"], F.array_repeat(F.lit(""), F.col("last") + 2 - F.size(x["cells"]))))
    return body.select(*sheet, "part", F.concat(F.array(F.concat(F.array(F.lit("行号")), F.transform("cols", lambda c: column_letters(c)))), lines).alias("tbl"))


def excel_to_word(cells: DataFrame) -> DataFrame:
    """C5."""
    tables = sheet_tables(cells)
    pos = F.col("sheet_index") * 1000 + F.col("part")
    return write_docx(tables.select("doc_id", pos.alias("pos"), F.lit("").alias("text"), F.lit(0).alias("level"), "tbl"))


CHARTS = "array<struct<kind:string,series:array<struct<name:string,categories:array<string>,values:array<string>>>>>"


def excel_to_slides(cells: DataFrame, points: DataFrame, rows_a_slide: int = 12, kind: str = "bar") -> DataFrame:
    """A sheet's rows by twelves, then a slide a chart, as a native chart of all its series."""
    lines = sheet_lines(cells)
    part = F.floor((F.row_number().over(Window.partitionBy("doc_id", "sheet_index").orderBy("row")) - 1) / rows_a_slide).cast("int")
    text = lines.withColumn("part", part).groupBy("doc_id", "sheet_index", "part").agg(F.first("sheet_name").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]).alias("body"))
    table = ooxml.chart_table(points)
    at = lambda c: F.map_from_entries(F.collect_list(F.struct("idx", c)))
    series = table.groupBy("doc_id", "sheet_index", "chart", "series").agg(F.first("name").alias("name"), dense(at("category")).alias("categories"), dense(at("value")).alias("values"))
    charts = series.groupBy("doc_id", "sheet_index", "chart").agg(F.array_sort(F.collect_list(F.struct("series", "name", "categories", "values"))).alias("s"))
    drawn = F.array(F.struct(F.lit(kind).alias("kind"), F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["categories"].alias("categories"), x["values"].alias("values"))).alias("series"))).cast(CHARTS)
    none = F.array().cast("array<string>")
    both = text.select("doc_id", "sheet_index", F.col("part").alias("o"), "title", "body", F.array().cast(CHARTS).alias("charts"))
    both = both.unionByName(charts.select("doc_id", "sheet_index", (F.lit(1_000_000) + F.col("chart")).alias("o"), F.col("s")[0]["name"].alias("title"), none.alias("body"), drawn.alias("charts")))
    return both.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("sheet_index", "o")).alias("idx"), F.coalesce("title", F.lit("")).alias("title"), "body", none.alias("notes"), "charts")


def select_sheets(cells: DataFrame, wanted: list[str]) -> DataFrame:
    """by name (case and ends ignored) or by 1-based number; nothing found raises when the rows are read."""
    keys = [w.strip().lower() for w in wanted]
    hit = F.lower(F.trim("sheet_name")).isin(keys) | F.col("sheet_index").cast("string").isin(keys)
    found = cells.filter(hit)
    none = cells.agg(F.count_if(hit).alias("n")).filter("n = 0").select(F.raise_error(F.lit("no such sheet")).cast("string").alias("doc_id"))
    return found.unionByName(none, allowMissingColumns=True)


def select_cells(cells: DataFrame, ranges: list[str] | None = None, first_n: int = 12) -> DataFrame:
    """Cells in any of the ranges, by interval; without ranges the first n of each sheet by (row, col), n from 1 to 200."""
    if ranges:
        hit = None
        for top, left, bottom, right in map(ooxml.range_at, ranges):
            box = F.col("row").between(top, bottom) & F.col("col").between(left, right)
            hit = box if hit is None else hit | box
        return cells.filter(hit)
    n = min(200, max(1, first_n))
    w = Window.partitionBy("doc_id", "sheet_index").orderBy("row", "col")
    return cells.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def select_merges(merges: DataFrame, ranges: list[str]) -> DataFrame:
    """merges that a selected range wholly contains."""
    hit = None
    for top, left, bottom, right in map(ooxml.range_at, ranges):
        inside = (F.col("top") >= top) & (F.col("left") >= left) & (F.col("bottom") <= bottom) & (F.col("right") <= right)
        hit = inside if hit is None else hit | inside
    return merges.filter(hit)


def formula_mode(cells: DataFrame) -> DataFrame:
    """a formula's stored result, or a note that none is stored; zero is a result."""
    shown = F.when(F.col("formula") != "", F.coalesce(F.nullif("result", F.lit("")), F.lit("计算结果未保存"))).otherwise(F.col("value"))
    return cells.withColumn("value", shown)


def previews(blocks: DataFrame, slides: DataFrame, cells: DataFrame, lines: DataFrame, sizes: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, page, text) with each kind's cap. sizes: image headers; entries: what archives hold."""
    rn = lambda key, *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    a = blocks.filter("error is null").withColumn("n", rn(["doc_id"], "pos")).filter("n <= 30").select("doc_id", F.lit("Word").alias("kind"), F.col("n").alias("page"), F.left("text", F.lit(240)).alias("text"))
    b = slides.filter("error is null and idx <= 40").select("doc_id", F.lit("PPT").alias("kind"), F.col("idx").alias("page"), F.left("title", F.lit(240)).alias("text"))
    c = cells.filter("error is null and sheet_index <= 24").withColumn("n", rn(["doc_id", "sheet_index"], "row", "col")).filter("n <= 16").groupBy("doc_id", "sheet_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]), " ").alias("text")).select("doc_id", F.lit("Excel").alias("kind"), F.col("sheet_index").alias("page"), F.left("text", F.lit(600)).alias("text"))
    d = lines.filter("error is null").withColumn("page", F.floor(F.col("pos") / 42).cast("int") + 1).filter("page <= 20").groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text")).select("doc_id", F.lit("PDF").alias("kind"), "page", "text")
    parts = [a, b, c, d]
    if sizes is not None:
        said = F.format_string("%d × %d", "width", "height")
        parts.append(sizes.select("doc_id", F.lit("图片").alias("kind"), F.lit(1).alias("page"), F.when(F.col("error").isNull(), said).otherwise("尺寸未知").alias("text")))
    if entries is not None:
        shown = archive.preview(entries.filter("error is null"), 40)
        parts.append(shown.select("doc_id", F.lit("压缩包").alias("kind"), (F.col("pos") + 1).alias("page"), F.left(F.concat_ws(" ", "part", F.col("size").cast("string")), F.lit(240)).alias("text")))
    return R.union_all(parts)


def compare_previews(before: DataFrame, after: DataFrame) -> DataFrame:
    """Pages by kind before and after, with what was lost."""
    n = lambda df: df.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return R.compared(n(before), n(after), "kind", "n").withColumn("lost", F.greatest(-F.col("delta"), F.lit(0)))
