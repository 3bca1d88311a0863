"""Queries that put the library's functions to work on the tables: stores, selections, conversions, checks of files, plans of tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import arrays, binary, maths, temporal, text
from docengine.functions import redaction as R
from docengine.operators import layout, merges
from docengine.operators.lineage import shared_dir, written
from docengine.operators.relational import spread
from docengine.operators.upkeep import Report
from docengine.plans import conversions as C
from docengine.plans import workbench as W
from docengine.plans.documents import BARE, PDF_LINES
from docengine.plans.sheets import LINES, lines
from docengine.plans.tables import Tables
from docengine.registry import query
from docengine.sources import archive, images, ooxml, pdf, store, writers
from docengine.streaming import taskstates


def _files(made: DataFrame) -> DataFrame:
    return made.select(F.col("name").alias("path"), "content")


def _store(spark: SparkSession) -> store.Store:
    return store.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 2 = 0 THEN 'later' END AS note FROM labels WHERE doc_id % 3 = 0 ORDER BY doc_id DESC""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table saved, changed by key with a new column, and scanned newest first."""
    s, labels = _store(spark), Tables(spark, sf_dir).labels.select("doc_id", "quality")
    s.save("labels", labels, ["doc_id"])
    s.save("labels", labels.filter("doc_id % 2 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit("later").alias("note")), ["doc_id"])
    return s.newest("labels", F.col("doc_id") % 3 == 0, order=("doc_id",))


@query("""SELECT doc_id, CASE WHEN doc_id % 100 = 7 THEN 1 - quality ELSE quality END AS quality, toxic, (SELECT count(*) FROM labels WHERE doc_id % 100 = 7) AS rows_written, (SELECT count(*) FROM labels) AS rows_before FROM labels WHERE doc_id % 100 <> 9""")
def store_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundredth of a table upserted and another deleted by two writers with one snapshot; each writes its own rows only."""
    s, labels = _store(spark), Tables(spark, sf_dir).labels
    s.write("labels", labels)
    one, other = s.begin(), s.begin()
    one.save("labels", one.read("labels").filter("doc_id % 100 = 7").withColumn("quality", 1 - F.col("quality")), ["doc_id"])
    other.delete("labels", other.read("labels").filter("doc_id % 100 = 9"), "doc_id")
    one.commit()
    other.commit()  # on top of the first: they share no key
    base, delta, *_ = s.current()["labels"]
    return s.read("labels").withColumns({"rows_written": F.lit(delta["rows"]).cast("long"), "rows_before": F.lit(base["rows"]).cast("long")})


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'moved' ELSE lang END AS lang, CASE WHEN doc_id % 9 = 4 THEN n_chars * 2 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 11 <> 3 AND lang <> 'fr')
SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, min(n_chars) AS shortest, max(n_chars) AS longest FROM d GROUP BY lang""")
def report_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of languages rewritten in place after documents moved, grew and went: counters adjusted, lost extremes read again."""
    s, docs = _store(spark), Tables(spark, sf_dir).documents.select("doc_id", "lang", "n_chars")
    s.write("documents", docs)
    report = Report(s, "languages", "documents", ["lang"], {"chars": F.col("n_chars")}, {"shortest": F.col("n_chars")}, {"longest": F.col("n_chars")})
    report.build()
    s.save("documents", docs.filter("doc_id % 9 = 4 and lang <> 'fr'").select("doc_id", F.lit("moved").alias("lang"), (F.col("n_chars") * 2).alias("n_chars")), ["doc_id"])
    report.refresh()
    s.delete("documents", docs.filter("doc_id % 11 = 3 or lang = 'fr'"), "doc_id")
    report.refresh()
    return s.read("languages")


@query("""WITH g AS (SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3) SELECT 'orders' AS table_name, (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM g)) AS kept
UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM g))""")
def store_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cascade over two stored tables as one commit; what both hold afterwards."""
    s, t = _store(spark), Tables(spark, sf_dir)
    s.write("orders", t.orders.select("o_orderkey", "o_custkey"))
    s.write("lineitem", t.lineitem.select("l_orderkey", "l_linenumber"))
    s.cascade({"lineitem": "l_orderkey", "orders": "o_orderkey"}, t.orders.filter("o_custkey % 10 = 3").select("o_orderkey"), "o_orderkey")
    count = lambda name: s.read(name).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("kept"))
    return count("orders").unionByName(count("lineitem"))


@query("""SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as one JSON file, read back under a schema."""
    at = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    rows = Tables(spark, sf_dir).nation.select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("in")).alias("o"))
    rows.agg(F.to_json(F.collect_list("o"))).coalesce(1).write.text(at)  # nations are a fixed few
    return store.read_json_objects(spark, at, "id int, name string, `in` struct<region:int>").select("id", "name", "in.region")


@query("""SELECT CAST(count(*) AS BIGINT) AS pages, CAST(sum(strlen(html)) + count(*) AS BIGINT) AS bytes FROM pages""")
def landing_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that landed in a folder: their bytes and lines (pages are single lines here)."""
    at = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    Tables(spark, sf_dir).pages.select(F.regexp_replace("html", "[\r\n]", " ").alias("value")).write.text(at)
    landed = archive.landed(spark, at, "part-*")
    return landed.agg(F.sum(F.regexp_count(F.decode("content", "UTF-8"), F.lit("\n"))).cast("long").alias("pages"), F.sum("length").alias("bytes"))


CELLS = """c AS (SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, l_linenumber AS sheet_index, 'Sheet ' || l_linenumber AS sheet_name, CAST(l_orderkey % 50 + 1 AS INTEGER) AS "row", CAST(l_partkey % 20 + 1 AS INTEGER) AS col,
max(l_returnflag) AS flag, max(l_discount) > 0.05 AS computed, max(l_quantity) > 25 AS stored FROM lineitem GROUP BY 1, 2, 3, 4, 5),
cells AS (SELECT *, CASE WHEN computed AND NOT stored THEN '' ELSE flag END AS result, CASE WHEN computed THEN '1-1' ELSE '' END AS formula,
CASE WHEN computed AND stored THEN flag || ' (=1-1)' WHEN computed THEN '=1-1' ELSE flag END AS value FROM c)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_suppkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("sheet_index"), (F.col("l_orderkey") % 50 + 1).cast("int").alias("row"), (F.col("l_partkey") % 20 + 1).cast("int").alias("col"))
    c = c.agg(F.max("l_returnflag").alias("flag"), (F.max("l_discount") > 0.05).alias("computed"), (F.max("l_quantity") > 25).alias("stored"))
    result = F.when(F.col("computed") & ~F.col("stored"), "").otherwise(F.col("flag"))
    formula = F.when(F.col("computed"), "1-1").otherwise("")
    value = F.when(F.col("computed") & F.col("stored"), F.concat("flag", F.lit(" (=1-1)"))).when(F.col("computed"), "=1-1").otherwise(F.col("flag"))
    return c.select("doc_id", "sheet_index", F.concat(F.lit("Sheet "), F.col("sheet_index").cast("string")).alias("sheet_name"), "row", "col", value.alias("value"), result.alias("result"), formula.alias("formula"), F.lit(None).cast("string").alias("error"))


@query(f"""WITH {CELLS} SELECT doc_id, sheet_index, "row", col, value FROM cells WHERE sheet_index IN (2, 5)""")
def select_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, XM3: sheets by name, case and ends ignored, or by number."""
    return C.select_sheets(_cells(spark, sf_dir), [" sheet 2", "5"]).select("doc_id", "sheet_index", "row", "col", "value")


@query(f"""WITH {CELLS} SELECT doc_id, sheet_index, "row", col FROM cells WHERE ("row" BETWEEN 2 AND 9 AND col BETWEEN 2 AND 4) OR ("row" BETWEEN 1 AND 20 AND col = 6)""")
def select_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, STR16: cells in any of the ranges, by interval."""
    return C.select_cells(_cells(spark, sf_dir), ["b2:D9", "F1:F20"]).select("doc_id", "sheet_index", "row", "col")


@query(f"""WITH {CELLS} SELECT doc_id, sheet_index, "row", col FROM cells QUALIFY row_number() OVER (PARTITION BY doc_id, sheet_index ORDER BY "row", col) <= 5""")
def first_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cells of each sheet by (row, col)."""
    return C.select_cells(_cells(spark, sf_dir), None, 5).select("doc_id", "sheet_index", "row", "col")


@query("""SELECT p_partkey FROM part WHERE p_size >= 2 AND p_partkey % 10 + 1 >= 2 AND p_size + p_partkey % 3 <= 20 AND p_partkey % 10 + 1 + p_partkey % 4 <= 9""")
def select_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """merges that the selection wholly holds."""
    left = F.col("p_partkey") % 10 + 1
    merges = Tables(spark, sf_dir).part.select("p_partkey", F.col("p_size").alias("top"), left.alias("left"), (F.col("p_size") + F.col("p_partkey") % 3).alias("bottom"), (left + F.col("p_partkey") % 4).alias("right"))
    return C.select_merges(merges, ["B2:I20"]).select("p_partkey")


@query(f"""WITH {CELLS} SELECT doc_id, sheet_index, "row", col, CASE WHEN formula = '' THEN value WHEN result = '' THEN '计算结果未保存' ELSE result END AS value FROM cells""")
def formula_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a formula's stored result, or a note that there's none."""
    return C.formula_mode(_cells(spark, sf_dir)).select("doc_id", "sheet_index", "row", "col", "value")


@query("""WITH s AS (SELECT source AS key, max(lang) AS value FROM documents GROUP BY 1), d(key, fallback, forced) AS (VALUES ('src1', 'default', NULL), ('src2', 'default', 'forced'), ('missing', 'default', NULL), ('src3', 'default', NULL), ('only', 'forced too', 'forced too'))
SELECT d.key, coalesce(d.forced, s.value, d.fallback) AS value FROM d LEFT JOIN s ON s.key = d.key""")
def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, M9: settings saved by source over defaults, forced ones over both; unknown keys are ignored."""
    saved = Tables(spark, sf_dir).documents.groupBy(F.col("source").alias("key")).agg(F.max("lang").alias("value"))
    return W.settings(saved, {"src1": "default", "src2": "default", "missing": "default", "src3": "default"}, {"src2": "forced", "only": "forced too"})


@query(f"""SELECT doc_id, pos FROM ({LINES}) WHERE NOT contains(line, '|')""")
def preserved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """switches drop kinds of blocks; lines with bars count as tables here."""
    blocks = lines(spark, sf_dir).withColumn("kind", F.when(F.col("line").contains("|"), "table").otherwise("paragraph"))
    return W.preserved(blocks, tables=False).select("doc_id", "pos")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, left(event_type || ' of ' || user_id, 12) AS label, list_filter([event_type, 'view', 'root'], lambda x: list_contains(['click', 'view', 'error'], x)) AS capabilities FROM events""")
def allowed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of a payload only the fields of an allow-list, texts cut, names of a known set."""
    payload = F.to_json(F.struct(F.from_json("props", "k bigint")["k"].alias("k"), F.concat_ws(" of ", "event_type", F.col("user_id").cast("string")).alias("label"), F.array("event_type", F.lit("view"), F.lit("root")).alias("capabilities"), F.lit("secret").alias("token")))
    kept = W.allowed(payload, "k bigint, label string, capabilities array<string>", most=12, known={"capabilities": ["click", "view", "error"]})
    return Tables(spark, sf_dir).events.select("event_id", kept.alias("p")).select("event_id", "p.k", "p.label", "p.capabilities")


@query("""SELECT conv_id, turn, substr(role || ': ' || text, 6, 40) AS shown, role || ': ' <> '' AS styled FROM conversations WHERE length(role || ': ' || text) > 5""")
def sliced_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR11: forty characters from the sixth on, over runs of two styles."""
    run = lambda t, bold: F.struct(t.alias("text"), F.lit(bold).alias("b"))
    runs = F.array(run(F.concat("role", F.lit(": ")), True), run(F.col("text"), False))
    cut = Tables(spark, sf_dir).conversations.select("conv_id", "turn", text.slice_runs(runs, 5, 40).alias("cut"))
    return cut.filter(F.size("cut") > 0).select("conv_id", "turn", F.array_join(F.transform("cut", lambda x: x["text"]), "").alias("shown"), F.exists("cut", lambda x: x["b"].isNotNull()).alias("styled"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size % 9 + 1 WHEN 1 THEN 1 WHEN 2 THEN CASE WHEN p_size = 1 THEN 1 ELSE 0 END WHEN 3 THEN p_size % 9 + 1 ELSE CASE WHEN p_size = 1 THEN 1 ELSE 0 END END AS level FROM part""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5: levels from style names; a title and the first paragraph are 1."""
    n = (F.col("p_size") % 9 + 1).cast("string")
    style = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("Heading "), n)).when(F.col("p_partkey") % 5 == 1, "Title").when(F.col("p_partkey") % 5 == 2, "Normal").when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("heading_"), n)).otherwise("heading10")
    return Tables(spark, sf_dir).part.select("p_partkey", text.heading_level(style, F.col("p_size")).alias("level"))


@query("""SELECT doc_id AS id, source || CASE WHEN rn > 1 THEN '-' || (rn - 1) ELSE '' END || '.txt' AS file_name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2, STR7: doubled names are numbered in order of arrival."""
    return W.stored_names(Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".txt")).alias("file_name")), "rename").select("id", "file_name")


@query("""SELECT min(doc_id) AS skip, max(doc_id) AS overwrite, source FROM documents GROUP BY source""")
def duplicate_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of files with one name the first stays (skip) or the last (overwrite)."""
    named = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), F.col("source").alias("file_name"))
    kept = lambda how: W.stored_names(named, how).select(F.col("file_name").alias("source"), F.col("id").alias(how))
    return kept("skip").join(kept("overwrite"), "source")


@query("""SELECT p_partkey, CAST(length(p_name) + CASE WHEN p_partkey % 2 = 0 THEN 8 ELSE 2 END AS BIGINT) AS width FROM part""")
def display_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR12: East Asian wide characters take two columns."""
    return Tables(spark, sf_dir).part.select("p_partkey", text.display_width(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "中文，。").otherwise("ab"))).alias("width"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN '失败' WHEN 'purchase' THEN '成功' WHEN 'signup' THEN '成功' ELSE '处理中' END AS status FROM events""")
def status_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR13: a status by any of its spellings."""
    return Tables(spark, sf_dir).events.select("event_id", text.alias_of(F.concat(F.lit(" "), F.upper("event_type")), {"error": "失败", "purchase": "成功", "signup": "成功"}, "处理中").alias("status"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'xl/drawings/d' || p_size || '.xml' WHEN 1 THEN 'abs/' || p_size WHEN 2 THEN NULL WHEN 3 THEN 'xl/worksheets/sheet' || p_size || '.xml' ELSE 'xl/worksheets/b' END AS part FROM part""")
def resolved_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR17, I5: relationship targets as part names; what leaves the package is null."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    target = F.when(k == 0, F.concat(F.lit("../drawings/d"), n, F.lit(".xml#f"))).when(k == 1, F.concat(F.lit("/abs/"), n)).when(k == 2, "../../../x").when(k == 3, "").otherwise("./a/../b")
    return Tables(spark, sf_dir).part.select("p_partkey", text.resolve_part(F.concat(F.lit("xl/worksheets/sheet"), n, F.lit(".xml")), target).alias("part"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CASE WHEN source IN ('src1', 'src2') THEN 'Hant' ELSE 'Hans' END WHEN 1 THEN NULL WHEN 2 THEN 'Jpan' WHEN 3 THEN 'Cyrl' WHEN 4 THEN 'Hang' ELSE CASE WHEN lang = 'en' THEN 'Latn' END END AS script FROM documents""")
def language_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR19: the script that a language tag stands for."""
    k = F.col("doc_id") % 6
    tag = F.when(k == 0, F.when(F.col("source").isin("src1", "src2"), "zh_TW").otherwise("zh-CN")).when(k == 1, "zh").when(k == 2, "ja-JP").when(k == 3, F.concat("lang", F.lit("-CYRL-x"))).when(k == 4, "ko-KR").otherwise(F.col("lang"))
    return Tables(spark, sf_dir).documents.select("doc_id", text.script_of(tag).alias("script"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at FROM events""")
def iso_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT1: instants as ISO seconds in UTC."""
    return Tables(spark, sf_dir).events.select("event_id", temporal.iso_seconds("ts").alias("at"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size + 0.123 WHEN 1 THEN NULL WHEN 2 THEN p_size * 100.0 ELSE NULL END AS value FROM part""".replace("p_size + 0.123", "CAST(p_size + 0.123 AS DOUBLE)").replace("p_size * 100.0", "CAST(p_size * 100.0 AS DOUBLE)"))
def finite_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA6: exact decimals; text, NaN and infinities are null."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    said = F.when(k == 0, F.concat(F.lit(" "), n, F.lit(".123"))).when(k == 1, "NaN").when(k == 2, F.concat(n, F.lit("e2"))).otherwise("Infinity")
    return Tables(spark, sf_dir).part.select("p_partkey", maths.finite_decimal(said).cast("double").alias("value"))


@query("""SELECT doc_id, array_to_string(list_transform(range(1, CAST(doc_id % 4 + 2 AS BIGINT)), lambda i: rtrim(repeat('x.', i), '.') || repeat('.', doc_id % 4 + 1 - i)), '/') AS grid FROM documents""")
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR1: ragged rows as a rectangle."""
    ragged = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 4 + 1).cast("int")), lambda i: F.array_repeat(F.lit("x"), i))
    return Tables(spark, sf_dir).documents.select("doc_id", F.array_join(F.transform(arrays.padded(ragged), lambda r: F.array_join(r, ".")), "/").alias("grid"))


@query("""SELECT doc_id, doc_id % 7 AS a, doc_id % 7 + 11 AS d FROM documents""")
def sub_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR2: a part of a matrix."""
    m = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda c: F.col("doc_id") % 7 + r * 10 + c - 10))
    cut = arrays.sub_matrix(m, 2, 1, 2, 2)
    return Tables(spark, sf_dir).documents.select("doc_id", cut[0][0].alias("a"), cut[1][1].alias("d"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, array_to_string(list(event_type || '=' || n ORDER BY event_type)[:3], ';') AS top FROM n GROUP BY user_id""")
def top_map_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR6: the first entries of a map, by key."""
    n = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return maps.select("user_id", F.array_join(F.transform(arrays.top_entries("m", 3), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";").alias("top"))


@query(f"""SELECT page_id, '{{"items":[{{"file_path":"{R.LABEL}/' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) || '","note":"see {R.LABEL}/x.txt","file_path_available":true}}],"meta":{{"token":"","n":' || page_id || '}}}}' AS payload FROM pages""")
def redact_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, F19, JS3, JS4: nested payloads: paths are told by labels and secrets emptied, at any depth."""
    item = F.struct(F.col("url").alias("file_path"), F.lit("see /home/user/x.txt").alias("note"))
    payload = F.struct(F.array(item).alias("items"), F.struct(F.lit("abc").alias("token"), F.col("page_id").alias("n")).alias("meta"))
    p = Tables(spark, sf_dir).pages.select("page_id", payload.alias("payload"))
    return R.redact_rows(p).select("page_id", F.to_json("payload").alias("payload"))


@query(f"""WITH e AS (SELECT event_id, event_type AS t, user_id AS u, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
b AS (SELECT *, '{R.LABEL}/' || t || '.html' AS html, k % 4 > 0 AS given FROM e)
SELECT event_id, '{{"a":{{"list":[{{"output_path":"{R.LABEL}/' || t || '.docx","output_path_available":true}},"saw {R.LABEL}/x.txt ' || u || '",[[' || k || ',null,"\\"html_path\\":\\"s/' || t || '\\""]]],"token":""}},"backup_available":' || given || ',"backup_path":"' || CASE WHEN given THEN '{R.LABEL}/b' || k ELSE '' END || '","backup_path_available":' || given
|| ',"html_path":"' || html || '","html_path_available":true,"k":' || k || ',"outputs":{{"pdf":"{R.LABEL}/' || k || '.pdf","txt":""}},"outputs_available":{{"pdf":true,"txt":false}},"path":' || CASE WHEN k % 2 = 0 THEN '"","path_available":false' ELSE '"{R.LABEL}","path_available":true' END || '}}' AS payload FROM b""")
def redact_json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, F18, JS3: payloads of unknown shape as they may be shown: the events' own with keys, escapes and nesting around them."""
    k, t = F.get_json_object("props", "$.k"), F.col("event_type")
    parts = [
        '{"html_path":"secret/dir/', t, '.html","outputs":{"pdf":"C:\\\\out\\\\', k, '.pdf","txt":""},"a":{"token":"x\\"y","list":[{"output_path":"/home/u/out/', t, '.docx"},"saw /tmp/d/x.txt ', F.col("user_id").cast("string"), '",[[', k, ',null,"\\"html_path\\":\\"s/', t, '\\""]]]},"path":',
        F.when(k.cast("long") % 2 == 0, "[]").otherwise('["/a/b"]'), ',"backup_path":', F.when(k.cast("long") % 4 > 0, F.concat(F.lit('"/var/x/b'), k, F.lit('/"'))).otherwise("null"), F.concat(F.lit(","), F.substring(F.col("props"), F.lit(2), F.length("props"))),
    ]
    said = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    # the events' file is a split or two, and the work is in the texts
    dealt = Tables(spark, sf_dir).events.select("event_id", said.alias("payload")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return R.redact_json(dealt, "payload")


@query("""SELECT page_id, sha256('data:text/html;base64,' || base64(encode(html))) AS uri_sha256, sha256(html) AS back_sha256 FROM pages""")
def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BI2: whole pages inside documents, there and back."""
    p = Tables(spark, sf_dir).pages.select("page_id", binary.data_uri(F.col("html").cast("binary"), F.lit("text/html")).alias("uri"))
    return p.select("page_id", F.sha2("uri", 256).alias("uri_sha256"), F.sha2(binary.from_data_uri("uri"), 256).alias("back_sha256"))


HEADS = [("89504E470D0A1A0A00", "png"), ("47494638396100", "gif"), ("424D0000", "bmp"), ("FFD8FFE0", "jpeg"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("255044462D", "pdf"), ("504B030414", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("00112233", None)]


@query(f"""SELECT vec_id, CASE vec_id % 10 {" ".join(f"WHEN {i} THEN '{k}'" for i, (_, k) in enumerate(HEADS) if k)} END AS kind FROM embeddings""")
def magic_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BI5: formats by their first bytes."""
    head = F.element_at(F.array(*[F.lit(h) for h, _ in HEADS]), (F.col("vec_id") % 10 + 1).cast("int"))
    return Tables(spark, sf_dir).embeddings.select("vec_id", binary.kind_of(F.unhex(head)).alias("kind"))


@query("""SELECT c_custkey, c_custkey % 4 = 0 AS legacy FROM customer""")
def legacy_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of old containers: one in four is whole, the others have a wrong version, a wrong order or are too short."""
    k = F.col("c_custkey") % 4
    fields = F.when(k == 1, "3E000900FEFF09000600").when(k == 2, "3E000300FFFE09000600").otherwise("3E000300FEFF09000600")
    head = F.concat(F.lit("D0CF11E0A1B11AE1"), F.repeat(F.lit("0"), 32), fields, F.repeat(F.lit("0"), F.when(k == 3, 20).otherwise(956)))
    return Tables(spark, sf_dir).customer.select("c_custkey", F.coalesce(binary.is_legacy_office(F.unhex(head)), F.lit(False)).alias("legacy"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Word' WHEN 1 THEN 'Word' WHEN 2 THEN 'PDF' WHEN 3 THEN '图片' ELSE '未知' END AS file_type, CAST(CASE WHEN page_id % 5 = 3 THEN 0 ELSE strlen(html) + CASE WHEN page_id % 5 = 0 THEN 4 ELSE 0 END END AS BIGINT) AS file_size,
CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '内容与扩展名不符' WHEN 2 THEN 'PDF 不完整' WHEN 3 THEN '空文件' ELSE '不支持的类型' END AS errors FROM pages""")
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed files typed by extension and checked against their first bytes."""
    k = F.col("page_id") % 5
    name = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in (".docx", ".DOCX", ".pdf", ".png", ".xyz")]), (k + 1).cast("int")))
    content = F.when(k == 0, F.concat(F.unhex(F.lit("504B0304")), F.col("html").cast("binary"))).when(k == 3, F.unhex(F.lit(""))).otherwise(F.col("html").cast("binary"))
    got = W.ingest(Tables(spark, sf_dir).pages.select(name.alias("path"), content.alias("content")))
    return got.select(F.regexp_extract("file_name", "^([0-9]+)", 1).cast("long").alias("page_id"), "file_type", "file_size", F.array_join("validation_errors", "；").alias("errors"))


@query(f"""SELECT doc_id || '.docx' AS doc_id, count(*) AS paragraphs, CAST(0 AS BIGINT) AS tables, CAST(0 AS BIGINT) AS omml FROM ({LINES}) GROUP BY doc_id""")
def word_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of Word files, counted in their document part."""
    blocks = lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "pos", F.col("line").alias("text"), F.lit(0).alias("level"))
    return W.object_summary(_files(C.write_docx(blocks)))


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a deck: a slide a turn, system turns as notes only."""
    c = Tables(spark, sf_dir).conversations.filter("text is not null")
    note = F.when(F.col("role") == "system", F.array("text")).otherwise(F.array().cast("array<string>"))
    body = F.when(F.col("role") == "system", F.array().cast("array<string>")).otherwise(F.array("text"))
    return c.select(F.col("conv_id").cast("string").alias("doc_id"), F.row_number().over(C.Window.partitionBy("conv_id").orderBy("turn")).alias("idx"), "role", F.concat_ws(" ", "role", F.col("turn").cast("string")).alias("title"), body.alias("body"), note.alias("notes"))


SLIDES = """d AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, role, role || ' ' || turn AS title, text FROM conversations WHERE text IS NOT NULL)"""


@query(f"""WITH {SLIDES}, t AS (SELECT doc_id, idx * 100000 AS pos, title AS text, 1 AS level FROM d UNION ALL SELECT doc_id, idx * 100000 + 1, CASE WHEN role = 'system' THEN '讲者备注' ELSE text END, 0 FROM d WHERE text <> ''
UNION ALL SELECT doc_id, idx * 100000 + 2, text, 0 FROM d WHERE role = 'system' AND text <> '' UNION ALL SELECT doc_id, idx, idx || '. ' || title, 0 FROM d UNION ALL SELECT DISTINCT doc_id, 0, '目录', 1 FROM d)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, text, CAST(level AS INTEGER) AS level FROM t""")
def slides_as_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides as blocks, notes first, with a table of contents."""
    return C.slides_to_blocks(_slides(spark, sf_dir), "notes-first", contents=True)


@query(f"""WITH {SLIDES}, f AS (SELECT doc_id, title, min(idx) AS idx FROM d GROUP BY 1, 2), n AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) // 3 AS page FROM f)
SELECT doc_id, CAST(page AS INTEGER) AS toc_page, list(title ORDER BY idx) AS entries FROM n GROUP BY 1, 2""")
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by first occurrence, three a page."""
    return C.contents_pages(_slides(spark, sf_dir), 3)


@query(f"""WITH {SLIDES} SELECT DISTINCT doc_id || '.pptx' AS doc_id, CAST(0 AS BIGINT) AS problems FROM d""")
def valid_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks as written are whole: no part is missing or doubled and every relation ends in the package."""
    made = _files(C.write_pptx(_slides(spark, sf_dir)))
    listed = written(archive.entries(made))  # read five times: each would make the decks again
    bad = ooxml.invalid_packages(listed, ooxml.read_relations(made), "pptx").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return listed.select("doc_id").distinct().join(bad, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("problems"))


@query(f"""WITH {PDF_LINES}, k AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM f)
SELECT doc_id || '.docx' AS doc_id, CAST(pos AS INTEGER) AS pos, text FROM k""")
def pdf_as_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDFs as Word documents, a paragraph a line."""
    rows = lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "pos", F.col("line").alias("text"))
    made = writers.per_group(rows, "doc_id", ["pos"], lambda r: writers.pdf([x["text"] for x in r]), lambda k: f"{k}.pdf")
    return ooxml.read_docx(_files(C.pdf_to_word(_files(made)))).select("doc_id", "pos", "text")


ROWS = f"""{CELLS}, r AS (SELECT doc_id, sheet_index, "row", string_agg(value, '  ' ORDER BY col) AS line FROM cells GROUP BY 1, 2, 3)"""


@query(f"""WITH {ROWS}, t AS (SELECT doc_id, regexp_replace(line, '\\s+', ' ', 'g') AS text, min((sheet_index, "row")) AS first_at FROM r GROUP BY 1, 2)
SELECT doc_id || '.pdf' AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_at) - 1 AS INTEGER) AS pos, text FROM t""")
def sheets_as_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: sheets as PDF, a line a row; different lines by first occurrence."""
    return pdf.read_pdf(_files(C.excel_to_pdf(_cells(spark, sf_dir)))).select("doc_id", "pos", "text")


@query(f"""WITH {CELLS}, g AS (SELECT doc_id, sheet_index, count(DISTINCT "row") + 1 AS height, count(DISTINCT col) + 1 AS width FROM cells GROUP BY 1, 2)
SELECT doc_id || '.docx' AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sheet_index) - 1 AS INTEGER) AS pos, CAST(height AS BIGINT) AS height, CAST(width AS BIGINT) AS width FROM g""")
def sheets_as_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as Word tables of the rows and columns that there are."""
    got = ooxml.read_docx(_files(C.excel_to_word(_cells(spark, sf_dir))))
    return got.select("doc_id", "pos", F.size("tbl").cast("long").alias("height"), F.size(F.col("tbl")[0]).cast("long").alias("width"))


@query(f"""WITH {ROWS}, p AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, sheet_index ORDER BY "row") - 1) // 12 AS part FROM r), g AS (SELECT doc_id, sheet_index, part, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT doc_id || '.pptx' AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sheet_index, part) AS INTEGER) AS idx, 'Sheet ' || sheet_index AS title, n AS lines, CAST(0 AS INTEGER) AS chart_count FROM g""")
def sheets_as_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets as slides of twelve rows."""
    points = spark.createDataFrame([], "doc_id string, sheet_index int, chart int, series int, name string, idx int, category string, value string")
    got = ooxml.read_pptx(_files(C.write_pptx(C.excel_to_slides(_cells(spark, sf_dir), points))))
    return got.select("doc_id", "idx", "title", F.size("body").cast("long").alias("lines"), "chart_count")


@query("""SELECT l_suppkey || '.pptx' AS doc_id, CAST(2 AS INTEGER) AS slides, CAST(1 AS INTEGER) AS charts, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS points, CAST(sum(q) AS DOUBLE) AS total FROM (SELECT l_suppkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def native_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart of every supplier's items as a native chart on a slide, with its workbook inside; its cached points read back."""
    per = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_suppkey").cast("string").alias("doc_id"), (F.col("l_linenumber") - 1).alias("idx")).agg(F.max("l_quantity").alias("q"))
    points = per.select("doc_id", F.lit(1).alias("sheet_index"), F.lit(1).alias("chart"), F.lit(1).alias("series"), F.lit("数量").alias("name"), "idx", F.lit(None).cast("string").alias("category"), F.col("q").cast("string").alias("value"))
    cells = per.filter("idx = 0").select("doc_id", F.lit(1).alias("sheet_index"), F.lit("s").alias("sheet_name"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("x").alias("value"))
    cells = cells.unionByName(per.select("doc_id").distinct().join(cells.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.lit(1).alias("sheet_index"), F.lit("s").alias("sheet_name"), F.lit(1).alias("row"), F.lit(1).alias("col"), F.lit("x").alias("value")))
    made = _files(C.write_pptx(C.excel_to_slides(cells, points)))
    decks = ooxml.read_pptx(made).groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("slides"), F.sum("chart_count").cast("int").alias("charts"))
    told = ooxml.read_slide_points(made).groupBy("doc_id").agg(F.count(F.lit(1)).alias("points"), F.sum(F.col("value").cast("double")).alias("total"))
    return decks.join(told, "doc_id")


@query("""SELECT p_partkey || '.docx' AS doc_id, CAST(CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS height, CAST(CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS width, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 2 = 0 THEN 1 ELSE 0 END AS merges,
'a' || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'b' END || 'c' || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'd' END || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN '' ELSE 'e' END || 'f' AS texts FROM part""".replace("CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN '' ELSE 'e' END", "CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN '' ELSE 'e' END"))
def merged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with merges written to Word and read back: what a merge covers is blank, the rest stays."""
    height, width = F.when(F.col("p_partkey") % 3 == 0, 2).otherwise(1), F.when(F.col("p_partkey") % 2 == 0, 2).otherwise(1)
    tbl = F.array(F.array(*[F.lit(x) for x in "abc"]), F.array(*[F.lit(x) for x in "def"]))
    covered = F.transform(tbl, lambda r, i: F.transform(r, lambda x, j: F.when((i < height) & (j < width) & ((i > 0) | (j > 0)), "").otherwise(x)))
    merges = F.when(height * width > 1, F.array(F.array(F.lit(0), F.lit(0), height, width))).otherwise(F.array().cast("array<array<int>>"))
    made = C.write_docx(Tables(spark, sf_dir).part.select(F.col("p_partkey").cast("string").alias("doc_id"), F.lit(0).alias("pos"), F.lit("").alias("text"), F.lit(0).alias("level"), covered.alias("tbl"), merges.alias("merges")))
    got = ooxml.read_docx(_files(made))
    box = F.get("merges", F.lit(0))
    return got.select("doc_id", F.coalesce(F.get(box, F.lit(2)), F.lit(1)).alias("height"), F.coalesce(F.get(box, F.lit(3)), F.lit(1)).alias("width"), F.size("merges").alias("merges"), F.array_join(F.flatten("tbl"), "").alias("texts"))


@query("""SELECT l_suppkey AS supplier, CAST(ceil(count(DISTINCT l_orderkey % 40) / 12.0) * 2 AS BIGINT) AS pages, CAST(count(DISTINCT l_orderkey % 40) * 15 AS BIGINT) AS cells FROM lineitem GROUP BY 1""")
def big_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5, AR2, W13: tables of fifteen columns as pages of twelve by twelve, no cell lost or doubled."""
    rows = Tables(spark, sf_dir).lineitem.select("l_suppkey", (F.col("l_orderkey") % 40).alias("r")).distinct()
    tables = rows.groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: F.transform(F.sequence(F.lit(0), F.lit(14)), lambda c: F.concat_ws(".", r.cast("string"), c.cast("string")))).alias("tbl"))
    pages = ooxml.paged(tables.select(F.col("l_suppkey").cast("string").alias("doc_id"), F.lit(0).alias("pos"), "tbl", F.array().cast("array<array<int>>").alias("merges")))
    return pages.groupBy(F.col("doc_id").cast("long").alias("supplier")).agg(F.count(F.lit(1)).alias("pages"), F.sum(F.size(F.flatten("tbl"))).cast("long").alias("cells"))


PAGED = """o AS (SELECT l_suppkey AS supplier, count(*) AS total FROM lineitem GROUP BY 1),
m AS (SELECT supplier, p * 12 + s.k % 11 AS first, p * 12 + s.k % 11 + 2 + s.k % 13 AS last FROM o, LATERAL (SELECT unnest(range(total // 12 + 1)) AS p), LATERAL (SELECT (supplier * 7 + p * 5) % 31 AS k) s WHERE s.k % 3 = 0 AND p * 12 + s.k % 11 + 2 + s.k % 13 <= total)"""


@query(f"""WITH RECURSIVE {PAGED},
c AS (SELECT DISTINCT supplier, unnest(range(first + 1, last)) AS cut FROM m),
f AS (SELECT supplier, list(cut) AS cuts FROM c GROUP BY 1),
t AS (SELECT o.supplier, total, coalesce(cuts, []) AS cuts FROM o LEFT JOIN f ON f.supplier = o.supplier),
p(supplier, page, s, e) AS (SELECT supplier, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM t UNION ALL
SELECT p.supplier, p.page + 1, p.e, coalesce((SELECT max(x) FROM (SELECT unnest(range(p.e + 1, least(p.e + 12, total) + 1)) AS x) WHERE NOT list_contains(cuts, x)), (SELECT min(x) FROM (SELECT unnest(range(least(p.e + 12, total), total + 1)) AS x) WHERE NOT list_contains(cuts, x)))
FROM p JOIN t ON t.supplier = p.supplier WHERE p.e < total)
SELECT supplier, page, s AS start, e AS "end" FROM p WHERE page >= 0""")
def merge_aware_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each supplier's lines, with merges of 2 to 14 rows, as pages of at most twelve rows that cut no merge."""
    tables = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count(F.lit(1)).alias("total"))
    m = tables.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("total") / 12)))).withColumn("k", (F.col("supplier") * 7 + F.col("p") * 5) % 31)
    m = m.withColumn("first", F.col("p") * 12 + F.col("k") % 11).withColumn("last", F.col("first") + 2 + F.col("k") % 13).filter("k % 3 = 0 and last <= total")
    return merges.merge_pages(tables, m, ["supplier"])


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS r FROM lineitem),
w AS (SELECT l_orderkey, r, CASE WHEN l_quantity > 45 THEN 300 ELSE 0 END AS fixed, 400 * (1 + (l_partkey % 30 + l_suppkey % 7) // 10) AS need, CASE WHEN r % 2 = 0 THEN 400 * (1 + (l_partkey % 90) // 20) ELSE 0 END AS pair, r // 2 AS g, count(*) OVER (PARTITION BY l_orderkey, r // 2) AS size FROM l),
h AS (SELECT *, CASE WHEN fixed > 0 THEN fixed ELSE need END AS own FROM w),
s AS (SELECT *, sum(own) OVER k AS has, count(*) FILTER (WHERE fixed = 0) OVER k AS free, max(pair) OVER k AS asked, count(*) FILTER (WHERE fixed = 0) OVER (PARTITION BY l_orderkey, g ORDER BY r) AS rank FROM h WINDOW k AS (PARTITION BY l_orderkey, g)),
d AS (SELECT *, CASE WHEN size = 2 AND fixed = 0 THEN greatest(asked - has, 0) ELSE 0 END AS lack FROM s)
SELECT l_orderkey, r AS row, CAST(own + CASE WHEN lack > 0 THEN lack // free + CASE WHEN rank <= lack % free THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS height FROM d""")
def table_row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a table of two columns: heights from texts, a merge over the second column of every two rows, fixed rows stay."""
    lines_ = Tables(spark, sf_dir).lineitem
    place = C.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = written(lines_.select("l_orderkey", (F.row_number().over(place) - 1).alias("row"), F.when(F.col("l_quantity") > 45, 300).otherwise(0).cast("long").alias("fixed"), (F.col("l_partkey") % 30 + F.col("l_suppkey") % 7).cast("int").alias("short"), (F.col("l_partkey") % 90).cast("int").alias("long")))  # read five times below
    narrow, broad = F.lit(10 * 114_300).cast("long"), F.lit(20 * 114_300).cast("long")
    tables = items.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "fixed"))), lambda x: x["fixed"]).alias("heights")).withColumn("widths", F.array(narrow, broad))
    # a column of ten half-widths: a text of 10 n characters and a newline's worth more takes n + 1 lines
    said = lambda c, k: F.concat(F.repeat(F.lit("x"), c - c % k), F.lit("y"))
    first = items.select("l_orderkey", "row", F.lit(0).alias("col"), said(F.col("short"), 10).alias("text"))
    second = items.select("l_orderkey", "row", F.lit(1).alias("col"), F.when(F.col("row") % 2 == 0, said(F.col("long"), 20)).otherwise("covered").alias("text"))
    pairs = items.filter("row % 2 = 1").select("l_orderkey", (F.col("row") - 1).alias("pos"), (F.col("row") - 1).alias("top"), F.lit(1).alias("left"), F.lit(2).alias("height"), F.lit(1).alias("span"))
    lone = items.select("l_orderkey", "row", "long")
    alone = lone.groupBy("l_orderkey").agg(F.max("row").alias("row")).filter("row % 2 = 0").withColumn("odd", F.lit(True))
    second = second.join(alone, ["l_orderkey", "row"], "left").withColumn("text", F.when(F.col("odd"), "").otherwise(F.col("text"))).drop("odd")
    return merges.row_heights(tables, first.unionByName(second), pairs, ["l_orderkey"])


@query("""SELECT p_partkey, [10 + p_size + CASE WHEN k % 3 > 0 THEN 1 ELSE 0 END + k // 3, 20 + CASE WHEN k % 3 > 1 THEN 1 ELSE 0 END + k // 3, 30 + k // 3] AS heights FROM (SELECT p_partkey, p_size, greatest(100 - (60 + p_size), 0) AS k FROM part)""")
def row_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows raised to the height that a cell needs, the remainder to the first ones."""
    heights = F.array((F.lit(10) + F.col("p_size")).cast("long"), F.lit(20).cast("long"), F.lit(30).cast("long"))
    return Tables(spark, sf_dir).part.select("p_partkey", layout.raised_heights(heights, F.lit(100)).alias("heights"))


@query(f"""WITH k AS (SELECT doc_id, {BARE} AS text, pos FROM ({LINES}) WHERE {BARE} <> '') SELECT doc_id || '.docx' AS doc_id, CAST(n AS INTEGER) AS page, left(text, 240) AS text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM k) WHERE n <= 30
UNION ALL SELECT doc_id || '.docx', 1, CAST(doc_id AS VARCHAR) FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM k)""")
def word_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thirty blocks of Word files, cut at 240 characters."""
    blocks = lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "pos", F.col("line").alias("text"), F.lit(0).alias("level"))
    shown = ooxml.read_docx(_files(C.write_docx(blocks)))
    none = lambda schema: spark.createDataFrame([], schema)
    made = C.previews(shown, none("doc_id string, idx int, title string, error string"), none("doc_id string, sheet_index int, row int, col int, value string, error string"), none("doc_id string, pos int, text string, error string"))
    return made.select("doc_id", "page", "text")


@query("""SELECT 'z' || (page_id // 50) || '.zip' AS doc_id, '压缩包' AS kind, CAST(rn AS INTEGER) AS page, page_id || '.html ' || strlen(html) AS text FROM (SELECT *, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id || '.html') AS rn FROM pages) WHERE rn <= 40
UNION ALL SELECT CAST(vec_id AS VARCHAR), '图片', 1, CASE WHEN vec_id % 2 = 0 THEN '7 × ' || (vec_id % 9 + 1) ELSE '尺寸未知' END FROM embeddings""")
def file_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previews of archives, by their first forty entries, and of pictures, by their size."""
    t = Tables(spark, sf_dir)
    p = t.pages.select(F.concat(F.lit("z"), F.floor(F.col("page_id") / 50).cast("string")).alias("task"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A" + "00" * 8 + "00000007000000"), F.lpad(F.hex(F.col("vec_id") % 9 + 1), 2, "0")))
    sizes = images.read_sizes(t.embeddings.select(F.col("vec_id").cast("string").alias("path"), F.when(F.col("vec_id") % 2 == 0, png).otherwise(F.unhex(F.lit("00"))).alias("content")))
    none = lambda schema: spark.createDataFrame([], schema)
    return C.previews(none("doc_id string, pos int, text string, error string"), none("doc_id string, idx int, title string, error string"), none("doc_id string, sheet_index int, row int, col int, value string, error string"), none("doc_id string, pos int, text string, error string"), sizes, archive.entries(_files(writers.bundle(p, "task"))))


@query("""WITH a AS (SELECT lang AS kind, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT lang AS kind, count(*) AS n FROM documents WHERE n_chars > 500 GROUP BY 1)
SELECT kind, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS lost FROM a FULL JOIN b USING (kind)""")
def preview_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by kind before and after."""
    d = Tables(spark, sf_dir).documents.select(F.col("lang").alias("kind"), "n_chars")
    return C.compare_previews(d, d.filter("n_chars > 500"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'outside' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 3 = 0 THEN 'bad digest' WHEN doc_id % 2 = 0 THEN 'changed' WHEN doc_id % 11 = 0 THEN 'stale' WHEN doc_id % 13 = 0 THEN 'bad format' END AS reason FROM documents""")
def verified_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1, I2, I3, I5, M3, O18, BI4: outputs against what is registered of them: place, presence, digest, size, time."""
    d = Tables(spark, sf_dir).documents.withColumn("text", F.coalesce("text", F.lit("")))
    k = F.col("doc_id")
    path = F.concat(F.when(k % 7 == 0, "/out/../x/").otherwise("/out/"), k.cast("string"))
    want = F.when(k % 3 == 0, "nothing").otherwise(F.sha2("text", 256))
    registered = d.select(path.alias("path"), F.when(k % 13 == 0, "png").alias("kind"), (F.octet_length("text") + F.when(k % 2 == 0, 1).otherwise(0)).cast("long").alias("size"), want.alias("sha256"), F.expr("timestamp'2024-01-02 00:00:00'").alias("started_at"))
    found = d.filter(k % 5 != 0).select(path.alias("path"), F.col("text").cast("binary").alias("content"), F.when(k % 11 == 0, F.expr("timestamp'2024-01-01 00:00:00'")).otherwise(F.expr("timestamp'2024-01-03 00:00:00'")).alias("modificationTime"))
    good, bad = W.verified(registered, found, "/out")
    both = good.select("path", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("path", "reason"))
    return both.select(F.regexp_extract("path", "([0-9]+)$", 1).cast("long").alias("doc_id"), "reason")


@query("""SELECT user_id, r AS reason FROM (SELECT DISTINCT user_id FROM events), (VALUES ('traversal', 2), ('encrypted', 3), ('size', 5), ('ratio', 5), ('ratio', 7)) t(r, k) WHERE user_id % k = 0 GROUP BY 1, 2""")
def unsafe_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that reach out, are locked, too large or expand too much."""
    k = F.col("user_id")
    parts = Tables(spark, sf_dir).events.select("user_id").distinct().select(k.cast("string").alias("doc_id"), F.when(k % 2 == 0, "../up.txt").otherwise("a/b.txt").alias("part"), F.when(k % 5 == 0, 3 * 1024**3).otherwise(1_000_000).cast("long").alias("size"), F.when(k % 7 == 0, 100).otherwise(500_000).cast("long").alias("packed"), (k % 3 == 0).alias("encrypted"), F.lit(None).cast("string").alias("error"))
    return archive.unsafe(parts).select(F.col("doc_id").cast("long").alias("user_id"), "reason")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'm' || (l_partkey % 5) AS media, list_sort(list(DISTINCT CASE WHEN l_linenumber <= 3 THEN '幻灯片 · s' || l_linenumber WHEN l_linenumber <= 5 THEN '工作表 · w' || l_linenumber ELSE '页眉 · h' || l_linenumber END)) AS locations FROM lineitem GROUP BY 1, 2""")
def media_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pictures are shown: directly, or by a sheet's drawing."""
    i = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("m"), (F.col("l_partkey") % 5).cast("string")).alias("media")).distinct()
    n = F.col("n").cast("string")
    kind = F.when(F.col("n") <= 3, "slide").when(F.col("n") <= 5, "worksheet").otherwise("header")
    part = F.concat(F.when(F.col("n") <= 3, "s").when(F.col("n") <= 5, "w").otherwise("h"), n)
    edge = lambda df, src, kind, target: df.select("doc_id", src.alias("src_part"), kind.alias("type"), target.alias("target"), F.lit(False).alias("external"), F.lit(None).cast("string").alias("error"))
    sheet = F.col("n").between(4, 5)
    edges = edge(i, F.lit("root"), kind, part).unionByName(edge(i.filter(~sheet), part, F.lit("image"), F.col("media"))).unionByName(edge(i.filter(sheet), part, F.lit("drawing"), F.concat(F.lit("d"), n))).unionByName(edge(i.filter(sheet), F.concat(F.lit("d"), n), F.lit("image"), F.col("media")))
    return W.image_locations(edges, W.part_labels(edges))


@query("""SELECT p_partkey, p_size * (p_partkey % 60) AS area FROM part WHERE p_size <= 40 AND p_partkey % 60 <= 40 AND p_size * (p_partkey % 60) <= 900 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0""")
def small_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures within the limits of side and area; switches leave out kinds."""
    p = Tables(spark, sf_dir).part.select("p_partkey", F.col("p_size").alias("width"), (F.col("p_partkey") % 60).alias("height"), (F.col("p_partkey") % 7 == 0).alias("is_header_footer"), (F.col("p_partkey") % 11 == 0).alias("is_watermark"), F.lit(True).alias("is_transparent"), F.lit(None).cast("boolean").alias("is_duplicate"))
    return W.small_images(p, 40, 900, header_footer=False, watermark=False, duplicates=False).select("p_partkey", "area")


@query("""SELECT event_id, k AS pos, CASE k WHEN 0 THEN '$x_' || user_id || '$' ELSE '\\[y^2\\]' END AS latex FROM events, (VALUES (0), (1)) t(k)""".replace("SELECT event_id, k AS pos", "SELECT event_id, CAST(k AS INTEGER) AS pos"))
def tex_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas of TeX sources, in order; an escaped dollar isn't one."""
    said = F.concat(F.lit(r"costs \$5, $x_"), F.col("user_id").cast("string"), F.lit(r"$ and \[y^2\] end"))
    return W.tex_formulas(Tables(spark, sf_dir).events.select(F.col("event_id").alias("doc_id"), said.alias("text"))).select(F.col("doc_id").alias("event_id"), "pos", "latex")


@query("""SELECT doc_id, CASE WHEN n_chars > 500 AND doc_id % 2 = 0 THEN '混合' WHEN n_chars > 500 THEN '文本' ELSE '扫描' END AS kind FROM documents""")
def pdf_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, scanned or mixed."""
    return Tables(spark, sf_dir).documents.select("doc_id", pdf.pdf_type(F.col("n_chars") > 500, F.col("doc_id") % 2 == 0).alias("kind"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN 'skip' WHEN o_orderkey % 3 = 0 THEN 'wait' ELSE 'run' END AS action, CASE WHEN o_orderkey % 3 = 0 THEN '缺少能力：office' ELSE '' END AS reason FROM orders""")
def local_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: what a local run would do with each task."""
    tasks = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "macro_run").otherwise("formula").alias("task_type"), F.when(F.col("o_orderstatus") == "P", "待处理").otherwise("成功").alias("status"))
    return W.planned_actions(tasks, ["none"]).select("id", "action", "reason")


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber, arg_max(l_returnflag, (l_partkey, l_suppkey, l_returnflag)) OVER (PARTITION BY l_orderkey, l_linenumber) AS f FROM lineitem),
n AS (SELECT l_orderkey, count(*) FILTER (WHERE f = 'N') AS s, count(*) FILTER (WHERE f = 'R') AS x FROM r GROUP BY 1)
SELECT o_orderkey AS id, coalesce(s, 0) AS success_count, coalesce(x, 0) AS fail_count, greatest(7 - coalesce(s, 0) - coalesce(x, 0), 0) AS pending_count, CASE WHEN greatest(7 - coalesce(s, 0) - coalesce(x, 0), 0) > 0 THEN '处理中' WHEN coalesce(x, 0) > 0 THEN '失败' ELSE '成功' END AS status FROM orders LEFT JOIN n ON l_orderkey = o_orderkey""".replace("SELECT DISTINCT l_orderkey, l_linenumber, arg_max(l_returnflag, (l_partkey, l_suppkey, l_returnflag)) OVER (PARTITION BY l_orderkey, l_linenumber) AS f FROM lineitem", "SELECT l_orderkey, l_linenumber, arg_max(l_returnflag, (l_partkey, l_suppkey, l_returnflag)) AS f FROM lineitem GROUP BY 1, 2"))
def reconciled_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local results into their tasks' counts; the latest of repeated results counts."""
    t = Tables(spark, sf_dir)
    tasks = t.orders.select(F.col("o_orderkey").alias("id"), F.array(*[F.lit(i) for i in range(1, 8)]).alias("file_ids"), F.lit("处理中").alias("status"))
    results = t.lineitem.select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("file_id"), F.when(F.col("l_returnflag") == "N", "成功").when(F.col("l_returnflag") == "R", "失败").otherwise("等待").alias("status"), F.struct("l_partkey", "l_suppkey", "l_returnflag").alias("seq"))
    return W.reconciled(tasks, results)


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN ['export', 'read'] WHEN c_nationkey % 2 = 0 THEN ['read', 'write'] ELSE ['read'] END AS permissions FROM customer""")
def user_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own permissions in their order, each once, else the role's."""
    own = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("export"), F.lit("read"), F.lit("export")))
    users = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "editor").otherwise("viewer").alias("role"), own.alias("permissions"))
    return W.permissions(users, {"editor": ["read", "write"], "viewer": ["read"]})


@query("""SELECT o_orderkey AS id, o_custkey AS user_id, coalesce(c_custkey % 3 = 0 OR (c_custkey % 3 <> 0 AND c_nationkey % 2 = 0 AND c_custkey % 5 <> 0), FALSE) AS allowed FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def allowed_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes that their users may make."""
    t = Tables(spark, sf_dir)
    own = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("delete"))).when(F.col("c_custkey") % 5 == 0, F.array(F.lit("read")))
    users = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "editor").otherwise("viewer").alias("role"), own.alias("permissions"))
    return W.deletable(t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id")), users, {"editor": ["read", "delete"], "viewer": ["read"]})


@query("""SELECT CAST(0 AS BIGINT) + count(*) FILTER (WHERE o_orderstatus = 'O') AS interrupted, count(*) FILTER (WHERE o_orderstatus = 'P') AS paused, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed, count(*) FILTER (WHERE o_orderstatus IN ('O', 'F')) AS retryable FROM orders""")
def startup_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running tasks are interrupted at start-up; what can go on."""
    status = F.when(F.col("o_orderstatus") == "O", "处理中").when(F.col("o_orderstatus") == "P", "已暂停").otherwise("失败")
    return W.recovery(Tables(spark, sf_dir).orders.select(status.alias("status")))


PARTS = "r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 + 1 AS part FROM documents)"


@query(f"""WITH {PARTS} SELECT source, CAST(part AS BIGINT) AS part, string_agg('<tr><td>' || doc_id || '</td><td>' || lang || '</td></tr>', chr(10) ORDER BY doc_id) AS body FROM r GROUP BY 1, 2""")
def html_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O9, STR8: an HTML report a source, in files of fifty rows; their rows."""
    made = writers.html_report("报告", Tables(spark, sf_dir).documents.select("source", "doc_id", "lang"), "source", ["doc_id", "lang"], ["doc_id"], rows_a_part=50)
    return made.select("source", "part", F.regexp_extract("html", r"(?s)</tr>\n(.*)\n</table>", 1).alias("body"))


@query(f"""WITH {PARTS} SELECT source, CAST(part AS BIGINT) AS part, string_agg('文件 ' || doc_id || '：' || n_chars || ' 字', chr(10) ORDER BY doc_id) AS text FROM r GROUP BY 1, 2""")
def text_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text report a source, in files of fifty lines."""
    line = F.concat(F.lit("文件 "), F.col("doc_id").cast("string"), F.lit("："), F.col("n_chars").cast("string"), F.lit(" 字"))
    return writers.text_report(Tables(spark, sf_dir).documents, "source", line, ["doc_id"], rows_a_part=50)


@query("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN '失败' ELSE '已取消' END WHEN 'P' THEN '已暂停' ELSE CASE WHEN o_orderkey % 3 = 0 THEN '成功' ELSE '处理中' END END AS status, ['retry', 'cancel', 'pause', 'resume', 'dance'][o_custkey % 5 + 1] AS action FROM orders),
n AS (SELECT *, CASE WHEN action = 'retry' AND status IN ('失败', '已取消') THEN '待处理' WHEN action = 'cancel' AND status IN ('处理中', '已暂停') THEN '已取消' WHEN action = 'pause' AND status = '处理中' THEN '已暂停' WHEN action = 'resume' AND status = '已暂停' THEN '待处理' END AS moved FROM t)
SELECT id, action, status, coalesce(moved, status) AS next_status, moved IS NOT NULL AS allowed FROM n""")
def task_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for actions on tasks by the table of moves; what a state doesn't allow changes nothing."""
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "F", F.when(k % 2 == 0, "失败").otherwise("已取消")).when(s == "P", "已暂停").otherwise(F.when(k % 3 == 0, "成功").otherwise("处理中"))
    action = F.get(F.array(*[F.lit(a) for a in ("retry", "cancel", "pause", "resume", "dance")]), (F.col("o_custkey") % 5).cast("int"))
    return taskstates.acted(Tables(spark, sf_dir).orders.select(k.alias("id"), action.alias("action"), status.alias("status")))


LOGS = "l AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS said_at, event_type, user_id, props FROM events ORDER BY event_id DESC LIMIT 5000)"


@query(f"""WITH {LOGS} SELECT 'txt' AS kind, string_agg(said_at || ' [' || event_type || '/info] ' || user_id || ' ' || props || chr(10), '' ORDER BY event_id) AS content FROM l
UNION ALL SELECT 'csv', 'created_at,category,level,task_id,message' || chr(10) || string_agg('"' || said_at || '","' || event_type || '","info","' || user_id || '","' || replace(props, '"', '""') || '"' || chr(10), '' ORDER BY event_id) FROM l
UNION ALL SELECT 'json', '{{"logs":[' || string_agg('{{"created_at":"' || said_at || '","category":"' || event_type || '","level":"info","task_id":"' || user_id || '","message":"' || replace(props, '"', chr(92) || '"') || '"}}', ',' ORDER BY event_id) || ']}}' FROM l""")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 5000 logs as text, CSV and JSON files, in ascending order."""
    e = Tables(spark, sf_dir).events
    rows = e.select(F.col("event_id").alias("id"), temporal.iso_seconds("ts").alias("created_at"), F.col("event_type").alias("category"), F.lit("info").alias("level"), F.col("user_id").cast("string").alias("task_id"), F.col("props").alias("message"))
    made = [writers.log_file(rows, k).select(F.lit(k).alias("kind"), "content") for k in ("txt", "csv", "json")]
    return made[0].unionByName(made[1]).unionByName(made[2])


@query("""SELECT user_id % 20 AS task_id, event_type, count(*) AS n, min(event_id) AS first_id FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2""")
def upload_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queues of jobs and of results to upload, as views over tasks and reports."""
    return W.queued(Tables(spark, sf_dir).events.select((F.col("user_id") % 20).alias("task_id"), "event_type", "event_id"), ["error", "purchase"])


@query("""WITH f AS (SELECT doc_id AS id, source AS name, sha256(coalesce(text, '')) AS digest, CASE WHEN strlen(coalesce(text, '')) > 20000 THEN '宏源码过大' ELSE '' END AS error FROM documents)
SELECT name, digest, id, min(id) OVER (PARTITION BY digest) < id AS again, error FROM f""")
def macro_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, BI1: whole sources known by their content: the first of a digest is new, later ones are the same macro; too large ones are named."""
    d = Tables(spark, sf_dir).documents.select(F.col("source").alias("name"), F.coalesce("text", F.lit("")).alias("source_text"), F.col("doc_id").alias("id"))
    return W.imported(d, most_bytes=20_000).select("name", "digest", "id", "again", "error")


@query("""SELECT doc_id AS id, sha256(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END) AS sha256, doc_id % 3 = 0 AS replaced, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 4 END AS children FROM documents""")
def replaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files replaced under their ids; what hung on the old contents goes."""
    d = Tables(spark, sf_dir).documents.withColumn("text", F.coalesce("text", F.lit("")))
    files = d.select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    new = d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id"), F.concat("text", F.lit("!")).cast("binary").alias("content"))
    kids = d.select(F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 4).cast("int"))).alias("i"), F.col("doc_id").alias("parent_id")).filter("i > 0")
    now, left = W.replaced(files, new, kids)
    n = left.groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return now.join(n, "id", "left").select("id", F.sha2("content", 256).alias("sha256"), "replaced", F.coalesce("n", F.lit(0)).alias("children"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN '来源已变' WHEN o_orderkey % 7 = 0 THEN '类型未知' ELSE '' END AS error, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN '失败' ELSE '待处理' END AS status, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 0 ELSE CAST(o_orderkey % 3 AS INTEGER) + 1 END AS files FROM orders""")
def created_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked-for tasks checked before they're taken: known types only, sources as they were when they were listed."""
    k = F.col("o_orderkey")
    asked = Tables(spark, sf_dir).orders.select(k.alias("id"), F.when(k % 7 == 0, "juggle").otherwise("word_to_ppt").alias("task_type"), F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct(F.concat_ws("-", k.cast("string"), i.cast("string")).alias("file_id"), F.lit("a").alias("sha256"))).alias("sources"))
    files = asked.select(F.explode("sources").alias("s"), "id").select("s.file_id", F.when((F.col("id") % 5 == 0) & F.col("s.file_id").endswith("-0"), "b").otherwise("a").alias("sha256"))
    return W.created(asked, files).select("id", "error", "status", "files")


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '校验失败' WHEN p_partkey % 5 = 0 THEN '备份缺失' ELSE '可恢复' END AS verdict FROM part""")
def restorable_backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backups that may be restored: they are there, and their bytes are those that were registered."""
    k = F.col("p_partkey")
    p = Tables(spark, sf_dir).part
    registered = p.select(k.alias("id"), F.sha2(F.when(k % 3 == 0, "other").otherwise(F.col("p_name")), 256).alias("sha256"))
    held = p.filter((k % 5 != 0) | (k % 3 == 0)).select(k.alias("id"), F.col("p_name").cast("binary").alias("content"))
    return W.restorable(registered, held)


@query("""SELECT n_nationkey || '.docx' AS doc_id, 'word/media/image1.png' AS media, CAST(9525 * (n_nationkey + 1) AS BIGINT) AS width, CAST(19050 AS BIGINT) AS height, TRUE AS same_bytes, 'x' AS cell, 'center' AS alignment, 1200 AS grid FROM nation""")
def word_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures and sized, aligned tables written to Word and read back."""
    n = F.col("n_nationkey")
    image = F.unhex(F.concat(F.lit("89504E470D0A1A0A"), F.lpad(F.hex(n), 4, "0")))
    none = lambda t: F.lit(None).cast(t)
    row = lambda pos, tbl, widths, alignment, data: Tables(spark, sf_dir).nation.select(n.cast("string").alias("doc_id"), F.lit(pos).alias("pos"), F.lit("").alias("text"), F.lit(0).alias("level"), tbl.alias("tbl"), widths.alias("widths"), alignment.alias("alignment"), data.alias("image"), F.lit("a.png").alias("image_name"), (F.lit(9525) * (n + 1)).cast("long").alias("cx"), F.lit(19050).cast("long").alias("cy"))
    blocks = row(0, none("array<array<string>>"), none("array<int>"), none("string"), image).unionByName(row(1, F.array(F.array(F.lit("x"))), F.array(F.lit(1200)), F.lit("center"), none("binary")))
    made = _files(C.write_docx(blocks))
    parts = archive.entries(made, with_data=True)
    xml = parts.filter("part = 'word/document.xml'").select("doc_id", F.decode("data", "UTF-8").alias("x"))
    told = xml.select("doc_id", F.regexp_extract("x", 'w:jc w:val="([a-z]+)"', 1).alias("alignment"), F.regexp_extract("x", 'w:gridCol w:w="([0-9]+)"', 1).cast("int").alias("grid"))
    held = parts.filter("part = 'word/media/image1.png'").select("doc_id", (F.hex("data") == F.concat(F.lit("89504E470D0A1A0A"), F.lpad(F.hex(F.regexp_extract("doc_id", "^([0-9]+)", 1).cast("long")), 4, "0"))).alias("same_bytes"))
    cells = ooxml.read_docx(made).filter("kind = 'table'").select("doc_id", F.col("tbl")[0][0].alias("cell"))
    return ooxml.read_pictures(made).select("doc_id", "media", "width", "height").join(held, "doc_id").join(cells, "doc_id").join(told, "doc_id")


def _xml_shapes(kinds: list[str]) -> str:
    head = f'xmlns:a="{writers.NS["a"]}" xmlns:p="{writers.NS["p"]}"'
    shape = lambda k: f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="{k}"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{k}</a:t></a:r></a:p></p:txBody></p:sp>'
    return f"<p:notes {head}>{''.join(map(shape, kinds))}</p:notes>"


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN ['body'] WHEN 1 THEN [] ELSE ['body', 'title'] END AS shown FROM customer""".replace("THEN []", "THEN CAST([] AS VARCHAR[])"))
def notes_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """of notes pages, header, footer, date and number placeholders aren't notes."""
    kinds = [["body", "sldNum"], ["hdr", "ftr", "dt", "sldImg"], ["body", "hdr", "title"]]
    xml = F.element_at(F.array(*[F.lit(_xml_shapes(k)) for k in kinds]), (F.col("c_custkey") % 3 + 1).cast("int"))
    got = archive.per_file(spread(Tables(spark, sf_dir).customer.select("c_custkey")).select(F.col("c_custkey").cast("string").alias("path"), xml.cast("binary").alias("content")), ooxml.notes_lines, "doc_id string, shown array<string>, error string")
    return got.select(F.col("doc_id").cast("long").alias("c_custkey"), "shown")


@query("""SELECT n_nationkey || x AS doc_id, m AS media, l AS locations FROM nation, (VALUES ('.docx', 'word/media/a.png', ['正文（页码待排版定位） · word/document.xml · 第 2 段', '页眉 · word/header1.xml · 第 1 段']), ('.pptx', 'ppt/media/a.png', ['幻灯片第 2 页 · ppt/slides/slide1.xml'])) t(x, m, l)
UNION ALL SELECT n_nationkey || '.xlsx', 'xl/media/a.png', ['工作表 表 · ' || chr(CAST(65 + n_nationkey AS INTEGER)) || '10', '工作表 表 · 绝对位置（无单元格锚点）'] FROM nation""")
def picture_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pictures are shown: paragraph of a story, slide, anchor cell."""
    ns = f'xmlns:w="{writers.NS["w"]}" xmlns:a="{writers.NS["a"]}" xmlns:r="{writers.NS["r"]}" xmlns:p="{writers.NS["p"]}" xmlns:s="{writers.NS["s"]}"'
    blip, image = '<a:blip r:embed="rId1"/>', ("rId1", "image", "media/a.png")
    up = ("rId1", "image", "../media/a.png")

    def build(rows: list[dict]) -> bytes:
        n, kind = int(rows[0]["n"]), rows[0]["kind"]
        if kind == ".docx":
            return writers.zipped({"word/document.xml": f'<w:document {ns}><w:body><w:p/><w:p><w:drawing>{blip}</w:drawing></w:p><w:sectPr><w:headerReference r:id="rId2"/></w:sectPr></w:body></w:document>', "word/_rels/document.xml.rels": writers.rels([image, ("rId2", "header", "header1.xml")]), "word/header1.xml": f"<w:hdr {ns}><w:p>{blip}</w:p></w:hdr>", "word/_rels/header1.xml.rels": writers.rels([image])})
        if kind == ".pptx":
            return writers.zipped({"ppt/presentation.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId r:id="rId2"/><p:sldId r:id="rId1"/></p:sldIdLst></p:presentation>', "ppt/_rels/presentation.xml.rels": writers.rels([("rId1", "slide", "slides/slide1.xml"), ("rId2", "slide", "slides/slide2.xml")]), "ppt/slides/slide1.xml": f"<p:sld {ns}>{blip}</p:sld>", "ppt/slides/_rels/slide1.xml.rels": writers.rels([up]), "ppt/slides/slide2.xml": f"<p:sld {ns}/>"})
        anchors = f"<x><from><col>{n}</col><row>9</row></from>{blip}</x><x>{blip}</x>"
        return writers.zipped({"xl/workbook.xml": f'<s:workbook {ns}><s:sheets><s:sheet name="表" sheetId="1" r:id="rId1"/></s:sheets></s:workbook>', "xl/_rels/workbook.xml.rels": writers.rels([("rId1", "worksheet", "worksheets/sheet1.xml")]), "xl/worksheets/sheet1.xml": f"<s:worksheet {ns}/>", "xl/worksheets/_rels/sheet1.xml.rels": writers.rels([("rId1", "drawing", "../drawings/d.xml")]), "xl/drawings/d.xml": f"<d {ns}>{anchors}</d>", "xl/drawings/_rels/d.xml.rels": writers.rels([up])})

    kinds = F.explode(F.array(*[F.lit(x) for x in (".docx", ".pptx", ".xlsx")]))
    rows = Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("n"), kinds.alias("kind"), F.lit(0).alias("pos")).withColumn("file", F.concat(F.col("n").cast("string"), "kind"))
    return ooxml.read_picture_places(_files(writers.per_group(rows, "file", ["pos"], build, str)))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, 'word/media/a.png' AS media, CAST(914400 * (n_nationkey + 1) AS BIGINT) AS width, CAST(n_nationkey * 10 AS INTEGER) AS crop, CAST(((n_nationkey - 12) * 60000 % 21600000 + 21600000) % 21600000 AS INTEGER) AS rotation, n_nationkey % 2 = 1 AS flip_h FROM nation""")
def picture_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of Word files with extent, crop, turn and flip."""
    head = f'xmlns:w="{writers.NS["w"]}" xmlns:a="{writers.NS["a"]}" xmlns:r="{writers.NS["r"]}" xmlns:wp="wp"'

    def build(rows: list[dict]) -> bytes:
        n = int(rows[0]["n"])
        pic = f'<a:pic><a:blipFill><a:blip r:embed="rId1"/><a:srcRect l="{n * 10}"/></a:blipFill><a:spPr><a:xfrm rot="{(n - 12) * 60000}" flipH="{n % 2}"/></a:spPr></a:pic>'
        body = f'<w:p><w:drawing><wp:inline><wp:extent cx="{914400 * (n + 1)}" cy="1"/>{pic}</wp:inline></w:drawing></w:p>'
        return writers.zipped({"word/document.xml": f"<w:document {head}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": writers.rels([("rId1", "image", "media/a.png")])})

    made = writers.per_group(Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("n"), F.lit(0).alias("pos")), "n", ["pos"], build, lambda k: str(k))
    return ooxml.read_pictures(_files(made)).select("doc_id", "media", "width", F.col("crop")[0].alias("crop"), "rotation", "flip_h")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, s AS style_id, CASE s WHEN 'A' THEN '1' WHEN 'B' THEN '1' END AS bold, CASE s WHEN 'B' THEN CAST(20 + n_nationkey AS VARCHAR) WHEN 'A' THEN '22' ELSE '18' END AS size FROM nation, (VALUES ('A'), ('B'), ('X')) t(s)""")
def resolved_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XM4, J14, AR4: styles of Word files with what they inherit: parents of their own kind, then the defaults."""
    style = lambda i, up, props, kind="paragraph": f'<w:style w:type="{kind}" w:styleId="{i}">' + (f'<w:basedOn w:val="{up}"/>' if up else "") + f"<w:rPr>{props}</w:rPr></w:style>"

    def build(rows: list[dict]) -> bytes:
        body = style("A", "", '<w:b/><w:sz w:val="22"/>') + style("B", "A", f'<w:sz w:val="{20 + int(rows[0]["n"])}"/>') + style("X", "A", "", "character")
        return writers.zipped({"word/styles.xml": f'<w:styles xmlns:w="{writers.NS["w"]}"><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="18"/></w:rPr></w:rPrDefault></w:docDefaults>{body}</w:styles>'})

    made = writers.per_group(Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("n"), F.lit(0).alias("pos")), "n", ["pos"], build, lambda k: str(k))
    got = ooxml.resolved_styles(ooxml.read_styles(_files(made)))
    return got.select("doc_id", "style_id", F.try_element_at("props", F.lit("b")).alias("bold"), F.try_element_at("props", F.lit("sz")).alias("size"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, s AS style_id, CASE s WHEN 'B' THEN '0' WHEN 'C' THEN '1' ELSE '1' END AS bold, CASE s WHEN 'A' THEN 'Song ' || n_nationkey ELSE 'Own' END AS font, CASE s WHEN 'A' THEN '00' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || 'FF' ELSE 'ABCDEF' END AS color FROM nation, (VALUES ('A'), ('B'), ('C')) t(s)""")
def theme_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XM4, STR19: styles with their theme's font for its language and its colour; bold switches along the chain."""
    ns = f'xmlns:w="{writers.NS["w"]}"'
    style = lambda i, up, props: f'<w:style w:type="paragraph" w:styleId="{i}">' + (f'<w:basedOn w:val="{up}"/>' if up else "") + f"<w:rPr>{props}</w:rPr></w:style>"

    def build(rows: list[dict]) -> bytes:
        n = int(rows[0]["n"])
        body = style("A", "", '<w:b/><w:rFonts w:asciiTheme="minorHAnsi"/><w:color w:val="auto" w:themeColor="accent1"/>'.replace('w:val="auto" ', "")) + style("B", "A", '<w:b/><w:rFonts w:ascii="Own"/><w:color w:val="ABCDEF"/>') + style("C", "B", "<w:b/>")
        theme = f'<a:theme xmlns:a="{writers.NS["a"]}"><a:clrScheme><a:accent1><a:srgbClr val="00{n:02}FF"/></a:accent1></a:clrScheme><a:fontScheme><a:minorFont><a:latin typeface="Plain"/><a:font script="Hans" typeface="Song {n}"/></a:minorFont></a:fontScheme></a:theme>'
        links = writers.rels([("rId1", "theme", "theme/theme1.xml"), ("rId2", "settings", "settings.xml")])
        return writers.zipped({"word/document.xml": f"<w:document {ns}/>", "word/_rels/document.xml.rels": links, "word/styles.xml": f"<w:styles {ns}>{body}</w:styles>", "word/theme/theme1.xml": theme, "word/settings.xml": f'<w:settings {ns}><w:themeFontLang w:val="zh-CN"/></w:settings>'})

    made = _files(writers.per_group(Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("n"), F.lit(0).alias("pos")), "n", ["pos"], build, lambda k: str(k)))
    got = ooxml.themed(ooxml.resolved_styles(ooxml.read_styles(made)), ooxml.read_themes(made))
    of = lambda key: F.try_element_at("props", F.lit(key))
    return got.select("doc_id", "style_id", of("b").alias("bold"), of("rFonts").alias("font"), of("color").alias("color"))


@query("""SELECT n_nationkey || '.xlsx' AS doc_id, r AS ref, CASE r WHEN 'A1' THEN n_name WHEN 'B1' THEN 'shared ' || n_regionkey ELSE n_regionkey || ' (=1+1)' END AS value FROM nation, (VALUES ('A1'), ('B1'), ('C1')) t(r)""")
def shared_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XM2, XM3, S9: cells by shared strings, and a formula beside its result."""

    def build(rows: list[dict]) -> bytes:
        name, region = rows[0]["name"], rows[0]["region"]
        cells = f'<c r="A1" t="s"><v>1</v></c><c r="B1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>{region}</v></c>'
        return writers.zipped({
            "xl/workbook.xml": f'<workbook xmlns="{writers.NS["s"]}" xmlns:r="{writers.NS["r"]}"><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": writers.rels([("rId1", "worksheet", "worksheets/sheet1.xml")]),
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{writers.NS["s"]}"><sheetData><row r="1">{cells}</row></sheetData></worksheet>',
            "xl/sharedStrings.xml": f'<sst xmlns="{writers.NS["s"]}"><si><r><t>shared</t></r><r><t> {region}</t></r></si><si><t>{name}</t></si></sst>',
        })

    rows = Tables(spark, sf_dir).nation.select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.lit(0).alias("pos"))
    return ooxml.read_cells(_files(writers.per_group(rows, "n", ["pos"], build, lambda k: f"{k}.xlsx"))).select("doc_id", "ref", "value")


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS doc_id, CAST(idx AS INTEGER) AS idx, CAST(v AS VARCHAR) AS value FROM (SELECT DISTINCT l_suppkey FROM lineitem), (VALUES (0, 5), (1, 6), (2, 7)) t(idx, v)""")
def chart_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of charts without a cache, from the cells that their formula names; sheet names ignore case."""
    s = Tables(spark, sf_dir).lineitem.select(F.col("l_suppkey").cast("string").alias("doc_id")).distinct()
    points = s.select("doc_id", F.lit(1).alias("sheet_index"), F.lit(1).alias("chart"), F.lit(1).alias("series"), F.lit("n").alias("name"), F.lit(None).cast("int").alias("idx"), F.lit("'DATA'!$B$2:$B$4").alias("value_formula"))
    cells = s.select("doc_id", F.lit("Data").alias("sheet_name"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("row"), F.lit(2).alias("col")).withColumn("result", (F.col("row") + 3).cast("string"))
    return ooxml.sourced_points(points, cells).select("doc_id", "idx", "value")


@query("""SELECT doc_id, ['x', '', ''] AS cells, [0, 0, 1, 2] AS merge, [100, 100, 200] AS widths, 'ctr' AS alignment FROM (SELECT CAST(n_nationkey AS VARCHAR) AS doc_id FROM nation)""".replace("[0, 0, 1, 2]", "CAST([0, 0, 1, 2] AS INTEGER[])").replace("[100, 100, 200]", "CAST([100, 100, 200] AS BIGINT[])"))
def slide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables on slides, written and read with merges, widths and alignments."""
    table = F.struct(F.array(F.array(F.lit("x"), F.lit(""), F.lit(""))).alias("tbl"), F.array(F.array(*[F.lit(i) for i in (0, 0, 1, 2)])).alias("merges"), F.array(*[F.lit(i).cast("long") for i in (100, 100, 200)]).alias("widths"), F.array(F.lit(50).cast("long")).alias("heights"), F.lit("ctr").alias("alignment"))
    slides = Tables(spark, sf_dir).nation.select(F.col("n_nationkey").cast("string").alias("doc_id"), F.lit(1).alias("idx"), F.lit("t").alias("title"), F.array().cast("array<string>").alias("body"), F.array().cast("array<string>").alias("notes"), F.array(table).alias("tables"))
    got = ooxml.read_slide_tables(_files(C.write_pptx(slides)))
    return got.select(F.regexp_replace("doc_id", "[.]pptx$", "").alias("doc_id"), F.col("tbl")[0].alias("cells"), F.col("merges")[0].alias("merge"), "widths", F.col("alignments")[0][0].alias("alignment"))


