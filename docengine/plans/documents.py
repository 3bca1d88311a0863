"""Document jobs over files that are made from the tables: write, read back, reconcile."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.plans import conversions as C
from docengine.functions import surface
from docengine.operators.lineage import shared_dir
from docengine.operators.relational import spread
from docengine.plans.sheets import LINES, lines
from docengine.plans.tables import Tables
from docengine.registry import query
from docengine.plans import workbench
from docengine.sources import archive, images, ooxml, pdf, store, vba, writers
from docengine.streaming import ingest, logs, taskstates
from docengine.streaming.retention import DayTable


def _files(made: DataFrame) -> DataFrame:
    return made.select(F.col("name").alias("path"), "content")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "pos", F.col("line").alias("text"), F.when(F.length("line") < 60, 1).otherwise(0).alias("level"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' items as a sheet a hundred orders."""
    some = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_set(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("cells"))
    return some.select(F.concat(F.lit("b"), F.floor(F.col("l_orderkey") / 100).cast("string")).alias("doc_id"), F.col("l_orderkey").alias("pos"), "cells")


#: A line without white space at its ends.
BARE = "trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13) || chr(160))"


@query(f"""WITH l AS ({LINES}), v AS (SELECT doc_id, pos, {BARE} AS text, CASE WHEN length(line) < 60 OR pos = 0 THEN 1 ELSE 0 END AS level FROM l), k AS (SELECT * FROM v WHERE text <> '')
SELECT doc_id || '.docx' AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, 'paragraph' AS kind, text, CAST(level AS INTEGER) AS level, CAST(NULL AS VARCHAR) AS error FROM k
UNION ALL SELECT doc_id || '.docx', 0, 'paragraph', CAST(doc_id AS VARCHAR), 1, NULL FROM (SELECT DISTINCT doc_id FROM l) WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def ooxml_word_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, S20, O12, STR4, STR5, XM1: documents written as DOCX and read back as blocks with their levels."""
    return ooxml.read_docx(_files(C.write_docx(_blocks(spark, sf_dir)))).select("doc_id", "pos", "kind", "text", "level", "error")


@query(f"""WITH s AS (SELECT *, count(*) FILTER (WHERE length(line) < 60) OVER w AS section, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER w AS title FROM ({LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, greatest((count(*) FILTER (WHERE length(line) >= 60) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) // 12, 0) AS part FROM s),
g AS (SELECT doc_id, section, part, coalesce(any_value(title), '正文') AS title, list(line ORDER BY pos) FILTER (WHERE length(line) >= 60) AS body FROM b GROUP BY 1, 2, 3),
i AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, part) AS idx, list_filter(list_transform(list_prepend(title, coalesce(body, [])), lambda line: {BARE}), lambda x: x <> '') AS t FROM g)
SELECT doc_id || '.pptx' AS doc_id, CAST(idx AS INTEGER) AS idx, coalesce(t[1], '幻灯片 ' || idx) AS title, t[2:] AS body, CAST(NULL AS VARCHAR) AS error FROM i""")
def ooxml_word_to_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks to slides, written as PPTX, read back."""
    b = _blocks(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    return ooxml.read_pptx(_files(C.write_pptx(C.word_to_slides(b)))).select("doc_id", "idx", "title", "body", "error")


@query("""WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem), c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag) AS col FROM u),
r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey // 100 ORDER BY l_orderkey) AS "row" FROM (SELECT DISTINCT l_orderkey FROM lineitem))
SELECT 'b' || (l_orderkey // 100) || '.xlsx' AS doc_id, CAST("row" AS INTEGER) AS "row", CAST(col AS INTEGER) AS col, chr(CAST(64 + col AS INTEGER)) || "row" AS ref, l_returnflag AS value, CAST(NULL AS VARCHAR) AS error FROM c JOIN r USING (l_orderkey)""")
def ooxml_sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S9, O8, XM3: sheets written as XLSX, read back as cells."""
    made = writers.per_group(_grid(spark, sf_dir), "doc_id", ["pos"], lambda rows: writers.xlsx([list(r["cells"]) for r in rows]), lambda k: f"{k}.xlsx")
    return ooxml.read_cells(_files(made)).select("doc_id", "row", "col", "ref", "value", "error")


PDF_LINES = f"""l AS ({LINES}), t AS (SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS text FROM l), f AS (SELECT doc_id, text, min(pos) AS pos FROM t WHERE text <> '' GROUP BY 1, 2)"""


@query(f"""WITH {PDF_LINES} SELECT doc_id || '.pdf' AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, text, CAST(NULL AS VARCHAR) AS error FROM f""")
def pdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10, O11, STR14, BI3: documents written as PDF, read back as lines by first occurrence."""
    made = writers.per_group(_blocks(spark, sf_dir), "doc_id", ["pos"], lambda rows: writers.pdf([r["text"] for r in rows]), lambda k: f"{k}.pdf")
    return pdf.read_pdf(_files(made))


@query("""SELECT (page_id // 50) || '.zip' AS doc_id, CAST(row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id || '.html') - 1 AS INTEGER) AS pos, page_id || '.html' AS part, CAST(strlen(html) AS BIGINT) AS size, CAST(NULL AS VARCHAR[]) AS reasons FROM pages""")
def zip_bundle_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages bundled into archives of fifty, listed with their safety verdict."""
    p = Tables(spark, sf_dir).pages.select(F.floor(F.col("page_id") / 50).cast("string").alias("task"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    listed = archive.entries(_files(writers.bundle(p, "task")))
    bad = archive.unsafe(listed).groupBy("doc_id").agg(F.array_sort(F.collect_list("reason")).alias("reasons"))
    return listed.join(bad, "doc_id", "left").select("doc_id", "pos", "part", "size", "reasons")


@query("""SELECT CAST(vec_id AS VARCHAR) AS doc_id, 'bmp' AS kind, CAST(vec_id % 200 + 1 AS INTEGER) AS width, CAST(4 AS INTEGER) AS height, CAST(NULL AS VARCHAR) AS error FROM embeddings""")
def image_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header probes over small BMP files made from embeddings' ids."""
    head = F.concat(F.lit("424D"), F.repeat(F.lit("0"), 24), F.lit("28000000"), F.lpad(F.hex(F.col("vec_id") % 200 + 1), 2, "0"), F.lit("000000FCFFFFFF"), F.repeat(F.lit("0"), 60))
    files = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").cast("string").alias("path"), F.unhex(head).alias("content"))
    return images.read_sizes(files)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS doc_id, m.name AS macro_name, 'M' || c_custkey AS module_name, CAST(m.line AS INTEGER) AS source_line, 'M' || c_custkey || '.' || m.name AS qualified_name, CAST(NULL AS VARCHAR) AS error FROM customer, (VALUES ('Run', 2), ('Also', 7)) m(name, line)""")
def vba_macro_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macros of modules made from customers."""
    source = F.concat(F.lit('Attribute VB_Name = "M'), F.col("c_custkey").cast("string"), F.lit("\"\nPublic Sub Run_\n  ' Sub No()\nEnd Sub\nPrivate Sub Hidden()\nEnd Sub\nSub Also(): x = \"Sub Neither()\"\nEnd Sub\n"))
    files = spread(Tables(spark, sf_dir).customer.select("c_custkey")).select(F.col("c_custkey").cast("string").alias("path"), F.replace(source, F.lit("Run_"), F.lit("Run()")).cast("binary").alias("content"))
    return vba.read_macros(files)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query("""SELECT event_type AS level, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY event_type""")
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs through the gate into a day-partitioned table by an available-now stream, then counted."""
    events = spark.readStream.schema(Tables(spark, sf_dir).events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = events.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("task_id"), F.col("props").alias("message"), F.lit("info").alias("level"), F.when(F.col("event_type") == "view", "macro").otherwise(F.col("event_type")).alias("category"), F.col("ts").cast("timestamp").alias("created_at"))
    at = _folder(spark)
    logs.append(logs.gated(rows, {"logMacro": "false"}), f"{at}/logs", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/logs").groupBy(F.col("category").alias("level")).agg(F.count(F.lit(1)).alias("n"))


MOVES_SQL = """WITH e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS task_id, event_id AS seq, CASE WHEN event_type = 'purchase' AND value > 90 THEN '成功' WHEN event_type = 'error' AND value > 95 THEN '失败' ELSE '处理中' END AS status, CAST(floor(value) AS INTEGER) AS progress FROM events),
t AS (SELECT task_id, min(seq) AS fin FROM e WHERE status <> '处理中' GROUP BY 1),
v AS (SELECT e.* FROM e LEFT JOIN t USING (task_id) WHERE fin IS NULL OR seq <= fin)
SELECT task_id, arg_max(status, seq) AS status, greatest(max(progress), 0) AS progress, count(*) AS updates FROM v GROUP BY 1"""


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("event_type") == "purchase") & (F.col("value") > 90), "成功").when((F.col("event_type") == "error") & (F.col("value") > 95), "失败").otherwise("处理中")
    return Tables(spark, sf_dir).events.select(F.col("user_id").cast("string").alias("task_id"), F.col("event_id").alias("seq"), status.alias("status"), F.floor("value").cast("int").alias("progress"))


@query(MOVES_SQL)
def task_state_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2 over a table."""
    return logs.task_states_batch(_moves(spark, sf_dir))


@query(MOVES_SQL.replace("SELECT task_id, arg_max(status, seq) AS status,", "SELECT task_id, CASE WHEN arg_max(status, seq) = '处理中' AND arg_max(ts, seq) + INTERVAL 6 HOUR < (SELECT max(ts) FROM events) - INTERVAL 1 MINUTE THEN '已中断' ELSE arg_max(status, seq) END AS status,").replace("event_id AS seq,", "event_id AS seq, ts,"))
def task_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M2, M4: events that land in three parts, each followed by a run of the stream from its checkpoint; tasks that were running and have been silent for six
    hours are interrupted by timers. What the state store holds at the end."""
    at, every = _folder(spark), Tables(spark, sf_dir).events
    moves = _moves(spark, sf_dir).join(every.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at")), "seq").select("task_id", "seq", "status", "progress", "at")
    last = every.agg(F.max("event_id")).first()[0] or 0
    for part in range(3):
        moves.filter(F.col("seq").between(part * last // 3 + (part > 0), (part + 1) * last // 3)).write.parquet(f"{at}/in/{part}")
        landed = spark.readStream.schema(taskstates.MOVE).parquet(f"{at}/in/*")
        taskstates.follow(landed, datetime.timedelta(hours=6), f"{at}/checkpoint", f"{at}/out").awaitTermination()
    return taskstates.stored(spark, f"{at}/checkpoint").select("task_id", "status", "progress", "updates")


LANDINGS = """g AS (SELECT page_id % 8 AS k, page_id, regexp_replace(html, '[\\r\\n]', ' ', 'g') || chr(10) AS line FROM pages),
a AS (SELECT k, 0 AS run, string_agg(line, '' ORDER BY page_id) AS body FROM g GROUP BY k UNION ALL SELECT k, 1, string_agg(line, '' ORDER BY CASE WHEN k < 4 THEN page_id ELSE -page_id END) FROM g GROUP BY k)"""


@query(f"""WITH {LANDINGS}, f AS (SELECT k, run, sha256(body) AS sha256, CAST(strlen(body) AS BIGINT) AS file_size FROM a)
SELECT sha256, file_size, count(*) AS arrivals FROM f GROUP BY 1, 2""")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight files of pages land, and eight more of which four hold what came before; a stream registers each content once."""
    at, pages = _folder(spark), Tables(spark, sf_dir).pages
    line = F.regexp_replace("html", "[\r\n]", " ").alias("value")
    registry = store.Store(spark, f"{at}/registry")
    for run, order in enumerate((F.col("page_id"), F.when(F.col("page_id") % 8 < 4, F.col("page_id")).otherwise(-F.col("page_id")))):
        parts = pages.withColumn("k", F.col("page_id") % 8)
        parts.repartition(8, "k").sortWithinPartitions("k", order).select("k", line).write.partitionBy("k").text(f"{at}/in/{run}")
        ingest.follow(ingest.landed(spark, f"{at}/in/*/*", "part-*"), registry, f"{at}/checkpoint", workbench.ingest).awaitTermination()
    came = registry.read(ingest.ARRIVALS).groupBy("sha256").agg(F.count(F.lit(1)).alias("arrivals"))
    return registry.read(ingest.FILES).join(came, "sha256").select("sha256", "file_size", "arrivals")


@query("""WITH e AS (SELECT event_id, ts, max(ts) OVER () - INTERVAL 10 DAY AS cut FROM events)
SELECT CAST(ts AS DATE) AS day, count(*) AS n, (SELECT count(DISTINCT CAST(ts AS DATE)) FROM e WHERE CAST(ts AS DATE) < CAST(cut AS DATE)) AS days_dropped FROM e WHERE ts > cut GROUP BY 1""")
def retention_by_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: events as a table a day; what is over ten days old goes: whole days from the manifest, the day of the cut by writing it anew."""
    events = Tables(spark, sf_dir).events.select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    table = DayTable(store.Store(spark, f"{_folder(spark)}/days"), "events")
    table.append(events)
    newest = events.agg(F.max("created_at")).first()[0]
    dropped = table.retain(newest, 10)
    return table.read().groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumn("days_dropped", F.lit(dropped["days_dropped"]).cast("long"))


@query("""SELECT p_partkey, chr(CAST(65 + p_size % 26 AS INTEGER)) AS letters, CAST(p_size % 26 + 1 AS BIGINT) AS number, CASE p_partkey % 3 WHEN 0 THEN 'xl/media/image' || p_size || '.png' WHEN 1 THEN 'docProps/' || p_size ELSE NULL END AS part FROM part""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR16, STR17: the library's functions called from SQL."""
    surface.register(spark)
    Tables(spark, sf_dir).part.createOrReplaceTempView("__surface_part")
    return spark.sql("""SELECT p_partkey, column_letters(p_size % 26 + 1) AS letters, column_number(column_letters(p_size % 26 + 1)) AS number,
        resolve_part('xl/worksheets/sheet1.xml', CASE p_partkey % 3 WHEN 0 THEN concat('../media/./image', p_size, '.png#x') WHEN 1 THEN concat('/docProps/', p_size) ELSE '../../../out' END) AS part FROM __surface_part""")


@query("""SELECT (page_id // 50) || '.zip' AS archive, CAST(row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id || '.html') - 1 AS INTEGER) AS pos, page_id || '.html' AS part, CAST(strlen(html) AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS error FROM pages""")
def zip_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of pages listed by a table function over a partitioned table argument."""
    surface.register(spark)
    p = Tables(spark, sf_dir).pages.select(F.floor(F.col("page_id") / 50).cast("string").alias("task"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("name"), F.col("html").cast("binary").alias("content"))
    writers.bundle(p, "task").select("name", "content").createOrReplaceTempView("__surface_archives")
    return spark.sql("SELECT archive, pos, part, size, error FROM zip_parts(TABLE(SELECT name, content FROM __surface_archives) PARTITION BY name)")


@query("""SELECT user_id AS client_id, count(*) AS beats, max(ts) AS last_seen FROM events GROUP BY 1""")
def heartbeat_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: heartbeats that come twice, in two landings; the stream lets each through once, late repeats fall behind the watermark."""
    at = _folder(spark)
    beats = Tables(spark, sf_dir).events.select(F.col("user_id").alias("client_id"), F.col("event_id").alias("beat_id"), F.col("ts").cast("timestamp").alias("at"))
    for landing in range(2):
        beats.unionByName(beats.filter("beat_id % 2 = 0")).write.parquet(f"{at}/in/{landing}")
        stream = spark.readStream.schema(beats.schema).parquet(f"{at}/in/*")
        logs.heartbeats(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("client_id").agg(F.count(F.lit(1)).alias("beats"), F.max("at").cast("timestamp_ntz").alias("last_seen"))
