"""Scalar functions over the tables: text, dates, numbers, arrays, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import arrays, maths, temporal, text
from docengine.functions.nulls import first_given
from docengine.plans.tables import Tables
from docengine.registry import query


DECODED = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"""


@query(f"""SELECT page_id, trim({DECODED.format("regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\\s+', ' ', 'g')")}) AS title FROM pages""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1, STR3."""
    return Tables(spark, sf_dir).pages.select("page_id", text.clean_text(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(f"""SELECT page_id, sha256({DECODED.format("html")} || ' ' || chr(CAST(200 + page_id % 700 AS INTEGER)) || chr(CAST(9000 + page_id % 400 AS INTEGER)) || '€ é ¬it; &bogus; &eacute;') AS decoded_sha256 FROM pages""")
def decoded_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR1: references in whole pages, and after them numbers, a name without its semicolon, an unknown one and one that is escaped twice."""
    n = F.col("page_id")
    tail = F.concat(F.lit(" &#"), (200 + n % 700).cast("string"), F.lit(";&#x"), F.hex(9000 + n % 400), F.lit(";&#128; &eacute &notit; &bogus; &amp;eacute;"))
    return Tables(spark, sf_dir).pages.select("page_id", F.sha2(text.unescape(F.concat("html", tail)), 256).alias("decoded_sha256"))


@query(r"""SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS bare_sha256, CAST(length(regexp_replace(html, '<[^>]+>', '', 'g')) AS BIGINT) AS bare_length FROM pages""")
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2."""
    bare = Tables(spark, sf_dir).pages.select("page_id", text.strip_tags("html").alias("b"))
    return bare.select("page_id", F.sha2("b", 256).alias("bare_sha256"), F.length("b").cast("long").alias("bare_length"))


@query("""SELECT doc_id, source FROM documents WHERE contains(lower(text), 'licensed under') OR contains(lower(source), 'src1')""")
def lower_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, F11, STR10: a term looked for without case."""
    d = Tables(spark, sf_dir).documents
    return d.filter(F.lower("text").contains("licensed under") | F.lower("source").contains("src1")).select("doc_id", "source")


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_extract(rtrim(url), '([^/\\\\]*)$', 1), '[\\x00-\\x1F<>:"|?*]', '_', 'g'), '[. ]+$', '') AS bare,
left(CASE WHEN regexp_replace(regexp_replace(regexp_extract(rtrim(url), '([^/\\\\]*)$', 1), '[\\x00-\\x1F<>:"|?*]', '_', 'g'), '[. ]+$', '') = '' THEN '_' ELSE regexp_replace(regexp_replace(regexp_extract(rtrim(url), '([^/\\\\]*)$', 1), '[\\x00-\\x1F<>:"|?*]', '_', 'g'), '[. ]+$', '') END, 80) AS name FROM pages""".replace("\\\\\\\\", "\\\\"))
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR6: names that any file system takes."""
    bare = F.regexp_replace(F.regexp_replace(text.base_name("url"), r'[\x00-\x1F<>:"|?*]', "_"), r"[. ]+$", "")
    return Tables(spark, sf_dir).pages.select("page_id", bare.alias("bare"), text.safe_file_name("url").alias("name"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey * 37 + p_size) % 16384 + 1 AS n FROM part)
SELECT p_partkey, n AS number, CASE WHEN n > 702 THEN chr(CAST(65 + (n - 703) // 676 AS INTEGER)) ELSE '' END || CASE WHEN n > 26 THEN chr(CAST(65 + ((n - 27) // 26) % 26 AS INTEGER)) ELSE '' END || chr(CAST(65 + (n - 1) % 26 AS INTEGER)) AS letters, n AS back FROM p""")
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR16: sheet columns from 1 to 16384, named and read back."""
    n = (F.col("p_partkey") * 37 + F.col("p_size")) % 16384 + 1
    named = Tables(spark, sf_dir).part.select("p_partkey", n.alias("number")).withColumn("letters", text.column_letters("number"))
    return named.withColumn("back", text.column_number("letters").cast("long"))


@query("""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[,，;；' || chr(10) || ']+'), lambda s: trim(s)), lambda s: s <> '') AS parts FROM documents""")
def split_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR9, F23: parts of a list, trimmed, empty ones dropped."""
    return Tables(spark, sf_dir).documents.select("doc_id", text.split_trim("text").alias("parts"))


@query(r"""SELECT event_id, 'opened ' || regexp_replace('/home/user' || user_id || '/in/' || event_type || '.docx', '(?:/(?:Users|home|var|tmp|private|opt|etc|mnt|Volumes)(?:/[^/\s"''<>|]+)*)/([^/\s"''<>|]+)', '\1', 'g') || ' ok' AS message FROM events""")
def redact_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """absolute paths cut to their last part."""
    said = F.concat(F.lit("opened /home/user"), F.col("user_id").cast("string"), F.lit("/in/"), "event_type", F.lit(".docx ok"))
    return Tables(spark, sf_dir).events.select("event_id", text.redact_paths(said).alias("message"))


@query(r"""SELECT doc_id, regexp_replace(text, '[^\x20-\x7E]', '?', 'g') AS shown FROM documents""")
def ascii_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR18, T3."""
    return Tables(spark, sf_dir).documents.select("doc_id", text.ascii_project("text").alias("shown"))


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS html, '来源：' || source || '；语言：' || lang AS label FROM documents""")
def escape_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR8, STR15."""
    return Tables(spark, sf_dir).documents.select("doc_id", text.escape("text").alias("html"), F.concat_ws("；", F.concat(F.lit("来源："), "source"), F.concat(F.lit("语言："), "lang")).alias("label"))


@query("""SELECT o_orderkey, CAST(s AS BIGINT) AS seconds, CASE WHEN s >= 3600 THEN (s // 3600) || '小时' || ((s // 60) % 60) || '分' || (s % 60) || '秒' WHEN s >= 60 THEN (s // 60) || '分' || (s % 60) || '秒' ELSE s || '秒' END AS label
FROM (SELECT o_orderkey, greatest(coalesce(CAST(epoch(o_orderdate + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) - o_orderdate) AS BIGINT), 0), 0) AS s FROM orders)""")
def duration_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT3, DT4."""
    start = F.col("o_orderdate").cast("timestamp")
    end = F.timestamp_seconds(F.unix_seconds(start) + F.floor("o_totalprice"))
    o = Tables(spark, sf_dir).orders.select("o_orderkey", temporal.duration_seconds(start, end, F.lit(None).cast("timestamp")).alias("seconds"))
    return o.withColumn("label", temporal.duration_label("seconds"))


@query("""SELECT event_id, ts <= TIMESTAMP '2024-01-10 00:00:00' AS expired FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'""")
def retention_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT5: at or before the cutoff."""
    gone = temporal.expired("ts", F.expr("timestamp_ntz'2024-01-10 00:00:00'"))
    return Tables(spark, sf_dir).events.filter(gone).select("event_id", gone.alias("expired"))


@query("""SELECT event_id, CASE WHEN event_id % 5 < 3 THEN epoch_us(date_trunc('second', ts)) - CASE WHEN event_id % 5 = 1 THEN (user_id % 12) * 3600000000 ELSE 0 END END AS micros FROM events""")
def parse_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DT2: events' instants as texts: Z and offsets read, naive as UTC, junk null."""
    k, at = F.col("event_id") % 5, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    said = F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, F.concat(at, F.format_string("+%02d:00", F.col("user_id") % 12))).when(k == 2, at).when(k == 3, F.concat(F.lit("soon "), at)).otherwise("")
    return Tables(spark, sf_dir).events.select("event_id", F.unix_micros(temporal.parse_instant(said)).alias("micros"))


@query("""SELECT l_orderkey, l_linenumber, l_discount, CAST(round(CAST(l_discount AS DECIMAL(20, 6)) * 100000, 0) AS BIGINT) AS crop,
CAST(((CAST(round(CAST(l_quantity * 17 AS DECIMAL(20, 6)) * 60000, 0) AS BIGINT) % 21600000) + 21600000) % 21600000 AS BIGINT) AS turn FROM lineitem""")
def half_up_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA2: crops and angles, exact in decimals."""
    return Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_discount", maths.half_up("l_discount", 100000).alias("crop"), maths.angle_60000(F.col("l_quantity") * 17).alias("turn"))


@query("""SELECT p_partkey, CAST(round(p_size * CASE p_partkey % 4 WHEN 0 THEN 914400 WHEN 1 THEN 360000 WHEN 2 THEN 12700 ELSE 0 END, 0) AS BIGINT) AS emu,
CAST(floor((p_size * CASE p_partkey % 4 WHEN 0 THEN 914400 WHEN 1 THEN 360000 WHEN 2 THEN 12700 ELSE 0 END + 317) / 635.0) AS BIGINT) AS twips FROM part""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA3, MA5."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("in", "cm", "pt", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = Tables(spark, sf_dir).part.select("p_partkey", maths.to_emu(F.concat(F.col("p_size").cast("string"), unit)).alias("emu"))
    return p.withColumn("twips", maths.emu_to_twips("emu"))


@query("""SELECT p_partkey, round(w * abs(cos(radians(a))) + h * abs(sin(radians(a))), 6) AS box_w, round(w * abs(sin(radians(a))) + h * abs(cos(radians(a))), 6) AS box_h,
round(least(1.0, 30.0 / (w * abs(cos(radians(a))) + h * abs(sin(radians(a)))), 20.0 / (w * abs(sin(radians(a))) + h * abs(cos(radians(a))))), 6) AS scale
FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS w, p_size / 2.0 AS h, CAST(p_partkey % 360 AS DOUBLE) AS a FROM part)""")
def bbox_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MA4."""
    p = Tables(spark, sf_dir).part.select("p_partkey", F.col("p_size").cast("double").alias("w"), (F.col("p_size") / 2.0).alias("h"), (F.col("p_partkey") % 360).cast("double").alias("a"))
    w, h = maths.rotated_box(F.col("w"), F.col("h"), F.col("a"))
    return p.select("p_partkey", F.round(w, 6).alias("box_w"), F.round(h, 6).alias("box_h"), F.round(maths.fit_scale(w, h, F.lit(30.0), F.lit(20.0)), 6).alias("scale"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{"id":' || event_id || ',"kind":"' || event_type || '"}' AS out FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS1, O7, S17."""
    e = Tables(spark, sf_dir).events
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))).alias("out"))


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), nullif(source, ''), 'none') AS chosen FROM documents""")
def truthy_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS2: the first spelling of a key that's given."""
    snake = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang"))
    return Tables(spark, sf_dir).documents.select("doc_id", first_given(snake, "source", F.lit("none")).alias("chosen"))


@query("""SELECT l_orderkey, list_transform(range(0, CAST(max(l_linenumber) + 1 AS BIGINT)), lambda i: coalesce(list_first(list_filter(list(l_linenumber || ':' || l_returnflag ORDER BY l_returnflag DESC), lambda x: starts_with(x, i || ':'))), '')) AS vec
FROM lineitem GROUP BY l_orderkey""".replace("list_first(", "list_extract(").replace("i || ':'))), '')", "i || ':')), 1), '')"))
def dense_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR3: a sparse vector made dense, gaps blank."""
    few = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("f"))
    m = few.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", F.concat_ws(":", F.col("l_linenumber").cast("string"), "f")))).alias("m"))
    return m.select("l_orderkey", arrays.dense("m").alias("vec"))


@query("""SELECT doc_id, len(list_filter(['en', 'de', source], lambda x: NOT list_contains(['en', 'de', 'fr', 'src1', 'src2'], x))) = 0 AS inside, list_sort(list_distinct(list_concat(['en', lang], ['de']))) AS keys FROM documents""")
def set_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, U4, U6."""
    d = Tables(spark, sf_dir).documents
    known = F.array(*[F.lit(x) for x in ("en", "de", "fr", "src1", "src2")])
    return d.select("doc_id", arrays.subset(F.array(F.lit("en"), F.lit("de"), "source"), known).alias("inside"), F.array_sort(F.array_union(F.array(F.lit("en"), "lang"), F.array(F.lit("de")))).alias("keys"))


@query("""SELECT doc_id, left(text, 48) AS short, CAST(length(left(text, 240)) AS BIGINT) AS n FROM documents WHERE source IN ('src1', 'src2') AND n_chars BETWEEN 500 AND 5000""")
def conjunctive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7, F10, T3."""
    d = Tables(spark, sf_dir).documents.filter(F.col("source").isin("src1", "src2") & F.col("n_chars").between(500, 5000))
    return d.select("doc_id", F.left("text", F.lit(48)).alias("short"), F.length(F.left("text", F.lit(240))).cast("long").alias("n"))
