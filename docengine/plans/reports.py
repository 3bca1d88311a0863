"""Report building: counters, quality checks, failure rows, dashboards, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions import binary
from docengine.functions.nulls import not_in_or_null, safe_int
from docengine.functions.text import tag_count
from docengine.operators import relational as R
from docengine.plans.tables import Tables
from docengine.registry import query

N = lambda name: F.count(F.lit(1)).alias(name)
IF = lambda cond, name: F.count_if(cond).alias(name)


@query("""SELECT o_orderkey AS report_id, count(l_orderkey) AS item_count, count(*) FILTER (WHERE l_returnflag = 'N') AS success_count,
count(*) FILTER (WHERE l_returnflag = 'R') AS fail_count, count(*) FILTER (WHERE l_linestatus = 'O') AS pending_count,
count(*) FILTER (WHERE l_discount >= 0.05) AS formula_count, count(*) FILTER (WHERE l_quantity < 10) AS small_image_count,
CAST(coalesce(max(l_linenumber), 0) AS INTEGER) AS last_line FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def report_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: all counters of a report in one pass over its items."""
    t = Tables(spark, sf_dir)
    per = t.lineitem.groupBy(F.col("l_orderkey").alias("report_id")).agg(N("item_count"), IF(F.col("l_returnflag") == "N", "success_count"), IF(F.col("l_returnflag") == "R", "fail_count"), IF(F.col("l_linestatus") == "O", "pending_count"), IF(F.col("l_discount") >= 0.05, "formula_count"), IF(F.col("l_quantity") < 10, "small_image_count"), F.max("l_linenumber").alias("last_line"))
    out = t.orders.select(F.col("o_orderkey").alias("report_id")).join(per, "report_id", "left")
    return out.select("report_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in per.columns[1:]])


@query("""WITH f AS (SELECT d.doc_id, d.source, coalesce(l.toxic = 1, FALSE) OR d.n_chars < 100 AS failed, l.doc_id IS NULL AS pending, d.lang = 'fr' AS cancelled FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT source, CASE WHEN failed THEN 'fail' WHEN pending THEN 'pending' WHEN cancelled THEN 'cancelled' ELSE 'success' END AS s FROM f)
SELECT source, count(*) AS files, count(*) FILTER (WHERE s = 'fail') AS fail_count, count(*) FILTER (WHERE s = 'pending') AS pending_count, count(*) FILTER (WHERE s = 'cancelled') AS cancelled_count,
greatest(count(*) - count(*) FILTER (WHERE s <> 'success'), 0) AS success_count FROM c GROUP BY source""")
def status_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fail before pending before cancelled; the rest succeeded."""
    t = Tables(spark, sf_dir)
    d = t.documents.select("doc_id", "source", "lang", "n_chars").join(t.labels.select("doc_id", "toxic", F.lit(True).alias("seen")), "doc_id", "left")
    failed = F.coalesce(F.col("toxic") == 1, F.lit(False)) | (F.col("n_chars") < 100)
    s = F.when(failed, "fail").when(F.col("seen").isNull(), "pending").when(F.col("lang") == "fr", "cancelled").otherwise("success")
    return d.withColumn("s", s).groupBy("source").agg(N("files"), *[IF(F.col("s") == k, f"{k}_count") for k in ("fail", "pending", "cancelled")], F.greatest(F.count(F.lit(1)) - F.count_if(F.col("s") != "success"), F.lit(0)).alias("success_count"))


@query("""SELECT source, CAST(sum(greatest(coalesce(TRY_CAST(regexp_extract(text, '([0-9]{1,6})', 1) AS INTEGER), 0), 0)) AS BIGINT) AS numbers, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS characters FROM documents GROUP BY source""")
def source_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, MA1: sums over nested values, junk counted as 0."""
    d = Tables(spark, sf_dir).documents
    return d.groupBy("source").agg(F.sum(safe_int(F.regexp_extract("text", "([0-9]{1,6})", 1))).alias("numbers"), F.max("n_chars").alias("most"), F.sum("n_chars").alias("characters"))


CHECKS = [("total", "文件总数"), ("empty", "空文件"), ("short", "过短"), ("long", "过长"), ("unlabelled", "待确认"), ("toxic", "异常"), ("best", "三项最大")]


@query("""WITH a AS (SELECT count(*) AS total, count(*) FILTER (WHERE d.n_chars = 0) AS empty, count(*) FILTER (WHERE d.n_chars < 200) AS short, count(*) FILTER (WHERE d.n_chars > 10000) AS long,
count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE l.toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)),
u AS (SELECT 'total' AS id, '文件总数' AS label, total AS metric FROM a UNION ALL SELECT 'empty', '空文件', empty FROM a UNION ALL SELECT 'short', '过短', short FROM a UNION ALL SELECT 'long', '过长', long FROM a
UNION ALL SELECT 'unlabelled', '待确认', unlabelled FROM a UNION ALL SELECT 'toxic', '异常', toxic FROM a UNION ALL SELECT 'best', '三项最大', greatest(short, long, toxic) FROM a)
SELECT *, CASE WHEN id = 'total' THEN '通过' WHEN metric = 0 THEN '通过' WHEN id IN ('toxic', 'empty') THEN '失败' ELSE '警告' END AS status FROM u""")
def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed check table from one aggregation, unpivoted."""
    t = Tables(spark, sf_dir)
    d = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "toxic", F.lit(True).alias("seen")), "doc_id", "left")
    a = d.agg(N("total"), IF(F.col("n_chars") == 0, "empty"), IF(F.col("n_chars") < 200, "short"), IF(F.col("n_chars") > 10000, "long"), IF(F.col("seen").isNull(), "unlabelled"), IF(F.col("toxic") == 1, "toxic"))
    a = a.withColumn("best", F.greatest("short", "long", "toxic"))
    table = R.unpivoted(a, [(i, label, F.col(i)) for i, label in CHECKS])
    return table.withColumn("status", F.when((F.col("id") == "total") | (F.col("metric") == 0), "通过").when(F.col("id").isin("toxic", "empty"), "失败").otherwise("警告"))


@query("""SELECT '校验失败' AS category, doc_id AS file_id, source AS file_name, '失败' AS status, 'n_chars' AS source_id FROM documents WHERE n_chars < 100
UNION ALL SELECT '人工标记', l.doc_id, coalesce(d.source, CAST(l.doc_id AS VARCHAR)), '异常', 'label' FROM labels l LEFT JOIN documents d USING (doc_id) WHERE l.toxic = 1
UNION ALL SELECT '输出缺失', o_orderkey, CAST(o_custkey AS VARCHAR), o_orderstatus, 'orders' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT '日志错误', event_id, event_type, '失败', 'events' FROM events WHERE event_type = 'error' AND value > 90""")
def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One list of failures from all their sources."""
    t = Tables(spark, sf_dir)
    row = lambda df, category, i, name, status, origin: df.select(F.lit(category).alias("category"), F.col(i).alias("file_id"), name.alias("file_name"), status.alias("status"), F.lit(origin).alias("source_id"))
    marked = R.named(t.labels.filter("toxic = 1"), t.documents.select("doc_id", F.col("source").alias("file_name")), "doc_id")
    return R.union_all([
        row(t.documents.filter("n_chars < 100"), "校验失败", "doc_id", F.col("source"), F.lit("失败"), "n_chars"),
        row(marked, "人工标记", "doc_id", F.col("file_name"), F.lit("异常"), "label"),
        row(t.orders.filter("o_orderstatus = 'P'"), "输出缺失", "o_orderkey", F.col("o_custkey").cast("string"), F.col("o_orderstatus"), "orders"),
        row(t.events.filter("event_type = 'error' and value > 90"), "日志错误", "event_id", F.col("event_type"), F.lit("失败"), "events"),
    ])


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<(?:[A-Za-z0-9]+:)?p[\\s/>]')) AS BIGINT) AS paragraphs, CAST(len(regexp_extract_all(html, '<(?:[A-Za-z0-9]+:)?li[\\s/>]')) AS BIGINT) AS items,
CAST(len(regexp_extract_all(html, '<(?:[A-Za-z0-9]+:)?a[\\s/>]')) AS BIGINT) AS links FROM pages""")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in markup by element name, prefix or not."""
    return Tables(spark, sf_dir).pages.select("page_id", tag_count("html", "p").alias("paragraphs"), tag_count("html", "li").alias("items"), tag_count("html", "a").alias("links"))


@query("""SELECT page_id, greatest(CAST(len(regexp_extract_all(html, '<a[\\s/>]')) AS BIGINT), CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS BIGINT)) AS objects FROM pages""")
def sheet_object_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: the larger of the tag count and the distinct related parts."""
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))
    return Tables(spark, sf_dir).pages.select("page_id", F.greatest(F.regexp_count("html", F.lit(r"<a[\s/>]")).cast("long"), F.size(hrefs).cast("long")).alias("objects"))


CUT = "2024-01-15 00:00:00"


@query("""SELECT count(*) AS recent FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def log_24h_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of the last 24 hours of the stream; the bound is a scalar, so the filter reaches the scan."""
    e = Tables(spark, sf_dir).events
    newest = e.agg((F.max("ts") - F.expr("interval 1 day")).alias("lo"))
    return e.select("ts").filter(F.col("ts") >= newest.scalar()).agg(N("recent"))


@query("""SELECT event_type AS level, count(*) AS lines, CAST(coalesce(sum(length(props)), 0) AS BIGINT) AS bytes, CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS rank
FROM events GROUP BY event_type ORDER BY rank, level""")
def log_level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By level, in an order of its own."""
    rank = F.when(F.col("level") == "error", 0).when(F.col("level") == "purchase", 1).when(F.col("level") == "signup", 2).otherwise(3)
    e = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("level")).agg(N("lines"), F.coalesce(F.sum(F.length("props")), F.lit(0)).alias("bytes"))
    return e.withColumn("rank", rank).orderBy("rank", "level")


@query("""SELECT user_id, count(*) AS lines FROM events GROUP BY user_id ORDER BY lines DESC, user_id LIMIT 10""")
def log_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest groups."""
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(N("lines")).orderBy(F.desc("lines"), "user_id").limit(10)


@query("""SELECT source, count(*) AS files, count(DISTINCT lang) AS types, count(*) FILTER (WHERE n_chars > 5000) AS large, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source""")
def type_status_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    return Tables(spark, sf_dir).documents.groupBy("source").agg(N("files"), F.count_distinct("lang").alias("types"), IF(F.col("n_chars") > 5000, "large"), F.sum("n_chars").alias("size"))


@query("""SELECT round(avg(o_totalprice), 0) AS mean_duration FROM (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8)""")
def recent_mean_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over the eight newest finished tasks."""
    o = Tables(spark, sf_dir).orders.filter("o_orderstatus = 'F'").select("o_totalprice", "o_orderdate", "o_orderkey")
    return o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(8).agg(F.round(F.avg("o_totalprice"), 0).alias("mean_duration"))


@query("""SELECT user_id, count(*) AS objects, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id HAVING sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) > 0""")
def nested_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, JS1: sums over a nested value; empty ones left out."""
    e = Tables(spark, sf_dir).events.select("user_id", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("user_id").agg(N("objects"), F.sum("p.k").alias("total")).filter("total > 0")


@query("""SELECT conv_id, string_agg(DISTINCT role, '；' ORDER BY role) AS roles, count(*) AS paragraph_count, CAST(sum(length(text)) AS BIGINT) AS characters FROM conversations GROUP BY conv_id""")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs as a sorted set, and what text there is."""
    return Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("role")), "；").alias("roles"), N("paragraph_count"), F.sum(F.length("text")).alias("characters"))


@query("""SELECT doc_id, sha256(text) AS image_hash, count(*) OVER (PARTITION BY sha256(text)) > 1 AS is_duplicate FROM documents""")
def duplicate_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, BI1: contents that occur twice; those without a text are equal too. Only digests that repeat are joined back, as flags."""
    d = Tables(spark, sf_dir).documents.select("doc_id", binary.sha256(F.col("text").cast("binary")).alias("image_hash"))
    again = d.groupBy("image_hash").count().filter("count > 1").select(F.col("image_hash").alias("h"), F.lit(True).alias("again"))
    return d.join(again, d["image_hash"].eqNullSafe(again["h"]), "left").select("doc_id", "image_hash", F.coalesce("again", F.lit(False)).alias("is_duplicate"))


@query("""SELECT event_type AS macro, count(*) AS usage_count, max(ts) AS last_used_at, max(ts) >= TIMESTAMP '2024-01-15 00:00:00' AS recently_used FROM events GROUP BY event_type""")
def usage_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("macro")).agg(N("usage_count"), F.max("ts").alias("last_used_at"), (F.max("ts") >= F.expr(f"timestamp_ntz'{CUT}'")).alias("recently_used"))


@query("""SELECT coalesce(o_orderstatus, '') AS status, CASE WHEN coalesce(o_orderstatus, '') = 'F' THEN 'success' WHEN coalesce(o_orderstatus, '') = 'O' THEN 'pending' ELSE 'failure' END AS class, count(*) AS n FROM orders GROUP BY 1, 2""")
def artifact_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whatever is neither success nor pending is a failure, a missing status too."""
    o = Tables(spark, sf_dir).orders
    kind = F.when(~not_in_or_null("o_orderstatus", "F"), "success").when(~not_in_or_null("o_orderstatus", "O"), "pending").otherwise("failure")
    return o.groupBy(F.coalesce("o_orderstatus", F.lit("")).alias("status"), kind.alias("class")).agg(N("n"))


@query("""SELECT doc_id, quality, toxic, quality < 80 AND toxic = 1 AS low_fixed FROM labels WHERE quality = 0 OR toxic = 1""")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One threshold is a parameter, the other is fixed."""
    threshold = 1
    return Tables(spark, sf_dir).labels.filter((F.col("quality") < threshold) | (F.col("toxic") == 1)).select("doc_id", "quality", "toxic", ((F.col("quality") < 80) & (F.col("toxic") == 1)).alias("low_fixed"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest report of each task, by max_by: one row a task and map task is shuffled, nothing is sorted."""
    o = Tables(spark, sf_dir).orders
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", F.col("x.o_orderkey").alias("o_orderkey"), F.col("x.o_orderdate").alias("o_orderdate"))


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC""")
def reports_of_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key, newest first; the filter reaches the scan."""
    return Tables(spark, sf_dir).orders.filter("o_custkey = 7").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""SELECT event_id, user_id, event_type, ts FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 200""")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 logs of a category."""
    return Tables(spark, sf_dir).events.filter("event_type = 'error'").select("event_id", "user_id", "event_type", "ts").orderBy(F.desc("event_id")).limit(200)


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS at, event_type, CAST(user_id AS VARCHAR) || ' ' || event_type AS message FROM events ORDER BY event_id DESC LIMIT 5000""")
def log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 5000 logs, told in ascending order."""
    e = Tables(spark, sf_dir).events.orderBy(F.desc("event_id")).limit(5000).orderBy("event_id")
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("at"), "event_type", F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("message"))


@query("""SELECT page_id, n, rn FROM (SELECT page_id, length(html) AS n, row_number() OVER (PARTITION BY length(html) % 10 ORDER BY length(html) DESC, page_id) AS rn FROM pages) WHERE rn <= 3""")
def preview_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most k of each kind."""
    p = Tables(spark, sf_dir).pages.select("page_id", F.length("html").cast("long").alias("n"))
    w = Window.partitionBy(F.col("n") % 10).orderBy(F.desc("n"), "page_id")
    return p.withColumn("rn", F.row_number().over(w).cast("long")).filter("rn <= 3")
