"""Overlays, lookups and other joins: documents as files, labels as annotations, orders as tasks, lineitem as artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.functions.nulls import truthy
from docengine.operators import relational as R
from docengine.plans.tables import Tables
from docengine.registry import query

PENDING, DONE, FIXED = "待确认", "已确认", "已修正"


@query(f"""SELECT d.doc_id, d.source, coalesce(l.quality, -1) AS quality,
CASE WHEN l.doc_id IS NULL THEN '{PENDING}' WHEN l.quality = 1 THEN '{DONE}' ELSE '{FIXED}' END AS status
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def overlay_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with their annotations."""
    t = Tables(spark, sf_dir)
    notes = t.labels.select("doc_id", "quality", F.lit(True).alias("seen"))
    status = F.when(F.col("seen").isNull(), PENDING).when(F.col("quality") == 1, DONE).otherwise(FIXED)
    return t.documents.select("doc_id", "source").join(notes, "doc_id", "left").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality"), status.alias("status"))


@query("""SELECT e.vec_id, e.label, coalesce(d.source, CAST(e.vec_id AS VARCHAR)) AS file_name,
CASE WHEN l.toxic = 1 THEN '印章' WHEN l.quality = 1 THEN '公式' WHEN l.quality = 0 THEN '图标' ELSE '图片' END AS image_type
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN labels l ON l.doc_id = e.vec_id""")
def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, AR5: images with annotation and file; the id stands in for a missing file; the first matching kind."""
    t = Tables(spark, sf_dir)
    images = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    withfile = R.named(images, t.documents.select("doc_id", "source").withColumnRenamed("source", "file_name"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "印章").when(F.col("quality") == 1, "公式").when(F.col("quality") == 0, "图标").otherwise("图片")
    return withfile.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("vec_id"), "label", "file_name", kind.alias("image_type"))


@query("""SELECT l.doc_id, 'dependency' AS origin FROM labels l WHERE l.quality = 0
UNION ALL SELECT d.doc_id, 'file' FROM documents d WHERE d.n_chars < 200 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.quality = 0 AND l.doc_id = d.doc_id)""")
def missing_not_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems found, and flagged files that no problem covers yet."""
    t = Tables(spark, sf_dir)
    have = t.labels.filter("quality = 0").select("doc_id", F.lit("dependency").alias("origin"))
    flagged = t.documents.filter("n_chars < 200").select("doc_id", F.lit("file").alias("origin"))
    return R.not_covered(have, flagged, ["doc_id"])


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_returnflag, coalesce(o.o_orderstatus, CAST(l.l_orderkey AS VARCHAR)) AS task_status
FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag IN ('R') OR l.l_quantity >= 49""")
def macro_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed artifacts with their task."""
    t = Tables(spark, sf_dir)
    failed = t.lineitem.filter(F.col("l_returnflag").isin("R") | (F.col("l_quantity") >= 49)).select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    tasks = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    return failed.join(tasks, F.col("l_orderkey") == F.col("k"), "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.coalesce("o_orderstatus", F.col("l_orderkey").cast("string")).alias("task_status"))


@query("""WITH b AS (SELECT l_shipmode AS label, n AS before FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY 1)),
a AS (SELECT l_linestatus AS label, count(*) AS after FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT label, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta,
greatest(coalesce(before, 0) - coalesce(after, 0), 0) AS lost FROM b FULL JOIN a USING (label)""")
def source_vs_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object counts before and after over the union of labels."""
    t = Tables(spark, sf_dir)
    items = t.lineitem.select("l_orderkey", "l_returnflag", "l_linestatus").join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus"), "l_orderkey")
    before = items.filter("o_orderstatus = 'F'").groupBy(F.col("l_returnflag").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    after = items.filter("o_orderstatus = 'O'").groupBy(F.col("l_linestatus").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return R.compared(before, after, "label", "n").withColumn("lost", F.greatest(-F.col("delta"), F.lit(0)))


REGIONS = [(1, 100, 1, 400, 2), (2, 300, 2, 900, 4), (3, 2000, 5, 2100, 7)]


@query(f"""WITH r(id, top, lft, bottom, rgt) AS (VALUES {", ".join(map(str, REGIONS))}),
c AS (SELECT l_orderkey AS "row", l_linenumber AS col, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
SELECT c."row", c.col, c.value, min(r.id) AS region FROM c LEFT JOIN r ON c."row" BETWEEN r.top AND r.bottom AND c.col BETWEEN r.lft AND r.rgt GROUP BY 1, 2, 3""")
def range_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with the first merged region that holds them."""
    cells = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max("l_quantity").alias("value"))
    regions = spark.createDataFrame(REGIONS, "id int, top long, left int, bottom long, right int")
    return R.within_regions(cells, regions, [])


@query("""WITH p AS (SELECT l_orderkey AS series, l_linenumber - 1 AS idx, max(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2),
k AS (SELECT l_orderkey AS series, l_linenumber - 1 AS idx, max(l_linestatus) AS category FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2)
SELECT series, idx, coalesce(category, CAST(idx + 1 AS VARCHAR)) AS category, coalesce(CAST(CAST(value AS BIGINT) AS VARCHAR), '') AS value FROM p FULL JOIN k USING (series, idx)""")
def sparse_points_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J9, AR3: chart points; a missing category is its 1-based index, a missing value blank and not zero."""
    items = Tables(spark, sf_dir).lineitem
    at = [F.col("l_orderkey").alias("series"), (F.col("l_linenumber") - 1).alias("idx")]
    values = items.filter("l_returnflag = 'N'").groupBy(*at).agg(F.max("l_quantity").alias("value"))
    cats = items.filter("l_linestatus = 'O'").groupBy(*at).agg(F.max("l_linestatus").alias("category"))
    return values.join(cats, ["series", "idx"], "full").select("series", "idx", F.coalesce("category", (F.col("idx") + 1).cast("string")).alias("category"), F.coalesce(F.col("value").cast("long").cast("string"), F.lit("")).alias("value"))


@query("""WITH p(id, name) AS (VALUES ('USER', '老师'), ('Assistant', '助手'))
SELECT c.conv_id, c.turn, c.role, coalesce(p.name, '') AS author FROM conversations c LEFT JOIN p ON lower(p.id) = lower(c.role)""")
def person_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, STR10: authors by id, case ignored; unknown ones are empty."""
    people = spark.createDataFrame([("USER", "老师"), ("Assistant", "助手")], "id string, name string").select(F.lower("id").alias("k"), "name")
    c = Tables(spark, sf_dir).conversations
    return c.join(people, F.lower(c["role"]) == F.col("k"), "left").select("conv_id", "turn", "role", F.coalesce("name", F.lit("")).alias("author"))


@query("""WITH roots AS (SELECT conv_id, min(turn) AS turn FROM conversations WHERE role = 'user' GROUP BY conv_id),
first_any AS (SELECT conv_id, min(turn) AS at FROM conversations GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE WHEN r.conv_id IS NOT NULL THEN f.at ELSE c.turn END AS ref FROM conversations c
LEFT JOIN roots r ON r.conv_id = c.conv_id AND r.turn = c.turn JOIN first_any f ON f.conv_id = c.conv_id
WHERE NOT (c.role = 'system' AND EXISTS (SELECT 1 FROM roots x WHERE x.conv_id = c.conv_id))""")
def placeholder_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders go where a thread's root exists, and the root takes over their place."""
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", "role")
    roots = c.filter("role = 'user'").groupBy("conv_id").agg(F.min("turn").alias("root_turn"))
    places = c.groupBy("conv_id").agg(F.min("turn").alias("at"))
    kept = c.filter("role = 'system'").join(roots, "conv_id", "left_anti").unionByName(c.filter("role <> 'system'"))
    return kept.join(roots, "conv_id", "left").join(places, "conv_id").select("conv_id", "turn", F.when(F.col("turn") == F.col("root_turn"), F.col("at")).otherwise(F.col("turn")).alias("ref"))


@query("""WITH RECURSIVE n AS (SELECT conv_id * 1000 + turn AS id, (SELECT max(p.conv_id * 1000 + p.turn) FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn < c.turn) AS parent_id FROM conversations c),
w(id, root, depth) AS (SELECT id, id, CAST(0 AS BIGINT) FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, w.root, w.depth + 1 FROM n JOIN w ON n.parent_id = w.id)
SELECT id, root, depth FROM w""")
def thread_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies up to the comment that opened the thread."""
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn").distinct()
    up = F.lag(F.col("conv_id") * 1000 + F.col("turn")).over(Window.partitionBy("conv_id").orderBy("turn"))
    return R.ancestors(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), up.alias("parent_id")))


@query("""WITH RECURSIVE s AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS parent_id, p_partkey % 3 AS k, p_brand AS brand, p_size AS size FROM part),
v AS (SELECT id, 'font' AS name, brand AS value FROM s WHERE k = 0 UNION ALL SELECT id, 'size', CAST(size AS VARCHAR) FROM s WHERE k <> 1 UNION ALL SELECT id, 'bold', '1' FROM s WHERE size > 45),
w AS (SELECT id, id AS at, parent_id, 0 AS depth FROM s UNION ALL SELECT w.id, s.id, s.parent_id, w.depth + 1 FROM w JOIN s ON w.parent_id = s.id),
b AS (SELECT w.id, v.name, arg_min(v.value, w.depth) AS value FROM w JOIN v ON v.id = w.at GROUP BY 1, 2)
SELECT s.id, coalesce(string_agg(name || '=' || value, ';' ORDER BY name), '') AS resolved FROM s LEFT JOIN b USING (id) GROUP BY 1""")
def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J14, AR4: parts as styles, each on the one with half its number, with what they inherit; the nearest style's value wins."""
    k = F.col("p_partkey")
    given = lambda when, name, value: F.when(when, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))
    props = F.map_concat(given(k % 3 == 0, "font", F.col("p_brand")), given(k % 3 != 1, "size", F.col("p_size").cast("string")), given(F.col("p_size") > 45, "bold", F.lit("1")))
    styles = Tables(spark, sf_dir).part.select(k.alias("id"), F.when(k > 0, F.floor(k / 2)).alias("parent_id"), props.alias("props"))
    told = F.array_sort(F.transform(F.map_entries("props"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return R.inherited(styles).select("id", F.array_join(told, ";").alias("resolved"))


@query("""SELECT r_name, count(*) AS items, count(DISTINCT o_orderkey) AS tasks FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def relationship_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four hops of a relationship graph. Each task's items are counted before the joins, so one row a task crosses them."""
    t = Tables(spark, sf_dir)
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    hops = items.join(t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey")), "o_orderkey").join(t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey")
    hops = hops.join(t.nation.select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey").join(t.region.select("r_regionkey", "r_name"), "r_regionkey")
    return hops.groupBy("r_name").agg(F.sum("n").alias("items"), F.count(F.lit(1)).alias("tasks"))


@query("""SELECT o_orderkey, count(*) AS pending FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_linestatus = 'O') JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1""")
def pending_dedup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pending list, duplicates dropped, joined to its tasks."""
    t = Tables(spark, sf_dir)
    listed = t.lineitem.filter("l_linestatus = 'O'").select("l_orderkey", "l_partkey").distinct()
    return listed.join(t.orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("pending"))


@query("""SELECT d.doc_id, d.source, count(l.l_partkey) AS reports, max(l.l_shipdate) AS last_report FROM documents d LEFT JOIN lineitem l ON l.l_partkey = d.doc_id GROUP BY 1, 2""")
def reports_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports that name a file, counted before the join."""
    t = Tables(spark, sf_dir)
    per = t.lineitem.groupBy(F.col("l_partkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last_report"))
    return t.documents.select("doc_id", "source").join(per, "doc_id", "left").select("doc_id", "source", F.coalesce("n", F.lit(0)).alias("reports"), "last_report")


@query("""SELECT path, min(page_id) AS owner, count(DISTINCT page_id) AS holders FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages) GROUP BY path""")
def first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record that holds a path, for every path at once: exploded references, one aggregation."""
    refs = Tables(spark, sf_dir).pages.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))).alias("path"))
    return refs.groupBy("path").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("holders"))


@query("""SELECT event_id, user_id, event_type FROM events e WHERE e.event_type = 'error' OR EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.value > 95)""")
def disjunctive_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of a category, or of a task in a set."""
    e = Tables(spark, sf_dir).events.select("event_id", "user_id", "event_type", "value")
    marked = R.matched_flag(e, e.filter("event_type = 'purchase' and value > 95"), "user_id", "hit")
    return marked.filter((F.col("event_type") == "error") | truthy("hit")).select("event_id", "user_id", "event_type")


@query("""SELECT l.doc_id, l.quality, l.toxic FROM labels l WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')""")
def still_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection cut to what still exists."""
    t = Tables(spark, sf_dir)
    return t.labels.join(t.documents.filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "quality", "toxic")
