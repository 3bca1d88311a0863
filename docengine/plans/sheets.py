"""Windows, layout, grids, and changes of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docengine.operators import layout, markers, relational as R
from docengine.operators.pageindex import PageIndex
from docengine.plans.tables import Tables
from docengine.registry import query

LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("""SELECT role, min(conv_id * 1000 + turn) AS first_pos, count(*) AS n FROM conversations GROUP BY role""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by first occurrence."""
    return Tables(spark, sf_dir).conversations.groupBy("role").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_pos"), F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT source AS task, count(*) AS n, row_number() OVER (ORDER BY source) AS pos FROM documents GROUP BY 1),
u AS (SELECT task, row_number() OVER (ORDER BY n DESC, task) AS pos FROM s WHERE n % 2 = 0)
SELECT s.task, CAST(row_number() OVER (ORDER BY coalesce(u.pos, 1000000000), s.pos) AS BIGINT) AS place FROM s LEFT JOIN u USING (task)""")
def ordered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's order first (sources by their documents), then the recommended rest by name."""
    n = Tables(spark, sf_dir).documents.groupBy(F.col("source").alias("task")).agg(F.count(F.lit(1)).alias("n"))
    recommended = n.select("task", F.row_number().over(Window.orderBy("task")).alias("pos"))
    user = n.filter("n % 2 = 0").select("task", F.row_number().over(Window.orderBy(F.desc("n"), "task")).alias("pos"))
    merged = recommended.join(user.select("task", F.col("pos").alias("u")), "task", "left")
    return merged.select("task", F.row_number().over(Window.orderBy(F.coalesce("u", F.lit(1_000_000_000)), "pos")).cast("long").alias("place"))


@query(f"""SELECT doc_id, pos, CAST(count(*) FILTER (WHERE length(line) < 60) OVER w AS BIGINT) AS section, last_value(CASE WHEN length(line) < 60 THEN line END IGNORE NULLS) OVER w AS section_title
FROM ({LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def section_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings open sections and give their title."""
    b = lines(spark, sf_dir).withColumn("level", F.when(F.length("line") < 60, 1).otherwise(0))
    return layout.sections(b, title="line").select("doc_id", "pos", F.col("section").cast("long").alias("section"), "section_title")


@query(f"""WITH b AS (SELECT doc_id, pos, line, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM ({LINES})),
p AS (SELECT *, f + length(line) AS t, unnest(range(CAST(f // 320 AS BIGINT), CAST((f + length(line) - 1) // 320 + 1 AS BIGINT))) AS page FROM b WHERE length(line) > 0)
SELECT doc_id, page, pos, substr(line, CAST(greatest(page * 320, f) - f + 1 AS BIGINT), CAST(least((page + 1) * 320, t) - greatest(page * 320, f) AS BIGINT)) AS piece FROM p""")
def char_budget_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 320 characters; lines are cut, nothing is lost."""
    return layout.budget_pages(lines(spark, sf_dir), 320, text="line")


@query(f"""SELECT doc_id, (rn - 1) // 12 AS chunk, count(*) AS n, min(pos) AS first_pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM ({LINES})) GROUP BY 1, 2""")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve lines a slide."""
    return layout.chunks(lines(spark, sf_dir), 12).groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"))


@query("""WITH u AS (SELECT l_linenumber AS col, l_orderkey AS "row", max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
g AS (SELECT *, sum(CASE WHEN flag = prev THEN 0 ELSE 1 END) OVER (PARTITION BY col ORDER BY "row") AS island FROM (SELECT *, lag(flag) OVER (PARTITION BY col ORDER BY "row") AS prev FROM u))
SELECT col, CAST(island AS BIGINT) AS island, min("row") AS top, count(*) AS height, max(flag) AS flag FROM g GROUP BY 1, 2""")
def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical merges as islands of rows that continue; a column's rows are cut into bands, so no task has a whole column."""
    u = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_linenumber").alias("col"), F.col("l_orderkey").alias("row")).agg(F.max("l_returnflag").alias("flag"))
    return layout.banded_islands(u, ["col"], "row", "flag").groupBy("col", "island").agg(F.min("row").alias("top"), F.count(F.lit(1)).alias("height"), F.max("flag").alias("flag"))


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY l_orderkey) AS total, sum(w) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS upto FROM u)
SELECT l_orderkey, l_linenumber, w, CAST(floor(9144000 * upto / total) - floor(9144000 * (upto - w) / total) AS BIGINT) AS share FROM c""")
def proportional_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths in proportion that sum to the whole."""
    u = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.floor("l_quantity").cast("long")).alias("w"))
    return layout.allotted(u, ["l_orderkey"], ["l_linenumber"], "w", 9_144_000)


@query("""SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS progress FROM events""")
def monotone_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress that never moves back."""
    return layout.monotone(Tables(spark, sf_dir).events.select("event_id", "user_id", "value", "ts"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "value", "progress")


@query("""SELECT doc_id, n_chars, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS BIGINT) AS rn, (SELECT count(*) FROM documents) AS total_rows FROM documents QUALIFY rn BETWEEN 21 AND 40""")
def page_n_of_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of 20 rows, with the count of all. Only the first 40 rows are ever sorted in one place."""
    return layout.pages(Tables(spark, sf_dir).documents.select("doc_id", "n_chars"), 20, 2, F.desc("n_chars"), F.col("doc_id"))


@query("""WITH o AS (SELECT doc_id, n_chars, CAST(row_number() OVER (ORDER BY n_chars DESC NULLS LAST, doc_id) AS BIGINT) AS rn, CAST(count(*) OVER () AS BIGINT) AS total_rows FROM documents)
SELECT * FROM o WHERE (rn - 1) // 20 = (total_rows - 1) // 20 OR (rn - 1) // 20 = (total_rows - 1) // 40""")
def deep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of twenty rows and the one half way, each from the ranges of a sorted index that hold it."""
    index = PageIndex.build(Tables(spark, sf_dir).documents.select("doc_id", "n_chars"), ["-n_chars", "doc_id"], rows_a_range=64, most_ranges=512)
    last, half = (index.total - 1) // 20, (index.total - 1) // 40
    return index.page(last + 1, 20).unionByName(index.page(half + 1, 20)) if half != last else index.page(last + 1, 20)


@query("""SELECT event_id, user_id, value FROM events WHERE event_type = 'error' AND value < 20 ORDER BY ts DESC, event_id DESC LIMIT 1""")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the newest event that fits, looked for from the newest on and no further than it takes."""
    index = PageIndex.build(Tables(spark, sf_dir).events.select("event_id", "user_id", "event_type", "value", "ts"), ["-ts", "-event_id"], rows_a_range=256, most_ranges=512)
    return index.first((F.col("event_type") == "error") & (F.col("value") < 20)).select("event_id", "user_id", "value")


@query("""SELECT url, CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS number, page_id FROM pages ORDER BY number, url, page_id""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the number in a path."""
    return Tables(spark, sf_dir).pages.select("url", F.regexp_extract("url", "/([0-9]+)", 1).cast("long").alias("number"), "page_id").orderBy("number", "url", "page_id")


@query("""SELECT l_orderkey AS "row", max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS A, max(CASE WHEN l_linenumber = 2 THEN l_returnflag END) AS B, max(CASE WHEN l_linenumber = 3 THEN l_returnflag END) AS C,
max(CASE WHEN l_linenumber = 4 THEN l_returnflag END) AS D FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1""")
def cells_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse cells as a wide table, with named columns so no distinct pass is needed."""
    cells = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), F.col("l_returnflag").alias("value"))
    wide = layout.dense_grid(cells, [1, 2, 3, 4], [])[0]
    return wide.select("row", *[F.col(str(i)).alias(n) for i, n in zip((1, 2, 3, 4), "ABCD")])


@query("""SELECT l_orderkey, 'qty' AS series, l_linenumber AS category, max(l_quantity) AS value FROM lineitem GROUP BY 1, 3
UNION ALL SELECT l_orderkey, 'disc', l_linenumber, max(l_discount) FROM lineitem GROUP BY 1, 3""")
def chart_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chart's series as a long table."""
    few = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey", F.col("l_linenumber").alias("category")).agg(F.max("l_quantity").alias("qty"), F.max("l_discount").alias("disc"))
    return few.unpivot(["l_orderkey", "category"], ["qty", "disc"], "series", "value").select("l_orderkey", "series", "category", "value")


MARKERS = [(1, "licensed under"), (2, "all rights reserved"), (3, "mit license")]


@query(f"""WITH m(marker, term) AS (VALUES {", ".join(map(str, MARKERS))}), p AS (SELECT doc_id, pos + 1 AS page, line FROM ({LINES}))
SELECT p.doc_id, p.page, m.marker FROM p JOIN m ON p.page = 1 OR contains(lower(p.line), m.term)""")
def marker_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 1 takes all markers, other pages those whose term they hold. The markers are a fixed few, kept in the row."""
    terms = F.array(*[F.struct(F.lit(i).alias("marker"), F.lit(t).alias("term")) for i, t in MARKERS])
    p = lines(spark, sf_dir).select("doc_id", (F.col("pos") + 1).alias("page"), F.lower("line").alias("low"))
    return p.select("doc_id", "page", F.explode(F.filter(terms, lambda m: (F.col("page") == 1) | F.contains(F.col("low"), m["term"]))).alias("m")).select("doc_id", "page", "m.marker")


TERMS = """b AS (SELECT item_id, lower(text) AS text FROM benchmark),
w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM b),
t AS (SELECT 's' || item_id AS marker, trim(s) AS term FROM (SELECT item_id, unnest(string_split(text, '.')) AS s FROM b)
UNION SELECT 'p' || item_id, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)
UNION SELECT 'w' || item_id, w[len(w) // 2] FROM w)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, pairs of words and a middle word of benchmark items."""
    b = Tables(spark, sf_dir).benchmark.select(F.col("item_id").cast("string").alias("i"), F.lower("text").alias("text"))
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    term = lambda kind, x: b.select(F.concat(F.lit(kind), "i").alias("marker"), x.alias("term"))
    pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return term("s", F.explode(F.transform(F.split("text", r"\."), lambda x: F.trim(x)))).unionByName(term("p", F.explode(pairs))).unionByName(term("w", F.get(w, F.floor(F.size(w) / 2).cast("int") - 1))).distinct()


@query(f"""WITH {TERMS}, p AS (SELECT doc_id, pos, lower(line) AS line FROM ({LINES}))
SELECT DISTINCT doc_id, pos AS page, marker FROM p JOIN t ON term <> '' AND contains(line, term)""")
def marker_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some thousand terms from a table, looked for in every line of every document."""
    dealt = Tables(spark, sf_dir).documents.select("doc_id", "text").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")  # few row groups are many tasks' work
    pages = dealt.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", F.col("pos").cast("long").alias("page"), "line")
    return markers.found(pages, _terms(spark, sf_dir), ["doc_id", "page"], "line")


@query("""WITH n AS (SELECT doc_id, 1 - quality AS quality, toxic FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 10000000, 1, 0 FROM labels WHERE doc_id % 5 = 0)
SELECT doc_id, quality, toxic FROM labels l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = l.doc_id) UNION ALL SELECT doc_id, quality, toxic FROM n""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes over a table by key."""
    old = Tables(spark, sf_dir).labels.select("doc_id", "quality", "toxic")
    new = old.filter("doc_id % 2 = 0").withColumn("quality", 1 - F.col("quality")).unionByName(old.filter("doc_id % 5 = 0").select((F.col("doc_id") + 10_000_000).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    return R.upsert(old, new, ["doc_id"])


@query("""WITH g AS (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1993-06-01 00:00:00' OR o_custkey % 10 = 3)
SELECT 'orders' AS table_name, count(*) AS removed FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM g) UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM g)
UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IN (SELECT o_orderkey FROM g)""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cascading delete of tasks removes."""
    t = Tables(spark, sf_dir)
    gone = t.orders.filter((F.col("o_orderdate") < F.expr("timestamp_ntz'1993-06-01 00:00:00'")) | (F.col("o_custkey") % 10 == 3)).select("o_orderkey")
    return R.cascade({"orders": (t.orders, "o_orderkey"), "lineitem": (t.lineitem, "l_orderkey"), "events": (t.events, "user_id")}, gone, "o_orderkey")[1]


@query("""WITH old AS (SELECT o_orderkey FROM orders WHERE o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 1000 DAY AND o_orderstatus <> 'O')
SELECT l.l_orderkey, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.o_orderkey = l.l_orderkey) GROUP BY 1""")
def retention_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts left after finished tasks past retention go."""
    t = Tables(spark, sf_dir)
    limit = t.orders.agg((F.max("o_orderdate") - F.expr("interval 1000 days")).alias("c"))
    old = t.orders.filter((F.col("o_orderdate") <= limit.scalar()) & (F.col("o_orderstatus") != "O")).select(F.col("o_orderkey").alias("l_orderkey"))
    return R.deleted(t.lineitem, old, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


MOVES = [("F", "retry", "待处理"), ("P", "pause", "已暂停"), ("P", "cancel", "已取消"), ("O", "cancel", "已取消")]


@query(f"""WITH m(state, action, target) AS (VALUES {", ".join(map(str, MOVES))}), a AS (SELECT o_orderkey, o_orderstatus AS state, CASE o_orderkey % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'pause' ELSE 'cancel' END AS action FROM orders)
SELECT o_orderkey, a.action, coalesce(target, state) AS state, target IS NOT NULL AS allowed FROM a LEFT JOIN m USING (state, action)""")
def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, M4: actions on tasks by a table of allowed moves; others leave the state."""
    moves = spark.createDataFrame(MOVES, "state string, action string, target string")
    action = F.when(F.col("o_orderkey") % 3 == 0, "retry").when(F.col("o_orderkey") % 3 == 1, "pause").otherwise("cancel")
    asked = Tables(spark, sf_dir).orders.select("o_orderkey", F.col("o_orderstatus").alias("state"), action.alias("action"))
    return asked.join(moves, ["state", "action"], "left").select("o_orderkey", "action", F.coalesce("target", "state").alias("state"), F.col("target").isNotNull().alias("allowed"))


@query("""SELECT c_custkey, list_sort(list_distinct(CASE WHEN c_nationkey % 2 = 0 THEN ['read', 'export'] ELSE ['read'] END || CASE WHEN c_acctbal > 5000 THEN ['manage', 'read'] ELSE [] END)) AS permissions FROM customer""")
def role_permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: a role's permissions and explicit ones, distinct."""
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    role = F.when(F.col("c_nationkey") % 2 == 0, words("read", "export")).otherwise(words("read"))
    extra = F.when(F.col("c_acctbal") > 5000, words("manage", "read")).otherwise(F.array().cast("array<string>"))
    return Tables(spark, sf_dir).customer.select("c_custkey", F.array_sort(F.array_union(role, extra)).alias("permissions"))


@query("""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size, sha256(text) AS digest, length(text) = n_chars AND regexp_matches(sha256(text), '^[0-9a-f]{64}$') AS verified FROM documents""")
def verify_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I1, BI1, BI4: registered size against contents."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "text", "n_chars", F.sha2("text", 256).alias("digest"))
    return d.select("doc_id", F.octet_length("text").cast("long").alias("size"), "digest", ((F.length("text") == F.col("n_chars")) & F.col("digest").rlike("^[0-9a-f]{64}$")).alias("verified"))


@query("""WITH e AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="/([^"#]*)"', 1))) AS target FROM pages), parts AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^?#/]*)', 1) AS part FROM pages)
SELECT page_id, count(*) AS relations, count(*) FILTER (WHERE part IS NULL) AS broken FROM e LEFT JOIN parts ON part = target GROUP BY page_id""")
def package_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose target isn't a part."""
    p = Tables(spark, sf_dir).pages
    edges = p.select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="/([^"#]*)"'), F.lit(1)))).alias("target"))
    parts = p.select(F.regexp_extract("url", "^https?://[^/]+/([^?#/]*)", 1).alias("target")).distinct()
    return R.matched_flag(edges, parts, "target", "there").groupBy("page_id").agg(F.count(F.lit(1)).alias("relations"), F.count_if(~F.col("there")).alias("broken"))


@query("""SELECT user_id, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY user_id""")
def heartbeat_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the newest heartbeat of each client."""
    return Tables(spark, sf_dir).events.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"))
