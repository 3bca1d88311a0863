"""Ingest, settings, redaction, verification, planning and queues of the workbench as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions import binary, text
from docengine.functions.nulls import first_given, truthy
from docengine.functions.redaction import LABEL, redact_rows
from docengine.operators import layout
from docengine.plans.tables import Tables
from docengine.registry import query
from docengine.sources import archive

#: What an extension is taken for (fixed values).
TYPES = {"doc": "Word", "docx": "Word", "docm": "Word", "xls": "Excel", "xlsx": "Excel", "xlsm": "Excel", "ppt": "PPT", "pptx": "PPT", "pptm": "PPT", "pdf": "PDF", "png": "图片", "jpg": "图片", "jpeg": "图片", "gif": "图片", "bmp": "图片", "tif": "图片", "tiff": "图片", "svg": "图片", "zip": "压缩包"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def ingest(files: DataFrame) -> DataFrame:
    """Landed files (path, content) as the files table: type by extension, checked against the first bytes."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), extension(F.col("path"))), F.lit("未知"))
    magic = binary.kind_of("content")
    zips = F.col("extension").isin("docx", "docm", "xlsx", "xlsm", "pptx", "pptm", "zip")
    errors = F.filter(F.array(F.when(F.octet_length("content") == 0, "空文件"), F.when(F.col("file_type") == "未知", "不支持的类型"), F.when(zips & ~F.coalesce(magic == "zip", F.lit(False)), "内容与扩展名不符"), F.when((F.col("extension") == "pdf") & ~F.coalesce(binary.is_pdf("content"), F.lit(False)), "PDF 不完整"), F.when(F.col("extension").isin("doc", "xls", "ppt") & ~F.coalesce(binary.is_legacy_office("content"), F.lit(False)), "旧版文件头无效")), lambda e: e.isNotNull())
    named = files.select("path", "content", extension(F.col("path")).alias("extension"), kind.alias("file_type"), text.safe_file_name("path").alias("file_name"))
    digest = F.sha2("content", 256)
    return named.select(F.concat(F.lit("file_"), F.substring(F.sha2(F.concat_ws("|", "path", digest), 256), 1, 12)).alias("id"), "file_name", "file_type", "extension", F.octet_length("content").cast("long").alias("file_size"), digest.alias("sha256"), errors.alias("validation_errors"), F.col("path").alias("file_path"))


def object_summary(files: DataFrame) -> DataFrame:
    """(doc_id, paragraphs, tables, omml) of Word files, counted natively in the document part."""
    part = archive.entries(files, with_data=True).filter("part = 'word/document.xml'").select("doc_id", F.decode("data", "UTF-8").alias("xml"))
    return part.select("doc_id", text.tag_count("xml", "p").alias("paragraphs"), text.tag_count("xml", "tbl").alias("tables"), text.tag_count("xml", "oMath").alias("omml"))


def renamed(files: DataFrame) -> DataFrame:
    """P2, STR7: doubled names get -1, -2 ... by order of arrival."""
    ext = F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    stem = F.substring(F.col("file_name"), F.lit(1), F.length("file_name") - F.length(ext))
    numbered = layout.ranked(files, ["file_name"], ["id"], "__rank")
    return numbered.withColumn("file_name", text.unique_name(stem, ext, F.col("__rank"))).drop("__rank")


def stored_names(files: DataFrame, how: str = "rename") -> DataFrame:
    """Files of one name: numbered (rename), the first stays (skip) or the last does (overwrite), by id."""
    if how == "rename":
        return renamed(files)
    row, at = F.struct(*files.columns), F.col("id")
    return files.groupBy("file_name").agg((F.min_by(row, at) if how == "skip" else F.max_by(row, at)).alias("x")).select("x.*")


def replaced(files: DataFrame, new: DataFrame, children: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with new contents under their ids, children without those of replaced files: they're built again from the new ones)."""
    n = new.select(F.col("id").alias("__id"), F.col("content").alias("__new"))
    now = files.join(n, F.col("id") == F.col("__id"), "left").select(*[c for c in files.columns if c != "content"], F.coalesce("__new", "content").alias("content"), F.col("__id").isNotNull().alias("replaced"))
    return now, children.join(n.select(F.col("__id").alias("parent_id")), "parent_id", "left_anti")


#: Kinds of tasks (fixed values).
TASK_TYPES = ("formula_recognition", "image_extract", "macro_run", "omml_preflight", "batch_process", "word_to_ppt", "ppt_to_word", "pdf_to_word", "excel_to_pdf", "excel_to_word", "excel_to_ppt")


def created(asked: DataFrame, files: DataFrame) -> DataFrame:
    """P5: (id, task_type, files, error, status) of asked-for tasks. asked: id, task_type, sources (file_id, sha256 when listed);
    files: file_id, sha256 now. A source that changed or is gone, or an unknown type, fails the task before it runs."""
    s = asked.select("id", F.explode("sources").alias("s")).select("id", "s.file_id", F.col("s.sha256").alias("listed"))
    now = files.select(F.col("file_id").alias("f"), F.col("sha256").alias("now"))
    changed = s.join(now, F.col("file_id") == F.col("f"), "left").groupBy("id").agg(F.bool_or(~F.col("listed").eqNullSafe(F.col("now"))).alias("changed"))
    both = asked.join(changed, "id", "left")
    error = F.when(truthy("changed"), "来源已变").when(~F.col("task_type").isin(*TASK_TYPES), "类型未知").otherwise("")
    return both.select("id", "task_type", F.when(error == "", F.size("sources")).otherwise(0).alias("files"), error.alias("error"), F.when(error == "", "待处理").otherwise("失败").alias("status"))


def imported(sources: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """Macro sources (name, source_text, id) with their digest; again: the same contents came in before, so nothing is added."""
    s = sources.withColumn("digest", F.sha2("source_text", 256))
    first = s.groupBy("digest").agg(F.min("id").alias("__first"))
    error = F.when(F.octet_length("source_text") > most_bytes, "宏源码过大").otherwise("")
    return s.join(first, "digest").withColumns({"again": F.col("id") > F.col("__first"), "error": error}).drop("__first")


def queued(results: DataFrame, kinds: list[str]) -> DataFrame:
    """What waits in tasks' results, a row each (task_id, event_type, event_id): (task_id, kind, n, first_id). Counted before the shuffle."""
    return results.filter(F.col("event_type").isin(*kinds)).groupBy("task_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def restorable(registered: DataFrame, held: DataFrame) -> DataFrame:
    """P20: (id, verdict) of backups: registered digests against the bytes that are held."""
    h = held.select(F.col("id").alias("__id"), F.sha2("content", 256).alias("__now"))
    verdict = F.when(F.col("__now").isNull(), "备份缺失").when(F.col("__now") != F.col("sha256"), "校验失败").otherwise("可恢复")
    return registered.join(h, F.col("id") == F.col("__id"), "left").select("id", verdict.alias("verdict"))


def allowed(payload: Column, schema: str, most: int = 200, known: dict[str, list[str]] | None = None) -> Column:
    """of a JSON payload the fields of an allow-list (DDL): texts cut to `most`, lists to known names where those are given."""
    p = F.from_json(payload, schema)

    def field(f: T.StructField) -> Column:
        c = p[f.name]
        if isinstance(f.dataType, T.StringType):
            return F.left(c, F.lit(most))
        if f.name in (known or {}):
            return F.filter(c, lambda x: x.isin(*known[f.name]))
        return c

    return F.when(p.isNotNull(), F.struct(*[field(f).alias(f.name) for f in T.StructType.fromDDL(schema)]))


def settings(saved: DataFrame, defaults: dict[str, str], forced: dict[str, str] | None = None) -> DataFrame:
    """F16, M9: (key, value) of the known settings: saved ones over defaults, forced ones over both; unknown keys are ignored."""
    forced = forced or {}
    known = [F.struct(F.lit(k).alias("key"), F.lit(v).alias("fallback"), F.lit(forced.get(k)).cast("string").alias("forced")) for k, v in (defaults | forced).items()]
    table = saved.sparkSession.range(1).select(F.explode(F.array(*known)).alias("d")).select("d.*")
    own = saved.select(F.col("key").alias("__k"), F.col("value").alias("__v")).filter(F.col("__k").isin(list(defaults)))
    return table.join(own, F.col("key") == F.col("__k"), "left").select("key", F.coalesce("forced", "__v", "fallback").alias("value"))


def setting(option: Column, saved: Column, default: str) -> Column:
    """M9, F2: task option, then settings, then default."""
    return first_given(option, saved, F.lit(default))


def preserved(blocks: DataFrame, tables: bool = True, images: bool = True) -> DataFrame:
    """switches that drop kinds of blocks."""
    gone = [k for k, keep in (("table", tables), ("image", images)) if not keep]
    return blocks.filter(~F.col("kind").isin(gone)) if gone else blocks


def verified(registered: DataFrame, found: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reason): inside the root, of the registered size and digest, not older than the attempt, and,
    where a format is registered (kind), begun as such files begin."""
    kind = F.col("kind") if "kind" in registered.columns else F.lit(None).cast("string")
    r = registered.select("path", F.col("size").alias("want_size"), F.col("sha256").alias("want"), "started_at", kind.alias("want_kind"))
    got = found.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified_at"), binary.kind_of("content").alias("kind"))
    both = r.join(got, "path", "left")
    reason = F.when(~archive.contained(F.col("path"), root), "outside").when(F.col("sha256").isNull(), "missing").when(~binary.is_digest("want"), "bad digest").when((F.col("size") != F.col("want_size")) | (F.col("sha256") != F.col("want")), "changed").when(truthy(F.col("modified_at") < F.col("started_at")), "stale").when(F.col("want_kind").isNotNull() & ~F.col("want_kind").eqNullSafe(F.col("kind")), "bad format")
    judged = both.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def small_images(images: DataFrame, side: int = 96, area: int = 9216, header_footer: bool = True, watermark: bool = True, transparent: bool = True, duplicates: bool = True) -> DataFrame:
    """Images within the side and area limits; switches leave kinds out."""
    keep = (F.col("width") <= side) & (F.col("height") <= side) & (F.col("width") * F.col("height") <= area)
    for name, on in (("is_header_footer", header_footer), ("is_watermark", watermark), ("is_transparent", transparent), ("is_duplicate", duplicates)):
        if not on:
            keep &= ~truthy(name)
    return images.filter(keep).withColumn("area", F.col("width") * F.col("height"))


def marked_duplicates(images: DataFrame) -> DataFrame:
    """By content digest; counted before the join, so one digest on every page is no hot task."""
    n = images.groupBy("image_hash").agg(F.count(F.lit(1)).alias("__n"))
    return images.join(n, "image_hash", "left").withColumn("is_duplicate", F.coalesce(F.col("__n") > 1, F.lit(False))).drop("__n")


#: Inline and display mathematics (fixed patterns).
TEX = (r"\\begin\{(?:equation|align|gather|multline)\*?\}[\s\S]*?\\end\{(?:equation|align|gather|multline)\*?\}", r"\$\$[\s\S]+?\$\$", r"\\\[[\s\S]+?\\\]", r"(?<![\\$])\$[^$\n]+\$", r"\\\([^\n]+?\\\)")


def tex_formulas(sources: DataFrame) -> DataFrame:
    """(doc_id, pos, latex) of TeX sources."""
    found = F.regexp_extract_all("text", F.lit("|".join(f"(?:{p})" for p in TEX)), F.lit(0))
    return sources.select("doc_id", F.posexplode(found).alias("pos", "latex"))


def image_locations(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(doc_id, media, locations). edges: package relations, repeats too; order: (doc_id, part, label) of what is shown."""
    inner = edges.filter(F.col("error").isNull() & ~F.col("external"))
    direct = inner.filter("type = 'image'").select("doc_id", F.col("src_part").alias("part"), F.col("target").alias("media"))
    drawn = inner.filter("type = 'drawing'").select("doc_id", F.col("src_part").alias("sheet"), F.col("target").alias("part")).distinct()
    over = direct.join(drawn, ["doc_id", "part"]).select("doc_id", F.col("sheet").alias("part"), "media")
    placed = direct.unionByName(over).join(order, ["doc_id", "part"]).select("doc_id", "media", F.concat_ws(" · ", "label", "part").alias("location"))
    return placed.groupBy("doc_id", "media").agg(F.array_sort(F.collect_set("location")).alias("locations"))


def part_labels(edges: DataFrame) -> DataFrame:
    """(doc_id, part, label): body, headers, footers, slides and sheets by the relations that reach them."""
    inner = edges.filter(F.col("error").isNull() & ~F.col("external"))
    label = F.when(F.col("type") == "header", "页眉").when(F.col("type") == "footer", "页脚").when(F.col("type") == "slide", "幻灯片").when(F.col("type") == "worksheet", "工作表")
    shown = inner.withColumn("label", label).filter(F.col("label").isNotNull()).select("doc_id", F.col("target").alias("part"), "label").distinct()
    body = inner.filter("type = 'officeDocument'").select("doc_id", F.col("target").alias("part"), F.lit("正文").alias("label"))
    return shown.unionByName(body)


LOCAL_ONLY = ("macro_run", "office_convert")


def planned_actions(tasks: DataFrame, capabilities: list[str]) -> DataFrame:
    """C11: what a local run would do with each task: run, wait for a capability, or nothing."""
    need = F.when(F.col("task_type").isin(*LOCAL_ONLY), "office").otherwise("none")
    ok = (need == "none") | need.isin(*capabilities)
    return tasks.select("id", "task_type", F.when(F.col("status") != "待处理", "skip").when(ok, "run").otherwise("wait").alias("action"), F.when(~ok, F.concat(F.lit("缺少能力："), need)).otherwise("").alias("reason"))


def reconciled(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Local results into task counts: duplicates once, unknown tasks rejected by the join, the rest pending."""
    latest = results.groupBy("task_id", "file_id").agg(F.max_by("status", "seq").alias("status"))
    per = latest.groupBy("task_id").agg(F.count_if(F.col("status") == "成功").alias("success_count"), F.count_if(F.col("status") == "失败").alias("fail_count"), F.count(F.lit(1)).alias("n"))
    out = tasks.join(per, F.col("id") == F.col("task_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    pending = F.greatest(F.size("file_ids") - zero("success_count") - zero("fail_count"), F.lit(0))
    status = F.when(pending > 0, F.col("status")).when(zero("fail_count") > 0, "失败").otherwise("成功")
    return out.select("id", zero("success_count").alias("success_count"), zero("fail_count").alias("fail_count"), pending.alias("pending_count"), status.alias("status"))


def recovery(tasks: DataFrame) -> DataFrame:
    """Running tasks become interrupted at start-up; counts of what can go on."""
    now = tasks.withColumn("status", F.when(F.col("status") == "处理中", "已中断").otherwise(F.col("status")))
    return now.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("已中断", "interrupted"), ("已暂停", "paused"), ("失败", "failed"))], F.count_if(F.col("status").isin("失败", "已取消", "已中断")).alias("retryable"))


def permissions(users: DataFrame, roles: dict[str, list[str]]) -> DataFrame:
    """M8: a user's explicit permissions in their order, else the role's."""
    table = F.create_map(*[x for k, v in roles.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    none = F.array().cast("array<string>")
    explicit = F.coalesce("permissions", none)
    return users.select("id", F.array_distinct(F.when(F.size(explicit) > 0, explicit).otherwise(F.coalesce(F.try_element_at(table, "role"), none))).alias("permissions"))


def deletable(asked: DataFrame, users: DataFrame, roles: dict[str, list[str]], permission: str = "delete") -> DataFrame:
    """(id, user_id, allowed): which deletes their users may make, by their own permissions or their role's."""
    can = permissions(users, roles).select(F.col("id").alias("__u"), F.array_contains("permissions", permission).alias("__can"))
    return asked.join(can, F.col("user_id") == F.col("__u"), "left").select("id", "user_id", truthy("__can").alias("allowed"))


@query(f"""SELECT page_id, '{LABEL}/' || regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) AS path, '' AS token, TRUE AS path_available FROM pages""")
def redact_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows with paths and secrets, as they may be shown."""
    p = Tables(spark, sf_dir).pages.select("page_id", F.col("url").alias("path"), F.col("url").alias("token"))
    return redact_rows(p)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '全部' WHEN lang <> '' THEN lang ELSE '当前' END AS mode FROM documents""")
def range_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2, M9: option, then setting, then default."""
    option = F.when(F.col("doc_id") % 4 == 0, "全部").otherwise("")
    return Tables(spark, sf_dir).documents.select("doc_id", setting(option, F.col("lang"), "当前").alias("mode"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn <= 3""")
def first_n_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first n cells of each sheet."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    items = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return items.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""WITH s AS (SELECT event_type, max(event_id) AS e FROM events GROUP BY 1) SELECT event_type AS id, CAST(row_number() OVER (ORDER BY e) AS BIGINT) AS execute_order FROM s""")
def macro_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each macro once, at its latest place, numbered in order."""
    once = Tables(spark, sf_dir).events.groupBy(F.col("event_type").alias("id")).agg(F.max("event_id").alias("e"))
    return once.select("id", F.row_number().over(Window.orderBy("e")).cast("long").alias("execute_order"))


@query("""SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS retryable FROM orders GROUP BY 1""")
def recovery_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, P8."""
    return Tables(spark, sf_dir).orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("retryable"))


@query("""SELECT doc_id, '<math xmlns="http://www.w3.org/1998/Math/MathML"><mtext>' || replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</mtext></math>' AS mathml FROM documents""")
def mathml_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas without MathML as text."""
    from docengine.sources.writers import mathml

    return Tables(spark, sf_dir).documents.select("doc_id", mathml(F.lit(None).cast("string"), F.col("text")).alias("mathml"))


@query("""SELECT source, '"' || source || '","' || count(*) || '","' || CAST(sum(n_chars) AS BIGINT) || '"' AS line FROM documents GROUP BY source""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted lines."""
    from docengine.sources.writers import csv_line

    d = Tables(spark, sf_dir).documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size"))
    return d.select("source", csv_line(F.col("source"), F.col("n"), F.col("size")).alias("line"))


