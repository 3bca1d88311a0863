"""A report's counters, failures and checks from its child tables: C8, A1-A8, over any number of reports at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions.nulls import not_in_or_null, truthy
from docengine.operators import relational as R

SUCCESS, SKIPPED, FAILED = "成功", "跳过", "失败"
#: Artifact states that are still open, and those that were called off (fixed values).
PENDING = ("待本地客户端执行",)
CANCELLED = ("local_execution_cancelled",)
BATCH_TASK = "batch_process"


def artifact_failed(status: str = "status") -> Column:
    """Whatever isn't success, skip, open or called off; a missing status too."""
    return not_in_or_null(status, SUCCESS, SKIPPED, *PENDING, *CANCELLED)


def file_states(files: DataFrame, artifacts: DataFrame, image_errors: DataFrame) -> DataFrame:
    """(report_id, file_id, state): failed before pending before cancelled, by the union of all sources of each."""
    key = ["report_id", "file_id"]
    none = F.lit(False)
    parts = [
        files.select(*key, (F.size(F.coalesce("validation_errors", F.array().cast("array<string>"))) > 0).alias("f"), none.alias("p"), none.alias("c"), F.lit(True).alias("listed")),
        artifacts.select(*key, artifact_failed().alias("f"), F.coalesce(F.col("status").isin(*PENDING), none).alias("p"), F.coalesce(F.col("status").isin(*CANCELLED), none).alias("c"), none.alias("listed")),
        image_errors.select(*key, F.lit(True).alias("f"), none.alias("p"), none.alias("c"), none.alias("listed")),
    ]
    flags = R.union_all(parts).filter(F.coalesce("file_id", F.lit("")) != "").groupBy(*key).agg(*[F.bool_or(x).alias(x) for x in ("f", "p", "c", "listed")])
    state = F.when(F.col("f"), "failed").when(F.col("p"), "pending").when(F.col("c"), "cancelled").otherwise("success")
    return flags.select(*key, state.alias("state"), "listed")


def counters(reports: DataFrame, files: DataFrame, artifacts: DataFrame, image_errors: DataFrame, batch: DataFrame, formulas: DataFrame, macros: DataFrame, images: DataFrame, omml: DataFrame, threshold: int = 80) -> DataFrame:
    """One row a report. Every child table is aggregated once, by report, before the joins."""
    n = lambda cond, name: F.count_if(truthy(cond)).alias(name)
    by = lambda df, *aggs: df.groupBy("report_id").agg(*aggs)
    states = by(file_states(files, artifacts, image_errors), *[n(F.col("state") == s, f"{s}_files") for s in ("failed", "pending", "cancelled")], F.array_sort(F.collect_set(F.when(F.col("state") == "failed", F.col("file_id")))).alias("failed_file_ids"))
    listed = by(files, F.count(F.lit(1)).alias("file_count"), n("missing_omml_dependency", "file_omml_missing_count"))
    runs = by(batch, F.count(F.lit(1)).alias("batch_total_count"), n(F.col("status") == SUCCESS, "batch_success_count"), n(F.col("status") == FAILED, "batch_fail_count"), n((F.col("status") == SKIPPED) | truthy("skipped"), "batch_skipped_count"))
    sure = F.coalesce("confidence", F.lit(0)) >= threshold
    f = by(formulas, F.count(F.lit(1)).alias("formula_count"), n(F.col("source_type") == "OMML", "omml_count"), n((F.col("source_type") == "OMML") & sure, "omml_converted_count"), n(F.col("format_status") == "已格式化", "formatted_formula_count"), n((F.col("status") == "待确认") | ~sure, "low_confidence_count"))
    m = by(macros, F.count(F.lit(1)).alias("macro_count"), n(F.col("execute_status") == SUCCESS, "macro_success_count"), n(F.col("execute_status") == FAILED, "macro_fail_count"), n(F.col("execute_status").isin("待本地客户端执行", "待确认"), "macro_queued_count"))
    a = by(artifacts, n(F.col("status") == SUCCESS, "artifact_count"), n(artifact_failed(), "artifact_failure_count"), n(F.col("status").isin(*PENDING), "artifact_pending_count"), n(F.col("status").isin(*CANCELLED), "artifact_cancelled_count"))
    i = by(images, F.count(F.lit(1)).alias("small_image_count"), n("is_duplicate", "duplicate_image_count"))
    o = by(omml, F.count(F.lit(1)).alias("omml_dependency_count"), n(F.col("copy_status") == SUCCESS, "omml_dependency_copied_count"))
    out = reports.select(F.col("id").alias("report_id"), "task_id", "task_type", "created_at")
    for part in (states, listed, runs, f, m, a, i, o):
        out = out.join(part, "report_id", "left")
    out = out.fillna(0).withColumn("failed_file_ids", F.coalesce("failed_file_ids", F.array().cast("array<string>")))
    batched = (F.col("task_type") == BATCH_TASK) & (F.col("batch_total_count") > 0)
    done = F.greatest(F.col("file_count") - F.col("failed_files") - F.col("pending_files") - F.col("cancelled_files"), F.lit(0))
    return out.withColumn("success_count", F.when(batched, F.col("batch_success_count")).otherwise(done)).withColumn("fail_count", F.when(batched, F.col("batch_fail_count")).otherwise(F.col("failed_files"))).withColumnsRenamed({"pending_files": "pending_count", "cancelled_files": "cancelled_count"}).drop("failed_files")


def failures(files: DataFrame, artifacts: DataFrame, image_errors: DataFrame, macros: DataFrame, omml: DataFrame) -> DataFrame:
    """The failure list: (report_id, category, file_id, file_name, status, message)."""
    names = files.select("report_id", "file_id", "file_name")

    def part(df: DataFrame, category: str, status: Column, message: Column) -> DataFrame:
        rows = df.select("report_id", F.lit(category).alias("category"), "file_id", status.alias("status"), message.alias("message"))
        return rows.join(names, ["report_id", "file_id"], "left").select("report_id", "category", "file_id", F.coalesce("file_name", "file_id").alias("file_name"), "status", "message")

    return R.union_all([
        part(files.filter(F.size("validation_errors") > 0), "文件校验", F.lit(FAILED), F.array_join("validation_errors", "；")),
        part(artifacts.filter(artifact_failed()), "输出文件", F.coalesce("status", F.lit("")), F.coalesce("name", F.lit(""))),
        part(image_errors, "图片提取", F.lit(FAILED), F.col("message")),
        part(macros.filter(F.col("execute_status") == FAILED), "宏执行", F.col("execute_status"), F.col("macro_name")),
        part(omml.filter(not_in_or_null("copy_status", SUCCESS)), "公式依赖", F.coalesce("copy_status", F.lit("")), F.col("omml_file_name")),
        part(files.filter(truthy("missing_omml_dependency")).join(omml.select("report_id", "file_id"), ["report_id", "file_id"], "left_anti"), "公式依赖", F.lit("缺失"), F.col("file_name")),
    ])


def report_json(totals: DataFrame, failed: DataFrame, formulas: DataFrame) -> DataFrame:
    """The nested form rebuilt: (report_id, json)."""
    f = failed.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("category", "file_id", "file_name", "status", "message"))).alias("failureRows"))
    g = formulas.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("page_index", "id", "latex", "confidence", "status"))).alias("formulas"))
    both = totals.join(f, "report_id", "left").join(g, "report_id", "left")
    return both.select("report_id", F.to_json(F.struct(*[c for c in both.columns])).alias("json"))
