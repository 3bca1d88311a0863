"""Quality of reports: the fifteen checks after preflight, the thirteen summary rows and the failure list of ten sources, for any
number of reports at once.

Every child table is aggregated once, by report, into one wide row of facts; checks and summary rows are expressions over that
row, unpivoted. Texts are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions.nulls import given, not_in_or_null, truthy
from docengine.operators import relational as R
from docengine.plans.report_build import CANCELLED, FAILED, PENDING, SKIPPED, SUCCESS
from docengine.plans.tables import Tables
from docengine.registry import query
from docengine.sources.writers import sectioned_html

PASS, ASK, FAIL = "通过", "需确认", "失败"
SEVERITY = {PASS: "info", ASK: "warning", FAIL: "error"}
CONVERSIONS = ("word_to_ppt", "ppt_to_word", "pdf_to_word", "excel_to_pdf", "excel_to_word", "excel_to_ppt")
OCR_WAITING = ("authorization_required", "missing_credentials", "api_error", "missing_local_file", "ocr_disabled")
OCR_FAILED = (*OCR_WAITING, "timeout", "error")

#: id -> (label, {status: (message, recommendation)}) of the checks; {} stands for what a check says itself (fixed values).
CHECKS = {
    "workflow_order": ("流程顺序", {PASS: ("{}", "按当前拖拽顺序继续"), ASK: ("{}", "检查处理配置中的流程顺序，移除未知或重复任务")}),
    "file_validation": ("文件校验", {PASS: ("所有输入文件通过基础校验", "可进入后续处理"), FAIL: ("存在文件损坏、加密、过大或格式异常", "处理校验失败文件后重试任务")}),
    "structure_counts": ("结构数量", {PASS: ("已记录基础结构数量", "继续转换或导出报告"), ASK: ("未读取到页数、幻灯片或工作表数量", "打开预览检查文件是否损坏或需要真实 Office 引擎")}),
    "content_preservation": ("内容保留", {PASS: ("源文档对象数量已记录，当前设置未发现明显保留风险", "继续转换并在结果预览中复核关键对象"), ASK: ("存在可能不保留的对象设置：{}", "调整保留设置后重试，或查看转换前后对比")}),
    "preview_consistency": ("转换前后预览一致性", {PASS: ("{}", "保留当前转换结果"), ASK: ("{}", "打开转换前后对比预览，复核页数、表格、图片和公式对象")}),
    "formula_confidence": ("公式置信度", {PASS: ("公式置信度通过当前阈值", "保留当前公式结果"), ASK: ("存在待人工确认的公式", "在公式页确认、重识别或修正 LaTeX")}),
    "formula_positions": ("公式位置", {PASS: ("公式位置已记录", "继续处理"), FAIL: ("存在公式位置丢失，已记录异常位置", "在排版校正中补充位置，或重新识别公式后重建报告")}),
    "omml_dependencies": ("OMML 依赖", {PASS: ("OMML 依赖检查通过", "可继续 OMML 转 MathType 流程"), FAIL: ("OMML 依赖缺失、未找到或复制失败", "配置 OMML 检索路径或手动选择依赖文件")}),
    "omml_conversion_prompt": ("OMML 转换确认", {PASS: ("OMML 转 MathType 决策已记录或当前任务不涉及 OMML", "按当前决策继续"), ASK: ("检测到 Word 自带公式，需要用户确认是否转换为 MathType", "在 Word 转 PPT 参数中选择先转 MathType，或在任务选项中确认保留原公式")}),
    "macro_results": ("宏执行结果", {PASS: ("宏执行状态正常", "保留当前宏结果"), ASK: ("宏队列等待本地客户端执行、风险确认或安全策略确认", "检查宏风险确认、白名单或禁用设置"), FAIL: ("存在失败宏", "检查宏权限、失败策略和备份后重试")}),
    "small_images": ("微小图片", {PASS: ("未发现需处理的微小图片", "无需处理"), ASK: ("发现微小图片，需要确认是否误判或导出", "在微小图片页查看、确认类型、导出或标记误判"), FAIL: ("存在图片条目读取或格式识别失败", "下载失败清单，修复源文档或重新上传后重试图片检索")}),
    "conversion_output": ("转换输出", {PASS: ("转换输出已生成", "可下载转换结果"), ASK: ("{}", "{}"), FAIL: ("部分转换输出未生成", "查看任务日志并重试失败文件")}),
    "mathpix_pdf": ("Mathpix PDF", {PASS: ("Mathpix 作业状态正常或当前任务不涉及 PDF OCR", "无需额外处理"), ASK: ("PDF 转 Word 等待 Mathpix 授权、凭证或接口结果", "在设置中授权外部上传并配置 Mathpix 凭证")}),
    "pdf_type": ("PDF 类型识别", {PASS: ("PDF 类型识别未发现额外 OCR 风险", "可按当前设置转换"), ASK: ("PDF 包含扫描页、图片层、公式或表格线索", "使用 Mathpix 并按需开启文字、公式和表格 OCR")}),
    "batch_results": ("批量单文件结果", {PASS: ("{}", "{}"), FAIL: ("批量任务存在失败文件", "查看失败清单，处理文件校验问题后重试")}),
}
#: What conversion_output says when it asks, and batch_results when it passes (fixed values).
OUTPUT_ASKS = (("artifacts_pending", "旧版 Office 输入等待本地客户端生成输出", "启动本地 Office 客户端执行并回传结果"), ("artifacts_cancelled", "本地 Office 转换已取消", "如需继续转换，请重试任务"), ("artifacts_skipped", "存在按同名策略跳过的输出", "如需生成被跳过文件，请调整输出同名策略后重试"))
BATCH_PASSES = (("失败文件已按用户选择跳过", "如需重新处理跳过文件，可重新上传或重建批量任务"), ("批量任务单文件状态正常或当前任务不是批量任务", "无需额外处理"))

#: id -> (label, detail, recommendation) of the summary rows; {} is what a row says itself (fixed values).
SUMMARY = {
    "file_total": ("处理文件总数", "{}", "{}"),
    "omml_formulas": ("OMML 公式数量", "来自 Word 原生公式检测和 OMML 转换确认记录", "确认是否转为 MathType 或保留原公式"),
    "omml_conversion": ("OMML 转 MathType", "当前记录转换决策和依赖状态，真实转换交给本地客户端", "修复依赖并完成用户确认"),
    "mathtype_formulas": ("MathType 公式数量", "来自公式报告和文件对象检测", "跨平台交付时保留 MathML/LaTeX 或图片兜底"),
    "formatted_formulas": ("已格式化公式数量", "按当前公式格式化设置记录", "低置信度或失败项进入人工校正"),
    "macro_execution": ("宏执行数量", "网页端只记录宏队列和本地客户端执行状态", "检查宏授权、白名单和失败策略"),
    "low_confidence": ("低置信度公式数量", "按公式状态和 80% 默认阈值统计", "在公式页确认、修正或重识别"),
    "formula_positions": ("公式位置异常", "{}", "{}"),
    "image_extraction": ("图片提取数量", "{}", "{}"),
    "small_images": ("微小图片数量", "按尺寸、面积、透明、水印和重复设置筛选", "按图片清单导出或标记"),
    "table_extraction": ("表格提取数量", "来自 Word/PPT/Excel/PDF 表格结构或线索统计", "转换后在预览对比中复核表格结构"),
    "possible_loss": ("可能丢失对象", "{}", "调整保留设置、修复依赖或使用本地 Office 引擎复核"),
    "error_details": ("错误详情", "失败清单汇总文件校验、OMML、宏、转换输出和 Mathpix 问题", "下载失败清单 CSV 并逐项处理"),
}

Frames = dict[str, DataFrame]


def failures(t: Frames) -> DataFrame:
    """(report_id, category, file_id, file_name, status, message, source_id) of all ten sources.

    t: files (report_id, file_id, file_name, validation_errors, missing_omml), batch (.., status, skipped, message, sequence), image_errors,
    formulas, omml, macros, artifacts, ocr and preflight.
    """
    key = ["report_id", "file_id"]
    names = t["files"].select(*key, F.col("file_name").alias("__name"))
    skipped = t["batch"].filter((F.col("status") == SKIPPED) | truthy("skipped")).select(*key).distinct()
    lost = (F.col("found_status") == "未找到") | (F.col("copy_status") == FAILED)
    none = F.lit("")

    def rows(df: DataFrame, category: str, status: Column, message: Column, source: Column = none, named: bool = True) -> DataFrame:
        out = df.select("report_id", F.lit(category).alias("category"), "file_id", status.alias("status"), message.alias("message"), source.cast("string").alias("source_id"))
        if named:
            out = out.join(names, key, "left").withColumn("file_name", F.coalesce("__name", F.col("file_id").cast("string"))).drop("__name")
        else:
            out = out.withColumn("file_name", none)
        return out.select("report_id", "category", F.coalesce(F.col("file_id").cast("string"), none).alias("file_id"), "file_name", "status", "message", F.coalesce("source_id", none).alias("source_id"))

    or_else = lambda c, text: F.coalesce(given(c), F.lit(text))
    omml = t["omml"].filter(truthy(lost))
    return R.union_all([
        rows(t["files"].join(skipped, key, "left_anti").select(*key, F.explode("validation_errors").alias("e")), "文件校验", F.lit(FAILED), F.col("e")),
        rows(t["image_errors"], "图片提取", or_else("status", FAILED), or_else("message", "图片提取失败"), F.col("id")),
        rows(t["formulas"].filter("position_status = '异常位置'"), "公式位置", F.col("position_status"), or_else("position_issue", "公式位置丢失"), F.col("id")),
        rows(t["batch"].filter(F.col("status") == FAILED), "批量处理", F.col("status"), or_else("message", "批量处理失败"), F.col("sequence")),
        rows(omml, "OMML 依赖", F.coalesce(given("copy_status"), "found_status"), or_else("message", "检索或复制未完成"), F.col("id")),
        rows(t["files"].filter(truthy("missing_omml")).join(omml.select(*key).distinct(), key, "left_anti"), "OMML 依赖", F.lit("缺少"), F.lit("文件含 OMML 公式，但当前目录未检测到 OMML 依赖文件")),
        rows(t["macros"].filter(F.col("execute_status") == FAILED), "宏执行", F.col("execute_status"), or_else("message", "宏执行失败"), F.col("id")),
        rows(t["artifacts"].filter(not_in_or_null("status", SUCCESS, SKIPPED, *PENDING, *CANCELLED)), "转换输出", F.coalesce("status", none), or_else("message", "转换输出未生成")),
        rows(t["ocr"].filter(F.col("status").isin(*OCR_FAILED)), "Mathpix PDF", F.col("status"), or_else("message", "Mathpix PDF 处理未完成"), F.col("id")),
        rows(t["preflight"].filter(F.col("status") == FAILED).withColumn("file_id", F.lit(None).cast("string")), "系统预检", F.col("status"), or_else("message", "系统预检失败"), F.col("id"), named=False),
    ])


def facts(t: Frames, threshold: int = 80) -> DataFrame:
    """One row a report with all that its checks count. t as for failures(), and reports (id, task_type, retain_images, retain_tables,
    retain_formulas, labels, invalid_items, duplicate_items, current_index), images, prompts and previews."""
    n = lambda cond, name: F.count_if(truthy(cond)).alias(name)
    key = ["report_id", "file_id"]
    by = lambda df, *aggs: df.groupBy("report_id").agg(*aggs)
    skipped = t["batch"].filter((F.col("status") == SKIPPED) | truthy("skipped")).select(*key).distinct().withColumn("was_skipped", F.lit(True))
    files = t["files"].join(skipped, key, "left")
    pdf_ = F.col("file_type") == "PDF"
    total = lambda c: F.coalesce(F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))), F.lit(0)).cast("long").alias(c)
    f = by(files, F.count(F.lit(1)).alias("files"), n((F.size("validation_errors") > 0) & ~truthy("was_skipped"), "invalid"), total("pages"), total("images_held"), total("tables_held"), total("formulas_held"), total("structures_held"), total("omml_held"), n((F.col("file_type") == "Word") & truthy("has_omml"), "omml_files"), n("has_mathtype", "mathtype_files"), n(pdf_ & F.col("pdf_kind").isin("扫描型 PDF", "混合型 PDF"), "pdf_ocr"), n(pdf_ & (truthy("has_formula") | (F.col("formula_hints") > 0)), "pdf_formula"), n(pdf_ & (F.col("table_hints") > 0), "pdf_table"))
    unsure = (F.col("status") == "待确认") | (F.coalesce("confidence", F.lit(0)) < threshold)
    g = by(t["formulas"], F.count(F.lit(1)).alias("formulas"), n(unsure, "unsure"), n(F.col("position_status") == "异常位置", "misplaced"), n(F.col("source_type") == "MathType", "mathtype"), n(F.col("format_status") == "已格式化", "formatted"))
    lost = truthy((F.col("found_status") == "未找到") | (F.col("copy_status") == FAILED))
    o = by(t["omml"], F.count(F.lit(1)).alias("omml"), n(lost, "omml_lost"))
    issues = t["omml"].filter(lost).select(*key).unionByName(t["files"].filter(truthy("missing_omml")).select(*key)).distinct()
    i = by(issues, F.count(F.lit(1)).alias("omml_issue_files"))
    p = by(t["prompts"], F.count(F.lit(1)).alias("prompts"), n(F.col("status") == ASK, "prompts_waiting"), n(F.col("status") == "已选择转换", "prompts_chosen"))
    m = by(t["macros"], F.count(F.lit(1)).alias("macros"), n(F.col("execute_status") == SUCCESS, "macros_done"), n(F.col("execute_status") == FAILED, "macros_failed"), n(F.col("execute_status").isin("待本地客户端执行", "待确认"), "macros_queued"), n(F.col("execute_status").isin("已禁用", "未授权"), "macros_blocked"))
    s = by(t["images"], F.count(F.lit(1)).alias("images"))
    e = by(t["image_errors"], F.count(F.lit(1)).alias("image_errors"))
    a = by(t["artifacts"], n(F.col("status") == SUCCESS, "artifacts_done"), n(F.col("status") == SKIPPED, "artifacts_skipped"), n(F.col("status").isin(*PENDING), "artifacts_pending"), n(F.col("status").isin(*CANCELLED), "artifacts_cancelled"), n(not_in_or_null("status", SUCCESS, SKIPPED, *PENDING, *CANCELLED), "artifacts_failed"))
    q = by(t["ocr"], F.count(F.lit(1)).alias("ocr"), n(F.col("status").isin(*OCR_WAITING), "ocr_waiting"))
    b = by(t["batch"], F.count(F.lit(1)).alias("batch"), n(F.col("status") == FAILED, "batch_failed"), n((F.col("status") == SKIPPED) | truthy("skipped"), "batch_skipped"))
    v = by(t["previews"], F.count(F.lit(1)).alias("compared"), F.sum(F.abs("page_delta")).alias("page_delta"), F.sum("lost").alias("objects_lost"), F.sum("warnings").alias("preview_warnings"))
    x = by(failures(t), F.count(F.lit(1)).alias("failures"))
    out = t["reports"].withColumnRenamed("id", "report_id")
    for part in (f, g, o, i, p, m, s, e, a, q, b, v, x):
        out = out.join(part, "report_id", "left")
    return out.fillna(0)


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _c(name: str) -> Column:
    return F.col(name)


def _status(fail: Column | None = None, ask: Column | None = None) -> Column:
    out = F.lit(PASS) if ask is None else F.when(ask, ASK).otherwise(PASS)
    return out if fail is None else F.when(fail, FAIL).otherwise(out)


def _first_of(cases: tuple, part: int, last: str) -> Column:
    """The text of the first case whose count isn't zero."""
    out = F.lit(last)
    for case in reversed(cases):
        out = F.when(_c(case[0]) > 0, case[part]).otherwise(out)
    return out


def risks() -> Column:
    """What the settings of a conversion may not keep."""
    of = lambda held, keep, text: F.when((_c(held) > 0) & ~F.coalesce(_c(keep), F.lit(True)), text)
    found = F.array(of("images_held", "retain_images", "图片保留关闭"), of("tables_held", "retain_tables", "表格保留关闭"), F.when(_c("task_type") == "word_to_ppt", of("formulas_held", "retain_formulas", "Word 公式保留关闭")))
    return F.when(_c("task_type").isin(*CONVERSIONS), F.filter(found, lambda r: r.isNotNull())).otherwise(F.array().cast("array<string>"))


def _plan() -> tuple[Column, Column]:
    """(metric, message) of the order of work."""
    order = F.array_join(F.slice("labels", 1, 6), " → ")
    size = F.size("labels")
    metric = _say("当前 ", F.when(_c("current_index") > 0, _c("current_index").cast("string")).otherwise("-"), " / ", size, " · ", F.when(size > 0, order).otherwise("未记录"), F.when(size > 6, "…").otherwise(""))
    bad = F.concat_ws("；", F.when(F.size("invalid_items") > 0, _say("已过滤未知任务：", F.array_join(F.slice("invalid_items", 1, 4), "、"))), F.when(F.size("duplicate_items") > 0, _say("已去除重复任务：", F.array_join(F.slice("duplicate_items", 1, 4), "、"))))
    return metric, F.when(bad != "", bad).when(size > 0, _say("流程顺序已随任务参数写入报告：", order)).otherwise("当前任务未记录流程顺序")


def checks(f: DataFrame) -> DataFrame:
    """(report_id, id, label, status, severity, metric, message, recommendation), fifteen rows a report."""
    plan_metric, plan_message = _plan()
    expected = F.when(_c("task_type").isin(*CONVERSIONS), _c("files")).otherwise(0)
    accounted = _c("artifacts_done") + _c("artifacts_skipped") + _c("artifacts_pending") + _c("artifacts_cancelled")
    differs = (_c("compared") > 0) & ((_c("page_delta") > 0) | (_c("objects_lost") > 0) | (_c("preview_warnings") > 0))
    compared = F.when(_c("compared") == 0, "当前任务暂无可比对转换输出").when(differs, "转换前后预览存在差异").otherwise("转换前后预览未发现明显差异")
    said = {
        "workflow_order": (_status(ask=(F.size("invalid_items") > 0) | (F.size("duplicate_items") > 0)), plan_metric, plan_message),
        "file_validation": (_status(_c("invalid") > 0), _say(_c("invalid"), " / ", _c("files"), " 个文件异常")),
        "structure_counts": (_status(ask=(_c("files") > 0) & (_c("pages") == 0)), _say("页/幻灯片/工作表合计 ", _c("pages"))),
        "content_preservation": (_status(ask=F.size(risks()) > 0), _say("图片 ", _c("images_held"), " 个，表格 ", _c("tables_held"), " 个，公式 ", _c("formulas_held"), " 个，标题/结构 ", _c("structures_held"), " 个"), F.array_join(risks(), "；")),
        "preview_consistency": (_status(ask=differs), _say("比对 ", _c("compared"), " 个，页段差异 ", _c("page_delta"), "，对象减少 ", _c("objects_lost"), "，告警 ", _c("preview_warnings")), compared),
        "formula_confidence": (_status(ask=_c("unsure") > 0), _say("低置信度 ", _c("unsure"), " / ", _c("formulas"), " 个，阈值 80")),
        "formula_positions": (_status(_c("misplaced") > 0), _say("异常 ", _c("misplaced"), " / ", _c("formulas"), " 个")),
        "omml_dependencies": (_status(_c("omml_issue_files") > 0), _say("异常 ", _c("omml_issue_files"), " / ", F.when(_c("omml_files") > 0, _c("omml_files")).otherwise(_c("omml")), " 个文件")),
        "omml_conversion_prompt": (_status(ask=_c("prompts_waiting") > 0), _say("待确认 ", _c("prompts_waiting"), " / ", _c("prompts"), " 个")),
        "macro_results": (_status(_c("macros_failed") > 0, (_c("macros_queued") > 0) | (_c("macros_blocked") > 0)), _say("失败 ", _c("macros_failed"), " 个，待本地处理 ", _c("macros_queued"), " 个，安全阻止 ", _c("macros_blocked"), " 个")),
        "small_images": (_status(_c("image_errors") > 0, _c("images") > 0), _say("发现 ", _c("images"), " 个，提取失败 ", _c("image_errors"), " 个")),
        "conversion_output": (_status((_c("artifacts_failed") > 0) | (accounted < expected), (_c("artifacts_skipped") > 0) | (_c("artifacts_pending") > 0) | (_c("artifacts_cancelled") > 0)), _say("成功 ", _c("artifacts_done"), " 个，待本地执行 ", _c("artifacts_pending"), " 个，已取消 ", _c("artifacts_cancelled"), " 个，跳过 ", _c("artifacts_skipped"), " 个，预期 ", F.when(expected > 0, expected).otherwise(accounted), " 个"), _first_of(OUTPUT_ASKS, 1, ""), _first_of(OUTPUT_ASKS, 2, "")),
        "mathpix_pdf": (_status(ask=_c("ocr_waiting") > 0), _say("需处理 ", _c("ocr_waiting"), " / ", _c("ocr"), " 个")),
        "pdf_type": (_status(ask=(_c("pdf_ocr") > 0) | (_c("pdf_formula") > 0) | (_c("pdf_table") > 0)), _say("OCR ", _c("pdf_ocr"), " 个，公式 ", _c("pdf_formula"), " 个，表格 ", _c("pdf_table"), " 个")),
        "batch_results": (_status(_c("batch_failed") > 0), _say("失败 ", _c("batch_failed"), " / ", _c("batch"), " 个，跳过 ", _c("batch_skipped"), " 个"), *[F.when(_c("batch_skipped") > 0, BATCH_PASSES[0][k]).otherwise(BATCH_PASSES[1][k]) for k in (0, 1)]),
    }

    def row(i: str) -> Column:
        label, texts = CHECKS[i]
        status, metric, *own = said[i]
        own = [*own, *[F.lit("")] * (2 - len(own))]
        pick = lambda k: F.coalesce(*[F.when(status == s, F.replace(F.lit(both[k]), F.lit("{}"), own[k])) for s, both in texts.items()])
        severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), status)
        return F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), status.alias("status"), severity.alias("severity"), metric.alias("metric"), pick(0).alias("message"), pick(1).alias("recommendation"))

    return f.select("report_id", F.explode(F.array(*[row(i) for i in CHECKS])).alias("c")).select("report_id", "c.*")


def all_checks(t: Frames, f: DataFrame) -> DataFrame:
    """The preflight's own checks before the fifteen."""
    none = F.lit("")
    severity = F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), F.col("status"))
    before = t["preflight"].select("report_id", "id", "label", "status", severity.alias("severity"), F.coalesce("metric", none).alias("metric"), F.coalesce("message", none).alias("message"), F.coalesce("recommendation", none).alias("recommendation"))
    return before.unionByName(checks(f))


def summary(f: DataFrame) -> DataFrame:
    """(report_id, id, label, metric, status, detail, recommendation), thirteen rows a report."""
    n = lambda c: c.cast("string")
    omml = F.greatest("omml_held", "prompts")
    mathtype = F.greatest("mathtype", "mathtype_files")
    notes = F.size(risks()) + F.when((_c("compared") > 0) & ((_c("page_delta") > 0) | (_c("objects_lost") > 0) | (_c("preview_warnings") > 0)), 1).otherwise(0) + F.when((_c("artifacts_failed") > 0) | (_c("artifacts_skipped") > 0) | (_c("artifacts_pending") > 0) | (_c("artifacts_cancelled") > 0), 1).otherwise(0)
    done = F.greatest(_c("files") - _c("invalid") - _c("artifacts_failed"), F.lit(0))
    failed = _c("invalid") + _c("artifacts_failed")
    waits, off = _c("artifacts_pending") > 0, _c("artifacts_cancelled") > 0
    said = {
        "file_total": (n(_c("files")), _status(failed > 0, waits | off), _say("成功 ", done, " 个，待本地处理 ", _c("artifacts_pending"), " 个，已取消 ", _c("artifacts_cancelled"), " 个，失败 ", failed, " 个"), F.when(waits & (failed == 0), "启动本地客户端处理等待文件").when(off & (failed == 0), "如需继续，请重试已取消文件").otherwise("处理失败文件后重试")),
        "omml_formulas": (n(omml), _status(ask=omml > 0)),
        "omml_conversion": (_say("已确认 ", _c("prompts_chosen"), " 个，待确认 ", _c("prompts_waiting"), " 个，异常 ", _c("omml_lost"), " 个"), _status(_c("omml_lost") > 0, _c("prompts_waiting") > 0)),
        "mathtype_formulas": (n(mathtype), _status()),
        "formatted_formulas": (n(_c("formatted")), _status()),
        "macro_execution": (_say("总数 ", _c("macros"), "，成功 ", _c("macros_done"), "，失败 ", _c("macros_failed")), _status(_c("macros_failed") > 0, _c("macros_queued") > 0)),
        "low_confidence": (n(_c("unsure")), _status(ask=_c("unsure") > 0)),
        "formula_positions": (n(_c("misplaced")), _status(_c("misplaced") > 0), F.when(_c("misplaced") > 0, "公式位置丢失会写入异常位置").otherwise("公式位置已记录"), F.when(_c("misplaced") > 0, "在排版校正中补充位置或重新识别公式").otherwise("继续处理")),
        "image_extraction": (_say("成功 ", _c("images"), " 个，失败 ", _c("image_errors"), " 个"), _status(_c("image_errors") > 0, _c("images") > 0), F.when(_c("image_errors") > 0, "存在图片条目读取或格式识别失败").otherwise("微小图片、图标、二维码、印章和签名进入图片报告"), F.when(_c("image_errors") > 0, "修复源文档或重新上传后重试图片检索").otherwise("查看图片页并确认类型、处理误判、删除或替换")),
        "small_images": (n(_c("images")), _status(ask=_c("images") > 0)),
        "table_extraction": (n(_c("tables_held")), _status(ask=_c("tables_held") > 0)),
        "possible_loss": (n(notes), _status(ask=notes > 0), F.when(notes > 0, "存在丢失风险").otherwise("未发现明显丢失风险")),
        "error_details": (n(_c("failures")), _status(_c("failures") > 0)),
    }

    def row(i: str) -> Column:
        label, detail, recommendation = SUMMARY[i]
        metric, status, *own = said[i]
        own = [*own, *[F.lit("")] * (2 - len(own))]
        fill = lambda text, k: F.replace(F.lit(text), F.lit("{}"), own[k])
        return F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), metric.alias("metric"), status.alias("status"), fill(detail, 0).alias("detail"), fill(recommendation, 1).alias("recommendation"))

    return f.select("report_id", F.explode(F.array(*[row(i) for i in SUMMARY])).alias("c")).select("report_id", "c.*")


def _frames(spark: SparkSession, sf_dir: str) -> Frames:
    """A workbench made of the documents: a report a source, its files the source's documents, the rest by their numbers."""
    t = Tables(spark, sf_dir)
    d = t.documents.select("doc_id", "source", "lang", "n_chars").withColumns({"report_id": F.col("source"), "file_id": F.col("doc_id").cast("string")})
    k = F.col("doc_id")
    at = lambda n, r=0: k % n == r
    zero = F.lit(0).cast("long")
    files = d.select("report_id", "file_id", F.concat(F.lit("doc"), "file_id").alias("file_name"), F.when(F.col("n_chars") < 100, F.array(F.lit("过短"))).otherwise(F.array().cast("array<string>")).alias("validation_errors"), F.when(F.col("lang") == "fr", "PDF").when(F.col("lang").isin("de", "en"), "Word").otherwise("Excel").alias("file_type"), ((F.col("lang") == "de") & (F.col("n_chars") < 300)).alias("missing_omml"), (F.col("lang") == "de").alias("has_omml"), at(13).alias("has_mathtype"), at(17).alias("has_formula"), F.floor(F.col("n_chars") / 2000).alias("pages"), (k % 3).alias("images_held"), (k % 2).alias("tables_held"), F.when(F.col("lang") == "de", k % 4).otherwise(zero).alias("omml_held"), F.when(F.col("lang") == "de", k % 4).otherwise(zero).alias("formulas_held"), F.floor(F.col("n_chars") / 1000).alias("structures_held"), F.when(at(5), "扫描型 PDF").otherwise("文本型 PDF").alias("pdf_kind"), F.when(at(7), 1).otherwise(0).alias("formula_hints"), F.when(at(6), 1).otherwise(0).alias("table_hints"))
    some = lambda cond, **cols: d.filter(cond).select("report_id", "file_id", F.col("doc_id").alias("id"), *[c.alias(n) for n, c in cols.items()])
    text = F.lit(None).cast("string")
    labels = t.labels.select("doc_id", "quality", "toxic")
    judged = d.join(labels, "doc_id")
    formulas = judged.select("report_id", "file_id", k.alias("id"), (F.col("quality") * 95).alias("confidence"), F.when(F.col("toxic") == 1, "待确认").otherwise("已确认").alias("status"), F.when(at(11), "异常位置").otherwise("已定位").alias("position_status"), text.alias("position_issue"), F.when(at(2), "MathType").otherwise("OMML").alias("source_type"), F.when(at(3), "已格式化").otherwise("").alias("format_status"))
    reports = d.select("source").distinct().select(F.col("source").alias("id"), F.when(F.col("source").endswith("2"), "batch_process").otherwise("word_to_ppt").alias("task_type"), F.lit(True).alias("retain_images"), (~F.col("source").endswith("4")).alias("retain_tables"), (~F.col("source").endswith("6")).alias("retain_formulas"), F.when(F.col("source").endswith("8"), F.array().cast("array<string>")).otherwise(F.array(F.lit("公式"), F.lit("转换"))).alias("labels"), F.when(F.col("source").endswith("5"), F.array(F.lit("foo"))).otherwise(F.array().cast("array<string>")).alias("invalid_items"), F.when(F.col("source").endswith("7"), F.array(F.lit("转换"))).otherwise(F.array().cast("array<string>")).alias("duplicate_items"), F.lit(1).alias("current_index"))
    ends = F.col("source").endswith("3")
    return {
        "reports": reports, "files": files, "formulas": formulas,
        "macros": some(at(9), execute_status=F.when(at(4), FAILED).when(at(4, 1), "待本地客户端执行").when(at(4, 2), "已禁用").otherwise(SUCCESS), message=text),
        "images": some(at(8)), "image_errors": some(at(50, 1), status=text, message=text),
        "omml": some((F.col("lang") == "de") & at(4), found_status=F.when(at(8), "未找到").otherwise("已找到"), copy_status=F.when(at(12), FAILED).otherwise(SUCCESS), message=text),
        "prompts": some((F.col("lang") == "de") & at(4, 1), status=F.when(at(3), ASK).otherwise("已选择转换")),
        "artifacts": some(k % 10 < 8, status=F.when(at(10), FAILED).when(at(10, 1), SKIPPED).when(at(10, 2), "待本地客户端执行").when(at(10, 3), "local_execution_cancelled").otherwise(SUCCESS), message=text),
        "ocr": some((F.col("lang") == "fr") & at(3), status=F.when(at(9), "timeout").when(at(6), "api_error").otherwise("completed"), message=text),
        "batch": some(at(7), status=F.when(at(21), FAILED).when(at(14), SKIPPED).otherwise(SUCCESS), skipped=F.lit(None).cast("boolean"), message=text, sequence=k),
        "previews": some((k % 10 > 3) & (k % 10 < 8), page_delta=k % 3 - 1, lost=F.when(at(5), 1).otherwise(0), warnings=F.lit(0)),
        "preflight": reports.select(F.col("id").alias("source")).select(F.col("source").alias("report_id"), F.lit("disk").alias("id"), F.lit("磁盘").alias("label"), F.when(ends, FAILED).otherwise(PASS).alias("status"), text.alias("metric"), text.alias("message"), text.alias("recommendation")),
    }


def _case(i: str, texts: dict[str, tuple[str, str]], k: int) -> str:
    return "CASE status " + " ".join(f"WHEN '{s}' THEN replace('{both[k]}', '{{}}', own{k})" for s, both in texts.items()) + " END"


D = """d AS (SELECT doc_id AS k, source AS r, lang, n_chars FROM documents),
sk AS (SELECT DISTINCT k FROM d WHERE k % 7 = 0 AND k % 21 <> 0 AND k % 14 = 0),
j AS (SELECT d.*, quality, toxic FROM d JOIN labels l ON l.doc_id = d.k),
lost AS (SELECT * FROM d WHERE lang = 'de' AND k % 4 = 0 AND (k % 8 = 0 OR k % 12 = 0)),
fx AS (SELECT r, '文件校验' AS category, k, '失败' AS status, '过短' AS message, '' AS source_id FROM d WHERE n_chars < 100 AND k NOT IN (SELECT k FROM sk)
UNION ALL SELECT r, '图片提取', k, '失败', '图片提取失败', CAST(k AS VARCHAR) FROM d WHERE k % 50 = 1
UNION ALL SELECT r, '公式位置', k, '异常位置', '公式位置丢失', CAST(k AS VARCHAR) FROM j WHERE k % 11 = 0
UNION ALL SELECT r, '批量处理', k, '失败', '批量处理失败', CAST(k AS VARCHAR) FROM d WHERE k % 21 = 0
UNION ALL SELECT r, 'OMML 依赖', k, CASE WHEN k % 12 = 0 THEN '失败' ELSE '成功' END, '检索或复制未完成', CAST(k AS VARCHAR) FROM lost
UNION ALL SELECT r, 'OMML 依赖', k, '缺少', '文件含 OMML 公式，但当前目录未检测到 OMML 依赖文件', '' FROM d WHERE lang = 'de' AND n_chars < 300 AND k NOT IN (SELECT k FROM lost)
UNION ALL SELECT r, '宏执行', k, '失败', '宏执行失败', CAST(k AS VARCHAR) FROM d WHERE k % 9 = 0 AND k % 4 = 0
UNION ALL SELECT r, '转换输出', k, '失败', '转换输出未生成', '' FROM d WHERE k % 10 = 0
UNION ALL SELECT r, 'Mathpix PDF', k, CASE WHEN k % 9 = 0 THEN 'timeout' ELSE 'api_error' END, 'Mathpix PDF 处理未完成', CAST(k AS VARCHAR) FROM d WHERE lang = 'fr' AND k % 3 = 0 AND (k % 9 = 0 OR k % 6 = 0)
UNION ALL SELECT DISTINCT r, '系统预检', NULL, '失败', '系统预检失败', 'disk' FROM d WHERE r LIKE '%3')"""

FACTS = f"""{D}, n AS (SELECT r, count(*) AS files, count(*) FILTER (WHERE n_chars < 100 AND k NOT IN (SELECT k FROM sk)) AS invalid, CAST(sum(n_chars // 2000) AS BIGINT) AS pages, CAST(sum(k % 3) AS BIGINT) AS im, CAST(sum(k % 2) AS BIGINT) AS tb,
CAST(sum(CASE WHEN lang = 'de' THEN k % 4 ELSE 0 END) AS BIGINT) AS fo, CAST(sum(n_chars // 1000) AS BIGINT) AS st, count(*) FILTER (WHERE lang = 'de') AS omml_files, count(*) FILTER (WHERE k % 13 = 0) AS mt_files,
count(*) FILTER (WHERE lang = 'fr' AND k % 5 = 0) AS p1, count(*) FILTER (WHERE lang = 'fr' AND (k % 17 = 0 OR k % 7 = 0)) AS p2, count(*) FILTER (WHERE lang = 'fr' AND k % 6 = 0) AS p3,
count(*) FILTER (WHERE lang = 'de' AND (n_chars < 300 OR (k % 4 = 0 AND (k % 8 = 0 OR k % 12 = 0)))) AS issue, count(*) FILTER (WHERE lang = 'de' AND k % 4 = 0 AND (k % 8 = 0 OR k % 12 = 0)) AS omml_lost,
count(*) FILTER (WHERE lang = 'de' AND k % 4 = 1) AS prompts, count(*) FILTER (WHERE lang = 'de' AND k % 4 = 1 AND k % 3 = 0) AS pw,
count(*) FILTER (WHERE k % 9 = 0) AS m, count(*) FILTER (WHERE k % 9 = 0 AND k % 4 = 0) AS mf, count(*) FILTER (WHERE k % 9 = 0 AND k % 4 = 1) AS mq, count(*) FILTER (WHERE k % 9 = 0 AND k % 4 = 2) AS mb,
count(*) FILTER (WHERE k % 8 = 0) AS images, count(*) FILTER (WHERE k % 50 = 1) AS ie,
count(*) FILTER (WHERE k % 10 BETWEEN 4 AND 7) AS ad, count(*) FILTER (WHERE k % 10 = 1) AS ak, count(*) FILTER (WHERE k % 10 = 2) AS ap, count(*) FILTER (WHERE k % 10 = 3) AS ac, count(*) FILTER (WHERE k % 10 = 0) AS af,
count(*) FILTER (WHERE lang = 'fr' AND k % 3 = 0) AS ocr, count(*) FILTER (WHERE lang = 'fr' AND k % 6 = 0 AND k % 9 <> 0) AS ow,
count(*) FILTER (WHERE k % 7 = 0) AS b, count(*) FILTER (WHERE k % 21 = 0) AS bf, count(*) FILTER (WHERE k % 14 = 0 AND k % 21 <> 0) AS bs,
coalesce(CAST(sum(abs(k % 3 - 1)) FILTER (WHERE k % 10 BETWEEN 4 AND 7) AS BIGINT), 0) AS pd, count(*) FILTER (WHERE k % 10 BETWEEN 4 AND 7 AND k % 5 = 0) AS ol, r LIKE '%2' AS batch_task FROM d GROUP BY r),
q AS (SELECT r, count(*) AS formulas, count(*) FILTER (WHERE toxic = 1 OR quality * 95 < 80) AS unsure, count(*) FILTER (WHERE k % 11 = 0) AS mis, count(*) FILTER (WHERE k % 2 = 0) AS mt, count(*) FILTER (WHERE k % 3 = 0) AS formatted FROM j GROUP BY r),
y AS (SELECT r, count(*) AS failures FROM fx GROUP BY r),
f AS (SELECT n.*, coalesce(formulas, 0) AS formulas, coalesce(unsure, 0) AS unsure, coalesce(mis, 0) AS mis, coalesce(mt, 0) AS mt, coalesce(formatted, 0) AS formatted, coalesce(failures, 0) AS failures,
ad + ak + ap + ac AS accounted, CASE WHEN batch_task THEN 0 ELSE n.files END AS expected, ad > 0 AND (pd > 0 OR ol > 0) AS differs,
CASE WHEN batch_task THEN [] ELSE list_filter([CASE WHEN r LIKE '%4' AND tb > 0 THEN '表格保留关闭' END, CASE WHEN r LIKE '%6' AND fo > 0 THEN 'Word 公式保留关闭' END], lambda x: x IS NOT NULL) END AS risks FROM n LEFT JOIN q USING (r) LEFT JOIN y USING (r))"""

_S = lambda fail, ask: f"CASE WHEN {fail} THEN '失败' WHEN {ask} THEN '需确认' ELSE '通过' END"
CHECK_SQL = {
    "workflow_order": (_S("FALSE", "r LIKE '%5' OR r LIKE '%7'"), "CASE WHEN r LIKE '%8' THEN '当前 1 / 0 · 未记录' ELSE '当前 1 / 2 · 公式 → 转换' END", "CASE WHEN r LIKE '%5' THEN '已过滤未知任务：foo' WHEN r LIKE '%7' THEN '已去除重复任务：转换' WHEN r LIKE '%8' THEN '当前任务未记录流程顺序' ELSE '流程顺序已随任务参数写入报告：公式 → 转换' END"),
    "file_validation": (_S("invalid > 0", "FALSE"), "invalid || ' / ' || files || ' 个文件异常'"),
    "structure_counts": (_S("FALSE", "files > 0 AND pages = 0"), "'页/幻灯片/工作表合计 ' || pages"),
    "content_preservation": (_S("FALSE", "len(risks) > 0"), "'图片 ' || im || ' 个，表格 ' || tb || ' 个，公式 ' || fo || ' 个，标题/结构 ' || st || ' 个'", "array_to_string(risks, '；')"),
    "preview_consistency": (_S("FALSE", "differs"), "'比对 ' || ad || ' 个，页段差异 ' || pd || '，对象减少 ' || ol || '，告警 0'", "CASE WHEN ad = 0 THEN '当前任务暂无可比对转换输出' WHEN differs THEN '转换前后预览存在差异' ELSE '转换前后预览未发现明显差异' END"),
    "formula_confidence": (_S("FALSE", "unsure > 0"), "'低置信度 ' || unsure || ' / ' || formulas || ' 个，阈值 80'"),
    "formula_positions": (_S("mis > 0", "FALSE"), "'异常 ' || mis || ' / ' || formulas || ' 个'"),
    "omml_dependencies": (_S("issue > 0", "FALSE"), "'异常 ' || issue || ' / ' || omml_files || ' 个文件'"),
    "omml_conversion_prompt": (_S("FALSE", "pw > 0"), "'待确认 ' || pw || ' / ' || prompts || ' 个'"),
    "macro_results": (_S("mf > 0", "mq > 0 OR mb > 0"), "'失败 ' || mf || ' 个，待本地处理 ' || mq || ' 个，安全阻止 ' || mb || ' 个'"),
    "small_images": (_S("ie > 0", "images > 0"), "'发现 ' || images || ' 个，提取失败 ' || ie || ' 个'"),
    "conversion_output": (_S("af > 0 OR accounted < expected", "ak > 0 OR ap > 0 OR ac > 0"), "'成功 ' || ad || ' 个，待本地执行 ' || ap || ' 个，已取消 ' || ac || ' 个，跳过 ' || ak || ' 个，预期 ' || CASE WHEN expected > 0 THEN expected ELSE accounted END || ' 个'", *["CASE " + " ".join(f"WHEN {c} > 0 THEN '{case[k]}'" for c, case in zip(("ap", "ac", "ak"), OUTPUT_ASKS)) + " ELSE '' END" for k in (1, 2)]),
    "mathpix_pdf": (_S("FALSE", "ow > 0"), "'需处理 ' || ow || ' / ' || ocr || ' 个'"),
    "pdf_type": (_S("FALSE", "p1 > 0 OR p2 > 0 OR p3 > 0"), "'OCR ' || p1 || ' 个，公式 ' || p2 || ' 个，表格 ' || p3 || ' 个'"),
    "batch_results": (_S("bf > 0", "FALSE"), "'失败 ' || bf || ' / ' || b || ' 个，跳过 ' || bs || ' 个'", *[f"CASE WHEN bs > 0 THEN '{BATCH_PASSES[0][k]}' ELSE '{BATCH_PASSES[1][k]}' END" for k in (0, 1)]),
}


def _check_sql(i: str) -> str:
    status, metric, *own = CHECK_SQL[i]
    own = [*own, *["''"] * (2 - len(own))]
    label, texts = CHECKS[i]
    return f"SELECT r AS report_id, '{i}' AS id, '{label}' AS label, status, CASE status WHEN '通过' THEN 'info' WHEN '需确认' THEN 'warning' ELSE 'error' END AS severity, metric, {_case(i, texts, 0)} AS message, {_case(i, texts, 1)} AS recommendation FROM (SELECT r, {status} AS status, {metric} AS metric, {own[0]} AS own0, {own[1]} AS own1 FROM f)"


@query(f"WITH {FACTS} " + " UNION ALL ".join(map(_check_sql, CHECKS)) + " UNION ALL SELECT r, 'disk', '磁盘', CASE WHEN r LIKE '%3' THEN '失败' ELSE '通过' END, CASE WHEN r LIKE '%3' THEN 'error' ELSE 'info' END, '', '', '' FROM n")
def report_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preflight and the fifteen checks of every report."""
    t = _frames(spark, sf_dir)
    return all_checks(t, facts(t))


SUMMARY_SQL = {
    "file_total": ("CAST(files AS VARCHAR)", _S("invalid + af > 0", "ap > 0 OR ac > 0"), "'成功 ' || greatest(files - invalid - af, 0) || ' 个，待本地处理 ' || ap || ' 个，已取消 ' || ac || ' 个，失败 ' || (invalid + af) || ' 个'", "CASE WHEN ap > 0 AND invalid + af = 0 THEN '启动本地客户端处理等待文件' WHEN ac > 0 AND invalid + af = 0 THEN '如需继续，请重试已取消文件' ELSE '处理失败文件后重试' END"),
    "omml_formulas": ("CAST(greatest(fo, prompts) AS VARCHAR)", _S("FALSE", "greatest(fo, prompts) > 0")),
    "omml_conversion": ("'已确认 ' || (prompts - pw) || ' 个，待确认 ' || pw || ' 个，异常 ' || omml_lost || ' 个'", _S("omml_lost > 0", "pw > 0")),
    "mathtype_formulas": ("CAST(greatest(mt, mt_files) AS VARCHAR)", "'通过'"),
    "formatted_formulas": ("CAST(formatted AS VARCHAR)", "'通过'"),
    "macro_execution": ("'总数 ' || m || '，成功 ' || (m - mf - mq - mb) || '，失败 ' || mf", _S("mf > 0", "mq > 0")),
    "low_confidence": ("CAST(unsure AS VARCHAR)", _S("FALSE", "unsure > 0")),
    "formula_positions": ("CAST(mis AS VARCHAR)", _S("mis > 0", "FALSE"), "CASE WHEN mis > 0 THEN '公式位置丢失会写入异常位置' ELSE '公式位置已记录' END", "CASE WHEN mis > 0 THEN '在排版校正中补充位置或重新识别公式' ELSE '继续处理' END"),
    "image_extraction": ("'成功 ' || images || ' 个，失败 ' || ie || ' 个'", _S("ie > 0", "images > 0"), "CASE WHEN ie > 0 THEN '存在图片条目读取或格式识别失败' ELSE '微小图片、图标、二维码、印章和签名进入图片报告' END", "CASE WHEN ie > 0 THEN '修复源文档或重新上传后重试图片检索' ELSE '查看图片页并确认类型、处理误判、删除或替换' END"),
    "small_images": ("CAST(images AS VARCHAR)", _S("FALSE", "images > 0")),
    "table_extraction": ("CAST(tb AS VARCHAR)", _S("FALSE", "tb > 0")),
    "possible_loss": ("CAST(notes AS VARCHAR)", _S("FALSE", "notes > 0"), "CASE WHEN notes > 0 THEN '存在丢失风险' ELSE '未发现明显丢失风险' END"),
    "error_details": ("CAST(failures AS VARCHAR)", _S("failures > 0", "FALSE")),
}


def _summary_sql(i: str) -> str:
    metric, status, *own = SUMMARY_SQL[i]
    own = [*own, *["''"] * (2 - len(own))]
    label, detail, recommendation = SUMMARY[i]
    return f"SELECT r AS report_id, '{i}' AS id, '{label}' AS label, {metric} AS metric, {status} AS status, replace('{detail}', '{{}}', {own[0]}) AS detail, replace('{recommendation}', '{{}}', {own[1]}) AS recommendation FROM z"


@query(f"WITH {FACTS}, z AS (SELECT *, CAST(len(risks) + CASE WHEN differs THEN 1 ELSE 0 END + CASE WHEN af > 0 OR ak > 0 OR ap > 0 OR ac > 0 THEN 1 ELSE 0 END AS INTEGER) AS notes FROM f) " + " UNION ALL ".join(map(_summary_sql, SUMMARY)))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirteen summary rows of every report."""
    return summary(facts(_frames(spark, sf_dir)))


@query(f"""WITH {D} SELECT r AS report_id, category, coalesce(CAST(k AS VARCHAR), '') AS file_id, CASE WHEN k IS NULL THEN '' ELSE 'doc' || k END AS file_name, status, message, source_id FROM fx""")
def report_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure list of every report, of all its ten sources."""
    return failures(_frames(spark, sf_dir))


@query(f"""WITH {FACTS}, c AS ({" UNION ALL ".join(map(_check_sql, CHECKS))}), o(id, i) AS (VALUES {", ".join(f"('{x}', {i})" for i, x in enumerate(CHECKS))}),
h AS (SELECT report_id, '<h2>质量检查</h2><table><tr><th>label</th><th>status</th></tr>' || string_agg('<tr><td>' || label || '</td><td>' || status || '</td></tr>', '' ORDER BY i) || '</table>' AS html FROM c JOIN o USING (id) GROUP BY 1),
g AS (SELECT r AS report_id, chr(10) || '<h2>失败清单</h2><table><tr><th>category</th><th>message</th></tr>' || string_agg('<tr><td>' || category || '</td><td>' || message || '</td></tr>', '' ORDER BY category, coalesce(CAST(k AS VARCHAR), '')) || '</table>' AS html FROM fx GROUP BY 1)
SELECT report_id, '<!doctype html><meta charset=''utf-8''><title>报告</title>' || h.html || coalesce(g.html, '') AS html FROM h LEFT JOIN g USING (report_id)""")
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O9, C8, STR8: the checks and failures of every report as one page of two tables."""
    t = _frames(spark, sf_dir)
    order = F.element_at(F.create_map(*[x for i, c in enumerate(CHECKS) for x in (F.lit(c), F.lit(i))]), F.col("id"))
    return sectioned_html("报告", [("质量检查", checks(facts(t)).withColumn("i", order), ["label", "status"], ["i"]), ("失败清单", failures(t), ["category", "message"], ["category", "file_id"])], "report_id")
