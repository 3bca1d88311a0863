"""Payloads as they may be shown: local paths told by a label, secrets emptied, whatever the shape.

Typed values are walked by their type, JSON texts of unknown shape as VARIANT: parsed, taken apart level by level into (key, value)
entries, judged by key, and put together again. Keys are those of the parsed objects, so a key's name inside a string is text, and escapes don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docengine.functions import text
from docengine.functions.nulls import col

#: Keys whose values are local paths (fixed values).
PATH_KEYS = ("file_path", "storage_path", "input_path", "output_path", "report_path", "path", "html_path", "json_path", "pdf_path", "xlsx_path", "txt_path", "failure_csv_path", "backup_path", "expected_location", "manual_omml_path", "target_path", "document_path", "omml_source_path", "omml_target_path", "image_path", "original_image_path", "template_path")
#: Keys whose values are emptied (own choice).
SECRET_KEYS = ("token", "password", "secret", "app_key", "api_key", "localSecurityToken")
#: What stands in a path's place (fixed value).
LABEL = "本地路径已隐藏"
OUTPUTS = "outputs"


def label(path: Column | str) -> Column:
    """Empty for no path, else the label and the path's last part."""
    bare = F.regexp_replace(F.coalesce(col(path), F.lit("")), r"[/\\]+$", "")
    name = text.base_name(bare)
    return F.when(F.coalesce(col(path), F.lit("")) == "", "").when(name == "", LABEL).otherwise(F.concat(F.lit(f"{LABEL}/"), name))


def labelled_text(x: Column | str) -> Column:
    """Absolute paths in running text told by their labels."""
    return text.redact_paths(x, f"{LABEL}/")


def _there(c: Column, t: T.DataType) -> Column:
    """Whether a value counts as given: not null, empty, zero or false."""
    if isinstance(t, T.StringType):
        return F.coalesce(c != "", F.lit(False))
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(t, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(t, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return c.isNotNull()


def redacted(c: Column, t: T.DataType, key: str = "") -> Column:
    """F17, F19, JS3, JS4: a typed value; paths get a flag beside them, at any depth of the type."""
    if isinstance(t, T.StructType):
        return F.when(c.isNotNull(), F.struct(*fields(t, lambda f: c[f.name])))
    if isinstance(t, T.ArrayType):
        return F.transform(c, lambda x: redacted(x, t.elementType, key))
    if isinstance(t, T.MapType) and isinstance(t.valueType, T.StringType):
        paths = F.lit(True) if key == OUTPUTS else F.lit(False)
        return F.transform_values(c, lambda k, v: F.when(k.isin(*SECRET_KEYS), "").when(paths | k.isin(*PATH_KEYS), label(v)).otherwise(labelled_text(v)))
    if isinstance(t, T.MapType):
        return F.transform_values(c, lambda k, v: redacted(v, t.valueType))
    if isinstance(t, T.StringType):
        return F.lit("") if key in SECRET_KEYS else label(c) if key in PATH_KEYS else labelled_text(c)
    return F.when(c.isNotNull(), LABEL) if key in PATH_KEYS else c


def fields(t: T.StructType, at) -> list[Column]:
    """The redacted fields of a struct or table and the flags of its paths; a field that has a flag's name stays."""
    out = [redacted(at(f), f.dataType, f.name).alias(f.name) for f in t]
    flags = {f"{f.name}_available": _there(at(f), f.dataType) for f in t if f.name in PATH_KEYS}
    flags |= {"backup_available": flags["backup_path_available"]} if "backup_path_available" in flags else {}
    flags |= {f"{OUTPUTS}_available": F.transform_values(at(f), lambda k, v: F.coalesce(v != "", F.lit(False))) for f in t if f.name == OUTPUTS and isinstance(f.dataType, T.MapType) and isinstance(f.dataType.valueType, T.StringType)}
    return out + [v.alias(k) for k, v in flags.items() if k not in t.names]


def redact_rows(df: DataFrame) -> DataFrame:
    return df.select(*fields(df.schema, lambda f: F.col(f.name)))


# ---- values of unknown shape ----


def nesting(payload: Column | str) -> Column:
    """How deep a JSON text nests."""
    brackets = F.regexp_replace(F.regexp_replace(col(payload), r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step)["most"]


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _string(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _variant(c: Column) -> Column:
    return c.cast("variant")


def _given(v: Column) -> Column:
    o, a, s = _object(v), _array(v), _string(v)
    return F.coalesce(F.when(o.isNotNull(), F.size(o) > 0).when(a.isNotNull(), F.size(a) > 0).when(_is_string(v), s != "").when(F.schema_of_variant(v) == "BOOLEAN", s == "true").otherwise(F.try_variant_get(v, "$", "double") != 0), F.lit(False))


def _path(v: Column) -> Column:
    """The label of any value under a path's key."""
    plain = _object(v).isNull() & _array(v).isNull()
    return F.when(~_given(v), "").when(plain, label(_string(v))).otherwise(LABEL)


def _let(c: Column, f) -> Column:
    """f(c) with c taken once: expressions stay linear in depth."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _entry(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def walked(v: Column, depth: int) -> Column:
    """A VARIANT redacted down to `depth` levels of containers; containers below them become null, so nothing of them shows."""
    scalar = lambda x: F.when(_is_string(x), _variant(labelled_text(_string(x)))).otherwise(x)
    if not depth:
        return F.when(_object(v).isNull() & _array(v).isNull(), scalar(v))

    def value(k: Column, x: Column) -> Column:
        labels = F.to_variant_object(F.transform_values(_object(x), lambda _, p: _path(p)))
        shown = F.when(k.isin(*SECRET_KEYS), _variant(F.lit(""))).when(k.isin(*PATH_KEYS), _variant(_path(x)))
        return shown.when((k == OUTPUTS) & _object(x).isNotNull(), labels).otherwise(walked(x, depth - 1))

    def together(o: Column, entries: Column) -> Column:
        done = F.transform(entries, lambda e: _entry(e["k"], value(e["k"], e["v"])))
        flags = F.transform(F.filter(entries, lambda e: e["k"].isin(*PATH_KEYS)), lambda e: _entry(F.concat(e["k"], F.lit("_available")), _variant(_given(e["v"]))))
        backup = F.transform(F.filter(entries, lambda e: e["k"] == "backup_path"), lambda e: _entry(F.lit("backup_available"), _variant(_given(e["v"]))))
        outputs = F.transform(F.filter(entries, lambda e: (e["k"] == OUTPUTS) & _object(e["v"]).isNotNull()), lambda e: _entry(F.lit(f"{OUTPUTS}_available"), F.to_variant_object(F.transform_values(_object(e["v"]), lambda _, p: _given(p)))))
        new = F.filter(F.concat(flags, backup, outputs), lambda e: ~F.map_contains_key(o, e["k"]))
        return _let(done, lambda d: F.when(o.isNotNull(), F.to_variant_object(F.map_from_entries(F.concat(d, new)))).otherwise(F.to_variant_object(F.transform(d, lambda e: e["v"]))))

    # a container is taken apart once; below, `walked` stands once only, so that expressions stay linear in depth
    def parted(c: Column) -> Column:
        entries = F.coalesce(F.transform(F.map_entries(c["o"]), lambda e: _entry(e["key"], e["value"])), F.transform(c["a"], lambda x: _entry(F.lit(None).cast("string"), x)))
        whole = _let(F.struct(c["o"].alias("o"), entries.alias("entries")), lambda s: together(s["o"], s["entries"]))
        return F.when(c["o"].isNotNull() | c["a"].isNotNull(), whole).otherwise(scalar(c["v"]))

    return _let(F.struct(v.alias("v"), _object(v).alias("o"), _array(v).alias("a")), parted)


def redacted_json(payload: Column | str, depth: int = 6) -> Column:
    """F17, JS3: a JSON text redacted down to `depth` levels (more than 6 need redact_json); a text that is no JSON as running text."""
    return F.coalesce(F.to_json(_let(F.try_parse_json(col(payload)), lambda v: walked(v, depth))), labelled_text(payload))


def redact_json(df: DataFrame, column: str) -> DataFrame:
    """df with a column of JSON texts redacted as deep as the deepest of them nests.

    The analyzer resolves a level of nested functions in some dozen of its rounds, so its bound is raised with the depth meanwhile.
    """
    deepest = df.agg(F.max(nesting(column))).first()[0] or 0
    conf, name = df.sparkSession.conf, "spark.sql.analyzer.maxIterations"
    before = conf.get(name)
    conf.set(name, max(int(before), 30 * (deepest + 2)))
    try:
        return df.withColumn(column, redacted_json(column, deepest))
    finally:
        conf.set(name, before)
