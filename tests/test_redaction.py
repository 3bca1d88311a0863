"""Payloads of unknown shape and of a type, against a plain walk."""

import json
import random

from docengine.functions import redaction as R
from pyspark.sql import functions as F


def label(x):
    if not x:
        return ""
    if isinstance(x, (dict, list)):
        return R.LABEL
    name = (json.dumps(x) if isinstance(x, bool) else str(x)).rstrip("/").rsplit("/", 1)[-1]
    return f"{R.LABEL}/{name}" if name else R.LABEL


def plain(x):
    if isinstance(x, list):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        out = {}
        for k, v in x.items():
            if k in R.SECRET_KEYS:
                out[k] = ""
            elif k in R.PATH_KEYS:
                out[k] = label(v)
                out.setdefault(f"{k}_available", bool(v))
            elif k == "outputs" and isinstance(v, dict):
                out[k] = {n: label(p) for n, p in v.items()}
                out.setdefault("outputs_available", {n: bool(p) for n, p in v.items()})
            else:
                out[k] = plain(v)
        if "backup_path" in x:
            out.setdefault("backup_available", bool(x["backup_path"]))
        for k, v in x.items():  # a flag of its own stays
            if k.endswith("_available"):
                out[k] = plain(v)
        return out
    return x.replace("/home/u/d/x.txt", f"{R.LABEL}/x.txt") if isinstance(x, str) else x


def payload(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([None, True, False, 0, 7, -3, 2.5, "", "plain", "at /home/u/d/x.txt, \"html_path\":\"s/a\"", "ü中", "a\\b", '{"path":"/home/u/d/x.txt"}'])
    if rng.random() < 0.3:
        return [payload(rng, depth - 1) for _ in range(rng.randrange(4))]
    keys = [*R.PATH_KEYS, "outputs", "token", "name", "path_available", "items", "n", 'we"ird', "outputs", "backup_path"]
    out = {}
    for k in rng.sample(keys, rng.randrange(6)):
        out[k] = rng.choice(["/srv/a/b.docx", "c.pdf", "dir/", "/", "", None, 5, 0, [], ["/a"], {}, {"path": "/x"}]) if k in R.PATH_KEYS else {"pdf": "/o/a.pdf", "txt": "", "none": None} if k == "outputs" and rng.random() < 0.5 else payload(rng, depth - 1)
    return out


def test_unknown_shapes_equal_the_walk(spark):
    rng = random.Random(8)
    given = [payload(rng, 6) for _ in range(300)] + [{}, [], "x", None, {"html_path": "secret/dir/a.html"}, {"a": [[[{"b": {"path": "/q/w"}}]]]}]
    df = spark.createDataFrame([(i, json.dumps(p, ensure_ascii=i % 2 == 0)) for i, p in enumerate(given)], "id int, p string").repartition(2)
    got = {r.id: json.loads(r.p) for r in R.redact_json(df, "p").collect()}
    for i, p in enumerate(given):
        assert got[i] == plain(p), (p, got[i])


def test_what_is_no_json_and_what_is_too_deep(spark):
    df = spark.createDataFrame([("open /home/u/d/x.txt {", 0), (None, 0), ("", 0), ('{"a":{"b":{"path":"/s/t"}},"c":1}', 2)], "p string, depth int")
    assert [r.p for r in R.redact_json(df.limit(3), "p").collect()] == [f"open {R.LABEL}/x.txt {{", None, ""]
    assert df.filter("depth = 2").select(R.redacted_json("p", 1).alias("p")).first().p == '{"a":null,"c":1}'
    assert [r.d for r in df.select(R.nesting("p").alias("d")).collect()] == [1, None, 0, 3]


def test_typed_rows(spark):
    df = spark.createDataFrame([("/home/me/x.docx", {"token": "s", "note": "at /home/me/y.txt"}, [("k", "C:\\u\\z.txt")], {"pdf": "/o/a.pdf", "txt": ""}, None)], "file_path string, options map<string,string>, items array<struct<token:string,path:string>>, outputs map<string,string>, backup_path string")
    r = R.redact_rows(df).first()
    assert r.file_path == f"{R.LABEL}/x.docx" and r.file_path_available and r.options == {"token": "", "note": f"at {R.LABEL}/y.txt"} and tuple(r["items"][0]) == ("", f"{R.LABEL}/z.txt", True)
    assert r.outputs == {"pdf": f"{R.LABEL}/a.pdf", "txt": ""} and r.outputs_available == {"pdf": True, "txt": False} and r.backup_path == "" and not r.backup_path_available and not r.backup_available
    kept = R.redact_rows(df.withColumn("file_path_available", F.lit("own"))).first()
    assert kept.file_path_available == "own"


def test_texts_are_dealt_out(spark, sf):
    from docengine.plans import library

    assert library.redact_json_texts(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_expressions_are_linear_in_depth_and_take_an_object_once(spark):
    plan = lambda d: spark.range(1).select(F.to_json(R.walked(F.parse_json(F.lit("{}")), d)).alias("x"))._jdf.queryExecution().analyzed().toString()
    size = [len(plan(d)) for d in (1, 2, 3)]
    assert size[2] - size[1] < 1.6 * (size[1] - size[0])
