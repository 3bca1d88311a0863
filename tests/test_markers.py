"""Terms in page texts against looking for each in each."""

import random

from docengine.operators import markers
from pyspark.sql import functions as F

PAGES, TERMS = "doc_id long, page int, text string", "marker string, term string"


def test_found_equals_looking(spark):
    rng = random.Random(5)
    piece = lambda: "".join(rng.choices("abÀ", k=rng.randrange(1, 4)))
    said = lambda n: "".join(piece() + rng.choice([" ", " ", "  ", "\n", ", ", "-"]) for _ in range(n))
    pages = [(i // 3, i % 3, said(rng.randrange(0, 25))) for i in range(90)] + [(50, 0, None), (50, 1, ""), (51, 0, "Licensed UNDER the MIT-License"), (51, 0, "Licensed UNDER the MIT-License")]
    terms = [(f"m{i}", said(rng.randrange(1, 5)).strip(" ") + rng.choice(["", "", ","])) for i in range(120)] + [("x", "mit-license"), ("y", "sed under"), ("z", "ER THE M"), ("n", None), ("e", ""), ("b", "  "), ("x", "license"), ("long", "w" * 50)]
    got = markers.found(spark.createDataFrame(pages, PAGES), spark.createDataFrame(terms, TERMS), ["doc_id", "page"])
    want = {(d, p, m) for d, p, t in pages for m, x in terms if x and x.strip() and t and x.lower() in t.lower()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and {("x"), ("y"), ("z")} <= {r[2] for r in rows}
    assert markers.found(spark.createDataFrame(pages, PAGES), spark.createDataFrame([], TERMS), ["doc_id", "page"]).collect() == []


def test_attached(spark):
    pages = spark.createDataFrame([(1, 1, "has a macro"), (1, 2, "公式 here"), (2, 5, "公式"), (3, 1, "公式")], PAGES)
    terms = spark.createDataFrame([("f", "公式"), ("m", "宏"), ("i", "macro")], TERMS)
    flagged = spark.createDataFrame([(1, "f"), (1, "m"), (2, "m"), (2, "m")], "doc_id long, marker string")
    assert sorted(map(tuple, markers.attached(pages, terms, flagged).collect())) == [(1, 1, "f"), (1, 1, "m"), (1, 2, "f"), (2, 5, "m")]
    assert markers.page_text(F.lit("A"), F.lit(None).cast("string"), F.lit("b")) is not None


def test_found_shuffles_no_texts_and_takes_passes(spark):
    """The index travels to the pages: only (key, marker) is shuffled, and an index beyond the bound takes passes with the same result."""
    pages = spark.createDataFrame([(i, 0, f"alpha{i} beta gamma delta{i % 7} epsilon") for i in range(60)], PAGES)
    terms = spark.createDataFrame([("w", "pha1"), ("p", "ta gam"), ("t", "beta gamma delta3"), ("f", "eta"), ("q", "a1 beta")], TERMS)
    once = markers.found(pages, terms, ["doc_id", "page"])
    plan = once._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [doc_id" in plan and plan.count("rightHint=(strategy=broadcast)") == plan.count("Join Inner")
    many = markers.found(pages, terms, ["doc_id", "page"], most=3)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, many.collect()))


def test_the_index_grows_with_the_terms_alone(spark):
    """However many different words hold them, terms are one pass; blanks of any kind and number are told apart."""
    pages = spark.createDataFrame([(i, 0, f"x{i}mac y{i}pub  the{i}\n end{i} of　a{i} line") for i in range(300)], PAGES)
    terms = spark.createDataFrame([("w", "mac"), ("p", "pub  the"), ("q", "pub the"), ("n", "\n end"), ("i", "of　a1"), ("t", "7\n end7 of"), ("b", "line "), ("c", " line")], TERMS)
    got = markers.found(pages, terms, ["doc_id", "page"], most=40)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 4 and "BuildLeft" not in plan  # a pass: one join for single words, two for pairs, one for longer terms
    counts = {r["marker"]: r["count"] for r in got.groupBy("marker").count().collect()}
    assert counts == {"w": 300, "p": 300, "n": 300, "i": 111, "t": 1, "c": 300}
