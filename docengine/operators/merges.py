"""Merged cells in plans: runs of rows that they tie together, pages that don't cut them, row heights that hold their texts.

A cut c lies before row c. A merge of rows first up to but without last forbids the cuts between: first < c < last. Overlapping merges
forbid a run of cuts. Work is dealt by table and band of rows, so one table may hold any share of all rows; what crosses bands
is one row a band, and a sheet's million rows are 256 of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions import text as X
from docengine.operators import relational as R
from docengine.operators.lineage import written

BAND = 4096


def banded_runs(merges: DataFrame, key: list[str], first: str = "first", last: str = "last", band: int = BAND) -> DataFrame:
    """(key, band, runs array of (a, b)): maximal runs of forbidden cuts a..b, in order, each in the band where it ends."""
    cuts = merges.filter(F.col(last) - F.col(first) > 1).select(*key, F.explode(F.sequence(F.col(first).cast("long") + 1, F.col(last).cast("long") - 1)).alias("cut"))
    c = cuts.groupBy(*key, F.floor(F.col("cut") / band).alias("band")).agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    # a run's start has no neighbour before it in its band, an end none after it
    starts = F.filter("cuts", lambda x, i: (i == 0) | (F.get("cuts", i - 1) != x - 1))
    ends = F.filter("cuts", lambda x, i: (i == F.size("cuts") - 1) | (F.get("cuts", i + 1) != x + 1))
    c = c.select(*key, "band", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("pieces"))
    order = Window.partitionBy(*key).orderBy("band")
    head, tail = F.get("pieces", F.lit(0)), F.element_at("pieces", -1)
    low, high = F.col("band") * band, F.col("band") * band + band - 1
    c = c.withColumn("goes_on", (tail["b"] == high) & (F.lead("band").over(order) == F.col("band") + 1) & (F.lead(head["a"]).over(order) == high + 1))
    c = c.withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    c = c.withColumn("came", F.coalesce(F.lag("goes_on").over(order), F.lit(False)))
    # where the run that leaves the band began; a band that it only crosses says nothing
    c = c.withColumn("begun", F.when(F.col("goes_on") & ~(F.col("came") & (F.size("pieces") == 1)), tail["a"]))
    c = c.withColumn("entered", F.last("begun", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    whole = F.transform("pieces", lambda p, i: F.when((i == 0) & F.col("came"), p.withField("a", F.col("entered"))).otherwise(p))
    done = F.when(F.col("goes_on"), F.slice(whole, F.lit(1), F.size("pieces") - 1)).otherwise(whole)
    return c.select(*key, "band", done.alias("runs")).filter(F.size("runs") > 0)


def runs(merges: DataFrame, key: list[str], first: str = "first", last: str = "last", band: int = BAND) -> DataFrame:
    """(key, a, b), one row a run of forbidden cuts."""
    return banded_runs(merges, key, first, last, band).select(*key, F.explode("runs").alias("r")).select(*key, "r.a", "r.b")


def merge_pages(tables: DataFrame, merges: DataFrame, key: list[str], size: int = 12, total: str = "total", band: int = BAND) -> DataFrame:
    """(key, page from 0, start, end): pages of at most `size` rows that never cut a merge; what no page holds is a page of its own.

    Between breaks pages start every `size` rows, so all that a run of forbidden cuts needs to know of what is before it is a remainder, and all it
    does is to turn remainders into remainders. A band's runs are folded into one such function; functions are applied in order, one row a band; then every band
    knows its remainder and lists its breaks and pages on its own.
    """
    m = F.lit(size).cast("long")

    def hit(r: Column, x: Column) -> tuple[Column, Column, Column]:
        """(whether pages on remainder x meet the run, whether the run is a page of its own, the break before the run)."""
        cut = r["a"] + F.pmod(x - r["a"], m)
        return cut <= r["b"], (cut == r["a"] + m - 1) | (r["a"] - 1 + m <= r["b"]), r["a"] - 1

    def after(r: Column, x: Column) -> Column:
        meets, own, before = hit(r, x)
        return F.when(~meets, x).when(own, F.pmod(r["b"] + 1, m)).otherwise(F.pmod(before, m))

    place = lambda at, alone: F.struct(at.cast("long").alias("at"), alone.alias("alone"))

    def breaks(r: Column, x: Column) -> Column:
        meets, own, before = hit(r, x)
        none = F.array().cast("array<struct<at:bigint,alone:boolean>>")
        return F.when(~meets, none).when(own, F.array(place(before, F.lit(True)), place(r["b"] + 1, F.lit(False)))).otherwise(F.array(place(before, F.lit(False))))

    found = banded_runs(merges, key, band=band)
    every = F.sequence(F.lit(0).cast("long"), m - 1)
    turned = F.aggregate("runs", every, lambda acc, r: F.transform(acc, lambda x: after(r, x)))
    chain = found.select(*key, F.struct("band", turned.alias("f")).alias("s")).groupBy(*key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    start = F.struct(F.lit(0).cast("long").alias("now"), F.array().cast("array<struct<band:bigint,was:bigint>>").alias("out"))
    carried = F.aggregate("s", start, lambda acc, s: F.struct(F.get(s["f"], acc["now"].cast("int")).alias("now"), F.array_append(acc["out"], F.struct(s["band"].alias("band"), acc["now"].alias("was"))).alias("out")))
    entered = chain.select(*key, F.explode(carried["out"]).alias("e")).select(*key, "e.band", "e.was")
    state = lambda now, out: F.struct(now.alias("now"), out.alias("out"))
    listed = F.aggregate("runs", state(F.col("was"), F.array().cast("array<struct<at:bigint,alone:boolean>>")), lambda acc, r: state(after(r, acc["now"]), F.concat(acc["out"], breaks(r, acc["now"]))))["out"]
    broken = found.join(entered, [*key, "band"]).select(*key, "band", listed.alias("breaks")).filter(F.size("breaks") > 0)
    opened = tables.filter(F.col(total) > 0).select(*key, F.lit(-1).cast("long").alias("band"), F.array(place(F.lit(0), F.lit(False))).alias("breaks"))
    both = opened.unionByName(broken).join(tables.select(*key, F.col(total).cast("long").alias("__total")), key)
    order = Window.partitionBy(*key).orderBy("band")
    both = both.withColumn("__next", F.coalesce(F.lead(F.get("breaks", F.lit(0))["at"]).over(order), F.col("__total")))
    until = lambda i: F.coalesce(F.get("breaks", i + 1)["at"], F.col("__next"))

    def page(x: Column, end: Column) -> Column:
        return F.struct(x.alias("start"), end.alias("end"))

    def from_break(p: Column, i: Column) -> Column:
        # a break at the very start of the table is followed by another one at the same row
        regular = F.when(p["at"] < until(i), F.transform(F.sequence(p["at"], until(i) - 1, m), lambda x: page(x, F.least(x + m, until(i)))))
        return F.when(p["alone"], F.array(page(p["at"], until(i)))).otherwise(F.coalesce(regular, F.array().cast("array<struct<start:bigint,end:bigint>>")))

    paged = both.withColumn("__pages", F.flatten(F.transform("breaks", from_break)))
    before = F.coalesce(F.sum(F.size("__pages")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flat = paged.withColumn("__before", before).select(*key, "__before", F.posexplode("__pages").alias("__i", "p"))
    return flat.select(*key, (F.col("__before") + F.col("__i")).cast("long").alias("page"), "p.start", "p.end")


def lines_needed(said: Column, capacity: Column) -> Column:
    """Lines that a text takes in cells `capacity` half-widths wide."""
    lines = F.split(said, "\n", -1)
    return F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(1).cast("long"), F.ceil(X.display_width(x) / capacity)))


def row_heights(tables: DataFrame, cells: DataFrame, merges: DataFrame, key: list[str], line: int = 400, unit: int = 114_300) -> DataFrame:
    """(key, row, height) of every row: explicit heights stay, automatic ones are raised to what their cells' texts need.

    tables: key, heights (one a row, 0: automatic), widths (one a column). cells: key, row, col, text. merges: key, pos, top, left, height,
    span; a cell is of the first that holds it, and only its first cell's text counts, over its whole width. What one row needs is a maximum. What several rows need together is shared
    out over their automatic rows, smaller merges first, the remainder to the upper rows: a fold over an array of heights, for
    each group of rows that merges tie together. Needs, heights of single rows and ties are each read twice or more, so they are written once.
    """
    m = merges.withColumn("id", F.struct("pos", "top", "left", "height", "span")).withColumns({"bottom": F.col("top") + F.col("height") - 1, "right": F.col("left") + F.col("span") - 1})
    c = R.within_regions(cells.select(*key, "row", "col", "text"), m, key)
    g = F.col("region")
    c = c.filter(g.isNull() | ((F.col("row") == g["top"]) & (F.col("col") == g["left"]))).join(tables.select(*key, "widths"), key)
    wide = F.aggregate(F.slice("widths", F.col("col") + 1, F.coalesce(g["span"], F.lit(1))), F.lit(0).cast("long"), lambda s, w: s + w)
    need = F.lit(line).cast("long") * lines_needed(F.coalesce("text", F.lit("")), F.greatest(F.floor(wide / unit), F.lit(1).cast("long")))
    c = written(c.select(*key, "row", "col", F.coalesce(g["height"], F.lit(1)).cast("long").alias("rows"), need.alias("need")))
    single = c.filter("rows = 1").groupBy(*key, "row").agg(F.max("need").alias("need"))
    given = tables.select(*key, F.posexplode("heights").alias("row", "given"))
    auto = F.coalesce(F.col("given") <= 0, F.lit(True))
    base = written(given.join(single, [*key, "row"], "left").select(*key, "row", auto.alias("auto"), F.when(auto, F.greatest(F.lit(line), F.coalesce("need", F.lit(0)))).otherwise(F.col("given")).cast("long").alias("height")))
    tied = runs(merges.filter("height > 1").select(*key, F.col("top").alias("first"), (F.col("top") + F.col("height")).alias("last")), key)
    member = written(tied.select(*key, F.col("a").alias("tie"), F.explode(F.sequence(F.col("a") - 1, F.col("b"))).alias("row")))
    of_tie = base.join(member, [*key, "row"]).groupBy(*key, "tie").agg(F.array_sort(F.collect_list(F.struct("row", "height", "auto"))).alias("members"))
    asked = c.filter("rows > 1").join(member, [*key, "row"]).groupBy(*key, "tie").agg(F.array_sort(F.collect_list(F.struct("rows", "row", "col", "need"))).alias("asks"))

    def met(members: Column, ask: Column) -> Column:
        inside = lambda x: (x["row"] >= ask["row"]) & (x["row"] < ask["row"] + ask["rows"])
        has = F.aggregate(F.filter(members, inside), F.lit(0).cast("long"), lambda s, x: s + x["height"])
        free = F.transform(F.filter(members, lambda x: inside(x) & x["auto"]), lambda x: x["row"])
        lack = F.greatest(ask["need"] - has, F.lit(0).cast("long"))
        n = F.greatest(F.size(free), F.lit(1))
        share = lambda x: F.floor(lack / n) + F.when(F.array_position(free, x["row"]) <= lack % n, 1).otherwise(0)
        return F.transform(members, lambda x: F.when(inside(x) & x["auto"], x.withField("height", x["height"] + share(x))).otherwise(x))

    folded = of_tie.join(asked, [*key, "tie"]).select(*key, F.explode(F.aggregate("asks", F.col("members"), met)).alias("x")).select(*key, "x.row", F.col("x.height").alias("raised"))
    return base.join(folded, [*key, "row"], "left").select(*key, F.col("row").cast("long").alias("row"), F.coalesce("raised", "height").alias("height"))
