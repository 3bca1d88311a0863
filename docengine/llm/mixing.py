"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets, in DataFrame operations only.

A source's target is its share of `share` times all words, at most `most` times its own words; what is cut off is
shared again by weight. The target's whole epochs take every document; the rest is a fractional sample: exponential keys
-ln(u)/quality, ascending, prefix sums of sizes up to the rest. u comes from md5(seed:doc_id:md5(text)), so reruns agree.

The prefix sum never sorts a whole source: keys are cut into 40-bit ranks, sizes are summed by (source, rank digit), and
only the digit in which the budget ends is refined (1024 times narrower each level) until few rows are left to sort.

Null texts have size 0, a null source is a source (last in order), an empty table gives an empty mix. Null and repeated ids are told apart by
their texts; rows that repeat both share a key: the plan takes as many of them as it needs, by their place in the written slim table (`mix_slim`), while
`mix`, whose rows have no place, takes them together. Columns of the input pass through; the operator's own are
named by `prefix` and replace none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import attach, n_words, written

RANK_BITS, DIGIT = 40, 10


def text_quality(size: Column, chars: Column) -> Column:
    """Default quality weight in [1/8, 1]: short texts and texts of odd mean word length weigh less."""
    length = F.least(F.lit(1.0), F.greatest(F.lit(0.25), size / F.lit(200.0)))
    mean = chars / F.greatest(size, F.lit(1))
    return length * F.when(mean.between(3.0, 12.0), 1.0).otherwise(0.5)


def sample_key(doc_id: Column, text: Column, quality: Column, seed: int) -> Column:
    told = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    draw = F.conv(F.substring(F.md5(told), 1, 13), 16, 10).cast("long")
    u = (draw.cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / quality


def _rank(key: Column) -> Column:
    return F.least(F.floor(key / (1 + key) * F.lit(float(1 << RANK_BITS))).cast("long"), F.lit((1 << RANK_BITS) - 1))


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sources (source, source_size): adds target, epochs and rest. One row a source, so one sorted window is enough.

    Water filling: with sources by rising cap/weight, the level of each prefix is (all - caps before)/(weights left); it
    rises while sources are capped and falls after, so its maximum is the level that holds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level).withColumn("target", F.least("cap", F.col("weight") * F.max("level").over(whole)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return s.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select("source", "source_size", "target", "epochs", "rest")


def cuts(slim: DataFrame, plan: DataFrame, rows_a_cut: int = 2_000) -> DataFrame:
    """plan with `cut` and `cut_place`: the last key that the fractional sample of each source takes (null: none), and the last place of those with it.

    slim: source, size, key, place. A document is taken if the sizes before it plus half its own stay below the rest, so the
    sample ends within half a document of it.
    """
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    now = written(plan.withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(1 << RANK_BITS).cast("long"), "base": F.lit(0).cast("long")}))
    slim = slim if "place" in slim.columns else slim.withColumn("place", F.lit(0))
    ranked = slim.withColumn("rank", _rank(F.col("key")))

    def inside(cols: list[str]) -> DataFrame:
        p = now.select(F.col("source").alias("__src"), "lo", "hi", "base", "rest")
        rows = attach(ranked, p.withColumnRenamed("__src", "source"), "source")
        return rows.filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(*cols)

    shift = RANK_BITS
    largest = ranked.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    while largest > rows_a_cut and shift >= DIGIT:
        shift -= DIGIT
        sums = inside(["source", "rank", "size", "base", "rest"]).groupBy("source", F.shiftright("rank", shift).alias("digit")).agg(F.sum("size").alias("size"), F.first("base").alias("base"), F.first("rest").alias("rest"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("digit")) + F.col("base")
        ends = sums.withColumn("upto", upto).filter(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("digit", (F.col("upto") - F.col("size")).alias("before"))).alias("e"))
        ends = ends.select(F.col("source").alias("__src"), "e")
        wide = now.join(ends, now["source"].eqNullSafe(ends["__src"]), "left")
        # no digit ends beyond the rest: the range above all ranks is left, so every document of the old range is taken
        now = written(wide.select("source", "source_size", "target", "epochs", "rest", F.coalesce(F.shiftleft(F.col("e.digit"), shift), F.col("hi")).alias("lo"), F.coalesce(F.shiftleft(F.col("e.digit") + 1, shift), F.col("hi")).alias("hi"), F.coalesce(F.col("e.before"), F.col("base")).alias("base")))
        largest = inside(["source"]).groupBy("source").count().agg(F.max("count")).first()[0] or 0
    ordered = Window.partitionBy("source").orderBy("key", "size", "place").rowsBetween(Window.unboundedPreceding, -1)
    rows = inside(["source", "size", "key", "place", "base", "rest"]).withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    last = rows.filter(F.col("before") + F.col("size") / 2 < F.col("rest")).groupBy("source").agg(F.max(F.struct("key", "place")).alias("last")).select(F.col("source").alias("__src"), "last")
    full = now.join(last, now["source"].eqNullSafe(last["__src"]), "left")
    return full.select("source", "source_size", "target", "epochs", "rest", "lo", F.col("last.key").alias("cut"), F.col("last.place").alias("cut_place"))


def _keyed(docs: DataFrame, doc_id: str, text: str, seed: int, quality: Column | None) -> DataFrame:
    """docs with __size and __key."""
    sized = docs.withColumn("__size", n_words(F.col(text)))
    weight = text_quality(F.col("__size"), F.coalesce(F.length(text), F.lit(0))) if quality is None else quality
    return sized.withColumn("__key", sample_key(F.col(doc_id), F.col(text), weight, seed))


def slim_table(docs: DataFrame, seed: int, quality: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, key, place), written: all that the plan needs, without the texts."""
    return written(_keyed(docs, doc_id, text, seed, quality).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key"), F.monotonically_increasing_id().alias("place")))


def _planned(rows: DataFrame, slim: DataFrame, source: str, key: str, place: Column, weights: list[float], share: float, most: float) -> DataFrame:
    """rows with __p_source_size, __p_target and __copies."""
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(cuts(slim, written(targets(sources, weights, share, most))))
    plan = plan.select(*[F.col(c).alias(f"__p_{c}") for c in plan.columns])
    rows = attach(rows.withColumn("__p_source", F.col(source)), plan, "__p_source")
    upto = (F.col(key) < F.col("__p_cut")) | ((F.col(key) == F.col("__p_cut")) & (place <= F.col("__p_cut_place")))
    taken = (_rank(F.col(key)) < F.col("__p_lo")) | F.coalesce(upto, F.lit(False))
    return rows.withColumn("__copies", (F.col("__p_epochs") + F.when(taken, 1).otherwise(0)).cast("long"))


def mix_slim(slim: DataFrame, *, weights: list[float], share: float, most: float = 2.0) -> DataFrame:
    """slim with source_size, target and copies (how often the mix takes the row)."""
    out = _planned(slim, slim, "source", "key", F.col("place"), weights, share, most)
    return out.select(*slim.columns, F.col("__p_source_size").alias("source_size"), F.col("__p_target").alias("target"), F.col("__copies").alias("copies"))


def mix(docs: DataFrame, *, weights: list[float], share: float, most: float = 2.0, seed: int = 17, quality: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", prefix: str = "mix_") -> DataFrame:
    """docs with {prefix}size, {prefix}source_size, {prefix}target and {prefix}copies; input columns of these names give way."""
    slim = slim_table(docs, seed, quality, doc_id, text, source)
    out = _planned(_keyed(docs, doc_id, text, seed, quality), slim, source, "__key", F.lit(0), weights, share, most)
    own = {f"{prefix}size": "__size", f"{prefix}source_size": "__p_source_size", f"{prefix}target": "__p_target", f"{prefix}copies": "__copies"}
    return out.select(*[c for c in docs.columns if c not in own], *[F.col(c).alias(k) for k, c in own.items()])


def repeated(mixed: DataFrame, columns: list[str], prefix: str = "mix_") -> DataFrame:
    """The mix itself: each row as often as it is taken, with `columns` only."""
    some = mixed.filter(F.col(f"{prefix}copies") > 0)
    return some.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{prefix}copies")))).select(*columns)
