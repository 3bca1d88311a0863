"""Marker terms from a table, found as parts of page texts (E9): any number of terms, through an index of the terms alone.

Texts and terms are cut behind every blank, so a token is what stands up to a blank, with it. A term of one token is part of a token; of a term of two the
first ends a token and the second begins the next; of more tokens, the inner ones are whole tokens of the text. So pages look up the ends of their tokens,
what follows them, grams for single words, and whole tokens for the rest, all by equality; only terms of three tokens or more, looked up by the inner one that
stands in fewest places, are then looked for in the text itself. The index grows with the terms, not with the texts or their vocabulary: it travels to the
pages, neither texts nor candidates are shuffled, and no page meets a term that it has no such token of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.functions.nulls import col
from docengine.operators.lineage import written

GRAM = 4
#: White space as Unicode has it, as a class that is quick to match.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BEHIND = f"(?<=[{SPACE}])"
#: Entries of the index (term, marker) that every task holds at once; a larger index takes more passes over the pages.
MOST = 500_000


def _tokens(x: Column) -> Column:
    return F.split(x, BEHIND)


def page_text(*parts: Column | str) -> Column:
    """What terms are looked for in: a page's title, kind and text, in lower case."""
    return F.lower(F.array_join(F.array(*[F.coalesce(col(p), F.lit("")) for p in parts]), " "))


def found(pages: DataFrame, terms: DataFrame, key: list[str], text: str = "text", most: int = MOST) -> DataFrame:
    """(key, marker) of terms that stand in the pages' texts, cases ignored.

    pages: key, text. terms: marker, term. A row per pair, however often terms or pages repeat. Null texts hold nothing; terms without a letter or sign stand nowhere.
    """
    t = terms.select("marker", F.lower("term").alias("term")).distinct().filter(F.col("term").rlike(f"[^{SPACE}]"))
    told = t.groupBy("term").agg(F.collect_set("marker").alias("markers")).withColumn("t", F.array_remove(_tokens(F.col("term")), ""))  # behind a last blank stands nothing
    p = pages.select(*key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("__low")).withColumn("__t", _tokens(F.col("__low")))
    # three tokens or more: the inner one that stands in fewest places; one that stands nowhere betrays that the term doesn't
    inner = written(told.filter(F.size("t") > 2).select("term", F.explode(F.array_distinct(F.slice("t", F.lit(2), F.size("t") - 2))).alias("token")))
    places = p.select(F.explode_outer("__t").alias("token")).join(inner.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = inner.join(places, "token", "left").groupBy("term").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("rarest"), F.min(F.coalesce("n", F.lit(0))).alias("n")).filter("n > 0").drop("n")
    # one token is looked up by its first characters, two by the first of them, then by the whole
    key_of = F.when(F.size("t") == 1, F.left("term", F.lit(GRAM))).when(F.size("t") == 2, F.get("t", F.lit(0))).otherwise(F.col("rarest"))
    index = written(told.join(rarest, "term", "left").select("term", "markers", F.least(F.size("t"), F.lit(3)).alias("kind"), key_of.alias("piece")).filter("piece is not null"))
    sizes = index.agg(F.sum(F.size("markers") + 1), F.collect_set(F.when(F.col("kind") == 1, F.length("piece"))), F.collect_set(F.when(F.col("kind") == 2, F.length("piece")))).first()
    passes, grams = max(1, -(-(sizes[0] or 0) // most)), sorted(sizes[1])  # grams: GRAM at most
    shortest, longest = min(sizes[2], default=1), max(sizes[2], default=0)
    whole = p.select(*key, F.explode(F.array_distinct("__t")).alias("__a")).withColumn("__n", F.length("__a"))
    said = p.select(*key, "__t", F.posexplode_outer("__t").alias("__i", "__a")).select(*key, "__a", F.length("__a").alias("__n"), F.get("__t", F.col("__i") + 1).alias("__b"))
    hashed = lambda x: F.xxhash64(x).alias("__h")  # noqa: E731  lookups by a number are the quick ones; texts decide

    def met(i: int) -> list[DataFrame]:
        own = lambda kind: index.filter((F.pmod(F.xxhash64("term"), F.lit(passes)) == i) & (F.col("kind") == kind))
        at = whole.select(*key, "__a", "__n", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__at"))
        at = at.select(*key, "__a", "__n", "__at", F.explode(F.array(*map(F.lit, grams)).cast("array<int>")).alias("__size")).filter("__at + __size <= __n + 1")
        at = at.select(*key, "__a", hashed(F.substring(F.col("__a"), F.col("__at"), F.col("__size"))))
        one = at.join(F.broadcast(own(1).select(hashed("piece"), "term", "markers")), "__h").filter(F.contains("__a", "term"))
        ends = said.filter(F.col("__b").isNotNull() & (F.col("__n") >= shortest)).select(*key, "__a", "__b", F.explode(F.sequence(F.lit(shortest), F.least("__n", F.lit(max(shortest, longest))))).alias("__size"))
        next_ = F.substring("term", F.length("piece") + 1, F.lit(1))  # an end is looked up with the character that follows: fewer meet
        firsts = own(2).groupBy("piece", F.xxhash64("piece", next_).alias("__h")).agg(F.collect_set(F.length("term") - F.length("piece")).alias("lengths"))
        ends = ends.select(*key, "__a", "__b", F.xxhash64(F.right("__a", "__size"), F.left("__b", F.lit(1))).alias("__h")).join(F.broadcast(firsts), "__h").filter(F.endswith("__a", "piece"))
        ends = ends.select(*key, "piece", "__b", F.explode("lengths").alias("__size")).filter(F.col("__size") <= F.length("__b"))
        two = ends.select(*key, F.concat("piece", F.left("__b", F.col("__size"))).alias("__said")).withColumn("__h", hashed("__said"))
        two = two.join(F.broadcast(own(2).select(hashed("term"), "term", "markers")), "__h").filter("__said = term")
        more = p.select(*key, "__low", F.explode(F.array_distinct("__t")).alias("piece")).join(F.broadcast(own(3).select("piece", "term", "markers")), "piece").filter(F.contains("__low", "term"))
        return [one, two, more]

    hits = [h.select(*key, F.explode("markers").alias("marker")) for i in range(passes) for h in met(i)]
    return reduce(DataFrame.unionByName, hits).distinct()


def attached(pages: DataFrame, terms: DataFrame, flagged: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, page, marker): a file's flagged markers on the pages that hold their terms, and all of them on its first page.

    flagged: (doc, marker). Terms of markers that no file is flagged with are not looked for.
    """
    f = flagged.select(doc, "marker").distinct()
    some = pages.join(f.select(doc).distinct(), doc, "left_semi")
    on_pages = found(some, terms.join(f.select("marker").distinct(), "marker", "left_semi"), [doc, page], text).join(f, [doc, "marker"], "left_semi")
    first = pages.groupBy(doc).agg(F.min(page).alias(page)).join(f, doc)
    return on_pages.select(doc, page, "marker").unionByName(first.select(doc, page, "marker")).distinct()
