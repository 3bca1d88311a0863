"""PII: pattern spans, and information-theoretic sanitisation of the terms that give them away. DataFrame operations only.

Base spans (email, ip, card, phone) come from regular expressions; positions are code points, found by splitting the text at the
pattern and summing lengths. The patterns are written so that no text, however long, makes them quadratic: runs are
possessive and begin only where a run begins or the last match ended; sums before each match are taken chunk by chunk.

Secrets: runs of 24 or more characters of keys (outside e-mail addresses) whose own information, the sum over their characters of
log2(length/occurrences), is `min_secret_bits` or more and which go from letters to digits or back six times; they're spans too.

Disclosure: an entity is a protected span's value, or its kind as such. For every entity and every term (a run of `min_letters`
letters or more outside addresses and secrets) within `reach` code points of it in the same text, the corpus gives
p(entity | term) = texts in which the term stands by the entity / texts that hold the term at all, and the information gained,
log2(p(entity | term)/p(entity)). A term that stands by an entity in at least `min_texts` different texts, with p >= `min_share`
and at least `min_bits` gained, discloses it: its occurrences, in any document, become `term` spans, generalised to [TERM] in
the sanitised text. Equal texts count once, so a group of copies discloses nothing by its size. Base spans stay as they are.

Null or empty texts have no spans. Nulls in doc_id are values. Repeated rows get equal results. Empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.common import attach, few, row_key, written

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
_LABEL = r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
SECRET = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"
#: A secret has a letter beside a digit; few texts have one at all.
SECRET_HINT = r"[0-9][A-Za-z]|[A-Za-z][0-9]"
SECRET_RANK, TERM_RANK = len(KINDS), len(KINDS) + 1
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(x: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element the merged elements before it (0: none), in n^(4/3) steps: chunk by chunk."""
    fold = lambda part: F.aggregate(part, F.lit(0), lambda a, b: merge(a, b))

    def chunked(x: Column) -> Column:
        width = (F.ceil(F.cbrt(F.size(x) * 2)) + 1).cast("int")
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / w).cast("int")), lambda c: F.slice(x, c * w + 1, w)))

    def inside(chunks: Column) -> Column:
        heads = let(F.transform(chunks, fold), lambda t: F.transform(t, lambda _, c: fold(F.slice(t, F.lit(1), c))))
        return let(heads, lambda h: F.flatten(F.transform(chunks, lambda part, c: F.transform(part, lambda _, i: merge(F.get(h, c), fold(F.slice(part, F.lit(1), i)))))))

    return let(x, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(chunked(x), inside)))


def _matches(text: Column, pattern: Column, rank: int, kind: str, valid) -> Column:
    """Spans of the pattern in text whose value is valid. split() and regexp_extract_all() walk the same matches."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("g"))

    def placed(p: Column) -> Column:
        steps = F.transform(p, lambda z: z["g"] + F.length(z["m"]))
        return let(before(steps, lambda a, b: a + b), lambda at: F.transform(p, lambda z, i: F.struct((F.get(at, i) + z["g"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (F.get(at, i) + z["g"] + F.length(z["m"])).alias("end"), z["m"].alias("value"))))

    return F.filter(let(F.filter(pairs, lambda z: z["m"].isNotNull()), placed), valid).cast(SPAN)


CUT = 1024


def cut(text: Column) -> Column:
    """text in pieces of CUT code points, so that a place in it is reached without walking there from its start."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))


def part(pieces: Column, a: Column, b: Column) -> Column:
    """The text from a to b."""
    first = F.floor(a / CUT).cast("int")
    some = F.slice(pieces, first + 1, F.floor((b - 1) / CUT).cast("int") - first + 1)
    return F.when(b > a, F.substring(F.array_join(some, ""), a % CUT + 1, b - a)).otherwise("")


def _masked(text: Column, pattern: str, valid) -> Column:
    """text with its valid matches overwritten, so that positions stay."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    over = lambda m: F.when(valid(F.struct(m.alias("value"))), F.repeat(F.lit("\x01"), F.length(m))).otherwise(m)
    pieces = F.split(text, pattern, -1)
    return let(found, lambda f: F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(over(F.get(f, i)), F.lit("")))), ""))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + add(i)) % 10 == 0


def _part_ok(part: Column) -> Column:
    bare = F.regexp_replace(part, r"^0+(?=[0-9])", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


VALID = {
    "email": lambda s: F.lit(True),
    "ip": lambda s: F.forall(F.split(s["value"], r"\."), _part_ok),
    "card": lambda s: F.when(F.length(_digits(s["value"])).between(14, 19), _luhn(_digits(s["value"]))).otherwise(False),
    "phone": lambda s: F.length(_digits(s["value"])).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    t = F.coalesce(text, F.lit(""))
    none = F.array().cast(SPAN)
    each = [F.when(t.contains("@") if k == "email" else t.rlike(HINTS[k]), _matches(t, F.lit(PATTERNS[k]), i, k, VALID[k])).otherwise(none) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*each))


def secret_bits(value: Column) -> Column:
    """Information of the value by its own characters."""
    n = F.length(value)
    count = lambda c: (n - F.length(F.replace(value, c, F.lit("")))).cast("double")
    return F.aggregate(F.array_distinct(F.split(value, "")), F.lit(0.0), lambda s, c: s + F.when(F.length(c) > 0, count(c) * F.log2(n / count(c))).otherwise(0.0))


def _secret(min_bits: float):
    turns = lambda s: F.regexp_count(s["value"], F.lit("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"))
    return lambda s: (turns(s) >= 6) & (secret_bits(s["value"]) >= min_bits)


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _letters(n: int) -> str:
    return rf"\p{{L}}{{{n},}}+"  # possessive: a run is matched whole from its first letter, or not at all


def _among(rows: DataFrame, small: DataFrame, key: str, most: int = 200_000, salts: int = 32) -> DataFrame:
    """rows whose key is in small (no repeats): broadcast only if a count shows few; else rows of a hot key are dealt over salts."""
    small = small.select(F.col(key).alias("__k"))
    if few(small, most):
        return rows.join(F.broadcast(small), F.col(key) == F.col("__k"), "left_semi")
    dealt = rows.withColumn("__s", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return dealt.join(small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), (F.col(key) == F.col("__k")) & (F.col("__s") == F.col("__salt")), "left_semi").drop("__s")


def disclosing(words: DataFrame, spans: DataFrame, texts: int, *, min_letters: int, min_texts: int, min_share: float, min_bits: float, in_plan: int = 10_000) -> DataFrame:
    """(__id, __row, term): where the terms that disclose an entity stand.

    words: __id, __row, __same (hash of the text) and its terms; spans: __same, around (kind, value, near); texts: different texts.
    """
    e = spans.select("__same", F.explode("around").alias("e")).select("__same", "e.*")
    e = e.withColumn("entity", F.explode(F.array(F.concat_ws(":", "kind", "value"), F.col("kind"))))
    by = written(e.select("__same", "entity", F.explode(F.array_distinct(F.regexp_extract_all("near", F.lit(_letters(min_letters)), F.lit(0)))).alias("term")).distinct())
    # texts that hold the term are at least those that hold it by any entity: what falls short of the share even so is out
    # before the corpus is searched, and with it every common word
    often = written(by.groupBy("term", "entity").agg(F.count(F.lit(1)).alias("n_te")).filter(F.col("n_te") >= min_texts))
    kinds = _among(by, often.select("term").distinct(), "term").select("term", "__same").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_tw"))
    together = written(attach(often, kinds, "term").filter(F.col("n_te") >= min_share * F.col("n_tw")).select("term", "entity", "n_te"))
    entities = _among(e.select("__same", "entity").distinct(), together.select("entity").distinct(), "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    candidates = together.select("term").distinct()
    if few(candidates, in_plan):  # they travel in the plan, so a text's other words aren't even told apart
        known = ", ".join(f"'{r['term']}'" for r in candidates.collect())  # letters only
        words = words.withColumn("terms", F.expr(f"filter(terms, t -> t IN ({known}))") if known else F.array().cast("array<string>"))
    each = words.select("__id", "__row", "__same", F.explode(F.array_distinct("terms")).alias("term"))
    stands = written(_among(each, candidates, "term"))
    holds = stands.select("term", "__same").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    judged = attach(attach(together, holds, "term"), entities, "entity")
    share = F.col("n_te") / F.col("n_t")
    terms = judged.filter((share >= min_share) & (F.log2(share * F.lit(float(texts)) / F.col("n_e")) >= min_bits)).select("term").distinct()
    return _among(stands.select("__id", "__row", "term"), written(terms), "term").distinct()


def find(docs: DataFrame, *, reach: int = 80, min_letters: int = 3, min_texts: int = 3, min_share: float = 0.5, min_bits: float = 4.0, min_secret_bits: float = 80.0, bound: int = 200_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, __row, base, spans): one row a row of docs; join on doc_id and __row, the hash of both, or use sanitise()."""
    given = docs.select(F.col(doc_id).alias("__id"), F.col(text).cast("string").alias("text")).select("__id", row_key("__id", "text").alias("__row"), F.xxhash64("text").alias("__same"), F.coalesce("text", F.lit("")).alias("text"))
    secret = _secret(min_secret_bits)
    bare = F.when(F.col("text").contains("@"), _masked(F.col("text"), PATTERNS["email"], VALID["email"])).otherwise(F.col("text"))
    given = given.withColumn("bare", bare)
    keyed = F.col("bare").rlike(SECRET_HINT) & F.col("bare").rlike(SECRET)
    given = given.withColumn("masked", F.when(keyed, _masked(F.col("bare"), SECRET, secret)).otherwise(F.col("bare")))
    secrets = F.when(keyed, _matches(F.col("bare"), F.lit(SECRET), SECRET_RANK, "secret", secret)).otherwise(F.array().cast(SPAN))
    lo = lambda s: F.greatest(s["start"] - reach, F.lit(0))

    def near(s: Column, pieces: Column, n: Column) -> Column:
        """Both surroundings without the words that the reach cuts through."""
        left = part(pieces, lo(s), s["start"])
        right = part(pieces, s["end"], F.least(s["end"] + reach, n))
        return F.concat(F.when(lo(s) > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left), F.lit(" "), F.when(s["end"] + reach <= n, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right))

    based = given.withColumns({"base": base_spans(F.col("text")), "secrets": secrets})
    all_ = F.concat("base", "secrets")
    told_of = let(cut(F.col("masked")), lambda p: let(F.length("masked"), lambda n: F.transform(all_, lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), near(s, p, n).alias("near")))))
    around = F.when(F.size(all_) > 0, told_of)
    slim = written(based.select("__id", "__row", "__same", "base", "secrets", around.alias("around")))
    texts = slim.select("__same").distinct().count()
    words = given.select("__id", "__row", "__same", F.regexp_extract_all(F.col("masked"), F.lit(_letters(min_letters)), F.lit(0)).alias("terms"))
    stands = disclosing(words, slim, texts, min_letters=min_letters, min_texts=min_texts, min_share=min_share, min_bits=min_bits)
    hits = written(stands.groupBy(F.col("__id").alias("hid"), F.col("__row").alias("hrow")).agg(F.sort_array(F.collect_set("term")).alias("terms")))
    # rows equal in id and text are one hit. Few hits are broadcast after a count, so no text crosses a shuffle
    scarce = few(hits, bound)
    side = F.broadcast(hits) if scarce else hits
    at = given.join(side, (F.col("__row") == F.col("hrow")) & F.col("__id").eqNullSafe(F.col("hid"))).select("__id", "__row", "masked", "terms")
    pattern = lambda term: F.concat(F.lit(r"(?<!\p{L})"), term, F.lit(r"(?!\p{L})"))
    found = F.array_sort(F.flatten(F.transform("terms", lambda t: _matches(F.col("masked"), pattern(t), TERM_RANK, "term", lambda s: F.lit(True)))))
    extra = written(at.select(F.col("__id").alias("xid"), F.col("__row").alias("xrow"), found.alias("found")).dropDuplicates(["xid", "xrow"]))
    both = slim.select("__id", "__row", "base", "secrets").join(F.broadcast(extra) if scarce else extra, (F.col("__row") == F.col("xrow")) & F.col("__id").eqNullSafe(F.col("xid")), "left")
    return both.select(F.col("__id").alias("doc_id"), "__row", "base", F.array_sort(F.concat("base", "secrets", F.coalesce("found", F.array().cast(SPAN)))).alias("spans"))


def sanitise(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with pii_text: base spans become [EMAIL] and the like, disclosing terms [TERM]; overlapping spans the first's label."""
    docs = docs.drop("pii_text")  # an input column of this name gives way
    found = find(docs, doc_id=doc_id, text=text, **options).dropDuplicates(["doc_id", "__row"]).select(F.col("doc_id").alias("__fid"), F.col("__row").alias("__frow"), "spans")
    rows = docs.withColumn("__row", F.xxhash64(F.col(doc_id), F.col(text).cast("string")))
    both = rows.join(found, (F.col("__row") == F.col("__frow")) & rows[doc_id].eqNullSafe(F.col("__fid")), "left")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))

    ends = before(F.transform("spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))  # where the spans before each end
    both = both.withColumn("__ends", ends)
    upto = lambda i: F.get("__ends", i)
    n = F.length(t)
    kept = lambda p, s, i: F.when(s["start"] >= upto(i), F.concat(part(p, upto(i), s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
    clean = let(cut(t), lambda p: F.concat(F.array_join(F.transform("spans", lambda s, i: kept(p, s, i)), ""), part(p, F.array_max(F.transform("spans", lambda s: s["end"])), n)))
    return both.select(*[F.col(c) for c in docs.columns], F.when(F.size("spans") > 0, clean).otherwise(t).alias("pii_text"))
