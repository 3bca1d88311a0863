"""What the operators of this subpackage share: tokens, row keys, written tables, bounded joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.operators.lineage import drop_written, noted, scratch, shared_dir, written  # noqa: F401  also for the operators here

#: A word: a maximal run of anything but ASCII white space (fixed by the contracts).
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as `bytes.split()` has it.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bucketed(df: DataFrame, n: int, *keys: str, sort: bool = False) -> DataFrame:
    """df as a table in the shared folder, cut into n buckets by the hash of keys: what groups or joins by them doesn't shuffle
    it again. sort: files are in the order of the keys."""
    spark, name = df.sparkSession, f"docengine_{uuid.uuid4().hex}"
    path = noted(f"{shared_dir(spark)}/{name}")
    writer = df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(n, *keys)
    (writer.sortBy(*keys) if sort else writer).saveAsTable(name)
    out = spark.table(name)
    out._written_path = path
    return out


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows, counted no further than that."""
    return df.limit(most + 1).count() <= most


def attach(big: DataFrame, small: DataFrame, key: str, most: int = 50_000, salts: int = 32) -> DataFrame:
    """big left join small on `key` (null equals null), where single keys may hold a third of big's rows.

    small has one row a key. It's broadcast only if a count shows at most `most` rows; beyond that small is repeated
    over `salts` salts and big's rows of a key are dealt out over them.
    """
    small = small.withColumnRenamed(key, "__attach")
    if few(small, most):
        return big.join(F.broadcast(small), big[key].eqNullSafe(small["__attach"]), "left").drop("__attach")
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = big.withColumn("__s", F.pmod(F.xxhash64(*[F.col(c) for c, t in big.dtypes if not t.startswith("map")]), F.lit(salts)).cast("int"))
    return dealt.join(salted, dealt[key].eqNullSafe(salted["__attach"]) & (dealt["__s"] == salted["__salt"]), "left").drop("__attach", "__salt", "__s")


def fetch(big: DataFrame, small: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """big left join small on `key`, small with one row a non-null key; neither side is broadcast whole.

    Keys that more than `most` rows of big hold are counted first; their rows are dealt out over as many salts as it takes, and
    small's row is repeated for each. Null keys fetch nothing and are spread by their rows. big is a table or a written one, so
    that its rows are numbered alike when a lost task is run again.
    """
    hot = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most)
    hot = written(hot.select(key, F.ceil(F.col("__n") / most).cast("int").alias("__salts")))
    row = F.xxhash64(F.monotonically_increasing_id())  # tells equal rows apart
    if hot.limit(1).count():
        big, small = attach(big, hot, key), attach(small, hot, key)
        small = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
        big = big.withColumn("__s", F.when(F.col(key).isNull(), F.pmod(row, F.lit(1 << 20)).cast("int")).otherwise(F.pmod(row, F.coalesce("__salts", F.lit(1))).cast("int"))).drop("__salts")
        return big.join(small.withColumnRenamed(key, "__k"), (F.col(key) == F.col("__k")) & (F.col("__s") == F.col("__salt")), "left").drop("__k", "__s", "__salt")
    small = small.withColumnRenamed(key, "__k")
    present = big.filter(F.col(key).isNotNull()).join(small, F.col(key) == F.col("__k"), "left").drop("__k")
    absent = big.filter(F.col(key).isNull())
    return present.unionByName(absent, allowMissingColumns=True)


def finite_vectors(df: DataFrame, x: str) -> DataFrame:
    """The rows whose array x has components, all of them numbers."""
    return df.filter(F.coalesce((F.size(x) > 0) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e) < float("inf"))), F.lit(False)))


def usual_length(df: DataFrame, x: str) -> int | None:
    """The length that most arrays x have; of two that tie, the longer. None without rows."""
    found = df.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else None


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(x: Column) -> Column:
    """A-Z lower-cased, nothing else; pure ASCII takes the byte-wise path."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER))


def row_key(*cols: str) -> Column:
    """64 bits that tell rows with the same id but other contents apart; rows equal in all of cols share it."""
    return F.xxhash64(*[F.col(c) for c in cols])
