"""The operators bound to the tables: thin queries that derive the contracts' columns, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.common import attach, written
from docengine.llm import bpe, linededup, lm, mixing, packing, pii, quality, sharding, simhash, vectorcodes, vectors, warc, whitening

MIX = {"weights": [5.0, 2.0, 1.0], "share": 1.5, "most": 2.0, "seed": 17}
SHARDS = 24


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def ranks() -> str:
    """The vocabulary that op8 and the pipeline use by default."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text", "source")
    # sizes and keys are taken once; the mix works on (doc_id, source, size, key) from there on
    slim = mixing.slim_table(docs, MIX["seed"])
    out = mixing.mix_slim(slim, **{k: v for k, v in MIX.items() if k != "seed"})
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl made of pages: each page is a response at second page_id, and two revisits of it follow.

    The first comes 40 000 s later by another spelling of the URL; every seventh of them has another entity tag, every eleventh
    none, so its date decides. The second comes 1 s before the page itself, so only an older capture of its URL can match it.
    """
    p = pages.select("page_id", "url", F.sha2("html", 256).alias("digest"), F.col("html").alias("payload"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    full = p.select((F.col("page_id") * 3).alias("record_id"), "url", F.col("page_id").alias("at"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("etag"), tag, F.lit("age"), F.lit("0")).alias("headers"), "payload")
    other = F.when(F.col("page_id") % 7 == 0, F.lit('"changed"')).when(F.col("page_id") % 11 != 0, F.concat(F.lit("W/"), tag))
    first = p.select((F.col("page_id") * 3 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "^https?://", "HTTP://www."), F.lit("#again")).alias("url"), (F.col("page_id") + 40_000).alias("at"), F.lit("revisit").alias("kind"), other.alias("etag"), date.alias("last_modified"), F.create_map(F.lit("age"), F.lit("9"), F.lit("content-length"), F.lit("0")).alias("headers"), F.lit(None).cast("string").alias("payload"))
    second = p.select((F.col("page_id") * 3 + 2).alias("record_id"), "url", (F.col("page_id") - 1).alias("at"), F.lit("revisit").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.create_map(F.lit("age"), F.lit("1")).alias("headers"), F.lit(None).cast("string").alias("payload"))
    return full.unionByName(first).unionByName(second)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the query tells payloads by their digests, so digests are all that it has materialised
    records = captures(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("payload", F.sha2("payload", 256))
    full = warc.materialise(records, written(warc.resolve(records, bucket_seconds=3600, carry=("headers",))), unresolved=True)
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return full.select("record_id", "canonical", "response_id", "verdict", headers.alias("headers"), F.col("payload").alias("payload_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(_docs(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean(_docs(spark, sf_dir, "doc_id", "text"), columns=["doc_id"], with_text=False)
    return found.select("doc_id", *[F.col(f"q_{c}").alias(c) for c in quality.COUNTS], F.col("q_base_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(_docs(spark, sf_dir, "doc_id", "text"))
    return found.select("doc_id", F.col("line_n").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2("line_kept", 256).alias("kept_sha256"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    found = sharding.shard(rows, SHARDS, text="text_crc32")
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_docs(spark, sf_dir, "doc_id", "text"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir, "doc_id", "text"), ranks=ranks())


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_docs(spark, sf_dir, "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    added = F.size("spans") - F.size("base")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.told(F.col("base")), 256).alias("base_sha256"), pii.told(F.col("spans")).alias("spans"), added.cast("long").alias("n_added"), (F.size("spans") > 0).alias("private"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectorcodes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
    rows = written(found.rows)  # summed by label and read again
    by_label = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return attach(rows, by_label, "label").select("vec_id", code.alias("code"), "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    flat = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    n, error, explained = (model.n, model.identity_error, model.explained.tolist()) if model else (0, 0.0, [0.0])
    shares = F.array(*[F.lit(e) for e in explained])
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.encode(_docs(spark, sf_dir, "doc_id", "text"), ranks=ranks, packed=True, columns=["doc_id"])
    both = bpe.decode(coded, ranks=ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_warc_revisits, op3_simhash, op4_quality_rules, op5_line_dedup, op6_shards, op7_lm_score, op8_pack, op9_near_vectors, op10_pii, op11_vector_codes, op12_whitening, op13_byte_bpe)}


W = r"[^\x20\x09-\x0D]+"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _op11(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebook rounds, one after another: every part against every entry of its position."""
    dims = parts * width
    at = lambda i: f"""a{i} AS MATERIALIZED (SELECT r, p, x, arg_min(e, d * {entries} + e) AS e, min(d) AS d FROM (
  SELECT v.r, v.p, v.x, c.e, list_sum(list_transform(range(1, {width + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))::BIGINT AS d FROM v JOIN c{i} c ON c.p = v.p) GROUP BY r, p, x)"""  # noqa: E731
    means = ", ".join(f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, width + 1))
    after = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
  SELECT p, e, CAST([{means}] AS BIGINT[]) AS x FROM a{i} GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"""  # noqa: E731
    steps = ",\n".join(f"{at(i)},\n{after(i)}" for i in range(rounds))
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda e: CAST(floor(4096.0::DOUBLE * e::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
v AS MATERIALIZED (SELECT r, p, q[p * {width} + 1 : p * {width} + {width}] AS x FROM k, (SELECT unnest(range({parts})) AS p)),
c0 AS (SELECT p, r AS e, x FROM v WHERE r < {entries}),
{steps},
{at(rounds)},
o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS digest FROM c{rounds})
SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.digest AS codebooks_sha256 FROM k JOIN o USING (r), h"""


def oracle_sql() -> dict[str, str]:
    op1 = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{W}')) AS BIGINT) AS size, length(coalesce(text, '')) AS chars, md5(coalesce(text, '')) AS told FROM documents),
q AS (SELECT *, CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || told), 1, 13) AS BIGINT) AS draw,
  least(1.0::DOUBLE, greatest(0.25::DOUBLE, size / 200.0::DOUBLE)) * CASE WHEN chars / greatest(size, 1)::DOUBLE BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS quality FROM d),
k AS (SELECT *, -ln((draw::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / quality AS key FROM q),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM s1
  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM s2),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM s3),
r AS (SELECT k.doc_id, k.size, s4.source_size, s4.target, s4.epochs, s4.target - s4.epochs * s4.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN s4 ON k.source IS NOT DISTINCT FROM s4.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN before + size / 2.0::DOUBLE < rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
    op2 = r"""
WITH p AS (SELECT page_id, url, sha256(html) AS digest, '"' || substr(sha256(html), 1, 16) || '"' AS tag, 'day ' || (page_id % 28) AS date FROM pages),
full_ AS (SELECT page_id * 3 AS record_id, url, page_id AS ts, tag AS etag, date AS lm, digest FROM p),
rev AS (SELECT page_id * 3 + 1 AS record_id, regexp_replace(url, '^https?://', 'HTTP://www.') || '#again' AS url, page_id + 40000 AS ts,
  CASE WHEN page_id % 7 = 0 THEN '"changed"' WHEN page_id % 11 <> 0 THEN 'W/' || tag END AS etag, date AS lm, '9' AS age FROM p
  UNION ALL SELECT page_id * 3 + 2, url, page_id - 1, tag, NULL, '1' FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://(www[0-9]*\.)?', '') AS bare FROM (SELECT record_id, url, ts, etag, lm, digest, NULL AS age, TRUE AS is_full FROM full_ UNION ALL SELECT record_id, url, ts, etag, lm, NULL, age, FALSE FROM rev)),
n AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', '') || CASE WHEN regexp_extract(bare, '^[^/?]*([^?]*)', 1) = '' THEN '/' ELSE regexp_extract(bare, '^[^/?]*([^?]*)', 1) END
  || CASE WHEN regexp_extract(bare, '\?(.*)$', 1) = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(regexp_extract(bare, '\?(.*)$', 1), '&')), '&') END AS canonical FROM c),
j AS (SELECT r.record_id, r.canonical, r.etag, r.lm, r.age, f.record_id AS fid, f.etag AS fetag, f.lm AS flm, f.digest,
  row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS rn
  FROM n r LEFT JOIN n f ON f.is_full AND f.canonical = r.canonical AND f.ts <= r.ts WHERE NOT r.is_full),
v AS (SELECT *, CASE WHEN fid IS NULL THEN 'orphan' WHEN etag IS NOT NULL AND fetag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(fetag, '^W/', '') THEN 'resolved' ELSE 'mismatch' END
  WHEN lm IS NULL OR flm IS NULL THEN 'unchecked' WHEN lm = flm THEN 'resolved' ELSE 'mismatch' END AS verdict FROM j WHERE rn = 1)
SELECT record_id, canonical, fid AS response_id, verdict, CASE WHEN verdict = 'resolved' THEN 'age=' || age || ';content-type=text/html;etag=' || fetag END AS headers,
  CASE WHEN verdict = 'resolved' THEN digest END AS payload_sha256 FROM v"""
    notice = quality.NOTICE.pattern.replace("'", "''")
    op4 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
l AS (SELECT *, regexp_extract_all(line, '{W}') AS w, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS s FROM l0),
f AS (SELECT r, len(w) AS n, row_number() OVER (PARTITION BY r, line ORDER BY pos) > 1 AS again,
  10 * s > length(line) OR (s > 0 AND len(w) >= 3 AND 3 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]$'))) > len(w))
  OR (len(w) >= 3 AND 10 * len(list_filter(w, lambda x: list_contains(['|', '>', '»', '·', '/', '-'], x))) >= len(w))
  OR (len(w) >= 10 AND 2 * len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) > len(w))
  OR (len(w) >= 5 AND 2 * len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]'))) > len(w))
  OR (len(w) <= {quality.NOTICE_WORDS} AND regexp_matches(line, '{notice}', 'i'))
  OR (len(w) >= 10 AND NOT regexp_matches(line, '[.!?…。？！]')) AS fails FROM l WHERE len(w) > 0),
a AS (SELECT r, sum(CASE WHEN fails THEN n ELSE 0 END) AS lost, count(*) FILTER (WHERE again) AS dup FROM f GROUP BY r),
x AS (SELECT r, unnest(regexp_extract_all(t, '{W}')) AS w, unnest(range(len(regexp_extract_all(t, '{W}')))) AS i FROM d),
g AS (SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM x WINDOW o AS (PARTITION BY r ORDER BY i)),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w2, w3) AS k FROM g WHERE w3 IS NOT NULL),
c AS (SELECT r, count(DISTINCT i + j) AS covered FROM h, (SELECT unnest([0, 1, 2]) AS j) WHERE k > 1 GROUP BY r),
b AS (SELECT d.doc_id, CAST(len(regexp_extract_all(t, '{W}')) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN a USING (r) LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= n_words AS kept FROM b"""
    op5 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, row_number() OVER () AS r FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r"""
    op9 = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
c(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.a, p.b FROM c JOIN p ON c.b = p.a),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a)
SELECT v.vec_id, CAST((SELECT count(*) FROM p WHERE p.a = v.vec_id) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v JOIN m ON m.a = v.vec_id"""
    return {"op11_vector_codes": _op11(), "op1_mix_sources": op1, "op2_warc_revisits": op2, "op4_quality_rules": op4, "op5_line_dedup": op5, "op9_near_vectors": op9}
