"""WARC: records of files, and revisit records of the server-not-modified profile resolved to the latest earlier full response.

As-of join by canonical URL: each revisit takes the latest response before it, then its validators are checked against that
response (entity tags by weak comparison if both have one, else Last-Modified dates; with neither, or a mismatch, it stays
unresolved), and the headers that a 304 may update are merged over the stored ones.

The join is two-level, so a URL with a third of all captures is no single task's: captures are reduced to one point a (URL, second),
points are cut into (URL, time bucket) groups; inside a group a running last() finds the response, and where a group begins
with revisits, the last response of an earlier group is carried in from one row a group. Revisits fetch the answer of their
point, and resolved ones their response's payload, by joins whose hot keys are counted and dealt out (`common.fetch`). Only
ids, times and validators are sorted; payloads join at the end.

Ties: at equal times responses come before revisits and, among responses, the larger record id is later (null ids first; equal
ids: the larger hash of the whole record). Null URLs resolve nothing; null times sort before all others. Payloads and headers
may be null. Records that repeat an id are as many captures: N revisits give N rows, whatever repeats. Records of other kinds
are passed over. An empty table gives no rows. Columns beyond those named don't matter unless they are carried.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docengine.llm.common import fetch, written

#: Fields of a 304 that describe its own message and don't update the stored response (RFC 9110, RFC 9111).
NOT_MERGED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
#: What a capture is known by, where there's no payload yet.
SLIM = ("record_id", "url", "at", "kind", "etag", "last_modified")
BEFORE_ALL = -(1 << 62)


RECORD = "path string, pos int, record_id string, url string, at long, kind string, etag string, last_modified string, headers map<string,string>, payload binary, error string"


def members(data: bytes) -> Iterator[bytes]:
    """A file's gzip members one after another, or the file itself if it isn't compressed."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        d = zlib.decompressobj(31)
        out = d.decompress(data)
        if not d.eof:
            raise ValueError("the last gzip member is cut off")
        yield out
        data = d.unused_data


def _fields(block: bytes) -> list[tuple[str, str]]:
    """Header fields in order; folded lines belong to the field before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", block).split(b"\n")
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines if b":" in x)
    return [(name.strip(), value.strip()) for name, _, value in pairs]


def parse_records(data: bytes) -> Iterator[tuple]:
    """(record_id, url, seconds, kind, etag, last_modified, headers, payload) of a WARC file's records, in order.

    headers and payload are those of the HTTP message inside a response or revisit; of other kinds the payload is the whole block.
    """
    for member in members(data):
        at = 0
        while at < len(member):
            if member[at : at + 1] in (b"\r", b"\n"):
                at += 1
                continue
            end = re.compile(rb"\r?\n\r?\n").search(member, at)
            if not member.startswith(b"WARC/", at) or end is None:
                raise ValueError(f"no record at byte {at}")
            said = {k.lower(): v for k, v in _fields(member[at : end.start()])}
            size = int(said["content-length"])
            block, at = member[end.end() : end.end() + size], end.end() + size
            if len(block) < size:
                raise ValueError("the last record is cut off")
            kind, headers = said.get("warc-type", ""), None
            if kind in ("response", "revisit"):
                head, _, rest = block.partition(b"\r\n\r\n") if b"\r\n\r\n" in block else block.partition(b"\n\n")
                headers, block = dict(_fields(head)), rest
            low = {k.lower(): v for k, v in (headers or {}).items()}
            when = said.get("warc-date")
            seconds = int(datetime.fromisoformat(when.replace("Z", "+00:00")).timestamp()) if when else None
            yield said.get("warc-record-id", "").strip("<>") or None, said.get("warc-target-uri", "").strip("<>") or None, seconds, kind, low.get("etag"), low.get("last-modified"), headers, block


def read_warc(files: DataFrame) -> DataFrame:
    """files (path, content), as Spark's binaryFile gives them -> the records of resolve() and materialise(), one row each. A file that
    can't be read to its end gives the records before that, and a last row with the error. A file is one task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
        names = [f.split()[0] for f in RECORD.replace("map<string,string>", "map").split(", ")]

        def out(path: str, rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*[(path, *r) for r in rows])
            return pa.RecordBatch.from_arrays([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], t) for c, t in zip(cols, types)], names=names)

        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, pos = [], 0
                try:
                    for r in parse_records(content.as_py() or b""):
                        rows.append((pos, *r, None))
                        pos += 1
                        if len(rows) >= 500:
                            yield out(path, rows)
                            rows = []
                except (ValueError, KeyError, zlib.error) as e:
                    rows.append((pos, *[None] * 8, f"{type(e).__name__}: {e}"))
                if rows:
                    yield out(path, rows)

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, RECORD)


def write_record(record_id: str, url: str, at: int, kind: str, headers: dict[str, str] | None, payload: bytes | None) -> bytes:
    """A response or revisit as a gzip member."""
    status = "304 Not Modified" if kind == "revisit" else "200 OK"
    message = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in (headers or {}).items()) + "\r\n"
    block = message.encode() + (payload or b"")
    date = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\n" if kind == "revisit" else ""
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{record_id}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {url}\r\n{profile}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", mtime=0)


def canonical_url(url: Column) -> Column:
    """Scheme, www., default ports and fragment dropped, host lower-cased, query parameters sorted, path / if none."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)https?://(www[0-9]*\\.)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_extract(bare, "^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, "\\?(.*)$", 1)
    sorted_query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: x != "")), "&")
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(sorted_query != "", F.concat(F.lit("?"), sorted_query)).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Entries with names in lower case; of names that differ in case only, the last."""
    entries = F.transform(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    return F.filter(entries, lambda e, i: F.array_position(F.reverse(F.transform(entries, lambda x: x["key"])), e["key"]) == F.size(entries) - i)


def merged_headers(stored: Column, fresh: Column) -> Column:
    """stored with what fresh may update; names in lower case, fresh wins. Fields that fresh's Connection names stay out."""
    new, old = _lowered(fresh), _lowered(stored)
    named = F.flatten(F.transform(F.filter(new, lambda e: e["key"] == "connection"), lambda e: F.split(F.lower(F.coalesce(e["value"], F.lit(""))), r"\s*,\s*")))
    updates = F.filter(new, lambda e: ~e["key"].isin(*NOT_MERGED) & ~F.array_contains(F.transform(named, F.trim), e["key"]))
    names = F.transform(updates, lambda e: e["key"])
    return F.map_from_entries(F.concat(F.filter(old, lambda e: ~F.array_contains(names, e["key"])), updates))


def _capture(records: DataFrame) -> Column:
    """64 bits a capture; equal captures share them."""
    headers = [F.array_sort(F.map_entries("headers"))] if "headers" in records.columns else []
    return F.xxhash64(*[F.col(c) for c in (*SLIM, *(["payload"] if "payload" in records.columns else []))], *headers)


def resolve(records: DataFrame, *, bucket_seconds: int = 86_400, carry: tuple[str, ...] = ()) -> DataFrame:
    """records (record_id, url, at timestamp or long seconds, kind 'response' or 'revisit', etag, last_modified) ->
    (record_id, canonical, response_id, verdict, response_key and the columns to carry) for each revisit.

    verdict: resolved, mismatch, unchecked (no validator in common), orphan (no earlier response; response_id null).
    response_key tells captures that share an id apart (see `materialise`).
    """
    slim = records.filter(F.col("kind").isin("response", "revisit")).withColumns({"canonical": canonical_url(F.col("url")), "seconds": F.coalesce(F.col("at").cast("long"), F.lit(BEFORE_ALL)), "key": _capture(records)})
    carried = [F.col(c).alias(f"carry_{c}") for c in carry]
    slim = written(slim.select("record_id", "canonical", "seconds", "kind", "etag", "last_modified", "key", *carried))
    # the latest response of a second: the larger record id, then the larger key
    latest = F.max(F.when(F.col("kind") == "response", F.struct("record_id", "key", "etag", "last_modified")))
    points = slim.filter(F.col("canonical").isNotNull()).groupBy("canonical", "seconds").agg(latest.alias("found")).withColumn("bucket", F.floor(F.col("seconds") / bucket_seconds))
    points = written(points)
    inside = Window.partitionBy("canonical", "bucket").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0)
    last_of = points.groupBy("canonical", "bucket").agg(F.max_by("found", F.when(F.col("found").isNotNull(), F.col("seconds"))).alias("last"))
    earlier = Window.partitionBy("canonical").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = last_of.select(F.col("canonical").alias("c"), F.col("bucket").alias("b"), F.last("last", ignorenulls=True).over(earlier).alias("before"))
    near = points.withColumn("inside", F.last("found", ignorenulls=True).over(inside)).join(before, (F.col("canonical") == F.col("c")) & (F.col("bucket") == F.col("b")), "left")
    answers = near.select(F.struct("canonical", "seconds").alias("point"), F.coalesce("inside", "before").alias("response"))
    revisits = slim.filter("kind = 'revisit'").withColumn("point", F.struct("canonical", "seconds"))
    every = fetch(revisits, answers, "point")
    weak = lambda x: F.regexp_replace(F.trim(x), "^W/", "")
    same = F.when(F.col("etag").isNotNull() & F.col("response.etag").isNotNull(), weak(F.col("etag")) == weak(F.col("response.etag"))).when(F.col("last_modified").isNotNull() & F.col("response.last_modified").isNotNull(), F.col("last_modified") == F.col("response.last_modified"))
    verdict = F.when(F.col("response").isNull(), "orphan").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("mismatch")
    return every.select("record_id", "canonical", F.col("response.record_id").alias("response_id"), verdict.alias("verdict"), F.col("response.key").alias("response_key"), *[F.col(f"carry_{c}").alias(c) for c in carry])


def materialise(records: DataFrame, resolved: DataFrame, *, unresolved: bool = False) -> DataFrame:
    """Resolved revisits as full records: resolved's columns but response_key, headers merged over the response's, its payload.

    records also has headers map<string,string> and payload; resolved carries headers. Asked for, revisits that aren't resolved
    stand too, with null headers and payload.
    """
    stored = records.filter("kind = 'response'").withColumn("key", _capture(records)).groupBy("key").agg(F.first(F.struct("headers", "payload")).alias("stored"))  # equal captures are one
    hits = resolved.withColumn("hit", F.when(F.col("verdict") == "resolved", F.col("response_key")))
    both = fetch(hits if unresolved else hits.filter("hit is not null"), stored.withColumnRenamed("key", "hit"), "hit")
    own = [c for c in resolved.columns if c not in ("headers", "payload", "response_key")]
    return both.select(*own, F.when(F.col("hit").isNotNull(), merged_headers(F.col("stored.headers"), F.col("headers"))).alias("headers"), F.col("stored.payload").alias("payload"))
