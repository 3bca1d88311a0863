"""PDF text as rows: text operators of plain and Flate streams, under hard limits."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.sources.archive import per_file

LINE = "doc_id string, pos int, text string, error string"


@dataclass(frozen=True)
class Limits:
    """Beyond any of these a file gives no text (fixed values)."""

    source: int = 50 * 2**20
    stream: int = 10 * 2**20
    total: int = 25 * 2**20
    streams: int = 1000


STREAM = re.compile(rb"<<(?P<head>(?:[^>]|>(?!>))*)>>\s*stream\r?\n")
TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[A-Za-z'\"*]+|/[^\s/<>\[\]()]*|[-+.0-9]+", re.S)
ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def inflate(data: bytes, most: int) -> bytes | None:
    """BI3: at most `most` bytes, else None."""
    d = zlib.decompressobj()
    out = d.decompress(data, most + 1)
    return None if len(out) > most or d.unconsumed_tail else out


def _escaped(m: re.Match) -> bytes:
    x = m[1]
    if x[:1].isdigit():
        return bytes([int(x, 8) & 255])
    return b"" if x in (b"\n", b"\r\n") else PLAIN.get(x, x)


def string(raw: bytes, utf16: bool = False) -> str:
    """STR14: a literal or hex string; UTF-16 by its mark, else UTF-8, else Latin-1."""
    if raw[:1] == b"(":
        data = ESCAPE.sub(_escaped, raw[1:-1])
    else:
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    if utf16:
        return data.decode("utf-16-be", "replace")
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _lines(stream: bytes, utf16: bool) -> Iterator[str]:
    """One line a text object, its shown strings in order."""
    for body in re.findall(rb"\bBT\b(.*?)\bET\b", stream, re.S):
        shown: list[str] = []
        operands: list[str] = []
        inside = False
        for m in TOKEN.finditer(body):
            t = m[0]
            if t[:1] in b"(<":
                operands.append(string(t, utf16))
            elif t == b"[":
                operands, inside = [], True
            elif t == b"]":
                operands, inside = ["".join(operands)], False
            elif t in (b"Tj", b"TJ", b"'", b'"') and not inside:
                shown += operands
                operands = []
            elif t.isalpha():
                operands = []
        text = " ".join(" ".join(x for x in shown if x).split())
        if text:
            yield text


def text_lines(data: bytes, limits: Limits = Limits()) -> list[str]:
    """Lines in order of first occurrence."""
    if len(data) > limits.source:
        return []
    streams, total, at = [], 0, 0
    while m := STREAM.search(data, at):
        end = data.find(b"endstream", m.end())
        if end < 0:
            break
        at = end
        if len(streams) >= limits.streams:
            return []
        body = data[m.end() : end].removesuffix(b"\n").removesuffix(b"\r")
        if b"/FlateDecode" in m["head"]:
            try:
                body = inflate(body, limits.stream)
            except zlib.error:
                continue
        if body is None or len(body) > limits.stream:
            return []
        total += len(body)
        if total > limits.total:
            return []
        streams.append(body)
    utf16 = b"/Identity-H" in data or b"/UniGB-UTF16-H" in data
    return list(dict.fromkeys(x for s in streams or [data] for x in _lines(s, utf16)))


def read_pdf(files: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, pos, text); oversize files are filtered before they're read."""

    def rows(name: str, content: bytes) -> Iterator[tuple]:
        for i, x in enumerate(text_lines(content, limits)):
            yield name, i, x, None

    return per_file(files.filter(F.octet_length("content") <= limits.source), rows, LINE)


def pdf_type(has_text, has_images):
    """文本, 扫描 or 混合, from what the pages hold."""
    return F.when(has_text & has_images, "混合").when(has_text, "文本").otherwise("扫描")
