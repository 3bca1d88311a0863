"""Image headers as rows: size and kind without decoding a pixel. PNG, GIF and BMP also have a pure expression in
docengine.functions.binary; JPEG, TIFF and SVG need a walk."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame

from docengine.sources.archive import per_file

SIZE = "doc_id string, kind string, width int, height int, error string"
#: Pixels in one of each unit at 96 to the inch (fixed values).
UNITS = {"": 1.0, "px": 1.0, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "pt": 96 / 72, "pc": 16.0}
#: Frame headers among JPEG markers (fixed values).
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}


def jpeg(data: bytes) -> tuple[int, int] | None:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 2
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        if marker in FRAMES:
            if at + 9 > len(data):
                return None
            h, w = struct.unpack_from(">HH", data, at + 5)
            return (w, h) if w and h else None
        at += 2 + size
    return None


def tiff(data: bytes) -> tuple[int, int] | None:
    """The first directory's width and height; only single SHORT or LONG values count."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    try:
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        found = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            if tag in (256, 257) and count == 1 and kind in (3, 4):
                found[tag] = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", data, at + 10 + 12 * i)[0]
    except (struct.error, TypeError):
        return None
    return (found[256], found[257]) if found.get(256) and found.get(257) else None


def _pixels(length: str | None) -> float | None:
    m = re.fullmatch(r"\s*([0-9]*\.?[0-9]+)\s*(px|in|cm|mm|pt|pc)?\s*", length or "")
    return float(m[1]) * UNITS[m[2] or ""] if m else None


def svg(data: bytes) -> tuple[int, int] | None:
    """width and height, or the view box for what's missing or relative; documents with a DTD aren't read."""
    if b"<!DOCTYPE" in data or b"<!ENTITY" in data:
        return None
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return None
    if root.tag.rsplit("}", 1)[-1] != "svg":
        return None
    w, h = _pixels(root.get("width")), _pixels(root.get("height"))
    box = re.split(r"[\s,]+", (root.get("viewBox") or "").strip())
    if len(box) == 4 and (w is None or h is None):
        try:
            bw, bh = float(box[2]), float(box[3])
        except ValueError:
            return None
        if bw <= 0 or bh <= 0:
            return None
        w, h = (bw, bh) if w is None and h is None else (w if w is not None else h * bw / bh, h if h is not None else w * bh / bw)
    return (round(w), round(h)) if w and h and round(w) > 0 and round(h) > 0 else None


def image_size(data: bytes) -> tuple[str, int, int] | None:
    """(kind, width, height)."""
    found: tuple[int, int] | None = None
    kind = ""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            kind, found = "png", struct.unpack_from(">II", data, 16)
        elif data[:4] == b"GIF8":
            kind, found = "gif", struct.unpack_from("<HH", data, 6)
        elif data[:2] == b"BM":
            kind = "bmp"
            found = struct.unpack_from("<HH", data, 18) if struct.unpack_from("<I", data, 14)[0] == 12 else tuple(map(abs, struct.unpack_from("<ii", data, 18)))
        elif data[:2] == b"\xff\xd8":
            kind, found = "jpeg", jpeg(data)
        elif data[:4] in (b"II*\0", b"MM\0*"):
            kind, found = "tiff", tiff(data)
        elif b"<svg" in data[:4096]:
            kind, found = "svg", svg(data)
    except struct.error:
        return None
    return (kind, *found) if found and found[0] > 0 and found[1] > 0 else None


def read_sizes(files: DataFrame) -> DataFrame:
    def rows(name: str, content: bytes) -> Iterator[tuple]:
        got = image_size(content)
        yield (name, *got, None) if got else (name, None, None, None, "no image header")

    return per_file(files, rows, SIZE)
