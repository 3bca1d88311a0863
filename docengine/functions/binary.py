"""Bytes: digests, magic numbers, image headers read by expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.nulls import col

#: Magic numbers (fixed values).
MAGIC = {"png": "89504E470D0A1A0A", "gif": "474946383", "bmp": "424D", "jpeg": "FFD8FF", "tiff": "49492A00", "tiff-be": "4D4D002A", "pdf": "25504446", "zip": "504B0304", "ole": "D0CF11E0A1B11AE1"}


def sha256(x: Column | str) -> Column:
    return F.sha2(col(x), 256)


def is_digest(x: Column | str) -> Column:
    return F.coalesce(col(x).rlike("^[0-9a-f]{64}$"), F.lit(False))


def kind_of(content: Column | str) -> Column:
    """The format that the first bytes tell, or null."""
    head = F.hex(F.substring(col(content), 1, 8))
    out = F.lit(None).cast("string")
    for kind, magic in MAGIC.items():
        out = F.when(head.startswith(magic), kind.removesuffix("-be")).otherwise(out)
    return out


def data_uri(content: Column | str, mime: Column) -> Column:
    """BI2: bytes inside a document, as base64 in one line."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(col(content)), r"\s", ""))


def from_data_uri(uri: Column | str) -> Column:
    """BI2: the bytes of a base64 data URI; null for anything else."""
    said = F.regexp_extract(col(uri), r"^data:[^;,]*;base64,([A-Za-z0-9+/]*={0,2})$", 1)
    return F.when(said != "", F.unbase64(said))


def is_pdf(content: Column | str) -> Column:
    tail = F.decode(F.substring(col(content), -2048, 2048), "ISO-8859-1")
    return (kind_of(content) == "pdf") & tail.contains("%%EOF")


def big(content: Column, at: int, n: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, n)), 16, 10).cast("long")


def little(content: Column, at: int, n: int) -> Column:
    return F.conv(F.array_join(F.array(*[F.hex(F.substring(content, at + 1 + i, 1)) for i in reversed(range(n))]), ""), 16, 10).cast("long")


def _signed32(x: Column) -> Column:
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def raster_size(content: Column | str) -> Column:
    """struct(width, height) of PNG, GIF and BMP; a top-down BMP's negative height is its size."""
    c = col(content)
    bmp_core = little(c, 14, 4) == 12
    w = F.when(kind_of(c) == "png", big(c, 16, 4)).when(kind_of(c) == "gif", little(c, 6, 2)).when(kind_of(c) == "bmp", F.when(bmp_core, little(c, 18, 2)).otherwise(F.abs(_signed32(little(c, 18, 4)))))
    h = F.when(kind_of(c) == "png", big(c, 20, 4)).when(kind_of(c) == "gif", little(c, 8, 2)).when(kind_of(c) == "bmp", F.when(bmp_core, little(c, 20, 2)).otherwise(F.abs(_signed32(little(c, 22, 4)))))
    return F.when((w > 0) & (h > 0), F.struct(w.alias("width"), h.alias("height")))


def is_legacy_office(content: Column | str) -> Column:
    """An OLE container's header: signature, version 3, byte order, sector shifts 9 and 6."""
    c = col(content)
    return (F.octet_length(c) >= 512) & (kind_of(c) == "ole") & (little(c, 26, 2) == 3) & (little(c, 28, 2) == 0xFFFE) & (little(c, 30, 2) == 9) & (little(c, 32, 2) == 6)
