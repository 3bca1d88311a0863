"""Text functions as column expressions."""

from __future__ import annotations

import html
import json
from functools import lru_cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.nulls import col, given

#: Predefined entities, & last on the way in and first on the way out (fixed values).
ENTITIES = (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
#: Names that a Windows file may not have (fixed values).
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)])
#: Absolute paths in running text: drive, UNC, home, file URL, root (fixed patterns).
PATHS = (r"[A-Za-z]:\\(?:[^\\\s\"'<>|]+\\)*([^\\\s\"'<>|]+)", r"\\\\(?:[^\\\s\"'<>|]+\\)+([^\\\s\"'<>|]+)", r"~/(?:[^/\s\"'<>|]+/)*([^/\s\"'<>|]+)", r"file://(?:/[^/\s\"'<>|]+)*/([^/\s\"'<>|]+)", r"(?:/(?:Users|home|var|tmp|private|opt|etc|mnt|Volumes)(?:/[^/\s\"'<>|]+)*)/([^/\s\"'<>|]+)")


#: A reference to a character: by number, or by a name that may lack its semicolon.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@lru_cache(maxsize=1)
def _references() -> tuple[str, str, str]:
    """As JSON: what names stand for, those of them that need no semicolon, and the numbers below 160 that stand for something else than themselves."""
    bare = {k: v for k, v in html5.items() if not k.endswith(";")}
    odd = {str(n): html.unescape(f"&#{n};") for n in range(160) if html.unescape(f"&#{n};") != chr(n)}
    return json.dumps(html5), json.dumps(bare), json.dumps(odd)


def _referred(t: Column) -> Column:
    """The characters that one reference stands for; what stands for nothing stays."""
    names, bare, odd = (F.from_json(F.lit(x), "map<string,string>") for x in _references())
    given_as = F.regexp_extract(t, "^&#[xX]?0*([0-9a-fA-F]*)", 1)
    short = F.left(given_as, F.lit(9))
    n = F.when(t.rlike("^&#[xX]"), F.conv(F.concat(F.lit("0"), short), 16, 10)).otherwise(F.concat(F.lit("0"), F.regexp_extract(short, "^[0-9]*", 0))).cast("long")
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    nothing = n.between(0xFDD0, 0xFDEF) | ((n >= 0xFFFE) & (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE))
    number = F.when((F.length(given_as) > 8) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when(nothing, "").otherwise(F.coalesce(F.try_element_at(odd, n.cast("string")), char))
    name = F.substring(t, 2, 40)
    longest = max(map(len, json.loads(_references()[1])))
    starts = [F.when(F.length(name) > k, F.concat(F.try_element_at(bare, F.left(name, F.lit(k))), F.substring(name, k + 1, 40))) for k in range(longest, 1, -1)]
    return F.when(t.startswith("&#"), number).otherwise(F.coalesce(F.try_element_at(names, name), *starts, t))


def unescape(x: Column | str) -> Column:
    """STR1: references to characters decoded exactly once: all names of HTML, numbers in either notation, names without their semicolon by their
    longest known beginning."""
    c = col(x)
    said = F.concat(F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0)), _referred), F.array(F.lit("")))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.zip_with(F.split(c, REFERENCE, -1), said, lambda p, t: F.concat(p, t)), "")).otherwise(c)


def escape(x: Column | str) -> Column:
    c = F.replace(col(x), F.lit("&"), F.lit("&amp;"))
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def squeeze(x: Column | str) -> Column:
    """White space, Unicode's too, as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def clean_text(x: Column | str) -> Column:
    """White space as single spaces, then references decoded, then none at the ends."""
    return F.regexp_replace(unescape(F.regexp_replace(col(x), r"(?U)\s+", " ")), r"(?U)^\s+|\s+$", "")


def strip_tags(x: Column | str) -> Column:
    return F.regexp_replace(col(x), "<[^>]+>", "")


def tag_texts(x: Column | str, tag: str) -> Column:
    """Texts of all elements of a local name, joined."""
    return F.array_join(F.regexp_extract_all(col(x), F.lit(rf"<(?:[A-Za-z0-9]+:)?{tag}(?:\s[^>]*)?>([^<]*)</"), F.lit(1)), "")


def tag_count(x: Column | str, tag: str) -> Column:
    """Elements of a local name with any prefix; longer names don't count."""
    return F.regexp_count(col(x), F.lit(rf"<(?:[A-Za-z0-9]+:)?{tag}[\s/>]")).cast("long")


def heading_level(style: Column | str, pos: Column) -> Column:
    """1 to 9 from heading1..heading9, 1 for a title and for the first paragraph, else 0."""
    s = F.lower(F.regexp_replace(col(style), r"[\s_-]", ""))
    n = given(F.regexp_extract(s, "^heading([1-9])$", 1)).cast("int")
    return F.coalesce(n, F.when(s == "title", 1), F.when(pos == 1, 1), F.lit(0))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(F.rtrim(col(path)), r"([^/\\]*)$", 1)


def safe_file_name(name: Column | str, most: int = 80) -> Column:
    """A name that any system takes: base name, no control or reserved characters, no trailing dots, reserved names led by _."""
    bare = F.regexp_replace(F.regexp_replace(base_name(name), r'[\x00-\x1F<>:"|?*]', "_"), r"[. ]+$", "")
    stem = F.upper(F.regexp_extract(bare, r"^([^.]*)", 1))
    return F.left(F.when(stem.isin(*RESERVED), F.concat(F.lit("_"), bare)).when(bare == "", "_").otherwise(bare), F.lit(most))


def split_trim(x: Column | str, separators: str = "[,，;；\n]+") -> Column:
    return F.filter(F.transform(F.split(col(x), separators), lambda s: F.trim(s)), lambda s: s != "")


def id_list(x: Column | str) -> Column:
    """Ids from a repeated or comma-separated parameter: trimmed, distinct, in order."""
    return F.array_distinct(split_trim(x, ","))


def redact_paths(x: Column | str, label: str = "") -> Column:
    """Absolute paths in text cut to their last part, led by a label."""
    return reduce(lambda c, p: F.regexp_replace(c, p, f"{label}$1"), PATHS, col(x))


def ascii_project(x: Column | str) -> Column:
    return F.regexp_replace(col(x), r"[^\x20-\x7E]", "?")


def pdf_escape(x: Column | str) -> Column:
    return F.regexp_replace(ascii_project(x), r"([\\()])", r"\\$1")


def display_width(x: Column | str) -> Column:
    """Columns in a fixed-width font: East Asian wide and full-width characters take two."""
    wide = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}\x{1F300}-\x{1F64F}\x{20000}-\x{3FFFD}]"
    return (F.length(col(x)) + F.regexp_count(col(x), F.lit(wide))).cast("long")


def column_number(letters: Column | str) -> Column:
    """A -> 1, Z -> 26, AA -> 27."""
    return F.aggregate(F.split(F.upper(col(letters)), ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64))


def column_letters(n: Column | str) -> Column:
    """1 -> A, 27 -> AA, 16384 -> XFD."""
    n = col(n)
    third, second, first = F.floor((n - 703) / 676), F.floor((n - 27) / 26) % 26, (n - 1) % 26
    letter = lambda k: F.char((k + 65).cast("long"))
    return F.concat(F.when(n > 702, letter(third)).otherwise(""), F.when(n > 26, letter(second)).otherwise(""), letter(first))


def resolve_part(base: Column | str, target: Column | str) -> Column:
    """A relationship's target as a part name: absolute or relative to the base's folder, . and .. resolved; null if it leaves
    the package. A fragment is dropped; an empty target is the base itself."""
    t = F.regexp_replace(col(target), "#.*$", "")
    folder = F.regexp_extract(col(base), "^(.*/)?[^/]*$", 1)
    path = F.when(t == "", col(base)).when(t.startswith("/"), t).otherwise(F.concat(folder, t))
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda a, s: F.when(a.isNull(), a).when(s != "..", F.array_append(a, s)).when(F.size(a) > 0, F.slice(a, F.lit(1), F.size(a) - 1)),
    )
    return F.when(F.size(walked) > 0, F.array_join(walked, "/"))


def slice_runs(runs: Column | str, start: int, length: int) -> Column:
    """STR11: the runs that make up `length` characters from `start` (from 0), each with its own style. runs: array of structs with text."""
    r = col(runs)
    size = lambda x: F.length(F.coalesce(x["text"], F.lit("")))
    before = F.transform(r, lambda x, i: F.aggregate(F.slice(r, F.lit(1), i), F.lit(0), lambda s, y: s + size(y)))

    def part(x: Column, at: Column) -> Column:
        lo, hi = F.greatest(F.lit(start) - at, F.lit(0)), F.least(size(x), F.lit(start + length) - at)
        return x.withField("text", F.substring(x["text"], lo + 1, F.greatest(hi - lo, F.lit(0))))

    return F.filter(F.zip_with(r, before, part), lambda x: F.length(x["text"]) > 0)


def unique_name(stem: Column, extension: Column, rank: Column) -> Column:
    """stem.ext, stem-1.ext, stem-2.ext ... by rank from 1."""
    return F.concat(stem, F.when(rank > 1, F.concat(F.lit("-"), (rank - 1).cast("string"))).otherwise(""), extension)


def script_of(tag: Column | str) -> Column:
    """The script a language tag is written in: the one it names, else what its language or region says, else null. Nothing is guessed."""
    parts = F.split(F.lower(F.replace(col(tag), F.lit("_"), F.lit("-"))), "-")
    head, rest = F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.size(parts))
    named = F.initcap(F.get(F.filter(rest, lambda p: p.rlike("^[a-z]{4}$")), F.lit(0)))
    region = F.when(F.exists(rest, lambda p: p.isin("tw", "hk", "mo")), "Hant").when(F.exists(rest, lambda p: p.isin("cn", "sg")), "Hans")
    return F.coalesce(named, F.when(head == "zh", region).when(head == "ja", "Jpan").when(head == "ko", "Hang").when(head == "en", "Latn"))


def alias_of(x: Column | str, aliases: dict[str, str], default: str) -> Column:
    """A status or platform by any of its spellings."""
    pairs = [F.lit(v) for kv in aliases.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(F.trim(col(x)))), F.lit(default))
