"""Quality rules, line first: lines are judged one by one, failing lines go, and a text that loses too much is rejected.

Line rules (a line is what stands between line feeds; one without a word is no line here):
- symbols: over a tenth of its code points are of [#*$%&|<>], or over a third of its words end in one of them
- navigation: at least three words, and at least one in ten is a lone separator (| > » · / -)
- shouting: over half of its words (five at least) have capitals of A-Z and no letter of a-z
- repetition: over half of its words (ten at least) equal the word before them
- boilerplate: a short line with a notice in it (licence, rights, cookies, sign-up)
- punctuation: ten words or more and no sentence mark at all
Document: base_failed, or more than `most_lost` of its words stood in failing lines.

Null text: no words, rejected. Everything is per row, whatever its id and however long its text; ties and repeats don't matter; an
empty table gives no rows; other columns pass through, those named q_ give way.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
SEPARATORS = frozenset([b"|", b">", "»".encode(), "·".encode(), b"/", b"-"])
SEPARATOR = re.compile(rb"(?:^|\s)(?:[|>/-]|\xc2\xbb|\xc2\xb7)(?:\s|$)")
SENTENCE = re.compile(r"[.!?…。？！]")
#: Notices in English, German, French and Spanish (fixed values of the rule).
NOTICE = re.compile(
    r"all rights reserved|licen[sc]ed under|\blicen[sc]e,? version|under the mit licen[sc]e|copyright \(c\)|©|terms of (use|service)|privacy policy|accept (all )?cookies|cookie policy|subscribe to our|sign up for|click here|javascript is (disabled|required)"
    r"|alle rechte vorbehalten|lizenziert unter|nutzungsbedingungen|datenschutz(erklärung|hinweise|richtlinie)|cookies (akzeptieren|zulassen)|newsletter abonnieren|hier klicken|javascript ist deaktiviert"
    r"|tous droits réservés|sous licence|mentions légales|conditions (générales )?d.utilisation|politique de confidentialité|accepter (tous )?les cookies|abonnez-vous à|cliquez ici|javascript est désactivé"
    r"|todos los derechos reservados|bajo (la )?licencia|aviso legal|términos (de uso|y condiciones)|política de (privacidad|cookies)|aceptar (todas )?las cookies|suscríbete a|haga clic aquí|javascript está desactivado",
    re.I,
)
NOTICE_WORDS = 25

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def line_fails(line: str, raw: bytes, words: list[bytes]) -> str | None:
    """The rule that the line breaks, if any. raw: its UTF-8."""
    n = len(words)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    if symbols and (10 * symbols > len(line) or n >= 3 and 3 * sum(w[-1] in SYMBOLS for w in words) > n):
        return "symbols"
    if n >= 3 and SEPARATOR.search(raw) and 10 * sum(w in SEPARATORS for w in words) >= n:
        return "navigation"
    if n >= 10 and 2 * sum(map(eq, words, words[1:])) > n:
        return "repetition"
    if n >= 5 and 2 * sum(map(bytes.isupper, words)) > n:
        return "shouting"
    if n <= NOTICE_WORDS and NOTICE.search(line):
        return "boilerplate"
    if n >= 10 and not SENTENCE.search(line):
        return "punctuation"
    return None


def repeat_words(words: list[bytes], width: int = 3) -> int:
    """Words that stand in a window of `width` words which the text holds twice or more."""
    windows = list(zip(*[words[i:] for i in range(width)]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = upto = 0  # words before upto are counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, upto)
            upto = i + width
    return covered


def judge(text: str | None, *, min_words: int, most_repeat: float, most_lost: float) -> tuple[tuple[int, ...], bool, bool, int, str]:
    """Counts (as COUNTS), base_failed, kept, words in failing lines, and the text without failing lines."""
    text = text or ""
    whole = text.encode("utf-8", "surrogatepass")
    seen: set[bytes] = set()
    lost = dup = 0
    every: list[bytes] = []
    left = []
    for line, raw in zip(text.split("\n"), whole.split(b"\n"), strict=True):
        words = raw.split()
        if words:
            every += words
            dup += raw in seen
            seen.add(raw)
            if line_fails(line, raw, words):
                lost += len(words)
                continue
        left.append(line)
    n = len(every)
    repeats = repeat_words(every)
    counts = (n, len(text) - len(whole) + len(whole.translate(None, BLANKS)), len(whole) - len(whole.translate(None, SYMBOLS)), dup, repeats)
    failed = n < min_words or repeats > most_repeat * n
    return counts, failed, not failed and lost <= most_lost * n, lost, "\n".join(left)


def clean(docs: DataFrame, *, min_words: int = 50, most_repeat: float = 0.5, most_lost: float = 0.5, text: str = "text", columns: list[str] | None = None, with_text: bool = True) -> DataFrame:
    """docs (or `columns` of it) with q_<count>, q_base_failed, q_kept, q_lost_words and, if asked, q_text (cleaned)."""
    carried = [c for c in (docs.columns if columns is None else columns) if not c.startswith("q_")]  # input columns named q_ give way
    given = docs.select(*carried, F.col(text).cast("string").alias("__text"))
    extra = [T.StructField(f"q_{c}", T.LongType()) for c in COUNTS] + [T.StructField("q_base_failed", T.BooleanType()), T.StructField("q_kept", T.BooleanType()), T.StructField("q_lost_words", T.LongType())] + [T.StructField("q_text", T.StringType())] * with_text
    schema = T.StructType([f for f in docs.select(*carried).schema.fields] + extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [judge(x.as_py(), min_words=min_words, most_repeat=most_repeat, most_lost=most_lost) for x in b.column(b.num_columns - 1)]
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
            cols += [pa.array([f[1] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.bool_()), pa.array([f[3] for f in found], pa.int64())]
            if with_text:
                cols.append(pa.array([f[4] for f in found], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    return given.mapInArrow(run, schema)
