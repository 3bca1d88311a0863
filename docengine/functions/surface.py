"""What SQL can call: the library's functions as SQL functions, archives as a table function.

    register(spark)
    SELECT column_letters(n), resolve_part('xl/workbook.xml', target) FROM ...
    SELECT * FROM zip_parts(TABLE(SELECT name, content FROM archives) PARTITION BY name)

Scalar ones are SQL bodies, so they are planned as if they had been written out. They are temporary, for one session.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

#: name(parameters) returns type -> body.
BODIES = {
    # STR16: 1 -> A, 27 -> AA, and back
    "column_letters(n BIGINT) RETURNS STRING": "concat(IF(n > 702, char(65 + (n - 703) DIV 676), ''), IF(n > 26, char(65 + ((n - 27) DIV 26) % 26), ''), char(65 + (n - 1) % 26))",
    "column_number(letters STRING) RETURNS BIGINT": "aggregate(filter(split(upper(letters), ''), c -> c <> ''), 0L, (n, c) -> n * 26 + ascii(c) - 64)",
    # STR17: a relationship's target as a part name; null if it leaves the package
    "resolve_part(base STRING, target STRING) RETURNS STRING": """aggregate(
        filter(split(CASE WHEN regexp_replace(target, '#.*$', '') = '' THEN base WHEN target LIKE '/%' THEN regexp_replace(target, '#.*$', '') ELSE concat(regexp_extract(base, '^(.*/)?[^/]*$', 1), regexp_replace(target, '#.*$', '')) END, '/'), s -> s NOT IN ('', '.')),
        cast(array() AS ARRAY<STRING>),
        (a, s) -> CASE WHEN a IS NULL THEN a WHEN s <> '..' THEN array_append(a, s) WHEN size(a) > 0 THEN slice(a, 1, size(a) - 1) END,
        a -> IF(size(a) > 0, array_join(a, '/'), NULL))""",
    # STR6-like: the last part of a path
    "base_name(path STRING) RETURNS STRING": r"regexp_extract(rtrim(path), '([^/\\\\]*)$', 1)",
}


@F.udtf(returnType="archive string, pos int, part string, size long, error string")
class ZipParts:
    """Rows (name, content) of archives -> a row a part, or one with an error. Of several rows of a name each is an archive of its own."""

    def eval(self, row: Row) -> Iterator[tuple]:
        name, content = row[0], row[1]
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(content or b""))) as z:
                for i, info in enumerate(x for x in z.infolist() if not x.is_dir()):
                    yield name, i, info.filename, info.file_size, None
        except zipfile.BadZipFile as e:
            yield name, None, None, None, str(e)


def register(spark: SparkSession) -> None:
    for head, body in BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("zip_parts", ZipParts)
