"""Column functions on source text: lines, flags, templates, carets, directives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases that mark a generated file; both kinds must occur in its first comment lines.
DO_NOT_EDIT = r"do not (edit|modify)"
GENERATED = r"auto-?\s?generated"


def lines(files: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line_no from 1, text, byte_pos) of every line of a text; null texts have none.

    One pass over each text, linear in its size; texts are cut where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, value in enumerate(batch.column(1).to_pylist()):
                if value is None:
                    continue
                parts = value.encode().split(b"\n")
                at = np.cumsum([0, *(len(x) + 1 for x in parts[:-1])])
                for a in range(0, len(parts), 10_000):
                    m = len(parts[a : a + 10_000])
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[k], m), pa.array(np.arange(a + 1, a + m + 1, dtype=np.int32)), pa.array(parts[a : a + m], pa.binary()).cast(pa.string()), pa.array(at[a : a + m], pa.int64())], names=["key", "line_no", "text", "byte_pos"])

    d = files.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return d.mapInArrow(run, f"key {d.schema['key'].dataType.simpleString()}, line_no int, text string, byte_pos long").withColumnRenamed("key", key)


def auto_generated(content: Column, first: int = 15) -> Column:
    """Do the first lines say both that the file is generated and that it must not be edited?"""
    head = F.filter(F.slice(F.split(F.lower(content), "\n", -1), 1, first), lambda x: F.ltrim(x).rlike(r"^(//|#|/?\*)"))
    return F.exists(head, lambda x: x.rlike(DO_NOT_EDIT)) & F.exists(head, lambda x: x.rlike(GENERATED))


def extension(path: Column) -> Column:
    """What follows the last dot of a path's last segment, without query or fragment; empty if there is none."""
    return F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"[^/]\.([A-Za-z0-9]+)$", 1)


def template(message: Column, captures: dict[str, Column], whole: Column | None = None) -> Column:
    """``$name`` replaced by captures one after the other, ``$$`` by the whole node.

    Captures of several lines or over 60 bytes aren't interpolated.
    """
    out = message if whole is None else F.replace(message, F.lit("$$"), whole)
    for name, value in captures.items():
        short = (F.octet_length(value) <= 60) & ~F.contains(value, F.lit("\n"))
        out = F.when(short, F.replace(out, F.lit(f"${name}"), value)).otherwise(out)
    return out


def caret(context: Column, start: Column, end: Column) -> Column:
    """The line that underlines characters start to end (from 0, end exclusive) of context; tabs stay tabs."""
    lead = F.regexp_replace(F.substring(context, F.lit(1), start), r"[^\t]", " ")
    return F.concat(lead, F.repeat(F.lit("^"), F.greatest(F.lit(1), end - start)))


def severity(level: Column) -> Column:
    return F.rpad(F.element_at(F.array(*[F.lit(x) for x in ("ERROR", "WARNING", "MAYBE")]), F.least(F.greatest(level, F.lit(1)), F.lit(3))), 7, " ")


def directives(fmt: Column) -> Column:
    """The printf directives of a format string, in order."""
    return F.regexp_extract_all(fmt, F.lit(r"%(?:\d+\$)?[-+ 0]*(?:'.)?\d*(?:\.\d+)?[bcdeEfFgGosuxX%]"), F.lit(0))


def base36(number: Column) -> Column:
    """An unsigned 64-bit number (a decimal) in base 36."""
    return F.lower(F.conv(number.cast("string"), 10, 36))


def from_base36(text: Column) -> Column:
    return F.conv(F.upper(text), 36, 10).cast("decimal(20,0)")


def words(text: Column) -> Column:
    """Words of letters in a text, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))
