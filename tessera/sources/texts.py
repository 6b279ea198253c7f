"""Texts as relations: metadata and lines, made in the row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newline_style(text: Column) -> Column:
    """none, lf, crlf or mixed."""
    crlf = (F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2
    every = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(every == 0, "none").when(crlf == 0, "lf").when(crlf == every, "crlf").otherwise("mixed")


def metadata(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, chars, bytes, lines, newline, final_newline, generated, digest of each text; null texts are left out."""
    t = F.col(text)
    return texts.filter(t.isNotNull()).select(
        key, F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), F.size(F.split(t, "\n")).cast("long").alias("lines"),
        newline_style(t).alias("newline"), t.endswith("\n").alias("final_newline"), t.rlike(r"(?m)^// Code generated .* DO NOT EDIT\.$").alias("generated"), F.sha2(t, 256).alias("digest"),
    )


def lines(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line (from 1), t: a row a line."""
    return texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line", "t")).withColumn("line", (F.col("line") + 1).cast("long"))


def line_starts(text: Column) -> Column:
    """0-based byte offsets at which the lines of a text start."""
    sizes = F.transform(F.split(text, "\n"), lambda x: F.octet_length(x) + 1)
    zero = F.array(F.lit(0))
    return F.aggregate(F.slice(sizes, 1, F.greatest(F.size(sizes) - 1, F.lit(0))), zero, lambda s, n: F.array_append(s, F.element_at(s, -1) + n))


def position(starts: Column, offset: Column) -> Column:
    """struct(line, column), both from 1, of a byte offset: the last line start not beyond it."""
    line = F.size(F.filter(starts, lambda s: s <= offset))
    return F.struct(line.cast("long").alias("line"), (offset - F.element_at(starts, line) + 1).cast("long").alias("column"))
