"""Text expressions that Spark evaluates in the JVM, with white space as Unicode has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, inside a class; the escapes mean the same to Java's and to RE2's regular expressions.
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: A line with its terminator, or the last one without.
LINE = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"
#: A sentence with the white space after it, or the rest of the text.
SENTENCE = rf"(?s).*?[.!?][\"'”’)]*[{SPACE}]+|.+"
SENTENCE_END = rf"[.!?][\"'”’)]*[{SPACE}]+$"
#: Words and single marks, as word aligners count them.
WORD = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_" + SPACE + "]"


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def rstrip(text: Column | str) -> Column:
    return F.regexp_replace(text, rf"[{SPACE}]+$", "")


def is_blank(text: Column | str) -> Column:
    return ~F.col(text).rlike(f"[^{SPACE}]") if isinstance(text, str) else ~text.rlike(f"[^{SPACE}]")


def count_words(text: Column | str) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def newlines(text: Column | str) -> Column:
    """All line ends as line feeds."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def piece(text: Column, start: Column, end: Column) -> Column:
    """A half-open slice in code points."""
    return F.substring(text, start + 1, end - start)


def joined(rows: Column, order: Column, separator: str = "") -> Column:
    """An aggregate: the strings in the order of another column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), rows.alias("t")))), lambda x: x["t"]), separator)
