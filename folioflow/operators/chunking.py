"""Sentences by marks, and chunks within a budget, both without losing a character."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map
from folioflow.functions.text import SENTENCE, SENTENCE_END, SPACE

GAP = re.compile(r"\s+")
ENDING = re.compile(r"[.!?][\"'”’)]*$")


def sentence_parts(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``(keys, part_no, part, separator)``: sentences by their marks, with the exact white space that follows. JVM only."""
    cut = df.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))).alias("part_no", "whole"))
    ended = F.col("whole").rlike(SENTENCE_END)
    return cut.select(
        *keys, "part_no",
        F.when(ended, F.regexp_replace("whole", rf"[{SPACE}]+$", "")).otherwise(F.col("whole")).alias("part"),
        F.when(ended, F.regexp_extract("whole", rf"[{SPACE}]+$", 0)).otherwise("").alias("separator"),
    )


def split_text(text: str, fits: Callable[[str], bool]) -> list[tuple[str | None, str]]:
    """``(part, separator)`` such that every part fits; a word that does not fit alone comes as a separator only, with no part.

    A text that does not fit is halved at the gap nearest to its middle, among those after a sentence if there are any. Words and the
    places of gaps are found once; halves are ranges of words, so no text is copied but what is tried.
    """
    if fits(text):
        return [(text, "")]
    words = [m.span() for m in re.finditer(r"\S+", text)]
    if not words:
        return [(None, text)]
    gaps = [e for _, e in words[:-1]]  # where gaps begin, in order
    stops = [e for s, e in words[:-1] if ENDING.search(text, s, e)]

    def near(places: list[int], first: int, last: int) -> int | None:
        """The place nearest to the middle of words first..last, the earlier of equals."""
        lo, hi = bisect_left(places, words[first][1]), bisect_left(places, words[last][1])
        at = bisect_left(places, (words[first][0] + words[last][1]) / 2, lo, hi)
        return min(places[max(at - 1, lo) : min(at + 1, hi)], key=lambda g: (abs(2 * g - words[first][0] - words[last][1]), g), default=None)

    def halves(first: int, last: int) -> Iterator[tuple[int, int, bool]]:
        whole = fits(text[words[first][0] : words[last][1]])
        if whole or first == last:
            yield first, last, whole
            return
        place = near(stops, first, last)
        cut = bisect_left(gaps, near(gaps, first, last) if place is None else place)
        yield from halves(first, cut)
        yield from halves(cut + 1, last)

    out = [(None, text[: words[0][0]])] if words[0][0] else []
    for first, last, whole in halves(0, len(words) - 1):
        s, e = words[first][0], words[last][1]
        gap = text[e : words[last + 1][0] if last + 1 < len(words) else len(text)]
        out.append((text[s:e], gap) if whole else (None, text[s:e] + gap))
    return out


def budget_chunks(df: DataFrame, keys: list[str], text: str, limit: int, unit: str = "chars") -> DataFrame:
    """``(keys, chunk_no, part, separator)`` of sentences cut to at most ``limit`` characters or words; a null part was too long alone."""
    fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "chunk_no int, part string, separator string"])

    def make():
        fits = (lambda s: len(s) <= limit) if unit == "chars" else (lambda s: len(s.split()) <= limit)

        def work(row: dict) -> list[tuple]:
            key = tuple(row[k] for k in keys)
            return [(*key, n, p, s) for n, (p, s) in enumerate(split_text(row[text] or "", fits))]

        return work

    return flat_map(df.select(*keys, text), schema, make)


def chunk_offsets(chunks: DataFrame, keys: list[str], order: str, size: Column, gap: Column) -> DataFrame:
    """Adds ``start_pos`` and ``end_pos`` of each chunk's text in its reassembled item, from the lengths of text and separator."""
    before = F.coalesce(F.sum(size + gap).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return chunks.withColumn("start_pos", before.cast("int")).withColumn("end_pos", (before + size).cast("int"))
