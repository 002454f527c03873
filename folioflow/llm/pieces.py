"""Splitting oversized items at natural boundaries.

Every place where a text may be cut has a strength: after a blank line, after a sentence, at white space. A sparse table over the
strengths answers which is the strongest cut in a window of permissible lengths, the rightmost of equals; the next piece steps
back from that cut by the overlap. Which kind of boundary alone suffices is found by the same cutting over a table that knows the
cuts of that kind only: wherever a window holds none of them, the kind does not suffice.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.arrow import map_batches
from folioflow.llm.sentences import BLANK, Model, Splitter

NONE, WORD, SENTENCE, PARAGRAPH = 0, 1, 2, 3
NAMES = {PARAGRAPH: "paragraph", SENTENCE: "sentence", WORD: "word", NONE: "none"}
SPACE = re.compile(r"\s+")


class RangeMax:
    """A sparse table: the place of the highest value in a range, the rightmost of equals, in constant time."""

    def __init__(self, values: np.ndarray, widest: int):
        n = len(values)
        self.n = n
        level = values.astype(np.int64) * (n + 1) + np.arange(n)
        self.levels, width = [level], 1
        while width * 2 <= min(widest, n):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def query(self, a: int, b: int) -> int:
        """Of the half-open range, which must not be empty."""
        k = min((b - a).bit_length() - 1, len(self.levels) - 1)
        level, width = self.levels[k], 1 << k
        best = int(level[a])
        for i in range(a + width, b - width + 1, width):
            best = max(best, int(level[i]))
        return max(best, int(level[b - width])) % (self.n + 1)


def boundaries(text: str, sentences: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places of cuts in order, with their strengths. A cut stands after the white space that it follows, so pieces join to the text."""
    strength = {m.end(): WORD for m in SPACE.finditer(text)}
    strength.update((s, SENTENCE) for s, _ in sentences[1:])
    strength.update((m.end(), PARAGRAPH) for m in BLANK.finditer(text))
    strength.pop(0, None)
    strength.pop(len(text), None)
    places = sorted(strength)
    return np.array(places, dtype=np.int64), np.array([strength[p] for p in places], dtype=np.int64)


def pieces(text: str | None, max_size: int, overlap: int, sentences: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(start, end, strength of the cut at its end)`` of pieces of at most ``max_size`` code points.

    Each piece starts exactly ``overlap`` before the end of the one before. Without a boundary in the window a piece is cut at
    its full size (strength 0). The last piece ends with the text, strength 3. Null and empty texts have no pieces, and a text
    within the size is one. ``overlap`` must be smaller than ``max_size``.
    """
    if not 0 <= overlap < max_size:
        raise ValueError("the overlap must be at least 0 and smaller than the size")
    if not text:
        return []
    if len(text) <= max_size:
        return [(0, len(text), PARAGRAPH)]
    places, strengths = boundaries(text, sentences)
    table = RangeMax(strengths, max_size) if len(places) else None
    out, start = [], 0
    while len(text) - start > max_size:
        a = int(np.searchsorted(places, start + overlap, side="right"))  # beyond the overlap, so that each piece gets further
        b = int(np.searchsorted(places, start + max_size, side="right"))
        if a < b:
            i = table.query(a, b)
            end, strength = int(places[i]), int(strengths[i])
        else:
            end, strength = start + max_size, NONE
        out.append((start, end, strength))
        start = end - overlap
    out.append((start, len(text), PARAGRAPH))
    return out


def cuts_alone(ends: np.ndarray, starts: np.ndarray, fit: np.ndarray, begin: int, end: int, limit: int) -> bool:
    """Whether cuts of one kind part ``begin..end`` into units of at most ``limit``.

    The k-th cut ends a unit at ``ends[k]`` and the next begins at ``starts[k]``; ``fit`` is 1 for cuts of the kind, else 0. Each step
    takes the strongest, rightmost cut that the table has in the window of permissible lengths.
    """
    table = RangeMax(fit, limit + 1)
    while end - begin > limit:
        a, b = int(np.searchsorted(starts, begin, side="right")), int(np.searchsorted(ends, begin + limit, side="right"))
        if a >= b or not fit[k := table.query(a, b)]:
            return False
        begin = int(starts[k])
    return True


def natural_boundary(text: str, limit: int, sentences: list[tuple[int, int]]) -> str:
    """The first of paragraph, sentence and word at which alone a cutting keeps all units within ``limit``, else none.

    Units count without outer white space, and a paragraph needs a blank line between two of them.
    """
    if not sentences:
        return NAMES[SENTENCE]  # nothing but white space: there is no unit
    begin, end = sentences[0][0], sentences[-1][1]
    before = {m.end(): m.start() for m in SPACE.finditer(text, begin, end)}
    kinds = dict.fromkeys(before, WORD)
    kinds.update((s, SENTENCE) for s, _ in sentences[1:])
    kinds.update((m.end(), PARAGRAPH) for m in BLANK.finditer(text, begin, end))
    at = sorted(kinds)
    starts, ends = np.array(at, dtype=np.int64), np.array([before.get(p, p) for p in at], dtype=np.int64)
    strength = np.array([kinds[p] for p in at], dtype=np.int64)
    spaced = starts > ends  # only these are cuts between words
    for kind, fit in ((PARAGRAPH, strength == PARAGRAPH), (SENTENCE, strength >= SENTENCE), (WORD, spaced)):
        if (kind != PARAGRAPH or fit.any()) and cuts_alone(ends, starts, fit.astype(np.int64), begin, end, limit):
            return NAMES[kind]
    return NAMES[NONE]


def oversized(items: DataFrame, budget: DataFrame) -> DataFrame:
    """The ``(origin, item_key, lang, text)`` that are longer than their origin's size, with size and overlap.

    The budget has a row per origin and is grouped to one, the smallest size, if it names an origin twice; origins without a
    budget, null texts and null sizes give nothing.
    """
    one = budget.where("origin is not null and max_size is not null").groupBy("origin").agg(F.min("max_size").alias("max_size"), F.min(F.coalesce("overlap", F.lit(0))).alias("overlap"))
    return items.select("origin", "item_key", "lang", "text").join(F.broadcast(one), "origin").where(F.length("text") > F.col("max_size"))  # a row an origin


def _mapped(items: DataFrame, schema: str, models: dict[str, Model], profiles: dict[str, set[str]], rows) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def make():
        splitter = Splitter(models, profiles)

        def work(batch: pa.RecordBatch) -> dict:
            found = []
            for origin, key, lang, text, size, overlap in zip(*(batch.column(c).to_pylist() for c in ("origin", "item_key", "lang", "text", "max_size", "overlap"))):
                found += [(origin, key, *r) for r in rows(text, size, overlap, splitter.spans(text, lang))]
            return dict(zip(names, map(list, zip(*found)))) if found else {n: [] for n in names}

        return work

    return map_batches(items.select("origin", "item_key", "lang", "text", "max_size", "overlap"), schema, make).distinct()


def split_items(items: DataFrame, budget: DataFrame, models: dict[str, Model], profiles: dict[str, set[str]]) -> DataFrame:
    """``(origin, item_key, piece_no, start_pos, end_pos, cut)`` of all oversized items; a key delivered twice comes out once."""
    rows = lambda t, size, overlap, s: [(n, a, b, NAMES[k] if b < len(t) else "end") for n, (a, b, k) in enumerate(pieces(t, size, overlap, s))]
    return _mapped(oversized(items, budget), "origin string, item_key long, piece_no int, start_pos int, end_pos int, cut string", models, profiles, rows)


def item_boundaries(items: DataFrame, budget: DataFrame, models: dict[str, Model], profiles: dict[str, set[str]]) -> DataFrame:
    """``(origin, item_key, boundary)`` of all oversized items: the boundary at which alone the sparse table cuts them within their size."""
    rows = lambda t, size, overlap, s: [(natural_boundary(t, size - overlap, s),)]
    return _mapped(oversized(items, budget), "origin string, item_key long, boundary string", models, profiles, rows)
