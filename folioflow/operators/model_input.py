"""What a model sees of a segment: syntax dropped, protected content behind markers, and maps back to the source.

``parts`` are ``(start, end, kind)`` that partition the source; kinds are text, protected and syntax. All of it is about one
segment, so these are pure functions for Arrow batches.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from folioflow.functions.arrow import flat_map
from folioflow.operators.chunking import split_text


def partition(length: int, protected: list[tuple[int, int]], syntax: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The parts of a text under two layers of ranges; syntax wins, neighbours of one kind are one part."""
    borders = sorted({0, length, *(x for r in (*protected, *syntax) for x in r)})
    out: list[tuple[int, int, str]] = []
    for a, b in zip(borders, borders[1:]):
        inside = lambda rs: any(s <= a and b <= e for s, e in rs)  # noqa: E731, B023
        kind = "syntax" if inside(syntax) else "protected" if inside(protected) else "text"
        if out and out[-1][2] == kind:
            out[-1] = (out[-1][0], b, kind)
        else:
            out.append((a, b, kind))
    return out


def prefix_for(text: str, namespace: str = "DLM") -> str:
    low, k = text.lower(), 0
    while (p := namespace + hashlib.sha256(f"{namespace}:{k}".encode()).hexdigest()[:32].upper()).lower() in low:
        k += 1
    return p


@dataclass
class Piece:
    start: int  # in the model's input
    end: int
    source_start: int
    source_end: int
    token: str | None = None


@dataclass
class ModelInput:
    """``text`` is None where there is nothing to translate."""

    source: str
    text: str | None
    prefix: str = ""
    pieces: list[Piece] = field(default_factory=list)

    @property
    def tokens(self) -> list[str]:
        return [p.token for p in self.pieces if p.token]

    def position(self, at: int) -> int:
        """The place in the input of a place in the source; places within dropped syntax move to what follows."""
        for p in self.pieces:
            if at <= p.source_start:
                return p.start
            if at < p.source_end:
                return p.start if p.token else p.start + at - p.source_start
        return self.pieces[-1].end if self.pieces else 0


def prepare(source: str, parts: list[tuple[int, int, str]]) -> ModelInput:
    if not any(k == "text" and any(c.isalnum() for c in source[a:b]) for a, b, k in parts):
        return ModelInput(source, None)
    prefix = prefix_for(source)
    out, pieces, size = [], [], 0
    for a, b, kind in parts:
        if kind == "syntax":
            continue
        token = None
        words = source[a:b]
        if kind == "protected" and words.strip():
            words = token = f"{prefix}X{sum(p.token is not None for p in pieces)}Z"
        out.append(words)
        pieces.append(Piece(size, size + len(words), a, b, token))
        size += len(words)
    return ModelInput(source, "".join(out), prefix, pieces)


@dataclass
class Chunk:
    text: str | None
    separator: str
    original: str
    source_spans: list[tuple[int, int]]
    formatting: list[int]


def chunks(prepared: ModelInput, fits: Callable[[str], bool], ranges: list[tuple[int, int]] | None = None) -> list[Chunk]:
    """The input in parts that fit, each with the source it stands for and the formatting ranges it touches. No marker is cut."""
    ranges = ranges or []
    if prepared.text is None:
        return [Chunk(None, "", prepared.source, [(0, len(prepared.source))] if prepared.source else [], list(range(len(ranges))))]
    starts = [p.start for p in prepared.pieces]
    out, at = [], 0
    for text, separator in split_text(prepared.text, fits):
        end = at + len(text or "") + len(separator)
        spans = []
        for p in prepared.pieces[max(bisect_right(starts, at) - 1, 0) :]:
            if p.start >= end:
                break
            if p.end <= at:
                continue
            if p.token:
                spans.append((p.source_start, p.source_end))
            else:
                spans.append((p.source_start + max(at, p.start) - p.start, p.source_start + min(end, p.end) - p.start))
        touched = [k for k, (a, b) in enumerate(ranges) if any(s < b and e > a for s, e in spans)]
        original = "".join(prepared.source[s:e] for s, e in spans)
        out.append(Chunk(text or None, separator if text else "", original, spans, touched))
        at = end
    return out


def restore(text: str, prepared: ModelInput) -> tuple[str, list[tuple[int, int, int]]]:
    """(the text with the markers' content, ``(place of a marker, its end, growth)`` in order)"""
    content = {p.token: prepared.source[p.source_start : p.source_end] for p in prepared.pieces if p.token}
    found = sorted((text.find(t), t) for t in content if t in text)
    out, at, moves = [], 0, []
    for place, token in found:
        out += [text[at:place], content[token]]
        at = place + len(token)
        moves.append((place, at, len(content[token]) - len(token)))
    return "".join([*out, text[at:]]), moves


def moved(at: int, moves: list[tuple[int, int, int]]) -> int:
    """A place in the translated input, in the restored text."""
    return at + sum(growth for _, end, growth in moves if end <= at)


def model_chunks(segments: DataFrame, key: str, limit: int) -> DataFrame:
    """``(key, chunk_no, text, separator, original, source_spans)`` of ``(key, text, protected_spans)``."""
    schema = f"{key} {segments.schema[key].dataType.simpleString()}, chunk_no int, text string, separator string, original string, source_spans array<struct<start_pos:int,end_pos:int>>"

    def make():
        def work(row: dict) -> list[tuple]:
            source = row["text"] or ""
            spans = [(s["start_pos"], s["end_pos"]) for s in row["protected_spans"] or []]
            found = chunks(prepare(source, partition(len(source), spans, [])), lambda x: len(x) <= limit)
            return [(row[key], n, c.text, c.separator, c.original, [{"start_pos": a, "end_pos": b} for a, b in c.source_spans]) for n, c in enumerate(found)]

        return work

    return flat_map(segments.select(key, "text", "protected_spans"), schema, make)
