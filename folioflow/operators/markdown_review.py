"""Markdown as people review it: blocks of visible text, and reviewed texts as Markdown again.

A block's body, without its container marks, line ends and closing marks, is read piece by piece: prose, literals (code and links whose words
are their address), line breaks, and wrappers that leave nothing. The pieces carry places on both sides, so visible text, formatting
and literals all follow from them. Reviewed text is escaped, gets its literals back as they were spelt and its formatting where the
alignment puts it, and is accepted only if the new document reads as the reviewed texts and has the blocks of the old one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from folioflow.functions.arrow import flat_map
from folioflow.operators import alignment as al
from folioflow.operators import markdown
from folioflow.operators.rendering import Wrapped, rendered
from folioflow.operators.review import ReviewError

LEAD = re.compile(r"(?:[ \t]*(?:>[ ]?|[-+*][ \t]+|\d{1,9}[.)][ \t]+))*(?:[ \t]*#{1,6}[ \t]+)?[ \t]*")
TRAIL = re.compile(r"(?:[ \t]+#+)?[ \t]*(?:(?:\r\n|\r|\n)[ \t>]*(?:=+|-+)[ \t]*)?[ \t\r\n]*$")
AGAIN = re.compile(r"[ \t]*(?:>[ ]?[ \t]*)*")  # before the continuation of a paragraph
LINE_END = re.compile(r"[ \t]*(\r\n|\r|\n)")


@dataclass
class Piece:
    """``text`` is what is seen of ``raw[start:end]``; ``literal`` says that it comes back as it is spelt."""

    text: str
    start: int
    end: int
    literal: bool = False


@dataclass
class Visible:
    pieces: list[Piece] = field(default_factory=list)
    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)  # wrappers in the raw text
    hard_breaks: bool = False

    @property
    def text(self) -> str:
        return "".join(p.text for p in self.pieces)

    def literals(self, raw: str) -> list[tuple[str, str]]:
        """(visible, spelling) of each literal, in order."""
        return [(p.text, raw[p.start : p.end]) for p in self.pieces if p.literal]

    def scopes(self) -> list[tuple[int, int]]:
        """The visible range of each wrapper."""
        ends = np.cumsum([0, *(len(p.text) for p in self.pieces)])
        starts = np.array([p.start for p in self.pieces])
        return [tuple(int(ends[np.searchsorted(starts, place)]) for place in (i, c)) for _, i, c, _ in self.ranges]


def visible(raw: str, kind: str) -> Visible:
    """What is seen of the body of a block. Inline HTML and images have no form for review and raise."""
    _, ranges, _ = markdown.inline_syntax(raw)
    out = Visible(ranges=sorted(ranges, key=lambda r: (r[0], -r[3])))
    wrappers = {(r[0], r[1]) for r in ranges} | {(r[2], r[3]) for r in ranges}

    def prose(a: int, b: int) -> None:
        at = a
        for m in LINE_END.finditer(raw, a, b):
            if m.start() > at:
                out.pieces.append(Piece(raw[at : m.start()], at, m.start()))
            at = AGAIN.match(raw, m.end(), b).end()
            out.pieces.append(Piece("\n", m.start(), at))
        if at < b:
            out.pieces.append(Piece(raw[at:b], at, b))

    def walk(a: int, b: int) -> None:
        at = a
        for m in markdown.INLINE.finditer(raw, a, b):
            s, e = m.span()
            name = next(k for k in ("escape", "code", "autolink", "html", "image", "link", "entity", "run", "break") if m[k] is not None)
            if name == "run" and (s, e) not in wrappers:
                continue
            prose(at, s)
            at = e
            if name in ("html", "image"):
                raise ReviewError("inline HTML and images have no form for review")
            if name == "escape":
                out.pieces.append(Piece(m[0][1:], s, e))
            elif name == "entity":
                out.pieces.append(Piece(html.unescape(m[0]), s, e))
            elif name == "break":
                out.hard_breaks = True
                if m[0] == "\\":
                    out.pieces.append(Piece("", s, e))
            elif name == "code":
                inner = re.sub(r"\r\n|\r|\n", " ", m[0].strip("`"))
                trimmed = inner[1:-1] if inner[:1] == inner[-1:] == " " and inner.strip() else inner
                out.pieces.append(Piece(trimmed, s, e, literal=True))
            elif name == "autolink":
                out.pieces.append(Piece(m[0][1:-1], s, e, literal=True))
            elif name == "link" and m["where"] == "[]":  # the words are the reference
                out.ranges = [r for r in out.ranges if not (s <= r[0] and r[3] <= e)]
                out.pieces.append(Piece(visible(m["label"], kind).text, s, e, literal=True))
            elif name == "link":
                walk(s + 1, s + 1 + len(m["label"]))
        prose(at, b)

    walk(0, len(raw))
    return out


def located(literals: list[str], text: str) -> list[tuple[int, int]]:
    """The one place of each literal in a text, as whole words; raises where one is lost, repeated or meets another."""
    found: list[tuple[int, int]] = []
    for value in literals:
        edge = lambda c, look: look if c == "_" or c.isalnum() else ""
        places = [m.start() for m in re.finditer(edge(value[:1], r"(?<!\w)") + f"(?={re.escape(value)}{edge(value[-1:], r'(?!\w)')})", text)] if value else []
        if len(places) != 1:
            raise ReviewError("a protected literal is missing or ambiguous")
        found.append((places[0], places[0] + len(value)))
    if any(a[1] > b[0] for a, b in zip(sorted(found), sorted(found)[1:])):
        raise ReviewError("protected literals overlap")
    return found


def body_of(source: str, kind: str, start: int, end: int) -> tuple[int, int]:
    """Where the body of a block lies in its source."""
    if kind == "table_cell":
        return start, end
    a = LEAD.match(source, start, end).end()
    return a, max(a, TRAIL.search(source, a, end).start())


@dataclass
class ReviewBlock:
    id: str
    type: str
    start: int  # of the body
    end: int
    seen: Visible

    @property
    def text(self) -> str:
        return self.seen.text


def review_blocks(source: str) -> list[ReviewBlock]:
    """The blocks of a document with words to review, numbered in order. HTML blocks have no form for review and raise, as do doubtful literals."""
    out = []
    for kind, s, e in markdown.blocks(source):
        if kind == "html_text":
            raise ReviewError(f"block {len(out) + 1}: HTML has no form for review")
        a, b = body_of(source, kind, s, e)
        try:
            seen = visible(source[a:b], kind)
            if not any(c.isalnum() for p in seen.pieces if not p.literal for c in p.text):
                continue
            located([t for t, _ in seen.literals(source[a:b])], seen.text)
        except ReviewError as error:
            raise ReviewError(f"block {len(out) + 1}: {error}") from error
        out.append(ReviewBlock(str(len(out) + 1), kind, a, b, seen))
    return out


def escaped_with(target: str, literals: list[tuple[str, str]]) -> tuple[str, Callable[[int], int | None]]:
    """(a reviewed text as Markdown with its literals as they were spelt, where a place of it is; None inside a literal)."""
    places = sorted(zip(located([value for value, _ in literals], target), (spelt for _, spelt in literals)))
    steps = [markdown.escaped(c) for c in target]
    for (s, e), spelt in places:
        steps[s:e] = [spelt] + [""] * (e - s - 1)
    offsets = np.cumsum([0, *map(len, steps)])
    inside = {p for (s, e), _ in places for p in range(s + 1, e)}
    return "".join(steps), lambda place: None if place in inside else int(offsets[place])


def wrapped(source: str, block: ReviewBlock, body: str) -> str:
    """The new body with the container marks of its block before every further line."""
    raw = source[block.start : block.end]
    if "\n" not in body and "\r" not in body:
        return body
    if block.type in ("table_cell", "heading") and "\n" not in raw:
        raise ReviewError("a cell or heading must stay on one line")
    ends = list(LINE_END.finditer(raw))
    known = [AGAIN.match(raw, m.end())[0] for m in ends]
    line = source.rfind("\n", 0, block.start) + 1
    further = known[-1] if known else re.sub(r"[^>\s]", " ", source[line : block.start])  # list marks become spaces
    ending = ends[0][1] if ends else "\r\n" if "\r\n" in source else "\n"
    first, *rest = re.split(r"\r\n|\r|\n", body)
    return first + "".join(ending + (known[k] if k < len(known) else further) + x for k, x in enumerate(rest))


def finalized_block(source: str, block: ReviewBlock, target: str, aligner: Callable | None = None) -> tuple[str, list[dict]]:
    """(the block's new body, issues). Its formatting goes where the aligner puts its words; without one only what wraps the whole block stays."""
    raw, seen = source[block.start : block.end], block.seen
    if target == seen.text:
        return raw, []
    alignment = al.components(seen.text, target, aligner(seen.text, target) if aligner else [])
    scopes = [
        {"id": str(k), "source": span, "link_target": raw[r[2] :] if raw[r[0]] == "[" else None} for k, (r, span) in enumerate(zip(seen.ranges, seen.scopes())) if span[0] < span[1]
    ]
    done, issues = al.project(alignment, scopes, complete_segment=True)
    body, place = escaped_with(target, seen.literals(raw))
    if seen.hard_breaks:
        issues.append({"id": "line_breaks", "action": "dropped", "reason": "hard_line_breaks_not_projected"})
    items = []
    for p in done:
        spans = [(place(s), place(e)) for s, e in p["targets"]]
        if any(None in span for span in spans):
            issues.append({"id": p["id"], "action": "dropped", "reason": "partial_protected_content"})
            continue
        o, i, c, e = seen.ranges[int(p["id"])]
        items.append(Wrapped(p["id"], raw[o:i], raw[c:e], spans, p["link_target"] is not None))
    out, dropped, placed = rendered(body, items)
    gone = {d["id"] for d in dropped}
    if not set(placed) <= set(markdown.inline_syntax(out)[1]):  # delimiters that do not open or close where they stand
        out, dropped = body, [{"id": i.id, "action": "dropped", "reason": "markdown_wrapper_validation"} for i in items]
        gone = {d["id"] for d in dropped}
    return wrapped(source, block, out), [i for i in issues if i["id"] not in gone] + dropped


def finalized_document(source: str, targets: dict[str, str], aligner: Callable | None = None) -> tuple[str, list[tuple[str, dict]]]:
    """(the document with the reviewed text of each block, ``(block, issue)``). Raises unless there is one text for each block and the result reads as they say."""
    blocks = review_blocks(source)
    if {b.id for b in blocks} != set(targets):
        raise ReviewError("the reviewed texts don't fit the blocks")
    wanted = {k: re.sub(r"[\r\n]+$", "", v).replace("\r\n", "\n") for k, v in targets.items()}
    parts, issues, at = [], [], 0
    for b in blocks:
        body, noted = finalized_block(source, b, wanted[b.id], aligner)
        parts += [source[at : b.start], body]
        issues += [(b.id, i) for i in noted]
        at = b.end
    new = "".join([*parts, source[at:]])
    if [(b.id, b.type, b.text) for b in review_blocks(new)] != [(b.id, b.type, wanted[b.id]) for b in blocks]:
        raise ReviewError("the reviewed text changes blocks or visible contents")
    if [kind for kind, _, _ in markdown.blocks(new)] != [kind for kind, _, _ in markdown.blocks(source)]:
        raise ReviewError("the reviewed text changes the structure of blocks")
    return new, issues




def literals_checked(blocks: DataFrame, keys: list[str], literals: str, text: str) -> DataFrame:
    """``(keys, sound)``: whether a text holds each of the literals at one place."""
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}

    def make():
        def work(row: dict) -> list[tuple]:
            try:
                located(list(row[literals] or ()), row[text] or "")
            except ReviewError:
                return [(*(row[k] for k in keys), False)]
            return [(*(row[k] for k in keys), True)]

        return work

    return flat_map(blocks.select(*keys, literals, text), ", ".join([*(f"{k} {fields[k]}" for k in keys), "sound boolean"]), make)


SPANS = "array<struct<start_pos:int,end_pos:int>>"
FORMATTING = "array<struct<outer_start:int,inner_start:int,inner_end:int,outer_end:int>>"


def markdown_blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ord, id, type, original, start_pos, end_pos, formatting, protected, protected_spans, error)`` of all documents.

    ``formatting`` is local to ``start_pos..end_pos``, the body of the block, and ``protected_spans`` are places of the literals in ``original``. A document that cannot be reviewed gives one row with its error;
    null and empty documents have no blocks.
    """
    names = ("outer_start", "inner_start", "inner_end", "outer_end")

    def make():
        def work(row: dict) -> list[tuple]:
            source = row[text] or ""
            try:
                found = review_blocks(source)
            except ReviewError as e:
                return [(row[key], *[None] * 9, str(e))]
            out = []
            for n, b in enumerate(found):
                literals = [t for t, _ in b.seen.literals(source[b.start : b.end])]
                spans = [{"start_pos": s, "end_pos": e} for s, e in sorted(located(literals, b.text))]
                out.append((row[key], n, b.id, b.type, b.text, b.start, b.end, [dict(zip(names, r)) for r in b.seen.ranges], literals, spans, None))
            return out

        return work

    schema = f"{key} {documents.schema[key].dataType.simpleString()}, ord int, id string, type string, original string, start_pos int, end_pos int, formatting {FORMATTING}, protected array<string>, protected_spans {SPANS}, error string"
    return flat_map(documents.select(key, text), schema, make)
