"""Markdown as editable regions with exact offsets: a documented subset of CommonMark, with tables and strike-through.

Blocks: front matter, fenced and indented code, headings of both kinds, lists, block quotes, tables, HTML blocks, thematic breaks,
reference definitions and paragraphs. Inline: code, emphasis, strong, strike-through, links, images, autolinks, HTML, escapes
and hard breaks. Whatever is in doubt stays protected, so a source that is written back is never harmed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from folioflow.functions.arrow import flat_map
from folioflow.operators import html_text
from folioflow.operators.rendering import CLOSING, INLINE_TAGS, OPENING

CONTAINER = re.compile(r"[ ]{0,3}(?:(?P<quote>>[ ]?)|(?P<bullet>[-+*])(?P<pad>[ ]{1,4}|\t|$)|(?P<number>\d{1,9}[.)])(?P<pad2>[ ]{1,4}|\t|$))")
FENCE = re.compile(r"[ ]{0,3}(`{3,}(?!.*`)|~{3,})")
ATX = re.compile(r"[ ]{0,3}#{1,6}(?:[ \t]+|$)(?P<text>.*?)(?:[ \t]+#+)?[ \t]*$")
SETEXT = re.compile(r"[ ]{0,3}(?:=+|-+)[ \t]*$")
RULE = re.compile(r"[ ]{0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
DELIMITERS = re.compile(r"[ ]{0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
REFERENCE = re.compile(r"[ ]{0,3}\[[^\[\]]+\]:[ \t]*\S+")
HTML_BLOCK = re.compile(r"[ ]{0,3}<(?:/?(?:" + "|".join(sorted(html_text.BLOCK)) + r"|html|body|head|iframe|script|style|pre|textarea|link|meta|title|details|summary)(?=[\s/>]|$)|!--|\?|![A-Z])", re.I)

INLINE = re.compile(
    r"""(?P<escape>\\[!-/:-@\[-`{-~])|(?P<code>(?P<t>`+)(?!`)(?:(?!(?P=t)(?!`)).)+?(?<!`)(?P=t)(?!`))|(?P<autolink><[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*>|<[\w.+-]+@[\w.-]+>)
    |(?P<html></?[A-Za-z][^<>]*>|<!--.*?-->)|(?P<image>!\[[^\[\]]*\](?:\([^()\s]*(?:\s+"[^"]*")?\)|\[[^\[\]]*\]))|(?P<link>\[(?P<label>[^\[\]]*)\](?P<where>\([^()\s]*(?:\s+"[^"]*")?\)|\[[^\[\]]*\]))
    |(?P<entity>&(?:\#\d+|\#[xX][0-9a-fA-F]+|\w+);)|(?P<run>\*{1,3}|_{1,3}|~~)|(?P<break>[ ]{2,}(?=\r?\n)|\\(?=\r?\n))""",
    re.X | re.S,
)


def inline_syntax(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]], list[tuple[str, str]]]:
    """(protected ranges, ranges ``(outer_start, inner_start, inner_end, outer_end)`` of emphasis, links and inline elements, signature of the syntax)"""
    opaque, ranges, signature = [], [], []
    stack: list[tuple[str, int, int]] = []
    tags: list[tuple[str, int, int]] = []  # open inline elements
    pairs: list[tuple[int, int, int, int]] = []
    todo = list(INLINE.finditer(text))
    for m in todo:
        kind, s, e = m.lastgroup, m.start(), m.end()
        kind = next(k for k in ("escape", "code", "autolink", "html", "image", "link", "entity", "run", "break") if m[k] is not None)
        if kind == "link":
            a = s + 1 + len(m["label"])
            opaque += [(s, s + 1), (a, e)]
            ranges.append((s, s + 1, a, e))
            signature.append(("link", m["where"]))
            inner, nested, marks = inline_syntax(m["label"])
            opaque += [(x + s + 1, y + s + 1) for x, y in inner]
            ranges += [tuple(v + s + 1 for v in r) for r in nested]
            signature += marks
        elif kind == "run":
            before, after = text[s - 1 : s] or " ", text[e : e + 1] or " "
            can_open = not after.isspace() and (m[0][0] != "_" or not before.isalnum())
            can_close = not before.isspace() and (m[0][0] != "_" or not after.isalnum())
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == m[0]), None)
            if can_close and k is not None:
                _, a, b = stack[k]
                del stack[k:]
                opaque += [(a, b), (s, e)]
                ranges.append((a, b, s, e))
                signature.append(("emphasis", m[0]))
            elif can_open:
                stack.append((m[0], s, e))
        else:
            opaque.append((s, e))
            signature.append((kind, m[0] if kind in ("code", "html", "autolink", "image") else kind))
            if kind == "html":
                begin, end = OPENING.fullmatch(m[0]), CLOSING.fullmatch(m[0])
                if begin and begin[1].lower() in INLINE_TAGS and not m[0].endswith("/>"):
                    tags.append((begin[1].lower(), s, e))
                elif end and (k := next((i for i in range(len(tags) - 1, -1, -1) if tags[i][0] == end[1].lower()), None)) is not None:
                    pairs.append((tags[k][1], tags[k][2], s, e))
                    del tags[k:]
    # an element that crosses emphasis or a link wraps nothing for sure
    ranges += [p for p in pairs if not any(r[0] < p[0] < r[3] < p[3] or p[0] < r[0] < p[3] < r[3] for r in ranges)]
    return sorted(opaque), sorted(ranges, key=lambda r: (r[0], -r[3])), signature


def cells(line: str) -> list[tuple[int, int]]:
    """Places of the trimmed cells of a table row; a pipe behind a backslash does not part cells."""
    end = len(line.rstrip())
    start = len(line) - len(line.lstrip())
    start += line[start : start + 1] == "|"
    borders = [m.start() for m in re.finditer(r"(?<!\\)\|", line[start:end])]
    out, at = [], start
    for border in [*(start + b for b in borders), *([end] if not borders or start + borders[-1] < end - 1 else [])]:
        part = line[at:border]
        a = at + len(part) - len(part.lstrip())
        out.append((a, max(a, at + len(part.rstrip()))))
        at = border + 1
    return out


def blocks(source: str) -> list[tuple[str, int, int]]:
    """``(type, start, end)`` of the blocks with prose, in order: whole lines for paragraphs and headings, cells for tables, and HTML."""
    lines = source.splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    out: list[tuple[str, int, int]] = []
    n, i = len(lines), 0
    if lines and lines[0].strip() == "---":
        i = next((k + 1 for k in range(1, n) if lines[k].strip() in ("---", "...")), n)
    paragraph: tuple[str, int] | None = None
    lists: list[tuple[int, str]] = []  # indents and kinds of the lists around

    def close(upto: int) -> None:
        nonlocal paragraph
        if paragraph:
            out.append((paragraph[0], starts[paragraph[1]], starts[upto]))
            paragraph = None

    while i < n:
        body = lines[i].rstrip("\r\n")
        at, kind, began = 0, "paragraph", False
        indent = len(body) - len(body.lstrip())
        if body.strip() and not paragraph:
            while lists and indent < lists[-1][0]:
                lists.pop()
        while True:
            m = CONTAINER.match(body, at)
            if lists and not m and at == 0 and indent >= lists[-1][0] > 0:
                at = lists[-1][0]
                kind = lists[-1][1]
                m = CONTAINER.match(body, at)
            if not m or RULE.match(body, at):
                break
            if m["quote"] is None and not (m["pad"] or m["pad2"]):
                break
            if m["number"] and paragraph and not began and paragraph[0] != "numbered_item" and m["number"][:-1] != "1":
                break
            if m["quote"] is not None:
                kind = "blockquote" if kind == "paragraph" else kind
                began = began or not (paragraph and paragraph[0] == kind)
            else:
                kind, began = ("numbered_item" if m["number"] else "bullet_item"), True
                while lists and m.start() + len(m[0]) <= lists[-1][0] and lists[-1][0] > m.start() + 1:
                    lists.pop()
                lists.append((m.end(), kind))
            at = m.end()
            if m["pad"] == "" or m["pad2"] == "":
                break
        rest = body[at:]
        if not rest.strip():
            close(i)
            i += 1
            continue
        if began:
            close(i)
        f = FENCE.match(rest)
        if f:
            close(i)
            mark = f[1]
            i += 1
            while i < n and not re.match(rf"[ >]*{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i].rstrip("\r\n")):
                i += 1
            i += 1
            continue
        if paragraph is None and not began and re.match(r"(?: {4}|\t)", rest) and not lists:
            i += 1  # indented code
            continue
        if ATX.match(rest):
            close(i)
            out.append(("heading", starts[i], starts[i + 1]))
            i += 1
            continue
        if paragraph and not began and SETEXT.match(rest) and paragraph[0] in ("paragraph",):
            paragraph = ("heading", paragraph[1])
            close(i)
            i += 1
            continue
        if RULE.match(rest):
            close(i)
            i += 1
            continue
        if paragraph is None and HTML_BLOCK.match(rest):
            first = i
            while i < n and lines[i].strip():
                i += 1
            out.append(("html_text", starts[first], starts[i]))
            continue
        if paragraph is None and REFERENCE.match(rest):
            i += 1
            continue
        if paragraph is None and "|" in rest and i + 1 < n and "-" in lines[i + 1] and DELIMITERS.match(lines[i + 1].rstrip("\r\n")[at:]) and len(cells(rest)) == len(cells(lines[i + 1].rstrip("\r\n")[at:])):
            width, row = len(cells(rest)), i
            while row < n and lines[row].strip() and (row <= i + 1 or not CONTAINER.match(lines[row])):
                if row != i + 1:
                    line = lines[row].rstrip("\r\n")
                    out += [("table_cell", starts[row] + at + a, starts[row] + at + b) for a, b in cells(line[at:])[:width] if a < b]
                row += 1
            i = row
            continue
        if paragraph is None:
            paragraph = (kind, i)
        i += 1
    close(n)
    return out


def regions(source: str) -> list[tuple[int, int, str, str, list[tuple[int, int]]]]:
    """``(start, end, type, text, protected spans)`` of the regions with letters or digits to translate."""
    out = []
    context: list[tuple[str, bool]] = []
    for kind, s, e in blocks(source):
        text = source[s:e]
        if kind == "html_text":
            whole = html_text.layout(text, context)
            context = whole.stack
            if whole.safe:
                out += [(s + a, s + b, kind, part, spans) for a, b, part, spans in html_text.segments(text)]
            continue
        syntax = [m.span() for m in re.finditer(r"(?m)^[ \t]*(?:(?:>[ ]?|[-+*][ \t]+|\d{1,9}[.)][ \t]+)[ \t]*)*(?:#{1,6}[ \t]+)?", text) if m.end() > m.start()] if kind != "table_cell" else []
        syntax += [m.span() for m in re.finditer(r"[ \t]+#+[ \t]*(?=\r?\n|$)|(?m:^[ ]{0,3}(?:=+|-+)[ \t]*$)", text)] if kind == "heading" else []
        syntax += [m.span() for m in re.finditer(r"[ \t]*(?:\r\n|\r|\n)", text)]
        opaque = inline_syntax(text)[0]
        whole = html_text.layout(text, context, [x for x in opaque if not text[x[0] : x[1]].startswith("<")])
        context = whole.stack
        if not whole.safe:
            continue
        covered = sorted([*syntax, *opaque])
        free, at = [], 0
        for a, b in [*covered, (len(text), len(text))]:
            if a > at:
                free.append((at, a))
            at = max(at, b)
        free = [(max(a, c), min(b, d)) for a, b in free for c, d in whole.editable if a < d and c < b]
        if any(c.isalnum() for a, b in free for c in text[a:b]):
            out.append((s, e, kind, text, html_text.protected(text, free)))
    return out


def structure(text: str) -> list[tuple[str, str]]:
    """What a translation must keep of the inline syntax of a region."""
    return inline_syntax(text)[2]


def structure_errors(before: str, after: str) -> list[str]:
    a, b = sorted(structure(before)), sorted(structure(after))
    if len(a) != len(b):
        return ["markdown_token_count_changed"]
    return ["markdown_token_changed"] if a != b else []


def spliced(source: str, replacements: list[tuple[int, int, str]]) -> str:
    """The source with regions replaced; they must be in order and apart."""
    out, at = [], 0
    for s, e, text in replacements:
        if s < at:
            raise ValueError("regions overlap")
        out += [source[at:s], text]
        at = e
    return "".join([*out, source[at:]])


def escaped(text: str) -> str:
    """Prose as Markdown: a backslash before every ASCII punctuation mark but the comma."""
    return re.sub(r"([!-+\-./:-@\[-`{-~])", r"\\\1", text)


def markdown_regions(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, seg_no, start_pos, end_pos, type, text, protected_spans)`` of all documents."""
    schema = f"{key} {documents.schema[key].dataType.simpleString()}, seg_no int, start_pos int, end_pos int, type string, text string, protected_spans array<struct<start_pos:int,end_pos:int>>"

    def make():
        def work(row: dict) -> list[tuple]:
            found = regions(row[text] or "")
            return [(row[key], n, s, e, kind, part, [{"start_pos": a, "end_pos": b} for a, b in spans]) for n, (s, e, kind, part, spans) in enumerate(found, 1)]

        return work

    return flat_map(documents.select(key, text), schema, make)


def markdown_layouts(segments: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ranges, signature)``: wrappers of emphasis and links, and the syntax, of each segment."""
    ranges = "array<struct<outer_start:int,inner_start:int,inner_end:int,outer_end:int>>"
    names = ("outer_start", "inner_start", "inner_end", "outer_end")

    def make():
        def work(row: dict) -> list[tuple]:
            _, found, marks = inline_syntax(row[text] or "")
            return [(row[key], [dict(zip(names, r)) for r in found], [f"{a}: {b}" for a, b in marks])]

        return work

    return flat_map(segments.select(key, text), f"{key} {segments.schema[key].dataType.simpleString()}, ranges {ranges}, signature array<string>", make)


def rewrite_documents(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, same)``: whether the regions, spliced back with their own texts, give the source again."""

    def make():
        return lambda row: [(row[key], spliced(row[text] or "", [(s, e, part) for s, e, _, part, _ in regions(row[text] or "")]) == (row[text] or ""))]

    return flat_map(documents.select(key, text), f"{key} {documents.schema[key].dataType.simpleString()}, same boolean", make)
