"""Formatting put back into a translated text: wrappers at projected places, nested soundly, conflicts dropped."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Inline elements whose tags may wrap other text than before. Fixed values.
INLINE_TAGS = frozenset("strong em b i span a s u mark small sub sup".split())
OPENING = re.compile(r"<([A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?>")
CLOSING = re.compile(r"</([A-Za-z][A-Za-z0-9]*)\s*>")


@dataclass
class Wrapped:
    id: str
    opening: str
    closing: str
    targets: list[tuple[int, int]]
    link: bool = False


def allowed(opening: str, closing: str) -> bool:
    """Whether a pair is Markdown emphasis or a link, or an HTML tag of the list with its own end."""
    m = OPENING.fullmatch(opening)
    if m:
        return m[1].lower() in INLINE_TAGS and re.fullmatch(rf"</{m[1]}\s*>", closing, re.I) is not None
    return opening == "[" and closing.startswith(("](", "][")) or opening == closing and opening in ("*", "_", "**", "__", "***", "___", "~~")


def crossing(items: list[Wrapped]) -> set[str]:
    """Ids of items that meet another one without nesting, and of links that meet at all; both sides of a conflict are named."""
    spans = sorted((s, -e, i.id, i.link) for i in items for s, e in i.targets)
    bad: set[str] = set()
    open_: list[tuple[int, str, bool]] = []
    for s, minus_e, name, link in spans:
        e = -minus_e
        open_ = [o for o in open_ if o[0] > s]
        bad |= {x for end, other, linked in open_ if other != name and (end < e or link and linked) for x in (name, other)}
        open_.append((e, name, link))
    return bad


def render(text: str, items: list[Wrapped]) -> tuple[str, list[dict]]:
    """(the text with wrappers, issues). Ends come before beginnings at one place, and outer wrappers before inner ones."""
    out, issues, _ = rendered(text, items)
    return out, issues


def rendered(text: str, items: list[Wrapped]) -> tuple[str, list[dict], list[tuple[int, int, int, int]]]:
    """The same with the places ``(outer_start, inner_start, inner_end, outer_end)`` where wrappers stand in the result."""
    issues = [{"id": i.id, "action": "dropped", "reason": "unsupported_markdown_wrapper"} for i in items if not allowed(i.opening, i.closing)]
    good = [i for i in items if allowed(i.opening, i.closing)]
    clash = crossing(good)
    issues += [{"id": i.id, "action": "dropped", "reason": "conflicting_markdown_ranges"} for i in good if i.id in clash]
    events, spans = [], [(i, s, e) for i in good if i.id not in clash for s, e in i.targets]
    for order, (i, s, e) in enumerate(spans):
        events += [(s, 1, -e, order, i.opening), (e, 0, -s, -order, i.closing)]
    out, at, length = [], 0, 0
    opened: dict[int, tuple[int, int]] = {}
    placed = []
    for place, opening, _, order, words in sorted(events):
        out += [text[at:place], words]
        length += place - at
        if opening:
            opened[order] = (length, length + len(words))
        else:
            placed.append((*opened[-order], length, length + len(words)))
        length += len(words)
        at = place
    return "".join([*out, text[at:]]), issues, placed
