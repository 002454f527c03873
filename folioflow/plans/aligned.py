"""Aligned translation: formatting is taken out, the bare text is translated and aligned, and the formatting goes where its words went."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from folioflow.functions.arrow import flat_map_rows
from folioflow.functions.backends import Backend, Steps, answered, together
from folioflow.operators import alignment as al
from folioflow.operators import markdown, odt
from folioflow.operators import model_input as mi
from folioflow.operators.chunking import ENDING, GAP, split_text
from folioflow.operators.rendering import Wrapped, crossing, rendered


LEAD = re.compile(r"(?:[ \t]*(?:>[ ]?|[-+*][ \t]+|\d{1,9}[.)][ \t]+))*(?:[ \t]*#{1,6}[ \t]+)?")
TRAIL = re.compile(r"(?:[ \t]+#+)?[ \t]*[\r\n]*$")


def sentences(text: str) -> list[tuple[str, str]]:
    out, start = [], 0
    for m in GAP.finditer(text):
        if ENDING.search(text[start : m.start()][-8:]):
            out.append((text[start : m.start()], m[0]))
            start = m.end()
    return [*out, (text[start:], "")] if start < len(text) else out


def aligned_units(prepared: mi.ModelInput, limit: int, aligner: Callable) -> Steps[tuple[dict, list[str]]]:
    """(the alignment of a whole input from calls sentence by sentence, reasons of the calls that failed).

    Units that are only a marker bypass the model, and what fails stays as it is and unaligned. Where the aligner refuses a unit, its
    translation stays but no word of it is linked. ``counts`` of the result holds calls of the model and the aligner, refusals and bypassed units.
    """
    pieces = [(part or "", separator) for sentence, gap in sentences(prepared.text) for part, separator in [*split_text(sentence, lambda s: len(s) <= limit), (None, gap)]]
    sent = [bool(words.strip()) and words.strip() not in prepared.tokens for words, _ in pieces]
    replies = iter((yield [words for (words, _), ask in zip(pieces, sent) if ask]))
    whole: dict = {"source": "", "target": "", "links": [], "unaligned": [], "ambiguous": [], "units": []}
    counts = whole["counts"] = {"translation_calls": sum(sent), "alignment_calls": 0, "alignment_failures": 0, "protected_units": 0}
    reasons = []
    for (words, separator), ask in zip(pieces, sent):
        a, b, out = len(whole["source"]), len(whole["target"]), words
        if ask:
            done, reason = next(replies)
            pairs: Iterable = []
            if not reason:
                counts["alignment_calls"] += 1
                try:
                    pairs = aligner(words, done)
                except al.AlignmentError:
                    counts["alignment_failures"] += 1
            one = al.components(words, words if reason else done, pairs)
            out = one["target"]
            whole["links"] += [([(s + a, e + a) for s, e in x], [(s + b, e + b) for s, e in y]) for x, y in one["links"]]
            whole["unaligned"] += [(s + a, e + a) for s, e in one["unaligned"]]
            if reason:
                reasons.append(reason)
            else:
                whole["units"].append(((a, a + len(words)), (b, b + len(out))))
        elif words.strip():
            counts["protected_units"] += 1
            whole["links"].append(([(a, a + len(words))], [(b, b + len(words))]))
        whole["source"] += words + separator
        whole["target"] += out + separator
    return whole, reasons


def intervals_left(text: str, start: int, end: int, opaque: list[tuple[int, int]]) -> str:
    """What opaque ranges leave of a stretch of text."""
    return "".join(text[a:b] for a, b in al.subtract((start, end), sorted(opaque)))


def aligned_body(text: str) -> tuple[str, str, str]:
    """A segment's prefix of containers and headings, its prose, and its closing marks with the line end."""
    lead = LEAD.match(text)[0]
    trail = TRAIL.search(text, len(lead))[0]
    return lead, text[len(lead) : len(text) - len(trail)], trail


def translate_markdown(text: str, backend: Backend, limit: int = 1_000, aligner: Callable = al.by_position) -> tuple[str, list[dict]]:
    """(the translated segment with its formatting, issues) of one text."""
    return answered([markdown_steps(text, limit, aligner)], backend)[0]


def markdown_steps(text: str | None, limit: int = 1_000, aligner: Callable = al.by_position) -> Steps[tuple[str | None, list[dict]]]:
    """(the translated segment with its formatting, issues). The source comes back where markers are lost or the result is unsound.

    Prefixes and line ends of the block never reach the model. A null text stays null.
    """
    if text is None:
        return None, []
    lead, body, trail = aligned_body(text)
    out, issues = yield from _translated_body(body, limit, aligner)
    return lead + out + trail, issues


def _translated_body(text: str, limit: int, aligner: Callable) -> Steps[tuple[str, list[dict]]]:
    opaque, ranges, _ = markdown.inline_syntax(text)
    # a wrapper around nothing to align, or around outer white space, stays with its content as it is
    fixed = [(o, e) for o, i, c, e in ranges if text[i:c] != text[i:c].strip() or not any(x.isalnum() for x in intervals_left(text, i, c, opaque))]
    ranges = [r for r in ranges if not any(o <= r[0] and r[3] <= e for o, e in fixed)]
    wrappers = sorted({(r[0], r[1]) for r in ranges} | {(r[2], r[3]) for r in ranges})
    protected = [o for o in opaque if o not in wrappers and not any(a <= o[0] and o[1] <= e for a, e in fixed)] + fixed
    prepared = mi.prepare(text, mi.partition(len(text), protected, wrappers))
    if prepared.text is None:
        return text, []
    a, _ = yield from aligned_units(prepared, limit, aligner)
    keep = lambda reason: (text, [{"id": "", "action": "retained_original", "reason": reason}])
    try:
        a = al.anchored(a, prepared.tokens, prepared.prefix) if prepared.tokens else a
    except al.AlignmentError as e:
        return keep(str(e))
    scopes = []
    for k, (_, inner, end, _) in enumerate(ranges):
        s, e = prepared.position(inner), prepared.position(end)
        if s < e:
            scopes.append({"id": str(k), "source": (s, e), "link_target": text[end:] if text[ranges[k][0]] == "[" else None})
    done, issues = al.project(a, scopes)
    issues += [{"id": "", "action": "dropped", "reason": "alignment_failed"}] * a["counts"]["alignment_failures"]
    bare, moves = mi.restore(a["target"], prepared)
    items = []
    for p in done:
        o, i, c, e = ranges[int(p["id"])]
        items.append(Wrapped(p["id"], text[o:i], text[c:e], [(mi.moved(s, moves), mi.moved(t, moves)) for s, t in p["targets"]], p["link_target"] is not None))
    out, dropped, placed = rendered(bare, items)
    if not set(placed) <= set(markdown.inline_syntax(out)[1]):  # every wrapper has to be read again where it was put
        gone = {d["id"] for d in dropped}
        dropped = [*dropped, *({"id": i.id, "action": "dropped", "reason": "markdown_wrapper_validation"} for i in items if i.id not in gone)]
        out = bare
    if errors := aligned_errors(text, out):
        return keep("; ".join(errors))
    gone = {d["id"] for d in dropped}
    return out, [i for i in issues if i["id"] not in gone or i["action"] == "dropped"] + dropped


def unit_counts(segments: DataFrame, key: str, backend: Callable[[], Backend], limit: int = 1_000) -> DataFrame:
    """``(key, translation_calls, alignment_calls, alignment_failures, protected_units)`` of the aligned path over Markdown segments ``(key, text)``."""
    names = ("translation_calls", "alignment_calls", "alignment_failures", "protected_units")

    def steps(text: str | None) -> Steps[dict]:
        body = aligned_body(text or "")[1]
        opaque, ranges, _ = markdown.inline_syntax(body)
        wrappers = sorted({(r[0], r[1]) for r in ranges} | {(r[2], r[3]) for r in ranges})
        prepared = mi.prepare(body, mi.partition(len(body), [o for o in opaque if o not in wrappers], wrappers))
        if prepared.text is None:
            return dict.fromkeys(names, 0)
        return (yield from aligned_units(prepared, limit, al.by_position))[0]["counts"]

    def make():
        model = backend()
        return lambda rows: [(row[key], *(counts[n] for n in names)) for row, counts in zip(rows, answered([steps(row["text"]) for row in rows], model))]

    return flat_map_rows(segments.select(key, "text"), f"{key} {segments.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} int" for n in names), make)


def aligned_errors(before: str, after: str) -> list[str]:
    """What a translation whose formatting may have gone must still keep: code, images, addresses, entities and elements that wrap no words."""

    def kept(text: str) -> list[tuple[str, str]]:
        _, ranges, signature = markdown.inline_syntax(text)
        tags = [text[a:b] for r in ranges for a, b in ((r[0], r[1]), (r[2], r[3])) if text[a] == "<"]
        out = [x for x in signature if x[0] not in ("emphasis", "link", "break")]
        for t in tags:
            out.remove(("html", t))
        return sorted(out)

    return [] if kept(before) == kept(after) else ["rendered_alignment_mismatch"]


def translate_aligned(segments: DataFrame, key: str, backend: Callable[[], Backend], limit: int = 1_000) -> DataFrame:
    """``(key, translated, issues)`` of Markdown segments ``(key, text)``; each issue is ``action: reason``."""

    def make():
        model = backend()

        def work(rows: list[dict]) -> list[tuple]:
            done = answered([markdown_steps(row["text"], limit) for row in rows], model)
            return [(row[key], out, [f"{i['action']}: {i['reason']}" for i in issues]) for row, (out, issues) in zip(rows, done)]

        return work

    return flat_map_rows(segments.select(key, "text"), f"{key} {segments.schema[key].dataType.simpleString()}, translated string, issues array<string>", make)


FRAME = re.compile(r"<(?:[^\s:>]+:)?frame[\s/>]")
PAGE_BREAK = re.compile(r"<(?:[^\s:>]+:)?soft-page-break\s*/>")
LINK = re.compile(r"<(?:[^\s:>]+:)?a[\s/>]")
SPAN = re.compile(r"<(?:[^\s:>]+:)?span\s+(?:[^\s=:>]+:)?style-name\s*=\s*[\"']([^\"']*)[\"']\s*>")
IDENTITY = re.compile(r"\s(?:xmlns(?::[^\s=]+)?|xml:id)\s*=")


def odt_lead(block: odt.Block) -> int:
    """Where the body begins behind frames and soft page breaks at the head of a paragraph that no wrapper holds."""
    end = 0
    for s, e in block.spans:
        if not (FRAME.match(block.text, s) or PAGE_BREAK.fullmatch(block.text, s, e)) or block.text[end:s].strip() or any(r[0] < e for r in block.ranges):
            break
        end = e
    return end


def odt_scopes(block: odt.Block, language: frozenset[str]) -> dict[int, str | None]:
    """The wrappers that carry formatting, by their number, with the opening of links. Empty and blank styles and mere language marks are none."""
    out = {}
    for k, (o, i, c, _) in enumerate(block.ranges):
        opening = block.text[o:i]
        link = opening if LINK.match(opening) else None
        style = SPAN.fullmatch(opening)
        if i < c and not (style and style[1] in language) and (link or block.text[i:c].strip()):
            out[k] = link
    return out


def odt_rendered(text: str, fragments: list[str], items: list[Wrapped]) -> tuple[str, list[dict]]:
    """Prose escaped, opaque content as it was and in order, wrappers at their places; crossing wrappers and links that meet are dropped."""
    opaque, prose, at = [], [], 0
    for f in [*fragments, None]:
        to = len(text) if f is None else text.find(f, at)
        if to < 0 or any(x in text[at:to] for x in fragments):
            raise odt.OdtError("protected content changed")
        prose.append(text[at:to])
        opaque += [] if f is None else [(to, to + len(f))]
        at = to + len(f or "")
    if not "".join(prose).strip():
        raise odt.OdtError("no prose is left")
    if odt.FORBIDDEN.search(text):
        raise odt.OdtError("a character is not allowed in XML")
    if any(a < x < b for a, b in opaque for i in items for t in i.targets for x in t):
        raise odt.OdtError("a wrapper would cut protected content")
    clash = crossing(items)
    events: dict[int, list] = {}
    for order, i in enumerate(k for k in items if k.id not in clash):
        for s, e in i.targets:
            events.setdefault(s, []).append((1, -e, order, i.opening))
            events.setdefault(e, []).append((0, -s, -order, i.closing))
    places = sorted({0, len(text), *events, *(x for o in opaque for x in o)})
    out = []
    for a, b in zip(places, [*places[1:], None]):
        out += [e[3] for e in sorted(events.get(a, []))]
        if b is not None:
            out.append(text[a:b] if (a, b) in opaque else escape(text[a:b]))
    xml = "".join(out)
    names = {m for m in re.findall(r"[<\s/]([^\s:<>=/\"']+):[^\s<>=/\"']+", "".join([*fragments, *(i.opening for i in items)])) if m not in ("xml", "xmlns")}
    odt.xml_root(("<r" + "".join(f' xmlns:{n}="x:{n}"' for n in sorted(names)) + f">{xml}</r>").encode())
    return xml, [{"id": k, "action": "dropped", "reason": "conflicting_odt_ranges"} for k in sorted(clash)]


def _protected_block(block: odt.Block, limit: int) -> Steps[tuple[str, list[str]]]:
    """(the translation with every token of the block behind a marker, as XML, reasons of failed calls)."""
    prepared = mi.prepare(block.text, mi.partition(len(block.text), block.spans, []))
    if prepared.text is None:
        return odt.rendered(block, block.text).decode(), []
    a, reasons = yield from aligned_units(prepared, limit, lambda s, t: [])
    if reasons:
        return "", reasons
    if prepared.tokens:
        al.anchored(a, prepared.tokens, prepared.prefix)
    return odt.rendered(block, mi.restore(a["target"], prepared)[0]).decode(), []


def translate_block(block: odt.Block, backend: Backend, limit: int = 1_000, aligner: Callable = al.by_position, language: frozenset[str] = frozenset()) -> tuple[str | None, list[dict]]:
    """(the block's new inner XML, issues) of one block."""
    return answered([block_steps(block, limit, aligner, language)], backend)[0]


def block_steps(block: odt.Block, limit: int = 1_000, aligner: Callable = al.by_position, language: frozenset[str] = frozenset()) -> Steps[tuple[str | None, list[dict]]]:
    """(the block's new inner XML, issues); None keeps its bytes.

    A block whose wrappers declare namespaces or carry identities is translated with all its tokens protected. The source stays if
    the model fails, markers are lost or the result is unsound.
    """
    keep = lambda reason: (None, [{"id": "", "action": "retained_original", "reason": reason}])
    try:
        if any(IDENTITY.search(block.text[r[0] : r[1]]) for r in block.ranges):
            out, reasons = yield from _protected_block(block, limit)
            return keep("; ".join(reasons)) if reasons else (out, [])
        lead = odt_lead(block)
        text = block.text[lead:]
        ranges = [tuple(x - lead for x in r) for r in block.ranges]
        wrappers = sorted({w for o, i, c, e in ranges for w in ((o, i), (c, e)) if w[0] < w[1]})
        protected = [(s - lead, e - lead) for s, e in block.spans if s >= lead and (s - lead, e - lead) not in wrappers]
        parts = mi.partition(len(text), protected, wrappers)
        prepared = mi.prepare(text, parts)
        if prepared.text is None:
            return None, []
        a, reasons = yield from aligned_units(prepared, limit, aligner)
        if reasons:
            return keep("; ".join(reasons))
        if not a["target"].strip():
            return keep("the translation is empty")
        a = al.anchored(a, prepared.tokens, prepared.prefix) if prepared.tokens else a
        kinds = odt_scopes(block, language)
        issues = [{"id": str(k), "action": "dropped", "reason": "no_visible_content"} for k, (_, i, c, _) in enumerate(ranges) if i == c]
        scopes = []
        for k, link in kinds.items():
            s, e = prepared.position(ranges[k][1]), prepared.position(ranges[k][2])
            if s < e:
                scopes.append({"id": str(k), "source": (s, e), "link_target": link})
            else:
                issues.append({"id": str(k), "action": "dropped", "reason": "no_visible_content"})
        done, noted = al.project(a, scopes, complete_segment=True)
        bare, moves = mi.restore(a["target"], prepared)
        items = []
        for p in sorted(done, key=lambda p: int(p["id"])):
            o, i, c, e = ranges[int(p["id"])]
            items.append(Wrapped(p["id"], text[o:i], text[c:e], [(mi.moved(s, moves), mi.moved(t, moves)) for s, t in p["targets"]], p["link_target"] is not None))
        xml, dropped = odt_rendered(bare, [text[s:e] for s, e, kind in parts if kind == "protected"], items)
    except (al.AlignmentError, odt.OdtError) as e:
        return keep(str(e))
    gone = {d["id"] for d in dropped}
    return block.text[:lead] + xml, [*issues, *(n for n in noted if n["id"] not in gone), *dropped]


def translated_package(package: bytes, backend: Backend, limit: int = 1_000, aligner: Callable = al.by_position) -> tuple[bytes, list[tuple]]:
    """(the package with all blocks that can be edited translated, ``(part, id, new XML or None, issues)`` of each of them)."""
    return answered([package_steps(package, limit, aligner)], backend)[0]


def package_steps(package: bytes, limit: int = 1_000, aligner: Callable = al.by_position) -> Steps[tuple[bytes, list[tuple]]]:
    """The same as steps that ask for all blocks of the package at once."""
    parts = odt.inspect(package)
    language = odt.language_styles(parts)
    kept = frozenset().union(*(odt.protected_styles(data) for data in parts.values()))
    found = {part: odt.blocks(data, part, kept) for part, data in parts.items()}
    open_ = [(part, b) for part, blocks in found.items() for b in blocks if b.reason is None]
    done = yield from together([block_steps(b, limit, aligner, language) for _, b in open_])
    rows = [(part, b.id, *out) for (part, b), out in zip(open_, done)]
    new = {part: odt.patched(data, found[part], {name: xml.encode() for p, name, xml, _ in rows if p == part and xml is not None}) for part, data in parts.items()}
    return odt.repacked(package, new), rows


def translate_aligned_odt(packages: DataFrame, key: str, content: str, backend: Callable[[], Backend], limit: int = 1_000) -> DataFrame:
    """``(key, content, issues, error)`` of packages; issues are ``part segment_id action: reason``. A bad package gives its error and no content."""

    def steps(package: bytes | None) -> Steps[tuple]:
        try:
            out, rows = yield from package_steps(package or b"", limit)
        except odt.OdtError as e:
            return None, [], str(e)
        return out, [f"{part} {name} {i['action']}: {i['reason']}" for part, name, _, found in rows for i in found], None

    def make():
        model = backend()
        return lambda rows: [(row[key], *out) for row, out in zip(rows, answered([steps(row[content]) for row in rows], model))]

    schema = f"{key} {packages.schema[key].dataType.simpleString()}, content binary, issues array<string>, error string"
    return flat_map_rows(packages.select(key, content), schema, make, rows=50)  # packages are large
