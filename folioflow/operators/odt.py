"""OpenDocument text: package checks, text blocks with exact byte places, and patched packages.

XML is first parsed for soundness, then cut into tokens by one pattern over the decoded part, so that everything that is not
replaced stays byte for byte. A fold over the tokens knows the elements around, the paragraphs they belong to, and why one of
them cannot be edited.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map
from folioflow.functions.lineage import cut_lineage

MIMETYPE = b"application/vnd.oasis.opendocument.text"
MOST_BYTES, MOST_XML = 256 << 20, 16 << 20
_NS = "urn:oasis:names:tc:opendocument:xmlns:"
# The namespaces and element names of the format, by how they are treated.
SPACES = {
    _NS + "office:1.0": "office", _NS + "text:1.0": "text", _NS + "table:1.0": "table", _NS + "drawing:1.0": "draw", _NS + "style:1.0": "style",
    _NS + "manifest:1.0": "manifest", _NS + "xsl-fo-compatible:1.0": "fo",
}
WRAPPERS = {"text:span", "text:a"}
FIELDS = {"text:page-number", "text:page-count", "text:sequence"}
OPAQUE = {"text:" + n for n in "s tab line-break bookmark bookmark-start bookmark-end soft-page-break".split()} | FIELDS | {"draw:frame"}
FLOW = {"office:" + n for n in "document-content body text".split()} | {"text:" + n for n in "list list-item list-header".split()}
FLOW |= {"table:" + n for n in "table table-header-rows table-rows table-row-group table-row table-cell".split()}
REGIONS = {"style:" + n for n in "header header-left header-first footer footer-left footer-first".split()}
VALUES = {"office:" + n for n in "value date-value time-value boolean-value string-value".split()}
UNSUPPORTED = ("unsupported_container", "unsupported_cell_value", "inline_content")

TOKEN = re.compile(r"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<!DOCTYPE|</[^>]*>|<[^!?/](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>|[^<]+", re.S)
TAG = re.compile(r"</?\s*([^\s/>]+)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*')")
FORBIDDEN = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


class OdtError(ValueError):
    pass


def xml_root(data: bytes) -> ET.Element:
    if b"<!DOCTYPE" in data:
        raise OdtError("document type declarations are not supported")
    try:
        data.decode("utf-8-sig")
        return ET.fromstring(data)
    except (ET.ParseError, UnicodeDecodeError) as e:
        raise OdtError("malformed XML") from e


def short(tag: str) -> str:
    space, _, name = tag[1:].rpartition("}") if tag[:1] == "{" else ("", "", tag)
    return f"{SPACES.get(space, '?')}:{name}"


def inspect(package: bytes) -> dict[str, bytes]:
    """The XML parts of a sound package, ``content.xml`` and perhaps ``styles.xml``; an OdtError says what is wrong with others."""
    try:
        with zipfile.ZipFile(io.BytesIO(package)) as z:
            entries = z.infolist()
            names = [e.filename for e in entries]
            for e in entries:
                path = e.orig_filename.rstrip("/").split("/")
                if any(c in e.orig_filename for c in "\0\\:") or any(p in ("", ".", "..") for p in path):
                    raise OdtError("a member's path is not allowed")
                if e.flag_bits & 1:
                    raise OdtError("the package is encrypted")
                if e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise OdtError("a member's compression is not supported")
                if e.filename.startswith("META-INF/") and "signatures" in e.filename.lower():
                    raise OdtError("the package is signed")
            if len(set(names)) < len(names):
                raise OdtError("a member occurs twice")
            if sum(e.file_size for e in entries) > MOST_BYTES:
                raise OdtError("the package is too large")
            if not {"mimetype", "content.xml", "META-INF/manifest.xml"} <= set(names):
                raise OdtError("a required member is missing")
            first = entries[0]
            if first.filename != "mimetype" or first.header_offset or first.compress_type != zipfile.ZIP_STORED or package[28:30] != b"\0\0":
                raise OdtError("mimetype must be the first member, stored and without extra fields")
            if z.read("mimetype") != MIMETYPE:
                raise OdtError("the package is no text document")
            parts = {}
            for name in ("META-INF/manifest.xml", "content.xml", "styles.xml"):
                if name in names:
                    if z.getinfo(name).file_size > MOST_XML:
                        raise OdtError("an XML part is too large")
                    parts[name] = z.read(name)
            _check_manifest(xml_root(parts.pop("META-INF/manifest.xml")), set(names))
    except (zipfile.BadZipFile, EOFError, zlib.error, NotImplementedError) as e:
        raise OdtError("the ZIP file is damaged") from e
    body = [c for c in xml_root(parts["content.xml"]) if short(c.tag) == "office:body"]
    if short(xml_root(parts["content.xml"]).tag) != "office:document-content" or len(body) != 1 or [short(c.tag) for c in body[0]] != ["office:text"]:
        raise OdtError("the content must have one text body")
    if "styles.xml" in parts and short(xml_root(parts["styles.xml"]).tag) != "office:document-styles":
        raise OdtError("the styles have another root")
    return parts


def _check_manifest(root: ET.Element, names: set[str]) -> None:
    manifest = "{" + _NS + "manifest:1.0}"
    if root.tag != manifest + "manifest":
        raise OdtError("the manifest has another root")
    if any(x.tag in (manifest + "encryption-data", manifest + "encrypted-key") for x in root.iter()):
        raise OdtError("the package is encrypted")
    kinds: dict[str, str | None] = {}
    for entry in root.findall(manifest + "file-entry"):
        path = entry.get(manifest + "full-path")
        if path is None or path in kinds:
            raise OdtError("a path of the manifest is missing or occurs twice")
        kinds[path] = entry.get(manifest + "media-type")
        if not path.endswith("/") and path not in names:
            raise OdtError("the manifest names a member that is missing")
    if kinds.get("/") != MIMETYPE.decode() or kinds.get("content.xml") != "text/xml" or "styles.xml" in names and kinds.get("styles.xml") != "text/xml":
        raise OdtError("the manifest does not match the members")


@dataclass
class Block:
    """A paragraph or heading. Places are bytes of its part; ``text`` holds decoded prose and the raw tokens in ``spans``."""

    id: str
    type: str
    start: int
    end: int = 0
    part: str = "content.xml"
    reason: str | None = None
    text: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    ranges: list[tuple[int, int, int, int]] = field(default_factory=list)
    frames: list[tuple[int, int]] = field(default_factory=list)
    context: str = ""  # the elements around it, from the root


def tokens(xml: str) -> Iterator[tuple[str, str, dict, int, int]]:
    """``(kind, name, attributes, start, end)`` in characters; names carry the usual prefixes whatever the document calls them."""
    scopes: list[dict[str, str]] = [{}]
    for m in TOKEN.finditer(xml):
        raw = m[0]
        if raw[0] != "<":
            yield "text", raw, {}, m.start(), m.end()
        elif raw.startswith("<![CDATA["):
            yield "odd", raw[9:-3], {}, m.start(), m.end()
        elif raw[1] in "!?":
            yield ("declaration" if raw.startswith("<?xml") else "odd"), "", {}, m.start(), m.end()
        else:
            closing = raw[1] == "/"
            have = {} if closing else {k: v[1:-1] for k, v in ATTRIBUTE.findall(raw)}
            if not closing:
                scopes.append(scopes[-1] | {k[6:] if k != "xmlns" else "": v for k, v in have.items() if k == "xmlns" or k.startswith("xmlns:")})
            scope = scopes[-1]
            full = lambda n, s=scope: (lambda p, x: f"{SPACES.get(s.get(p, ''), '?')}:{x}")(*n.split(":", 1)) if ":" in n else n
            name = full(TAG.match(raw)[1])
            if not closing:
                yield "open", name, {full(k): v for k, v in have.items() if not k.startswith("xmlns")}, m.start(), m.end()
            if closing or raw.endswith("/>"):
                scopes.pop()
                yield "close", name, {}, m.start() if closing else m.end(), m.end()


def supported(stack: list[str], part: str) -> bool:
    """Whether text may be edited inside these elements: the usual flow, and text boxes in frames that paragraphs own."""
    if part == "styles.xml":
        if stack[:3] != ["office:document-styles", "office:master-styles", "style:master-page"] or not set(stack[3:4]) <= REGIONS or len(stack) < 4:
            return False
        stack = stack[4:]
    k = 0
    while k < len(stack):
        if stack[k] in FLOW:
            k += 1
        elif stack[k : k + 2] == ["draw:frame", "draw:text-box"]:
            k += 2
        elif stack[k] in WRAPPERS | {"text:p", "text:h"}:
            while k + 1 < len(stack) and stack[k + 1] in WRAPPERS:
                k += 1
            if stack[k + 1 : k + 3] != ["draw:frame", "draw:text-box"]:
                return False
            k += 1
        else:
            return False
    return True


def blocks(data: bytes, part: str = "content.xml", protected_styles: frozenset[str] = frozenset()) -> list[Block]:
    """All paragraphs and headings of a part, in the order they begin, with the reason why some cannot be edited."""
    xml_root(data)
    xml = data.decode("utf-8")
    stack: list[str] = []
    open_: list[dict] = []
    done: list[tuple[int, Block]] = []
    cells: list[int] = []
    number = 0
    for kind, name, have, s, e in tokens(xml):
        if kind == "open":
            if name == "table:table-cell" and ("table:formula" in have or have.get("office:value-type", "string") != "string" or VALUES & have.keys()):
                cells.append(len(stack))
            for p in open_:
                if p["inside"] is not None:
                    continue
                if name in WRAPPERS:
                    p["tokens"].append((s, e))
                    p["wrappers"].append((len(stack), s, e))
                elif name in OPAQUE:
                    p["field"] |= name in FIELDS
                    p["inside"] = (len(stack), s, name)
                else:
                    p["odd"] = True
            if name in ("text:p", "text:h"):
                number += 1
                box = max((k + 1 for k, t in enumerate(stack) if t == "draw:text-box"), default=0)
                style = have.get("text:style-name") in protected_styles or any(p["style"] for p in open_)
                kind_ = "heading" if name == "text:h" else "list_item" if "text:list-item" in stack[box:] else "paragraph"
                block = Block(str(number) if part == "content.xml" else f"{part}:{number}", kind_, e, part=part, context="/".join(stack))
                open_.append(
                    {"depth": len(stack), "block": block, "n": number, "tokens": [], "wrappers": [], "ranges": [], "frames": [], "inside": None, "odd": False, "field": False,
                     "fits": supported(stack, part), "cell": bool(cells), "style": style, "plain": []}
                )
            stack.append(name)
        elif kind == "close":
            stack.pop()
            if cells and cells[-1] == len(stack):
                cells.pop()
            if open_ and open_[-1]["depth"] == len(stack):
                p = open_.pop()
                p["block"].end = max(s, p["block"].start) if s >= p["block"].start else p["block"].start
                done.append((p["n"], _finished(p, xml)))
            for p in open_:
                if p["inside"] is not None:
                    if p["inside"][0] == len(stack):
                        p["tokens"].append((p["inside"][1], e))
                        if p["inside"][2] == "draw:frame":
                            p["frames"].append((p["inside"][1], e))
                        p["inside"] = None
                elif p["wrappers"] and p["wrappers"][-1][0] == len(stack):
                    _, a, b = p["wrappers"].pop()
                    if e > b:
                        p["tokens"].append((s, e))
                    p["ranges"].append((a, b, s, e))
        elif kind == "text":
            if open_:
                open_[-1]["plain"].append(name)
        elif kind == "odd":
            for p in open_:
                p["odd"] |= p["inside"] is None
            if open_:
                open_[-1]["plain"].append(name)
    places = _byte_places(xml)
    for _, b in done:
        b.start, b.end = places(b.start), places(b.end)
        b.frames = [(places(a), places(c)) for a, c in b.frames]
    return [b for _, b in sorted(done, key=lambda x: x[0])]


def _byte_places(xml: str):
    if xml.isascii():
        return lambda k: k
    import numpy as np

    codes = np.frombuffer(xml.encode("utf-32-le"), dtype=np.uint32)
    sizes = np.r_[0, np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))]
    return lambda k: int(sizes[k])


def _decoded(prose: str) -> str:
    text = re.sub(r"\r\n?", "\n", prose)
    entity = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
    return re.sub(r"&(?:#x([0-9A-Fa-f]+)|#(\d+)|(\w+));", lambda m: chr(int(m[1], 16)) if m[1] else chr(int(m[2])) if m[2] else entity.get(m[3], m[0]), text)


def _finished(p: dict, xml: str) -> Block:
    b: Block = p["block"]
    plain = _decoded("".join(p["plain"]))
    b.frames = p["frames"]
    if p["style"]:
        b.reason = "protected_preformatted"
    elif not p["fits"]:
        b.reason = "unsupported_container"
    elif p["cell"]:
        b.reason = "unsupported_cell_value"
    elif p["odd"]:
        b.reason = "inline_content"
    elif not plain.strip():
        b.reason = "empty"
    b.text = plain
    if b.reason is None and p["tokens"]:
        pieces, at, size, prose, moved = [], b.start, 0, [], {}
        for s, e in sorted(p["tokens"]):
            words = _decoded(xml[at:s])
            pieces += [words, xml[s:e]]
            prose.append(words)
            size += len(words)
            b.spans.append((size, size + e - s))
            moved[s] = size
            size += e - s
            moved[e] = size
            at = e
        prose.append(_decoded(xml[at : b.end]))
        b.text = "".join([*pieces, prose[-1]])
        b.ranges = [tuple(moved[x] for x in r) for r in sorted(p["ranges"]) if all(x in moved for x in r)]
        words = "".join(prose)
        if not words.strip() or p["field"] and all(c.isspace() or c in "/|:;.,-–—()[]{}" for c in words):
            b.reason = "protected_only"
    return b


def rendered(block: Block, text: str) -> bytes:
    """A block's new text as XML: prose escaped, every protected token exactly once and in order, and some prose left."""
    fragments = [block.text[s:e] for s, e in block.spans]
    at, out, prose = 0, [], []
    for f in [*fragments, None]:
        to = len(text) if f is None else text.find(f, at)
        if to < 0 or any(x in text[at:to] for x in fragments):
            raise OdtError("protected content changed")
        prose.append(text[at:to])
        out += [escape(text[at:to]), f or ""]
        at = to + len(f or "")
    if not "".join(prose).strip():
        raise OdtError("no prose is left")
    if FORBIDDEN.search(text):
        raise OdtError("a character is not allowed in XML")
    return "".join(out).encode()


def patched(data: bytes, found: list[Block], replacements: dict[str, bytes]) -> bytes:
    """The part with blocks replaced. A paragraph inside another one's frame is patched within that frame's unchanged bytes."""

    def compose(start: int, end: int, inside: list[Block]) -> bytes:
        out, at = [], start
        todo = sorted(inside, key=lambda b: (b.start, -b.end))
        k = 0
        while k < len(todo):
            b = todo[k]
            children = [c for c in todo[k + 1 :] if c.start < b.end]
            if any(c.end > b.end for c in children):
                raise OdtError("blocks cross")
            body = replacements.get(b.id)
            if body is None:
                body = compose(b.start, b.end, children)
            else:
                for a, c in b.frames:  # the frame's bytes occur once in the new body
                    old = data[a:c]
                    new = compose(a, c, [x for x in children if a <= x.start and x.end <= c])
                    if new != old:
                        if body.count(old) != 1:
                            raise OdtError("a frame occurs more than once")
                        body = body.replace(old, new)
            out += [data[at : b.start], body]
            at = b.end
            k += 1 + len(children)
        return b"".join([*out, data[at:end]])

    return compose(0, len(data), found)


def written(package: bytes, replacements: dict[str, str]) -> bytes:
    """The package with texts replaced by block id; all other members stay byte for byte, and the result is inspected again."""
    parts = inspect(package)
    new = {}
    for part, data in parts.items():
        found = blocks(data, part)
        ids = {b.id: b for b in found}
        mine = {k: rendered(ids[k], v) if ids[k].spans else escape(v).encode() for k, v in replacements.items() if k in ids}
        if any(ids[k].reason for k in mine):
            raise OdtError("a block that cannot be edited was to be replaced")
        new[part] = patched(data, found, mine)
    return repacked(package, new)


def repacked(package: bytes, new: dict[str, bytes]) -> bytes:
    """The package with parts replaced, inspected again."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as old, zipfile.ZipFile(buffer, "w") as z:
        for entry in old.infolist():
            z.writestr(entry, new.get(entry.filename, old.read(entry.filename)), compress_type=entry.compress_type)
    inspect(buffer.getvalue())
    return buffer.getvalue()


def make_package(paragraphs: list[tuple[str, str]]) -> bytes:
    """A small package of ``(type, text)``: for round trips and tests."""
    body = []
    for kind, text in paragraphs:
        words = escape(text).replace("\n", "<text:line-break/>")
        body.append(f"<text:h>{words}</text:h>" if kind == "heading" else f"<text:list><text:list-item><text:p>{words}</text:p></text:list-item></text:list>" if kind == "list_item" else f"<text:p>{words}</text:p>")
    spaces = f'xmlns:office="{_NS}office:1.0" xmlns:text="{_NS}text:1.0"'
    content = f'<?xml version="1.0" encoding="UTF-8"?><office:document-content {spaces}><office:body><office:text>{"".join(body)}</office:text></office:body></office:document-content>'
    manifest = f'<manifest:manifest xmlns:manifest="{_NS}manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{MIMETYPE.decode()}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr(zipfile.ZipInfo("mimetype"), MIMETYPE, zipfile.ZIP_STORED)
        z.writestr("content.xml", content, zipfile.ZIP_DEFLATED)
        z.writestr("META-INF/manifest.xml", manifest, zipfile.ZIP_DEFLATED)
    return buffer.getvalue()


SPAN = "array<struct<start_pos:int,end_pos:int>>"


def odt_blocks(packages: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, part, block_no, segment_id, type, reason, text, protected_spans, error)`` of packages; a bad one gives a single row with its error."""
    schema = f"{key} {packages.schema[key].dataType.simpleString()}, part string, block_no int, segment_id string, type string, reason string, text string, protected_spans {SPAN}, error string"

    def make():
        def work(row: dict) -> list[tuple]:
            try:
                out = []
                for part, data in inspect(row[content] or b"").items():
                    for b in blocks(data, part):
                        out.append((row[key], part, len(out) + 1, b.id, b.type, b.reason, b.text, [{"start_pos": s, "end_pos": e} for s, e in b.spans], None))
                return out
            except OdtError as e:
                return [(row[key], None, None, None, None, None, None, [], str(e))]

        return work

    return flat_map(packages.select(key, content), schema, make)


def inventory(packages: DataFrame, key: str, content: str) -> DataFrame:
    """``(key, part, block_no, segment_id, type, context, status, text)``: every paragraph and heading, with the elements around it and whether it can be edited.

    ``status`` is ``eligible`` or the reason why not, also by styles; bad packages have no blocks.
    """

    def make():
        def work(row: dict) -> list[tuple]:
            try:
                parts = inspect(row[content] or b"")
                kept = frozenset().union(*map(protected_styles, parts.values()))
                found = [(part, b) for part, data in parts.items() for b in blocks(data, part, kept)]
            except OdtError:
                return []
            return [(row[key], part, n, b.id, b.type, b.context, b.reason or "eligible", b.text) for n, (part, b) in enumerate(found, 1)]

        return work

    schema = f"{key} {packages.schema[key].dataType.simpleString()}, part string, block_no int, segment_id string, type string, context string, status string, text string"
    return flat_map(packages.select(key, content), schema, make)


def skipped_issues(found: DataFrame, key: str) -> DataFrame:
    """Issue rows for blocks with text that cannot be edited."""
    lost = found.where(F.col("reason").isin(*UNSUPPORTED) & F.col("text").rlike(r"(?U)\S"))
    return lost.select(key, "segment_id", F.col("type").alias("segment_type"), F.lit("skipped_content").alias("action"), "reason", F.col("text").alias("original"), F.lit("odt_inventory").alias("stage"))


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(style)``: styles that are seeds or inherit from one, by ``(style, parent)``, through chains of any length.

    A style that is defined twice has the smaller of its parents; nulls are no styles. Every style looks twice as far up in each
    round, so the rounds are as many as the longest chain has binary digits, and cycles end by themselves: the first round that reaches nothing
    new is the last.
    """
    roots = seeds.where("style is not null").select("style").distinct()
    found = roots.withColumn("hit", F.lit(True))
    known = edges.where("style is not null and parent is not null").groupBy("style").agg(F.min("parent").alias("up"))
    above = cut_lineage(known.join(found, "style", "left").select("style", "up", F.coalesce("hit", F.lit(False)).alias("hit")).join(found.select(F.col("style").alias("up"), F.col("hit").alias("next")), "up", "left")
                        .select("style", "up", (F.col("hit") | F.coalesce("next", F.lit(False))).alias("hit")))
    reached = above.where("hit").count()
    while True:
        far = above.select(F.col("style").alias("up"), F.col("up").alias("further"), F.col("hit").alias("next"))
        above = cut_lineage(above.join(far, "up", "left").select("style", F.coalesce("further", "up").alias("up"), (F.col("hit") | F.coalesce("next", F.lit(False))).alias("hit")))
        now = above.where("hit").count()
        if now == reached:
            return above.where("hit").select("style").union(roots).distinct()
        reached = now


def protected_styles(styles: bytes) -> frozenset[str]:
    """Names of paragraph styles that are preformatted text or inherit from it."""
    parent = {}
    style = "{" + _NS + "style:1.0}"
    for x in xml_root(styles).iter(style + "style"):
        parent[x.get(style + "name")] = x.get(style + "parent-style-name")
    known = {"Preformatted_20_Text", "Preformatted Text"}
    while more := {n for n, p in parent.items() if p in known and n not in known}:
        known |= more
    return frozenset(known)


def language_styles(parts: dict[str, bytes]) -> frozenset[str]:
    """Names of text styles that say nothing but the language of their words; one that is defined twice is not among them."""
    style, fo = "{" + _NS + "style:1.0}", "{" + _NS + "xsl-fo-compatible:1.0}"
    said = {fo + "language", fo + "country", style + "script-type"}
    seen, good = set(), set()
    for data in parts.values():
        for x in xml_root(data).iter(style + "style"):
            name = x.get(style + "name")
            only = x.get(style + "family") == "text" and bool(name) and len(x) == 1 and x[0].tag == style + "text-properties" and not len(x[0]) and fo + "language" in x[0].attrib and set(x[0].attrib) <= said
            if name not in seen and only and set(x.attrib) == {style + "name", style + "family"}:
                good.add(name)
            else:
                good.discard(name)
            seen.add(name)
    return frozenset(good)
