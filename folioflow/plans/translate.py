"""The translation pipeline: mask protected spans, mask glossary terms, translate chunks, restore, validate, and record issues.

Everything but the model and the glossary runs in the JVM. Segments with nothing to translate never reach Python: the plan
splits them off first, since a filter cannot move below a Python stage by itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map_rows
from folioflow.functions.backends import Backend, Steps, answered
from folioflow.operators import glossary as terms
from folioflow.operators import html_text, intervals, markdown, markers
from folioflow.operators.chunking import split_text

RETAINED = "retained_original"
REPAIRED = "formatting_repaired"


def _layout(form: str, text: str) -> html_text.Layout:
    return html_text.layout(text, None, [x for x in markdown.inline_syntax(text)[0] if not text[x[0] : x[1]].startswith("<")] if form == "md" else None)


def structure_errors(form: str, kind: str | None, before: str, after: str) -> list[str]:
    """What a translation changed of the structure of a Markdown or HTML segment; other formats have none."""
    if form not in ("md", "html"):
        return []
    if form == "md" and kind == "table_cell" and (re.search(r"[\r\n]|(?<!\\)\|", after) or after.endswith("\\") and not before.endswith("\\")):
        return ["markdown_table_cell_boundary_changed"]
    errors = html_text.changes(_layout(form, before), _layout(form, after))
    return [*errors, *markdown.structure_errors(before, after)] if form == "md" else errors


def repaired(form: str, kind: str | None, before: str, after: str) -> str | None:
    """The translation without plain emphasis that it emptied, if that is all that is wrong with it."""
    found = html_text.without_empty_emphasis(_layout(form, before), _layout(form, after)) if form in ("md", "html") else None
    return found[1] if found and not structure_errors(form, kind, *found) else None


def translation(text: str, mask: terms.TermMask | None, fits: Callable[[str], bool] | None) -> Steps[tuple[str, list[str]]]:
    """Asks for one text, sentence by sentence where it does not fit; (translation, reasons). With any reason the whole text stays as it is."""
    parts = [(text, "")] if fits is None else split_text(text, fits)
    reasons = ["A word exceeds the input token budget" for part, rest in parts if part is None and rest.strip()]
    units = [mask.masked(part) if mask else terms.MaskedTerms(part, part) for part, _ in parts if part and part.strip()]
    replies = iter((yield [u.send for u in units if u.send is not None]))
    done = []
    for u in units:
        out, reason = next(replies) if u.send is not None else (u.text, None)
        if reason is None and u.send is not None and mask:
            out, reason = mask.filled(u, out)
        done.append(out)
        reasons += [reason] if reason else []
    if reasons:
        return text, reasons
    filled = iter(done)
    return "".join((next(filled) if part and part.strip() else part or "") + rest for part, rest in parts), []


def translate_segments(
    segments: DataFrame, keys: list[str], backend: Callable[[], Backend], glossary: DataFrame | None = None, limit: int | None = None, mode: str = "permissive", form: str | None = None,
    ordered: bool = True, fits: Callable[[], Callable[[str], bool]] | None = None,
) -> DataFrame:
    """``(keys, text, translated, action, errors)`` of segments with ``keys``, ``text`` and ``protected_spans``.

    With ``form``, the key that holds ``md`` or ``html``, the structure of such segments is checked after restoring, with that of
    cells if a key ``type`` says so: a translation that emptied plain emphasis is repaired and also comes out as it was in
    ``unrepaired_text``, a further column; any other change keeps the original.

    Texts without a visible letter come back as they are. If a marker is lost, doubled, moved (unless not ``ordered``) or damaged, the original is
    retained and ``errors`` says why; ``mode="failfast"`` raises instead. Null texts stay null. The model gets all units of some
    thousand segments in one call, and a segment of which any unit fails stays as it is. ``limit`` is a size in characters, and ``fits`` builds
    another measure once per task, such as :func:`backends.budget` of a tokenizer.
    """
    spans = F.coalesce("protected_spans", F.array().cast("array<struct<start_pos:int,end_pos:int>>"))
    known = [tuple(t) for t in terms.collected(glossary)] if glossary is not None else None
    whole = segments.select(*keys, "text", spans.alias("spans"))
    visible = F.coalesce(intervals.extracted(F.col("text"), F.col("spans")).rlike(r"\p{L}"), F.lit(False))
    passed = whole.where(~visible).select(*keys, "text", F.col("text").alias("translated"), F.lit(None).cast("string").alias("action"), F.array().cast("array<string>").alias("errors"))
    work = whole.where(visible).withColumn("prefix", markers.marker_prefix(F.col("text"))).withColumn("m", markers.masked(F.col("text"), F.col("spans"), F.col("prefix")))
    fields = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    carried = [*keys, "text", "prefix", "markers"]
    flat = work.select(*keys, "text", "prefix", F.col("m.text").alias("masked"), F.col("m.markers").alias("markers"))
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "text string, prefix string", f"markers {flat.schema['markers'].dataType.simpleString()}", "raw string, reasons array<string>"])

    def make():
        model = backend()
        mask = terms.TermMask(known) if known else None
        room = fits() if fits else (lambda s: len(s) <= limit) if limit is not None else None
        return lambda rows: [(*(row[c] for c in carried), *out) for row, out in zip(rows, answered([translation(r["masked"], mask, room) for r in rows], model))]

    done = flat_map_rows(flat, schema, make)
    tokens = F.transform("markers", lambda m: m["token"])
    bad = F.when(F.size("markers") > 0, markers.marker_errors(F.col("raw"), F.col("prefix"), tokens, ordered)).otherwise(F.array().cast("array<string>"))
    checked = done.withColumn("bad", bad)
    failed = F.size(F.concat("bad", "reasons")) > 0
    instead = F.raise_error(F.concat(F.lit("translation failed: "), F.array_join(F.concat("bad", "reasons"), "; "))).cast("string") if mode == "failfast" else F.col("text")
    result = checked.select(
        *keys, "text", F.when(failed, instead).otherwise(markers.restored(F.col("raw"), F.col("markers"))).alias("translated"),
        F.when(failed, RETAINED).alias("action"), F.concat("bad", "reasons").alias("errors"),
    )
    if form is None:
        return result.unionByName(passed)
    return _structured(result, keys, form, mode).unionByName(passed.withColumn("unrepaired_text", F.lit(None).cast("string")))


def _structured(result: DataFrame, keys: list[str], form: str, mode: str) -> DataFrame:
    """Only what is changed and has a sign of syntax on either side reaches Python; without one there is no structure."""
    kind = F.col("type") if "type" in keys else F.lit(None).cast("string")
    sign = F.when(F.col(form) == "html", F.lit("[<&]")).otherwise(F.lit(r"[\\`<&\[*_~]|  \r?\n"))
    signs = F.regexp_like("text", sign) | F.regexp_like("translated", sign) | F.coalesce((F.col(form) == "md") & (kind == "table_cell"), F.lit(False))
    doubtful = F.col(form).isin("md", "html") & (F.col("text") != F.col("translated")) & signs

    @F.udf("struct<errors:array<string>,fixed:string>", useArrow=True)
    def checked(form: str | None, kind: str | None, before: str | None, after: str | None):
        if form is None:
            return None
        errors = structure_errors(form, kind, before, after)
        return (errors, repaired(form, kind, before, after) if errors and mode != "failfast" else None)

    only = lambda c: F.when(doubtful, c)
    found = result.withColumn("found", checked(only(F.col(form)), only(kind), only(F.col("text")), only(F.col("translated"))))
    wrong, fixed = F.coalesce(F.size("found.errors"), F.lit(0)) > 0, F.col("found.fixed")
    instead = F.raise_error(F.concat(F.lit("translation failed: "), F.array_join("found.errors", "; "))).cast("string") if mode == "failfast" else F.col("text")
    return found.select(
        *keys, "text", F.when(wrong, F.coalesce(fixed, instead)).otherwise(F.col("translated")).alias("translated"),
        F.when(wrong & fixed.isNull(), RETAINED).when(wrong, F.coalesce("action", F.lit(REPAIRED))).otherwise(F.col("action")).alias("action"),
        F.when(wrong, F.concat("errors", "found.errors")).otherwise(F.col("errors")).alias("errors"), F.when(wrong & fixed.isNotNull(), F.col("translated")).alias("unrepaired_text"),
    )
