"""Opaque markers that stand for protected content while a text is translated, and their validation.

A prefix is the namespace and 32 hexadecimal digits of a hash; the first counter whose prefix does not occur in the text is taken,
so prefixes are deterministic and never collide with content. All of this is arrays and hashes in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def hashed_prefix(namespace: str, counter: Column) -> Column:
    return F.concat(F.lit(namespace), F.upper(F.substring(F.sha2(F.concat(F.lit(f"{namespace}:"), counter.cast("string")), 256), 1, 32)))


def marker_prefix(text: Column, namespace: str = "DLM") -> Column:
    """The first free prefix of a text, whatever its letters' case.

    Each mention of the namespace takes one prefix at most, so as many counters and one more hold a free one.
    """
    low = F.lower(text)
    mentions = F.regexp_count(low, F.lit(namespace.lower()))
    tried = F.transform(F.sequence(F.lit(0), mentions), lambda k: hashed_prefix(namespace, k))
    return F.get(F.filter(tried, lambda p: ~F.contains(low, F.lower(p))), F.lit(0))


def token(prefix: Column, number: Column) -> Column:
    return F.concat(prefix, F.lit("X"), number.cast("string"), F.lit("Z"))


def masked(text: Column, spans: Column, prefix: Column) -> Column:
    """``struct(text, markers array<struct<token, content>>)`` with a marker for each ordered span; spaces pad a marker that touches a word.

    The padding is taken away again by :func:`restored`.
    """
    at = lambda i: F.substring(text, i, F.lit(1))
    space = lambda c: (c == "") | c.rlike(r"^(?U)\s$")
    piece = lambda s, i: F.concat(
        F.substring(text, F.when(i == 0, F.lit(1)).otherwise(F.get(spans, i - 1)["end_pos"] + 1), s["start_pos"] - F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end_pos"])),
        F.when((s["start_pos"] > 0) & ~space(at(s["start_pos"])), " ").otherwise(""),
        token(prefix, i),
        F.when(~space(at(s["end_pos"] + 1)), " ").otherwise(""),
    )
    tail = F.substring(text, F.element_at(spans, -1)["end_pos"] + 1, F.length(text))
    marked = F.concat(F.array_join(F.transform(spans, piece), ""), tail)
    markers = F.transform(
        spans,
        lambda s, i: F.struct(
            token(prefix, i).alias("token"),
            F.substring(text, s["start_pos"] + 1, s["end_pos"] - s["start_pos"]).alias("content"),
            ((s["start_pos"] > 0) & ~space(at(s["start_pos"]))).alias("left"),
            (~space(at(s["end_pos"] + 1))).alias("right"),
        ),
    )
    none = F.array().cast("array<struct<token:string,content:string,left:boolean,right:boolean>>")
    return F.when(F.size(spans) > 0, F.struct(marked.alias("text"), markers.alias("markers"))).otherwise(F.struct(text.alias("text"), none.alias("markers")))


def restored(text: Column, markers: Column) -> Column:
    """The text with each marker's content, and without the spaces that padded it."""

    def put(acc: Column, m: Column) -> Column:
        at = F.position(m["token"], acc)
        before, after = F.substring(acc, F.lit(1), at - 1), F.substring(acc, at + F.length(m["token"]), F.length(acc))
        before = F.when(m["left"], F.regexp_replace(before, r"[ \t]+$", "")).otherwise(before)
        after = F.when(m["right"], F.regexp_replace(after, r"^[ \t]+", "")).otherwise(after)
        return F.when(at > 0, F.concat(before, m["content"], after)).otherwise(acc)

    return F.aggregate(markers, text, put)


def found_markers(text: Column, prefix: Column) -> Column:
    return F.regexp_extract_all(text, F.concat(prefix, F.lit("X[0-9]+Z")), F.lit(0))


def marker_errors(text: Column, prefix: Column, tokens: Column, ordered: bool = True) -> Column:
    """What is wrong with the markers of a translated text: an array of error names, empty if nothing is."""
    got = found_markers(text, prefix)
    rest = F.regexp_replace(text, F.concat(prefix, F.lit("X[0-9]+Z")), F.lit(""))
    times = lambda t: F.size(F.filter(got, lambda g: g == t))
    errors = [
        F.transform(F.filter(tokens, lambda t: times(t) == 0), lambda t: F.concat(F.lit("missing_marker: "), t)),
        F.transform(F.filter(F.array_distinct(got), lambda g: times(g) > 1), lambda t: F.concat(F.lit("duplicate_marker: "), t)),
        F.transform(F.filter(F.array_distinct(got), lambda g: ~F.array_contains(tokens, g)), lambda t: F.concat(F.lit("unexpected_marker: "), t)),
    ]
    one = lambda bad, name: F.when(bad, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    if ordered:
        errors.append(one((got != tokens) & (F.array_sort(got) == F.array_sort(tokens)), "marker_order_changed"))
    errors.append(one(F.contains(F.lower(rest), F.lower(prefix)), "damaged_marker"))
    errors.append(one(~rest.rlike(r"(?U)\S"), "empty_translated_text"))
    return F.concat(*errors)


def same_bag(left: Column, right: Column) -> Column:
    """Whether two arrays hold the same values equally often."""
    return F.array_sort(left) == F.array_sort(right)
