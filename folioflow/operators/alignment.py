"""Word alignments as ranges of characters, and the projection of formatting through them.

Ranges are half-open pairs. An alignment is a dict: ``source``, ``target``, ``links`` (pairs of lists of ranges), ``unaligned``,
``ambiguous`` (source ranges) and ``units`` (pairs of a source and a target range that were translated by one call). The work on
one pair of texts is a pure function, run over Arrow batches; what relates pairs, scopes and links is done by joins.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map
from folioflow.operators.intervals import overlapping

WORD = re.compile(r"\w+|[^\w\s]")
Range = tuple[int, int]


class AlignmentError(ValueError):
    pass


def word_ranges(text: str) -> list[Range]:
    return [m.span() for m in WORD.finditer(text)]


def meet(a: Range, b: Range) -> bool:
    return a[0] < b[1] and b[0] < a[1]


def components(source: str, target: str, pairs: Iterable[Range]) -> dict:
    """The alignment whose links are the connected components of the word pairs; words in none are unaligned."""
    left, right = word_ranges(source), word_ranges(target)
    parent = list(range(len(left) + len(right)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    touched = set()
    for i, j in pairs:
        if not (0 <= i < len(left) and 0 <= j < len(right)):
            raise AlignmentError(f"no such pair of words: {i}, {j}")
        touched.add(i)
        a, b = root(i), root(len(left) + j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    groups: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    for i in sorted(touched):
        groups[root(i)][0].append(left[i])
    for j in range(len(right)):
        if root(len(left) + j) in groups:
            groups[root(len(left) + j)][1].append(right[j])
    return {"source": source, "target": target, "links": list(groups.values()), "unaligned": [left[i] for i in range(len(left)) if i not in touched], "ambiguous": [], "units": []}


def by_position(source: str, target: str) -> list[Range]:
    """A double for an aligner: the words of both sides pair in their order."""
    return [(i, i) for i in range(min(len(word_ranges(source)), len(word_ranges(target))))]


def alignment_errors(a: dict) -> list[str]:
    """Broken rules: ranges out of order, overlaps on either side, and visible source characters with no status or with two."""
    errors = []
    for side, length in (("source", len(a["source"])), ("target", len(a["target"]))):
        ranges = [r for link in a["links"] for r in link[side == "target"]]
        if any(not link[side == "target"] for link in a["links"]):
            errors.append(f"empty_{side}_side")
        if any(not (0 <= s < e <= length) for s, e in ranges):
            errors.append(f"{side}_range_outside")
        if any(list(link[side == "target"]) != sorted(link[side == "target"]) for link in a["links"]):
            errors.append(f"{side}_ranges_unordered")
        if side == "source":
            ranges = ranges + list(a["unaligned"]) + list(a["ambiguous"])
        ranges = sorted(ranges)
        if any(x[1] > y[0] for x, y in zip(ranges, ranges[1:])):
            errors.append(f"{side}_overlap")
        if side == "source":
            at = 0
            for s, e in [*ranges, (length, length)]:
                if a["source"][at:s].strip():
                    errors.append("source_not_covered")
                    break
                at = max(at, e)
    return errors


def subtract(span: Range, cuts: list[Range]) -> list[Range]:
    """What ordered cuts leave of a span."""
    out, at = [], span[0]
    for s, e in cuts:
        if s >= span[1] or e <= at:
            continue
        if s > at:
            out.append((at, s))
        at = max(at, min(e, span[1]))
    return [*out, (at, span[1])] if at < span[1] else out


class Painted:
    """An alignment painted on its two texts: every character bears the number of its link or loose range, or -1.

    ``kinds`` says for each number whether it is a ``link``, or source that is ``unaligned`` or ``ambiguous``. What is painted later covers
    what was there. Questions about ranges become questions about which numbers occur where, so the order of links is of no account.
    """

    def __init__(self, a: dict):
        self.texts = (a["source"], a["target"])
        self.numbers = tuple(np.full(len(t), -1, dtype=np.int64) for t in self.texts)
        self.visible = tuple(np.fromiter((not c.isspace() for c in t), dtype=bool, count=len(t)) for t in self.texts)
        self.kinds: list[str] = []
        self.drawn: list[tuple[list[Range], list[Range]]] = []
        for left, right in a["links"]:
            self.draw("link", left, right)
        for kind in ("unaligned", "ambiguous"):
            for r in a[kind]:
                self.draw(kind, [r], [])

    def draw(self, kind: str, left: list[Range], right: list[Range]) -> None:
        for numbers, ranges in zip(self.numbers, (left, right)):
            for s, e in ranges:
                numbers[s:e] = len(self.kinds)
        self.kinds.append(kind)
        self.drawn.append((list(left), list(right)))

    def within(self, *spans: Range | None) -> set[int]:
        """Numbers that occur in a span of the source, and of the target if there is one."""
        return {int(k) for numbers, span in zip(self.numbers, spans) if span for k in np.unique(numbers[span[0] : span[1]]) if k >= 0}

    def links(self, numbers: set[int]) -> list[int]:
        return [k for k in numbers if self.kinds[k] == "link"]

    def loosen(self, links: list[int]) -> None:
        """Links become ambiguous source, and their target is free."""
        for k in links:
            self.kinds[k] = "gone"
            self.numbers[1][self.numbers[1] == k] = -1
            for r in self.drawn[k][0]:
                self.draw("ambiguous", [r], [])

    def enclosed(self, links: list[int], spans: tuple[Range, Range]) -> bool:
        """Whether links lie in a pair of spans with all their characters."""
        return all(np.isin(n, links).sum() == np.isin(n[s:e], links).sum() for n, (s, e) in zip(self.numbers, spans))

    def stretches(self, side: int, chosen: np.ndarray, over_space: bool = False) -> list[Range]:
        """The runs of chosen characters of one number, or, over white space, of chosen characters with nothing visible between them."""
        numbers, visible = np.where(chosen, self.numbers[side], -1), self.visible[side]
        if over_space:
            at = np.flatnonzero(chosen)
            new = np.diff(np.cumsum(visible & ~chosen)[at], prepend=-1) != 0
            return [(int(at[x[0]]), int(at[x[-1]]) + 1) for x in np.split(np.arange(len(at)), np.flatnonzero(new)[1:]) if len(x)]
        edges = np.flatnonzero(np.diff(numbers, prepend=-1, append=-1))
        return [(int(s), int(e)) for s, e in zip(edges, edges[1:]) if numbers[s] >= 0]

    def plain(self) -> tuple[list, list[Range], list[Range]]:
        """(links, unaligned, ambiguous) as ranges again."""
        runs: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        for side in (0, 1):
            for r in self.stretches(side, self.numbers[side] >= 0):
                runs[side][int(self.numbers[side][r[0]])].append(r)
        of = lambda kind: sorted(r for k, rs in runs[0].items() if self.kinds[k] == kind for r in rs)
        return sorted((runs[0][k], runs[1][k]) for k in list(runs[0]) if self.kinds[k] == "link"), of("unaligned"), of("ambiguous")


def anchored(a: dict, tokens: list[str], prefix: str) -> dict:
    """The alignment with exact links between registered markers; a link that touches a marker becomes ambiguous as a whole."""
    marker = re.compile(re.escape(prefix) + r"X[0-9]+Z")
    if not prefix or len(set(tokens)) < len(tokens) or any(marker.fullmatch(t) is None for t in tokens):
        raise AlignmentError("the registered markers are not distinct markers of their namespace")
    hits = {side: {m.span(): m[0] for m in marker.finditer(a[side])} for side in ("source", "target")}
    for side, found in hits.items():
        if sorted(found.values()) != sorted(tokens):
            raise AlignmentError(f"missing, duplicate or unexpected marker in the {side}")
        if a[side].lower().count(prefix.lower()) > len(found):
            raise AlignmentError(f"damaged marker in the {side}")
    painted = Painted(a)
    there = {name: span for span, name in hits["target"].items()}
    pairs = [(span, there[name]) for span, name in hits["source"].items()]
    painted.loosen(painted.links(set().union(*(painted.within(*p) for p in pairs))))
    for left, right in pairs:
        painted.draw("link", [left], [right])
    links, unaligned, ambiguous = painted.plain()
    return a | {"links": links, "unaligned": unaligned, "ambiguous": ambiguous}


def _with_units(a: dict, scope: Range) -> Painted:
    """The painted alignment with units in place of the words in them, where a unit lies in the scope and no link leaves it."""
    painted = Painted(a)
    inside = [u for u in a["units"] if scope[0] <= u[0][0] <= u[0][1] <= scope[1]]
    for left, right in [u for u in inside if painted.enclosed(painted.links(painted.within(*u)), u)]:
        painted.draw("link", [left], [right])
    return painted


def _projected(painted: Painted, scope: Range) -> tuple[str | None, list[Range]]:
    """(why a scope cannot be carried over, source ranges), or (None, its target ranges, joined over white space)."""
    source, target = painted.numbers
    here = np.zeros(len(source), dtype=bool)
    here[scope[0] : scope[1]] = True
    loose = np.isin(source, [k for k in painted.within(scope) if painted.kinds[k] != "link"]) & here
    doubtful = [(s + int(seen[0]), s + int(seen[-1]) + 1) for s, e in painted.stretches(0, loose) if len(seen := np.flatnonzero(painted.visible[0][s:e]))]
    if doubtful:
        return "unresolved_source", doubtful
    mine = painted.links(painted.within(scope))
    if (np.isin(source, mine) & ~here).any():
        return "crossing_source_boundary", sorted({r for k in mine for r in painted.drawn[k][0]})
    chosen = np.isin(target, mine)
    return (None, painted.stretches(1, chosen, over_space=True)) if chosen.any() else ("no_target", [scope])


def project(a: dict, scopes: list[dict], complete_segment: bool = False) -> tuple[list[dict], list[dict]]:
    """Scopes ``{id, source, link_target}`` carried to the target: (projected with ``targets``, issues with ``action`` and ``reason``).

    A scope over unresolved or crossing source text is dropped. Target ranges join over white space; several that remain split a
    style and stretch a link. Links that meet in the target are all dropped, whatever their order.
    """
    if len({s["id"] for s in scopes}) < len(scopes):
        raise AlignmentError("the scopes' ids are not distinct")
    if any(s["source"][1] > len(a["source"]) for s in scopes):
        raise AlignmentError("a scope reaches beyond the source")
    whole = Painted(a)
    spread = tuple(np.flatnonzero(v) for v in whole.visible)
    issue = lambda scope, action, reason, ranges=(): {"id": scope["id"], "action": action, "reason": reason, "ranges": list(ranges)}
    kept: dict[str, list[Range]] = {}
    noted: dict[str, dict] = {}
    for scope in scopes:
        s, e = scope["source"]
        if complete_segment and len(spread[0]) and len(spread[1]) and s <= spread[0][0] and spread[0][-1] < e:
            kept[scope["id"]] = [(int(spread[1][0]), int(spread[1][-1]) + 1)]
            continue
        reason, ranges = _projected(_with_units(a, (s, e)) if a["units"] else whole, (s, e))
        if reason:
            noted[scope["id"]] = issue(scope, "dropped", reason, ranges)
            continue
        if len(ranges) > 1:
            stretch = scope.get("link_target") is not None
            noted[scope["id"]] = issue(scope, "expanded" if stretch else "split", "discontinuous_target")
            ranges = [(ranges[0][0], ranges[-1][1])] if stretch else ranges
        kept[scope["id"]] = ranges
    layers = np.zeros(len(a["target"]) + 1, dtype=np.int64)  # links over each character
    anchors = [s for s in scopes if s["id"] in kept and s.get("link_target") is not None]
    for s in anchors:
        layers[kept[s["id"]][0][0]] += 1
        layers[kept[s["id"]][0][1]] -= 1
    layers = np.cumsum(layers)
    for s in anchors:
        if layers[slice(*kept[s["id"]][0])].max() > 1:
            del kept[s["id"]]
            noted[s["id"]] = issue(s, "dropped", "overlapping_links")
    return [s | {"targets": kept[s["id"]]} for s in scopes if s["id"] in kept], [noted[s["id"]] for s in scopes if s["id"] in noted]


def diagnostic(issue: dict) -> str:
    text = f"{issue['id']}: {issue['reason']}"
    if issue["ranges"]:
        text += "; alignment_source_ranges=" + ", ".join(f"[{s},{e})" for s, e in issue["ranges"])
    return text


def expected_alignment(source: str, target: str, spans: list[dict]) -> dict:
    """An alignment from stored spans; source words that no span names are unaligned."""
    links, known = [], []
    for span in spans or []:
        left = [(r["start_pos"], r["end_pos"]) for r in span["source_ranges"] or []]
        right = [(r["start_pos"], r["end_pos"]) for r in span["target_ranges"] or []]
        if span["relation"] == "correspondence" and left and right:
            links.append((left, right))
            known += left
    known.sort()
    return {"source": source, "target": target, "links": sorted(links, key=lambda k: k[0][0]), "unaligned": [p for w in word_ranges(source) for p in subtract(w, known)], "ambiguous": [], "units": []}


def project_pairs(pairs: DataFrame, aligner: str = "position") -> DataFrame:
    """``(pair_key, scope_id, action, reason, start_pos, end_pos, diagnostic)`` of ``(pair_key, source, target, scopes, expected_spans)``.

    One row per target range of a projected scope (action ``kept``, ``split`` or ``expanded``) or per dropped scope, with null range.
    """

    def make():
        def work(row: dict) -> list[tuple]:
            source, target = row["source"] or "", row["target"] or ""
            a = components(source, target, by_position(source, target)) if aligner == "position" else expected_alignment(source, target, row["expected_spans"])
            scopes = [{"id": s["id"], "source": tuple(s["source"]), "link_target": s["link_target"]} for s in row["scopes"] or []]
            done, issues = project(a, scopes)
            noted = {i["id"]: i for i in issues}
            out = []
            for p in done:
                i = noted.get(p["id"])
                out += [(row["pair_key"], p["id"], i["action"] if i else "kept", i["reason"] if i else None, s, e, diagnostic(i) if i else None) for s, e in p["targets"]]
            return out + [(row["pair_key"], i["id"], i["action"], i["reason"], None, None, diagnostic(i)) for i in issues if i["action"] == "dropped"]

        return work

    schema = "pair_key long, scope_id string, action string, reason string, start_pos int, end_pos int, diagnostic string"
    return flat_map(pairs.select("pair_key", "source", "target", "scopes", "expected_spans"), schema, make)


def scope_rows(pairs: DataFrame) -> DataFrame:
    one = pairs.select("pair_key", F.explode("scopes").alias("s"))
    return one.select("pair_key", F.col("s.id").alias("scope_id"), F.get("s.source", 0).alias("start_pos"), F.get("s.source", 1).alias("end_pos"), F.col("s.link_target").alias("link_target"))


def link_rows(pairs: DataFrame, side: str) -> DataFrame:
    """``(pair_key, link_no, start_pos, end_pos)`` of one side of the stored spans."""
    one = pairs.select("pair_key", F.posexplode("expected_spans").alias("link_no", "x")).where("x.relation = 'correspondence'")
    return one.select("pair_key", "link_no", F.explode(f"x.{side}_ranges").alias("r")).select("pair_key", "link_no", "r.start_pos", "r.end_pos")


def scope_links(scopes: DataFrame, links: DataFrame) -> DataFrame:
    """Per scope: how many links touch it and how many of them cross its border."""
    pairs = overlapping(scopes, links, ["pair_key"])
    crossing = (F.col("r.start_pos") < F.col("l.start_pos")) | (F.col("r.end_pos") > F.col("l.end_pos"))
    return pairs.groupBy(F.col("l.pair_key").alias("pair_key"), F.col("l.scope_id").alias("scope_id")).agg(F.count_distinct("r.link_no").alias("links"), F.count_if(crossing).alias("crossing"))


def conflicts(scopes: DataFrame) -> DataFrame:
    """``(pair_key, scope_id, others)``: scopes that cross another one of the same pair without nesting."""
    pairs = overlapping(scopes, scopes, ["pair_key"]).where("l.scope_id <> r.scope_id")
    nested = ((F.col("l.start_pos") <= F.col("r.start_pos")) & (F.col("r.end_pos") <= F.col("l.end_pos"))) | ((F.col("r.start_pos") <= F.col("l.start_pos")) & (F.col("l.end_pos") <= F.col("r.end_pos")))
    return pairs.where(~nested).groupBy(F.col("l.pair_key").alias("pair_key"), F.col("l.scope_id").alias("scope_id")).agg(F.array_join(F.array_sort(F.collect_set("r.scope_id")), ",").alias("others"))


def window_conflicts(windows: DataFrame) -> DataFrame:
    """``(pair_key, scope_id, conflicts_with)``: proposals ``(pair_key, scope_id, source_start, source_end, target_start, target_end)`` that meet on either side."""
    side = lambda name: windows.select("pair_key", "scope_id", F.col(f"{name}_start").alias("start_pos"), F.col(f"{name}_end").alias("end_pos"))
    met = [overlapping(side(n), side(n), ["pair_key"]).where("l.scope_id <> r.scope_id").select(F.col("l.pair_key").alias("pair_key"), F.col("l.scope_id").alias("scope_id"), F.col("r.scope_id").alias("other")) for n in ("source", "target")]
    return met[0].unionByName(met[1]).groupBy("pair_key", "scope_id").agg(F.array_join(F.array_sort(F.collect_set("other")), ",").alias("conflicts_with"))


def nearest_anchors(scopes: DataFrame, anchors: DataFrame) -> DataFrame:
    """Per scope the end of the last anchor before it and the start of the first after it: an as-of search both ways.

    Anchors and scopes of a pair are merged into one order and looked up by windows, so no pairs are built.
    """
    events = (
        scopes.select("pair_key", "scope_id", F.col("start_pos").alias("at"), F.lit(None).cast("int").alias("anchor"), F.lit(1).alias("kind"), "start_pos", "end_pos")
        .unionByName(anchors.select("pair_key", F.lit(None).cast("string").alias("scope_id"), F.col("end_pos").alias("at"), F.col("end_pos").alias("anchor"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("start_pos"), F.lit(None).cast("int").alias("end_pos")))
    )
    before = F.last("anchor", ignorenulls=True).over(Window.partitionBy("pair_key").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    left = events.withColumn("before_end", before).where("kind = 1").select("pair_key", "scope_id", "start_pos", "end_pos", "before_end")
    later = left.select("pair_key", "scope_id", "start_pos", "end_pos", "before_end", F.col("end_pos").alias("at"), F.lit(None).cast("int").alias("anchor"), F.lit(0).alias("kind")).unionByName(
        anchors.select("pair_key", F.lit(None).cast("string").alias("scope_id"), F.lit(None).cast("int").alias("start_pos"), F.lit(None).cast("int").alias("end_pos"), F.lit(None).cast("int").alias("before_end"), F.col("start_pos").alias("at"), F.col("start_pos").alias("anchor"), F.lit(1).alias("kind"))
    )
    after = F.first("anchor", ignorenulls=True).over(Window.partitionBy("pair_key").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing))
    return later.withColumn("after_start", after).where("kind = 0").select("pair_key", "scope_id", "before_end", "after_start")


def statistics(aligned: DataFrame) -> DataFrame:
    """Totals over ``(links, unaligned, ambiguous, failed)`` rows of pairs."""
    return aligned.agg(F.count(F.lit(1)).alias("pairs"), F.sum("links").alias("links"), F.sum("unaligned").alias("unaligned"), F.sum("ambiguous").alias("ambiguous"), F.count_if("failed").alias("failed"))


def align_pairs(pairs: DataFrame) -> DataFrame:
    """``(pair_key, links, unaligned, ambiguous, failed, errors)`` by the positional double, with registered markers anchored."""

    def make():
        def work(row: dict) -> list[tuple]:
            source, target = row["source"] or "", row["target"] or ""
            a = components(source, target, by_position(source, target))
            try:
                if row["marker_prefix"]:
                    a = anchored(a, list(row["markers"] or []), row["marker_prefix"])
            except AlignmentError as e:
                return [(row["pair_key"], 0, len(word_ranges(source)), 0, True, str(e))]
            return [(row["pair_key"], len(a["links"]), len(a["unaligned"]), len(a["ambiguous"]), False, "; ".join(alignment_errors(a)))]

        return work

    return flat_map(pairs.select("pair_key", "source", "target", "marker_prefix", "markers"), "pair_key long, links int, unaligned int, ambiguous int, failed boolean, errors string", make)
