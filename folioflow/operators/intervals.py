"""Half-open intervals of code points: partitions, complements, overlaps, differences, merging and checks.

Intervals live in arrays within a row wherever they belong to one text; then nothing is shuffled. Joins of intervals always
carry an equality on the text's key, with the overlap as a residual filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_spans(spans: Column, length: Column) -> Column:
    """Whether spans are in order, apart, not empty and within the text. Null arrays are."""
    size = F.size(spans)
    inside = F.forall(spans, lambda s: (s["start_pos"] >= 0) & (s["start_pos"] < s["end_pos"]) & (s["end_pos"] <= length))
    apart = F.forall(F.sequence(F.lit(1), size - 1), lambda i: F.get(spans, i - 1)["end_pos"] <= F.get(spans, i)["start_pos"])
    return F.coalesce(inside & ((size < 2) | apart), F.lit(True))


def gaps(spans: Column, length: Column) -> Column:
    """What ordered spans leave of a text, as spans without empty ones."""
    spans = F.coalesce(spans, F.array().cast("array<struct<start_pos:int,end_pos:int>>"))
    edge = lambda a, b: F.struct(a.cast("int").alias("start_pos"), b.cast("int").alias("end_pos"))
    between = F.transform(spans, lambda s, i: edge(F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end_pos"]), s["start_pos"]))
    last = F.array(edge(F.coalesce(F.element_at(F.when(F.size(spans) > 0, spans), -1)["end_pos"], F.lit(0)), length))
    return F.filter(F.concat(between, last), lambda s: s["start_pos"] < s["end_pos"])


def extracted(text: Column, spans: Column) -> Column:
    """The text without the spans."""
    return F.array_join(F.transform(gaps(spans, F.length(text)), lambda s: F.substring(text, s["start_pos"] + 1, s["end_pos"] - s["start_pos"])), "")


def partition(items: DataFrame, key: str, length: str, layers: dict[str, DataFrame]) -> DataFrame:
    """``(key, part_no, start_pos, end_pos, kind)``: each text cut where intervals of the layers start and end.

    ``layers`` maps a kind to its ``(key, start_pos, end_pos)``; where several cover a place the first kind named wins, and places
    under none are ``text``. Neighbours of one kind are merged. A sweep over the boundaries by window, not a pass over characters.
    """
    zero, events = F.lit(0), []
    events.append(items.select(key, zero.alias("pos"), *[zero.alias(f"d_{k}") for k in layers]))
    events.append(items.select(key, F.col(length).alias("pos"), *[zero.alias(f"d_{k}") for k in layers]))
    for kind, spans in layers.items():
        for pos, change in (("start_pos", 1), ("end_pos", -1)):
            events.append(spans.select(key, F.col(pos).alias("pos"), *[F.lit(change if k == kind else 0).alias(f"d_{k}") for k in layers]))
    union = events[0]
    for e in events[1:]:
        union = union.unionByName(e)
    at = Window.partitionBy(key).orderBy("pos")
    summed = union.groupBy(key, "pos").agg(*[F.sum(f"d_{k}").alias(f"d_{k}") for k in layers])
    kind = F.lit("text")
    for k in reversed(layers):
        kind = F.when(F.sum(f"d_{k}").over(at) > 0, k).otherwise(kind)
    cut = summed.select(key, F.col("pos").alias("start_pos"), F.lead("pos").over(at).alias("end_pos"), kind.alias("kind")).where("end_pos is not null and end_pos > start_pos")
    by_start = Window.partitionBy(key).orderBy("start_pos")
    fresh = cut.withColumn("fresh", (~F.col("kind").eqNullSafe(F.lag("kind").over(by_start))).cast("int"))
    merged = fresh.withColumn("part_no", F.sum("fresh").over(by_start)).groupBy(key, "part_no", "kind").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"))
    return merged.select(key, F.col("part_no").cast("int"), "start_pos", "end_pos", "kind")


def overlapping(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """Pairs of ``left`` and ``right`` (aliases l and r, columns start_pos and end_pos) of one key that share a place."""
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in key]
    return left.alias("l").join(right.alias("r"), [*same, F.col("l.start_pos") < F.col("r.end_pos"), F.col("r.start_pos") < F.col("l.end_pos")], how)


def merged_runs(spans: DataFrame, key: list[str], text: str) -> DataFrame:
    """``(key, start_pos, end_pos)``: spans joined where only white space lies between them. ``text`` is a column of ``spans``."""
    at = Window.partitionBy(*key).orderBy("start_pos", "end_pos")
    reach = F.max("end_pos").over(at.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.expr(f"substr({text}, before + 1, greatest(start_pos - before, 0))")
    fresh = spans.withColumn("before", reach).withColumn("fresh", (F.col("before").isNull() | F.coalesce(gap.rlike(r"(?U)\S"), F.lit(False))).cast("int"))
    return fresh.withColumn("run", F.sum("fresh").over(at)).groupBy(*key, "run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos")).drop("run")


def difference(spans: DataFrame, cuts: DataFrame, key: list[str]) -> DataFrame:
    """``(key, span_start, start_pos, end_pos)``: what the cuts leave of each span. Cuts may overlap each other and span borders."""
    touching = cuts.select(*key, F.col("start_pos").alias("c_start"), F.col("end_pos").alias("c_end"))
    hit = [F.col(f"s.{k}") == F.col(f"c.{k}") for k in key]
    pairs = spans.alias("s").join(touching.alias("c"), [*hit, F.col("c_start") < F.col("end_pos"), F.col("c_end") > F.col("start_pos")], "left")
    grouped = pairs.groupBy(*[F.col(f"s.{k}").alias(k) for k in key], "start_pos", "end_pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("c_start").isNotNull(), F.struct("c_start", "c_end")))).alias("cuts")
    )
    fold = F.aggregate(
        F.col("cuts"),
        F.struct(F.col("start_pos").alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("out")),
        lambda acc, c: F.struct(
            F.greatest(acc["at"], c["c_end"]).alias("at"),
            F.when(acc["at"] < c["c_start"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), c["c_start"].alias("b"))))).otherwise(acc["out"]).alias("out"),
        ),
    )
    left = F.expr("if(done.at < end_pos, concat(done.out, array(named_struct('a', done.at, 'b', end_pos))), done.out)")
    return grouped.withColumn("done", fold).select(*key, F.col("start_pos").alias("span_start"), F.explode(left).alias("p")).select(*key, "span_start", F.col("p.a").alias("start_pos"), F.col("p.b").alias("end_pos"))


def laminar(ranges: Column) -> Column:
    """Whether ranges ``(outer_start, inner_start, inner_end, outer_end)`` are sound, in source order, and nested or apart.

    A later range must lie within the inner part of an earlier one, or start at or after its end.
    """
    sound = F.forall(
        ranges,
        lambda r: (0 <= r["outer_start"]) & (r["outer_start"] <= r["inner_start"]) & (r["inner_start"] <= r["inner_end"]) & (r["inner_end"] <= r["outer_end"]) & (r["outer_start"] < r["outer_end"]),
    )
    # one pass that keeps the inner parts of the ranges that are open at a place, outermost first
    none = F.struct(F.lit(True).alias("ok"), F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,end:int>>").alias("open"))

    def step(acc: Column, r: Column) -> Column:
        still = F.filter(acc["open"], lambda o: o["end"] > r["outer_start"])
        fits = (r["outer_start"] >= acc["at"]) & F.forall(still, lambda o: (r["outer_start"] >= o["s"]) & (r["outer_end"] <= o["e"]))
        inner = F.struct(r["inner_start"].alias("s"), r["inner_end"].alias("e"), r["outer_end"].alias("end"))
        return F.struct((acc["ok"] & fits).alias("ok"), F.greatest(acc["at"], r["outer_start"]).alias("at"), F.concat(still, F.array(inner)).alias("open"))

    return F.coalesce(sound & F.aggregate(ranges, none, step, lambda acc: acc["ok"]), F.lit(True))
