"""Evaluation rows: cases by settings, prompts, language pairs and output names."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map, flat_map_rows
from folioflow.functions.backends import Backend
from folioflow.functions.lineage import cut_lineage
from folioflow.operators import alignment as al

# The pairs that the two kinds of models take.
PAIRS = {"marian": {("en", "de")}, "qwen": {(a, b) for a in ("en", "de") for b in ("en", "de")}}


def supported_pair(backend: str, source: str, target: str) -> bool:
    return (source, target) in PAIRS.get(backend, set())


def fingerprint(template: str) -> str:
    return hashlib.sha256(template.encode()).hexdigest()


def messages(template: str, text: Column, source: Column, target: Column) -> Column:
    """A prompt as chat rows ``array<struct<role, content>>``."""
    system = F.replace(F.replace(F.lit(template), F.lit("{source}"), source), F.lit("{target}"), target)
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), text.alias("content")))


def output_name(path: Column, language: Column) -> Column:
    """``stem.lang.ext`` in the same folder."""
    return F.concat(F.regexp_replace(path, r"(\.[^./]+)?$", ""), F.lit("."), language, F.regexp_extract(path, r"(\.[^./]+)$", 1))


def evaluate_alignment(pairs: DataFrame, shares: list[float]) -> DataFrame:
    """``(pair_key, share, expected, hit, links, unaligned)`` for each case and setting.

    The double aligns the first ``share`` of the words by position. An expected phrase is hit if its words are linked only to words
    of its counterpart. Settings are few and go to the tasks with the function, so cases are read once.
    """

    def make():
        def work(row: dict) -> list[tuple]:
            source, target, out = row["source"] or "", row["target"] or "", []
            for share in shares:
                words = al.by_position(source, target)
                a = al.components(source, target, words[: round(len(words) * share)])
                hits = 0
                for phrase in row["expected"] or []:
                    s, t = source.find(phrase[0]), target.find(phrase[1])
                    if min(s, t) < 0:
                        continue
                    inside = [link for link in a["links"] if any(al.meet(r, (s, s + len(phrase[0]))) for r in link[0])]
                    hits += bool(inside) and all(t <= x and y <= t + len(phrase[1]) for link in inside for x, y in link[1])
                out.append((row["pair_key"], share, len(row["expected"] or []), hits, len(a["links"]), len(a["unaligned"])))
            return out

        return work

    return flat_map(pairs.select("pair_key", "source", "target", "expected"), "pair_key long, share double, expected int, hit int, links int, unaligned int", make)


def report(rows: DataFrame) -> DataFrame:
    """Totals by setting."""
    return rows.groupBy("share").agg(F.count(F.lit(1)).alias("cases"), F.sum("expected").alias("expected"), F.sum("hit").alias("hit"), F.percentile("links", 0.5).alias("median_links"))


def evaluate_suite(examples: DataFrame, backend: Callable[[], Backend]) -> DataFrame:
    """``(id, category, source, reference, translated, error, kept)`` of the examples ``(id, category, source, reference, criteria)`` of a suite.

    The model gets some thousand sources at once. ``kept`` says for each criterion whether the translation holds it word for word;
    null sources are translated to null. Judging is left to people.
    """

    def make():
        model = backend()

        def work(rows: list[dict]) -> list[tuple]:
            texts = [r["source"] for r in rows if r["source"] is not None]
            replies = iter(model(texts) if texts else ())
            out = []
            for r in rows:
                done, error = next(replies) if r["source"] is not None else (None, None)
                done = None if error else done
                out.append((r["id"], r["category"], r["source"], r["reference"], done, error, [bool(done) and c in done for c in r["criteria"] or ()]))
            return out

        return work

    schema = "id string, category string, source string, reference string, translated string, error string, kept array<boolean>"
    return flat_map_rows(examples.select("id", "category", "source", "reference", "criteria"), schema, make)


def extend_report(examples: DataFrame, path: str, backend: Callable[[], Backend], at_a_time: int = 1_000) -> int:
    """Writes the report of a suite as JSON lines, some examples after the other, and goes on where an earlier run ended; how many were added.

    Examples that the report holds are not translated again. A part is there as a whole or not at all.
    """
    spark, added = examples.sparkSession, 0
    parts = max(1, -(-examples.count() // at_a_time))
    numbered = examples.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    for part in range(parts):
        some = numbered.where(F.col("_part") == part).drop("_part")
        try:
            known = spark.read.schema("id string").json(path).select("id").distinct()
            some = some.join(known, "id", "left_anti")
        except AnalysisException:  # no report yet
            pass
        rows = cut_lineage(evaluate_suite(some, backend))
        if count := rows.count():
            rows.write.mode("append").json(path)
            added += count
    return added


def inventory_counts(found: DataFrame, key: str) -> DataFrame:
    """``(key, blocks, eligible, skipped, blank)`` of :func:`odt.odt_blocks`: blocks that can be edited, those with words that cannot, and those without words."""
    words = F.coalesce(F.col("text").rlike(r"(?U)\S"), F.lit(False))
    good = found.where("error is null")
    return good.groupBy(key).agg(
        F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("reason").isNull() & words).alias("eligible"), F.count_if(F.col("reason").isNotNull() & words).alias("skipped"), F.count_if(~words).alias("blank")
    )


def evaluate_packages(found: DataFrame, translated: DataFrame, key: str) -> DataFrame:
    """``(key, eligible, skipped, retained, formatting, error)``: the inventory of packages beside the issues ``(key, issues, error)`` of their translation."""
    of = lambda action: F.size(F.filter("issues", lambda i: i.contains(action)))
    issues = translated.select(key, of(" retained_original:").alias("retained"), (F.size("issues") - of(" retained_original:")).alias("formatting"), "error")
    return issues.join(inventory_counts(found, key), key, "left").select(key, F.coalesce("eligible", F.lit(0)).alias("eligible"), F.coalesce("skipped", F.lit(0)).alias("skipped"), "retained", "formatting", "error")
