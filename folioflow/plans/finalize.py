"""Reviewed texts put back into their documents. Nothing is translated here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import newlines
from folioflow.operators import text_blocks


def finalized_text(jobs: DataFrame, selected: DataFrame) -> DataFrame:
    """``(id, document, missing, extra)`` of plain text jobs ``(id, text)`` and their ``(job_id, id, text)`` by block.

    Blocks are those of the snapshot, so prefixes, blank lines and line ends stay. A block without a text keeps its own and counts
    as missing; a text without a block counts as extra. Only a document with neither may be published.
    """
    blocks = text_blocks.text_blocks(jobs, "id", "text").withColumn("seg", F.col("seg_no").cast("string"))
    chosen = selected.select(F.col("job_id"), F.col("id").alias("block_id"), F.col("text").alias("chosen"))
    both = blocks.join(chosen, (F.col("id") == F.col("job_id")) & (F.col("seg") == F.col("block_id")), "left")
    used = both.withColumn("lost", F.col("text").isNotNull() & F.col("chosen").isNull())
    written = text_blocks.rewritten(used.select("id", "block_no", "prefix", "text", "ending", "chosen"), "id", F.coalesce("chosen", "text"))
    counts = used.groupBy("id").agg(F.count_if("lost").alias("missing"), F.count("chosen").alias("matched"))
    given = selected.groupBy(F.col("job_id").alias("id")).agg(F.count("text").alias("given"))
    return written.join(counts, "id").join(given, "id", "left").select("id", "document", "missing", (F.coalesce("given", F.lit(0)) - F.col("matched")).alias("extra"))


def one_line(text: Column) -> Column:
    """A text for a table cell, which has no line ends and no bare pipes."""
    return F.regexp_replace(F.regexp_replace(newlines(text), r"\s*\n\s*", " "), r"(?<!\\)\|", r"\\|")


def finalized_markdown(jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(id, document, sound)`` of Markdown jobs ``(id, text)`` and ``(job_id, type, start_pos, end_pos, chosen)`` by block.

    The blocks' places are cut out of the snapshot and the chosen texts put in; what stands between stays as it is, and so does
    the line end of each block. ``sound`` is false where places overlap or lie outside; such a document keeps its source. One row
    per job through array functions, so the source is not copied for every block.
    """
    text = F.when(F.col("type") == "table_cell", one_line(F.col("chosen"))).otherwise(F.regexp_replace("chosen", r"[\r\n]+$", ""))
    row = F.struct("start_pos", "end_pos", text.alias("chosen"))
    grouped = blocks.where("start_pos is not null").groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("b"))
    both = jobs.join(grouped, F.col("id") == F.col("job_id"), "left").withColumn("b", F.coalesce("b", F.array().cast("array<struct<start_pos:int,end_pos:int,chosen:string>>")))
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("b", i - 1)["end_pos"])
    cut = lambda a, e: F.substring(F.col("text"), a + 1, e - a)

    def put(x: Column, i: Column) -> Column:
        old = cut(x["start_pos"], x["end_pos"])
        return F.concat(cut(before(i), x["start_pos"]), F.coalesce(F.concat(x["chosen"], F.regexp_extract(old, r"[\r\n]*$", 0)), old))

    last = F.coalesce(F.element_at(F.when(F.size("b") > 0, F.col("b")), -1)["end_pos"], F.lit(0))
    apart = F.forall(F.transform("b", lambda x, i: (x["start_pos"] >= before(i)) & (x["end_pos"] >= x["start_pos"])), lambda ok: ok) & (last <= F.length("text"))
    whole = F.concat(F.array_join(F.transform("b", put), ""), cut(last, F.length("text")))
    return both.select("id", F.when(apart, whole).otherwise(F.col("text")).alias("document"), apart.alias("sound"))
