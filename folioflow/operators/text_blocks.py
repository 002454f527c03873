"""Plain text as blocks: paragraphs, headings, list items, and the blank lines between them.

The boundaries are a window plan over the lines. A heading has at most six words and its successor at least ten, so two
neighbouring lines are never both headings, and whether a line stands in a list depends only on the last blank line or item
before it. So nothing has to be carried from line to line.
"""

from __future__ import annotations

import textwrap

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map
from folioflow.functions.text import LINE, SPACE, count_words, is_blank, joined, rstrip

#: What a list item looks like; a fixed value of the format.
ITEM = rf"(?s)^([ \t]*([-*•]|[0-9]+[.)])[ \t]+)[^{SPACE}].*$"
BOM = "\ufeff"


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, line_no, line)`` with line ends; a byte order mark is dropped."""
    body = F.regexp_replace(text, f"^{BOM}", "")
    return documents.select(key, F.posexplode(F.regexp_extract_all(body, F.lit(LINE), F.lit(0))).alias("line_no", "line"))


def text_blocks(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, block_no, seg_no, type, prefix, text, ending)`` of all documents, separators included.

    ``seg_no`` counts the translatable blocks from 1 and is null for blank lines, whose text is null and whose prefix is the line.
    """
    at = Window.partitionBy(key).orderBy("line_no")
    line = lines(documents, key, text)
    item = F.col("body").rlike(ITEM)
    flagged = line.withColumn("body", F.regexp_replace("line", r"[\r\n]+$", "")).withColumns({"blank": is_blank("line"), "item": item, "words": count_words("line")})
    context = F.last(F.when(F.col("item"), True).when(F.col("blank"), False), ignorenulls=True).over(at.rowsBetween(Window.unboundedPreceding, -1))
    complete = F.coalesce(F.lag("blank").over(at), F.lit(True)) | rstrip(F.lag("line").over(at)).rlike(r"[.!?]$")
    heading = (
        ~F.coalesce(context, F.lit(False)) & complete & F.col("words").between(1, 6) & (F.length("body") <= 60)
        & F.col("body").rlike(r"^\p{Lu}") & ~F.col("body").rlike(r"[.,;!?]$")
        & F.coalesce((F.lead("words").over(at) >= 10) & ~F.lead("item").over(at), F.lit(False))
    )
    headed = flagged.withColumn("heading", ~F.col("blank") & ~F.col("item") & heading)
    begins = F.col("blank") | F.col("item") | F.col("heading") | F.coalesce(F.lag("blank").over(at) | F.lag("heading").over(at), F.lit(True))
    numbered = headed.withColumn("begins", begins).withColumn("block_no", F.sum(F.col("begins").cast("int")).over(at))
    prefix = F.when(F.col("item"), F.regexp_extract("body", ITEM, 1)).otherwise("")
    content = F.when(F.col("begins"), F.expr("substr(line, length(prefix) + 1)")).otherwise(F.col("line"))
    blocks = (
        numbered.withColumn("prefix", prefix).withColumn("content", content).groupBy(key, "block_no").agg(
            F.bool_or("blank").alias("blank"),
            joined(F.col("content"), F.col("line_no")).alias("whole"),
            F.max(F.when(F.col("begins"), F.col("prefix"))).alias("prefix"),
            F.max(F.when(F.col("begins"), F.col("line"))).alias("first"),
            F.bool_or("heading").alias("heading"),
        )
    )
    kind = F.when(F.col("blank"), None).when(F.col("heading"), "heading").when(F.col("prefix") == "", "paragraph").when(F.col("prefix").rlike("[-*•]"), "bullet_item").otherwise("numbered_item")
    order = Window.partitionBy(key).orderBy("block_no")
    return blocks.select(
        key, "block_no",
        F.when(~F.col("blank"), F.sum((~F.col("blank")).cast("int")).over(order)).alias("seg_no"),
        kind.alias("type"),
        F.when(F.col("blank"), F.col("first")).otherwise(F.col("prefix")).alias("prefix"),
        F.when(~F.col("blank"), F.col("whole")).alias("text"),
        F.when(F.col("blank"), "").otherwise(F.regexp_extract("whole", r"[\r\n]*$", 0)).alias("ending"),
    )


def rewritten(blocks: DataFrame, key: str, replacement: Column) -> DataFrame:
    """``(key, document)``: every block with its prefix, the replacement without line ends, and its own line end."""
    body = F.concat("prefix", F.regexp_replace(replacement, r"[\r\n]+$", ""), "ending")
    return blocks.groupBy(key).agg(joined(F.coalesce(F.when(F.col("text").isNull(), F.col("prefix")).otherwise(body), F.lit("")), F.col("block_no")).alias("document"))


def reflowed(source: str, target: str, prefix: str = "") -> str:
    """A one-line translation of a source of several lines, wrapped to about the source's width with a hanging indent."""
    source_lines = source.splitlines()
    if len(source_lines) < 2 or len(target.splitlines()) != 1:
        return target
    width = min(max(max(map(len, source_lines)), 40), 100)
    first = source_lines[0]
    end = next((e for e in ("\r\n", "\n", "\r") if source.startswith(first + e)), "\n")
    wrapped = textwrap.wrap(target.strip(), width=width, break_long_words=False, break_on_hyphens=False, subsequent_indent=" " * len(prefix))
    return end.join(wrapped) + target[len(target.rstrip("\r\n")) :]


def reflow(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, translated)`` of ``(keys, text, translated, prefix)``, each translation wrapped like its source. Nulls stay null."""
    fields = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), "translated string"])

    def make():
        def work(row: dict) -> list[tuple]:
            both = row["text"] is not None and row["translated"] is not None
            return [(*(row[k] for k in keys), reflowed(row["text"], row["translated"], row["prefix"] or "") if both else row["translated"])]

        return work

    return flat_map(blocks.select(*keys, "text", "translated", "prefix"), schema, make)


def paragraph_numbers(segments: DataFrame, key: str, order: str, kind: str = "type") -> DataFrame:
    """Adds ``paragraph_number``: the running number of paragraphs in a document, null for other segments."""
    running = F.sum((F.col(kind) == "paragraph").cast("int")).over(Window.partitionBy(key).orderBy(order))
    return segments.withColumn("paragraph_number", F.when(F.col(kind) == "paragraph", running))
