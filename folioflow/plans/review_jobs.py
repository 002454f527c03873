"""Review jobs from documents: a snapshot with its hash, its blocks, and a proposal for each block; and reviewed Markdown as documents again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map
from folioflow.functions.backends import Backend
from folioflow.operators import alignment as al
from folioflow.operators import markdown_review, text_blocks
from folioflow.operators.review import ReviewError
from folioflow.plans import translate

VERSIONS = {"txt": 1, "md": 2}
BOM = "﻿"


def _uuid(*parts: Column) -> Column:
    """An id in the form of a UUID from a hash, so that a task that is run again gives a job the same id."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(F.lit("8"), cut(18, 3)), cut(21, 12))


def created_jobs(files: DataFrame, source_lang: str, target_lang: str) -> DataFrame:
    """Job rows of files ``(name, document_format, content)``; only plain text and Markdown can be reviewed. The id follows from name, contents and languages."""
    if source_lang == target_lang or not source_lang or not target_lang:
        raise ReviewError("a job needs two different languages")
    digest = F.sha2("content", 256)
    version = F.create_map(*(F.lit(x) for pair in VERSIONS.items() for x in pair))[F.col("document_format")]
    return files.where(F.col("document_format").isin(*VERSIONS) & F.col("content").isNotNull()).select(
        _uuid(F.col("name"), digest, F.lit(source_lang), F.lit(target_lang)).alias("id"), F.col("name").alias("source_name"), F.lit(source_lang).alias("source_lang"), F.lit(target_lang).alias("target_lang"),
        digest.alias("source_sha256"), F.col("content").alias("source"), version.alias("schema_version"), "document_format",
    )


def _snapshots(jobs: DataFrame, form: str) -> DataFrame:
    text = F.decode("source", "UTF-8")
    return jobs.where(F.col("document_format") == form).select(F.col("id").alias("job_id"), F.when(text.startswith(BOM), F.substring(text, 2, 2**31 - 1)).otherwise(text).alias("text"))


def job_blocks(jobs: DataFrame) -> DataFrame:
    """``(job_id, ord, id, type, original, source_info, protected_spans, error)`` of all jobs, in the form of stored review blocks."""
    info = f"struct<start_pos:int,end_pos:int,formatting:{markdown_review.FORMATTING},protected:array<string>>"
    plain = text_blocks.text_blocks(_snapshots(jobs, "txt"), "job_id", "text").where("text is not null")
    plain = plain.select("job_id", (F.col("seg_no") - 1).cast("int").alias("ord"), F.col("seg_no").cast("string").alias("id"), "type", F.col("text").alias("original"), F.lit(None).cast(info).alias("source_info"), F.array().cast(markdown_review.SPANS).alias("protected_spans"), F.lit(None).cast("string").alias("error"))
    marked = markdown_review.markdown_blocks(_snapshots(jobs, "md"), "job_id", "text")
    source_info = F.when(F.col("error").isNull(), F.struct("start_pos", "end_pos", "formatting", "protected")).cast(info)
    return plain.unionByName(marked.select("job_id", "ord", "id", "type", "original", source_info.alias("source_info"), "protected_spans", "error"))


def prepared_blocks(jobs: DataFrame, backend: Callable[[], Backend], glossary: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``(job_id, ord, id, type, original, proposal, source_info, action, errors)``: the blocks of all jobs with translated proposals.

    Literals of Markdown are masked; their markers may move but must each come back once, and the proposal must hold each literal at one
    place. Otherwise, or if the model fails, the whole original is the proposal and ``action`` says so. Blocks of jobs that cannot
    be reviewed are left to :func:`job_blocks` and its errors.
    """
    keys = ["job_id", "ord", "id", "type", "source_info"]
    found = job_blocks(jobs).where("error is null").select(*keys, F.col("original").alias("text"), "protected_spans")
    done = translate.translate_segments(found, keys, backend, glossary, limit, ordered=False)
    carried = [*keys, "text", "translated", "action", "errors"]
    row = done.select(F.struct(*carried).alias("row"), F.col("source_info.protected").alias("literals"), "translated")
    checked = markdown_review.literals_checked(row, ["row"], "literals", "translated").select("row.*", "sound")
    return checked.select(
        *keys[:4], F.col("text").alias("original"), F.when(F.col("sound"), F.col("translated")).otherwise(F.col("text")).alias("proposal"), "source_info",
        F.when(F.col("sound"), F.col("action")).otherwise(translate.RETAINED).alias("action"), F.when(F.col("sound"), F.col("errors")).otherwise(F.concat("errors", F.array(F.lit("ambiguous_content")))).alias("errors"),
    )


def preparation_issues(prepared: DataFrame) -> DataFrame:
    """Issue rows of blocks whose proposal is their original because something failed."""
    return prepared.where("action is not null").select(
        F.col("job_id").alias("run_id"), F.col("id").alias("segment_id"), F.col("type").alias("segment_type"), (F.col("ord") + 1).alias("segment_number"), "action",
        F.array_join("errors", "; ").alias("reason"), "original", F.lit("review_preparation").alias("stage"),
    )


def finalized_markdown(jobs: DataFrame, reviewed: DataFrame, align: bool = True) -> DataFrame:
    """``(id, document, issues, error)`` of Markdown jobs and their reviewed ``(job_id, id, text)``; issues are ``block action: reason``.

    Every block needs one text. The document is null where the texts don't fit or would change its blocks; it never holds half of a review.
    """
    texts = reviewed.groupBy("job_id").agg(F.collect_list(F.struct("id", "text")).alias("texts"))  # the blocks of one document
    both = _snapshots(jobs, "md").join(texts, "job_id", "left")

    def make():
        def work(row: dict) -> list[tuple]:
            given = [(t["id"], t["text"]) for t in row["texts"] or ()]
            try:
                if len(dict(given)) < len(given) or any(t is None for _, t in given):
                    raise ReviewError("the reviewed texts don't fit the blocks")
                document, issues = markdown_review.finalized_document(row["text"] or "", dict(given), al.by_position if align else None)
            except ReviewError as e:
                return [(row["job_id"], None, [], str(e))]
            return [(row["job_id"], document, [f"{block} {i['action']}: {i['reason']}" for block, i in issues], None)]

        return work

    return flat_map(both, "id string, document string, issues array<string>, error string", make)

