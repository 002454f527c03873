"""Documents, glossaries, suites and review jobs from files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamReader

from folioflow.functions.arrow import flat_map
from folioflow.operators import html_text, markdown, odt, review, text_blocks

CASES = (
    "id string, category string, source string, target string, review_note string, expected array<array<string>>, marker_prefix string, markers array<string>,"
    "scopes array<struct<id:string,source:array<int>,link_target:string>>,"
    "expected_spans array<struct<source_ranges:array<struct<start:int,end:int,text:string>>,target_ranges:array<struct<start:int,end:int,text:string>>,relation:string>>"
)
SUITE = "schema_version int, suite_version int, source_lang string, target_lang string, examples array<struct<id:string,category:string,source:string,reference:string,criteria:array<string>,format:string>>"
FORMATS = {"txt": "txt", "md": "md", "markdown": "md", "html": "html", "htm": "html", "odt": "odt"}


def documents(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``(path, name, document_format, content)`` of files as they are; formats go by the name's end."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return with_format((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path))


def with_format(files: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return files.select("path", name.alias("name"), known[ending].alias("document_format"), "content")


def stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of new files."""
    reader: DataStreamReader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return with_format(reader.load(path))


def segments(files: DataFrame) -> DataFrame:
    """``(path, document_format, seg_no, id, type, text, protected_spans)`` of documents of all formats; each goes through its own reader."""
    text = files.where("document_format <> 'odt'").select("path", "document_format", F.decode("content", "UTF-8").alias("text"))
    none = F.array().cast("array<struct<start_pos:int,end_pos:int>>").alias("protected_spans")
    one = lambda n: F.col(n).cast("int").alias("seg_no")
    plain = text_blocks.text_blocks(text.where("document_format = 'txt'"), "path", "text").where("text is not null").select("path", one("seg_no"), "type", "text", none)
    marked = markdown.markdown_regions(text.where("document_format = 'md'"), "path", "text").select("path", one("seg_no"), "type", "text", "protected_spans")
    pages = html_text.html_segments(text.where("document_format = 'html'"), "path", "text").select("path", one("seg_no"), F.lit("html_text").alias("type"), "text", "protected_spans")
    packages = odt.odt_blocks(files.where("document_format = 'odt'"), "path", "content").where("error is null and reason is null")
    office = packages.select("path", one("block_no"), "type", "text", "protected_spans")
    form = lambda df, name: df.withColumn("document_format", F.lit(name))
    return form(plain, "txt").unionByName(form(marked, "md")).unionByName(form(pages, "html")).unionByName(form(office, "odt")).withColumn("id", F.col("seg_no").cast("string"))


def suite(spark: SparkSession, path: str) -> DataFrame:
    """Examples of an evaluation suite, with their defaults."""
    return spark.read.schema(SUITE).json(path, multiLine=True).select("suite_version", "source_lang", "target_lang", F.inline("examples")).withColumn("format", F.coalesce("format", F.lit("txt")))


def suite_errors(examples: DataFrame) -> DataFrame:
    """``(id, error)`` of examples without sources, references or criteria, of unknown formats, and with ids that occur twice."""
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    checks = F.array(
        F.when(blank("id"), "id"), F.when(blank("source"), "source"), F.when(blank("reference"), "reference"),
        F.when(~F.coalesce(F.col("format").isin("txt", "markdown", "html"), F.lit(False)), "format"), F.when(F.coalesce(F.size(F.when(F.col("criteria").isNotNull(), F.col("criteria"))), F.lit(0)) == 0, "criteria"),
    )
    single = examples.select("id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("error"))
    twice = examples.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and id is not null").select("id", F.lit("duplicate_id").alias("error"))
    return single.unionByName(twice)


def alignment_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).json(path, multiLine=True)


def review_jobs(files: DataFrame) -> DataFrame:
    """``(path, id, source_name, document_format, schema_version, source, error)`` of job files (ZIP)."""

    def make():
        def work(row: dict) -> list[tuple]:
            try:
                job, source = review.unpacked(row["content"] or b"")
                review.checked_job(job, source)
                return [(row["path"], job.get("id"), job.get("source_name"), job.get("document_format"), job.get("schema_version"), source, None)]
            except review.ReviewError as e:
                return [(row["path"], None, None, None, None, None, str(e))]

        return work

    return flat_map(files.select("path", "content"), "path string, id string, source_name string, document_format string, schema_version int, source binary, error string", make)


def publish(rows: DataFrame, path: str) -> None:
    """``(name, content)`` as files of a new folder of a file system that all executors share; nothing that exists is overwritten.

    ``path`` is a path or an address that pyarrow knows (``file://``, ``hdfs://``, ``s3://``). Each file is written beside its name under one of its
    own and then moved, so a lost task leaves no half-written file under a final name and may run again, and two tasks don't meet.
    """
    from pyarrow import fs

    address = path if "://" in path else os.path.abspath(path)
    system, folder = fs.FileSystem.from_uri(address)
    if system.get_file_info(folder).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(folder, recursive=True)

    def write(part) -> None:
        system, folder = fs.FileSystem.from_uri(address)
        for row in part:
            own = f"{folder}/.{uuid.uuid4().hex}.part"
            with system.open_output_stream(own) as out:
                out.write(bytes(row.content))
            system.move(own, f"{folder}/{row.name}")

    rows.select("name", "content").foreachPartition(write)
