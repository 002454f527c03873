"""Review jobs: snapshots and their checks, the text form that people edit, and the reviewed document.

A review text names each block and holds its source, its proposed translation and a place for a correction. Blank lines mean
nothing. A line that looks like a control line or starts with a backslash gets a backslash before it.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map
from folioflow.functions.text import SPACE, joined, newlines

# The control lines of the review form.
HEADER, ORIGINAL, TRANSLATION, CORRECTION, END = "document-review: 1", "--- Original ---", "--- Translation ---", "--- Correction ---", "=== End Block ==="
CONTROL = rf"^(?:{re.escape(HEADER)}|--- (?:Original|Translation|Correction) ---|=== End Block ===|=== Block [A-Za-z0-9._:-]+ ===)$"
_BLOCK = re.compile(r"=== Block ([A-Za-z0-9._:-]+) ===")
_CONTROL = re.compile(CONTROL)
MOST_BYTES = 128 << 20
MOST_MEMBER = 64 << 20
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


class ReviewError(ValueError):
    pass


def encoded(text: Column) -> Column:
    """A text as lines of a review, with control-like lines escaped."""
    lines = F.split(newlines(text), "\n")
    return F.array_join(F.transform(lines, lambda x: F.when(x.startswith("\\") | x.rlike(CONTROL), F.concat(F.lit("\\"), x)).otherwise(x)), "\n")


def content_lines(text: Column) -> Column:
    return F.filter(F.split(newlines(text), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def source_label(name: Column) -> Column:
    """The name as in JSON, without the quotes."""
    return F.concat(F.lit("Source: "), F.regexp_extract(F.to_json(F.struct(name.alias("n"))), r'^\{"n":"(.*)"\}$', 1))


def review_texts(jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(job_id, review)`` of ``(job_id, source_name)`` and ``(job_id, ord, id, original, proposal)``."""
    part = F.concat(
        F.lit("=== Block "), "id", F.lit(" ===\n"), source_label(F.col("source_name")), F.lit(f"\n{ORIGINAL}\n"), encoded(F.coalesce("original", F.lit(""))), F.lit(f"\n{TRANSLATION}\n"),
        encoded(F.coalesce("proposal", F.lit(""))), F.lit(f"\n{CORRECTION}\n\n{END}\n\n"),
    )
    body = blocks.join(jobs, "job_id").select("job_id", "ord", part.alias("part")).groupBy("job_id").agg(joined(F.col("part"), F.col("ord")).alias("body"))
    return body.select("job_id", F.concat(F.lit(f"{HEADER}\nJob-ID: "), "job_id", F.lit("\n\n"), "body").alias("review"))


def parsed_review(text: str) -> tuple[str, list[tuple[str, str, str, str, str]]]:
    """(job id, ``(block, source label, original, proposal, correction)`` of each block); a ReviewError says what is wrong."""
    if len(text) > MOST_BYTES:
        raise ReviewError("the review is too large")
    rows = iter([x for x in re.split(r"\r\n|\r|\n", text.removeprefix("\ufeff")) if x.strip()])

    def take(expected: str | None = None) -> str:
        line = next(rows, None)
        if line is None:
            raise ReviewError("the review ends too early")
        if expected is not None and line != expected:
            raise ReviewError(f"expected: {expected}")
        return line

    def section(end: str) -> str:
        out = []
        while (line := take()) != end:
            if line.startswith("\\"):
                line = line[1:]
                if not (line.startswith("\\") or _CONTROL.match(line)):
                    raise ReviewError("a leading backslash has to be doubled")
            elif _CONTROL.match(line):
                raise ReviewError("a control line stands in a text")
            out.append(line)
        return "\n".join(out)

    take(HEADER)
    job = take()
    if not job.startswith("Job-ID: "):
        raise ReviewError("the job is not named")
    found: list[tuple[str, str, str, str, str]] = []
    for line in rows:
        m = _BLOCK.fullmatch(line)
        if not m:
            raise ReviewError("text outside blocks")
        label = take()
        take(ORIGINAL)
        found.append((m[1], label, section(TRANSLATION), section(CORRECTION), section(END)))
    return job[8:], found


def review_blocks(reviews: DataFrame) -> DataFrame:
    """``(job_id, id, label, original, proposal, correction, error)`` of ``(job_id, review)``; a bad review gives one row with its error."""

    def make():
        def work(row: dict) -> list[tuple]:
            try:
                job, found = parsed_review(row["review"] or "")
                if job != row["job_id"]:
                    raise ReviewError("another job")
                return [(row["job_id"], *b, None) for b in found]
            except ReviewError as e:
                return [(row["job_id"], None, None, None, None, None, str(e))]

        return work

    return flat_map(reviews.select("job_id", "review"), "job_id string, id string, label string, original string, proposal string, correction string, error string", make)


def review_errors(imported: DataFrame, blocks: DataFrame) -> DataFrame:
    """``(job_id, id, error)``: unknown, missing and repeated blocks, and references that were changed. Blank lines don't count."""
    squeezed = lambda c: F.array_join(content_lines(F.coalesce(c, F.lit(""))), "\n")
    broken = imported.where("error is not null").select("job_id", "id", "error")
    read = imported.where("error is null")
    twice = read.groupBy("job_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("job_id", "id", F.lit("duplicate_block").alias("error"))
    stored = blocks.select("job_id", "id", squeezed(F.col("original")).alias("s_original"), squeezed(F.col("proposal")).alias("s_proposal"), F.lit(True).alias("stored"))
    both = read.withColumn("read", F.lit(True)).join(stored, ["job_id", "id"], "full_outer")
    error = (
        F.when(F.col("stored").isNull(), "unknown_block").when(F.col("read").isNull(), "missing_block")
        .when((F.col("original") != F.col("s_original")) | (F.col("proposal") != F.col("s_proposal")), "reference_changed")
    )
    return broken.unionByName(twice).unionByName(both.select("job_id", "id", error.alias("error")).where("error is not null"))


def selected(blocks: DataFrame, corrections: DataFrame) -> DataFrame:
    """``(job_id, ord, id, text)``: the correction of each block where there is one, else the stored proposal."""
    chosen = F.when(F.col("correction").rlike(f"[^{SPACE}]"), F.col("correction")).otherwise(F.col("proposal"))
    return blocks.join(corrections.select("job_id", "id", "correction"), ["job_id", "id"], "left").select("job_id", "ord", "id", chosen.alias("text"))


def job_errors(jobs: DataFrame) -> DataFrame:
    """``(id, error)`` of jobs whose version and format, id, name or snapshot hash don't fit."""
    pair = ((F.col("schema_version") == 1) & (F.col("document_format") == "txt")) | ((F.col("schema_version") == 2) & (F.col("document_format") == "md"))
    checks = [
        (~F.coalesce(pair, F.lit(False)), "schema_and_format"), (~F.coalesce(F.col("id").rlike(UUID), F.lit(False)), "job_id"),
        (F.coalesce(F.col("source_name"), F.lit("")).rlike(r"^$|[/\\\x00]"), "source_name"), (~F.coalesce(F.sha2("source", 256) == F.col("source_sha256"), F.lit(False)), "source_changed"),
    ]
    found = F.filter(F.array(*[F.when(bad, name) for bad, name in checks]), lambda x: x.isNotNull())
    return jobs.select("id", F.explode(found).alias("error"))


def block_errors(blocks: DataFrame) -> DataFrame:
    """``(job_id, id, error)`` of stored blocks: ids that occur twice in a job, and blocks without words or without a proposal."""
    blank = lambda c: ~F.coalesce(F.col(c).rlike(f"[^{SPACE}]"), F.lit(False))
    checks = F.array(F.when(blank("id"), "block_id"), F.when(blank("original"), "blank_original"), F.when(blank("proposal"), "blank_proposal"))
    single = blocks.select("job_id", "id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("error"))
    twice = blocks.groupBy("job_id", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("job_id", "id", F.lit("duplicate_block").alias("error"))
    return single.unionByName(twice)


def literal_counts(blocks: DataFrame) -> DataFrame:
    """``(job_id, id, literals, missing)``: how many protected literals a block has, and how many its proposal does not hold exactly once."""
    times = lambda text, x: F.size(F.split(text, F.concat(F.lit(r"\Q"), x, F.lit(r"\E")), F.lit(-1))) - 1
    return blocks.select("job_id", "id", F.size("protected").alias("literals"), F.size(F.filter("protected", lambda x: times(F.col("proposal"), x) != 1)).alias("missing"))


def packed(job: dict, source: bytes) -> bytes:
    """A job as a ZIP file of ``job.json`` and the snapshot."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("job.json", json.dumps(job, ensure_ascii=False, indent=2))
        z.writestr(f"source.{job['document_format']}", source)
    return buffer.getvalue()


def checked_job(job: dict, source: bytes) -> dict:
    """A job whose fields are what they must be, with the snapshot that it was made of; else a ReviewError."""
    text = ("id", "source_name", "source_lang", "target_lang", "source_sha256", "document_format")
    if any(not isinstance(job.get(k), str) or not job[k] for k in text) or type(job.get("schema_version")) is not int:
        raise ReviewError("a field is missing or of another type")
    if (job["schema_version"], job["document_format"]) not in {(1, "txt"), (2, "md")}:
        raise ReviewError("schema and format don't fit")
    if not re.match(UUID, job["id"]):
        raise ReviewError("the id is no UUID")
    if re.search(r"[/\\\x00]", job["source_name"]):
        raise ReviewError("the name is a path")
    if hashlib.sha256(source).hexdigest() != job["source_sha256"]:
        raise ReviewError("the snapshot was changed")
    return job


def unpacked(data: bytes) -> tuple[dict, bytes]:
    """The job and its snapshot; duplicate keys, other members and large ones are errors."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ReviewError("a key occurs twice")
        return dict(pairs)

    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            if any(e.file_size > MOST_MEMBER for e in z.infolist()):
                raise ReviewError("a member is too large")
            names = [e.filename for e in z.infolist()]
            if "job.json" not in names:
                raise ReviewError("the members don't fit")
            job = json.loads(z.read("job.json"), object_pairs_hook=once)
            if sorted(names) != sorted(["job.json", f"source.{job.get('document_format')}"]):
                raise ReviewError("the members don't fit")
            return job, z.read(f"source.{job['document_format']}")
    except (zipfile.BadZipFile, json.JSONDecodeError, UnicodeDecodeError) as e:
        raise ReviewError("the job file is damaged") from e
