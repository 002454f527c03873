import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.operators import issues, review

JOB = "11111111-2222-3333-4444-555555555555"
BLOCKS = [(JOB, 1, "1", "Source\n\\line\n--- Original ---\n", "Ziel\n=== Block 7 ==="), (JOB, 2, "2", "x", "y"), (JOB, 3, "3", "", None)]


def frames(spark):
    jobs = spark.createDataFrame([(JOB, 'na"me ä.txt')], "job_id string, source_name string")
    blocks = spark.createDataFrame(BLOCKS, "job_id string, ord int, id string, original string, proposal string")
    return jobs, blocks


def test_round_trip_and_selection(spark):
    jobs, blocks = frames(spark)
    texts = review.review_texts(jobs, blocks)
    text = texts.first().review
    assert 'Source: na\\"me ä.txt\n' in text and "\n\\\\line\n\\--- Original ---\n" in text and "\n\\=== Block 7 ===\n" in text
    back = review.review_blocks(texts)
    assert review.review_errors(back, blocks).count() == 0
    edited = spark.createDataFrame([(JOB, "﻿" + text.replace("--- Correction ---\n", "--- Correction ---\n\\\\neu\n\n", 1).replace("\n", "\r\n"))], "job_id string, review string")
    read = review.review_blocks(edited)
    assert review.review_errors(read, blocks).count() == 0
    assert [r.text for r in review.selected(blocks, read).orderBy("ord").collect()] == ["\\neu", "y", None]


def test_errors(spark):
    jobs, blocks = frames(spark)
    text = review.review_texts(jobs, blocks).first().review
    cases = {"reference_changed": text.replace("\ny\n", "\nz\n"), "unknown_block": text.replace("Block 2 =", "Block 9 ="), "duplicate_block": text + text[text.index("=== Block 2") : text.index("=== Block 3")]}
    for error, changed in cases.items():
        found = review.review_errors(review.review_blocks(spark.createDataFrame([(JOB, changed)], "job_id string, review string")), blocks)
        assert error in {r.error for r in found.collect()}, error
    for bad in ("", "x", text.replace("=== End Block ===", "", 1), text.replace("\\\\line", "\\line"), text.replace(JOB, "other")):
        row = review.review_blocks(spark.createDataFrame([(JOB, bad)], "job_id string, review string")).collect()
        assert len(row) == 1 and row[0].error


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "\\a", "--- Original ---", "=== Block 1 ===", "=== End Block ===", "\\\\", " b "]), min_size=1, max_size=5))
def test_escaping_round_trips(lines):
    escape = lambda x: "\\" + x if x.startswith("\\") or review._CONTROL.match(x) else x
    text = f"{review.HEADER}\nJob-ID: j\n=== Block b ===\nSource: s\n{review.ORIGINAL}\n" + "\n".join(map(escape, lines)) + f"\n{review.TRANSLATION}\n{review.CORRECTION}\n{review.END}\n"
    assert review.parsed_review(text)[1][0][2] == "\n".join(lines)


def test_job_errors(spark):
    import hashlib

    good = hashlib.sha256(b"abc").hexdigest()
    rows = [(JOB, "a.txt", good, bytearray(b"abc"), 1, "txt"), ("no-uuid", "a/b", "0", bytearray(b"abc"), 1, "md"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, source_name string, source_sha256 string, source binary, schema_version int, document_format string")
    got = {}
    for r in review.job_errors(df).collect():
        got.setdefault(r.id, set()).add(r.error)
    every = {"schema_and_format", "job_id", "source_name", "source_changed"}
    assert got == {"no-uuid": every, None: every}


def test_job_files():
    job = {"id": JOB, "document_format": "txt"}
    assert review.unpacked(review.packed(job, b"x")) == (job, b"x")
    import io
    import zipfile

    def zipped(**members):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in members.items():
                z.writestr(k.replace("_", "."), v)
        return out.getvalue()

    for bad in (b"", zipped(job_json='{"id": 1, "id": 2}', source_txt="x"), zipped(job_json='{"document_format": "txt"}'), zipped(job_json='{"document_format": "txt"}', source_txt="x", more_txt="y")):
        with pytest.raises(review.ReviewError):
            review.unpacked(bad)


def test_literals(spark):
    df = spark.createDataFrame([("j", "1", "a <br> b <br>", ["<br>", "(x)"]), ("j", "2", "see (x)", ["(x)"])], "job_id string, id string, proposal string, protected array<string>")
    assert sorted((r.id, r.literals, r.missing) for r in review.literal_counts(df).collect()) == [("1", 2, 2), ("2", 1, 0)]


def test_issue_log_and_totals(spark, tmp_path):
    rows = [(1, "r", "formatting_split", None, "paragraph", 1), (2, "r", "skipped_content", None, "heading", 2), (3, "s", "odd", "7", "heading", None)]
    df = spark.createDataFrame(rows, "issue_key long, run_id string, action string, page string, segment_type string, paragraph_number int")
    assert {(r.issue_key, r.error) for r in issues.issue_errors(df).collect()} == {(2, "paragraph_number"), (3, "unknown_action"), (3, "page")}
    assert {r.run_id: (r.issues, r.formatting, r.skipped, r.exit_code) for r in issues.totals(df, "run_id").collect()} == {"r": (2, 1, 1, 3), "s": (1, 0, 0, 3)}
    issues.write_log(df.coalesce(1), str(tmp_path / "log"), "issue_key", "action", "page")
    lines = spark.read.text(str(tmp_path / "log")).collect()
    assert lines[0].value == '{"issue_key":1,"action":"formatting_split"}'
    with pytest.raises(Exception, match="(?i)exist"):
        issues.write_log(df, str(tmp_path / "log"), "issue_key")
    assert df.where(F.lit(False)).count() == 0


def test_job_files_are_checked(spark):
    import hashlib
    import uuid

    from folioflow.operators import review as rv
    from folioflow.sources import files

    source = b"One line"
    good = {"id": str(uuid.UUID(int=5)), "source_name": "a.txt", "source_lang": "en", "target_lang": "de", "source_sha256": hashlib.sha256(source).hexdigest(), "document_format": "txt", "schema_version": 1}
    bad = {"id": "x", "source_name": "../a", "source_sha256": "0", "schema_version": 2, "target_lang": None}
    rows = [("good", rv.packed(good, source))] + [(k, rv.packed(good | {k: v}, source)) for k, v in bad.items()] + [("none", None), ("zip", b"PK")]
    found = {r.path: r for r in files.review_jobs(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert found["good"].error is None and bytes(found["good"].source) == source and found["good"].id == good["id"]
    assert all(found[k].error for k in [*bad, "none", "zip"])


def test_block_errors(spark):
    from folioflow.operators import review as rv

    rows = [("j", "1", "a", "b"), ("j", "1", "a", "b"), ("j", "2", " ", None), ("j", None, "a", "b")]
    got = sorted((r.id or "", r.error) for r in rv.block_errors(spark.createDataFrame(rows, "job_id string, id string, original string, proposal string")).collect())
    assert got == [("", "block_id"), ("1", "duplicate_block"), ("2", "blank_original"), ("2", "blank_proposal")]
