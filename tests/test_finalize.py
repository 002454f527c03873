import os
import re

import pytest
from pyspark.sql import functions as F

from folioflow import queries
from folioflow.operators import evaluation as ev
from folioflow.plans.finalize import finalized_markdown, finalized_text
from tests.compare import FOLDER, connect


def test_text_jobs(spark):
    jobs = spark.createDataFrame([("j", "Head\r\n\r\n- item\r\n\r\nlast"), ("k", "one")], "id string, text string")
    chosen = spark.createDataFrame([("j", "1", "Kopf\n"), ("j", "2", "Punkt"), ("j", "3", "Ende"), ("k", "7", "x")], "job_id string, id string, text string")
    got = {r.id: r for r in finalized_text(jobs, chosen).collect()}
    assert got["j"].document == "Kopf\r\n\r\n- Punkt\r\n\r\nEnde" and (got["j"].missing, got["j"].extra) == (0, 0)
    assert got["k"].document == "one" and (got["k"].missing, got["k"].extra) == (1, 1)


def test_markdown_jobs(spark):
    jobs = spark.createDataFrame([("j", "# Head\n\n| a | b |\n|---|---|\n\ntext ä😀 end\n"), ("k", "abc"), ("l", "abc")], "id string, text string")
    rows = [("j", "heading", 2, 7, "Kopf\n"), ("j", "table_cell", 10, 11, "x|y\nz"), ("j", "paragraph", 29, 40, "Text ü"), ("k", "paragraph", 0, 2, "x"), ("k", "paragraph", 1, 3, "y"), ("j", "paragraph", None, None, "lost")]
    got = {r.id: r for r in finalized_markdown(jobs, spark.createDataFrame(rows, "job_id string, type string, start_pos int, end_pos int, chosen string")).collect()}
    assert got["j"].document == "# Kopf\n\n| x\\|y z | b |\n|---|---|\n\nText ü\n" and got["j"].sound
    assert got["k"].document == "abc" and not got["k"].sound and got["l"].document == "abc" and got["l"].sound


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_table_cells_get_their_proposals(spark):
    con = connect()
    want, cells = {}, 0
    for job, source in con.execute("SELECT DISTINCT id, decode(source) FROM review_job WHERE document_format = 'md'").fetchall():
        at, parts = 0, []
        rows = con.execute("SELECT DISTINCT type, proposal, source_info.start_pos AS s, source_info.end_pos AS e FROM review_block WHERE job_id = ? AND source_info.start_pos IS NOT NULL ORDER BY s", [job]).fetchall()
        for kind, proposal, start, end in rows:
            old = source[start:end]
            if kind == "table_cell" and proposal is not None:
                new = re.sub(r"(?<!\\)\|", r"\\|", re.sub(r"\s*\n\s*", " ", re.sub(r"\r\n?", "\n", proposal)))
                cells += new != old
            else:
                new = old if proposal is None else proposal.rstrip("\r\n") + re.search(r"[\r\n]*$", old)[0]
            parts += [source[at:start], new]
            at = end
        want[job] = "".join(parts) + source[at:]
    got = {r.id: (r.document, r.sound) for r in queries.QUERIES["markdown_finalized_cells"](spark, FOLDER).collect()}
    assert cells and got == {k: (v, True) for k, v in want.items()}


def test_evaluation(spark):
    pairs = spark.createDataFrame([(1, "a b c", "x y z", [["b", "y"], ["c", "x"]]), (2, None, None, None)], "pair_key long, source string, target string, expected array<array<string>>")
    got = {(r.pair_key, r.share): (r.expected, r.hit) for r in ev.evaluate_alignment(pairs, [0.5, 1.0]).collect()}
    assert got == {(1, 0.5): (2, 1), (1, 1.0): (2, 1), (2, 0.5): (0, 0), (2, 1.0): (0, 0)}
    assert ev.report(ev.evaluate_alignment(pairs, [1.0])).first().cases == 2
    assert ev.supported_pair("marian", "en", "de") and not ev.supported_pair("marian", "de", "en") and ev.supported_pair("qwen", "de", "en")
    df = spark.createDataFrame([("/a/b.c/doc.txt", "de"), ("/a/plain", "en")], "p string, l string")
    assert [r[0] for r in df.select(ev.output_name(F.col("p"), F.col("l"))).collect()] == ["/a/b.c/doc.de.txt", "/a/plain.en"]
    chat = df.select(ev.messages("From {source} to {target}", F.col("p"), F.lit("en"), F.col("l")).alias("m")).first().m
    assert chat[0].content == "From en to de" and chat[1].role == "user" and len(ev.fingerprint("x")) == 64
