import pytest
from pyspark.sql import functions as F

from folioflow.functions import backends
from folioflow.operators import alignment as al
from folioflow.operators import markdown_review as mr
from folioflow.operators.review import ReviewError
from folioflow.plans import review_jobs

SOURCE = """---
title: kept
---
# Main head #

One *soft* and **bold [link](http://x)** word, `code_1`
goes on &amp; ends\\!

> Quoted first
> and second

1. item one
2. item <http://x.y/z>

| a head | b head |
|---|---|
| cell one | `only` |

```
no prose
```
"""


def texts(source):
    return [(b.id, b.type, b.text) for b in mr.review_blocks(source)]


def test_blocks_show_what_is_read():
    assert texts(SOURCE) == [
        ("1", "heading", "Main head"), ("2", "paragraph", "One soft and bold link word, code_1\ngoes on & ends!"), ("3", "blockquote", "Quoted first\nand second"), ("4", "numbered_item", "item one"),
        ("5", "numbered_item", "item http://x.y/z"), ("6", "table_cell", "a head"), ("7", "table_cell", "b head"), ("8", "table_cell", "cell one"),
    ]
    b = mr.review_blocks(SOURCE)[1]
    assert [SOURCE[b.start : b.end][r[1] : r[2]] for r in b.seen.ranges] == ["soft", "bold [link](http://x)", "link"]
    assert b.seen.scopes() == [(4, 8), (13, 22), (18, 22)] and b.seen.literals(SOURCE[b.start : b.end]) == [("code_1", "`code_1`")]
    assert texts("") == [] and texts("```\nx\n```\n") == []


@pytest.mark.parametrize("source, message", [("a <b>x</b>", "inline HTML"), ("<div>\nx\n</div>", "HTML has no form"), ("see `x1` and x1 now", "ambiguous"), ("![a](b) c", "images")])
def test_what_has_no_form_for_review(source, message):
    with pytest.raises(ReviewError, match=message):
        mr.review_blocks(source)


def test_literals_are_whole_words():
    assert mr.located(["x", "y z"], "xx x, y z") == [(3, 4), (6, 9)]
    for literals, text in ((["x"], "x x"), (["x"], "xx"), (["ab", "b c"], "ab c"), ([""], "a")):
        with pytest.raises(ReviewError):
            mr.located(literals, text)


def test_reviewed_texts_come_back_as_they_read():
    same = {b.id: b.text for b in mr.review_blocks(SOURCE)}
    assert mr.finalized_document(SOURCE, same) == (SOURCE, [])
    new = same | {"1": "Kopf * | # eins", "2": "Ein weiches Wort\nmit code_1 am Ende.", "3": "Erstes\nzweites\ndrittes", "4": "- kein Punkt", "8": "Zelle | zwei"}
    document, issues = mr.finalized_document(SOURCE, new)
    assert {b.id: b.text for b in mr.review_blocks(document)} == new
    assert "> drittes" in document and "`code_1`" in document and "title: kept" in document and "Zelle \\| zwei" in document and "no prose" in document
    assert {i["reason"] for _, i in issues} == {"unresolved_source"}


def test_formatting_goes_where_its_words_go():
    source = "One *soft* word here\n"
    align = lambda s, t: [(0, 0), (1, 2), (2, 1), (3, 3)]
    assert mr.finalized_document(source, {"1": "Ein Wort weich hier"}, align)[0] == "Ein Wort *weich* hier\n"
    assert mr.finalized_document("**All of it**\n", {"1": "Alles\n"})[0] == "**Alles**\n"
    nested = "a [b](x) and [c](y) d\n"
    document, issues = mr.finalized_document(nested, {"1": "p q r s t"}, lambda s, t: [(0, 0), (1, 1), (2, 2), (3, 1), (4, 3)])
    assert document == "p q r s t\n" and {i["action"] for _, i in issues} == {"dropped"}


@pytest.mark.parametrize("target", ["two\n\nparagraphs", "", "lost code"])
def test_what_would_change_the_blocks_is_refused(target):
    source = "One `code_1` word\n\nTwo\n"
    with pytest.raises(ReviewError):
        mr.finalized_document(source, {"1": target, "2": "Zwei"})
    with pytest.raises(ReviewError):
        mr.finalized_document(source, {"1": "code_1"})


def files(spark):
    rows = [("a.md", "md", SOURCE.encode()), ("b.txt", "txt", "﻿One line\n\n- an item\n".encode()), ("c.md", "md", b"a <b>x</b>\n"), ("d.odt", "odt", b"x"), ("e.md", "md", None), ("f.md", "md", b"")]
    return spark.createDataFrame(rows, "name string, document_format string, content binary")


def test_jobs_from_files_to_documents(spark):
    jobs = review_jobs.created_jobs(files(spark), "en", "de")
    assert jobs.count() == 4 and jobs.select("id").distinct().count() == 4
    assert jobs.where("sha2(source, 256) <> source_sha256 or not id rlike '^[0-9a-f-]{36}$'").count() == 0
    assert [r.error for r in review_jobs.job_blocks(jobs).where("error is not null").collect()] == ["block 1: inline HTML and images have no form for review"]
    prepared = review_jobs.prepared_blocks(jobs, backends.upper)
    names = {r.id: r.source_name for r in jobs.collect()}
    got = {(names[r.job_id], r.id): r.proposal for r in prepared.collect()}
    assert got["a.md", "2"] == "ONE SOFT AND BOLD LINK WORD, code_1\nGOES ON & ENDS!" and got["a.md", "5"] == "ITEM http://x.y/z" and len(got) == 10
    done = {names[r.id]: r for r in review_jobs.finalized_markdown(jobs, prepared.select("job_id", "id", F.col("proposal").alias("text"))).collect()}
    assert "`code_1`" in done["a.md"].document and "# MAIN HEAD" in done["a.md"].document and "*SOFT*" in done["a.md"].document and done["a.md"].error is None
    assert done["c.md"].document is None and done["f.md"].document == "" and set(done) == {"a.md", "c.md", "f.md"}
    missing = review_jobs.finalized_markdown(jobs, prepared.where("id <> '2'").select("job_id", "id", F.col("proposal").alias("text")))
    assert {names[r.id]: r.error for r in missing.collect()}["a.md"].endswith("don't fit the blocks")
    with pytest.raises(ReviewError):
        review_jobs.created_jobs(files(spark), "en", "en")


def test_failed_blocks_keep_their_originals_with_an_issue(spark):
    jobs = review_jobs.created_jobs(files(spark).where("name = 'a.md'"), "en", "de")
    prepared = review_jobs.prepared_blocks(jobs, backends.failing("soft"))
    kept = review_jobs.preparation_issues(prepared).collect()
    assert [(r.segment_id, r.action) for r in kept] == [("2", "retained_original")] and "cannot translate" in kept[0].reason
    twice = review_jobs.prepared_blocks(jobs, lambda: lambda texts: [(t + " code_1" if "soft" in t else t, None) for t in texts])
    row = {r.id: r for r in twice.collect()}["2"]
    assert row.proposal == row.original and row.errors == ["ambiguous_content"]


def test_nested_links_are_a_conflict():
    from folioflow.operators.rendering import Wrapped, render

    text, issues = render("abcdef", [Wrapped("1", "[", "](x)", [(0, 6)], True), Wrapped("2", "[", "](y)", [(1, 3)], True)])
    assert text == "abcdef" and {i["id"] for i in issues} == {"1", "2"}
    assert al.by_position("a", "b") == [(0, 0)]
