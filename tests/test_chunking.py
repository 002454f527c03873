from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.operators import chunking as ch


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.!? \n \"", max_size=80), st.integers(1, 20))
def test_splitting_loses_nothing_and_fits(text, limit):
    parts = ch.split_text(text, lambda s: len(s) <= limit)
    assert "".join((p or "") + s for p, s in parts) == text
    assert all(p is None or len(p) <= limit for p, _ in parts)


def test_prefers_the_sentence_nearest_the_middle():
    text = "One two. Three four. Five six seven eight nine."
    assert ch.split_text(text, lambda s: len(s) <= 30)[0] == ("One two. Three four.", " ")
    assert ch.split_text("abcdefghij", lambda s: len(s) <= 3) == [(None, "abcdefghij")]


def plain(text):
    import re

    out, start = [], 0
    for m in re.finditer(r"\s+", text):
        if re.search(r"[.!?][\"'”’)]*$", text[start : m.start()]):
            out.append((text[start : m.start()], m[0]))
            start = m.end()
    return out + ([(text[start:], "")] if start < len(text) else [])


def test_sentence_parts_against_a_loop(spark):
    texts = ["A b. C d!  E", "No end", "He said \"Stop.\" Then. ", "x.y z?\n\nNext", "", "  lead. in", "Q? NBSP. T x", "😀. b", "...　a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {i: [] for i in range(len(texts))}
    for r in ch.sentence_parts(df, ["id"], "text").orderBy("id", "part_no").collect():
        got[r.id].append((r.part, r.separator))
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_budget_chunks_and_nulls(spark):
    df = spark.createDataFrame([(1, "aaa bbb ccc"), (2, None), (3, "")], "id long, text string")
    rows = ch.budget_chunks(df, ["id"], "text", 7).orderBy("id", "chunk_no").collect()
    assert "".join((r.part or "") + r.separator for r in rows if r.id == 1) == "aaa bbb ccc"
    assert all(len(r.part or "") <= 7 for r in rows)
