import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.pieces import RangeMax, item_boundaries, natural_boundary, pieces, split_items
from folioflow.llm.sentences import BLANK, Model, Splitter

S = Splitter({"en": Model()})


def cut(text, size, overlap):
    return pieces(text, size, overlap, S.spans(text, "en"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.integers(1, 60), st.data())
def test_range_maximum_against_a_loop(values, widest, data):
    table = RangeMax(np.array(values), widest)
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a + 1, len(values)))
    best = max(values[a:b])
    assert table.query(a, b) == max(k for k in range(a, b) if values[k] == best)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_pieces_join_to_the_text_with_their_overlap(text, size, overlap):
    found = cut(text, size, overlap)
    assert all(0 < e - s <= size for s, e, _ in found)
    at = 0
    for k, (s, e, _) in enumerate(found):
        assert s == (at - overlap if k else 0)
        at = e
    assert at == len(text)


def test_strongest_cut_rightmost():
    text = "One two. Three.\n\nFour five six. Seven eight nine ten"
    ends = [text[:e] for _, e, _ in cut(text, 30, 0)]
    assert ends[0] == "One two. Three.\n\n"
    assert [k for _, _, k in cut(text, 30, 0)][0] == 3
    assert cut("x" * 25, 10, 2) == [(0, 10, 0), (8, 18, 0), (16, 25, 3)]
    assert cut("", 5, 1) == [] and cut(None, 5, 1) == [] and cut("abc", 5, 1) == [(0, 3, 3)]
    with pytest.raises(ValueError):
        cut("abcdef", 3, 3)


@pytest.mark.parametrize(
    "text, limit, want",
    [("aaaa bbbb.\n\ncccc.", 10, "paragraph"), ("Aaaa bbbb. Cccc dddd.", 10, "sentence"), ("aaaa bbbb cccc dddd", 10, "word"), ("a" * 20 + " b", 10, "none"), ("aaaa\n\n" + "b" * 9 + ". Cccc.", 10, "sentence"), ("\n\n" + "a" * 5 + " " + "b" * 5 + "\n\n", 8, "word")],
)
def test_boundaries(text, limit, want):
    assert natural_boundary(text, limit, S.spans(text, "en")) == want


def lengths_fit(text, limit, sentences):
    """By the lengths of all units, without a cutting."""
    ends = [(m.start(), m.end()) for m in BLANK.finditer(text) if text[: m.start()].strip() and text[m.end() :].strip()]
    cuts = [0, *(x for e in ends for x in e), len(text)]
    if ends and all(len(text[a:b].strip()) <= limit for a, b in zip(cuts[::2], cuts[1::2])):
        return "paragraph"
    if all(e - s <= limit for s, e in sentences):
        return "sentence"
    return "word" if all(len(w) <= limit for w in text.split()) else "none"


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb ", "Ccc", ". ", ".", "。", " ", "\n", "\n\n", "\r\n \r\n", "dddd"]), max_size=60).map("".join), st.integers(1, 14))
def test_boundary_of_the_cutting_against_all_lengths(text, limit):
    spans = S.spans(text, "en")
    if spans:
        assert natural_boundary(text, limit, spans) == lengths_fit(text, limit, spans)


def test_the_sparse_table_decides(monkeypatch):
    text = "Aaaa bbbb. Cccc dddd."
    monkeypatch.setattr(RangeMax, "query", lambda self, a, b: a)  # the first cut of a window instead of the strongest
    assert natural_boundary(text, 10, S.spans(text, "en")) != "sentence"


def test_rows(spark):
    items = spark.createDataFrame(
        [("segment", 1, "en", "word " * 30, 1), ("segment", 1, "en", "word " * 30, 2), ("segment", 2, None, "short", 1), ("chunk_text", 1, None, None, 1), ("chunk_text", 3, None, "x" * 90, 1), ("other", 4, "en", "y" * 999, 1), ("segment", None, "en", "z" * 70, 1)],
        "origin string, item_key long, lang string, text string, piece_no int",
    )
    budget = spark.createDataFrame([("segment", 60, 5), ("segment", 60, 5), ("chunk_text", 40, None), (None, 1, 0), ("none", None, 1)], "origin string, max_size int, overlap int")
    got = {(r.origin, r.item_key): r.boundary for r in item_boundaries(items, budget, {}, {}).collect()}
    assert got == {("segment", 1): "word", ("chunk_text", 3): "none", ("segment", None): "none"}
    rows = split_items(items, budget, {}, {}).where("origin = 'chunk_text'").orderBy("piece_no").collect()
    assert [(r.start_pos, r.end_pos, r.cut) for r in rows] == [(0, 40, "none"), (40, 80, "none"), (80, 90, "end")]
    assert split_items(items, budget.where("false"), {}, {}).count() == 0 and item_boundaries(items.where("false"), budget, {}, {}).count() == 0


def test_very_long_item():
    text = "Some words here. " * 60_000
    found = cut(text, 900, 90)
    assert found[-1][1] == len(text) and max(e - s for s, e, _ in found) <= 900
