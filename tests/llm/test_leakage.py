import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm import leakage
from folioflow.llm.leakage import Passages, leaked, leaks_in, reading_order

WORDS = "pump valve tank sensor cable module panel shaft brake lever motor filter hatch gauge arm ring coil nozzle rotor intake".split()


def passage(rng, n=30):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def suite():
    rng = random.Random(4)
    return [(k, passage(rng)) for k in range(40)]


@pytest.fixture(scope="module")
def passages(suite):
    return Passages(suite)


def prose(rng, n):
    return " ".join(rng.choice(["the", "council", "opened", "bridge", "many", "people", "rain", "evening", "crowd", "river", "mayor"]) for _ in range(n))


def lines(text, width=32):
    import textwrap

    return textwrap.wrap(text, width)


def found(passages, text, xs=None, ys=None):
    return {(passages.items[q], w) for _, q, w in leaks_in([text], [xs], [ys], passages)}


def test_whole_part_and_too_short(suite, passages):
    rng = random.Random(1)
    words = suite[7][1].split()
    around = lambda x: "\n".join(lines(prose(rng, 30) + " " + x + " " + prose(rng, 30)))
    assert found(passages, around(suite[7][1])) == {(7, 30)}
    assert found(passages, around(" ".join(words[5:17]))) == {(7, 12)}
    assert found(passages, around(" ".join(words[5:16]))) == set()
    assert found(passages, around(suite[7][1].upper().replace(" ", ", "))) == {(7, 30)}


def test_misread_letters_hyphens_and_adverts(suite, passages):
    rng = random.Random(2)
    hits = 0
    for k in range(40):
        text = suite[k][1]
        confused = "".join({"e": "c", "a": "o", "t": "f", "n": "u", "l": "1", "r": "v"}.get(c, c) if rng.random() < 0.06 else c for c in text)
        rows = lines(confused.replace("m", "rn", 1))
        for i in range(0, len(rows) - 1, 2):  # hyphens at line ends, some of them lost
            head, _, tail = rows[i + 1].partition(" ")
            if len(head) > 4:
                rows[i] += " " + head[:3] + rng.choice(["-", "­", ""])
                rows[i + 1] = head[3:] + " " + tail
        rows[len(rows) // 2 : len(rows) // 2] = ["WANTED, a strong lad", "Price 31d. per box", "Boots repaired while you wait"]
        hits += any(item == k for item, _ in found(passages, "\n".join([*lines(prose(rng, 20)), *rows, *lines(prose(rng, 20))])))
    assert hits >= 36  # recall of 0.9


@pytest.mark.parametrize("advert", [3, 12, 60])
def test_long_adverts_are_stepped_over(suite, passages, advert):
    rng = random.Random(3)
    words = suite[9][1].split()
    between = lines(prose(rng, 12 * advert))[:advert]
    assert len(between) == advert
    page = [*lines(prose(rng, 30)), " ".join(words[4:13]), *between, " ".join(words[13:22]), *lines(prose(rng, 30))]
    assert found(passages, "\n".join(page)) == {(9, 18)}
    apart = [*lines(prose(rng, 30)), " ".join(words[4:9]), *between, " ".join(words[20:25]), *lines(prose(rng, 30))]
    assert found(passages, "\n".join(apart)) == set()


def test_columns(suite, passages):
    rng = random.Random(3)
    left, right = lines(suite[3][1]), lines(prose(rng, 60))
    n = max(len(left), len(right))
    left, right = left + [""] * (n - len(left)), right + [""] * (n - len(right))
    rows = [x for pair in zip(left, right) for x in pair]
    assert found(passages, "\n".join(rows), [80 if k % 2 == 0 else 900 for k in range(2 * n)], [40 * (k // 2) for k in range(2 * n)]) == {(3, 30)}
    merged = [f"{a:<40}{b}" for a, b in zip(left, right)]
    assert found(passages, "\n".join(merged), [80] * n, [40 * k for k in range(n)]) == {(3, 30)}
    whole, starts, pages = reading_order(["a\nb", "c"], [[900, 80], None], [[0, 0], None])
    assert whole.split("\n")[:3] == ["b", "a", "c"] and pages.tolist() == [0, 0, 1] and len(starts) == 3


def test_near_misses_of_other_items(suite, passages):
    words = suite[9][1].split()
    for k in range(0, 30, 8):
        words[k] = "zebra"
    assert found(passages, " ".join(words)) == set()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=90), st.lists(st.integers(0, 3), max_size=90))
def test_edit_distance_against_the_table(a, b):
    assert leakage.edit_distance(a, b) == distance(a, b)


def test_scripts_without_spaces():
    rng = random.Random(8)
    sign = lambda n: "".join(chr(rng.randint(0x4E00, 0x8FFF)) for _ in range(n))
    leak = sign(60)
    chinese = Passages([(1, leak), (2, sign(80))])
    assert found(chinese, sign(200)) == set()
    assert found(chinese, sign(70) + leak[5:50] + "。\n" + sign(70)) == {(1, 22)}
    assert found(chinese, sign(30) + leak[5:20] + sign(70)) == set()


def test_letters_of_a_class_are_no_letters_of_the_word(suite, passages):
    """What only falls into the same classes everywhere is found by the search and refused by the exact distance."""
    text = suite[4][1].translate(str.maketrans({"a": "0", "e": "9", "o": "q", "c": "g", "t": "5", "f": "s", "n": "u", "r": "v", "i": "1", "l": "j"}))
    assert found(passages, text) == set()


def test_suites_in_parts(spark, suite, monkeypatch):
    documents = spark.createDataFrame([(k, "\n".join(lines(text)), None) for k, text in suite], "doc_id long, text string, line_boxes array<struct<x:int,y:int>>")
    items = spark.createDataFrame(suite, "item_id long, passage string")
    monkeypatch.setattr(leakage, "MOST_PASSAGES", 30)
    assert {(r.doc_id, r.item_id) for r in leaked(documents, items).collect()} == {(k, k) for k, _ in suite}


def test_embedding_keeps_small_edits_near():
    e = leakage.Embedding()
    rng = np.random.default_rng(0)
    pad = np.zeros(leakage.STEPS + 1, np.uint8)
    near = far = 0
    for _ in range(200):
        a = rng.integers(1, 24, 40).astype(np.uint8)
        b = np.delete(a, 20)
        ka, kb, kc = (e.keys(np.r_[x, pad], np.array([0]))[:, 0] for x in (a, b, rng.integers(1, 24, 40).astype(np.uint8)))
        near += bool((ka == kb).any())
        far += bool((ka == kc).any())
    assert near > 100 and far == 0


def test_rows(spark, suite):
    box = "array<struct<x:int,y:int,w:int,h:int,conf:float>>"
    text = "\n".join(lines(suite[5][1]))
    rows = [(1, text, [(80, 40 * k, 9, 9, 1.0) for k in range(text.count("\n") + 1)], 7), (2, text, None, 7), (3, text, [], 7), (4, None, None, 7), (5, "", [], 7), (6, "short", [(1, 1, 1, 1, 1.0)], 7), (7, text + "\n" + text, None, 7), (8, "x" * 200_000, None, 7)]
    documents = spark.createDataFrame(rows, f"doc_id long, text string, line_boxes {box}, item_id long")
    items = spark.createDataFrame([*suite, (5, suite[5][1] + " more words"), (99, None), (None, "x"), (98, "too short"), (97, "")], "item_id long, passage string")
    got = {(r.doc_id, r.item_id): r.words for r in leaked(documents, items).collect()}
    assert got == {(1, 5): 30, (2, 5): 30, (3, 5): 30, (7, 5): 30}
    assert leaked(documents.where("false"), items).count() == 0 and leaked(documents, items.where("false")).count() == 0
