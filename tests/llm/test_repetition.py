import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.repetition import FOLLOWS, STRETCH, TOGETHER, WORD, all_repeated, host_verdicts, judged, measured, repeated_chars, with_shares


def brute(text):
    """Every stretch and every string, by comparing them all."""
    low = text.lower()
    hit = [False] * len(text)
    spans = [m.span() for m in WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    cover = [False] * len(words)
    starts = []
    for i in range(len(words) - STRETCH + 1):
        if any(words[k : k + STRETCH] == words[i : i + STRETCH] for k in range(i)):
            starts.append(i)
            for k in range(i, i + STRETCH):
                cover[k] = True
    for i, c in enumerate(cover):
        if c:
            end = spans[i + 1][0] if i + 1 < len(cover) and cover[i + 1] else spans[i][1]
            for k in range(spans[i][0], end):
                hit[k] = True
    i = 0
    while i < len(words):
        j = i
        while j + 1 < len(words) and words[j + 1] == words[i]:
            j += 1
        if j - i >= FOLLOWS:
            for k in range(spans[i][1], spans[j][1]):
                hit[k] = True
        i = j + 1
    n = len(low)
    for p in range(1, n // (FOLLOWS + 1) + 1):
        for a in range(n - p * (FOLLOWS + 1) + 1):
            if all(low[a + p * k : a + p * (k + 1)] == low[a : a + p] for k in range(1, FOLLOWS + 1)):
                for k in range(a + p, a + p * (FOLLOWS + 1)):
                    hit[k] = True
    return sum(hit)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab -1.", max_size=50))
def test_against_brute_force(text):
    assert repeated_chars(text) == brute(text)


def test_longer_texts_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice(["one two three four ", "ab", "five, ", "x ", "Ha", "\n- ", "3. "]) * rng.choice([1, 1, 2, 6]) for _ in range(rng.randint(1, 10)))
        assert repeated_chars(text) == brute(text), text


def test_texts_together_are_as_alone():
    rng = random.Random(5)
    texts = ["".join(rng.choice(["one two three four ", "ab", "five, ", "x ", "aaaaaa", "\n- "]) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, "", "a" * TOGETHER, "b c d e " * 3]
    assert all_repeated(texts) == [repeated_chars(t) for t in texts]
    assert all_repeated(["a b c d e"] * 5) == [0] * 5 and all_repeated([]) == []


def test_examples():
    assert repeated_chars(None) == repeated_chars("") == repeated_chars("all different words here now") == 0
    assert repeated_chars("word " * 4) == 0 and repeated_chars("ha" * 5) == 8 and repeated_chars("-" * 10) == 9
    line = "The pump moves the arm"
    assert repeated_chars(f"{line}. {line.upper()}!") == len(line)
    assert repeated_chars("1. a b c d\n2. a b c d\n3. a b c d") == len("a b c d\n3. a b c d")


def test_very_long_texts():
    assert repeated_chars("a" * 200_000) == 199_999
    rng = random.Random(1)
    assert repeated_chars("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(100_000))) == 0


def test_rows_and_hosts(spark):
    bad, good = "again and again we say " * 6, "nothing of this text repeats itself at all today"
    rows = [(k, f"h{k % 4}", bad if k % 4 == 0 else good, k) for k in range(40)] + [(100, None, bad, 1), (101, None, None, 1), (102, "h9", "", 2)]
    docs = spark.createDataFrame(rows, "issue_key long, run_id string, text string, share int").drop("share")
    found = measured(docs)
    assert found.columns == ["issue_key", "run_id", "n_chars", "n_repeated"]
    verdicts = {r.run_id: r for r in host_verdicts(found, "run_id").collect()}
    assert verdicts["h0"].bad_host and not verdicts["h1"].bad_host and verdicts["h0"].failures == 10 and verdicts[None].texts == 2
    assert verdicts["h1"].rate < verdicts[None].rate < 1 and verdicts["h0"].rate > 0.8
    assert {r.issue_key for r in with_shares(found).where("repeats").collect()} == {k for k in range(40) if k % 4 == 0} | {100}
    flagged = {r.issue_key for r in judged(found, "run_id").where("repeats").collect()}
    assert flagged == {k for k in range(40) if k % 4 == 0} | {100}
    assert judged(found, "run_id").count() == len(rows)
    assert judged(measured(docs.where("false")), "run_id").count() == 0


@pytest.mark.parametrize("text", ["\ud800 lone", "İstanbul " * 6, "ß" * 9])
def test_odd_letters(text):
    repeated_chars(text)
