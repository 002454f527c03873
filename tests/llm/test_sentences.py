import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.sentences import Model, Splitter, kind_of, learn, sentence_units

EN = Model({"dr": "title", "st": "title", "mr": "title", "fig": "plain", "p": "plain", "e.g": "plain", "etc": "ender", "max": "plain"}, {"the", "never", "it"}, {"january"})
SPLITTER = Splitter({"en": EN, "de": Model({"abb": "plain"}, {"die"}, {"januar"})}, {"en": {"the", "of"}, "de": {"der", "die"}})


def units(text, lang="en"):
    return [text[s:e] for s, e in SPLITTER.spans(text, lang)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The pump stops. It runs again!", ["The pump stops.", "It runs again!"]),
        ("Dr. Smith went to St. Ives. The end.", ["Dr. Smith went to St. Ives.", "The end."]),
        ("See fig. 3.5 on p. 12, e.g. here. The end", ["See fig. 3.5 on p. 12, e.g. here.", "The end"]),
        ("Cables, gaskets, etc. Never open it.", ["Cables, gaskets, etc.", "Never open it."]),
        ("Wait ... then go. The end…", ["Wait ... then go.", "The end…"]),
        ('He said: "Stop. Wait." The end.', ['He said: "Stop. Wait."', "The end."]),
        ("“Stop!” the man said. The end.", ["“Stop!” the man said.", "The end."]),
        ("It ran. (See fig. 4.) The end.", ["It ran.", "(See fig. 4.)", "The end."]),
        ("It ran (max. 38 V). The end.", ["It ran (max. 38 V).", "The end."]),
        ("It goes out.The end. See www.x.test/f.9 now.", ["It goes out.", "The end.", "See www.x.test/f.9 now."]),
        ("It ran. 12. January is cold. eQ-one ran.", ["It ran.", "12. January is cold.", "eQ-one ran."]),
        ("one\n\ntwo\nlines", ["one", "two\nlines"]),
        ("Too heavy?! The end", ["Too heavy?!", "The end"]),
        ("Model A. Smith ran.", ["Model A. Smith ran."]),
        ("“Open quote. The end.", ["“Open quote.", "The end."]),
        ("", []), (" \n ", []), (".", ["."]), ("...", ["..."]), ("x", ["x"]),
    ],
)
def test_english(text, want):
    assert units(text) == want


@pytest.mark.parametrize("a, b", [('"', '"'), ("“", "”"), ("„", "“"), ("«", "»"), ("‘", "’")])
def test_long_quotations_are_one(a, b):
    said = a + "It stops. " * 400 + "It runs." + b
    assert units(f"{said} The end.") == [said, "The end."]
    bracket = "(" + "It stops. " * 400 + "It runs.)"
    assert units(f"It ran. {bracket} The end.") == ["It ran.", bracket, "The end."]


@pytest.mark.parametrize("text", ["“ " * 100_000, "(a " * 100_000, "‘a’b " * 60_000, '"a ' * 100_000, "‘ " + "a’b " * 100_000, "„«“‚ " * 50_000])
def test_marks_without_partners_take_linear_time(text):
    import time

    began = time.perf_counter()
    units(text)
    assert time.perf_counter() - began < 20


def test_other_scripts():
    assert units("水泵停止。它显示“太热。等待。”的提示。再见！", "zh") == ["水泵停止。", "它显示“太热。等待。”的提示。", "再见！"]
    assert units("終わりました……次です。", "ja") == ["終わりました……", "次です。"]
    assert units("यह चलता है। क्या? हाँ!", "hi") == ["यह चलता है।", "क्या?", "हाँ!"]
    assert units("วาล์วหยุดทำงาน 82 ครั้ง ปั๊มเปิด", "th") == ["วาล์วหยุดทำงาน 82 ครั้ง", "ปั๊มเปิด"]
    assert units("هل تعمل؟ نعم. انتهى", "ar") == ["هل تعمل؟", "نعم.", "انتهى"]
    assert units("C'est tout ! Oui.", "fr") == ["C'est tout !", "Oui."]
    assert units("«Стоп!» — говорит он. Да.", "ru") == ["«Стоп!» — говорит он.", "Да."]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aB. !?\n\"'“”()[]«»„‚‘’1…。ก", max_size=60))
def test_units_cover_everything_once(text):
    spans = SPLITTER.spans(text, "en")
    at = 0
    for s, e in spans:
        assert at <= s < e and not text[at:s].strip() and text[s:e] == text[s:e].strip()
        at = e
    assert not text[at:].strip()


def test_very_long_texts_and_many_open_quotes():
    assert len(units("The pump stops. " * 50_000)) == 50_000
    assert units("(" * 20_000 + " end") and units("x" * 300_000) == ["x" * 300_000]


def test_types():
    assert kind_of("(Dr.") == ("dr", True)
    assert kind_of("3.5") == ("##", False) and kind_of("12.") == ("##", True) and kind_of("...") is None and kind_of("—") is None


@pytest.fixture(scope="module")
def corpus(spark):
    names = ["Smith", "Jones", "Lee", "Park", "Hill"]
    things = ["tank", "pump", "valve", "arm", "crew", "shaft", "gauge", "panel"]
    thing = lambda k: things[k * k % 8]
    rows = [("en", f"Yesterday Dr. {names[k % 5]} tested the {thing(k)} near part no. {k} of the {thing(k + 1)}. The {thing(k + 2)} stops the {thing(k + 3)}. It holds the {thing(k)}, oil, etc.") for k in range(300)]
    rows += [("de", f"Am {1 + k % 28}. Januar lief Pumpe {k} ohne {thing(k)}. Die {thing(k + 1)} steht vor {thing(k + 2)}. Das {thing(k + 3)} ist gut vor {thing(k)}.") for k in range(200)]
    return spark.createDataFrame([*rows, ("en", "It is part no. The tank ran. It is part no. It ran."), (None, "The tank ran."), ("en", None), ("en", "")], "lang string, text string")


def test_learns_without_labels(corpus):
    models, profiles = learn(corpus)
    assert models["en"].abbreviations["dr"] == "title" and models["en"].abbreviations["no"] == "plain"
    assert {"the", "it"} <= models["en"].starters and "januar" in models["de"].collocations
    s = Splitter(models, profiles)
    assert s.language("The tank of the pump") == "en" and s.language("Die Pumpe lief") == "de" and s.language("12345") == ""
    text = "Dr. Jones ran. Am"
    assert [text[a:b] for a, b in s.spans(text, "en")] == ["Dr. Jones ran.", "Am"]


def test_rows_nulls_repeats_and_extra_columns(spark, corpus):
    items = [("segment", 1, "en", "The tank ran. It stopped.", 5), ("segment", 1, "en", "The tank ran. It stopped.", 9), ("pair", 1, None, "One.", 1), ("pair", 2, "xx", None, 1), (None, None, None, "  ", 1), ("pair", 3, "en", "", 1)]
    df = spark.createDataFrame(items, "origin string, item_key long, lang string, text string, start_pos int")
    got = sorted((r.origin, r.item_key, r.start_pos, r.end_pos) for r in sentence_units(df, *learn(corpus)).collect())
    assert got == [("pair", 1, 0, 4), ("segment", 1, 0, 13), ("segment", 1, 14, 25)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    models, profiles = learn(empty)
    assert models == {} and profiles == {}
    items = spark.createDataFrame([("a", 1, "en", "One. Two.")], "origin string, item_key long, lang string, text string")
    assert sentence_units(items, models, profiles).count() == 2
    assert sentence_units(items.where("false"), models, profiles).count() == 0
