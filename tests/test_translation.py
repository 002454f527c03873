import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import backends
from folioflow.operators import glossary as gl
from folioflow.operators import markers as mk
from folioflow.plans.translate import translate_segments

SPANS = "array<struct<start_pos:int,end_pos:int>>"


def test_prefix_is_fixed_and_avoids_the_text(spark):
    first = "DLMD8B763120364A81332B2765008969E9A"
    df = spark.createDataFrame([("plain",), (f"has {first.lower()}X0Z",)], "t string")
    a, b = [r[0] for r in df.select(mk.marker_prefix(F.col("t"))).collect()]
    assert a == first and b != first and b.startswith("DLM") and len(b) == 35


def segments(spark, rows):
    return spark.createDataFrame(rows, f"id long, text string, protected_spans {SPANS}")


ROWS = [(1, "see <b>this</b> now", [(4, 7), (11, 15)]), (2, "plain text", None), (3, "<x/>", [(0, 4)]), (4, None, None), (5, "a`b`c d", [(1, 4)]), (6, "12 34", []), (7, "ends in code `x`", [(13, 16)])]


def test_upper_keeps_protected_content(spark):
    done = {r.id: r for r in translate_segments(segments(spark, ROWS), ["id"], backends.upper).collect()}
    assert {k: done[k].translated for k in done} == {1: "SEE <b>THIS</b> NOW", 2: "PLAIN TEXT", 3: "<x/>", 4: None, 5: "A`b`C D", 6: "12 34", 7: "ENDS IN CODE `x`"}
    assert all(r.action is None for r in done.values())


def test_echo_gives_every_text_back(spark):
    assert all(r.text == r.translated for r in translate_segments(segments(spark, ROWS), ["id"], backends.echo).collect())


def test_lost_markers_keep_the_original(spark):
    rows = [(1, "drop the end <b>", [(13, 16)]), (2, "bad word <i> here", [(9, 12)])]
    done = {r.id: r for r in translate_segments(segments(spark, rows), ["id"], backends.failing("bad")).collect()}
    assert done[1].translated == rows[0][1] and done[1].action == "retained_original" and done[1].errors[0].startswith("missing_marker")
    assert done[2].translated == rows[1][1] and done[2].errors == ["the backend cannot translate bad"]
    with pytest.raises(Exception, match="translation failed"):
        translate_segments(segments(spark, rows), ["id"], backends.failing("none"), mode="failfast").collect()


def test_changed_structures_keep_the_original(spark):
    rows = [(1, "html", "paragraph", "see <b>this</b> now", [(4, 7), (11, 15)]), (2, "html", "paragraph", "see <a>this</a> now", [(4, 7), (11, 15)]), (3, "md", "paragraph", "one **two** end", []),
            (4, "md", "table_cell", "one two", []), (5, "txt", "paragraph", "big *dog* end", []), (6, "html", "paragraph", "see that now", [])]
    df = spark.createDataFrame(rows, f"id long, form string, type string, text string, protected_spans {SPANS}")

    def model():
        return lambda texts: [(t.replace("this", "").replace("**", "").replace("*", "").replace("one two", "ONE | TWO").replace("that", "THAT"), None) for t in texts]

    done = {r.id: r for r in translate_segments(df, ["id", "form", "type"], model, form="form").collect()}
    assert {k: done[k].translated for k in done} == {1: "see  now", 2: rows[1][3], 3: rows[2][3], 4: rows[3][3], 5: "big dog end", 6: "see THAT now"}
    assert {k: done[k].action for k in done} == {1: "formatting_repaired", 2: "retained_original", 3: "retained_original", 4: "retained_original", 5: None, 6: None}
    assert done[1].unrepaired_text == "see <b></b> now" and done[2].unrepaired_text is None
    assert done[3].errors == ["markdown_token_count_changed"] and done[4].errors == ["markdown_table_cell_boundary_changed"]
    with pytest.raises(Exception, match="translation failed"):
        translate_segments(df.where("id = 2"), ["id", "form", "type"], model, mode="failfast", form="form").collect()


def test_marker_errors(spark):
    p = "DLM" + "A" * 32
    rows = [(f"a {p}X0Z b {p}X1Z", []), (f"a {p}X1Z b {p}X0Z", ["marker_order_changed"]), (f"a {p}X0Z", [f"missing_marker: {p}X1Z"]), (f"a {p}X0Z {p}X0Z {p}X1Z", [f"duplicate_marker: {p}X0Z"]),
            (f"a {p}X0Z {p}X1Z {p}X7Z", [f"unexpected_marker: {p}X7Z"]), (f"{p}X0Z {p}X1Z", ["empty_translated_text"]), (f"a {p}X0Z {p}X1Z {p.lower()}", ["damaged_marker"])]
    df = spark.createDataFrame(rows, "t string, want array<string>")
    tokens = F.array(F.lit(f"{p}X0Z"), F.lit(f"{p}X1Z"))
    for r in df.select("want", mk.marker_errors(F.col("t"), F.lit(p), tokens).alias("got")).collect():
        assert r.got == r.want


def test_index_is_leftmost_longest_and_whole_words():
    index = gl.TermIndex(["valve", "relief valve", "İstanbul", "straße", "a b"])
    text = "Relief valve, valves; VALVE istanbul STRASSE xvalve valve_ a b"
    assert [text[s:e] for s, e, _ in index.find(text)] == ["Relief valve", "VALVE", "istanbul", "a b"]
    assert gl.TermIndex(["straße"]).find("STRAẞE")[0][:2] == (0, 6)


def brute(text, terms):
    out, at = [], 0
    while at < len(text):
        best = 0
        if at == 0 or not gl.word_character(text[at - 1]):
            for t in terms:
                e = at + len(t)
                if text[at:e].lower() == t and (e >= len(text) or not gl.word_character(text[e])) and len(t) > best:
                    best = len(t)
        if best:
            out.append((at, at + best))
            at += best
        else:
            at += 1
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB _.", max_size=40), st.lists(st.text(alphabet="ab ", min_size=1, max_size=4).filter(lambda t: t.strip() == t), min_size=1, max_size=6, unique=True))
def test_index_against_brute_force(text, terms):
    assert [(s, e) for s, e, _ in gl.TermIndex(terms).find(text)] == brute(text, terms)


def test_terms_around_a_translation():
    mask = gl.TermMask([("valve", "translate", "Ventil"), ("pump", "keep", None), ("crew", "annotate", "Mannschaft")])

    def run(text, model):
        m = mask.masked(text)
        return (m.text, None) if m.send is None else mask.filled(m, model(m.send))

    up = str.upper
    assert run("open the valve. Valve and pump, crew", up) == ("OPEN THE Ventil. Ventil AND pump, Mannschaft (crew)", None)
    assert run(" valve ", lambda t: 1 / 0) == (" Ventil ", None)
    assert run("the valve", lambda t: "gone") == ("the valve", "Glossary protection failed; original segment retained")
    assert run("the valve", lambda t: t + " " + mask.prefix("")[:35])[1].startswith("Unexpected glossary marker")
    assert run("nothing here", up) == ("NOTHING HERE", None)
    with pytest.raises(ValueError, match="fold alike"):
        gl.TermIndex(["Straße", "STRAẞE"])
    assert gl.TermIndex(["straße", "strasse"]).find("Strasse Straße") == [(0, 7, 1), (8, 14, 0)]


def test_failing_backends_keep_the_source_with_its_terms(spark):
    """Not a mixture of source words and renderings; the whole segment stays if one unit of it fails."""
    entries = spark.createDataFrame([("valve", "translate", "Ventil", "en", "de")], "source string, mode string, target string, source_lang string, target_lang string")
    rows = [(1, "The valve leaks bad fuel.", None), (2, "The valve leaks. It has bad fuel. The valve.", None), (3, "The valve leaks.", None)]
    done = {r.id: r for r in translate_segments(segments(spark, rows), ["id"], backends.failing("bad"), entries, limit=20).collect()}
    assert {k: done[k].translated for k in done} == {1: rows[0][1], 2: rows[1][1], 3: "THE Ventil LEAKS."}
    assert {k: done[k].action for k in done} == {1: "retained_original", 2: "retained_original", 3: None}
    assert gl.for_languages(entries, "en", "de") is entries
    with pytest.raises(ValueError, match="target_lang"):
        gl.for_languages(entries, "en", "fr")


def test_budgets_and_listeners(spark):
    from folioflow.functions import progress

    count = lambda text: len(text.split())
    assert [backends.budget(count, 8, share)("a b c d e f") for share in (1.0, 0.75)] == [True, False]
    rows = [(1, "one two. three four five", None), (2, "six", None)]
    fits = lambda: backends.budget(lambda text: len(text.split()), 4)
    done = translate_segments(segments(spark, rows), ["id"], backends.upper, fits=fits)
    watched, seen = progress.observed(done, issues=F.count("action"))
    assert {r.id: r.translated for r in watched.collect()} == {1: "ONE TWO. THREE FOUR FIVE", 2: "SIX"}
    assert seen.get == {"rows": 2, "issues": 0}
    heard = spark.sparkContext.accumulator(0)
    progress.notify(done, lambda: lambda row: heard.add(row.id))
    assert heard.value == 3


def test_the_model_is_called_once_for_many_texts():
    calls = []

    def model(texts):
        calls.append(len(texts))
        return [(t.upper(), None) for t in texts]

    from folioflow.plans.translate import translation

    assert [o for o, _ in backends.answered([translation(t, None, lambda s: len(s) <= 8) for t in ("one two. three", "four", " ")], model)] == ["ONE TWO. THREE", "FOUR", " "]
    assert calls == [3]
    with pytest.raises(RuntimeError, match="reply"):
        backends.answered([translation("x", None, None)], lambda texts: [])


def test_glossaries_in_parts(spark, monkeypatch):
    import random

    rng = random.Random(6)
    word = lambda: rng.choice(["ab", "cd", "Ef", "gh", "ij"])
    terms = sorted({" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(60)})
    entries = spark.createDataFrame([(t, "keep", None) for t in terms], gl.SCHEMA)
    texts = spark.createDataFrame([(k, " ".join(word() + rng.choice(["", ",", "x"]) for _ in range(rng.randint(0, 12)))) for k in range(80)] + [(99, None)], "id long, text string")
    whole = sorted(tuple(r) for r in gl.matches(texts, ["id"], "text", entries).collect())
    monkeypatch.setattr(gl, "MOST_TERMS", 30)
    assert whole and sorted(tuple(r) for r in gl.matches(texts, ["id"], "text", entries).collect()) == whole


def test_glossary_files_and_errors(spark, tmp_path):
    import gzip
    import json

    data = json.dumps({"schema_version": 1, "source_lang": "en", "target_lang": "de", "entries": [{"source": "valve", "mode": "translate", "target": "Ventil"}, {"source": "pump", "mode": "keep"}]})
    (tmp_path / "g.json").write_text(data)
    with gzip.open(tmp_path / "g.json.gz", "wt") as f:
        f.write(data)
    for name in ("g.json", "g.json.gz"):
        got = gl.read_glossary(spark, str(tmp_path / name))
        assert sorted((r.source, r.mode, r.target, r.target_lang) for r in got.collect()) == [("pump", "keep", None, "de"), ("valve", "translate", "Ventil", "de")]
        assert gl.glossary_errors(got).count() == 0
    (tmp_path / "bad.json").write_text(data.replace(": 1", ": 2"))
    with pytest.raises(Exception, match="schema_version"):
        gl.read_glossary(spark, str(tmp_path / "bad.json")).collect()
