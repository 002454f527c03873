from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.functions import backends
from folioflow.operators import model_input as mi
from folioflow.operators import odt
from folioflow.operators.rendering import Wrapped, allowed, crossing, render
from folioflow.plans.aligned import translate_aligned, translate_aligned_odt, translate_block, translate_markdown


def test_prepare_and_positions():
    source = "see **bold** `x` end"
    p = mi.prepare(source, mi.partition(len(source), [(13, 16)], [(4, 6), (10, 12)]))
    token = p.tokens[0]
    assert p.text == f"see bold {token} end"
    assert [p.position(k) for k in (0, 6, 10, 13, 17)] == [0, 4, 8, 9, 10 + len(token)]
    text, moves = mi.restore(p.text.upper().replace(token.upper(), token), p)
    assert text == "SEE BOLD `x` END" and mi.moved(len(p.text), moves) == len(text)
    assert mi.prepare("`x` ", [(0, 3, "protected"), (3, 4, "text")]).text is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=1, max_size=60), st.integers(5, 60), st.data())
def test_chunks_stand_for_their_source(source, limit, data):
    a = data.draw(st.integers(0, len(source)))
    b = data.draw(st.integers(a, len(source)))
    p = mi.prepare(source, mi.partition(len(source), [(a, b)] if a < b else [], []))
    found = mi.chunks(p, lambda s: len(s) <= limit)
    assert "".join(c.original for c in found) == source


def test_rendering():
    ids = lambda x: {i["id"]: i["reason"] for i in x}
    out, issues = render("one two three", [Wrapped("a", "**", "**", [(0, 7)]), Wrapped("b", "[", "](u)", [(4, 7)], True)])
    assert out == "**one [two](u)** three" and issues == []
    out, issues = render("one two three", [Wrapped("a", "**", "**", [(0, 7)]), Wrapped("b", "*", "*", [(4, 13)]), Wrapped("c", "<div>", "</div>", [(0, 3)])])
    assert out == "one two three" and ids(issues) == {"a": "conflicting_markdown_ranges", "b": "conflicting_markdown_ranges", "c": "unsupported_markdown_wrapper"}
    assert crossing([Wrapped("a", "*", "*", [(0, 3)]), Wrapped("b", "*", "*", [(3, 6)])]) == set()
    assert allowed("<a href='x'>", "</a>") and not allowed("<a>", "</b>") and not allowed("<script>", "</script>")


def test_markdown_keeps_its_formatting():
    up = backends.upper()
    assert translate_markdown("see **bold words** and [a link](http://x) `code` now.", up) == ("SEE **BOLD WORDS** AND [A LINK](http://x) `code` NOW.", [])
    assert translate_markdown("> - ## one *two* ##\n", up) == ("> - ## ONE *TWO* ##\n", [])
    assert translate_markdown("`only` <br>", up) == ("`only` <br>", [])
    swap = lambda texts: [(" ".join(reversed(t.split())), None) for t in texts]
    out, issues = translate_markdown("one **two** three", swap)
    assert out == "three **two** one" and issues == []
    lost = lambda texts: [("gone", None) for t in texts]
    assert translate_markdown("a `b` c", lost)[1][0]["action"] == "retained_original"
    fail = backends.failing("bad")()
    assert translate_markdown("a bad **word**", fail)[0] == "a bad word"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab *_`[]()~<>. \n", max_size=50))
def test_echo_never_harms_a_text(text):
    out, issues = translate_markdown(text, backends.echo())
    assert out == text or issues


def test_rows(spark):
    df = spark.createDataFrame([(1, "a **b** c"), (2, None), (3, "")], "id long, text string")
    assert {r.id: r.translated for r in translate_aligned(df, "id", backends.upper).collect()} == {1: "A **B** C", 2: None, 3: ""}


def odt_block(body: str) -> odt.Block:
    data = f'<o:document-content xmlns:o="{odt._NS}office:1.0" xmlns:t="{odt._NS}text:1.0" xmlns:d="{odt._NS}drawing:1.0" xmlns:x="x"><o:body><o:text><t:p>{body}</t:p></o:text></o:body></o:document-content>'
    return odt.blocks(data.encode())[0]


def test_odt_formatting_goes_where_its_words_go():
    up = backends.upper()
    swap = lambda texts: [(" ".join(reversed(t.split())), None) for t in texts]
    word = lambda s, t: [(i, t.split().index(w)) for i, w in enumerate(s.split()) if w in t.split()]
    body = 'see <t:span t:style-name="B">bold &amp; words</t:span> and <t:a x:href="u">a link</t:a> <t:tab/> now'
    assert translate_block(odt_block(body), up) == ('SEE <t:span t:style-name="B">BOLD &amp; WORDS</t:span> AND <t:a x:href="u">A LINK</t:a> <t:tab/> NOW', [])
    out, issues = translate_block(odt_block('one <t:span t:style-name="B">two</t:span> three four'), swap, aligner=word)
    assert out == 'four three <t:span t:style-name="B">two</t:span> one' and issues == []
    assert translate_block(odt_block('<t:soft-page-break/>a <t:span t:style-name="L">b</t:span>'), up, language=frozenset("L"))[0] == "<t:soft-page-break/>A B"
    out, issues = translate_block(odt_block('a <t:span t:style-name="B"/>b'), up)
    assert out == "A B" and [i["reason"] for i in issues] == ["no_visible_content"]


def test_odt_falls_back():
    up = backends.upper()
    own = 'a <t:span xml:id="i">b</t:span> c'
    assert translate_block(odt_block(own), up) == ('A <t:span xml:id="i">B</t:span> C', [])
    lost = lambda texts: [("gone", None) for t in texts]
    for body, model in (("a <t:tab/> b", lost), ("a bad word", backends.failing("bad")()), (own, lost), ("a b", lambda texts: [("\x01", None) for t in texts]), ("a b", lambda texts: [(" ", None) for t in texts])):
        out, issues = translate_block(odt_block(body), model)
        assert out is None and [i["action"] for i in issues] == ["retained_original"]


def test_odt_packages(spark):
    good = odt.make_package([("heading", "head & co"), ("paragraph", "two\nlines")])
    got = {r.id: r for r in translate_aligned_odt(spark.createDataFrame([(1, good), (2, b"none"), (3, None)], "id long, content binary"), "id", "content", backends.upper).collect()}
    assert [b.text for b in odt.blocks(odt.inspect(bytes(got[1].content))["content.xml"])] == ["HEAD & CO", "TWO<text:line-break/>LINES"]
    assert got[1].issues == [] and got[1].error is None and got[2].error and got[3].error and got[2].content is None


def test_language_styles():
    style = lambda name, more: f'<s:style s:name="{name}" s:family="text">{more}</s:style>'
    lang = '<s:text-properties f:language="de" f:country="DE"/>'
    body = style("A", lang) + style("B", '<s:text-properties f:language="de" f:weight="bold"/>') + style("C", lang) + style("C", "")
    assert odt.language_styles({"content.xml": f'<r xmlns:s="{odt._NS}style:1.0" xmlns:f="{odt._NS}xsl-fo-compatible:1.0">{body}</r>'.encode()}) == {"A"}


def test_refused_alignments_keep_the_translation():
    from folioflow.operators import alignment as al

    def refuses(source, target):
        raise al.AlignmentError("too long")

    out, issues = translate_markdown("one **two** three. Four", backends.upper(), limit=12, aligner=refuses)
    assert out == "ONE TWO THREE. FOUR" and [i["reason"] for i in issues if not i["id"]] == ["alignment_failed"] * 3


def test_counts_of_calls(spark):
    from folioflow.plans.aligned import unit_counts

    df = spark.createDataFrame([(1, "a **b** c. D `x`"), (2, None), (3, "`x`")], "id long, text string")
    assert {r.id: tuple(r)[1:] for r in unit_counts(df, "id", backends.upper).collect()} == {1: (2, 2, 0, 0), 2: (0, 0, 0, 0), 3: (0, 0, 0, 0)}
