import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.markup import Parse, clean_text, constructs, converted, structural, weighed


def found(text, literals=None):
    return sorted("/".join(k) for k in Parse(text, literals).found)


@pytest.mark.parametrize(
    "text, want",
    [
        ("<b>x</b> y", ["html/inline"]), ("<h1>x</h2>", ["html/heading"]), ("<ul><li>a</li></ul>", ["html/list"]), ("<pre><code>**a**\n[[b]]</code></pre>", ["html/code"]), ("a &amp; b &nbsp;", ["html/inline"]), ("&lt;i&gt;x&lt;/i&gt;", ["html/inline"]),
        ("<!-- x -->", ["html/inline"]), ("<div id=box7 some words</div>", ["html/inline"]), ("</span> x", ["html/inline"]), ("<code>x</code>", ["html/code"]), ("<FONT COLOR=red>x</FONT><BR>", ["html/inline"]),
        ("# Head", ["markdown/heading"]), ("Head\n====\ntext", ["markdown/heading"]), ("- a\n- b", ["markdown/list"]), ("- [ ] a", ["markdown/list"]), ("+ a", ["markdown/list"]), ("1. a\n2. b", ["markdown/list"]), ("**a** *b* ~~c~~ __d__", ["markdown/inline"]),
        ("[a](http://x) ![b](c.png) [d][ref1]", ["markdown/inline"]), ("```py\na = '$x$'\n```", ["markdown/code"]), ("~~~\n<b>\n~~~", ["markdown/code"]), ("a `<br>` b", ["markdown/code"]), ("> quoted", ["markdown/inline"]),
        ("== Head ==", ["wiki/heading"]), ("** a\n*# b", ["wiki/list"]), ("'''a''' ''b''", ["wiki/inline"]), ("[[A|b]] {{C|d}} [http://x e]", ["wiki/inline"]), ("[[File:a_b.jpg|thumb|c]] [[Category:X]]", ["wiki/inline"]),
        ("\\section{A}", ["latex/heading"]), ("\\subsection*{A}", ["latex/heading"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex/list"]), ("\\begin{verbatim}\n<b>\n\\end{verbatim}", ["latex/code"]), ("\\verb|if x > 3: $y$|", ["latex/code"]),
        ("\\begin{equation}\nx_1 = 2\n\\end{equation}", ["latex/formula"]), ("$x_1 + y^2$", ["latex/formula"]), ("$$E = m$$", ["latex/formula"]), ("\\[ x \\] \\( y \\)", ["latex/formula"]), ("\\textbf{a} \\emph{b}~\\cite{c_d}", ["latex/inline"]),
        ("__Signalkabel__ x", ["markdown/inline"]), ("__NOTOC__ x", ["wiki/inline"]), ("It costs $5 to more. Use `${x}` now.", ["markdown/code"]),
        ("**<i>x</i>**", ["html/inline", "markdown/inline"]),
    ],
)
def test_constructs(text, want):
    assert found(text) == want


@pytest.mark.parametrize(
    "text",
    ["It costs $5 to $7 per unit.", "Es kostet 5 $ bis 7 $ je Stück.", "Press <Enter> to go on.", "Write to <desk@plant.example> first.", "Keep 3 < x and y > 5.", "R&D asked for 2 * 3 * 4 parts.", "Use it twice* a day -- or more.", "The field run_list is filled in.",
     "Copy it to C:\\tank_level\\new.", "It holds 'a' ~ 'b' == true.", "Rows a | b | c are equal.", "The old label [sic] stays [1].", "Insert {name} as # 5 in C#.", "12. January is cold.", "", "plain"],
)
def test_what_only_looks_like_markup(text):
    assert found(text) == [] and clean_text(Parse(text).nodes) == text


def test_protected_literals_stay():
    assert found("a <br> b **c**", ["<br>"]) == ["markdown/inline"]
    assert clean_text(Parse("a <br> b **c**", ["<br>", "", None]).nodes) == "a <br> b c"
    assert found("x [[y]] z", ["[[y]]"]) == []


def test_clean_text_keeps_structure():
    text = "<h2>Head</h2>\n<p>One <b>two</b> &amp; [three](http://x).</p>\n* a\n* b\n```py\nx = 1\n```\nSum $x_1$ and `code`<!-- gone -->"
    clean = clean_text(Parse(text).nodes)
    for part in ("# Head", "One two & three.", "- a\n- b", "```\nx = 1\n```", "$x_1$", "`code`"):
        assert part in clean
    assert "gone" not in clean and "http" not in clean and "<" not in clean


def test_structure_keeps_its_words_and_empty_paths_lose_theirs(spark):
    """A list's short items and words within sentences stay, while a menu's words go."""
    menu = "<nav>" + "<a href='x'>Up</a>\n" * 40 + "</nav>"
    rows = [(k, "A long <b>and bold</b> sentence stands here, and it goes on, " + "and on, " * 40 + "<ol><li>a<li>b</ol><h2>c</h2>" + menu) for k in range(30)]
    items = spark.createDataFrame(rows, "item_key long, text string").selectExpr("'segment' as origin", "item_key", "text", "cast(null as array<string>) as literals")
    clean = converted(items).first().clean
    assert "- a\n- b" in clean and "# c" in clean and "A long and bold sentence" in clean and "Up" not in clean
    paths = {r.path: r for r in weighed(items).collect()}
    assert paths["html:ol/html:li"].content and structural("html:div/html:ol/html:li") and not structural("html:div/html:b")
    assert paths["html:ol/html:li"].nodes == 60 and paths["text"].content and not paths["html:nav"].content


def test_deep_nesting_counts_a_name_once():
    p = Parse("<div>" * 6_000 + "<p>x" * 50 + "</div>" * 6_000 + "y")
    assert ("text", "html:div/html:p", "x") in p.nodes and p.nodes[-1] == ("text", "text", "y")
    assert Parse("<div><ul><li><p>a</p></li></ul></div>").nodes[4][1] == "html:div/html:ul/html:li/html:p"


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab <>/*_`~#=[]{}|\\$&;'-+.!1\n()", max_size=70))
def test_never_fails(text):
    clean_text(Parse(text, [text[:3]]).nodes)


def test_long_texts():
    for text in ("**a ", "[a", "<b ", "'''", "`x", "$a ", "{{", "\\item ", "*a* "):
        Parse(text * 5_000)


@pytest.mark.parametrize(
    "left, right, want",
    [("$", "$", "latex/formula"), ("`", "`", "markdown/code"), ("\\verb|", "|", "latex/code"), ("**", "**", "markdown/inline"), ("__", "__", "markdown/inline"), ("~~", "~~", "markdown/inline"), ("''", "''", "wiki/inline"), ("'''", "'''", "wiki/inline"), ("'''''", "'''''", "wiki/inline")],
)
def test_long_constructs_are_found_and_cleaned(left, right, want):
    inside = "x_1 = y + " * 300 + "z" if left == "$" else "word " * 600 + "end"
    text = f"Start {left}{inside}{right} stop"
    clean = clean_text(Parse(text).nodes)
    assert found(text) == [want] and inside in clean
    assert clean == f"Start {'$' + inside + '$' if left == '$' else '`' + inside + '`' if want.endswith('code') else inside} stop"


def test_rows(spark):
    items = spark.createDataFrame(
        [("segment", 1, "<b>x</b> y", None, "z"), ("segment", 1, "<b>x</b> y", None, "w"), ("block", 1, "a <br> b", ["<br>"], "z"), ("block", 2, None, [None], "z"), (None, None, "", None, None), ("block", 3, "# H\n\n<b>q</b> `c`", None, None)],
        "origin string, item_key long, text string, literals array<string>, markup string",
    )
    rows = sorted((r.origin, r.item_key, r.markup, r.structure) for r in constructs(items).collect())
    assert rows == [("block", 3, "html", "inline"), ("block", 3, "markdown", "code"), ("block", 3, "markdown", "heading"), ("segment", 1, "html", "inline")]
    clean = {(r.origin, r.item_key): r.clean for r in converted(items).collect()}
    assert clean[("segment", 1)] == "x y" and clean[("block", 1)] == "a <br> b" and clean[("block", 2)] == "" and clean[(None, None)] == ""
    assert constructs(items.where("false")).count() == 0 and converted(items.where("false")).count() == 0
