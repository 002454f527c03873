import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.operators import html_text as ht
from folioflow.operators import markdown as md
from folioflow.operators import odt
from folioflow.sources import files


def visible(part, spans):
    at, out = 0, []
    for s, e in [*spans, (len(part), len(part))]:
        out.append(part[at:s])
        at = e
    return "".join(out)


def test_html_segments_and_exclusions():
    source = "<p>One &amp; <b>two</b></p><script>if (a<b) {}</script><div>three<pre>code</pre><span translate='no'>name</span></div><p hidden>x</p><!-- c -->"
    assert [visible(p, s) for _, _, p, s in ht.segments(source)] == ["One  two", "three"]
    assert not ht.layout("<p>a</div>").safe and not ht.layout("a <b").safe and not ht.layout("<!-- open").safe
    assert ht.layout("a < b & c > d").safe
    assert ht.layout("<p><br><img src='x>y'></p>").stack == []


def test_html_changes_and_mending():
    before, lay = ht.layout("<b>x</b> y"), ht.layout
    assert ht.changes(before, lay("<b>q</b> z")) == []
    assert ht.changes(before, lay("<i>q</i> z")) == ["html_tags_attributes_or_protected_content_changed"]
    assert ht.changes(before, lay("<b></b> y")) == ["html_text_emptied: b[0]"]
    assert ht.without_empty_emphasis(before, lay("<b> </b>y z")) == ("x y", " y z")
    assert ht.without_empty_emphasis(lay("<a href='u'>x</a>"), lay("<a href='u'></a>")) is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>/p!-&;\"'\n", max_size=60))
def test_html_never_fails_and_keeps_offsets(source):
    x = ht.layout(source)
    assert all(0 <= s < e <= len(source) for s, e in x.editable)
    for s, e, part, spans in ht.segments(source):
        assert source[s:e] == part and all(a < b for a, b in spans)


SOURCE = """---
title: not prose
---
# Head *one*

Para `code` and **bold** [link](http://x) <b>html</b>
continued

- item one
  more
- item two

1. first

> quoted

| a | b |
|---|---|
| c \\| d | e |

```py
code
```

    indented code

Title
=====

[ref]: http://x
"""


def test_markdown_regions():
    found = md.regions(SOURCE)
    assert [k for _, _, k, _, _ in found] == ["heading", "paragraph", "bullet_item", "bullet_item", "numbered_item", "blockquote", "table_cell", "table_cell", "table_cell", "table_cell", "heading"]
    assert visible(found[1][3], found[1][4]) == "Para  and bold link htmlcontinued"
    assert all("code\n" not in t and "not prose" not in t for _, _, _, t, _ in found)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #*-_`[]()|>1.~<\n =\\", max_size=80))
def test_markdown_splices_back(source):
    found = md.regions(source)
    assert md.spliced(source, [(s, e, t) for s, e, _, t, _ in found]) == source
    assert all(source[s:e] == t for s, e, _, t, _ in found)


def test_markdown_structure():
    assert md.structure_errors("a **b** `c`", "`c` d **e**") == []
    assert md.structure_errors("a **b**", "a b") == ["markdown_token_count_changed"]
    assert md.structure_errors("a `b`", "a `c`") == ["markdown_token_changed"]
    assert md.escaped("a*b, c.") == "a\\*b, c\\."


def test_odt_round_trip_and_patch():
    package = odt.make_package([("heading", "Head"), ("list_item", "Item & more"), ("paragraph", "Two\nlines äöü")])
    found = odt.blocks(odt.inspect(package)["content.xml"])
    assert [(b.type, b.reason) for b in found] == [("heading", None), ("list_item", None), ("paragraph", None)]
    assert found[1].text == "Item & more" and found[2].text == "Two<text:line-break/>lines äöü"
    out = odt.written(package, {"1": "Kopf <x>", "3": "Zwei<text:line-break/>Zeilen"})
    again = odt.blocks(odt.inspect(out)["content.xml"])
    assert [b.text for b in again] == ["Kopf <x>", "Item & more", "Zwei<text:line-break/>Zeilen"]
    with pytest.raises(odt.OdtError):
        odt.written(package, {"3": "the break is gone"})
    with pytest.raises(odt.OdtError):
        odt.written(package, {"1": "bad \x01"})


CONTENT = """<?xml version="1.0"?><o:document-content xmlns:o="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:t="urn:oasis:names:tc:opendocument:xmlns:text:1.0"
 xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:draw="urn:oasis:names:tc:opendocument:xmlns:drawing:1.0"><o:body><o:text>
<t:p>é <t:span t:style-name="S">bold</t:span> end</t:p><t:p> </t:p><t:p>a<t:note>n</t:note></t:p><t:p><t:page-number>3</t:page-number> / </t:p>
<table:table><table:table-row><table:table-cell o:value-type="float" o:value="1"><t:p>1</t:p></table:table-cell></table:table-row></table:table><t:section><t:p>in section</t:p></t:section>
<t:p>Outer <draw:frame><draw:text-box><t:p>Inner</t:p></draw:text-box></draw:frame> text</t:p></o:text></o:body></o:document-content>"""


def test_odt_reasons_and_nested_frames():
    data = CONTENT.encode()
    found = odt.blocks(data)
    assert [b.reason for b in found] == [None, "empty", "inline_content", "protected_only", "unsupported_cell_value", "unsupported_container", None, None]
    assert [found[0].text[s:e] for s, e in found[0].spans] == ['<t:span t:style-name="S">', "</t:span>"]
    assert data[found[0].start : found[0].end].decode() == 'é <t:span t:style-name="S">bold</t:span> end'
    outer, inner = found[6], found[7]
    new = odt.patched(data, found, {outer.id: odt.rendered(outer, outer.text.replace("Outer", "Außen")), inner.id: b"Innen"})
    assert "Außen <draw:frame><draw:text-box><t:p>Innen</t:p></draw:text-box></draw:frame> text" in new.decode()


def repack(package, change):
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(package)) as a, zipfile.ZipFile(out, "w") as b:
        change({e.filename: a.read(e) for e in a.infolist()}, b)
    return out.getvalue()


def test_odt_bad_packages():
    good = odt.make_package([("paragraph", "x")])
    stored = lambda z, m: z.writestr(zipfile.ZipInfo("mimetype"), m.get("mimetype", b""), zipfile.ZIP_STORED)
    bad = {
        "no zip": b"nothing", "empty": b"",
        "mimetype late": repack(good, lambda m, z: [z.writestr(k, v) for k, v in sorted(m.items())]),
        "missing": repack(good, lambda m, z: stored(z, m)),
        "other type": repack(good, lambda m, z: [stored(z, {"mimetype": b"text/plain"}), *(z.writestr(k, v) for k, v in m.items() if k != "mimetype")]),
        "path": repack(good, lambda m, z: [stored(z, m), *(z.writestr(k, v) for k, v in m.items() if k != "mimetype"), z.writestr("../x", b"")]),
        "doctype": repack(good, lambda m, z: [stored(z, m), z.writestr("content.xml", b"<!DOCTYPE x>" + m["content.xml"]), z.writestr("META-INF/manifest.xml", m["META-INF/manifest.xml"])]),
    }
    for name, data in bad.items():
        with pytest.raises(odt.OdtError):
            odt.inspect(data)
            raise AssertionError(name)


def test_odt_blocks_as_rows(spark):
    df = spark.createDataFrame([(1, bytearray(odt.make_package([("paragraph", "x")]))), (2, bytearray(b"junk")), (3, None)], "id long, content binary")
    rows = {r.id: r for r in odt.odt_blocks(df, "id", "content").collect()}
    assert rows[1].text == "x" and rows[1].error is None and rows[2].error and rows[3].error


def test_styles():
    xml = f"""<s:styles xmlns:s="{odt._NS}style:1.0"><s:style s:name="A" s:parent-style-name="Preformatted_20_Text"/><s:style s:name="B" s:parent-style-name="A"/><s:style s:name="C"/></s:styles>"""
    assert {"A", "B"} <= odt.protected_styles(xml.encode()) and "C" not in odt.protected_styles(xml.encode())


def test_files_of_all_formats_and_publishing(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_bytes("Eins\n\nZwei".encode())
    (src / "b.md").write_text("# Head\n\ntext `x`\n")
    (src / "c.html").write_text("<p>Hello</p><p>you</p>")
    (src / "d.odt").write_bytes(odt.make_package([("heading", "H"), ("paragraph", "p")]))
    (src / "e.bin").write_bytes(b"\0")
    found = files.documents(spark, str(src))
    got = {}
    for r in files.segments(found).orderBy("path", "seg_no").collect():
        got.setdefault(r.path[-5:], []).append((r.type, r.text))
    assert got["a.txt"] == [("paragraph", "Eins\n"), ("paragraph", "Zwei")] and got["d.odt"] == [("heading", "H"), ("paragraph", "p")] and got[".html"] == [("html_text", "Hello"), ("html_text", "you")] and got["/b.md"] == [("heading", "# Head\n"), ("paragraph", "text `x`\n")]
    out = str(tmp_path / "out")
    files.publish(found.where("document_format is not null"), out)
    assert (tmp_path / "out" / "a.txt").read_bytes() == (src / "a.txt").read_bytes()
    with pytest.raises(FileExistsError):
        files.publish(found, out)


def test_suites_and_cases(spark, tmp_path):
    examples = [{"id": "a", "category": "x", "source": "s", "reference": "r", "criteria": ["c"]}, {"id": "a", "source": "s", "reference": "", "criteria": [], "format": "pdf"}]
    (tmp_path / "s.json").write_text(json.dumps({"schema_version": 1, "suite_version": 2, "source_lang": "en", "target_lang": "de", "examples": examples}))
    suite = files.suite(spark, str(tmp_path / "s.json"))
    assert [r.format for r in suite.collect()] == ["txt", "pdf"]
    assert sorted((r.id, r.error) for r in files.suite_errors(suite).collect()) == [("a", "criteria"), ("a", "duplicate_id"), ("a", "format"), ("a", "reference")]
    (tmp_path / "c.json").write_text(json.dumps([{"id": "k", "source": "a b", "target": "x y", "scopes": [{"id": "1", "source": [0, 1], "link_target": None}]}]))
    assert files.alignment_cases(spark, str(tmp_path / "c.json")).first().scopes[0].source == [0, 1]


def test_stream(spark, tmp_path):
    from folioflow.streaming.documents import translate_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one\n\ntwo\n")
    run = lambda: translate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), "upper").awaitTermination()
    run()
    (tmp_path / "in" / "b.md").write_text("three `x`\n")
    run()
    got = sorted(r.translated for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["ONE\n", "THREE `x`\n", "TWO\n"]
