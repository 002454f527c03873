"""Markup residue in text: HTML, Markdown, wiki and LaTeX constructs, and the clean text without them.

A text is parsed into leaf nodes. Every node has a root-to-leaf path of the constructs around it, such as ``html:div/html:b``; a
name counts once in a path, however often it nests. Length and punctuation of the nodes, smoothed over their neighbours in the
running text, are summed by path over the corpus, smoothed towards the parent path, and fused to one ratio; inline paths below
the threshold, such as those of menus, hold no content and leave nothing in the clean text, while the others leave their words. Headings, lists, code and formulas are structure and always stay with all
their words, in one plain notation. A path says what a construct is and leaves; the ratio cannot, so the constructs found are
those of the parsed nodes.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.arrow import cut_lineage, map_batches

SMOOTH = 8.0  # nodes of the parent that a path is smoothed with
LEAST = 0.05  # of the mean fused ratio: paths below hold no content

#: Names of HTML elements, by what they leave. Fixed values.
HTML_HEADING = set("h1 h2 h3 h4 h5 h6".split())
HTML_LIST = set("ul ol li dl dt dd menu dir".split())
HTML_CODE = set("pre code kbd samp tt xmp listing".split())
HTML_FORMULA = {"math"}
HTML_INLINE = set(
    """a abbr acronym address applet area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas caption center cite col
    colgroup data datalist del details dfn dialog div em embed fieldset figcaption figure font footer form frame frameset head header hgroup hr html i iframe
    img input ins label legend link main map mark marquee meta meter nav nobr noframes noscript object optgroup option output p param picture progress q rp rt
    ruby s script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr track u
    var video wbr""".split()
)
WIKI_TAGS = set("nowiki ref references gallery noinclude includeonly onlyinclude syntaxhighlight poem".split())
HTML_NAMES = HTML_HEADING | HTML_LIST | HTML_CODE | HTML_FORMULA | HTML_INLINE | WIKI_TAGS
BLOCKS = HTML_HEADING | HTML_LIST | set("div p td th tr table section article aside nav header footer main form blockquote body".split())
#: Environments and commands of LaTeX, by what they leave. Fixed values.
TEX_FORMULA = set("equation align math displaymath eqnarray gather multline alignat flalign split cases array matrix pmatrix".split())
TEX_CODE = set("verbatim lstlisting minted alltt Verbatim".split())
TEX_LIST = set("itemize enumerate description".split())
TEX_HEADING = set("part chapter section subsection subsubsection paragraph subparagraph title".split())
TEX_DROPPED = set("cite citep citet ref eqref label pageref index bibliography bibliographystyle usepackage documentclass input include vspace hspace includegraphics".split())
TEX_BARE = set("item maketitle tableofcontents centering noindent newpage clearpage par hline bfseries itshape ldots dots LaTeX TeX footnotesize small large newline linebreak bigskip medskip smallskip".split())

_ENV = "|".join(sorted(TEX_FORMULA))
_CODE = "|".join(sorted(TEX_CODE))
CONSTRUCT = re.compile(
    rf"""
    (?:^(?:
     (?P<fence>[ ]{{0,3}}(?P<f>```+|~~~+)[^\n`]*(?:\n(?P<fenced>.*?))?(?:^[ ]{{0,3}}(?P=f)[`~]*[ \t]*$|\Z))
     |(?P<wikihead>[ \t]*(?P<w>={{2,6}})[ \t]*(?P<wheaded>[^=\n][^\n]*?)[ \t]*={{1,6}}[ \t]*$|[ \t]*=[ \t]+(?P<wheaded1>[^=\n]+?)[ \t]+=[ \t]*$)
     |(?P<setext>[ ]{{0,3}}(?P<sheaded>\S[^\n]*)\n[ ]{{0,3}}(?:={{3,}}|-{{3,}})[ \t]*$)
     |(?P<atx>[ ]{{0,3}}\#{{1,6}}[ \t]+(?P<aheaded>[^\n]*?)[ \t]*\#*[ \t]*$)
     |(?P<wikilist>[ \t]*(?:[*\#:;]{{2,}})[ \t]+(?=\S))
     |(?P<table>[ \t]*(?:\{{\|[^\n]*|\|\}}[ \t]*$|\|-[^\n]*$))
     |(?P<mdtable>[ \t]*\|?[ \t]*:?-{{3,}}:?[ \t]*(?:\|[ \t]*:?-{{3,}}:?[ \t]*)+\|?[ \t]*$)
     |(?P<rule>[ ]{{0,3}}(?:(?:-[ ]?){{3,}}|(?:\*[ ]?){{3,}}|(?:_[ ]?){{3,}})[ \t]*$)
     |(?P<mdlist>[ \t]*[-+*][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S))
     |(?P<mdnum>[ \t]*\d{{1,9}}[.)][ \t]+(?=\S))
     |(?P<quote>[ ]{{0,3}}(?:>[ ]?)+(?=\S))
     |(?P<refdef>[ ]{{0,3}}\[[^\[\]\n]+\]:[ \t]+\S+[^\n]*$)
    )
    |(?=[<\\$`&\[{{'*_~!])(?:
     (?P<comment><!--(?P<commented>.*?)(?:-->|\Z))
     |(?P<pre><(?P<pn>pre|xmp|listing|script|style|math|syntaxhighlight)\b[^<>]*>(?P<pred>.*?)(?:</(?P=pn)\s*>|\Z))
     |(?P<icode><(?P<cn>code|tt|kbd|samp|nowiki)\b[^<>]*>(?P<coded>.*?)(?:</(?P=cn)\s*>|\n|\Z))
     |(?P<verbatim>\\begin\{{(?P<vn>(?:{_CODE})\*?)\}}(?P<verbed>.*?)(?:\\end\{{(?P=vn)\}}|\Z))
     |(?P<verb>\\(?:verb|lstinline)\*?(?P<v>[^\w\s*])(?P<verbs>[^\n]*?)(?:(?P=v)|$))
     |(?P<equation>\\begin\{{(?P<en>(?:{_ENV})\*?)\}}(?P<equated>.*?)(?:\\end\{{(?P=en)\}}|\Z))
     |(?P<display>\\\[(?P<displayed>.*?)(?:\\\]|\Z)|\\\((?P<displayed2>.*?)(?:\\\)|\Z))
     |(?P<dollars>\$\$(?P<dollared>[^$]+?)(?:\$\$|\Z))
     |(?P<dollar>(?<![\w$\\])\$(?![\s$])(?P<dollared1>[^$\n]*?)(?<![\s\\])\$(?![\w$]))
     |(?P<tick>(?<!`)(?P<t>`+)(?!`)(?P<ticked>[^\n]*?[^`\n])(?P=t)(?!`))
     |(?P<texhead>\\(?P<hn>{"|".join(sorted(TEX_HEADING))})\*?\s?(?:\[[^\[\]\n]*\])?\{{(?P<headed>[^{{}}\n]*)(?:\}}|$))
     |(?P<texlist>\\(?:begin|end)\{{(?:itemize|enumerate|description)\}}(?:\[[^\]\n]*\])?|\\item\b[ ]?(?:\[[^\]\n]*\])?)
     |(?P<texenv>\\(?:begin|end)\{{[A-Za-z]+\*?\}}(?:\[[^\]\n]*\]|\{{[^{{}}\n]*\}})*)
     |(?P<texcmd>(?<![\w:\\])~?\\(?P<xn>[A-Za-z]+)\*?(?:\[[^\[\]\n]*\])?\{{(?P<xarg>[^{{}}\n]*)(?:\}}|$))
     |(?P<texbare>(?<![\w:\\])\\(?:{"|".join(sorted(TEX_BARE))})(?![A-Za-z_{{\\])(?:\{{\}})?)
     |(?P<tag></?(?P<tn>[A-Za-z][A-Za-z0-9]*)(?=[\s/>]|<|$)(?P<attr>(?:[^<>"'\n]|"[^"\n]*"|'[^'\n]*')*)(?P<tagend>>|(?=<)|(?=\n)|\Z))
     |(?P<autolink><(?:https?|ftp|mailto):[^\s<>]+>)
     |(?P<entity>&(?:\#\d{{1,7}}|\#[xX][0-9a-fA-F]{{1,6}}|[A-Za-z][A-Za-z0-9]{{1,30}});)
     |(?P<wikilink>\[\[(?P<wl>[^\[\]\n]*)(?:\]\]|$))
     |(?P<template>\{{\{{(?P<wt>[^{{}}\n]*)(?:\}}\}}|$))
     |(?P<extlink>\[(?:https?|ftp)://[^\s\]]+(?:[ \t]+(?P<el>[^\[\]\n]*))?\])
     |(?P<image>!\[(?P<im>[^\[\]\n]*)\](?:\([^()\n]*\)?|\[[^\[\]\n]*\]))
     |(?P<link>\[(?P<li>[^\[\]\n]*)\](?:\((?:[^()\n]|\([^()\n]*\))*(?:\)|$)|\[[^\[\]\n]*\]))
     |(?P<foot>\[\^[^\[\]\s]+\])
     |(?P<quotes>'{{3}}''(?P<q5>[^\n]+?)'{{2,5}}|'''(?P<q3>[^\n]+?)'{{2,3}}(?!')|(?<!')''(?!')(?P<q2>[^\n]+?)''(?!'))
     |(?P<magic>__(?-i:[A-Z]{{3,}})__)
     |(?P<strong>\*\*(?=[^\s*])(?P<b1>[^\n]*?[^\s])\*\*|(?<!\w)__(?=[^\s_])(?P<b2>[^\n]*?[^\s])__(?!\w))
     |(?P<strike>~~(?=[^\s~])(?P<s1>[^\n]*?[^\s])~~)
     |(?P<em>(?<![\w*\\])\*(?=[^\s*])(?P<e1>[^*\n]*?[^\s*])\*(?![\w*])|(?<!\w)_(?=[^\s_])(?P<e2>[^_\n]*?[^\s_])_(?!\w))
     |(?P<open>(?<![\w*])\*\*(?=[^\W_])|(?<=[^\W_])\*\*(?!\w)|(?<!~)~~(?=[^\W_])|(?<=[^\W_])~~(?!~))
    ))
    """,
    re.X | re.M | re.S | re.I,
)
PROSE = re.compile(r"`|(?<!\\)\b[^\W\d_]{2,}[.,;:!?]?\s+[^\W\d_]{3,}")
MATHS = re.compile(r"[\\^_=+<>{}/|]|^\s*[A-Za-z]\s*$|\d\s*[A-Za-z]")
PUNCTUATION = re.compile(r"[.,;:!?…。！？،؛]")
SPECIAL = re.compile(r"[<&\\$`=#*\[{'_~|>]|^\s*[-+]\s|^\s*\d+[.)]\s|-{3}", re.M)
SHIELD = "\ue000"


class Parse:
    """One pass over a text: the constructs ``(markup, structure)``, and the leaf nodes ``(kind, path, text)``.

    Kinds are ``text``, ``heading``, ``list``, ``code``, ``block`` (of code), ``formula`` and ``inline``.
    """

    def __init__(self, text: str, literals: list[str] | None = None):
        self.notes: list[tuple[str, str]] = []
        self.nodes: list[tuple[str, str, str]] = []
        self.stack: list[str] = []
        self.names: dict[str, int] = {}  # those of the stack, from the root, with how often they are open
        self.kept: list[str] = []
        for literal in sorted({x for x in literals or () if x}, key=len, reverse=True):
            if literal in text:  # protected literals become opaque letters, and come back in the nodes
                text = text.replace(literal, f"{SHIELD}{len(self.kept)}{SHIELD}")
                self.kept.append(literal)
        self.numbered = False
        if SPECIAL.search(text):
            self._scan(text, ())
        elif text:
            self._leaf("text", (), text)

    def _back(self, text: str) -> str:
        if SHIELD in text:
            for k in range(len(self.kept) - 1, -1, -1):
                text = text.replace(f"{SHIELD}{k}{SHIELD}", self.kept[k])
        return text

    def _leaf(self, kind: str, around: tuple, text: str) -> None:
        self.nodes.append((kind, "/".join({**self.names, **dict.fromkeys(around)}) or "text", self._back(text)))

    def _note(self, markup: str, structure: str) -> None:
        self.notes.append((markup, structure))

    @property
    def found(self) -> set[tuple[str, str]]:
        return set(self.notes)

    def _scan(self, text: str, around: tuple) -> None:
        at = look = 0
        while m := CONSTRUCT.search(text, look):
            group = next(k for k in GROUPS if m[k] is not None) if m.lastgroup not in GROUPS else m.lastgroup
            before, noted = len(self.nodes), len(self.notes)
            plain = text[at : m.start()]
            if plain:
                self._leaf("text", around, plain)
            if self._one(group, m, around):
                at = look = max(m.end(), m.start() + 1)
            else:
                del self.nodes[before:], self.notes[noted:]
                look = m.start() + 1
        if text[at:]:
            self._leaf("text", around, text[at:])

    def _inner(self, text: str | None, markup: str, name: str, around: tuple, kind: str = "") -> None:
        if text:
            if kind:
                self._leaf(kind, (*around, f"{markup}:{name}"), "")
            self._scan(text, (*around, f"{markup}:{name}"))
            if kind:
                self._leaf("end", around, "")

    def _one(self, group: str, m: re.Match, around: tuple) -> bool:
        """Takes a construct in; False if it only looks like one."""
        g = m.group
        if group == "fence":
            self._note("markdown", "code")
            self._leaf("block", (*around, "markdown:fence"), g("fenced") or "")
        elif group == "comment":
            self._note("html", "inline")
            self._leaf("drop", (*around, "html:!--"), g("commented") or "")
        elif group == "pre":
            name = g("pn").lower()
            if name == "math":
                self._note("html", "formula")
                self._leaf("formula", (*around, "html:math"), g("pred"))
            elif name in ("script", "style"):
                self._note("html", "inline")
                self._leaf("drop", (*around, f"html:{name}"), g("pred"))
            else:
                self._note("wiki" if name in WIKI_TAGS else "html", "code")
                inside = re.sub(r"</?(?:code|span)\b[^<>]*>", "", g("pred"))
                self._leaf("block", (*around, f"html:{name}"), html.unescape(inside))
        elif group == "icode":
            name = g("cn").lower()
            self._note(*(("wiki", "inline") if name == "nowiki" else ("html", "code")))
            self._leaf("text" if name == "nowiki" else "block" if "\n" in g("coded") else "code", (*around, f"html:{name}"), html.unescape(g("coded")))
        elif group in ("verbatim", "verb"):
            self._note("latex", "code")
            self._leaf("block" if group == "verbatim" else "code", (*around, f"latex:{group}"), g("verbed") if group == "verbatim" else g("verbs"))
        elif group in ("equation", "display", "dollars", "dollar"):
            inside = next(x for x in (g("equated"), g("displayed"), g("displayed2"), g("dollared"), g("dollared1")) if x is not None)
            if group == "dollar" and (PROSE.search(inside) or not MATHS.search(inside)):
                return False
            if group == "display" and m[0][1] == "(" and not m[0].endswith("\\)") or not inside.strip():
                return False
            self._note("latex", "formula")
            self._leaf("formula", (*around, f"latex:{group}"), inside.strip())
        elif group == "tick":
            self._note("markdown", "code")
            self._leaf("code", (*around, "markdown:code"), g("ticked").strip())
        elif group == "texhead":
            self._note("latex", "heading")
            self._inner(g("headed"), "latex", "heading", around, "heading")
        elif group == "texlist":
            self._note("latex", "list")
            if "item" in m[0][:5]:
                self._leaf("list", (*around, "latex:item"), "")
        elif group == "texenv":
            self._note("latex", "inline")
        elif group == "texcmd":
            self._note("latex", "inline")
            if g("xn") in TEX_DROPPED:
                self._leaf("drop", (*around, f"latex:{g('xn')}"), g("xarg"))
            else:
                self._inner(g("xarg"), "latex", "command", around)
        elif group == "texbare":
            self._note("latex", "inline")
        elif group == "tag":
            return self._tag(g("tn").lower(), m[0].startswith("</"), g("attr") or "", g("tagend"))
        elif group == "autolink":
            self._note("markdown", "inline")
            self._leaf("text", (*around, "markdown:autolink"), m[0][1:-1])
        elif group == "entity":
            plain = html.unescape(m[0])
            if plain == m[0]:
                return False
            self._note("html", "inline")
            self._leaf("text", around, " " if plain == "\xa0" else plain)
        elif group in ("wikihead", "setext", "atx"):
            inside = next(x for x in (g("wheaded"), g("wheaded1"), g("sheaded"), g("aheaded")) if x is not None)
            if group == "setext" and re.match(r"[-+*>#|]\s|\d+[.)]\s", inside):
                return False
            if not inside.strip(" #"):
                return False
            markup = "wiki" if group == "wikihead" else "markdown"
            self._note(markup, "heading")
            self._inner(inside, markup, "heading", around, "heading")
        elif group in ("wikilist", "mdlist"):
            markup = group[:-4].replace("md", "markdown")
            self._note(markup, "list")
            self._leaf("list", (*around, f"{markup}:list"), "")
        elif group == "mdnum":
            number = int(re.match(r"\s*(\d+)", m[0])[1])
            if not (number == 1 or self.numbered):
                return False
            self.numbered = True
            self._note("markdown", "list")
            self._leaf("list", (*around, "markdown:list"), "")
        elif group in ("quote", "rule", "mdtable", "refdef", "foot"):
            self._note("markdown", "inline")
            if group == "refdef":
                self._leaf("drop", (*around, "markdown:reference"), m[0])
        elif group in ("table", "magic"):
            self._note("wiki", "inline")
        elif group in ("wikilink", "template"):
            inside = g("wl") if group == "wikilink" else g("wt")
            if not inside.strip():
                return False
            self._note("wiki", "inline")
            head, _, label = inside.rpartition("|")
            hidden = group == "template" and head == "" or re.match(r"\s*(?:file|image|category|datei|bild|kategorie|fichier|catégorie)\s*:", inside, re.I)
            if hidden and not (label and head):
                self._leaf("drop", (*around, f"wiki:{group}"), inside)
            else:
                self._inner(label or inside, "wiki", group, around)
        elif group == "extlink":
            self._note("wiki", "inline")
            self._inner(g("el"), "wiki", "extlink", around)
        elif group in ("image", "link"):
            self._note("markdown", "inline")
            self._inner(g("im") if group == "image" else g("li"), "markdown", group, around)
        elif group == "quotes":
            self._note("wiki", "inline")
            self._inner(next(x for x in (g("q5"), g("q3"), g("q2")) if x is not None), "wiki", "quotes", around)
        elif group in ("strong", "strike", "em"):
            self._note("markdown", "inline")
            self._inner(next(x for x in (g("b1"), g("b2"), g("s1"), g("e1"), g("e2")) if x is not None), "markdown", group, around)
        elif group == "open":
            self._note("markdown", "inline")
        return True

    def _tag(self, name: str, closing: bool, attributes: str, end: str) -> bool:
        if name not in HTML_NAMES:
            return False
        if end != ">" and not ("=" in attributes or closing or not attributes.strip()):
            return False
        structure = "heading" if name in HTML_HEADING else "list" if name in HTML_LIST else "code" if name in HTML_CODE else "formula" if name in HTML_FORMULA else "inline"
        self._note("wiki" if name in WIKI_TAGS else "html", structure)
        if name in BLOCKS:
            if closing:
                for k in range(len(self.stack) - 1, -1, -1):
                    if self.stack[k] == f"html:{name}" or name in HTML_HEADING and self.stack[k][5:] in HTML_HEADING:
                        for left in self.stack[k:]:
                            self.names[left] -= 1
                            if not self.names[left]:
                                del self.names[left]
                        del self.stack[k:]
                        break
                self._leaf("end", (), "")
            else:
                self.stack.append(f"html:{name}")
                self.names[f"html:{name}"] = self.names.get(f"html:{name}", 0) + 1
                self._leaf("heading" if name in HTML_HEADING else "list" if name in ("li", "dt", "dd") else "end", (), "")
        elif name in ("br", "hr"):
            self._leaf("end", (), "")
        if end != ">" and attributes and not closing:  # a broken tag: what is no attribute is text
            words = re.sub(r"\s*[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|\S+)", "", attributes).strip()
            if words:
                self._leaf("text", (), words)
        return True


GROUPS = tuple(
    """fence comment pre icode verbatim verb equation display dollars dollar tick texhead texlist texenv texcmd texbare tag autolink entity wikihead setext atx
    wikilist table mdtable rule mdlist mdnum quote refdef wikilink template extlink image link foot quotes magic strong strike em open""".split()
)


def clean_text(nodes: list[tuple[str, str, str]], content: dict[str, bool] | None = None) -> str:
    """The text that the nodes leave: ``#`` before headings, ``-`` before list items, fences and back ticks around code, ``$`` around formulas."""
    out: list[str] = []

    def fresh() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for kind, path, text in nodes:
        if kind == "drop" or kind == "text" and content is not None and not content.get(path, True):
            continue
        if kind == "heading":
            fresh()
            out.append("# " + text)
        elif kind == "list":
            fresh()
            out.append("- " + text)
        elif kind == "end":
            fresh()
        elif kind == "block":
            fresh()
            out.append("```\n" + text.strip("\n") + "\n```\n")
        elif kind == "code":
            out.append(f"`{text}`")
        elif kind == "formula":
            out.append(f"${text}$")
        elif out and out[-1][-2:] in ("# ", "- ") or out and out[-1].endswith("\n"):
            out.append(text.lstrip("\n"))
        else:
            out.append(text)
    return re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", "".join(out))).strip()


NODE = "array<struct<path:string,nodes:long,chars:double,punctuation:double>>"
NOTE = "array<struct<markup:string,structure:string>>"


def smoothed(nodes: list[tuple[str, str, str]]) -> list[tuple[str, float, float]]:
    """``(path, characters, punctuation)`` of the leaves of text, each the mean of itself and its neighbours in one line of running text."""
    runs: list[list[tuple[str, int, int]]] = [[]]
    for kind, path, leaf in nodes:
        if kind not in ("text", "drop"):
            runs.append([])
            continue
        for k, line in enumerate(leaf.split("\n")):
            if k:
                runs.append([])
            if line.strip():
                runs[-1].append((path, len(line), len(PUNCTUATION.findall(line))))
    out = []
    for run in runs:
        for k, (path, _, _) in enumerate(run):
            near = run[max(k - 1, 0) : k + 2]
            out.append((path, sum(n[1] for n in near) / len(near), sum(n[2] for n in near) / len(near)))
    return out


def parsed(items: DataFrame) -> DataFrame:
    """``(origin, item_key, paths, notes)``: the sums of the text nodes by path and the constructs of each item, without its text."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            paths, notes = [], []
            for text, literals in zip(batch.column("text").to_pylist(), batch.column("literals").to_pylist()):
                p = Parse(text or "", literals)
                sums: dict[str, list[float]] = {}
                for path, chars, points in smoothed(p.nodes):
                    s = sums.setdefault(path, [0, 0.0, 0.0])
                    s[0] += 1
                    s[1] += chars
                    s[2] += points
                paths.append([{"path": k, "nodes": n, "chars": c, "punctuation": q} for k, (n, c, q) in sums.items()])
                notes.append([{"markup": a, "structure": b} for a, b in sorted(p.found)])
            return {"origin": batch.column("origin"), "item_key": batch.column("item_key"), "paths": paths, "notes": notes}

        return work

    return map_batches(items.select("origin", "item_key", "text", "literals"), f"origin string, item_key long, paths {NODE}, notes {NOTE}", make)


def structural(path: str) -> bool:
    """Whether a path lies in a heading, list, code or formula."""
    return any(name in STRUCTURAL or name.endswith((":heading", ":list")) for name in path.split("/"))


STRUCTURAL = {f"html:{n}" for n in HTML_HEADING | HTML_LIST | HTML_CODE | HTML_FORMULA | {"syntaxhighlight"}} | set(
    "markdown:fence markdown:code latex:item latex:verbatim latex:verb latex:equation latex:display latex:dollars latex:dollar".split()
)


def path_sums(found: DataFrame) -> DataFrame:
    """``(path, nodes, chars, punctuation)`` over the whole corpus, of the result of :func:`parsed`; summed before the shuffle too."""
    return found.select(F.explode("paths").alias("p")).groupBy("p.path").agg(*(F.sum(f"p.{c}").alias(c) for c in ("nodes", "chars", "punctuation")))


def ratios(sums: list) -> dict[str, float]:
    """The fused ratio of each path: text and punctuation to a node, each smoothed towards the nearest path above that has nodes."""
    rows = {r.path: r for r in sums}
    fused: dict[str, float] = {}
    for path in rows:
        r, up = rows[path], path.rpartition("/")[0]
        while up and up not in rows:
            up = up.rpartition("/")[0]
        parent = rows.get(up or "text")
        above = (parent.chars / parent.nodes, parent.punctuation / parent.nodes) if parent else (0.0, 0.0)
        chars, points = ((a + SMOOTH * b) / (r.nodes + SMOOTH) for a, b in zip((r.chars, r.punctuation), above))
        fused[path] = chars * (1 + points)
    return fused


def content_paths(found: DataFrame) -> dict[str, bool]:
    """Whether a path holds content: it is structural, or its fused ratio is at least LEAST of the mean over all characters.

    ``found`` is the result of :func:`parsed`. Paths are chains of the fixed names without repeats, of which a corpus has some hundreds,
    whatever its size.
    """
    sums = path_sums(found).collect()
    fused = ratios(sums)
    mean = sum(fused[r.path] * r.chars for r in sums) / (sum(r.chars for r in sums) or 1)
    return {p: structural(p) or ratio >= LEAST * mean for p, ratio in fused.items()}


def weighed(items: DataFrame) -> DataFrame:
    """``(path, nodes, chars, punctuation, ratio, content)``: the tag paths of ``(origin, item_key, text, literals)`` with their fused ratios."""
    found = cut_lineage(path_sums(parsed(items)))
    sums = found.collect()
    fused = ratios(sums)
    mean = sum(fused[r.path] * r.chars for r in sums) / (sum(r.chars for r in sums) or 1)
    rows = [(r.path, r.nodes, r.chars, r.punctuation, fused[r.path], structural(r.path) or fused[r.path] >= LEAST * mean) for r in sums]
    return items.sparkSession.createDataFrame(rows, "path string, nodes long, chars double, punctuation double, ratio double, content boolean")


def constructs(items: DataFrame) -> DataFrame:
    """``(origin, item_key, markup, structure)`` of the nodes of ``(origin, item_key, text, literals)``.

    Each distinct row of an item comes out once, however often the item was delivered. Null and empty texts have no constructs;
    null literals are none.
    """
    return parsed(items).select("origin", "item_key", F.explode("notes").alias("c")).select("origin", "item_key", "c.markup", "c.structure").distinct()


def converted(items: DataFrame) -> DataFrame:
    """``(origin, item_key, clean)``: the clean text of each item, a row for every row delivered. Null and empty texts become empty texts."""
    content = content_paths(parsed(items))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            both = zip(batch.column("text").to_pylist(), batch.column("literals").to_pylist())
            return {"origin": batch.column("origin"), "item_key": batch.column("item_key"), "clean": [clean_text(Parse(t or "", l).nodes, content) for t, l in both]}

        return work

    return map_batches(items.select("origin", "item_key", "text", "literals"), "origin string, item_key long, clean string", make)
