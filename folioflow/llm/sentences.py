"""Sentence boundaries across languages and scripts.

Abbreviations, collocations of numbers, and words that start sentences are learned without labels from all texts, for each
language, by log-likelihood ratios; the counts are summed by Spark and only what passes the thresholds reaches the driver. Each
period is then classified by these statistics and by its context. Marks that are no periods, quotations, brackets, trailing dots
and scripts without spaces or marks follow rules that hold for any language.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.arrow import cut_lineage, map_batches

ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88  # thresholds of the log-likelihood ratios
PROFILE = 150  # most frequent words of a language, by which texts without a language are assigned
NUMBER = "##"

OPENERS, CLOSERS = "\"'“„‚‘«»‹›([{¿¡「『（【《〈", "\"'”“’‘»«›‹)]}」』）】》〉"
STRIP = OPENERS + CLOSERS + ",;:–—-"
DIGITS = re.compile(r"[\d.,:/%-]*\d[\d.,:/%-]*$")
DASHES = "—–-,;:،؛、，：；…/&"
CJK = "぀-ヿ㐀-䶿一-鿿가-힯豈-﫿"

BLANK = re.compile(r"\r?\n[^\S\n]*\r?\n\s*|\u2029\s*")
MARKS = ".!?…。！？｡؟।॥۔։።។៕‼⁇⁈⁉"
_IN = "*?"  # of any length: what is inside never passes another mark of its own kind, so a text is read at most once for each kind
EVENT = re.compile(
    rf"""(?=[„“«»‚‘"'「『《(\[（【{MARKS}])(?:  # all alternatives begin with one of these
    (?P<quote>„[^„“”]{_IN}[“”]|“[^“”]{_IN}”|«[^«»]{_IN}»|»[^«»]{_IN}«|‚[^‚‘’]{_IN}[‘’](?!\w)|‘[^‘]{_IN}’(?!\w)
    |(?<![^\s(\[.!?…])"(?=\S)[^"]{_IN}(?<=\S)"(?!\w)|(?<![^\s(\[.!?…])'(?=\S)[^']{_IN}(?<=\S)'(?!\w)|「[^「」]{_IN}」|『[^『』]{_IN}』|《[^《》]{_IN}》)
    |(?P<bracket>\([^()]{_IN}\)|\[[^\[\]]{_IN}\]|（[^（）]{_IN}）|【[^【】]{_IN}】)
    |(?P<mark>[{MARKS}]+(?:[^\S\n]?[!?]+)*))""",
    re.X,
)
THAI = re.compile(r"[฀-๿]")
THAI_GAP = re.compile(r"(?<![\d๐-๙\s])\s+(?![\d๐-๙\s])")
TOKEN = re.compile(r"[^\s]*")
MIXED = re.compile(r"[^\W\d_]*[a-zà-ÿ][A-ZÀ-Þ]")
PERIODS = re.compile(r"(?:[^\W\d_]{1,3}[.‐-]+-?)+[^\W\d_]{1,3}$")
LATER = re.compile(r"\S")
VALUE = re.compile(r"\d[\d.,]*\s")


@dataclass
class Model:
    """What was learned of one language. ``abbreviations`` maps a type to ``title``, ``plain`` or ``ender``."""

    abbreviations: dict[str, str] = field(default_factory=dict)
    starters: set[str] = field(default_factory=set)
    collocations: set[str] = field(default_factory=set)  # words after a number with a period


def kind_of(token: str) -> tuple[str, bool] | None:
    """(type, whether it ends with a period), or None for what is no word."""
    core = token.strip(STRIP)
    dot = core.endswith(".")
    if dot:
        if core.endswith(".."):
            return None
        core = core[:-1].strip(STRIP)
    elif core[-1:] in "!?…؟。！？।":
        core = core.rstrip("!?…؟。！？।").strip(STRIP)
    if not core:
        return None
    return (NUMBER if DIGITS.match(core) else core.lower()), dot


def shape_of(token: str) -> str:
    """A: capital or mixed case, a: small, 9: digit, -: anything else."""
    core = token.lstrip(OPENERS)
    if not core:
        return "-"
    if core[0].isdigit():
        return "9"
    return "a" if core[0].islower() and not MIXED.match(core) else "A" if core[0].isalpha() else "-"


def count_batch(texts: list, langs: list) -> list[tuple]:
    """Partial counts ``(lang, kind, a, b, n)``. Kinds: w word, p word with a period, b what follows a period, e an end of text."""
    grouped: dict[str, list[str]] = {}
    for t, l in zip(texts, langs):
        if t:
            grouped.setdefault(l or "", []).extend([*t.split(), "\0"])
    rows = []
    for lang, tokens in grouped.items():
        words, dots, pairs = Counter(), Counter(), Counter()
        for token, n in Counter(tokens).items():
            if k := kind_of(token) if token != "\0" else None:
                words[k[0]] += n
                if k[1]:
                    dots[k[0]] += n
        ending = Counter((a, b) for a, b in zip(tokens, tokens[1:]) if a[-1] in ".!?\"”’»)“" and a != "\0")
        for (a, b), n in ending.items():
            k = kind_of(a)
            left = (k[0] if k and k[1] else "") if "." in a[-3:] else "!" if ("!" in a[-3:] or "?" in a[-3:]) else None
            if left:
                right = kind_of(b) if b != "\0" else None
                pairs[left, (shape_of(b) + right[0]) if right else "$"] += n
        rows += [(lang, "w", w, "", n) for w, n in words.items()]
        rows += [(lang, "p", w, "", n) for w, n in dots.items()]
        rows += [(lang, "b", a, b, n) for (a, b), n in pairs.items()]
    return rows


def counts(texts: DataFrame) -> DataFrame:
    """Summed counts of all ``(lang, text)`` rows; batches are summed before the shuffle."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = count_batch(batch.column("text").to_pylist(), batch.column("lang").to_pylist())
            cols = list(zip(*rows)) or [()] * 5
            return dict(zip(("lang", "kind", "a", "b", "n"), map(list, cols)))

        return work

    found = map_batches(texts.select("lang", "text"), "lang string, kind string, a string, b string, n long", make, rows=20_000)  # few counts a text
    return found.groupBy("lang", "kind", "a", "b").agg(F.sum("n").alias("n"))


def _binomial(k, n, p):
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return k * F.log(p) + (n - k) * F.log(1 - p)


def _ratio(joint, left, right, total):
    """Log-likelihood ratio of a pair against independence."""
    p, p1, p2 = right / total, joint / left, (right - joint) / (total - left)
    return -2 * (_binomial(joint, left, p) + _binomial(right - joint, total - left, p) - _binomial(joint, left, p1) - _binomial(right - joint, total - left, p2))


def learn(texts: DataFrame) -> tuple[dict[str, Model], dict[str, set[str]]]:
    """Models and word profiles by language, from all rows of ``(lang, text)``. Null and empty texts count nothing.

    Texts without a language form a language ``""`` of their own. What reaches the driver are the words that pass the thresholds: abbreviations
    are hardly ever seen without their period, however large the corpus, and of the words that start sentences only those
    that a text has after an abbreviation are ever asked for.
    """
    spark = texts.sparkSession
    c = cut_lineage(counts(texts))
    words = c.where("kind in ('w', 'p')").groupBy("lang", "a").agg(F.sum(F.when(F.col("kind") == "w", F.col("n"))).alias("n"), F.sum(F.when(F.col("kind") == "p", F.col("n")).otherwise(0)).alias("k"))
    after = c.where("kind = 'b'")
    # a row a language: bounded by the number of languages
    per_lang = words.groupBy("lang").agg(F.sum("n").alias("tokens"), F.sum("k").alias("periods"), F.sum(F.when(F.col("a") == NUMBER, F.col("k")).otherwise(0)).alias("numbers"))
    last = after.where("a != '!'").groupBy("lang").agg((F.sum(F.when(F.col("b") == "$", F.col("n")).otherwise(0)) / F.sum("n")).alias("last"))
    totals = F.broadcast(spark.createDataFrame(per_lang.join(last, "lang", "left").na.fill(0.0, ["last"]).collect(), "lang string, tokens long, periods long, numbers long, last double"))
    inner = F.length(F.regexp_replace("a", r"[^.]", ""))
    size = F.length("a") - inner
    n, k, all_n = F.col("n").cast("double"), F.col("k").cast("double"), F.col("tokens").cast("double")
    score = (
        -2 * (_binomial(k, n, F.col("periods") / all_n) - _binomial(k, n, F.lit(0.99)))
        * F.exp(-size / 2) * (inner + 1) * F.pow(size.cast("double"), k - n)
    )
    candidates = (
        words.where((F.col("k") > 0) & (F.col("a") != NUMBER) & F.col("a").rlike(r"^[^\d]*[\p{L}\p{M}]$")).join(totals, "lang")
        .where(score >= ABBREVIATION).select("lang", "a", "k", "last")
    )
    ends = after.where("b = '$'").selectExpr("lang", "a", "n as ends")
    # words that end texts as often as any word do end sentences, though never seen without a period
    found = candidates.join(ends, ["lang", "a"], "left").where("coalesce(ends, 0) <= 0.3 * last * k").select("lang", "a").collect()
    known = F.broadcast(spark.createDataFrame(found, "lang string, a string").withColumn("is", F.lit(True)))
    breaks = cut_lineage(
        after.where(f"a != '{NUMBER}' and b != '$' and substr(b, 1, 1) != 'a'").join(known, ["lang", "a"], "left").where("is is null")
        .groupBy("lang", F.expr("substr(b, 2)").alias("a")).agg(F.sum("n").alias("at_break"))
    )
    all_breaks = F.broadcast(spark.createDataFrame(breaks.groupBy("lang").agg(F.sum("at_break").alias("breaks")).collect(), "lang string, breaks long"))
    j, all_j = F.col("at_break").cast("double"), F.col("breaks").cast("double")
    asked = after.join(known, ["lang", "a"], "left").where(f"is or a like '%.%' or a = '{NUMBER}'").select("lang", F.expr("substr(b, 2)").alias("a")).distinct()
    starters = (
        breaks.where((F.col("a") != NUMBER) & F.col("a").rlike(r"\p{L}")).join(asked, ["lang", "a"], "left_semi").join(words.select("lang", "a", "n"), ["lang", "a"]).join(totals, "lang").join(all_breaks, "lang")
        .where((_ratio(F.least(j, n), all_j, n, all_n) >= STARTER) & (j / n > all_j / all_n)).select("lang", "a").collect()
    )
    numbered = after.where(f"a = '{NUMBER}' and substr(b, 1, 1) = 'A'").selectExpr("lang", "substr(b, 2) as a", "n as joint")
    collocations = (
        numbered.join(words.select("lang", "a", "n"), ["lang", "a"]).join(totals, "lang")
        .where((_ratio(F.least(F.col("joint").cast("double"), n), F.col("numbers").cast("double"), n, all_n) >= COLLOCATION) & (F.col("joint") >= 2)).select("lang", "a").collect()
    )
    starting = F.broadcast(spark.createDataFrame(starters, "lang string, w string").withColumn("starts", F.lit(True)))
    small = F.substring("b", 1, 1) == "a"
    follow = (
        after.join(known, ["lang", "a"]).withColumn("w", F.expr("substr(b, 2)")).join(starting, ["lang", "w"], "left").groupBy("lang", "a").agg(
            F.sum("n").alias("all"),
            F.sum(F.when((F.col("b") == "$") | (~small & F.col("starts")), F.col("n")).otherwise(0)).alias("ended"),
            F.sum(F.when((F.substring("b", 1, 1) == "A") & F.col("starts").isNull(), F.col("n")).otherwise(0)).alias("named"),
        ).collect()
    )
    models: dict[str, Model] = {}
    got = lambda lang: models.setdefault(lang, Model())
    for r in found:
        got(r.lang).abbreviations[r.a] = "plain"
    for r in follow:
        share = lambda x: (x or 0) / r["all"]  # noqa: E731, B023
        got(r.lang).abbreviations[r.a] = "ender" if share(r.ended) >= 0.5 else "title" if share(r.named) >= 0.5 else "plain"
    for r in starters:
        got(r.lang).starters.add(r.a)
    for r in collocations:
        if r.a not in got(r.lang).starters:
            got(r.lang).collocations.add(r.a)
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "a")
    rows = words.where(F.col("a").rlike(r"^[\p{L}\p{M}'’]+$") & (F.col("lang") != "")).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= PROFILE).select("lang", "a").collect()
    profiles: dict[str, set[str]] = {}
    for r in rows:
        got(r.lang)
        profiles.setdefault(r.lang, set()).add(r.a)
    return models, profiles


class Splitter:
    def __init__(self, models: dict[str, Model], profiles: dict[str, set[str]] | None = None):
        self.models, self.none = models, Model()
        self.by_word: dict[str, list[str]] = {}
        for lang, words in (profiles or {}).items():
            for w in words:
                self.by_word.setdefault(w, []).append(lang)

    def language(self, text: str) -> str:
        """The language whose frequent words the text has most of; a word of several languages counts in part."""
        votes: Counter = Counter()
        for w in text.lower().split():
            for lang in (near := self.by_word.get(w.strip(STRIP + MARKS), ())):
                votes[lang] += 1 / len(near)
        return max(votes, key=lambda k: (votes[k], k)) if votes else ""

    def spans(self, text: str | None, lang: str | None) -> list[tuple[int, int]]:
        """Ordered half-open spans of the sentence units. They cover every character but white space; null and blank texts have none."""
        if not text or text.isspace():
            return []
        lang = lang if lang in self.models else self.language(text)
        model = self.models.get(lang, self.none)
        out: list[tuple[int, int]] = []
        at = 0
        for m in [*BLANK.finditer(text), None]:
            end = m.start() if m else len(text)
            if at < end:
                self._block(text, at, end, model, out)
            at = m.end() if m else end
        return out

    def _block(self, text: str, a: int, b: int, model: Model, out: list) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a == b:
            return
        cuts = []
        if THAI.search(text, a, b):
            letters = sum(map(str.isalpha, text[a:b])) or 1
            if len(THAI.findall(text, a, b)) * 2 > letters:
                cuts = [m.start() for m in THAI_GAP.finditer(text, a, b)]
        if not cuts:
            cuts = self._cuts(text, a, b, model)
        for cut in cuts:
            if cut > a:
                out.append((a, cut))
                a = cut
                while text[a].isspace():
                    a += 1
        out.append((a, b))

    def _cuts(self, text: str, a: int, b: int, model: Model) -> list[int]:
        events = list(EVENT.finditer(text, a, b))
        cuts: list[int] = []
        start = a
        for k, m in enumerate(events):
            group, end = m.lastgroup, m.end()
            if group == "mark":
                opened = k + 1 < len(events) and events[k + 1].start() == end and events[k + 1].lastgroup != "mark"
                if not opened:
                    while end < b and text[end] in CLOSERS:
                        end += 1
            elif text[end - 2] not in MARKS and text[end - 2 : end - 1] not in CLOSERS or len(m[0]) < 3:
                continue
            if end >= b:
                break
            nxt = LATER.search(text, end).start()
            gap = nxt > end
            if group == "mark":
                cut = self._after_mark(text, m, start, end, nxt, gap, model)
            else:
                cut = self._after_quote(text, m, start, nxt, gap, group)
            if cut:
                cuts.append(end)
                start = nxt
        return cuts

    def _small(self, text: str, nxt: int) -> bool:
        """Whether a sentence would go on with a small letter; names like ``eQ-one`` don't count as small."""
        return text[nxt].islower() and not MIXED.match(text, nxt)

    def _after_quote(self, text: str, m: re.Match, start: int, nxt: int, gap: bool, group: str) -> bool:
        c = text[nxt]
        if c in DASHES or c in MARKS or self._small(text, nxt):
            return False
        if not gap and ("぀" <= c <= "鿿" or c.isalnum()):
            return False
        return group == "quote" or m.start() == start

    def _after_mark(self, text: str, m: re.Match, start: int, end: int, nxt: int, gap: bool, model: Model) -> bool:
        mark, c, before = m[0], text[nxt], text[m.start() - 1 : m.start()]
        if mark[-1] in "。！？｡॥।" or (mark[-1] == "…" and "぀" <= before <= "鿿"):
            return c not in CLOSERS or gap
        if c in ",;:،؛" or (c in DASHES and c != "-" and "\n" not in text[end:nxt]):
            return False
        if "!" in mark or "?" in mark or "؟" in mark or mark[0] not in ".…":
            if self._small(text, nxt):
                return False
            return gap or c.isupper() or c in OPENERS or "؀" <= c <= "ۿ"
        if len(mark) > 1 or mark == "…":
            return (gap or c.isupper()) and not self._small(text, nxt)
        return self._after_period(text, m.start(), start, end, nxt, gap, model)

    def _after_period(self, text: str, dot: int, start: int, end: int, nxt: int, gap: bool, model: Model) -> bool:
        left = dot
        while left > start and not text[left - 1].isspace():
            left -= 1
        token = text[left:dot].lstrip(OPENERS)
        word = TOKEN.match(text, nxt)[0]
        c = text[nxt]
        if not gap:  # a lost space, or no end at all
            if not token or "/" in token or "@" in token or "_" in token or token[:4].lower() == "www." or not token[-1].islower() and not token[-1] in CLOSERS:
                return False
            last = re.split(r"[^\w]", token)[-1]
            if "." in token and len(token.rsplit(".", 1)[1]) < 3 or len(last) < 2 or last.lower() in model.abbreviations:
                return False
            if c.isdigit():
                return "." not in token and bool(VALUE.match(text, nxt))
            return c.isupper() and (word[1:2].islower() or len(word) == 1 or not word[1:2].isalpha()) or bool(MIXED.match(text, nxt)) or c in OPENERS
        if not token:
            return not self._small(text, nxt)
        small = self._small(text, nxt)
        kind = kind_of(word)
        follower = kind[0] if kind else ""
        starts = follower in model.starters and not small
        if DIGITS.match(token):
            if not text[start:left].strip(OPENERS + " \n\t") or small or follower in model.collocations:
                return False
            return True
        if end > dot + 1:  # the period stands before a closing mark
            return not small
        if len(token) == 1 and token.isalpha():
            return False
        name = token.lower()
        if "(" in name or "[" in name or "-" in name or "/" in name:
            name = re.split(r"[(\[/-]", name)[-1] if not PERIODS.match(name) else name
        known = model.abbreviations.get(name) or model.abbreviations.get(token.lower())
        if known is None and "." in name and not PERIODS.match(token):  # a space was lost before an abbreviation
            known = model.abbreviations.get(name.rsplit(".", 1)[1])
        if known is None and PERIODS.match(token):
            known = "plain"
        if known is None:
            return not small
        if small or known == "title":
            return False
        return True if known == "ender" else starts


def sentence_units(texts: DataFrame, models: dict[str, Model], profiles: dict[str, set[str]]) -> DataFrame:
    """``(origin, item_key, start_pos, end_pos)`` for ``(origin, item_key, lang, text)``.

    One map over whole rows. A key that was delivered twice comes out once, by a distinct over the small result rows.
    """

    def make():
        splitter = Splitter(models, profiles)

        def work(batch: pa.RecordBatch) -> dict:
            out = {"origin": [], "item_key": [], "start_pos": [], "end_pos": []}
            for origin, key, lang, text in zip(*(batch.column(c).to_pylist() for c in ("origin", "item_key", "lang", "text"))):
                for s, e in splitter.spans(text, lang):
                    out["origin"].append(origin)
                    out["item_key"].append(key)
                    out["start_pos"].append(s)
                    out["end_pos"].append(e)
            return out

        return work

    found = map_batches(texts.select("origin", "item_key", "lang", "text"), "origin string, item_key long, start_pos int, end_pos int", make)
    return found.distinct()
