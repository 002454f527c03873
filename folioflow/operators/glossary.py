"""Glossaries: their checks, leftmost-longest matching of whole terms, and masking of terms around a translation.

Two matchers give the same matches. An index inside an Arrow function folds letters exactly and costs as much as the text is long,
whatever the glossary's size. For small ASCII glossaries one regular expression in the JVM does, without Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import itemgetter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.arrow import flat_map
from folioflow.functions.lineage import cut_lineage

SCHEMA = "source string, mode string, target string"
MODES = ("keep", "translate", "annotate")
MOST_TERMS = 200_000  # what one matcher may hold; the checked bound of what every task gets


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """``(source, mode, target, source_lang, target_lang)`` of a versioned JSON glossary; ``.json.gz`` is read alike."""
    raw = spark.read.schema(f"schema_version int, source_lang string, target_lang string, entries array<struct<source:string,mode:string,target:string>>").json(path, multiLine=True)
    checked = raw.withColumn("ok", F.when(F.col("schema_version") == 1, True).otherwise(F.raise_error(F.lit("a glossary must have schema_version 1")).cast("boolean"))).where("ok")
    return checked.select("source_lang", "target_lang", F.inline("entries"))


def glossary_errors(entries: DataFrame) -> DataFrame:
    """``(source, error)`` of entries that are not allowed: bad sources, modes and targets, and sources that fold to the same key."""
    blank = lambda c: F.col(c).isNull() | ~F.col(c).rlike(r"(?U)\S")
    problem = (
        F.when(blank("source"), "empty_source").when(F.col("source").rlike(r"^(?U)\s|\s$"), "source_not_trimmed").when(F.col("source").rlike(r"[\r\n]"), "source_of_several_lines")
        .when(~F.col("mode").isin(*MODES) | F.col("mode").isNull(), "unknown_mode").when((F.col("mode") == "keep") & F.col("target").isNotNull(), "target_with_keep")
        .when((F.col("mode") != "keep") & blank("target"), "missing_target")
    )
    single = entries.select("source", problem.alias("error")).where("error is not null")
    key = F.udf(lambda t: None if t is None else "\0".join(map(fold, t)), "string", useArrow=True)("source").alias("key")
    twice = entries.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("source")).where("n > 1 and key is not null").select("source", F.lit("duplicate_source").alias("error"))
    return single.unionByName(twice)


def fold(character: str) -> str:
    """The key of a character; a capital or dotless Turkish i counts as i, and one character may fold to several letters."""
    return "i" if character in "İı" else character.casefold()


def word_character(character: str) -> bool:
    return character == "_" or character.isalnum()


class _Folding(dict):
    """A table for ``str.translate`` that gives each character one character; folds of several letters get one of the private use each."""

    def __init__(self) -> None:
        self.several: dict[str, str] = {}

    def __missing__(self, code: int) -> str:
        key = fold(chr(code))
        self[code] = key if len(key) == 1 else self.several.setdefault(key, chr(0xF0000 + len(self.several)))
        return self[code]


_FOLDING = _Folding()


def folded(text: str) -> str:
    """A text as its terms are compared, with one character for each of its own. Good within one process only."""
    return text.lower() if text.isascii() else text.translate(_FOLDING)


class TermIndex:
    """Whole terms in a text, from left to right, the longest at each place, without overlaps.

    Folded terms are the keys of one dictionary, and their lengths stand under their first letters. Places where a term may start
    are found by one pattern of their first two characters, so text without them costs next to nothing; at such a place only the
    lengths that occur are looked up, the longest first.
    """

    HEAD = 3  # letters under which lengths are listed, fewer for shorter terms

    def __init__(self, terms: list[str]):
        whole = "\n".join(terms)
        plain = whole.isascii() and whole.count("\n") == len(terms) - 1  # folded as one text, as no term holds a line end
        keys = whole.lower().split("\n") if plain else [folded(t) for t in terms]
        self.numbers = dict(zip(keys, range(len(keys))))
        if len(self.numbers) < len(keys):
            raise ValueError("two terms of the glossary fold alike")
        self.numbers.pop("", None)
        lengths: dict[str, list[int]] = {}
        for head, length in set(zip(map(itemgetter(slice(self.HEAD)), self.numbers), map(len, self.numbers))):
            lengths.setdefault(head, []).append(length)
        self.lengths = {head: sorted(found, reverse=True) for head, found in lengths.items()}
        begin: dict[str, set[str]] = {}
        for head in self.lengths:
            begin.setdefault(head[0], set()).add(head[1:2])
        one = lambda c, more: re.escape(c) + ("" if "" in more else "[" + "".join(map(re.escape, sorted(more))) + "]")
        self.starts = re.compile(r"(?<!\w)(?:" + "|".join(one(c, begin[c]) for c in sorted(begin)) + ")") if begin else None

    def find(self, text: str, overlapping: bool = False) -> list[tuple[int, int, int]]:
        """``(start, end, number of the term)``; with ``overlapping`` the longest match at every place, also within other matches."""
        if self.starts is None:
            return []
        low, size, free = folded(text), len(text), 0
        odd, found = not text.isascii(), []
        for m in self.starts.finditer(low):
            at = m.start()
            if at < free or odd and at and word_character(text[at - 1]):
                continue
            if (match := self._longest(text, low, at, size)) is not None:
                found.append((at, *match))
                free = at if overlapping else match[0]
        return found

    def _longest(self, text: str, low: str, at: int, size: int) -> tuple[int, int] | None:
        for head in range(self.HEAD, 0, -1):
            for length in self.lengths.get(low[at : at + head], ()):  # a longer head has longer terms
                end = at + length
                if end <= size and (end == size or not word_character(text[end])) and (number := self.numbers.get(low[at:end])) is not None:
                    return end, number
        return None


def for_languages(entries: DataFrame, source: str, target: str) -> DataFrame:
    """The entries of a glossary of these languages; raises if it has others. Entries without languages are for any."""
    columns = [(c, wanted) for c, wanted in (("source_lang", source), ("target_lang", target)) if c in entries.columns]
    for column, wanted in columns:
        other = entries.where(F.col(column) != wanted).select(column).first()
        if other:
            raise ValueError(f"the glossary's {column} is {other[0]}, not {wanted}")
    return entries


def collected(entries: DataFrame) -> list[tuple[str, str, str | None]]:
    """The entries on the driver, behind a check of their number."""
    rows = entries.select("source", "mode", "target").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a glossary of more than {MOST_TERMS} terms has to be split")
    return sorted((r.source, r.mode, r.target) for r in rows)


def matches(texts: DataFrame, keys: list[str], text: str, entries: DataFrame) -> DataFrame:
    """``(keys, start_pos, end_pos, source, mode, target)`` of all matches, by the index.

    A glossary beyond MOST_TERMS is matched in parts of a bounded size: each part gives the longest match at every place, and of
    all parts' matches the leftmost and longest are kept, text by text. The keys must tell the texts apart then.
    """
    parts = -(-entries.count() // (MOST_TERMS // 2)) or 1 if entries.limit(MOST_TERMS + 1).count() > MOST_TERMS else 1  # half full on average
    fields = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    schema = ", ".join([*(f"{k} {fields[k]}" for k in keys), f"start_pos int, end_pos int, {SCHEMA}"])

    def by(terms: list[tuple[str, str, str | None]]) -> DataFrame:
        def make():
            index = TermIndex([t[0] for t in terms])
            return lambda row: [(*(row[k] for k in keys), a, b, *terms[n]) for a, b, n in index.find(row[text] or "", overlapping=parts > 1)]

        return flat_map(texts.select(*keys, text), schema, make)

    if parts == 1:
        return by(collected(entries))
    part = F.pmod(F.xxhash64("source"), F.lit(parts))
    found = reduce(DataFrame.unionByName, [cut_lineage(by(collected(entries.where(part == k)))) for k in range(parts)])
    row = F.struct("start_pos", (-F.col("end_pos")).alias("minus_end"), "end_pos", "source", "mode", "target")
    ordered = found.groupBy(*keys).agg(F.array_sort(F.collect_set(row)).alias("all"))  # the matches of one text
    none = F.array().cast("array<struct<start_pos:int,minus_end:int,end_pos:int,source:string,mode:string,target:string>>")
    free = lambda kept: F.when(F.size(kept) > 0, F.element_at(kept, -1)["end_pos"]).otherwise(0)
    kept = F.aggregate("all", none, lambda kept, x: F.when(x["start_pos"] >= free(kept), F.concat(kept, F.array(x))).otherwise(kept))
    return ordered.select(*keys, F.inline(kept)).drop("minus_end")


def matched_terms(texts: DataFrame, keys: list[str], text: str, terms: list[str]) -> DataFrame:
    """``(keys, match_no, term)``: matches of ASCII terms by one regular expression, longest alternatives first. JVM only."""
    if not all(t.isascii() for t in terms):
        raise ValueError("only ASCII terms fold alike in both")
    pattern = term_pattern(terms)
    return texts.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("match_no", "term"))


def term_pattern(terms: list[str]) -> str:
    return r"\b(?:" + "|".join(re.escape(t.lower()).replace("\\ ", " ") for t in sorted(terms, key=lambda t: (-len(t), t))) + r")\b"


def rendered(original: str, mode: str, target: str | None, before: str) -> str:
    """What stands in the translation for a matched term, with a capital where a sentence starts."""
    if mode == "keep":
        return original
    out = target or ""
    lead = before.rstrip().rstrip("\"'“”„‘’«»([").rstrip()
    if not lead or lead[-1] in ".!?":
        out = out[:1].upper() + out[1:]
    return f"{out} ({original})" if mode == "annotate" else out


@dataclass
class MaskedTerms:
    """A text with its terms behind markers. ``send`` goes to the model; without it, the terms are all there is and ``text`` has their renderings."""

    text: str
    send: str | None
    marker: re.Pattern | None = None
    hits: list[tuple[str, str, str | None]] = field(default_factory=list)  # what stood there, mode and target


class TermMask:
    """Masks terms before a translation and puts their renderings back, only if every marker came back once and unharmed."""

    def __init__(self, terms: list[tuple[str, str, str | None]], namespace: str = "DLG"):
        self.terms, self.namespace = terms, namespace
        self.index = TermIndex([t[0] for t in terms])

    def prefix(self, text: str) -> str:
        import hashlib

        low, k = text.lower(), 0
        while True:
            p = self.namespace + hashlib.sha256(f"{self.namespace}:{k}".encode()).hexdigest()[:32].upper()
            if p.lower() not in low:
                return p
            k += 1

    def masked(self, text: str) -> MaskedTerms:
        found = self.index.find(text)
        hits = [(text[a:b], *self.terms[n][1:]) for a, b, n in found]
        between = [text[a:b] for a, b in zip([0, *(b for _, b, _ in found)], [*(a for a, _, _ in found), len(text)])]
        if not hits:
            return MaskedTerms(text, text)
        if len(hits) == 1 and not "".join(between).strip():  # the whole segment is one term: no translation is needed
            return MaskedTerms(between[0] + rendered(*hits[0], "") + between[1], None)
        prefix = self.prefix(text)
        send = between[0] + "".join(f"{prefix}X{i}Z{rest}" for i, rest in enumerate(between[1:]))
        return MaskedTerms(text, send, re.compile(re.escape(prefix) + "X([0-9]+)Z"), hits)

    def filled(self, masked: MaskedTerms, out: str) -> tuple[str, str | None]:
        """(the translation with the terms' renderings, None) or (the text as it was, why)."""
        if not masked.hits:
            return out, None
        prose = masked.marker.split(out)
        order, prose = [int(n) for n in prose[1::2]], prose[::2]
        if sorted(order) != list(range(len(masked.hits))):
            return masked.text, "Glossary protection failed; original segment retained"
        namespace = masked.marker.pattern.split("X(")[0].lower()
        if any(namespace in p.lower() for p in prose):
            return masked.text, "Unexpected glossary marker; original segment retained"
        whole = prose[0]
        for k, (number, rest) in enumerate(zip(order, prose[1:])):
            before = prose[k] if prose[k].strip() or not k else "term"  # a sentence starts with the text, or after the end of another
            whole += rendered(*masked.hits[number], before) + rest
        return whole, None
