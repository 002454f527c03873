"""Keyword-stuffed and link-list pages.

A page is cut into blocks of a fixed length, so that lengths compare, and each block is compressed twice: alone, and with a
dictionary of running text of a language. Running text gains much from its language's dictionary. Keywords, links and tags gain
next to nothing, for their redundancy is their own, so the ratio of the two sizes is the redundancy normalised by length and
language. Pages whose blocks mostly stay near 1, or compress extremely well alone, are flagged and confirmed by a low density of
sentence punctuation. Compression alone takes lists that inform (results, prices, contents) for spam as well, hence an exact
look at the cells of the flagged pages follows: links, tags, menus and repeated keywords must be most of the page.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.arrow import map_batches

BLOCK = 512
SAMPLE = 64  # pages of each language in its dictionary: the documented bound of the fitted sample
DICTIONARY_BYTES = 60_000
FLAG = 0.68  # size with the dictionary to size without; running text lies near 0.5
REDUNDANT = 4.0  # ratio from which a block alone is extremely redundant
DENSITY = 12.0  # ends of sentences outside spam matter in 1,000 characters of a page; lists of names and small ads have 18 and more
SHARE = 0.5  # of the characters in cells

SENTENCE_END = re.compile(r"[^\W\d_]{2,}[.!?]+[\"'”’»)]*(?=\s|$)")
GAP = re.compile(r"\s{3,}")
LINK = re.compile(r"https?:?/|www\.|\[\w+\]|>>|\w{3,}(?:[-.]\w+)*\.[^\W\d]{3,}(?=[/\s)]|$)", re.I)
TAG = re.compile(r"(?:^|\s)#\w{3,}")
ARTICLE_NO = re.compile(r"^[^\W\d_]+(?: [^\W\d_]+){0,3} \d{1,4}-\d{2,5}(?=\s|$)")
SIZES = re.compile(r"^(?:(?:XS|S|M|L|XL|XXL|\d{2}|size|tags:|[^\W\d_]{3,}/[^\W\d_]{3,})[ ,]*)+$|^tags:|\((?:new|neu|nouveau)\)$", re.I)
MENU = re.compile(r"^\|?\s*[^\W\d_]+(?:\s*\|\s*[^\W\d_]*)+$")
INFORMS = re.compile(r"\d\s*:\s*\d|\d+\s?[sdfp]\.|(?:\.\s){3,}|(?:^|\s)\.[\s\d.]*$|\d{1,2}[.:]\d\d|[£$€]|\d\s?(?:Pf|Mk|Kr|fr)\b")
WORD = re.compile(r"[^\W\d_]+")
KEYWORD = re.compile(r"[^\W\d_]{3,}(?![\w.])")  # neither the end of a sentence nor an abbreviated title


def dictionaries(documents: DataFrame, sample: int = SAMPLE) -> dict[str, bytes]:
    """A dictionary of running text for each language, from at most ``sample`` pages, whole and in the order of a hash of doc_id.

    Pages without a language, shorter than 200 characters, or with too few ends of sentences for their length are not taken, nor are
    those that would no longer fit into DICTIONARY_BYTES. A rerun gives the same bytes.
    """
    density = F.regexp_count("text", F.lit(r"[\p{L}]{2,}[.!?](?=\s|$)")) / F.length("text")
    some = documents.where("lang is not null and length(text) >= 200 and octet_length(text) < " + str(DICTIONARY_BYTES)).select("lang", "doc_id", density.alias("density"), "text")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # the top of each group is taken before the shuffle too (a group limit of the window), so a hot language stays small
    rows = some.where("density > 0.008").withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample).select("lang", "n", "text").collect()
    texts: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.n)):
        longer = texts.get(r.lang, b"") + r.text.encode("utf-8", "surrogatepass") + b"\n"
        if len(longer) <= DICTIONARY_BYTES:
            texts[r.lang] = longer
    return texts


class Compressors:
    """Block compression alone and with each language's dictionary."""

    def __init__(self, texts: dict[str, bytes]):
        self.alone = zstandard.ZstdCompressor(level=3)
        self.by = {
            k: zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k, v in texts.items()
        }

    def blocks(self, text: str, lang: str | None) -> tuple[list[bool], float]:
        """(for each block, whether it gains little from any language; highest ratio of a block alone)"""
        order = sorted(self.by, key=lambda k: k != lang)
        poor, most = [], 0.0
        for i in range(0, max(len(text) - BLOCK // 2, 1), BLOCK):
            data = text[i : i + BLOCK if i + BLOCK * 3 // 2 < len(text) else len(text)].encode("utf-8", "surrogatepass")
            alone = len(self.alone.compress(data))
            most = max(most, len(data) / alone)
            poor.append(all(len(self.by[k].compress(data)) >= FLAG * alone for k in order))
        return poor, most


def matter(text: str, poor: list[bool] | None = None) -> tuple[float, float]:
    """The share of the characters that stands in links, tags, menus and repeated keywords; the ends of sentences elsewhere in 1,000 characters.

    Where ``poor`` says that a block is running text, repeated words in it are no keywords.
    """
    cells, running, at = [], [], 0
    for line in text.split("\n"):
        block = min(at // BLOCK, len(poor) - 1) if poor else 0
        parts = [c.strip() for c in GAP.split(line) if c.strip()]
        cells += parts
        running += [bool(poor) and not poor[block]] * len(parts)
        at += len(line) + 1
    words = [[w.lower() for w in WORD.findall(c)] for c in cells]
    counts = Counter(w.lower() for c in cells for w in KEYWORD.findall(c))
    spam, total, ends, before = 0, 0, 0, False
    for cell, ws, prose in zip(cells, words, running):
        total += len(cell)
        if LINK.search(cell) or TAG.search(cell) or ARTICLE_NO.search(cell) or SIZES.search(cell) or MENU.search(cell):
            kind = True
        elif prose or INFORMS.search(cell):
            kind = False
        elif any(ch.isdigit() for ch in cell):
            kind = before and len(cell) < 12
        elif len(ws) == 1 and len(cell) < 12:
            kind = before  # the rest of a broken line
        else:
            again = sum(counts[w] >= 3 for w in ws if len(w) > 2)
            long = sum(len(w) > 2 for w in ws)
            kind = cell.endswith(" -") or bool(long) and again >= (0.5 if before else 0.58) * long
        spam += len(cell) * kind
        ends += 0 if kind else len(SENTENCE_END.findall(cell))
        before = kind
    return (spam / total, ends / total * 1_000) if total else (0.0, 0.0)


def spam_page(text: str | None, lang: str | None, compressors: Compressors) -> tuple[float, float, float, bool]:
    """(share of poor blocks, density of sentences, share of spam matter, verdict); null and blank pages are none.

    The density and the share are worked out for flagged pages only and are 0 for the others.
    """
    if not text or not text.strip():
        return 0.0, 0.0, 0.0, False
    blocks, most = compressors.blocks(text, lang)
    poor = sum(blocks) / len(blocks)
    if poor < 0.5 and most < REDUNDANT:
        return poor, 0.0, 0.0, False
    share, density = matter(text, blocks)
    return poor, density, share, share >= SHARE and density < DENSITY


def stuffed_pages(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, poor_blocks, density, matter, spam)`` for every page.

    One pass without a shuffle after the dictionaries are there (at most DICTIONARY_BYTES a language). A null or unknown
    language is tried with all dictionaries; without any dictionary every block counts as poor and the exact look decides.
    Equal pages get equal verdicts; other columns are ignored.
    """
    texts = dictionaries(documents, sample)

    def make():
        compressors = Compressors(texts)

        def work(batch: pa.RecordBatch) -> dict:
            found = [spam_page(t, l, compressors) for t, l in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist())]
            return {"doc_id": batch.column("doc_id")} | {k: [f[i] for f in found] for i, k in enumerate(("poor_blocks", "density", "matter", "spam"))}

        return work

    return map_batches(documents.select("doc_id", "text", "lang"), "doc_id long, poor_blocks double, density double, matter double, spam boolean", make)
