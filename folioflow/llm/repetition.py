"""Repetition inside a single document.

The share of a text that repeats earlier content of the same text is measured in numpy, for many texts at once, over word and
character ids. Rules on it are counted per host; a host's failure rate is shrunk with a beta prior whose mean and weight are
fitted to all hosts (method of moments), and the host's verdict is joined back to its documents. The verdict on one document
rests on its own share; a host's rate cannot tell which of its texts repeat themselves.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.arrow import cut_lineage, map_batches

WORD = re.compile(r"[^\W\d_]+")
STRETCH = 4  # words of a stretch that counts as repeated
FOLLOWS = 4  # times that a word or string follows itself
TOGETHER = 400_000  # characters of the texts that are measured in one go, which bounds the arrays; a longer text is measured alone
_MIX = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str) -> str:
    """Small letters, one for each character."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[:1] or c for c in text)


def repeated_chars(text: str | None) -> int:
    """Characters of ``text`` that repeat earlier content. Null and empty texts have none."""
    return all_repeated([text])[0]


def all_repeated(texts: list[str | None]) -> list[int]:
    """For each text, its characters that repeat earlier content of the same text."""
    out, some, size = [], [], 0
    for text in texts:
        if some and size + len(text or "") > TOGETHER:
            out += _together(some)
            some, size = [], 0
        some.append(text or "")
        size += len(text or "")
    return out + (_together(some) if some else [])


def _together(texts: list[str]) -> list[int]:
    """The texts stand one after another, each followed by a code of its own that no character has, so nothing is equal across texts."""
    low = [lowered(t) for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    after = np.cumsum([len(t) + 1 for t in low])
    codes[after - 1] = np.arange(len(texts), dtype=np.uint64) + np.uint64(0x110000)
    marks = np.zeros(len(codes) + 1, dtype=np.int32)  # +1 where a repeated range begins, -1 where it ends
    letters = np.r_[False, _letters()[np.minimum(codes, np.uint64(0x110000)).astype(np.int64)], False]
    edge = np.flatnonzero(letters[1:] != letters[:-1])
    starts, ends = edge[::2], edge[1::2]
    if len(starts) > STRETCH:
        known: dict[str, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in WORD.findall("\n".join(low))], dtype=np.int64)
        owners = np.searchsorted(after, starts, side="right")
        _stretches(ids, starts, ends, owners, len(known), marks)
        _runs(ids, starts, ends, owners, marks)
    _strings(codes, after, marks)
    hit = np.r_[0, np.cumsum(np.cumsum(marks[:-1]) > 0)]
    return (hit[after - 1] - hit[np.r_[0, after[:-1]]]).tolist()


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code is a letter of a word, with False at the end for what is no character."""
    out = np.zeros(0x110001, dtype=bool)
    for m in WORD.finditer("".join(map(chr, range(0x110000)))):
        out[m.start() : m.end()] = True
    return out


def _stretches(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, kinds: int, marks: np.ndarray) -> None:
    """Marks stretches of STRETCH or more words that occurred earlier in their text, with what stands between their words."""
    n = len(ids) - STRETCH + 1
    gram = owners[:n].copy()
    for k in range(STRETCH):  # ranks after each step, so that equal numbers mean equal stretches of one text
        gram = np.unique(gram * (kinds + 1) + ids[k : k + n], return_inverse=True)[1]
    first = np.full(int(gram.max()) + 1, n, dtype=np.int64)
    np.minimum.at(first, gram, np.arange(n))
    again = np.flatnonzero((first[gram] < np.arange(n)) & (owners[:n] == owners[STRETCH - 1 :]))
    np.add.at(marks, starts[again], 1)
    np.add.at(marks, ends[again + STRETCH - 1], -1)
    near = again[1:][(np.diff(again) == STRETCH) & (owners[again[1:]] == owners[again[:-1]])]  # right after another one: what stands between belongs to both
    np.add.at(marks, ends[near - 1], 1)
    np.add.at(marks, starts[near], -1)


def _runs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, owners: np.ndarray, marks: np.ndarray) -> None:
    """Marks a word that follows itself FOLLOWS times or more, whatever stands between."""
    change = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (owners[1:] != owners[:-1]), True])
    long = np.flatnonzero(np.diff(change) > FOLLOWS)
    np.add.at(marks, ends[change[long]], 1)
    np.add.at(marks, ends[change[long + 1] - 1], -1)


def _strings(codes: np.ndarray, after: np.ndarray, marks: np.ndarray) -> None:
    """Marks any string that follows itself FOLLOWS times or more, for every length of string.

    A run of FOLLOWS + 1 copies of length p holds FOLLOWS - 1 pairs of equal neighbouring blocks, one after another, of any cutting
    into blocks of p. So only those pairs are compared, by prefix hashes: n / p of them for each p, n log n in all. Where so many
    follow one another, the run's ends are found by halving and the run is spelt out, unless a shorter string's run covers it
    already, so a text of one letter costs no more than another.
    """
    n, longest = len(codes), int(np.diff(after, prepend=0).max()) - 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _MIX | np.uint64(1), dtype=np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * (codes + np.uint64(0x51ED270B)) * powers[:-1])]
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for p in range(1, longest // (FOLLOWS + 1) + 1):
            block = np.diff(sums[::p])
            equal = block[:-1] * powers[p] == block[1:]
            if np.count_nonzero(equal) < FOLLOWS - 1:
                continue
            edge = np.flatnonzero(np.diff(np.r_[False, equal, False].astype(np.int8)))
            first, last = edge[::2], edge[1::2]  # blocks first..last are equal, one after another
            many = last - first >= FOLLOWS - 1
            if many.any():
                found.append((p, first[many] * p, (last[many] + 1) * p))
        covered: tuple[list[int], list[int]] = ([], [])  # starts and ends of what is marked, apart and in order
        for p, a, b in found:
            end = np.minimum(after[np.searchsorted(after, a, side="right")] - 1, b + p)  # the run ends here at the latest
            rest = [k for k, (x, y) in enumerate(zip(np.maximum(a, p).tolist(), end.tolist())) if (i := bisect_right(covered[0], x)) == 0 or covered[1][i - 1] < y]
            a, b = a[rest], b[rest]
            for lo, hi in zip(_back(sums, powers, a, p).tolist(), _on(sums, powers, b, p, n).tolist()):
                k = bisect_right(covered[0], lo + p) - 1
                if hi - lo < (FOLLOWS + 1) * p or k >= 0 and hi <= covered[1][k] or not np.array_equal(codes[lo : hi - p], codes[lo + p : hi]):
                    continue
                lo += p  # the first copy does not count
                marks[lo] += 1
                marks[hi] -= 1
                i = k if k >= 0 and covered[1][k] >= lo else k + 1
                j = bisect_right(covered[0], hi)
                if i < j:
                    lo, hi = min(lo, covered[0][i]), max(hi, max(covered[1][i:j]))
                covered[0][i:j], covered[1][i:j] = [lo], [hi]


def _back(sums: np.ndarray, powers: np.ndarray, a: np.ndarray, p: int) -> np.ndarray:
    """Where the runs of period p around a begin: how far before a, at most p, each code equals the one p later."""
    low, high = np.zeros_like(a), np.minimum(a, p)
    while (low < high).any():
        mid = (low + high + 1) // 2
        s = a - mid
        fits = (sums[a] - sums[s]) * powers[p] == sums[a + p] - sums[s + p]
        low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
    return a - low


def _on(sums: np.ndarray, powers: np.ndarray, b: np.ndarray, p: int, n: int) -> np.ndarray:
    """Where the runs of period p that go up to b end: how far from b on, at most p, each code equals the one p earlier."""
    low, high = np.zeros_like(b), np.minimum(n - b, p)
    while (low < high).any():
        mid = (low + high + 1) // 2
        e = b + mid
        fits = (sums[e - p] - sums[b - p]) * powers[p] == sums[e] - sums[b]
        low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
    return b + low


def measured(texts: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``n_chars`` and ``n_repeated`` instead of the text. Only key columns should come along."""
    keep = [f for f in texts.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "n_chars int, n_repeated int"])

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            values = batch.column(text).to_pylist()
            return {f.name: batch.column(f.name) for f in keep} | {
                "n_chars": [len(v or "") for v in values],
                "n_repeated": all_repeated(values),
            }

        return work

    return map_batches(texts, schema, make)


def host_verdicts(docs: DataFrame, host: str, threshold: float = 1 / 3) -> DataFrame:
    """Per host: rule failures, and the failure rate shrunk towards that of all hosts.

    ``docs`` needs the host, ``n_chars`` and ``n_repeated``. Two rules: a share of at least ``threshold``, and one of at least
    half of it. A null host is a host of its own.
    """
    share = F.when(F.col("n_chars") > 0, F.col("n_repeated") / F.col("n_chars")).otherwise(0.0)
    per = docs.groupBy(host).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(share >= threshold).alias("failures"),
        F.count_if(share >= threshold / 2).alias("near_failures"),
    )
    rate = F.col("failures") / F.col("texts")
    prior = per.agg((F.sum("failures") / F.sum("texts")).alias("mean"), F.var_samp(rate).alias("spread"), F.avg(1 / F.col("texts")).alias("noise"))
    m, v = F.col("mean"), F.coalesce("spread", F.lit(0.0)) - F.col("mean") * (1 - F.col("mean")) * F.col("noise")
    weight = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(F.lit(100.0))
    return (
        per.crossJoin(F.broadcast(prior.select("mean", weight.alias("weight"))))  # one row
        .withColumn("rate", (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("texts") + F.col("weight")))
        .withColumn("bad_host", (F.col("rate") > 2 * F.col("mean")) & (F.col("failures") > 0))
        .drop("mean", "weight")
    )


def with_shares(docs: DataFrame, threshold: float = 1 / 3) -> DataFrame:
    """:func:`measured` documents with ``share`` and ``repeats``, the verdict on their own share. Null and empty texts have a share of 0 and don't repeat."""
    share = F.when(F.col("n_chars") > 0, F.col("n_repeated") / F.col("n_chars")).otherwise(0.0)
    return docs.withColumn("share", share).withColumn("repeats", (F.col("n_chars") > 0) & (F.col("n_repeated") >= threshold * F.col("n_chars")))


def judged(docs: DataFrame, host: str, threshold: float = 1 / 3) -> DataFrame:
    """Each document with its share, its own verdict ``repeats``, and its host's shrunken ``rate`` and verdict ``bad_host``."""
    docs = cut_lineage(docs)  # measured once; the rows hold no text
    verdicts = host_verdicts(docs, host, threshold).withColumnRenamed(host, "_host").select("_host", "rate", "bad_host")
    return with_shares(docs.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host"), threshold)
