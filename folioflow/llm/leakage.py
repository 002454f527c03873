"""Evaluation texts leaking into training text.

Pages and passages become streams of letters without case, accents, line breaks, hyphens and punctuation. Pages are read down
their columns by the boxes of their lines. Windows of the size of a few words start at every word of pages and passages. For
the search, letters that scans take for each other share a class, the CGK random walk embeds a window of classes so that a small
edit distance becomes a small Hamming distance, and repeated bit sampling of the embedding looks the pages' windows up among the
passages'. Each pair of page and passage that meets in four windows (MEETINGS) is aligned by a walk along the passage, which may
step over any number of lines of adverts. It is verified by the exact edit distance of the letters themselves, not of their
classes, and the consecutive words that the page holds are counted.

Scripts without spaces have a word for every two letters, and windows start at every letter. The passages are a fixed suite: they
are collected in parts of a checked size, and every task gets the windows of a part. Pages are mapped where they lie; nothing is
shuffled but the found pairs. A window that many passages share leads to as many pairs only if the page leaks them all.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.arrow import cut_lineage, map_batches

MIN_WORDS = 12
WINDOW = 24  # letters of a window, about five words
STEPS = 2 * WINDOW  # of the random walk: each step moves on by one letter with probability 1/2
WALKS, BANDS, SAMPLED = 2, 3, 9  # walks, bit samples of each walk, places of the embedding in each sample
MEETINGS = 4  # windows of a passage that a page must meet; a run of MIN_WORDS words has about eight
MOST_PASSAGES = 50_000  # of a part of the suite: the checked bound of what is sent to every task
MOST_EDITS = 0.4  # of the letters of a passage's words that are found
#: Classes of letters that scans take for each other.
ALIKE = ("aoec0gq9", "tfs5", "nu", "rv", "il1j", "hb6")
GAP = re.compile(r" {3,}")
_MULTI = (("vv", "w"), ("rn", "m"), ("li", "h"), ("cl", "d"), ("ii", "u"), ("in", "m"))


SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{SPACELESS}]{{1,2}}|[^\s{SPACELESS}]+")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 0x3000 its class (0: no letter or digit) and its letter, in small and without accents."""
    import unicodedata

    classes = {c: i + 1 for i, group in enumerate(ALIKE) for c in group}
    for c in "abcdefghijklmnopqrstuvwxyz0123456789":
        classes.setdefault(c, len(set(classes.values())) + 1)
    out, base = np.zeros(0x3000, dtype=np.uint8), np.arange(0x3000, dtype=np.uint32)
    for code in range(0x3000):
        ch = chr(code)
        if ch.isalnum():
            letter = unicodedata.normalize("NFD", ch.lower())[:1]
            letter = "s" if letter == "ſ" else letter
            out[code], base[code] = classes.get(letter, 31 + code % 32), ord(letter)
    return out, base


def folded(text: str, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all code points, 0 for what is no letter or digit; their letters; whether they are of a script without spaces)

    From 0x3000 on every sign counts but punctuation, as its own letter, and classes are spread over the signs.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    small = np.minimum(codes, len(tables[0]) - 1)
    low = codes < len(tables[0])
    sign = ((codes < 0x3000) | (codes > 0x303F)) & ((codes < 0xFE30) | (codes > 0xFE6F)) & ((codes < 0xFF00) | (codes > 0xFF0F))
    classes = np.where(low, tables[0][small], np.where(sign, 31 + codes % 32, 0)).astype(np.uint8)
    spaceless = (codes >= 0x0E00) & ((codes < 0x0F00) | (codes >= 0x1000) & (codes < 0x10A0) | (codes >= 0x1780) & (codes < 0x1800) | (codes >= 0x3040) & ((codes < 0xAC00) | (codes >= 0xF900) & (codes < 0xFB00) | (codes >= 0x20000)))
    return classes, np.where(low, tables[1][small], codes), spaceless


def followed(classes: np.ndarray, letters: np.ndarray) -> memoryview:
    """What the walk compares: classes, but from 0x3000 on the letters themselves."""
    return memoryview(np.where(letters < 0x3000, classes, letters).astype(np.uint32))


def edit_distance(a: list[int], b: list[int]) -> int:
    """Exact, by whole columns of the distance table at once, held in the bits of two numbers."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0
    for c in b:
        same = where.get(c, 0)
        x = same | down
        flat = (((same & up) + up) ^ up) | same
        right, left = down | ~(flat | up) & full, up & flat
        score += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ~(x | right) & full, right & x
    return score


def reading_order(texts: list[str], xs: list, ys: list) -> tuple[str, np.ndarray, np.ndarray]:
    """All pages as one string of cells in reading order, a line feed after each; starts of cells and the page of each.

    Lines whose text holds two columns are cut at their wide gaps. Columns are the clusters of the lines' left edges; pages whose
    boxes don't match their lines keep the order of their text.
    """
    cells, page, col, row = [], [], [], []
    for p, (text, x, y) in enumerate(zip(texts, xs, ys)):
        lines = text.split("\n")
        boxed = x is not None and len(x) == len(lines) and None not in x and None not in y
        if boxed:
            edges = sorted(set(x))
            column, k, before = {}, 0, edges[0]
            for e in edges:
                k += e - before > 120
                column[e], before = k, e
            order = sorted(range(len(lines)), key=lambda i: (column[x[i]], y[i]))
            columns = [column[e] for e in x]
        else:
            order, columns = range(len(lines)), [0] * len(lines)
        for i in order:
            line = lines[i]
            if "   " in line:
                for j, part in enumerate(GAP.split(line)):
                    cells.append(part), page.append(p), col.append(columns[i] + j), row.append(len(row))
            else:
                cells.append(line), page.append(p), col.append(columns[i]), row.append(len(row))
    at = np.lexsort((row, col, page))
    pages = np.array(page, dtype=np.int64)[at]
    cells = [cells[i] for i in at]
    starts = np.cumsum(np.r_[0, [len(c) + 1 for c in cells[:-1]]]).astype(np.int64) if cells else np.zeros(0, np.int64)
    return "\n".join([*cells, ""]), starts, pages


class Embedding:
    """CGK random walks and the places that are sampled from them, the same in every task."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.moves = rng.integers(0, 2, size=(WALKS, STEPS, 64)).astype(np.int32)
        self.sampled = [[np.sort(rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(BANDS)] for _ in range(WALKS)]
        self.factors = rng.integers(1, 2**32, size=(WALKS, BANDS, STEPS), dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def keys(self, stream: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of WALKS * BANDS hashes for each window; ``stream`` must go on WINDOW letters and more beyond each start."""
        out = np.zeros((WALKS * BANDS, len(starts)), dtype=np.uint32)
        with np.errstate(over="ignore"):
            for lo in range(0, len(starts), 1 << 15):
                at0 = starts[lo : lo + (1 << 15)].astype(np.int32)
                for w in range(WALKS):
                    at, use = at0.copy(), [{int(j) for j in s} for s in self.sampled[w]]
                    for j in range(STEPS):
                        c = stream[at]
                        for b in range(BANDS):
                            if j in use[b]:
                                out[w * BANDS + b, lo : lo + len(at)] += c * self.factors[w, b, j]
                        at += self.moves[w, j][c]
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x85EBCA6B)
        out ^= out >> np.uint32(13)
        return out


class Passages:
    """The passages' streams and the hash tables of their windows."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.tables, self.embedding = _tables(), Embedding()
        self.items, self.streams, self.letters, self.words = [], [], [], []
        whole: list[np.ndarray] = []
        owners, offsets, pieces, at = [], [], [], 0
        for item, text in rows:
            stream, letters, ends, starts = [], [], [], []
            for word in WORD.findall(text):
                c, l, spaceless = folded(word.lower(), self.tables)
                l, spaceless, c = l[c > 0], spaceless[c > 0], c[c > 0]
                if len(c):
                    at_word = ends[-1] if ends else 0
                    starts += [at_word + k for k in range(len(c)) if not k or spaceless[k]]
                    stream.append(c)
                    letters.append(l)
                    ends.append(at_word + len(c))
            if len(ends) < MIN_WORDS:
                continue
            s = np.concatenate(stream)
            good = np.array([x for x in starts if x + WINDOW <= len(s)], dtype=np.int64)
            owners += [len(self.items)] * len(good)
            offsets += good.tolist()
            pieces += (good + at).tolist()
            at += len(s)
            whole.append(s)
            self.items.append(item)
            self.letters.append(np.concatenate(letters))
            self.streams.append(followed(s, self.letters[-1]))
            self.words.append(np.array(ends))
        whole = np.concatenate([*whole, np.zeros(STEPS, np.uint8)])
        keys = self.embedding.keys(whole, np.array(pieces, dtype=np.int64)) if pieces else np.zeros((WALKS * BANDS, 0), np.uint32)
        self.owners, self.offsets = np.array(owners, dtype=np.int64), np.array(offsets, dtype=np.int64)
        self.sorted, self.seen = [], []
        for k in keys:
            order = np.argsort(k, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[k & np.uint32((1 << 20) - 1)] = True
            self.sorted.append((k[order], order))
            self.seen.append(seen)

    def candidates(self, stream: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into starts, window of the passages) of all windows that share a sampled hash, without repeats."""
        keys = self.embedding.keys(stream, starts)
        left, right = [], []
        for k, (known, order), seen in zip(keys, self.sorted, self.seen):
            near = np.flatnonzero(seen[k & np.uint32((1 << 20) - 1)])
            if not len(near):
                continue
            lo, hi = np.searchsorted(known, k[near], "left"), np.searchsorted(known, k[near], "right")
            n = hi - lo
            near, lo, n = near[n > 0], lo[n > 0], n[n > 0]
            if len(n):
                left.append(np.repeat(near, n))
                right.append(order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.unique(np.concatenate(left) * (len(self.owners) + 1) + np.concatenate(right))
        return pairs // (len(self.owners) + 1), pairs % (len(self.owners) + 1)


def _walk(p: memoryview, q: memoryview, i: int, j: int, step: int, jumps: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """Follows q from j along p from i, in one direction, as far as it goes; (last place reached in q, the stretches of p that were followed).

    A wrong letter may be replaced, dropped or added where the next four letters agree afterwards, as many as one edit in four
    letters. Where that fails near a place in ``jumps``, the walk goes on at the nearest of those places beyond that agrees, however far
    away it is on the page.
    """
    edits, good, start = 0, j, j
    n, m = len(p), len(q)
    stretches, since = [], i

    def same(a: int, b: int, length: int) -> int:
        hits = 0
        for t in range(length):
            x, y = a + step * t, b + step * t
            if not (0 <= x < n and 0 <= y < m):
                return hits if t >= 2 and hits == t and not 0 <= y < m else -1
            hits += p[x] == q[y]
        return hits

    while 0 <= j < m:
        if 0 <= i < n and p[i] == q[j]:
            i, j = i + step, j + step
            good = j
            continue
        done = False
        if edits < 1 + abs(j - start) // 4:
            for di, dj in ((1, 1), (2, 1), (1, 2), (1, 0), (0, 1), (2, 2), (3, 1), (2, 0), (0, 2)):
                if same(i + step * di, j + step * dj, 4) >= 4:
                    i, j, edits, done = i + step * di, j + step * dj, edits + max(di, dj), True
                    good = j
                    break
        if done:
            continue
        if jumps:
            k = bisect_left(jumps, i if step > 0 else i + 1)
            for near in (k, k - 1, k + 1):
                if done or not 0 <= near < len(jumps) or abs(jumps[near] - (i if step > 0 else i + 1)) > 4:
                    continue
                back = (i if step > 0 else i + 1) - jumps[near]  # letters of the advert that happened to agree
                for to in range(near + step, len(jumps) if step > 0 else -1, step):
                    for b in dict.fromkeys((back, 0)):
                        a, c = (jumps[to], j - b) if step > 0 else (jumps[to] - 1, j - b)
                        if 0 <= c < m and same(a, c, 8) >= 7 or 0 <= c < m and (m - c if step > 0 else c + 1) < 8 and same(a, c, 4) >= 4:
                            stretches.append((since, i - step * b))
                            i, j, done, since = a, c, True, a
                            break
                    if done:
                        break
        if not done:
            break
    return good, [*stretches, (since, i)]


def longest_run(page: tuple[memoryview, np.ndarray], passage: tuple[memoryview, np.ndarray], words: np.ndarray, cells: list[int], seeds: list[tuple[int, int]]) -> int:
    """The most consecutive words of the passage that the page holds, from any of the seeds (place in page, place in passage).

    A word at either end counts if two thirds of its letters are reached. The letters of the words and those that were followed
    on the page may differ by an edit distance of MOST_EDITS of their number.
    """
    best, covered = 0, []
    for i, j in seeds:
        if page[0][i] != passage[0][j] or any(a <= j < b and abs((i - j) - d) < 3 for a, b, d in covered):
            continue
        right, after = _walk(page[0], passage[0], i, j, 1, cells)
        left, before = _walk(page[0], passage[0], i - 1, j - 1, -1, cells)
        left = left + 1 if left < j else j
        if right <= j:
            continue
        covered.append((left, right, i - j))
        starts = np.r_[0, words[:-1]]
        inside = np.minimum(words, right) - np.maximum(starts, left)
        run = int((3 * inside >= 2 * (words - starts)).sum())
        if run > max(best, MIN_WORDS - 1):
            read = [x for a, b in reversed(before) for x in page[1][b + 1 : a + 1].tolist()] + [x for a, b in after for x in page[1][a:b].tolist()]
            if edit_distance(passage[1][left:right].tolist(), read) <= MOST_EDITS * (right - left):
                best = run
    return best


def leaks_in(texts: list, xs: list, ys: list, passages: Passages) -> list[tuple[int, int, int]]:
    """(page, passage, consecutive words) of all verified pairs of at least MIN_WORDS words."""
    whole, starts, pages = reading_order([(t or "").lower() for t in texts], xs, ys)
    if not len(starts) or not passages.items:
        return []
    classes, signs, spaceless = folded(whole, passages.tables)
    letters = classes > 0
    place = np.cumsum(letters) - letters  # of each code point in the stream
    stream = np.r_[classes[letters], np.zeros(STEPS + 1, dtype=np.uint8)]
    signs = signs[letters]
    first = letters & (np.r_[True, ~letters[:-1]] | spaceless)
    begins = place[first]
    ends = np.searchsorted(pages, np.arange(len(texts)), side="right")
    bounds = np.r_[0, np.where(ends < len(starts), place[starts[np.minimum(ends, len(starts) - 1)]], letters.sum())]
    near, windows = passages.candidates(stream, begins)
    if not len(near):
        return []
    where = begins[near]
    page = np.searchsorted(bounds, where, side="right") - 1
    owner = passages.owners[windows]
    pair = page * len(passages.items) + owner
    order = np.lexsort((where, pair))
    pair, where, windows = pair[order], where[order], windows[order]
    fresh = np.unique(pair * (len(passages.owners) + 1) + windows) // (len(passages.owners) + 1)
    met, times = np.unique(fresh, return_counts=True)
    enough = np.isin(pair, met[times >= MEETINGS])
    pair, where, windows = pair[enough], where[enough], windows[enough]
    cuts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True]) if len(pair) else np.zeros(1, np.int64)
    cell_at = place[starts]
    out = []
    data = followed(stream[: len(signs)], signs)
    for a, b in zip(cuts[:-1], cuts[1:]):
        p, q = divmod(int(pair[a]), len(passages.items))
        lo, hi = int(bounds[p]), int(bounds[p + 1])
        cells = np.unique(cell_at[np.searchsorted(cell_at, lo) : np.searchsorted(cell_at, hi)]) - lo
        seeds = list(zip((where[a:b] - lo).tolist(), passages.offsets[windows[a:b]].tolist()))
        run = longest_run((data[lo:hi], signs[lo:hi]), (passages.streams[q], passages.letters[q]), passages.words[q], cells.tolist(), seeds)
        if run >= MIN_WORDS:
            out.append((p, q, run))
    return out


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, words)``: each page with the items of which it holds MIN_WORDS or more consecutive words.

    ``items`` are ``(item_id, passage)``; null passages, and passages of fewer words, leak nowhere. Pages without text, or with
    fewer letters than a window, hold nothing. Equal pages come out each with its doc_id; an item that leaks by two passages
    comes out once, with the longer run.
    """
    suite = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    parts = -(-suite.count() // (MOST_PASSAGES // 2)) or 1  # half full on average, so that a part that a hash fills more is within the bound
    part = F.pmod(F.xxhash64("item_id", "passage"), F.lit(parts))
    found = [_leaked_by(documents, suite.where(part == k)) for k in range(parts)]
    return reduce(DataFrame.unionByName, found if parts == 1 else map(cut_lineage, found)).groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _leaked_by(documents: DataFrame, part: DataFrame) -> DataFrame:
    rows = [(r.item_id, r.passage) for r in part.limit(MOST_PASSAGES + 1).collect()]
    if len(rows) > MOST_PASSAGES:
        raise ValueError(f"more than {MOST_PASSAGES} passages in a part")
    rows.sort()

    def make():
        passages = Passages(rows)

        def work(batch: pa.RecordBatch) -> dict:
            keys = batch.column("doc_id").to_pylist()
            found = leaks_in(*(batch.column(c).to_pylist() for c in ("text", "x", "y")), passages)
            return {"doc_id": [keys[p] for p, _, _ in found], "item_id": [passages.items[q] for _, q, _ in found], "words": [w for _, _, w in found]}

        return work

    pages = documents.select("doc_id", "text", F.col("line_boxes.x").alias("x"), F.col("line_boxes.y").alias("y"))
    return map_batches(pages, "doc_id long, item_id long, words int", make)
