"""Periodic runs of words: stretches that repeat a period several times, found by LCE queries on a harmonic grid.

A run of period q and at least `exponent` periods covers a grid place i that is a multiple of (exponent - 1) q, and the word q
further on; it reaches as far back and forth from there as the text agrees with itself shifted by q. So a text of n words needs
n log n / (exponent - 1) questions how far the suffixes (and the reversed prefixes) of two places agree.

These longest common extensions come from a difference cover: for any two places there is a shift below WINDOW after which both are
sampled. Only sampled suffixes are sorted (by doubling blocks of WINDOW words), neighbours' common blocks go into a sparse table, and
a question compares the words before the samples, asks the table, and compares the words of the first different block.

Each batch of texts is one sequence of word numbers with an own mark after each text, so numpy answers all questions of a batch together.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohort.llm.common import map_texts, named

# fixed values: the differences of the cover's places give every remainder
WINDOW = 13
COVER = (0, 1, 3, 9)
QUESTIONS = 1 << 20     # grid places that are asked for at once
FIELDS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _shifts() -> np.ndarray:
    """For two remainders the least shift that brings both places into the cover."""
    a, b, d = np.meshgrid(*[np.arange(WINDOW)] * 3, indexing="ij")
    there = np.isin((a + d) % WINDOW, COVER) & np.isin((b + d) % WINDOW, COVER)
    return there.argmax(axis=2)


SHIFTS = _shifts()
SLOT = np.searchsorted(COVER, np.arange(WINDOW))   # of a sampled remainder within its block


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
    return out


class Extensions:
    """Longest common extensions of places in a sequence of non-negative numbers whose last one occurs nowhere else."""

    def __init__(self, words: np.ndarray):
        n, top = len(words), int(words.max(initial=0)) + 1
        blocks = n // WINDOW + 2
        more = blocks * WINDOW + WINDOW - n
        self.words = np.concatenate([words, top + np.arange(more)])   # numbers of their own behind the end
        places = (np.arange(blocks)[:, None] * WINDOW + np.array(COVER)).ravel()
        rank = self._blocks(places, int(top + more).bit_length())
        levels, step, m = [rank], len(COVER), len(places)
        while rank.max() + 1 < m and step < m:
            after = np.full(m, -1, np.int64)
            after[:m - step] = rank[step:]
            rank = _ranks(rank * (m + 1) + after + 1)
            levels.append(rank)
            step *= 2
        self.rank = rank
        self._table(np.argsort(rank), levels)

    def _blocks(self, places: np.ndarray, bits: int) -> np.ndarray:
        """Ranks of the WINDOW words from each place, as many words at a time as a number holds."""
        rank, used = np.zeros(len(places), np.int64), 0
        while used < WINDOW:
            take = max(1, min(WINDOW - used, (62 - int(rank.max()).bit_length()) // bits))
            for k in range(used, used + take):
                rank = (rank << bits) | self.words[places + k]
            rank, used = _ranks(rank), used + take
        return rank

    def _table(self, order: np.ndarray, levels: list[np.ndarray]) -> None:
        """Sparse table of the common blocks of neighbours among the sorted samples."""
        a, b, m = order[:-1].copy(), order[1:].copy(), len(order)
        common = np.zeros(m - 1, np.int32)
        for k in reversed(range(len(levels))):
            ahead = np.append(levels[k], -1)
            same = ahead[np.minimum(a, m)] == ahead[np.minimum(b, m)]
            same &= np.maximum(a, b) < m
            common[same] += 1 << k
            a[same] += len(COVER) << k
            b[same] += len(COVER) << k
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            low, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-half], low[half:]))

    def _common_blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common blocks of two different sampled places each."""
        a, b = (self.rank[(p // WINDOW) * len(COVER) + SLOT[p % WINDOW]] for p in (i, j))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << int(k))])
        return out

    def _same_words(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to a limit of WINDOW at most."""
        out, on = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(int(limit.max(initial=0))):
            on = on[limit[on] > k]
            on = on[self.words[i[on] + k] == self.words[j[on] + k]]
            out[on] += 1
        return out

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from place i on equal those from place j on, i < j."""
        shift = SHIFTS[i % WINDOW, j % WINDOW]
        out = self._same_words(i, j, shift)
        on = np.flatnonzero(out == shift)
        i, j = i[on] + shift[on], j[on] + shift[on]
        whole = self._common_blocks(i, j) * WINDOW
        out[on] += whole + self._same_words(i + whole, j + whole, np.full(len(on), WINDOW))
        return out


def _grid(sizes: np.ndarray, starts: np.ndarray, exponent: int, shortest: int):
    """Chunks (text, period, place) of the harmonic grids of all texts."""
    most = np.where(sizes >= shortest, sizes // exponent, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (sizes[text] - 1 - period) // ((exponent - 1) * period) + 1
    ends = np.cumsum(places)
    first = 0
    while first < len(text):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + QUESTIONS, "right")))
        n, q = places[first:last], period[first:last]
        own = np.repeat(np.arange(last - first), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield text[first:last][own], q[own], starts[text[first:last]][own] + k * ((exponent - 1) * q)[own]
        first = last


def runs_of(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, exponent: int = 4, shortest: int = 6) -> np.ndarray:
    """Rows (text, start in the sequence, length, period) of all runs of texts, by start, then period.

    words: numbers of the words of all texts, each text followed by a number that occurs once.
    """
    none = np.zeros((0, 4), np.int64)
    if not (sizes >= shortest).any():
        return none
    n, ahead, back, found = len(words), None, None, []
    for text, q, i in _grid(sizes, starts, exponent, shortest):
        same = words[i] == words[i + q]
        text, q, i = text[same], q[same], i[same]
        if not len(i):
            continue
        if ahead is None:
            ahead, back = Extensions(words), Extensions(np.concatenate([words[:-1][::-1], words[-1:]]))
        end = i + q + ahead.common(i, i + q)
        # the reversed sequence reads the words before a place, up to the mark of the text before
        start = i + 1 - back.common(n - 2 - (i + q), n - 2 - i)
        keep = end - start >= np.maximum(shortest, exponent * q)
        found.append(np.stack([text[keep], start[keep], (end - start)[keep], q[keep]], axis=1))
    all_runs = np.concatenate(found or [none])
    # a stretch found by several places and by multiples of its period counts once, with its smallest period
    all_runs = all_runs[np.lexsort((all_runs[:, 3], all_runs[:, 2], all_runs[:, 1]))]
    fresh = np.ones(len(all_runs), bool)
    fresh[1:] = (all_runs[1:, 1:3] != all_runs[:-1, 1:3]).any(axis=1)
    all_runs = all_runs[fresh]
    return all_runs[np.lexsort((all_runs[:, 3], all_runs[:, 1]))]


def measure(texts: list[bytes], exponent: int = 4, shortest: int = 6) -> list:
    """Columns of FIELDS for UTF-8 texts."""
    split = [t.split() for t in texts]
    number = defaultdict(count().__next__)
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    words = np.empty(int((sizes + 1).sum()), np.int64)
    for at, own in zip(starts.tolist(), split):
        words[at:at + len(own)] = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
    words[starts + sizes] = len(number) + np.arange(len(split))
    found = runs_of(words, starts, sizes, exponent, shortest) if len(words) else np.zeros((0, 4), np.int64)
    edges = np.bincount(found[:, 1] + found[:, 3], minlength=len(words) + 1) - np.bincount(found[:, 1] + found[:, 2], minlength=len(words) + 1)
    kept = np.cumsum(edges) == 0
    runs: list[list] = [[] for _ in texts]
    for text, start, length, period in found.tolist():
        runs[text].append({"start": start - int(starts[text]), "length": length, "period": period})
    collapsed = [b" ".join(own if not mine else [w for w, k in zip(own, kept[at:at + len(own)].tolist()) if k])
                 for own, mine, at in zip(split, runs, starts.tolist())]
    return [pa.array(sizes), pa.array(runs, pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))),
            pa.array(collapsed, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = 4, shortest: int = 6) -> DataFrame:
    """(id, n_words, runs, collapsed) of every row; words are separated by white space and compared as they are.

    A run is a stretch of words with smallest period q and at least max(shortest, exponent * q) words that no neighbouring word
    extends with period q; runs are given by start, then period. collapsed is the text without the words that any run holds after
    its first q words, joined by single spaces. Null and empty texts have no words and no runs. Repeated rows stay repeated, null ids
    have rows too, other columns are not read, an empty table gives an empty table. Texts are processed whole; one text is
    one task's work, about 500 bytes of memory a word.
    """
    if exponent < 2 or shortest < 2:
        raise ValueError("a run has at least two periods and two words")
    return map_texts(docs, id_col, text_col, lambda texts: measure(texts, exponent, shortest), FIELDS)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 10) -> DataFrame:
    """(id, text): in one of so many documents, by the crc32 h of the id, the words from the g mod n-th on (g = h / parts) repeat
    their first 1 + (words left) / (3 + g mod 8). Rows without an id or words stay as they are."""
    h = F.crc32(named(id_col).cast("string"))
    told = docs.select(named(id_col), named(text_col).cast("string").alias("text"), F.floor(h / parts).alias("g"), (h % parts == 0).alias("hit"))
    words = told.withColumn("words", F.when(F.col("hit"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))).withColumn("n", F.size("words"))
    first = words.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    left = F.col("n") - F.col("a")
    sized = first.withColumn("p", (1 + F.floor(left / (3 + F.col("g") % 8))).cast("int"))
    turns = F.ceil(left / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), turns)), F.lit(1), left)
    return sized.select(named(id_col), F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " ")).otherwise(
        F.col("text")).alias(text_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of periodic_runs: the number of runs, the longest one (ties: smallest start, then period), and digests."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("best", best)
    return out.select(
        named(id_col), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"), F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
