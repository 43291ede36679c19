"""Periodic runs of words: stretches that repeat with a period at least four times, found over a harmonic grid.

A run is a stretch of consecutive words with least period q and at least max(LEAST, TIMES * q) words that no neighbouring word
extends with that period. For each period p, neighbouring grid places jp and (j + 1)p are queried for their longest common
extensions forward and backward; a run of period p holds two such places, so that the two extensions of one pair span it.
An extension is the least value between two ranks of a suffix array's common prefixes (range minimum over a sparse table);
backward ones come from the same arrays of the reversed words. A pair whose words differ extends by nothing and needs no query.

Texts are worked on as a few at a time, with words numbered per text so that none matches another text's. Over n words that
makes about n ln n pairs in all; each text is whole in one task, at some 300 bytes of memory a word for the longest text.

Cases: null and empty texts have no words and no run; every row is judged by its own text, so repeated and null doc_ids have a row each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm.lz_dedup import split_words

LEAST, TIMES = 6, 4
#: Words that are worked on together, and grid pairs that are queried together.
TOGETHER, PAIRS = 1 << 17, 1 << 20


class Extensions:
    """Longest common extensions between any two places of one array of non-negative numbers."""

    def __init__(self, symbols: np.ndarray):
        order, self.rank, levels = self._sorted(symbols)
        common = np.zeros(len(order), np.int32)
        a, b = order[:-1].copy(), order[1:].copy()
        # Places of equal rank at a level agree in as many symbols as the level is long.
        for size, level in reversed(levels):
            inside = np.flatnonzero((a < len(order)) & (b < len(order)))
            equal = inside[level[a[inside]] == level[b[inside]]]
            common[equal + 1] += size
            a[equal] += size
            b[equal] += size
        self.least = [common]
        while (width := 1 << len(self.least)) <= len(common):
            below = self.least[-1]
            self.least.append(np.minimum(below[: len(common) - width + 1], below[width // 2 : len(common) - width // 2 + 1]))

    @staticmethod
    def _sorted(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Suffixes in order, their ranks, and the ranks of all stretches of 1, 2, 4, ... symbols until no two are equal.

        Only suffixes that share a rank are sorted again.
        """
        n = len(symbols)
        order = np.argsort(symbols, kind="stable")
        fresh = np.concatenate([[True], np.diff(symbols[order]) != 0])[:n]
        levels, size = [], 1
        while True:
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            rank = np.empty(n, np.int32)
            rank[order] = start
            shared = np.flatnonzero(~(fresh & np.concatenate([fresh[1:], [True]])[:n]))
            if not len(shared):
                return order, rank, levels
            levels.append((size, rank))
            at = order[shared]
            after = np.where(at + size < n, rank[np.minimum(at + size, n - 1)] + 1, 0)
            key = rank[at].astype(np.int64) * (n + 1) + after
            by = np.argsort(key, kind="stable")
            order[shared] = at[by]
            fresh = np.ones(n, bool)
            fresh[shared[1:]] = np.diff(key[by]) != 0
            size *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of different places a and b, pair by pair."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level = np.frexp(high - low)[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            out[own] = np.minimum(self.least[k][low[own]], self.least[k][high[own] - (1 << k)])
        return out


def _grid(symbols: np.ndarray, longest: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, place) of neighbouring grid places that hold the same symbol, some periods at a time."""
    periods, places, waiting = [], [], 0
    for p in range(1, longest // times + 1):
        grid = symbols[::p]
        at = np.flatnonzero(grid[:-1] == grid[1:])
        if len(at):
            periods.append(np.full(len(at), p, np.int64))
            places.append(at * p)
            waiting += len(at)
        if waiting >= PAIRS:
            yield np.concatenate(periods), np.concatenate(places)
            periods, places, waiting = [], [], 0
    if waiting:
        yield np.concatenate(periods), np.concatenate(places)


def runs_of(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Texts as lists of words -> for each an array of its runs (start, length, period), by start, then period."""
    sizes = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(sizes + 1)
    starts, out = ends - sizes - 1, [np.zeros((0, 3), np.int64)] * len(texts)
    # Each text's words have numbers of their own, and a number that occurs once ends it.
    symbols, used = np.empty(int(ends[-1]) if len(texts) else 0, np.int64), 0
    for words, start in zip(texts, starts.tolist(), strict=True):
        ids: dict = {}
        symbols[start : start + len(words)] = [ids.setdefault(w, len(ids)) for w in words]
        symbols[start : start + len(words)] += used
        symbols[start + len(words)] = used + len(ids)
        used += len(ids) + 1
    if not len(symbols) or int(sizes.max()) < least:
        return out
    forward = backward = None
    found = []
    for period, place in _grid(symbols, int(sizes.max()), times):
        if forward is None:
            forward, backward = Extensions(symbols), Extensions(symbols[::-1])
        ahead = forward(place, place + period)
        # Extensions backward end before the two places.
        n = len(symbols)
        before = np.zeros(len(place), np.int64)
        inner = np.flatnonzero(place > 0)
        before[inner] = backward(n - place[inner], n - place[inner] - period[inner])
        length = before + ahead + period
        kept = length >= np.maximum(least, times * period)
        found.append(np.unique(np.stack([place[kept] - before[kept], length[kept], period[kept]], axis=1), axis=0))
    if not found:
        return out
    every = np.unique(np.concatenate(found), axis=0)
    # One stretch has several periods: the least is its own.
    every = every[np.unique(every[:, :2], axis=0, return_index=True)[1]]
    of = np.searchsorted(starts, every[:, 0], "right") - 1
    every[:, 0] -= starts[of]
    for k in np.unique(of).tolist():
        own = every[of == k]
        out[k] = own[np.lexsort((own[:, 2], own[:, 0]))]
    return out


def collapsed(words: list, runs: np.ndarray) -> list:
    """The words left when each run keeps one period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    gone = np.cumsum(steps[:-1]) > 0
    return [w for w, x in zip(words, gone.tolist(), strict=True) if not x]


_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def _found_rows(least: int, times: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, held = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split_words(text)
                if held and held + len(words) > TOGETHER:
                    yield _found_batch(ids, texts, least, times)
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(words)
                held += len(words)
            yield _found_batch(ids, texts, least, times)

    return rows


def _found_batch(ids: list[int], texts: list[list[bytes]], least: int, times: int) -> pa.RecordBatch:
    runs, kept = [], []
    for words, own in zip(texts, runs_of(texts, least, times), strict=True):
        runs.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in own.tolist()])
        kept.append(b" ".join(collapsed(words, own)).decode("utf-8", "surrogatepass"))
    columns = ((ids, pa.int64()), (runs, pa.list_(_RUN)), (kept, pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs -> (doc_id, runs: array of (start, length, period) by start, then period, collapsed: the words left, joined by one space).

    times must be 2 or more, so that a run holds two places of its period's grid.
    """
    if times < 2:
        raise ValueError("times must be 2 or more")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(_found_rows(least, times), "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest_run(runs):
    """Of a column of runs, the one of greatest length; ties to the least start, then period. Null without runs."""
    return F.get(F.array_sort(F.transform(runs, lambda x: F.struct((-x["length"]).alias("less"), x["start"].alias("start"), x["period"].alias("period")))), F.lit(0))
