"""Periodic runs of words, by seeds and diagonals, and texts with the repetitions of their runs left out.

A run is a stretch of consecutive words of smallest period q, at least max(least, 2q) words long, that no neighbouring word
extends. Words q apart are equal on its first length - q places, which are a stretch of the diagonal of lag q. That
stretch holds at least max(least - q, q) places, so lags are taken in bands [k, 2k), k = least / 2, least, 2 least, ... (the
first from 1), and every run of a band shows as two equal k-grams at its lag. Grams are indexed by hash, places that share one are
enumerated up to the band's largest lag, and words are compared one by one from the first seed of every stretch; a table
of the furthest place covered at each lag keeps other seeds of the same stretch from being extended again.

Grams that lie in a known run of period at most k/2 recur at every period. Such places only are seeds where the
run of one of the two begins: further left the words would be equal as well, so every stretch still has its first place.
That keeps the seeds of a band within a small multiple of n log n, whatever the words.

Texts that are null or without words have no run and an empty collapsed text. Rows are treated one by one, so repeated rows
give repeated results; an empty table gives an empty table. A kept column named `runs`, `collapsed` or `n_words` gives way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from modelwarden.llm.common import over_texts

#: Words that a run has at least.
LEAST = 12
#: An odd base of the rolling hash, and the multiplier that spreads word numbers over 64 bits.
BASE, SPREAD = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of base modulo 2**64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Grams:
    """Hashes of any stretch of words, from sums of words times powers modulo 2**64; unequal hashes mean unequal words."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(SPREAD)
        mixed ^= mixed >> np.uint64(29)
        self.inverse = powers(pow(BASE, -1, 2**64), n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * powers(BASE, n), dtype=np.uint64)])

    def of(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.inverse[at]


def ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, member) of all members of the ranges [first, last)."""
    size = np.maximum(last - first, 0)
    which = np.repeat(np.arange(len(first)), size)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + first[which]


def near_pairs(group: np.ndarray, place: np.ndarray, run: np.ndarray, begins: np.ndarray, low: int, high: int, n: int):
    """(left, right) places of one group that may begin a stretch of a lag in [low, high); group and place ascend."""
    left, right = [], []
    free = np.flatnonzero(run < 0)
    g, p = group[free], place[free]
    step = 1
    while step < len(p):
        near = (g[step:] == g[:-step]) & (p[step:] - p[:-step] < high)
        if not near.any():
            break
        left.append(p[:-step][near])
        right.append(p[step:][near])
        step += 1
    heads = np.flatnonzero((run >= 0) & begins)
    if len(heads):
        key = group * (n + 1) + place
        base = group[heads] * (n + 1)
        after = ranges(np.searchsorted(key, base + np.minimum(place[heads] + low, n)),
                       np.searchsorted(key, base + np.minimum(place[heads] + high, n)))
        before = ranges(np.searchsorted(key, base + np.maximum(place[heads] - high + 1, 0)),
                        np.searchsorted(key, base + np.maximum(place[heads] - low + 1, 0)))
        for (which, other), forward in ((after, True), (before, False)):
            apart = run[heads[which]] != run[other]
            mine, theirs = place[heads[which][apart]], place[other[apart]]
            left.append(mine if forward else theirs)
            right.append(theirs if forward else mine)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    fits = right - left >= low
    return left[fits], right[fits]


def equal_from(words: np.ndarray, at: int, lag: int) -> int:
    """The first place from `at` on whose word differs from the one `lag` further."""
    step = 64
    end = len(words) - lag
    while at < end:
        stop = min(at + step, end)
        differ = words[at:stop] != words[at + lag : stop + lag]
        if differ.any():
            return at + int(differ.argmax())
        at, step = stop, min(step * 2, 1 << 20)
    return end


def find(words: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period.

    `words` are numbers of words, texts one after the other, each text followed by a number that occurs nowhere else; `owner`
    is the text of every place.
    """
    n = len(words)
    grams = Grams(words)
    end = np.searchsorted(owner, owner, side="right") - 1  # the place of the number that ends the text
    runs: dict[tuple[int, int], int] = {}
    k, low = (least + 1) // 2, 1
    places = np.flatnonzero(np.arange(n) + k <= end)
    while len(places):
        key = grams.of(places, k) + owner[places].astype(np.uint64) * np.uint64(SPREAD)
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        shared = same[1:] | same[:-1]
        group, places = np.cumsum(~same[:-1])[shared], places[shared]
        if not len(places):
            break
        inside = np.full(n, -1, np.int64)
        first = np.zeros(n, bool)
        for number, ((start, stop), period) in enumerate(runs.items()):
            if 2 * period <= k <= stop - start:
                inside[start : stop - k + 1] = number
                first[start] = True
        left, right = near_pairs(group, places, inside[places], first[places], low, 2 * k, n)
        lag = right - left
        ok = (owner[left] == owner[right]) & (words[left] == words[right])
        seed = np.unique(lag[ok] * n + left[ok])
        seed = seed[np.concatenate([[True], seed[1:] != seed[:-1] + 1])] if len(seed) else seed
        lag, left = seed // n, seed % n
        need = np.maximum(least - lag, lag)
        fits = left + lag + need <= end[left]
        lag, left, need = lag[fits], left[fits], need[fits]
        square = grams.of(left, need) == grams.of(left + lag, need)
        furthest: dict[int, int] = {}
        for q, start, size in zip(lag[square].tolist(), left[square].tolist(), need[square].tolist()):
            if start < furthest.get(q, 0):
                continue
            furthest[q] = stop = equal_from(words, start, q)
            if stop - start >= size:
                runs.setdefault((start, stop + q), q)  # lags ascend, so the smallest period of a stretch comes first
        again = np.zeros(n + k, bool)
        again[places] = True
        places = np.sort(places)
        places = places[again[places + k] & (places + 2 * k <= end[places])]
        k, low = 2 * k, 2 * k
    return sorted((start, stop - start, period) for (start, stop), period in runs.items())


def numbered(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(words, their numbers with an end number after each text, text of each number, number of words of each text)."""
    split = [(t or b"").split() for t in texts]  # bytes split at \x20 and \x09 to \x0D only
    sizes = np.array([len(s) for s in split], np.int64)
    flat = [w for s in split for w in s]
    codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    ends = np.cumsum(sizes + 1) - 1
    words = np.empty(len(owner), np.int64)
    body = np.ones(len(owner), bool)
    body[ends] = False
    words[body] = codes
    words[ends] = len(flat) + np.arange(len(texts))
    return flat, words, owner, sizes


def runs_and_rest(texts: list[bytes | None], least: int) -> list[pa.Array]:
    flat, words, owner, sizes = numbered(texts)
    first = np.cumsum(sizes + 1) - sizes - 1  # place of the first word among the numbers
    runs: list[list[dict]] = [[] for _ in texts]
    dropped = np.zeros(len(words), bool)
    for start, length, period in find(words, owner, least):
        mine = int(owner[start])
        runs[mine].append({"start": start - int(first[mine]), "length": length, "period": period})
        dropped[start + period : start + length] = True
    rest = []
    for i, size in enumerate(sizes.tolist()):
        at = int(first[i]) - i
        mine = flat[at : at + size]
        if runs[i]:
            gone = dropped[first[i] : first[i] + size].tolist()
            mine = [w for w, out in zip(mine, gone) if not out]
        rest.append(b" ".join(mine))
    return [pa.array(sizes), pa.array(runs, pa.list_(RUN)), pa.array(rest, pa.binary()).cast(pa.string())]


def periodic_runs(docs: DataFrame, keep: list[str], least: int = LEAST) -> DataFrame:
    """The columns `keep` of every row with n_words, its runs (by start, then period) and the collapsed text.

    `collapsed` holds the words joined by one space, without those that a run contains after its first period.
    """
    outputs = StructType.fromDDL(
        "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return over_texts(docs, keep, outputs, lambda texts: runs_and_rest(texts, least))
