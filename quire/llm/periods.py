"""Runs of periodic word sequences by maximal pairs.

A *run* is a stretch of words with smallest period ``q`` that is at least
``2 * q`` (and ``min_length``) words long and that no neighbouring word
extends. A run from ``s`` of length ``n`` is a maximal pair: the words from
``s`` and from ``s + q`` agree for ``n - q`` words, and neither the words
before nor those behind do. A maximal pair of length ``m`` at distance ``q``
is such a stretch exactly when ``q <= m`` and ``m + q >= min_length``, so runs
are read off the pairs without extending anything; a stretch that is found
with several multiples of its period keeps the smallest.

Each text is handled on its own, inside its task:

1. words become numbers; a text in which no sequence of ``min_length / 2``
   words stands twice has no run and is done;
2. suffixes are sorted by prefix doubling, neighbours' common prefixes are
   counted in text order;
3. the tree of LCP intervals is walked bottom-up, only through intervals of
   at least ``min_length / 2`` words. An interval holds its positions in
   order, and the same in lists by the word to their left. When a child joins,
   each position of the smaller side looks up the partners that are near
   enough, in the lists of *other* left words or in the window of all
   positions, whichever is shorter. Children of an interval go on with
   different words, so these are the maximal pairs and no others.

The pairs found number no more than the sum of the runs' exponents, which is
linear in the text, so a text of one word repeated a million times takes as
many steps as words.

Defined results: null, empty and short texts have no runs and collapse to
their words joined by one space; every row is judged alone, so null and
repeated ids are kept row by row; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12


def _rank_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max()) + 2) + b + 1, return_inverse=True)[1]


def sorted_suffixes(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray] | None:
    """``(order, same)``: suffixes in order, and for each whether it shares
    its first ``least`` words with the one before. None when no two do."""
    n = len(ids)
    if n <= least:
        return None
    # numbers of the sequences of `least` words from each place
    gram, width = ids, 1
    while 2 * width <= least:
        gram = np.unique(gram[:-width] * (int(gram.max()) + 1) + gram[width:], return_inverse=True)[1]
        width *= 2
    if width < least:
        d = least - width
        gram = np.unique(gram[:-d] * (int(gram.max()) + 1) + gram[d:], return_inverse=True)[1]
    if int(gram.max()) + 1 == len(gram):
        return None
    rank, h = ids, 1
    while True:
        behind = np.full(n, -1, np.int64)
        behind[:max(n - h, 0)] = rank[h:]
        rank = _rank_pairs(rank, behind)
        h *= 2
        if int(rank.max()) + 1 == n or h >= n:
            break
    order = np.argsort(rank, kind="stable")
    named = np.full(n, -1, np.int64)
    named[:len(gram)] = gram
    g = named[order]
    same = np.zeros(n, bool)
    same[1:] = (g[1:] == g[:-1]) & (g[1:] >= 0)
    return order, same


def common_prefixes(words: list[int], order: list[int], same: np.ndarray, least: int) -> list[int]:
    """Common prefix of each suffix with the one before it in order (0 where
    it is below ``least``), counted in text order."""
    n = len(words)
    before = {order[k]: (order[k - 1], k) for k in np.flatnonzero(same).tolist()}
    out = [0] * n
    h, last = 0, -1
    for i in sorted(before):
        j, k = before[i]
        h = max(least, h - (i - last))
        while i + h < n and j + h < n and words[i + h] == words[j + h]:
            h += 1
        out[k] = h
        last = i
    return out


def runs_of(words: list, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All runs ``(start, length, period)`` by start, then period."""
    least = -(-min_length // 2)
    number: dict = {}
    ids = [number.setdefault(w, len(number)) for w in words]
    if len(number) == len(ids):
        return []
    got = sorted_suffixes(np.array(ids, np.int64), least)
    if got is None:
        return []
    order, same = got[0].tolist(), got[1]
    lcp = common_prefixes(ids, order, same, least)
    found: dict[tuple[int, int], int] = {}

    def left(p: int) -> int:
        return ids[p - 1] if p else -1

    def pair(p: int, x: int, depth: int) -> None:
        q = abs(p - x)
        if q <= depth and depth + q >= min_length:
            key = (min(p, x), depth + q)
            if found.get(key, q) >= q:
                found[key] = q

    # an interval's places: all in order, and by the word to their left
    def joined(a: tuple[list, dict], b: tuple[list, dict], depth: int) -> tuple[list, dict]:
        if len(a[0]) < len(b[0]):
            a, b = b, a
        places, lists = a
        for p in b[0]:
            lo, hi = bisect_left(places, p - depth), bisect_right(places, p + depth)
            own = left(p)
            if hi - lo <= len(lists):
                for x in places[lo:hi]:
                    if left(x) != own:
                        pair(p, x, depth)
            else:
                for w, at in lists.items():
                    if w != own:
                        for x in at[bisect_left(at, p - depth):bisect_right(at, p + depth)]:
                            pair(p, x, depth)
        if len(b[0]) > 16:
            places += b[0]
            places.sort()
        else:
            for p in b[0]:
                insort(places, p)
        for w, at in b[1].items():
            mine = lists.setdefault(w, [])
            if len(at) > 16:
                mine += at
                mine.sort()
            else:
                for p in at:
                    insort(mine, p)
        return a

    # bottom-up over the stretches of suffixes that share `least` words
    edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()):
        open_: list[tuple[int, tuple[list, dict]]] = []
        for k in range(lo, hi + 1):
            depth = lcp[k] if k < hi else 0
            p = order[k - 1]
            child = ([p], {left(p): [p]})
            while open_ and open_[-1][0] > depth:
                d, held = open_.pop()
                child = joined(held, child, d)
            if open_ and open_[-1][0] == depth:
                open_[-1] = (depth, joined(open_[-1][1], child, depth))
            elif depth:
                open_.append((depth, child))
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that lie in a run after its first period."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        cover[s + q] += 1
        cover[s + n] -= 1
    return [w for w, c in zip(words, np.cumsum(cover).tolist()) if not c]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              keep_text: bool = True, rewrite: Callable[[str | None, list], list] | None = None) -> DataFrame:
    """``(<id_col>, n_runs, start, length, period, runs_sha256,
    collapsed_sha256, runs, collapsed)``: the longest run of each text (ties:
    smallest start, then period), all its runs, and the text without the
    repeats. Without ``keep_text`` the last two columns are left out;
    ``rewrite`` may change a text's words beforehand, given the id as text."""
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))

    def one(key: str | None, text: str | None) -> tuple:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if rewrite:
            words = rewrite(key, words)
        runs = runs_of(words, min_length)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        kept = b" ".join(kept_words(words, runs))
        row = (key, len(runs), s, n, q, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        if keep_text:
            row += ([{"start": a, "length": b, "period": c} for a, b, c in runs], kept.decode("utf-8", "replace"))
        return row

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([one(i, t) for i, t in zip(pdf["id"], pdf["text"])], columns=names)
            for c in ("start", "length", "period"):
                got[c] = got[c].astype("Int64")
            yield got

    names = ["id", "n_runs", "start", "length", "period", "runs_sha256", "collapsed_sha256"] + ["runs", "collapsed"] * keep_text
    out = "id string, n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string"
    out += ", runs array<struct<start:long,length:long,period:long>>, collapsed string" * keep_text
    return (src.mapInPandas(scan, out).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
            .withColumnRenamed("id", id_col))


def planted(key: str | None, words: list) -> list:
    """Periodic tails for a tenth of all ids, told by a checksum of the id."""
    if key is None or not words:
        return words
    h = zlib.crc32(key.encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
