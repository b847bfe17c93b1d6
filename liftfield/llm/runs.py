"""Periodic runs of words: synchronising positions at dyadic scales propose periods, short periods are read off directly.

At scale ``t`` a position is synchronising if the least hash among the ``t``-word strings that start at it and at the
``t`` positions after it stands at either end of that stretch. Whether a position is chosen depends on the next ``2 t``
words alone, so a run of period ``t <= q < 2 t`` has chosen positions that repeat ``q`` words later with the same
context; no other equal context lies between them, as a run's period word is primitive. Strings of period ``t / 4`` or
less are no candidates, which keeps the chosen positions few inside highly periodic regions; their runs are found at
lower scales, and periods under ``FIRST`` by comparing words ``q`` apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from liftfield.llm.common import BASE, coded, mix, pieces, split_words, texts

#: Least scale; shorter periods are found by direct comparison.
FIRST = 8
#: A run has at least this many words and repeats its period at least this often.
LEAST_WORDS, LEAST_TIMES = 6, 4
CELLS = 1 << 20
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def stretches(codes: np.ndarray, rows: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal stretch of one row that repeats after ``period`` words and is long enough for a run."""
    if len(codes) <= period:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    same = np.zeros(len(codes) - period + 2, np.int8)
    same[1:-1] = (codes[period:] == codes[:-period]) & (rows[period:] == rows[:-period])
    edges = np.flatnonzero(np.diff(same))
    start, stop = edges[::2], edges[1::2] + period
    long = stop - start >= max(LEAST_WORDS, LEAST_TIMES * period)
    return start[long], stop[long]


def doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of strings of ``2 size`` words from those of ``size`` words; nothing is promised across rows."""
    out = np.zeros_like(h)
    if len(h) > size:
        out[:-size] = mix(h[:-size] * np.uint64(BASE) + mix(h[size:]))
    return out


def least_within(values: np.ndarray, size: int) -> np.ndarray:
    """Least of ``size + 1`` consecutive values from each position on (``size`` a power of two)."""
    out, width = values.copy(), 1
    while width < size:
        out[:-width] = np.minimum(out[:-width], out[width:])
        width *= 2
    out[:-size] = np.minimum(out[:-size], values[size:])
    return out


def extended(codes: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray,
             reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches widened on both sides, inside their rows ``low .. high``, as far as words ``period`` apart are equal."""
    start, stop = start.copy(), stop.copy()
    for left in (True, False):
        open_, step = np.arange(len(start)), np.arange(reach)
        while len(open_):
            rest = []
            for part in np.array_split(open_, len(open_) * reach // CELLS + 1):
                if left:
                    at = start[part, None] - 1 - step
                    fine = at >= low[part, None]
                    other = at + period[part, None]
                else:
                    at = stop[part, None] + step
                    fine = at < high[part, None]
                    other = at - period[part, None]
                at, other = np.where(fine, at, 0), np.where(fine, other, 0)
                fine &= codes[at] == codes[other]
                gain = np.where(fine.all(1), reach, fine.argmin(1))
                if left:
                    start[part] -= gain
                else:
                    stop[part] += gain
                rest.append(part[gain == reach])
            open_ = np.concatenate(rest)
    return start, stop


def repeats(codes: np.ndarray, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which stretches really have their period, word by word."""
    right = np.ones(len(start), bool)
    size = stop - start - period
    for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(np.cumsum(size) // CELLS)) + 1):
        if len(part):
            n = size[part]
            ends = np.cumsum(n)
            at = np.repeat(start[part] - (ends - n), n) + np.arange(ends[-1])
            differs = np.concatenate([[0], np.cumsum(codes[at] != codes[at + np.repeat(period[part], n)])])
            right[part] = differs[ends] == differs[ends - n]
    return right


def at_scale(t: int, codes: np.ndarray, h: np.ndarray, context: np.ndarray, rows: np.ndarray, base: np.ndarray, end: np.ndarray,
             found: np.ndarray) -> np.ndarray:
    """Runs of periods ``t .. 2 t - 1``: columns row, start, stop, period. ``base`` and ``end`` bound each row's words."""
    n = len(codes)
    periodic = np.zeros(n + 1, np.int64)
    few = found[(found[:, 3] <= t // 4) & (found[:, 2] - found[:, 1] >= t)]
    np.add.at(periodic, few[:, 1], 1)
    np.add.at(periodic, few[:, 2] - t + 1, -1)
    ids = np.where(np.cumsum(periodic)[:n] > 0, NONE, h)
    least = least_within(ids, t)
    chosen = least != NONE
    chosen[: n - t] &= (ids[: n - t] == least[: n - t]) | (ids[t:] == least[: n - t])
    chosen &= np.arange(n) + 2 * t <= end[rows]
    at = np.flatnonzero(chosen)
    at = at[np.lexsort((context[at], rows[at]))]
    apart = at[1:] - at[:-1]
    pair = (rows[at[1:]] == rows[at[:-1]]) & (context[at[1:]] == context[at[:-1]]) & (apart >= t) & (apart < 2 * t)
    at, period = at[:-1][pair], apart[pair]
    if not len(at):
        return np.zeros((0, 4), np.int64)
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    # proposals of one run overlap in a period or more
    first = np.flatnonzero(np.concatenate([[True], (period[1:] != period[:-1]) | (at[1:] > at[:-1] + 2 * t)]))
    last = np.append(first[1:], len(at)) - 1
    start, stop, period = at[first], at[last] + period[first] + 2 * t, period[first]
    some = stop - start + 2 * t >= LEAST_TIMES * period
    start, stop, period = start[some], stop[some], period[some]
    row = rows[start]
    start, stop = extended(codes, base[row], end[row], start, stop, period, t)
    some = stop - start >= LEAST_TIMES * period
    out = np.stack([row, start, stop, period], 1)[some]
    right = repeats(codes, out[:, 1], out[:, 2], out[:, 3])
    for r, q in np.unique(out[~right][:, [0, 3]], axis=0):  # two strings shared a hash
        a, b = stretches(codes[base[r] : end[r]], rows[base[r] : end[r]], int(q))
        out = np.concatenate([out, np.stack([np.full(len(a), r), a + base[r], b + base[r], np.full(len(a), q)], 1)])
        right = np.append(right, np.ones(len(a), bool))
    return out[right]


def find_runs(codes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """All runs of the rows' words, sorted: columns row, start, stop, period; start and stop count from the row's first word."""
    size = np.bincount(rows, minlength=n_rows)
    base = np.cumsum(size) - size
    found = []
    for q in range(1, FIRST):
        start, stop = stretches(codes, rows, q)
        found.append(np.stack([rows[start], start, stop, np.full(len(start), q)], 1))
    found = np.concatenate(found)
    found[:, 1:3] -= base[found[:, 0], None]
    h, t = mix(codes.astype(np.uint64) * np.uint64(BASE) + np.uint64(1)), 1
    while t < FIRST:
        h, t = doubled(h, t), 2 * t
    own = np.arange(n_rows)
    while True:
        live = size >= LEAST_TIMES * t
        if not live.any():
            break
        if not live.all():  # only rows with room for a run go on
            stay = live[rows]
            codes, h, own = codes[stay], h[stay], own[live]
            rows = (np.cumsum(live) - 1)[rows[stay]]
            size = size[live]
        base = np.cumsum(size) - size
        here = np.full(n_rows, -1)
        here[own] = np.arange(len(own))
        before = found[here[found[:, 0]] >= 0]
        before = np.stack([here[before[:, 0]], before[:, 1] + base[here[before[:, 0]]], before[:, 2] + base[here[before[:, 0]]], before[:, 3]], 1)
        context = doubled(h, t)
        more = at_scale(t, codes, h, context, rows, base, base + size, before)
        more[:, 1:3] -= base[more[:, 0], None]
        more[:, 0] = own[more[:, 0]]
        found = np.concatenate([found, more])
        h, t = context, 2 * t
    # a stretch also repeats after each multiple of its period
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    smallest = np.ones(len(found), bool)
    smallest[1:] = (found[1:, :3] != found[:-1, :3]).any(1)
    found = found[smallest]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed`` of each row.

    A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` long, that no neighbouring word extends.
    ``collapsed`` joins by one space the words that no run covers after its first period. One map, no shuffle: a batch is
    cut into pieces of bounded bytes, and only a single longer text makes a longer piece.

    A null or blank text has no words, no runs and an empty ``collapsed``; a null id stays null; repeated rows each give
    their own row; runs of one start come by period; other columns, whatever their names, are not read. An empty table
    gives an empty one.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            words, rows = split_words(batch["text"])
            codes, _ = coded(words)
            n = batch.num_rows
            size = np.bincount(rows, minlength=n)
            base = np.cumsum(size) - size
            found = find_runs(codes, rows, n)
            gone = np.zeros(len(codes) + 1, np.int64)
            np.add.at(gone, base[found[:, 0]] + found[:, 1] + found[:, 3], 1)
            np.add.at(gone, base[found[:, 0]] + found[:, 2], -1)
            stay = np.cumsum(gone)[:-1] == 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows[stay], minlength=n))]).astype(np.int32)
            kept = pa.ListArray.from_arrays(ends, words.filter(pa.array(stay)))
            runs = pa.StructArray.from_arrays([pa.array(c) for c in (found[:, 1], found[:, 2] - found[:, 1], found[:, 3])], ["start", "length", "period"])
            yield pa.record_batch({
                "doc_id": batch["doc_id"], "n_words": size.astype(np.int64),
                "runs": pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(found[:, 0], minlength=n))]).astype(np.int32), runs),
                "collapsed": pc.binary_join(kept, pa.scalar(" ", words.type)).cast(pa.string())})

    return texts(docs).mapInArrow(scan, "doc_id bigint, " + SCHEMA)
