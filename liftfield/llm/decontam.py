"""Benchmark decontamination: seeds of word pairs, then Smith-Waterman alignment of words.

Words are lower-cased and freed of punctuation at their ends. Seeds are pairs of neighbouring words of an item, found
in a document next to each other or with one word between. A passage that reaches the least score must hold a certain
number of them within a certain length, whatever the corpus is (``least_pairs``), so passages with fewer are left out
without loss and no others: recall depends neither on the size of the corpus nor on how often an item was copied. The
rest are aligned with the item, so copies with replaced, added or dropped words are scored too. Items are handled in
blocks of a bounded number of words, and only a block's words and seeds are sent to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.llm.common import BASE, coded, hash_words, mix, pieces, split_words, texts

MATCH, MISMATCH, GAP = 2, -1, -1
#: Least score, as a share of a perfect alignment of the whole item.
LEAST_SCORE = 0.5
#: Words of test items that are sent to the tasks at once.
BLOCK_WORDS = 500_000
TABLE_BITS = 20
#: Hits of seeds that are held at once, but whole rows.
MOST_HITS = 2_000_000
LINK = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint"


def plain_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the cleaned words, their rows, and their place among all words of the row."""
    words, rows = split_words(text)
    ids, distinct = coded(words)
    clean = pc.utf8_lower(distinct.cast(pa.large_string()))
    clean = pc.replace_substring_regex(clean, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")
    h = hash_words(clean)
    full = pc.greater(pc.binary_length(clean), 0).to_numpy(zero_copy_only=False)
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(text)))[rows]
    if len(ids) and not full.all():
        stay = full[ids]
        ids, rows, place = ids[stay], rows[stay], place[stay]
    return (h[ids] if len(ids) else np.zeros(0, np.uint64)), rows, place


@dataclass
class Seeds:
    """Sorted hashes of word pairs with the item and place of each, and of each item its words, the least hits and the longest passage."""

    value: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    items: list[np.ndarray]
    ids: list[int]
    hits: np.ndarray
    span: np.ndarray


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(BASE) + second)


def least_pairs(length: int, least: float) -> int:
    """Neighbouring words of an item that any passage of a score of ``least`` has at a distance of one or two.

    Of m matched words, a pairs of neighbours lie further apart in the passage (at least two gaps each), b steps leave
    out words of the item (at least one error each); the score is at most 2m - 2a - b, and all other steps are such pairs.
    """
    score, found = math.ceil(MATCH * length * least - 1e-9), length
    for m in range(1, length + 1):
        left = 2 * m - score
        if left >= 0:
            b = min(length - m, left)
            found = min(found, m - 1 - b - (left - b) // 2)
    return found


def choose_seeds(ids: list[int], items: list[np.ndarray], least: float) -> Seeds:
    """Pairs of neighbours of each item, without those most common in the benchmark as far as enough must still be found."""
    pairs = [pair(h[:-1], h[1:]) for h in items]
    distinct, common = np.unique(np.concatenate([np.unique(x) for x in pairs]), return_counts=True)
    values, owners, places = [], [], []
    hits, span = np.ones(len(items), np.int64), np.ones(len(items), np.int64)
    for k, (h, own) in enumerate(zip(items, pairs, strict=True)):
        place = np.arange(len(own))
        need = least_pairs(len(h), least)
        if len(h) == 1:
            own, place = h, np.zeros(1, np.int64)  # a word by itself
        elif need < 1:
            # too short for a pair of neighbours to be sure: all pairs of its words
            i, j = np.triu_indices(len(h), 1)
            own, place = pair(h[i], h[j]), i
        elif need > 1:
            order = np.argsort(common[np.searchsorted(distinct, own)], kind="stable")
            place = np.sort(order[: len(own) - need // 2])
            own = own[place]
            hits[k] = need - need // 2
        span[k] = max(len(h), math.floor(3 * len(h) - MATCH * len(h) * least + 1e-9))
        values.append(own)
        owners.append(np.full(len(own), k))
        places.append(place)
    value = np.concatenate(values)
    order = np.argsort(value, kind="stable")
    table = np.zeros(1 << TABLE_BITS, bool)
    table[(value >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    return Seeds(value[order], np.concatenate(owners)[order], np.concatenate(places)[order], table, items, ids, hits, span)


def seed_hits(seeds: Seeds, h: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place in the batch and item of every seed found; whole rows at a time, about ``MOST_HITS`` hits each."""
    found = []
    for d in (0, 1, 2):
        if len(h) <= d or d == 0 and not any(len(x) == 1 for x in seeds.items):
            continue
        hashes = pair(h[:-d], h[d:]) if d else h
        at = np.flatnonzero(seeds.table[(hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] & (rows[: len(hashes)] == rows[d:]))
        low, high = np.searchsorted(seeds.value, hashes[at], "left"), np.searchsorted(seeds.value, hashes[at], "right")
        some = high > low
        found.append((at[some], low[some], (high - low)[some]))
    if not found:
        return
    at, low, reps = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    at, low, reps = at[order], low[order], reps[order]
    total, begin = np.cumsum(reps), 0
    while begin < len(at):
        end = int(np.searchsorted(total, total[begin] - reps[begin] + MOST_HITS, "right"))
        end = int(np.searchsorted(rows[at], rows[at[max(end, begin + 1) - 1]], "right"))
        n, first = reps[begin:end], low[begin:end]
        which = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(at[begin:end], n), seeds.item[which]
        begin = end


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the passage word at which it ends."""
    shift = np.arange(len(passage) + 1, dtype=np.int32) * -GAP
    row, best, end = np.zeros(len(passage) + 1, np.int32), 0, -1
    for word in item:
        step = np.zeros_like(row)
        step[1:] = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        step = np.maximum(np.maximum(step, row + GAP), 0)
        row = np.maximum.accumulate(step + shift) - shift
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k - 1
    return best, end


def aligned(seeds: Seeds, h: np.ndarray, rows: np.ndarray, place: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item id, score, first word, last word): the best alignment of each row and item above ``least``."""
    if not len(rows):
        return []
    starts = np.searchsorted(rows, np.arange(rows[-1] + 2))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for at, item in seed_hits(seeds, h, rows):
        # hits of an item in a row, each place once; close ones, as many as its score needs, make a passage
        key = np.unique(item * np.int64(len(h)) + at)
        item, at = key // len(h), key % len(h)
        last = np.arange(len(at)) + seeds.hits[item] - 1
        ok = last < len(at)
        last[~ok] = 0
        ok &= (item[last] == item) & (rows[at[last]] == rows[at]) & (at[last] - at < seeds.span[item])
        first = np.flatnonzero(ok)
        if not len(first):
            continue
        item, low, high = item[first], at[first], at[last[first]]
        reach = 2 * seeds.span[item]
        new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (rows[low[1:]] != rows[low[:-1]]) | (low[1:] - high[:-1] > reach[1:])]))
        for f, e in zip(new, np.append(new[1:], len(first)), strict=True):
            words, row = seeds.items[item[f]], int(rows[low[f]])
            a, b = max(starts[row], low[f] - seeds.span[item[f]]), min(starts[row + 1], high[f:e].max() + seeds.span[item[f]] + 1)
            passage = h[a:b]
            if MATCH * np.isin(words, passage).sum() < least * MATCH * len(words):
                continue
            score, end = align(words, passage)
            share = score / (MATCH * len(words))
            own = (row, int(item[f]))
            if share >= least and share > best.get(own, (0.0,))[0]:
                back = align(words[::-1], passage[end::-1])[1]
                best[own] = (share, int(place[a + end - back]), int(place[a + end]))
    return [(row, seeds.ids[i], *v) for (row, i), v in best.items()]


def item_blocks(benchmark: DataFrame, least: float, block_words: int = BLOCK_WORDS) -> list[Seeds]:
    """Seeds of all items, in blocks of about ``block_words`` words; items are read block by block."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    count = -(-int(words) // block_words)
    out = []
    for b in range(count):
        got = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == b).orderBy("item_id", "text").toArrow()
        h, rows, _ = plain_words(got["text"].combine_chunks())
        ends = np.searchsorted(rows, np.arange(got.num_rows + 1))
        split = [h[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        full = [k for k, x in enumerate(split) if len(x)]
        if full:
            ids = got["item_id"].to_pylist()
            out.append(choose_seeds([ids[k] for k in full], [split[k] for k in full], least))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id``, ``item_id``, ``score`` (1 is a whole copy) and the first and last word of the passage, for each row and item.

    Null or blank texts have no passage and such items no seeds; null ids are passed through; equal items each report.
    Without items there are no rows.
    """
    out = docs.sparkSession.createDataFrame([], LINK)
    for k, seeds in enumerate(item_blocks(benchmark, least, block_words)):
        part = texts(docs).mapInArrow(find(seeds, least), LINK)
        out = part if k == 0 else out.unionByName(part)
    return out


def find(seeds: Seeds, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = aligned(seeds, *plain_words(batch["text"]), least)
            ids = batch["doc_id"].take(pa.array([g[0] for g in got], pa.int64()))
            yield pa.record_batch({"doc_id": ids} | {c: pa.array([g[k] for g in got], t) for c, k, t in (
                ("item_id", 1, pa.int64()), ("score", 2, pa.float64()), ("first_word", 3, pa.int64()), ("last_word", 4, pa.int64()))})

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without a passage of any item, all columns as they are; nothing is shuffled."""

    def without(seeds: Seeds) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                stay = np.ones(batch.num_rows, bool)
                stay[[g[0] for g in aligned(seeds, *plain_words(batch["text"].cast(pa.string())), least)]] = False
                yield batch.filter(pa.array(stay))

        return run

    out = docs
    for seeds in item_blocks(benchmark, least, block_words):
        out = out.mapInArrow(without(seeds), docs.schema)
    return out
