"""Language identification by hyperdimensional profiles.

A letter has a random vector of signs, drawn from its code point. A trigram is bound from its letters' vectors, each
rotated by its place (elementwise product of the vectors rotated by two, one and zero); a text's profile bundles its
trigrams, once each (a count is damped to its square root). Prototypes bundle all learning texts of a language, less
what all languages share. A text gets the language whose prototype has the largest cosine with its profile.

Learning aggregates trigram counts by language and sums one vector per language and task; prediction needs the
prototypes only, which are as many as there are languages.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftfield.llm.common import mix, pieces, texts

DIMENSIONS = 512
UNKNOWN = "und"
#: Bytes of text and rows of one piece of work, and trigrams whose vectors are held at once.
PIECE = 2 << 20
ROWS = 4096
GRAMS = 1 << 14
#: Rows of one block product, and the share of rows (one in so many) from which a trigram is frequent.
BLOCK_ROWS = 512
SPARSE = 150
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """Signs, a function of the code point alone."""
    words = mix(points.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + mix(np.arange(1, dimensions // 64 + 1, dtype=np.uint64))[None, :])
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return (2.0 * bits - 1).astype(np.float32)


def trigrams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, numbers of the distinct trigrams in them, counts, and the trigrams' code points (n x 3).

    Letters are lower-cased; each run of other characters, and both ends, is one space.
    """
    joined = [" " + (t or "").lower() + " " for t in text.to_pylist()]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    points = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(joined)), sizes)
    points = np.where(letters()[points], points, 32)
    stay = np.ones(len(points), bool)
    stay[1:] = (points[1:] != 32) | (points[:-1] != 32) | (rows[1:] != rows[:-1])
    points, rows = points[stay], rows[stay]
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    code = np.zeros(0x110000, np.int64)
    code[alphabet] = np.arange(len(alphabet))
    c, a = code[points], max(len(alphabet), 1)
    ok = (rows[2:] == rows[:-2]) if len(rows) > 2 else np.zeros(0, bool)
    key = ((c[:-2] * a + c[1:-1]) * a + c[2:])[ok] if len(ok) else np.zeros(0, np.int64)
    grams = np.unique(key)
    number = np.searchsorted(grams, key) if a**3 > 1 << 24 else lookup(grams, a**3)[key]
    both = rows[:-2][ok] * max(len(grams), 1) + number if len(ok) else np.zeros(0, np.int64)
    both.sort()
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(both)))
    spelled = alphabet[np.stack([grams // (a * a), grams // a % a, grams % a], 1)] if len(grams) else np.zeros((0, 3), np.int64)
    return both[first] // max(len(grams), 1), both[first] % max(len(grams), 1), counts, spelled


def lookup(grams: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[grams] = np.arange(len(grams))
    return out


def bound(spelled: np.ndarray, dimensions: int) -> np.ndarray:
    """Vectors of trigrams: letters rotated by two, one and zero places, multiplied."""
    points, back = np.unique(spelled, return_inverse=True)
    vectors, back = letter_vectors(points, dimensions), back.reshape(spelled.shape)
    return np.roll(vectors, 2, 1)[back[:, 0]] * np.roll(vectors, 1, 1)[back[:, 1]] * vectors[back[:, 2]]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, most=PIECE):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def profiles(rows: np.ndarray, numbers: np.ndarray, weight: np.ndarray, spelled: np.ndarray, n: int, dimensions: int) -> np.ndarray:
    """Weighted sums of the rows' trigram vectors, a bounded number of trigrams and entries at a time.

    Trigrams that a good part of the rows has are summed as products of blocks (rows × trigrams times trigrams ×
    dimensions), the others entry by entry; both give the same sums.
    """
    out = np.zeros((n, dimensions), np.float32)
    weight = weight.astype(np.float32)
    often = np.bincount(numbers, minlength=len(spelled)) * SPARSE >= n
    frequent = np.flatnonzero(often)
    if len(frequent):
        column = np.cumsum(often) - 1
        some = often[numbers]
        own, col, w = rows[some], column[numbers[some]], weight[some]
        for low in range(0, len(frequent), GRAMS):
            vectors = bound(spelled[frequent[low : low + GRAMS]], dimensions)
            for at in range(0, n, BLOCK_ROWS):
                part = slice(*np.searchsorted(own, (at, at + BLOCK_ROWS)))
                here = slice(None) if len(frequent) <= GRAMS else (col[part] >= low) & (col[part] < low + GRAMS)
                block = np.zeros((min(BLOCK_ROWS, n - at), len(vectors)), np.float32)
                block[own[part][here] - at, col[part][here] - low] = w[part][here]
                out[at : at + BLOCK_ROWS] += block @ vectors
    seldom = np.flatnonzero(~often)
    some = ~often[numbers]
    column = np.cumsum(~often) - 1
    own, col, w = rows[some], column[numbers[some]], weight[some]
    for low in range(0, len(seldom), GRAMS):
        vectors = bound(spelled[seldom[low : low + GRAMS]], dimensions)
        here = slice(None) if len(seldom) <= GRAMS else (col >= low) & (col < low + GRAMS)
        r_all, c_all, w_all = own[here], col[here] - low, w[here]
        for at in range(0, len(r_all), GRAMS):
            r = r_all[at : at + GRAMS]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[r[first]] += np.add.reduceat(vectors[c_all[at : at + GRAMS]] * w_all[at : at + GRAMS, None], first, axis=0)
    return out


def has_letter(rows: np.ndarray, numbers: np.ndarray, spelled: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[rows[(spelled != 32).any(1)[numbers]]] = True
    return out


def learn(docs: DataFrame, chosen: Column, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from the text and lang of all rows that ``chosen`` admits; lang is not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in chunks(batches):
            rows, numbers, counts, spelled = trigrams(batch["text"])
            if not len(rows):
                continue
            names = batch["lang"].dictionary_encode()
            own, width = names.indices.to_numpy()[rows], len(spelled)
            # each text counts as one, whatever its length
            weight = np.sqrt(counts / np.bincount(rows, counts, batch.num_rows)[rows])
            key, back = np.unique(own * width + numbers, return_inverse=True)
            sums = profiles(key // width, key % width, np.bincount(back, weight), spelled, len(names.dictionary), dimensions)
            for name, v in zip(names.dictionary.to_pylist(), sums, strict=True):
                total[name] = total.get(name, 0) + v
        at = [(k, d, float(x)) for k, v in total.items() for d, x in enumerate(v)]
        yield pa.record_batch({"lang": pa.array([r[0] for r in at], pa.string()), "d": pa.array([r[1] for r in at], pa.int32()),
                               "x": pa.array([r[2] for r in at], pa.float64())})

    rows = texts(docs, F.col("lang").cast("string").alias("lang")).where(chosen & F.col("lang").isNotNull() & F.col("text").isNotNull())
    got = (rows.select("text", "lang").mapInArrow(run, "lang string, d int, x double").groupBy("lang", "d").agg(F.sum("x").alias("x"))
           .groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v")).orderBy("lang").collect())
    names = [r["lang"] for r in got]
    if not names:
        return [], np.zeros((0, dimensions))
    p = np.array([r["v"] for r in got])
    p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    if len(names) > 1:
        p = p - p.mean(0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return names, p.astype(np.float32)


def languages(docs: DataFrame, held_out: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (the cosine, 0 to 1) of each row.

    Rows that ``held_out`` (over ``doc_id``; never null) marks are not learned from. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if there is nothing to learn from. Ties go to the language
    that sorts first.
    """
    names, prototypes = learn(docs, ~held_out, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            n = batch.num_rows
            rows, numbers, counts, spelled = trigrams(batch["text"])
            known = has_letter(rows, numbers, spelled, n)
            best, score = np.zeros(n, np.int64), np.zeros(n)
            if names:
                profile = profiles(rows, numbers, np.sqrt(counts), spelled, n, dimensions)
                cosine = profile @ prototypes.T / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12)
                best, score = cosine.argmax(1), np.clip(cosine.max(1), 0, 1).astype(float)
            found = known if names else np.zeros(n, bool)
            picked = pa.array(np.array([*names, UNKNOWN], object)[np.where(found, best, len(names))], pa.string())
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": picked, "score": np.where(found, score, 0.0)})

    return texts(docs, held_out.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def fold(size: int, which: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder; a null id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % size == which, F.lit(False))
