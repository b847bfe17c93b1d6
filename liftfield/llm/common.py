"""Words, hashes and Arrow batches that the operators share.

A word is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``. All helpers work on pieces of a bounded
number of text bytes, so a batch of very long texts never grows the working arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
PIECE_BYTES = 6 << 20
#: Odd multiplier of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has at most ``most`` bytes in each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the row that each belongs to."""
    lists = pc.ascii_split_whitespace(pc.fill_null(text.cast(pa.large_string()), ""))
    words, rows = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py():
        words, rows = words.filter(full), rows[full.to_numpy(zero_copy_only=False)]
    return words, rows.astype(np.int64)


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ids within this array, and the distinct words."""
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes, the same in every batch and task."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive 64-bit values (also across rows: the caller masks those)."""
    n = len(values)
    if n < size:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(BASE, n - 1), dtype=np.uint64)])
    return mix((sums[size:] - sums[:-size]) * powers(INVERSE, n - size))


def inside(rows: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words stay in one row."""
    return rows[: max(0, len(rows) - size + 1)] == rows[size - 1 :] if len(rows) >= size else np.zeros(0, bool)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (bigint), ``text`` (string) and the named columns; nothing else of ``docs`` is read."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def tasks(df: DataFrame) -> int:
    """Partitions for a shuffle whose rows are packed blocks, which adaptive execution must not merge by their few rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: tuple[int, int], learn: Column | None = None,
                    longest: int = 200_000) -> DataFrame:
    """A bounded training sample: at most ``most`` = (rows of label 0, rows of label 1), those of least id hash.

    Only ids chosen from ``labels`` meet ``docs`` (a broadcast of at most sum(most) rows). A repeated id counts once,
    with its least label and least text; rows of a null id, another label or a text over ``longest`` bytes are not
    learned from.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    chosen = None
    for value, rows in enumerate(most):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    return (texts(docs).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).join(F.broadcast(chosen), "doc_id")
            .groupBy("doc_id", "label").agg(F.min("text").alias("text")))
