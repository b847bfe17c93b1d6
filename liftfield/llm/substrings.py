"""Repeated passages: fixed-block anchors, rolling probes, extension to exact repeats.

1. Every document is cut into non-overlapping reference blocks of 25 words, and every rolling 25-word window of every
   document probes them. A repeat of 50 words holds one whole reference block of either copy, so no repeat is missed.
2. Around each hit the repeat is extended: all 50-word windows that contain the hit are compared among documents by
   64-bit hashes (plus the bucket's own hash), which leaves exactly the windows that also start in a document with a
   smaller id. Overlapping windows make up the maximal repeat.

Window hashes travel as packed blocks, one per piece of text and bucket: four bytes a window in the first round, eight
for the few candidates of the second. A bucket is chosen by hash, so a passage or a document that fills a third of
the input is spread over all buckets; no pairs of documents are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.llm.common import coded, hash_words, inside, mix, pieces, split_words, tasks, windows
from liftfield.session import cut_lineage

WINDOW = 50
#: Stands for a null id: after all others.
LAST = 2**63 - 1
BLOCKS = "bucket int, kind int, ids binary, counts binary, hashes binary"
HITS = "key bigint, hits binary"


def word_hashes(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    words, rows = split_words(text)
    ids, distinct = coded(words)
    return (hash_words(distinct)[ids] if len(ids) else np.zeros(0, np.uint64)), rows, words


def rolling(h: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows that stay in one row, and their first word's place."""
    ok = np.flatnonzero(inside(rows, size))
    return windows(h, size)[ok], ok


def by_hash(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a window, by bits that its lower half does not hold."""
    return (mix(hashes + np.uint64(7)) % np.uint64(buckets)).astype(np.uint32)


def by_id(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) + np.uint64(1)) % np.uint64(buckets)).astype(np.uint32)


def packed(kind: int, hashes: np.ndarray, ids: np.ndarray, bucket: np.ndarray, buckets: int, dtype: type) -> list[tuple]:
    """One row for each bucket: run-length coded document ids and the hashes."""
    order = np.argsort(bucket.astype(np.uint16) if buckets < 65536 else bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint32))
    ids, values, out = ids[order], hashes[order].astype(dtype), []
    for b in range(buckets):
        s, e = ends[b], ends[b + 1]
        if e > s:
            own = ids[s:e]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            counts = np.diff(np.append(first, e - s)).astype(np.uint32)
            out.append((b, kind, own[first].tobytes(), counts.tobytes(), values[s:e].tobytes()))
    return out


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    bucket, kind, ids, counts, hashes = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.record_batch({"bucket": pa.array(bucket, pa.int32()), "kind": pa.array(kind, pa.int32()),
                            "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary()), "hashes": pa.array(hashes, pa.binary())})


def unpacked(batch: pa.RecordBatch, k: int, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = (np.frombuffer(batch[c][k].as_py(), t) for c, t in (("ids", np.int64), ("counts", np.uint32)))
    return np.frombuffer(batch["hashes"][k].as_py(), dtype), np.repeat(ids, counts)


def distinct(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash of a document once, sorted by document."""
    order = np.lexsort((hashes, ids))
    hashes, ids = hashes[order], ids[order]
    new = np.ones(len(ids), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (ids[1:] != ids[:-1])
    return hashes[new], ids[new]


def returned(got: list[tuple[np.ndarray, np.ndarray]], buckets: int, dtype: type) -> Iterator[pa.RecordBatch]:
    """What a bucket found, packed again by the documents' buckets: its rows do not grow with the documents."""
    if got:
        hashes, ids = distinct(*(np.concatenate(x) for x in zip(*got, strict=True)))
        if len(ids):
            yield rows_batch(packed(0, hashes, ids, by_id(ids, buckets), buckets, dtype))


def gather(dtype: type):
    """One row for each document of a bucket: all its hashes, at most as many as it has windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if got:
                hashes, ids = distinct(*(np.concatenate(x) for x in zip(*got, strict=True)))
                first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
                parts = [hashes[s:e].tobytes() for s, e in zip(first.tolist(), [*first[1:].tolist(), len(ids)], strict=True)]
                yield pa.record_batch({"key": pa.array(ids[first], pa.int64()), "hits": pa.array(parts, pa.binary())})

        for batch in batches:
            for k in range(batch.num_rows):
                if batch["bucket"][k].as_py() != now:
                    yield from close()
                    now, got = batch["bucket"][k].as_py(), []
                got.append(unpacked(batch, k, dtype))
        yield from close()

    return run


def match_blocks(buckets: int):
    """Rows come by bucket, reference blocks first: hashes of hits, for the documents of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, refs, index, got = None, [], None, []

        def close() -> Iterator[pa.RecordBatch]:
            if index is not None and index[3].any():
                hit = index[3][np.searchsorted(index[0], index[4])]
                got.append((index[4][hit], index[5][hit]))
            yield from returned(got, buckets, np.uint32)

        for batch in batches:
            for k in range(batch.num_rows):
                bucket, kind = batch["bucket"][k].as_py(), batch["kind"][k].as_py()
                if bucket != now:
                    yield from close()
                    now, refs, index, got = bucket, [], None, []
                value, own = unpacked(batch, k, np.uint32)
                if kind == 0:
                    refs.append((value, own))
                    continue
                if index is None:
                    if not refs:
                        continue
                    v, o = (np.concatenate(x) for x in zip(*refs, strict=True))
                    order = np.argsort(v)
                    v, o = v[order], o[order]
                    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
                    index = (v[first], np.minimum.reduceat(o, first), np.maximum.reduceat(o, first), np.zeros(len(first), bool), v, o)
                at = np.searchsorted(index[0], value)
                at[at == len(index[0])] = 0
                hit = (index[0][at] == value) & ((index[1][at] != own) | (index[2][at] != own))
                index[3][at[hit]] = True
                if hit.any():
                    got.append((value[hit], own[hit]))
        yield from close()

    return run


def match_windows(buckets: int):
    """Windows of a bucket that also start in a document with a smaller id, by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if got:
                value, own = (np.concatenate(x) for x in zip(*got, strict=True))
                order = np.argsort(value)
                value, own = value[order], own[order]
                first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
                least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(value))))
                later = own > least
                yield from returned([(value[later], own[later])], buckets, np.uint64)

        for batch in batches:
            for k in range(batch.num_rows):
                if batch["bucket"][k].as_py() != now:
                    yield from close()
                    now, got = batch["bucket"][k].as_py(), []
                got.append(unpacked(batch, k, np.uint64))
        yield from close()

    return run


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("key"), F.col("text").cast("string").alias("text"), *more)


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind")


def marked(h: np.ndarray, rows: np.ndarray, hits: pa.Array, size: int, dtype: type) -> np.ndarray:
    """First words of the windows whose hash is among their own row's hits."""
    hashes, at = rolling(h, rows, size)
    sizes = (pc.fill_null(pc.binary_length(hits), 0).to_numpy(zero_copy_only=False) // np.dtype(dtype).itemsize).astype(np.int64)
    wanted = np.frombuffer(b"".join(x for x in hits.to_pylist() if x), dtype).astype(np.uint64)
    salt = mix(np.arange(1, len(hits) + 1, dtype=np.uint64))
    wanted = mix(wanted ^ np.repeat(salt, sizes))
    return at[np.isin(mix(hashes.astype(dtype).astype(np.uint64) ^ salt[rows[at]]), wanted)]


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``key`` (the id; the largest bigint for null) and ``hits``: hashes of its windows to remove."""
    block, buckets = window // 2, tasks(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, rows, _ = word_hashes(batch["text"])
            hashes, at = rolling(h, rows, block)
            ids = batch["key"].to_numpy()[rows[at]]
            starts = np.searchsorted(rows, np.arange(batch.num_rows))
            aligned = (at - starts[rows[at]]) % block == 0
            bucket = by_hash(hashes, buckets)
            yield rows_batch(packed(0, hashes[aligned], ids[aligned], bucket[aligned], buckets, np.uint32) + packed(1, hashes, ids, bucket, buckets, np.uint32))

    found = dealt(keyed(docs).mapInArrow(anchors, BLOCKS), buckets).mapInArrow(match_blocks(buckets), BLOCKS)
    hits = cut_lineage(dealt(found, buckets).mapInArrow(gather(np.uint32), HITS))

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h, rows, _ = word_hashes(batch["text"])
            anchor = np.zeros(len(h) + 1, np.int64)
            anchor[marked(h, rows, batch["hits"], block, np.uint32)] = 1
            sums = np.concatenate([[0], np.cumsum(anchor)])
            hashes, at = rolling(h, rows, window)
            near = sums[at + window - block + 1] > sums[at]
            yield rows_batch(packed(0, hashes[near], batch["key"].to_numpy()[rows[at[near]]], by_hash(hashes[near], buckets), buckets, np.uint64))

    later = dealt(keyed(docs).join(hits, "key").mapInArrow(extended, BLOCKS), buckets).mapInArrow(match_windows(buckets), BLOCKS)
    return cut_lineage(dealt(later, buckets).mapInArrow(gather(np.uint64), HITS))


def covered_words(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which words of the texts lie in a removed window."""
    h, rows, words = word_hashes(batch["text"])
    edge = np.zeros(len(h) + window + 1, np.int64)
    at = marked(h, rows, batch["hits"], window, np.uint64)
    edge[at] += 1
    edge[at + window] -= 1
    return np.cumsum(edge)[: len(h)] > 0, rows, words


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of each row.

    A null text has no words; a null id comes after all others, and rows of one id count as one document: none of them
    is earlier than another. Texts shorter than a window lose nothing.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n = batch.num_rows
            text = batch["text"].to_pylist()
            kept = [(t or "").encode().split() for t in text]
            n_words, n_removed = np.fromiter(map(len, kept), np.int64, n), np.zeros(n, np.int64)
            some = np.flatnonzero(batch["hits"].is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                gone, rows, _ = covered_words(batch.take(pa.array(some)), window)
                n_removed[some] = np.bincount(rows[gone], minlength=len(some))
                ends = np.cumsum(n_words[some])
                for k, i in enumerate(some):
                    left = ~gone[ends[k] - n_words[i] : ends[k]]
                    kept[i] = [w for w, stay in zip(kept[i], left.tolist(), strict=True) if stay]
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_words": n_words, "n_removed": n_removed,
                                   "kept_sha256": pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in kept], pa.string())})

    both = keyed(docs, F.col("doc_id").cast("bigint").alias("doc_id")).join(repeated_windows(docs, window), "key", "left")
    return both.mapInArrow(digest, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated words cut out; a changed text has its kept words joined by one space, others stay as they are."""
    columns = docs.columns
    hits = repeated_windows(docs, window).withColumnsRenamed({"key": "__key", "hits": "__hits"})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            own = batch.select(columns)
            hit = batch["__hits"]
            some = np.flatnonzero(hit.is_valid().to_numpy(zero_copy_only=False))
            if len(some):
                part = pa.record_batch({"text": batch["text"].cast(pa.string()), "hits": hit}).take(pa.array(some))
                gone, rows, words = covered_words(part, window)
                texts, stay, owner = batch["text"].to_pylist(), words.filter(pa.array(~gone)).to_pylist(), rows[~gone]
                ends = np.searchsorted(owner, np.arange(len(some) + 1))
                for k, i in enumerate(some):
                    texts[i] = " ".join(stay[ends[k] : ends[k + 1]])
                own = own.set_column(columns.index("text"), own.schema.field("text"), pa.array(texts, own.schema.field("text").type))
            yield own

    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST))
    return docs.withColumn("__key", key).join(hits, "__key", "left").select(*[F.col(f"`{c}`") for c in columns], "__hits").mapInArrow(cut, docs.schema)
