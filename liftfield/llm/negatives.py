"""Hard negatives from embeddings: a secondary sort brings each anchor's scores in descending order to a streaming reader.

Anchors are taken in blocks of a bounded number of vectors. For each block every row of the table is scored in the tasks
where it lies, and a task keeps what may still be among the first: of the same label the best ``positives``, of other labels
the best ``negatives`` inside each positive's window. Both leave packed keys (anchor, descending score, kind, id), which
are dealt by anchor, sorted within partitions and read once: a positive opens its window, negatives pass through the open
windows, and no anchor's rows are held.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftfield.llm.common import tasks
from liftfield.session import cut_lineage, shared_folder

#: Vectors of one block; the bound on what is broadcast, with their windows.
BLOCK = 8192
#: Scores held at once.
CELLS = 1 << 20
SIGN = np.uint64(1 << 63)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("id", ">u8")])
VECTORS = "id bigint, label bigint, vector array<double>"
OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
POSITIVE, NEGATIVE = 0, 1
LEAST = -(1 << 63)


def usable(vectors: DataFrame, scale: int, id: str, label: str, vector: str) -> DataFrame:
    """``id``, ``label`` and the whole-number components of rows that can take part."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["vector"]
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
            ends = np.cumsum(size)
            broken = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            fine = broken[ends] == broken[ends - size]
            values = np.floor(values[np.repeat(fine, size)] * scale)
            kept = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size[fine])]).astype(np.int32), values)
            mask = pa.array(fine)
            yield pa.record_batch({"id": batch["id"].filter(mask), "label": batch["label"].filter(mask), "vector": kept})

    named = vectors.select(F.col(id).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"),
                           F.col(vector).cast("array<double>").alias("vector"))
    return named.where("id is not null and label is not null and vector is not null").mapInArrow(whole, VECTORS)


def dense(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` components: a longer vector is read so far, a shorter one counts as zero beyond its end."""
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
    if (size == width).all():
        return values.reshape(len(size), width)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    near = column < width
    out[row[near], column[near]] = values[near]
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, in the smallest type that holds them; past 64 bits they stop at its ends."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, LEAST, (1 << 63) - 1).astype(np.int64)


def packed(anchor: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.RecordBatch:
    """Keys that sort by anchor, higher score, kind and smaller id as plain bytes."""
    key = np.empty(len(anchor), KEY)
    key["anchor"] = anchor.astype(np.int64).view(np.uint64) ^ SIGN
    key["score"] = FULL - (score.astype(np.int64).view(np.uint64) ^ SIGN)
    key["kind"] = kind
    key["id"] = ids.astype(np.int64).view(np.uint64) ^ SIGN
    width = KEY.itemsize
    flat = pa.py_buffer(key.tobytes())
    keys = pa.Array.from_buffers(pa.binary(width), len(key), [None, flat]).cast(pa.binary())
    return pa.record_batch({"anchor": pa.array(anchor.astype(np.int64)), "key": keys})


def unpacked(keys: pa.Array) -> tuple[np.ndarray, ...]:
    """Anchor, score, kind and id of packed keys."""
    k = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    signed = lambda x: (x.astype(np.uint64) ^ SIGN).view(np.int64)
    return signed(k["anchor"]), signed(FULL - k["score"].astype(np.uint64)), k["kind"], signed(k["id"])


def secondary_sort(pairs: DataFrame) -> DataFrame:
    """Each anchor's keys in one partition, in their order."""
    return pairs.repartition(tasks(pairs), "anchor").sortWithinPartitions("key")


class Best:
    """The first ``k`` (score descending, id ascending) of each of ``n`` lists, kept as scores arrive in any order.

    Arrivals wait until they are as many as the lists hold, so sorting stays a constant share of the work.
    """

    def __init__(self, n: int, k: int):
        self.n, self.k, self.most = n, k, max(n * k, 1 << 16)
        self.kept = np.zeros((4, 0), np.int64)  # list, score, id, number of the row among those seen
        self.waiting, self.count = [], 0
        self.floor = np.full(n, LEAST)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, number: np.ndarray) -> None:
        self.waiting.append(np.stack([slot, score, ids, number]))
        self.count += len(slot)
        if self.count >= self.most:
            self.rows()

    def rows(self) -> np.ndarray:
        rows = np.concatenate([self.kept, *self.waiting], 1)
        self.waiting, self.count = [], 0
        rows = rows[:, np.lexsort((rows[2], ~rows[1], rows[0]))]
        starts = np.searchsorted(rows[0], np.arange(self.n + 1))
        full = starts[1:] - starts[:-1] >= self.k
        self.floor[full] = rows[1][starts[:-1][full] + self.k - 1]
        self.kept = rows[:, np.arange(rows.shape[1]) - starts[rows[0]] < self.k]
        return self.kept


def blocks(lists: pa.RecordBatch, cells: int) -> Iterator[tuple[int, int]]:
    """Cuts of a batch's rows so that a block of anchors times a cut stays within ``CELLS`` scores."""
    step = max(1, CELLS // max(cells, 1))
    for at in range(0, lists.num_rows, step):
        yield at, min(at + step, lists.num_rows)


def same_label(rows: DataFrame, block, k: int) -> DataFrame:
    """Keys of each anchor's best ``k`` other rows of its label in every task."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, _ = block.value
        of = {int(x): np.flatnonzero(labels == x) for x in np.unique(labels)}
        kept = Best(len(ids), k)
        for batch in batches:
            label = batch["label"].to_numpy()
            for x in np.unique(label).tolist():
                if x not in of:
                    continue
                mine = of[x]
                part = batch.take(pa.array(np.flatnonzero(label == x)))
                for at, to in blocks(part, len(mine)):
                    other = part["id"].to_numpy()[at:to]
                    s = scores(vectors[mine], dense(part["vector"][at:to], vectors.shape[1]))
                    a, b = np.nonzero((s >= kept.floor[mine, None]) & (ids[mine, None] != other[None, :]))
                    kept.add(mine[a], s[a, b], other[b], b)
        slot, score, other, _ = kept.rows()
        yield packed(ids[slot], score, POSITIVE, other)

    return rows.mapInArrow(best, "anchor bigint, key binary")


def other_labels(rows: DataFrame, block, k: int, low: tuple[int, int]) -> DataFrame:
    """Keys of the best ``k`` rows of other labels inside each positive's window in every task, each row once an anchor."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, (owner, score) = block.value
        kept = Best(len(owner), k)
        order = np.argsort(owner, kind="stable")
        owner, high = owner[order], score[order]
        # least whole number at or over low of a positive's score
        floor = np.array([-(-low[0] * int(x) // low[1]) for x in high], np.int64)
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        turns = [np.flatnonzero((place == t) & (floor <= high)) for t in range(int(place.max(initial=-1)) + 1)]
        seen = 0
        for batch in batches:
            for at, to in blocks(batch, len(ids)):
                other, label = batch["id"].to_numpy()[at:to], batch["label"].to_numpy()[at:to]
                s = scores(vectors, dense(batch["vector"][at:to], vectors.shape[1]))
                differs = labels[:, None] != label[None, :]
                for slots in turns:
                    mine = owner[slots]
                    least = np.maximum(floor[slots], kept.floor[slots])
                    a, b = np.nonzero((s[mine] >= least[:, None]) & (s[mine] <= high[slots, None]) & differs[mine])
                    kept.add(slots[a], s[mine[a], b], other[b], seen + at + b)
            seen += batch.num_rows
        slot, score, other, number = kept.rows()
        anchor = owner[slot]
        _, once = np.unique(np.stack([anchor, number]), axis=1, return_index=True)
        yield packed(ids[anchor[once]], score[once], NEGATIVE, other[once])

    return rows.mapInArrow(best, "anchor bigint, key binary")


def first_positives(k: int):
    """The first ``k`` keys of each anchor in a sorted stream."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, taken = None, 0
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for j, anchor in enumerate(batch["anchor"].to_pylist()):
                if anchor != last:
                    last, taken = anchor, 0
                keep[j] = taken < k
                taken += 1
            yield batch.filter(pa.array(keep))

    return read


def emit(k: int, low: tuple[int, int]):
    """Read sorted keys once: positives open windows, negatives go to every open one, full or passed windows close."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, open_ = None, []
        for batch in batches:
            out = []
            for anchor, score, kind, other in zip(*(x.tolist() for x in unpacked(batch["key"])), strict=True):
                if anchor != last:
                    last, open_ = anchor, []
                if kind == POSITIVE:
                    open_.append([other, score, 0])
                    continue
                open_ = [w for w in open_ if w[2] < k and low[0] * w[1] <= low[1] * score]
                for w in open_:
                    w[2] += 1
                    out.append((anchor, w[0], w[2], other, w[1], score))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                  ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return read


def anchor_blocks(anchors: DataFrame, block: int) -> Iterator[DataFrame]:
    """The anchors in parts of at most ``block`` rows: whole files of a written table, each no longer than that."""
    spark = anchors.sparkSession
    path = f"{shared_folder(spark)}/liftfield/anchors-{uuid.uuid4().hex}"
    anchors.write.option("maxRecordsPerFile", block).parquet(path)
    table = spark.read.schema(anchors.schema).parquet(path)
    part, size = [], 0
    for r in table.groupBy(F.col("_metadata.file_path").alias("file")).count().orderBy("file").toLocalIterator():
        if part and size + r["count"] > block:
            yield spark.read.schema(anchors.schema).parquet(*part)
            part, size = [], 0
        part.append(r["file"])
        size += r["count"]
    if part:
        yield spark.read.schema(anchors.schema).parquet(*part)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100),
                   scale: int = 256, block: int = BLOCK, id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """For each anchor and each of its ``positives`` best rows of the same label, the best ``negatives`` rows of other labels
    whose score is at most the positive's and at least ``low`` (a fraction) of it.

    A score is the inner product of components ``floor(scale * x)``, an exact whole number; higher comes first, ties by
    smaller id. ``anchors`` is a condition on ``id``. Rows with a null id, label, vector, or a component that is null or not
    finite take no part. Repeated rows each take a place of their own, but never beside the anchor of their id; an anchor
    id counts once, with its least label and components. Vectors of another length than the block's longest count as zero
    beyond their end. An anchor without positives, or a positive without negatives, gives no row; an empty table gives an
    empty one. Other columns are not read.

    The work is anchors times rows, as stated by the anchor set, done in blocks of ``block`` anchors; a task keeps at most
    ``positives * negatives`` rows an anchor, and only those are shuffled.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, scale, id, label, vector)
    chosen = usable(vectors.where(anchors), scale, id, label, vector)
    chosen = chosen.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select("id", "v.*")
    path = f"{shared_folder(spark)}/liftfield/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], OUT).write.parquet(f"{path}/none")
    paths = [f"{path}/none"]
    for part in anchor_blocks(chosen, block):
        t = part.toArrow().combine_chunks()
        ids, labels = t["id"].to_numpy(), t["label"].to_numpy()
        lists = t["vector"].combine_chunks()
        own = dense(lists, max(pc.max(pc.list_value_length(lists)).as_py(), 1))
        sent = spark.sparkContext.broadcast((ids, labels, own, None))
        first = secondary_sort(same_label(rows, sent, positives)).mapInArrow(first_positives(positives), "anchor bigint, key binary")
        first = cut_lineage(first)
        anchor, score, _, _ = unpacked(first.toArrow()["key"].combine_chunks())  # at most ``block`` times ``positives``
        order = np.argsort(ids)
        sent_windows = spark.sparkContext.broadcast((ids, labels, own, (order[np.searchsorted(ids, anchor, sorter=order)], score)))
        both = first.unionByName(other_labels(rows, sent_windows, negatives, low))
        paths.append(f"{path}/{len(paths)}")
        secondary_sort(both).mapInArrow(emit(negatives, low), OUT).write.parquet(paths[-1])
    return spark.read.schema(OUT).parquet(*paths)
