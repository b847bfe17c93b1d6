"""SimHash fingerprints and their near-duplicate components, through a Gray-order hierarchical index.

At most three of 64 bits differ, so one of four 16-bit blocks is equal: each distinct fingerprint is filed under its
four blocks. Within a file fingerprints are sorted by the Gray rank of their bits, which puts those that differ in few
bits next to each other, and cut into leaf nodes. A node keeps the bits that all its members share; an upper node
keeps what a run of nodes shares. Two nodes meet only if the bits that both fix differ in at most three places, level
by level from the top, so whole groups are pruned by the differences gathered so far. Members of two surviving leaves
are compared bit by bit, and a leaf pair gives back a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StructField, StructType

from liftfield.llm.common import pieces, tasks, texts
from liftfield.session import cut_lineage

SHINGLE = 3
SEED = 42
MOST_BITS = 3
BLOCKS = 4
#: Members of a leaf, and children of an upper node.
FANOUT = 256
LEVELS = 2
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bit k is set if it is set in over half the hashes of the word shingles; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < size:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(words) - size + 1]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[size - 1 :].tolist(), strict=True)),
                             np.uint64, len(starts))
    columns = hashes.view(np.uint8).reshape(-1, 8)
    set_bits = np.stack([np.bincount(columns[:, k], minlength=256) @ BYTE_BITS for k in range(8)]).ravel()
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed 64-bit value, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = np.array([fingerprint(t, size) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": batch["doc_id"], "fp": pa.array(fp.view(np.int64))})

    return texts(docs).mapInArrow(run, "doc_id bigint, fp bigint")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its four blocks, with the Gray rank after the block is turned to the top."""
    for batch in batches:
        fp = batch["fp"].to_numpy().view(np.uint64)
        for k in range(BLOCKS):
            turned = fp if k == 0 else (fp << np.uint64(16 * k)) | (fp >> np.uint64(64 - 16 * k))
            file = (turned >> np.uint64(48)).astype(np.int64) + (k << 16)
            rank = gray_rank(turned).view(np.int64) ^ np.int64(-(2**63))  # signed order equals unsigned order
            yield pa.record_batch({"file": file, "rank": rank, "fp": batch["fp"]})


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between ``a`` and ``b`` that join all that lie within the distance; each new member is linked once."""
    got_a, got_b = [], []
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= MOST_BITS
    seen_a, seen_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for start in np.flatnonzero(near.any(1)):
        if seen_a[start]:
            continue
        seen_a[start] = True
        queue = [start]
        while queue:
            i = queue.pop()
            new_b = np.flatnonzero(near[i] & ~seen_b)
            seen_b[new_b] = True
            got_a += [i] * len(new_b)
            got_b += new_b.tolist()
            for j in new_b:
                new_a = np.flatnonzero(near[:, j] & ~seen_a)
                seen_a[new_a] = True
                got_a += new_a.tolist()
                got_b += [j] * len(new_a)
                queue += new_a.tolist()
    return a[np.array(got_a, np.int64)], b[np.array(got_b, np.int64)]


def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})


NODE = "file bigint, level int, node string, parent string, ones bigint, zeros bigint, members array<bigint>"


def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut rows in (file, rank) order into leaf nodes and these into upper nodes; a node never spans two files."""
    import uuid

    name, count, rest = uuid.uuid4().hex, 0, None
    pending: list[tuple] = []

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        nonlocal count
        out = {k: [] for k in ("file", "level", "node", "parent", "ones", "zeros", "members")}
        at = 0
        while at < len(rows):
            file, to = rows[at][0], at
            while to < len(rows) and to < at + FANOUT and rows[to][0] == file:
                to += 1
            count += 1
            top = f"{name}-{count}"
            for k, (_, ones, zeros, members) in enumerate(rows[at:to]):
                for key, v in zip(out, (file, 0, f"{top}.{k}", top, ones, zeros, members), strict=True):
                    out[key].append(v)
            ones = int(np.bitwise_and.reduce(np.array([r[1] for r in rows[at:to]], np.int64)))
            zeros = int(np.bitwise_and.reduce(np.array([r[2] for r in rows[at:to]], np.int64)))
            for key, v in zip(out, (file, 1, top, None, ones, zeros, None), strict=True):
                out[key].append(v)
            at = to
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("file", pa.int64()), ("level", pa.int32()), ("node", pa.string()),
            ("parent", pa.string()), ("ones", pa.int64()), ("zeros", pa.int64()), ("members", pa.list_(pa.int64()))]))

    def cut(file: np.ndarray, fp: np.ndarray, final: bool) -> int:
        """Turn all complete runs into leaves; the number of rows used."""
        starts = np.flatnonzero(np.concatenate([[True], file[1:] != file[:-1]]))
        used = 0
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(file)], strict=True):
            for at in range(s, e, FANOUT):
                to = min(at + FANOUT, e)
                if to == len(file) and not final and to - at < FANOUT:
                    return used
                part = fp[at:to]
                pending.append((int(file[at]), int(np.bitwise_and.reduce(part)), int(np.bitwise_and.reduce(~part)), part))
                used = to
        return used

    for batch in batches:
        file, fp = batch["file"].to_numpy(), batch["fp"].to_numpy()
        if rest is not None:
            file, fp = np.concatenate([rest[0], file]), np.concatenate([rest[1], fp])
        if not len(file):
            continue
        used = cut(file, fp, False)
        rest = file[used:].copy(), fp[used:].copy()
        if len(pending) >= 4 * FANOUT:
            yield flush(pending)
            pending = []
    if rest is not None and len(rest[0]):
        cut(*rest, True)
    if pending:
        yield flush(pending)


def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside leaves; runs of small leaves are compared together, and leaf numbers keep them apart."""
    for batch in batches:
        members = batch["members"]
        fp = pc.list_flatten(members).to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = pc.list_value_length(members).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        for size in np.unique(sizes[(sizes > 1) & (sizes <= 16)]):
            group = fp[(ends[sizes == size] - size)[:, None] + np.arange(size)]
            for i in range(size):
                for j in range(i + 1, size):
                    near = np.bitwise_count(group[:, i] ^ group[:, j]) <= MOST_BITS
                    yield links(group[near, i], group[near, j])
        for k in np.flatnonzero(sizes > 16):
            own = fp[ends[k] - sizes[k] : ends[k]]
            yield links(*forest(own, own))


def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x, y in zip(batch["x"], batch["y"], strict=True):
            yield links(*forest(x.values.to_numpy(zero_copy_only=False).view(np.uint64), y.values.to_numpy(zero_copy_only=False).view(np.uint64)))


def node_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs of leaves of one file that may hold a link: pairs of upper nodes first, then only the children of survivors."""
    top = nodes.where("level = 1").select("file", "node", "ones", "zeros")
    right = top.select("file", *[F.col(c).alias(f"{c}_r") for c in ("node", "ones", "zeros")])
    fixed = "bit_count((ones & zeros_r) | (zeros & ones_r))"
    survivors = top.join(right, "file").where(f"node <= node_r and {fixed} <= {MOST_BITS}").select("node", "node_r")
    leaf = nodes.where("level = 0").select("parent", F.col("node").alias("leaf"), "ones", "zeros", "members")
    several = survivors.join(leaf, survivors["node"] == leaf["parent"]).drop("parent", "node")
    other = leaf.select(F.col("parent").alias("node_r"), F.col("leaf").alias("leaf_r"), F.col("ones").alias("ones_r"),
                        F.col("zeros").alias("zeros_r"), F.col("members").alias("y"))
    return several.join(other, "node_r").where(f"leaf < leaf_r and {fixed} <= {MOST_BITS}").select(F.col("members").alias("x"), "y")


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints ``fp`` whose components are those of all links."""
    n = tasks(distinct)
    rows = distinct.select("fp").mapInArrow(filed, "file bigint, rank bigint, fp bigint")
    sorted_rows = rows.repartitionByRange(n, "file", "rank").sortWithinPartitions("file", "rank").select("file", "fp")
    nodes = cut_lineage(sorted_rows.mapInArrow(leaves, NODE))
    # an upper node alone in its file, with one leaf, has no pair: only files with more go on
    busy = nodes.where("level = 0").groupBy("file").agg(F.count("*").alias("leaves")).where("leaves > 1").select("file")
    crossing = node_pairs(cut_lineage(nodes.join(busy, "file", "left_semi")))
    inner = nodes.where("level = 0 and size(members) > 1").select("members").mapInArrow(within, "a bigint, b bigint")
    return inner.unionByName(crossing.repartition(n).mapInArrow(between, "a bigint, b bigint")).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``v`` and ``root`` (the least vertex reachable) of each vertex of undirected ``edges`` (a, b).

    Alternates large-star and small-star steps until nothing changes; every step is aggregated on both sides before
    rows move, and is written to the shared folder, so nothing recomputes and no link reaches the driver.
    """
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # v is the smaller end of every row, and the vertices with a smaller neighbour are those whose least is another
        lower = e.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        large = cut_lineage(lower.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "v")
        before = now


def component_tables(docs: DataFrame, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of all rows, and (fp, root, component_id) of all distinct fingerprints."""
    prints = cut_lineage(fingerprints(docs, size))
    own = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut_lineage(components(fingerprint_links(own)))
    linked = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
    named = linked.join(own, linked["v"] == own["fp"]).groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(named, "root").select(F.col("v").alias("fp"), "root", "component")
    ids = own.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component", "least").alias("component_id"))
    return prints, cut_lineage(ids)


def simhash_components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` (least id reachable) of each row.

    A text without words, or null, has fingerprint 0 and is linked like any other. Rows that repeat an id are separate
    rows of one document. A null id never names a component: a component of such rows alone has a null id. An empty
    table gives no rows.
    """
    prints, ids = component_tables(docs, size)
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component: that of the least id, all columns as they are.

    Of rows that repeat this id within the component the one of least text stays. A component of null ids keeps one row.
    """
    columns = docs.columns
    _, ids = component_tables(docs, size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            fp = np.array([fingerprint(t, size) for t in batch["text"].cast(pa.string()).to_pylist()], np.uint64)
            yield batch.append_column("__fp", pa.array(fp.view(np.int64)))

    rows = docs.mapInArrow(add, StructType([*docs.schema.fields, StructField("__fp", LongType())]))
    ids = ids.withColumnsRenamed({"fp": "__fp", "root": "__root", "component_id": "__component"})
    least = rows.join(ids, "__fp").where(F.col("doc_id").cast("bigint").eqNullSafe(F.col("__component")))
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)]
    chosen = least.groupBy("__root").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in columns]), F.struct("text", F.xxhash64(*plain))).alias("__row"))
    return chosen.select("__row.*")
