"""Quality rules: counts of each text, and a calibrated logistic regression on hashed n-grams.

Features are the shares of hashed character n-grams (two and three bytes of UTF-8) and word n-grams (one and two
words), so a text's score is a mean of looked-up weights: scoring needs no feature matrix. The weights are fitted on
a bounded sample of labelled rows, a held-out quarter of it calibrates the probability (Platt), and the classes'
true shares among all labelled rows are restored by a shift of the log-odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.llm.common import coded, hash_words, inside, labelled_sample, mix, pieces, split_words, texts

BITS = 12
FAMILIES = 4
SCALE = 30.0
#: Labelled rows of either class that the fit may use, and the length up to which it uses them.
SAMPLE_ROWS = 1200
SAMPLE_BYTES = 50_000
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
LEAST_PROBABILITY = 0.5
COLUMNS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double"


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (scores + self.bias) + self.shift, -60, 60)))


def hashed(text: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: hashed feature and row of every n-gram of the texts."""
    plain = pc.fill_null(text.cast(pa.large_string()), "")
    sizes = pc.binary_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(plain.cast(pa.large_binary()).to_pylist()), np.uint8).astype(np.uint32)
    rows = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    shift = np.uint32(32 - BITS)
    for family, n in enumerate((2, 3)):
        ok = inside(rows, n)
        key = raw[: len(ok)].copy()
        for k in range(1, n):
            key |= raw[k : k + len(ok)] << np.uint32(8 * k)
        yield (((key[ok] * np.uint32(2654435761)) >> shift) + np.uint32(family << BITS)).astype(np.int32), rows[: len(ok)][ok]
    words, rows = split_words(text)
    ids, distinct = coded(words)
    h = hash_words(distinct)[ids] if len(ids) else np.zeros(0, np.uint64)
    yield ((mix(h) >> np.uint64(64 - BITS)) + np.uint64(2 << BITS)).astype(np.int32), rows
    ok = inside(rows, 2)
    pair = mix(h[: len(ok)] * np.uint64(3) + (h[1:] if len(ok) else h[:0]))[ok]
    yield ((pair >> np.uint64(64 - BITS)) + np.uint64(3 << BITS)).astype(np.int32), rows[: len(ok)][ok]


def raw_scores(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(text))
    for features, rows in hashed(text):
        total = np.bincount(rows, weights[features], len(text))
        out += SCALE * total / np.maximum(np.bincount(rows, minlength=len(text)), 1)
    return out


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = FAMILIES << BITS
    for batch in pieces(batches, most=1 << 20):
        n = batch.num_rows
        dense = np.zeros((n, size), np.float32)
        for features, rows in hashed(batch["text"]):
            flat = np.bincount(rows.astype(np.int64) * size + features, minlength=n * size).reshape(n, size)
            dense += SCALE * flat / np.maximum(np.bincount(rows, minlength=n), 1)[:, None]
        at = [np.flatnonzero(x).astype(np.int32) for x in dense]
        yield pa.record_batch({"doc_id": batch["doc_id"], "label": batch["label"], "at": pa.array(at, pa.list_(pa.int32())),
                               "x": pa.array([d[a] for d, a in zip(dense, at, strict=True)], pa.list_(pa.float32()))})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> QualityModel | None:
    """Fit on at most ``rows`` labelled documents of each class, in a task; None if one class has no rows."""
    sample = labelled_sample(docs, labels, "quality", (rows, rows), longest=longest).select("doc_id", "label", "text")
    parts = sample.mapInArrow(sample_features, "doc_id bigint, label int, at array<int>, x array<float>")
    got = parts.repartition(1).mapInArrow(learned, "weights binary, bias double, slope double, offset double, good bigint, bad bigint").collect()
    if not got:
        return None
    shares = {r["q"]: r["n"] for r in labels.groupBy(F.col("quality").cast("int").alias("q")).agg(F.count("*").alias("n"))
              .where(F.col("q").isin(0, 1)).collect()}
    r = got[0]
    prior = np.log(shares[1] / shares[0]) - np.log(r["good"] / r["bad"])
    return QualityModel(np.frombuffer(r["weights"], np.float32), r["bias"], r["slope"], float(r["offset"] + prior))


def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of the bounded sample, in a task: the driver gets its weights and no features. Nothing if a class has no rows."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    got = pa.Table.from_batches(parts).sort_by("doc_id")
    y = got["label"].to_numpy().astype(float)
    if y.min() == y.max():
        return
    values = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (got["at"], got["x"])]
    at, x = (v.flatten().to_numpy(zero_copy_only=False) for v in values)
    row = np.repeat(np.arange(len(y)), pc.list_value_length(got["at"]).to_numpy())
    weights, bias = descend(at, x, row, y, np.arange(len(y)) % 4 != 3)
    z = np.bincount(row, x * weights[at], len(y)) + bias
    held = np.arange(len(y)) % 4 == 3
    if len(set(y[held])) < 2:
        held = np.ones(len(y), bool)
    slope, offset = platt(z[held], y[held])
    yield pa.record_batch({"weights": pa.array([weights.astype(np.float32).tobytes()], pa.binary()), "bias": [float(bias)], "slope": [float(slope)],
                           "offset": [float(offset)], "good": [int(y.sum())], "bad": [int(len(y) - y.sum())]})


def descend(at: np.ndarray, x: np.ndarray, row: np.ndarray, y: np.ndarray, used: np.ndarray, steps: int = 150, rate: float = 0.05,
            ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Adam on the whole sample; both classes weigh the same."""
    w = np.zeros((FAMILIES << BITS) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    each = np.where(y > 0, 0.5 / max(1, (used & (y > 0)).sum()), 0.5 / max(1, (used & (y == 0)).sum())) * used
    for t in range(1, steps + 1):
        z = np.bincount(row, x * w[at], len(y)) + w[-1]
        r = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * each
        g = np.append(np.bincount(at, x * r[row], len(w) - 1), r.sum()) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:-1], w[-1]


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the probability, with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -60, 60)))
        h = x.T @ (x * (q * (1 - q) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        p = p - np.clip(np.linalg.solve(h, x.T @ (q - target)), -2, 2)
    return max(p[0], 1e-3), p[1]


def base_counts(text: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text; a null text has none."""
    n = len(text)
    plain = pc.fill_null(text.cast(pa.large_string()), "")
    words, rows = split_words(text)
    out = {"n_words": np.bincount(rows, minlength=n)}
    out["word_chars"] = np.bincount(rows, pc.utf8_length(words).to_numpy(zero_copy_only=False), n).astype(np.int64)
    out["n_symbols"] = pc.count_substring_regex(plain, "[#*$%&|<>]").to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(plain, "\n")
    lines, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
    lines, owner = lines.filter(full), owner[full.to_numpy(zero_copy_only=False)]
    ids, distinct = coded(lines)
    first = np.unique(owner * max(len(distinct), 1) + ids) // max(len(distinct), 1)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(first, minlength=n)
    ids, distinct = coded(words)
    ok = inside(rows, 3)
    covered = np.zeros(len(rows), bool)
    if ok.any():
        at, v = np.flatnonzero(ok), len(distinct)
        pair = ids[at] * v + ids[at + 1]
        if v >= 1 << 21:
            pair = np.unique(pair, return_inverse=True)[1]
        key, own = pair * v + ids[at + 2], rows[at]
        order = np.argsort(mix(key.view(np.uint64) + mix(own.view(np.uint64) + np.uint64(1))))
        same = (key[order][1:] == key[order][:-1]) & (own[order][1:] == own[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
    return out


def judged(model: QualityModel | None, text: pa.Array, least: float) -> dict[str, np.ndarray]:
    out = base_counts(text)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"])
    out["probability"] = model.probability(raw_scores(text, model.weights)) if model else np.ones(len(text))
    out["kept"] = ~out["base_failed"] & (out["probability"] >= least)
    return out


def quality(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs`` with its counts, ``base_failed``, the probability of good quality and ``kept``.

    A null or empty text has no words and so fails the base rules. A null id is passed through. Without labels of
    both classes there is no model: the probability is 1 and the base rules alone decide.
    """
    model = fit(docs, labels, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            got = judged(model, batch["text"], least)
            yield pa.record_batch({"doc_id": batch["doc_id"]} | {k: pa.array(got[k]) for k in
                                  ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")})

    return texts(docs).mapInArrow(score, COLUMNS)


def good_documents(docs: DataFrame, labels: DataFrame, least: float = LEAST_PROBABILITY, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, all columns as they are; rows pass once through Python, nothing is shuffled."""
    model = fit(docs, labels, rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(judged(model, batch["text"].cast(pa.string()), least)["kept"]))

    return docs.mapInArrow(keep, docs.schema)
