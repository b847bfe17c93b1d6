"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled first: in a bounded sample of labelled rows, a feature (the
word, or its first four to eight characters) is a sign of toxicity if it is far more frequent in toxic documents
than in others by the likelihood ratio; a token with such a sign is toxic in a toxic document. The field has two tags, hashed features
of the token and of its neighbours, and tag-to-tag weights; it is fitted by maximum likelihood with forward-backward.
Squared marginals of the whole text's tokens, those of at least a fifth, add up to a toxic mass (unlikely tokens make
none, however long the text), which a logistic curve fitted on the sample turns into the document's score. Near copies in the sample count once as evidence. Runs of likely toxic tokens are the offending spans.

The recursions run over a whole batch at once: texts are one long chain whose transition at a text's first token
forgets what came before, cut into blocks of equal length that are scanned side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from liftfield.llm.common import coded, hash_words, inside, labelled_sample, mix, pieces, split_words, texts, windows

BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
#: Learning rows without and with toxicity that the fit may use, and the length up to which it uses them.
SAMPLE_ROWS = (3200, 800)
SAMPLE_BYTES = 20_000
LEAST_EVIDENCE = 20.0
THRESHOLD = 0.3
SPAN_MARGINAL = 0.5
MASS_MARGINAL = 0.2
BLOCK = 128


@dataclass
class TaggerModel:
    """Log-odds of the toxic tag by feature, the two-by-two transition weights (log), and the document curve."""

    weights: np.ndarray
    bias: float
    moves: np.ndarray
    slope: float
    offset: float

    def scores(self, expected: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log(expected + 1e-4) + self.offset, -60, 60)))


def token_features(distinct: pa.Array) -> np.ndarray:
    """Hashed word and prefixes of the lower-cased word without punctuation at its ends: one row for each word."""
    clean = pc.utf8_lower(distinct.cast(pa.large_string()))
    clean = pc.replace_substring_regex(clean, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")
    columns = [hash_words(clean)] + [mix(hash_words(pc.utf8_slice_codeunits(clean, 0, n)) + np.uint64(n)) for n in PREFIXES]
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in columns], 1).reshape(-1, len(columns))


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number of each token, its row, and the features of the distinct words."""
    words, rows = split_words(text)
    ids, distinct = coded(words)
    return ids, rows, token_features(distinct)


def scan(first: np.ndarray, gain: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Forward messages (share of the toxic tag after each token) of chains laid end to end.

    ``first`` marks chain starts, ``gain`` is the toxic tag's factor at each token, ``moves[a, b]`` the factor from
    tag a to b. Each token maps the odds u of the toxic tag to (m01 + m11 u) / (m00 + m10 u) * gain; these maps are
    two-by-two matrices, multiplied within blocks first, then from block to block, then applied inside the blocks.
    """
    n = len(gain)
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    g = np.concatenate([gain, np.ones(pad)]).reshape(blocks, BLOCK).T
    f = np.concatenate([first, np.zeros(pad, bool)]).reshape(blocks, BLOCK).T
    (m00, m01), (m10, m11) = moves
    # rows of the product: what (1, 0) and (0, 1) before the block become
    p = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
    for t in range(BLOCK):
        for k in (0, 2):
            a, b = p[k], p[k + 1]
            start = a + b
            na = np.where(f[t], start, a * m00 + b * m10)
            nb = np.where(f[t], start, a * m01 + b * m11) * g[t]
            p[k], p[k + 1] = na, nb
        scale = p[0] + p[1] + p[2] + p[3]
        p = [x / scale for x in p]
    entry = np.zeros((2, blocks))
    a, b = 1.0, 0.0
    for k in range(blocks):
        entry[:, k] = a, b
        a, b = a * p[0][k] + b * p[2][k], a * p[1][k] + b * p[3][k]
        a, b = a / (a + b), b / (a + b)
    out = np.zeros((BLOCK, blocks))
    a, b = entry
    for t in range(BLOCK):
        start = a + b
        a, b = np.where(f[t], start, a * m00 + b * m10), np.where(f[t], start, a * m01 + b * m11) * g[t]
        s = a + b
        a, b = a / s, b / s
        out[t] = b
    return out.T.ravel()[:n]


def marginals(rows: np.ndarray, gain: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of the toxic tag at each token; forward and backward shares."""
    if not len(rows):
        return np.zeros(0), np.zeros(0), np.zeros(0)
    edge = rows[1:] != rows[:-1]
    forward = scan(np.concatenate([[True], edge]), gain, moves)
    after = scan(np.concatenate([[True], edge[::-1]]), gain[::-1], moves.T)[::-1]  # shares with the own token's factor
    odds_after = after / np.maximum((1 - after) * gain, 1e-300)
    odds = forward / np.maximum(1 - forward, 1e-300) * odds_after
    return odds / (1 + odds), forward, odds_after


def factors(weights: np.ndarray, bias: float, ids: np.ndarray, features: np.ndarray) -> np.ndarray:
    return np.exp(np.clip(weights[features].sum(1) + bias, -30, 30))[ids]


def mass(rows: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Sum of squared marginals of each row's tokens that are at least ``MASS_MARGINAL``."""
    return np.bincount(rows, np.where(p >= MASS_MARGINAL, p * p, 0.0), n).astype(float)


def labelled_tokens(ids: np.ndarray, rows: np.ndarray, features: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which tokens of toxic rows carry a sign of toxicity."""
    hits = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for column in range(features.shape[1]):
        pair = np.unique(rows * (1 << BITS) + features[ids, column])
        for c in (0, 1):
            hits[c] += np.bincount(pair[y[pair >> BITS] == c] & ((1 << BITS) - 1), minlength=1 << BITS)
    n0, n1 = (max(1, int((y[np.unique(rows)] == c).sum())) for c in (0, 1))
    clean, toxic = hits
    both = (clean + toxic) / (n0 + n1)

    def part(k: np.ndarray, n: int) -> np.ndarray:
        p = k / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(p / both)) + np.nan_to_num((n - k) * np.log((1 - p) / (1 - both)))

    evidence = np.where(toxic / n1 > 10 * clean / n0, 2 * (part(clean, n0) + part(toxic, n1)), 0)
    sign = evidence >= LEAST_EVIDENCE
    return sign[features].any(1)[ids] & (y[rows] == 1)


def distinct_rows(ids: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """False for rows that share one of two least hashes of three-word runs with an earlier row: near copies."""
    out = np.ones(n, bool)
    ok = inside(rows, 3)
    for salt in (1, 2):
        h = mix(windows(mix(ids.astype(np.uint64) + np.uint64(1)), 3) + np.uint64(salt))[ok]
        own = rows[: len(ok)][ok]
        if len(own):
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            _, kept = np.unique(np.minimum.reduceat(h, first), return_index=True)
            once = np.ones(n, bool)
            once[own[first]] = False
            once[own[first[kept]]] = True
            out &= once
    return out


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: tuple[int, int] = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> TaggerModel | None:
    """Fit on a bounded sample of the rows of ``labels`` that ``learn`` admits; None if one class has no rows."""
    got = labelled_sample(docs, labels, "toxic", sample_rows, learn, longest).select("doc_id", "label", "text").toArrow().sort_by("doc_id")
    y = got["label"].to_numpy().astype(np.int64)
    if not len(y) or y.min() == y.max():
        return None
    ids, rows, features = tokens_of(got["text"].combine_chunks())
    alone = distinct_rows(ids, rows, len(y))
    keep = alone[rows]
    ids, rows = ids[keep], rows[keep]
    tag = labelled_tokens(ids, rows, features, y)
    usable = (y == 0) | (np.bincount(rows, tag, len(y)) > 0)
    keep = usable[rows]
    ids, rows, tag = ids[keep], rows[keep], tag[keep]
    edge = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    inner = ~edge
    seen = np.zeros((2, 2))
    np.add.at(seen, (tag[:-1][inner[1:]].astype(int), tag[1:][inner[1:]].astype(int)), 1)
    w, moves = np.zeros((1 << BITS) + 1), np.zeros((2, 2))
    w[-1] = np.log((tag.sum() + 1) / (len(tag) + 1))
    truth = np.bincount(ids, tag, len(features))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for t in range(1, 41):
        gain = factors(w[:-1], w[-1], ids, features)
        e = np.exp(moves)
        p, forward, odds_after = marginals(rows, gain, e)
        per_word = np.bincount(ids, p, len(features)) - truth
        g = np.zeros(len(w) + 4)
        for column in range(features.shape[1]):
            g[: len(w) - 1] += np.bincount(features[:, column], per_word, len(w) - 1)
        g[len(w) - 1] = per_word.sum()
        # expected moves: forward share before, move, own factor, backward share after
        before, at = forward[:-1][inner[1:]], np.flatnonzero(inner[1:]) + 1
        joint = np.stack([(1 - before) * e[0, 0], (1 - before) * e[0, 1] * gain[at] * odds_after[at], before * e[1, 0], before * e[1, 1] * gain[at] * odds_after[at]])
        g[len(w) :] = (joint / joint.sum(0)).sum(1) - seen.ravel()
        g[: len(w) - 1] += 0.1 * w[:-1]
        g[len(w) :] += 0.1 * moves.ravel()
        m, v = 0.9 * m + 0.1 * g, 0.95 * v + 0.05 * g * g
        step = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.95**t)) + 1e-6)
        w -= step[: len(w)]
        moves -= step[len(w) :].reshape(2, 2)
    model = TaggerModel(w[:-1], float(w[-1]), np.exp(moves), 1.0, 0.0)
    from liftfield.llm.quality import platt

    ids, rows, features = tokens_of(got["text"].combine_chunks())
    expected = mass(rows, marginals(rows, factors(model.weights, model.bias, ids, features), model.moves)[0], len(y))
    model.slope, model.offset = platt(np.log(expected + 1e-4), y.astype(float))
    return model


def judged(model: TaggerModel | None, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each text; rows and marginals of its tokens."""
    n = len(text)
    if model is None:
        return np.zeros(n), np.zeros(0, np.int64), np.zeros(0)
    ids, rows, features = tokens_of(text)
    p = marginals(rows, factors(model.weights, model.bias, ids, features), model.moves)[0]
    return model.scores(mass(rows, p, n)), rows, p


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<first_word:bigint,last_word:bigint>>"


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = THRESHOLD,
             sample_rows: tuple[int, int] = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` and the offending ``spans`` (words, from 0) of each row.

    Rows that ``held_out`` (over ``doc_id``) marks are not learned from. A text that is null or blank scores like one
    without toxic tokens; without labels of both classes every score is 0.
    """
    model = fit(docs, labels, ~held_out, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))
        for batch in pieces(batches):
            score, rows, p = judged(model, batch["text"])
            bad = np.flatnonzero(p >= SPAN_MARGINAL)
            starts = np.searchsorted(rows, np.arange(batch.num_rows))
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            new = np.concatenate([[True], (np.diff(bad) > 1) | (rows[bad][1:] != rows[bad][:-1])]) if len(bad) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            for a, b in zip(bad[first].tolist(), bad[np.append(first[1:] - 1, len(bad) - 1)].tolist() if len(bad) else [], strict=True):
                s = starts[rows[a]]
                spans[rows[a]].append({"first_word": int(a - s), "last_word": int(b - s)})
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score,
                                   "predicted": (score >= threshold).astype(np.int32), "spans": pa.array(spans, kind)})

    return texts(docs, held_out.alias("held_out")).mapInArrow(run, SCHEMA)
