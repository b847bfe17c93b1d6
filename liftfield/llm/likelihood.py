"""Masked pseudo-likelihood of documents under a bidirectional window network.

Each token's class is predicted from the two tokens on either side, and the word from its class by the counts of all
words of the corpus, which stay a Spark table that scoring joins. Classes are the most frequent words, one each, the
endings of all other words, and the edge of a text; their numbers grow with the square root of the distinct words that
occur at least ``COUNTED`` times. Texts are written once as classes; a hash of their content deals them to a number of
learners that the corpus alone sets, each learns from all its windows, and their weights are averaged after each round. The
driver holds one set of weights and the vocabulary.

With a given number of words, a fixed network of one token on either side scores classes only: the counts of all
(left, token, right) windows are sufficient for its loss, and it becomes a table of conditional log-probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liftfield.llm.common import coded, hash_words, pieces, split_words, tasks, texts
from liftfield.session import cut_lineage

WORDS = 127
ENDINGS = 32
HIDDEN = 24
STEPS = 80
RATE = 0.05
#: Added to each target's share of a context, so that unseen windows keep a probability.
SMOOTHING = 0.02


def cleaned(distinct: pa.Array) -> pa.Array:
    clean = pc.utf8_lower(distinct.cast(pa.large_string()))
    return pc.replace_substring_regex(clean, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "")


def frequent_words(docs: DataFrame, words: int = WORDS) -> list[str]:
    """The most frequent cleaned words of all documents; ties by code point."""

    counts = word_counts(docs).where("word != ''")
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(words).collect()]


class Tokens:
    """Ids of words: the frequent ones, then classes by ending, then the edge of a text."""

    def __init__(self, words: list[str]):
        order = np.argsort(hash_words(pa.array(words, pa.large_string()))) if words else np.zeros(0, np.int64)
        self.hashes = hash_words(pa.array([words[k] for k in order], pa.large_string()))
        self.ids = np.array(order, np.int64)
        self.edge = len(words) + ENDINGS
        self.size = self.edge + 1

    def windows(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(left, token, right) as one number, and the row, for each token."""
        words, rows = split_words(text)
        code, distinct = coded(words)
        clean = cleaned(distinct)
        h = hash_words(clean)
        ending = (hash_words(pc.utf8_slice_codeunits(clean, -2, None)) % np.uint64(ENDINGS)).astype(np.int64) + len(self.ids)
        if len(self.hashes) and len(h):
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            ending = np.where(self.hashes[at] == h, self.ids[at], ending)
        t = ending[code] if len(code) else code
        same = rows[1:] == rows[:-1]
        left, right = np.full(len(t), self.edge), np.full(len(t), self.edge)
        left[1:][same] = t[:-1][same]
        right[:-1][same] = t[1:][same]
        return (left * self.size + t) * self.size + right, rows


def window_counts(docs: DataFrame, tokens: Tokens) -> np.ndarray:
    """Counts [left, token, right] over all documents; each task sends what it has seen once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tokens.size**3, np.int64)
        for batch in pieces(batches):
            total += np.bincount(tokens.windows(batch["text"])[0], minlength=len(total))
        some = np.flatnonzero(total)
        for at in range(0, len(some), 1 << 18):
            part = some[at : at + (1 << 18)]
            yield pa.record_batch({"w": part.astype(np.int32), "n": total[part]})

    got = texts(docs).mapInArrow(run, "w int, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(tokens.size**3, np.float32)
    out[got["w"].to_numpy()] = got["n"].to_numpy()
    return out.reshape((tokens.size,) * 3)


def train(counts: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """Conditional log-probabilities [left, token, right] of the trained network; Adam on all windows."""
    v = counts.shape[0]
    by_context = counts.transpose(0, 2, 1).reshape(v * v, v)
    weight = by_context.sum(1)
    seen = np.flatnonzero(weight)
    rng = np.random.default_rng(seed)
    shape = {"l": (v, hidden), "r": (v, hidden), "c": (hidden,), "u": (hidden, v), "b": (v,)}
    w = {k: (rng.normal(0, 0.3, s) if len(s) == 2 else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    if len(seen):
        w["b"] = np.log((by_context.sum(0) + 1) / (weight.sum() + v)).astype(np.float32)
        share = weight[seen] / weight.sum()
        target = by_context[seen] / weight.sum()
        left, right = seen // v, seen % v
        m, s2 = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
        for t in range(1, steps + 1):
            h = np.tanh(w["l"][left] + w["r"][right] + w["c"])
            p = softmax(h @ w["u"] + w["b"])
            d = p * share[:, None] - target
            g = {"u": h.T @ d, "b": d.sum(0)}
            dh = (d @ w["u"].T) * (1 - h * h)
            g["c"] = dh.sum(0)
            grid = np.zeros((v * v, dh.shape[1]), np.float32)
            grid[seen] = dh
            grid = grid.reshape(v, v, -1)
            g["l"], g["r"] = grid.sum(1), grid.sum(0)
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s2[k] = 0.98 * s2[k] + 0.02 * g[k] ** 2
                w[k] -= RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(s2[k] / (1 - 0.98**t)) + 1e-8)
    h = np.tanh(w["l"][:, None] + w["r"][None] + w["c"]).reshape(v * v, -1)
    p = (1 - SMOOTHING) * softmax(h @ w["u"] + w["b"]) + SMOOTHING / v
    return np.log(p).astype(np.float32).reshape(v, v, v).transpose(0, 2, 1).copy()


def softmax(z: np.ndarray) -> np.ndarray:
    """In place."""
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def powers_of(z: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """A softmax before its division, in place, and the sums; ``small`` says that no value is large enough to overflow."""
    if not small:
        z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    return z, z @ np.ones(z.shape[1], z.dtype)


def descend(w: dict[str, np.ndarray], squares: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
    """A step of AdaGrad in place; the tables are as large as a step's work, so nothing is allocated for them but once."""
    for x in w:
        step = np.multiply(g[x], g[x])
        squares[x] += step
        np.sqrt(squares[x], out=step)
        np.divide(g[x], step, out=step)
        step *= np.float32(rate)
        w[x] -= step


#: Distinct words of the corpus that occur so often let the vocabulary and the classes of all other words grow.
COUNTED = 5
OFFSETS = (-2, -1, 1, 2)
#: Tokens whose hidden units are held at once.
SCORED = 1 << 15
#: Tokens of rare words that a task holds before it writes each of these words with its documents.
RARE = 1 << 21
#: Rows of a block of an id's rows.
TOGETHER = 8
#: There are as many learners as the square root of the corpus in units of so many tokens, and a step of training takes as
#: many tokens as the square root of all, so each learner makes about the same number of steps at every size.
LEARNED = 1_000_000
ROUNDS = 2
ADDED = 0.5
CHUNK = 4096


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (cleaned, also the empty one) and ``n`` of the whole corpus, one row for each distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, distinct = coded(split_words(batch["text"])[0])
            yield pa.record_batch({"word": cleaned(distinct).cast(pa.string()), "n": np.bincount(ids, minlength=len(distinct))})

    return texts(docs).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


class Classes(Tokens):
    """Ids of words as in Tokens, with a number of endings; and windows of two words on either side."""

    def __init__(self, words: list[str], endings: int):
        super().__init__(words)
        self.endings = endings
        self.edge = len(words) + endings
        self.size = self.edge + 1

    def of(self, clean: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hash and class of cleaned words."""
        h = hash_words(clean)
        out = np.full(len(h), -1)
        if len(self.hashes) and len(h):
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            out = np.where(self.hashes[at] == h, self.ids[at], -1)
        rare = np.flatnonzero(out < 0)
        ending = hash_words(pc.utf8_slice_codeunits(clean.take(pa.array(rare)), -2, None))
        out[rare] = (ending % np.uint64(self.endings)).astype(np.int64) + len(self.ids)
        return h, out

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash and class of each distinct word, and which of these words and what row each token is."""
        words, rows = split_words(text)
        code, distinct = coded(words)
        if not len(code):
            return np.zeros(0, np.uint64), code, code, rows
        return *self.of(cleaned(distinct)), code, rows

    def around(self, t: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Classes of the four words around each token."""
        out = np.full((len(OFFSETS), len(t)), self.edge, np.int16 if self.size < 1 << 15 else np.int32)
        for k, d in enumerate(OFFSETS):
            a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            out[k, a] = np.where(rows[a] == rows[b], t[b], self.edge)
        return out


class Network:
    """h = tanh(sum of the four words' vectors + c); a softmax over groups of classes, then over a group's classes."""

    def __init__(self, size: int, hidden: int = HIDDEN):
        self.size, self.hidden = size, hidden
        self.span = int(np.ceil(np.sqrt(size)))
        self.groups = -(-size // self.span)
        self.shapes = {"e": (len(OFFSETS), size, hidden), "c": (hidden,), "u": (hidden, self.groups), "b": (self.groups,),
                       "v": (self.groups, hidden, self.span), "d": (self.groups, self.span)}

    def start(self, counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
        """Random vectors, and the classes' shares of all tokens as biases."""
        rng = np.random.default_rng(seed)
        w = {k: rng.normal(0, 0.2, s).astype(np.float32) if len(s) > 1 and k != "d" else np.zeros(s, np.float32) for k, s in self.shapes.items()}
        full = np.zeros(self.groups * self.span)
        full[: self.size] = counts + 1
        full = full.reshape(self.groups, self.span)
        w["b"] = np.log(full.sum(1) / full.sum()).astype(np.float32)
        w["d"] = np.where(full > 0, np.log(np.maximum(full, 1) / full.sum(1, keepdims=True)), -50).astype(np.float32)
        return w

    def flat(self, w: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([w[k].ravel() for k in self.shapes])

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([0, *(int(np.prod(s)) for s in self.shapes.values())])
        return {k: flat[a:b].reshape(s).copy() for (k, s), a, b in zip(self.shapes.items(), ends[:-1], ends[1:], strict=True)}

    def ready(self, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, bool]:
        """What all tokens of a step share: weights with the biases as those of a last unit, which is one.

        The last value says that no softmax sees a value large enough to overflow.
        """
        u, v = np.vstack([w["u"], w["b"]]), np.concatenate([w["v"], w["d"][:, None]], 1)
        # the hidden units are within one, so the weights bound what a softmax sees
        return u, v, max(float(np.abs(m).sum(-2).max()) for m in (u, v)) < 64

    def units(self, w: dict[str, np.ndarray], around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hidden units of each token by tanh(x) = 1 - 2 / (exp(2 x) + 1), and these with the unit that is one."""
        x = np.take(w["e"][0], around[0], axis=0)
        more = np.empty_like(x)
        for k in range(1, len(OFFSETS)):
            x += np.take(w["e"][k], around[k], axis=0, out=more, mode="clip")
        x += w["c"]
        x *= 2
        with np.errstate(over="ignore"):
            np.exp(x, out=x)
        x += 1
        np.divide(-2, x, out=x)
        x += 1
        h = np.empty((len(x), self.hidden + 1), x.dtype)
        h[:, :-1], h[:, -1] = x, 1
        return x, h

    def grouped(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """Order of the tokens by group, where in the softmaxes of its group each token's class is, and each group's tokens."""
        group = (t // self.span).astype(np.int16)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(self.groups + 1)).tolist()
        parts = [(k, a, b) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if a < b]
        place = t[order].astype(np.int64)
        for k, a, b in parts:
            place[a:b] += np.arange(-k * self.span, (b - a - k) * self.span, self.span)
        return order, place, parts

    def chances(self, w: dict[str, np.ndarray], ready: tuple, t: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each token's group, and of its class in the group."""
        u, v, small = ready
        order, place, parts = self.grouped(t)
        _, h = self.units(w, np.take(around, order, axis=1))
        p, total = powers_of(h @ u, small)
        outer, inner = np.empty(len(t), h.dtype), np.empty(len(t), h.dtype)
        for k, a, b in parts:
            q, sums = powers_of(h[a:b] @ v[k], small)
            np.divide(p[a:b, k], total[a:b], out=total[a:b])
            outer[order[a:b]], inner[order[a:b]] = total[a:b], q.ravel()[place[a:b]] / sums
        return outer, inner

    def learn(self, w: dict[str, np.ndarray], ready: tuple, t: np.ndarray, around: np.ndarray, weight: float, g: dict[str, np.ndarray]) -> None:
        """Add the gradient of the loss of each token times ``weight``; those of ``u`` and ``v`` have the biases' in a last row."""
        u, v, small = ready
        order, place, parts = self.grouped(t)
        around, at = np.take(around, order, axis=1), np.int16 if len(OFFSETS) * self.size < 1 << 15 else np.int32
        x, h = self.units(w, around)
        # a softmax is never divided by its sums: they scale the few hidden units instead
        p, total = powers_of(h @ u, small)
        for k, a, b in parts:
            p[a:b, k] -= total[a:b]
        scale = (weight / total)[:, None]
        g["u"] += (h * scale).T @ p
        dh = p @ w["u"].T
        dh *= scale
        for k, a, b in parts:
            q, sums = powers_of(h[a:b] @ v[k], small)
            q.ravel()[place[a:b]] -= sums
            scale = (weight / sums)[:, None]
            g["v"][k] += (h[a:b] * scale).T @ q
            back = q @ w["v"][k].T
            back *= scale
            dh[a:b] += back
        x *= x
        dh *= np.subtract(1, x, out=x)
        ids, sums = sums_by(np.concatenate([k * self.size + each.astype(at) for k, each in enumerate(around)]), dh)
        e = np.zeros_like(w["e"])
        e.reshape(-1, self.hidden)[ids] = sums
        g["e"] = g["e"] + e if "e" in g else e

    def run(self, w: dict[str, np.ndarray], t: np.ndarray, around: np.ndarray, learn: bool = False):
        """Log-probability of each token; or the gradient of the mean loss."""
        if learn:
            return self.gradient(w, t, around)
        outer, inner = self.chances(w, self.ready(w), t, around)
        return np.log(outer) + np.log(inner)

    def gradient(self, w: dict[str, np.ndarray], t: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean loss, a bounded number of tokens at a time."""
        ready = self.ready(w)
        g = {k: np.zeros_like(x) for k, x in zip("uv", ready, strict=False)}
        for a in range(0, len(t), SCORED):
            self.learn(w, ready, t[a : a + SCORED], around[:, a : a + SCORED], 1 / len(t), g)
        u, v = g["u"], g["v"]
        return {"e": g["e"], "c": g["e"][0].sum(0), "u": u[:-1], "b": u[-1], "v": v[:, :-1], "d": v[:, -1]}

    def score(self, w: dict[str, np.ndarray], t: np.ndarray, around: np.ndarray) -> np.ndarray:
        ready, p = self.ready(w), np.empty(len(t))
        for a in range(0, len(t), SCORED):
            np.multiply(*self.chances(w, ready, t[a : a + SCORED], around[:, a : a + SCORED]), out=p[a : a + SCORED])
        return np.log((1 - SMOOTHING) * p + SMOOTHING / self.size)


def sums_by(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, and the sum of each one's rows, of which there are as many as ids or a part that repeats for them.

    The rows of an id are added in blocks, the first rows of all blocks as one array, then the second ones; block sums are
    summed in the same way. A sum run by run would cost a call for each number of a sum.
    """
    while True:
        at = np.argsort(ids, kind="stable")
        ids = ids[at]
        at %= len(rows)
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        ends = np.append(first[1:], len(ids))
        blocks = -((first - ends) // TOGETHER)
        start = np.repeat(first - TOGETHER * (np.cumsum(blocks) - blocks), blocks) + TOGETHER * np.arange(blocks.sum())
        size = np.minimum(np.repeat(ends, blocks) - start, TOGETHER).astype(np.int8)
        by = np.argsort(-size, kind="stable")  # the largest blocks first
        start, size = start[by], size[by]
        out = np.take(rows, at[start], axis=0)
        for k in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -k))
            out[:n] += np.take(rows, at[start[:n] + k], axis=0)
        ids, rows = ids[start], out
        if len(start) == len(first):
            return ids, rows


def tokens_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Class and row of each token of encoded documents."""
    ids = batch["ids"]
    t = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype(np.int64)
    return t, np.repeat(np.arange(batch.num_rows), pc.list_value_length(ids).to_numpy(zero_copy_only=False))


def encoded_rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of the table of encoded texts: of documents, or of rare words with the documents of some pieces that they are in."""
    kinds = {"row": pa.int64(), "doc_id": pa.int64(), "deal": pa.int64(), "ids": pa.list_(pa.int32()), "h": pa.int64(), "at": pa.list_(pa.int64())}
    return pa.record_batch({k: columns.get(k, pa.nulls(n, kind)) for k, kind in kinds.items()})


def rows_of_words(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """One row for each rare word of the pieces held: hashes of a piece's words, and the word and document of each token."""
    h, same = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
    first = np.cumsum([0, *(len(x[0]) for x in held)])
    word = np.concatenate([same[a + x[1]] for a, x in zip(first, held, strict=False)])
    ends = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(h)))]).astype(np.int32)
    at = np.concatenate([x[2] for x in held])[np.argsort(word, kind="stable")]
    return encoded_rows(len(h), h=pa.array(h), at=pa.ListArray.from_arrays(ends, pa.array(at)))


def steps(batches: Iterator[pa.RecordBatch], classes: Classes, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``size`` tokens and what is around them at a time, however the documents are cut into batches."""
    kept_t, kept_a, count = [], [], 0
    for piece in batches:
        t, rows = tokens_of(piece)
        around = classes.around(t, rows)
        at = 0
        while at < len(t):
            take = min(size - count, len(t) - at)
            kept_t.append(t[at : at + take])
            kept_a.append(around[:, at : at + take])
            at, count = at + take, count + take
            if count == size:
                yield np.concatenate(kept_t), np.concatenate(kept_a, 1)
                kept_t, kept_a, count = [], [], 0
    if count:
        yield np.concatenate(kept_t), np.concatenate(kept_a, 1)


def fit(encoded: DataFrame, classes: Classes, net: Network, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights after one pass over all documents in ``ROUNDS`` rounds, of which each averages what its learners learned.

    The learners are as many as the corpus asks for, and each gets the documents that a hash of their content deals to it,
    in the order of that hash: neither the splits of the input nor the number of tasks change a weight.
    """
    w, total = net.start(counts), max(int(counts.sum()), 1)
    learners, size = int(np.ceil(np.sqrt(total / LEARNED))), int(np.ceil(np.sqrt(total)))
    for k in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], w=w, rate=0.1 / (1 + k / 2)) -> Iterator[pa.RecordBatch]:
            learner, own = None, None

            def learned() -> pa.RecordBatch:
                flat = net.flat(own)
                cuts = range(0, len(flat), CHUNK)
                return pa.record_batch({"k": pa.array(range(len(cuts)), pa.int32()), "learner": np.full(len(cuts), learner, np.int64), "n": np.full(len(cuts), seen),
                                        "w": pa.array([flat[a : a + CHUNK].tobytes() for a in cuts], pa.binary())})

            for number, docs in by_learner(batches):
                learner, seen = number, 0
                own = {x: v.copy() for x, v in w.items()}
                squares = {x: np.full_like(v, 1e-8) for x, v in w.items()}
                for t, around in steps(docs, classes, size):
                    descend(own, squares, net.gradient(own, t, around), rate)
                    seen += len(t)
                if seen:
                    yield learned()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for b in batches:
                for c, n, x in zip(b["k"].to_pylist(), b["n"].to_pylist(), b["w"].to_pylist(), strict=True):
                    s = sums.setdefault(c, [0, 0.0])
                    s[0], s[1] = s[0] + n, s[1] + n * np.frombuffer(x, np.float32).astype(float)
            if sums:
                yield pa.record_batch({"k": pa.array(list(sums), pa.int32()), "w": pa.array([(x / n).astype(np.float32).tobytes() for n, x in sums.values()], pa.binary())})

        own_learner = F.pmod(F.shiftright("deal", 8), F.lit(learners)).alias("learner")
        part = encoded.where(F.pmod("deal", F.lit(ROUNDS)) == k).select(own_learner, "deal", "ids")
        dealt = part.repartition(min(learners, 4 * tasks(part)), "learner").sortWithinPartitions("learner", "deal")
        got = (dealt.mapInArrow(run, "k int, learner bigint, n bigint, w binary").repartition("k").sortWithinPartitions("k", "learner")
               .mapInArrow(add, "k int, w binary").toArrow().sort_by("k"))
        if got.num_rows:
            w = net.parts(np.frombuffer(b"".join(got["w"].to_pylist()), np.float32))
    return w


def by_learner(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Runs of batches of one learner, read as they come."""
    parts = (b.slice(at, to - at) for b in batches for at, to in cuts_of(b["learner"].to_numpy()))
    part = next(parts, None)
    while part is not None:
        number = part["learner"][0].as_py()

        def same() -> Iterator[pa.RecordBatch]:
            nonlocal part
            while part is not None and part["learner"][0].as_py() == number:
                yield part
                part = next(parts, None)

        own = same()
        yield number, own
        for _ in own:
            pass


def cuts_of(ids: np.ndarray) -> list[tuple[int, int]]:
    if not len(ids):
        return []
    ends = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def corpus_likelihood(docs: DataFrame) -> DataFrame:
    counts = cut_lineage(word_counts(docs))
    often = int(np.sqrt(counts.where(F.col("n") >= COUNTED).count()))
    most = max(WORDS, 8 * often)
    words = [r["word"] for r in counts.where("word != ''").orderBy(F.desc("n"), "word").limit(most).collect()]
    classes = Classes(words, max(ENDINGS, often // 2))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, t = classes.of(b["word"].cast(pa.large_string()))
            yield pa.record_batch({"h": h.view(np.int64), "class": t, "n": b["n"]})

    known = cut_lineage(counts.mapInArrow(placed, "h bigint, class bigint, n bigint"))
    sums = known.groupBy("class").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    by_class = np.zeros(classes.size, np.int64)
    for r in sums.collect():
        by_class[r["class"]] = r["total"]
    net = Network(classes.size)
    own = len(words)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in pieces(batches):
            h, t, code, rows = classes.encode(batch["text"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))]).astype(np.int32)
            ids = pa.ListArray.from_arrays(ends, pa.array(t[code].astype(np.int32)))
            yield encoded_rows(batch.num_rows, row=batch["row"], doc_id=batch["doc_id"], deal=batch["deal"], ids=ids)
            rare = t >= own
            of = rare[code]
            held.append((h[rare].view(np.int64), (np.cumsum(rare) - 1)[code[of]].astype(np.int32), batch["row"].to_numpy()[rows[of]]))
            if sum(len(x[1]) for x in held) >= RARE:
                yield rows_of_words(held)
                held = []
        if held:
            yield rows_of_words(held)

    # texts are read twice: for the counts of words, and to be written as classes that all later steps read
    rows = texts(docs).withColumn("row", F.monotonically_increasing_id()).withColumn("deal", F.xxhash64("doc_id", "text"))
    both = cut_lineage(rows.mapInArrow(encode, "row bigint, doc_id bigint, deal bigint, ids array<int>, h bigint, at array<bigint>"))
    encoded, rare_words = both.where("ids is not null").select("row", "doc_id", "deal", "ids"), both.where("h is not null").select("h", "at")
    w = fit(encoded, classes, net, by_class)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, owner = tokens_of(batch)
            total = np.bincount(owner, net.score(w, t, classes.around(t, owner)), batch.num_rows).astype(float)
            yield pa.record_batch({"row": batch["row"], "doc_id": batch["doc_id"], "n_tokens": np.bincount(owner, minlength=batch.num_rows), "total": total})

    scored = encoded.select("row", "doc_id", "ids").mapInArrow(score, "row bigint, doc_id bigint, n_tokens bigint, total double")
    # the share of a word within its class; half a count is added to each word and to all unseen ones together
    share = F.log((F.col("n") + ADDED) / (F.col("total") + ADDED * (F.col("kinds") + 1)))
    factors = known.where(F.col("class") >= own).join(F.broadcast(sums), "class").select("h", share.alias("share"))
    unseen = float(np.log(ADDED / (max(by_class.sum(), 1) + ADDED)))
    rare = rare_words.join(factors, "h", "left").select(F.explode("at").alias("row"), F.coalesce("share", F.lit(unseen)).alias("share")).groupBy("row").agg(
        F.sum("share").alias("shares"))
    out = scored.join(rare, "row", "left").withColumn("log_likelihood", F.col("total") + F.coalesce("shares", F.lit(0.0)))
    return out.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, words: int | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``log_likelihood`` (sum over tokens) and ``mean_log_likelihood`` of each row.

    A null or blank text has no tokens, sum 0 and a null mean; ids are passed through. The network is trained on all
    rows of ``docs``, repeated ones as often as they occur. With ``words``, the vocabulary is that many words, and all
    others are scored by their class alone.
    """
    if words is None:
        return corpus_likelihood(docs)
    tokens = Tokens(frequent_words(docs, words))
    table = train(window_counts(docs, tokens)).ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            window, rows = tokens.windows(batch["text"])
            n = np.bincount(rows, minlength=batch.num_rows)
            total = np.bincount(rows, table[window], batch.num_rows).astype(float)
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_tokens": n, "log_likelihood": total,
                                   "mean_log_likelihood": pa.array(total / np.maximum(n, 1), mask=n == 0)})

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_likelihood double")
