"""Token counts by a finite-state transducer compiled from a byte-level BPE vocabulary with word ends.

Every prefix of a word has one encoding, and it grows from a shorter prefix's by one token that fits the token before
it. So what decides the next step is finite: the positions from which a longer token may still run, by trie node, each
with the token that ends there and its count relative to now. These sets are the states. A transition reads one byte
and emits the change in the number of tokens; another table holds what the word's last byte emits. Transitions are
compiled when first met and kept in dense tables of a bounded size; when those are full they start anew from the
states in use, with the same results.

Words run in lockstep through the tables. White space always ends a word, so the state map of a word sends every state
to the start and only adds its count: maps compose by addition, and one prefix sum over a batch gives all documents.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from liftfield.llm.common import coded, pieces, split_words, texts

LIMIT = 2048
STATES = 1 << 16
#: Words whose counts a Python worker remembers.
WORDS = 1 << 18
LANES = 1 << 13
UNKNOWN = -128


def byte_names() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself, or one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges, the trie of tokens, and which tokens may follow each other."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        self.names = byte_names()
        self.symbols = self.names + [c + self.end for c in self.names]
        number = {c: k for k, c in enumerate(self.names)}
        reserved = {t["content"] for t in spec["added_tokens"]}
        self.trie: dict[int, int] = {}
        self.token_at: dict[int, str] = {}
        self.inner: set[int] = set()
        self.parts: dict[str, list[str]] = {}
        nodes = 1
        for token in model["vocab"]:
            if token in reserved:
                continue
            last = token.endswith(self.end) and len(token) > len(self.end)
            body = token[: -len(self.end)] if last else token
            codes = [number[c] for c in body]
            if last:
                codes[-1] += 256
            node = 0
            for c in codes:
                self.inner.add(node)
                key = (node << 9) | c
                if key not in self.trie:
                    self.trie[key] = nodes
                    nodes += 1
                node = self.trie[key]
            self.token_at[node] = token
            self.parts[token] = [self.symbols[c] for c in codes]
        self.fits_cache: dict[tuple[str | None, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short run of symbols."""
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:]), key=lambda p: self.ranks.get(p, 1 << 30))
            if best not in self.ranks:
                break
            out, k = [], 0
            while k < len(symbols):
                if k + 1 < len(symbols) and (symbols[k], symbols[k + 1]) == best:
                    out.append(symbols[k] + symbols[k + 1])
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out
        return symbols

    def fits(self, before: str | None, token: str) -> bool:
        key = (before, token)
        known = self.fits_cache.get(key)
        if known is None:
            if len(self.fits_cache) > 400_000:
                self.fits_cache.clear()
            parts = self.parts[token]
            known = self.merged(parts) == [token] if before is None else self.merged(self.parts[before] + parts) == [before, token]
            self.fits_cache[key] = known
        return known

    def pretokens(self, word: str) -> tuple[list[bytes], int]:
        """Normalised pieces of a word between white space, and its special tokens."""
        if word.isascii() and word.isalpha():
            return [word.lower().encode()], 0
        out, special = [], 0
        for part in self.special.split(word) if self.special else [word]:
            if self.special and self.special.fullmatch(part):
                special += 1
                continue
            if not part.isascii():
                # lower case is taken letter by letter, without the final form of sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            out += [x.encode() for x in self.pattern.findall(part.lower())]
        return out, special


class Transducer:
    def __init__(self, vocabulary: Vocabulary, states: int = STATES):
        self.v, self.size = vocabulary, states
        self.known: dict[str, int] = {}
        self.reset()

    def reset(self) -> None:
        self.next = np.full((self.size, 256), -1, np.int32)
        self.emit = np.zeros((self.size, 256), np.int8)
        self.last = np.full((self.size, 256), UNKNOWN, np.int8)
        self.states: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.start = self.intern(((0, None, 0),))

    def intern(self, state: tuple) -> int:
        k = self.number.get(state)
        if k is None:
            k = self.number[state] = len(self.states)
            self.states.append(state)
        return k

    def taken(self, state: tuple, symbol: int) -> tuple[str, int, list[tuple]]:
        """Token that ends with this symbol, the change in count, and the runs that go on."""
        found, runs = None, []
        for node, before, behind in state:
            child = self.v.trie.get((node << 9) | symbol)
            if child is None:
                continue
            runs.append((child, before, behind))
            token = self.v.token_at.get(child)
            if found is None and token is not None and self.v.fits(before, token):
                found = token, behind + 1
        if found is None:
            raise ValueError("the vocabulary does not encode this byte")
        return *found, runs

    def compile(self, k: int, byte: int) -> None:
        token, change, runs = self.taken(self.states[k], byte)
        state = tuple((c, b, n - change) for c, b, n in runs if c in self.v.inner) + ((0, token, 0),)
        self.emit[k, byte], self.next[k, byte] = change, self.intern(state)

    def room(self, live: np.ndarray, needed: int) -> np.ndarray:
        """Start the tables anew if ``needed`` more states may not fit; the live states' new numbers."""
        if len(self.states) + needed < self.size:
            return live
        distinct, back = np.unique(live, return_inverse=True)
        kept = [self.states[k] for k in distinct]
        self.reset()
        return np.array([self.intern(s) for s in kept], np.int64)[back] if len(kept) else live

    def counts(self, words: list[bytes]) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] > 0]
        for at in range(0, len(order), LANES):
            own = order[at : at + LANES]
            out[own] = self.lockstep([words[k] for k in own], sizes[own])
        return out

    def lockstep(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Token counts of words sorted by falling size; all read their k-th byte together."""
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        self.room(np.zeros(0, np.int64), 1)
        state, total = np.full(len(words), self.start, np.int64), np.zeros(len(words), np.int64)
        falling = -sizes
        for k in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(falling, -k, side="left"))  # words longer than k
            go = int(np.searchsorted(falling, -(k + 1), side="left"))  # words that do not end here
            byte = flat[starts[:live] + k]
            if go < live:
                s, b = state[go:live], byte[go:]
                for q, c in {*zip(*(x[self.last[s, b] == UNKNOWN].tolist() for x in (s, b)), strict=True)}:
                    self.last[q, c] = self.taken(self.states[q], c + 256)[1]
                total[go:live] += self.last[s, b]
            if go:
                s, b = state[:go], byte[:go]
                missing = self.next[s, b] < 0
                if missing.any():
                    new = {*zip(s[missing].tolist(), b[missing].tolist(), strict=True)}
                    if len(self.states) + len(new) >= self.size:
                        s = state[:go] = self.room(s, len(new))
                        missing = self.next[s, b] < 0
                        new = {*zip(s[missing].tolist(), b[missing].tolist(), strict=True)}
                    for q, c in new:
                        self.compile(q, c)
                total[:go] += self.emit[s, b]
                state[:go] = self.next[s, b]
        return total


_COMPILED: dict[int, Transducer] = {}


def transducer(source: str) -> Transducer:
    """One for each vocabulary and Python worker."""
    key = hash(source)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = Transducer(Vocabulary(source))
    return _COMPILED[key]


def text_counts(machine: Transducer, text: pa.Array) -> np.ndarray:
    words, rows = split_words(text)
    ids, distinct = coded(words)
    distinct = distinct.to_pylist()
    word_count = np.fromiter((machine.known.get(w, -1) for w in distinct), np.int64, len(distinct))
    new = np.flatnonzero(word_count < 0)
    pieces_of: dict[bytes, int] = {}
    place, owner, special = [], [], np.zeros(len(new), np.int64)
    for k, i in enumerate(new.tolist()):
        got, special[k] = machine.v.pretokens(distinct[i])
        for x in got:
            place.append(pieces_of.setdefault(x, len(pieces_of)))
            owner.append(k)
    if len(new):
        each = machine.counts(list(pieces_of))[np.array(place, np.int64)]
        word_count[new] = special + np.bincount(np.array(owner, np.int64), each, len(new)).astype(np.int64)
        if len(machine.known) + len(new) > WORDS:
            machine.known.clear()
        machine.known.update((distinct[i], int(word_count[i])) for i in new[:WORDS].tolist() if len(distinct[i]) <= 64)
    sums = np.concatenate([[0], np.cumsum(word_count[ids])])
    edges = np.searchsorted(rows, np.arange(len(text) + 1))
    return sums[edges[1:]] - sums[edges[:-1]]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row, for the vocabulary file at path ``tokenizer``.

    The file is read once on the driver (its size is that of the vocabulary). A null text counts as empty; ids are
    passed through as they are.
    """
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(source)
        for batch in pieces(batches):
            n = text_counts(machine, batch["text"])
            size = pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())
            yield pa.record_batch({"doc_id": batch["doc_id"], "n_bytes": size, "n_tokens": n, "over_limit": n > limit})

    return texts(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
