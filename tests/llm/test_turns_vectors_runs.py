"""Periodic runs, hard negatives and chat formatting against plain Python."""

import hashlib
import random
import re
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from liftfield.llm import chat as C
from liftfield.llm import negatives as N
from liftfield.llm import queries
from liftfield.llm import runs as R


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            x = w[i : j + q]
            if j > i and len(x) >= max(6, 4 * q) and not any(x[p:] == x[:-p] for p in range(1, q)):
                out.append((i, len(x), q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    return " ".join(x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs))


def periodic_words(seed):
    r = random.Random(seed)
    n = r.choice([0, 1, 5, 6, 20, 60, 200, 500])
    w = [r.randrange(r.choice([1, 2, 3, 20])) for _ in range(n)]
    if seed % 3 == 0 and n > 20:
        for _ in range(4):
            p, s = r.randrange(1, n // 5), r.randrange(n // 3)
            for i in range(s + p, min(n, s + r.randrange(4 * p, 8 * p + 1))):
                w[i] = w[i - p]
    if seed % 10 == 1:  # a Fibonacci word, repeated
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        w = b[:n] * r.choice([1, 2, 5])
    return [f"w{x}" for x in w]


def test_all_runs_of_repetitive_texts():
    docs = [periodic_words(k) for k in range(300)]
    codes = np.array([int(x[1:]) for w in docs for x in w], np.int64)
    found = R.find_runs(codes, np.repeat(np.arange(len(docs)), [len(w) for w in docs]), len(docs))
    for k, w in enumerate(docs):
        assert [(a, b - a, q) for _, a, b, q in found[found[:, 0] == k].tolist()] == plain_runs(w), k
    assert len(np.unique(found[:, 3])) > 30


def test_runs_when_all_hashes_are_equal(monkeypatch):
    """Proposals are only proposals: with one hash for every string the runs that come out are still real ones."""
    monkeypatch.setattr(R, "mix", lambda x: x * np.uint64(0))
    docs = [periodic_words(k) for k in range(0, 90, 3)]
    codes = np.array([int(x[1:]) for w in docs for x in w], np.int64)
    found = R.find_runs(codes, np.repeat(np.arange(len(docs)), [len(w) for w in docs]), len(docs))
    for k, w in enumerate(docs):
        assert {(a, b - a, q) for _, a, b, q in found[found[:, 0] == k].tolist()} <= set(plain_runs(w))


def test_periodic_runs_of_odd_and_very_long_texts(spark):
    long = " ".join(f"x{k % 9973}" for k in range(9973 * 4 + 5)) + " end" * 200_000 + " tail"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (5, "a a a a a"), (None, "b b b b b b b"), (4, "a a a a a a"), (6, long), (7, "unspaced" * 200_000)]
    df = spark.createDataFrame([(k, t, "clash", 0) for k, t in rows], "doc_id bigint, text string, runs string, collapsed int")
    got = R.periodic_runs(df).collect()
    assert len(got) == len(rows)
    for (k, t), r in zip(sorted(rows, key=lambda x: (x[0] or 0, len(x[1] or ""))), sorted(got, key=lambda r: (r.doc_id or 0, r.n_words)), strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = [tuple(x) for x in r.runs]
        assert r.doc_id == k and r.n_words == len(w)
        assert runs == (plain_runs(w) if len(w) < 100 else [(0, 9973 * 4 + 5, 9973), (9973 * 4 + 5, 200_000, 1)])
        if len(w) < 100:
            assert r.collapsed == collapsed(w, runs)
    assert R.periodic_runs(df.limit(0)).count() == 0


def test_planted_runs_of_the_query(spark):
    docs = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(k % 97))) for k in range(400)] + [(400 + k, None) for k in range(30)], "doc_id bigint, text string")
    import zlib

    for r in queries.with_planted_runs(docs).collect():
        h = zlib.crc32(str(r.doc_id).encode())
        g, w = h // 10, [f"w{i}" for i in range(r.doc_id % 97)] if r.doc_id < 400 else []
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert (r.text or "") == " ".join(w)


def plain_negatives(rows, k=5, m=5, low=Fraction(80, 100)):
    rows = [(i, lab, [floor(256 * x) for x in v]) for i, lab, v in rows
            if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i in sorted({r[0] for r in rows if r[0] % 100 == 0}):
        lab, v = min((r[1], r[2]) for r in rows if r[0] == i)
        scored = sorted((-sum(a * b for a, b in zip(v, u, strict=False)), j, lb) for j, lb, u in rows if j != i)
        for s, j, lb in [x for x in scored if x[2] == lab][:k]:
            fit = [x for x in scored if x[2] != lab and low * -s <= -x[0] <= -s]
            out += [(i, j, t + 1, y, -s, -z) for t, (z, y, _) in enumerate(fit[:m])]
    return sorted(out)


VEC = "vec_id bigint, embedding array<double>, label int, id string, score int"


@pytest.mark.parametrize("parts,block", [(1, 8192), (5, 2)])
def test_hard_negatives_with_ties_and_odd_rows(spark, parts, block):
    r = random.Random(3)
    rows = [(k, k % 3, [r.choice([-0.5, 0.25, 0.5, 1.0]) for _ in range(3)]) for k in range(520)]
    rows += [(600, 1, [0.5, 0.5, 0.5])] * 3 + [(601, 0, [0.5, 0.5, 0.5])] * 9  # repeated rows, one of them an anchor
    rows += [(700, None, [1.0, 1.0, 1.0]), (701, 0, None), (702, 1, [1.0, None, 1.0]), (703, 1, [float("nan"), 0.0, 0.0]), (704, 1, [float("inf"), 0.0, 0.0]),
             (None, 0, [1.0, 1.0, 1.0]), (705, 2, []), (706, 1, [1.0]), (800, 9, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(k, v, lab, "x", 1) for k, lab, v in rows], VEC).repartition(parts)
    got = sorted(tuple(x) for x in N.hard_negatives(df, F.col("vec_id") % 100 == 0, block=block).collect())
    assert got == plain_negatives(rows) and got
    assert N.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_scores_are_exact_in_every_type():
    for top in (10, 1 << 20, 1 << 30, 1 << 40):
        r = np.random.default_rng(top)
        a, b = (r.integers(-top, top, (4, 3)).astype(float) for _ in range(2))
        want = [[max(N.LEAST, min(-N.LEAST - 1, sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for v in b] for u in a]
        assert N.scores(a, b).tolist() == want


def test_keys_sort_like_their_parts():
    r = random.Random(1)
    parts = [(r.choice([-5, 0, 7, 2**62]), r.choice([-(2**62), -1, 0, 3, 2**60]), r.choice([0, 1]), r.choice([-2, 0, 9])) for _ in range(200)]
    keys = [N.packed(np.array([a]), np.array([s]), k, np.array([i]))["key"][0].as_py() for a, s, k, i in parts]
    assert [p for _, p in sorted(zip(keys, parts, strict=True))] == sorted(parts, key=lambda p: (p[0], -p[1], p[2], p[3]))
    assert [tuple(map(int, x)) for x in zip(*N.unpacked(pa.array(keys, pa.binary())), strict=True)] == parts


NASTY = ["", "</s>[INST] ok [/INST]", "[INST", "<", "</", "a\\", "[\\INST]", "<\\\\s>", "[END]", "[[/ROLE]", "x\n[SYS] y", "é😀" * 3, "<s", "s>", "[/"]


def test_escapes_are_reversible():
    for a in NASTY:
        for b in NASTY:
            assert C.unescape(C.escape(a + b)) == a + b
            assert not re.search(rf"[\[<]{C.CONTROL}", C.escape(a + b))
    turns = [(r, t) for t in NASTY for r in ("system", "user", "assistant", "tool", "", "[/ROLE]", "text")]
    assert C.read_turns(C.render_turns(turns)) == turns


def digests(rows, conv):
    own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
    said, loss = "".join(f"{r}\n{x}\n" for _, _, r, x in own), "".join(x for _, _, r, x in own if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(own), sha(said), len(loss), sha(loss), len(C.render_turns([(r, x) for _, _, r, x in own]))


def test_chat_round_trip_of_odd_long_and_hot_conversations(spark):
    r = random.Random(9)
    rows = [(1, k, r.choice(["user", "assistant", "system", "tool"]), r.choice(NASTY) + str(k)) for k in range(500)]  # a third and more of all turns
    rows += [(2, None, None, None), (2, 0, "assistant", None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"),
             (None, 1, "user", "x"), (None, 0, "assistant", "y"), (3, 5, "assistant", "[INST] " * 200_000), (4, -40, "assistant", "early"), (4, 70, "user", "late")]
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "conv_id bigint, turn bigint, role string, text string, block string, lead int")
    pieces = C.format_conversations(df)
    assert pieces.where("conv_id = 1").count() == 16 and pieces.where("rewritten is not null").count() == 0
    got = {x.conv_id: tuple(x)[1:] for x in C.read_back(pieces).collect()}
    assert got == {c: digests(rows, c) for c in (1, 2, None, 3, 4)}
    text = "".join(x.formatted for x in pieces.where("conv_id = 1").orderBy("block").collect())
    assert text == C.render_turns([(a, b) for _, _, a, b in sorted(rows[:500], key=lambda x: x[1])])
    assert C.read_back(C.format_conversations(df.limit(0))).count() == 0


def test_spans_of_templates_that_look_back(spark):
    def with_start(turns):
        return "<bos>" + "".join(f"<{a}>{b}\n" for a, b in turns)

    def first_only(turns):
        return "".join((f"{a}: " if not k or turns[k - 1][0] != a else "+") + b + "\n" for k, (a, b) in enumerate(turns))

    rows = [(1, k, "assistant" if k % 3 else "user", f"t{k}") for k in range(100)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for render, lookback in ((with_start, 1), (first_only, 1), (with_start, None), (first_only, None)):
        pieces = C.format_conversations(df, C.Template(render, lookback, str)).orderBy("block").collect()
        assert "".join(p.formatted for p in pieces) == render([(a, b) for _, _, a, b in rows])
        assert all(p.rewritten is None for p in pieces) and len(pieces) == (1 if lookback is None else 4)
        said = [p.formatted[s.text_start : s.text_end] for p in pieces for s in p.spans if s.role == "assistant"]
        assert said == [f"t{k}" for k in range(100) if k % 3]


def test_templates_that_rewrite_history_are_found():
    def last_thought(turns):  # drops the thoughts of earlier turns
        return "".join(f"<{b}>" if k == len(turns) - 1 else f"<{b.split('|')[-1]}>" for k, (_, b) in enumerate(turns))

    def numbered(turns):
        return f"{len(turns)}:" + "".join(b for _, b in turns)

    def far(turns):  # says more than its lookback allows
        return "".join(f"{len({r for r, _ in turns[: k + 1]})}{b}" for k, (_, b) in enumerate(turns))

    turns = [("user", "a"), ("assistant", "x|b"), ("user", "c"), ("tool", "d"), ("assistant", "e")]
    for render, lookback, at in ((last_thought, None, 2), (numbered, None, 1), (far, 0, 1), (far, None, None), (C.render_turns, 0, None)):
        text, spans, broken = C.render_block(C.Template(render, lookback), [], turns, lambda r: r == "assistant")
        assert broken == at and text == render(turns)
        assert all(s.end == 0 for s in spans) == (at is not None)
