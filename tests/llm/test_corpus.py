"""Corpus-wide operators and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from liftfield.llm import decontam as D
from liftfield.llm import licenses as C
from liftfield.llm import mixing as X
from liftfield.llm import quality as Q
from liftfield.llm import simhash as S
from liftfield.llm import substrings as R

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, source string, hits string, fp int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_fingerprint(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints):
    """least id reachable by fingerprint"""
    distinct = sorted(set(p for _, p in prints))
    parent = {p: p for p in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for d, p in prints:
        if d is not None:
            least[find(p)].append(d)
    return {p: min(least[find(p)], default=None) for p in distinct}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_fingerprints_and_components(spark, docs):
    extra = [(None, "lone words of a null id", "s", "", 1), (None, None, "s", "", 1), (900, "", None, "", 1), (900, " ", None, "", 1), (901, "Two words", "s", "x", 2),
             (902, "two\nWORDS", "s", "x", 2)]
    table = docs.select("doc_id", "text", "source", F.lit("x").alias("hits"), F.lit(0).alias("fp")).unionByName(spark.createDataFrame(extra, DOC))
    rows = table.collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    least = plain_components(prints)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in S.simhash_components(table).collect()), key=str)
    assert got == sorted(((d is None, d or 0, f"{p:016x}", least[p]) for d, p in prints), key=str)
    left = S.representatives(table)
    assert left.columns == table.columns
    kept = [(r.doc_id, plain_fingerprint(r.text)) for r in left.collect()]
    groups = defaultdict(set)
    for _, p in prints:
        groups[least[p]].add(p)
    assert sorted((d is None, d or 0) for d, _ in kept) == sorted((k is None, k or 0) for k in groups)
    assert S.simhash_components(table.limit(0)).count() == 0


def test_components_take_few_stages_a_round(spark):
    """The driver keeps what it knows of each stage and task, so a round has few."""
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7)], "a bigint, b bigint")
    sc, rounds = spark.sparkContext, []
    sc.setJobGroup("components", "")
    first = type(edges).first
    try:
        type(edges).first = lambda self: rounds.append(1) or first(self)
        got = S.components(edges)
    finally:
        type(edges).first = first
    jobs = sc.statusTracker().getJobIdsForGroup("components")
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
    assert len(stages) <= 20 * len(rounds)
    roots = {r.v: r.root for r in got.collect()}
    assert roots == {k: 0 for k in range(1, 41)} | {100 + k: 100 for k in range(1, 30)}


def test_large_file_of_close_fingerprints(spark):
    rnd = random.Random(5)
    values = {rnd.getrandbits(64) for _ in range(300)}
    for _ in range(3):  # clouds that share blocks, far more than a leaf holds
        centre = rnd.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rnd.sample(range(14), rnd.randint(0, 6))) for _ in range(700)}
    values = sorted(values)
    table = spark.createDataFrame([(k, v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)], "doc_id bigint, fp bigint")
    roots = {r.v & (2**64 - 1): r.root & (2**64 - 1) for r in S.components(S.fingerprint_links(table)).collect()}
    least = plain_components(list(enumerate(values)))
    group = defaultdict(set)
    for v in values:
        group[roots.get(v, v)].add(least[v])
    assert all(len(g) == 1 for g in group.values()) and len(group) == len(set(least.values()))


def plain_dedup(rows):
    last = 2**63 - 1
    first = {}
    for d, t in rows:
        w = words(t)
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, last), last if d is None else d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < (last if d is None else d) for j in range(50)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def passages():
    rnd = random.Random(2)
    vocabulary = [f"w{k}é" for k in range(400)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    shared, common = [text(n) for n in (49, 50, 51, 74, 75, 130)], text(60)
    rows = []
    for d in range(120):
        w = text(rnd.randint(0, 90))
        for _ in range(rnd.randint(0, 2)):
            w = w + rnd.choice(shared) + text(rnd.randint(0, 40))
        rows.append((d, " ".join(w + common if d % 3 == 0 else w)))
    loop = " ".join(["a", "b"] * 60)
    rows += [(200, loop), (201, loop), (201, " ".join(shared[5])), (None, " ".join(shared[5] + ["x"])), (None, loop), (202, None), (203, ""), (204, "\n ")]
    return rows


def test_repeated_passages(spark):
    rows = passages()
    table = spark.createDataFrame([(d, t, "s", "clash", 7) for d, t in rows], DOC).repartition(5)
    key = lambda r: (str(r[0]), *r[1:])
    want = plain_dedup(rows)
    assert sorted(map(tuple, R.deduplicated(table).collect()), key=key) == sorted((r[:4] for r in want), key=key)
    cut = R.without_repeats(table)
    assert cut.columns == table.columns
    plain = sorted((str(d), " ".join(words(r[4]))) for (d, _), r in zip(rows, want, strict=True))
    assert sorted((str(r.doc_id), " ".join(words(r.text))) for r in cut.collect()) == plain
    assert R.deduplicated(table.limit(0)).count() == 0


def plain_targets(sizes, weights=(3, 1, 2), share=1.5):
    names = sorted((n for n in sizes if n is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        left, rest = total - sum(stopped.values()), sum(w[n] for n in names if n not in stopped)
        over = [n for n in names if n not in stopped and left * w[n] / rest > 2 * sizes[n] + 1e-9]
        if not over:
            return {n: stopped.get(n, left * w[n] / rest if rest else 0.0) for n in names}
        stopped |= {n: 2.0 * sizes[n] for n in over}


def test_mix(spark, docs):
    extra = [(900, "a b c", None), (901, None, "src1"), (902, " ", "zz"), (903, "x " * 5000, "src2"), (None, "a b", "src2"), (904, "p q", ""), (904, "p q", "")]
    table = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(extra, "doc_id bigint, text string, source string")).withColumn("size", F.lit("clash"))
    got = X.mixed(table, "source").collect()
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.copies == -(-r.taken // max(r.size, 1))
    want = plain_targets(dict(size))
    assert len(got) == table.count() and sorted(r.size for r in got) == sorted(len(words(r.text)) for r in table.collect())
    for s in size:
        assert target[s] == pytest.approx(want[s], abs=1e-6) and all(r.source_size == size[s] for r in got if r.source == s)
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 4
    again = X.mixed(table, "source").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mix = X.mixture(table)
    assert mix.columns == [*table.columns, "mix_copy"]
    assert sum(len(words(r.text)) for r in mix.collect()) == sum(taken.values())
    assert X.mixed(table.limit(0)).count() == 0 and X.mixture(table.limit(0)).count() == 0


def test_licences(spark):
    mit = "Released under the MIT License."
    prose = "Plain words of a story that goes on with nothing to say about rights at all.\n"
    files = [("r/LICENSE", C.TEMPLATES["Apache-2.0"][1].replace("; ", ";\n  ")), ("r/a/x.py", prose * 3), ("r/a/b/y.py", prose), ("r/a/b/z.py", f"# {mit}\n{prose}"),
             ("r/a/b/COPYING", "// " + C.TEMPLATES["GPL-3.0"][0]), ("r/a/bc/y.py", prose), ("q/x.py", prose), ("top.py", None), ("empty", ""), (None, mit), ("r/a/x.py", prose),
             ("r/m.py", "Licensed under the Apache License,\nVersion 2.0.\n" + prose)]
    got = {r.path: r for r in C.licenses(spark.createDataFrame([(*f, 1) for f in files], "path string, text string, license int")).collect()}
    assert len(got) == 11
    assert {p: got[p].license for p in got} == {"r/LICENSE": "Apache-2.0", "r/a/x.py": "Apache-2.0", "r/a/b/y.py": "GPL-3.0", "r/a/b/z.py": "MIT", "r/a/b/COPYING": "GPL-3.0",
                                               "r/a/bc/y.py": "Apache-2.0", "q/x.py": None, "top.py": None, "empty": None, None: "MIT", "r/m.py": "Apache-2.0"}
    assert got["r/a/x.py"].inherited_from == "r" and got["r/a/b/y.py"].inherited_from == "r/a/b" and got["r/a/b/z.py"].inherited_from is None
    assert C.licenses(spark.createDataFrame([], "path string, text string")).count() == 0


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_against_dynamic_programme():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        assert D.align(a, b)[0] == plain_alignment(a, b)


def test_edited_leaks(spark):
    rnd = random.Random(4)
    text = lambda n: [f"t{rnd.randint(0, 3000)}" for _ in range(n)]
    items = [text(30) for _ in range(12)] + [["short", "pair"]]
    rows, want = [], set()
    for d in range(80):
        w = text(60)
        if d % 4 == 0:
            k = d % 12
            copy = [x if rnd.random() > 0.12 else "new" for x in items[k]]
            if d % 8 == 0:
                del copy[7]
                copy.insert(15, "more")
            w[20:20] = [x.upper() + "," for x in copy]
            want.add((d, k))
        rows.append((d, " ".join(w), "s", "", 0))
    rows += [(90, None, "s", "", 0), (91, "", "s", "", 0), (None, " ".join(items[3]), "s", "", 0), (92, " ".join(items[5][:8]), "s", "", 0), (93, "a short pair here", "s", "", 0)]
    table = spark.createDataFrame(rows, DOC)
    benchmark = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(50, None), (51, " ")], "item_id bigint, text string")
    for block in (D.BLOCK_WORDS, 100):
        got = D.leaks(table, benchmark, block_words=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want | {(None, 3), (93, 12)}
        assert all(r.first_word <= r.last_word for r in got)
    clean = D.clean_documents(table, benchmark)
    assert clean.columns == table.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want} - {None, 93}
    assert D.leaks(table, benchmark.limit(0)).count() == 0 and D.leaks(table.limit(0), benchmark).count() == 0


def test_pipeline_stages(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = stages["quality_rules"](spark, docs, SMALL)
    verdict = {r.doc_id for r in Q.quality(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == verdict and kept.columns == docs.columns
    one = stages["near_duplicates"](spark, kept, SMALL)
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in kept.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(plain_components(prints).values()))
    cut = stages["repeated_passages"](spark, one, SMALL)
    want = {d: k for (d, *_, k) in plain_dedup([(r.doc_id, r.text) for r in one.collect()])}
    assert {r.doc_id: " ".join(words(r.text)) for r in cut.collect()} == want and cut.columns == docs.columns
    clean = stages["benchmark_leaks"](spark, cut, SMALL)
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    leaking = {r.doc_id for r in cut.collect() if any(i in " ".join(words(r.text)) for i in items)}
    assert not left & leaking and len(left) >= cut.count() - len(leaking) - 2
    mix = stages["source_mix"](spark, clean, SMALL)
    total = sum(len(words(r.text)) for r in mix.collect())
    assert total == pytest.approx(1.5 * sum(len(words(r.text)) for r in clean.collect()), rel=0.02)
    assert corpus_pipeline.run(spark, SMALL).count() == mix.count()


def test_packed_rows_round_trip():
    rng = np.random.default_rng(0)
    hashes, ids = rng.integers(0, 2**63, 500).astype(np.uint64), np.sort(rng.integers(0, 40, 500))
    batch = R.rows_batch(R.packed(0, hashes, ids, R.by_hash(hashes, 7), 7, np.uint64))
    back = [R.unpacked(batch, k, np.uint64) for k in range(batch.num_rows)]
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*back, strict=True)), strict=True)) == sorted(zip(hashes.tolist(), ids.tolist(), strict=True))
    assert R.rows_batch([]).num_rows == 0 and isinstance(batch, pa.RecordBatch)


def test_mix_equals_its_sql(spark):
    import duckdb

    from liftfield.llm.queries import MIX_SQL, op8

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    rel = con.execute(MIX_SQL)
    names = [d[0] for d in rel.description]
    got = op8(spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(rel.fetchall())


def test_leaks_do_not_depend_on_corpus_size_or_copies():
    rng = np.random.default_rng(9)
    for n in (5, 9, 14, 30, 50):
        items = [rng.integers(1, 1 << 60, n).astype(np.uint64) for _ in range(4)]
        for least in (0.5, 0.7):
            seeds = D.choose_seeds(list(range(4)), items, least)
            # any edits: replaced, dropped and added words; every passage of that score is found, however common its words
            texts = []
            for _ in range(60):
                copy, p = [], rng.dirichlet((6, 1.5, 1, 2))
                for w in items[0][: rng.integers(n // 2, n + 1)]:
                    what = rng.choice(4, p=p)
                    copy += [[w], [rng.integers(1, 1 << 60)], [], [w, rng.integers(1, 1 << 60)]][what]
                texts.append(np.array([*rng.integers(1, 1 << 60, 3), *copy, *rng.integers(1, 1 << 60, 3)], np.uint64))
            h, rows = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            got = {(r[0], r[2]) for r in D.aligned(seeds, h, rows, np.arange(len(h)), least)}
            want = {(k, s / (2 * n)) for k, t in enumerate(texts) if (s := D.align(items[0], t)[0]) >= least * 2 * n}
            assert got == want and want


def test_leaks_of_an_item_that_fills_the_corpus(spark):
    item = [f"w{k}" for k in range(30)]
    edited = [x if k % 4 else "other" for k, x in enumerate(item)]
    rows = [(k, " ".join(edited)) for k in range(300)] + [(1000 + k, " ".join(f"x{k}y{j}" for j in range(60))) for k in range(300)]
    got = D.leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert {r.doc_id for r in got} == set(range(300))


def test_licences_within_lines(spark):
    prose = " ".join(f"plain{k} word{k}" for k in range(12)) + "."
    rows = [("a", "Acme toolkit parses records quickly and safely. Released under the MIT License. See docs folder for installation guidance."),
            ("b", f"{prose} Licensed under the Apache License, Version 2.0. {prose}"), ("c", f"{prose} this software, which is {C.TEMPLATES['BSD-3-Clause'][1].lower()} {prose} {prose}"),
            ("d", f"{prose} {prose} license plain version public {prose}"), ("e", f"{prose} {C.TEMPLATES['GPL-3.0'][1]} {prose}")]
    got = {r.path: r.own_license for r in C.licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a": "MIT", "b": "Apache-2.0", "c": "BSD-3-Clause", "d": None, "e": "GPL-3.0"}


def test_licences_of_other_versions_and_clauses(spark):
    """A wrong name is worse than none."""
    cases = {
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.": None,
        "This work is licensed under the GNU General Public License, version 2.": None,
        "Licensed under the GNU Lesser General Public License, version 2.1.": None,
        "Licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0",
        "Licensed under the GNU Affero General Public License, version 3.": "AGPL-3.0",
        "Licensed under the BSD 2-Clause License.": None,
        "Licensed under the BSD 3-Clause License.": "BSD-3-Clause",
        "Licensed under CC BY 3.0.": None,
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-NC-SA 4.0.": None,
        "Licensed under CC BY-ND 4.0.": None,
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 1.1.": None,
        "Licensed under the Apache License, Version 2.": "Apache-2.0",
        "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
        "SPDX-License-Identifier: (MIT OR Apache-2.0)": "MIT",
        "# SPDX-License-Identifier: ISC": "ISC",
        "This file is not released under the MIT License.": None,
        "It was never licensed under the Apache License, Version 2.0; ask first.": None,
        "Released under the MIT License. It does not end here.": "MIT",
    }
    df = spark.createDataFrame([(f"d{k}/{k}", t) for k, t in enumerate(cases)], "path string, text string")
    got = {r.path: r.own_license for r in C.licenses(df).collect()}
    assert [got[f"d{k}/{k}"] for k in range(len(cases))] == list(cases.values())


def plain_cosine(text, k, name):
    rows, idf, other = C.template_vectors(C.TEMPLATES)
    share = {t: w for n, j, t, w in rows if (n, j) == (name, k)}
    count = defaultdict(int)
    for t in C.terms(text):
        count[t] += 1
    weight = {t: n * idf.get(t, other) for t, n in count.items()}
    return sum(w * share.get(t, 0.0) for t, w in weight.items()) / max(sum(w * w for w in weight.values()) ** 0.5, 1e-300)


def test_cosine_of_all_lines_by_hand(spark, docs):
    """Every line of every document against every notice in plain Python: none over the threshold is missed."""
    rows = [(str(r.doc_id), r.text) for r in docs.collect()]
    got = {r.path: r for r in C.own_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    for path, text in rows:
        best = max(((plain_cosine(line, k, name), name) for line in [*(text or "").split("\n"), text or ""] for name, ts in C.TEMPLATES.items() for k in range(len(ts))
                    if set(C.decisive(ts[k])) <= set(C.terms(line)) and not (set(C.terms(line)) & set(C.CLAUSES)) - {t for n in ts for t in C.decisive(n)}), default=(0, None))
        if best[0] >= C.LEAST_COSINE and not re.search(C.DENIED, text):
            assert path in got and got[path].cosine >= best[0] - 1e-9
