"""Per-document operators against plain Python, a library, or held-out labels."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from liftfield.llm import languages as L
from liftfield.llm import likelihood as M
from liftfield.llm import quality as Q
from liftfield.llm import tokens as T
from liftfield.llm import toxicity as X

SMALL = "/root/testdata/sf0.01"
DOC = "doc_id bigint, text string, lang string, source string, n_words string, kept int"
ODD = [None, "", " \t\n", "one", "a b c a b c a b c", "x\ny\nx\n \nx\n\n", "#tag |pipe| <b> 100% $5 & *", "naïve word 日本語 \U0001f600",
       "w " * 5000, "a\x0bb\x0cc\rd\x1ce"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "s", "clash", 1) for k, t in enumerate(ODD)] + [(None, "one", None, None, None, None), (3, "one", None, "s", "x", 0), (3, "one", None, "s", "x", 0)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_base_counts(spark, docs):
    texts = ODD + [r.text for r in docs.limit(150).collect()]
    got = Q.base_counts(pa.array(texts, pa.string()))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[c][k]) for c in columns) for k in range(len(texts))] == [plain_counts(t) for t in texts]


def test_quality_verdicts(spark, docs, labels):
    got = Q.quality(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.02 * n[0, False]


def test_quality_held_out(spark, docs, labels):
    half = labels.where("doc_id % 2 = 0")
    model = Q.fit(docs, half)
    rows = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").select("text", "quality").collect()
    got = Q.judged(model, pa.array([r.text for r in rows]), 0.5)
    right = [k == bool(r.quality) for k, f, r in zip(got["kept"], got["base_failed"], rows, strict=True) if not f]
    assert np.mean(right) > 0.97


def test_quality_learns_in_a_task(spark, docs, labels, monkeypatch):
    """The driver gets no features, and the model is that of the same rows learned here."""
    with monkeypatch.context() as m:
        m.setattr(type(docs), "toArrow", lambda *a: pytest.fail("features sent to the driver"))
        model = Q.fit(docs, labels, 40)
    sample = Q.labelled_sample(docs, labels, "quality", (40, 40), longest=Q.SAMPLE_BYTES).select("doc_id", "label", "text")
    batches = Q.sample_features(iter(sample.toArrow().to_batches()))
    here = next(Q.learned(batches)).to_pylist()[0]
    assert np.array_equal(model.weights, np.frombuffer(here["weights"], np.float32)) and (model.bias, model.slope) == (here["bias"], here["slope"])
    assert Q.fit(docs, labels.where("quality = 1")) is None


def test_quality_without_labels_and_odd_rows(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = Q.quality(odd, none).collect()
    assert len(got) == len(ODD) + 3 and all(r.base_failed and not r.kept for r in got if r.doc_id != 8)
    kept = Q.good_documents(odd, none)
    assert kept.columns == odd.columns and kept.count() == 0
    assert Q.quality(odd.limit(0), none).count() == 0


def test_token_counts_equal_the_library(spark, odd, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    strange = odd.unionByName(spark.createDataFrame([(100 + k, t, "", "", "", 0) for k, t in enumerate((
        "<|endoftext|>abc<|startoftext|> x", "don't I'LL 'sfoo", "ΣΑΣ İ Straße É", "½ Ⅷ 123", "ab" * 400, "\x85　​", "!!!???"))], DOC))
    for table in (strange, docs):
        got = T.token_counts(table, path).collect()
        texts = {r.doc_id: r.text for r in table.collect()}
        want = dict(zip(texts, (len(e.ids) for e in library.encode_batch([t or "" for t in texts.values()], add_special_tokens=False)), strict=True))
        assert all((r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len((texts[r.doc_id] or "").encode()), want[r.doc_id] > 2048) for r in got)
        assert len(got) == table.count()


def test_small_tables_of_states_give_the_same_counts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        v = T.Vocabulary(f.read())
    words = [w.encode() for w in ("internationalization", "thtionness", "a", "zzzzzzzz", "überall", "qwertyuiopasdfgh" * 20)]
    assert T.Transducer(v, states=96).counts(words).tolist() == T.Transducer(v).counts(words).tolist()


def test_likelihood_table_and_sums(spark, docs):
    few = docs.limit(60)
    tokens = M.Tokens(M.frequent_words(few, 20))
    counts = M.window_counts(few, tokens)
    texts = [r.text for r in few.collect()]
    assert counts.sum() == sum(len((t or "").split()) for t in texts)
    table = M.train(counts, steps=10)
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-3)
    # training lowers the loss
    assert (table * counts).sum() > (M.train(counts, steps=1) * counts).sum()
    got = {r.doc_id: r for r in M.pseudo_likelihood(few, 20).collect()}
    table = M.train(counts).ravel()
    for r in few.collect():
        w, _ = tokens.windows(pa.array([r.text]))
        assert got[r.doc_id].n_tokens == len(w) and got[r.doc_id].log_likelihood == pytest.approx(float(table[w].sum(dtype=float)), rel=1e-3)


def test_likelihood_odd_rows(spark, odd):
    got = M.pseudo_likelihood(odd, 5).collect()
    assert len(got) == len(ODD) + 3
    assert all(r.mean_log_likelihood is None and r.log_likelihood == 0 for r in got if r.n_tokens == 0)
    assert M.pseudo_likelihood(odd.limit(0), 5).count() == 0


def test_languages_held_out(spark, docs):
    got = L.languages(docs, L.fold(3, 1)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() > 0.97 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_languages_brute_force(spark):
    rows, numbers, counts, spelled = L.trigrams(pa.array(["Ab ab!", None, "ß"]))
    grams = Counter()
    for r, n, c in zip(rows, numbers, counts, strict=True):
        grams[int(r), "".join(map(chr, spelled[n]))] += int(c)
    assert grams == {(0, " ab"): 2, (0, "ab "): 2, (0, "b a"): 1, (2, " ß "): 1}
    v = L.letter_vectors(np.array([ord(c) for c in "ab "]), 128)
    assert np.array_equal(L.bound(np.array([[ord("a"), ord("b"), 32]]), 128)[0], np.roll(v[0], 2) * np.roll(v[1], 1) * v[2])


def test_languages_odd_rows(spark, odd):
    got = {(r.doc_id, r.lang_pred) for r in L.languages(odd, L.fold(3, 1)).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (6, "en")} <= got
    assert L.languages(odd.limit(0), L.fold(3, 1)).count() == 0
    assert {r.lang_pred for r in L.languages(odd.withColumn("lang", F.lit(None).cast("string")), L.fold(3, 1)).collect()} == {"und"}


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    rows = np.repeat([0, 1, 4], [1, 5, 7])
    gain, moves = rng.uniform(0.1, 4, len(rows)), rng.uniform(0.2, 3, (2, 2))
    got = X.marginals(rows, gain, moves)[0]
    for row in np.unique(rows):
        g = gain[rows == row]
        total, hit = 0.0, np.zeros(len(g))
        for code in range(1 << len(g)):
            tags = [(code >> k) & 1 for k in range(len(g))]
            w = np.prod([g[k] if t else 1 for k, t in enumerate(tags)]) * np.prod([moves[a, b] for a, b in zip(tags, tags[1:])])
            total, hit = total + w, hit + w * np.array(tags)
        assert np.allclose(got[rows == row], hit / total)
    long = np.zeros(1000, int)
    g = rng.uniform(0.1, 4, 1000)
    a, b, want = 1.0, 1.0, []
    for k in range(1000):
        a, b = (1.0, g[0]) if k == 0 else (a * moves[0, 0] + b * moves[1, 0], (a * moves[0, 1] + b * moves[1, 1]) * g[k])
        a, b = a / (a + b), b / (a + b)
        want.append(b)
    assert np.allclose(X.scan(np.arange(1000) == 0, g, moves), want)
    assert len(X.marginals(long[:0], g[:0], moves)[0]) == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = X.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, L.fold(4, 2), sample_rows=(1500, 400)).join(labels, "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] > 0.75 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) < 0.06 * n[0, 0]


def test_toxicity_spans_and_odd_rows(spark, odd):
    bad = spark.createDataFrame([(1000 + k, f"word{k % 7} other{k} " + ("zorgish " if k % 4 == 0 else "") + f"end{k % 5}", "en", "s", "", 0) for k in range(200)], DOC)
    labels = spark.createDataFrame([(1000 + k, 1, int(k % 4 == 0)) for k in range(200)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in X.toxicity(odd.unionByName(bad), labels, L.fold(4, 2)).where("doc_id is not null").collect()}
    assert all(got[1000 + k].predicted == int(k % 4 == 0) for k in range(200))
    assert got[1004].spans[0].asDict() == {"first_word": 2, "last_word": 2}
    assert got[0].score == got[1].score and got[0].predicted == 0 and got[8].predicted == 0
    none = X.toxicity(odd, labels.limit(0), L.fold(4, 2)).collect()
    assert len(none) == len(ODD) + 3 and {r.score for r in none} == {0.0}


def test_likelihood_knows_each_word_and_two_on_either_side(spark):
    rows = [f"alpha beta gamma delta w{k}xy epsilon zeta eta" for k in range(300) for _ in range(3)]
    rows += [f"one two{k % 2} three four{k % 2} five" for k in range(400)]
    probe = ["alpha beta gamma delta w7xy epsilon zeta eta", "alpha beta gamma delta q999xy epsilon zeta eta", "one two0 three four0 five", "one two0 three four1 five", None, " "]
    rows += probe
    table = spark.createDataFrame([(k, t) for k, t in enumerate(rows)] + [(None, "one"), (0, "one")], "doc_id bigint, text string")
    got = M.pseudo_likelihood(table).collect()
    assert len(got) == len(rows) + 2
    by_id = {r.doc_id: r for r in got if r.doc_id}
    seen, junk, fits, swapped, none, blank = (by_id[len(rows) - 6 + k] for k in range(6))
    # an ending alone does not make a word likely
    assert seen.log_likelihood > junk.log_likelihood + 0.3
    # two0 and four0 agree across the word between them
    assert fits.log_likelihood > swapped.log_likelihood + 1
    assert none.n_tokens == blank.n_tokens == 0 and none.mean_log_likelihood is None and blank.log_likelihood == 0
    assert M.pseudo_likelihood(table.limit(0)).count() == 0


def test_likelihood_does_not_depend_on_the_split(spark, docs):
    """Many learners, input in other partitions and order: the same scores."""
    few = docs.where("doc_id < 300").select("doc_id", "text")
    least, M.LEARNED = M.LEARNED, 2_000
    try:
        a, b = ({r.doc_id: r.log_likelihood for r in M.pseudo_likelihood(d).collect()} for d in (few, few.orderBy(F.desc("doc_id")).repartition(7)))
    finally:
        M.LEARNED = least
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, rel=1e-6) for k, v in a.items())


def test_likelihood_sums_of_the_whole_vocabulary(spark):
    """Class probabilities of an untrained network times a word's share of its class, token by token."""
    texts = ["red blue Red, green zq", "blue blue xx9 red", "", None, "(yellow) zq " * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    words, rounds, M.WORDS, M.ROUNDS = M.WORDS, M.ROUNDS, 2, 0
    try:
        got = {r.doc_id: r for r in M.pseudo_likelihood(df).collect()}
    finally:
        M.WORDS, M.ROUNDS = words, rounds
    clean = [[w.lower().strip("(),") for w in (t or "").split()] for t in texts]
    counts = Counter(w for ws in clean for w in ws)
    top = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:2]]
    classes = M.Classes(top, M.ENDINGS)
    of = {w: int(classes.of(pa.array([w], pa.large_string()))[1][0]) for w in counts}
    size = Counter()
    for w, n in counts.items():
        size[of[w]] += n
    kinds = Counter(of.values())
    net = M.Network(classes.size)
    weights = net.start(np.array([size[k] for k in range(classes.size)]))
    for k, ws in enumerate(clean):
        want = 0.0
        for i, w in enumerate(ws):
            around = np.array([[of[ws[i + d]] if 0 <= i + d < len(ws) else classes.edge] for d in M.OFFSETS])
            want += float(net.score(weights, np.array([of[w]]), around)[0])
            if w not in top:
                want += float(np.log((counts[w] + M.ADDED) / (size[of[w]] + M.ADDED * (kinds[of[w]] + 1))))
        assert got[k].n_tokens == len(ws) and got[k].log_likelihood == pytest.approx(want, rel=1e-5, abs=1e-6)


@pytest.mark.parametrize("width", (0.2, 9.0))
def test_likelihood_step_by_hand(width):
    """Log-probabilities and gradients from the full softmaxes, in double precision; a step changes its tables in place."""
    rnd = np.random.default_rng(3)
    net = M.Network(30, 5)
    w = net.start(rnd.integers(0, 50, 30))
    w = {k: v + rnd.normal(0, width, v.shape).astype(np.float32) * (k in "uv") for k, v in w.items()}
    t, around = rnd.integers(0, 30, 200), rnd.integers(0, 30, (len(M.OFFSETS), 200)).astype(np.int16)

    def logs(w):
        h = np.tanh(sum(w["e"][k][around[k]] for k in range(len(M.OFFSETS))) + w["c"])
        a, b = h @ w["u"] + w["b"], np.einsum("nh,nhs->ns", h, w["v"][t // net.span]) + w["d"][t // net.span]
        of = [z - z.max(1, keepdims=True) for z in (a, b)]
        of = [z - np.log(np.exp(z).sum(1, keepdims=True)) for z in of]
        return of[0][np.arange(200), t // net.span] + of[1][np.arange(200), t % net.span]

    wide = {k: v.astype(float) for k, v in w.items()}
    assert np.allclose(net.run(w, t, around), logs(wide), rtol=1e-4, atol=1e-4)
    g = net.gradient(w, t, around)
    for k, v in wide.items():
        for at in np.argsort(-np.abs(g[k]).ravel())[:4]:
            ends = [logs(wide | {k: v + d * (np.arange(v.size) == at).reshape(v.shape)}).mean() for d in (-1e-5, 1e-5)]
            assert g[k].ravel()[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=5e-3, abs=1e-5)
    own, squares = {k: v.copy() for k, v in w.items()}, {k: np.full_like(v, 1e-8) for k, v in w.items()}
    tables = {k: v for k, v in own.items()}
    M.descend(own, squares, g, 0.1)
    assert all(own[k] is tables[k] and np.allclose(own[k], w[k] - 0.1 * g[k] / np.sqrt(1e-8 + g[k] ** 2), atol=1e-6) for k in w)


def test_likelihood_sums_by_id():
    rnd = np.random.default_rng(5)
    for most, n in ((1, 300), (40, 300), (4, 5000), (200, 1)):
        rows = rnd.normal(size=(n, 3))
        ids = rnd.integers(0, most, 2 * n).astype(np.int16)  # the rows twice, each time under other ids
        want = np.zeros((most, 3))
        np.add.at(want, ids, np.concatenate([rows, rows]))
        got, sums = M.sums_by(ids, rows)
        assert sorted(got.tolist()) == sorted(set(ids.tolist())) and np.allclose(sums, want[got])


def test_likelihood_rare_words_once_a_task(spark, monkeypatch):
    """A rare word goes to its corpus count once for all texts that a task holds, with each document it occurs in, repeats included."""
    written, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    common = " ".join(f"v{k:03d}" for k in range(140))
    rows = [(k, f"{common} {common} zz{k % 3} Zz{k % 3}!") for k in range(6)]
    assert M.pseudo_likelihood(spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)).count() == 6
    words = [r for r in written[-1].collect() if r["h"] is not None]
    assert len(words) == 13 + 3 and sum(len(r["at"]) for r in words) == 13 * 12 + 3 * 4
    assert written[-1].where("ids is not null").count() == 6


def test_languages_cosine_by_hand(spark):
    """Every prediction and score from the definition, without blocks."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("der Hund und die Katze", "de"), ("the dog and the cat", "en"), ("le chien et le chat", "fr"), ("und der die das", "de"),
                                                        ("Then the other one", "en"), ("12 34", "en"), (None, "fr"), ("chat noir", "fr"), ("ein Hund", "de")])]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string")
    got = {r.doc_id: r for r in L.languages(df, L.fold(3, 1)).collect()}

    def grams(t):
        s = re.sub(r"[^a-z]+", " ", " " + (t or "").lower() + " ")
        return Counter(s[i : i + 3] for i in range(len(s) - 2))

    def vector(g):
        v = L.letter_vectors(np.array([ord(c) for c in g]), L.DIMENSIONS)
        return np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]

    unit = lambda v: v / np.linalg.norm(v)
    sums = {}
    for k, t, lang in rows:
        if not got[k].held_out and grams(t):
            g = grams(t)
            sums[lang] = sums.get(lang, 0) + sum(np.sqrt(n / g.total()) * vector(x) for x, n in g.items())
    names = sorted(sums)
    p = np.array([unit(sums[n]) for n in names])
    p = np.array([unit(v) for v in p - p.mean(0)])
    for k, t, _ in rows:
        if not re.search("[a-z]", (t or "").lower()):
            assert got[k].lang_pred == "und" and got[k].score == 0
            continue
        c = p @ unit(sum(np.sqrt(n) * vector(x) for x, n in grams(t).items()))
        assert got[k].lang_pred == names[int(c.argmax())] and got[k].score == pytest.approx(min(max(c.max(), 0), 1), abs=1e-4)


def test_likelihood_gradient():
    rng = np.random.default_rng(3)
    net = M.Network(11, 4)
    w = {k: v.astype(float) for k, v in net.start(np.arange(11)).items()}
    t, around = rng.integers(0, 11, 40), rng.integers(0, 11, (4, 40))
    g = net.run(w, t, around, learn=True)
    for k, at in (("e", (2, around[2][0], 1)), ("c", (2,)), ("u", (1, 2)), ("b", (0,)), ("v", (t[0] // net.span, 3, 1)), ("d", (1, 1))):
        loss = []
        for step in (1e-5, -1e-5):
            x = {n: v.copy() for n, v in w.items()}
            x[k][at] += step
            loss.append(-net.run(x, t, around).mean())
        assert g[k][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-5)
