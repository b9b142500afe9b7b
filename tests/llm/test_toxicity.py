"""The recurrent network: gradients by finite differences, windows, held-out accuracy, odd rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from facetry.llm import textkit as tk
from facetry.llm import toxicity as tx


def test_windows_cover_all_words():
    for n_words in (0, 1, 47, 48, 49, 80, 81, 500):
        first, size, text = tx.windows(np.zeros(n_words, np.int64), 1)
        seen = np.zeros(n_words, int)
        for f, s in zip(first, size, strict=True):
            seen[f : f + s] += 1
        assert (seen >= 1).all() and len(first) >= 1 and (text == 0).all()


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in tx._params(rng, 5).items()}
    word = np.array([0, 1, 2, 3])
    feats, ptr = np.array([3, 4, 5, 3, 9]), np.array([0, 2, 3, 3, 5])
    code, mask = np.array([[0, 1, 2], [3, 2, 0]]), np.array([[1, 1, 1], [1, 1, 0]], float)
    y = np.array([1.0, 0.0])

    def loss():
        x, _ = tx.inputs(w, word, feats, ptr)
        hf, _ = tx.run_gru(x @ w["Wf"] + w["cf"], w["Uf"], code, mask, False)
        hb, _ = tx.run_gru(x @ w["Wb"] + w["cb"], w["Ub"], code, mask, True)
        z = tx.pool(w, np.concatenate([hf, hb], axis=2), mask)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = tx._step(w, word, feats, ptr, code, mask, y)
    for k, at in (("o", 3), ("v", 2), ("a", 1), ("k", 0), ("A", (2, 3)), ("Uf", (1, 5)), ("Ub", (3, 20)), ("Wf", (2, 9)), ("cb", 17), ("word", (2, 1)), ("char", (3, 2))):
        old, eps = w[k][at], 1e-2
        w[k][at] = old + eps
        up = loss()
        w[k][at] = old - eps
        down = loss()
        w[k][at] = old
        assert abs((up - down) / (2 * eps) - g[k][at]) < 2e-3, k


def test_planted_word_is_learned(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(3))
    rows = []
    for i in range(240):
        t = [word() for _ in range(rnd.randint(20, 150))]
        if i % 3 == 0:
            for _ in range(3):
                t[rnd.randrange(len(t))] = "vile" + rnd.choice(["", "!", "s", "ness"])
        rows.append((" ".join(t), int(i % 3 == 0)))
    net = tx.train(rows[:180])
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(rows[180:])] + [(900, None, None), (901, "", None), (902, "ka " * 50_000, None), (903, "ka " * 30_000 + "vile vile vile vile", None)], "doc_id long, text string, score string")
    out = {r.doc_id: r for r in tx.score(docs, net).collect()}
    assert len(out) == 64 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    right = sum(out[i].predicted == y for i, (_, y) in enumerate(rows[180:]))
    assert right >= 57
    assert out[900].score == out[901].score and not out[900].predicted
    assert tx.score(docs.limit(0), net).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in tx.score(docs, tx.fit(docs, labels)).collect()] == [0.0, 0.0]
    assert tx.train([("a", 1), ("b", 1)]).base == 1.0


def test_held_out(spark):
    d = "/root/testdata/sf0.01"
    out = tx.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    x = out.groupBy().agg(F.sum(F.expr("if(predicted = 1 and toxic = 1, 1, 0)")), F.sum(F.expr("if(predicted = 1 and toxic = 0, 1, 0)")), F.sum("toxic")).first()
    assert x[0] >= 0.6 * x[2] and x[1] <= 8


def test_features_are_the_same_in_any_slice():
    texts = pa.array(["alpha beta", "beta, gamma!", "x" * 200])
    whole = {}
    for size in (1 << 20, 1):
        for a, b, data, offsets in tk.slices(texts, size):
            s = tx.Prepared(data, offsets)
            for i, h in enumerate(s.hash.tolist()):
                assert whole.setdefault(h, s.feats[s.ptr[i] : s.ptr[i + 1]].tolist()) == s.feats[s.ptr[i] : s.ptr[i + 1]].tolist()


def test_sample_is_drawn_from_texts_that_can_be_learned_from(spark, monkeypatch):
    """Labels of other folds, of long texts and of no text take none of the sample's places."""
    docs = spark.createDataFrame([(i, "w" * (40 if i % 2 else 10)) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12_000)], "doc_id long, toxic int")
    monkeypatch.setattr(tx, "train", lambda rows: rows)
    rows = tx.fit(docs, labels, sample=300, most_chars=20)
    for label in (0, 1):
        assert 230 <= sum(y == label for _, y in rows) <= 370
    assert len(tx.fit(docs, labels, sample=5000, most_chars=20)) == 2000
    assert (tx.SAMPLE, tx.MOST_CHARS) == (2500, 30_000)


def test_texts_prepared_by_slices(monkeypatch):
    """Slices change nothing of what is learned from."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("ab cd, efg! hijk lmnop".split()) + str(rnd.randrange(60)) for _ in range(rnd.randrange(120))) for _ in range(50)]
    (_, _, data, offsets), = tk.slices(pa.array(texts, pa.large_string()), 1 << 40)
    whole, cut = tx.Prepared(data, offsets), tk.slices
    monkeypatch.setattr(tk, "slices", lambda column: cut(column, 500))
    monkeypatch.setattr(tx, "SOME_WORDS", 7)
    s = tx.Prepared.of_texts(texts)
    for name in ("row", "code", "hash", "feats", "ptr", "first", "size", "text"):
        assert np.array_equal(getattr(s, name), getattr(whole, name)), name
    w = tx._params(np.random.default_rng(0), 0)
    few = tx.inputs(w, np.zeros(len(s.hash), int), s.feats, s.ptr)[0]
    monkeypatch.setattr(tx, "SOME_WORDS", 1 << 14)
    assert np.array_equal(few, tx.inputs(w, np.zeros(len(s.hash), int), s.feats, s.ptr)[0])


def test_long_runs_are_read_to_their_end():
    rnd = random.Random(5)
    for text in ("x" * 48, "x" * 49, "日本語" * 40, "aé日🙂" * 30, "a_b-" * 5000, "short " + "y" * 200 + " z"):
        data = np.frombuffer(text.encode(), np.uint8)
        start, end, row = tx.pieces_of_runs(data, *tk.words(data, np.array([0, len(data)])))
        seen = np.zeros(len(data), int)
        for a, b in zip(start, end, strict=True):
            data[a:b].tobytes().decode()
            seen[a:b] += 1
        assert (seen[data != 32] >= 1).all() and (end - start <= tk.LONG).all() and (np.diff(start) > 0).all()
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "re"]) for _ in range(3))
    rows = []
    for i in range(600):
        t = [word() for _ in range(rnd.randint(20, 150))]
        if i % 3 == 0:
            for _ in range(3):
                t[rnd.randrange(len(t))] = "vilest"
        rows.append((rnd.choice(" _-/").join(t), int(i % 3 == 0)))
    net = tx.train(rows)
    for sep in "_-/ ":
        clean = [word() for _ in range(30)]
        toxic = [*clean[:20], "vilest", *clean[20:]]
        (_, _, data, offsets), = tk.slices(pa.array([sep.join(clean), sep.join(toxic)]))
        x, _ = tx.score_slice(net, data, offsets)
        assert x[1] > 2 * x[0], (sep, x)  # equal while byte 48 was the last one read


def slow_score(net, text):
    """Score of one text: every window word by word, with plain formulas."""
    low = tx.folded(np.frombuffer((text or "").encode(), np.uint8))
    start, end, row = tx.pieces_of_runs(low, *tx.trimmed_words(low, np.array([0, len(low)])))
    w, sig, vectors = net.w, lambda x: 1 / (1 + np.exp(-x)), []
    for a, b in zip(start, end, strict=True):
        h = int(tk.hashes(low, np.array([a]), np.array([b]))[0])
        at = int(np.searchsorted(net.known, h))
        known = at + 1 if at < len(net.known) and int(net.known[at]) == h else 0
        feats, _ = tx.char_features(low, np.array([a]), np.array([b]))
        chars = sum((w["char"][f].astype(float) for f in feats), np.zeros(tx.CHAR_DIM)) / np.sqrt(max(1, len(feats)))
        vectors.append(np.concatenate([w["word"][known], chars]))
    n, logits, first = len(vectors), [], 0
    while True:
        some = vectors[first : first + tx.WIDTH]
        states = []
        for side, order in (("f", range(len(some))), ("b", range(len(some) - 1, -1, -1))):
            h, out = np.zeros(tx.HIDDEN), {}
            for t in order:
                x, g = some[t] @ w[f"W{side}"] + w[f"c{side}"], h @ w[f"U{side}"]
                z, r = sig(x[: tx.HIDDEN] + g[: tx.HIDDEN]), sig(x[tx.HIDDEN : 2 * tx.HIDDEN] + g[tx.HIDDEN : 2 * tx.HIDDEN])
                c = np.tanh(x[2 * tx.HIDDEN :] + r * g[2 * tx.HIDDEN :])
                h = out[t] = z * h + (1 - z) * c
            states.append(out)
        both = [np.concatenate([states[0][t], states[1][t]]) for t in range(len(some))]
        e = np.array([np.tanh(s @ w["A"] + w["a"]) @ w["v"] for s in both])
        att = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(e) else e
        logits.append(float(sum((a * s for a, s in zip(att, both, strict=True)), np.zeros(2 * tx.HIDDEN)) @ w["o"] + w["k"][0]))
        if first + tx.WIDTH >= n:
            break
        first += tx.STRIDE
    top = sorted(np.clip(logits, -12, 12), reverse=True)
    return float(sig(np.array([1.0, top[0], top[min(1, len(top) - 1)]]) @ np.array(net.scale)))


def test_scores_by_force():
    """The fast path gives what a pass over all windows of all words gives."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "tu", "re", "日本", "é", "_"]) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "!!!", ",", "..............."])
    rows = [(" ".join(word() if rnd.random() > 0.1 or i % 2 else "vile" for _ in range(rnd.randint(5, 130))), int(i % 2 == 0)) for i in range(60)]
    net = tx.train(rows)
    texts = [t for t, _ in rows[:12]] + ["", None, " \n ", "***", "--vile--", "x" * 300, "a_" * 200 + "vile", " ".join(word() for _ in range(400)) + " vile", "日本" * 60]
    for _, _, data, offsets in tk.slices(pa.array(texts, pa.large_string())):
        got, _ = tx.score_slice(net, data, offsets)
        assert np.allclose(got, [slow_score(net, t) for t in texts], atol=2e-4)
