"""Language identification: Viterbi against brute force, held-out accuracy, odd rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from facetry.llm import language_id as li
from facetry.llm import textkit as tk


def test_viterbi_by_force():
    rng = np.random.default_rng(5)
    for n_lang in (2, 3):
        old, li.WINDOW = li.WINDOW, 3
        try:
            sizes = [0, 1, 2, 3, 4, 6, 7, 0]
            ptr = np.concatenate([[0], np.cumsum(sizes)])
            score = -rng.integers(0, 9, (ptr[-1], n_lang)).astype(np.float32)
            got = li.viterbi(score, ptr, 4.0)
        finally:
            li.WINDOW = old
        value = lambda s, path: sum(s[i][x] for i, x in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
        for a, b in zip(ptr, ptr[1:], strict=False):
            if b > a:
                best = max(value(score[a:b], p) for p in itertools.product(range(n_lang), repeat=int(b - a)))
                assert value(score[a:b], got[a:b].tolist()) == best


def test_many_languages():
    """More than fit into a byte."""
    score = np.full((6, 300), -5, np.float32)
    score[:3, 140], score[3:, 290] = 0, 0
    assert li.viterbi(score, np.array([0, 6]), 1.0).tolist() == [140] * 3 + [290] * 3


def test_word_scores_by_force():
    rows = [("the cat sat on the mat and the dog ran", "en"), ("der Hund und die Katze auf der Matte", "de"), ("кошка и собака сидят", "ru")]
    m = li.train(rows)
    words = ["the", "Katze", "собака", "кот", "***", "mat7", "9"]
    data = " ".join(words).encode()
    low = li.folded(np.frombuffer(data, np.uint8))
    start, end, _ = tk.words(low, np.array([0, len(data)]))
    got = li.word_scores(m, li.describe(low, start, end))
    for k, word in enumerate(words):
        letters = [ord(c) for c in word.lower() if c.isalpha()]
        marked = [1, *letters, 1]
        sums = np.zeros(len(m.langs))
        for a, b, c in zip(marked, marked[1:], marked[2:], strict=False):
            h = tk.mix64(np.array([(a * 1_000_003 + b) * 1_000_003 + c], np.uint64))[0]
            sums += m.log[int(h % np.uint64(li.BUCKETS))]
        if not letters:
            assert (got[k] == 0).all()
            continue
        may = np.array([(lang == "ru") == (letters[0] > 0x400) for lang in m.langs])
        want = np.where(may, np.maximum(sums - sums[may].max(), -12), li.RULED_OUT)
        assert np.allclose(got[k], want, atol=1e-3)


def test_a_script_rules_languages_out():
    m = li.train([("the cat sat on the mat the cat went home", "en"), ("кошка сидела дома на ковре", "ru")])
    data = np.frombuffer("the cat sat on the mat кошка the cat went home".encode(), np.uint8)
    _, _, spans, (start, _, _, lang) = li.label(m, data, np.array([0, len(data)]))
    assert spans[0] == 3 and [m.langs[x] for x in lang].count("ru") == 1 and len(start) == 11


def test_sample_does_not_depend_on_order(spark):
    """A bound below the number of texts, one text in many copies: the same model however the rows are dealt."""
    rows = [(i, f"wort{i % 400} satz{i} {'ab' * (i % 5)}", "x" if i % 3 else "y") for i in range(1200)] + [(5000 + i, "copied text", "x") for i in range(600)]
    one = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2), per_lang=40)
    two = li.fit(spark.createDataFrame(rows[::-1], "doc_id long, text string, lang string").repartition(5), per_lang=40)
    assert one.langs == two.langs and (one.log == two.log).all()


def test_code_points():
    text = "aé日🙂ж"
    cp, _ = li.code_points(np.frombuffer(text.encode(), np.uint8))
    assert cp.tolist() == [ord(c) for c in text]


def test_identify(spark):
    rnd = random.Random(1)
    parts = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ein", "ung", "öb"], "ru": ["да", "не", "при", "вет"]}
    text = lambda lang, n: " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    model = li.train([(text(x, 60), x) for x in parts for _ in range(20)])
    rows = [(i, text(x, 40), x, "s") for i, x in enumerate(list(parts) * 10)]
    rows += [(100, None, None, None), (101, "", "aa", None), (102, "12 34 *** \n", "aa", None), (103, text("aa", 30) + " " + text("ru", 30), None, None), (104, text("bb", 30_000), "bb", None), (0, rows[0][1], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = li.identify(docs, model, with_spans=True).collect()
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id < 100:
            assert r.lang_pred == list(parts)[r.doc_id % 3] and r.score > 0.9
    by = {r.doc_id: r for r in out}
    assert all((by[i].lang_pred, by[i].score, by[i].spans) == ("und", 0.0, []) for i in (100, 101, 102))
    assert [s.lang for s in by[103].spans] == ["aa", "ru"] and by[104].lang_pred == "bb"
    assert li.identify(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in li.identify(docs, li.fit(docs.limit(0))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = li.op4_language_id(spark, "/root/testdata/sf0.001").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    right, n = out.agg(F.sum(F.when(F.col("lang") == F.col("lang_pred"), 1).otherwise(0)), F.count("*")).first()
    assert n > 30 and right >= 0.97 * n


def test_labelling_holds_little_whatever_the_batch():
    """Some thirty times a slice is held, so what the operator takes at once is small; results do not depend on it."""
    import tracemalloc

    rng = np.random.default_rng(2)
    vocabulary = np.array(["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000)])
    texts = pa.array([" ".join(rng.choice(vocabulary, 400)) for _ in range(2500)])  # 6 MB
    model = li.train([(t, lang) for t, lang in zip(texts[:40].to_pylist(), ["a", "b"] * 20, strict=True)])
    li.is_letter()

    def labelled(most):
        tracemalloc.start()
        out = [x for _, _, data, offsets in tk.slices(texts, most) for x in zip(*li.label(model, data, offsets)[:3], strict=True)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    small, held = labelled(tk.SMALL_SLICE)
    large, more = labelled(tk.SLICE_BYTES)
    assert small == large and held < 0.6 * more
