"""The n-gram join against brute force: many near copies around the threshold, small sets, large components, odd rows."""

import random
import re

import numpy as np
import pytest

from facetry.llm import ngram_join as nj


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(60)]
    texts = []
    for size in (4, 5, 8, 12, 20, 40, 90, 150):
        for _ in range(5):
            base = [word() for _ in range(size)]
            if rnd.random() < 0.5:
                base = passage[: max(4, size // 2)] + base
            texts.append(base)
            for _ in range(5):
                near = list(base)
                for _ in range(rnd.randint(0, max(1, size // 30) + 1)):
                    near[rnd.randrange(len(near))] = word()
                texts.append(near + [word() for _ in range(rnd.randint(0, 2 + size // 30))])
    chain = [word() for _ in range(400)]
    for i in range(40):  # a long chain: each links to the next, not to those further on
        texts.append(chain[3 * i : 3 * i + 130])
    out = [" ".join(t) for t in texts] + [None, "", " \n", "one", "One", "one two", "two one", "a b c", "A B C", "\ta  b\nc"]
    rnd.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def brute(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num", "block", "small", "cell_block"), [(4, 85, nj.BLOCK, nj.SMALL, 4096), (5, 80, 400, 3, 4096), (5, 80, 400, 2, 7)])
def test_components(spark, k, num, block, small, cell_block):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7, "n") for i, t in rows], "doc_id long, text string, node int, label string").repartition(3)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(docs, k, num, 100, block=block, small=small, cell_block=cell_block).collect()}
    assert got == brute(rows, k, num, 100)


def test_every_linked_pair_shares_a_cell():
    """Also after each set has left out the commonest cells that it may, whatever the cells' sizes are."""
    rng = np.random.default_rng(2)
    classes = nj.Classes(85, 100)
    size = {}

    def said(s):
        out = set()
        for names, spare in nj.cells(s, classes):
            order = sorted(names.tolist(), key=lambda c: (size.setdefault(c, int(rng.integers(0, 1000))), c))
            out |= set(order[: len(order) - spare])
        return out

    for n in list(range(1, 60)) + [100, 333, 700]:
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        for _ in range(4):
            drop = int(rng.integers(0, max(1, int(0.16 * n)) + 1))
            t = np.union1d(s[rng.permutation(len(s))[drop:]], rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 12))).astype(np.uint64))
            both = len(np.intersect1d(s, t))
            if len(t) and nj.set_digest(s) != nj.set_digest(t) and both * 100 >= 85 * (len(s) + len(t) - both):
                assert said(s) & said(t)


def test_tree_loses_no_link():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 2**63, int(rng.integers(5, 300))).astype(np.uint64))
        sets += [np.union1d(base[rng.random(len(base)) > rng.random() * 0.1], rng.integers(0, 2**63, int(rng.integers(1, 10))).astype(np.uint64)) for _ in range(4)]
    links, label = nj.SignatureTree.of_sets(sets, fan=4).links(80, 100, np.arange(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if both * 100 >= 80 * (len(x) + len(sets[j]) - both):
                assert label[i] == label[j]
    for i, j in links:
        both = len(np.intersect1d(sets[i], sets[j]))
        assert both * 100 >= 80 * (len(sets[i]) + len(sets[j]) - both)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (2, None), (9, "x " * 30_000)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id) for r in nj.jaccard_components(docs).collect())
    assert got == [(-1, 4, 5), (2, 0, 2), (5, 4, 5), (5, 4, 5), (9, 1, 9)]
    assert nj.jaccard_components(docs.limit(0)).count() == 0
    assert {r.doc_id for r in nj.representatives(docs.where("doc_id is not null")).collect()} == {2, 5, 9}


def test_links_by_null_and_repeated_ids(spark):
    """A node is verified with its own text, whatever the ids of its rows."""
    w = [[f"{c}{i}" for i in range(70)] for c in "abc"]
    cut = lambda k, i: " ".join(w[k][i : i + 60])
    rows = [(1, cut(0, 0)), (None, cut(0, 3)), (3, cut(0, 6)), (5, cut(1, 0)), (5, cut(2, 0)), (7, cut(1, 3)), (8, cut(2, 3)), (None, None)]
    for some in (rows, rows[::-1]):
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(spark.createDataFrame(some, "doc_id long, text string")).collect()]
        assert sorted(got, key=str) == sorted([(1, 57, 1), (None, 57, 1), (3, 57, 1), (5, 57, 5), (5, 57, 5), (7, 57, 5), (8, 57, 5), (None, 0, None)], key=str)


def near_group(n, words=60):
    """Copies of one text, each with one word of its own, and texts of which a passage is a third."""
    base = [f"b{i}" for i in range(words)]
    rows = [(i, " ".join(base[: i % words] + [f"x{i}"] + base[i % words + 1 :])) for i in range(n)]
    return rows + [(n + i, " ".join(base[: words // 3] + [f"y{i}q{j}" for j in range(2 * words // 3)])) for i in range(n // 2)]


def test_one_large_group_of_near_copies(spark):
    """More near copies than a leaf, a cell's block and a component's block hold, over several tasks."""
    rows = near_group(160)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for more in ({}, {"block": 1500, "small": 8, "cell_block": 16}):
        got = {(r.doc_id, r.n_shingles, r.component_id) for r in nj.jaccard_components(docs, 5, 80, 100, **more).collect()}
        assert got == brute(rows, 5, 80, 100)


def test_representatives_by_row(spark):
    """Ids that repeat with different texts, and null ids, are decided row by row; clashing names do no harm."""
    w = [[f"{c}{i}" for i in range(70)] for c in "abcd"]
    cut = lambda k, i: " ".join(w[k][i : i + 60])
    rows = [(1, cut(0, 0)), (5, cut(0, 3)), (5, cut(1, 0)), (9, cut(1, 3)), (None, cut(1, 6)), (None, cut(2, 0)), (None, cut(2, 3)), (7, cut(3, 0)), (7, cut(3, 0)), (8, None), (8, ""), (None, " ")]
    docs = spark.createDataFrame([(i, t, j, "z", t) for j, (i, t) in enumerate(rows)], "doc_id long, text string, node int, comp string, label string")
    got = nj.representatives(docs)
    assert got.columns == docs.columns
    out = [(r.doc_id, r.text) for r in got.collect()]
    ids = sorted((str(i), t or "") for i, t in out)
    assert ids[:1] + ids[-1:] and len(out) == 7
    assert {(1, cut(0, 0)), (5, cut(1, 0)), (7, cut(3, 0)), (8, None), (8, ""), (None, " ")} <= set(out)
    assert sum(i is None and t in (cut(2, 0), cut(2, 3)) for i, t in out) == 1
