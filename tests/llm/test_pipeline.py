"""Every stage of the pipeline against brute force on a small table with odd rows."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from facetry.llm import language_id as li
from facetry.llm.common import written

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def near(rows):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    by, top = defaultdict(list), {i: i for i in sets}
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    pairs = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), both in pairs.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    base = spark.read.parquet(f"{d}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "123 ***", "en", "s", 7), (10**6 + 3, "123 ***", "en", "s", 7)], base.schema)
    docs = written(base.unionByName(odd).unionByName(base.limit(2)), "test-docs")
    before = docs.collect()

    one = written(cp.STAGES[0][1](spark, docs, d), "t1")
    kept = one.collect()
    assert one.columns == COLS
    assert {r.doc_id for r in before} - {r.doc_id for r in kept} >= {10**6, 10**6 + 1, 10**6 + 2}
    assert {r.doc_id for r in kept} >= {r.doc_id for r in before if len(r.text or "") > 40 and sum(c.isalpha() for c in r.text) > 0.6 * len(r.text)}

    two = written(cp.STAGES[1][1](spark, one, d), "t2")
    groups = defaultdict(list)
    for r in kept:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    assert sorted(r.doc_id for r in two.collect()) == sorted(min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values())
    assert two.columns == COLS

    three = written(cp.STAGES[2][1](spark, two, d), "t3")
    assert {r.doc_id for r in three.collect()} == near(two.collect()) and three.columns == COLS and three.count() == three.select("doc_id").distinct().count()

    four = written(cp.STAGES[3][1](spark, three, d), "t4")
    assert four.columns == COLS
    times = Counter(r.doc_id for r in four.collect())
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in three.collect()}
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows)
    assert 1.5 * words(three.collect()) - 20 * 1000 <= words(four.collect()) <= 1.5 * words(three.collect()) + 1  # ten texts a source: within one of them

    five = cp.STAGES[4][1](spark, four, d).collect()
    assert Counter(r.doc_id for r in five) == times and all(r.round_trip for r in five)
    assert [r.doc_id for r in cp.STAGES[4][1](spark, four.limit(0), d).collect()] == []


def test_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = written(stage(spark, docs, ""), "empty")
    assert docs.count() == 0 and li.PER_LANG > 0


def test_clashing_names(spark):
    """Every stage on documents with columns that are called what the operators call their own."""
    d = "/root/testdata/sf0.001"
    more = ["score", "lang_pred", "size", "target", "xi", "source_key", "rank", "node", "keep", "digest", "copies", "n_spans"]
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(40)
    docs = written(docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(more)]), "clash")
    for _, stage in cp.STAGES[:-1]:
        docs = written(stage(spark, docs, d), "clash")
        assert docs.columns == COLS + more and [tuple(r) for r in docs.select(more).distinct().collect()] == [tuple(range(len(more)))]
    assert cp.STAGES[-1][1](spark, docs, d).count() == docs.count()
