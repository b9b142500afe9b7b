"""Exact dedup and mixing on small tables against plain Python."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from facetry.llm import exact_dedup, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, norm string"
ROWS = [
    (1, "a b", "en", "s0", 3, "x", None), (2, "ab", None, "s1", 2, None, "q"), (3, None, "en", None, 0, None, None),
    (4, " \t\n", "en", "s0", 3, None, None), (5, "ab", "en", "s0", 2, None, None), (6, "c" * 50_000, "en", "s2", 0, None, None),
    (7, "c " * 50_000, "en", "s2", 0, None, None), (8, "é ü", "de", "s1", 3, None, None), (9, "a b", "de", "s1", 3, None, None),
    (10, "one two three", "de", "s1", 3, None, None), (10, "one two three", "de", "s1", 3, None, None),
]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = set()
    for g in groups.values():
        keep = min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0]
        out |= {(r[0], keep, len(g), r[0] == keep) for r in g}
    return out


def got(df):
    return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()}


def test_exact_dedup(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert got(exact_dedup.classes(docs)) == brute(ROWS)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for _, k, _, _ in brute(ROWS)}


def test_collisions_are_resolved_by_bytes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 0)  # noqa: E731  every text collides
    assert got(exact_dedup.classes(docs, digest=weak)) == brute(ROWS)


def test_deduplicate_by_row(spark):
    """An id that repeats with different texts is decided row by row; null ids too."""
    rows = [(1, "foo"), (5, "foo"), (5, "bar"), (None, "bar "), (None, "baz"), (None, "baz"), (7, "q"), (7, "q "), (7, "q")]
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], "doc_id long, text string, kept string, n int, digest int")
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "foo"), (5, "bar"), (None, "baz"), (7, "q ")], key=str)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.classes(docs).count() == 0 and mixing.mix(docs).count() == 0


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 13)), "en", None if i % 10 == 9 else f"s{i % 10 // 3}", 0, None, None) for i in range(600)] + ROWS[:5]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan, sources = mixing.plan(docs)
    out = mixing.copies(plan, sources).collect()
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        by[r.source][0] += r.size
        by[r.source][1] += r.size * r.copies
        by[r.source][2] = r.target
        assert r.copies <= 2
    whole = sum(x[0] for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - 1.5 * whole) < 1e-6 * whole
    for size, taken, target in by.values():
        assert target <= 2 * size + 1e-9 and 0 <= target - taken <= 14
    assert mixing.mix(docs).count() == sum(r.copies for r in out)
    assert mixing.mix(docs).columns == docs.columns


def test_mix_with_null_ids_and_clashing_names(spark):
    """Rows without an id are ranked by their text, so sources meet their targets; columns of any name are kept as they are."""
    rows = [(None if i % 2 else i, f"t{i} " + "w " * (i % 9), "abc"[i % 3], 777, 0.5, "k", 3, 4) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, xi double, source_key string, target int, rank int")
    plan, sources = mixing.plan(docs)
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.copies(plan, sources).collect():
        by[r.source][0] += r.size * r.copies
        by[r.source][1] = r.target
    assert len(by) == 3 and all(0 <= target - taken <= 12 for taken, target in by.values())
    out = mixing.mix(docs)
    assert out.columns == docs.columns and {(r.size, r.xi, r.source_key, r.target, r.rank) for r in out.collect()} == {(777, 0.5, "k", 3, 4)}


def test_mix_with_many_sources(spark):
    """More sources than are broadcast: the same result."""
    rows = [(i, "w " * (1 + i % 9), f"s{i % 7}" if i % 3 else "hot") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = lambda: {(r.doc_id, r.copies) for r in mixing.copies(*mixing.plan(docs)).collect()}
    want, mixing.MOST_BROADCAST_SOURCES = got(), 2
    try:
        assert got() == want
    finally:
        mixing.MOST_BROADCAST_SOURCES = 20_000
