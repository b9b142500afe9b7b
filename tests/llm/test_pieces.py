"""Piece segmentation against brute force, and exact round trips."""

import random

import numpy as np
import pyarrow as pa

from facetry.llm import piece_codec as cc
from facetry.llm import pieces as pc
from facetry.llm import textkit as tk

TEXTS = [
    None, "", " ", "\n", "  a\tb  ", "the theory of everything", "été à la plage", "▁marker ▁▁ in text", "日本語 text 🙂", "x" * 300,
    "a" + " " * 100 + "b", "tabs\t\t\nnew\r\nlines ", "the the the", "<0x41> <s>", "\x00\x01 null", "word " * 20_000,
]


def pieces_of(p):
    out = {}
    for i in range(p.n):
        text = p.text[p.ptr[i] : p.ptr[i + 1]].tobytes().replace(b" ", bytes([pc.MARK]))
        if text and p.score[i] and i not in set(p.byte_id.tolist()):
            out[text] = int(p.score[i])
    return out


def best_by_force(known, p, key):
    """(count, score) over every segmentation, by recursion on the first piece."""
    memo = {len(key): 0}
    for i in range(len(key) - 1, -1, -1):
        memo[i] = max([p.byte_score + memo[i + 1]] + [known[key[i:j]] + memo[j] for j in range(i + 1, len(key) + 1) if key[i:j] in known])
    return (-memo[0]) % 4096, memo[0]


def test_segment_and_shared_counts():
    p = pc.load()
    known = pieces_of(p)
    rnd = random.Random(3)
    keys = [bytes([pc.MARK]) * rnd.randint(0, 3) + "".join(rnd.choice("thein aoré日ß") for _ in range(rnd.randint(0, 9))).replace(" ", "").encode() for _ in range(400)]
    keys = sorted({k for k in keys if k and len(k) <= 40}, key=lambda k: rnd.random())
    m = np.zeros((len(keys), 40), np.uint8)
    size = np.array([len(k) for k in keys])
    for i, k in enumerate(keys):
        m[i, : len(k)] = np.frombuffer(k, np.uint8)
    ids, ptr = pc.segment(p, m, size)
    n, score = pc.shared_counts(p, m, size)
    for i, k in enumerate(keys):
        count, packed = best_by_force(known, p, k)
        own = ids[ptr[i] : ptr[i + 1]]
        assert len(own) == n[i] == count
        assert int(p.score[own].sum()) == packed and own.tolist() == pc.segment_one(p, k)
        assert abs(score[i] - (packed + count) / 4096 / 65536) < 1e-6


def test_codec_round_trip(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "\n", "clash", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_ids int")
    out = cc.codec(docs).collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    p = pc.load()
    for r in out:
        data, _ = cc.decode_slice(p, np.array(r.ids, np.int32), np.array([0, len(r.ids)]))
        assert data.tobytes().decode() == (rows[r.doc_id][1] or "")
    counts = {r.doc_id: r.n_tokens for r in cc.token_counts(docs).collect()}
    assert counts == {r.doc_id: r.n_ids for r in out}
    assert cc.codec(docs.limit(0)).count() == 0 and cc.token_counts(docs.limit(0)).count() == 0


def test_words_and_table():
    arr = pa.array(TEXTS)
    for a, b, data, offsets in tk.slices(arr, 64):
        start, end, row = tk.words(data, offsets)
        got = [[] for _ in range(b - a)]
        for s, e, r in zip(start, end, row, strict=True):
            got[r].append(data[s:e].tobytes())
        import re

        assert got == [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode()) for t in TEXTS[a:b]]
        h = tk.hashes(data, start, end)
        code, values, first = tk.distinct(h)
        assert len({w for g in got for w in g}) == len(values)
    t = tk.Table()
    keys = tk.mix64(np.arange(1, 200_001, dtype=np.uint64))
    t.add(keys[:150_000])
    t.add(keys[150_000:])
    assert (t.find(keys) == np.arange(200_000)).all() and (t.find(keys + np.uint64(1)) < 0).all()


def test_whole_texts_with_carriage_returns(spark):
    """Against brute force over the whole text, so over every edge between words and white space."""
    p = pc.load()
    known = pieces_of(p)
    rnd = random.Random(8)
    parts = ["f();", "}", " {", "if", " (x)", "\r", "\r\n", "\r\r", "\n", "\t", " ", '">', "word", "日", "*/", "\x0b", "\x0c", "  "]
    texts = ["int f();\r\n{\r\n}\r\n", "\r", "\r\r\r\r", " \r", "a \r\r b\r", ");\r\t);\r", "x" * 60 + ");\r\n" + "\r" * 60, "\r\n" * 30] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 20))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = {r.doc_id: r for r in cc.codec(docs).collect()}
    counted = {r.doc_id: r for r in cc.token_counts(docs).collect()}
    for i, t in enumerate(texts):
        key = bytes([pc.MARK]) + t.encode().replace(b" ", bytes([pc.MARK]))
        count, packed = best_by_force(known, p, key)
        assert coded[i].n_ids == counted[i].n_tokens == count and int(p.score[coded[i].ids].sum()) == packed, repr(t)
        assert coded[i].ids == pc.segment_one(p, key) and coded[i].round_trip
        assert abs(counted[i].log_score - (packed + count) / 4096 / 65536) < 1e-6
    assert counted[0].n_pretokens == 10
