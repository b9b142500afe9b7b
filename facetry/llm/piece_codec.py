"""SentencePiece encoding and decoding, and token counts, over whole columns of text.

Encoding is the Unigram Viterbi of `pieces` with a dummy prefix and no normalisation; a pre-token is a run of spaces
with the word or other white-space character after it.  Those with no space between them are taken as one wherever some
piece of the vocabulary holds the two bytes at the edge (as ");" and a carriage return), and no piece holds a marker
after another character; so no piece reaches over an edge, and the best segmentation of a text is that of its spans.  Decoding joins pieces and fallback bytes and drops the prefix.

Defined results: a null or empty text has no pieces and decodes to the empty text; a marker character in a text
comes back by byte fallback; ties are settled by score, fewer pieces, longer last piece; repeated rows give repeated
results; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from facetry.llm import pieces as pc
from facetry.llm import textkit as tk
from facetry.llm.common import table


def encode_slice(seg: pc.Segmented, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ptr) of the rows of a slice."""
    start, end, spaces, row = tk.joined(data, *tk.pretokens(data, offsets), seg.p.joins)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    code = seg.codes(data, start, end, spaces)
    size = seg.ptr[code + 1] - seg.ptr[code]
    per_row = tk.row_sums(size, row, n).astype(np.int64)
    return tk.csr_take(seg.ids, seg.ptr, code), np.concatenate([[0], np.cumsum(per_row)])


def decode_slice(p: pc.Pieces, ids: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the rows' texts."""
    data = tk.csr_take(p.text, p.ptr, ids)
    ends = np.concatenate([[0], np.cumsum(np.diff(p.ptr)[ids])])[ptr]
    prefix = ends[:-1][ends[1:] > ends[:-1]]
    keep = np.ones(len(data), bool)
    keep[prefix] = False
    return data[keep], ends - np.concatenate([[0], np.cumsum(ends[1:] > ends[:-1])])


def _agrees(data, offsets, back, back_offsets) -> np.ndarray:
    """Whether each row came back byte by byte."""
    size = np.diff(offsets)
    same = size == np.diff(back_offsets)
    if len(data) == len(back) and same.all():
        wrong = np.flatnonzero(data != back)
        same[np.searchsorted(offsets, wrong, "right") - 1] = False
        return same
    return np.array([bool(s) and np.array_equal(data[a:b], back[c:d]) for s, a, b, c, d in zip(same, offsets, offsets[1:], back_offsets, back_offsets[1:], strict=False)])


def codec(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = pc.DEFAULT_MODEL) -> DataFrame:
    """doc_id, ids (the pieces), n_ids, n_bytes (fallback pieces), n_decoded (bytes of the decoded text), round_trip."""
    shared = docs.sparkSession.sparkContext.broadcast(pc.load(model))  # a vocabulary: its size does not grow with data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        seg = pc.Segmented(p)
        is_byte = np.zeros(p.n + 1, bool)
        is_byte[p.byte_id] = True
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(1), tk.SMALL_SLICE):
                ids, ptr = encode_slice(seg, data, offsets)
                back, back_offsets = decode_slice(p, ids, ptr)
                fall = np.concatenate([[0], np.cumsum(is_byte[ids])])[ptr]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(ids)), pa.array(np.diff(ptr)), pa.array(np.diff(fall)), pa.array(np.diff(back_offsets)), pa.array(_agrees(data, offsets, back, back_offsets))],
                    ["doc_id", "ids", "n_ids", "n_bytes", "n_decoded", "round_trip"],
                )

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(tk.returning(run), f"doc_id {kind}, ids array<int>, n_ids long, n_bytes long, n_decoded long, round_trip boolean")


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = pc.DEFAULT_MODEL, most: int = 1 << 20) -> DataFrame:
    """doc_id, n_pretokens (before any are joined), n_tokens, log_score of each text's best segmentation.

    A task keeps the terminal counts of the spans it has seen (up to `most`); those new in a slice of text are put
    into one trie and counted by dynamic programming over its nodes, once per shared prefix.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pc.load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        seen, counts, scores = tk.Table(), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(1)):
                start, end, spaces, row = tk.pretokens(data, offsets)
                n = b - a
                tokens = score = held = np.zeros(n)
                if len(start):
                    held = np.bincount(row, minlength=n)
                    start, end, spaces, row = tk.joined(data, start, end, spaces, row, p.joins)
                    h = tk.mix64(tk.hashes(data, start, end) ^ (spaces.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                    code, values, first = tk.distinct(h)
                    if seen.n + len(values) > most:
                        seen, counts, scores = tk.Table(), np.zeros(0, np.int64), np.zeros(0)
                    found = seen.find(values)
                    new = np.flatnonzero(found < 0)
                    if len(new):
                        c, s = _new_counts(p, data, start[first[new]], end[first[new]], spaces[first[new]])
                        found[new] = np.arange(seen.n, seen.n + len(new))
                        seen.add(values[new])
                        counts, scores = np.concatenate([counts, c]), np.concatenate([scores, s])
                    at = found[code]
                    tokens, score = (tk.row_sums(x, row, n) for x in (counts[at], scores[at]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(held.astype(np.int64)), pa.array(tokens.astype(np.int64)), pa.array(score)], ["doc_id", "n_pretokens", "n_tokens", "log_score"])

    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, n_pretokens long, n_tokens long, log_score double")


def _new_counts(p: pc.Pieces, data, start, end, spaces) -> tuple[np.ndarray, np.ndarray]:
    count, score = np.zeros(len(start), np.int64), np.zeros(len(start))
    short = end - start + spaces <= tk.LONG
    at = np.flatnonzero(short)
    if len(at):
        count[at], score[at] = pc.shared_counts(p, *tk.spelled(data, start[at], end[at], spaces[at], pc.MARK))
    for i in np.flatnonzero(~short):
        ids = np.array(pc.segment_one(p, pc.key_bytes(data, start[i], end[i], spaces[i])))
        count[i], score[i] = len(ids), ((p.score[ids] + 1) // 4096 / 65536.0).sum()
    return count, score


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec(table(spark, sf_dir, "documents"))
