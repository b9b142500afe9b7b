"""Chat formatting with offset-aligned loss masks.

A conversation's turns are rendered as <|im_start|>role<|im_sep|>text<|im_end|> and a line end.  Inside roles and texts
every "<|" gets a backslash between its characters, and one more where backslashes stand there already, so no control
string can be written and unescaping is exact.  The rendered text is encoded once, with offsets; the spans of turns
are cut against the tokens' spans by binary search.  Control strings are tokens of their own, so a token never
reaches over a span's edge, and a conversation longer than `chunk_chars` may be encoded turn group by turn group with
the same tokens as in one piece: memory is bounded by the chunk or the longest turn.

Defined results: a null text or role is empty; turns are ordered by turn (null first), then role and text, and repeated
turns stay; a null conv_id is a conversation of its own; an empty table has only what `extra` adds; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import table

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
CHUNK_CHARS = 1 << 18


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def load_tokenizer(path: str = DEFAULT_TOKENIZER):
    from tokenizers import AddedToken, Tokenizer, processors

    tok = Tokenizer.from_file(path)
    tok.add_special_tokens([AddedToken(s, special=True, normalized=False) for s in (START, SEP, END)])
    tok.post_processor = processors.ByteLevel(trim_offsets=False)
    return tok


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The rendered turns, and (start, end, is under the loss) of each turn's text, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == "assistant"))
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), spans


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mask of each token, first token, end token of each loss span) by binary search in the tokens' offsets."""
    a = np.array([s for s, _, on in spans if on], np.int64)
    b = np.array([e for _, e, on in spans if on], np.int64)
    first, last = np.searchsorted(starts, a, "left"), np.searchsorted(ends, b, "right")
    last = np.maximum(first, last)
    edge = np.zeros(len(starts) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0, first, last


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    out = []
    for part in formatted.split(START)[1:]:
        head, _, rest = part.partition(SEP)
        out.append((unescape(head), unescape(rest[: rest.rindex(END)])))
    return out


def _chunks(batches: Iterator[pa.RecordBatch], chunk_chars: int) -> Iterator[tuple[object, int, list[tuple[str, str]], bool]]:
    """(conversation, chunk number, turns, is its last) from rows sorted by conversation and turn."""
    held: list[tuple[str, str]] = []
    size, chunk, conv, begun = 0, 0, None, False
    for batch in batches:
        for key, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if begun and key != conv:
                yield conv, chunk, held, True
                held, size, chunk = [], 0, 0
            elif size > chunk_chars:
                yield conv, chunk, held, False
                held, size, chunk = [], 0, chunk + 1
            conv, begun = key, True
            held.append((role or "", text or ""))
            size += len(role or "") + len(text or "")
    if begun:
        yield conv, chunk, held, True


def _sorted_turns(turns: DataFrame) -> DataFrame:
    picked = turns.select("conv_id", "role", "text", "turn")
    return picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _encoded(tok, turns: list[tuple[str, str]]) -> tuple[str, list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    text, spans = render(turns)
    enc = tok.encode(text, add_special_tokens=False)
    offsets = np.array(enc.offsets, np.int64).reshape(-1, 2)
    return text, enc.ids, offsets[:, 0], offsets[:, 1], *mask(offsets[:, 0], offsets[:, 1], spans)


def formatted(turns: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id, chunk (0 but for very long conversations), formatted, ids, loss_mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer)
        for conv, chunk, held, _ in _chunks(batches, chunk_chars):
            text, ids, _, _, on, _, _ = _encoded(tok, held)
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], pa.int64()), "chunk": [chunk], "formatted": [text], "ids": pa.array([ids], pa.list_(pa.int32())), "loss_mask": pa.array([on.tolist()], pa.list_(pa.bool_()))})

    return _sorted_turns(turns).mapInArrow(run, "conv_id long, chunk long, formatted string, ids array<int>, loss_mask array<boolean>")


def digests(turns: DataFrame, tokenizer: str = DEFAULT_TOKENIZER, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """What can be read back from the formatted conversations: turns from the text, the loss text through the mask's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer)
        rows: list[tuple] = []
        n = chars = loss = 0
        turn_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
        for conv, _, held, last in _chunks(batches, chunk_chars):
            text, _, starts, ends, _, first, end = _encoded(tok, held)
            for role, body in parse(text):
                turn_hash.update(f"{role}\n{body}\n".encode())
                n += 1
            for i, j in zip(first, end, strict=True):
                if j > i:
                    part = unescape(text[starts[i] : ends[j - 1]])
                    loss += len(part)
                    loss_hash.update(part.encode())
            chars += len(text)
            if last:
                rows.append((conv, n, turn_hash.hexdigest(), loss, loss_hash.hexdigest(), chars))
                n = chars = loss = 0
                turn_hash, loss_hash = hashlib.sha256(), hashlib.sha256()
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    return _sorted_turns(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    own = f"{END}{START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    return digests(turns.unionByName(extra))


def _sql_escape(c: str) -> str:
    return rf"regexp_replace({c}, '<(\\*)\|', '<\1\\|', 'g')"


OP7_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len(START) + len(SEP) + len(END) + 1}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
