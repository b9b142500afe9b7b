"""Language identification of mixed text: script ranges, per-word scores, and Viterbi with a switching penalty.

A word's script is that of most of its letters; languages that the training texts hardly write in that script are no
candidates for it.  For the others a word scores its mean log-likelihood ratio under each language's letter trigrams.
Viterbi over a text's words, paying `penalty` for each change of language, labels its spans; the text's language is
the one with most letters, its score that share of the letters.

Training takes at most `per_lang` different texts of each language of at most `most_chars` characters, those with the
least hashes: a bounded sample that no order of the rows changes, both bounds parameters.

Defined results: a null text, or one without a letter, is `und` with score 0 and no spans; with nothing to learn
from, all is `und`; a null doc_id is no held-out one; ties go to the language first in order; repeated rows repeat; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import textkit as tk
from facetry.llm.common import table

PER_LANG, MOST_CHARS, PENALTY, BUCKETS = 400, 50_000, 6.0, 1 << 16
#: The score of a language that a word's script rules out: no number of switches costs as much.
RULED_OUT = np.float32(-1e9)
#: Words are labelled in windows of this many, each from every state before it, so that long texts run side by side.
WINDOW = 96
#: First code points of script ranges and what they write; fixed values of the Unicode blocks.
RANGES = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"),
    (0x0980, "bengali"), (0x0A00, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})
_FIRST = np.array([a for a, _ in RANGES])
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES], np.int8)


def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for c in range(0x110000):
        out[c] = unicodedata.category(chr(c))[0] == "L"
    return out


_IS_LETTER: np.ndarray | None = None


def is_letter() -> np.ndarray:
    global _IS_LETTER
    if _IS_LETTER is None:
        _IS_LETTER = _letters()
    return _IS_LETTER


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, position of its first byte) of UTF-8 bytes."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at].astype(np.int32)
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    follow = [(pad[at + k] & 0x3F).astype(np.int32) for k in (1, 2, 3)]
    cp = np.where(lead < 0x80, lead, np.where(lead < 0xE0, (lead & 0x1F) << 6 | follow[0], np.where(lead < 0xF0, (lead & 0xF) << 12 | follow[0] << 6 | follow[1], (lead & 7) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2])))
    return np.minimum(cp, 0x10FFFF), at


def folded(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and, in two-byte form, À-Þ."""
    out = tk.lowered(data)
    if len(out) > 1:
        big = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][big] += 32
    return out


@dataclass
class Words:
    """Distinct words of a slice: bucket of each trigram, and script."""

    tri: np.ndarray  # bucket of each trigram
    ptr: np.ndarray
    script: np.ndarray  # -1: no letter
    letters: np.ndarray


def describe(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Words:
    """Letters of each word, between word marks, as hashed trigrams."""
    n = len(start)
    own = tk.csr_take(data, np.concatenate([[0], np.arange(1, len(data) + 1)]), _spans(start, end)) if n else np.zeros(0, np.uint8)
    row_of_byte = np.repeat(np.arange(n), end - start)
    cp, at = code_points(own)
    row = row_of_byte[at] if len(at) else np.zeros(0, np.int64)
    yes = is_letter()[cp]
    cp, row = cp[yes], row[yes]
    letters = np.bincount(row, minlength=n)
    script = np.full(n, -1, np.int8)
    if len(cp):
        kind = np.maximum(np.searchsorted(_FIRST, cp, "right") - 1, 0)
        per = np.zeros((n, len(SCRIPTS)), np.int32)
        np.add.at(per, (row, _SCRIPT[kind]), 1)
        script = np.where(letters > 0, per.argmax(axis=1), -1).astype(np.int8)
    # marks around each word with letters
    have = np.flatnonzero(letters)
    size = letters[have] + 2
    ptr0 = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(int(ptr0[-1]), 1, np.int64)
    inner = np.ones(len(flat), bool)
    inner[ptr0[:-1]] = inner[ptr0[1:] - 1] = False
    flat[inner] = cp
    tri = (flat[:-2] * 1_000_003 + flat[1:-1]) * 1_000_003 + flat[2:] if len(flat) > 2 else np.zeros(0, np.int64)
    ends = np.zeros(len(flat), bool)
    ends[ptr0[1:] - 1] = True
    good = ~(ends[:-2] | ends[1:-1]) if len(flat) > 2 else np.zeros(0, bool)
    bucket = (tk.mix64(tri[good].astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int32)
    count = np.zeros(n, np.int64)
    count[have] = letters[have]
    return Words(bucket, np.concatenate([[0], np.cumsum(count)]), script, letters)


def _spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    return np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))


@dataclass
class Model:
    langs: list[str]
    log: np.ndarray  # trigram bucket x language
    candidate: np.ndarray  # script x language


def train(rows: list[tuple[str, str]]) -> Model:
    """From (text, language) pairs."""
    langs = sorted({lang for _, lang in rows})
    count = np.zeros((BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPTS), len(langs)))
    for k, lang in enumerate(langs):
        texts = pa.array([t for t, x in rows if x == lang])
        for _, _, data, offsets in tk.slices(texts):
            data = folded(data)
            start, end, _ = tk.words(data, offsets)
            code, _, first = tk.distinct(tk.hashes(data, start, end))
            w = describe(data, start[first], end[first])
            times = np.bincount(code, minlength=len(first))
            count[:, k] += np.bincount(w.tri, weights=np.repeat(times, np.diff(w.ptr)), minlength=BUCKETS)
            on = w.script >= 0
            scripts[:, k] += np.bincount(w.script[on], weights=(times * w.letters)[on], minlength=len(SCRIPTS))
    seen = (count.sum(axis=1) > 0).sum() or 1
    log = np.log((count + 0.5) / (count.sum(axis=0) + 0.5 * seen + 1))
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    candidate = share >= 0.001
    candidate[~candidate.any(axis=1)] = True  # a script nobody wrote rules nobody out
    return Model(langs, log.astype(np.float32), candidate)


def word_scores(m: Model, w: Words) -> np.ndarray:
    """Of each word and language, at most 0; 0 for the best; RULED_OUT where the script rules it out; 0 throughout for a word without letters."""
    n = len(w.script)
    out = np.zeros((n, len(m.langs)), np.float32)
    have = np.flatnonzero(w.letters)
    if len(have):
        total = np.add.reduceat(m.log[w.tri], w.ptr[:-1][have], axis=0)
        may = m.candidate[w.script[have]]
        best = np.where(may, total, -np.inf).max(axis=1, keepdims=True)
        out[have] = np.where(may, np.clip(total - best, -12.0, 0.0), RULED_OUT)
    return out


def viterbi(score: np.ndarray, ptr: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word: per text, the sum of scores less `penalty` for each change is largest."""
    n, size = len(score), np.diff(ptr)
    n_lang = score.shape[1]
    if not n or n_lang == 1:
        return np.zeros(n, np.int16)
    full = np.flatnonzero(size)
    of = -(-size[full] // WINDOW)
    begin = np.repeat(ptr[:-1][full], of) + WINDOW * (np.arange(int(of.sum())) - np.repeat(np.concatenate([[0], np.cumsum(of)[:-1]]), of))
    text = np.repeat(np.arange(len(full)), of)
    span = np.minimum(WINDOW, np.repeat(ptr[1:][full], of) - begin)
    order = np.argsort(-span, kind="stable")
    begin_s, span_s = begin[order], span[order]
    n_win = len(order)
    v = np.full((n_win, n_lang, n_lang), -penalty, np.float32)
    v[:, range(n_lang), range(n_lang)] = 0
    stay_bits = np.zeros((int(span_s[0]), n_win, n_lang, n_lang), bool)
    best_at = np.zeros((int(span_s[0]), n_win, n_lang), np.int16)
    for t in range(int(span_s[0])):
        k = int(np.searchsorted(-span_s, -t, "left"))
        if t:
            top = v[:k].max(axis=2)
            best_at[t, :k] = v[:k].argmax(axis=2)
            jump = top[:, :, None] - penalty
            stay = v[:k] >= jump
            stay_bits[t, :k] = stay
            v[:k] = np.where(stay, v[:k], jump)
        v[:k] += score[begin_s[:k] + t][:, None, :]
    back = np.empty(n_win, np.int64)
    back[order] = np.arange(n_win)
    v = v[back]
    # over the windows of each text, in turn
    first = np.concatenate([[0], np.cumsum(of)[:-1]])
    u = np.zeros((len(full), n_lang), np.float32)
    came = np.zeros((n_win, n_lang), np.int16)
    for k in range(int(of.max())):
        t = np.flatnonzero(of > k)
        step = u[t][:, :, None] + v[first[t] + k]
        came[first[t] + k] = step.argmax(axis=1)
        u[t] = step.max(axis=1)
    last_state, entry = np.zeros(n_win, np.int16), np.zeros(n_win, np.int16)
    state = u.argmax(axis=1)
    for k in range(int(of.max()) - 1, -1, -1):
        t = np.flatnonzero(of > k)
        w = first[t] + k
        last_state[w] = state[t]
        entry[w] = came[w, state[t]]
        state[t] = entry[w]
    out = np.zeros(n, np.int16)
    cur, ent = last_state[order].astype(np.int64), entry[order].astype(np.int64)
    for t in range(int(span_s[0]) - 1, -1, -1):
        k = int(np.searchsorted(-span_s, -t, "left"))
        i = np.arange(k)
        out[begin_s[:k] + t] = cur[:k]
        if t:
            kept = stay_bits[t, i, ent[:k], cur[:k]]
            cur[:k] = np.where(kept, cur[:k], best_at[t, i, ent[:k]])
    return out


def label(m: Model, data: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY):
    """(prediction, share of letters, spans, and the words' start, end, row, language) for the rows of a slice."""
    n = len(offsets) - 1
    low = folded(data)
    start, end, row = tk.words(low, offsets)
    if not len(start) or not m.langs:
        z = np.zeros(0, np.int64)
        return ["und"] * n, np.zeros(n), np.zeros(n, np.int64), (z, z, z, z)
    code, _, first = tk.distinct(tk.hashes(low, start, end))
    w = describe(low, start[first], end[first])
    ptr = np.searchsorted(row, np.arange(n + 1))
    lang = viterbi(word_scores(m, w)[code], ptr, penalty).astype(np.int64)
    weight = w.letters[code].astype(np.float64)
    per = np.bincount(row * len(m.langs) + lang, weights=weight, minlength=n * len(m.langs)).reshape(n, -1)
    total = per.sum(axis=1)
    top = per.argmax(axis=1)
    change = np.concatenate([[True], (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])])
    spans = np.bincount(row[change], minlength=n)
    spans[total == 0] = 0
    pred = [m.langs[k] if t else "und" for k, t in zip(top, total, strict=True)]
    return pred, np.where(total > 0, per[np.arange(n), top] / np.maximum(total, 1), 0.0), spans, (start, end, row, lang)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most_chars: int = MOST_CHARS) -> Model:
    """Learns from a bounded sample of the rows with text and language, picked by a hash of the text."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.char_length(text_col) <= most_chars)).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    mark = F.xxhash64("text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(mark, 0.02).alias("n")).collect()}
    if not counts:
        return train([])
    # somewhat more of each language's different texts pass; those with the least marks are learned, whatever the rows' order
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * per_lang / n))).otherwise(rate)
    place = F.pmod(mark, F.lit(1 << 30))
    some = rows.where(place < rate * (1 << 30)).dropDuplicates(["text", "lang"]).select("lang", place.alias("place"), "text")
    got: dict[str, list[tuple[int, str]]] = {lang: [] for lang in counts}
    for r in some.toLocalIterator():
        got[r["lang"]].append((r["place"], r["text"]))
    return train([(t, lang) for lang in sorted(got) for _, t in sorted(got[lang])[:per_lang]])


def identify(docs: DataFrame, model: Model, text_col: str = "text", carry: dict[str, Column] | None = None, penalty: float = PENALTY, with_spans: bool = False) -> DataFrame:
    """The columns of `carry` with lang_pred, score, n_spans and, if asked for, spans (first and end byte, lang)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages: bounded by the languages learned
    carry = carry if carry is not None else {"doc_id": F.col("doc_id")}
    picked = docs.select(F.col(text_col).alias("__text"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    kinds = ", ".join(f"c{i} {picked.schema[i + 1].dataType.simpleString()}" for i in range(len(carry)))
    extra = ", spans array<struct<first:bigint,end:bigint,lang:string>>" if with_spans else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(0), tk.SMALL_SLICE):
                pred, score, n_spans, found = label(m, data, offsets, penalty)
                out = [batch.column(i + 1).slice(a, b - a) for i in range(batch.num_columns - 1)] + [pa.array(pred), pa.array(score), pa.array(n_spans)]
                names = [f"c{i}" for i in range(batch.num_columns - 1)] + ["lang_pred", "score", "n_spans"]
                if with_spans:
                    out.append(_span_array(m, offsets, n_spans, *found))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(out, names)

    out = picked.mapInArrow(tk.returning(run), f"{kinds}, lang_pred string, score double, n_spans long{extra}")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(carry)], "lang_pred", "score", "n_spans", *(["spans"] if with_spans else []))


def _span_array(m: Model, offsets, n_spans, start, end, row, lang) -> pa.Array:
    out: list[list[dict]] = [[] for _ in n_spans]
    if len(start):
        change = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (lang[1:] != lang[:-1])]))
        stop = np.concatenate([change[1:], [len(start)]]) - 1
        for i, j in zip(change, stop, strict=True):
            if n_spans[row[i]]:
                at = offsets[row[i]]
                out[row[i]].append({"first": int(start[i] - at), "end": int(end[j] - at), "lang": m.langs[lang[i]]})
    return pa.array(out, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])))


def held_out(fold: int) -> Column:
    """Whether the row is held out; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(3)))
    return identify(docs, model, carry={"doc_id": F.col("doc_id"), "held_out": held_out(3)})
