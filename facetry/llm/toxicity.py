"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters with a learned vector of its own (if training knew it) and one from its characters: hashed n-grams
between word marks, and prefixes that say whether the word goes on.  Windows of `width` words overlap by a third; both
directions run over all windows side by side, attention pools the states of a window, and a text's score is the
calibrated maximum over all its windows.

Training takes some `sample` texts of each label of at most `most_chars` characters, chosen by a hash of the id from the
labelled texts of the training fold that are no longer: a bounded sample, both bounds parameters.  Of a text of label 1 the most suspicious windows by
log-odds of words and character features are learned, of label 0 those and others.

Defined results: null and blank texts are a window without words; without labels, or with labels of one kind only, all
texts get the share of label 1 (0 without any); a null doc_id is no held-out one and has no label; repeated rows repeat; an empty table gives no rows; further columns are
ignored.  A run of over 48 bytes without white space enters as overlapping pieces of whole characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm import textkit as tk
from facetry.llm.common import table, written
from facetry.llm.language_id import folded, held_out

SAMPLE, MOST_CHARS, WIDTH, STRIDE = 2500, 30_000, 48, 32
HIDDEN, WORD_DIM, CHAR_DIM, DICTIONARY, BUCKETS, EPOCHS, STEPS = 8, 8, 8, 8000, 1 << 15, 5, 160
THRESHOLD = 0.7
#: Distinct words whose character features are worked on at once.
SOME_WORDS = 1 << 14
#: Bytes of a piece of a long run, and from one piece's begin to the next.
PIECE, PIECE_STEP = 24, 12
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def trimmed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without ASCII punctuation at their ends; a word of nothing else stays."""
    start, end, row = tk.words(data, offsets)
    other = np.flatnonzero(~_PUNCT[data])
    if not len(other) or not len(start):
        return start, end, row
    first = other[np.minimum(np.searchsorted(other, start), len(other) - 1)]
    last = other[np.maximum(np.searchsorted(other, end) - 1, 0)]
    on = (first >= start) & (first < end)
    return np.where(on, first, start), np.where(on, last + 1, end), row


def pieces_of_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as they are up to tk.LONG bytes; a longer one as overlapping pieces that cover it, cut between characters."""
    size = end - start
    of = np.where(size > tk.LONG, 1 + -(-(size - PIECE) // PIECE_STEP), 1)
    if not len(of) or of.max() == 1:
        return start, end, row
    word = np.repeat(np.arange(len(of)), of)
    k = np.arange(len(word)) - np.repeat(np.cumsum(of) - of, of)
    first, last = start[word], end[word]
    a = first + k * PIECE_STEP
    b = np.where(of[word] > 1, np.minimum(a + PIECE, last), last)
    for _ in range(3):  # a character has at most three bytes that continue it
        a = a - ((a > first) & (data[a] & 0xC0 == 0x80))
        b = b + ((b < last) & (data[np.minimum(b, len(data) - 1)] & 0xC0 == 0x80))
    return a, b, row[word]


def char_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, ptr): hashed n-grams of 3 and 4 bytes between marks, and prefixes of 2 to 10 bytes with whether more follows."""
    keys, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for k in range(0, len(start), SOME_WORDS):
        key, ptr = _some_features(data, start[k : k + SOME_WORDS], end[k : k + SOME_WORDS])
        keys.append(key)
        sizes.append(np.diff(ptr))
    return np.concatenate(keys), np.cumsum(np.concatenate(sizes))


def _some_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m, size = tk.spelled(data, start, end)
    n, width = m.shape
    marked = np.zeros((n, width + 2), np.uint64)
    marked[:, 0] = 256
    marked[:, 1 : width + 1] = m
    marked[np.arange(n), size + 1] = 257
    rows, keys = [], []
    for gram in (3, 4):
        for j in range(width + 3 - gram):
            r = np.flatnonzero(size + 2 >= j + gram)
            h = np.full(len(r), gram, np.uint64)
            for k in range(gram):
                h = h * np.uint64(1_000_003) + marked[r, j + k]
            rows.append(r)
            keys.append(h)
    h = np.full(n, 77, np.uint64)
    for j in range(min(10, width)):
        r = np.flatnonzero(size > j)
        h[r] = h[r] * np.uint64(1_000_003) + m[r, j]
        if j:
            rows.append(r)
            keys.append(h[r] * np.uint64(2) + (size[r] > j + 1))
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    key = (tk.mix64(np.concatenate(keys)) % np.uint64(BUCKETS)).astype(np.int32) if rows else np.zeros(0, np.int32)
    order = np.argsort(row, kind="stable")
    return key[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])


@dataclass
class Net:
    known: np.ndarray  # sorted hashes of the dictionary
    w: dict[str, np.ndarray]
    scale: tuple[float, ...]  # weights of the calibrated score
    base: float | None = None  # the constant score if nothing could be learned


def _params(rng: np.random.Generator, n_words: int) -> dict[str, np.ndarray]:
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"word": 0.1 * rng.standard_normal((n_words + 1, WORD_DIM)).astype(np.float32), "char": 0.1 * rng.standard_normal((BUCKETS, CHAR_DIM)).astype(np.float32)}
    for side in "fb":
        w |= {f"W{side}": r(d, 3 * h), f"c{side}": np.zeros(3 * h, np.float32), f"U{side}": r(h, 3 * h)}
    return w | {"A": r(2 * h, h), "a": np.zeros(h, np.float32), "v": r(h, 1)[:, 0], "o": r(2 * h, 1)[:, 0], "k": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def inputs(w: dict, word: np.ndarray, feats: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of distinct words, and the root of each one's number of features."""
    size = np.diff(ptr)
    root = np.sqrt(np.maximum(size, 1)).astype(np.float32)
    chars = np.zeros((len(word), CHAR_DIM), np.float32)
    have = np.flatnonzero(size)
    for k in range(0, len(have), SOME_WORDS):
        some = have[k : k + SOME_WORDS]
        low, high = ptr[some[0]], ptr[some[-1] + 1]
        chars[some] = np.add.reduceat(w["char"][feats[low:high]], ptr[some] - low, axis=0)
    return np.concatenate([w["word"][word], chars / root[:, None]], axis=1), root


def run_gru(p: np.ndarray, u: np.ndarray, code: np.ndarray, mask: np.ndarray, back: bool, keep: bool = False):
    """States (step x window x hidden) over windows of codes; p holds each code's projected input."""
    n, width = code.shape
    h = np.zeros((n, HIDDEN), np.float32)
    out = np.zeros((width, n, HIDDEN), np.float32)
    tape = []
    for t in range(width - 1, -1, -1) if back else range(width):
        x, g = p[code[:, t]], h @ u
        zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        cand = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
        m = mask[:, t : t + 1]
        new = h + m * (1 - z) * (cand - h)
        if keep:
            tape.append((t, h, z, r, cand, g[:, 2 * HIDDEN :], m))
        h = out[t] = new
    return out, tape


def pool(w: dict, states: np.ndarray, mask: np.ndarray):
    """(logit, attention, tanh, pooled) of each window."""
    q = np.tanh(states @ w["A"] + w["a"])
    e = q @ w["v"]
    e = np.where(mask.T > 0, e, np.float32(-30))
    e = np.exp(e - e.max(axis=0))
    att = e / e.sum(axis=0) * (mask.T > 0)
    pooled = np.einsum("tn,tnh->nh", att, states)
    return pooled @ w["o"] + w["k"][0], att, q, pooled


def windows(row: np.ndarray, n: int, width: int = WIDTH, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, row) of all windows; a row without words has one of none."""
    ptr = np.searchsorted(row, np.arange(n + 1))
    size = np.diff(ptr)
    of = np.maximum(1, 1 + -(-(size - width) // stride))
    which = np.repeat(np.arange(n), of)
    k = np.arange(len(which)) - np.repeat(np.concatenate([[0], np.cumsum(of)[:-1]]), of)
    first = ptr[which] + k * stride
    return first, np.minimum(width, ptr[which + 1] - first), which


def _codes(code: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    col = np.arange(width)
    mask = (col < size[:, None]).astype(np.float32)
    at = np.minimum(first[:, None] + col, max(len(code) - 1, 0))
    return (code[at] if len(code) else np.zeros((len(first), width), np.int64)), mask


class Prepared:
    """A slice's distinct words and windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = folded(data)
        start, end, self.row = pieces_of_runs(low, *trimmed_words(low, offsets))
        self.code, self.hash, first = tk.distinct(tk.hashes(low, start, end))
        if len(first):
            self.feats, self.ptr = char_features(low, start[first], end[first])
        else:
            self.feats, self.ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.first, self.size, self.text = windows(self.row, len(offsets) - 1)

    @classmethod
    def of_texts(cls, texts: list[str]) -> Prepared:
        """All texts as one slice, prepared slice by slice, so that beside the result memory is a slice's."""
        codes, hashes, feats, sizes, rows, n_words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], 0
        for a, _, data, offsets in tk.slices(pa.array(texts, pa.large_string())):
            part = cls(data, offsets)
            codes.append(part.code + n_words)
            rows.append(part.row + a)
            hashes.append(part.hash)
            feats.append(part.feats)
            sizes.append(np.diff(part.ptr))
            n_words += len(part.hash)
        s = cls.__new__(cls)
        s.row = np.concatenate(rows)
        code, s.hash, first = tk.distinct(np.concatenate(hashes))
        s.code = code[np.concatenate(codes)]
        ptr = np.cumsum(np.concatenate(sizes))
        s.feats, s.ptr = tk.csr_take(np.concatenate(feats), ptr, first), np.concatenate([[0], np.cumsum(np.diff(ptr)[first])])
        s.first, s.size, s.text = windows(s.row, len(texts))
        return s

    def words_of(self, known: np.ndarray) -> np.ndarray:
        """The dictionary's number of each distinct word; 0 if it has none."""
        if not len(known):
            return np.zeros(len(self.hash), np.int64)
        at = np.minimum(np.searchsorted(known, self.hash), len(known) - 1)
        return np.where(known[at] == self.hash, at + 1, 0)


def logits(net: Net, s: Prepared, some: np.ndarray | None = None) -> np.ndarray:
    """The logit of each window."""
    w = net.w
    some = np.arange(len(s.first)) if some is None else some
    x, _ = inputs(w, s.words_of(net.known), s.feats, s.ptr) if len(s.hash) else (np.zeros((1, WORD_DIM + CHAR_DIM), np.float32), None)
    pf, pb = x @ w["Wf"] + w["cf"], x @ w["Wb"] + w["cb"]
    out = np.zeros(len(some), np.float32)
    for k in range(0, len(some), 4096):
        at = some[k : k + 4096]
        code, mask = _codes(s.code, s.first[at], s.size[at], WIDTH)
        hf, _ = run_gru(pf, w["Uf"], code, mask, False)
        hb, _ = run_gru(pb, w["Ub"], code, mask, True)
        out[k : k + 4096] = pool(w, np.concatenate([hf, hb], axis=2), mask)[0]
    return out


def _step(w: dict, word, feats, ptr, code, mask, y) -> dict[str, np.ndarray]:
    """Gradients of the mean log loss over a batch of windows; `code` refers to the distinct words given."""
    x, root = inputs(w, word, feats, ptr)
    pf, pb = x @ w["Wf"] + w["cf"], x @ w["Wb"] + w["cb"]
    hf, tf = run_gru(pf, w["Uf"], code, mask, False, True)
    hb, tb = run_gru(pb, w["Ub"], code, mask, True, True)
    states = np.concatenate([hf, hb], axis=2)
    logit, att, q, pooled = pool(w, states, mask)
    g = {}
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g["o"], g["k"] = pooled.T @ d, np.array([d.sum()], np.float32)
    dpool = d[:, None] * w["o"]
    ds = att[:, :, None] * dpool
    da = np.einsum("tnh,nh->tn", states, dpool)
    de = att * (da - (att * da).sum(axis=0))
    g["v"] = np.einsum("tn,tnh->h", de, q)
    dq = de[:, :, None] * w["v"] * (1 - q * q)
    g["A"], g["a"] = np.einsum("tni,tnj->ij", states, dq, optimize=True), dq.sum(axis=(0, 1))
    ds = ds + dq @ w["A"].T
    dx = np.zeros_like(x)
    for side, tape, part in (("f", tf, ds[:, :, :HIDDEN]), ("b", tb, ds[:, :, HIDDEN:])):
        u = w[f"U{side}"]
        dp_all = np.zeros((code.shape[1], *code.shape[:1], 3 * HIDDEN), np.float32)
        du, dh = np.zeros_like(u), np.zeros((len(y), HIDDEN), np.float32)
        for t, h, z, r, cand, gn, m in reversed(tape):
            dh = dh + part[t]
            dm = dh * m
            dn = dm * (1 - z) * (1 - cand * cand)
            dz = dm * (h - cand) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dp_all[t] = np.concatenate([dz, dr, dn], axis=1)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            du += h.T @ dg
            dh = dh * (1 - m) + dm * z + dg @ u.T
        dp = summed(dp_all.reshape(-1, 3 * HIDDEN), code.T.ravel(), len(x))
        g[f"U{side}"], g[f"W{side}"], g[f"c{side}"] = du, x.T @ dp, dp.sum(axis=0)
        dx += dp @ w[f"W{side}"].T
    g["word"] = summed(dx[:, :WORD_DIM], word, len(w["word"]))
    g["char"] = summed(np.repeat(dx[:, WORD_DIM:] / root[:, None], np.diff(ptr), axis=0), feats, BUCKETS)
    return g


def summed(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of `values` by `at`."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    if len(at):
        out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def train(rows: list[tuple[str, int]], seed: int = 7) -> Net:
    """From (text, label) pairs."""
    y = np.array([b for _, b in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return Net(np.zeros(0, np.uint64), {}, (0.0, 0.5, 0.5), float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    rows = rows + [("", 0)] * max(4, len(rows) // 40)  # a text without words is learned as label 0
    y = np.array([b for _, b in rows], np.float32)
    s = Prepared.of_texts([t for t, _ in rows])
    # log-odds of words and features by texts that have them
    label = y.astype(bool)
    n_pos, n_neg = label.sum(), (~label).sum()
    w_has, f_has = np.zeros((2, len(s.hash)), np.int64), np.zeros((2, BUCKETS), np.int64)
    begin = np.searchsorted(s.row, np.arange(len(y) + 1))
    for i in range(len(y)):  # text by text, so that memory is a text's
        word = np.unique(s.code[begin[i] : begin[i + 1]])
        w_has[int(label[i]), word] += 1
        f_has[int(label[i]), np.unique(tk.csr_take(s.feats, s.ptr, word))] += 1
    in_docs = w_has.sum(axis=0)
    odds = lambda has: np.where(has[1] >= 3, np.log((has[1] + 0.1) / n_pos) - np.log((has[0] + 0.5) / n_neg), 0.0)
    w_odds, f_odds = odds(w_has), odds(f_has)
    top = np.maximum(w_odds, np.maximum.reduceat(f_odds[s.feats], s.ptr[:-1]) if len(s.feats) else 0)
    at_word, heat = top[s.code], np.zeros(len(s.first))
    for k in range(0, len(heat), 4096):
        code, mask = _codes(at_word, s.first[k : k + 4096], s.size[k : k + 4096], WIDTH)
        heat[k : k + 4096] = np.where(mask > 0, np.maximum(code - 1.5, 0), 0).sum(axis=1)
    by_heat = np.lexsort((-heat, s.text))
    rank = np.arange(len(by_heat)) - np.searchsorted(s.text[by_heat], s.text[by_heat], "left")
    hot = by_heat[rank < 2]
    pick = np.concatenate([hot[~label[s.text[hot]] | (heat[hot] > 1.0)], rng.permutation(np.flatnonzero(~label[s.text]))[: n_neg]])
    often = np.argsort(-in_docs, kind="stable")[:DICTIONARY]
    known = np.sort(s.hash[often[in_docs[often] >= 3]])
    w = _params(rng, len(known))
    net = Net(known, w, (0.0, 0.5, 0.5))
    of_word = s.words_of(known)
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    batches = max(1, len(pick) // 256)
    for _ in range(max(EPOCHS, -(-STEPS // batches))):
        for some in np.array_split(rng.permutation(pick), batches):
            code, mask = _codes(s.code, s.first[some], s.size[some], WIDTH)
            local, code = np.unique(code, return_inverse=True)
            own = s.ptr[local + 1] - s.ptr[local]
            g = _step(w, of_word[local], tk.csr_take(s.feats, s.ptr, local), np.concatenate([[0], np.cumsum(own)]), code.reshape(mask.shape), mask, y[s.text[some]])
            step += 1
            rate = 0.01 * min(1.0, step / 30)
            for k, v in g.items():
                a, b = mom[k]
                a += 0.1 * (v - a)
                b += 0.01 * (v * v - b)
                w[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    net.scale = _calibrate(_top_two(s.text, logits(net, s), len(y)), y)
    return net


def _top_two(text: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """1, the greatest logit and the second (the greatest again if there is but one window) of each text, clipped."""
    order = np.lexsort((-logit, text))
    first = np.searchsorted(text[order], np.arange(n))
    last = np.searchsorted(text[order], np.arange(n), "right")
    x = np.clip(logit[order], -12, 12)
    return np.stack([np.ones(n), x[first], x[np.minimum(first + 1, last - 1)]], axis=1)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights of a logistic fit, by damped Newton steps, near (0, 1/2, 1/2)."""
    prior, keep = np.array([0.0, 0.5, 0.5]), np.diag([1e-3, 1.0, 1.0])
    w = prior.copy()
    for _ in range(40):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ (w - prior))
        w = w - np.clip(step, -1, 1)
    return tuple(np.concatenate([w[:1], np.maximum(w[1:], 0.0)]))


def score_slice(net: Net, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, windows) of each row."""
    n = len(offsets) - 1
    if net.base is not None:
        return np.full(n, net.base), np.ones(n, np.int64)
    s = Prepared(data, offsets)
    return _sigmoid(_top_two(s.text, logits(net, s), n) @ np.array(net.scale)).astype(np.float64), np.bincount(s.text, minlength=n)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_chars: int = MOST_CHARS) -> Net:
    """Learns from documents whose labels.toxic is known; some `sample` of each label, or all if there are fewer."""
    docs = docs.where(F.char_length("text") <= most_chars)
    known = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = written(known.join(docs.select("doc_id"), "doc_id", "left_semi"), "toxic-labels")  # those that can be learned from
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return train([])
    rate = F.lit(0.0)
    for k, n in counts.items():
        rate = F.when(F.col("toxic") == k, F.lit(min(1.0, sample / n))).otherwise(rate)
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).limit(4 * sample)  # a bound that chance does not reach
    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic").toLocalIterator()
    return train(sorted((r["text"], int(r["toxic"] > 0)) for r in rows))


def score(docs: DataFrame, net: Net, carry: dict[str, Column] | None = None, text_col: str = "text") -> DataFrame:
    """The columns of `carry` with score, predicted and n_windows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a network of fixed size
    carry = carry if carry is not None else {"doc_id": F.col("doc_id")}
    picked = docs.select(F.col(text_col).alias("__text"), *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    kinds = ", ".join(f"c{i} {picked.schema[i + 1].dataType.simpleString()}" for i in range(len(carry)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(0)):
                x, n = score_slice(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i + 1).slice(a, b - a) for i in range(batch.num_columns - 1)] + [pa.array(x), pa.array((x >= THRESHOLD).astype(np.int32)), pa.array(n)],
                    [f"c{i}" for i in range(batch.num_columns - 1)] + ["score", "predicted", "n_windows"],
                )

    out = picked.mapInArrow(run, f"{kinds}, score double, predicted int, n_windows long")
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(carry)], "score", "predicted", "n_windows")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out(3)), table(spark, sf_dir, "labels"))
    return score(docs, net, {"doc_id": F.col("doc_id"), "held_out": held_out(3)})
