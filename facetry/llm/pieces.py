"""Unigram segmentation over a double-array trie of pieces: the vocabulary, Viterbi, and its trie-shared form.

Inside, the white-space marker is the byte 0xFF, which no UTF-8 text has; so a marker written in a text is ordinary
text and goes through byte fallback, and decoding gives the text back.  Scores are whole numbers: a piece's log score
times 2^16, in the upper digits, less one per piece in the lower, so that of equal scores fewer pieces win; of what is
then equal, the longer last piece.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np

from facetry.llm import textkit as tk

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, MARKER = 0xFF, "▁"
_COUNT = 4096  # more pieces than a span of tk.LONG symbols can have
_NONE = np.int64(-(1 << 62))


@dataclass
class Pieces:
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id at a state, or -1
    score: np.ndarray  # of each id, scaled
    byte_id: np.ndarray  # id of each byte's fallback piece
    byte_score: int
    text: np.ndarray  # decoded bytes of all ids, one after the other
    ptr: np.ndarray
    joins: np.ndarray  # whether some piece holds byte x and then byte y

    @property
    def n(self) -> int:
        return len(self.ptr) - 1


def double_array(keys: list[bytes], ids: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value): from state s, byte b leads to base[s]+b if check there is s. The root is 1."""
    children: list[dict[int, int]] = [{}]
    value = [-1]
    for key, i in zip(keys, ids, strict=True):
        node = 0
        for b in key:
            to = children[node].get(b)
            if to is None:
                to = children[node][b] = len(children)
                children.append({})
                value.append(-1)
            node = to
        value[node] = i
    room = 4 * len(children) + 1024
    base, check, val = np.zeros(room, np.int32), np.zeros(room, np.int32), np.full(room, -1, np.int32)
    used = bytearray(room)
    used[0] = used[1] = 1
    state, low = {0: 1}, 2
    queue = [0]
    for node in queue:
        kids = sorted(children[node])
        if not kids:
            continue
        while used[low]:
            low += 1
        b = max(1, low - kids[0])
        tries = 0
        while any(used[b + k] for k in kids):
            b += 1
            tries += 1
        if tries > 500:
            low += 64
        s = state[node]
        base[s] = b
        for k in kids:
            used[b + k] = 1
            check[b + k] = s
            child = children[node][k]
            state[child] = b + k
            val[b + k] = value[child]
            queue.append(child)
    return base, check, val


@functools.lru_cache(maxsize=2)
def load(model: str = DEFAULT_MODEL) -> Pieces:
    """The pieces of a published SentencePiece model file.

    Its scores are ranks, so a piece's log score is that of Zipf's law: -ln(rank + 1) - ln(H), H normalising.
    Runs of markers, which carry no rank, come last.  Pieces with a marker after another character cannot occur here.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    norm = math.log(sum(1 / (k + 1) for k in range(1, n + 1)))
    keys, ids, score = [], [], np.zeros(n, np.int64)
    text, byte_id = [b""] * n, np.zeros(256, np.int32)
    low = 0.0
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            b = int(piece[3:5], 16)
            byte_id[b] = i
            text[i] = bytes([b])
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and MARKER not in piece.lstrip(MARKER):
            rank = -sp.get_score(i)
            log = -math.log(1 + (rank if 0 < rank < n else n)) - norm
            low = min(low, log)
            score[i] = round(log * 65536) * _COUNT - 1
            keys.append(b"".join(bytes([MARK]) if c == MARKER else c.encode() for c in piece))
            ids.append(i)
            text[i] = piece.replace(MARKER, " ").encode()
    byte_score = round((low - 10) * 65536) * _COUNT - 1
    score[byte_id] = byte_score
    base, check, value = double_array(keys, ids)
    joins = np.zeros((256, 256), bool)
    for key in keys:
        joins[list(key[:-1]), list(key[1:])] = True
    size = np.array([len(t) for t in text], np.int64)
    return Pieces(base, check, value, score, byte_id, byte_score, np.frombuffer(b"".join(text), np.uint8), np.concatenate([[0], np.cumsum(size)]), joins)


def segment_one(p: Pieces, key: bytes) -> list[int]:
    """Viterbi for one span of any length."""
    n = len(key)
    best: list[tuple[int, int]] = [(0, 0)] + [(-(1 << 200), 0)] * n  # score, minus the count
    back = [(0, 0)] * (n + 1)
    base, check, value, score = p.base, p.check, p.value, p.score
    for i in range(n):
        s0, c0 = best[i]
        new = ((s0 + p.byte_score + 1), c0 - 1)
        if new > best[i + 1]:
            best[i + 1], back[i + 1] = new, (i, int(p.byte_id[0x20 if key[i] == MARK else key[i]]))
        state = 1
        for j in range(i, n):
            to = int(base[state]) + key[j]
            if base[state] == 0 or check[to] != state:
                break
            state = to
            v = int(value[state])
            if v >= 0:
                new = (s0 + int(score[v]) + 1, c0 - 1)
                if new > best[j + 1]:
                    best[j + 1], back[j + 1] = new, (i, v)
    out = []
    while n:
        n, v = back[n]
        out.append(v)
    return out[::-1]


def segment(p: Pieces, m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ptr): Viterbi for every row of the byte matrix at once."""
    rows, width = m.shape
    best = np.full((rows, width + 1), _NONE)
    best[:, 0] = 0
    back, piece = np.zeros((rows, width + 1), np.int16), np.zeros((rows, width + 1), np.int32)
    byte_id = p.byte_id.copy()
    byte_id[MARK] = p.byte_id[0x20]
    for i in range(width):
        cur = np.flatnonzero(size > i)
        cand = best[cur, i] + p.byte_score
        won = cand > best[cur, i + 1]
        w = cur[won]
        best[w, i + 1], back[w, i + 1], piece[w, i + 1] = cand[won], i, byte_id[m[w, i]]
        state, j = np.ones(len(cur), np.int32), i
        while len(cur):
            to = p.base[state] + m[cur, j]
            ok = p.check[to] == state
            cur, state = cur[ok], to[ok]
            v = p.value[state]
            ends = v >= 0
            r, v = cur[ends], v[ends]
            cand = best[r, i] + p.score[v]
            won = cand > best[r, j + 1]
            r = r[won]
            best[r, j + 1], back[r, j + 1], piece[r, j + 1] = cand[won], i, v[won]
            j += 1
            on = size[cur] > j
            cur, state = cur[on], state[on]
    count = (-best[np.arange(rows), size]) % _COUNT
    ptr = np.concatenate([[0], np.cumsum(count)])
    ids = np.zeros(int(ptr[-1]), np.int32)
    at, pos, live = ptr[1:] - 1, size.astype(np.int64).copy(), np.flatnonzero(size > 0)
    while len(live):
        x = pos[live]
        ids[at[live]] = piece[live, x]
        at[live] -= 1
        pos[live] = back[live, x]
        live = live[pos[live] > 0]
    return ids, ptr


def shared_counts(p: Pieces, m: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, score) of every row's best segmentation.

    The rows are put into a trie; each of its nodes gets its forward score once, for all rows that share the prefix,
    from the nodes above and the states of the piece trie that are alive there; rows read theirs where they end.
    """
    rows, width = m.shape
    order = np.lexsort((size, *(m[:, k] for k in range(width - 1, -1, -1))))  # padding is 0: of rows equal but for it, the shorter comes first
    m, size = m[order], size[order]
    common = np.zeros(rows, np.int64)
    if rows > 1:
        same = np.logical_and.accumulate(m[1:] == m[:-1], axis=1).sum(axis=1)
        common[1:] = np.minimum(same, np.minimum(size[1:], size[:-1]))
    out_n, out_s = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    node = np.zeros(rows, np.int64)  # of each row, at the depth before
    forward = np.zeros(1, np.int64)
    a_ptr, a_state, a_start = np.array([0, 0]), np.zeros(0, np.int32), np.zeros(0, np.int64)
    for d in range(1, width + 1):
        live = np.flatnonzero(size >= d)
        fresh = common[live] < d
        fresh[:1] = True
        rep = live[fresh]
        parent, ch = node[rep], m[rep, d - 1].astype(np.int32)
        # states alive at the parent, and a new one that starts there
        n_of = a_ptr[parent + 1] - a_ptr[parent]
        child = np.repeat(np.arange(len(rep)), n_of)
        state, begun = tk.csr_take(a_state, a_ptr, parent), tk.csr_take(a_start, a_ptr, parent)
        child = np.concatenate([child, np.arange(len(rep))])
        state = np.concatenate([state, np.ones(len(rep), np.int32)])
        begun = np.concatenate([begun, forward[parent]])
        to = p.base[state] + ch[child]
        ok = p.check[to] == state
        child, state, begun = child[ok], to[ok], begun[ok]
        best = forward[parent] + p.byte_score
        v = p.value[state]
        ends = v >= 0
        np.maximum.at(best, child[ends], begun[ends] + p.score[v[ends]])
        by = np.argsort(child, kind="stable")
        a_state, a_start = state[by], begun[by]
        a_ptr = np.concatenate([[0], np.cumsum(np.bincount(child, minlength=len(rep)))])
        forward = best
        node[live] = np.cumsum(fresh) - 1
        done = live[size[live] == d]
        out_n[done] = (-forward[node[done]]) % _COUNT
        out_s[done] = forward[node[done]]
    n, s = np.empty(rows, np.int64), np.empty(rows, np.int64)
    n[order], s[order] = out_n, out_s
    return n, log_score(s, n)


def log_score(packed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log scores from whole-number scores."""
    return (packed + n) // _COUNT / 65536.0


def key_bytes(data: np.ndarray, start: int, end: int, spaces: int) -> bytes:
    return bytes([MARK]) * int(spaces) + data[start:end].tobytes()


class Segmented:
    """What distinct pre-tokens were segmented to, kept over batches; emptied when it holds `most`."""

    def __init__(self, p: Pieces, most: int = 1 << 20):
        self.p, self.most = p, most
        self._clear()

    def _clear(self) -> None:
        self.table = tk.Table()
        self.ids, self.ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def codes(self, data, start, end, spaces) -> np.ndarray:
        """A row of (ids, ptr) for each pre-token."""
        h = tk.mix64(tk.hashes(data, start, end) ^ (spaces.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        code, values, first = tk.distinct(h)
        if self.table.n + len(values) > self.most:
            self._clear()
        row = self.table.find(values)
        new = np.flatnonzero(row < 0)
        if len(new):
            self._add(data, start[first[new]], end[first[new]], spaces[first[new]])
            row[new] = np.arange(self.table.n, self.table.n + len(new))
            self.table.add(values[new])
        return row[code]

    def _add(self, data, start, end, spaces) -> None:
        count = np.zeros(len(start), np.int64)
        short = end - start + spaces <= tk.LONG
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        some = np.flatnonzero(short)
        for k in range(0, len(some), 1 << 16):
            at = some[k : k + (1 << 16)]
            ids, ptr = segment(self.p, *tk.spelled(data, start[at], end[at], spaces[at], MARK))
            parts.append((at, ids, ptr))
            count[at] = np.diff(ptr)
        for i in np.flatnonzero(~short):
            ids = np.array(segment_one(self.p, key_bytes(data, start[i], end[i], spaces[i])), np.int32)
            parts.append((np.array([i]), ids, np.array([0, len(ids)])))
            count[i] = len(ids)
        ptr = np.concatenate([[0], np.cumsum(count)])
        all_ids = np.zeros(int(ptr[-1]), np.int32)
        for at, ids, own in parts:
            all_ids[np.repeat(ptr[at] - own[:-1], np.diff(own)) + np.arange(len(ids))] = ids
        self.ids = np.concatenate([self.ids, all_ids])
        self.ptr = np.concatenate([self.ptr, ptr[1:] + self.ptr[-1]])
