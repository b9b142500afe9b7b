"""N-gram Jaccard join: links and components of texts whose shingle sets are alike, exactly, by signature trees.

A document's set is its distinct k-word shingles.  Documents with equal sets are one node.  Every pair of nodes that
can reach the threshold meets in a cell:

* Sizes fall into classes.  A pair whose smaller set is in class c differs in at most d(c) shingles, so if hash space
  is cut into d + 1 + g ranges, more than g ranges hold the same shingles in both.  A node names each of its ranges by
  what it holds; a name is a cell.
* Linked nodes share more than g cells, so each may leave out its g commonest ones, in an order that all nodes agree
  on (empty ranges first, then by size), and they still share one.  What a passage that many texts share puts into a
  cell is left out that way.
* Of a cell's nodes, those may link whose signatures (size, bitmap of the set) leave enough overlap possible.  A cell
  of at most `small` nodes is one leaf; a larger one gets a signature tree: its leaves are runs of nodes, its inner
  nodes hold the OR of their bitmaps, the range of sizes and the most tokens that share a bit.  A dual traversal drops
  pairs of tree nodes whose greatest possible overlap is too small and skips those that are connected already.

What may link so is a candidate component.  Its sets are read again and joined exactly by a signature tree of their
own.  Cells and components above a size are dealt into blocks: first each block is joined to itself and to a few
pivots, then only what is outside the group's largest class is joined to all blocks.

Defined results: null, empty and blank texts have no shingles, link with nothing and are their own component; a text
with fewer words than k has one shingle, all its words; repeated rows and ties fall to the smallest doc_id; rows with
a null doc_id take part and have the component of their set (null if no row of the component has an id); an empty
table gives no rows; further columns are ignored, whatever their names.  Shingles and sets are held as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from facetry.llm import textkit as tk
from facetry.llm.common import attach, resolved, table, written
from facetry.llm.components import components

#: Shingles in a block of a large component; nodes in a block of a large cell; pivots of one; cells of one flush; buckets for each shuffle partition.
BLOCK, CELL_BLOCK, PIVOTS, FLUSH, BUCKETS = 1 << 17, 4096, 8, 1_000_000, 2
#: Nodes of a cell up to which it is a single leaf.
SMALL = 48
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xC2B2AE3D27D4EB4F)
_LOW40 = np.uint64((1 << 40) - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    n = len(offsets) - 1
    low = tk.lowered(data)
    start, end, row = tk.words(low, offsets)
    h = tk.hashes(low, start, end)
    ptr = np.searchsorted(row, np.arange(n + 1))
    if len(h) >= k:
        m = len(h) - k + 1
        acc = np.zeros(m, np.uint64)
        for j in range(k):
            acc = tk.mix64(acc * _M + h[j : j + m])
    else:
        acc = np.zeros(0, np.uint64)
    out = []
    for i in range(n):
        a, b = int(ptr[i]), int(ptr[i + 1])
        if b - a >= k:
            out.append(np.unique(acc[a : b - k + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for v in h[a:b]:
                x = tk.mix64(x * _M2 + v)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(s: np.ndarray) -> int:
    """A set's node, as a signed 64-bit number; 0 is kept for the empty set."""
    if not len(s):
        return 0
    x = tk.mix64(s * _M2 + np.uint64(len(s)))
    both = np.array([x.sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(tk.mix64(x))])
    return int(tk.mix64(both).view(np.int64)[0]) or 1


class Classes:
    """Size classes, the number of hash ranges of each, and the classes in which a size takes part."""

    def __init__(self, num: int, den: int, ratio: float = 1.5):
        self.num, self.den = num, den
        self.high: list[int] = []
        self.ratio = ratio

    def of(self, n: int) -> list[int]:
        while not self.high or self.high[-1] < n:
            lo = self.high[-1] + 1 if self.high else 1
            self.high.append(max(lo, int(lo * self.ratio)))
        c = int(np.searchsorted(self.high, n))
        return [c] + ([c - 1] if c and n * self.num <= self.high[c - 1] * self.den else [])

    def ranges(self, c: int) -> tuple[int, int]:
        """(number of ranges, g); 0 ranges if only equal sets can link."""
        most = self.high[c]
        d = (most + most * self.den // self.num) * (self.den - self.num) // (self.den + self.num)
        if not d:
            return 0, 0
        g = 2 + d // 8
        return d + 1 + g, g


def cells(s: np.ndarray, classes: Classes) -> list[tuple[np.ndarray, int]]:
    """For each class of a set: the names of its ranges, and how many of the commonest of these it may leave out.

    Empty ranges count as commonest, those of greater index before others, so up to g of them are not named at all.
    """
    out = []
    mixed = None
    for c in classes.of(len(s)):
        n, g = classes.ranges(c)
        if not n:
            continue
        where = ((s >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        first = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
        mixed = tk.mix64(s) if mixed is None else mixed
        named = np.add.reduceat(mixed, first) + (where[first] * np.uint64(65537) + np.uint64(c + 1)) * _M
        empty = n - len(first)
        if empty > g:
            blank = np.setdiff1d(np.arange(n, dtype=np.uint64), where[first])[: empty - g]
            named = np.concatenate([named, (blank * np.uint64(65537) + np.uint64(c + 1)) * _M2])
        out.append((tk.mix64(named), max(0, g - empty)))
    return out


def bitmap(s: np.ndarray) -> bytes:
    """The bits of a set's shingles: as many as it has members, rounded up to a power of two, 256 to 65,536."""
    flat = np.zeros(1 << int(np.clip(int(len(s) - 1).bit_length(), 8, 16)), bool)
    flat[(s & np.uint64(len(flat) - 1)).astype(np.int64)] = True
    return np.packbits(flat).tobytes()


def folded(bits: list[bytes], width: int | None = None) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all `width` bytes long (the shortest's length): halves of a longer one are ORed."""
    width = width or min(map(len, bits))
    out = np.empty((len(bits), width), np.uint8)
    for size in {len(b) for b in bits}:
        at = [i for i, b in enumerate(bits) if len(b) == size]
        x = np.frombuffer(b"".join(bits[i] for i in at), np.uint8).reshape(len(at), size // width, width)
        out[at] = np.bitwise_or.reduce(x, axis=1)
    return out.view(np.uint64)


_SCHEMA = "kind int, doc_id long, n long, node long, bits binary, bucket int, cell binary, hold binary, name long"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
_NAMES = ["kind", "doc_id", "n", "node", "bits", "bucket", "cell", "hold", "name"]
#: Members of cells: info is 2 * spare + class, both the cell's size (upper half) and the set's.
_MEMBER = "node long, info int, cell long, both long"


def _batch(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


class Entries:
    """A set in one of its classes: node, size, which of its classes (0, 1), and how many cells it may leave out."""

    def __init__(self, node: np.ndarray, n: np.ndarray, info: np.ndarray):
        self.node, self.n, self.info = node, n, info  # info: 2 * spare + class

    def pack(self, at: np.ndarray) -> bytes:
        """The entries named by `at`, each once, and then `at` in terms of these."""
        names, at = np.unique(at, return_inverse=True)
        small = len(names) < 65536
        return np.array([len(names)], "<i8").tobytes() + self.node[names].astype("<i8").tobytes() + self.n[names].astype("<u4").tobytes() + self.info[names].astype("<u4").tobytes() + at.astype("<u2" if small else "<u4").tobytes()

    @staticmethod
    def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, n, info) of each place."""
        k = int(np.frombuffer(b, "<i8", 1)[0])
        at = np.frombuffer(b, "<u2" if k < 65536 else "<u4", -1, 8 + 16 * k)
        return tuple(np.frombuffer(b, kind, k, 8 + off * k)[at] for kind, off in (("<i8", 0), ("<u4", 8), ("<u4", 12)))


def _scan(num: int, den: int, k: int, buckets: int, small: int):
    """kind 0: each row's set; 1: cells of a bucket with their nodes; 2: a cell with so many nodes here that they stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, seen = Classes(num, den), set()
        held: list[np.ndarray] = []
        entries: list[tuple[int, int, int]] = []  # node, n, info

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            name = np.concatenate(held)
            own = np.repeat(np.arange(len(held)), [len(c) for c in held])
            of = Entries(*(np.array(x) for x in zip(*entries, strict=True)))
            held.clear()
            entries.clear()
            order = np.argsort(name, kind="stable")  # by bucket, then by cell
            name, own = name[order], own[order]
            fresh = np.concatenate([[0], np.flatnonzero(name[1:] != name[:-1]) + 1])
            size = np.diff(np.append(fresh, len(name)))
            hot = np.flatnonzero(size > small)
            for i in range(0, len(hot), 64):
                some = hot[i : i + 64]
                yield _batch(len(some), kind=np.full(len(some), 2, np.int32), name=name[fresh[some]].astype(np.int64), hold=[of.pack(own[fresh[q] : fresh[q] + size[q]]) for q in some])
            rest = np.repeat(size <= small, size)
            hot_name, hot_size = name[fresh[hot]], size[hot]
            name, own = name[rest], own[rest]
            edge = np.searchsorted(name >> np.uint64(40), np.arange(buckets + 1))
            hot_edge = np.searchsorted(hot_name >> np.uint64(40), np.arange(buckets + 1))
            have = np.flatnonzero(np.diff(edge) + np.diff(hot_edge))
            packed, holds = [], []
            for q in have:
                x, y = name[edge[q] : edge[q + 1]], slice(hot_edge[q], hot_edge[q + 1])
                packed.append(np.array([len(x)], "<i8").tobytes() + (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32) & np.uint64(0xFF)).astype(np.uint8).tobytes() + (hot_name[y] & _LOW40).astype("<u8").tobytes() + hot_size[y].astype("<i8").tobytes())
                holds.append(of.pack(own[edge[q] : edge[q + 1]]))
            for i in range(0, len(have), 64):
                yield _batch(len(have[i : i + 64]), kind=np.ones(len(have[i : i + 64]), np.int32), bucket=have[i : i + 64], cell=packed[i : i + 64], hold=holds[i : i + 64])

        n_held = 0
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                nodes = np.array([set_digest(s) for s in sets], np.int64)
                yield _batch(b - a, kind=np.zeros(b - a, np.int32), doc_id=batch.column(0).slice(a, b - a), n=np.array([len(s) for s in sets], np.int64), node=nodes, bits=[bitmap(s) for s in sets])
                for s, node in zip(sets, nodes.tolist(), strict=True):
                    if node and node not in seen:
                        if len(seen) > 2_000_000:
                            seen.clear()
                        seen.add(node)
                        for ent, (c, spare) in enumerate(cells(s, classes)):
                            held.append(((c >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | c & _LOW40)
                            entries.append((node, len(s), 2 * spare + ent))
                            n_held += len(c)
                if n_held > FLUSH:
                    yield from flush()
                    n_held = 0
        yield from flush()

    return run


def _meet(t: pa.Table) -> pa.Table:
    """A bucket's cells of more than one node: their members with the cell's size; for cells held apart the size alone."""
    names, sizes, parts = [], [], []
    hot_names, hot_sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for c, h in zip(t.column("cell").to_pylist(), t.column("hold").to_pylist(), strict=True):
        n = int(np.frombuffer(c, "<i8", 1)[0])
        names.append(np.frombuffer(c, "<u4", n, 8).astype(np.uint64) | np.frombuffer(c, np.uint8, n, 8 + 4 * n).astype(np.uint64) << np.uint64(32))
        more = (len(c) - 8 - 5 * n) // 16
        hot_names.append(np.frombuffer(c, "<u8", more, 8 + 5 * n))
        hot_sizes.append(np.frombuffer(c, "<i8", more, 8 + 5 * n + 8 * more))
        parts.append(Entries.unpack(h))
    name, (node, n, info) = np.concatenate(names), (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((node, name))
    name, node, n, info = name[order], node[order], n[order], info[order]
    once = np.ones(len(name), bool)
    once[1:] = (name[1:] != name[:-1]) | (node[1:] != node[:-1])
    name, node, n, info = name[once], node[once], n[once], info[once]
    apart, at = np.unique(np.concatenate(hot_names), return_inverse=True)
    apart_size = np.bincount(at, weights=np.concatenate(hot_sizes), minlength=len(apart)).astype(np.int64)
    of, code, count = np.unique(name, return_inverse=True, return_counts=True)
    sizes = count.astype(np.int64)
    if len(apart) and len(of):
        both = np.minimum(np.searchsorted(apart, of), len(apart) - 1)
        sizes += np.where(apart[both] == of, apart_size[both], 0)
        mine = np.minimum(np.searchsorted(of, apart), len(of) - 1)
        apart_size = apart_size + np.where(of[mine] == apart, count[mine], 0)
    size = sizes[code]
    on = size > 1
    bucket = np.uint64(t.column("bucket")[0].as_py()) << np.uint64(40)
    pad = len(apart)
    some = lambda x, kind: pa.concat_arrays([pa.array(x[on], kind), pa.nulls(pad, kind)])
    return pa.table({
        "node": some(node, pa.int64()), "info": some(info.astype(np.int32), pa.int32()), "cell": pa.array(np.concatenate([name[on] | bucket, apart | bucket]).astype(np.int64)),
        "both": pa.array(np.concatenate([(size[on] << 32) + n[on], apart_size << 32])),
    })


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of cells that were held apart: cell, hold, size."""
    for batch in batches:
        for cell, hold, size in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            node, n, info = Entries.unpack(hold)
            yield pa.RecordBatch.from_pydict({"node": node, "info": info.astype(np.int32), "cell": np.full(len(node), cell), "both": (size << 32) + n.astype(np.int64)})


def _possible(num: int, den: int):
    """Drops pairs whose bitmaps rule the threshold out: each bit of one that the other lacks is a shingle it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(k).to_numpy() for k in range(4))
            x, y = (batch.column(k).to_pylist() for k in (4, 5))
            width = np.array([min(len(p), len(q)) for p, q in zip(x, y, strict=True)], np.int64)
            on = np.zeros(len(a), bool)
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                p, q = folded([x[i] for i in at], int(w)), folded([y[i] for i in at], int(w))
                most = np.minimum(na[at] - np.bitwise_count(p & ~q).sum(axis=1, dtype=np.int64), nb[at] - np.bitwise_count(q & ~p).sum(axis=1, dtype=np.int64))
                on[at] = most * (num + den) >= num * (na[at] + nb[at])
            yield pa.RecordBatch.from_pydict({"a": a[on], "b": b[on]})

    return run


class SignatureTree:
    """Signatures in leaves of `fan`; each node: OR of bitmaps, least and greatest size, most tokens beyond their bits.

    `bits`: bitmaps of one width as rows of 64-bit words; `size`: of each set; `key`: what puts like sets side by side;
    `sets`: the sorted sets, if links are to be exact, else what may link is a link.
    """

    def __init__(self, bits: np.ndarray, size: np.ndarray, key: np.ndarray, sets: list[np.ndarray] | None = None, fan: int = 16):
        self.fan = fan
        self.order = np.lexsort((key, np.floor(np.log(np.maximum(size, 1)) * 8)))
        self.sets = None if sets is None else [sets[i] for i in self.order]
        self.size = size[self.order]
        bits = bits[self.order]
        over = self.size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, self.size, self.size, over)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, ov = self.levels[-1]
            cut = np.arange(0, len(b), fan)
            self.levels.append((np.bitwise_or.reduceat(b, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ov, cut)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], fan: int = 16) -> SignatureTree:
        size = np.array([len(s) for s in sets])
        width = 1 << int(np.clip(np.ceil(np.log2(max(64, 4 * size.max()))), 8, 17))
        bits = np.zeros((len(sets), width // 8), np.uint8)
        for i, s in enumerate(sets):
            flat = np.zeros(width, bool)
            flat[(s & np.uint64(width - 1)).astype(np.int64)] = True
            bits[i] = np.packbits(flat)
        return cls(bits.view(np.uint64), size, np.array([s[0] if len(s) else 0 for s in sets], np.uint64), sets, fan)

    def may(self, level: int, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        """Which node pairs can hold a linked pair: by sizes, then by the greatest possible overlap."""
        b, lo, hi, ov = self.levels[level]
        ok = (hi[i] * den >= lo[j] * num) & (hi[j] * den >= lo[i] * num)
        at = np.flatnonzero(ok)
        for k in range(0, len(at), 2048):
            x = at[k : k + 2048]
            a, c = i[x], j[x]
            most = np.bitwise_count(b[a] & b[c]).sum(axis=1, dtype=np.int64) + np.minimum(ov[a], ov[c])
            most = np.minimum(most, np.minimum(hi[a], hi[c]))
            ok[x] = most * (num + den) >= num * (lo[a] + lo[c])
        return ok

    def links(self, num: int, den: int, label: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Links that connect all that is linked, as positions in the sets given; `label` says what is connected already."""
        lab = label[self.order].copy()
        out: list[tuple[int, int]] = []

        def one(level: int, i: int, j: int) -> bool:
            step = self.fan**level
            a, b = lab[i * step : (i + 1) * step], lab[j * step : (j + 1) * step]
            return bool((a == a[0]).all() and (b == a[0]).all())

        def linked(i: int, j: int) -> bool:
            if self.sets is None:
                return True
            x, y = self.sets[i], self.sets[j]
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            return both * den >= num * (len(x) + len(y) - both)

        def walk(level: int, i: int, j: int) -> None:
            if level == 0:
                if i != j and lab[i] != lab[j] and linked(i, j):
                    out.append((int(self.order[i]), int(self.order[j])))
                    lab[lab == lab[j]] = lab[i]
                return
            if one(level, i, j):
                return
            n = len(self.levels[level - 1][0])
            ci, cj = np.arange(i * self.fan, min(n, (i + 1) * self.fan)), np.arange(j * self.fan, min(n, (j + 1) * self.fan))
            p, q = (np.repeat(ci, len(cj)), np.tile(cj, len(ci)))
            if i == j:
                keep = p < q if level == 1 else p <= q
                p, q = p[keep], q[keep]
            ok = self.may(level - 1, p, q, num, den)
            near = np.argsort(np.abs(p[ok] - q[ok]), kind="stable")
            for a, b in zip(p[ok][near].tolist(), q[ok][near].tolist(), strict=True):
                walk(level - 1, a, b)

        top = len(self.levels) - 1
        if top:
            walk(top, 0, 0)
        back = np.empty_like(lab)
        back[self.order] = lab
        return out, back


def _by_sets(k: int) -> Callable[[list[tuple]], SignatureTree]:
    """A tree of texts' sets. Rows: (text,)."""

    def build(rows: list[tuple]) -> SignatureTree:
        sets = []
        for _, _, data, offsets in tk.slices(pa.array([r[0] for r in rows], pa.large_string())):
            sets += shingle_sets(data, offsets, k)
        return SignatureTree.of_sets(sets)

    return build


def _by_signatures(rows: list[tuple]) -> SignatureTree:
    """A tree of signatures. Rows: (n, bits)."""
    bits = folded([r[1] for r in rows])
    return SignatureTree(bits, np.array([r[0] for r in rows], np.int64), bits[:, 0])


def _join(num: int, den: int, build: Callable[[list[tuple]], SignatureTree]):
    """Rows sorted by group: group, node, label, what `build` takes. Gives links of nodes."""

    def close(rows: list[tuple]) -> pa.RecordBatch | None:
        ids, first = np.unique(np.array([r[0] for r in rows], np.int64), return_index=True)
        if len(ids) < 2:
            return None
        _, label = np.unique(np.array([rows[i][1] for i in first], np.int64), return_inverse=True)
        links, _ = build([rows[i][2:] for i in first]).links(num, den, label)
        if not links:
            return None
        at = np.array(links)
        return pa.RecordBatch.from_pydict({"a": ids[at[:, 0]], "b": ids[at[:, 1]]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != now:
                    if held and (out := close(held)) is not None:
                        yield out
                    now, held = row[0], []
                held.append(row[1:])
        if held and (out := close(held)) is not None:
            yield out

    return run


def _links_of(groups: DataFrame, payload: list[str], kernel) -> DataFrame:
    dealt = groups.repartition("grp").sortWithinPartitions("grp").select("grp", "node", "label", *payload)
    return dealt.mapInArrow(tk.returning(kernel), "a long, b long")


def _grouped_links(rows: DataFrame, payload: list[str], kernel, block: int, name: str) -> DataFrame:
    """Links within groups. `rows`: comp, node, members and weight of its group, payload; above a weight of `block` in blocks."""
    rows = rows.withColumn("blocks", F.ceil(F.col("weight") / block))
    small = rows.where("blocks <= 1").select(F.col("comp").cast("string").alias("grp"), "node", F.col("node").alias("label"), *payload)
    links = written(_links_of(small, payload, kernel), f"{name}-links")
    large = rows.where("blocks > 1").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")))
    if large.isEmpty():
        return links
    rank = F.row_number().over(Window.partitionBy("comp", "blk").orderBy(F.xxhash64("node")))
    heads = large.where("blk < 4").withColumn("r", rank).where(F.col("r") <= PIVOTS // 4).select("comp", "blocks", "node", *payload)
    pivots = heads.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cols = ["node", "label", *payload]
    first = large.select("comp", "blk", "node", *payload).unionByName(pivots.select("comp", "blk", "node", *payload)).withColumn("label", F.col("node"))
    one = written(_links_of(first.select(F.concat_ws(":", "comp", "blk").alias("grp"), *cols), payload, kernel), f"{name}-links1")
    state = large.join(components(one), "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = state.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("rows"), F.max("n").alias("most"))
    state = written(attach(state, main, "comp", "rows", state.count()), f"{name}-state")
    # what is not in its group's largest class, in parts of a block's weight each
    part_of = F.greatest(F.ceil((F.col("rows") - F.col("most")) * F.col("weight") / F.col("members") / F.lit(block)), F.lit(1))
    left = state.where("label <> main").withColumn("part", F.pmod(F.xxhash64("label", "node"), part_of))
    left = left.withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    every = state.where("rows > most").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), part_of - 1)))
    both = left.select("comp", "blk", "part", *cols).unionByName(every.select("comp", "blk", "part", *cols))
    two = written(_links_of(both.select(F.concat_ws(":", "comp", "blk", "part").alias("grp"), *cols), payload, kernel), f"{name}-links2")
    return links.unionByName(one).unionByName(two)


def _candidates(scan: DataFrame, nodes: DataFrame, num: int, den: int, small: int, cell_block: int) -> DataFrame:
    """a, b: links that connect whatever may link. `scan`: of `_scan`; `nodes`: node, n, bits."""
    met = written(scan.where("kind = 1").select("bucket", "cell", "hold").groupBy("bucket").applyInArrow(_meet, _MEMBER), "ngram-met")
    members, apart = met.where("node is not null"), scan.where("kind = 2").select(F.col("name").alias("cell"), "hold")
    if not apart.isEmpty():
        sizes = met.where("node is null").select("cell", F.shiftright("both", 32).alias("size"))
        members = members.unionByName(apart.join(sizes, "cell").select("cell", "hold", "size").mapInArrow(_spread, _MEMBER))
    # each set leaves out its commonest cells
    rank = F.dense_rank().over(Window.partitionBy("node", F.col("info") % 2).orderBy(F.desc("both"), F.desc("cell")))
    kept = members.withColumn("r", rank).where("r > shiftright(info, 1)")
    kept = written(kept.select("cell", "node", F.expr("both & 4294967295").alias("n"), F.shiftright("both", 32).alias("size")), "ngram-kept")
    common = kept.where(F.col("size") > small)
    sized = attach(common, common.groupBy("cell").agg(F.count(F.lit(1)).alias("members")), "cell", "members", common.count())
    sized = written(sized, "ngram-common")
    few = kept.where(F.col("size") <= small).select("cell", "node", "n").unionByName(sized.where(F.col("members") <= small).select("cell", "node", "n"))
    leaf = few.groupBy("cell").agg(F.sort_array(F.collect_set(F.struct("node", "n"))).alias("m")).where("size(m) > 1")
    pairs = leaf.select("m", F.posexplode("m").alias("i", "x")).select("x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))
    near = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    pairs = pairs.where(near).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    check = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    edges = written(check.mapInArrow(tk.returning(_possible(num, den)), "a long, b long"), "ngram-edges")  # so that its workers do not run beside the next ones
    many = sized.where(F.col("members") > small).select(F.col("cell").alias("comp"), "node", "members", F.col("members").alias("weight")).distinct()
    if not many.isEmpty():
        signed = many.join(nodes.select("node", "n", "bits"), "node")
        edges = edges.unionByName(_grouped_links(signed, ["n", "bits"], _join(num, den, _by_signatures), cell_block, "ngram-cells"))
    return edges


def classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, small: int = SMALL, cell_block: int = CELL_BLOCK) -> DataFrame:
    """doc_id, n, node (equal for equal sets, 0 for the empty one), component_id, keep; one row per row of `docs`.

    keep: the row is its component's: of its smallest doc_id (null after others), and of that id's least node.
    """
    spark = docs.sparkSession
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    scan = written(picked.mapInArrow(tk.returning(_scan(num, den, k, buckets, small)), _SCHEMA), "ngram-scan")
    rows = scan.where("kind = 0").select("doc_id", "n", "node", "bits")
    nodes = written(rows.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.min("n").alias("n"), F.count(F.lit(1)).alias("group_size"), F.first("bits").alias("bits")), "ngram-nodes")
    cand = written(components(_candidates(scan, nodes, num, den, small, cell_block)).withColumnRenamed("label", "comp"), "ngram-candidates")
    # one text of each candidate node, found by a second scan through a filter of bounded size
    member = written(cand.join(nodes, "node").select("node", "comp", "n"), "ngram-members")
    weigh = written(member.groupBy("comp").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("members")), "ngram-weights")
    texts = written(attach(_texts(picked, rows.drop("bits"), member, k), weigh, "comp", "members", member.count()), "ngram-texts")
    label = components(_grouped_links(texts, ["text"], _join(num, den, _by_sets(k)), block, "ngram"))
    member_of = nodes.drop("bits").join(label, "node", "left").select("node", "low", "group_size", F.coalesce("label", "node").alias("label"))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "node"))
    lowest = member_of.groupBy("label").agg(first.alias("first"), F.count(F.lit(1)).alias("members"))
    full = attach(member_of, lowest, "label", "members", nodes.count())
    full = written(full.select("node", "group_size", F.col("first.low").alias("component_id"), F.col("first.node").alias("of")), "ngram-components")
    out = attach(rows.where("node <> 0").drop("bits"), full, "node", "group_size", rows.count())
    alone = rows.where("node = 0").select("doc_id", "n", "node", F.col("doc_id").alias("component_id"), F.lit(True).alias("keep"))
    keep = (F.col("node") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    return out.select("doc_id", "n", "node", "component_id", keep.alias("keep")).unionByName(alone)


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, **more) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per row of `docs`. `more`: as for `classes`."""
    return classes(docs, k, num, den, **more).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _named(k: int):
    """node, text: the texts with the digests of their sets, each digest once in a while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(0)):
                nodes, fresh = [set_digest(s) for s in shingle_sets(data, offsets, k)], []
                for i, node in enumerate(nodes):
                    if node and node not in seen:
                        if len(seen) > 2_000_000:
                            seen.clear()
                        seen.add(node)
                        fresh.append(i)
                if fresh:
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in fresh], pa.int64()), batch.column(0).slice(a, b - a).take(pa.array(fresh))], ["node", "text"])

    return run


def _texts(picked: DataFrame, rows: DataFrame, member: DataFrame, k: int) -> DataFrame:
    """node, comp, text of one row of each member.

    The filter holds an id of each member, null if it has no other; what passes is told apart by its set, not by its id.
    """
    source = rows.join(member.select("node", "comp"), "node").groupBy("node", "comp").agg(F.min("doc_id").alias("doc_id"))
    source = written(source, "ngram-sources")
    bits = min(1 << 23, max(1 << 12, 1 << (16 * max(1, source.count())).bit_length()))
    slot = f"pmod(xxhash64(doc_id), {bits})"
    marks = source.select(F.expr(f"shiftright({slot}, 6)").alias("word"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    passed = picked.withColumn("word", F.expr(f"shiftright({slot}, 6)")).join(F.broadcast(marks), "word").where(F.expr(f"shiftright(bits, cast({slot} & 63 as int)) & 1L = 1L"))
    named = passed.select("text").mapInArrow(tk.returning(_named(k)), "node long, text string").dropDuplicates(["node"])
    return named.join(source.select("node", "comp"), "node").select("node", "comp", "text")


def _with_node(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """`docs` with __key, the digest of each row's set."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in tk.slices(batch.column(at)):
                node = pa.array([set_digest(s) for s in shingle_sets(data, offsets, k)], pa.int64())
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, node], [*part.schema.names, "__key"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__key", LongType())]))


def representatives(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of `docs` that stay, one of each component, with the columns of `docs`.

    It is that of the smallest doc_id, null after others; of rows that repeat an id with one set, that of the least
    text.  Rows without shingles all stay.
    """
    found = classes(docs, k, num, den, id_col, text_col, **more).select(F.col("doc_id").alias("__id"), F.col("node").alias("__key"), F.col("keep").alias("__keep"))
    return resolved(docs, written(found, "ngram-classes"), id_col, lambda rows: _with_node(rows, text_col, k), F.coalesce(F.col(text_col), F.lit("")), free=0)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i : ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS ss FROM w
), e AS (SELECT doc_id, unnest(ss) AS g FROM s), n AS (SELECT doc_id, len(ss) AS n FROM s),
f AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id WHERE a.g IN (SELECT g FROM f) GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n n1 ON x = n1.doc_id JOIN n n2 ON y = n2.doc_id WHERE 100 * c >= 85 * (n1.n + n2.n - c)),
d AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT d.y, r.root FROM r JOIN d ON r.doc_id = d.x)
SELECT r.doc_id, any_value(n.n)::BIGINT AS n_shingles, min(root) AS component_id FROM r JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""
