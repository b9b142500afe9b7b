"""Mesh files, one part each, decoded in Arrow batches; a part is what one task holds.

Readers take a path or a pattern and give long tables: node rows (kind 'node') and element rows (kind 'elem').
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, kind string, id long, type int, tag int, verts array<long>, x double, y double, z double"
#: Vertices of the element types of .msh files (fixed values of the format).
MSH_VERTS = {15: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 8, 6: 6, 7: 5, 8: 3, 9: 6, 11: 10}


def _frame(file: str, kind: str, **columns) -> pd.DataFrame:
    n = len(columns["id"])
    base = {"file": [file] * n, "kind": [kind] * n, "type": [None] * n, "tag": [None] * n, "verts": [None] * n, "x": [None] * n, "y": [None] * n, "z": [None] * n}
    return pd.DataFrame(base | columns)[["file", "kind", "id", "type", "tag", "verts", "x", "y", "z"]]


def _decoded(spark: SparkSession, path: str, decode) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                yield from (part for part in decode(name, content) if len(part))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def _sections(lines: list[str]) -> dict[str, list[str]]:
    out, name = {}, None
    for line in lines:
        if line.startswith("$End"):
            name = None
        elif line.startswith("$"):
            name = line[1:].strip()
            out[name] = []
        elif name:
            out[name].append(line)
    return out


def _msh(name: str, content: bytes) -> Iterator[pd.DataFrame]:
    s = _sections(content.decode().splitlines())
    if float(s["MeshFormat"][0].split()[0]) < 4:
        nodes = [r.split() for r in s["Nodes"][1:]]
        elems = []
        for r in s["Elements"][1:]:
            e = list(map(int, r.split()))
            elems.append((e[0], e[1], e[3] if e[2] else 0, e[3 + e[2] :]))
    else:
        nodes, at = [], 1
        for _ in range(int(s["Nodes"][0].split()[0])):
            n = int(s["Nodes"][at].split()[3])
            nodes += [[t.strip(), *x.split()] for t, x in zip(s["Nodes"][at + 1 : at + 1 + n], s["Nodes"][at + 1 + n : at + 1 + 2 * n], strict=True)]
            at += 1 + 2 * n
        elems, at = [], 1
        for _ in range(int(s["Elements"][0].split()[0])):
            _, tag, kind, n = map(int, s["Elements"][at].split())
            for r in s["Elements"][at + 1 : at + 1 + n]:
                e = list(map(int, r.split()))
                elems.append((e[0], kind, tag, e[1:]))
            at += 1 + n
    yield _frame(name, "node", id=[int(r[0]) for r in nodes], x=[float(r[1]) for r in nodes], y=[float(r[2]) for r in nodes], z=[float(r[3]) for r in nodes])
    yield _frame(name, "elem", id=[e[0] for e in elems], type=[e[1] for e in elems], tag=[e[2] for e in elems], verts=[e[3] for e in elems])


def msh(spark: SparkSession, path: str) -> DataFrame:
    """Text .msh files of version 2 or 4."""
    return _decoded(spark, path, _msh)


def msh_version(spark: SparkSession, path: str) -> DataFrame:
    """The major version of each file, from its second line."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_extract("value", r"^\$MeshFormat\s+(\d+)", 1).cast("int").alias("major"))


def _ugrid(order: str):
    def decode(name: str, content: bytes) -> Iterator[pd.DataFrame]:
        head = np.frombuffer(content, f"{order}i4", 7)
        n_node, n_tri, n_quad, *cells = map(int, head)
        at = 28
        xyz = np.frombuffer(content, f"{order}f8", 3 * n_node, at).astype(float).reshape(-1, 3)
        at += 24 * n_node
        yield _frame(name, "node", id=np.arange(1, n_node + 1), x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2])
        faces = []
        for n, size in ((n_tri, 3), (n_quad, 4)):
            faces.append(np.frombuffer(content, f"{order}i4", n * size, at).reshape(-1, size))
            at += 4 * n * size
        tags = np.frombuffer(content, f"{order}i4", n_tri + n_quad, at).astype(int)
        at += 4 * (n_tri + n_quad)
        first = 0
        for f, kind in zip(faces, (2, 3), strict=True):
            yield _frame(name, "elem", id=np.arange(first, first + len(f)), type=[kind] * len(f), tag=tags[first : first + len(f)], verts=[v.tolist() for v in f])
            first += len(f)
        for n, size, kind in zip(cells, (4, 5, 6, 8), (4, 7, 6, 5), strict=True):
            v = np.frombuffer(content, f"{order}i4", n * size, at).reshape(-1, size)
            at += 4 * n * size
            yield _frame(name, "elem", id=np.arange(first, first + n), type=[kind] * n, verts=[r.tolist() for r in v])
            first += n

    return decode


def ugrid(spark: SparkSession, path: str, big_endian: bool = True) -> DataFrame:
    """Binary .b8.ugrid or .lb8.ugrid files: nodes, tagged faces, tets, pyramids, prisms, hexes."""
    return _decoded(spark, path, _ugrid(">" if big_endian else "<"))


def write_ugrid(nodes: np.ndarray, tris: np.ndarray, tags: np.ndarray, tets: np.ndarray, big_endian: bool = True) -> bytes:
    """The bytes of a file of triangles and tets, ids from 1."""
    o = ">" if big_endian else "<"
    head = struct.pack(f"{o}7i", len(nodes), len(tris), 0, len(tets), 0, 0, 0)
    return head + nodes.astype(f"{o}f8").tobytes() + tris.astype(f"{o}i4").tobytes() + tags.astype(f"{o}i4").tobytes() + tets.astype(f"{o}i4").tobytes()


def model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities: dim, tag; boundaries: dim, tag, bdry, use_dim, use_tag) of a topological model file.

    Counts of regions, faces, edges, vertices; the bounding box; vertices with coordinates; edges with two vertices;
    faces by loops and regions by shells, each a count of (tag, direction) pairs. A use of an absent vertex is left out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for text in f["value"]:
                it = iter(text.split())
                take = lambda n, kind=int: [kind(next(it)) for _ in range(n)]  # noqa: E731, B023
                regions, faces, edges, verts = take(4)
                take(6, float)
                rows, known = [], set()
                for _ in range(verts):
                    (tag,) = take(1)
                    take(3, float)
                    known.add(tag)
                    rows.append((0, tag, None, None, None))
                for _ in range(edges):
                    tag, a, b = take(3)
                    rows.append((1, tag, None, None, None))
                    rows += [(1, tag, 0, 0, v) for v in (a, b) if v in known]
                for dim, n in ((2, faces), (3, regions)):
                    for _ in range(n):
                        tag, loops = take(2)
                        rows.append((dim, tag, None, None, None))
                        for k in range(loops):
                            (uses,) = take(1)
                            rows += [(dim, tag, k, dim - 1, take(2)[0]) for _ in range(uses)]
                yield pd.DataFrame(rows, columns=["dim", "tag", "bdry", "use_dim", "use_tag"])

    x = spark.read.text(path, wholetext=True).mapInPandas(run, "dim int, tag int, bdry int, use_dim int, use_tag int")
    return x.where("use_tag is null").select("dim", "tag"), x.where("use_tag is not null")
