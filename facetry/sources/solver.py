"""Solver files: named binary blocks behind one-line heads; text files of nodes and elements in columns; models as text."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The number by which a reader tells the byte order; a fixed value of the format.
MAGIC = 362436
_HEAD = re.compile(rb"^\s*([^:#\n]+?)\s*: <\s*(\d+)\s*>\s*([^\n]*)\n")


def block(name: str, data: np.ndarray | None, *params: int) -> bytes:
    """A head (name, bytes that follow, numbers) and the data with a line's end; without data only the head."""
    body = b"" if data is None else data.tobytes() + b"\n"
    return f"{name} : < {len(body)} > {''.join(f'{p} ' for p in params)}\n".encode() + body


def encode(blocks: list[tuple[str, np.ndarray | None, tuple[int, ...]]]) -> bytes:
    head = block("byteorder magic number", np.array([MAGIC], "<i4"), 1)
    return head + b"".join(block(name, data, *params) for name, data, params in blocks)


def decode(data: bytes) -> dict[str, tuple[bytes, list[int]]]:
    """name -> (bytes, numbers) of all blocks, in either byte order (bytes come as they are, the order under '')."""
    out, at = {}, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"#"):
            at = data.index(b"\n", at) + 1
            continue
        m = _HEAD.match(data[at:])
        if not m:
            raise ValueError(f"no head at byte {at}")
        name, size = m[1].decode(), int(m[2])
        at += m.end()
        out[name] = (data[at : at + max(size - 1, 0)], [int(p) for p in m[3].split()])
        at += size
    magic = out.get("byteorder magic number", (b"", []))[0]
    little = len(magic) < 4 or int(np.frombuffer(magic, "<i4", 1)[0]) == MAGIC
    return out | {"": (b"<" if little else b">", [])}


def values(blocks: dict[str, tuple[bytes, list[int]]], name: str, kind: str = "f8") -> np.ndarray:
    data, params = blocks[name]
    x = np.frombuffer(data, blocks[""][0].decode() + kind)
    return x.reshape(params[1], params[0]).T if len(params) > 1 and params[0] * params[1] == len(x) else x


def nodes_and_elements(spark: SparkSession, node_path: str, elem_path: str) -> tuple[DataFrame, DataFrame]:
    """(vert, x, y, z) and (elem, kind, verts) from a text file of nodes and one of elements in columns of six characters.

    A node line is its id and up to three numbers, missing ones 0. An element line holds eight nodes, the kind in column 9
    and the id in column 13; a quadratic tet (902) has its last two nodes in a line of their own.
    """
    f = F.split(F.trim("value"), r"\s+")
    num = lambda i: F.coalesce(F.try_element_at(f, F.lit(i)).try_cast("double"), F.lit(0.0))
    nodes = spark.read.text(node_path).where(F.length(F.trim("value")) > 0).select(F.try_element_at(f, F.lit(1)).try_cast("long").alias("vert"), num(2).alias("x"), num(3).alias("y"), num(4).alias("z"))
    lines = spark.read.text(elem_path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "value")).where("length(value) > 0")
    col = lambda i: F.trim(F.substring("value", 6 * i + 1, 6)).try_cast("long")
    full = lines.where(F.length("value") >= 84)
    more = lines.where(F.length("value") < 84).select((F.col("line") - 1).alias("line"), F.array(col(0), col(1)).alias("rest"))
    e = full.join(more, "line", "left")
    eight = F.array(*[col(i) for i in range(8)])
    kind = F.when(col(9) == 902, "quadratic tet").when(col(9) == 702, "tet")
    corners = F.when(col(9) == 902, F.concat(eight, F.coalesce("rest", F.array().cast("array<bigint>")))).otherwise(F.slice(eight, 1, 4))
    return nodes, e.select(col(13).alias("elem"), kind.alias("kind"), corners.alias("verts"))


def model_text(counts: tuple[int, int, int, int], vertices: list[tuple[int, float, float, float]], edges: list[tuple[int, int, int]], faces: list[tuple[int, list[list[tuple[int, int]]]]], regions: list[tuple[int, list[list[tuple[int, int]]]]]) -> str:
    """A topological model: counts of regions, faces, edges, vertices; a box; each entity with what bounds it."""
    out = [" ".join(map(str, counts)), "0 0 0", "0 0 0"]
    out += [f"{t} {x} {y} {z}" for t, x, y, z in vertices]
    out += [f"{t} {a} {b}" for t, a, b in edges]
    for group in (faces, regions):
        for t, loops in group:
            out.append(f"{t} {len(loops)}")
            for loop in loops:
                out.append(str(len(loop)))
                out += [f" {u} {d}" for u, d in loop]
    return "\n".join(out) + "\n"


#: Readers by the end of a file's name.
LOADERS: dict[str, Callable] = {}


def loader(ending: str):
    def add(f: Callable) -> Callable:
        LOADERS[ending] = f
        return f

    return add


def load(spark: SparkSession, path: str):
    """Reads a file by the longest registered ending of its name."""
    found = [e for e in LOADERS if path.endswith(e)]
    if not found:
        raise ValueError(f"no reader for {path}")
    return LOADERS[max(found, key=len)](spark, path)


def _register() -> None:
    from facetry.sources import meshfiles, text

    loader(".msh")(meshfiles.msh)
    loader(".ugrid")(meshfiles.ugrid)
    loader(".lb8.ugrid")(lambda spark, path: meshfiles.ugrid(spark, path, False))
    loader(".dmg")(meshfiles.model)
    loader(".spj")(text.boundary_conditions)
    loader(".inp")(text.deck)


_register()
