"""Unstructured-grid pieces with encoded arrays, and the file that lists them. A part is what one task holds."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Cell types of the format, a fixed value each.
CELL = {"triangle": 5, "quad": 9, "tet": 10, "hex": 12, "prism": 13, "pyramid": 14}
_KINDS = {"f8": "Float64", "i8": "Int64", "u1": "UInt8"}


def packed(x: np.ndarray, compressed: bool) -> str:
    """An array's bytes behind their size, in base 64; compressed as one block, with the sizes before it."""
    data = x.tobytes()
    if not compressed:
        return base64.b64encode(struct.pack("<I", len(data)) + data).decode()
    small = zlib.compress(data)
    return (base64.b64encode(struct.pack("<4I", 1, len(data), len(data), len(small))) + base64.b64encode(small)).decode()


def unpacked(text: str, kind: str, compressed: bool) -> np.ndarray:
    if not compressed:
        return np.frombuffer(base64.b64decode(text)[4:], kind)
    head = struct.unpack("<4I", base64.b64decode(text[:24])[:16])
    body = zlib.decompress(base64.b64decode(text[24:]))
    if len(body) != head[1]:
        raise ValueError("the block has another size than its head says")
    return np.frombuffer(body, kind)


def array(name: str, x: np.ndarray, components: int = 1, compressed: bool = True) -> str:
    kind = _KINDS[x.dtype.str[1:]]
    return f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{components}" format="binary">{packed(x, compressed)}</DataArray>'


def piece(points: np.ndarray, cells: np.ndarray, kind: str, point_data: dict[str, np.ndarray], compressed: bool = True) -> str:
    """One piece: `cells` are rows of places among the points."""
    a = lambda *x: array(*x, compressed=compressed)
    n, size = len(cells), cells.shape[1]
    how = ' compressor="vtkZLibDataCompressor"' if compressed else ""
    return (
        f'<VTKFile type="UnstructuredGrid" byte_order="LittleEndian" header_type="UInt32"{how}><UnstructuredGrid><Piece NumberOfPoints="{len(points)}" NumberOfCells="{n}">'
        f'<Points>{a("coordinates", points.astype("<f8").ravel(), 3)}</Points><Cells>{a("connectivity", cells.astype("<i8").ravel())}'
        f'{a("offsets", np.arange(1, n + 1, dtype="<i8") * size)}{a("types", np.full(n, CELL[kind], "u1"))}</Cells>'
        f'<PointData>{"".join(a(k, v.astype("<f8")) for k, v in point_data.items())}</PointData></Piece></UnstructuredGrid></VTKFile>'
    )


def listing(names: list[str], fields: list[str]) -> str:
    """The parallel file of pieces."""
    data = "".join(f'<PDataArray type="Float64" Name="{f}" NumberOfComponents="1"/>' for f in fields)
    return f'<VTKFile type="PUnstructuredGrid"><PUnstructuredGrid GhostLevel="0"><PPoints><PDataArray type="Float64" Name="coordinates" NumberOfComponents="3"/></PPoints><PPointData>{data}</PPointData>' + "".join(f'<Piece Source="{n}"/>' for n in names) + "</PUnstructuredGrid></VTKFile>"


def parsed(xml: str) -> dict[str, np.ndarray]:
    """The arrays of a piece by name."""
    compressed = "compressor=" in xml
    kinds = {v: k for k, v in _KINDS.items()}
    return {name: unpacked(body, "<" + kinds[kind] if kind != "UInt8" else "u1", compressed) for kind, name, body in re.findall(r'<DataArray type="(\w+)" Name="(\w+)"[^>]*>([^<]*)</DataArray>', xml)}


def pieces(corners: DataFrame, field: str | None = None, compressed: bool = True, per_element: bool = False) -> DataFrame:
    """part, xml from corners (part, elem, pos, vert, x, y, z and the field) of tets; with `per_element` no point is shared."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["elem", "pos"])
        ids = np.arange(len(f)) if per_element else f["vert"].to_numpy()
        names, first, at = np.unique(ids, return_index=True, return_inverse=True)
        pts = f[["x", "y", "z"]].to_numpy()[first]
        data = {field: f[field].to_numpy(float)[first]} if field else {}
        return pd.DataFrame({"part": [key[0]], "xml": [piece(pts, at.reshape(-1, 4), "tet", data, compressed)]})

    return corners.groupBy("part").applyInPandas(run, "part int, xml string")


def read_back(xmls: DataFrame) -> DataFrame:
    """part, points, cells, point_sum, field_sum of pieces that were read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for part, xml in zip(f["part"], f["xml"], strict=True):
                a = parsed(xml)
                extra = [v for k, v in a.items() if k not in ("coordinates", "connectivity", "offsets", "types")]
                x = a["coordinates"].reshape(-1, 3)[a["connectivity"]]
                rows.append((part, len(a["coordinates"]) // 3, len(a["types"]), float(x.sum()), float(sum(v[a["connectivity"]].sum() for v in extra))))
            yield pd.DataFrame(rows, columns=["part", "points", "cells", "point_sum", "field_sum"])

    return xmls.mapInPandas(run, "part int, points long, cells long, point_sum double, field_sum double")
