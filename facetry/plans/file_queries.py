"""Queries that write files and read them back: part files, pieces for viewers, solver blocks, text meshes, models, decks, streams."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.operators import adapt, build, graph, tags
from facetry.plans.box_queries import CTE, FACE, REP
from facetry.plans.catalog import query
from facetry.plans.meshes import PARTS, Tables, box
from facetry.sources import binary, meshfiles, native, solver, text, vtk
from facetry.streaming import incremental


def _corners(b) -> DataFrame:
    """part, elem, pos, vert, x, y, z."""
    return b.down().join(b.elem().select("elem", "part"), "elem").join(b.vertex(), "vert")


def _write(spark, name: str, files: list[tuple[str, bytes]]) -> str:
    """Small files of a fixture, written through the file system of the shared folder. Gives the folder."""
    folder = graph.scratch(spark, name)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    for file, data in files:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(path, file))
        out.write(bytearray(data))
        out.close()
    return folder


def part_files(spark, sf_dir, compressed: bool = False) -> DataFrame:
    """part, content: the box as one binary file for each part."""
    b = box(spark, sf_dir)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["elem", "pos"])
        gid, first, at = np.unique(f["vert"].to_numpy(), return_index=True, return_inverse=True)
        p = binary.of_tets(f[["x", "y", "z"]].to_numpy()[first], at.reshape(-1, 4), gid, PARTS)
        p.fields, p.numberings = [("temperature", 0, 1, "Linear"), ("velocity", 1, 3, "Linear")], [("ids", 1, "Linear")]
        return pd.DataFrame({"part": [key[0]], "content": [binary.encode(p, compressed)]})

    return _corners(b).groupBy("part").applyInPandas(run, "part int, content binary")


def _decoded(files: DataFrame, columns: list[str], kinds: str, rows) -> DataFrame:
    def run(frames):
        for f in frames:
            out = [r for part, data in zip(f["part"], f["content"], strict=True) for r in rows(part, binary.decode(bytes(data)))]
            yield pd.DataFrame(out, columns=columns)

    return files.mapInPandas(run, kinds)


def _stored(spark, sf_dir, compressed: bool = False) -> DataFrame:
    """The part files written as a table by part and read again."""
    path = graph.scratch(spark, "parts")
    native.write({"files": part_files(spark, sf_dir, compressed)}, path)
    return native.read(spark, path, "files")


_COUNTS = f"{FACE.replace(CTE, REP)}"
_PART_COUNTS = f"WITH {_COUNTS}, ed AS (SELECT part, count(DISTINCT key) AS edges FROM edge JOIN elem USING (elem) GROUP BY part), fc AS (SELECT part, count(DISTINCT key) AS triangles FROM face JOIN elem USING (elem) GROUP BY part), vc AS (SELECT part, count(*) AS vertices FROM replica GROUP BY part) SELECT part, vertices, edges, triangles, elems AS tets FROM load JOIN ed USING (part) JOIN fc USING (part) JOIN vc USING (part)"


@query("mesh_part_files", _PART_COUNTS)
def part_file_counts(spark, sf_dir):
    """Entities of each part, from its file."""
    row = lambda part, p: [(part, len(p.points), len(p.down["edge"]), len(p.down["triangle"]), len(p.down["tet"]))]
    return _decoded(_stored(spark, sf_dir), ["part", "vertices", "edges", "triangles", "tets"], "part int, vertices long, edges long, triangles long, tets long", row)


@query("mesh_part_files_compressed", f"WITH {CTE} SELECT part, count(*) AS tets, round(count(*) / (6.0::DOUBLE * any_value(n * n * n)), 9) AS volume FROM elem, dim GROUP BY part")
def part_files_compressed(spark, sf_dir):
    """The volume of each part, from tets that its compressed file gives by faces and edges."""

    def row(part, p):
        t = p.points[binary.tets_of(p)]
        v = np.einsum("ni,ni->n", t[:, 1] - t[:, 0], np.cross(t[:, 2] - t[:, 0], t[:, 3] - t[:, 0])) / 6
        return [(part, len(t), round(float(v.sum()), 9))]

    return _decoded(_stored(spark, sf_dir, True), ["part", "tets", "volume"], "part int, tets long, volume double", row)


@query("mesh_part_files_stitched", f"WITH {REP} SELECT vert, count(*) AS copies, min(part) AS lowest FROM replica GROUP BY vert")
def part_files_stitched(spark, sf_dir):
    """All parts read and stitched by the global ids that vertices carry."""
    rows = lambda part, p: [(part, int(i)) for i in p.tags["gid"]["vertex"][1][:, 0]]
    v = _decoded(_stored(spark, sf_dir), ["part", "vert"], "part int, vert long", rows)
    return v.groupBy("vert").agg(F.count(F.lit(1)).alias("copies"), F.min("part").cast("long").alias("lowest"))


@query("mesh_part_file_one", f"WITH {CTE} SELECT part, count(*) AS tets FROM elem WHERE part = 3 GROUP BY part")
def part_file_one(spark, sf_dir):
    """A single part, read alone by pruning."""
    path = graph.scratch(spark, "parts")
    native.write({"files": part_files(spark, sf_dir)}, path)
    return _decoded(native.read(spark, path, "files", 3), ["part", "tets"], "part long, tets long", lambda part, p: [(part, len(p.down["tet"]))])


@query("mesh_part_file_meta", "SELECT * FROM (VALUES ('field', 'temperature', 1, 'Linear'), ('field', 'velocity', 3, 'Linear'), ('numbering', 'ids', 1, 'Linear')) t(kind, name, components, shape)")
def part_file_meta(spark, sf_dir):
    """The fields and numberings that files list."""
    rows = lambda part, p: [("field", n, k, s) for n, _, k, s in p.fields] + [("numbering", n, k, s) for n, k, s in p.numberings]
    return _decoded(_stored(spark, sf_dir), ["kind", "name", "components", "shape"], "kind string, name string, components int, shape string", rows).distinct()


@query("mesh_part_paths", "SELECT * FROM (VALUES (0, 'm/0.smb', 'm/0/0.smb'), (2047, 'm/2047.smb', 'm/0/2047.smb'), (5000, 'm/5000.smb', 'm/2/5000.smb')) t(part, few, many)")
def part_paths(spark, sf_dir):
    """Where part files lie, in one folder or in folders of 2048."""
    p = spark.createDataFrame([(0,), (2047,), (5000,)], "part int")
    return p.select("part", tags.path_of(F.col("part"), "m/", parts=8).alias("few"), tags.path_of(F.col("part"), "m/", parts=6000).alias("many"))


@query("mesh_serial_part", f"WITH {CTE} SELECT 0 AS part, count(*) AS tets, (SELECT count(*) FROM vertex) AS vertices FROM elem")
def serial_part(spark, sf_dir):
    """The whole mesh as one part."""
    b = box(spark, sf_dir)
    e = b.elem().withColumn("part", F.lit(0))
    return e.groupBy("part").agg(F.count(F.lit(1)).alias("tets")).join(F.broadcast(b.vertex().agg(F.count(F.lit(1)).alias("vertices"))), F.lit(True))


# --- pieces for viewers


def _vtk_sql(points: str) -> str:
    return f"WITH {REP} SELECT part, {points} AS points, count(*) // 4 AS cells, round(sum(x + y + z), 6) AS point_sum, round(sum(x * 2), 6) AS field_sum FROM down JOIN elem USING (elem) JOIN vertex USING (vert) GROUP BY part"


def _vtk(spark, sf_dir, **how) -> DataFrame:
    c = _corners(box(spark, sf_dir)).withColumn("u", F.col("x") * 2)
    path = graph.scratch(spark, "pieces")
    vtk.pieces(c, "u", **how).write.parquet(path)
    x = vtk.read_back(spark.read.parquet(path))
    return x.select("part", "points", "cells", F.round("point_sum", 6).alias("point_sum"), F.round("field_sum", 6).alias("field_sum"))


@query("mesh_vtk_compressed", _vtk_sql("count(DISTINCT vert)"))
def vtk_compressed(spark, sf_dir):
    """Pieces with compressed arrays, read back."""
    return _vtk(spark, sf_dir)


@query("mesh_vtk_binary", _vtk_sql("count(DISTINCT vert)"))
def vtk_binary(spark, sf_dir):
    return _vtk(spark, sf_dir, compressed=False)


@query("mesh_vtk_per_element", _vtk_sql("count(*)"))
def vtk_per_element(spark, sf_dir):
    """Pieces in which no element shares a point, for fields that jump between elements."""
    return _vtk(spark, sf_dir, per_element=True)


@query("mesh_vtk_listing", f"SELECT {PARTS} AS pieces, true AS has_field")
def vtk_listing(spark, sf_dir):
    xml = vtk.listing([f"mesh_{k}.vtu" for k in range(PARTS)], ["u"])
    return spark.createDataFrame([(xml.count("<Piece "), 'Name="u"' in xml)], "pieces int, has_field boolean")


@query("mesh_printable_fields", f"WITH {REP}, f AS (SELECT part, vert, vert % 50 <> 0 AS b FROM replica) SELECT 'a' AS field, true AS printable UNION ALL SELECT 'b', bool_and(b) FROM f")
def printable_fields(spark, sf_dir):
    """Fields that have a value on every node of every part."""
    b = box(spark, sf_dir)
    from facetry.operators import replicas

    f = replicas.replicas(_corners(b)).select("part", "vert", F.col("n").alias("a"), F.when(F.col("vert") % 50 != 0, 1).alias("b"))
    row = f.agg(*[F.bool_and(F.col(k).isNotNull()).alias(k) for k in "ab"])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("printable")) for k in "ab"])).alias("r")).select("r.*")


@query("mesh_codecs", "SELECT name, true AS same FROM (VALUES ('base64'), ('ascii85'), ('zlib')) t(name)")
def codecs(spark, sf_dir):
    """Encodings of part names that come back as they were."""
    names = Tables(spark, sf_dir).read("part").select("p_name")

    def run(frames):
        for f in frames:
            raw = [n.encode() for n in f["p_name"]]
            ways = {"base64": (base64.b64encode, base64.b64decode), "ascii85": (base64.a85encode, base64.a85decode), "zlib": (zlib.compress, zlib.decompress)}
            yield pd.DataFrame([(k, all(d(e(x)) == x for x in raw)) for k, (e, d) in ways.items()], columns=["name", "same"])

    return names.mapInPandas(run, "name string, same boolean").groupBy("name").agg(F.bool_and("same").alias("same"))


# --- text meshes


def _msh(spark, sf_dir, version: int) -> str:
    """The box as one text mesh, written by the tasks as lines and gathered by the file's order."""
    b = box(spark, sf_dir)
    v = b.vertex().select(F.lit(1).alias("s"), F.col("vert").alias("k"), F.concat_ws(" ", (F.col("vert") + 1).cast("string"), *[F.col(c).cast("string") for c in "xyz"]).alias("line"))
    c = build.connectivity(b.down()).select("elem", F.transform("verts", lambda x: (x + 1).cast("string")).alias("vs"))
    e = c.select(F.lit(3).alias("s"), F.col("elem").alias("k"), F.concat_ws(" ", (F.col("elem") + 1).cast("string"), F.lit("4 2 9 1"), F.array_join("vs", " ")).alias("line"))
    n, m = (b.n + 1) ** 3, 6 * b.n**3
    heads = spark.createDataFrame([(0, 0, f"$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n{n}"), (2, 0, f"$EndNodes\n$Elements\n{m}"), (4, 0, "$EndElements")], "s int, k long, line string")
    path = graph.scratch(spark, "msh")
    heads.unionByName(v).unionByName(e).coalesce(1).sortWithinPartitions("s", "k").select("line").write.text(path)  # one file by format
    return path


@query("mesh_msh_round_trip", f"WITH {CTE} SELECT (SELECT count(*) FROM vertex) AS nodes, count(*) AS tets, 1.0::DOUBLE AS volume FROM elem")
def msh_round_trip(spark, sf_dir):
    """A text mesh written, read, assembled and measured."""
    rows = meshfiles.msh(spark, f"{_msh(spark, sf_dir, 2)}/*.txt")
    rows = graph.pinned(rows)
    nodes = rows.where("kind = 'node'").select(F.col("id").alias("vert"), "x", "y", "z")
    conn = rows.where("kind = 'elem' and type = 4").select(F.col("id").alias("elem"), F.lit(0).alias("part"), "verts")
    _, down = build.assemble({"tet": conn})
    c = adapt.cells(down, nodes).agg(F.count(F.lit(1)).alias("tets"), F.round(F.sum(adapt.volume()), 9).alias("volume"))
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(c), F.lit(True))


@query("mesh_msh_model", "SELECT * FROM (VALUES (3, 9)) t(dim, tag)")
def msh_model(spark, sf_dir):
    """Model entities from the elements' tags of a text mesh."""
    rows = meshfiles.msh(spark, f"{_msh(spark, sf_dir, 2)}/*.txt")
    dim = F.when(F.col("type") == 15, 0).when(F.col("type") == 1, 1).when(F.col("type").isin(2, 3), 2).otherwise(3)
    return rows.where("kind = 'elem'").select(dim.alias("dim"), "tag").distinct()


@query("mesh_msh_versions", "SELECT * FROM (VALUES (2, 4, 2), (4, 4, 2)) t(major, nodes, elems)")
def msh_versions(spark, sf_dir):
    """A tet with a face in both versions of the text format."""
    two = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n4\n1 0 0 0\n2 1 0 0\n3 0 1 0\n4 0 0 1\n$EndNodes\n$Elements\n2\n1 2 2 7 1 1 2 3\n2 4 2 9 1 1 2 3 4\n$EndElements\n"
    four = "$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes\n1 4 1 4\n3 1 0 4\n1\n2\n3\n4\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n$EndNodes\n$Elements\n2 2 1 2\n2 7 2 1\n1 1 2 3\n3 9 4 1\n2 1 2 3 4\n$EndElements\n"
    folder = _write(spark, "msh", [("a.msh", two.encode()), ("b.msh", four.encode())])
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    v = meshfiles.msh_version(spark, folder).select(name("file").alias("f"), "major")
    rows = meshfiles.msh(spark, folder).select(name("file").alias("f"), "kind")
    n = rows.groupBy("f").agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.count_if(F.col("kind") == "elem").alias("elems"))
    return v.join(n, "f").select("major", "nodes", "elems")


@query("mesh_ugrid_round_trip", "SELECT * FROM (VALUES ('big', 5, 2, 2), ('little', 5, 2, 2)) t(byte_order, nodes, faces, tets)")
def ugrid_round_trip(spark, sf_dir):
    """Two tets and two tagged faces in both byte orders, each loaded by its name's ending."""
    nodes, tris, ids, tets = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]]), np.array([[1, 2, 3], [1, 2, 4]]), np.array([5, 6]), np.array([[1, 2, 3, 4], [2, 3, 4, 5]])
    folder = _write(spark, "ugrid", [("m.b8.ugrid", meshfiles.write_ugrid(nodes, tris, ids, tets)), ("m.lb8.ugrid", meshfiles.write_ugrid(nodes, tris, ids, tets, False))])
    out = None
    for order, file in (("big", "m.b8.ugrid"), ("little", "m.lb8.ugrid")):
        r = solver.load(spark, f"{folder}/{file}").agg(F.count_if(F.col("kind") == "node").alias("nodes"), F.count_if(F.col("type") == 2).alias("faces"), F.count_if(F.col("type") == 4).alias("tets"))
        r = r.select(F.lit(order).alias("byte_order"), "nodes", "faces", "tets")
        out = r if out is None else out.unionByName(r)
    return out


@query("mesh_partition_file", f"WITH {CTE}, p AS (SELECT elem, elem % 5 AS ptn FROM elem) SELECT ptn, count(*) AS elems, round(count(*) / (SELECT count(*) / 5.0::DOUBLE FROM elem), 9) AS share FROM p GROUP BY ptn")
def partition_file(spark, sf_dir):
    """Elements weighed by a partition that a file of one number a line gives."""
    b = box(spark, sf_dir)
    path = graph.scratch(spark, "ptn")
    b.elem().select(F.concat_ws(" ", F.col("elem").cast("string"), (F.col("elem") % 5).cast("string")).alias("line")).write.text(path)
    f = F.split("value", " ")
    p = spark.read.text(path).select(f[0].cast("long").alias("elem"), f[1].cast("long").alias("ptn"))
    w = p.join(b.elem(), "elem").groupBy("ptn").agg(F.sum("weight").alias("elems"))
    return w.join(F.broadcast(w.agg(F.avg("elems").alias("a"))), F.lit(True)).select("ptn", "elems", F.round(F.col("elems") / F.col("a"), 9).alias("share"))


@query("mesh_vertex_partition_file", f"WITH {REP} SELECT owner AS part, count(*) AS verts FROM owner GROUP BY owner")
def vertex_partition_file(spark, sf_dir):
    """The owner of each vertex, a line each, in order of ids; read again."""
    from facetry.operators import replicas

    b = box(spark, sf_dir)
    own = replicas.owners(replicas.replicas(_corners(b)), replicas.part_loads(b.elem()))
    path = graph.scratch(spark, "vtxptn")
    own.orderBy("vert").select(F.col("owner").cast("string")).write.text(path)
    return spark.read.text(path).groupBy(F.col("value").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("verts"))


@query("mesh_column_files", "SELECT * FROM (VALUES (1, 'tet', 4), (2, 'quadratic tet', 10)) t(elem, kind, nodes)")
def column_files(spark, sf_dir):
    """Elements in columns of six characters, linear and quadratic."""
    line = lambda nodes, kind, ident: "".join(f"{n:6d}" if n else "      " for n in [*nodes, *[0] * (8 - len(nodes))]) + " " * 6 + f"{kind:6d}" + " " * 18 + f"{ident:6d}"
    elems = "\n".join([line([1, 2, 3, 4], 702, 1), line([1, 2, 3, 4, 5, 6, 7, 8], 902, 2), f"{9:6d}{10:6d}"]) + "\n"
    nodes = "\n".join(f"{k} {0.1 * k} {0.2 * k}" for k in range(1, 11)) + "\n"
    folder = _write(spark, "columns", [("m.node", nodes.encode()), ("m.elem", elems.encode())])
    v, e = solver.nodes_and_elements(spark, f"{folder}/m.node", f"{folder}/m.elem")
    used = e.select("elem", "kind", F.explode("verts").alias("vert")).join(v, "vert")
    return used.groupBy("elem", "kind").agg(F.count(F.lit(1)).cast("int").alias("nodes")).withColumn("elem", F.col("elem").cast("int"))


# --- solver blocks


@query("mesh_solver_blocks", f"WITH {CTE} SELECT (SELECT count(*) FROM vertex) AS nodes, 5 AS vars, 7 AS step, round(sum(x), 6) AS total FROM vertex")
def solver_blocks(spark, sf_dir):
    """A solution of five variables in a block, read back with its numbers."""
    b = box(spark, sf_dir)

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("vert")["x"].to_numpy()
        sol = np.stack([x, x + 1, x + 2, x + 3, x + 4], 1)
        data = solver.encode([("number of modes", None, (len(x),)), ("solution", np.asfortranarray(sol).T.astype("<f8").copy(), (len(x), 5, 7))])
        got = solver.decode(data)
        back = solver.values(got, "solution")
        return pd.DataFrame({"nodes": [back.shape[0]], "vars": [back.shape[1]], "step": [got["solution"][1][2]], "total": [float(back[:, 0].sum())]})

    out = b.vertex().withColumn("part", F.floor(F.col("vert") / 1000)).groupBy("part").applyInPandas(run, "nodes long, vars int, step int, total double")
    return out.agg(F.sum("nodes").alias("nodes"), F.max("vars").alias("vars"), F.max("step").alias("step"), F.round(F.sum("total"), 6).alias("total"))


@query("mesh_restart_fields", f"WITH {CTE} SELECT vert, round(x + 2, 9) AS v2 FROM vertex")
def restart_fields(spark, sf_dir):
    """A block's array attached to nodes by their place."""
    b = box(spark, sf_dir)
    rows = b.vertex().withColumn("part", F.floor(F.col("vert") / 500))

    def encode(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = f.sort_values("vert")["x"].to_numpy()
        sol = np.stack([x, x + 1, x + 2], 0).astype("<f8")
        return pd.DataFrame({"part": [key[0]], "content": [solver.encode([("solution", sol, (len(x), 3, 1))])]})

    path = graph.scratch(spark, "restart")
    rows.groupBy("part").applyInPandas(encode, "part long, content binary").write.parquet(path)

    def decode(frames):
        for f in frames:
            for part, data in zip(f["part"], f["content"], strict=True):
                v = solver.values(solver.decode(bytes(data)), "solution")
                yield pd.DataFrame({"vert": part * 500 + np.arange(len(v)), "v2": np.round(v[:, 2], 9)})

    return spark.read.parquet(path).mapInPandas(decode, "vert long, v2 double")


@query("mesh_hand_off", f"WITH {CTE} SELECT count(*) AS elems, 8 * count(*) AS finer FROM elem")
def hand_off(spark, sf_dir):
    """A mesh handed from one pass to the next as a view, refined there."""
    b = box(spark, sf_dir)
    adapt.cells(b.down(), b.vertex()).createOrReplaceTempView("facetry_pass")
    from facetry.operators import recovery

    given = spark.table("facetry_pass")
    return given.agg(F.count(F.lit(1)).alias("elems")).join(F.broadcast(recovery.refined(given).agg(F.count(F.lit(1)).alias("finer"))), F.lit(True))


# --- models and decks

_CUBE_V = [(100 + i, float(i & 1), float(i >> 1 & 1), float(i >> 2)) for i in range(8)]
_CUBE_E = [(200 + k, 100 + a, 100 + b) for k, (a, b) in enumerate((a, a | 1 << d) for a in range(8) for d in range(3) if not a >> d & 1)]


def _cube() -> str:
    """A cube's model: eight vertices, twelve edges, six faces, a region."""
    faces = []
    for k, (d, s) in enumerate((d, s) for d in range(3) for s in (0, 1)):
        on = [t for t, a, b in _CUBE_E if (a - 100) >> d & 1 == s and (b - 100) >> d & 1 == s]
        faces.append((300 + k, [[(t, 1) for t in on]]))
    return solver.model_text((1, 6, 12, 8), _CUBE_V, _CUBE_E, faces, [(400, [[(300 + k, 1) for k in range(6)]])])


@query("mesh_model_file", "SELECT * FROM (VALUES (0, 8, 0), (1, 12, 24), (2, 6, 24), (3, 1, 6)) t(dim, entities, uses)")
def model_file(spark, sf_dir):
    """A cube's model written as text and read."""
    folder = _write(spark, "model", [("cube.dmg", _cube().encode())])
    ents, uses = solver.load(spark, f"{folder}/cube.dmg")
    e, u = ents.groupBy("dim").agg(F.count(F.lit(1)).cast("int").alias("entities")), uses.groupBy("dim").agg(F.count(F.lit(1)).cast("int").alias("uses"))
    return e.join(u, "dim", "left").select("dim", "entities", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("mesh_model_lookup", "SELECT * FROM (VALUES (0, 103, true), (2, 305, true), (2, 900, false), (3, 400, true)) t(dim, tag, found)")
def model_lookup(spark, sf_dir):
    """Entities by dimension and tag."""
    ents, _ = solver.load(spark, _write(spark, "model", [("cube.dmg", _cube().encode())]) + "/cube.dmg")
    want = spark.createDataFrame([(0, 103), (2, 305), (2, 900), (3, 400)], "dim int, tag int")
    return want.join(ents.withColumn("found", F.lit(True)), ["dim", "tag"], "left").select("dim", "tag", F.coalesce("found", F.lit(False)).alias("found"))


@query("mesh_model_path", "SELECT * FROM (VALUES (3, 400), (2, 300), (1, 201), (0, 100)) t(dim, tag)")
def model_path(spark, sf_dir):
    """A path down from the region to a vertex, through the lowest entity of each boundary."""
    _, uses = solver.load(spark, _write(spark, "model", [("cube.dmg", _cube().encode())]) + "/cube.dmg")
    uses = graph.pinned(uses.groupBy("dim", "tag", "use_dim").agg(F.min("use_tag").alias("use_tag")))
    now = spark.createDataFrame([(3, 400)], "dim int, tag int")
    out = now
    for _ in range(3):
        now = now.join(uses, ["dim", "tag"]).select(F.col("use_dim").alias("dim"), F.col("use_tag").alias("tag"))
        out = out.unionByName(now)
    return out


@query("mesh_model_upward_closure", "SELECT * FROM (VALUES (100, 3), (103, 3), (107, 3)) t(vert, faces)")
def model_upward_closure(spark, sf_dir):
    """The model faces whose closure holds a vertex."""
    _, uses = solver.load(spark, _write(spark, "model", [("cube.dmg", _cube().encode())]) + "/cube.dmg")
    e = uses.where("dim = 1").select(F.col("tag").alias("edge"), F.col("use_tag").alias("vert"))
    f = uses.where("dim = 2").select(F.col("tag").alias("face"), F.col("use_tag").alias("edge"))
    return e.join(f, "edge").where(F.col("vert").isin(100, 103, 107)).groupBy("vert").agg(F.count_distinct("face").cast("int").alias("faces"))


@query("mesh_null_model", "SELECT * FROM (VALUES (0, 5, 'made'), (2, 300, 'known'), (3, 1, 'made')) t(dim, tag, state)")
def null_model(spark, sf_dir):
    """A model that makes what is looked up and not there."""
    known = spark.createDataFrame([(2, 300, "known")], "dim int, tag int, state string")
    want = spark.createDataFrame([(0, 5), (2, 300), (3, 1)], "dim int, tag int")
    return want.join(known, ["dim", "tag"], "left").select("dim", "tag", F.coalesce("state", F.lit("made")).alias("state"))


@query("mesh_analytic_model", f"WITH {CTE} SELECT vert, round(cos(2 * pi() * x), 9) + 0.0 AS px, round(sin(2 * pi() * x), 9) + 0.0 AS py, round(sqrt(1.0::DOUBLE), 9) AS radius FROM vertex")
def analytic_model(spark, sf_dir):
    """Points of a cylinder from their parameters, its period one along the first."""
    u = F.col("x") * (2 * 3.141592653589793)
    v = box(spark, sf_dir).vertex()
    return v.select("vert", (F.round(F.cos(u), 9) + 0.0).alias("px"), (F.round(F.sin(u), 9) + 0.0).alias("py"), F.round(F.sqrt(F.cos(u) ** 2 + F.sin(u) ** 2), 9).alias("radius"))


@query("mesh_closest_on_model", f"WITH {CTE} SELECT vert, round((x + 1) / sqrt((x + 1) * (x + 1) + y * y), 9) AS cx, round(y / sqrt((x + 1) * (x + 1) + y * y), 9) AS cy, round(abs(sqrt((x + 1) * (x + 1) + y * y) - 1), 9) AS distance FROM vertex")
def closest_on_model(spark, sf_dir):
    """The nearest point of a unit cylinder, which is also its normal there."""
    x, y = F.col("x") + 1, F.col("y")
    r = F.sqrt(x * x + y * y)
    return box(spark, sf_dir).vertex().select("vert", F.round(x / r, 9).alias("cx"), F.round(y / r, 9).alias("cy"), F.round(F.abs(r - 1), 9).alias("distance"))


@query("mesh_point_in_region", f"WITH {CTE} SELECT vert, (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) <= 0.16 AS inside FROM vertex")
def point_in_region(spark, sf_dir):
    d = (F.col("x") - 0.5) * (F.col("x") - 0.5) + (F.col("y") - 0.5) * (F.col("y") - 0.5)
    return box(spark, sf_dir).vertex().select("vert", (d <= 0.16).alias("inside"))


@query("mesh_reparametrised", f"WITH {CTE} SELECT vert, round(x, 9) AS on_edge, round(x * 2 - 1, 9) AS on_face FROM vertex WHERE y = 0 AND z = 0")
def reparametrised(spark, sf_dir):
    """An edge's parameter as one of the face beside it, whose range is -1 to 1."""
    return box(spark, sf_dir).vertex().where("y = 0 and z = 0").select("vert", F.round("x", 9).alias("on_edge"), F.round(F.col("x") * 2 - 1, 9).alias("on_face"))


@query("mesh_model_periods", "SELECT * FROM (VALUES (1, 0, true, 0.0::DOUBLE, 1.0::DOUBLE), (1, 1, false, 0.0, 2.0)) t(face, axis, periodic, lo, hi)")
def model_periods(spark, sf_dir):
    """The range of each parameter of a cylinder's side and whether it closes: its ends give the same point."""
    at = lambda u, v: (np.cos(2 * np.pi * u), np.sin(2 * np.pi * u), v)
    rows = [(1, 0, bool(np.allclose(at(0, 0.3), at(1, 0.3))), 0.0, 1.0), (1, 1, bool(np.allclose(at(0.3, 0), at(0.3, 2))), 0.0, 2.0)]
    return spark.createDataFrame(rows, "face int, axis int, periodic boolean, lo double, hi double")


@query("mesh_condition_deck", "SELECT * FROM (VALUES ('initial velocity', 4, 3, '1.5,0.0,-2.0'), ('surface id', 7, 2, '3.0')) t(name, tag, dim, vals)")
def condition_deck(spark, sf_dir):
    """Boundary conditions from text."""
    folder = _write(spark, "deck", [("bc.spj", b"# comment\ninitial velocity: 4 3 1.5 0 -2\n\nsurface id: 7 2 3\n")])
    return solver.load(spark, f"{folder}/bc.spj").select("name", "tag", "dim", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("vals"))


@query("mesh_input_deck", "SELECT * FROM (VALUES ('timeStepNumber', '50', 'int', false), ('rbParamData', '2', 'int', true), ('adaptFlag', '0', 'int', false)) t(key, value, kind, by_default)")
def input_deck(spark, sf_dir):
    """Keys and values with types and defaults; a key that is not known is left out."""
    folder = _write(spark, "deck", [("adapt.inp", b"# deck\ntimeStepNumber   50 # now\nadaptFlag 0\nunheardOf 3\n")])
    rules = spark.createDataFrame([("timeStepNumber", "0", "int"), ("rbParamData", "2", "int"), ("adaptFlag", "1", "int")], "key string, dflt string, kind string")
    d = solver.load(spark, f"{folder}/adapt.inp")
    return rules.join(d, "key", "left").select("key", F.coalesce("value", "dflt").alias("value"), "kind", F.col("value").isNull().alias("by_default"))


@query("mesh_bubble_deck", "SELECT * FROM (VALUES (1, 0.5::DOUBLE), (2, 0.25)) t(id, radius)")
def bubble_deck(spark, sf_dir):
    folder = _write(spark, "deck", [("b.txt", b"1 0 0 0 0.5\n 2 1 1 1 .25\n")])
    return text.bubbles(spark, f"{folder}/b.txt").select("id", "radius")


@query("mesh_loader_registry", "SELECT * FROM (VALUES ('.dmg'), ('.inp'), ('.lb8.ugrid'), ('.msh'), ('.spj'), ('.ugrid')) t(ending)")
def loader_registry(spark, sf_dir):
    return spark.createDataFrame([(e,) for e in solver.LOADERS], "ending string")


# --- the engine's own format, exchange, streams


@query("mesh_native_round_trip", f"WITH {CTE} SELECT part, count(*) AS elems FROM elem GROUP BY part")
def native_round_trip(spark, sf_dir):
    b = box(spark, sf_dir)
    path = graph.scratch(spark, "native")
    native.write({"elem": b.elem(), "vertex": b.vertex()}, path)
    return native.read(spark, path, "elem").groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_resplit", f"WITH {CTE} SELECT count(*) AS elems, 16::BIGINT AS parts FROM elem")
def resplit(spark, sf_dir):
    """Parts loaded and each split in two."""
    return native.split(box(spark, sf_dir).elem(), 2).agg(F.count(F.lit(1)).alias("elems"), F.count_distinct("part").alias("parts"))


@query("mesh_exchange", f"WITH {CTE} SELECT elem, array_to_string(list(vert ORDER BY pos), ',') AS verts, any_value(part) AS owner FROM down JOIN elem USING (elem) GROUP BY elem")
def exchange(spark, sf_dir):
    """Connectivity, classification and owners for other libraries, as Parquet, and back."""
    b = box(spark, sf_dir)
    path = graph.scratch(spark, "exchange")
    build.connectivity(b.down()).join(b.elem().select("elem", F.col("part").cast("long").alias("owner")), "elem").write.parquet(path)
    return spark.read.parquet(path).select("elem", F.array_join("verts", ",").alias("verts"), "owner")


@query("mesh_bulk_field", f"WITH {CTE} SELECT vert, (vert * 3 + 1)::BIGINT AS value FROM vertex")
def bulk_field(spark, sf_dir):
    """A field of another library, with ids from 1, copied to vertices by id."""
    b = box(spark, sf_dir)
    theirs = b.vertex().select((F.col("vert") + 1).alias("id"), (F.col("vert") * 3 + 1).alias("value"))
    return b.vertex().select("vert").join(theirs.select((F.col("id") - 1).alias("vert"), "value"), "vert")


@query("mesh_print", "WITH t AS (SELECT p_partkey AS vert, p_size AS class FROM part) SELECT vert, 'vertex ' || vert || ' class ' || class AS line FROM t")
def print_mesh(spark, sf_dir):
    """Vertices as lines of text in order of ids."""
    return Tables(spark, sf_dir).vert().select("vert", F.format_string("vertex %d class %d", "vert", F.col("class").cast("long")).alias("line")).orderBy("vert")


@query("mesh_stream_accumulate", f"WITH {Tables.SQL} SELECT vert, count(*) AS copies, CAST(sum(n) AS BIGINT) AS total FROM replica GROUP BY vert")
def stream_accumulate(spark, sf_dir):
    """Copies streamed in files; the running sum after the last one."""
    from facetry.operators import replicas

    src, mark, name = graph.scratch(spark, "stream"), graph.scratch(spark, "mark"), "facetry_accumulate"
    replicas.replicas(Tables(spark, sf_dir).incidence()).select("vert", "n").repartition(4).write.parquet(src)
    stream = spark.readStream.schema("vert long, n long").option("maxFilesPerTrigger", 2).parquet(src)
    q = incremental.running_accumulate(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select("vert", "copies", "total")


@query("mesh_stream_windows", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, event_type AS part, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Events counted by hour and kind with the plan that streams use."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("part"))
    w = incremental.windowed_load(e, "ts", "part")
    return w.select(F.unix_seconds(F.col("window.start")).alias("hour"), "part", "n")
