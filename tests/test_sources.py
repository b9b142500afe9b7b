"""Readers and writers: round trips and odd lines."""

import xml.etree.ElementTree as ET

import numpy as np
from pyspark.sql import functions as F

from facetry.plans.meshes import Box
from facetry.sources import meshfiles, native, text
from facetry.streaming import incremental

MSH2 = "$MeshFormat\n2.2 0 8\n$EndMeshFormat\n$Nodes\n4\n1 0 0 0\n2 1 0 0\n3 0 1 0\n4 0 0 1\n$EndNodes\n$Elements\n2\n1 2 2 7 1 1 2 3\n2 4 2 9 1 1 2 3 4\n$EndElements\n"
MSH4 = "$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes\n1 4 1 4\n3 1 0 4\n1\n2\n3\n4\n0 0 0\n1 0 0\n0 1 0\n0 0 1\n$EndNodes\n$Elements\n2 2 1 2\n2 7 2 1\n1 1 2 3\n3 9 4 1\n2 1 2 3 4\n$EndElements\n"


def test_msh(spark, tmp_path):
    for name, body, major in (("a.msh", MSH2, 2), ("b.msh", MSH4, 4)):
        (tmp_path / name).write_text(body)
        rows = meshfiles.msh(spark, str(tmp_path / name)).collect()
        assert {(r.id, r.x, r.y, r.z) for r in rows if r.kind == "node"} == {(1, 0, 0, 0), (2, 1, 0, 0), (3, 0, 1, 0), (4, 0, 0, 1)}
        assert {(r.id, r.type, r.tag, tuple(r.verts)) for r in rows if r.kind == "elem"} == {(1, 2, 7, (1, 2, 3)), (2, 4, 9, (1, 2, 3, 4))}
        assert meshfiles.msh_version(spark, str(tmp_path / name)).first().major == major


def test_ugrid(spark, tmp_path):
    nodes, tris, tags, tets = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.5]]), np.array([[1, 2, 3], [1, 2, 4]]), np.array([5, 6]), np.array([[1, 2, 3, 4]])
    for big in (True, False):
        (tmp_path / f"{big}.ugrid").write_bytes(meshfiles.write_ugrid(nodes, tris, tags, tets, big))
        rows = meshfiles.ugrid(spark, str(tmp_path / f"{big}.ugrid"), big).collect()
        assert [(r.x, r.y, r.z) for r in sorted((r for r in rows if r.kind == "node"), key=lambda r: r.id)] == [tuple(n) for n in nodes.tolist()]
        assert {(r.type, r.tag, tuple(r.verts)) for r in rows if r.kind == "elem"} == {(2, 5, (1, 2, 3)), (2, 6, (1, 2, 4)), (4, None, (1, 2, 3, 4))}


def test_model_and_text(spark, tmp_path):
    (tmp_path / "m.dmg").write_text("1 1 2 2\n0 0 0\n1 1 1\n10 0 0 0\n11 1 0 0\n20 10 11\n21 11 99\n30 1\n2\n20 1\n21 0\n40 1\n1\n30 1\n")
    ents, uses = meshfiles.model(spark, str(tmp_path / "m.dmg"))
    assert {tuple(r) for r in ents.collect()} == {(0, 10), (0, 11), (1, 20), (1, 21), (2, 30), (3, 40)}
    assert {tuple(r) for r in uses.collect()} == {(1, 20, 0, 0, 10), (1, 20, 0, 0, 11), (1, 21, 0, 0, 11), (2, 30, 0, 1, 20), (2, 30, 0, 1, 21), (3, 40, 0, 2, 30)}
    (tmp_path / "bc.spj").write_text("# comment\ninitial velocity: 4 3 1.5 0 -2\n\nsurface id: 7 2 x\n")
    assert {(r.name, r.tag, r.dim, tuple(r["values"])) for r in text.boundary_conditions(spark, str(tmp_path / "bc.spj")).collect()} == {("initial velocity", 4, 3, (1.5, 0.0, -2.0)), ("surface id", 7, 2, (None,))}
    (tmp_path / "b.inp").write_text("1 0 0 0 0.5\n 2 1 1 1 .25\nbad\n")
    assert {r.id: r.radius for r in text.bubbles(spark, str(tmp_path / "b.inp")).collect()} == {1: 0.5, 2: 0.25, None: None}
    (tmp_path / "adapt.inp").write_text("# deck\nsolutionMigration 1 # on\ntimeStepNumber   50\n")
    assert {r.key: r.value for r in text.deck(spark, str(tmp_path / "adapt.inp")).collect()} == {"solutionMigration": "1", "timeStepNumber": "50"}


def test_native_and_vtk(spark, tmp_path):
    b = Box(spark, 2)
    native.write({"elem": b.elem(), "vertex": b.vertex()}, str(tmp_path / "mesh"))
    assert native.read(spark, str(tmp_path / "mesh"), "elem").count() == 48 and native.read(spark, str(tmp_path / "mesh"), "elem", 3).count() == 6
    assert native.split(b.elem(), 2).select("part").distinct().count() == 16
    pieces = native.vtk_pieces(b.vertex(), b.down(), b.elem()).collect()
    cells = 0
    for r in pieces:
        piece = ET.fromstring(r.xml).find("./UnstructuredGrid/Piece")
        n, m = int(piece.get("NumberOfPoints")), int(piece.get("NumberOfCells"))
        conn = list(map(int, piece.find("./Cells/DataArray[@Name='connectivity']").text.split()))
        assert len(conn) == 4 * m and set(conn) == set(range(n)) and len(piece.find("./Points/DataArray").text.split()) == 3 * n
        cells += m
    assert len(pieces) == 8 and cells == 48


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(v, v + k) for v in range(4)], "vert long, n long").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("vert long, n long").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = incremental.running_accumulate(stream).writeStream.outputMode("complete").format("memory").queryName("acc").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.vert, r.total, r.copies) for r in spark.table("acc").collect()} == {(v, 3 * v + 3, 3) for v in range(4)}
    rows = spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 1), ("2024-01-01 01:10:00", 2)], "ts string, part int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in incremental.windowed_load(rows, "ts", "part").collect()) == [1, 2]
