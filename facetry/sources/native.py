"""The engine's own format: Parquet tables partitioned by part, with a table of fields beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(tables: dict[str, DataFrame], path: str) -> None:
    """Each table below `path`; those with a column part are laid out by it, so that a part is read alone."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy("part") if "part" in df.columns else w).parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, name: str, part: int | None = None) -> DataFrame:
    """A table, or one part of it by partition pruning."""
    df = spark.read.parquet(f"{path}/{name}")
    return df if part is None else df.where(F.col("part") == part)


def split(df: DataFrame, factor: int, key: str = "elem") -> DataFrame:
    """Every part dealt into `factor` parts by the key."""
    return df.withColumn("part", (F.col("part") * factor + F.pmod(F.xxhash64(key), F.lit(factor))).cast("int"))


def vtk_pieces(vertex: DataFrame, down: DataFrame, elem: DataFrame) -> DataFrame:
    """part, xml: an ASCII unstructured-grid piece of each part of tets (a part is what one task holds)."""
    corner = down.join(elem.select("elem", "part"), "elem").join(vertex, "vert")
    points = corner.select("part", "vert", "x", "y", "z").distinct().groupBy("part").agg(F.array_sort(F.collect_list(F.struct("vert", "x", "y", "z"))).alias("p"))
    cells = corner.groupBy("part", "elem").agg(F.array_sort(F.collect_list(F.struct("pos", "vert"))).alias("v")).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("elem", F.col("v.vert").alias("vs")))).alias("c"))
    join = lambda c, f: F.array_join(F.transform(c, f), "\n")
    both = points.join(cells, "part").withColumn("ids", F.col("p.vert"))
    xyz = join("p", lambda q: F.concat_ws(" ", q["x"].cast("string"), q["y"].cast("string"), q["z"].cast("string")))
    conn = join("c", lambda q: F.array_join(F.transform(q["vs"], lambda v: F.array_position(F.col("ids"), v) - 1), " "))
    offsets = join(F.sequence(F.lit(1), F.size("c")), lambda k: (k * 4).cast("string"))
    kinds = join("c", lambda q: F.lit("10"))
    arr = lambda t, n, extra, body: F.concat(F.lit(f'<DataArray type="{t}" Name="{n}"{extra} format="ascii">\n'), body, F.lit("\n</DataArray>\n"))
    head = F.format_string('<VTKFile type="UnstructuredGrid"><UnstructuredGrid><Piece NumberOfPoints="%d" NumberOfCells="%d">\n', F.size("p"), F.size("c"))
    xml = F.concat(head, F.lit("<Points>\n"), arr("Float64", "xyz", ' NumberOfComponents="3"', xyz), F.lit("</Points>\n<Cells>\n"), arr("Int64", "connectivity", "", conn), arr("Int64", "offsets", "", offsets), arr("UInt8", "types", "", kinds), F.lit("</Cells>\n</Piece></UnstructuredGrid></VTKFile>\n"))
    return both.select("part", xml.alias("xml"))
