"""Line-oriented inputs as plain text scans: boundary-condition decks, bubble lists, key/value decks. Bad lines are null rows, never lost jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def boundary_conditions(spark: SparkSession, path: str) -> DataFrame:
    """name, tag, dim, values from lines `name: tag dim v1 .. vn`; lines that begin with # and empty ones are skipped."""
    line = F.col("value")
    rest = F.split(F.trim(F.regexp_extract(line, r"^[^:]*:(.*)$", 1)), r"\s+")
    return (
        spark.read.text(path).where(~line.startswith("#") & (F.length(F.trim(line)) > 0))
        .select(F.trim(F.split(line, ":")[0]).alias("name"), F.try_element_at(rest, F.lit(1)).try_cast("int").alias("tag"), F.try_element_at(rest, F.lit(2)).try_cast("int").alias("dim"),
                F.transform(F.slice(rest, 3, F.greatest(F.size(rest) - 2, F.lit(0))), lambda v: v.try_cast("double")).alias("values"))
    )


def bubbles(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z, radius from lines of five numbers."""
    f = F.split(F.trim("value"), r"\s+")
    cols = [("id", "int"), ("x", "double"), ("y", "double"), ("z", "double"), ("radius", "double")]
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(*[F.try_element_at(f, F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(cols)])


def deck(spark: SparkSession, path: str) -> DataFrame:
    """key, value of lines `key value`, without comments; of a repeated key each line stays."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(line.alias("l")).where(F.length("l") > 0).select(F.regexp_extract("l", r"^(\S+)", 1).alias("key"), F.trim(F.regexp_replace("l", r"^\S+", "")).alias("value"))
