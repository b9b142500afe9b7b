"""Shared-folder tables and the split of hot keys, used by every operator of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters of [\x20\x09-\x0D].
WHITESPACE = " \t\n\x0b\x0c\r"

#: A key that holds at least 1/HEAVY_SHARE of all rows is heavy, so there are HEAVY_SHARE heavy keys at most.
HEAVY_SHARE = 1 << 14


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """`rows` left-joined to `groups` (one row per `key`, with the group's row count in `size`).

    Groups of at least total/HEAVY_SHARE rows are at most HEAVY_SHARE many, so that side is broadcast and its
    rows never meet in one task; all other keys are joined by a shuffle in which none holds more than that share.
    """
    heavy = groups.where(F.col(size) * HEAVY_SHARE >= F.lit(total)).withColumn("__heavy", F.lit(True))
    light = groups.where(F.col(size) * HEAVY_SHARE < F.lit(total))
    first = rows.join(F.broadcast(heavy), key, "left")
    names = [c for c in first.columns if c != "__heavy"]
    out = first.where(F.col("__heavy")).select(names)
    rest = first.where(F.col("__heavy").isNull()).select(rows.columns).join(light, key, "left").select(names)
    return out.unionByName(rest)


def uniform(key: Column, seed: int) -> Column:
    """A repeatable number in (0, 1) of 52 bits for each key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


#: Bits of a filter for each key, and the most bits that a filter has (2 MB as broadcast rows).
BITS_PER_KEY, MOST_BITS = 16, 1 << 23


def _slot(key: str, bits: int) -> str:
    return f"pmod(xxhash64({key}), {bits})"


def marks(keys: DataFrame, key: str, count: int) -> tuple[DataFrame, int]:
    """(word, bits) rows of a filter over `keys`, at most MOST_BITS/64 of them, and the number of its bits."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_PER_KEY * max(1, count)).bit_length()))
    one = keys.select(F.expr(f"shiftright({_slot(key, bits)}, 6)").alias("__word"), F.expr(f"shiftleft(1L, cast({_slot(key, bits)} & 63 as int))").alias("__bit"))
    return one.groupBy("__word").agg(F.bit_or("__bit").alias("__bits")), bits


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """`rows` whose `key` is not among the keys of `gone` (a column of that name); null keys stay.

    Rows that a broadcast filter of bounded size lets by are kept where they are; only the others are joined by a shuffle.
    """
    gone = written(gone.select(key).distinct(), "gone")
    filt, bits = marks(gone, key, gone.count())
    seen = rows.withColumn("__word", F.expr(f"shiftright({_slot(key, bits)}, 6)")).join(F.broadcast(filt), "__word", "left")
    maybe = F.expr(f"coalesce(shiftright(__bits, cast({_slot(key, bits)} & 63 as int)) & 1L = 1L, false)")
    kept = seen.where(~maybe).select(rows.columns)
    return kept.unionByName(seen.where(maybe).select(rows.columns).join(gone, key, "left_anti").select(rows.columns))


def resolved(docs: DataFrame, decided: DataFrame, id_col: str, key: Callable[[DataFrame], DataFrame], order: Column, free: int | None = None) -> DataFrame:
    """The rows of `docs` that stay. `decided`: __id, __key, __keep for each row of `docs`, a written table.

    An id all of whose rows go is taken out by id.  Where an id is null or has rows of both kinds, or several that stay,
    `key` gives the rows their __key, and of the rows of one id and key that stay the least by `order` (never null) does;
    rows whose key is `free` all stay.
    """
    kind = docs.schema[id_col].dataType
    per = decided.groupBy("__id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__keep").cast("int")).alias("stay"))
    odd = written(per.where("__id is null or stay = 0 or n > 1"), "odd-ids")
    out = without(docs, odd.where("stay = 0 and __id is not null").select(F.col("__id").cast(kind).alias(id_col)), id_col)
    mixed = odd.where("stay > 0 and __id is not null").select(F.col("__id").cast(kind).alias(id_col))
    if odd.where("__id is null or stay > 0").isEmpty():
        return out
    rows = docs.join(mixed, id_col, "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    keyed = written(key(rows.select(docs.columns)), "odd-rows")
    best = keyed.groupBy(F.col(id_col).alias("__id"), "__key").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), order).alias("__row"))
    stay = decided.where("__keep").select(F.col("__id").alias("__i"), F.col("__key").alias("__k")).distinct()
    same = F.coalesce(F.col("__id"), F.lit(0)).eqNullSafe(F.coalesce(F.col("__i"), F.lit(0))) & (F.col("__id").isNull() == F.col("__i").isNull()) & (F.col("__key") == F.col("__k"))
    if free is not None:
        best = best.where(F.col("__key") != F.lit(free))
    chosen = best.join(stay, same, "left_semi").select("__row.*")
    if free is not None:
        chosen = chosen.unionByName(keyed.where(F.col("__key") == F.lit(free)).select(docs.columns))
    certain = out.where(F.col(id_col).isNotNull()).join(mixed, id_col, "left_anti").select(docs.columns)
    return certain.unionByName(chosen)
