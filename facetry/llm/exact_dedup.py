"""Exact deduplication by a log-structured merge index, in DataFrame operations only.

Every task is a memtable: it flushes the digests of its rows as one sorted run (a Parquet file whose row groups
carry min/max statistics and a Bloom filter on the digest).  Compaction merges all runs, keeping for each digest
the group's size and its smallest identifier among the longest originals.  Digests with more than one row are hits.
The hits' bits make a filter of bounded size; only texts that pass it are read again and verified byte by byte, by
grouping on the normalised text itself.  Digests under which verification finds several texts are resolved by text.

Defined results: a null text counts as empty; empty texts are equal to each other; `classes` keeps a repeated doc_id
with an equal text in each row that carries the id kept, `deduplicate` in one of them; an id with different texts is
decided row by row; null ids never win against others (a group with null ids only has keep_id null); an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.common import WHITESPACE, attach, resolved, table, written

#: Filter bits for each hit, and the most bits that a filter has (2 MB as broadcast rows).
BITS_PER_HIT, MOST_BITS = 16, 1 << 23
_SHIFT = "18446744073709551616"  # 2^64


def normalised(text: Column) -> Column:
    """Text without the characters of [\\x20\\x09-\\x0D]; null as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITESPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def sha256_digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _best() -> list[Column]:
    """Group size and, packed in a fixed-width buffer, the longest original and the smallest id of that length."""
    rank = F.col("n").cast("decimal(12,0)") * F.lit(_SHIFT).cast("decimal(20,0)") - F.col("doc_id").cast("decimal(20,0)")
    return [F.count(F.lit(1)).alias("group_size"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n"))).alias("top_n"), F.max(rank).alias("top")]


def _keep_id() -> Column:
    return (F.col("top_n").cast("decimal(12,0)") * F.lit(_SHIFT).cast("decimal(20,0)") - F.col("top")).cast("long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_digest) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, digest.

    `digest` may be any function of the normalised text, even one with collisions: results rest on the bytes.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n"))
    # memtables: each task flushes one sorted run with its filters
    runs = written(
        texts.select("doc_id", "n", digest(F.col("norm")).alias("digest"), F.xxhash64("norm").alias("probe")).sortWithinPartitions("digest", "doc_id"),
        "dedup-runs", **{"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.max.bytes": "1048576"},
    )
    # compaction: runs are merged, each task's copies of a digest first
    level1 = written(runs.groupBy("digest").agg(*_best(), F.min("probe").alias("probe"), F.max("probe").alias("probe_b")), "dedup-level1")
    hits = level1.where("group_size > 1")
    sums = level1.agg(F.sum("group_size").alias("rows"), F.sum(F.when(F.col("group_size") > 1, 1)).alias("hits")).first()
    total, n_hits = sums["rows"] or 0, sums["hits"] or 0
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_PER_HIT * n_hits).bit_length()))
    slot = lambda c: F.pmod(c, F.lit(bits))
    # copies have equal probes; a digest with several probes has collided
    probes = hits.where("probe = probe_b").select("probe")
    collided = hits.where("probe <> probe_b").select("digest")
    marks = probes.select(F.shiftright(slot(F.col("probe")), 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(probe, {bits}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    seen = texts.withColumn("probe", F.xxhash64("norm")).withColumn("word", F.shiftright(slot(F.col("probe")), 6))
    passed = seen.join(F.broadcast(marks), "word").where(F.expr(f"shiftright(bits, cast(pmod(probe, {bits}) & 63 as int)) & 1L = 1L"))
    # byte verification: rows under one digest are one group only if their bytes are equal
    named = passed.withColumn("digest", digest(F.col("norm")))
    verified = named.groupBy("digest", "norm").agg(*_best())
    texts_of = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("group_size").alias("group_size"), F.max("top_n").alias("top_n"), F.max("top").alias("top"))
    texts_of = written(texts_of.where("group_size > 1"), "dedup-verified")
    several = written(texts_of.where("texts > 1").select("digest").union(collided).distinct(), "dedup-several")
    found = texts_of if several.isEmpty() else texts_of.join(several, "digest", "left_anti")
    group = attach(runs.select("doc_id", "digest"), found.select("digest", "group_size", "top_n", "top"), "digest", "group_size", total)
    single = F.col("group_size").isNull()
    out = group.select("doc_id", F.when(single, F.col("doc_id")).otherwise(_keep_id()).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "digest")
    if not several.isEmpty():  # texts that collide are resolved by the text itself
        all_of = texts.withColumn("digest", digest(F.col("norm"))).join(several, "digest", "left_semi")
        by_text = all_of.groupBy("digest", "norm").agg(*_best())
        exact = all_of.select("doc_id", "digest", "norm").join(by_text, ["digest", "norm"])
        out = out.join(several, "digest", "left_anti").unionByName(exact.select("doc_id", _keep_id().alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), "digest").select("doc_id", "keep_id", "group_size", "digest"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one of each group of equal texts, with the columns of `docs`.

    Of rows that repeat the id and the normalised text, the longest original stays, then the least.
    """
    found = classes(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__key"), F.col("kept").alias("__keep"))
    norm = normalised(F.col(text_col))
    longest = F.struct(-F.char_length(F.coalesce(F.col(text_col), F.lit(""))), F.coalesce(F.col(text_col), F.lit("")))
    return resolved(docs, written(found, "dedup-classes"), id_col, lambda rows: rows.withColumn("__key", sha256_digest(norm)), longest)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
