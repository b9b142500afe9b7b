"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source's target in words is its weight's share of the mix, capped at a multiple of its own size, the excess
being shared again.  A source's whole number of copies is certain for every document; the fraction left is a sample
of fixed size in words: documents are ranked by random odds divided by inclusion odds (Pareto order sampling) and
taken in that order up to the words still needed.  Then two refill rounds take, in the same order, documents that
fit into what is left.  Inclusion odds fall with a document's length (to the power of a quarter), so that a few
very long documents do not carry a source's quota.

The cut in a ranking is found by a radix descent: word sums per (source, bucket) over 4096 buckets of a 32nd octave
each, then 4096 within the one bucket that holds the cut, then its few rows.  So no task sees a whole source, and what
decides a row is a handful of numbers of its source.

Defined results: a null or blank text has size 0 and is never taken (taken 0); a null source is a source of its
own, last in order; rows with a null doc_id are ranked by a hash of their text; ties of rank (repeated ids, or null
ids with one text) are taken together or not at all; an empty table gives no rows; further columns are ignored, and
`mix` keeps them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from facetry.llm.common import attach, table, uniform, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST_COPIES, REFILLS, SEED = 1.5, 2, 2, 17
#: Sources up to this many are broadcast as a table of a few numbers each; of more, those that hold many rows.
MOST_BROADCAST_SOURCES = 20_000
_RADIX = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame, key: str) -> DataFrame:
    """`sources` with a 0-based global rank by code point, null last: a distributed sort, then offsets of its partitions."""
    flat = written(sources.orderBy(F.col(key).asc_nulls_last()).withColumn("__part", F.spark_partition_id()), "mix-sources")
    counts = flat.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(F.col(key).asc_nulls_last())) - 1
    return flat.withColumn("__inside", inside).join(before, "__part").withColumn("rank", F.col("__before") + F.col("__inside")).drop("__part", "__before", "__inside")


def targets(sources: DataFrame, share: float = SHARE, most: int = MOST_COPIES, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """`sources` (source, source_size, n_docs) with weight and target, by sharing the excess again until no target is above its cap."""
    by_rank = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    s = written(ranked_sources(sources, "source").withColumn("weight", by_rank), "mix-weights")
    cap, rate, free = F.col("source_size") * most, 0.0, None
    whole = share * float(s.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        over = F.lit(False) if free is None else cap < F.lit(rate) * F.col("weight")
        row = s.agg(F.sum(F.when(over, cap)).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("free")).first()
        now = (whole - float(row["capped"] or 0)) / row["free"] if row["free"] else rate
        if free is not None and (row["free"] == free or not row["free"]):
            break
        rate, free = now, row["free"]
        if not free:
            break
    return s.withColumn("target", F.least(cap.cast("double"), F.lit(rate) * F.col("weight")))


def _order(seed: int) -> Column:
    """Random odds over inclusion odds."""
    mean = F.col("source_size") / F.col("n_docs")
    chance = F.least(F.lit(0.999999), F.greatest(F.lit(1e-9), F.col("fraction") / F.sqrt(F.sqrt(F.col("size") / mean))))
    u = uniform(F.col("mark"), seed)
    return (u / (1 - u)) / (chance / (1 - chance))


def _cell() -> Column:
    """The small bucket of a rank: a 4096th of a 32nd octave of xi, from 2^-64 to 2^64."""
    return F.least(F.lit(_RADIX * _RADIX - 1), F.greatest(F.lit(0), F.floor((F.log2("xi") + 64) * 32 * _RADIX))).cast("long")


def marked(id_col: str, text_col: str) -> list[Column]:
    """mark (what a row's random number comes from) and tie (what settles equal ranks)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.md5(text))).alias("mark"), F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text)).alias("tie")]


def _cuts(rows: DataFrame, need: DataFrame) -> DataFrame:
    """For each source, the last (cell, xi, tie) in order of rank at which the words so far are within `need` (columns source_key, need).

    `rows`: source_key, size, xi, tie.  Gives source_key, cut_cell, cut_xi, cut_id, got; sources that take nothing are absent.
    """
    rows = rows.withColumn("b2", _cell()).withColumn("b1", F.expr(f"b2 div {_RADIX}"))

    def crossing(cells: DataFrame, b: str, base: Column) -> DataFrame:
        # cells: at most _RADIX rows for each source
        cum = base + F.sum("words").over(Window.partitionBy("source_key").orderBy(b))
        return cells.withColumn("cum", cum).where(F.col("cum") > F.col("need")).groupBy("source_key", "need").agg(F.min_by(F.struct(F.col(b), (F.col("cum") - F.col("words")).alias("base")), F.col(b)).alias("x")).select("source_key", "need", f"x.{b}", "x.base")

    all1 = rows.groupBy("source_key", "b1").agg(F.sum("size").alias("words")).join(need, "source_key")
    at1 = written(crossing(all1, "b1", F.lit(0)), "mix-cut1")
    all2 = rows.join(at1, ["source_key", "b1"]).groupBy("source_key", "need", "base", "b2").agg(F.sum("size").alias("words"))
    at2 = written(crossing(all2, "b2", F.col("base")), "mix-cut2")
    last = rows.join(at2, ["source_key", "b2"])
    cum = F.col("base") + F.sum("size").over(Window.partitionBy("source_key").orderBy("xi", "tie"))
    fit = last.withColumn("cum", cum).where("cum <= need").groupBy("source_key").agg(F.max(F.struct("xi", "tie")).alias("c"), F.max("cum").alias("got"))
    # where the cell's first row is already too much, the cut is before the cell; where no cell crosses, after all
    edge = at2.select("source_key", F.col("b2").alias("v"), F.col("base").alias("edge_got"))
    whole = rows.groupBy("source_key").agg(F.sum("size").alias("words"))
    return written(
        need.join(whole, "source_key").join(fit, "source_key", "left").join(edge, "source_key", "left").select(
            "source_key",
            F.coalesce(F.col("v"), F.lit(2**62)).cast("long").alias("cut_cell"),
            F.coalesce(F.col("c.xi"), F.lit(-1.0)).alias("cut_xi"),
            F.coalesce(F.col("c.tie"), F.lit(0)).cast("long").alias("cut_id"),
            F.when(F.col("v").isNull(), F.col("words")).otherwise(F.coalesce(F.col("got"), F.col("edge_got"))).cast("long").alias("got"),
        ),
        "mix-cuts",
    )


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, refills: int = REFILLS) -> tuple[DataFrame, DataFrame]:
    """(rows, sources): rows has source_key, doc_id, source, size; sources has all numbers that `copies` needs."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), *marked(id_col, text_col))
    rows = written(rows.withColumn("source_key", key), "mix-rows")
    # each task sums a source's rows first, so that a hot source is a row for each task when it is moved
    sums = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    s = targets(sums)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    s = s.withColumn("whole", F.floor(ratio).cast("long")).withColumn("fraction", ratio - F.floor(ratio))
    s = written(s.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    put = _putter(s)
    ready = put(rows.where("size > 0"), s.select("source_key", "source_size", "n_docs", "fraction", "need")).where("fraction > 0").withColumn("xi", _order(seed))
    ready = written(ready.select("source_key", "tie", "size", "xi"), "mix-ready")
    left = ready
    gap = s.select("source_key", "n_docs", F.col("need").alias("gap0"))
    for k in range(refills + 1):
        fits = put(left, gap).where(F.col("size") <= F.col(f"gap{k}")).select("source_key", "tie", "size", "xi") if k else left
        cut = _cuts(fits, gap.select("source_key", F.col(f"gap{k}").alias("need")))
        s = s.join(cut.select("source_key", F.col("cut_cell").alias(f"cell{k}"), F.col("cut_xi").alias(f"xi{k}"), F.col("cut_id").alias(f"id{k}"), F.col("got").alias(f"got{k}")), "source_key", "left")
        s = s.withColumn(f"gap{k}", F.col("need") if k == 0 else F.col(f"gap{k - 1}") - F.coalesce(F.col(f"got{k - 1}"), F.lit(0)))
        s = written(s.withColumn(f"gap{k + 1}", F.col(f"gap{k}") - F.coalesce(F.col(f"got{k}"), F.lit(0))), "mix-plan").drop(f"gap{k + 1}")
        if k < refills:
            gap = s.select("source_key", "n_docs", (F.col(f"gap{k}") - F.coalesce(F.col(f"got{k}"), F.lit(0))).alias(f"gap{k + 1}"), f"cell{k}", f"xi{k}", f"id{k}")
            before = gap.select("source_key", "n_docs", f"cell{k}", f"xi{k}", f"id{k}")
            left = put(left, before).where(~_within(k)).select("source_key", "tie", "size", "xi")
            gap = gap.select("source_key", "n_docs", f"gap{k + 1}")
    return rows, s


def _putter(sources: DataFrame):
    """How rows get the numbers of their source: all sources broadcast, or of very many only those that hold many rows."""
    if sources.count() <= MOST_BROADCAST_SOURCES:
        return lambda rows, s: rows.join(F.broadcast(s), "source_key")
    total = sources.agg(F.sum("n_docs")).first()[0]
    return lambda rows, s: attach(rows, s, "source_key", "n_docs", total)


def _within(k: int) -> Column:
    cell, xi = _cell(), F.col("xi")
    same = (cell == F.col(f"cell{k}")) & ((xi < F.col(f"xi{k}")) | ((xi == F.col(f"xi{k}")) & (F.col("tie") <= F.col(f"id{k}"))))
    return F.coalesce((cell < F.col(f"cell{k}")) | same, F.lit(False))


def copies(rows: DataFrame, sources: DataFrame, seed: int = SEED, refills: int = REFILLS) -> DataFrame:
    """`rows` (source_key, size, mark, tie and others) with source_size, target and copies; decided from the row and its source's numbers alone."""
    x = _putter(sources)(rows, sources.drop("source")).withColumn("xi", F.when((F.col("size") > 0) & (F.col("fraction") > 0), _order(seed)))
    hit = F.lit(False)
    for k in range(refills + 1):
        hit = hit | (_within(k) & (F.col("size") <= F.col(f"gap{k}")))
    extra = F.when(F.col("xi").isNotNull() & hit, 1).otherwise(0)
    return x.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(0).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """`docs`, each row as often as the mix takes it, with the columns of `docs`."""
    _, sources = plan(docs)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("source_key"), n_words(F.col("text")).alias("size"), *marked("doc_id", "text"))
    out = copies(packed, sources)
    return out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = plan(table(spark, sf_dir, "documents"))
    out = copies(rows, sources)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))


def _sql_round(k: int, before: str) -> str:
    gap = "need" if k == 0 else f"gap{k}"
    return f"""
c{k} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY xi, doc_id) AS cum FROM {before} WHERE size <= {gap} OR {k} = 0),
t{k} AS (SELECT doc_id FROM c{k} WHERE cum <= {gap}),
g{k} AS (SELECT source, sum(size) AS got FROM c{k} WHERE cum <= {gap} GROUP BY source),
l{k} AS (SELECT b.* EXCLUDE (gap_now), b.gap_now - coalesce(g.got, 0) AS gap_now, b.gap_now - coalesce(g.got, 0) AS gap{k + 1} FROM {before} b LEFT JOIN g{k} g ON b.source IS NOT DISTINCT FROM g.source WHERE b.doc_id NOT IN (SELECT doc_id FROM t{k})),"""


OP6_SQL = (
    r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s0),
s2 AS (SELECT *, 1.5 * (SELECT sum(source_size) FROM s0)::DOUBLE AS whole, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k FROM s1),
s3 AS (SELECT *, (whole - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM s2),
r AS (SELECT rate FROM s3 WHERE NOT (2 * source_size < rate * w) ORDER BY k LIMIT 1),
s4 AS (SELECT source, source_size, n_docs, least((2 * source_size)::DOUBLE, (SELECT rate FROM r) * w) AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM s4),
s6 AS (SELECT *, floor(ratio)::BIGINT AS whole, ratio - floor(ratio) AS fraction, target - floor(ratio) * source_size AS need FROM s5),
p AS (SELECT d.doc_id, d.source, d.size, s6.need, s6.need AS gap_now, (('0x' || substr(md5('17:' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u,
  least(0.999999::DOUBLE, greatest(1e-9::DOUBLE, s6.fraction / sqrt(sqrt(d.size / (s6.source_size / s6.n_docs))))) AS chance
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source WHERE d.size > 0 AND s6.fraction > 0),
q AS (SELECT doc_id, source, size, need, gap_now, (u / (1 - u)) / (chance / (1 - chance)) AS xi FROM p),"""
    + _sql_round(0, "q") + _sql_round(1, "l0") + _sql_round(2, "l1").rstrip(",")
    + r""",
hit AS (SELECT doc_id FROM t0 UNION ALL SELECT doc_id FROM t1 UNION ALL SELECT doc_id FROM t2)
SELECT d.doc_id, d.size::BIGINT AS size, s6.source_size, s6.target, (d.size * (s6.whole + CASE WHEN d.doc_id IN (SELECT doc_id FROM hit) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
"""
)
