"""Connected components of a table of links, by label propagation with pointer jumping.

Labels and links stay distributed; each round is written to the shared folder.  Nodes with a large share of all links
are joined by broadcast (there are few by definition), so a star's centre never gathers its links in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.llm.common import attach, written

#: Links up to which no key can be too large for one task (rows of two numbers).
LIGHT = 2_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars: every node linked to the smallest that the batch connects it to."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        label = np.arange(len(names))
        while True:
            low = np.minimum(label[x], label[y])
            new = label.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            np.minimum.at(new, label[x], low)
            np.minimum.at(new, label[y], low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        on = label != np.arange(len(names))
        yield pa.RecordBatch.from_pydict({"a": names[label[on]], "b": names[on]})


def _joined(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    return rows.join(groups, key, "left") if total <= LIGHT else attach(rows, groups, key, size, total)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable. `edges`: a, b (longs); loops and repeats do no harm."""
    one = edges.where("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(_stars, "a long, b long")  # within tasks first
    both = one.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").distinct()
    both = written(both, "cc-edges")
    total = both.count()
    both = both.coalesce(total // 100_000 + 1) if total <= LIGHT else both
    labels = written(both.groupBy("src").agg(F.count(F.lit(1)).alias("deg"), F.least(F.min("dst"), F.first("src")).alias("label")).withColumnRenamed("src", "node"), "cc-labels")
    while True:
        # every node hears its neighbours' labels
        heard = _joined(both, labels.select(F.col("node").alias("src"), "deg", "label"), "src", "deg", total)
        told = heard.groupBy("dst").agg(F.min("label").alias("heard")).withColumnRenamed("dst", "node")
        new = labels.join(told, "node").select("node", "deg", F.least("label", "heard").alias("label"), F.col("label").alias("old"))
        new = written(new, "cc-heard")
        # and takes the label of its label; a label that many share is joined by broadcast
        counts = new.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        up = new.select(F.col("node").alias("label"), F.col("label").alias("top")).join(counts, "label")
        jumped = _joined(new, up, "label", "n", total)
        labels = written(jumped.select("node", "deg", F.least("label", F.coalesce("top", "label")).alias("label"), "old"), "cc-labels")
        if labels.where("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("old")
