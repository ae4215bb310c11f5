"""Connected components of links between rows, in rounds of joins; no vertex's links ever have to be in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import forget, saved


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of some links that isn't the least of its component in them, and that least vertex."""
    vertex, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertex))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(vertex))
    return vertex[moved], vertex[label[moved]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars in place of a batch's links."""
    for batch in batches:
        x, root = roots(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(root, pa.int64())], names=["x", "root"])


def components(links: DataFrame) -> DataFrame:
    """(x, root) for links (a, b) of longs: the least vertex of x's component, for every x that isn't it.

    Each round hangs every vertex on its least root, links its other roots to that one, and skips one step of each path.
    """
    sorted_links = links.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).where("a < b").repartitionByRange("a", "b").sortWithinPartitions("a", "b")
    state = saved(sorted_links.mapInArrow(contracted, "x long, root long"))
    while True:
        least = saved(state.groupBy("x").agg(F.min("root").alias("root"), F.count("*").alias("n")))
        more = state.join(least.where("n > 1").select("x", F.col("root").alias("to")), "x").where("root > to").select(F.col("root").alias("x"), F.col("to").alias("root"))
        above = least.select(F.col("x").alias("root"), F.col("root").alias("up"))
        jumped = least.select("x", "root").join(above, "root", "left").select("x", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved"))
        after = saved(jumped.unionByName(more.distinct().withColumn("moved", F.lit(True))))
        done = after.where("moved").isEmpty()
        forget(state)
        forget(least)
        state = after.drop("moved")
        if done:
            return state
