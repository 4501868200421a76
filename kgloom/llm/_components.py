"""Connected components of an edge table by repeated hooking and contraction.

Each round is dealt to as few tasks as its edges need at HELD a task, and every task first makes the edges that it holds a
forest of stars, so what hangs together in one task is one step apart and long chains take few rounds.  It hooks every node
to its smallest neighbour (a partial minimum per task, so a node with a third of all edges is one row per task), shortens the
pointers once, and renames the edges by them; edges inside a component vanish.  The smallest node of a component never moves, so it is
the label that is left.  Every table is written between rounds; all joins are equi-joins of written
tables, whose hot partitions AQE splits.  Nothing is collected but one row count a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import for_python, removed, written

#: Edges that are made a forest at once.
HELD = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component), component the smallest node reachable. Nodes without an edge to another node are absent."""
    spark = edges.sparkSession
    for_python(spark)
    stars = lambda df: df.mapInArrow(_forests, "a long, b long")
    left = written(stars(edges.filter("a <> b").select("a", "b")), "cc-edges")
    labels = None
    while n := left.count():
        both = stars(left.coalesce(-(-n // HELD))).select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("near"))
        hooked = written(both.groupBy("node").agg(F.min("near").alias("up")), "cc-hooks")
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        short = written(hooked.join(above, "up", "left").select("node", F.coalesce("upper", "up").alias("label")), "cc-labels")
        removed(spark, hooked)
        rename = lambda c: short.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        if labels is None:
            labels = short
        else:
            old, labels = labels, written(labels.withColumnRenamed("label", "up").join(rename("up"), "up", "left").select("node", F.coalesce("up_label", "up").alias("label")), "cc-labels")
        moved = left.join(rename("a"), "a", "left").join(rename("b"), "b", "left").select(F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y"))
        old, left = left, written(stars(moved.filter("x <> y")), "cc-edges")
        removed(spark, old)
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.withColumnRenamed("label", "component")


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as forests, of at most about HELD edges each."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(i).to_numpy() for i in range(2)])
        n += batch.num_rows
        if n >= HELD:
            a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, n = [[a, b]], len(a)
            if n >= HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                held, n = [], 0
    if n:
        a, b = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the ends of a and b with the same components, one less than a component's nodes: each to its smallest."""
    who, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(who))
    while (label[x] != label[y]).any():
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
    moved = label != np.arange(len(who))
    return who[label[moved]], who[moved]
