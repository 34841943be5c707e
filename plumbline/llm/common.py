"""Helpers shared by the training-data operators: shared-folder tables, connected components, running sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.arrays import running
from plumbline.functions.tables import discard, likely, materialize, shared_dir  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed by Spark's SQL parser: the same class, for use inside SQL string literals.
WORD_SQL = r"[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(df_rows: int, rows_each: int, least: int = 1) -> int:
    """How many partitions hold df_rows with about rows_each in each."""
    return max(least, -(-df_rows // rows_each))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest id each reaches) of the edges a[i] - b[i], by hooking roots and halving paths."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        rx, ry = root[x], root[y]
        open_ = rx != ry
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while (root != root[root]).any():
            root = root[root]
    return ids, ids[root]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v), u > v: each id of a partition's edges and the smallest it reaches there; holds a row per id, not per edge."""
    u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        u, v = (np.concatenate([x, batch.column(i).to_numpy().astype(np.int64)]) for i, x in enumerate((u, v)))
        u, v = forest(u, v)
        u, v = u[u != v], v[u != v]
    yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "components", edges_each: int = 250_000) -> DataFrame:
    """(id, component) for every id (long) on an edge; component is the smallest id reachable.

    Every round first shrinks each partition of about edges_each edges to its own spanning stars, without a shuffle.
    If several partitions are left, a large-star and a small-star step follow, on (child, parent) rows with map-side
    minima, so a vertex that has a third of all edges costs one partial row per task; the joins back are plain
    equi-joins that adaptive execution splits when a key is hot. The rounds end when every child has one parent and
    no parent is a child. Edges with a null end are left out; an empty input gives an empty result.
    """
    e = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v"), name)
    while True:
        parts = partitions_for(e.count(), edges_each)
        e = materialize(e.coalesce(parts).mapInArrow(_forests, "u long, v long"), name)
        if parts == 1:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour of u points to the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point to the smallest of them; rows are (larger, smaller)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), name)
        twice = e.groupBy("u").count().where("count > 1").select("u")
        inner = e.select(F.col("v").alias("u")).join(e.select("u"), "u", "left_semi")
        if not twice.unionByName(inner).limit(1).count():
            break
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def running_sum(arr: Column) -> Column:
    """The sum of the elements of array<bigint> before each one."""
    return running(arr, lambda a, b: a + b, "bigint")


def running_max(arr: Column) -> Column:
    """The largest element of array<bigint> before each one, 0 at least."""
    return running(arr, lambda a, b: F.greatest(a, b), "bigint")
