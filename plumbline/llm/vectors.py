"""What the embedding operators share: checked vectors with row ids, and blocks of vectors as single rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import materialize


def with_row_ids(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(uid, vec_id, vec, ok, width): written out, so the ids stay what they are. ok: the vector takes part.

    A vector takes part if it is not null, has no null, NaN or infinite component and is not all zeros. Vectors of
    different widths (numbers of components) have no cosine and are worked on apart.
    """
    single = rows.schema[embedding].dataType.simpleString() == "array<float>"  # half the bytes of array<double>
    vec = F.col(embedding).cast("array<float>" if single else "array<double>")
    rows = rows.select(F.col(vec_id).alias("vec_id"), vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    return materialize(rows.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("uid", F.monotonically_increasing_id()).withColumn("width", F.size("vec")), "vectors")


def of_each_width(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(width, the batch's rows whose list in that column has it)."""
    widths = pc.list_value_length(batch.column(column)).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        yield int(width), batch.take(pa.array(np.flatnonzero(widths == width)))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """[rows, width] of an Arrow list array whose lists all have that width."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by a power of two first, which is exact and keeps the squares of extreme values finite."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def block(rows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(uids, matrix) of one array<struct<uid, vec>> value; its vectors have one width."""
    width = len(rows.field("vec")[0])
    return rows.field("uid").to_numpy(), matrix(rows.field("vec"), width)
