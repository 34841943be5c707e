"""Approximate nearest neighbours by cosine: probed lists, scanned dimension by dimension with early abandoning.

Vectors are scaled to length one, rotated by a fixed random rotation and kept in lists around centroids, which are
fitted on a bounded sample (SAMPLE rows, the smallest hashes of the ids); every row is indexed. A query probes the lists
nearest to it, as many as the sample's own queries need for PROBE_RECALL of their neighbours. Within a list, partial
squared distances grow by COLUMNS rotated dimensions at a time; after each step a test drops the candidates whose partial
distance, scaled up, exceeds the query's current k-th distance by the factor 1 + EPSILON / sqrt(dimensions seen), and at
the end those whose whole distance exceeds it by more than single precision may err (SLACK). Survivors get the exact cosine of the original vectors in double precision.

Long lists are cut into chunks of about CHUNK rows at most. A row goes to its chunk, once, and a query to each chunk of
the lists it probes; a task holds a chunk and meets its queries QUERIES at a time, so none depends on the size of a list
and no vector is written for a pair of blocks.

Defined results. Vectors that take no part (see vectors.with_row_ids) are neither queries nor candidates; neighbours
have the query's width, and each width has an index of its own. A repeated
row is a candidate of its own, so a query's copy is its neighbour. Rows with a null vec_id are no queries. Fewer
candidates than k are all returned. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm import vectors

SAMPLE = 16_384
LISTS = 64
PROBE_RECALL = 0.98
COLUMNS, EPSILON, SLACK = 16, 2.1, np.float32(1e-4)
CHUNK, LEAST_CHUNK, CHUNKS, QUERIES, STEP = 65_536, 64, 64, 512, 1024
#: Chunks are dealt to so many tasks at most.
MOST_TASKS = 4096


def rotation(width: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(30).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def fit_centroids(sample: np.ndarray, lists: int = LISTS, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of unit vectors; empty lists keep their last centre."""
    lists = max(1, min(lists, len(sample) // 32))
    centres = sample[np.random.default_rng(31).choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.sqrt((sums**2).sum(1))
        centres[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centres


def fit_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float = PROBE_RECALL) -> int:
    """How many nearest lists hold this part of the sample queries' k nearest; the whole table's are nearer, so no fewer."""
    queries = sample[:512]
    near = queries @ sample.T
    near[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    best = np.argpartition(-near, min(k, len(sample) - 1) - 1, axis=1)[:, : min(k, len(sample) - 1)] if len(sample) > 1 else np.zeros((len(queries), 0), int)
    order = np.argsort(np.argsort(-(queries @ centres.T), axis=1), axis=1)
    ranks = np.take_along_axis(order, (sample @ centres.T).argmax(1)[best], axis=1).ravel()
    return int(np.quantile(ranks, recall, method="higher")) + 1 if len(ranks) else len(centres)


def scan(queries: np.ndarray, rotated_q: np.ndarray, rows: np.ndarray, rotated: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """([queries, k] positions, [queries, k] cosines) among rows, -1 where there are none; own[q] is the row to leave out, or -1.

    queries and rows are original vectors scaled to length one in double precision; ties go to the earlier row.
    """
    m, width = rotated_q.shape
    top, where = np.full((m, k), -np.inf), np.full((m, k), -1)
    cuts = [*range(0, width, COLUMNS), width]
    steps = [(0, min(256, len(rows)))] + [(s, min(s + STEP, len(rows))) for s in range(min(256, len(rows)), len(rows), STEP)]
    norm = lambda x: np.stack([(x[:, a:b] ** 2).sum(1) for a, b in zip(cuts, cuts[1:], strict=False)])
    qn, rn = norm(rotated_q), norm(rotated)
    for s, e in steps:
        limit = (2 - 2 * top[:, -1]).astype(np.float32)  # infinite until k are known
        alive = np.ones((m, e - s), bool)
        partial = np.zeros((m, e - s), np.float32)
        for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if alive.mean() > 0.1:
                partial -= 2 * rotated_q[:, a:b] @ rotated[s:e, a:b].T
                partial += qn[c][:, None]
                partial += rn[c][None, s:e]
            else:
                i, j = np.nonzero(alive)
                partial[i, j] += qn[c][i] + rn[c][s + j] - 2 * np.einsum("ij,ij->i", rotated_q[i, a:b], rotated[s + j, a:b])
            most = limit + SLACK if b == width else limit * np.float32((1 + EPSILON / np.sqrt(b)) ** 2 * b / width)
            alive &= partial <= most[:, None]
        i, j = np.nonzero(alive)
        keep = own[i] != s + j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        exact = np.concatenate([np.einsum("ij,ij->i", queries[i[at : at + 65536]], rows[s + j[at : at + 65536]]) for at in range(0, len(i), 65536)])
        hit = np.unique(i)
        of, score, place = np.concatenate([np.repeat(hit, k), i]), np.concatenate([top[hit].ravel(), exact]), np.concatenate([where[hit].ravel(), s + j])
        order = np.lexsort((place, -score, of))
        first = np.searchsorted(of[order], hit)
        order = order[first[:, None] + np.arange(k)]  # each has its k rows of before, at least
        top[hit], where[hit] = score[order], place[order]
        where[np.isinf(top)] = -1
    return where, top


def nearest(rows: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which is_query holds (over vec_id)."""
    base = vectors.with_row_ids(rows, vec_id, embedding)
    good = base.where("ok")
    fitted: dict[int, tuple[np.ndarray, int]] = {}
    for width in sorted(r["width"] for r in good.select("width").distinct().collect()):  # a few: the table's widths
        mine = good.where(F.col("width") == width)
        sample = mine.orderBy(F.xxhash64("vec_id", "uid"), "uid").limit(SAMPLE).select("vec").toArrow().column(0).combine_chunks()
        unit = vectors.unit(vectors.matrix(sample, width))
        centres = fit_centroids(unit)
        fitted[width] = centres, fit_probes(unit, centres, k)

    def assign(probe: bool) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for width, part in vectors.of_each_width(batch, 2):
                    centres, probes = fitted[width]
                    near = vectors.unit(vectors.matrix(part.column(2), width)) @ centres.T
                    lists = np.argsort(-near, axis=1, kind="stable")[:, : probes if probe else 1]
                    index = pa.array(np.repeat(np.arange(len(part)), lists.shape[1]))
                    # a width has lists of its own
                    yield pa.record_batch([*part.take(index).columns, pa.array(width * 2**20 + lists.ravel())], names=["uid", "vec_id", "vec", "list"])

        return run

    kind, vec = (base.schema[c].dataType.simpleString() for c in ("vec_id", "vec"))
    schema = f"uid long, vec_id {kind}, vec {vec}, list long"
    rows_in = good.select("uid", "vec_id", "vec").mapInArrow(assign(False), schema)
    asked = good.where(is_query).select("uid", "vec_id", "vec").mapInArrow(assign(True), schema)
    sizes = {r["list"]: r["count"] for r in rows_in.groupBy("list").count().collect()}  # one row per list
    chunk = min(CHUNK, max(LEAST_CHUNK, -(-sum(sizes.values()) // CHUNKS)))
    parts = {at: max(1, round(n / chunk)) for at, n in sizes.items()}
    n_parts = F.element_at(F.create_map(*[F.lit(x) for kv in parts.items() for x in kv]), F.col("list")) if parts else F.lit(1)
    here = rows_in.select("list", F.pmod(F.xxhash64("uid"), n_parts).cast("int").alias("part"), F.lit(False).alias("asks"), "uid", "vec_id", "vec")
    there = asked.where(F.col("list").isin(*parts)).select("list", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.lit(True).alias("asks"), "uid", "vec_id", "vec")
    units = here.unionByName(there).repartition(max(1, min(sum(parts.values()), MOST_TASKS)), "list", "part")

    def run(table: pa.Table) -> pa.Table:
        """The k nearest of a chunk's rows to each of its queries."""
        asks = table.column("asks")
        rows, queries = table.filter(pc.invert(asks)).combine_chunks(), table.filter(asks).combine_chunks()
        out = []
        if len(rows) and len(queries):
            rows = rows.take(pc.sort_indices(rows, sort_keys=[("vec_id", "ascending"), ("uid", "ascending")], null_placement="at_start"))
            rids, lists = rows.column("uid").to_numpy(), rows.column("vec").combine_chunks()
            width = len(lists[0])
            turn = rotation(width)
            rv = vectors.unit(vectors.matrix(lists, width))
            rotated = (rv @ turn).astype(np.float32)
            order = np.argsort(rids)
            for s in range(0, len(queries), QUERIES):
                q = queries.slice(s, QUERIES).combine_chunks()
                qids = q.column("uid").to_numpy()
                qv = vectors.unit(vectors.matrix(q.column("vec").combine_chunks(), width))
                at = np.minimum(np.searchsorted(rids[order], qids), len(rids) - 1)
                own = np.where(rids[order][at] == qids, order[at], -1)
                where, top = scan(qv, (qv @ turn).astype(np.float32), rv, rotated, own, k)
                i, c = np.nonzero(where >= 0)
                i, hit = pa.array(i), where[i, c]
                out.append(pa.table([q.column("uid").take(i), q.column("vec_id").take(i), rows.column("vec_id").take(pa.array(hit)), pa.array(rids[hit]), pa.array(top[np.asarray(i), c])], names=["quid", "query_id", "vec_id", "uid", "score"]))
        kinds = rows.schema.field("vec_id").type
        return pa.concat_tables(out) if out else pa.table({"quid": pa.array([], pa.int64()), "query_id": pa.array([], kinds), "vec_id": pa.array([], kinds), "uid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    found = units.groupBy("list", "part").applyInArrow(run, f"quid long, query_id {kind}, vec_id {kind}, uid long, score double")
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
