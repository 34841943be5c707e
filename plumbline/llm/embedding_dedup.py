"""Embedding near-dedup by collision-counting projections, verified by cosine.

Every vector, scaled to length one, is projected on random lines. Two vectors of cosine c differ on a line by a
normal value of deviation sqrt(2 - 2c); they collide on it if they are within WINDOW, and on one of the further lines,
SETS of SIDES, if they lie on one side of it. Pairs that at most `most` lines of each set part, with at least `least`
collisions on LINES, are verified in double precision; both limits are the closest that a pair of exactly the cosine
keeps with probability 1 - MISS. The rows are sorted by one more line and cut into blocks; blocks meet only those inside the sort
window around them (`route`, calibrated likewise). In a block the rows are sorted by another line, with the same window.

A block travels to its partners as codes, CODE bytes a row, and not as vectors: the first pass tells which rows of two
blocks have a pair to be verified, and only their vectors follow, to the second. Near copies stand close on the sort line,
so a row's vector goes to the few block pairs it is needed in.

One line prunes but a constant part of the pairs of vectors spread evenly, so the work stays quadratic there, at
about a nanosecond per pair; no pair is written out, only counts and a spanning label per vector and block pair.
A dense group, however large, is just more full blocks.

Defined results. Vectors that take no part (see vectors.with_row_ids) link with nothing and are kept; those of different
widths never link. Repeated rows
are vectors of their own and link. A row with a null vec_id may link; component_id is the smallest id that is not
null, and a null row is kept only if it has no component id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import vectors
from plumbline.llm.common import connected_components, discard, likely, materialize, partitions_for

COSINE = 0.95
LINES, WINDOW, SIDES, SETS, MISS = 16, 0.5, 64, 2, 2e-4
#: Rows of a block at most, and how many blocks there are at least, if they have LEAST_BLOCK rows.
BLOCK, BLOCKS, LEAST_BLOCK = 65_536, 12, 512
#: Steps of a line's code; pairs compared at once: TILE rows with those of COLUMNS.
SCALE = 24
TILE, COLUMNS = 8, 4096
#: Block pairs are dealt to so many tasks at most.
MOST_TASKS = 4096
#: What a block holds of each row, sorted by q.
CODE = np.dtype([("uid", np.int64), ("sides", np.uint64, SETS), ("q", np.float32), ("lines", np.int8, LINES)])


def calibrate(cosine: float, lines: int = LINES, window: float = WINDOW, miss: float = MISS, sides: int = SIDES) -> tuple[int, int, float]:
    """(least collisions, most lines between, routing window): each loses a pair of exactly this cosine with probability `miss` at most."""
    deviation = math.sqrt(max(2 - 2 * cosine, 1e-12))
    # the first k counts of a binomial law that together have a probability of `miss` at most
    tail = lambda n, p: next(k for k in range(n + 1) if k == n or sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > miss)
    least = tail(lines, math.erf(window / deviation / math.sqrt(2)))
    most = sides - tail(sides, 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi)
    low, high = 0.0, 10.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - math.erf(mid / math.sqrt(2)) > miss else (low, mid)
    return least, most, high * deviation


def lines_for(width: int) -> np.ndarray:
    """[width, LINES + 2 + SETS * SIDES] fixed normal directions; the two after LINES are the sort lines."""
    first = np.random.default_rng(20).standard_normal((width, LINES + 1))
    return np.concatenate([first, np.random.default_rng(21).standard_normal((width, 1 + SETS * SIDES))], 1)


def codes(uids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The CODEs of vectors of length one, in their order, and their places p on the first sort line."""
    on = unit @ lines_for(unit.shape[1])
    out = np.zeros(len(unit), CODE)
    out["uid"], out["q"] = uids, on[:, LINES + 1]
    out["lines"] = np.clip(np.rint(on[:, :LINES] * SCALE), -120, 120)
    out["sides"] = np.packbits(on[:, LINES + 2 :] >= 0, axis=1).view(np.uint64)
    return out, on[:, LINES]


def close(a: np.ndarray, b: np.ndarray, limits: tuple[int, int, float], same: bool, done: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks (i, j) of the pairs of two arrays of codes, each sorted by q, that have to be verified; same: of one array, each pair once.

    done: marks of the rows of both, which may grow meanwhile; pairs of which both rows are marked are left out.
    """
    least, most, route = limits
    window, route = int(WINDOW * SCALE) + 1, route + 1e-5  # the codes are rounded
    differ, counts, good = (np.empty(TILE * COLUMNS, x) for x in (np.uint64, np.uint8, bool))
    sides_a, sides_b = ([np.ascontiguousarray(x["sides"][:, k]) for k in range(SETS)] for x in (a, b))
    lines_a, lines_b = (np.ascontiguousarray(x["lines"]).astype(np.int16) for x in (a, b))
    starts = np.arange(0, len(a), TILE)
    ends = np.minimum(starts + TILE, len(a))
    low = np.maximum(np.searchsorted(b["q"], a["q"][starts] - route), starts if same else 0)
    high = np.searchsorted(b["q"], a["q"][ends - 1] + route, "right")
    for s, e, lo, hi in zip(starts.tolist(), ends.tolist(), low.tolist(), high.tolist(), strict=True):
        for at in range(lo, hi, COLUMNS):
            wide = min(COLUMNS, hi - at)
            n = (e - s) * wide
            np.bitwise_xor(sides_a[0][s:e, None], sides_b[0][None, at : at + wide], out=differ[:n].reshape(e - s, wide))
            np.bitwise_count(differ[:n], out=counts[:n])
            np.less_equal(counts[:n], most, out=good[:n])
            good[n : n + -n % 8] = False
            hit = np.flatnonzero(good[: n + -n % 8].view(np.uint64))  # eight at once: few are
            if not len(hit):
                continue
            hit = (hit[:, None] * 8 + np.arange(8)).ravel()
            i, j = np.divmod(hit[good[hit]], wide)
            i, j = i + s, j + at
            ok = ~(done[0][i] & done[1][j]) & ((i < j) | (not same))
            i, j = i[ok], j[ok]
            for u, v in zip(sides_a[1:], sides_b[1:], strict=True):
                ok = np.bitwise_count(u[i] ^ v[j]) <= most
                i, j = i[ok], j[ok]
            ok = (np.abs(lines_a[i] - lines_b[j]) <= window).sum(1) >= least
            yield i[ok], j[ok]


def summary(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(uid, links, label): per linked vector, how many links it has here and the smallest uid they connect it to; each pair (i, j) once."""
    label = ids.astype(np.int64)
    while True:
        old = label.copy()
        np.minimum.at(label, j, label[i])
        np.minimum.at(label, i, label[j])
        if (old == label).all():
            break
    count = np.bincount(i, minlength=len(label)) + np.bincount(j, minlength=len(label))
    hit = np.flatnonzero(count)
    return ids[hit], count[hit], label[hit]


def block_pairs(blocks: DataFrame, window: float) -> DataFrame:
    """(width, a, b), a <= b: blocks(width, block, lo, hi) of one width that come within window of each other, by an equi-join on cells of the line."""
    cell = lambda c: F.floor(F.col(c) / window)
    a = blocks.select("width", F.col("block").alias("a"), F.col("hi").alias("hi_a"), F.explode(F.sequence(cell("lo"), cell("hi") + 1)).alias("cell"))
    b = blocks.select("width", F.col("block").alias("b"), F.col("lo").alias("lo_b"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("cell"))
    return a.join(b, ["width", "cell"]).where("a <= b").where(F.col("lo_b") - F.col("hi_a") <= window).select("width", "a", "b").distinct()


def packed(flat: DataFrame) -> DataFrame:
    """(width, block, lo, hi, codes): one row for each width in each partition of flat(width, p, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        ends: dict[int, list[float]] = {}
        part = 0
        for batch in batches:
            if len(batch):
                part = batch.column(3)[0].as_py()
            width = batch.column(0).to_numpy()
            for w in np.unique(width):
                of = pa.array(width == w)
                held.setdefault(int(w), []).extend(batch.column(2).filter(of).to_pylist())
                ends.setdefault(int(w), []).extend(f(batch.column(1).filter(of).to_pylist()) for f in (min, max))
        for w, rows in held.items():
            data = b"".join(rows)
            block = np.frombuffer(data, CODE)
            block = block[np.argsort(block["q"], kind="stable")]
            yield pa.record_batch([pa.array([w], pa.int32()), pa.array([part], pa.int64()), pa.array([min(ends[w])]), pa.array([max(ends[w])]), pa.array([block.tobytes()], pa.binary())], names=["width", "block", "lo", "hi", "codes"])

    return flat.select("width", "p", "code", F.spark_partition_id().alias("part")).mapInArrow(run, "width int, block long, lo double, hi double, codes binary")


def merged(blocks: DataFrame, n: int) -> DataFrame:
    """The blocks, every n neighbours as one: Spark may deal a small table to more partitions than asked for."""
    rows = blocks.groupBy("width", F.floor(F.col("block") / n).alias("block")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("codes").alias("codes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lists in batch.column(4):
                block = np.frombuffer(b"".join(lists.as_py()), CODE)
                out.append(block[np.argsort(block["q"], kind="stable")].tobytes())
            yield pa.record_batch([*batch.columns[:4], pa.array(out, pa.binary())], names=["width", "block", "lo", "hi", "codes"])

    return rows.mapInArrow(run, "width int, block long, lo double, hi double, codes binary")


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    base = vectors.with_row_ids(rows, vec_id, embedding)
    good = base.where("ok").select("uid", "vec", "width")
    n = good.count()
    limits = calibrate(cosine)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in vectors.of_each_width(batch, 1):
                got, p = codes(part.column(0).to_numpy(), vectors.unit(vectors.matrix(part.column(1), width)))
                yield pa.record_batch([part.column(0), part.column(2), pa.array(p), pa.array([x.tobytes() for x in got], pa.binary())], names=["uid", "width", "p", "code"])

    flat = good.mapInArrow(project, "uid long, width int, p double, code binary")
    size = min(BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS)))
    flat = flat.repartitionByRange(partitions_for(n, size), "width", "p", "uid")
    blocks = materialize(packed(flat), "blocks")
    if (made := blocks.count()) >= 2 * partitions_for(n, size):
        small, blocks = blocks, materialize(merged(blocks, made // partitions_for(n, size)), "merged-blocks")
        discard(small)
    pairs = materialize(block_pairs(blocks.select("width", "block", "lo", "hi"), limits[2]).withColumn("unit", F.xxhash64("width", "a", "b")), "block-pairs")
    units = partitions_for(pairs.count(), 1)
    sides = pairs.select("unit", "width", F.explode(F.when(F.expr("a = b"), F.array(F.struct("a", F.lit(0).alias("side")))).otherwise(F.array(F.struct("a", F.lit(0).alias("side")), F.struct(F.col("b").alias("a"), F.lit(1).alias("side"))))).alias("x"))
    sides = sides.select("unit", "width", F.col("x.a").alias("block"), "x.side").join(blocks.select("width", "block", "codes"), ["width", "block"])
    met = sides.select("unit", "side", "codes").repartition(min(units, MOST_TASKS), "unit").groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("side", "codes"))).alias("m"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of two blocks that have a pair to be verified."""
        for batch in batches:
            for k in range(len(batch)):
                both = [np.frombuffer(x.as_py(), CODE) for x in batch.column(1)[k].values.field("codes")]
                same = len(both) == 1
                a, b = both[0], both[-1]
                hit = [np.zeros(len(a), bool), np.zeros(len(b), bool)]
                for i, j in close(a, b, limits, same, [hit[0], hit[not same]]):
                    hit[0][i], hit[not same][j] = True, True
                uid = [x["uid"][h] for x, h in zip(both, hit, strict=False)]
                side = np.repeat([0, 1][: len(both)], [len(u) for u in uid])
                uid = np.concatenate(uid)
                yield pa.record_batch([pa.array(np.full(len(uid), batch.column(0)[k].as_py())), pa.array(side, pa.int32()), pa.array(np.full(len(uid), same)), pa.array(uid)], names=["unit", "side", "same", "uid"])

    wanted = materialize(met.mapInArrow(mark, "unit long, side int, same boolean, uid long"), "wanted")
    discard(blocks, pairs)
    # a vector follows only where its code has found a pair
    known = likely(good.select("uid", "vec"), F.col("uid"), wanted, F.col("uid"))
    ready = wanted.join(known, "uid").select("unit", "side", "same", "uid", "vec")

    def verify(table: pa.Table) -> pa.Table:
        """The links between the two sides of a unit, or inside its only one."""
        table = table.combine_chunks()
        side, uid = (table.column(c).to_numpy() for c in ("side", "uid"))
        vec = table.column("vec").combine_chunks()
        unit = vectors.unit(vectors.matrix(vec, len(vec[0])))
        every, _ = codes(uid, unit)
        order = np.argsort(every["q"], kind="stable")
        place = [order[side[order] == k] for k in (0, 1)]
        same = table.column("same")[0].as_py()
        a, b = (place[0], place[0]) if same else place
        out = [(np.zeros(0, int), np.zeros(0, int))]
        for i, j in close(every[a], every[b], limits, same, [np.zeros(len(x), bool) for x in (a, b)]):
            for s in range(0, len(i), 65536):
                x, y = a[i[s : s + 65536]], b[j[s : s + 65536]]
                good = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                out.append((x[good], y[good]))
        got, count, label = summary(uid, *(np.concatenate([o[k] for o in out]) for k in (0, 1)))
        return pa.table([pa.array(got), pa.array(count.astype(np.int64)), pa.array(label)], names=["uid", "k", "label"])

    ready = ready.repartition(min(units, MOST_TASKS), "unit")
    found = materialize(ready.groupBy("unit").applyInArrow(verify, "uid long, k long, label long"), "vector-links")
    discard(wanted)
    parts_of = connected_components(found.select(F.col("uid").alias("a"), F.col("label").alias("b")))
    counts = found.groupBy("uid").agg(F.sum("k").alias("n_links"))
    out = base.select("uid", "vec_id").join(counts, "uid", "left").join(parts_of.withColumnRenamed("id", "uid"), "uid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "uid").alias("component"))
    out = materialize(out, "vector-components")
    least_id = out.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = out.join(least_id, "component").select("vec_id", "n_links", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
