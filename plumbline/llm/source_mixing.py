"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents are shuffled into one stream of words, cut into equal blocks and repeated at most
MAX_REPEATS times. Slot i of the mix is a point of a golden-ratio lattice, mapped through the cumulative block
counts to a source; the r-th slot of a source takes its r-th block. The lattice visits each of its points once,
so every source gets exactly its number of blocks, spread evenly over the mix.

Defined results. A document's size is its number of words; null or empty texts have size 0 and take nothing. A
null source is a source of its own, listed last. Targets are real; a source takes its target rounded down, its
last block being cut short. Repeated rows are separate documents. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD, materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_REPEATS = 1.5, 2
BLOCK_WORDS = 1024
#: Each source's shuffled stream is summed in so many parts, and each mix in so many runs of slots.
PARTS, RUNS = 4096, 512
#: Cells of the unit interval by which slots meet sources.
CELLS = 4096


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size) of every row."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) per source.

    Sources are ranked by code point, null last, and take the weights in turn. Targets share `share` times all
    sizes by weight; a source whose part exceeds `most` times its size stops there, and the excess is shared again
    among the others until none exceeds. Each round is one aggregate over the sources; one row reaches the driver.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    ranked = materialize(totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).select("source", "source_size", F.spark_partition_id().alias("part")), "source-order")
    # places within range partitions, then the counts of the partitions before
    inner = ranked.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1)
    before = ranked.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.pmod(F.col("place") + F.col("offset"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    rows = materialize(inner.join(before.select("part", "offset"), "part").select("source", "source_size", weight.alias("weight")), "source-weights")
    goal = share * (rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s")).first()["s"])
    rate, cap = 0.0, F.col("source_size") * float(most)
    while True:
        full = cap <= rate * F.col("weight")
        x = rows.agg(F.sum(F.when(full, cap).otherwise(0.0)).alias("spent"), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)).alias("open")).first()
        new = (goal - (x["spent"] or 0.0)) / x["open"] if x["open"] else math.inf
        if new <= rate:
            break
        rate = new
    target = F.least(cap, F.lit(rate) * F.col("weight")) if math.isfinite(rate) else cap
    return rows.select("source", "source_size", "weight", F.greatest(target, F.lit(0.0)).alias("target"))


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source, block): which source's block stands at each slot of the mix."""
    blocks = targets.select("source", F.ceil(F.floor("target") / block_words).cast("long").alias("blocks")).where("blocks > 0")
    blocks = materialize(blocks, "source-blocks")
    # cumulative counts, by ranges of sources
    total = blocks.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    spark = targets.sparkSession
    if not total:
        return blocks.select(F.lit(0).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("block"))
    upper = F.sum("blocks").over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranges = blocks.withColumn("hi", upper).withColumn("lo", F.col("hi") - F.col("blocks"))
    cell = max(1, -(-total // CELLS))
    ranges = ranges.select("source", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor((F.col("hi") - 1) / cell))).alias("cell"))
    golden = next(g for g in range(max(1, round(total * (math.sqrt(5) - 1) / 2)), total + 2) if math.gcd(g, total) == 1)
    point = F.pmod(F.col("id").cast("decimal(19,0)") * F.lit(golden).cast("decimal(19,0)"), F.lit(total).cast("decimal(19,0)")).cast("long")
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / cell))
    slots = slots.join(ranges, "cell").where("point >= lo and point < hi").select("slot", "source")
    # rank of each slot in its source: inside a run of slots, plus the slots of the runs before
    run = max(1, -(-total // RUNS))
    slots = materialize(slots.withColumn("run", F.floor(F.col("slot") / run)), "mix-slots")
    inside = Window.partitionBy("run", "source").orderBy("slot")
    ahead = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = slots.groupBy("source", "run").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    ranked = slots.withColumn("r", F.row_number().over(inside) - 1).alias("s").join(runs.alias("r"), F.expr("s.run = r.run and s.source <=> r.source"))
    return ranked.select("s.slot", "s.source", (F.col("s.r") + F.col("r.ahead")).cast("long").alias("block"))


def streams(sizes: DataFrame, seed: int = 0) -> DataFrame:
    """sizes plus start: where each document begins in its source's shuffled stream of words.

    The order is by a hash of the id. Sums over PARTS hash ranges come first, so no task holds a whole source.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    rows = sizes.withColumn("h", order).withColumn("part", F.pmod(F.shiftright("h", 40), F.lit(PARTS)))
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    inside = Window.partitionBy("source", "part").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.alias("d").join(parts.alias("p"), F.expr("d.part = p.part and d.source <=> p.source"))
    return joined.select("d.doc_id", "d.source", "d.size", (F.col("d.inner") + F.col("p.ahead")).alias("start"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, **columns: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs."""
    return taken(materialize(sized(docs, **columns), "doc-sizes"), block_words)


def taken(sizes: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """As mix, of (doc_id, source, size) rows."""
    targets = materialize(source_targets(sizes), "source-targets")
    slots = schedule(targets, block_words)
    rows = streams(sizes).alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select("d.*", "t.source_size", "t.target")
    rows = materialize(rows, "doc-streams")
    # a document lies at start in the first pass over its source and at source_size + start in the second
    full = rows.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    full = full.withColumn("a", F.col("start") + F.col("pass") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.floor("target"))).where("a < b")
    pieces = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("b") - 1) / block_words))))
    pieces = pieces.withColumn("words", F.least("b", (F.col("block") + 1) * block_words) - F.greatest("a", F.col("block") * block_words))
    used = pieces.alias("p").join(slots.alias("s"), F.expr("p.block = s.block and p.source <=> s.source")).select("p.doc_id", "p.source", "p.start", "p.words")
    sums = used.groupBy("source", "start").agg(F.sum("words").alias("taken"))
    out = rows.alias("d").join(sums.alias("u"), F.expr("d.source <=> u.source and d.start = u.start and d.size > 0"), "left")
    return out.select("d.doc_id", "d.source", "d.size", "d.source_size", "d.target", F.coalesce("u.taken", F.lit(0)).cast("long").alias("taken"))
