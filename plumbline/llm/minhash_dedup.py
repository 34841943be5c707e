"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

A signature has COMPONENTS components of BITS bits each; its distance to another is the number of components that
differ. It is split into CHUNKS chunks. Two signatures within RADIUS of each other have, by pigeonhole, a chunk with
at most one error (CHUNKS * 2 > RADIUS), so each chunk is indexed once for every component left out: pairs within the
radius meet in at least one key, always. Pairs beyond it that meet are compared up to a distance of ACCEPT, so that
a pair of exactly the similarity is missed with probability 4e-5.

Documents with one and the same set collapse into a class first, so copies cost nothing afterwards. Then

1. each key links its members to one of them (linear in its size): to the one that shares the most keys with others,
   which in a group of edited copies is the text they stem from. Links count once confirmed on the full sets.
2. keys whose members still lie in different components are cut into blocks, of which pairs meet in one task: first
   with signatures alone, which tells the members that have a partner left, then with the full sets of those. A task
   confirms its pairs and gives the links that join components, one per member at most. No pair leaves a task
   before it is confirmed, and pairs joined already are skipped. Members of a long key's largest component meet the
   others only.

Defined results. Null or empty texts and texts without words have an empty set and stand alone. Words are runs of
other characters than space and U+0009-U+000D with A-Z lower-cased; with fewer than five, all of them are one
shingle. Repeated rows belong to one component. A row with a null id joins its component, whose id is the smallest
id that is not null; alone, its component is null and it is kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import connected_components, discard, likely, materialize

K_WORDS, PERCENT = 5, 75
COMPONENTS, BITS, CHUNKS, RADIUS, ACCEPT = 64, 16, 13, 25, 30
#: Members and bytes of shingle hashes of a block, about; pairs compared at once.
BLOCK, BLOCK_BYTES, PAIRS = 512, 4_000_000, 1 << 17
#: Component ranges of the chunks.
BOUNDS = [(COMPONENTS * i // CHUNKS, COMPONENTS * (i + 1) // CHUNKS) for i in range(CHUNKS)]


def signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, sig): cls is a 128-bit fingerprint of the set, sig the signature's bytes."""
    kind = docs.schema[doc_id].dataType
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("text_key"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                sets, offsets = tokens.shingle_sets(part.column(2), K_WORDS)
                sig = tokens.signatures(sets, offsets, COMPONENTS, BITS)
                n = np.diff(offsets)
                sums = [np.append(np.cumsum(tokens.mix64(sets ^ tokens.U(s)), dtype=tokens.U), tokens.U(0)) for s in (11, 13)]
                ends = [np.where(offsets > 0, c[offsets - 1], tokens.U(0)) for c in sums]
                prints = np.stack([e[1:] - e[:-1] for e in ends], 1)
                yield pa.record_batch(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in prints], pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "cls", "sig"],
                )
            tokens.release()

    return rows.mapInArrow(sign, f"doc_id {kind.simpleString()}, text_key binary, n_shingles long, cls binary, sig binary")


def chunk_keys(sig: Column) -> Column:
    """array<long>: for each component, a key of its chunk without it."""
    part = lambda a, b: F.substring(sig, 2 * a + 1, 2 * (b - a))
    return F.array(*[F.xxhash64(F.lit(i), part(a, i), part(i + 1, b)) for a, b in BOUNDS for i in range(a, b)])


def first_keys(equal: np.ndarray) -> np.ndarray:
    """equal[pairs, COMPONENTS]: the place in chunk_keys of the first key each pair shares, COMPONENTS if it shares none."""
    out = np.full(len(equal), COMPONENTS)
    for start, end in reversed(BOUNDS):
        missing = end - start - equal[:, start:end].sum(1)
        for i in reversed(range(start, end)):
            out[missing == 1 - equal[:, i].astype(int)] = i
            out[missing == 0] = i
    return out


def alike(sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs (i, j) may have the similarity, by the sizes of the sets and the distance of the signatures."""
    return (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j])) & ((sig[i] != sig[j]).sum(1) <= ACCEPT)


def partners(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, slot: np.ndarray, other: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Chunks (i, j) of the pairs inside each run of members (from ends[r] to ends[r + 1]) that have to be confirmed.

    Those are alike, of different components, not both on the other side, and share no earlier key than `slot`.
    """
    size = np.diff(ends)[np.searchsorted(ends, np.arange(len(n)), "right") - 1]
    left = ends[1:][np.searchsorted(ends, np.arange(len(n)), "right") - 1] - np.arange(len(n)) - 1  # members behind in the run
    left = np.where(size > 1, left, 0)
    before = np.concatenate([[0], np.cumsum(left)])
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(at, to), left[at:to])
        j = i + 1 + np.arange(len(i)) - (before[i] - before[at])
        ok = (comp[i] != comp[j]) & ~(other[i] & other[j])
        i, j = i[ok], j[ok]
        ok = alike(sig, n, i, j)
        i, j = i[ok], j[ok]
        ok = first_keys(sig[i] == sig[j]) == slot[i]
        yield i[ok], j[ok]
        at = to


def confirmed(sets: np.ndarray, ends: np.ndarray, comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j): links on full sets that join components, without those between members joined meanwhile."""
    code = np.unique(sets, return_inverse=True)[1]
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    n = np.diff(ends)
    kinds, root = np.unique(comp, return_inverse=True)
    out: list[tuple[int, int]] = []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(i)), strict=True):
        x, ys = i[a], j[a:b][root[j[a:b]] != root[i[a]]]
        if not len(ys):
            continue
        mark[code[ends[x] : ends[x + 1]]] = True
        flat = np.repeat(ends[ys] - (np.cumsum(n[ys]) - n[ys]), n[ys]) + np.arange(n[ys].sum())
        both = np.add.reduceat(mark[code[flat]].astype(np.int64), np.cumsum(n[ys]) - n[ys])
        mark[code[ends[x] : ends[x + 1]]] = False
        for y in ys[100 * both >= PERCENT * (n[x] + n[ys] - both)]:
            if root[x] != root[y]:
                out.append((x, y))
                root[root == root[y]] = root[x]
    return np.array([o[0] for o in out], int), np.array([o[1] for o in out], int)


def runs_of(batch: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, pa.Array | None]:
    """The members of a batch's units as flat arrays, their ends, and the sets if there are some."""
    lists = batch.column(batch.schema.get_field_index("m"))
    flat = lists.flatten()
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    out = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("cid", "comp", "n", "other")}
    out["slot"] = np.repeat(batch.column(batch.schema.get_field_index("slot")).to_numpy(), np.diff(ends))
    out["sig"] = np.frombuffer(b"".join(flat.field("sig").to_pylist()), np.uint16).reshape(len(flat), COMPONENTS)
    return out, ends, flat.field("words") if flat.type.get_field_index("words") >= 0 else None


def blocks_of(mixed: DataFrame) -> DataFrame:
    """(unit, slot, m) of mixed(key, slot, cid, comp, n, sig): pairs of blocks of each key's members, as one list each.

    A key of more than a block has its largest component's members on the other side: they don't meet each other.
    Only the numbers of the blocks are paired by key; their contents join them by block.
    """
    by_comp = mixed.groupBy("key", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("words"))
    sizes = by_comp.groupBy("key").agg(F.sum("k").alias("all_k"), F.sum("words").alias("all_words"), F.max_by(F.struct("comp", "k", "words"), F.struct("k", "comp")).alias("big"))
    parts = lambda k, words: F.greatest(F.ceil(k / BLOCK), F.ceil(words * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    one = parts(F.col("all_k"), F.col("all_words")) == 1
    sizes = sizes.select("key", F.when(~one, F.col("big.comp")).alias("big"), F.when(one, 1).otherwise(parts(F.col("all_k") - F.col("big.k"), F.col("all_words") - F.col("big.words"))).alias("pa"), F.when(one, 0).otherwise(parts(F.col("big.k"), F.col("big.words"))).alias("po"))
    sizes = materialize(sizes, "key-blocks")
    other = F.coalesce(F.col("comp") == F.col("big"), F.lit(False))
    rows = mixed.join(sizes, "key").withColumn("other", other)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("cid"), F.when(F.col("other"), F.col("po")).otherwise(F.col("pa"))))
    blocks = rows.groupBy("key", "slot", "other", "part").agg(F.collect_list(F.struct("cid", "comp", "n", "other", "sig")).alias("m"))
    blocks = materialize(blocks, "blocks")
    first = sizes.select("key", "pa", "po", F.explode(F.sequence(F.lit(0), F.col("pa") - 1)).alias("a"))
    near = first.select("key", "a", F.lit(False).alias("other"), F.explode(F.sequence(F.col("a"), F.col("pa") - 1)).alias("b"))
    far = first.where("po > 0").select("key", "a", F.lit(True).alias("other"), F.explode(F.sequence(F.lit(0), F.col("po") - 1)).alias("b"))
    near = near.where("a < b").unionByName(far)
    a = blocks.where("not other").select("key", F.col("part").alias("a"), "slot", F.col("m").alias("ma"))
    b = blocks.select("key", "other", F.col("part").alias("b"), F.col("m").alias("mb"))
    met = near.join(a, ["key", "a"]).join(b, ["key", "other", "b"]).select(F.xxhash64("key", "a", "other", "b").alias("unit"), "slot", F.concat("ma", "mb").alias("m"))
    alone = a.where(F.size("ma") > 1).select(F.xxhash64("key", "a").alias("unit"), "slot", F.col("ma").alias("m"))
    return alone.unionByName(met)


def wanted(units: DataFrame) -> DataFrame:
    """(unit, slot, cid, comp, n, other, sig): the members of units that have a partner to be confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m, ends, _ = runs_of(batch)
            hit = np.zeros(len(m["n"]), bool)
            for i, j in partners(m["sig"], m["n"], m["comp"], m["slot"], m["other"], ends):
                hit[i] = hit[j] = True
            at = np.flatnonzero(hit)
            of = np.searchsorted(ends, at, "right") - 1
            flat = batch.column(2).flatten().take(pa.array(at))
            yield pa.record_batch([batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), *(flat.field(c) for c in ("cid", "comp", "n", "other", "sig"))], names=["unit", "slot", "cid", "comp", "n", "other", "sig"])
            tokens.release()

    return units.mapInArrow(run, "unit long, slot int, cid long, comp long, n long, other boolean, sig binary")


def joins(units: DataFrame) -> DataFrame:
    """(a, b): confirmed links of units(unit, slot, m with words) that join components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                m, ends, words = runs_of(batch.slice(r, 1))
                found = list(partners(m["sig"], m["n"], m["comp"], m["slot"], m["other"], ends))
                i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                sets = np.frombuffer(b"".join(words.to_pylist()), tokens.U)
                i, j = confirmed(sets, np.concatenate([[0], np.cumsum(m["n"])]), m["comp"], i, j)
                yield pa.record_batch([pa.array(m["cid"][i]), pa.array(m["cid"][j])], names=["a", "b"])
            tokens.release()

    return units.mapInArrow(run, "a long, b long")


def close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike; classes(cid, n, sig)."""
    side = lambda name: classes.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sig").alias(f"sig_{name}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n_a", "n_b", "sig_a", "sig_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.concatenate([batch.column(c).to_numpy() for c in (2, 3)])
            sig = np.concatenate([np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, COMPONENTS) for c in (4, 5)])
            at = np.arange(len(batch))
            yield batch.filter(pa.array(alike(sig, n, at, at + len(batch)))).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity; texts(cid, text)."""
    both = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in tokens.slices(batch.column(3)):
                part = batch.slice(s, e - s)
                # equal texts of one side stand together after the join, so each is hashed once a slice
                left = part.column(2).dictionary_encode()
                la, lo = tokens.shingle_sets(left.dictionary, K_WORDS)
                ra, ro = tokens.shingle_sets(part.column(3), K_WORDS)
                good = np.zeros(len(part), bool)
                for i, j in enumerate(left.indices.to_numpy()):
                    x, y = la[lo[j] : lo[j + 1]], ra[ro[i] : ro[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good[i] = 100 * both >= PERCENT * (len(x) + len(y) - both)
                yield part.filter(pa.array(good)).select(["a", "b"])
            tokens.release()

    return both.mapInArrow(check, "a long, b long")


def word_sets(texts: DataFrame) -> DataFrame:
    """(cid, words): the shingle hashes of each text as bytes; texts(cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, e in tokens.slices(batch.column(1)):
                sets, ends = tokens.shingle_sets(batch.column(1).slice(s, e - s), K_WORDS)
                yield pa.record_batch([batch.column(0).slice(s, e - s), pa.array([sets[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], names=["cid", "words"])
            tokens.release()

    return texts.mapInArrow(run, "cid long, words binary")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    base = materialize(signed(docs, doc_id, text), "signed")
    classes = base.where("n_shingles > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.min("doc_id").alias("low"), F.min("n_shingles").alias("n"), F.min("sig").alias("sig"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    keys = classes.select("cid", F.posexplode(chunk_keys(F.col("sig"))).alias("slot", "key")).repartition("key")
    sizes = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    once = materialize(keys.join(sizes, "key"), "shared-keys")
    # how many key neighbours a class has in all
    fame = once.groupBy("cid").agg(F.sum("k").alias("fame"))
    shared = materialize(once.join(fame, "cid").select("key", "slot", "cid", "fame"), "famed-keys")
    discard(once)
    lead = shared.groupBy("key").agg(F.max_by("cid", F.struct("fame", "cid")).alias("lead"))
    stars = shared.join(lead, "key").select(F.least("lead", "cid").alias("a"), F.greatest("lead", "cid").alias("b")).where("a <> b").distinct()
    stars = materialize(close(stars, classes), "star-pairs")

    def fetch(cids: DataFrame) -> DataFrame:
        need = cids.distinct().join(classes, "cid").select("cid", F.col("rep.doc_id").alias("rid"), F.col("rep.text_key").alias("rkey"))
        have = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
        have = have.withColumn("text_key", F.unhex(F.md5("text")))
        need = materialize(need, "needed")
        have = likely(have, F.col("text_key"), need, F.col("rkey"))
        return have.join(need, F.expr("text_key = rkey and doc_id <=> rid")).select("cid", "text").dropDuplicates(["cid"])

    ends = stars.select(F.col("a").alias("cid")).unionByName(stars.select(F.col("b").alias("cid")))
    texts = materialize(fetch(ends), "texts")
    links = materialize(confirm(stars, texts), "star-links")
    discard(texts, stars)
    parts = connected_components(links)
    at = shared.join(parts.select(F.col("id").alias("cid"), "component"), "cid", "left").select("key", "slot", "cid", F.coalesce("component", "cid").alias("comp"))
    split = at.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    mixed = materialize(at.join(split, "key").join(classes.select("cid", "n", "sig"), "cid").select("key", "slot", "cid", "comp", "n", "sig"), "mixed-keys")
    discard(shared)
    tried = materialize(wanted(blocks_of(mixed)), "wanted")
    discard(mixed)
    sets = materialize(word_sets(fetch(tried.select("cid"))), "word-sets")
    both = tried.join(sets, "cid")
    more = joins(both.groupBy("unit", "slot").agg(F.collect_list(F.struct("cid", "comp", "n", "other", "sig", "words")).alias("m")))
    more = materialize(more, "new-links")
    discard(tried, sets)
    parts = connected_components(links.unionByName(more))
    comp = classes.join(parts.select(F.col("id").alias("cid"), "component"), "cid", "left").select("cls", "low", F.coalesce("component", "cid").alias("comp"))
    least = comp.groupBy("comp").agg(F.min("low").alias("component_id"))
    comp = comp.join(materialize(least, "component-ids"), "comp").select("cls", "component_id")
    out = base.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("cls")).alias("cls")).join(comp, "cls", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
