"""Language ID: interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Texts are lower-cased and cut into words of letters; a word is modelled with a mark on either side, by characters of
up to ORDER - 1 predecessors. Counting runs over all training rows: tasks count n-grams of their rows and Spark sums
them and their continuation counts. The summed model, every n-gram of it, is broadcast as sorted arrays. A text gets
the language of the lowest cross-entropy per character. Confidence is a softmax whose temperature, and rejection is a
limit of entropy, both fitted on the training rows' own scores.

Defined results. A text that is null, empty or has no letter is `und` with score 0 and rejected. Rows without a
language are not trained on. Without any training row every text is `und`. Ties between languages fall to the one
first by code point. Repeated rows get one and the same result. An empty table gives no rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import materialize

ORDER = 4
UND = "und"
TEMPERATURES = (0.05, 0.1, 0.2, 0.5, 1.0, 2.0)
#: Rejection: entropy above the language's mean by so many deviations, which shrink with the root of the length, and bits.
REJECT_DEVIATIONS, REJECT_BITS = 6.0, 1.0
#: Words that a task gathers before it counts them, or whose scores it keeps; and how many are worked on at once.
CACHE_WORDS = 100_000
WORDS_AT_ONCE = 15_000
U = tokens.U
_KINDS: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case) by code point."""
    if not _KINDS:
        n = sys.maxunicode + 1
        lower = ((i, chr(i).lower()) for i in range(n))
        _KINDS.append(np.fromiter((chr(i).isalpha() for i in range(n)), bool, n))
        _KINDS.append(np.fromiter((ord(x) if len(x) == 1 else i for i, x in lower), np.int32, n))
    return _KINDS[0], _KINDS[1]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased code points, word starts, word lengths, word offsets of the texts)."""
    letter, lower = _tables()
    text = pc.fill_null(texts, "")
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    raw, _ = tokens.utf8(text)
    codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    keep = letter[codes]
    starts, words = tokens.run_ids(keep, offsets)
    ends = np.flatnonzero(keep & ~np.append(keep[1:], False))
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(codes))]
    cut = np.unique(inner[keep[inner - 1] & keep[inner]]) - 1 if len(inner) else inner
    ends = np.union1d(ends, cut)
    return lower[codes], starts, ends - starts + 1, words


def unique_words(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each distinct word, where it first occurs, the distinct word of each word)."""
    keep = np.zeros(len(codes) + 1, np.int8)
    keep[starts] += 1
    keep[starts + lengths] -= 1
    hashes = tokens.run_hashes(tokens.mix64(codes.astype(U) + U(1)), np.cumsum(keep[:-1]) > 0, starts)
    return np.unique(hashes, return_index=True, return_inverse=True)


def ngrams(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at every predicted symbol of the given words, each between two marks (code 0).

    Returns ([hashes of order 0 .. ORDER], word of each position, order available at it). Every word gives its letters and the
    end mark as predicted symbols; position 1 follows the opening mark.
    """
    reach = lengths + 2
    total = int(reach.sum())
    word = np.repeat(np.arange(len(starts)), reach)
    first = np.concatenate([[0], np.cumsum(reach)[:-1]]).astype(np.int64)
    at = np.arange(total) - first[word]
    inside = (at > 0) & (at <= lengths[word])
    flat = np.zeros(total, U)
    flat[inside] = codes[(starts[word] + at - 1)[inside]].astype(U)
    value = tokens.mix64(flat + U(7))
    place = tokens.stream(5, ORDER + 1) | U(1)
    out, acc = [np.full(total, U(1))], np.zeros(total, U)
    for n in range(1, ORDER + 1):
        acc = acc.copy()
        acc[n - 1 :] += value[: total - n + 1] * place[n - 1]
        out.append(tokens.mix64(acc + place[ORDER : ORDER + 1] * U(n)))
    return out, word, at


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, n, h, prefix, suffix, opens, k): n-gram counts of rows(text, lang); opens = starts with the opening mark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        seen: dict[str, list[tuple]] = {}  # by language: distinct words of the slices so far

        def merge(parts: list[np.ndarray]) -> np.ndarray:
            all_ = np.concatenate(parts)
            order = np.argsort(all_["h"], kind="stable")
            all_ = all_[order]
            new = np.flatnonzero(np.append(True, all_["h"][1:] != all_["h"][:-1])) if len(all_) else np.zeros(0, int)
            out = all_[new].copy()
            out["k"] = np.add.reduceat(all_["k"], new) if len(new) else 0
            return out

        kind = np.dtype([("h", U), ("prefix", U), ("suffix", U), ("opens", bool), ("k", np.int64)])

        def count_words(lang: str) -> None:
            """Turns the distinct words gathered for a language into n-grams."""
            parts = seen.pop(lang)
            sizes = np.concatenate([p[1] for p in parts])
            codes, starts = np.concatenate([p[2] for p in parts]), np.cumsum(sizes) - sizes
            _, index, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
            times = np.bincount(inverse, weights=np.concatenate([p[3] for p in parts])).astype(np.int64)
            for i in range(0, len(index), WORDS_AT_ONCE):
                some = index[i : i + WORDS_AT_ONCE]
                grams, word, at = ngrams(codes, starts[some], sizes[some])
                for n in range(1, ORDER + 1):
                    j = np.flatnonzero((at >= 1) & (at >= n - 1))
                    x = np.zeros(len(j), kind)
                    x["h"], x["prefix"], x["suffix"] = grams[n][j], grams[n - 1][j - 1] if n > 1 else U(1), grams[n - 1][j]
                    x["opens"], x["k"] = at[j] == n - 1, times[i + word[j]]
                    held[lang, n] = [merge([*held.get((lang, n), []), merge([x])])]

        for batch in batches:
            for a, b in tokens.slices(batch.column(0)):
                part = batch.slice(a, b - a)
                codes, starts, lengths, offsets = words_of(part.column(0))
                langs = part.column(1).to_pylist()
                owner = np.repeat(np.arange(len(langs)), np.diff(offsets))
                for lang in sorted(set(langs)):
                    mine = np.array([x == lang for x in langs])[owner] if len(owner) else np.zeros(0, bool)
                    if not mine.any():
                        continue
                    s, w = starts[mine], lengths[mine]
                    hashes, index, inverse = unique_words(codes, s, w)
                    s, w = s[index], w[index]
                    flat = codes[np.arange(w.sum()) + np.repeat(s - (np.cumsum(w) - w), w)]
                    seen.setdefault(lang, []).append((hashes, w, flat, np.bincount(inverse)))
                    if sum(len(p[0]) for p in seen[lang]) > CACHE_WORDS:
                        count_words(lang)
            tokens.release()
        for lang in sorted(seen):
            count_words(lang)
        for (lang, n), parts in held.items():
            x = merge(parts)
            signed = lambda c: pa.array(np.ascontiguousarray(x[c]).view(np.int64))  # noqa: B023, E731
            yield pa.record_batch([pa.array([lang] * len(x), pa.string()), pa.array([n] * len(x), pa.int32()), signed("h"), signed("prefix"), signed("suffix"), pa.array(x["opens"]), pa.array(x["k"])], names=["lang", "n", "h", "prefix", "suffix", "opens", "k"])

    counts = rows.select("text", "lang").mapInArrow(count, "lang string, n int, h long, prefix long, suffix long, opens boolean, k long")
    return counts.groupBy("lang", "n", "h", "prefix", "suffix", "opens").agg(F.sum("k").alias("k"))


class SortedTable:
    """Sorted 64-bit hashes with a row of values each.

    The hashes are uniform, so their leading bits say nearly where one stands: an index over them leaves a step or two
    to look, not a binary search.
    """

    def __init__(self, keys: np.ndarray, **values: np.ndarray) -> None:
        self.keys, self.values = keys, values
        bits = max(1, int(len(keys)).bit_length())
        self.shift = U(64 - bits)
        self.index = np.searchsorted(keys, np.arange(1 << bits, dtype=U) << self.shift).astype(np.int32)

    def find(self, want: np.ndarray) -> np.ndarray:
        """The place of each hash, or that past the last if it is missing."""
        n = len(self.keys)
        if not n:
            return np.zeros(len(want), np.int32)
        at = self.index[want >> self.shift]
        open_ = np.arange(len(want))
        while len(open_):
            i = at[open_]
            less = (i < n) & (self.keys[np.minimum(i, n - 1)] < want[open_])
            open_ = open_[less]
            at[open_] += 1
        return np.where(self.keys[np.minimum(at, n - 1)] == want, np.minimum(at, n), n)


class Model:
    """langs, and per order one table: "p" discounted probabilities of the n-gram, "g" its back-off weight as a context.

    The values end in a row for missing hashes: probability 0, weight 1.
    """

    def __init__(self, langs: list[str], tables: dict[int, SortedTable], base: np.ndarray) -> None:
        self.langs, self.tables, self.base = langs, tables, base

    def bits(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """[words, languages] of total bits of each word."""
        if not len(starts):
            return np.zeros((0, len(self.langs)))
        hashes, word, at = ngrams(codes, starts, lengths)
        p = np.repeat(self.base[None, :], len(word), 0)
        before = np.zeros(len(word), np.int32)  # the one context of order 0
        for n in range(1, ORDER + 1):
            place, values = self.tables[n].find(hashes[n]), self.tables[n].values["p"]
            can = at >= max(n - 1, 1)
            q = p * self.tables[n - 1].values["g"][np.append(len(self.tables[n - 1].keys), before[:-1])] + values[place]
            p = np.where(can[:, None], q, p)
            before = place
        cost = -np.log2(np.maximum(p, 1e-12))
        cost[at == 0] = 0
        return np.add.reduceat(cost, np.flatnonzero(at == 0), axis=0)


def fit(rows: DataFrame) -> Model:
    """Models of the languages in rows(text, lang), by counts over all of them."""
    grams = materialize(count_grams(rows.where("lang is not null")), "grams")
    lefts = grams.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suffix").alias("h")).agg(F.count("*").alias("left"))
    raw = (F.col("n") == ORDER) | F.col("opens")
    adj = grams.join(lefts, ["lang", "n", "h"], "left").withColumn("c", F.when(raw, F.col("k")).otherwise(F.coalesce("left", "k")).cast("double"))
    adj = materialize(adj, "adjusted")
    few = adj.groupBy("lang", "n").agg(F.sum((F.col("c") == 1).cast("long")).alias("n1"), F.sum((F.col("c") == 2).cast("long")).alias("n2"))
    few = few.select("lang", "n", F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2.0 * F.col("n2"))).otherwise(0.5).alias("d0")).select("lang", "n", F.least("d0", F.lit(0.9)).alias("d"))
    ctx = adj.groupBy("lang", "n", "prefix").agg(F.sum("c").alias("tot"), F.count("*").alias("kinds"))
    ctx = ctx.join(F.broadcast(few), ["lang", "n"])
    gamma = ctx.select("lang", "n", F.col("prefix").alias("h"), (F.col("d") * F.col("kinds") / F.col("tot")).alias("v"))
    alpha = adj.join(ctx, ["lang", "n", "prefix"]).select("lang", "n", "h", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("tot")).alias("v"))
    a, g = alpha.toPandas(), gamma.toPandas()
    langs = sorted(set(a["lang"]), key=lambda s: s.encode())

    def filled(x: object, keys: np.ndarray, missing: float) -> np.ndarray:
        out = np.full((len(keys) + 1, len(langs)), missing, np.float32)
        columns = x["lang"].map({s: i for i, s in enumerate(langs)}).to_numpy(int)
        out[np.searchsorted(keys, x["h"].to_numpy(np.int64).view(U)), columns] = x["v"].to_numpy(np.float32)
        return out

    tables = {}
    for n in range(ORDER + 1):
        mine, contexts = a[a["n"] == n], g[g["n"] == n + 1]
        keys = np.unique(np.concatenate([mine["h"].to_numpy(np.int64), contexts["h"].to_numpy(np.int64)]).view(U))
        tables[n] = SortedTable(keys, p=filled(mine, keys, 0.0), g=filled(contexts, keys, 1.0))
    kinds = max(2, len(tables[1].keys))
    return Model(langs, tables, np.full(len(langs), 1.0 / (4 * kinds)))


def entropies(rows: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """rows' columns `keep` plus n (predicted characters) and bits (array<double> of bits per character, by language)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    width = len(model.langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known, costs = np.zeros(0, U), np.zeros((0, width), np.float32)
        for batch in batches:
            for a, b in tokens.slices(batch.column(len(keep))):
                part = batch.slice(a, b - a)
                codes, starts, lengths, offsets = words_of(part.column(len(keep)))
                hashes, index, inverse = unique_words(codes, starts, lengths)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                have = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                new = np.flatnonzero(~have)
                parts = [index[new[i : i + WORDS_AT_ONCE]] for i in range(0, max(len(new), 1), WORDS_AT_ONCE)]
                fresh = np.concatenate([m.bits(codes, starts[p], lengths[p]) for p in parts]).astype(np.float32)
                cost = np.zeros((len(hashes), width), np.float32)
                cost[have], cost[new] = costs[at[have]], fresh
                known, costs = (hashes, cost) if len(known) + len(new) > CACHE_WORDS else (np.append(known, hashes[new]), np.concatenate([costs, fresh]))
                order = np.argsort(known)
                known, costs = known[order], costs[order]
                sums = np.zeros((len(inverse) + 1, width))
                sums[1:] = np.cumsum(cost[inverse], axis=0, dtype=np.float64) if len(inverse) else 0
                size = np.concatenate([[0], np.cumsum(lengths + 1)])
                n = size[offsets[1:]] - size[offsets[:-1]]
                per = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)[:, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), pa.array(per.ravel()))
                yield pa.record_batch([*part.columns[: len(keep)], pa.array(n, pa.int64()), lists], names=[*keep, "n", "bits"])
            tokens.release()

    return rows.select(*keep, F.col(text).alias("_text")).mapInArrow(score, f"{kinds}, n long, bits array<double>")


def identify(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, trained, lang_pred, score, rejected, entropy) for every row; rows where `train` holds teach the models."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.coalesce(train, F.lit(False)).alias("trained"))
    model = fit(rows.where("trained").select("text", "lang"))
    if not model.langs:
        return rows.select("doc_id", "trained", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("entropy"))
    names = F.array(*map(F.lit, model.langs))
    got = materialize(entropies(rows, model, ["doc_id", "lang", "trained"]), "entropies")
    best = F.array_min("bits")
    got = got.withColumn("entropy", best).withColumn("i", F.array_position("bits", best).cast("int")).withColumn("lang_pred", F.element_at(names, F.col("i")))
    taught = got.where("trained and lang is not null and n > 0")
    odds = lambda t: F.aggregate("bits", F.lit(0.0), lambda s, b: s + F.pow(F.lit(2.0), (F.col("entropy") - b) * F.col("n") * t))
    right = F.element_at("bits", F.array_position(names, F.col("lang")).cast("int"))
    loss = [F.avg((right - F.col("entropy")) * F.col("n") * t + F.log2(odds(t))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    losses = taught.agg(*loss).first()
    heat = min(TEMPERATURES, key=lambda t: losses[TEMPERATURES.index(t)] if losses[0] is not None else 0)
    means = taught.groupBy(F.col("lang_pred").alias("l")).agg(F.avg("entropy").alias("mean"))
    spread = taught.join(F.broadcast(means), F.col("lang_pred") == F.col("l")).groupBy("l", "mean").agg(F.sqrt(F.avg(F.pow(F.col("entropy") - F.col("mean"), 2) * F.col("n"))).alias("sd"))
    out = got.join(F.broadcast(spread), F.col("lang_pred") == F.col("l"), "left")  # one row per learned language
    limit = F.col("mean") + REJECT_DEVIATIONS * F.col("sd") / F.sqrt("n") + REJECT_BITS
    found = F.col("n") > 0
    return out.select(
        "doc_id", "trained", F.when(found, F.col("lang_pred")).otherwise(UND).alias("lang_pred"),
        F.when(found, 1.0 / odds(heat)).otherwise(0.0).alias("score"),
        (~found | F.coalesce(F.col("entropy") > limit, F.lit(False))).alias("rejected"),
        F.when(found, F.col("entropy")).alias("entropy"),
    )
