"""Quality classifier: a linear-chain conditional random field that labels every line of a text good or bad.

A line is described by its own features and those of the lines beside it; two states and their transitions make the
chain. Forward-backward gives every line the probability of being good; their mean, weighted by the lines' lengths, and
a logistic curve fitted to it give the document's quality.

Only documents have labels. Training starts with every line labelled as its document and then, ROUNDS - 1 times, labels
those lines of bad documents good that the field holds to be good, unless all of them were. It runs on a sample of
SAMPLE labelled documents, those of the smallest hashes of their ids, whole texts, as long as they have SAMPLE_LINES
lines at most together; the sample does not grow with the corpus. Every text is scored whole, in one pass without a shuffle.

The chain of a slice of a partition is computed at once: lines are 2 x 2 matrices, their products a doubling scan, and a
text's first line a matrix that forgets what came before. So a text of n lines costs n log n.

Defined results. Null counts as an empty text, which is one empty line. Lines without characters weigh nothing, unless
a text has no others. Rows without a label are not trained on; a document with several labels trains once for each.
Without any labelled row every score is 0.5. Repeated rows get equal scores; an empty table gives none. Columns that are
not asked for may have any name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import materialize

#: Labelled documents that training sees at most, and their lines.
SAMPLE, SAMPLE_LINES = 4000, 200_000
#: Labellings of the lines; steps of each fit; weight of the squared weights.
ROUNDS, STEPS, RIDGE = 2, 80, 1e-4
#: Deviations that a feature counts at most.
FARTHEST = 3.0
#: Kinds of characters. Punctuation is what sentences have.
LOWER, UPPER, DIGIT, BLANK, MARK, SYMBOL, NEWLINE = range(7)
PUNCTUATION = ".,;:?'\"()-’“”«»¿¡"
FEATURES = [
    "length", "words", "upper", "digits", "blanks", "marks", "symbols", "doubled", "word_length", "short_words", "same_word", "distinct_words", "symbol_ends",
    "capital", "closed", "repeated", "empty", "mostly_upper", "many_symbols",
]
_KINDS: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point."""
    if not _KINDS:
        def kind(c: str) -> int:
            if c == "\n":
                return NEWLINE
            if c.isspace():
                return BLANK
            if c.isalpha():
                return UPPER if c.isupper() else LOWER
            return DIGIT if c.isdigit() else MARK if c in PUNCTUATION else SYMBOL

        _KINDS.append(np.fromiter((kind(chr(i)) for i in range(sys.maxunicode + 1)), np.int8, sys.maxunicode + 1))
    return _KINDS[0]


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([lines, FEATURES], characters of each line, line offsets of the texts); newlines end lines, so every text has one at least."""
    text = pc.fill_null(texts, "")
    sizes = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    # a newline behind every text closes its last line
    ends = np.cumsum(sizes + 1)
    raw = b"\n".join(x for x in text.cast(pa.binary()).to_pylist()) + b"\n" if len(text) else b""
    codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = kinds()[codes]
    stops = np.flatnonzero(kind == NEWLINE)
    starts = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
    offsets = np.searchsorted(stops, np.concatenate([[0], ends]) - 1, "left") + 1
    offsets[0] = 0
    n = (stops - starts).astype(np.float64)

    def inside(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return (sums[stops] - sums[starts]).astype(np.float64)

    count = {k: inside(kind == k) for k in (LOWER, UPPER, DIGIT, BLANK, MARK, SYMBOL)}
    same = np.append(False, codes[1:] == codes[:-1]) & ((kind == SYMBOL) | (kind == MARK))
    black = (kind != BLANK) & (kind != NEWLINE)
    w0 = np.flatnonzero(black & ~np.append(False, black[:-1]))
    w1 = np.flatnonzero(black & ~np.append(black[1:], False)) + 1
    line = np.searchsorted(stops, w0)
    words = np.bincount(line, minlength=len(stops)).astype(np.float64)
    per = lambda flags: np.bincount(line, weights=flags, minlength=len(stops))
    hashes = tokens.run_hashes(tokens.mix64(codes.astype(tokens.U) + tokens.U(1)), black, w0) if len(w0) else np.zeros(0, tokens.U)
    again = np.append(False, (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])) if len(w0) else np.zeros(0, bool)
    order = np.lexsort((hashes, line))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][new], minlength=len(stops)).astype(np.float64)
    lines = np.flatnonzero(n > 0)
    whole = np.zeros(len(stops), tokens.U)
    if len(lines):
        whole[lines] = tokens.run_hashes(tokens.mix64(codes.astype(tokens.U) + tokens.U(1)), kind != NEWLINE, starts[lines])
    owner = np.repeat(np.arange(len(sizes)), np.diff(offsets))
    order = np.lexsort((whole, owner))
    twin = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1]) if len(order) else np.zeros(0, bool)
    repeated = np.zeros(len(stops), bool)
    repeated[order[1:][twin]] = True
    repeated[order[:-1][twin]] = True
    full, letters = np.maximum(n, 1), np.maximum(count[LOWER] + count[UPPER], 1)
    some = np.maximum(words, 1)
    first, last = np.minimum(starts, np.maximum(stops - 1, 0)), np.maximum(stops - 1, starts)
    upper, symbols = count[UPPER] / letters, count[SYMBOL] / full
    out = [
        np.log1p(n), np.log1p(words), upper, count[DIGIT] / full, count[BLANK] / full, count[MARK] / full, symbols, inside(same) / full,
        (n - count[BLANK]) / some, per(w1 - w0 <= 3) / some, per(again) / some, distinct / some, per(kind[w1 - 1] == SYMBOL) / some,
        (kind[first] == UPPER) & (n > 0), (kind[last] == MARK) & (n > 0), repeated & (n > 0), n == 0, upper > 0.5, symbols > 0.05,
    ]
    return np.stack([x.astype(np.float64) for x in out], 1) if len(stops) else np.zeros((0, len(FEATURES))), n, offsets


def with_neighbours(x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and behind it (nothing at a text's ends), marks of the ends, and 1."""
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    opens, closes = np.zeros((len(x), 1)), np.zeros((len(x), 1))
    opens[offsets[:-1]], closes[offsets[1:] - 1] = 1, 1
    return np.hstack([x, before * (1 - opens), behind * (1 - closes), opens, closes, np.ones_like(opens)])


def scaled(x: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Features in deviations from their means; beyond FARTHEST they count as that, so a line unlike any seen is no outlier."""
    return np.clip((x - mean) / deviation, -FARTHEST, FARTHEST)


def scan(steps: np.ndarray, longest: int) -> np.ndarray:
    """[lines, 2]: the direction of the product of the matrices up to each, for rows that start from (1, 1).

    Doubling: after k rounds each place holds the product of the 2**k matrices up to it. Every text's first matrix has equal
    rows, so what stands before it makes no difference to directions.
    """
    out, reach = steps / steps.max((1, 2), keepdims=True), 1
    while reach < longest:
        a, b = out[:-reach], out[reach:]
        ahead = np.empty_like(b)
        for i in range(2):
            for j in range(2):
                ahead[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
        out = np.concatenate([out[:reach], ahead / ahead.max((1, 2), keepdims=True)])
        reach *= 2
    both = out.sum(1)
    return both / both.sum(1, keepdims=True)


@dataclass(frozen=True)
class Model:
    """Means and deviations of the features, weights of a good line, transition weights [before, here], and the curve (slope, level)."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]


def marginals(emit: np.ndarray, moves: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability that each line is good, [lines, 2, 2] of the states before it and its own, nothing for first lines).

    emit is the weight of good against bad.
    """
    own = np.stack([np.ones_like(emit), np.exp(np.clip(emit, -30, 30))], 1)
    own /= own.max(1, keepdims=True)
    first = np.zeros(len(emit), bool)
    first[offsets[:-1]] = True
    move = np.where(first[:, None, None], 1.0, np.exp(moves)[None])
    longest = int(np.diff(offsets).max()) if len(offsets) > 1 else 1
    ahead = scan(move * own[:, None, :], longest)
    # backwards: the step from a line to the next one, nothing behind a text's last line
    last = np.zeros(len(emit), bool)
    last[offsets[1:] - 1] = True
    after = np.roll(np.swapaxes(move * own[:, None, :], 1, 2), -1, axis=0)
    after[last] = 1.0
    back = scan(after[::-1], longest)[::-1]
    both = ahead * back
    good = both[:, 1] / both.sum(1)
    pair = np.zeros((len(emit), 2, 2))
    pair[1:] = ahead[:-1, :, None] * (move * own[:, None, :])[1:] * back[1:, None, :]
    pair[first] = 0
    pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return good, pair


def fit_weights(x: np.ndarray, offsets: np.ndarray, labels: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights, the four moves last, that make the labels of the lines likely: gradient steps of adaptive size from w, on a concave function."""
    n = max(len(x), 1)
    second = np.ones(len(x), bool)
    second[offsets[:-1]] = False
    at = np.flatnonzero(second)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1.0)
    slope, size = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        good, pair = marginals(x @ w[:-4], w[-4:].reshape(2, 2), offsets)
        g = np.concatenate([x.T @ (labels - good), (seen - pair.sum(0)).ravel()]) / n - 2 * RIDGE * w
        slope, size = 0.9 * slope + 0.1 * g, 0.999 * size + 0.001 * g * g
        w = w + 0.1 * (slope / (1 - 0.9**t)) / (np.sqrt(size / (1 - 0.999**t)) + 1e-8)
    return w


def document_means(good: np.ndarray, chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The mean of the lines' probabilities, weighted by their characters."""
    flat = np.repeat(np.add.reduceat(chars, offsets[:-1]) == 0, np.diff(offsets)) if len(offsets) > 1 else np.zeros(0, bool)
    weight = np.where(flat, 1.0, chars)
    return np.add.reduceat(weight * good, offsets[:-1]) / np.add.reduceat(weight, offsets[:-1]) if len(offsets) > 1 else np.zeros(0)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_curve(means: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, level) of the logistic curve from a document's mean to its label, by Newton's steps, held near (1, 0)."""
    x, c = np.stack([logit(means), np.ones(len(means))], 1), np.array([1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        pull = np.eye(2) * (1e-3 * len(x) + 1)
        c = c + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pull, x.T @ (labels - p) - pull @ (c - [1.0, 0.0]))
    return max(float(c[0]), 1e-3), float(c[1])


def fit(x: np.ndarray, chars: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> Model:
    """The model of texts with their lines' features, and a label, 0 or 1, for each text."""
    wide = with_neighbours(x, offsets)
    mean, deviation = wide.mean(0), wide.std(0)
    mean[-1], deviation = 0, np.where(deviation > 1e-9, deviation, 1)
    z = scaled(wide, mean, deviation)
    of_text = np.repeat(labels, np.diff(offsets))
    lines, w = of_text.astype(int), np.zeros(z.shape[1] + 4)
    for k in range(ROUNDS):
        w = fit_weights(z, offsets, lines, w)
        weights, moves = w[:-4], w[-4:].reshape(2, 2)
        good, _ = marginals(z @ weights, moves, offsets)
        if k + 1 < ROUNDS:
            held = (good > 0.5) & (of_text == 0)
            all_good = np.repeat(np.logical_and.reduceat(good > 0.5, offsets[:-1]), np.diff(offsets))
            lines = np.where(held & ~all_good, 1, of_text).astype(int)
    return Model(mean, deviation, weights, moves, fit_curve(document_means(good, chars, offsets), labels))


def judge(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each text, probability that each line is good, line offsets)."""
    x, chars, offsets = line_features(texts)
    if not len(x):
        return np.zeros(0), np.zeros(0), offsets
    good, _ = marginals(scaled(with_neighbours(x, offsets), model.mean, model.deviation) @ model.weights, model.moves, offsets)
    slope, level = model.curve
    return 1 / (1 + np.exp(-np.clip(slope * logit(document_means(good, chars, offsets)) + level, -30, 30))), good, offsets


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> Model | None:
    """The model of the labelled documents, or None if there are none; labels(doc_id, label) holds 0 or 1."""
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    some = usable.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "label").limit(SAMPLE)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # SAMPLE rows at most
    sample = materialize(rows.join(F.broadcast(some), "doc_id").withColumn("lines", F.size(F.split("text", "\n", -1))), "quality-sample")
    order = ["h", "doc_id", "label"]
    upto = sample.select(*order, "lines").orderBy(*order).limit(SAMPLE).toPandas()
    if not len(upto):
        return None
    keep = int((upto["lines"].cumsum() <= SAMPLE_LINES).sum()) or 1

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column(0)):
                part = batch.slice(a, b - a)
                x, chars, offsets = line_features(part.column(0))
                lists = lambda v, o: pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v))
                yield pa.record_batch([*part.columns[1:], lists(x.ravel(), offsets * len(FEATURES)), lists(chars, offsets)], names=["h", "doc_id", "label", "x", "chars"])
            tokens.release()

    kept = sample.orderBy(*order).limit(keep).select("text", *order)
    kind = kept.schema["doc_id"].dataType.simpleString()
    got = kept.mapInArrow(describe, f"h long, doc_id {kind}, label int, x array<double>, chars array<double>").toPandas().sort_values(order, kind="stable")
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in got["chars"]])]).astype(np.int64)
    return fit(np.concatenate(list(got["x"])).reshape(-1, len(FEATURES)), np.concatenate(list(got["chars"])), offsets, got["label"].to_numpy(np.int64))


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", with_lines: bool = True) -> DataFrame:
    """(doc_id, score[, lines]) of every row of docs; labels(doc_id, label) teach. lines: the probability that each line is good."""
    model = train(docs, labels, doc_id, text, label)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    if model is None:
        lines: Column = F.transform(F.split("text", "\n", -1), lambda x: F.lit(0.5)).alias("lines")
        return rows.select("doc_id", F.lit(0.5).alias("score"), *([lines] if with_lines else []))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in tokens.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                scores, good, offsets = judge(model, part.column(1))
                more = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(good))] if with_lines else []
                yield pa.record_batch([part.column(0), pa.array(scores), *more], names=["doc_id", "score", *(["lines"] if with_lines else [])])
            tokens.release()

    return rows.mapInArrow(score, f"doc_id {kind}, score double" + (", lines array<double>" if with_lines else ""))
