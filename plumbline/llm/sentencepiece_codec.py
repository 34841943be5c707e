"""SentencePiece encoding and decoding: a batched Viterbi over a piece inventory, and an exact way back.

Words are cut where a run of spaces begins and around newlines (no piece crosses either; load checks that), each
distinct word of a task is encoded once, and words of one length advance together: for every piece length the
substring hashes of all words probe the sorted piece keys, and one vectorised maximum per end position stores the
back-pointers. Spaces are the pieces' U+2581. A character without a piece, and a literal U+2581, is written as its
UTF-8 bytes, so every text comes back exactly.

A unigram model's scores are used as they are. A BPE model holds merge ranks, not probabilities; its pieces then get
the log probability of Zipf's law at their rank, so ids are the best split under that law, not the merge order's.

Defined results. A null text counts as empty: no ids. Repeated rows get the same ids. No prefix space is added and
nothing is normalised. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm import tokens

U = tokens.U
SPACE, MARK = " ", "▁"
#: Distinct words whose ids a task keeps from one slice to the next.
CACHE_WORDS = 300_000
#: Longer words advance one by one, a step of positions at a time.
LONG, LONG_STEP = 256, 65_536
#: Words of one length are encoded in groups of about this many characters.
GROUP_CHARS = 1_000_000


class Pieces:
    """The inventory as arrays: fixed in size by the model file, so it is broadcast."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]) -> None:
        """pieces[i] is "" for ids that stand for no text; byte_ids[b] is the id of byte b."""
        for p in pieces:
            if len(p) > 1 and ("\n" in p or SPACE in p.lstrip(SPACE)):
                raise ValueError(f"a piece crosses a word: {p!r}")
        ids = [i for i, p in enumerate(pieces) if p]
        self.longest = max((len(pieces[i]) for i in ids), default=1)
        self.byte_ids = np.array(byte_ids, np.int32)
        place = tokens.stream(6, self.longest + 1) | U(1)
        keys = np.zeros(len(ids), U)
        for k, i in enumerate(ids):
            codes = np.array([ord(c) for c in pieces[i]], U)
            keys[k] = tokens.mix64(np.array([(tokens.mix64(codes + U(9)) * place[: len(codes)]).sum(dtype=U) + U(len(codes))]))[0]
        order = np.argsort(keys)
        self.place, self.keys, self.ids = place, keys[order], np.array(ids, np.int32)[order]
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one key")
        self.scores = np.array(scores, np.float64)[self.ids]
        self.missing = float(min(scores, default=0.0)) - 10.0
        raw = [p.encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def load(path: str) -> Pieces:
    """The pieces of a model file, read on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces, bytes_ = [""] * n, {}
    for i in range(n):
        if sp.is_byte(i):
            bytes_[int(sp.id_to_piece(i)[1:-1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = sp.id_to_piece(i).replace(MARK, SPACE)
    if len(bytes_) != 256:
        raise ValueError("the model has no byte pieces")
    scores = [sp.get_score(i) for i in range(n)]
    text_scores = [s for s, p in zip(scores, pieces, strict=True) if p]
    if all(s == round(s) for s in text_scores):  # merge ranks
        top = max(text_scores)
        scores = [-float(np.log(top - s + 2.0)) - 1.0 if p else 0.0 for s, p in zip(scores, pieces, strict=True)]
    return Pieces(pieces, scores, [bytes_[b] for b in range(256)])


def encode_words(p: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """codes[words, length]: (ids flat, how many each); an id below 0 is minus a code point to be written in bytes."""
    n, size = codes.shape
    value = tokens.mix64(codes.astype(U).ravel() + U(9)).reshape(n, size)
    longest = min(p.longest, size)
    best = np.full((n, size + 1), -np.inf)
    best[:, 0] = 0
    back, pick = np.zeros((n, size + 1), np.int32), np.zeros((n, size + 1), np.int32)
    scores, ids = [], []
    acc = np.zeros((n, size), U)
    for w in range(1, longest + 1):
        acc = acc[:, : size - w + 1] + value[:, w - 1 :] * p.place[w - 1]
        h = tokens.mix64((acc + U(w)).ravel())
        i = np.minimum(np.searchsorted(p.keys, h), len(p.keys) - 1)
        hit = p.keys[i] == h
        score, found = np.where(hit, p.scores[i], -np.inf).reshape(n, -1), np.where(hit, p.ids[i], 0).reshape(n, -1)
        if w == 1:
            other = np.isinf(score) | (codes == ord(MARK))
            score, found = np.where(other, p.missing, score), np.where(other, -codes.astype(np.int64), found)
        scores.append(score)
        ids.append(found)
    for j in range(1, size + 1):
        for w in range(min(j, longest), 0, -1):
            s = best[:, j - w] + scores[w - 1][:, j - w]
            better = s > best[:, j]
            best[better, j] = s[better]
            back[better, j] = w
            pick[better, j] = ids[w - 1][better, j - w]
    out = np.zeros((n, size), np.int32)
    rows, at, count = np.arange(n), np.full(n, size), np.zeros(n, np.int64)
    while len(rows):
        count[rows] += 1
        out[rows, size - count[rows]] = pick[rows, at]
        at = at - back[rows, at]
        rows, at = rows[at > 0], at[at > 0]
    keep = np.arange(size)[None, :] >= (size - count)[:, None]
    return out[keep], count


def encode_long(p: Pieces, codes: np.ndarray) -> np.ndarray:
    """As encode_words of one long word, such as a text without spaces: the same maxima, with the pieces that occur alone.

    The probes stay vectorised; positions then advance one by one over the few pieces that end there.
    """
    size = len(codes)
    value = tokens.mix64(codes.astype(U) + U(9))
    acc = np.zeros(size, U)
    found = []
    for w in range(1, min(p.longest, size) + 1):
        acc = acc[: size - w + 1] + value[w - 1 :] * p.place[w - 1]
        h = tokens.mix64(acc + U(w))
        i = np.minimum(np.searchsorted(p.keys, h), len(p.keys) - 1)
        at = np.flatnonzero(p.keys[i] == h)
        score, ids = p.scores[i[at]], p.ids[i[at]]
        if w == 1:
            all_score, all_ids = np.full(size, p.missing), -codes.astype(np.int32)
            known = codes[at] != ord(MARK)
            all_score[at[known]], all_ids[at[known]] = score[known], ids[known]
            at, score, ids = np.arange(size), all_score, all_ids
        found.append((at.astype(np.int32) + w, np.full(len(at), w, np.int32), score, ids.astype(np.int32)))
    end, width, score, ids = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((-width, end))
    end, width, score, ids = end[order], width[order], score[order], ids[order]
    best, back = [0.0], np.zeros(size + 1, np.int64)
    cuts = np.searchsorted(end, np.arange(1, size + 2, LONG_STEP))
    for a, b in zip(cuts, np.append(cuts[1:], len(end)), strict=True):
        last, top, place = 0, 0.0, 0
        for k, (j, w, s) in enumerate(zip(end[a:b].tolist(), width[a:b].tolist(), score[a:b].tolist(), strict=True), a):
            if j != last:
                if last:
                    best.append(top)
                    back[last] = place
                last, top = j, -np.inf
            s += best[j - w]
            if s > top:
                top, place = s, k
        if last:
            best.append(top)
            back[last] = place
    out, at = [], size
    while at:
        out.append(back[at])
        at -= width[back[at]]
    return ids[np.array(out[::-1], np.int64)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + counts[i] - 1, one run after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def expand_bytes(p: Pieces, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids below 0 replaced by those of their UTF-8 bytes."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, count
    chars = [p.byte_ids[list(chr(-int(i)).encode())] for i in ids[odd]]
    sizes = np.ones(len(ids), np.int64)
    sizes[odd] = [len(c) for c in chars]
    out = np.repeat(ids, sizes)
    first = np.cumsum(sizes) - sizes
    for at, c in zip(first[odd], chars, strict=True):
        out[at : at + len(c)] = c
    ends = np.cumsum(count)
    total = np.concatenate([[0], np.cumsum(sizes)])
    return out, total[ends] - total[ends - count]


class Encoder:
    """Encodes slices of texts and keeps the ids of words already seen."""

    def __init__(self, pieces: Pieces) -> None:
        self.p = pieces
        self.forget()

    def forget(self) -> None:
        self.known, self.at, self.n, self.pool = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        text = pc.fill_null(texts, "")
        ends = np.concatenate([[0], np.cumsum(pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64))])
        raw, _ = tokens.utf8(text)
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        space, line = codes == ord(SPACE), codes == ord("\n")
        new = np.zeros(len(codes), bool)
        new[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
        new[ends[:-1][ends[:-1] < len(codes)]] = True
        starts = np.flatnonzero(new)
        lengths = np.diff(np.append(starts, len(codes)))
        words = np.searchsorted(starts, ends)
        hashes = tokens.run_hashes(tokens.mix64(codes.astype(U) + U(1)), np.ones(len(codes), bool), starts)
        unique, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHE_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        fresh = np.flatnonzero(self.known[at] != unique) if len(self.known) else np.arange(len(unique))
        self.learn(codes, unique[fresh], starts[index[fresh]], lengths[index[fresh]])
        at = np.searchsorted(self.known, unique)[inverse]
        ids = self.pool[spread(self.at[at], self.n[at])]
        return ids, np.concatenate([[0], np.cumsum(self.n[at])])[words]

    def learn(self, codes: np.ndarray, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        pools, counts, order = [self.pool], [], []
        for size in np.unique(lengths):
            mine = np.flatnonzero(lengths == size)
            if size > LONG:
                for k in mine:
                    ids = encode_long(self.p, codes[starts[k] : starts[k] + size])
                    ids, count = expand_bytes(self.p, ids, np.array([len(ids)]))
                    pools.append(ids)
                    counts.append(count)
                    order.append(np.array([k]))
                continue
            step = max(1, GROUP_CHARS // int(size))
            for i in range(0, len(mine), step):
                part = mine[i : i + step]
                ids, count = encode_words(self.p, codes[starts[part][:, None] + np.arange(size)])
                ids, count = expand_bytes(self.p, ids, count)
                pools.append(ids)
                counts.append(count)
                order.append(part)
        if not order:
            return
        count, part = np.concatenate(counts), np.concatenate(order)
        at = len(self.pool) + np.cumsum(count) - count
        self.pool = np.concatenate(pools)
        known, where, n = np.append(self.known, hashes[part]), np.append(self.at, at), np.append(self.n, count)
        by = np.argsort(known)
        self.known, self.at, self.n = known[by], where[by], n[by]


def decode_ids(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of flat ids."""
    sizes = (p.raw_at[1:] - p.raw_at[:-1])[ids]
    raw = p.raw[spread(p.raw_at[ids], sizes)]
    ends = np.concatenate([[0], np.cumsum(sizes)])[offsets]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))


def encode(docs: DataFrame, pieces: Pieces, keep: list[str], text: str = "text") -> DataFrame:
    """docs' columns `keep` plus ids (array<int>), n_tokens and exact (the ids decode to the text itself)."""
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            for a, b in tokens.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                ids, offsets = coder.encode(part.column(at))
                same = pc.equal(decode_ids(coder.p, ids, offsets), pc.fill_null(part.column(at), "").cast(pa.large_string()))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([*part.columns[:at], lists, pa.array(np.diff(offsets)), same], names=[*keep, "ids", "n_tokens", "exact"])
            tokens.release()

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, f"{kinds}, ids array<int>, n_tokens long, exact boolean")


def decode(rows: DataFrame, pieces: Pieces, keep: list[str], ids: str = "ids", to: str = "text") -> DataFrame:
    """rows' columns `keep` plus the text of ids; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(pieces)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = decode_ids(shared.value, flat, np.concatenate([[0], np.cumsum(sizes)]))
            yield pa.record_batch([*batch.columns[:at], texts.cast(pa.string())], names=[*keep, to])

    return rows.select(*keep, rows[ids].alias("_ids")).mapInArrow(run, f"{kinds}, `{to}` string")
