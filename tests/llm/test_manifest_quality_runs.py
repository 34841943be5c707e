"""Operators 11 to 13 against brute force: Merkle manifest, quality by a conditional random field, periodic runs."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import merkle_manifest, periodic_runs, quality_crf, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_lower(text: str | None) -> str | None:
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf_of(row: dict, text: str | None) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in [row[f] for f in FIELDS[:4]] + [text]))


def tree_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path_of(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        a = i - i % 8
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + 8])))
        i //= 8
    return out


def brute_manifest(rows: list[dict]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[g] = tree_of([leaf_of(r, r["text"]) for r in groups[g]])
    top = tree_of([trees[g][-1][0] for g in langs]) if langs else []
    out = []
    for j, g in enumerate(langs):
        for i, r in enumerate(groups[g]):
            path = path_of(trees[g], i) + path_of(top, j)
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            h = leaf_of(r, ascii_lower(r["text"]) if tampered else r["text"])
            for before, after in path:
                h = sha(before + h + after)
            out.append((r["doc_id"], leaf_of(r, r["text"]), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(spark, rows: list[dict], columns: str = SCHEMA):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], columns) if rows else spark.createDataFrame([], columns)
    claimed = F.when(queries.id_crc() % 3 == 0, merkle_manifest.digest(*map(F.col, FIELDS[:4]), F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return merkle_manifest.manifest(docs, FIELDS, claimed=claimed)


def some_rows(n: int, langs: list, seed: int) -> list[dict]:
    rng = random.Random(seed)
    pick = lambda v, share: None if rng.random() < share else v
    rows = [{"doc_id": pick(rng.randrange(n), 0.05), "text": pick("Ab é😀\n" * rng.randrange(4), 0.1), "lang": rng.choice(langs), "source": pick("s1", 0.2), "n_chars": pick(i, 0.2)} for i in range(n)]
    return rows + rows[: n // 4]  # repeated rows


@pytest.mark.parametrize(("levels", "n", "langs"), [(3, 60, ["en", None, "", "é", "zz"]), (1, 300, ["en", "en", "en", None, "de"]), (1, 90, [f"l{i}" for i in range(30)])])
def test_manifest_is_that_of_brute_force(spark, monkeypatch, levels, n, langs):
    """Nulls, repeated ids and rows, a hot group, several rounds of blocks, more groups than one run holds."""
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8**levels)
    monkeypatch.setattr(merkle_manifest, "ROWS_EACH", 50)
    rows = some_rows(n, langs, n)
    got = sorted((tuple(r) for r in manifest_of(spark, rows).collect()), key=str)
    assert got == brute_manifest(rows)
    assert any(not r[6] for r in got)


def test_manifest_of_one_row_none_and_clashing_columns(spark):
    one = [{"doc_id": 5, "text": "X" * 2_000_000, "lang": None, "source": None, "n_chars": None}]
    assert [tuple(r) for r in manifest_of(spark, one).collect()] == brute_manifest(one)
    assert manifest_of(spark, []).count() == 0
    clash = [{**r, "place": 1, "node": "n", "_group": "g", "path": "p", "block": 2} for r in some_rows(20, ["a", "b"], 3)]
    got = sorted((tuple(r) for r in manifest_of(spark, clash, SCHEMA + ", place int, node string, _group string, path string, block int").collect()), key=str)
    assert got == brute_manifest([{k: r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")} for r in clash])


def brute_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    found: dict = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def without(words: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone).decode()


def texts_with_periods(seed: int) -> list[str]:
    rng, out = random.Random(seed), []
    for _ in range(rng.randint(1, 6)):
        n, kinds = rng.choice([0, 1, 5, 6, 7, 20, 60, 130, 300, 700]), rng.choice([1, 2, 3, 30])
        words = [str(rng.randrange(kinds)) for _ in range(n)]
        for _ in range(rng.randint(0, 4) if n >= 8 else 0):
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 4))
            for i in range(a + p, rng.randint(a, n)):
                words[i] = words[i - p]
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_those_of_brute_force(seed):
    texts = texts_with_periods(seed)
    n, runs, left = periodic_runs._texts(pa.array(texts), 6)
    for i, t in enumerate(texts):
        words = t.encode().split()
        want = brute_runs(words)
        assert [tuple(r.values()) for r in runs[i].as_py()] == want
        assert left[i].as_py() == without(words, want)
        assert n[i] == len(words)


@pytest.mark.parametrize(("word", "runs"), [(["a"], [(0, 200_000, 1)]), (["a", "b"], [(0, 200_000, 2)]), (["a", "b", "a"], [(0, 199_998, 3)])])
def test_runs_of_long_texts(word, runs):
    """A text of one period costs no more than n log n."""
    words = word * (200_000 // len(word))
    _, got, left = periodic_runs._texts(pa.array([" ".join(words)]), 6)
    assert [tuple(r.values()) for r in got[0].as_py()] == runs
    assert left[0].as_py() == " ".join(word)


def test_runs_of_rows(spark):
    """Null and empty texts, repeated rows, blanks of other scripts (no blanks here), clashing columns, an empty table."""
    repeat = "x y " * 6
    rows = [(1, None, "r"), (2, "", "r"), (None, repeat, "r"), (3, repeat, "r"), (3, repeat, "r"), (4, "a a " * 3, "r"), (5, "a\x0ba\x0ca\ta\na\ra", "r")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()), key=str)
    want = [(1, 0, [], ""), (2, 0, [], ""), *[(i, 12, [(0, 12, 2)], "x y") for i in (None, 3, 3)], (4, 3, [], "a a a a a a"), (5, 6, [(0, 6, 1)], "a")]
    assert got == sorted(want, key=str)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_planted_periods(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 40))) for i in range(200)] + [(0, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", queries.planted(F.coalesce("text", F.lit(""))).alias("t")).collect()
    changed = 0
    for (i, text), r in zip(rows, got, strict=True):
        h, words = zlib.crc32(str(i).encode()), (text or "").split()
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
            changed += 1
        assert r.t.split() == words
    assert changed > 5


def brute_chain(emit: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals by all sequences of states."""
    total = np.zeros((len(emit), 2))
    for states in itertools.product((0, 1), repeat=len(emit)):
        weight = np.exp(sum(e for e, s in zip(emit, states, strict=True) if s) + sum(moves[a, b] for a, b in itertools.pairwise(states)))
        for i, s in enumerate(states):
            total[i, s] += weight
    return total[:, 1] / total.sum(1)


def test_marginals_are_those_of_all_sequences():
    rng = np.random.default_rng(5)
    sizes = [1, 2, 7, 1, 10, 3]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    emit, moves = rng.normal(0, 3, offsets[-1]), rng.normal(0, 2, (2, 2))
    good, pair = quality_crf.marginals(emit, moves, offsets)
    for a, b in itertools.pairwise(offsets):
        assert np.allclose(good[a:b], brute_chain(emit[a:b], moves))
        assert np.allclose(pair[a + 1 : b].sum(1)[:, 1], good[a + 1 : b])  # the states before and here sum to here's
        assert np.allclose(pair[a + 1 : b].sum(2)[:, 1], good[a : b - 1])
        assert (pair[a] == 0).all()


def test_weights_meet_the_slope_of_the_likelihood():
    """At the fitted weights, expected and seen features agree, up to the pull of the squared weights."""
    rng = np.random.default_rng(1)
    offsets = np.arange(0, 401, 8)
    x = np.hstack([rng.normal(size=(400, 2)), np.ones((400, 1))])
    labels = (x[:, 0] + rng.normal(0, 1, 400) > 0).astype(int)
    w = np.zeros(7)
    for _ in range(6):
        w = quality_crf.fit_weights(x, offsets, labels, w)
    good, _ = quality_crf.marginals(x @ w[:-4], w[-4:].reshape(2, 2), offsets)
    assert np.abs(x.T @ (labels - good) / 400).max() < 0.01


def test_line_features_do_not_depend_on_the_texts_around():
    texts = ["", "One line.", "A\n\nB b b###\nA", None, "\n", "é" * 50 + "\n" + "X!! " * 9, "　 \t"]
    together, chars, offsets = quality_crf.line_features(pa.array(texts, pa.string()))
    assert list(np.diff(offsets)) == [(t or "").count("\n") + 1 for t in texts]
    for i, t in enumerate(texts):
        alone, n, _ = quality_crf.line_features(pa.array([t], pa.string()))
        assert np.allclose(together[offsets[i] : offsets[i + 1]], alone)
        assert list(n) == [len(s) for s in (t or "").split("\n")]


def test_quality_of_held_out_documents(spark):
    """Over 0.98 right on documents that training never sees, empty texts scored, a text in one line of 300,000 characters too."""
    got = queries.op12_quality_crf(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 50
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_quality_of_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and labels, lines of an all-bad text, clashing columns, no labels, no rows."""
    good, bad = "The words of a line go on.\nSo do these, and more.", "BUY!! NOW!! ### $$$\n@@@ ### !!! NOW!!"
    rows = [(i, good if i % 2 else bad) for i in range(60)] + [(60, None), (61, ""), (62, "\n\n"), (63, bad + "\n" + good), (64, "\n".join([bad] * 5000)), (65, "NOW!! " * 100_000), (None, good), (1, good)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, i % 2, "q") for i in range(60)] + [(1, 1, "q"), (2, None, "q"), (None, 1, "q")], "doc_id long, quality int, text string")
    got = [(r.doc_id, r.score, list(r.lines)) for r in quality_crf.quality(docs, labels).collect()]
    assert len(got) == len(rows)
    by = {i: (s, lines) for i, s, lines in got}
    assert by[1][0] > 0.8 > 0.2 > by[2][0]
    assert by[64][0] < 0.3 and len(by[64][1]) == 10_000
    assert 0 <= by[65][0] <= 1
    assert [len(by[i][1]) for i in (60, 61, 62, 63)] == [1, 1, 3, 4]
    assert by[None][0] == by[1][0]
    assert by[63][1][0] < by[63][1][-1]
    none = quality_crf.quality(docs, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_crf.quality(docs.limit(0), labels).count() == 0
