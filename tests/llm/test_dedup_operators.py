"""Near duplicates, passages, embeddings, neighbours, language ID: against brute force, with nulls, ties, repeats and empty tables."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import embedding_dedup, language_id, minhash_dedup, nearest_neighbours, substring_dedup
from plumbline.llm import vectors as vectors_module
from plumbline.llm.common import connected_components, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def corpus(seed, n):
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    rows = [" ".join(make(rng.randrange(1, 120))) for _ in range(n)]
    base = make(100)
    rows += [" ".join(edited(rng, base, 0.02 * (i % 6))) for i in range(n)]
    rows += [rows[0], rows[0].upper(), "", None, "one two", "One  two", "\n\t "]
    return rows


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(n, links):
    root = list(range(n))
    for a, b in links:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    out = []
    for x in range(n):
        while root[x] != x:
            x = root[x]
        out.append(x)
    return out


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame([*links, (None, 1), (1, None)], "a long, b long")
    want = roots(341, links)
    got = {r.id: r.component for r in connected_components(df).collect()}
    assert got == {x: want[x] for a, b in links if a != b for x in (a, b)}
    assert connected_components(df.limit(0)).count() == 0
    spread = df.repartition(7).where("a is not null and b is not null")
    assert {r.id: r.component for r in connected_components(spread, edges_each=30).collect()} == got


def test_minhash(spark):
    texts = corpus(2, 60)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, cls string")
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(df).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in range(len(texts))}
    assert minhash_dedup.near_duplicates(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c"), (3, "a b c"), (3, "a b c"), (None, None)], "doc_id long, text string")
    assert sorted(map(str, minhash_dedup.near_duplicates(odd).collect())) == sorted(
        ["Row(doc_id=None, n_shingles=1, component_id=3, kept=False)", "Row(doc_id=3, n_shingles=1, component_id=3, kept=True)", "Row(doc_id=3, n_shingles=1, component_id=3, kept=True)", "Row(doc_id=None, n_shingles=0, component_id=None, kept=True)"]
    )


def near_misses(seed, n, words=60):
    """Edited copies of one text, of which most lie a little below the similarity from one another."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    return [" ".join(edited(rng, base, rng.choice([0.01, 0.03, 0.05]))) for _ in range(n)]


@pytest.mark.parametrize("block", [512, 6])
def test_minhash_near_misses(spark, monkeypatch, block):
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    texts = near_misses(8, 70) + near_misses(9, 12, 3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = roots(len(texts), links)
    assert len(set(want)) > 5 and max(want.count(x) for x in want) > 20
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(df).collect()} == dict(enumerate(want))


def test_minhash_deletes_used_tables(spark):
    """What the next step has been written from takes no room beside it."""
    folder = Path(shared_dir(spark).removeprefix("file://"))
    there = set(folder.iterdir())
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(4, 30))], "doc_id long, text string")
    minhash_dedup.near_duplicates(df).collect()
    left = {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - there}
    assert "signed" in left
    assert not left & {"shared-keys", "famed-keys", "star-pairs", "texts", "mixed-keys", "wanted", "word-sets"}


def test_minhash_recall(spark):
    """Lone pairs of a similarity of 0.75 to 0.8: all are found."""
    rng, texts = random.Random(10), []
    while len(texts) < 400:
        a = [f"v{rng.randrange(10**6)}" for _ in range(104)]
        b = a[: rng.randrange(90, 93)] if rng.random() < 0.3 else [*a[:50], "x", *a[51:]] if rng.random() < 0.5 else a[:90] + [f"y{len(texts)}"] + a[91:]
        while len(shingles(" ".join(a)) & shingles(" ".join(b))) * 100 >= 80 * len(shingles(" ".join(a)) | shingles(" ".join(b))):
            b = b[:-1]
        if len(shingles(" ".join(a)) & shingles(" ".join(b))) * 100 >= 75 * len(shingles(" ".join(a)) | shingles(" ".join(b))):
            texts += [" ".join(a), " ".join(b)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r.component_id == r.doc_id // 2 * 2 for r in minhash_dedup.near_duplicates(df).collect())


def test_passages(spark):
    rng = random.Random(3)
    make = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    passage = make(60)
    docs = [make(80) for _ in range(20)]
    for i in (2, 5, 9):
        docs[i][20:20] = passage
    docs[11][30:30] = edited(rng, passage, 0.08)
    texts = [" ".join(d) for d in docs] + [" ".join(docs[0]), "", None, "short text"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} == {0, 2, 5, 9, 11, 20}
    for r in rows:
        a, b = texts[r.doc_id].split()[r.start : r.end], texts[r.other_id].split()[r.other_start : r.other_end]
        assert min(len(a), len(b)) >= 50
        if 11 not in (r.doc_id, r.other_id):
            assert len(set(a) & set(b)) >= 0.9 * len(set(a))
    assert substring_dedup.repeated_passages(df.limit(0)).count() == 0


def test_chain_is_best():
    rng = random.Random(4)
    for _ in range(30):
        anchors = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(12)})
        score = []
        for i, (a, b) in enumerate(anchors):
            before = [score[j] - substring_dedup.GAP * (a - x + b - y) for j, (x, y) in enumerate(anchors[:i]) if x < a and y < b]
            score.append(substring_dedup.K_WORDS + max([0.0, *before]))
        path = substring_dedup.chain(anchors)[0]
        total = substring_dedup.K_WORDS * len(path) - sum(substring_dedup.GAP * (a - x + b - y) for (x, y), (a, b) in zip(path, path[1:], strict=False))
        assert total == pytest.approx(max(score)) or max(score) == substring_dedup.K_WORDS


def vectors(n=300, width=16, seed=5):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, width))
    for i in range(0, 120):
        v[i] = v[i % 3] + 0.12 * rng.standard_normal(width) * (i % 4)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, [0.0] * width), (902, [float("nan")] * width), (903, [None] + [1.0] * (width - 1)), (904, [1.0]), (905, [float("inf")] * width), (None, v[0].tolist()), (7, v[7].tolist())]
    return rows + odd, v


def test_extreme_vectors(spark):
    df = spark.createDataFrame([(1, [3e200, 4e200]), (2, [3e-200, 4.1e-200]), (3, [3.0, 4.0]), (4, [-3.0, 4.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_embeddings(spark):
    rows, v = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = np.vstack([v, v[:1], v[7:8]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = roots(len(u), np.argwhere(link).tolist())
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    mine = {r.vec_id: r for r in got if r.vec_id is not None and r.vec_id != 7}
    for i in range(300):
        if i != 7:
            assert (mine[i].n_links, mine[i].component_id) == (link[i].sum(), root[i])
    assert all(mine[i].n_links == 0 and mine[i].kept for i in range(900, 906))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_by_blocks(spark, monkeypatch):
    """Many blocks: vectors follow to the block pairs where they have partners, not to each that their block meets."""
    rng = np.random.default_rng(15)
    v = rng.standard_normal((1200, 64))
    v[1000:] = v[:8].repeat(25, 0) + 0.05 * rng.standard_normal((200, 64))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = roots(len(u), np.argwhere(link).tolist())
    written, keep = {}, embedding_dedup.materialize
    monkeypatch.setattr(embedding_dedup, "materialize", lambda df, name: written.setdefault(name, (keep(df, name), df.columns))[0])
    monkeypatch.setattr(embedding_dedup, "discard", lambda *tables: None)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {i: (link[i].sum(), root[i]) for i in range(len(v))}
    pairs, wanted = (written[name][0].count() for name in ("block-pairs", "wanted"))
    assert pairs > 40 and wanted < 8 * link.any(1).sum()


def test_vectors_of_several_widths(spark):
    """Rare widths have links and neighbours of their own, in one table with a common one."""
    rng = np.random.default_rng(9)
    rows, v = vectors()
    rare = rng.standard_normal((60, 5))
    rare[30:] = rare[:30] + 0.01 * rng.standard_normal((30, 5))
    df = spark.createDataFrame(rows + [(2000 + i, x.tolist()) for i, x in enumerate(rare)] + [(3000, [2.0]), (3001, [5.0]), (3002, [-1.0])], "vec_id long, embedding array<double>")
    u = rare / np.linalg.norm(rare, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    root = roots(len(u), np.argwhere(link).tolist())
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[2000 + i] for i in range(60)] == [(link[i].sum(), 2000 + root[i]) for i in range(60)]
    # 904 is [1.0] as well
    assert (got[3000], got[3001], got[3002], got[904]) == ((2, 904), (2, 904), (0, 3002), (2, 904))
    out = nearest_neighbours.nearest(df, F.col("vec_id").isin(2000, 3000)).collect()
    near = lambda q: [(r.vec_id, pytest.approx(r.score)) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q]
    s = u @ u[0]
    assert near(2000) == [(2000 + i, s[i]) for i in np.argsort(-s)[1:6]]
    assert near(3000) == [(904, 1.0), (3001, 1.0), (3002, -1.0)]


def test_neighbours(spark):
    rows, v = vectors(n=1500, seed=6)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest_neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.append(np.arange(1500), [-1, 7])
    u = np.vstack([u, u[:1], u[7:8]])
    hits = total = 0
    for q in range(0, 1500, 50):
        s = u @ u[q]
        s[q] = -9
        mine = sorted([r for r in out if r.query_id == q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]
        assert [r.score for r in mine] == sorted([r.score for r in mine], reverse=True)
        hits += len(set(np.round(np.sort(s)[-5:], 9)) & {round(r.score, 9) for r in mine})
        total += 5
    assert hits / total >= 0.9 and len(ids) == len(u)
    assert nearest_neighbours.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_by_chunks(spark, monkeypatch):
    """Lists of many chunks: no table holds a row for each pair of a chunk and a block of queries."""
    rows, v = vectors(n=1500, seed=6)
    rows = [r for r in rows if r[0] is not None and r[0] < 900]
    u = v[:900] / np.linalg.norm(v[:900], axis=1, keepdims=True)
    monkeypatch.setattr(nearest_neighbours, "CHUNK", 20)
    monkeypatch.setattr(nearest_neighbours, "QUERIES", 4)
    monkeypatch.setattr(nearest_neighbours, "PROBE_RECALL", 1.0)
    written = []
    keep = vectors_module.materialize
    for module in (nearest_neighbours, vectors_module):
        monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or keep(df, name), raising=False)
    df = spark.createDataFrame([r for r in rows if r[0] != 7], "vec_id long, embedding array<double>")
    out = nearest_neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect()
    keeps = [i for i in range(900) if i != 7]
    hits = 0
    for q in range(0, 900, 50):
        best = sorted((i for i in keeps if i != q), key=lambda i: (-(u[i] @ u[q]), i))[:5]
        hits += len({r.vec_id for r in out if r.query_id == q} & set(best))
    assert hits >= 0.95 * 5 * 18  # copies tie but for rounding
    assert written == ["vectors"]


def test_language(spark):
    rng = random.Random(7)
    kinds = {"en": ["the", "and", "ing", "tion", "er"], "de": ["sch", "ung", "ein", "ü", "der"], "es": ["ción", "de", "que", "ñ", "os"]}
    rows = []
    for i in range(240):
        lang = sorted(kinds)[i % 3]
        rows.append((i, " ".join("".join(rng.choices(kinds[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))), lang))
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, rows[0][1], None), (1004, rows[0][1].upper() * 20, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(df, F.col("doc_id") % 4 != 1).collect()}
    held = [i for i in range(240) if i % 4 == 1]
    assert sum(got[i].lang_pred == rows[i][2] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == rows[0][2]
    assert not any(got[i].rejected for i in range(240)) and got[1000].rejected
    assert language_id.identify(df.limit(0), F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, F.lit(False)).collect()} == {"und"}


def test_passages_of_frequent_sentences(spark):
    """A passage of two sentences that each stand in documents of smaller text id as well."""
    rng = random.Random(11)
    make = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    one, two = make(30), make(30)
    docs = [make(40) + (one, two)[i % 2] + make(40) for i in range(40)] + [make(40) + one + two + make(40) for _ in range(2)] + [make(100) for _ in range(5)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert {(r.doc_id, r.other_id) for r in rows} == {(40, 41), (41, 40)}
    assert all(r.start <= 42 and r.end >= 98 for r in rows)


def test_passages_of_repeated_words(spark):
    """Stretches of one word or a few, over and over, beside texts of smaller stretches; a pair has few rows, not one per shift."""
    rng = random.Random(13)
    make = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    x, y, abc = ["x"], ["y"], ["a", "b", "c"]
    docs = [make(20) + (x * 10, y * 10, x * 10 + y * 10, abc * 5)[i % 4] + make(40) for i in range(40)]
    docs += [make(20) + x * 60 + make(30), make(35) + x * 75 + make(9)]
    docs += [make(20) + abc * 20 + make(30), make(35) + abc * 31 + make(9)]
    docs += [make(20) + y * 44 + x * 30 + make(30), make(35) + y * 30 + x * 44 + make(9)]
    docs += [make(20) + ["z"] * 43 + make(30), make(35) + ["z"] * 40 + make(30)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    got = {(r.doc_id, r.other_id) for r in rows}
    assert got >= {(i, j) for k in range(40, 48, 2) for i, j in ((k, k + 1), (k + 1, k))}
    assert not any(i < 40 for pair in got for i in pair)
    assert len(rows) <= 6 * len(got)


def test_periodic():
    """Against its definition, place by place."""
    rng = random.Random(14)
    for _ in range(200):
        lists = [[rng.randrange(3) for _ in range(rng.randrange(5))] * rng.randrange(9) + [rng.randrange(2) for _ in range(rng.randrange(6))] for _ in range(3)]
        hashes, text = np.array([h for x in lists for h in x], np.uint64), np.repeat(np.arange(3), [len(x) for x in lists])
        inside, last = substring_dedup.periodic(hashes, text)
        same = lambda t, i, p: all(0 <= j - p and j < len(t) and t[j] == t[j - p] for j in range(i - p + 1, i + 1))
        periods = range(1, substring_dedup.SPAN + 1)
        want = [any(same(t, i, p) and same(t, i + p, p) for p in periods) for t in lists for i in range(len(t))]
        before = [any(same(t, i, p) for p in periods) for t in lists for i in range(len(t))]
        assert inside.tolist() == want and last.tolist() == [b and not w for b, w in zip(before, want, strict=True)]


def quoted_pairs(seed, pairs=60, words=80, share=0.15, quote=20):
    """(docs, ids of the pairs): passages and altered copies of them, every piece of which other texts quote too."""
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    rows, wanted = [], []
    for _ in range(pairs):
        passage = make(words)
        copy = [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in passage]
        wanted.append((len(rows), len(rows) + 1))
        rows += [make(60) + passage + make(60), make(60) + copy + make(60)]
        rows += [make(40) + passage[i : i + quote] + make(40) for i in range(0, words, quote)]
    return [(i, " ".join(r)) for i, r in enumerate(rows)], wanted


@pytest.mark.parametrize("share,quote", [(0.15, 20), (0.1, 12)])
def test_altered_passages_whose_seeds_others_quote(spark, share, quote):
    rows, wanted = quoted_pairs(17, share=share, quote=quote)
    got = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(w in got for w in wanted) >= 0.95 * len(wanted), sum(w in got for w in wanted)
    assert got <= {x for a, b in wanted for x in ((a, b), (b, a))}


def test_contexts():
    """Against plain minima, text by text."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{rng.integers(30)}" for _ in range(n)) for n in (60, 3, 0, 120, 5)]
    seeds, at, kind, around, ends, n = substring_dedup.minimizers(substring_dedup.pa.array(texts))
    tokens, top = substring_dedup.tokens, np.iinfo(np.uint64).max
    for t, text in enumerate(texts):
        words, _ = tokens.word_hashes(substring_dedup.pa.array([text]))
        for i in range(ends[t], ends[t + 1]):
            sides = zip(tokens.stream(9, 2), (words[max(0, at[i] - substring_dedup.REACH) : at[i]], words[at[i] + substring_dedup.K_WORDS :][: substring_dedup.REACH]), strict=True)
            want = [int(tokens.mix64(w + s).min() if len(w) else top) >> 48 for s, w in sides]
            assert int(around[i : i + 1].view(np.uint32)[0]) == want[0] << 16 | want[1]


def test_colliding_text_hashes(spark, monkeypatch):
    rng = random.Random(8)
    make = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    base = make(70)
    rows = [make(30) + base, base + make(20), make(90), make(90)]
    rows = [(i, " ".join(r)) for i, r in enumerate([*rows, rows[2], rows[0]])] + [(9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substring_dedup.repeated_passages(df).select("doc_id", "other_id", "start", "end", "other_start", "other_end").collect()))
    whole = substring_dedup.text_hash
    monkeypatch.setattr(substring_dedup, "text_hash", lambda text: whole(text) % 2)
    assert sorted(map(tuple, substring_dedup.repeated_passages(df).select("doc_id", "other_id", "start", "end", "other_start", "other_end").collect())) == want and want


def test_passages_of_similarity(spark):
    """Copies of 60 to 100 words with 10 to 20 % of the words changed, evenly or at random, against the diagonal by brute force."""
    rng = random.Random(12)
    make = lambda k: [f"w{rng.randrange(5000)}" for _ in range(k)]
    docs, pairs = [], []
    for i in range(240):
        share, n = (0.1, 0.125, 0.15, 0.2)[i % 4], (60, 100)[i // 4 % 2]
        p = make(n)
        q = [f"x{rng.randrange(10**6)}" if (int((j + 1) * share) > int(j * share) if i % 3 == 0 else rng.random() < share) else w for j, w in enumerate(p)]
        equal = np.concatenate([[0], np.cumsum([a == b for a, b in zip(p, q, strict=True)])])
        if any(equal[y] - equal[x] >= 0.75 * (y - x) for x in range(n) for y in range(x + 50, n + 1)):
            pairs.append((len(docs), len(docs) + 1))
        docs += [make(30) + p + make(30), make(20) + q + make(40)]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in substring_dedup.repeated_passages(df).collect()}
    assert len(got & set(pairs)) >= 0.97 * len(pairs)


def test_straight_chains():
    """Many chains on one diagonal at once, against their alignment one by one."""
    rng = np.random.default_rng(21)
    S, lists, chains, want = substring_dedup, ([], []), [], []
    for _ in range(600):
        a = rng.integers(0, 10**6, rng.integers(4, 200)).astype(np.int32)
        b = np.where(rng.random(len(a)) < rng.choice([0, 0.1, 0.2, 0.3, 0.7]), -1, a).astype(np.int32)
        skip = int(rng.integers(0, 30))
        at = sorted(rng.choice(len(a) - 3, min(len(a) - 3, int(rng.integers(1, 6))), replace=False).tolist())
        for i in at:
            b[i : i + S.K_WORDS] = a[i : i + S.K_WORDS]
        b = np.concatenate([rng.integers(0, 10**6, skip).astype(np.int32), b[: at[-1] + S.K_WORDS + int(rng.integers(0, 90))]])
        chains.append((at[0], at[0] + skip, at[-1] - at[0] + S.K_WORDS))
        want.append(S.align([(i, i + skip) for i in at], a, b))
        for x, words in zip(lists, (a, b), strict=True):
            x.append(words)
    ends = [np.cumsum([0, *map(len, x)]) for x in lists]
    x, y, width = np.array(chains).T
    got = S.straight(*map(np.concatenate, lists), x + ends[0][:-1], y + ends[1][:-1], width, *(np.stack([e[:-1], e[1:]], axis=1) for e in ends))
    got = [g - e[:-1] for g, e in zip(got[:4], (ends[0], ends[0], ends[1], ends[1]), strict=True)] + [got[4]]
    assert list(zip(*(g.tolist() for g in got), strict=True)) == want
    assert 100 < sum(S.fits(*w) for w in want) < 550


def test_bits_around():
    """Against their definition, place by place, also from a slice of the packed values."""
    S, words = substring_dedup, np.random.default_rng(22).integers(0, 2**60, 230).astype(np.uint64)
    places = [(0, 0, 90), (40, 0, 90), (86, 0, 90), (90, 90, 94), (94, 94, 230), (170, 94, 230)]
    got = S.bits_around(words, *(np.array(c) for c in zip(*places, strict=True)))
    for k, (i, s, e) in enumerate(places):
        for side, near in enumerate((words[max(s, i - S.MARGIN) : i][::-1], words[i + S.K_WORDS : min(e, i + S.K_WORDS + S.MARGIN)])):
            want = [*(int(w) & 1 for w in near), 1]
            assert np.unpackbits(got[side][k], bitorder="little").tolist() == want + [0] * (72 - len(want))
    assert (S.unpacked(S.packed(got[0]).slice(2, 3)) == got[0][2:5]).all()


def test_passages_without_ids(spark):
    """Texts are fetched by hash and id: null ids and repeated rows meet too."""
    rng = random.Random(23)
    make = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage = make(70)
    one, two = " ".join(make(20) + passage + make(20)), " ".join(make(9) + passage[:40] + ["x"] + passage[41:] + make(30))
    df = spark.createDataFrame([(None, one), (None, one), (5, two), (5, two), (6, " ".join(make(90)))], "doc_id long, text string")
    rows = substring_dedup.repeated_passages(df).collect()
    assert sorted((str(r.doc_id), r.start, r.end, str(r.other_id), r.other_start, r.other_end) for r in rows if r.doc_id != r.other_id) == [("5", 9, 79, "None", 20, 90), ("None", 20, 90, "5", 9, 79)]


def test_minhash_radius():
    """Signatures within RADIUS of each other share a key, however the errors lie, and are compared in the first one they share."""
    m, rng = minhash_dedup, np.random.default_rng(1)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, m.COMPONENTS).astype(np.uint16)
        b = a.copy()
        b[rng.choice(m.COMPONENTS, m.RADIUS, replace=False)] ^= 1
        first = m.first_keys((a == b)[None])[0]
        chunk = next((s, e) for s, e in m.BOUNDS if s <= first < e)
        assert all(a[k] == b[k] for k in range(*chunk) if k != first)
        sig, one, ends = np.stack([a, b]), np.array([10, 10]), np.array([0, 2])
        met = [len(i) for slot in range(m.COMPONENTS) for i, _ in m.partners(sig, one, np.array([1, 2]), np.full(2, slot), np.zeros(2, bool), ends)]
        assert sum(met) == 1 and met[first] == 1


def test_language_model_is_whole(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_ENTRIES", 50, raising=False)
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(1, 7))) for _ in range(400)]
    model = language_id.fit(spark.createDataFrame([(" ".join(words), "en")], "text string, lang string"))
    for n in (2, 3, 4):
        grams = {f"^{w}$"[i : i + n] for w in words for i in range(len(w) + 3 - n)}
        probable = (model.tables[n].values["p"][:-1] > 0).sum()
        assert probable == len(grams)


def brute_kneser_ney(texts):
    """(word -> bits) of one language's interpolated Kneser-Ney model, by counting strings; marks are blanks. None is for its base."""
    order, grams = language_id.ORDER, {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            s = f" {w} "
            for end in range(1, len(s)):
                for n in range(1, min(order, end + 1) + 1):
                    key = (s[end - n + 1 : end + 1], end == n - 1)
                    grams[key] = grams.get(key, 0) + 1
    adjusted = {}
    for (g, opens), k in grams.items():
        lefts = len({x for x in grams if len(x[0]) == len(g) + 1 and x[0][1:] == g})
        adjusted[g, opens] = k if len(g) == order or opens else lefts or k
    discount = {}
    for n in range(1, order + 1):
        c = [v for (g, _), v in adjusted.items() if len(g) == n]
        n1, n2 = c.count(1), c.count(2)
        discount[n] = min(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.9)
    total, kinds, value = {}, {}, {}
    for (g, _), v in adjusted.items():
        total[len(g), g[:-1]] = total.get((len(g), g[:-1]), 0) + v
        kinds[len(g), g[:-1]] = kinds.get((len(g), g[:-1]), 0) + 1
    for (g, _), v in adjusted.items():
        value[g] = max(v - discount[len(g)], 0) / total[len(g), g[:-1]]

    def bits(word, base):
        s, out = f" {word} ", 0.0
        for end in range(1, len(s)):
            p = base
            for n in range(1, min(order, end + 1) + 1):
                g = s[end - n + 1 : end + 1]
                key = (n, g[:-1])
                p = p * (discount[n] * kinds[key] / total[key] if key in total else 1.0) + value.get(g, 0.0)
            out -= np.log2(max(p, 1e-12))
        return out

    return bits, {g for g, _ in grams if len(g) == 1} | {g[:-1] for g, _ in grams if len(g) == 2}


def test_language_model_is_that_of_counting(spark):
    """Bits a character against a plain Kneser-Ney of strings; ties go to the first language; noise is rejected, text is not."""
    rng = random.Random(11)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(25))
    kinds = {"aa": ["the", "ing", "er", "on"], "bb": ["sch", "ung", "ü", "ei"]}
    rows = [(i, make(kinds["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    brute = {x: brute_kneser_ney([t for _, t, g in rows if g == x]) for x in kinds}
    symbols = set().union(*(b[1] for b in brute.values()))
    tests = rows[:4] + [(100, "Then schungs xyz, ü", "aa"), (101, "a", "aa")]
    asked = spark.createDataFrame(tests, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.entropies(asked, model, ["doc_id"]).collect()}
    for i, t, _ in tests:
        words = re.findall(r"[^\W\d_]+", t.lower())
        n = sum(len(w) + 1 for w in words)
        assert got[i].n == n
        for k, x in enumerate(["aa", "bb"]):
            assert got[i].bits[k] == pytest.approx(sum(brute[x][0](w, 1 / (4 * max(2, len(symbols)))) for w in words) / n, rel=1e-4)
    twins = spark.createDataFrame([(i, make(["the", "on"]), x) for i, x in enumerate(["zz", "aa"] * 6)], "doc_id long, text string, lang string")
    same = twins.select("doc_id", F.lit("the onthe on").alias("text"), "lang")  # both languages learn the same text
    assert {r.lang_pred for r in language_id.identify(same, F.lit(True)).collect()} == {"aa"}
    noise = spark.createDataFrame([*rows, (200, " ".join("".join(rng.choice("qxzjkwvfpb") for _ in range(7)) for _ in range(60)), None)], "doc_id long, text string, lang string")
    rejected = {r.doc_id for r in language_id.identify(noise, F.col("lang").isNotNull()).collect() if r.rejected}
    assert rejected == {200}
