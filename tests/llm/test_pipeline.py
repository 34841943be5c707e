"""The stages of the pipeline against brute force, with nulls, repeated ids and rows, ties, clashing columns and empty tables."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import pytest
from test_dedup_operators import near_misses, roots, shingles
from test_text_operators import brute_secrets

KINDS = "doc_id long, text string, lang string, source string, n_chars long, row_key string, spans int, times int, turn int, text_key int, taken int"
SYLLABLES = {"aa": ["ka", "lo", "mi", "ne", "ru"], "bb": ["sch", "ung", "er", "tz", "oh"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def documents():
    rng = random.Random(1)
    rows = [(i, prose(rng, lang := rng.choice(["aa", "bb"]), rng.randrange(1, 80)), lang, f"s{i % 3}" if i % 7 else None) for i in range(80)]
    rows += [(100 + i, t, "aa", "s0") for i, t in enumerate(near_misses(3, 12))]
    rows += [(3, rows[5][1], "aa", "s1"), (5, rows[5][1], "aa", "s1"), (5, "another text of id five " + prose(rng, "aa", 30), "aa", "s2")]
    rows += [(None, rows[9][1], None, None), (None, "lone text " + prose(rng, "bb", 40), "bb", "s1"), (None, None, None, None), (200, "", "aa", "s1"), (201, "12 34 !", "aa", "s1"), (202, None, "bb", "s1")]
    rows += [rows[11], rows[11], (300, "token = abcdef0123456789abcdef01 " + prose(rng, "bb", 20), "bb", "s2")]
    return [(*r, len(r[1]) if r[1] is not None else None, "k", 1, 2, 3, 4, 5) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), KINDS)


def test_stages_keep_columns_and_pass_empty_tables(spark, docs):
    for table in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            table = stage(spark, table, "")
            assert table.columns == docs.columns
        assert set(pipeline.STAGES[-1][1](spark, table, "").columns) == {"doc_id", "lang", "source", "ids", "n_tokens", "exact"}
    assert table.count() == 0


def test_language_stage(spark, docs):
    """Rows without a letter go; prose like that of the table stays, whatever its id."""
    got = Counter(map(tuple, pipeline.identify_language(spark, docs, "").collect()))
    want = Counter(r for r in documents() if any(c.isalpha() for c in r[1] or ""))
    assert got == want


def test_near_duplicate_stage(spark, docs):
    rows = documents()
    sets = [shingles(r[1]) for r in rows]
    same = lambda i, j: rows[i][:2] == rows[j][:2]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if same(i, j) or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    groups = {}
    for i, g in enumerate(roots(len(rows), links)):
        groups.setdefault(g, []).append(i)
    got = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert len(got) == len(groups)
    kept = Counter((r.doc_id, r.text) for r in got)
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        texts = {rows[i][1] for i in members if rows[i][0] == (min(ids) if ids else None)}
        assert sum(kept[min(ids) if ids else None, t] for t in texts) == 1
    assert kept[5, rows[94][1]] == 1 and rows[94][1].startswith("another text")


def test_secret_stage(spark, docs):
    got = pipeline.redact_secrets(spark, docs, "").collect()
    assert len(got) == len(documents())
    for r, (_, text, *_) in zip(sorted(got, key=lambda r: str(r)), sorted(documents(), key=lambda r: 0), strict=True):
        assert r.text is None or not brute_secrets(r.text) and r.n_chars == len(r.text)
    plain = Counter(r[1] for r in documents() if not brute_secrets(r[1]))
    assert all(Counter(r.text for r in got)[t] >= n for t, n in plain.items())


def test_mix_stage(spark, docs):
    from plumbline.llm import source_mixing

    taken = {}
    for r in source_mixing.mix(docs.select("doc_id", "text", "source")).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    got = Counter((r.doc_id, r.text) for r in pipeline.mix_sources(spark, docs, "").collect())
    rows = Counter(r[:2] for r in documents())
    assert set(got) <= set(rows) and all(got[k] <= 2 * rows[k] for k in got)
    words = lambda c: sum(len((t or "").split()) * n for (_, t), n in c.items())
    assert 0.6 * sum(taken.values()) <= words(got) <= 1.4 * sum(taken.values())


def test_encode_stage(spark, docs):
    out = pipeline.encode_pieces(spark, docs, "").collect()
    assert len(out) == len(documents()) and all(r.exact and r.n_tokens == len(r.ids) for r in out)
