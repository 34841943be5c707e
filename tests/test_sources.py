"""Path filters, vocabulary, configuration, evaluation helpers and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import lexicons
from plumbline.operators.rules import Settings
from plumbline import oracle, queries
from plumbline.operators import evaluation, report
from plumbline.plans import engine
from plumbline.plans.config import Config, discover, load, merge, read_store, update_store
from plumbline.sources import files, markdown, wordset
from plumbline.streaming import lint_stream


@pytest.mark.parametrize("glob,path,fits", [("vendor/*", "vendor/a", True), ("vendor/*", "vendor/a/b", False), ("*.md", "x/y.md", True), ("[", "[", False), ("a?c", "abc", True), ("**/C.md", "x/y/C.md", True), ("[^a]x", "bx", True)])
def test_globs(spark, glob, path, fits):
    assert spark.range(1).select(files.matches_any(F.lit(path), [glob])).first()[0] == fits


def test_wordset(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"words": [{"title": "swift", "wordstatus": "unapproved"}, {"title": "gloom", "wordstatus": "unapproved"}], "alternatives": [{"title": "swift", "alt_title": "fast"}, {"title": "swift", "alt_title": "quick"}, {"title": "swift", "alt_title": "fast"}, {"title": "q", "alt_title": "Q"}]}')
    words, alternatives = wordset.read_wordset(spark, str(tmp_path / "w.json"))
    subs = wordset.substitutions(alternatives)
    assert wordset.to_settings(subs) == {"swift": ["fast", "quick"]}
    assert [r.word for r in wordset.bare_words(words, subs).collect()] == ["gloom"]


def test_config_layers():
    c = merge(Config(), {"sentence": {"procedureMax": 10}, "vocabulary": {"allow": ["a"]}, "rules": {"X": {"disabled": True}}})
    c = merge(c, {"vocabulary": {"allow": ["b"], "deny": ["a"]}, "rules": {"X": {"severity": "error"}}, "slop": {"enabled": True}}).validate()
    assert (c.procedure_max, c.allow, c.disabled(), c.severities(), c.slop) == (10, ["a", "b"], set(), {"X": "error"}, True)
    assert "b" in c.settings().allowed and "a" not in c.settings().allowed
    with pytest.raises(ValueError):
        merge(Config(), {"minSeverity": "loud"}).validate()


def test_strip_fence(spark):
    df = spark.createDataFrame([("```md\nx\n```",), ("x",), ("```\nx",)], "t string")
    assert [r[0] for r in df.select(evaluation.strip_fence(F.col("t"))).collect()] == ["x", "x", "```\nx"]


def test_front_matter(spark):
    df = spark.createDataFrame([(t,) for t in queries.FRONT_MATTER], "text string").select("text", markdown.front_matter_end(F.col("text")).alias("n"))
    assert all(r.n == markdown.front_matter(r.text) for r in df.collect())


def test_every_key_has_sql():
    assert set(queries.QUERIES) - set(oracle.ORACLE_SQL) == {"md_mask"}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, "Testing it.", False), ("a", 2, "Done.", False), ("b", 1, "Testing b.", False), ("c", 1, "Testing c.", True)], "path string, seq long, text string, closed boolean").write.parquet(str(tmp_path / "in"))
    changes = spark.readStream.schema("path string, seq long, text string, closed boolean").parquet(str(tmp_path / "in"))
    seen = []
    q = lint_stream.start(changes, lambda f, d, n: seen.append((sorted(r.path for r in f.collect()), sorted(r.path for r in d.collect()))), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination(120)
    assert seen == [(["b"], ["a", "b", "c"])]


def test_word_lists_are_whole():
    assert (len(lexicons.SUBSTITUTIONS), len(lexicons.BARE_WORDS), len(lexicons.TECHNICAL_TERMS)) == (1030, 33, 246)
    assert sum(" " in w for w in lexicons.SUBSTITUTIONS) == 43
    assert (sum(map(len, lexicons.SUBSTITUTIONS.values())), max(map(len, lexicons.SUBSTITUTIONS.values()))) == (1518, 6)
    assert {"blend", "entire", "heat", "render", "rest", "teach", "under"} <= set(Settings().substitutions)


def test_read_folder(spark, tmp_path):
    root = tmp_path / "a b+c"
    for name in ("one.md", "two.TXT", "sub/deep file.md", "sub/gen.x.md", "node_modules/p/q.md", "code.py", "out/z.md", "odd.rst"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"{name}\r\n")
    (root / files.IGNORE).write_text("# made\n\n  out \n*.x.md\n")
    skip = files.ignored(str(root / "sub"))
    assert skip == ["out", "*.x.md"] and files.ignored(str(tmp_path)) == []
    got = {r.path: r.text for r in files.read_folder(spark, str(root), exclude=skip, explicit=[f"{root}/odd.rst", f"{root}/one.md"]).collect()}
    assert got == {n.removeprefix(f"{root}/") if p else n: n.removeprefix(f"{root}/") + "\r\n" for n, p in ((f"{root}/odd.rst", 0), (f"{root}/one.md", 0), (f"{root}/two.TXT", 1), (f"{root}/sub/deep file.md", 1))}
    assert [r.path for r in files.read_folder(spark, str(root), include=["sub/*"], exclude=skip).collect()] == ["sub/deep file.md"]


def test_discover_and_store(tmp_path):
    env = {"HOME": str(tmp_path / "home"), "XDG_CONFIG_DIRS": f"{tmp_path}/s1:{tmp_path}/s2"}
    where = ["s2/plumbline/config.yml", "s1/plumbline/config.yaml", "home/.config/plumbline/config.yaml", "home/.local/state/plumbline/vocab.yaml", "work/.plumbline.yaml", "work/sub/.plumbline.local.yml", "work/.plumbline.vocab.yaml"]
    for i, name in enumerate(where):
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"sentence: {{procedureMax: {i}}}\nvocabulary: {{allow: [t{i}]}}\n")
    found = discover(str(tmp_path / "work/sub"), env)
    assert found == [str((tmp_path / n).resolve()) for n in where]
    config = load(found)
    assert (config.procedure_max, config.allow) == (6, [f"t{i}" for i in range(7)])
    assert discover(str(tmp_path / "work"), {"XDG_CONFIG_DIRS": str(tmp_path / "none")}) == [str((tmp_path / n).resolve()) for n in (where[4], where[6])]
    store = str(tmp_path / "new/folder/v.yaml")
    assert read_store(store) == ([], [])
    update_store(store, [" Valve ", "pump", ""], ["Ö"])
    assert update_store(store, ["PUMP", "axle"]) == (["axle", "pump", "valve"], ["ö"]) == read_store(store)
    assert load([store]).allow == ["axle", "pump", "valve"]


def test_write_substitutions(spark, tmp_path):
    rows = [("swift", ["fast", "quick"]), ("able", ["can"])]
    texts = []
    for i, order in enumerate((rows, rows[::-1])):
        wordset.write_substitutions(spark.createDataFrame(order, "word string, alternatives array<string>").repartition(3), str(tmp_path / f"o{i}"))
        texts.append("".join(p.read_text() for p in (tmp_path / f"o{i}").glob("*.json")))
    assert texts[0] == texts[1] and texts[0].startswith('{"word":"able"')
    assert wordset.to_settings(wordset.read_substitutions(spark, str(tmp_path / "o0"))) == dict(rows)


def test_prompt_file(spark, tmp_path):
    (tmp_path / "p.txt").write_text("# a\n\n  Say it.  \n")
    assert [r.prompt for r in evaluation.read_prompts(spark, str(tmp_path / "p.txt")).collect()] == ["Say it."]
    (tmp_path / "q.txt").write_text("# a\n")
    with pytest.raises(ValueError):
        evaluation.read_prompts(spark, str(tmp_path / "q.txt"))


def test_json_document(spark):
    docs = spark.createDataFrame([("b", "Testing it."), ("a", 'Testing "that".'), ("c", "Done.")], "path string, text string")
    for found, paths in ((engine.lint(docs), ["a", "b"]), (engine.lint(docs.where("path = 'c'")), [])):
        lines = report.json_document(found).orderBy("part", "path").collect()
        got = json.loads("".join(r.report for r in lines))
        assert [r["path"] for r in got["results"]] == paths and got["summary"]["total"] == sum(len(r["findings"]) for r in got["results"])


def test_text_report(spark):
    rows = [("m1", "f", 2, 3, 1, "late", 200, 4, 10), ("m2", "g", 1, 1, 0, None, 100, 5, 5), ("m3", "h", 3, 1, 1, "x", 0, 0, 0)]
    models = spark.createDataFrame(rows, "model string, family string, first_seq long, samples long, errors long, first_error string, words long, slop_findings long, total_findings long")
    models = models.withColumns({"slop_per_100": evaluation.per_100(F.col("slop_findings"), F.col("words")), "total_per_100": evaluation.per_100(F.col("total_findings"), F.col("words"))})
    got = [r.report for r in evaluation.text_report(models).collect()]
    assert [g.split()[0] for g in got] == ["g", "f", "h", "m2", "m1", "m3"]
    assert got[4].endswith("slop   2.00  all   5.00  (200 words)  [1 errors: late]")


def test_replies_are_markdown(spark):
    rows = spark.createDataFrame([(1, "m", "f", "`Testing` it.", None)], "seq long, model string, family string, output string, err string")
    by_rule = lambda **more: evaluation.samples(rows, **more).first().by_rule
    assert by_rule() == {} and by_rule(markdown=False) == {"STE.IngForms": 1}


def test_stream_keeps_texts(spark, tmp_path):
    schema = "path string, seq long, text string, closed boolean"
    batches = [[("a", 1, "Testing it.", False), ("b", 1, "Done.", False)], [("a", 2, None, None), ("c", 1, None, False)], [("a", 1, "Old.", False), ("b", 3, "Testing b.", False)], [("a", 4, None, True), ("b", 4, None, None)], [("a", 5, None, False)]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = lint_stream.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda f, d, n: seen.append((sorted(r.path for r in f.collect()), sorted((r.path, r.closed) for r in d.collect()))), str(tmp_path / "ck"), availableNow=True)
        q.awaitTermination(120)
    seen = [s for s in seen if s[1]]
    assert seen == [(["a"], [("a", False), ("b", False)]), (["a"], [("a", False)]), (["b"], [("b", False)]), (["b"], [("a", True), ("b", False)])]


def test_whole_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.md").write_bytes(b"Testing a.\r\n\r\nTesting b.\n")
    assert [(r.path.rpartition("/")[2], r.text) for r in files.read_documents(spark, str(tmp_path / "in")).collect()] == [("x.md", "Testing a.\r\n\r\nTesting b.\n")]
    seen = []
    lint_stream.start(lint_stream.file_changes(spark, str(tmp_path / "in")), lambda f, d, n: seen.extend(sorted((r.line, r.col) for r in f.collect())), str(tmp_path / "ck"), availableNow=True).awaitTermination(120)
    assert seen == [(1, 1), (3, 1)]


def test_stream_replay_goes_on_after_a_restart(spark, tmp_path):
    """Two replays into one folder: the second reads only what is new, and what stands is the batch lint of the last texts."""
    schema = "path string, seq long, text string, closed boolean"
    write = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    changes = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    folder = str(tmp_path / "out")
    write([("a", 1, "It isn't opened.", False), ("b", 1, "Testing it.", False), ("c", 1, "Don't.", False)], "1")
    first = {(r.path, r.match) for r in lint_stream.replay(changes(), folder).collect()}
    assert {p for p, _ in first} == {"a", "b", "c"}
    write([("a", 2, "All is fine.", False), ("b", 2, None, False), ("b", 0, "Don't be old.", False), ("c", 2, None, True), ("d", 5, "Don't.", False)], "2")
    got = sorted(tuple(r) for r in lint_stream.replay(changes(), folder).collect())
    last = spark.createDataFrame([("a", "All is fine."), ("b", "Testing it."), ("d", "Don't.")], "path string, text string")
    assert got == sorted(tuple(r) for r in engine.lint(last).collect())
