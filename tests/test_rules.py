"""Cases of the rules, the parser and suppression: input to exact findings."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import dictionary, evaluation, parse, report, suppress
from plumbline.operators.rules import Settings, rules
from plumbline.plans import engine


def found(spark, text, rule, markdown=False, **settings):
    docs = spark.createDataFrame([("p", text, markdown)], "path string, text string, markdown boolean")
    rows = engine.run_rules(docs, [r for r in rules(Settings(**settings)) if r.id == f"STE.{rule}"]).collect()
    return sorted((r.line, r.col, r.end_line, r.end_col, r.match, r.message, r.hint) for r in rows)


CASES = [
    ("SentenceLength", "one two three four five six.", False, dict(description_max=5), 1),
    ("SentenceLength", "one two three four five six.", False, dict(description_max=6), 0),
    ("SentenceLength", "# one two three four", True, dict(description_max=1, procedure_max=1), 0),
    ("SentenceLength", "one two three.", False, dict(description_max=0), 0),
    ("Contractions", "The system's fan is here.", False, {}, 0),
    ("Contractions", "Don't and can't work.", False, {}, 2),
    ("PassiveVoice", "The file was written.", False, {}, 1),
    ("PassiveVoice", "It is indeed here. He opened the door.", False, {}, 0),
    ("IngForms", "Testing and checking now.", False, {}, 2),
    ("IngForms", "The warning string setting is here. The ping is here.", False, {}, 0),
    ("IngForms", "# Installing the system", True, {}, 0),
    ("PhrasalVerbs", "Set up the system. Carry out the test. Shut down it.", False, {}, 3),
    ("PhrasalVerbs", "Turn, on 3 lights.", False, {}, 1),
    ("OneInstruction", "- Open the door; close it.", True, {}, 1),
    ("OneInstruction", "- Open the door and then close it.", True, {}, 1),
    ("OneInstruction", "Open the door; close it.", True, {}, 0),
    ("Vocabulary", "Open the bolt here.", False, dict(strict=True), 1),
    ("Vocabulary", "Open the bolt here.", False, {}, 0),
    ("Vocabulary", "Hook up to the pump.", False, {}, 2),
    ("Vocabulary", "Open the able tool according to it.", False, dict(allowed=frozenset({"able", "according to"})), 0),
    ("Vocabulary", "Build the file and verify the rest of the branch.", False, {}, 0),
    ("Vocabulary", "Build the file and verify the rest of the branch.", False, dict(allowed=frozenset()), 5),
    ("Vocabulary", "By means of a pump.", False, {}, 1),
    ("SlopVocabulary", "We delve into the intricate realm of valves.", False, {}, 3),
    ("SlopRestatement", "The valve opens. In other words, flow starts.", False, {}, 1),
    ("SlopNegativeParallelism", "It is not only fast but also cheap.", False, {}, 1),
    ("SlopEvaluative", "The robust design works.", False, {}, 0),
    ("SlopEvaluative", "The comprehensive and robust design works.", False, {}, 1),
    ("SlopHedgeDensity", "It may possibly perhaps work.", False, {}, 1),
    ("SlopNominalization", "Ément ément ément.", False, {}, 1),
]


@pytest.mark.parametrize("rule,text,markdown,settings,n", CASES)
def test_counts(spark, rule, text, markdown, settings, n):
    assert len(found(spark, text, rule, markdown, **settings)) == n


def test_exact(spark):
    assert found(spark, "The door was opened.", "PassiveVoice")[0][:5] == (1, 10, 1, 20, "was opened")
    assert found(spark, "It was quickly removed.", "PassiveVoice")[0][4] == "was removed"
    assert found(spark, "It’s broken.", "Contractions")[0][4:] == ("It’s", 'Contraction "It’s" is not allowed.', 'Write "it is".')
    assert found(spark, "Turn on the light.", "PhrasalVerbs") == [(1, 1, 1, 8, "turn on", 'Phrasal verb "turn on" is not clear.', 'Use "start".')]
    assert found(spark, "- one two three four", "SentenceLength", True, procedure_max=3)[0][:4] == (1, 3, 1, 21)
    assert found(spark, "Open the valve able tool.", "Vocabulary")[0][6] == 'Use "can" or "possible".'
    assert found(spark, "It could be argued that the fan is loud.", "SlopImpersonalHedge")[0][4] == "It could be argued that"


def sentences(spark, text, markdown=False):
    docs = spark.createDataFrame([("p", text, markdown)], "path string, text string, markdown boolean")
    return [[t.text for t in r.toks] for r in parse.sentences(docs).orderBy("block_id", "sent_id").collect()]


@pytest.mark.parametrize(
    "text,n",
    [("Use it, e.g. now here.", 1), ("See this. 3 more.", 2), ("Stop! go? done.", 3), ("First block\n\nSecond block", 2), ("", 0), ("What?! Ok... yes", 3), ("v1.5 is", 2), ("...", 1), (None, 0)],
)
def test_sentences(spark, text, n):
    assert len(sentences(spark, text)) == n


def test_tokens(spark):
    docs = spark.createDataFrame([("p", "café ready\r\nIt's a well-made 😀 end- stop")], "path string, text string")
    rows = [(t.text, t.kind, t.line, t.col, t.end_col) for t in parse.tokens(docs).orderBy("line", "col").collect()]
    assert rows[:2] == [("café", "word", 1, 1, 5), ("ready", "word", 1, 6, 11)]
    assert [r[0] for r in rows[2:]] == ["It's", "a", "well-made", "😀", "end", "-", "stop"]


def test_long_block_positions(spark):
    words = [f"w{i % 97}" for i in range(30000)]
    docs = spark.createDataFrame([("p", " ".join(words))], "path string, text string")
    row = parse.tokens(docs).orderBy("col").tail(1)[0]
    assert row.text == words[-1] and row.end_col == len(" ".join(words)) + 1


def test_a_long_text_is_its_parts(spark):
    """Texts joined by blank lines, or by line ends inside one block, have the tokens of the parts, moved down; blocks and sentences count on."""
    parts = [f"The door {i} was opened. It is 3.5 m wide! Why?\nSee e.g. v1.{i} here... and so on" for i in range(400)]
    rows = lambda texts: {(r.path, r.block_id, r.sent_id, r.tok_idx): (r.text, r.kind, r.line, r.col) for r in parse.tokens(spark.createDataFrame(texts, "path string, text string")).collect()}
    alone = rows([(str(i), p) for i, p in enumerate(parts)])
    assert rows([("d", "\n\n".join(parts))]) == {("d", int(p), s, t): (text, kind, line + 3 * int(p), col) for (p, _, s, t), (text, kind, line, col) in alone.items()}
    # the last sentence of a part goes on in the next one's first, so whole parts are compared that end with a mark
    ended = [p + "." for p in parts]
    alone = rows([(str(i), p) for i, p in enumerate(ended)])
    counts = {p: 1 + max(s for q, _, s, _ in alone if q == str(p)) for p in (0, 1)}
    assert set(counts.values()) == {6}
    want = {("d", 0, 6 * int(p) + s, t): (text, kind, line + 2 * int(p), col) for (p, _, s, t), (text, kind, line, col) in alone.items()}
    assert rows([("d", "\n".join(ended))]) == want


def test_sentences_dealt_anew(spark):
    docs = spark.createDataFrame([("d", "It was opened. Testing isn't done.\n\n" * 50)], "path string, text string")
    assert sorted(map(tuple, engine.lint(docs, deal=3).collect())) == sorted(map(tuple, engine.lint(docs).collect()))


def test_suppression(spark):
    text = "a\n<!-- lint off -->\nb\n<!-- lint on -->\n<!-- lint STE.X = no -->\nc <!-- LINT disable-line A B -->\n<!-- lint STE.X = YES -->\n<!-- lint disable-next-line -->\nd <!-- lint off --> <!-- lint on -->"
    docs = spark.createDataFrame([("p", text)], "path string, text string")
    got = {(r.line, r.rule_id) for r in suppress.suppressed_lines(docs).collect()}
    assert got == {(2, "*"), (3, "*"), (5, "STE.X"), (6, "STE.X"), (6, "A"), (6, "B"), (9, "*")}


def brute_suppressed(text):
    """{(line, rule)} by reading the lines one by one."""
    import re

    state, out = {}, set()
    for i, line in enumerate(text.split("\n"), 1):
        for body in re.findall(r"(?i)<!--\s*lint\s+(.*?)\s*-->", line):
            verb, *args = body.split()
            if verb.lower() in ("on", "off"):
                state["*"] = verb.lower() == "off"
            elif verb.lower() in ("disable-line", "disable-next-line"):
                out |= {(i + (verb.lower() == "disable-next-line"), a) for a in args or ["*"]}
            elif len(args) == 2 and args[0] == "=" and args[1].upper() in ("YES", "NO"):
                state[verb] = args[1].upper() == "NO"
        out |= {(i, r) for r, off in state.items() if off}
    return out


def test_suppression_by_spans(spark):
    """Random directives: the spans over a finding are those that a reader of the lines sees; overlapping ones too."""
    rng = random.Random(4)
    ids = ["STE.IngForms", "STE.Contractions", "X"]
    make = lambda: rng.choice(["off", "on", "disable-line", "disable-next-line", "disable-line X", "disable-next-line STE.IngForms X", *[f"{r} = {v}" for r in ids for v in ("NO", "yes", "no", "perhaps")]])
    line = lambda: "Testing it isn't." + "".join(f" <!-- lint {make()} -->" for _ in range(rng.choice([0, 0, 0, 1, 2])))
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 60))) for _ in range(25)] + [None, "", "Testing it isn't."]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    want = {(str(i), *x) for i, t in enumerate(texts) for x in brute_suppressed(t or "")}
    assert {(r.path, r.line, r.rule_id) for r in suppress.suppressed_lines(docs).collect()} == want
    some = [r for r in rules() if r.id in ids]
    left = {(r.path, r.line, r.rule_id) for r in engine.run_rules(docs, some).collect()}
    got = {(r.path, r.line, r.rule_id) for r in suppress.without_suppressed(engine.run_rules(docs, some), docs).collect()}
    assert got == {f for f in left if f not in want and (f[0], f[1], "*") not in want}
    assert len(got) < len(left)


def test_a_region_is_one_row(spark):
    docs = spark.createDataFrame([("d", "<!-- lint off -->\n" + "x\n" * 200_000)], "path string, text string")
    assert [tuple(r) for r in suppress.spans(docs).collect()] == [("d", "*", 1, None)]


def test_utf16_and_reports(spark):
    docs = spark.createDataFrame([("p", "😀 Don't stop testing.")], "path string, text string")
    out = engine.lint(docs)
    at = {(r.start_char, r.end_char) for r in report.diagnostics(out, docs).collect()}
    assert (3, 8) in at
    docs = spark.createDataFrame([("p", "It isn't.\n😀😀 It isn't."), ("q", "It isn't.")], "path string, text string")
    at = {(r.path, r.start_line, r.start_char, r.end_line, r.end_char) for r in report.diagnostics(engine.lint(docs), docs).collect()}
    assert at == {("p", 0, 3, 0, 8), ("p", 1, 8, 1, 13), ("q", 0, 3, 0, 8)}
    assert report.summary(out).first().summary_line == "2 problems (1 errors, 0 warnings, 1 suggestions)"


def test_partitioning_does_not_matter(spark):
    docs = spark.createDataFrame([(str(i), f"It was opened {i}. Testing isn't done.") for i in range(40)], "path string, text string")
    rows = lambda d: sorted(map(tuple, engine.lint(d).collect()))
    assert rows(docs.repartition(7)) == rows(docs.coalesce(1))


def test_dictionary_of_any_size(spark):
    """100,000 entries beside the rule's own: its findings, and the plan of a small dictionary."""
    s = Settings(allowed=frozenset({"able", "according to"}))
    text = "Hook up to the pump according to it. Able means give rise to. By means of an able pump, top up to it. Top up to. Unknownword7 seven words here."
    docs = spark.createDataFrame([("p", text), ("q", "Able " * 300 + "hook up"), ("r", None), ("s", "")], "path string, text string")
    own = spark.createDataFrame([(w, a) for w, a in s.substitutions.items()], "word string, alternatives array<string>")
    more = spark.range(100_000).select(F.concat(F.lit("Unknownword"), "id").alias("word"), F.array(F.lit("x"), F.col("id").cast("string")).alias("alternatives"))
    terms = spark.createDataFrame([("able",), ("According to",)], "term string")
    rows = lambda t: sorted(tuple(r) for r in dictionary.findings(docs, dictionary.entries(t, terms)).collect())
    want = sorted(tuple(r) for r in engine.run_rules(docs, [r for r in rules(s) if r.id == "STE.Vocabulary"]).collect())
    assert rows(own) == want and len(want) > 5
    extra = set(rows(own.unionByName(more))) - set(want)
    assert [(r[3], r[-1]) for r in extra] == [('Use "x" or "7".', "Unknownword7")]
    assert dictionary.findings(docs, dictionary.entries(own.limit(0))).count() == 0


def test_rollup_and_json(spark):
    """Totals of the levels agree, and the JSON objects carry what the tables do."""
    rows = [(i, f"m{i % 3}", f"f{i % 2}", "It isn't opened. Don't." if i % 4 else "fine words", None) for i in range(12)] + [(99, "m9", "f9", None, "no route")]
    got = evaluation.samples(spark.createDataFrame(rows, "seq int, model string, family string, output string, err string"))
    roll = evaluation.rollup(got).collect()
    by = lambda level, what: sum(getattr(r, what) or 0 for r in roll if r.level == level)
    assert len({by(k, "n") for k in (0, 1, 2, 3, 6, 7)}) == 1 and by(7, "n") > 0
    assert by(1, "words") == by(3, "words") == by(7, "words") == 9 * 4 + 3 * 2
    import json

    report = [(r.section, json.loads(r.json)) for r in evaluation.json_report(got).collect()]
    models = {r["Model"]: r for s, r in report if s == "models"}
    assert models["m9"]["FirstError"] == "no route" and models["m9"]["ByRule"] == {} and models["m0"]["ByRule"]["STE.Contractions"] == sum(1 for i in range(0, 12, 3) if i % 4) * 2
    assert {r["Family"] for s, r in report if s == "families"} == {"f0", "f1", "f9"}
