"""The registered queries of the prose engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import lexicons as lex
from plumbline.operators import dictionary, evaluation, parse, repetition, report, suppress
from plumbline.operators.rules import Settings, rules
from plumbline.plans import engine
from plumbline.sources import files, markdown, wordset
from plumbline.streaming import lint_stream

#: Texts that make every rule fire: (path, text, markdown). The documents never do for most of them.
FIXTURES = [
    ("fix:01", "Don't stop. It’s broken. The system's fan is here. Don't and can't work.", False),
    ("fix:02", "The door was opened. It was quickly removed. The file was written. It is indeed here.", False),
    ("fix:03", "Testing and checking now. The warning string setting is here. The ping is here.", False),
    ("fix:04", "Turn on the light. Set up the system. Turn, on 3 lights. Carry out the test. Shut down the system.", False),
    ("fix:05", "- Open the door; close it.\n- Open the door and then close it.\n\nOpen the door; close it.", True),
    ("fix:06", "Open the valve able tool. Open the valve according to the manual. Open the bolt here. Hook up to the pump.", False),
    ("fix:07", "We delve into the intricate realm of valves. We leverage a nuanced tapestry.", False),
    ("fix:08", "The valve opens. In other words, flow starts. That is to say, simply put, it works. To put it another way, stop.", False),
    ("fix:09", "It could be argued that the fan is loud. It is possible that it fails. There is a possibility that it stops.", False),
    ("fix:10", "It is not only fast but also cheap. It is not just fast but cheap. It is not only here.", False),
    ("fix:11", "The comprehensive and robust design works. The robust design works. A cutting-edge, notable, versatile tool.", False),
    ("fix:12", "It may possibly perhaps work. It may work. It seems it could likely fail, arguably.", False),
    ("fix:13", "The implementation of the configuration needs consideration. Ément ément ément.", False),
    ("fix:14", "# Installing the system\n- " + "one two three " * 8 + "end.\n\nVersion v1.5 is here. See this. 3 more! What?! Use it, e.g. now.", True),
    ("fix:15", "Testing one.\n<!-- lint off -->\nTesting two.\n<!-- lint on -->\nTesting three. <!-- lint disable-line STE.IngForms -->", False),
    ("fix:16", "<!-- lint disable-next-line -->\nTesting it's.\n<!-- lint STE.IngForms = NO -->\nTesting don't.\n<!-- lint STE.IngForms = YES -->\nTesting <!-- lint off --> <!-- lint on -->", False),
    ("fix:17", "😀 Testing café.\r\n\r\nIt's 😀 done. \n　\nTop up to it.", False),
    ("fix:18", "", False),
    ("fix:19", "By means of a pump we build the file and the rest. It can give rise to a branch. The process of thread render is means.", False),
    ("fix:20", "Open the inlet valve before starting pump seven. " * 3 + "Always open the inlet valve before starting pump seven. Close everything. Merge commit hash branch, merge commit hash branch.", False),
]
ALL = Settings(strict=True)
#: Rule -> query key.
RULE_KEYS = {
    "STE.SentenceLength": "rule_sentence_length", "STE.Contractions": "rule_contractions", "STE.PassiveVoice": "rule_passive_voice",
    "STE.IngForms": "rule_ing_forms", "STE.PhrasalVerbs": "rule_phrasal_verbs", "STE.OneInstruction": "rule_one_instruction",
    "STE.Vocabulary": "rule_vocabulary", "STE.SlopVocabulary": "rule_slop_vocabulary", "STE.SlopRestatement": "rule_slop_restatement",
    "STE.SlopImpersonalHedge": "rule_slop_impersonal_hedge", "STE.SlopNegativeParallelism": "rule_slop_negative_parallelism",
    "STE.SlopEvaluative": "rule_slop_evaluative", "STE.SlopHedgeDensity": "rule_slop_hedge_density",
    "STE.SlopNominalization": "rule_slop_nominalization",
}
PATHS = [
    ("docs/a.md", False), ("docs/b.MD", False), ("docs/sub/c.txt", False), ("vendor/x.md", False), ("a.gen.md", False), ("README.rst", False),
    ("keep/odd.rst", True), ("node_modules/p/q.md", False), (".git/z.md", False), ("x/CHANGELOG.md", False), ("docs/a.md", False), ("notes.mkd", False),
    ("vendor/deep/y.md", False), ("x/y.markdown", False), ("bare", False),
]
WORDS = [("able", "unapproved"), ("foo", "unapproved"), ("bar", "approved"), ("baz (note)", "unapproved")]
ALTERNATIVES = [
    ("able", "can"), ("able", "possible"), ("able", "can"), ("apple", "seed"), ("banana", "fruit"), ("set up", "install"), ("zebra", "zebra"),
    ("bad (note)", "x"), ("empty", ""),
]
#: What makes paths of the pages' urls, and what stands around turns.
FOLDERS, ENDINGS = ["", "vendor/", "docs/", "node_modules/", "x/.git/", "a b/"], [".md", ".MD", ".txt", ".rst", "", ".markdown", ".gen.md", "/CHANGELOG.md"]
FRONTS = [("", ""), ("---\na: 1\n---\n", ""), ("---\n", ""), ("---\r\nb\r\n", "\n...\n"), ("---\n", "\n---")]
FENCES = [("", ""), ("```\n", "\n```"), ("```md\n", "\n``` "), ("```\n", "")]
ALLOW, DENY = [" Valve ", "able", "API", ""], ["api", "Deploy"]
FAMILIES = [("src0", "alpha"), ("src1", "beta"), ("src2", "")]
PROMPT_LINES = ["# describe", "Describe a pump.", "", "  Explain a valve.\t", "\u3000", " # not this", "Why # here?", "Describe a pump."]
PROMPTS = ["Describe a pump.", "Explain a valve."]
#: Words of the phrases that are counted.
LENGTHS = (3, 4)
#: Documents that have a phrase before it counts as common.
HEAVY_DOCUMENTS = 20
SEVERITIES = {"STE.IngForms": "error", "STE.PassiveVoice": "suggestion", "STE.Contractions": "loud"}
DISABLED = ["STE.IngForms", "STE.SlopNominalization"]
#: Replies that never came: (seq, model, family, output, err).
FAILED = [(-2, "src3", "en", "Testing it.", "timed out\nafter 30 s"), (-1, "src3", "fr", None, "no route"), (-3, "none", "xx", None, " refused ")]
FRONT_MATTER = ["---\na: b\n---\nx", "---\r\na\r\n...\r\nx", "---\nnever", "no", "---\n---\n", "a\n---\nb\n---\n", "---\nx: 1\n---", "---\n\n--- \n---\ny"]
FENCED = ["```md\nfixed\n```", "plain", "```\nonly", "text\n```", "```\n\n  x\n``` "]


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text, prose) of all documents, as plain text, and of the fixtures."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), "text")
    fixed = spark.createDataFrame(FIXTURES, "path string, text string, markdown boolean")
    # the mask runs on the fixtures alone
    return parse.with_lines(engine.spread(docs)).unionByName(parse.with_lines(fixed.coalesce(1)))


def over(spark: SparkSession, sf_dir: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """plan over documents and fixtures."""
    return plan(corpus(spark, sf_dir))


def parsed(plan: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: over(spark, sf_dir, plan)


def rule_query(rule_id: str, settings: Settings) -> Callable[[SparkSession, str], DataFrame]:
    return parsed(lambda d: engine.run_rules(d, [r for r in rules(settings) if r.id == rule_id]))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the seven standard rules and the seven others, strict vocabulary off."""
    return over(spark, sf_dir, lambda d: engine.lint(d, Settings()))


def lint_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.in_reading_order(findings(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("path", "text")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every file, read back from its JSON."""
    kind = "struct<findings:array<struct<line:int,col:int,ruleId:string,severity:string,message:string,hint:string,endLine:int,endCol:int,match:string>>>"
    fields = lambda f: F.concat_ws("|", *[F.coalesce(f[c].cast("string"), F.lit("-")) for c in ("line", "col", "ruleId", "severity", "message", "hint", "endLine", "endCol", "match")])
    return report.json(findings(spark, sf_dir)).select("path", "n", F.array_join(F.array_sort(F.transform(F.from_json("json", kind)["findings"], fields)), "\n").alias("findings"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as replies: the source stands for the model, the language for its family; FAILED replies come with them."""
    docs = engine.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))
    good = docs.select(F.col("doc_id").alias("seq"), F.col("source").alias("model"), F.col("lang").alias("family"), F.col("text").alias("output"), F.lit(None).cast("string").alias("err"))
    return good.unionByName(spark.createDataFrame(FAILED, "seq long, model string, family string, output string, err string"))


def chat_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant'")
    rows = rows.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("seq"), F.lit("chat").alias("model"), F.lit("none").alias("family"), F.col("text").alias("output"), F.lit(None).cast("string").alias("err"))
    out = evaluation.samples(rows)  # as Markdown
    return out.select("seq", "words", evaluation.total(F.col("by_rule")).alias("findings"), evaluation.total(F.col("by_rule"), evaluation.SLOP).alias("slop"))


def one_column(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def said_words(spark: SparkSession, sf_dir: str, role: str | None = None) -> DataFrame:
    """(pos, word, next) of all conversations, or of one role's turns: every word between blanks and the one behind it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.where(F.col("role") == role) if role else rows
    rows = rows.select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), r"\s+", -1).alias("w")).select("conv_id", "turn", "w", F.posexplode("w").alias("i", "word"))
    return rows.select(((F.col("conv_id") * 1000 + F.col("turn")) * 100_000 + F.col("i")).alias("pos"), "word", F.coalesce(F.get("w", F.col("i") + 1), F.lit("")).alias("next"))


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substitutions to clean: every word of the conversations with the next one, and the fixtures ahead of them."""
    fixed = spark.createDataFrame([(i - 100, a, b) for i, (a, b) in enumerate(ALTERNATIVES)], "pos long, title string, alt_title string")
    return fixed.unionByName(said_words(spark, sf_dir).select("pos", F.col("word").alias("title"), F.col("next").alias("alt_title")))


def vocab_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs = wordset.substitutions(alternatives(spark, sf_dir))
    return subs.select("word", F.array_join("alternatives", "|").alias("alternatives"))


def vocab_unapproved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of even length count as unapproved here, against the fixtures' substitutions."""
    status = F.when(F.length("word") % 2 == 0, "unapproved").otherwise("approved")
    words = said_words(spark, sf_dir).select(F.col("word").alias("title"), status.alias("wordstatus"))
    fixed = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(ALTERNATIVES)], "pos int, title string, alt_title string")
    return wordset.bare_words(words.unionByName(spark.createDataFrame(WORDS, "title string, wordstatus string")), wordset.substitutions(fixed))


def terms(spark: SparkSession, sf_dir: str, fixed: list[str], role: str | None = None) -> DataFrame:
    """(term): a role's words, those of six letters at most for the user, and the fixtures."""
    own = said_words(spark, sf_dir, role).select(F.col("word").alias("term"))
    return (own.where(F.length("term") <= 6) if role == "user" else own).unionByName(one_column(spark, fixed, "term"))


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, explicit): the pages' urls as paths, in folders and with extensions by their ids, and the fixtures."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % len(values) + 1).cast("int"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = F.concat(pick(FOLDERS), F.regexp_extract("url", "://([^?#]*)", 1), pick(ENDINGS))
    return pages.select(path.alias("path"), (F.col("page_id") % 11 == 0).alias("explicit")).unionByName(spark.createDataFrame(PATHS, "path string, explicit boolean"))


def wrapped(spark: SparkSession, sf_dir: str, around: list[tuple[str, str]], fixed: list[str]) -> DataFrame:
    """(text): the turns of all conversations, each with what stands around it by its conversation's id, and the fixtures."""
    k = F.col("conv_id") % len(around)
    pick = lambda side: F.element_at(F.array(*[F.lit(a[side]) for a in around]), (k + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.concat(pick(0), F.coalesce("text", F.lit("")), pick(1)).alias("text")).unionByName(one_column(spark, fixed, "text"))


def eval_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the users' turns as a prompt file, comments in one conversation of five."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    lines = rows.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("value"), "conv_id")
    lines = lines.select(F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit(" # "), "value")).otherwise(F.concat(F.lit("\t"), "value", F.lit(" "))).alias("value"))
    return evaluation.prompts(lines.unionByName(one_column(spark, PROMPT_LINES, "value")))


def list_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules, each with how many findings the corpus has."""
    counts = findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("n"))
    return report.rule_table(spark, rules(Settings())).join(counts, "rule_id", "left").select("pos", "rule_id", "severity", "description", F.coalesce("n", F.lit(0)).alias("n"))


def scan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("path"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


def suppress_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.suppressed_lines(texts(spark, sf_dir))


def suppress_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.directives(texts(spark, sf_dir)).select("path", "line", "ord", "verb", F.array_join("args", " ").alias("args"))


def suppress_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what the fixtures' directives leave of the ing rule."""
    return over(spark, sf_dir, lambda d: suppress.without_suppressed(engine.run_rules(d, [r for r in rules() if r.id == "STE.IngForms"]), d))


def md_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown: raw HTML vanishes."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("path"), F.col("html").alias("text"), F.lit(True).alias("markdown"))
    return parse.lines(pages).select("path", "line", "masked", "kind", "blank")


def md_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapped(spark, sf_dir, FRONTS, FRONT_MATTER).select("text", markdown.front_matter_end(F.col("text")).alias("front_end"))


def fix_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewriting task of every document, with its findings as a concise report."""
    return evaluation.fix_prompts(texts(spark, sf_dir), report.concise_by_path(findings(spark, sf_dir)))


def _members(members: DataFrame) -> DataFrame:
    return members.select("path", "block_id", "sent_id", *[F.col(f"class.{c}").alias(f"class_{c}") for c in ("path", "block_id", "sent_id")])


def pair_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("a", "b") for c in ("path", "block_id", "sent_id")], "shared", "together")


def vocabulary_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary rule with its word list as a table."""
    subs = spark.createDataFrame([(w, a) for w, a in lex.SUBSTITUTIONS.items()], "word string, alternatives array<string>")
    return over(spark, sf_dir, lambda d: dictionary.findings(d, dictionary.entries(subs, one_column(spark, lex.TECHNICAL_TERMS, "term"))))


def stream_lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns as changes of one document, replayed as a stream: the findings of its last turn stand."""
    # a pattern, as a stream's plain path must be a folder, and a table may be one file
    rows = spark.readStream.schema("conv_id long, turn long, text string").option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/conversation[s].parquet")
    changes = rows.select(F.concat(F.lit("conv:"), "conv_id").alias("path"), F.col("turn").alias("seq"), "text", F.lit(False).alias("closed"))
    return lint_stream.replay(changes, lint_stream.work_folder(spark, "stream-lint"))


def eval_json(rows: DataFrame) -> DataFrame:
    """Every object of the JSON report, read back."""
    kind = "struct<Family:string,Model:string,Models:bigint,Samples:bigint,Errors:bigint,Words:bigint,SlopFindings:bigint,TotalFindings:bigint,SlopPer100Words:double,TotalPer100Word:double,ByRule:map<string,bigint>,FirstError:string>"
    got = evaluation.json_report(rows).select("section", F.from_json("json", kind).alias("r")).select("section", "r.*")
    said = F.array_join(F.array_sort(F.transform(F.map_entries("ByRule"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))), ";")
    return got.select(
        "section", F.col("Family").alias("family"), F.col("Model").alias("model"), F.coalesce("Models", "Samples").alias("size"), F.col("Errors").alias("errors"), F.col("Words").alias("words"),
        F.col("SlopFindings").alias("slop_findings"), F.col("TotalFindings").alias("total_findings"), F.round("SlopPer100Words", 6).alias("slop_per_100"),
        F.round("TotalPer100Word", 6).alias("total_per_100"), said.alias("rules"), F.col("FirstError").alias("first_error"),
    )


def _eval(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(evaluation.samples(replies(spark, sf_dir), markdown=False))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "lines": parsed(parse.lines),
    "blocks": parsed(lambda d: parse.blocks(d).select("path", "block_id", "block_kind", "start", "n_lines", F.md5("body").alias("body_md5"))),
    "tokens": parsed(parse.tokens),
    "words": parsed(parse.words),
    "sentences": parsed(parse.sentence_spans),
    "sentence_word_count": parsed(lambda d: parse.sentence_spans(d).groupBy("path").agg(F.count("*").alias("n_sentences"), F.sum("word_count").alias("n_words"), F.max("word_count").alias("longest"))),
    **{key: rule_query(rule, Settings()) for rule, key in RULE_KEYS.items()},
    "vocabulary_by_join": vocabulary_by_join,
    "rule_vocabulary_all_terms": rule_query("STE.Vocabulary", Settings(allowed=frozenset())),
    "rule_vocabulary_strict": rule_query("STE.Vocabulary", ALL),
    "lint_all": lint_all,
    "lint_min_severity": lambda s, d: engine.at_least(findings(s, d), "Warning "),
    "lint_severity_override": lambda s, d: over(s, d, lambda x: engine.lint(x, Settings(), severities=SEVERITIES)),
    "lint_disabled_rule": lambda s, d: over(s, d, lambda x: engine.lint(x, Settings(), disabled=DISABLED)),
    "gate": lambda s, d: engine.gate(findings(s, d)),
    "suppress_directives": suppress_directives,
    "suppress_map": suppress_map,
    "suppress_filter": suppress_filter,
    "report_summary": lambda s, d: report.summary(findings(s, d)),
    "report_concise_groups": lambda s, d: report.groups(findings(s, d)),
    "report_concise": lambda s, d: report.concise(findings(s, d)),
    "report_text": lambda s, d: report.text(findings(s, d)).select("path", "line", "col", "rule_id", "report"),
    "report_text_color": lambda s, d: report.text(findings(s, d), color=True).select("path", "line", "col", "rule_id", "report"),
    "report_json": report_json,
    "lsp_diagnostics": lambda s, d: report.diagnostics(findings(s, d), texts(s, d)),
    "list_rules": list_rules,
    "vocab_build": vocab_build,
    "vocab_unapproved": vocab_unapproved,
    "vocab_merge": lambda s, d: wordset.merged(terms(s, d, ALLOW + DENY)),
    "allowed_vocabulary": lambda s, d: wordset.allowed(one_column(s, lex.TECHNICAL_TERMS, "term"), terms(s, d, ALLOW, "user"), terms(s, d, DENY, "assistant")),
    "scan_docs": scan_docs,
    "scan_filter_paths": lambda s, d: files.filter_paths(file_paths(s, d), [], ["vendor/*", "*.gen.md", "**/CHANGELOG.md"]),
    "markdown_mode": lambda s, d: file_paths(s, d).select("path", files.is_markdown(F.col("path")).alias("markdown")),
    "eval_tasks": lambda s, d: evaluation.tasks(s.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("model")).distinct(), one_column(s, PROMPTS, "prompt")),
    "eval_family_lookup": lambda s, d: evaluation.with_family(s.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("model")).distinct(), s.createDataFrame(FAMILIES, "model string, family string")),
    "eval_samples": chat_samples,
    "eval_by_rule": _eval(evaluation.by_rule),
    "eval_by_model": _eval(evaluation.by_model),
    "eval_by_family": _eval(lambda r: evaluation.by_family(evaluation.by_model(r))),
    "eval_report": _eval(lambda r: evaluation.text_report(evaluation.by_model(r)).select("section", "report")),
    "stream_lint": stream_lint,
    "eval_rollup": _eval(evaluation.rollup),
    "eval_json": _eval(eval_json),
    "eval_prompts": eval_prompts,
    "rep_n_documents": parsed(lambda d: repetition.rep_n(d, LENGTHS)),
    "rep_n_windows": parsed(lambda d: repetition.rep_n_windows(d, LENGTHS)),
    "rep_heavy_phrases": parsed(lambda d: repetition.heavy_phrases(d, LENGTHS, HEAVY_DOCUMENTS)),
    "restatement_within": parsed(lambda d: pair_rows(repetition.restated_within(d))),
    "restatement_across": parsed(lambda d: pair_rows(repetition.restatements(d, across=True)[1])),
    "restatement_members": parsed(lambda d: _members(repetition.restatements(d, across=True)[0])),
    "word_overuse": parsed(repetition.overused_words),
    "md_mask": md_mask,
    "md_frontmatter": md_frontmatter,
    "fix_prompt": fix_prompt,
    "strip_fence": lambda s, d: wrapped(s, d, FENCES, FENCED).select("text", evaluation.strip_fence(F.col("text")).alias("stripped")),
}
