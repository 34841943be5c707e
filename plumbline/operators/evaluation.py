"""Scoring of model replies: findings per 100 words by sample, model and family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules import Settings
from plumbline.plans.engine import lint

SLOP = "STE.Slop"
ERROR_BYTES = 160
#: The parts of a rewriting task around the issues and the text.
FIX_TASK = "Correct the text at the end so that none of these issues is left. Change wording alone: meaning, order and markup stay. Answer with the text only.\n\nIssues:\n"
NOTHING_FOUND = "none; simplify wording only where that is plainly better"
FIX_TEXT = "\n\nText:\n"


def prompts(lines: DataFrame) -> DataFrame:
    """(prompt) of lines(value): trimmed, without empty ones and # comments."""
    line = F.regexp_replace("value", r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$", "")
    return lines.select(line.alias("prompt")).where((F.col("prompt") != "") & ~F.col("prompt").startswith("#"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt) of a prompt file; a file without any is an error."""
    out = prompts(spark.read.text(path))
    if out.isEmpty():
        raise ValueError(f"no prompts in {path}")
    return out


def tasks(models: DataFrame, prompts: DataFrame) -> DataFrame:
    """Every (model, prompt): the request list, models times prompts by definition; prompts is the small side."""
    return models.crossJoin(prompts)


def with_family(rows: DataFrame, families: DataFrame) -> DataFrame:
    """rows(model) plus family, unknown where it has none."""
    table = families.groupBy("model").agg(F.max("family").alias("family"))
    return rows.join(table, "model", "left").withColumn("family", F.coalesce(F.expr("nullif(family, '')"), F.lit("unknown")))


def field_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s\x85\p{Z}]+", -1), lambda x: x != ""))


def short_error(text: Column) -> Column:
    """One line, cut to ERROR_BYTES bytes."""
    line = F.trim(F.replace(text, F.lit("\n"), F.lit(" ")))
    cut = F.decode(F.substring(F.encode(line, "UTF-8"), 1, ERROR_BYTES), "UTF-8")
    return F.when(F.octet_length(line) > ERROR_BYTES, F.concat(cut, F.lit("…"))).otherwise(line)


def samples(replies: DataFrame, settings: Settings | None = None, markdown: bool = True) -> DataFrame:
    """replies(seq, model, family, output, err) without output, plus words and by_rule, the reply's findings by rule.

    Replies are linted as Markdown, unless markdown says otherwise; a column of that name decides for each reply. A
    failed reply has no words and no findings. seq names a reply. Words are counted before the counts of findings come
    back, so no reply's text is shuffled.
    """
    good = replies.where("err is null")
    docs = good.select(F.col("seq").alias("path"), F.col("output").alias("text"), *(["markdown"] if "markdown" in replies.columns else [F.lit(True).alias("markdown")] if markdown else []))
    per = lint(docs, settings or Settings(slop=True)).groupBy("path", "rule_id").agg(F.count("*").alias("n"))
    maps = per.groupBy(F.col("path").alias("seq")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("by_rule"))
    words = F.when(F.col("err").isNull(), field_count(F.col("output"))).otherwise(0)
    out = replies.withColumn("words", words.cast("long")).drop("output").join(maps, "seq", "left")
    return out.withColumn("by_rule", F.coalesce("by_rule", F.create_map().cast("map<string,bigint>")))


def total(by_rule: Column, prefix: str = "") -> Column:
    return F.aggregate(F.map_entries(by_rule), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"].startswith(prefix), e["value"]).otherwise(0))


def per_100(count: Column, words: Column) -> Column:
    return F.when(words == 0, 0.0).otherwise(count * 100.0 / words)


def by_rule(rows: DataFrame) -> DataFrame:
    """(model, rule_id, n)."""
    return rows.select("model", F.explode("by_rule").alias("rule_id", "n")).groupBy("model", "rule_id").agg(F.sum("n").alias("n"))


def by_model(rows: DataFrame) -> DataFrame:
    """One row per model. Its family is that of its first sample; failed samples count as samples only."""
    out = rows.groupBy("model").agg(
        F.min_by("family", "seq").alias("family"), F.min("seq").alias("first_seq"), F.count("*").alias("samples"), F.count("err").alias("errors"),
        F.min_by(short_error(F.col("err")), F.when(F.col("err").isNotNull(), F.col("seq"))).alias("first_error"), F.sum("words").alias("words"),
        F.sum(total(F.col("by_rule"), SLOP)).alias("slop_findings"), F.sum(total(F.col("by_rule"))).alias("total_findings"),
    )
    return out.withColumns({"slop_per_100": per_100(F.col("slop_findings"), F.col("words")), "total_per_100": per_100(F.col("total_findings"), F.col("words"))})


def by_family(models: DataFrame) -> DataFrame:
    """One row per family, most slop first; densities are ratios of sums."""
    out = models.groupBy("family").agg(F.count("*").alias("models"), F.min("first_seq").alias("first_seq"), *[F.sum(c).alias(c) for c in ("words", "slop_findings", "total_findings")])
    out = out.withColumns({"slop_per_100": per_100(F.col("slop_findings"), F.col("words")), "total_per_100": per_100(F.col("total_findings"), F.col("words"))})
    return out.orderBy(F.desc("slop_per_100"), "first_seq").drop("first_seq")


#: Levels of the roll-up, each with the columns that it keeps.
LEVELS = [("family", "model", "rule_id"), ("family", "model"), ("family", "rule_id"), ("family",), ("rule_id",), ()]


def rollup(rows: DataFrame) -> DataFrame:
    """(level, family, model, rule_id, n, words, per_100) of samples at all LEVELS, by grouping sets in one pass of partial counts.

    level is the grouping id: which of the three columns are rolled up (family 4, model 2, rule_id 1), and so null. words
    and per_100 are those of levels without rules.
    """
    # a sample is a row for each of its rules and one for its words
    own = F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit(0).cast("long").alias("n"), F.col("words").alias("words"))
    each = F.transform(F.map_entries("by_rule"), lambda e: F.struct(e["key"].alias("rule_id"), e["value"].alias("n"), F.lit(0).cast("long").alias("words")))
    flat = rows.select("family", "model", F.inline(F.concat(F.array(own), each)))
    columns = ["family", "model", "rule_id"]
    out = flat.groupingSets([[F.col(c) for c in level] for level in LEVELS], *columns).agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.grouping_id().alias("level"))
    ruled = F.col("level").bitwiseAND(1) == 0
    out = out.where(~ruled | F.col("rule_id").isNotNull())
    words = F.when(~ruled, F.col("words"))
    return out.select(F.col("level").cast("int").alias("level"), *columns, "n", words.alias("words"), per_100(F.col("n"), words).alias("per_100"))


def json_report(rows: DataFrame) -> DataFrame:
    """(section, place, json): one JSON object for each family, most slop first, and for each model, as first seen; the samples' texts are left out.

    place orders a section's objects. Every object is a row of its own.
    """
    models = by_model(rows)
    families = by_family(models)
    first = models.groupBy("family").agg(F.min("first_seq").alias("first_seq"))
    family = F.struct(
        F.col("family").alias("Family"), F.col("models").alias("Models"), F.col("words").alias("Words"), F.col("slop_findings").alias("SlopFindings"),
        F.col("total_findings").alias("TotalFindings"), F.col("slop_per_100").alias("SlopPer100Words"), F.col("total_per_100").alias("TotalPer100Word"),
    )
    place = lambda density: F.struct(density.alias("density"), "first_seq").alias("place")
    top = families.join(first, "family").select(F.lit("families").alias("section"), place(-F.col("slop_per_100")), F.to_json(family).alias("json"))
    maps = by_rule(rows).groupBy("model").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("rule_id", "n")))).alias("rules"))
    model = F.struct(
        F.col("model").alias("Model"), F.col("family").alias("Family"), F.col("samples").alias("Samples"), F.col("errors").alias("Errors"), F.col("words").alias("Words"),
        F.col("slop_findings").alias("SlopFindings"), F.col("total_findings").alias("TotalFindings"), F.col("slop_per_100").alias("SlopPer100Words"),
        F.col("total_per_100").alias("TotalPer100Word"), F.coalesce("rules", F.create_map().cast("map<string,bigint>")).alias("ByRule"), F.coalesce("first_error", F.lit("")).alias("FirstError"),
    )
    rest = models.join(maps, "model", "left").select(F.lit("models").alias("section"), place(F.lit(0.0)), F.to_json(model).alias("json"))
    return top.unionByName(rest)


#: The lines of the text report.
FAMILY_LINE = "  %-12s slop %6.2f  all %6.2f  (%d models, %d words)"
MODEL_LINE = "  %-28s %-10s slop %6.2f  all %6.2f  (%d words)"


def text_report(models: DataFrame) -> DataFrame:
    """(section, place, report) of by_model rows, ordered by the first two: families, most slop first, then models as first seen."""
    families = by_family(models)
    line = F.format_string(FAMILY_LINE, "family", "slop_per_100", "total_per_100", "models", "words")
    # ties of the density go by the family's first sample
    first = models.groupBy("family").agg(F.min("first_seq").alias("first_seq"))
    place = F.struct((-F.col("slop_per_100")).alias("density"), "first_seq")
    top = families.join(first, "family").select(F.lit(0).alias("section"), place.alias("place"), line.alias("report"))
    note = F.when(F.col("errors") > 0, F.format_string("  [%d errors: %s]", "errors", "first_error")).otherwise("")
    line = F.concat(F.format_string(MODEL_LINE, "model", "family", "slop_per_100", "total_per_100", "words"), note)
    rest = models.select(F.lit(1).alias("section"), F.struct(F.lit(0.0).alias("density"), "first_seq").alias("place"), line.alias("report"))
    return top.unionByName(rest).orderBy("section", "place")


def fix_prompts(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """(path, prompt): the rewriting task of each document with its issues(path, issues)."""
    rows = docs.join(issues, "path", "left")
    return rows.select("path", F.concat(F.lit(FIX_TASK), F.coalesce(F.expr("nullif(trim(issues), '')"), F.lit(NOTHING_FOUND)), F.lit(FIX_TEXT), F.coalesce("text", F.lit(""))).alias("prompt"))


def strip_fence(text: Column) -> Column:
    """Without one code fence that wraps the whole text."""
    lines = F.split(text, "\n", -1)
    wrapped = (F.size(lines) >= 2) & F.rlike(F.element_at(lines, 1), F.lit(r"^\s*```")) & F.rlike(F.element_at(lines, -1), F.lit(r"^\s*```\s*$"))
    return F.when(wrapped, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(text)
