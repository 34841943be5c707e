"""Reports over findings: text, grouped, summary, JSON and editor diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.tables import materialize
from plumbline.operators.parse import source_lines
from plumbline.operators.rules import Rule

#: Terminal colours and editor severities.
COLORS = {"error": 31, "warning": 33, "suggestion": 36}
EDITOR_SEVERITY = {"error": 1, "warning": 2}
SOURCE = "prose"
#: Characters that take two UTF-16 units.
WIDE = r"[\x{10000}-\x{10FFFF}]"


def place() -> Column:
    return F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"))


def colored(severity: Column) -> Column:
    out = severity
    for name, code in COLORS.items():
        out = F.when(severity == name, F.lit(f"\x1b[{code}m{name}\x1b[0m")).otherwise(out)
    return out


def text(findings: DataFrame, color: bool = False) -> DataFrame:
    """findings plus report: path:line:col: severity: message [rule], and the hint if there is one."""
    severity = colored(F.col("severity")) if color else F.col("severity")
    hint = F.when(F.col("hint") != "", F.concat(F.lit(" hint: "), "hint")).otherwise("")
    return findings.withColumn("report", F.concat(place(), F.lit(": "), severity, F.lit(": "), "message", F.lit(" ["), "rule_id", F.lit("]"), hint))


def rank(severity: Column) -> Column:
    """0 for the most severe."""
    return F.when(severity == "error", 0).when(severity == "warning", 1).otherwise(2)


def groups(findings: DataFrame) -> DataFrame:
    """(rule_id, severity, n, shared_hint): one row per rule; the severity is that of the first finding in reading order.

    The hint is shared only if all findings have it. Counts combine before the shuffle, so a rule with most findings
    is one row per task.
    """
    order = F.struct("path", "line", "col")
    out = findings.groupBy("rule_id").agg(F.min_by("severity", order).alias("severity"), F.count("*").alias("n"), F.when(F.min("hint") == F.max("hint"), F.min("hint")).otherwise("").alias("shared_hint"))
    return out.orderBy(rank(F.col("severity")), "rule_id")


def concise(findings: DataFrame, color: bool = False) -> DataFrame:
    """(seq_rank, rule_id, seq, report): header, shared hint and rows of each rule; order by the first three.

    Every line is a row of its own, so no task gathers the findings of a rule. The findings are read for the groups and
    for the rows, so they are written down first, with the columns that are needed: texts are linted once.
    """
    findings = materialize(findings.select("rule_id", "severity", "path", "line", "col", "message", "hint", "match"), "findings")
    g = groups(findings)
    severity = colored(F.col("severity")) if color else F.col("severity")
    head = g.select(rank(F.col("severity")).alias("seq_rank"), "rule_id", F.lit(0).alias("seq"), F.lit("").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.concat_ws(" · ", "rule_id", severity, F.col("n").cast("string")).alias("report"))
    shared = g.where("shared_hint <> ''").select(rank(F.col("severity")).alias("seq_rank"), "rule_id", F.lit(1).alias("seq"), F.lit("").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col"), F.concat(F.lit("  ↳ "), "shared_hint").alias("report"))
    shown = F.when(F.col("match") == "", F.col("message")).otherwise(F.col("match"))
    own = F.when((F.col("shared_hint") == "") & (F.col("hint") != ""), F.concat(F.lit("  — "), "hint")).otherwise("")
    rows = findings.join(F.broadcast(g.select("rule_id", "shared_hint", F.col("severity").alias("group_severity"))), "rule_id")  # a row per rule
    rows = rows.select(rank(F.col("group_severity")).alias("seq_rank"), "rule_id", F.lit(2).alias("seq"), "path", "line", "col", F.concat(F.lit("  "), place(), F.lit("  "), shown, own).alias("report"))
    return head.unionByName(shared).unionByName(rows)


def concise_by_path(findings: DataFrame) -> DataFrame:
    """(path, issues): the concise report of each file by itself, as one text."""
    shown = F.when(F.col("match") == "", F.col("message")).otherwise(F.col("match"))
    row = F.struct("line", "col", F.concat(place(), F.lit("  "), shown).alias("text"), F.col("hint").alias("hint"))
    first = F.min_by("severity", F.struct("line", "col", "severity"))
    by_rule = findings.groupBy("path", "rule_id").agg(first.alias("severity"), F.count("*").alias("n"), F.when(F.min("hint") == F.max("hint"), F.min("hint")).otherwise("").alias("shared_hint"), F.array_sort(F.collect_list(row)).alias("rows"))
    own = lambda r: F.when((F.col("shared_hint") == "") & (r["hint"] != ""), F.concat(F.lit("  — "), r["hint"])).otherwise("")
    head = F.concat_ws(" · ", "rule_id", "severity", F.col("n").cast("string"))
    parts = F.concat(F.array(head), F.when(F.col("shared_hint") != "", F.array(F.concat(F.lit("  ↳ "), "shared_hint"))).otherwise(F.array().cast("array<string>")), F.transform("rows", lambda r: F.concat(F.lit("  "), r["text"], own(r))))
    by_rule = by_rule.select("path", F.struct(rank(F.col("severity")).alias("rank"), "rule_id", F.array_join(parts, "\n").alias("text")).alias("block"))
    return by_rule.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("block")), lambda b: b["text"]), "\n").alias("issues"))


def summary(findings: DataFrame) -> DataFrame:
    """(errors, warnings, suggestions, total, summary_line)."""
    out = findings.agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in COLORS])
    total = F.col("errors") + F.col("warnings") + F.col("suggestions")
    say = F.format_string("%d problems (%d errors, %d warnings, %d suggestions)", total, "errors", "warnings", "suggestions")
    return out.select("errors", "warnings", "suggestions", total.alias("total"), say.alias("summary_line"))


def json(findings: DataFrame) -> DataFrame:
    """(path, n, json): a file's findings in reading order; empty hint and match are left out."""
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    row = F.struct(F.col("line"), F.col("col"), F.col("rule_id").alias("ruleId"), "severity", "message", blank("hint"), blank("path"), F.col("end_line").alias("endLine"), F.col("end_col").alias("endCol"), blank("match"))
    out = findings.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("findings"))
    return out.select("path", F.size("findings").cast("long").alias("n"), F.to_json(F.struct("path", "findings")).alias("json"))


def json_document(findings: DataFrame) -> DataFrame:
    """(part, path, report): the lines of one JSON document of all files and the summary, in the order of part and path.

    Every file is a row of its own, so no task gathers them. findings are read twice: write them first if they are dear.
    """
    rows = json(findings)
    first = rows.agg(F.min("path").alias("first"))
    body = rows.join(F.broadcast(first)).select(F.lit(1).alias("part"), "path", F.concat(F.when(F.col("path") > F.col("first"), ",").otherwise(""), "json").alias("report"))  # one row
    counts = summary(findings).select(F.to_json(F.struct("errors", "warnings", "suggestions", "total")).alias("counts"))
    head = counts.select(F.lit(0).alias("part"), F.lit("").alias("path"), F.lit('{"results":[').alias("report"))
    tail = counts.select(F.lit(2).alias("part"), F.lit("").alias("path"), F.concat(F.lit('],"summary":'), "counts", F.lit("}")).alias("report"))
    return head.unionByName(body).unionByName(tail)


def utf16_column(line: Column, col: Column) -> Column:
    """UTF-16 units before a 1-based code-point column; columns beyond the line count as its end."""
    return F.when(col <= 1, 0).otherwise((F.octet_length(F.encode(F.substring(line, F.lit(1), col - 1), "UTF-16BE")) / 2).cast("int"))


def diagnostics(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """(path, start_line, start_char, end_line, end_char, severity, code, source, message), positions from 0 in UTF-16 units.

    Columns differ from code points only behind characters outside the basic plane, so findings meet the lines that have
    such characters, by path and line, and no other text.
    """
    lines = docs.select("path", F.posexplode(source_lines(F.col("text"))).alias("i", "src")).where(F.rlike("src", F.lit(WIDE)))
    lines = lines.select(F.col("path").alias("_path"), (F.col("i") + 1).alias("_line"), "src")
    rows = findings
    for n in ("line", "end_line"):
        mine = lines.select(*[F.col(c).alias(f"{c}_{n}") for c in lines.columns])
        rows = rows.join(mine, (F.col("path") == F.col(f"_path_{n}")) & (F.col(n) == F.col(f"_line_{n}")), "left")
    message = F.when(F.col("hint") != "", F.concat_ws(" — ", "message", "hint")).otherwise(F.col("message"))
    at = lambda n, col: F.when(F.col(f"src_{n}").isNull(), F.greatest(F.col(col) - 1, F.lit(0))).otherwise(utf16_column(F.col(f"src_{n}"), F.col(col)))
    severity = F.when(F.col("severity") == "error", 1).when(F.col("severity") == "warning", 2).otherwise(3)
    return rows.select(
        "path", F.greatest(F.col("line") - 1, F.lit(0)).alias("start_line"), at("line", "col").alias("start_char"),
        F.greatest(F.col("end_line") - 1, F.lit(0)).alias("end_line"), at("end_line", "end_col").alias("end_char"),
        severity.alias("severity"), F.col("rule_id").alias("code"), F.lit(SOURCE).alias("source"), message.alias("message"),
    )


def rule_table(spark: SparkSession, some: list[Rule]) -> DataFrame:
    """(pos, rule_id, severity, description) in registration order."""
    return spark.createDataFrame([(i, r.id, r.severity, r.description) for i, r in enumerate(some)], "pos int, rule_id string, severity string, description string")
