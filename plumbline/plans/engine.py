"""lint: documents to findings, in one narrow pass, then suppression, severities and order."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.arrays import let
from plumbline.operators import parse, suppress
from plumbline.operators.rules import Rule, Settings, rules

RANK = {"error": 3, "warning": 2, "suggestion": 1}
COLUMNS = ["rule_id", "severity", "message", "hint", "path", "line", "col", "end_line", "end_col", "match"]


def rank(severity: Column) -> Column:
    """error 3, warning 2, suggestion 1, anything else 0."""
    out = F.lit(0)
    for name, r in RANK.items():
        out = F.when(severity == name, r).otherwise(out)
    return out


def spread(docs: DataFrame) -> DataFrame:
    """docs over at least as many partitions as there are cores: an input of a file or two would keep one core busy.

    Inputs that have enough partitions pass unchanged, so nothing large is ever shuffled here.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def run_rules(docs: DataFrame, some: Iterable[Rule], deal: int = 0) -> DataFrame:
    """Findings of the rules with their default severities, unordered; docs(path, text[, markdown]).

    deal: for inputs of a few very long texts, the partitions that sentences are dealt to; their texts are shuffled once.
    """
    some = list(some)
    rows = parse.sentences(docs, deal)
    if not some:
        return rows.limit(0).select(*[F.lit(0).alias(c) if c in ("line", "col", "end_line", "end_col") else F.col("path") if c == "path" else F.lit("").alias(c) for c in COLUMNS])
    return rows.select("path", F.inline(_findings(tuple(some), docs.sparkSession.sparkContext.applicationId))).select(*COLUMNS)


@lru_cache(maxsize=64)
def _findings(some: tuple[Rule, ...], application: str) -> Column:
    """The findings of a sentence row. Thousands of small expressions make it up, so it is put together once an application."""
    checked = lambda toks, words: F.concat(*[F.transform(r.check(F.col("block_kind"), toks, words), _named(r)) for r in some])
    return let(F.col("toks"), lambda toks: let(parse.words_of(toks), lambda words: checked(toks, words)))


def _named(r: Rule) -> object:
    return lambda f: F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.severity).alias("severity"), *[f[c].alias(c) for c in ("message", "hint", "line", "col", "end_line", "end_col", "match")])


def override(findings: DataFrame, severities: Mapping[str, str]) -> DataFrame:
    """Replaces severities by rule; values that are no severity are ignored."""
    good = {k: v for k, v in severities.items() if v in RANK}
    if not good:
        return findings
    table = F.create_map(*[F.lit(x) for kv in sorted(good.items()) for x in kv])
    return findings.withColumn("severity", F.coalesce(F.element_at(table, F.col("rule_id")), F.col("severity")))


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of that severity and above; all of them if it is none."""
    name = severity.strip().lower()
    return findings.where(rank(F.col("severity")) >= RANK[name]) if name in RANK else findings


def lint(docs: DataFrame, settings: Settings | None = None, disabled: Iterable[str] = (), severities: Mapping[str, str] | None = None, least: str = "", keyword: str = suppress.KEYWORD, deal: int = 0) -> DataFrame:
    """All findings of docs(path, text[, markdown]) that no directive suppresses, unordered; deal as in run_rules."""
    off = set(disabled)
    out = run_rules(docs, [r for r in rules(settings) if r.id not in off], deal)
    out = suppress.without_suppressed(override(out, severities or {}), docs, keyword)
    return at_least(out, least)


def in_reading_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy("path", "line", "col", "rule_id")


def gate(findings: DataFrame, severity: str = "error") -> DataFrame:
    """One row: failed, whether any finding reaches the severity (error, if it is none)."""
    least = RANK.get(severity.strip().lower(), RANK["error"])
    return findings.agg(F.coalesce(F.bool_or(rank(F.col("severity")) >= least), F.lit(False)).alias("failed"))
