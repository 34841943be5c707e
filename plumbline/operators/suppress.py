"""Suppression directives in comments: regions for all rules or one, this line, the next line.

Only documents that hold a directive are taken apart into lines. A region is one row, and a document's regions are one
sorted array per rule, in which a finding's line is found by halving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.arrays import running

#: The word that opens a directive, as in <!-- lint off -->; a parameter, so that other tools' directives work.
KEYWORD = "lint"
#: The last line of a region that is never closed.
END = 2**31 - 1


def pattern(keyword: str = KEYWORD) -> str:
    return rf"(?i)<!--\s*{keyword}\s+(.*?)\s*-->"


def directives(docs: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """(path, line, ord, verb, args): every directive of the raw lines, from left to right; verb is lower-cased."""
    some = docs.where(F.rlike(F.coalesce("text", F.lit("")), F.lit(pattern(keyword))))
    rows = some.select("path", F.posexplode(F.split("text", "\n", -1)).alias("i", "src"))
    rows = rows.select("path", (F.col("i") + 1).alias("line"), F.posexplode(F.regexp_extract_all("src", F.lit(pattern(keyword)), F.lit(1))).alias("ord", "body"))
    rows = rows.withColumn("toks", F.filter(F.split("body", r"\s+", -1), lambda t: t != "")).where(F.size("toks") > 0)
    return rows.select("path", "line", "ord", F.lower(F.get("toks", 0)).alias("verb"), F.get("toks", 0).alias("first"), F.slice("toks", 2, 2**31 - 2).alias("args"))


def spans(docs: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """(path, rule_id, first, last): stretches of suppressed lines, a row each however long; rule_id * stands for all, a null last for the end.

    A region's state is that after the line's last directive: off covers its own line, on frees its own. Spans of one
    rule may overlap.
    """
    ds = directives(docs, keyword)
    # a toggle: rule (or *) and its new state
    alone = F.col("verb").isin("off", "on")
    line = F.col("verb").isin("disable-line", "disable-next-line")
    named = ~alone & ~line & (F.size("args") == 2) & (F.get("args", 0) == "=") & F.upper(F.get("args", 1)).isin("NO", "YES")
    off = F.when(alone, F.col("verb") == "off").otherwise(F.upper(F.get("args", 1)) == "NO")
    toggles = ds.where(alone | named).select("path", "line", "ord", F.when(alone, "*").otherwise(F.col("first")).alias("rule_id"), off.alias("off"))
    toggles = toggles.groupBy("path", "rule_id", "line").agg(F.max_by("off", "ord").alias("off"))
    until = F.lead("line").over(Window.partitionBy("path", "rule_id").orderBy("line"))
    regions = toggles.withColumn("until", until).where("off").select("path", "rule_id", F.col("line").alias("first"), (F.col("until") - 1).alias("last"))
    ids = F.when(F.size("args") == 0, F.array(F.lit("*"))).otherwise(F.col("args"))
    at = F.col("line") + (F.col("verb") == "disable-next-line").cast("int")
    single = ds.where(line).select("path", F.explode(ids).alias("rule_id"), at.alias("first"), at.alias("last"))
    return regions.unionByName(single)


def suppressed_lines(docs: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """(path, line, rule_id): what is suppressed where, a row for each line: for reading; findings are filtered by spans."""
    some = docs.where(F.rlike(F.coalesce("text", F.lit("")), F.lit(pattern(keyword))))
    ends = some.select("path", F.size(F.split("text", "\n", -1)).alias("end"))
    rows = spans(docs, keyword).join(ends, "path")
    return rows.select("path", F.explode(F.sequence("first", F.coalesce("last", F.greatest("end", "first")))).alias("line"), "rule_id").distinct()


def span_index(docs: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """(path, by_rule): for each document with directives a map from rule to its spans, sorted, each with the farthest end so far."""
    row = F.struct("first", F.coalesce("last", F.lit(END)).alias("last"))
    own = spans(docs, keyword).groupBy("path", "rule_id").agg(F.array_sort(F.collect_list(row)).alias("spans"))
    ahead = running(F.transform("spans", lambda s: s["last"]), lambda a, b: F.greatest(a, b))
    reach = F.zip_with("spans", ahead, lambda s, a: F.struct(s["first"].alias("first"), F.greatest(s["last"], a).alias("reach")))
    return own.select("path", "rule_id", reach.alias("spans")).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("rule_id", "spans"))).alias("by_rule"))


def covers(found: Column, line: Column) -> Column:
    """Whether a sorted array<struct<first, reach>> has a span over the line: the spans that begin up to it are found by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        before = F.get(found, middle)["first"] <= line
        return F.when(s["low"] >= s["high"], s).when(before, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    steps = F.ceil(F.log2(F.size(found).cast("double") + 1)).cast("int")
    count = F.aggregate(F.sequence(F.lit(0), steps), F.struct(F.lit(0).alias("low"), F.size(found).alias("high")), halve)["low"]
    return F.coalesce(F.get(found, count - 1)["reach"] >= line, F.lit(False))


def without_suppressed(findings: DataFrame, docs: DataFrame, keyword: str = KEYWORD) -> DataFrame:
    """findings without those whose start line is suppressed for their rule or for all.

    Findings meet one row for each document with directives, whatever its lines are; Spark broadcasts those while they are small.
    """
    index = span_index(docs, keyword).select(F.col("path").alias("_path"), F.col("by_rule").alias("_by_rule"))
    rows = findings.join(index, F.col("path") == F.col("_path"), "left")
    over = lambda rule: covers(F.element_at("_by_rule", rule), F.col("line"))
    kept = rows.where(F.col("_by_rule").isNull() | ~(over(F.col("rule_id")) | over(F.lit("*"))))
    return kept.drop("_path", "_by_rule")
