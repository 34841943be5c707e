"""Vocabulary sources: a wordset of approved and unapproved words becomes substitutions and bare words."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Titles that are plain words or phrases.
TITLE = r"^[a-z]+(?:[-' ][a-z]+)*$"


def read_wordset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words(title, wordstatus), alternatives(pos, title, alt_title)) of a wordset file."""
    raw = spark.read.schema("words array<struct<title:string,wordstatus:string>>, alternatives array<struct<title:string,alt_title:string>>").json(path, multiLine=True)
    return raw.select(F.inline("words")), raw.select(F.posexplode("alternatives").alias("pos", "a")).select("pos", "a.title", "a.alt_title")


def substitutions(alternatives: DataFrame) -> DataFrame:
    """(word, alternatives): clean titles, without empty alternatives, themselves and repeats, in the order of pos."""
    good = alternatives.where(F.rlike("title", F.lit(TITLE)) & (F.col("alt_title") != "") & (F.lower("alt_title") != F.lower("title")))
    once = good.groupBy("title", "alt_title").agg(F.min("pos").alias("pos"))
    rows = once.groupBy(F.col("title").alias("word")).agg(F.array_sort(F.collect_list(F.struct("pos", "alt_title"))).alias("a"))
    return rows.select("word", F.transform("a", lambda x: x["alt_title"]).alias("alternatives"))


def bare_words(words: DataFrame, subs: DataFrame) -> DataFrame:
    """(word): unapproved clean titles that have no substitution."""
    bad = words.where((F.col("wordstatus") == "unapproved") & F.rlike("title", F.lit(TITLE))).select(F.col("title").alias("word")).distinct()
    return bad.join(subs.select("word"), "word", "left_anti")


def normalized(term: Column) -> Column:
    return F.lower(F.regexp_replace(term, r"^[\s\x85\p{Z}]+|[\s\x85\p{Z}]+$", ""))


def merged(terms: DataFrame) -> DataFrame:
    """(term): terms trimmed, lower-cased, without empty ones and repeats."""
    return terms.select(normalized(F.col("term")).alias("term")).where("term <> ''").distinct()


def allowed(builtin: DataFrame, allow: DataFrame, deny: DataFrame) -> DataFrame:
    """(term): built-in and allowed terms without denied ones."""
    return merged(builtin.select("term").unionByName(allow.select("term"))).join(merged(deny), "term", "left_anti")


def allowed_set(builtin: Iterable[str], allow: Iterable[str], deny: Iterable[str], with_builtin: bool = True) -> frozenset[str]:
    """The same for the lists of a configuration."""
    clean = lambda terms: {t.strip().lower() for t in terms}
    return frozenset(((clean(builtin) if with_builtin else set()) | clean(allow)) - clean(deny) - {""})


def to_settings(subs: DataFrame) -> dict[str, list[str]]:
    """Substitutions as the rules take them; a wordset is a dictionary of words, bounded by language, not by the corpus."""
    return {r["word"]: list(r["alternatives"]) for r in subs.collect()}


def write_substitutions(subs: DataFrame, path: str) -> None:
    """One JSON file of the substitutions, sorted by word: the same rows give the same file. Bounded like to_settings."""
    subs.select("word", "alternatives").repartition(1).sortWithinPartitions("word").write.mode("overwrite").json(path)


def read_substitutions(spark: SparkSession, path: str) -> DataFrame:
    """(word, alternatives) as written."""
    return spark.read.schema("word string, alternatives array<string>").json(path)
