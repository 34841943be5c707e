"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
Decisions are taken for rows, known by id and text: a repeated or null doc_id takes no other text with it. Documents
without letters (null and empty texts among them) go in the first stage. Columns may have any name. An empty table
passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language_id, minhash_dedup, secret_scans, sentencepiece_codec, source_mixing
from plumbline.llm.common import materialize, table
from plumbline.llm.queries import PIECES_PATH, held_out


def fresh(docs: DataFrame, name: str) -> str:
    """name, or it with underscores added until docs has no such column (Spark compares names without case)."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def row_key(docs: DataFrame) -> Column:
    """What a row is known by: its id, null ids last, and its text; rows that share both are copies in every way."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("text"), F.col("text").isNull().alias("no_text"))


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with its row keys, and the name of their column."""
    key = fresh(docs, "row_key")
    return docs.withColumn(key, row_key(docs)), key


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language ID rejects: no letters, or an entropy far above every learned language's.

    The verdict depends on the text alone, so it is taken back to the rows by the text.
    """
    key = fresh(docs, "text_key")
    texts = docs.withColumn(key, F.md5("text"))
    got = language_id.identify(texts.select(key, "doc_id", "text", "lang"), ~held_out(), doc_id=key)
    out = materialize(got.where(F.col("rejected") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias(key)).distinct(), "rejected")
    return texts.join(out, key, "left_anti").where(F.rlike("text", F.lit(r"\p{L}"))).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that of the smallest id (null ids last), then of the smallest text hash.

    Rows of one id and text become one. Texts that share nothing but the id stay.
    """
    rows, key = keyed(docs)
    got = materialize(minhash_dedup.near_duplicates(rows.select(key, "text"), doc_id=key), "near-groups")
    out = got.where("not kept").select(F.col("doc_id").alias(key)).distinct()
    again = got.where("kept").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key)
    left = rows.join(materialize(out.unionByName(again), "near-copies"), key, "left_anti")
    return left.unionByName(rows.join(materialize(again, "repeated-rows"), key, "left_semi").dropDuplicates([key])).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the texts; no document goes. n_chars follows the text."""
    out = secret_scans.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes its words, rounded: none, once or twice. Copies of a row share alike."""
    rows, key = keyed(docs)
    times, turn = fresh(docs, "times"), fresh(docs, "turn")
    taken = source_mixing.mix(rows.select(key, "text", "source"), doc_id=key)
    taken = taken.where("size > 0").groupBy(F.col("doc_id").alias(key)).agg(F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int").alias(times)).where(F.col(times) > 0)
    return rows.join(taken, key).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, exact)."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load(PIECES_PATH), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("minhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Language ID and near-dedup have no SQL form; tests/llm/test_pipeline.py holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
