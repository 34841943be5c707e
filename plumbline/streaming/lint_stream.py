"""Linting of streams: each micro-batch runs the batch plan on the latest text of every changed document."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.rules import Settings
from plumbline.plans.engine import lint


def latest(changes: DataFrame) -> DataFrame:
    """The last change per path of changes(path, seq, text, closed)."""
    last = changes.groupBy("path").agg(F.max_by(F.struct("text", "closed"), "seq").alias("x"), F.max("seq").alias("seq"))
    return last.select("path", "seq", F.col("x.text").alias("text"), F.col("x.closed").alias("closed"))


def with_stored_text(changes: DataFrame) -> DataFrame:
    """A streaming changes(path, seq, text, closed), one row per path and batch: its last change, with the text it has then.

    A change without a text, such as a save, stands for the text stored for its path; a change older than the stored one
    counts for nothing, and a save without a stored text gives no row. The state holds the open documents alone: a
    closed one leaves it.
    """

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, text = state.get if state.exists else (None, None)
        closed, news = False, False
        for part in parts:
            for s, t, c in part[["seq", "text", "closed"]].sort_values("seq", kind="stable").itertuples(index=False):
                if seq is None or s >= seq:
                    seq, text, closed, news = int(s), text if pd.isna(t) else t, not pd.isna(c) and bool(c), True
        if closed:
            if state.exists:
                state.remove()
        elif news and text is not None:
            state.update((seq, text))
        if news and (closed or text is not None):
            yield pd.DataFrame({"path": [key[0]], "seq": [seq], "text": [text], "closed": [closed]})

    keep = "seq long, text string"
    return changes.groupBy("path").applyInPandasWithState(step, "path string, seq long, text string, closed boolean", keep, "update", GroupStateTimeout.NoTimeout)


def lint_changes(changes: DataFrame, settings: Callable[[], Settings] = Settings) -> DataFrame:
    """Findings of the documents as they stand after the changes; a closed document has none."""
    return lint(latest(changes).where("not coalesce(closed, false)").select("path", "text"), settings())


def start(changes: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, settings: Callable[[], Settings] = Settings, stored: bool = True, **trigger: object) -> StreamingQuery:
    """Runs sink(findings, documents, batch) for every micro-batch of a streaming changes(path, seq, text, closed).

    settings is called once a batch, so learned vocabulary takes effect with the next one. documents lists the paths of
    the batch, closed ones too, so that a sink can replace what it holds of them. stored: texts are kept between batches
    (with_stored_text).
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        try:
            sink(lint_changes(df, settings), latest(df).select("path", "closed"), number)
        finally:
            df.unpersist()

    if stored:
        changes = with_stored_text(changes).writeStream.outputMode("update")
    else:
        changes = changes.writeStream
    query = changes.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (query.trigger(**trigger) if trigger else query).start()


def into_tables(folder: str) -> Callable[[DataFrame, DataFrame, int], None]:
    """A sink that writes each batch's findings and documents to a folder of its own; a batch that runs again replaces what it wrote."""

    def sink(findings: DataFrame, documents: DataFrame, number: int) -> None:
        findings.write.mode("overwrite").parquet(f"{folder}/findings/batch={number}")
        documents.write.mode("overwrite").parquet(f"{folder}/documents/batch={number}")

    return sink


def standing(spark: SparkSession, folder: str) -> DataFrame:
    """The findings that stand after all batches of into_tables: those of the last batch that saw their document, none of closed ones."""
    seen = spark.read.parquet(f"{folder}/documents").groupBy("path").agg(F.max("batch").alias("batch"), F.max_by(F.coalesce("closed", F.lit(False)), "batch").alias("closed"))
    rows = spark.read.parquet(f"{folder}/findings")
    return rows.join(seen.where("not closed").select("path", "batch"), ["path", "batch"], "left_semi").select(*[c for c in rows.columns if c != "batch"])


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-plumbline-")
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def replay(changes: DataFrame, folder: str, settings: Callable[[], Settings] = Settings) -> DataFrame:
    """The findings that stand after all that a streaming changes(path, seq, text, closed) holds now.

    The folder keeps the stream's place and the tables: a replay into the same one goes on where the last one ended.
    """
    start(changes, into_tables(folder), f"{folder}/checkpoint", settings, availableNow=True).awaitTermination()
    return standing(changes.sparkSession, folder)


def file_changes(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as changes: lint on write."""
    rows = spark.readStream.text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.unix_micros(F.col("_metadata.file_modification_time")).alias("seq"), F.col("value").alias("text"), F.lit(False).alias("closed"))
