"""Tables between the steps of a job: in the folder all executors share, and a filter before joins."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base and not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="spark-plumbline-"))
        atexit.register(shutil.rmtree, _OWN[0].removeprefix("file://"), ignore_errors=True)
    return (base or _OWN[0]).rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize that nothing will read again: what is left of the job has been written since."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search(r"-[0-9a-f]{32}$", folder):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: 64-bit words of the bitmap that passes over rows without a partner.
BITMAP_WORDS = 1 << 17


def likely(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows whose key (never null) stands in wanted, and few others: a filter before a join by that key, which it leaves exact.

    The filter is a bitmap of BITMAP_WORDS words over hashes of the keys, broadcast: never more rows than that, however
    many keys there are. Where they fill it, all rows pass.
    """
    word = lambda h: F.pmod(F.shiftright(h, 6), F.lit(BITMAP_WORDS))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    bits = wanted.select(F.xxhash64(wanted_key).alias("h")).groupBy(word(F.col("h")).alias("_word")).agg(F.bit_or(bit(F.col("h"))).alias("_bits"))
    hashed = F.xxhash64(key)
    return rows.join(F.broadcast(bits), word(hashed) == F.col("_word")).where(F.col("_bits").bitwiseAND(bit(hashed)) != 0).drop("_word", "_bits")
