"""Changes read from a table in order of their token, a bounded batch at a time, with a resume token.

For sources that can be asked for what comes after a token, but that no stream
reader of Spark knows: a database's change table, an archive of changes.  The
resume token is stored after a batch has been handed on, so a stop in between
repeats the batch, under its number, and sinks that replace a batch's files
neither lose nor double anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "number long, after string, upto string"


def pointer(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """Number of the last batch handed on, and the last token of it; -1 and none at the start."""
    rows = spark.read.schema(POINTER).option("ignoreMissingFiles", True).parquet(f"{path}/token") if _exists(spark, f"{path}/token") else None
    last = rows.orderBy(F.desc("number")).first() if rows is not None else None
    return (last["number"], last["upto"]) if last else (-1, None)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def next_batch(changes: DataFrame, after: str | None, limit: int, token: str = "token") -> tuple[DataFrame, str] | None:
    """Up to ``limit`` changes that follow ``after``, and the last of their tokens; all those of one token stay together."""
    kind = changes.schema[token].dataType
    rest = changes if after is None else changes.where(F.col(token) > F.lit(after).cast(kind))
    rest = rest.where(F.col(token).isNotNull())
    # the order is settled on tokens alone; the filter by them reaches the scan
    upto = rest.select(token).orderBy(token).limit(limit).agg(F.max(token).cast("string").alias("upto")).first()["upto"]
    return None if upto is None else (rest.where(F.col(token) <= F.lit(upto).cast(kind)), upto)


def run(changes: DataFrame, path: str, hand_on: Callable[[DataFrame, int], None], limit: int = 100_000, batches: int | None = None, token: str = "token") -> int:
    """Hand on what has come since the stored token, batch after batch; gives how many there were.

    ``hand_on`` gets a batch and its number.  At most ``batches`` are taken.
    """
    spark, done = changes.sparkSession, 0
    number, after = pointer(spark, path)
    while batches is None or done < batches:
        found = next_batch(changes, after, limit, token)
        if found is None:
            break
        batch, upto = found
        hand_on(batch, number + 1)
        spark.createDataFrame([(number + 1, after, upto)], POINTER).coalesce(1).write.mode("overwrite").parquet(f"{path}/token/batch={number + 1}")
        number, after, done = number + 1, upto, done + 1
    return done
