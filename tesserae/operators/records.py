"""What a run leaves on record: how long it took, and what was counted while it ran."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def timed_write(df: DataFrame, path: str, partition_by: str | None = None, drop: list[str] | None = None, **counted: Column) -> dict:
    """Write a table and give ``seconds`` and the aggregates ``counted`` on the way, without a second reading.

    Columns to ``drop`` are there to be counted, but not written.
    """
    seen = Observation()
    out = df.observe(seen, *[c.alias(name) for name, c in counted.items()]).drop(*(drop or []))
    start = time.monotonic()
    writer = out.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return {"seconds": max(time.monotonic() - start, 1e-3), **seen.get}


def encode_record(counts: dict) -> dict:
    """Chunks, words (five characters each) and words a second of an encoding run."""
    words = (counts["characters"] or 0) / 5
    return {"chunks": counts["chunks"], "words": words, "seconds": round(counts["seconds"], 3), "words_per_second": round(words / counts["seconds"], 2)}


def search_records(queries: DataFrame, pool: DataFrame, collection_id, owner_id, seconds: float, k: int = 5) -> DataFrame:
    """A row per query (query_id, text): whose search it was, its best ``k`` scores before reranking, response time in ms, and when."""
    scores = pool.where(F.col("rank") <= k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    rows = queries.select("query_id", F.col("text") if "text" in queries.columns else F.lit(None).cast("string").alias("text")).join(scores, "query_id", "left")
    return rows.select(
        F.uuid().alias("record_id"),
        F.lit(collection_id).alias("collection_id"),
        F.lit(owner_id).alias("owner_id"),
        "query_id",
        "text",
        F.coalesce("scores", F.expr("cast(array() as array<double>)")).alias("scores"),
        F.lit(round(1000 * seconds)).cast("long").alias("rt"),
        F.unix_timestamp().alias("ts"),
    )
