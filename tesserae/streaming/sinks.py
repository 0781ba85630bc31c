"""Messages as files: one sink, or the same messages to several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def messages(rows: DataFrame) -> DataFrame:
    """Rows as JSON (value); null fields are left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def fan_out(rows: DataFrame, number: int, paths: list[str]) -> None:
    """Batch ``number`` to every path; a repeated batch replaces its files."""
    out = messages(rows)
    for path in paths:
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")


def run_stream(source: DataFrame, paths: list[str], checkpoint: str, trigger: dict | None = None):
    """A stream of rows to every path."""
    def each(batch: DataFrame, number: int) -> None:
        fan_out(batch, number, paths)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
