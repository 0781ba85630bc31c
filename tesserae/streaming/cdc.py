"""Rules that turn changes of resources into pipeline events, and their stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import url_extension, url_host

#: An update of any of these is no news; what a failed message is called.
IGNORED = ["metadata"]


def relevant(changes: DataFrame) -> DataFrame:
    """Without changes that have no document, and without updates of ignored fields."""
    ignored = F.arrays_overlap("updated", F.array(*map(F.lit, IGNORED)))
    return changes.where(F.col("resource_id").isNotNull() & ~((F.col("op") == "update") & F.coalesce(ignored, F.lit(False))))


def with_url_parts(changes: DataFrame) -> DataFrame:
    return changes.withColumn("domain", url_host(F.col("url"))).withColumn("extension", url_extension(F.col("url")))


def dead_letters(changes: DataFrame) -> DataFrame:
    """Changes with a URL that can't be parsed."""
    return changes.where(unparsable())


def unparsable() -> Column:
    return F.col("url").isNotNull() & url_host(F.col("url")).isNull()


def event_names() -> Column:
    """Events of a change in order: inserts load or chunk; updates load, delete and chunk, delete."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    touched = lambda f: F.coalesce(F.array_contains("updated", f), F.lit(False))
    load = F.when(touched("url") & has("url") | has("url") & touched("refreshedAt"), F.lit("load"))
    content = touched("content")
    updates = F.array(load, F.when(content, F.lit("delete")), F.when(content, F.lit("chunk")), F.when(touched("isDeleted") & F.col("is_deleted"), F.lit("delete")))
    inserts = F.array(F.when(has("url"), F.lit("load")).when(has("content"), F.lit("chunk")))
    nothing = F.expr("cast(array() as array<string>)")
    return F.array_compact(F.when(F.col("op") == "insert", inserts).when(F.col("op") == "update", updates).otherwise(nothing))


def events(changes: DataFrame) -> DataFrame:
    """One row per event, ``ord`` counting a change's events."""
    rows = with_url_parts(relevant(changes))
    return rows.select("token", "resource_id", "domain", "extension", F.posexplode(event_names()).alias("ord", "event"))


def statuses(found: DataFrame) -> DataFrame:
    """Latest status of each resource: what its last event leaves it in."""
    status = F.when(F.col("event") == "load", "loaded").when(F.col("event") == "chunk", "chunked").otherwise("deleted")
    return found.groupBy("resource_id").agg(F.max_by(status, F.struct("token", "ord")).alias("status"), F.max("token").alias("token"))


def unchanged_loads(loaded: DataFrame, stored: DataFrame) -> DataFrame:
    """(resource_id, status): text equal to what is stored needs no write."""
    both = loaded.join(stored.select("resource_id", F.col("content").alias("old")), "resource_id", "left")
    return both.select("resource_id", F.when(F.col("content").eqNullSafe(F.col("old")), "chunked").otherwise("loaded").alias("status"))


def run_stream(source: DataFrame, events_path: str, failed_path: str, checkpoint: str, trigger: dict | None = None):
    """Write events and dead letters of a change stream, batch by batch.

    Files of a batch are replaced when it is repeated, so a restart after a
    failure between the sinks neither loses nor doubles events.
    """
    def each(batch: DataFrame, number: int) -> None:
        bad, good = dead_letters(batch), batch.where(~unparsable())
        events(good).write.mode("overwrite").parquet(f"{events_path}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{failed_path}/batch={number}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
