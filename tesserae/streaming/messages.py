"""Messages of the pipeline: their form, and what makes one invalid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.streaming import cdc

EVENT = "event string, resourceId string, collectionId string, ownerId string, url string, data string, vectorSource string"


def parsed(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Adds ``message``, and ``reason`` where it is none of the known events; null if it is valid."""
    out = messages.withColumn("message", F.from_json(F.col(value_col), EVENT))
    empty = lambda c: F.coalesce(F.trim(F.col(f"message.{c}")), F.lit("")) == ""
    event = F.col("message.event")
    reason = (
        F.when(F.col("message").isNull() | event.isNull() | ~event.isin("load", "chunk", "delete", "update"), F.lit("unknown event"))
        .when(empty("resourceId"), F.lit("no resource"))
        .when((event == "load") & empty("url"), F.lit("no url"))
        .when((event == "chunk") & empty("data"), F.lit("empty content"))
    )
    return out.withColumn("reason", reason)


def of_changes(changes: DataFrame) -> DataFrame:
    """Messages (token, ord, value) that the changes of resources give, in each change's order.

    changes: token, op, resource_id, url, content, is_deleted, updated [, collection_id, owner_id].
    """
    text = lambda c: (F.col(c) if c in changes.columns else F.lit(None)).cast("string")
    kept = changes.withColumn("_as", F.struct(text("resource_id").alias("resourceId"), text("collection_id").alias("collectionId"), text("owner_id").alias("ownerId"), text("url").alias("url"), text("content").alias("data")))
    rows = cdc.relevant(kept).select("token", "_as", F.posexplode(cdc.event_names()).alias("ord", "event"))
    return rows.select("token", "ord", F.to_json(F.struct("event", "_as.*")).alias("value"))


def of_loads(loaded: DataFrame) -> DataFrame:
    """Messages that newly loaded contents give: what was stored goes, then the new text is chunked.

    loaded: token, resource_id, collection_id, owner_id, content.
    """
    change = loaded.select("token", F.lit("update").alias("op"), "resource_id", F.lit(None).cast("string").alias("url"), "content", F.lit(False).alias("is_deleted"), F.array(F.lit("content")).alias("updated"), "collection_id", "owner_id")
    return of_changes(change)
