"""Settling of messages: per resource and in token order, with what is stored as keyed state.

A message is load, chunk, delete or update.  A load compares what was fetched
with the stored content's digest; a chunk saves to the stores, a delete clears a
resource from both; an update changes nothing.  Nothing is lost: what can't be
settled, and what was settled before, comes out with a reason.

State per resource: the token settled last and the digest of the stored content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tesserae.streaming.messages import parsed

#: What a message needs to be settled; its texts stand beside and pass through.
COLUMNS = ["key", "token", "ord", "value", "event", "resource_id", "collection_id", "owner_id", "data", "vector_source", "content", "digest", "reason"]
SETTLED = "token long, ord int, value string, event string, resource_id string, collection_id string, owner_id string, data string, vector_source string, content string, action string, status string, reason string"
#: Statuses that a message leaves its resource in.
LOADED, CHUNKED, DELETED, ERROR = "loaded", "chunked", "deleted", "error"
REPEATED = "settled before"


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def to_settle(messages: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """Messages (token, value [, ord]) parsed, with what the loaders got for their URLs (url, content)."""
    rows = parsed(messages if "ord" in messages.columns else messages.withColumn("ord", F.lit(0)))
    load = F.col("message.event") == "load"
    if fetched is None:
        rows = rows.withColumn("content", F.lit(None).cast("string"))
    else:
        got = fetched.select(F.col("url").alias("_url"), "content").dropDuplicates(["_url"])
        rows = rows.join(got, load & F.col("reason").isNull() & (F.col("message.url") == F.col("_url")), "left")
    reason = F.coalesce("reason", F.when(load & F.col("content").isNull(), F.lit("nothing fetched")))
    return rows.select(
        # messages without a resource have no order to keep; they are dealt by their own text
        F.coalesce(F.col("message.resourceId"), F.concat(F.lit("\0"), F.sha2(F.coalesce("value", F.lit("")).cast("binary"), 256))).alias("key"),
        F.col("token").cast("long").alias("token"),
        F.col("ord").cast("int").alias("ord"),
        "value",
        F.col("message.event").alias("event"),
        F.col("message.resourceId").alias("resource_id"),
        F.col("message.collectionId").alias("collection_id"),
        F.col("message.ownerId").alias("owner_id"),
        F.col("message.data").alias("data"),
        F.col("message.vectorSource").alias("vector_source"),
        "content",
        digest(F.col("content")).alias("digest"),
        reason.alias("reason"),
    )


def decide(event: str, digest: str | None, stored: str | None) -> tuple[str | None, str | None]:
    """(action, status) of a valid message."""
    if event == "load":
        return (None, CHUNKED) if digest == stored else ("write", LOADED)
    return {"chunk": ("save", CHUNKED), "delete": ("delete", DELETED)}.get(event, (None, None))


class Settler(StatefulProcessor):
    """Settles a resource's messages one after the other."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "token long, ord int, digest string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        if key[0].startswith("\0"):
            for f in rows:
                yield self._out(f, [None] * len(f), [None] * len(f), f["reason"])
            return
        f = pd.concat(rows).sort_values(["token", "ord"], kind="stable")
        token, place, stored = self.last.get() if self.last.exists() else (None, 0, None)
        actions, statuses, reasons = [], [], []
        for own, at, event, found, fault in zip(f["token"], f["ord"], f["event"], f["digest"], f["reason"], strict=True):
            if token is not None and (own, at) <= (token, place):
                action, status, fault = None, None, REPEATED
            elif isinstance(fault, str):
                action, status, token, place = None, ERROR, own, at
            else:
                action, status = decide(event, found, stored)
                stored = found if action == "write" else stored
                token, place = own, at
            actions.append(action)
            statuses.append(status)
            reasons.append(fault)
        if token is not None:
            self.last.update((int(token), int(place), stored))
        yield self._out(f, actions, statuses, reasons)

    def handleInitialState(self, key, initial: pd.DataFrame, timer_values) -> None:
        self.last.update((-1, 0, initial["digest"].iloc[0]))

    @staticmethod
    def _out(f: pd.DataFrame, actions: list, statuses: list, reasons: list) -> pd.DataFrame:
        kept = f[["token", "ord", "value", "event", "resource_id", "collection_id", "owner_id", "data", "vector_source", "content"]]
        return kept.assign(action=actions, status=statuses, reason=list(reasons))

    def close(self) -> None:
        pass


def in_one_go(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
    """What :class:`Settler` gives over all messages at once, as window functions; stored: key, digest."""
    order = Window.partitionBy("key").orderBy("token", "ord")
    place = F.struct("token", "ord")
    of_none = F.col("key").startswith("\0")
    marked = rows.withColumn("_again", ~of_none & F.coalesce(F.lag(place).over(order) == place, F.lit(False)))
    if stored is None:
        marked = marked.withColumn("_stored", F.lit(None).cast("string"))
    else:
        marked = marked.join(stored.select(F.col("key").alias("_key"), F.col("digest").alias("_stored")), F.col("key") == F.col("_key"), "left")
    valid = F.col("reason").isNull() & ~F.col("_again")
    loaded = F.when(valid & (F.col("event") == "load"), F.col("digest"))
    before = F.coalesce(F.last(loaded, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_stored"))
    same = F.coalesce(F.col("digest") == F.col("_before"), F.lit(False))
    event = F.col("event")
    action = F.when(event == "load", F.when(~same, "write")).when(event == "chunk", "save").when(event == "delete", "delete")
    status = F.when(event == "load", F.when(same, CHUNKED).otherwise(LOADED)).when(event == "chunk", CHUNKED).when(event == "delete", DELETED)
    out = marked.withColumn("_before", before)
    return out.withColumns({
        "action": F.when(valid, action),
        "status": F.when(valid, status).when(~F.col("_again") & ~of_none, ERROR),
        "reason": F.when(F.col("_again"), REPEATED).otherwise(F.col("reason")),
    }).select(*[c.split()[0] for c in SETTLED.split(", ")])


def settle(messages: DataFrame, fetched: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """Settled messages: ``action`` (write, save or delete), ``status`` and ``reason``; a batch, or a stream with state.

    ``resources`` (resource_id, content) is what is stored before the first message.
    """
    stored = None
    if resources is not None:
        known = resources.where("resource_id is not null").select(F.col("resource_id").cast("string").alias("key"), digest(F.col("content")).alias("digest"))
        stored = known.groupBy("key").agg(F.min("digest").alias("digest"))
    rows = to_settle(messages, fetched).select(*COLUMNS)
    if not messages.isStreaming:
        return in_one_go(rows, stored)
    return rows.groupBy("key").transformWithStateInPandas(Settler(), SETTLED, "append", "none", None if stored is None else stored.groupBy("key"))
