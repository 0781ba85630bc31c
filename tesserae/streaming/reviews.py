"""Review links as a stream: what a link stands for is kept for a day, and clicks on it become votes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, StringType, StructType

#: Hours that a link lives, and what its actions are worth.
HOURS, WORTH = 24, {"upvote": 1, "downvote": -1}


class Reviews(StatefulProcessor):
    """State: the context of one link, dropped when time has passed its end."""

    def __init__(self, context: StructType, hours: int) -> None:
        self.context, self.hours = context, hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.context)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        f = pd.concat(rows).sort_values(["at"], kind="stable")
        made = f[f["action"].isna()]
        if len(made):
            first = made.iloc[0]
            self.held.update((first["query_id"], first["chunk_id"], first["at"].to_pydatetime()))
            self.handle.registerTimer(int((first["at"] + pd.Timedelta(hours=self.hours)).timestamp() * 1000) + 1)
        clicks = f[f["action"].notna()]
        if not len(clicks):
            return
        query, chunk, since = self.held.get() if self.held.exists() else (None, None, None)
        expired = clicks["at"] > pd.Timestamp(since) + pd.Timedelta(hours=self.hours) if since is not None else pd.Series(True, index=clicks.index)
        delta = clicks["action"].map(WORTH)
        reason = delta.isna().map({True: "unknown action", False: None}).where(~expired, "link expired")
        good = reason.isna()
        yield pd.DataFrame({
            "feedback_id": key[0],
            "action": clicks["action"],
            "at": clicks["at"],
            "query_id": [query if g else None for g in good],
            "chunk_id": [chunk if g else None for g in good],
            "delta": pd.array([int(d) if g else None for d, g in zip(delta, good, strict=True)], "Int32"),
            "reason": reason,
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def votes_by_link_stream(clicks: DataFrame, contexts: DataFrame, hours: int = HOURS, late: str = "1 hour") -> DataFrame:
    """Clicks (feedback_id, action, at) as votes (query_id, chunk_id, delta), or with a ``reason``; streams, or one of both.

    contexts: feedback_id, query_id, point_id, made_at, sent before their links
    are shown.  A context is forgotten ``hours`` after it was made, once no event
    older than ``late`` is awaited.
    """
    # ids of any type travel as text, since numbers beside nulls would become fractions
    text = lambda c: F.col(c).cast("string").alias(c)
    made = contexts.select("feedback_id", F.lit(None).cast("string").alias("action"), F.col("made_at").alias("at"), text("query_id"), text("point_id").alias("chunk_id"))
    clicked = clicks.where("action is not null").select("feedback_id", "action", "at", *[F.lit(None).cast("string").alias(c) for c in ("query_id", "chunk_id")])
    both = made.unionByName(clicked).withWatermark("at", late)
    context = StructType().add("query_id", StringType()).add("chunk_id", StringType()).add("at", contexts.schema["made_at"].dataType)
    out = StructType().add("feedback_id", contexts.schema["feedback_id"].dataType).add("action", StringType()).add("at", clicks.schema["at"].dataType)
    out = out.add("query_id", StringType()).add("chunk_id", StringType()).add("delta", IntegerType()).add("reason", StringType())
    found = both.groupBy("feedback_id").transformWithStateInPandas(Reviews(context, hours), out, "append", "EventTime")
    return found.withColumns({c: F.col(c).cast(contexts.schema[of].dataType) for c, of in (("query_id", "query_id"), ("chunk_id", "point_id"))})
