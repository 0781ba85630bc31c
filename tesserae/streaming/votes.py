"""Votes as a stream: assignment to earlier queries kept as state per collection and owner."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructType

from tesserae.functions.text import content_id
from tesserae.operators.feedback import Known, unit_rows


VOTE = "query string, chunkId string, resourceId string, action string, collectionId string, ownerId string"
REQUIRED = ["collectionId", "query", "chunkId", "resourceId", "action"]


def parsed(messages: DataFrame, value_col: str = "value") -> DataFrame:
    """Vote messages as rows (collection_id, owner_id, query_id, query, chunk_id, resource_id, delta), with ``reason`` where one is faulty.

    ``query_id`` is the id that a feedback query founded by this vote has; votes
    without an owner are the public's.
    """
    out = messages.withColumn("vote", F.from_json(F.col(value_col), VOTE))
    field = lambda c: F.col(f"vote.{c}")
    lacks = [F.coalesce(field(c), F.lit("")) == "" for c in REQUIRED]
    reason = F.when(reduce(lambda a, b: a | b, lacks), F.lit("a field is missing")).when(~field("action").isin("upvote", "downvote"), F.lit("unknown action"))
    owner = F.when(F.coalesce(field("ownerId"), F.lit("")) == "", F.lit("public")).otherwise(field("ownerId"))
    return out.select(
        *messages.columns,
        field("collectionId").alias("collection_id"),
        owner.alias("owner_id"),
        content_id(field("query"), field("collectionId"), owner).alias("query_id"),
        field("query").alias("query"),
        field("chunkId").alias("chunk_id"),
        field("resourceId").alias("resource_id"),
        F.when(reason.isNull(), F.when(field("action") == "upvote", 1).otherwise(-1)).alias("delta"),
        reason.alias("reason"),
    )


class VoteAssigner(StatefulProcessor):
    """State: the owner's feedback queries with their vectors and terms, in order of creation."""

    def __init__(self, state: StructType, keys: list[str], hybrid: bool) -> None:
        self.state, self.keys, self.hybrid = state, keys, hybrid

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", self.state)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        f = pd.concat(rows).sort_values("event_id")
        known = Known(self.hybrid)
        for query, vector, terms in self.known.get() if self.known.exists() else []:
            known.add(query, *unit_rows([vector]), dict(terms or {}))
        found, of = [], {}
        all_terms = f["terms"] if self.hybrid else [None] * len(f)
        for query, vector, terms in zip(f["query_id"].tolist(), unit_rows(f["vector"]), all_terms, strict=True):
            terms = {str(k): float(v) for k, v in dict(terms).items()} if terms is not None else {}
            if query in known.ids:
                own = query
            elif (own := of.get(query)) is None:
                own = known.belongs_to(vector, terms)
                if own is None:
                    known.add(query, vector, terms)
                    self.known.appendValue((query, vector.tolist(), terms))
                    own = query
            of[query] = own
            found.append(own)
        yield f[[*self.keys, "event_id", "query_id"]].assign(feedback_id=found)

    def close(self) -> None:
        pass


def assign_stream(votes: DataFrame, hybrid: bool = False) -> DataFrame:
    """votes: event_id, owner_id, query_id, vector [, collection_id] [, terms]; ids of any type; one row per vote.

    ``hybrid`` is for collections with a sparse model, whose votes have ``terms`` (term to weight).
    """
    keys = [c for c in ("collection_id", "owner_id") if c in votes.columns]
    kind = votes.schema["query_id"].dataType
    state = StructType().add("query_id", kind).add("vector", ArrayType(DoubleType())).add("terms", MapType(StringType(), DoubleType()))
    out = StructType()
    for c in (*keys, "event_id", "query_id"):
        out = out.add(c, votes.schema[c].dataType)
    return votes.groupBy(*keys).transformWithStateInPandas(VoteAssigner(state, keys, hybrid), out.add("feedback_id", kind), "append", "none")
