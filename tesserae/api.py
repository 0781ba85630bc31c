"""The engine as one object over its tables."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import chunking, encode, evaluate, feedback, records, retrieve, store
from tesserae.streaming import ingest

#: Settings of a collection that may change after its creation.
MUTABLE = ["chunkingUrl", "chunkOverlap", "chunkSize", "strategy", "keepDuplicate"]
#: Fields of a resource that may change after its creation.
MUTABLE_RESOURCE = ["url", "content", "title", "description", "refreshedAt", "is_deleted", "settings", *MUTABLE]
PUBLIC = "public"


class NotFound(LookupError):
    """No such entity."""


@dataclass
class Engine:
    """Tables are DataFrames; methods that change them replace the attribute by a new plan.

    collections: collection_id, name, ... settings as columns.
    resources: resource_id, collection_id, owner_id, content, url, is_deleted.
    points: point_id, collection_id, owner_id, resource_id, text, vector, tokens.
    votes: query_id, chunk_id, delta.  cases: query_id, collection_id, owner_id, expected.
    asked: queries that votes were given for (point_id, vector, collection_id, owner_id).  runs: records of evaluations.
    """

    spark: SparkSession
    collections: DataFrame
    resources: DataFrame
    points: DataFrame
    votes: DataFrame | None = None
    cases: DataFrame | None = None
    asked: DataFrame | None = None
    runs: DataFrame | None = None
    options: dict = field(default_factory=dict)

    def models(self) -> DataFrame:
        return encode.registry(self.spark)

    def collection(self, collection_id) -> DataFrame:
        return self._one(self.collections.where(F.col("collection_id") == collection_id), "collection", collection_id)

    def add_collection(self, row: DataFrame) -> None:
        for kind, column in (("dense", "denseModel"), ("sparse", "sparseModel"), ("reranker", "rerankerModel")):
            if column in row.columns:
                known = encode.registry(self.spark).where(F.col("kind") == kind).select(F.col("model_id").alias(column))
                for r in row.select(column).where(F.col(column).isNotNull()).join(known, column, "left_anti").take(1):
                    encode.check_model(kind, r[0])
        self._check_settings(row)
        self.collections = self.collections.unionByName(row, allowMissingColumns=True)

    def update_collection(self, changes: DataFrame) -> None:
        """Changes of mutable settings; models stay as they are."""
        kept = [c for c in changes.columns if c in ("collection_id", "name", "description", *MUTABLE)]
        kind = dict(changes.dtypes)
        now = self.collections.withColumns({c: F.lit(None).cast(kind[c]) for c in kept if c not in self.collections.columns})
        updated = store.update_by_id(now, changes.select(*kept), "collection_id")
        self._check_settings(updated.join(changes.select("collection_id"), "collection_id", "left_semi"))
        self.collections = updated

    def collection_resources(self, collection_id, owner_id=None, content: bool = False) -> DataFrame:
        found = self.resources.where((F.col("collection_id") == collection_id) & ~F.col("is_deleted"))
        found = found.where(F.col("owner_id") == owner_id) if owner_id else found
        return found if content else found.drop("content")

    def resource(self, resource_id) -> DataFrame:
        return self._one(self.resources.where(F.col("resource_id") == resource_id), "resource", resource_id)

    def add_resource(self, rows: DataFrame) -> None:
        """Resources without an owner are public; a faulty one is refused with all others."""
        owner = F.coalesce("owner_id", F.lit(PUBLIC)) if "owner_id" in rows.columns else F.lit(PUBLIC)
        gone = F.coalesce("is_deleted", F.lit(False)) if "is_deleted" in rows.columns else F.lit(False)
        rows = rows.withColumns({"owner_id": owner, "is_deleted": gone})
        self._refuse(rows, store.resource_fault(rows if "collection_id" in rows.columns else rows.withColumn("collection_id", F.lit(None).cast("string"))))
        self.resources = self.resources.unionByName(rows, allowMissingColumns=True)

    def update_resource(self, changes: DataFrame, as_given: list[str] | None = None) -> None:
        """Unknown ids and faulty values are refused, fields that may not change left out; columns ``as_given`` may be set to null."""
        changes = changes.select(*[c for c in changes.columns if c in ("resource_id", *MUTABLE_RESOURCE)])
        self._refuse(changes, store.resource_fault(changes))
        for r in changes.join(self.resources.select("resource_id"), "resource_id", "left_anti").take(1):
            raise NotFound(f"resource {r['resource_id']}")
        self.resources = store.update_by_id(self.resources, changes, "resource_id", as_given)
        if "refreshedAt" in self.resources.columns:
            stamp = changes.select("resource_id", F.current_timestamp().alias("refreshedAt"))
            self.resources = store.update_by_id(self.resources, stamp, "resource_id")

    def add_cases(self, rows: DataFrame) -> None:
        self.cases = rows if self.cases is None else self.cases.unionByName(rows, allowMissingColumns=True)

    def update_cases(self, changes: DataFrame) -> None:
        self.cases = store.update_by_id(self.cases, changes, "query_id")

    def delete_resource(self, ids: DataFrame) -> None:
        """Soft: the rows stay and their points go."""
        self.resources = store.soft_delete(self.resources, ids, "resource_id")
        self.points = store.hard_delete(self.points, ids, "resource_id")

    def resource_chunks(self, resource_id) -> DataFrame:
        return self.points.where(F.col("resource_id") == resource_id)

    def chunk(self, strategy: str = "recursive", size: int = chunking.DEFAULT_SIZE, overlap: int = chunking.DEFAULT_OVERLAP, custom=None) -> DataFrame:
        return chunking.chunk_documents(self.resources.where(~F.col("is_deleted")), "content", strategy, size, overlap, custom)

    def search(self, queries: DataFrame, collection_id, owner_id=PUBLIC, resource_id=None, limit: int = 5, min_score: float = 0.0, hybrid: bool = True, reranking: bool = True, asked: DataFrame | None = None, analytics: str | None = None) -> DataFrame:
        """queries: query_id, text, vector, tokens.  With ``analytics``, a path, results are written and the search goes on record there.  Votes for similar queries move the scores: those of ``asked`` (point_id, vector), or of the engine's own in this collection and tenant."""
        points = self.points.where((F.col("collection_id") == collection_id) & (F.col("owner_id") == owner_id))
        points = points.where(F.col("resource_id") == resource_id) if resource_id is not None else points
        if asked is None and self.asked is not None:
            asked = self.asked.where((F.col("collection_id") == collection_id) & (F.col("owner_id") == owner_id)).select("point_id", "vector")
        moved = None if asked is None or self.votes is None else lambda found: feedback.boost(found, queries, asked, self.vote_counts())
        if analytics is None:
            return retrieve.search(queries, points, limit, min_score, hybrid, reranking, moved)
        pools, start, run = [], time.monotonic(), uuid.uuid4().hex
        found = retrieve.search(queries, points, limit, min_score, hybrid, reranking, moved, pools.append)
        found.write.parquet(f"{analytics}/results/run={run}")
        records.search_records(queries, pools[0], collection_id, owner_id, time.monotonic() - start, limit).write.parquet(f"{analytics}/searches/run={run}")
        return self.spark.read.schema(found.schema).parquet(f"{analytics}/results/run={run}")

    def update_chunk(self, changes: DataFrame) -> None:
        """Changed fields of chunks (point_id, ...); a chunk's place and tenant stay."""
        kept = [c for c in changes.columns if c not in ("collection_id", "owner_id", "resource_id")]
        self.points = store.update_by_id(self.points, changes.select(*kept), "point_id")

    def delete_chunk(self, ids: DataFrame) -> None:
        self.points = store.hard_delete(self.points, ids, "point_id")

    def delete_collection(self, ids: DataFrame) -> None:
        """The collection's row goes; resources and points stay for whoever still holds their ids."""
        self.collections = store.hard_delete(self.collections, ids, "collection_id")

    def chunk_by_id(self, point_id) -> DataFrame:
        """One row, or none."""
        return self.points.where(F.col("point_id") == point_id)

    def feedback_by_id(self, query_id) -> DataFrame:
        return self.votes.where(F.col("query_id") == query_id)

    def replace_metadata(self, rows: DataFrame) -> None:
        """Whole metadata of resources (resource_id, metadata), not merged with the former."""
        now = self.resources if "metadata" in self.resources.columns else self.resources.withColumn("metadata", F.lit(None).cast(dict(rows.dtypes)["metadata"]))
        self.resources = store.update_by_id(now, rows.select("resource_id", "metadata"), "resource_id", ["metadata"])

    def vote(self, rows: DataFrame) -> None:
        self.votes = rows if self.votes is None else self.votes.unionByName(rows)

    def vote_counts(self) -> DataFrame:
        return feedback.vote_counts(self.votes)

    def evaluate(self, queries: DataFrame, collection_id, owner_id=PUBLIC) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Summary, cases, and failed cases of a collection's evaluation."""
        cases = self.cases.where((F.col("collection_id") == collection_id) & (F.col("owner_id") == owner_id))
        asked = queries.join(cases.select("query_id"), "query_id", "left_semi")
        judged = evaluate.evaluate(cases, self.search(asked, collection_id, owner_id, limit=evaluate.TOP_K))
        run = evaluate.run_record(judged, collection_id, owner_id)
        self.runs = run if self.runs is None else self.runs.unionByName(run)
        return evaluate.summary(judged), judged, evaluate.failed(judged)

    def vote_by_link(self, clicks: DataFrame, contexts: DataFrame, hours: int = 24) -> DataFrame:
        """Clicked links count as votes; gives back the clicks without a living context."""
        votes, failed = feedback.votes_by_link(clicks, contexts, hours)
        self.vote(votes)
        return failed

    def ingest(self, messages: DataFrame, number: int, path: str, fetched: DataFrame | None = None, encoders: encode.Encoders | None = None, custom=None) -> DataFrame:
        """A batch of messages (token, value [, ord]) into the stores below ``path``; points and contents follow.  Gives back the dead letters."""
        ingest.work(messages, number, path, self.resources, self.collections, fetched, encoders, custom)
        documents, points = ingest.stores(self.spark, path)
        self.points = points.join(documents.select("point_id", "collection_id", F.col("chunk").alias("text")).dropDuplicates(["point_id", "collection_id"]), ["point_id", "collection_id"])
        loaded = self.spark.read.parquet(f"{path}/loaded/batch={number}").select("resource_id", "content", F.struct("token", "ord").alias("at"))
        self.resources = store.update_by_id(self.resources, loaded, "resource_id", order="at")
        return self.spark.read.parquet(f"{path}/failed/batch={number}")

    @staticmethod
    def _check_settings(rows: DataFrame) -> None:
        given = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
        fault = store.settings_fault(given("chunkSize", "int"), given("chunkOverlap", "int"), given("strategy", "string"), given("chunkingUrl", "string"))
        Engine._refuse(rows, fault)

    @staticmethod
    def _refuse(rows: DataFrame, fault: Column) -> None:
        for r in rows.select(fault.alias("fault")).where("fault is not null").take(1):
            raise ValueError(r[0])

    @staticmethod
    def _one(found: DataFrame, kind: str, key) -> DataFrame:
        if found.isEmpty():
            raise NotFound(f"{kind} {key}")
        return found
