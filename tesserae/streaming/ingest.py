"""Settled messages at work: chunking and encoding by effective settings, both stores, statuses, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.text import content_id
from tesserae.operators import chunking, encode, records, store
from tesserae.streaming import settle
from tesserae.streaming.messages import parsed

__all__ = ["apply", "embed_source", "parsed", "point_id", "run_stream", "settings_of", "stores", "work"]

#: Where a message stands in the order of all.
SEQ = ["token", "ord"]


def embed_source(data: Column, vector_source: Column) -> Column:
    """What is encoded; ``data`` is what is stored."""
    return F.coalesce(F.when(vector_source != "", vector_source), data)


def point_id(data: Column, vector_source: Column, collection: Column, owner: Column, keep_duplicate: Column) -> Column:
    """A new id for every point where duplicates are kept, else one by content."""
    return F.when(F.coalesce(keep_duplicate, F.lit(False)), F.uuid()).otherwise(content_id(F.concat(data, F.coalesce(vector_source, F.lit(""))), collection, owner))


def settings_of(saves: DataFrame, resources: DataFrame, collections: DataFrame) -> DataFrame:
    """Messages that save a text, with their effective chunk_size, chunk_overlap and strategy, and ``known``: whether the collection is.

    resources: resource_id [, chunkSize, chunkOverlap, strategy]; collections: collection_id and the same [, keepDuplicate, denseModel, sparseModel, rerankerModel].
    """
    def part(df: DataFrame, key: str, name: str) -> DataFrame:
        given = lambda c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind)
        return df.select(F.col(key).cast("string").alias(f"{name}_key"), given("chunkSize", "int").alias(f"{name}_size"), given("chunkOverlap", "int").alias(f"{name}_overlap"), given("strategy", "string").alias(f"{name}_strategy"), given("keepDuplicate", "boolean").alias(f"{name}_keep"), *[given(f"{kind}Model", "string").alias(f"{name}_{kind}") for kind in encode.KINDS])

    r, c = part(resources, "resource_id", "resource").dropDuplicates(["resource_key"]), part(collections, "collection_id", "collection").dropDuplicates(["collection_key"])
    joined = saves.join(r, F.col("resource_id") == F.col("resource_key"), "left").join(c, F.col("collection_id") == F.col("collection_key"), "left")
    own = F.coalesce("resource_size", "resource_overlap").isNotNull() | F.col("resource_strategy").isNotNull()
    marked = joined.withColumn("has_settings", own).withColumn("known", F.col("collection_key").isNotNull()).withColumn("keep_duplicate", F.coalesce("collection_keep", F.lit(False)))
    return store.resolve_settings(marked, *SEQ, "value", "owner_id", "data", "vector_source", "known", "keep_duplicate", *[F.col(f"collection_{kind}").alias(f"{kind}_model") for kind in encode.KINDS])


def apply(settled: DataFrame, number: int, path: str, resources: DataFrame, collections: DataFrame, encoders: encode.Encoders | None = None, custom: Callable[[str], list] | None = None) -> None:
    """One batch of settled messages done: tables ``settled``, ``loaded``, ``documents``, ``vectors`` (by collection), ``deleted``, ``failed``, ``statuses`` and ``encoded`` (chunks, words and words a second) below ``path``.

    Each table's files of a batch are replaced when it is repeated, so a failure
    between two of them neither loses nor doubles rows.  Rows carry their
    message's place (token, ord), by which :func:`stores` lets deletes take effect.
    """
    spark = settled.sparkSession
    at = lambda name: f"{path}/{name}/batch={number}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(at(name))
        return spark.read.schema(df.schema).parquet(at(name))

    rows = kept(settled, "settled")
    kept(rows.where("action = 'write'").select(*SEQ, "resource_id", "collection_id", "owner_id", "content"), "loaded")
    settings = settings_of(rows.where("action = 'save'").select(*SEQ, "value", "resource_id", "collection_id", "owner_id", "data", "vector_source"), resources, collections)
    parts = chunking.chunk_by_settings(settings.where("known").withColumnRenamed("vector_source", "given_source"), "data", custom).drop("data")
    found = parts.withColumn("vector_source", F.coalesce("vector_source", "given_source")).drop("given_source")
    ids = point_id(F.col("chunk"), F.col("vector_source"), F.col("collection_id"), F.col("owner_id"), F.col("keep_duplicate"))
    # ids of kept duplicates are drawn once, for both stores
    documents = kept(found.withColumn("point_id", F.when(F.col("error").isNull(), ids)).drop("known", "keep_duplicate"), "documents")
    good = documents.where("error is null").select("point_id", *SEQ, "resource_id", "owner_id", "collection_id", "chunk_no", embed_source(F.col("chunk"), F.col("vector_source")).alias("embed"), *[f"{kind}_model" for kind in encode.KINDS])
    made = encode.encode_kinds(good, "embed", *[F.col(f"{kind}_model") for kind in encode.KINDS], encoders)
    counts = records.timed_write(made, at("vectors"), "collection_id", ["embed", *[f"{kind}_model" for kind in encode.KINDS]], chunks=F.count("*"), characters=F.sum(F.length("embed")))
    kept(spark.createDataFrame([records.encode_record(counts)], "chunks long, words double, seconds double, words_per_second double"), "encoded")
    kept(rows.where("action = 'delete'").select(*SEQ, "resource_id", "collection_id"), "deleted")

    bad = rows.where("reason is not null").select(*SEQ, "value", "reason", "resource_id")
    bad = bad.unionByName(settings.where("not known").select(*SEQ, "value", F.lit("collection not found").alias("reason"), "resource_id"))
    failed = kept(bad.unionByName(documents.where("error is not null").select(*SEQ, "value", F.col("error").alias("reason"), "resource_id")), "failed")
    undone = failed.where(F.col("reason") != settle.REPEATED).select(*SEQ, F.lit(settle.ERROR).alias("_error")).distinct()
    out = rows.where("resource_id is not null").join(undone, SEQ, "left").withColumn("status", F.coalesce("_error", "status"))
    out.where("status is not null").select("resource_id", "status", *SEQ).distinct().write.mode("overwrite").parquet(at("statuses"))


def work(batch: DataFrame, number: int, path: str, resources: DataFrame, collections: DataFrame, fetched: DataFrame | None = None, encoders: encode.Encoders | None = None, custom: Callable[[str], list] | None = None) -> None:
    """One batch of messages (token, value [, ord]) settled and done, without state from earlier ones.

    ``fetched`` (url, content) is what the loaders got, ``resources`` what is stored.
    """
    stored = resources if "content" in resources.columns else None
    apply(settle.settle(batch, fetched, stored), number, path, resources, collections, encoders, custom)


def run_stream(source: DataFrame, path: str, checkpoint: str, resources: DataFrame, collections: DataFrame, fetched: DataFrame | None = None, encoders: encode.Encoders | None = None, custom: Callable[[str], list] | None = None, trigger: dict | None = None):
    """A stream of messages (token, value [, ord]) into both stores; what each resource has stored is keyed state."""
    def each(batch: DataFrame, number: int) -> None:
        apply(batch, number, path, resources, collections, encoders, custom)

    stored = resources if "content" in resources.columns else None
    settled = settle.settle(source, fetched, stored)
    return settled.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stores(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What the document store and the vector store hold after all batches: saves that no later delete of their resource follows."""
    # a resource's chunks of one message have one place, so the chunk's number tells the last of equal ones
    seq = F.struct("token", "ord", "chunk_no").alias("seq")
    gone = spark.read.parquet(f"{path}/deleted").select(F.struct("token", "ord", F.lit(2**31 - 1).alias("chunk_no")).alias("seq"), F.lit("delete").alias("action"), "collection_id", "resource_id")

    def log(name: str) -> DataFrame:
        saved = spark.read.parquet(f"{path}/{name}")
        saved = saved.where("error is null").drop("error") if "error" in saved.columns else saved
        return saved.drop("batch").withColumns({"seq": seq, "action": F.lit("save")}).unionByName(gone, allowMissingColumns=True)

    models = [f"{kind}_model" for kind in encode.KINDS]
    return store.live_chunks(log("documents")).drop("action", "seq", *models), store.live_points(log("vectors")).drop("action", "seq")
