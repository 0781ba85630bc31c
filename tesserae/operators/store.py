"""The stores as folds of an ordered change log, and updates of entities.

A message is a row (seq, action, collection_id, resource_id, ...).  The point
store keeps the last save of a point id that no later delete of that row's
resource follows; the document store keeps all chunks since a resource's last
delete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import url_host


def upsert_dedup(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last write of each key."""
    # combined before the shuffle, without sorting a key's rows
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("_last"))
    return kept.select("_last.*")


def live_points(log: DataFrame) -> DataFrame:
    """Points left after saves and deletes (seq, action, collection_id, resource_id, point_id)."""
    saved = upsert_dedup(log.where("action = 'save'"), ["collection_id", "point_id"], "seq")
    gone = log.where("action = 'delete'").groupBy("collection_id", "resource_id").agg(F.max("seq").alias("gone_at"))
    out = saved.join(gone, ["collection_id", "resource_id"], "left")
    return out.where(F.col("gone_at").isNull() | (F.col("gone_at") < F.col("seq"))).drop("gone_at")


def live_chunks(log: DataFrame) -> DataFrame:
    """Chunks left in the document store, repeated ones included."""
    gone = log.where("action = 'delete'").groupBy("collection_id", "resource_id").agg(F.max("seq").alias("gone_at"))
    out = log.where("action = 'save'").join(gone, ["collection_id", "resource_id"], "left")
    return out.where(F.col("gone_at").isNull() | (F.col("gone_at") < F.col("seq"))).drop("gone_at")


def truthy(*choices: Column) -> Column:
    """The first that is neither null, 0 nor empty."""
    return F.coalesce(*[F.when(c.cast("string").isin("", "0", "0.0"), F.lit(None)).otherwise(c) for c in choices])


def resolve_settings(rows: DataFrame, *others: str) -> DataFrame:
    """Effective chunk settings: the resource's, else the collection's, else constants."""
    strategy = F.when(F.col("has_settings") & F.coalesce(F.col("resource_strategy"), F.lit("")).isin(""), F.lit("recursive")).otherwise(F.col("resource_strategy"))
    return rows.select(
        "resource_id",
        "collection_id",
        *others,
        truthy(F.col("resource_size"), F.col("collection_size"), F.lit(512)).alias("chunk_size"),
        truthy(F.col("resource_overlap"), F.col("collection_overlap"), F.lit(50)).alias("chunk_overlap"),
        truthy(strategy, F.col("collection_strategy"), F.lit("recursive")).alias("strategy"),
    )


def settings_fault(size: Column, overlap: Column, strategy: Column, url: Column) -> Column:
    """What is wrong with chunk settings; null if nothing is."""
    return (
        F.when(size > 4000, F.lit("size over 4000"))
        .when(overlap >= size, F.lit("overlap not below size"))
        .when(~strategy.isin("recursive", "semantic", "custom"), F.lit("unknown strategy"))
        .when((strategy == "custom") & (F.coalesce(url, F.lit("")) == ""), F.lit("custom without url"))
    )


def resource_fault(rows: DataFrame) -> Column:
    """What is wrong with a new or changed resource; null if nothing is.  Columns that aren't there are not looked at."""
    given = lambda c, kind: F.col(c).cast(kind) if c in rows.columns else F.lit(None).cast(kind)
    fault = settings_fault(given("chunkSize", "int"), given("chunkOverlap", "int"), given("strategy", "string"), given("chunkingUrl", "string"))
    url = given("url", "string")
    fault = F.when(url.isNotNull() & url_host(url).isNull(), F.lit("not a url")).otherwise(fault)
    if "collection_id" in rows.columns:
        fault = F.when(F.coalesce(F.col("collection_id").cast("string"), F.lit("")) == "", F.lit("no collection")).otherwise(fault)
    return fault


def last_updates(updates: DataFrame, key: str, as_given: list[str] | None = None, order: str | None = None) -> DataFrame:
    """One update a key: of each column the last value that isn't null, of those ``as_given`` the last at all.

    Updates come in the order of column ``order``, else of the rows.
    """
    new = [c for c in updates.columns if c not in (key, order)]
    rows = updates.select(F.col(key).alias("_key"), (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"), *[F.col(c).alias(f"_new_{c}") for c in new])
    last = lambda c: F.max_by(F.struct(f"_new_{c}"), F.when(F.col(f"_new_{c}").isNotNull() | F.lit(c in (as_given or ())), F.col("_order")))[f"_new_{c}"]
    return rows.groupBy("_key").agg(F.lit(True).alias("_hit"), *[last(c).alias(f"_new_{c}") for c in new])


def update_by_id(table: DataFrame, updates: DataFrame, key: str, as_given: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Partial update: columns of ``updates`` that aren't null replace the table's, those ``as_given`` also when null.

    Several updates of one id take effect one after the other.
    """
    taken = F.col("_hit").isNotNull()
    new = [c for c in updates.columns if c not in (key, order)]
    joined = table.join(last_updates(updates, key, as_given, order), F.col(key) == F.col("_key"), "left")
    value = lambda c: F.when(taken, F.col(f"_new_{c}")).otherwise(F.col(c)) if c in (as_given or ()) else F.coalesce(f"_new_{c}", c)
    return joined.select(*[value(c).alias(c) if c in new else F.col(c) for c in table.columns])


def soft_delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    marks = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return table.join(marks, key, "left").withColumn("is_deleted", F.coalesce("_gone", "is_deleted")).drop("_gone").select(*table.columns)


def hard_delete(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")
