"""Reading tables and viewing the test tables as the engine's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is dear per row: files that give fewer partitions than there are cores are dealt out first.

    Tables of a real size have more, and are read as they lie.
    """
    df, lanes = read(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    # of a bare scan, which is only planned here
    return df.repartition(lanes) if df.rdd.getNumPartitions() < lanes else df


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as resources: the language is the collection, the source the owner, toxic ones are deleted."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    gone = labels.groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("gone"))
    out = docs.join(gone, "doc_id", "left")
    return out.select(F.col("doc_id").alias("resource_id"), F.col("lang").alias("collection_id"), F.col("source").alias("owner_id"), F.col("text").alias("content"), "n_chars", F.coalesce("gone", F.lit(False)).alias("is_deleted"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("point_id"), F.col("label").alias("resource_id"), F.pmod("label", F.lit(2)).alias("owner_id"), F.col("embedding").alias("vector"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases are upvotes, errors are downvotes."""
    e = read(spark, sf_dir, "events")
    chunk = F.regexp_extract("props", r'"k": ?([0-9]+)', 1).cast("long")
    kind = F.col("event_type")
    return e.where(kind.isin("click", "purchase", "error")).select("event_id", F.col("user_id").alias("query_id"), chunk.alias("chunk_id"), F.when(kind == "error", -1).otherwise(1).alias("delta"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log of resources."""
    e = read(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": ?([0-9]+)', 1).cast("long")
    kind = F.col("event_type")
    op = F.when(kind == "signup", "insert").when(kind == "error", "delete").otherwise("update")
    fields = F.array(F.lit("url"), F.lit("content"), F.lit("refreshedAt"), F.lit("isDeleted"), F.lit("metadata"))
    return e.select(
        F.col("event_id").alias("token"),
        op.alias("op"),
        F.when(op != "delete", F.col("user_id")).alias("resource_id"),
        F.when(F.pmod("user_id", F.lit(3)) != 0, F.concat(F.lit("https://Site"), F.col("user_id").cast("string"), F.lit(".example.com/a.b/Doc."), F.when(F.pmod(k, F.lit(2)) == 0, "PDF").otherwise("html"))).alias("url"),
        F.when(F.pmod(k, F.lit(4)) != 0, F.concat(F.lit("text "), k.cast("string"))).alias("content"),
        (F.pmod(k, F.lit(7)) == 0).alias("is_deleted"),
        F.when(op == "update", F.array(F.element_at(fields, F.pmod(k, F.lit(5)).cast("int") + 1), F.element_at(fields, F.pmod(F.col("user_id"), F.lit(4)).cast("int") + 1))).alias("updated"),
    )
