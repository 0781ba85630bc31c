"""Sparse search over postings: block maxima, a first guess, and only the blocks that can still matter.

A posting is (block, point_id, term, weight).  Points are dealt into blocks of
like total weight, heaviest first, so that a block's largest weight of a term
says much about its points; a term that every point has is spread over all
blocks.  The largest score a query can reach in a block is the sum of its weights
times the block's largest ones.  The blocks with the largest of these are scored
first; the score of the k-th point found is a threshold, and of the other blocks
only those that can reach it are scored.  The result is that of a full scan.

All of it is joins and sums; terms are counted once, when the index is built.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserae.sources import scratch

#: Points of a block at least, and blocks at most.
BLOCK_POINTS, BLOCKS = 64, 65_536
#: Points, for each one asked for, that the blocks scored before the others hold: enough for a threshold that few others reach.
FIRST = 16
DIGITS = 6
#: Terms of blocks to score, some 60 bytes each, that may be sent to where the postings lie.
SENT_ROWS = 1_000_000


@dataclass
class Postings:
    """An index on shared storage."""

    spark: SparkSession
    path: str
    schema: StructType

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/postings")

    @property
    def maxima(self) -> DataFrame:
        return self.spark.read.schema("term string, block long, most double").parquet(f"{self.path}/maxima")


def build(points: DataFrame, path: str | None = None) -> Postings:
    """Index of points (point_id, sparse: a map from term to weight); one without terms has no posting.

    Points are sorted by their total weight, a row each; only then is a row made
    of each posting, with its block.  Postings stay where their points are.
    """
    spark = points.sparkSession
    path = path or scratch.new_path(spark, "postings")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = points.where(F.size("sparse") > 0).select("point_id", F.col("sparse").cast("map<string, double>").alias("sparse"))
    total = F.aggregate(F.map_values("sparse"), F.lit(0.0), lambda s, x: s + F.abs(F.coalesce(x, F.lit(0.0))))
    order = [F.col("total").desc(), F.col("point_id")]
    # a point's place in its partition; partitions are ranges, so each is blocks of neighbours
    filled.withColumn("total", total).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{path}/points")
    placed = spark.read.schema(filled.withColumns({"total": total, "place": F.lit(0).cast("long")}).schema).parquet(f"{path}/points")
    size = max(BLOCK_POINTS, placed.count() // BLOCKS + 1)
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    block = F.shiftleft(part, 33).bitwiseOR(F.floor(within / size).cast("long"))
    found = placed.select(block.alias("block"), "point_id", F.explode("sparse").alias("term", "weight")).where("weight is not null")
    found.write.parquet(f"{path}/postings")
    index = Postings(spark, path, found.schema)
    index.rows.groupBy("term", "block").agg(F.max("weight").alias("most")).write.parquet(f"{path}/maxima")
    return index


def scored(blocks: DataFrame, asked: DataFrame, index: Postings) -> DataFrame:
    """(query_id, point_id, score) of the points of (query_id, block) that share a term; asked: query_id, term, asked.

    Terms of few blocks go to the postings, so that these are not shuffled; more meet them by a shuffle.
    """
    path = scratch.new_path(index.spark, "wanted")
    # counted and joined
    blocks.select("query_id", "block").join(asked, "query_id").write.parquet(path)
    wanted = index.spark.read.parquet(path)
    if wanted.count() <= SENT_ROWS:
        wanted = F.broadcast(wanted)
    hits = index.rows.join(wanted, ["term", "block"])
    return hits.groupBy("query_id", "point_id").agg(F.round(F.sum(F.col("asked") * F.col("weight")), DIGITS).alias("score"))


def best(found: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Postings, k: int = 5, first: int | None = None) -> DataFrame:
    """Best k points of each query (query_id, sparse) by dot product: query_id, point_id, score, rank.

    Weights are above 0, as counts are; points that share no term are no candidates.
    ``first`` is how many blocks of a query are scored before the others.
    """
    spark = queries.sparkSession
    first = first or max(2, -(-FIRST * k // BLOCK_POINTS))
    path = scratch.new_path(spark, "sparse-search")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    asked = kept(queries.select("query_id", F.explode(F.col("sparse").cast("map<string, double>")).alias("term", "asked")), "asked")
    reach = asked.join(index.maxima, "term").groupBy("query_id", "block").agg(F.round(F.sum(F.col("asked") * F.col("most")), DIGITS).alias("reach"))
    order = Window.partitionBy("query_id").orderBy(F.desc("reach"), "block")
    reach = kept(reach.withColumn("place", F.row_number().over(order)), "reach")
    early = kept(best(scored(reach.where(F.col("place") <= first), asked, index), k), "early")
    # the k-th score so far; fewer points found set no threshold
    least = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    others = reach.where(F.col("place") > first).join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("reach") >= F.col("least")))
    return best(early.drop("rank").unionByName(scored(others, asked, index)), k)
