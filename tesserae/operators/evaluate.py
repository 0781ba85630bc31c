"""Retrieval quality: hit, recall, reciprocal rank, and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K = 5


def is_hit(expected: Column, found: Column) -> Column:
    return F.coalesce(F.arrays_overlap(expected, found), F.lit(False))


def recall(expected: Column, found: Column) -> Column:
    """Share of expected ids found; repeated ones count each; 0 for none expected."""
    hits = F.size(F.filter(expected, lambda x: F.array_contains(found, x)))
    return F.when(F.size(expected) > 0, hits / F.size(expected)).otherwise(F.lit(0.0))


def reciprocal_rank(expected: Column, found: Column) -> Column:
    places = F.transform(expected, lambda x: F.array_position(found, x))
    first = F.array_min(F.filter(places, lambda p: p > 0))
    return F.coalesce(1.0 / first, F.lit(0.0))


def evaluate(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case (query_id, expected): what was found and its measures.  results: query_id, point_id, rank.

    Ids may be of any type; found ones are compared as the type of those expected.
    """
    kind = dict(cases.dtypes)["expected"]
    found = results.where(F.col("rank") <= TOP_K).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "point_id"))), lambda r: r["point_id"]).alias("found"))
    out = cases.join(found, "query_id", "left").withColumn("found", F.coalesce(F.col("found").cast(kind), F.expr(f"cast(array() as {kind})")))
    e, f = F.col("expected"), F.col("found")
    return out.select("query_id", "expected", "found", is_hit(e, f).alias("is_hit"), recall(e, f).alias("recall"), reciprocal_rank(e, f).alias("reciprocal_rank"))


def summary(judged: DataFrame) -> DataFrame:
    """One row: hit rate, average recall, mean reciprocal rank and counts.  No case is an error."""
    out = judged.agg(
        F.round(F.avg(F.col("is_hit").cast("double")), 6).alias("overall_score"),
        F.round(F.avg("recall"), 6).alias("average_recall"),
        F.round(F.avg("reciprocal_rank"), 6).alias("mrr"),
        F.count("*").alias("total_cases"),
        F.count_if("is_hit").alias("hit_count"),
    )
    return out.where(F.when(F.col("total_cases") == 0, F.raise_error(F.lit("no evaluation case")).cast("boolean")).otherwise(F.lit(True)))


def failed(judged: DataFrame) -> DataFrame:
    return judged.where(~F.col("is_hit"))


def run_record(judged: DataFrame, collection_id, owner_id) -> DataFrame:
    """One row to keep of an evaluation: whose it was, when, its summary, and each case's result.

    A run's cases are those of one collection and owner, set up by hand; the row holds them all.
    """
    cases = judged.agg(F.array_sort(F.collect_list(F.struct("query_id", "expected", "found", "is_hit", "recall", "reciprocal_rank"))).alias("results"))
    run = F.struct(F.lit(collection_id).alias("collection_id"), F.lit(owner_id).alias("owner_id"), F.current_timestamp().alias("at"))
    # one row each
    return summary(judged).join(F.broadcast(cases)).select(F.uuid().alias("run_id"), *[run[c].alias(c) for c in ("collection_id", "owner_id", "at")], "overall_score", "average_recall", "mrr", "total_cases", "hit_count", "results")
