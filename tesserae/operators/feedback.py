"""Human feedback: vote counts, and two ways to let them move results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators.retrieve import block_topk, dense_topk, same_owner_scores
from tesserae.sources import scratch

#: Neighbours of a query, and how alike they must be.
NEIGHBOURS, SEARCH_GATE, VOTE_GATE, WEIGHT = 5, 0.85, 0.9, 0.2


def vote_counts(votes: DataFrame) -> DataFrame:
    """(query_id, chunk_id, votes): up minus down."""
    return votes.groupBy("query_id", "chunk_id").agg(F.sum("delta").alias("votes"))


def add_votes(counts: DataFrame, votes: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts (query_id, chunk_id, votes) with new votes added, and votes for queries that aren't known."""
    ids = known.select("query_id").distinct()
    new = vote_counts(votes.join(ids, "query_id", "left_semi"))
    both = counts.select("query_id", "chunk_id", "votes").unionByName(new)
    failed = votes.join(ids, "query_id", "left_anti").withColumn("reason", F.lit("unknown feedback"))
    return both.groupBy("query_id", "chunk_id").agg(F.sum("votes").alias("votes")), failed


def review_links(results: DataFrame, base_url: str, key: Column | None = None) -> DataFrame:
    """Results with ``feedback_id`` and the links that vote them up or down; a random id unless ``key`` gives one.

    Keep the rows as the context a link stands for, and write them once: random ids are drawn anew on a second reading.
    """
    link = lambda action: F.concat(F.lit(base_url.rstrip("/") + "/feedback/vote/"), F.col("feedback_id"), F.lit("/" + action))
    out = results.withColumn("feedback_id", F.uuid() if key is None else key)
    return out.withColumn("upvote_url", link("upvote")).withColumn("downvote_url", link("downvote"))


def votes_by_link(clicks: DataFrame, contexts: DataFrame, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Votes (query_id, chunk_id, delta) of clicked links, and clicks without a living context.

    clicks: feedback_id, action, at; contexts: feedback_id, query_id, point_id, made_at.
    """
    held = contexts.select("feedback_id", "query_id", F.col("point_id").alias("chunk_id"), "made_at")
    joined = clicks.join(held, "feedback_id", "left")
    fault = F.when(F.col("made_at").isNull() | (F.col("at") > F.col("made_at") + F.make_dt_interval(hours=F.lit(hours))), F.lit("link expired")).when(~F.coalesce(F.col("action").isin("upvote", "downvote"), F.lit(False)), F.lit("unknown action"))
    judged = joined.withColumn("reason", fault)
    votes = judged.where("reason is null").select("query_id", "chunk_id", F.when(F.col("action") == "upvote", 1).otherwise(-1).alias("delta"))
    return votes, judged.where("reason is not null").select(*clicks.columns, "reason")


def similar_queries(queries: DataFrame, asked: DataFrame) -> DataFrame:
    """Earlier queries alike enough: (query_id, feedback_id, sim).  asked: point_id, vector."""
    return dense_topk(queries, asked, NEIGHBOURS).where(F.col("score") > SEARCH_GATE).select("query_id", F.col("point_id").alias("feedback_id"), F.col("score").alias("sim"))


def boosted(score: Column, hits: Column) -> Column:
    """Fold ``score <- ln(votes) * sim + score`` over hits in order.

    No votes left minus infinity, negative ones the logarithm undefined, and an
    undefined sum or one of 0 counts as 0.
    """
    def step(s: Column, h: Column) -> Column:
        added = F.ln(h["votes"].cast("double")) * h["sim"] + s
        return F.when(h["votes"] < 0, F.lit(0.0)).when(h["votes"] == 0, F.lit(float("-inf"))).otherwise(F.when(F.isnan(added), F.lit(0.0)).otherwise(added))

    return F.aggregate(hits, score, step)


def boost(results: DataFrame, queries: DataFrame, asked: DataFrame, counts: DataFrame) -> DataFrame:
    """Results (query_id, point_id, score, ...) with scores moved by the votes of similar queries."""
    hits = similar_queries(queries, asked).join(counts.withColumnRenamed("query_id", "feedback_id"), "feedback_id")
    # at most NEIGHBOURS hits a result
    folded = hits.groupBy("query_id", F.col("chunk_id").alias("point_id")).agg(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("order"), "feedback_id", "sim", "votes"))).alias("hits"))
    out = results.join(folded, ["query_id", "point_id"], "left")
    nothing = F.expr(f"cast(array() as {dict(folded.dtypes)['hits']})")
    return out.withColumn("score", F.round(boosted(F.col("score"), F.coalesce("hits", nothing)), 6)).drop("hits")


def fuse(results: DataFrame, queries: DataFrame, asked: DataFrame, counts: DataFrame) -> DataFrame:
    """score + 0.2 * sum of sim * log10(votes + 1), with the parts kept."""
    hits = similar_queries(queries, asked).join(counts.where("votes > -1").withColumnRenamed("query_id", "feedback_id"), "feedback_id")
    sums = hits.groupBy("query_id", F.col("chunk_id").alias("point_id")).agg(F.sum(F.col("sim") * F.log10(F.col("votes") + 1.0)).alias("boost"))
    out = results.join(sums, ["query_id", "point_id"], "left").withColumnRenamed("score", "original_score")
    extra = F.coalesce("boost", F.lit(0.0))
    return out.withColumn("feedback_boost", F.round(extra, 6)).withColumn("score", F.round(F.col("original_score") + extra * WEIGHT, 6)).drop("boost")


def assign_in_order(votes: list[tuple[int, np.ndarray]], known: list[tuple[int, np.ndarray]], gate: float = VOTE_GATE, step: int = 512) -> list[int]:
    """For each vote (query id, unit vector) in order, the earlier query it belongs to, or its own.

    ``known`` grows by the queries that found a group.  Votes meet the groups
    known before their step in one product; only groups founded within a step
    are looked at one by one.
    """
    out = []
    for start in range(0, len(votes), step):
        part = votes[start : start + step]
        v = np.array([x for _, x in part])
        own = np.round(v @ v.T, 6)
        before, ids = len(known), [q for q, _ in known]
        if before:
            sims = np.round(v @ np.array([x for _, x in known]).T, 6)
            nearest, near = sims.argmax(1), sims.max(1)
        founded: list[int] = []
        for n, (query, vector) in enumerate(part):
            best, best_sim = (ids[nearest[n]], near[n]) if before and near[n] > gate else (None, gate)
            if founded:
                at = int(own[n, founded].argmax())
                if own[n, founded[at]] > best_sim:
                    best = part[founded[at]][0]
            if best is None:
                known.append((query, vector))
                founded.append(n)
                best = query
            out.append(best)
    return out


class Known:
    """Feedback queries known so far, in order of creation, with unit vectors and, in hybrid mode, term weights."""

    def __init__(self, hybrid: bool = False, gate: float = VOTE_GATE) -> None:
        self.hybrid, self.gate = hybrid, gate
        self.ids: list = []
        self.vectors: list[np.ndarray] = []
        self.terms: list[dict] = []

    def add(self, query, vector: np.ndarray, terms: dict | None = None) -> None:
        self.ids.append(query)
        self.vectors.append(vector)
        self.terms.append(terms or {})

    def belongs_to(self, vector: np.ndarray, terms: dict | None = None):
        """The known query that a vote for this one counts for, or None.

        Dense: the most alike, if alike enough.  Hybrid: two candidates of either
        branch are fused by reciprocal ranks, whose best only passes the gate if
        it is first in both branches; points that share no term are in none.
        """
        if not self.ids:
            return None
        sims = np.round(np.array(self.vectors) @ vector, 6)
        first = int(sims.argmax())
        if not self.hybrid:
            return self.ids[first] if sims[first] > self.gate else None
        shared = np.array([sum(w * own.get(t, 0) for t, w in (terms or {}).items()) for own in self.terms])
        score: dict[int, float] = {}
        for branch in (sims, np.where(shared > 0, shared, -np.inf)):
            order = np.argsort(-branch, kind="stable")[:2]
            for place, k in enumerate(order[branch[order] > -np.inf].tolist()):
                score[k] = score.get(k, 0) + 1 / (2 + place)
        best = min(score, key=lambda k: (-score[k], k))
        return self.ids[best] if score[best] > self.gate else None


def assign_hybrid(votes: DataFrame) -> DataFrame:
    """Like :func:`assign_votes` where the collection has a sparse model: votes also have ``terms``, a map of weights.

    Which query a vote falls to depends on all those known just then, whatever
    the distance, so an owner's distinct queries are one ordered fold.
    """
    first = votes.groupBy("owner_id", "query_id").agg(F.min("event_id").alias("event_id"), F.min_by("vector", "event_id").alias("vector"), F.min_by(F.map_entries("terms"), "event_id").alias("terms"))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("event_id")
        known, out = Known(hybrid=True), []
        for query, vector, entries in zip(f["query_id"].tolist(), unit_rows(f["vector"]), f["terms"], strict=True):
            terms = {e["key"]: e["value"] for e in entries} if entries is not None else {}
            found = known.belongs_to(vector, terms)
            if found is None:
                known.add(query, vector, terms)
            out.append(query if found is None else found)
        return pd.DataFrame({"owner_id": f["owner_id"], "query_id": f["query_id"], "feedback_id": out})

    of = dict(votes.dtypes)
    return first.groupBy("owner_id").applyInPandas(fold, f"owner_id {of['owner_id']}, query_id {of['query_id']}, feedback_id {of['query_id']}")


def unit_rows(vectors) -> list[np.ndarray]:
    return [np.asarray(v, float) / max(np.linalg.norm(v), 1e-12) for v in vectors]


#: Queries of an owner that are settled in one round, and of a part that meets the founders of a round.
ROUND, PART = 8192, 20_000


def founders(first: DataFrame, gate: float = VOTE_GATE, round_size: int = ROUND) -> DataFrame:
    """Queries (owner_id, query_id, event_id, vector) that no earlier founder of their owner is alike enough to.

    An owner's queries are settled in rounds.  A round folds the first undecided
    ones of each owner, a bounded number in one task, and drops from the rest, in
    parts over all tasks, those that the founders just found are alike enough to.
    What is left was compared with every earlier founder, so the outcome is that
    of one fold over all; the number of rounds follows the founders, not the votes.
    """
    spark = first.sparkSession
    path = scratch.new_path(spark, "founders")
    schema = ", ".join(f"{c} {t}" for c, t in first.select("owner_id", "query_id", "event_id", "vector").dtypes)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("event_id")
        own = list(zip(f["query_id"].tolist(), unit_rows(f["vector"]), strict=True))
        found = assign_in_order(own, [], gate)
        return f[[a == b for (a, _), b in zip(own, found, strict=True)]]

    def far(f: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if len(f) and len(new):
            leaders, keep = np.array(unit_rows(new["vector"])), []
            for start in range(0, len(f), 256):
                sims = np.array(unit_rows(f["vector"].iloc[start : start + 256])) @ leaders.T
                keep += (np.round(sims.max(1), 6) <= gate).tolist()
            f = f[keep]
        return f.drop(columns="_part")

    left, found, number = kept(first.select("owner_id", "query_id", "event_id", "vector"), "left-0"), [], 0
    while rows := left.count():
        number += 1
        order = Window.partitionBy("owner_id").orderBy("event_id")
        # ranks need no vectors
        ranks = left.select("owner_id", "event_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= round_size)
        last = kept(ranks.groupBy("owner_id").agg(F.max("event_id").alias("upto")), f"last-{number}")
        upto = left.join(F.broadcast(last) if last.count() <= PART else last, "owner_id")
        block, rest = (upto.where(c).drop("upto") for c in ("event_id <= upto", "event_id > upto"))
        new = kept(block.groupBy("owner_id").applyInPandas(fold, schema), f"found-{number}")
        found.append(f"{path}/found-{number}")
        parts = max(rows // PART + 1, min(spark.sparkContext.defaultParallelism, rows // 1024 + 1))
        rest = rest.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
        every = new.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        left = kept(rest.groupBy("owner_id", "_part").cogroup(every.groupBy("owner_id", "_part")).applyInPandas(far, schema), f"left-{number}")
    return spark.read.schema(left.schema).parquet(*found) if found else left


def assign_votes(votes: DataFrame, round_size: int = ROUND) -> DataFrame:
    """Feedback id of each query voted for (event_id, owner_id, query_id, vector): the most alike earlier one of its owner, or its own.

    Votes are reduced to each query's first one before.  Of queries as alike, the
    one known longest counts.
    """
    first = votes.groupBy("owner_id", "query_id").agg(F.min("event_id").alias("event_id"), F.min_by("vector", "event_id").alias("vector"))
    path = scratch.new_path(votes.sparkSession, "votes")
    first.write.parquet(path)
    first = votes.sparkSession.read.parquet(path)
    known = founders(first, VOTE_GATE, round_size)
    # places in time stand for the known queries, so that ties go to the earliest; those themselves are near to none before
    others = first.join(known.select("owner_id", "query_id"), ["owner_id", "query_id"], "left_anti")
    asked = others.select(F.to_json(F.struct("owner_id", "query_id")).alias("query_id"), "vector", "owner_id", "event_id")
    near = block_topk(asked, known.select(F.col("event_id").alias("point_id"), "vector", "owner_id"), 1, {"dense": earlier_of_owner})
    near = near.where(F.col("score") > VOTE_GATE).select(F.col("query_id").alias("_asked"), F.col("point_id").alias("_at"))
    ids = known.select(F.col("event_id").alias("_when"), F.col("owner_id").alias("_owner"), F.col("query_id").alias("_found"))
    joined = first.withColumn("_asked", F.to_json(F.struct("owner_id", "query_id"))).join(near, "_asked", "left")
    joined = joined.join(ids, (F.col("_at") == F.col("_when")) & (F.col("owner_id") == F.col("_owner")), "left")
    return joined.select("owner_id", "query_id", F.coalesce("_found", "query_id").alias("feedback_id"))


def earlier_of_owner(q: pd.DataFrame):
    """Scores of an owner's known queries that were voted for before."""
    alike, at = same_owner_scores(q), q["event_id"].to_numpy()

    def score(part: pd.DataFrame) -> np.ndarray:
        s = alike(part)
        s[at[:, None] <= part["point_id"].to_numpy()[None]] = -np.inf
        return s

    return score
