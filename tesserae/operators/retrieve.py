"""Retrieval: dense and sparse top-k, rank fusion, late interaction, and the whole search.

A small set of queries, whose size is checked, is sent to the points where they
lie.  Of a larger one, queries and points are dealt into blocks of bounded size
and each block of queries meets each block of points in one task.  Either way a
task keeps each query's best k.  The sparse branch runs over postings.  Filters
apply before scoring.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import postings
from tesserae.operators.encode import encode_kinds
from tesserae.sources import scratch

#: Bytes of a block of queries and of one of points, and scores in memory at once.
QUERY_BYTES, POINT_BYTES, CELLS = 8_000_000, 64_000_000, 2_000_000
#: Queries of a tile of scores, and those of it whose scores are copied at once.
TILE, COPIED = 1024, 64
#: Fixed value: candidates of a search.
POOL = 50
DIGITS = 6
#: Scores nearer than this may be equal once rounded.
SLACK = 1.01 * 10**-DIGITS

#: From a block of queries, a function that scores points against it (queries x points).
Scorer = Callable[[pd.DataFrame], Callable[[pd.DataFrame], np.ndarray]]


def ranked(found: DataFrame, k: int, query: str | list[str] = "query_id", item: str = "point_id", by: str = "score") -> DataFrame:
    """Rank from 1 by score, ties by id; the best k stay."""
    order = Window.partitionBy(query).orderBy(F.desc(by), item)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of(score: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row, positions of its k largest scores, ties by id; minus infinity is no candidate."""
    out = []
    for row in score:
        near = np.flatnonzero(row >= (np.partition(row, -k)[-k] if len(row) > k else -np.inf))
        near = near[row[near] > -np.inf]
        # ids may be texts
        near = near[np.argsort(ids[near], kind="stable")]
        out.append(near[np.argsort(-row[near], kind="stable")][:k])
    return out


def measured(rows: DataFrame) -> tuple[int, int]:
    """Rows, and about the bytes of their vectors and texts; vectors are as long as the first."""
    text = F.coalesce(F.octet_length("text"), F.lit(0)) if "text" in rows.columns else F.lit(0)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(text.cast("long")), F.lit(0))).first()
    first = rows.where(F.col("vector").isNotNull()).select(F.size("vector")).first() if "vector" in rows.columns and n else None
    return n, total + n * (8 * first[0] if first else 0)


class Best:
    """The best k points of each query of a block, over any number of blocks of points, ties by id.

    Scores are looked at in tiles; kept are the best so far, as arrays, and of a
    tile only what can be among them.
    """

    def __init__(self, queries: pd.DataFrame, k: int, scorers: dict[str, Scorer]) -> None:
        self.k = k
        starts = range(0, len(queries), TILE)
        # a tile of queries: its ids, its scorers, and for each branch the rows, points and scores found
        self.tiles = [(q["query_id"].to_numpy(), {branch: scorer(q) for branch, scorer in scorers.items()}, {}) for q in (queries.iloc[n : n + TILE] for n in starts)]

    def add(self, points: pd.DataFrame) -> None:
        step = max(1, CELLS // max([len(ids) for ids, _, _ in self.tiles], default=1))
        for start in range(0, len(points), step):
            part = points.iloc[start : start + step]
            names = part["point_id"].to_numpy()
            for ids, scorers, found in self.tiles:
                for branch, score in scorers.items():
                    found[branch] = self.merged(found.get(branch), score(part), names, len(ids))

    def merged(self, found, s: np.ndarray, names: np.ndarray, n: int):
        """Rows, points and scores of the best of what was found and of a tile; minus infinity is no candidate."""
        k, least = self.k, np.full(n, -np.inf)
        if found is not None:
            rows, _, scores = found
            last = np.flatnonzero(np.bincount(rows, minlength=n) >= k)
            # found is sorted by row and score
            least[last] = scores[np.searchsorted(rows, last, "right") - 1]
        if s.shape[1] > k:
            fresh = np.flatnonzero(least == -np.inf)
            for some in (fresh[m : m + COPIED] for m in range(0, len(fresh), COPIED)):
                least[some] = np.partition(np.where(np.isnan(s[some]), -np.inf, s[some]), -k, axis=1)[:, -k]
        # rounding keeps the order, so no more than half a digit is lost; what is no number is no candidate
        row, at = np.nonzero(s >= np.maximum(least - SLACK, np.finfo(float).min)[:, None])
        point, score = names[at], np.round(s[row, at], DIGITS) + 0.0
        if found is not None:
            row, point, score = np.concatenate([found[0], row]), np.concatenate([found[1], point]), np.concatenate([found[2], score])
        # ids may be texts
        order = np.lexsort((np.unique(point, return_inverse=True)[1], -score, row))
        row = row[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[first], point[order[first]], score[order[first]]

    def rows(self):
        for ids, _, found in self.tiles:
            for branch, (row, point, score) in found.items():
                yield pd.DataFrame({"branch": branch, "query_id": ids[row], "point_id": point, "score": score})


def block_topk(queries: DataFrame, points: DataFrame, k: int, scorers: dict[str, Scorer]) -> DataFrame:
    """Best k points of each query by each scorer: (branch, query_id, point_id, score, rank).

    queries: query_id and columns; points: point_id and columns; of these only
    ``vector`` and ``text`` are taken to be large.  Queries that measure no more
    than ``QUERY_BYTES`` go to where the points lie, and only the best points are
    shuffled; more are dealt into blocks that meet blocks of points.
    """
    n_queries, q_bytes = measured(queries)
    of = {**dict(queries.dtypes), **dict(points.dtypes)}
    schema = f"branch string, query_id {of['query_id']}, point_id {of['point_id']}, score double"
    if q_bytes + 100 * n_queries <= QUERY_BYTES:
        asked = queries.toPandas()

        def scan(frames):
            best = Best(asked, k, scorers)
            for f in frames:
                best.add(f)
            yield from best.rows()

        return ranked(points.mapInPandas(scan, schema), k, ["branch", "query_id"])
    n_points, p_bytes = measured(points)
    lanes = points.sparkSession.sparkContext.defaultParallelism
    n_q, n_p = q_bytes // QUERY_BYTES + 1, max(p_bytes // POINT_BYTES + 1, min(lanes, n_points // 256 + 1))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("_q", dealt("query_id", n_q)).withColumn("_p", every(n_p))
    right = points.withColumn("_p", dealt("point_id", n_p)).withColumn("_q", every(n_q))

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        best = Best(q, k, scorers)
        best.add(p)
        rows = list(best.rows())
        return pd.concat(rows) if rows else pd.DataFrame(columns=["branch", "query_id", "point_id", "score"])

    met = left.groupBy("_q", "_p").cogroup(right.groupBy("_q", "_p")).applyInPandas(run, schema)
    return ranked(met, k, ["branch", "query_id"])


def matrix(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, float) for v in vectors])
    length = np.sqrt((x * x).sum(1, keepdims=True)) if len(x) else x
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


_last: dict = {}


def unit_vectors(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a vector, and those in unit length; kept for the tiles of queries that meet the same points."""
    if _last.get("part") is not part:
        own = part["vector"].notna().to_numpy()
        _last.update(part=part, made=(own, matrix(part["vector"][own])))
    return _last["made"]


def cosine_scores(q: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
    """Rows without a vector are no candidates, and queries without one have none."""
    has = q["vector"].notna().to_numpy()
    qm = matrix(q["vector"][has])

    def score(part: pd.DataFrame) -> np.ndarray:
        own, pm = unit_vectors(part)
        if has.all() and own.all():
            return qm @ pm.T
        s = np.full((len(q), len(part)), -np.inf)
        if has.any() and own.any():
            s[np.ix_(has, own)] = qm @ pm.T
        return s

    return score


def same_owner_scores(q: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
    cosines, owner = cosine_scores(q), q["owner_id"].to_numpy()

    def score(part: pd.DataFrame) -> np.ndarray:
        s = cosines(part)
        s[owner[:, None] != part["owner_id"].to_numpy()[None]] = -np.inf
        return s

    return score


def dense_topk(queries: DataFrame, points: DataFrame, k: int = 5, same_owner: bool = False, id_col: str = "point_id") -> DataFrame:
    """Cosine top-k.  queries: query_id, vector [, owner_id]; points: id, vector [, owner_id]."""
    extra = ["owner_id"] * same_owner
    kept = points.where(F.col("vector").isNotNull()).select(F.col(id_col).alias("point_id"), "vector", *extra)
    scorer = same_owner_scores if same_owner else cosine_scores
    return block_topk(queries.select("query_id", "vector", *extra), kept, k, {"dense": scorer}).drop("branch")


def sparse_topk(queries: DataFrame, docs: DataFrame | postings.Postings, k: int = 5, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """Dot product of sparse vectors, or of term frequencies where rows have none; docs: rows, or an index of them.  Points that share no term are none."""
    index = docs if isinstance(docs, postings.Postings) else postings.build(with_terms(docs, id_col, text_col).withColumnRenamed(id_col, "point_id"))
    return postings.search(with_terms(queries, "query_id", "text"), index, k)


def with_terms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sparse): the sparse vectors that rows have, else the counts of their texts' terms."""
    if "sparse" in rows.columns:
        return rows.select(id_col, "sparse")
    return encode_kinds(rows.select(id_col, text_col), text_col, None, "terms", None, only="sparse").select(id_col, "sparse")


def reciprocal_rank_fusion(branches: list[DataFrame], k: int, rrf_k: int = 2) -> DataFrame:
    """Sum of 1 / (rrf_k + position) over ranked lists, positions from 0."""
    parts = [b.select("query_id", "point_id", (1.0 / (rrf_k + F.col("rank") - 1)).alias(f"_{n}")) for n, b in enumerate(branches)]
    joined = reduce(lambda a, b: a.join(b, ["query_id", "point_id"], "full"), parts)
    total = reduce(lambda a, b: a + b, [F.coalesce(f"_{n}", F.lit(0.0)) for n in range(len(parts))])
    return ranked(joined.select("query_id", "point_id", F.round(total, DIGITS).alias("score")), k)


def hybrid_topk(queries: DataFrame, points: DataFrame, k: int = 5, rrf_k: int = 2, index: postings.Postings | None = None) -> DataFrame:
    """Dense and sparse branches of twice k, fused.  queries: query_id, text, vector; points: point_id, text, vector.

    ``index`` has the points' terms; without one it is built.
    """
    dense = dense_topk(queries, points, 2 * k).select("query_id", "point_id", "rank")
    sparse = sparse_topk(queries, index or points, 2 * k).select("query_id", "point_id", "rank")
    total = F.round(F.sum(1.0 / (rrf_k + F.col("rank") - 1)), DIGITS)
    return ranked(dense.unionByName(sparse).groupBy("query_id", "point_id").agg(total.alias("score")), k)


def max_sim(query: Column, point: Column) -> Column:
    """Sum over query vectors of the best inner product with a point's vectors."""
    from tesserae.functions.vector import dot

    return F.aggregate(F.transform(query, lambda q: F.array_max(F.transform(point, lambda p: dot(q, p)))), F.lit(0.0), lambda s, x: s + x)


def token_vectors(vector: Column, tokens: int = 4, width: int = 16) -> Column:
    """A vector as several shorter unit vectors, where no late-interaction encoder is plugged in."""
    from tesserae.functions.vector import unit

    return F.array(*[unit(F.slice(vector, k * width + 1, width)) for k in range(tokens)])


def rerank(candidates: DataFrame, queries: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """Late interaction over candidates (query_id, point_id); queries and points have ``tokens``."""
    pairs = candidates.select("query_id", "point_id").join(queries.select("query_id", F.col("tokens").alias("q")), "query_id").join(points.select("point_id", F.col("tokens").alias("p")), "point_id")
    scored = pairs.select("query_id", "point_id", F.round(max_sim(F.col("q"), F.col("p")), DIGITS).alias("rerank_score"))
    return ranked(scored, k, by="rerank_score")


def positional_scores(reranked: DataFrame, pool: DataFrame) -> DataFrame:
    """Row i of the reranked list takes the score of row i of the candidate list, its own where that is none or 0."""
    by_place = pool.select("query_id", "rank", F.col("score").alias("place_score"))
    out = reranked.join(by_place, ["query_id", "rank"], "left")
    place = F.coalesce("place_score", F.lit(0.0))
    return out.select("query_id", "point_id", "rank", "rerank_score", F.when(place == 0, F.col("rerank_score")).otherwise(place).alias("score"))


def search(queries: DataFrame, points: DataFrame, k: int = 5, min_score: float = 0.0, hybrid: bool = True, reranking: bool = True, feedback: Callable[[DataFrame], DataFrame] | None = None, on_pool: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Candidates, score threshold, late interaction, feedback, limit.

    ``points`` are filtered by tenant beforehand, so the filter reaches the scan.
    """
    pool = (hybrid_topk if hybrid else dense_topk)(queries, points, POOL)
    # used twice below: as candidates, and for the scores of their places
    path = scratch.new_path(queries.sparkSession, "pool")
    pool.write.parquet(path)
    pool = queries.sparkSession.read.parquet(path)
    if on_pool is not None:
        on_pool(pool)
    kept = pool.where(F.col("score") >= min_score)
    if reranking:
        kept = positional_scores(rerank(kept, queries, points, k), pool)
    else:
        kept = kept.withColumn("rerank_score", F.lit(None).cast("double"))
    if feedback is not None:
        kept = feedback(kept)
    return ranked(kept.drop("rank"), k) if feedback is not None else kept.where(F.col("rank") <= k)


def dedup_results(results: DataFrame, value: str = "score") -> DataFrame:
    """Each id of a query once: at its first position, with its last value (query_id, position, point_id, value)."""
    return results.groupBy("query_id", "point_id").agg(F.min("position").alias("position"), F.max_by(value, "position").alias(value))
