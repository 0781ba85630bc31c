"""Exact top-k by inner product over a pivot-distance index.

Vectors get one more coordinate that makes all norms equal, so the largest inner
product is the smallest distance.  Each vector is keyed by its nearest pivot and
the distance to it; sorted by that key, bounded blocks of vectors are annuli
around a pivot.  A query's distance to a vector is at least the difference of
their distances to a pivot, so an annulus whose bound is worse than the query's
k-th score so far can't hold a result.

Search widens in three steps, each with a tighter bar: the query's own annulus,
the nearest few annuli, and every further one that the bound lets through.
Queries of one block are compared together with a block of vectors.

Pivots come from a bounded, hash-chosen sample (``pivot_sample``); all vectors
are indexed and the result is exact whatever the pivots are.

Defined results: vectors that are null, or hold null, NaN or infinite
components, and null ids take no part; an id that occurs repeatedly stands for
its smallest vector; shorter vectors count as padded with zeros; ties go to the
smaller id; a query with fewer than k candidates returns them all.  Scores are
whole numbers and exact: products are summed in double precision only where no
sum can pass 2 ** 53, else as integers; a score beyond 64 bits is returned as the
largest or smallest one, such ties going by id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import materialize


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def pick_pivots(points: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first traversal."""
    chosen = [int(np.argmax((points**2).sum(1)))] if len(points) else []
    gap = ((points - points[chosen[0]]) ** 2).sum(1) if chosen else None
    while chosen and len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


SMALLEST, LARGEST = -(2**63), 2**63 - 1


class Space:
    """Vectors lifted to equal norm, and distances to pivots."""

    def __init__(self, dim: int, largest: float) -> None:
        self.dim, self.largest, self.pivots = dim, largest, np.zeros((0, dim + 1))

    @property
    def exact(self) -> bool:
        """Whether no partial sum of an inner product can pass what doubles hold exactly."""
        return self.largest < 2**53

    @property
    def blur(self) -> float:
        """How far rounding may put a squared distance off."""
        return 16 * (self.dim + 2) * np.finfo(float).eps * max(self.largest, 1.0)

    def pad(self, vectors) -> np.ndarray:
        out = np.zeros((len(vectors), self.dim), np.int64)
        for k, v in enumerate(vectors):
            out[k, : len(v)] = v
        return out

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.concatenate([x, np.sqrt(np.maximum(self.largest - (x**2).sum(1), 0))[:, None]], 1)

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((points**2).sum(1)[:, None] + (self.pivots**2).sum(1)[None] - 2 * points @ self.pivots.T, 0))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        """Queries are not lifted: their added coordinate is 0."""
        return self.to_pivots(np.concatenate([x, np.zeros((len(x), 1))], 1))

    def radius(self, x: np.ndarray, bar: np.ndarray) -> np.ndarray:
        """Distance within which an inner product can reach ``bar``, with a little slack for rounding."""
        reach = np.sqrt(np.maximum((x.astype(float) ** 2).sum(1) + self.largest - 2 * bar, 0) + self.blur)
        # distances to pivots are off by the root of the blur at most, on either side
        return np.where(np.isfinite(bar), reach * (1 + 1e-9) + 2 * self.blur**0.5 + 1e-6, np.inf)

    def scores(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Inner products of whole-number vectors, as doubles that hold them exactly or else as integers."""
        if self.exact:
            return q.astype(float) @ v.T.astype(float)
        return np.clip(q.astype(object) @ v.T.astype(object), SMALLEST, LARGEST)


def top_rows(score: np.ndarray, q_ids: np.ndarray, v_ids: np.ndarray, k: int, bar: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector id, score) of each query's best k in a block, below the bar left out."""
    rows, ids, scores = [], [], []
    for i in range(len(q_ids)):
        other = np.flatnonzero(v_ids != q_ids[i])
        s = score[i, other]
        if len(s) > k:
            kth = np.partition(s, -k)[-k]
            near = np.flatnonzero(s >= (kth if bar[i] is None else max(kth, bar[i])))
        else:
            near = np.arange(len(s)) if bar[i] is None else np.flatnonzero(s >= bar[i])
        near = near[np.lexsort((v_ids[other[near]], -s[near]))][:k]
        rows.append(np.full(len(near), i))
        ids.append(v_ids[other[near]])
        scores.append(s[near].astype(np.int64))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 32, pivot_sample: int = 2048, block_rows: int = 2048, near_blocks: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score); ``is_query`` is evaluated on ``vec_id``."""
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    points = source.groupBy("vec_id").agg(F.min(quantised(F.col("v"))).alias("v")).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    points = materialize(points, "vectors")
    # a little more than the largest norm, since its sum is rounded
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    shape = points.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("largest"), F.count("*").alias("n")).first()
    answer = "query_id long, vec_id long, score long"
    if not shape["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    space = Space(shape["dim"], shape["largest"] * (1 + 1e-12))
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_sample).select("v").toPandas()
    space.pivots = pick_pivots(space.lift(space.pad(sample["v"])), pivots)

    def keyed(frames):
        for f in frames:
            if len(f):
                x = space.pad(f["v"])
                d = space.to_pivots(space.lift(x))
                near = d.argmin(1)
                yield pd.DataFrame({"vec_id": f["vec_id"], "is_query": f["is_query"], "pivot": near.astype("int32"), "dist": d[np.arange(len(d)), near], "data": [r.tobytes() for r in x]})

    index = points.mapInPandas(keyed, "vec_id long, is_query boolean, pivot int, dist double, data binary")
    parts = int(shape["n"] // (4 * block_rows)) + 1
    index = index.repartitionByRange(parts, "pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")

    def blocks(frames):
        held, number = None, TaskContext.get().partitionId() << 32
        for f in frames:
            held = f if held is None else pd.concat([held, f], ignore_index=True)
            while len(held) and (len(held) > block_rows or held["pivot"].iloc[0] != held["pivot"].iloc[-1]):
                n = min(block_rows, int((held["pivot"] == held["pivot"].iloc[0]).sum()))
                yield block(held.iloc[:n], number)
                held, number = held.iloc[n:].reset_index(drop=True), number + 1
        if held is not None and len(held):
            yield block(held, number)

    def block(f: pd.DataFrame, number: int) -> pd.DataFrame:
        x, ids = np.frombuffer(b"".join(f["data"]), np.int64).reshape(len(f), -1), f["vec_id"].to_numpy()
        asks = np.flatnonzero(f["is_query"].to_numpy())
        row, near, score = top_rows(space.scores(x[asks], x), ids[asks], ids, k, [None] * len(asks)) if len(asks) else (np.zeros(0, int),) * 3
        return pd.DataFrame({
            "block": [number], "pivot": [f["pivot"].iloc[0]], "lo": [f["dist"].iloc[0]], "hi": [f["dist"].iloc[-1]],
            "ids": [ids.tobytes()], "data": [x.tobytes()], "asks": [asks.astype(np.int64).tobytes()],
            "found": [list(zip(ids[asks][row].tolist(), near.tolist(), score.tolist(), strict=True))],
        })

    built = index.mapInPandas(blocks, "block long, pivot int, lo double, hi double, ids binary, data binary, asks binary, found array<struct<query_id: long, vec_id: long, score: long>>")
    built = materialize(built, "blocks")
    found = built.select(F.inline("found"))
    annuli = built.select(F.col("block").alias("other"), "pivot", "lo", "hi")

    def bars(found: DataFrame) -> DataFrame:
        """The k-th best score of each query, where it has as many."""
        best = ranked(found, k).where(F.col("rank") == k)
        return best.select("query_id", F.col("score").alias("bar"))

    def reach(bar: DataFrame) -> DataFrame:
        """Per block with queries and per pivot: from where to where its queries' results can lie."""
        def ask(frames):
            for f in frames:
                for number, ids, data, asks in zip(f["block"], f["ids"], f["data"], f["asks"], strict=True):
                    rows = np.frombuffer(asks, np.int64)
                    x = np.frombuffer(data, np.int64).reshape(-1, space.dim)[rows]
                    yield pd.DataFrame({"block": number, "query_id": np.frombuffer(ids, np.int64)[rows], "data": [r.tobytes() for r in x], "to": list(space.of_queries(x))})

        asked = built.where(F.length("asks") > 0).select("block", "ids", "data", "asks").mapInPandas(ask, "block long, query_id long, data binary, to array<double>")
        # the bar itself as text, since pandas would round a whole number beside nulls
        asked = asked.join(bar, "query_id", "left").select("block", "query_id", "data", "to", F.col("bar").cast("string").alias("bar"), F.col("bar").cast("double").alias("near_bar"))

        def widen(frames):
            for f in frames:
                if len(f):
                    x = np.frombuffer(b"".join(f["data"]), np.int64).reshape(len(f), -1)
                    yield f.assign(radius=space.radius(x, f["near_bar"].fillna(-np.inf).to_numpy())).drop(columns="near_bar")

        return asked.mapInPandas(widen, "block long, query_id long, data binary, to array<double>, bar string, radius double")

    def compare(pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """Best k of each query in each block of ``pairs`` (block, other)."""
        chunk = queries.groupBy("block").agg(F.collect_list(F.struct("query_id", "data", "bar")).alias("chunk"))
        # a block of queries has block_rows rows at most; so many of them meet a block of vectors in one task
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(int(shape["n"] // (block_rows * 64)) + 1)))
        left = salted.join(chunk, "block")
        tiles = salted.select(F.col("other").alias("tile"), F.col("salt").alias("part")).distinct()
        right = tiles.join(built.select(F.col("block").alias("tile"), "ids", "data"), "tile")

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = []
            for ids, data in zip(right["ids"], right["data"], strict=True):
                v_ids, v = np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, space.dim)
                for chunk in left["chunk"]:
                    q_ids = np.array([c["query_id"] for c in chunk])
                    q = np.frombuffer(b"".join(c["data"] for c in chunk), np.int64).reshape(len(chunk), -1)
                    row, near, score = top_rows(space.scores(q, v), q_ids, v_ids, k, [None if c["bar"] is None else int(c["bar"]) for c in chunk])
                    out.append(pd.DataFrame({"query_id": q_ids[row], "vec_id": near, "score": score}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

        return left.groupBy("other", "salt").cogroup(right.groupBy("tile", "part")).applyInPandas(meet, answer)

    def within(queries: DataFrame) -> DataFrame:
        """(block, other, gap): annuli that a block's queries may have to visit, and how far away they are."""
        spread = queries.select("block", "radius", F.posexplode("to").alias("pivot", "d"))
        ranges = spread.groupBy("block", "pivot").agg(F.min(F.col("d") - F.col("radius")).alias("from_d"), F.max(F.col("d") + F.col("radius")).alias("to_d"), F.min("d").alias("d0"), F.max("d").alias("d1"))
        met = ranges.join(annuli, "pivot").where("lo <= to_d and hi >= from_d and block <> other")
        return met.select("block", "other", F.greatest(F.col("lo") - F.col("d1"), F.col("d0") - F.col("hi"), F.lit(0.0)).alias("gap"))

    queries = materialize(reach(bars(found)), "queries")
    near = within(queries).withColumn("n", F.row_number().over(Window.partitionBy("block").orderBy("gap", "other"))).where(F.col("n") <= near_blocks)
    near = materialize(near.select("block", "other"), "near")
    found = materialize(found.unionByName(compare(near, queries)), "found")
    queries = materialize(reach(bars(found)), "queries")
    rest = within(queries).select("block", "other").join(near, ["block", "other"], "left_anti")
    found = found.unionByName(compare(rest, queries))
    return ranked(found, k).select("query_id", "rank", "vec_id", "score")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
