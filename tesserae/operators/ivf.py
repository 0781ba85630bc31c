"""Approximate nearest neighbours by an inverted file: vectors in lists around centroids, stored as Parquet.

Centroids are fitted on a bounded sample, every vector is put into the list of
its nearest centroid, and a query looks into the lists nearest to it until they
hold enough points.  How many are enough is measured when the index is built: for
a bounded sample of its own points, how far down the lists their exact neighbours
lie.  Vectors in clusters need a few lists; of vectors without any structure most
lists are read, since no index finds their neighbours otherwise.  A list of any
size is split into blocks of bounded size, so that a vector which a third of all
points have is searched by many tasks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators.retrieve import DIGITS, POOL, best_of, dense_topk, matrix, ranked
from tesserae.sources import scratch

#: Vectors in the sample for each list, lists at most, points of a block.
SAMPLE, LISTS, BLOCK_POINTS = 64, 4096, 20_000
#: Share of exact neighbours to be found, and points of the sample that it is measured with.
RECALL, MEASURED = 0.97, 256


@dataclass
class Index:
    """An inverted file on shared storage: points by list, and the lists' centroids and sizes (at most ``LISTS``)."""

    spark: SparkSession
    path: str
    schema: str
    wanted: int = 0

    @property
    def points(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/points")

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, sizes and centroids."""
        rows = sorted(self.spark.read.schema("list long, n long, centroid string").parquet(f"{self.path}/lists").collect())
        return np.array([r["list"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64), np.array([json.loads(r["centroid"]) for r in rows], float)


def nearest_list(vectors: pd.Series, centroids: np.ndarray) -> np.ndarray:
    return (matrix(vectors) @ centroids.T).argmax(1)


def build(points: DataFrame, path: str | None = None, lists: int | None = None, seed: int = 7, recall_wanted: float = RECALL) -> Index:
    """Index of points (point_id, vector, ...); rows without a vector or with one of length 0 are in no list.

    The centroids come from at most ``SAMPLE`` vectors a list, chosen by a hash of
    the id; all rows are indexed.
    """
    spark = points.sparkSession
    path = path or scratch.new_path(spark, "ivf")
    usable = points.where(F.col("vector").isNotNull() & F.exists("vector", lambda x: x != 0))
    n = usable.count()
    lists = lists or max(1, min(LISTS, int(n**0.5)))
    want = SAMPLE * lists
    chosen = usable if n <= want else usable.where(F.pmod(F.xxhash64("point_id"), F.lit(1 << 20)) < int((1 << 20) * want / n) + 1)
    fitted = chosen.select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    if n:
        model = KMeans(k=lists, distanceMeasure="cosine", seed=seed, maxIter=12).fit(fitted)
        centroids = matrix([np.array(c) for c in model.clusterCenters()])
    else:
        centroids = np.zeros((1, 1))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", list long, block long"

    def assign(frames):
        for f in frames:
            yield f.assign(list=nearest_list(f["vector"], centroids) if len(f) else [], block=0)

    assigned = usable.mapInPandas(assign, schema)
    assigned.write.parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = assigned.groupBy("list").agg(F.count("*").alias("n"))
    known = {r["list"]: r["n"] for r in sizes.collect()}
    rows = [(k, known[k], json.dumps(centroids[k].tolist())) for k in sorted(known)]
    spark.createDataFrame(rows, "list long, n long, centroid string").write.parquet(f"{path}/lists")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_POINTS))
    # one row a list
    dealt = assigned.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("point_id"), blocks).cast("long")).drop("n")
    dealt.repartition("list", "block").sortWithinPartitions("list", "block").write.partitionBy("list").parquet(f"{path}/points")
    index = Index(spark, path, schema)
    index.wanted = enough(index, n, recall_wanted) if n else 0
    return index


def enough(index: Index, n: int, share: float) -> int:
    """Points that the nearest lists must hold for ``share`` of the exact neighbours of stored points to lie in them."""
    numbers, sizes, centroids = index.lists()
    mark = F.pmod(F.xxhash64("point_id", F.lit(1)), F.lit(1 << 20))
    sample = index.points.where(mark < int((1 << 20) * min(1.0, MEASURED / n)) + 1).select(F.col("point_id").alias("query_id"), "vector")
    near = dense_topk(sample, index.points, POOL).select("query_id", "point_id")
    # about MEASURED times POOL rows
    found = near.join(index.points.select("point_id", "list"), "point_id").groupBy("query_id").agg(F.collect_list("list").alias("lists")).join(sample, "query_id").select("vector", "lists").toPandas()
    if not len(found):
        return n
    order = np.argsort(-(matrix(found["vector"]) @ centroids.T), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    place = {number: k for k, number in enumerate(numbers.tolist())}
    depth = [h[int(np.flatnonzero(row == place[x])[0])] for row, h, lists in zip(order, held, found["lists"], strict=True) for x in lists]
    return int(np.quantile(depth, share, method="higher"))


def probes(vectors: np.ndarray, sizes: np.ndarray, centroids: np.ndarray, wanted: int) -> list[np.ndarray]:
    """For each vector, places of its nearest lists, as many as hold ``wanted`` points."""
    order = np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    return [row[: int(np.searchsorted(h, wanted)) + 1] for row, h in zip(order, held, strict=True)]


def search(queries: DataFrame, index: Index, k: int = 5, wanted: int | None = None) -> DataFrame:
    """About the best k points of each query (query_id, vector): query_id, point_id, score, rank.

    ``wanted`` is how many points to look at, else what was measured for up to ``POOL`` neighbours.
    """
    numbers, sizes, centroids = index.lists()
    of = {**dict(queries.dtypes), **dict(index.points.dtypes)}
    if not len(numbers):
        return index.spark.createDataFrame([], f"query_id {of['query_id']}, point_id {of.get('point_id', 'long')}, score double, rank int")
    wanted = max(k, wanted or index.wanted * max(1, k // POOL))
    blocks = -(-sizes // BLOCK_POINTS)

    def ask(frames):
        for f in frames:
            f = f[f["vector"].notna()]
            rows = []
            for start in range(0, len(f), 1024):
                part = f.iloc[start : start + 1024]
                found = probes(matrix(part["vector"]), sizes, centroids, wanted)
                rows += [(q, v, int(numbers[at]), b) for q, v, places in zip(part["query_id"], part["vector"], found, strict=True) for at in places.tolist() for b in range(int(blocks[at]))]
            yield pd.DataFrame(rows, columns=["query_id", "vector", "list", "block"])

    asked = queries.select("query_id", "vector").mapInPandas(ask, f"query_id {of['query_id']}, vector {of['vector']}, list long, block long")
    path = scratch.new_path(index.spark, "probes")
    asked.write.parquet(path)
    asked = index.spark.read.parquet(path)
    # only the lists that are asked for are read; there are at most LISTS of them
    points = index.points.join(F.broadcast(asked.select("list").distinct()), "list", "left_semi").select("list", "block", "point_id", "vector")

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(q) and len(p):
            ids, pm = p["point_id"].to_numpy(), matrix(p["vector"])
            for start in range(0, len(q), 256):
                part = q.iloc[start : start + 256]
                s = np.round(matrix(part["vector"]) @ pm.T, DIGITS) + 0.0
                rows += [(query, i, x) for query, row, near in zip(part["query_id"], s, best_of(s, ids, k), strict=True) for i, x in zip(ids[near].tolist(), row[near].tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["query_id", "point_id", "score"])

    met = asked.groupBy("list", "block").cogroup(points.groupBy("list", "block")).applyInPandas(run, f"query_id {of['query_id']}, point_id {of['point_id']}, score double")
    return ranked(met, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query, the share of its exact neighbours that were found."""
    hit = exact.select("query_id", "point_id").join(found.select("query_id", "point_id", F.lit(1).alias("hit")), ["query_id", "point_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
