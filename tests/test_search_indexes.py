"""Postings and inverted files against full scans, and votes over blocks against one fold."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.operators import feedback, ivf, postings, retrieve
from tesserae.sources import tables
from tesserae.streaming import votes

from .conftest import DATA


def by_scan(asked, points, k):
    """Best k by dot products over dictionaries."""
    out = []
    for q, terms in asked.items():
        scores = [(-round(float(sum(w * own.get(t, 0) for t, w in terms.items())), 6), p) for p, own in points.items() if set(terms) & set(own)]
        out += [(q, p, -s, rank) for rank, (s, p) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "first"), [(3, 1), (5, 2), (64, 2), (2, 50)])
def test_pruned_postings_are_a_full_scan(spark, monkeypatch, block, first):
    """``the`` is in every point; lengths vary, so most blocks can't reach the threshold."""
    monkeypatch.setattr(postings, "BLOCK_POINTS", block)
    rng = random.Random(block)
    points = {p: {"the": 1 + rng.randrange(9), **{f"t{rng.randrange(30)}": 1 + rng.randrange(4) for _ in range(rng.choice([1, 2, 20]))}} for p in range(120)}
    points[500] = {}
    asked = {q: {"the": 1, **{f"t{rng.randrange(40)}": 1 + rng.randrange(3) for _ in range(4)}} for q in range(15)} | {77: {"none": 1}}
    maps = lambda named: [(i, {t: float(w) for t, w in own.items()}) for i, own in named.items()]
    index = postings.build(spark.createDataFrame([*maps(points), (501, None)], "point_id long, sparse map<string, double>"))
    got = postings.search(spark.createDataFrame([*maps(asked), (78, None)], "query_id long, sparse map<string, double>"), index, 7, first)
    assert sorted(map(tuple, got.select("query_id", "point_id", "score", "rank").collect())) == by_scan(asked, points, 7)


def test_blocks_out_of_reach_are_not_scored(spark, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK_POINTS", 10)
    index = postings.build(spark.createDataFrame([(p, {"x": float(p // 10 + 1), "y": float(p // 10 + 1)}) for p in range(100)], "point_id long, sparse map<string, double>"))
    seen = []
    real = postings.scored
    monkeypatch.setattr(postings, "scored", lambda blocks, asked, index: seen.append(blocks.count()) or real(blocks, asked, index))
    got = postings.search(spark.createDataFrame([(1, {"x": 1.0, "y": 2.0})], "query_id long, sparse map<string, double>"), index, 5, 1)
    assert [r["point_id"] for r in got.orderBy("rank").collect()] == [90, 91, 92, 93, 94]
    assert sum(seen) <= 5 < index.maxima.select("block").distinct().count()


def test_large_query_sets_meet_points_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(f"p{i:03}", rng.normal(size=8).tolist()) for i in range(150)], "point_id string, vector array<double>")
    queries = points.where("point_id < 'p020'").withColumnRenamed("point_id", "query_id")
    whole = sorted(map(tuple, retrieve.dense_topk(queries, points, 4).collect()))
    plan = retrieve.dense_topk(queries, points, 4)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapCoGroupsInPandas" not in plan
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 500)
    dealt = retrieve.dense_topk(queries, points, 4)
    assert "FlatMapCoGroupsInPandas" in dealt._jdf.queryExecution().toString() and sorted(map(tuple, dealt.collect())) == whole


def test_inverted_file_finds_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(ivf, "BLOCK_POINTS", 40)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    vectors = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.4).tolist()
    # a vector that a third of all points have, points without one, and one of length 0
    rows = [(k, vectors[0] if k % 3 == 1 else v) for k, v in enumerate(vectors)] + [(9000, None), (9001, [0.0] * 16)]
    points = spark.createDataFrame(rows, "point_id long, vector array<double>")
    queries = spark.createDataFrame([(k, vectors[k]) for k in range(0, 3000, 60)] + [(-1, None)], "query_id long, vector array<double>")
    index = ivf.build(points)
    assert index.points.count() == 3000 and index.points.groupBy("list", "block").count().agg(F.max("count")).first()[0] < 200
    found, exact = ivf.search(queries, index, 10), retrieve.dense_topk(queries, points.where("point_id < 9000"), 10)
    assert ivf.recall(found, exact).agg(F.avg("recall")).first()[0] >= 0.95
    assert found.groupBy("query_id").count().where("count > 10").isEmpty()
    numbers, sizes, centroids = index.lists()
    looked = [sizes[p].sum() for p in ivf.probes(retrieve.matrix([v for _, v in rows[:50]]), sizes, centroids, 128)]
    assert np.median(looked) < 3000 / 2
    none = ivf.build(points.limit(0))
    assert ivf.search(queries, none).count() == 0


def test_recall_on_the_tables(spark):
    points = tables.points(spark, DATA).select("point_id", "vector")
    queries = points.where("point_id % 50 = 0").withColumnRenamed("point_id", "query_id")
    found = ivf.search(queries, ivf.build(points), retrieve.POOL)
    assert ivf.recall(found, retrieve.dense_topk(queries, points, retrieve.POOL)).agg(F.avg("recall")).first()[0] >= 0.95


def some_votes(n=300, owners=2, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 6))
    vectors = centres[rng.integers(0, 9, n)] + rng.normal(size=(n, 6)) * 0.25
    # queries voted for again, later
    rows = [(2 * k, f"o{k % owners}", f"q{k:04}", v.tolist()) for k, v in enumerate(vectors)]
    return rows + [(2 * k + 1, *rows[k // 2][1:]) for k in range(0, n, 7)]


def fold_by_hand(rows):
    out = {}
    for owner in {r[1] for r in rows}:
        first = {}
        for event, _, query, vector in sorted(r for r in rows if r[1] == owner):
            first.setdefault(query, vector)
        found = feedback.assign_in_order(list(zip(first, feedback.unit_rows(first.values()), strict=True)), [])
        out.update({(owner, q): f for q, f in zip(first, found, strict=True)})
    return out


@pytest.mark.parametrize("round_size", [1, 15, 2048])
def test_votes_in_rounds_are_one_fold(spark, monkeypatch, round_size):
    monkeypatch.setattr(feedback, "PART", 50)
    rows = some_votes(120 if round_size == 1 else 300, owners=1 if round_size == 15 else 2)
    if round_size == 1:
        rows = [r for r in rows if r[0] < 60]
    found = feedback.assign_votes(spark.createDataFrame(rows, "event_id long, owner_id string, query_id string, vector array<double>"), round_size)
    want = fold_by_hand(rows)
    assert {(r["owner_id"], r["query_id"]): r["feedback_id"] for r in found.collect()} == want
    assert len(set(want.values())) > 5


def hybrid_by_hand(rows):
    """Each vote against all known ones, branch by branch."""
    out, known = {}, {}
    for _, owner, query, vector, terms in sorted(rows, key=lambda r: r[0]):
        if (owner, query) in out:
            continue
        own = known.setdefault(owner, [])
        v = np.array(vector) / np.linalg.norm(vector)
        dense = sorted((-round(float(v @ u), 6), k) for k, (_, u, _) in enumerate(own))[:2]
        shared = [(sum(w * t.get(x, 0) for x, w in terms.items()), k) for k, (_, _, t) in enumerate(own)]
        sparse = sorted((-s, k) for s, k in shared if s > 0)[:2]
        fused = {}
        for branch in (dense, sparse):
            for place, (_, k) in enumerate(branch):
                fused[k] = fused.get(k, 0) + 1 / (2 + place)
        best = min(fused, key=lambda k: (-fused[k], k), default=None)
        if best is not None and fused[best] > 0.9:
            out[owner, query] = own[best][0]
        else:
            own.append((query, v, terms))
            out[owner, query] = query
    return out


def test_hybrid_votes_in_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = [(*r, {f"t{rng.randrange(6)}": float(rng.randint(1, 3)) for _ in range(rng.randrange(3))}) for r in some_votes(80)]
    frame = spark.createDataFrame(rows, "event_id long, owner_id string, query_id string, vector array<double>, terms map<string, double>")
    want = hybrid_by_hand([(e, o, q, v, t) for e, o, q, v, t in rows])
    got = {(r["owner_id"], r["query_id"]): r["feedback_id"] for r in feedback.assign_hybrid(frame).collect()}
    assert got == want and 1 < len(set(want.values())) < len(want)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in ("event_id < 60", "event_id >= 60"):
        frame.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = votes.assign_stream(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), hybrid=True)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == len(rows) and {(r["owner_id"], r["query_id"]): r["feedback_id"] for r in out.collect()} == want


def test_founders_are_not_searched_for_again(spark, monkeypatch):
    asked = []
    search = feedback.block_topk
    monkeypatch.setattr(feedback, "block_topk", lambda queries, *rest: asked.append(queries.count()) or search(queries, *rest))
    rows = [(0, "o", "a", [1.0, 0.0]), (1, "o", "b", [0.0, 1.0]), (2, "o", "c", [0.01, 1.0])]
    found = feedback.assign_votes(spark.createDataFrame(rows, "event_id long, owner_id string, query_id string, vector array<double>"))
    assert {r["query_id"]: r["feedback_id"] for r in found.collect()} == {"a": "a", "b": "b", "c": "b"}
    assert asked == [1]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_postings_are_not_shuffled_for_few_blocks(spark, monkeypatch, sent):
    monkeypatch.setattr(postings, "SENT_ROWS", sent)
    # decided by the hint alone
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = postings.build(spark.createDataFrame([(p, {"x": float(p), "y": 1.0}) for p in range(1, 200)], "point_id long, sparse map<string, double>"))
        blocks = index.rows.selectExpr("1L as query_id", "block").distinct()
        found = postings.scored(blocks, spark.createDataFrame([(1, "x", 2.0)], "query_id long, term string, asked double"), index)
        assert sorted(tuple(r) for r in found.collect()) == [(1, p, 2.0 * p) for p in range(1, 200)]
        plan = found._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("BroadcastHashJoin" in plan) == (sent > 0)
