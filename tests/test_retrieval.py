import math
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.functions.vector import cosine
from tesserae.operators import encode, evaluate, feedback, retrieve, store


def measures_by_hand(expected, found):
    ranks = [k + 1 for k, x in enumerate(found) if x in expected]
    share = sum(x in found for x in expected) / len(expected) if expected else 0
    return bool(ranks), share, 1 / ranks[0] if ranks else 0


def test_measures(spark):
    rng = random.Random(31)
    lists = [(rng.choices("pqrstuvw", k=rng.randrange(4)), rng.sample("pqrstuvw", rng.randrange(7))) for _ in range(80)]
    rows = spark.createDataFrame([(k, e, f) for k, (e, f) in enumerate(lists)], "k int, e array<string>, f array<string>")
    e, f = F.col("e"), F.col("f")
    got = rows.select("k", evaluate.is_hit(e, f), evaluate.recall(e, f), evaluate.reciprocal_rank(e, f)).collect()
    for k, *values in got:
        assert tuple(values) == pytest.approx(measures_by_hand(*lists[k]))


def test_summary_needs_cases(spark):
    none = spark.createDataFrame([], "is_hit boolean, recall double, reciprocal_rank double")
    with pytest.raises(Exception, match="no evaluation case"):
        evaluate.summary(none).collect()


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0]), ([], []), ([0.0], [1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [0, 0, 0, pytest.approx(1)]


def test_dense_topk_breaks_ties_by_id_and_ignores_null_vectors(spark):
    points = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, None)], "point_id long, vector array<double>")
    queries = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<double>")
    got = retrieve.dense_topk(queries, points, 3).orderBy("rank").collect()
    assert [(r["point_id"], r["score"]) for r in got] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_dense_topk_in_blocks_is_the_same(spark, monkeypatch):
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(200)], "point_id long, vector array<double>")
    queries = points.where("point_id < 20").withColumnRenamed("point_id", "query_id")
    whole = sorted(map(tuple, retrieve.dense_topk(queries, points, 4).collect()))
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 500)
    monkeypatch.setattr(retrieve, "POINT_BYTES", 3_000)
    monkeypatch.setattr(retrieve, "CELLS", 20)
    assert sorted(map(tuple, retrieve.dense_topk(queries, points, 4).collect())) == whole


def test_fusion_sums_reciprocal_positions(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, point_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, point_id long, rank int")
    got = {r["point_id"]: r["score"] for r in retrieve.reciprocal_rank_fusion([a, b], 5).collect()}
    assert got == {11: pytest.approx(1 / 3 + 1 / 2, abs=1e-6), 10: 0.5, 12: pytest.approx(1 / 3, abs=1e-6)}


def test_positional_scores_fall_back_to_own(spark):
    pool = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.0, 2)], "query_id long, point_id long, score double, rank int")
    reranked = spark.createDataFrame([(1, 6, 2.5, 1), (1, 5, 1.5, 2), (1, 7, 0.5, 3)], "query_id long, point_id long, rerank_score double, rank int")
    got = [r["score"] for r in retrieve.positional_scores(reranked, pool).orderBy("rank").collect()]
    assert got == [0.9, 1.5, 0.5]


@pytest.mark.parametrize("votes, expected", [([3], 0.5 + math.log(3) * 0.9), ([1], 0.5), ([0], -math.inf), ([-1], 0.0), ([-1, 3], math.log(3) * 0.9), ([0, 3], -math.inf)])
def test_boost_edges(spark, votes, expected):
    hits = [(0.9, v) for v in votes]
    df = spark.createDataFrame([(0.5, hits)], "score double, hits array<struct<sim: double, votes: long>>")
    assert df.select(feedback.boosted(F.col("score"), F.col("hits"))).first()[0] == pytest.approx(expected)


def test_votes_are_assigned_to_the_nearest_earlier_query():
    unit = lambda x, y: np.array([x, y]) / np.hypot(x, y)
    votes = [(1, unit(1, 0)), (2, unit(1, 0.1)), (3, unit(0, 1)), (4, unit(0.1, 1))]
    assert feedback.assign_in_order(votes, []) == [1, 1, 3, 3]


def test_votes_in_steps_agree_with_one_by_one():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 6))
    vectors = centres[rng.integers(0, 9, 300)] + rng.normal(size=(300, 6)) * 0.25
    votes = [(n, v / np.linalg.norm(v)) for n, v in enumerate(vectors)]
    known, want = [], []
    for n, v in votes:
        near = [(-round(float(v @ u), 6), place, m) for place, (m, u) in enumerate(known) if round(float(v @ u), 6) > feedback.VOTE_GATE]
        if not near:
            known.append((n, v))
        want.append(min(near)[2] if near else n)
    assert len(known) > 9
    for step in (1, 7, 512):
        assert feedback.assign_in_order(votes, [], step=step) == want


def test_both_branches_of_a_hybrid_search_are_whole(spark):
    rows = [(1, "a b", [1.0, 0.0]), (2, "c", [0.0, 1.0]), (3, None, None), (4, "a", None)]
    points = spark.createDataFrame(rows, "point_id long, text string, vector array<double>")
    queries = spark.createDataFrame([(7, "a b", [0.0, 1.0]), (8, None, None)], "query_id long, text string, vector array<double>")
    got = {r["point_id"]: r["score"] for r in retrieve.hybrid_topk(queries, points, 5).collect()}
    assert got == {1: pytest.approx(1 / 3 + 1 / 2, abs=1e-6), 2: 0.5, 4: pytest.approx(1 / 3, abs=1e-6)}
    assert retrieve.hybrid_topk(queries.limit(0), points).count() == retrieve.hybrid_topk(queries, points.limit(0)).count() == 0


def test_shared_point_goes_with_its_last_resource(spark):
    log = spark.createDataFrame([(1, "save", "c", "A", "p"), (2, "save", "c", "B", "p"), (3, "save", "c", "A", "q"), (4, "delete", "c", "B", None)], "seq long, action string, collection_id string, resource_id string, point_id string")
    assert [(r["point_id"], r["resource_id"]) for r in store.live_points(log).collect()] == [("q", "A")]
    assert store.live_chunks(log).count() == 2


def test_updates(spark):
    table = spark.createDataFrame([(1, "a", False), (2, "b", False)], "k long, v string, is_deleted boolean")
    new = spark.createDataFrame([(2, "c")], "k long, v string")
    assert {r["k"]: r["v"] for r in store.update_by_id(table, new, "k").collect()} == {1: "a", 2: "c"}
    assert {r["k"]: r["is_deleted"] for r in store.soft_delete(table, new, "k").collect()} == {1: False, 2: True}
    assert [r["k"] for r in store.hard_delete(table, new, "k").collect()] == [1]


def test_urls(spark):
    urls = ["https://Docs.Google.com/document/d/X1/edit", "http://h.org/a.b/c", "http://h.org/x.PDF", "http://h.org/x.pdf?q=a.b", "http://www.youtube.com/watch", "not a url", None, "http://h.org"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    u = F.col("u")
    got = df.select(T.url_host(u), T.url_extension(u), T.loader_of(u), T.google_export_url(u)).collect()
    assert [r[0] for r in got] == ["docs.google.com", "h.org", "h.org", "h.org", "www.youtube.com", None, None, "h.org"]
    assert [r[1] for r in got][:4] == ["html", "b/c", "pdf", "pdf"]
    assert [r[2] for r in got] == ["google-doc", "web", "web", "pdf", "youtube", None, None, "web"]
    assert got[0][3] == "https://docs.google.com/document/d/X1/export?format=txt"


def test_content_id(spark):
    import hashlib

    df = spark.createDataFrame([("t", "c", "o"), ("", "c", "o")], "t string, c string, o string")
    got = [r[0] for r in df.select(T.content_id(F.col("t"), F.col("c"), F.col("o"))).collect()]
    h = hashlib.md5(b"c:o:t").hexdigest()
    assert got == [f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", None]


def test_sparse_counts_shared_terms(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "c"), (3, None)], "point_id long, text string")
    queries = spark.createDataFrame([(7, "a b b")], "query_id long, text string")
    assert [(r["point_id"], r["score"]) for r in retrieve.sparse_topk(queries, docs, 5).collect()] == [(1, 4.0)]


def test_settings_fall_through_zero_and_empty(spark):
    rows = spark.createDataFrame([(1, "c", 0, None, "", True, 800, 0, "semantic"), (2, "c", None, 7, None, False, 0, 0, "semantic")], "resource_id long, collection_id string, resource_size int, resource_overlap int, resource_strategy string, has_settings boolean, collection_size int, collection_overlap int, collection_strategy string")
    got = [tuple(r)[2:] for r in store.resolve_settings(rows).orderBy("resource_id").collect()]
    assert got == [(800, 50, "recursive"), (512, 7, "semantic")]


def test_random_rankings_agree_with_sorting(spark):
    random.seed(5)
    rows = [(q, p, random.randint(0, 3) / 2) for q in range(5) for p in range(40)]
    df = spark.createDataFrame(rows, "query_id long, point_id long, score double")
    got = {}
    for r in retrieve.ranked(df, 7).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["point_id"])
    assert got == {q: [p for _, p in sorted((-s, p) for x, p, s in rows if x == q)][:7] for q in range(5)}


def test_shards_of_a_known_total_go_by_checksum(spark):
    import zlib

    rows = spark.createDataFrame([(k,) for k in ("a", "b", "10", "", "é")], "k string")
    got = {r[0]: r[1] for r in rows.select("k", T.shard_of(F.col("k"), 1000, 300)).collect()}
    assert got == {k: zlib.crc32(k.encode()) % 4 for k in got}


@pytest.mark.parametrize("k", [1, 3])
def test_best_of_tiles_are_those_of_a_sort(monkeypatch, k):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(retrieve, "TILE", 3)
    monkeypatch.setattr(retrieve, "CELLS", 21)
    # coarse scores, so that many are equal; some are no candidates
    scores = rng.integers(0, 4, (8, 40)) / 4.0
    scores[rng.random(scores.shape) < 0.2] = -np.inf
    scores[5] = -np.inf
    queries = pd.DataFrame({"query_id": [f"q{n}" for n in range(8)], "n": range(8)})
    points = pd.DataFrame({"point_id": [f"p{n}" for n in rng.permutation(40)], "m": range(40)})
    best = retrieve.Best(queries, k, {"s": lambda q: lambda p: scores[np.ix_(q["n"], p["m"])].copy()})
    best.add(points.iloc[:25])
    best.add(points.iloc[25:])
    frames = list(best.rows())
    assert max(len(f) for f in frames) <= 3 * k
    got = [tuple(r) for f in frames for r in f[["query_id", "score", "point_id"]].itertuples(index=False)]
    want = [(f"q{n}", -s, i) for n in range(8) for s, i in sorted((-scores[n, m], points["point_id"][m]) for m in range(40) if scores[n, m] > -np.inf)[:k]]
    assert got == want


def test_best_points_hold_one_tile_of_scores_at_once():
    rng = np.random.default_rng(3)
    vectors = lambda n, name: pd.DataFrame({name: range(n), "vector": list(rng.normal(size=(n, 8)))})
    queries, points = vectors(2 * retrieve.TILE, "query_id"), vectors(10_000, "point_id")
    best = retrieve.Best(queries, 5, {"dense": retrieve.cosine_scores})
    tracemalloc.start()
    best.add(points)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, best.rows())) == 5 * len(queries)
    # a score has 8 bytes, the mark of a candidate one
    assert most < 1.5 * 8 * retrieve.CELLS < 30e6


def test_encoding_holds_a_slice_of_texts_at_once(spark):
    texts = spark.range(0, 3000, 1, 1).selectExpr("id", "concat('text ', id) as text")
    found = encode.encode(texts, "text", encoder=lambda own: [[float(len(own))] for _ in own], max_items=10**6, max_waste=1.0)
    assert found.count() == 3000
    assert found.selectExpr("max(vector[0])").first()[0] <= encode.SLICE_TEXTS
