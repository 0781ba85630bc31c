import pytest
from pyspark.sql import functions as F

from tesserae.api import Engine, NotFound
from tesserae.operators.encode import encode, encode_kinds
from tesserae.operators.retrieve import token_vectors


@pytest.fixture
def engine(spark):
    texts = [(1, "c", "public", 10, "red apples and green pears"), (2, "c", "public", 11, "stock prices fell on monday"), (3, "c", "me", 12, "red apples"), (4, "d", "public", 13, "red apples")]
    points = encode(spark.createDataFrame(texts, "point_id long, collection_id string, owner_id string, resource_id long, text string"), "text").withColumn("tokens", token_vectors(F.col("vector")))
    resources = spark.createDataFrame([(10, "c", "public", "x", False), (11, "c", "public", "y", False), (12, "c", "me", "z", False)], "resource_id long, collection_id string, owner_id string, content string, is_deleted boolean")
    collections = spark.createDataFrame([("c", "C", 1000)], "collection_id string, name string, chunkSize int")
    cases = spark.createDataFrame([(1, "c", "public", [1]), (2, "c", "public", [9])], "query_id long, collection_id string, owner_id string, expected array<long>")
    return Engine(spark, collections, resources, points, cases=cases)


@pytest.fixture
def queries(spark):
    q = encode(spark.createDataFrame([(1, "green apples"), (2, "prices on monday")], "query_id long, text string"), "text")
    return q.withColumn("tokens", token_vectors(F.col("vector")))


def test_search_stays_within_tenant(engine, queries):
    got = engine.search(queries, "c").collect()
    assert {r["point_id"] for r in got} == {1, 2}
    assert {r["query_id"]: r["point_id"] for r in got if r["rank"] == 1} == {1: 1, 2: 2}
    assert {r["point_id"] for r in engine.search(queries, "c", resource_id=11).collect()} == {2}


def test_evaluation(engine, queries):
    summary, judged, failed = engine.evaluate(queries, "c")
    assert tuple(summary.first())[3:] == (2, 1)
    assert judged.count() == 2 and [r["query_id"] for r in failed.collect()] == [2]


def test_entities(engine, spark):
    assert engine.collection("c").first()["name"] == "C"
    with pytest.raises(NotFound):
        engine.collection("nope")
    engine.update_collection(spark.createDataFrame([("c", 500, "other")], "collection_id string, chunkSize int, denseModel string"))
    assert tuple(engine.collection("c").first()) == ("c", "C", 500)
    assert engine.collection_resources("c", "me").columns == ["resource_id", "collection_id", "owner_id", "is_deleted"]
    engine.delete_resource(spark.createDataFrame([(11,)], "resource_id long"))
    assert engine.resource(11).first()["is_deleted"] and engine.resource_chunks(11).isEmpty()
    assert engine.collection_resources("c").count() == 2
    with pytest.raises(ValueError):
        engine.add_collection(spark.createDataFrame([("e", "E", "no-model")], "collection_id string, name string, denseModel string"))
    assert engine.models().count() == 12


def test_checks_and_updates(engine, spark):
    for fault in [(5000, "recursive"), (500, "custom")]:
        with pytest.raises(ValueError):
            engine.add_collection(spark.createDataFrame([("e", *fault)], "collection_id string, chunkSize int, strategy string"))
    new = spark.createDataFrame([(10, None)], "resource_id long, content string")
    engine.update_resource(new)
    assert engine.resource(10).first()["content"] == "x"
    engine.update_resource(new, as_given=["content"])
    assert engine.resource(10).first()["content"] is None and engine.resource(11).first()["content"] == "y"
    with pytest.raises(NotFound):
        engine.update_resource(spark.createDataFrame([(99, "q")], "resource_id long, content string"))
    engine.update_cases(spark.createDataFrame([(2, [2])], "query_id long, expected array<long>"))
    assert [r["expected"] for r in engine.cases.orderBy("query_id").collect()] == [[1], [2]]


def test_votes_move_a_search(engine, queries, spark):
    asked = queries.select(F.col("query_id").alias("point_id"), "vector")
    engine.vote(spark.createDataFrame([(1, 2, 1)] * 50, "query_id long, chunk_id long, delta int"))
    first = lambda **how: {r["query_id"]: r["point_id"] for r in engine.search(queries, "c", **how).collect() if r["rank"] == 1}
    assert first() == {1: 1, 2: 2} and first(asked=asked)[1] == 2


def test_links_become_votes(spark):
    from datetime import datetime

    from tesserae.operators import feedback

    found = spark.createDataFrame([(1, 7)], "query_id long, point_id long")
    linked = feedback.review_links(found, "http://h", F.lit("k"))
    assert tuple(linked.select("upvote_url", "downvote_url").first()) == ("http://h/feedback/vote/k/upvote", "http://h/feedback/vote/k/downvote")
    contexts = linked.withColumn("made_at", F.lit(datetime(2024, 1, 1)))
    clicks = spark.createDataFrame([("k", "upvote", datetime(2024, 1, 1, 5)), ("k", "downvote", datetime(2024, 1, 3)), ("x", "upvote", datetime(2024, 1, 1)), ("k", "sing", datetime(2024, 1, 1))], "feedback_id string, action string, at timestamp")
    votes, failed = feedback.votes_by_link(clicks, contexts)
    assert [tuple(r) for r in votes.collect()] == [(1, 7, 1)]
    assert sorted(r["reason"] for r in failed.collect()) == ["link expired", "link expired", "unknown action"]


def test_several_updates_of_one_id_leave_one_row(engine, spark):
    new = spark.createDataFrame([(1, 10, "first", None), (3, 10, "third", None), (2, 10, "second", "other")], "n int, resource_id long, content string, owner_id string")
    from tesserae.operators import store

    table = store.update_by_id(engine.resources, new, "resource_id", order="n")
    assert table.count() == 3 and tuple(table.where("resource_id = 10").select("content", "owner_id").first()) == ("third", "other")
    engine.update_resource(new.coalesce(1).drop("n"))
    assert engine.resources.count() == 3 and engine.resource(10).first()["content"] == "second"
    engine.replace_metadata(spark.createDataFrame([(10, "a"), (10, "b")], "resource_id long, metadata string").coalesce(1))
    engine.replace_metadata(spark.createDataFrame([(10, None), (11, "c")], "resource_id long, metadata string").coalesce(1))
    assert {r["resource_id"]: r["metadata"] for r in engine.resources.collect()} == {10: None, 11: "c", 12: None}


def test_updates_of_settings_are_checked(engine, spark):
    with pytest.raises(ValueError, match="overlap"):
        engine.update_collection(spark.createDataFrame([("c", 1000)], "collection_id string, chunkOverlap int"))
    assert tuple(engine.collection("c").first()) == ("c", "C", 1000)
    engine.update_collection(spark.createDataFrame([("c", 100)], "collection_id string, chunkOverlap int"))
    assert tuple(engine.collection("c").first()) == ("c", "C", 1000, 100)


def test_what_was_ingested_can_be_searched_voted_and_evaluated(spark, tmp_path):
    """Point ids are texts here, as the library makes them."""
    import json

    from tesserae.operators.feedback import review_links

    texts = {"r1": "red apples and green pears.", "r2": "stock prices fell on monday.", "r3": "green apples."}
    rows = [(k, json.dumps(dict(event="chunk", resourceId=r, collectionId="c", ownerId="public", data=t))) for k, (r, t) in enumerate(texts.items())]
    rows += [(8, json.dumps(dict(event="load", resourceId="r2", url="http://a.org"))), (9, json.dumps(dict(event="delete", resourceId="r3", collectionId="c")))]
    resources = spark.createDataFrame([(r, "c", "public", t, False) for r, t in texts.items()], "resource_id string, collection_id string, owner_id string, content string, is_deleted boolean")
    models = dict(sparseModel="Qdrant/bm25", rerankerModel="colbert-ir/colbertv2.0")
    engine = Engine(spark, spark.createDataFrame([("c", "C", *models.values())], "collection_id string, name string, sparseModel string, rerankerModel string"), resources, None)
    failed = engine.ingest(spark.createDataFrame(rows, "token long, value string"), 0, str(tmp_path), spark.createDataFrame([("http://a.org", "new text")], "url string, content string"))
    assert failed.isEmpty() and engine.resource("r2").first()["content"] == "new text"
    points = {r["resource_id"]: r["point_id"] for r in engine.points.collect()}
    assert set(points) == {"r1", "r2"} and all(isinstance(p, str) for p in points.values())

    asked = encode_kinds(spark.createDataFrame([("q1", "green apples"), ("q2", "prices on monday")], "query_id string, text string"), "text", None, *models.values())
    first = lambda: {r["query_id"]: r["point_id"] for r in engine.search(asked, "c").collect() if r["rank"] == 1}
    assert first() == {"q1": points["r1"], "q2": points["r2"]}
    engine.cases = spark.createDataFrame([("q1", "c", "public", [points["r1"]]), ("q2", "c", "public", ["none"])], "query_id string, collection_id string, owner_id string, expected array<string>")
    summary, judged, missed = engine.evaluate(asked, "c")
    assert tuple(summary.first())[3:] == (2, 1) and [r["query_id"] for r in missed.collect()] == ["q2"]
    run = engine.runs.first()
    assert run["collection_id"] == "c" and run["total_cases"] == 2 and [r["is_hit"] for r in run["results"]] == [True, False]

    linked = review_links(spark.createDataFrame([("q1", points["r2"])], "query_id string, point_id string"), "http://h", F.lit("k")).withColumn("made_at", F.current_timestamp())
    clicks = spark.createDataFrame([("k", "upvote")] * 60 + [("gone", "upvote")], "feedback_id string, action string").withColumn("at", F.current_timestamp())
    assert engine.vote_by_link(clicks, linked).count() == 1
    engine.asked = asked.where("query_id = 'q1'").select(F.col("query_id").alias("point_id"), "vector", F.lit("c").alias("collection_id"), F.lit("public").alias("owner_id"))
    assert first()["q1"] == points["r2"]


def test_new_and_changed_resources_are_checked(engine, spark):
    kind = "resource_id long, collection_id string, url string, chunkSize int"
    engine.add_resource(spark.createDataFrame([(20, "c", "http://a.org/x", None)], kind))
    row = engine.resource(20).first()
    assert (row["owner_id"], row["is_deleted"]) == ("public", False)
    for bad, fault in [((21, None, None, None), "no collection"), ((21, "c", "nowhere", None), "not a url"), ((21, "c", None, 5000), "size")]:
        with pytest.raises(ValueError, match=fault):
            engine.add_resource(spark.createDataFrame([bad], kind))
    with pytest.raises(ValueError, match="not a url"):
        engine.update_resource(spark.createDataFrame([(10, "nowhere")], "resource_id long, url string"))
    engine.update_resource(spark.createDataFrame([(10, "new", "thief")], "resource_id long, content string, owner_id string"))
    assert tuple(engine.resource(10).select("content", "owner_id").first()) == ("new", "public")


def test_chunks_and_collections_change_and_go(engine, spark):
    engine.update_chunk(spark.createDataFrame([(1, "blue plums", "d")], "point_id long, text string, collection_id string"))
    assert tuple(engine.chunk_by_id(1).select("text", "collection_id").first()) == ("blue plums", "c")
    engine.delete_chunk(spark.createDataFrame([(1,), (99,)], "point_id long"))
    assert engine.points.count() == 3 and engine.chunk_by_id(1).isEmpty()
    engine.delete_collection(spark.createDataFrame([("c",)], "collection_id string"))
    with pytest.raises(NotFound):
        engine.collection("c")


def test_searches_go_on_record(engine, queries, spark, tmp_path):
    plain = sorted(map(tuple, engine.search(queries, "c").collect()))
    assert sorted(map(tuple, engine.search(queries, "c", analytics=str(tmp_path)).collect())) == plain
    engine.search(queries, "c", limit=1, analytics=str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/searches").collect()
    assert len(found) == 4 and len({r["record_id"] for r in found}) == 4
    assert sorted((r["query_id"], r["text"], len(r["scores"])) for r in found) == [(1, "green apples", 1), (1, "green apples", 2), (2, "prices on monday", 1), (2, "prices on monday", 2)]
    assert all(r["rt"] > 0 and r["ts"] > 0 and (r["collection_id"], r["owner_id"]) == ("c", "public") for r in found)
