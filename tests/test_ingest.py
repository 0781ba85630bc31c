import json

from tesserae.streaming import ingest, messages, settle


def message(**fields):
    return (json.dumps(fields),)


COLLECTIONS = "collection_id string, chunkSize int, chunkOverlap int"


def of(spark, path, name):
    return spark.read.parquet(f"{path}/{name}")


def test_messages_go_to_both_stores_or_to_the_dead_letters(spark, tmp_path):
    text = "One sentence here. " * 30
    ok = dict(resourceId="r1", collectionId="c1", ownerId="o")
    data = [message(event="chunk", data=text, **ok), message(event="chunk", data=text, **{**ok, "collectionId": "c2"}), message(event="chunk", data=" ", **ok), message(event="load", **ok), message(event="load", url="http://a.org", **ok), message(event="sing", **ok), ("not json",), (None,), message(event="delete", collectionId="c1")]
    batch = spark.createDataFrame([(k, *m) for k, m in enumerate(data)], "token long, value string")
    collections, path = spark.createDataFrame([("c1", 200, 20), ("c2", 200, 20)], COLLECTIONS), str(tmp_path)
    for _ in range(2):  # a repeated batch changes nothing
        ingest.work(batch, 3, path, spark.createDataFrame([], "resource_id string"), collections)
    assert sorted(r["reason"] for r in of(spark, path, "failed").collect()) == ["empty content", "no resource", "no url", "nothing fetched", "unknown event", "unknown event", "unknown event"]
    chunks, points = ingest.stores(spark, path)
    assert chunks.count() == points.count() > 2 and {r[0] for r in points.select("collection_id").distinct().collect()} == {"c1", "c2"}
    # the same text in another collection is another point
    ids = {r["point_id"]: r["collection_id"] for r in chunks.collect()}
    assert set(ids.values()) == {"c1", "c2"} and len(ids) <= chunks.count()


def test_point_ids_and_what_is_encoded(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a", None), ("a", ""), ("a", "v"), ("a", "v")], "data string, vs string")
    made = lambda keep: [r[0] for r in rows.select(ingest.point_id(F.col("data"), F.col("vs"), F.lit("c"), F.lit("o"), F.lit(keep))).collect()]
    same, drawn = made(False), made(True)
    assert same[0] == same[1] != same[2] == same[3] and len(set(drawn)) == 4
    assert [r[0] for r in rows.select(ingest.embed_source(F.col("data"), F.col("vs"))).collect()] == ["a", "a", "v", "v"]


MESSAGES = [
    (1, 0, dict(event="chunk", resourceId="a", data="first text of a.")),
    (2, 0, dict(event="chunk", resourceId="b", data="text of b.")),
    (3, 0, dict(event="load", resourceId="a", url="http://a.org")),
    (3, 1, dict(event="delete", resourceId="a")),
    (3, 2, dict(event="chunk", resourceId="a", data="second text of a.")),
    (4, 0, dict(event="load", resourceId="a", url="http://a.org")),
    (5, 0, dict(event="load", resourceId="b", url="http://old.org")),
    (6, 0, dict(event="delete", resourceId="b")),
    (7, 0, dict(event="update", resourceId="c")),
    (8, 0, dict(event="load", resourceId="c", url="http://none.org")),
    (9, 0, dict(event="chunk", resourceId="c", data="text of b.")),
]


def settled_tables(spark, path):
    """All that the stream leaves behind, without the numbers of batches."""
    columns = {"loaded": ["token", "resource_id", "content"], "failed": ["token", "reason", "resource_id"], "statuses": ["token", "ord", "resource_id", "status"], "settled": ["token", "ord", "action", "status", "reason"]}
    out = {n: sorted(map(tuple, of(spark, path, n).select(*c).collect()), key=repr) for n, c in columns.items()}
    documents, points = ingest.stores(spark, path)
    out["documents"] = sorted(map(tuple, documents.select("token", "resource_id", "chunk").collect()))
    out["points"] = sorted(map(tuple, points.select("token", "resource_id", "point_id").collect()))
    return out


def test_the_stream_settles_load_delete_and_chunk_in_order(spark, tmp_path):
    """Over any split into batches and with a restart after each: nothing is lost, nothing doubled."""
    rows = [(t, o, json.dumps(dict(collectionId="c1", ownerId="o", **m))) for t, o, m in MESSAGES]
    resources = spark.createDataFrame([("b", "old content")], "resource_id string, content string")
    fetched = spark.createDataFrame([("http://a.org", "fetched a"), ("http://old.org", "old content")], "url string, content string")
    collections = spark.createDataFrame([("c1", 200, 20)], COLLECTIONS)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = []
    for name, cuts in (("one", [11]), ("three", [2, 4, 11]), ("again", [5, 11])):
        source, path = tmp_path / name / "in", str(tmp_path / name / "out")
        start = 0
        for end in cuts:
            # a message that is delivered twice
            part = rows[max(0, start - 1) if name == "again" else start : end]
            spark.createDataFrame(part, "token long, ord int, value string").coalesce(1).write.mode("append").parquet(str(source))
            stream = spark.readStream.schema("token long, ord int, value string").parquet(str(source))
            ingest.run_stream(stream, path, str(tmp_path / name / "checkpoint"), resources, collections, fetched).awaitTermination(120)
            start = end
        found.append(settled_tables(spark, path))
    one, three, again = found
    assert one == three
    assert one["loaded"] == [(3, "a", "fetched a")]
    assert one["failed"] == [(8, "nothing fetched", "c")]
    assert {(t, o): s for t, o, _, s in one["statuses"]} == {(1, 0): "chunked", (2, 0): "chunked", (3, 0): "loaded", (3, 1): "deleted", (3, 2): "chunked", (4, 0): "chunked", (5, 0): "chunked", (6, 0): "deleted", (8, 0): "error", (9, 0): "chunked"}
    assert len(one["settled"]) == len(MESSAGES)
    # b's text went with b, and stands again for c
    assert one["documents"] == [(3, "a", "second text of a."), (9, "c", "text of b.")]
    assert [p[:2] for p in one["points"]] == [(3, "a"), (9, "c")]
    repeated = [f for f in again["failed"] if f[1] == settle.REPEATED]
    assert len(repeated) == 1 and {**again, "failed": [f for f in again["failed"] if f not in repeated], "settled": [s for s in again["settled"] if s[4] != settle.REPEATED]} == one


def test_a_batch_settles_like_the_stream(spark, tmp_path):
    rows = [(t, o, json.dumps(dict(collectionId="c1", ownerId="o", **m))) for t, o, m in MESSAGES]
    resources = spark.createDataFrame([("b", "old content")], "resource_id string, content string")
    fetched = spark.createDataFrame([("http://a.org", "fetched a"), ("http://old.org", "old content")], "url string, content string")
    found = settle.settle(spark.createDataFrame(rows, "token long, ord int, value string"), fetched, resources)
    assert [(r["token"], r["ord"], r["action"], r["status"], r["reason"]) for r in found.orderBy("token", "ord").collect()] == [
        (1, 0, "save", "chunked", None), (2, 0, "save", "chunked", None), (3, 0, "write", "loaded", None), (3, 1, "delete", "deleted", None), (3, 2, "save", "chunked", None), (4, 0, None, "chunked", None),
        (5, 0, None, "chunked", None), (6, 0, "delete", "deleted", None), (7, 0, None, None, None), (8, 0, None, "error", "nothing fetched"), (9, 0, "save", "chunked", None),
    ]


def test_changes_and_loads_become_messages(spark):
    row = "token long, op string, resource_id string, url string, content string, is_deleted boolean, updated array<string>, collection_id string, owner_id string"
    changes = spark.createDataFrame([(5, "update", "r", "http://a", "x", False, ["url", "content"], "c", "o"), (6, "delete", None, None, None, None, None, None, None)], row)
    made = [(r["token"], r["ord"], json.loads(r["value"])) for r in messages.of_changes(changes).orderBy("ord").collect()]
    whole = dict(resourceId="r", collectionId="c", ownerId="o", url="http://a", data="x")
    assert made == [(5, 0, dict(event="load", **whole)), (5, 1, dict(event="delete", **whole)), (5, 2, dict(event="chunk", **whole))]
    loaded = spark.createDataFrame([(9, "r", "c", "o", "new")], "token long, resource_id string, collection_id string, owner_id string, content string")
    assert [json.loads(r["value"])["event"] for r in messages.of_loads(loaded).orderBy("ord").collect()] == ["delete", "chunk"]


def test_work_settles_every_message(spark, tmp_path):
    text = "One sentence here. " * 30
    resources = spark.createDataFrame([("r1", "same", 200, 20), ("r2", "old", None, None)], "resource_id string, content string, chunkSize int, chunkOverlap int")
    collections = spark.createDataFrame([("c1", 300, 30, "recursive"), ("c2", 100, 0, "custom")], "collection_id string, chunkSize int, chunkOverlap int, strategy string")
    fetched = spark.createDataFrame([("http://a.org", "same"), ("http://b.org", "new")], "url string, content string")

    def custom(content):
        if "bad" in content:
            raise RuntimeError("no answer")
        return ["plain", {"text": "shown", "vectorSource": "encoded", "metadata": {"page": 1}}]

    rows = [
        message(event="load", resourceId="r1", url="http://a.org"),
        message(event="load", resourceId="r2", url="http://b.org"),
        message(event="load", resourceId="r3", url="http://none.org"),
        message(event="chunk", resourceId="r1", collectionId="c1", ownerId="o", data=text),
        message(event="chunk", resourceId="r4", collectionId="c1", ownerId="o", data=text),
        message(event="chunk", resourceId="r5", collectionId="c2", ownerId="o", data="x"),
        message(event="chunk", resourceId="r6", collectionId="c2", ownerId="o", data="bad"),
        message(event="chunk", resourceId="r7", collectionId="nowhere", ownerId="o", data="x"),
        message(event="chunk", resourceId="r8", collectionId="c1", ownerId="o", data=" "),
        message(event="delete", resourceId="r9", collectionId="c1"),
    ]
    batch, path = spark.createDataFrame([(k, *m) for k, m in enumerate(rows)], "token long, value string"), str(tmp_path / "out")
    for _ in range(2):
        ingest.work(batch, 1, path, resources, collections, fetched, custom=custom)
    table = lambda name: spark.read.parquet(f"{path}/{name}")
    assert {(r["resource_id"], r["status"]) for r in table("statuses").collect()} == {
        ("r1", "chunked"), ("r2", "loaded"), ("r3", "error"), ("r4", "chunked"), ("r5", "chunked"), ("r6", "error"), ("r7", "error"), ("r8", "error"), ("r9", "deleted")
    }
    assert {(r["resource_id"], r["reason"]) for r in table("failed").collect()} == {("r3", "nothing fetched"), ("r6", "no answer"), ("r7", "collection not found"), ("r8", "empty content")}
    documents = table("documents").where("error is null").collect()
    longest = {r: max(len(d["chunk"]) for d in documents if d["resource_id"] == r) for r in ("r1", "r4")}
    assert longest["r1"] <= 200 < longest["r4"] <= 300
    shown = [d for d in documents if d["chunk"] == "shown"]
    assert shown[0]["vector_source"] == "encoded" and json.loads(shown[0]["metadata"]) == {"page": 1}
    assert table("vectors").count() == len(documents)


def test_messages_fan_out(spark, tmp_path):
    from tesserae.streaming import sinks

    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    paths = [str(tmp_path / "one"), str(tmp_path / "two")]
    for _ in range(2):
        sinks.fan_out(rows, 4, paths)
    for path in paths:
        assert sorted(r["value"] for r in spark.read.parquet(path).collect()) == ['{"k":1,"v":"a"}', '{"k":2}']
