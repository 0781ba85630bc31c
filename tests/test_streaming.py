import pandas as pd
import pytest
from pyspark.sql import functions as F

from tesserae.operators.feedback import assign_votes
from tesserae.sources import html, tables
from tesserae.streaming import cdc, votes

from .conftest import DATA

ROW = "token long, op string, resource_id long, url string, content string, is_deleted boolean, updated array<string>"


@pytest.mark.parametrize(
    "op, url, content, deleted, updated, expected",
    [
        ("insert", "http://a.b", "x", False, None, ["load"]),
        ("insert", None, "x", False, None, ["chunk"]),
        ("insert", None, None, False, None, []),
        ("update", "http://a.b", "x", False, ["url", "content"], ["load", "delete", "chunk"]),
        ("update", "http://a.b", "x", True, ["refreshedAt", "isDeleted"], ["load", "delete"]),
        ("update", None, "x", False, ["refreshedAt", "isDeleted"], []),
        ("replace", "http://a.b", "x", True, ["url"], []),
    ],
)
def test_rules(spark, op, url, content, deleted, updated, expected):
    df = spark.createDataFrame([(1, op, 5, url, content, deleted, updated)], ROW)
    assert [r["event"] for r in cdc.events(df).orderBy("ord").collect()] == expected


def test_metadata_updates_and_hard_deletes_are_dropped(spark):
    df = spark.createDataFrame([(1, "update", 5, None, "x", False, ["content", "metadata"]), (2, "delete", None, None, None, None, None), (3, "insert", 6, None, "x", False, None)], ROW)
    assert [r["token"] for r in cdc.relevant(df).collect()] == [3]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    changes = tables.changes(spark, DATA).withColumn("url", F.when(F.pmod("token", F.lit(13)) == 0, "no url").otherwise(F.col("url")))
    changes.repartition(5).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    cdc.run_stream(source, str(tmp_path / "events"), str(tmp_path / "failed"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "events")).drop("batch")
    bad = cdc.dead_letters(changes)
    want = cdc.events(changes.join(bad.select("token"), "token", "left_anti"))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert spark.read.parquet(str(tmp_path / "failed")).count() == bad.count() > 0


def test_vote_state_is_the_fold(spark, tmp_path):
    vectors = tables.points(spark, DATA).select(F.col("point_id").alias("query_id"), F.col("owner_id").cast("long").alias("owner_id"), F.col("vector").cast("array<double>").alias("vector"))
    rows = tables.votes(spark, DATA).select("event_id", "query_id").join(vectors, "query_id").select("event_id", "owner_id", "query_id", "vector")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = votes.assign_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("owner_id", "query_id", "feedback_id").distinct().toPandas()
    want = assign_votes(rows).toPandas()
    key = ["owner_id", "query_id"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><p>a &amp; b</p><script>x</script><div>c<br>d</div></body>"
    assert html.html_text(page) == "a & b\nc\nd"
    assert html.html_text(None) == ""
