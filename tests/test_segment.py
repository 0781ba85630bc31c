"""Sentence ends, encoding of three kinds, and review links as a stream."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import chunking, encode, feedback, segment
from tesserae.streaming import reviews


@pytest.mark.parametrize(
    "text, want",
    [
        ("", []),
        (" \n\t ", []),
        ("One line without an end", ["One line without an end"]),
        ("It rains. Really? Yes! Fine", ["It rains.", "Really?", "Yes!", "Fine"]),
        ("It costs 3.50 today. Version 2.1.3 is out.", ["It costs 3.50 today.", "Version 2.1.3 is out."]),
        ("They met at the U.S. embassy. It was late.", ["They met at the U.S. embassy.", "It was late."]),
        ("We saw the U.S.A. Then we left.", ["We saw the U.S.A.", "Then we left."]),
        ("Dr. Who came by.", ["Dr.", "Who came by."]),
        ("See fig. 3 below, e.g. there. (etc. and so on) End.", ["See fig. 3 below, e.g. there. (etc. and so on) End."]),
        ('He said "Stop." and left. "Why?" she asked.', ['He said "Stop." and left.', '"Why?"', "she asked."]),
        ("Wait... what?! No!!! 'Done.' Next", ["Wait... what?!", "No!!!", "'Done.'", "Next"]),
        ("Well., so it goes!, he said.", ["Well., so it goes!, he said."]),
        ("First line\nsecond line\r\nthird fourth", ["First line", "second line", "third", "fourth"]),
        ("Ends here.\nStarts here", ["Ends here.", "Starts here"]),
        ("今日は晴れです。明日は雨ですか？はい！", ["今日は晴れです。", "明日は雨ですか？", "はい！"]),
        ("هل تسمع؟ نعم.", ["هل تسمع؟", "نعم."]),
        ("if (a.b == c.d) { return e.f(); }", ["if (a.b == c.d) { return e.f(); }"]),
        ("Un. Été. 2 Ça.", ["Un.", "Été.", "2 Ça."]),
        ("A stop.́ Next. ​Then", ["A stop.́", "Next. ​", "Then"]),
        ("word " * 300, [("word " * 300).strip()]),
    ],
)
def test_sentences(text, want):
    assert segment.sentences(text) == want
    ends = segment.boundaries(text)
    assert ends == sorted(set(ends)) and ends[-1] == len(text)


def test_sentences_of_a_table(spark):
    df = spark.createDataFrame([(1, "One. Two."), (2, None), (3, "")], "sentences_ long, text string")
    assert [tuple(r) for r in segment.with_sentences(df, "text").orderBy("sentences_").select("sentences").collect()] == [(["One.", "Two."],), (None,), ([],)]


def test_the_semantic_chunker_takes_them():
    text = "It costs 3.50 today. They met at the U.S. embassy."
    assert chunking.split_sentences(text, 1000) == segment.sentences(text)
    assert chunking.split_sentences(text, 1000, chunking.sentences_by_marks) == ["It costs 3.", "50 today.", "They met at the U.", "S.", "embassy."]
    assert max(map(len, chunking.split_sentences("long words " * 100 + ".", 100))) <= 25


def test_three_kinds_in_one_pass(spark):
    rows = [(1, "red apples red", None, None, None), (2, "green", "own", "s", None), (3, None, "own", "s", "r"), (4, "apples", "own", None, "r")]
    df = spark.createDataFrame(rows, "k long, text string, d string, s string, r string")
    loads = spark.sparkContext.accumulator(0)

    def own():
        loads.add(1)
        return lambda texts: [[float(len(t))] for t in texts]

    out = encode.encode_kinds(df.coalesce(1), "text", F.col("d"), F.col("s"), F.col("r"), encode.Encoders({("dense", "own"): own}))
    assert out.columns == ["k", "text", "d", "s", "r", "vector", "sparse", "tokens"]
    got = {r["k"]: r for r in out.collect()}
    assert got[1]["vector"] == pytest.approx(encode.hash_encoder(["red apples red"])[0]) and got[1]["sparse"] is None and got[1]["tokens"] is None
    assert got[2]["vector"] == [5.0] and got[2]["sparse"] == {"green": 1.0}
    assert got[3]["vector"] == [0.0] and got[3]["sparse"] == {} and got[3]["tokens"] == []
    assert len(got[4]["tokens"]) == 1 and np.linalg.norm(got[4]["tokens"][0]) == pytest.approx(1)
    assert loads.value == 1


def test_links_as_a_stream_are_those_of_a_batch(spark, tmp_path):
    day = datetime(2024, 1, 1)
    contexts = spark.createDataFrame([(f"k{n}", n, f"c{n}", day + timedelta(hours=n)) for n in range(6)], "feedback_id string, query_id long, point_id string, made_at timestamp")
    clicked = [("k0", "upvote", 1), ("k0", "downvote", 24), ("k0", "upvote", 25), ("k1", "sing", 3), ("k2", "downvote", 2), ("none", "upvote", 3), ("k3", "upvote", 26), ("k5", "upvote", 30)]
    clicks = spark.createDataFrame([(k, a, day + timedelta(hours=h)) for k, a, h in clicked], "feedback_id string, action string, at timestamp")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = {"contexts": contexts, "clicks": clicks}
    for part in ("hour < 20", "hour >= 20"):
        for name, df in source.items():
            at = "made_at" if name == "contexts" else "at"
            df.withColumn("hour", (F.unix_timestamp(at) - F.unix_timestamp(F.lit(day))) / 3600).where(part).drop("hour").coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = {name: spark.readStream.schema(df.schema).parquet(str(tmp_path / name)) for name, df in source.items()}
        out = reviews.votes_by_link_stream(streams["clicks"], streams["contexts"])
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out"))
    votes, failed = feedback.votes_by_link(clicks, contexts)
    held = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    assert held(got.where("reason is null"), "query_id", "chunk_id", "delta") == held(votes, "query_id", "chunk_id", "delta")
    assert held(got.where("reason is not null"), "feedback_id", "action", "at", "reason") == held(failed, "feedback_id", "action", "at", "reason")
