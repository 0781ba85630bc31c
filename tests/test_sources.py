"""Changes with a resume token, captions, and records of runs."""

import pytest
from pyspark.sql import functions as F

from tesserae.operators import records
from tesserae.sources import captions, loaders
from tesserae.streaming import cdc, resume

ROLLING = """WEBVTT
Kind: captions

NOTE made by hand

00:00:00.000 --> 00:00:02.000 align:start
good<00:00:00.500><c> morning</c>

00:00:02.000 --> 00:00:04.000
good morning
and   welcome

00:01:04.000 --> 00:01:06.500
and welcome
to the show
"""
NUMBERED = "1\r\n00:00:01,500 --> 00:00:02,000\r\nsecond\r\nline\r\n\r\n2\r\n00:00:00,500 --> 00:00:01,000\r\nfirst\r\n\r\n3\r\n01:00:00,000 --> 01:00:01,000\r\n\r\n"


def test_captions_become_transcripts(spark):
    files = spark.createDataFrame([(1, ROLLING), (2, NUMBERED), (3, "no cues at all"), (4, None), (5, "")], "k long, body string")
    assert {r["k"]: r["text"] for r in captions.transcripts(files, "k", "body").collect()} == {1: "good morning and welcome to the show", 2: "first second line"}
    found = captions.cues(files, "k", "body").where("k = 2").orderBy("cue").collect()
    assert [(r["begin"], r["end"], r["lines"]) for r in found] == [(1.5, 2.0, ["second", "line"]), (0.5, 1.0, ["first"]), (3600.0, 3601.0, [])]


def test_videos_with_captions_are_loaded(spark):
    url = "https://www.youtube.com/watch?v="
    rows = spark.createDataFrame([(1, url + "a"), (2, url + "b")], "k long, url string")
    files = spark.createDataFrame([(url + "a", NUMBERED), (url + "a", NUMBERED)], "url string, captions string")
    loaded, failed = loaders.load(rows, {"youtube": captions.fetcher(files)})
    assert [(r["k"], r["content"]) for r in loaded.collect()] == [(1, "first second line")]
    assert [(r["k"], r["reason"]) for r in failed.collect()] == [(2, "nothing fetched")]


def test_changes_are_resumed_after_the_last_token(spark, tmp_path):
    """A stop after a batch was written and before its token was: the batch comes again, under its number."""
    table = spark.createDataFrame([(t, f"r{t}") for t in (5, 1, 9, 3, 3, 7, 12, 20)] + [(None, "lost")], "token long, v string")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    sizes = []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        sizes.append((number, batch.count()))

    def stop(batch, number):
        write(batch, number)
        raise RuntimeError("stopped")

    assert resume.run(table, state, write, limit=2, batches=1) == 1
    assert resume.pointer(spark, state) == (0, "3")
    with pytest.raises(RuntimeError):
        resume.run(table, state, stop, limit=2)
    assert resume.pointer(spark, state) == (0, "3")
    assert resume.run(table, state, write, limit=2) == 3
    # both changes of one token stay together
    assert sizes == [(0, 3), (1, 2), (1, 2), (2, 2), (3, 1)]
    assert sorted(r["token"] for r in spark.read.parquet(out).collect()) == [1, 3, 3, 5, 7, 9, 12, 20]
    assert resume.run(table, state, write) == 0
    more = table.unionByName(spark.createDataFrame([(21, "r21")], "token long, v string"))
    assert resume.run(more, state, write) == 1 and sizes[-1] == (4, 1)


def test_events_of_a_change_table_are_those_of_the_batch(spark, tmp_path):
    from tesserae.sources import tables

    from .conftest import DATA

    changes = tables.changes(spark, DATA)
    out = str(tmp_path / "events")
    resume.run(changes, str(tmp_path / "state"), lambda batch, n: cdc.events(batch).write.mode("overwrite").parquet(f"{out}/batch={n}"), limit=300)
    got, want = spark.read.parquet(out).drop("batch"), cdc.events(changes)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_runs_are_timed_and_counted_in_one_reading(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            read.add(len(f))
            yield f

    df = spark.createDataFrame([(k, "word " * k) for k in range(1, 11)], "k long, text string").mapInPandas(seen, "k long, text string")
    counts = records.timed_write(df, str(tmp_path / "t"), None, ["text"], chunks=F.count("*"), characters=F.sum(F.length("text")))
    made = records.encode_record(counts)
    assert read.value == 10 and spark.read.parquet(str(tmp_path / "t")).columns == ["k"]
    assert made["chunks"] == 10 and made["words"] == 55 and made["seconds"] > 0 and made["words_per_second"] > 0
