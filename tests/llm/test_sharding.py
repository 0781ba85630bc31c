"""Shards against a plain search over every capacity."""

import random
import zlib

import pytest

from tesserae.llm import sharding

from .test_operators import EDGES, clash, rows

COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def greedy(sizes, capacity):
    """Shards that a greedy filling takes."""
    n, held = 1, 0
    for s in sizes:
        if held + s > capacity:
            n, held = n + 1, 0
        held += s
    return n


def plain_capacity(sizes, shards):
    capacity = max(sizes)
    while greedy(sizes, capacity) > shards:
        capacity += 1
    return capacity


def groups(table):
    """Sizes of the groups of equal texts by their smallest id; null ids last."""
    found: dict = {}
    for doc_id, text in table:
        found.setdefault(text, []).append(doc_id)
    first = lambda t: min((i for i in found[t] if i is not None), default=None)
    return [(t, len(found[t]) * (len((t or "").encode()) + 1)) for t in sorted(found, key=lambda t: (first(t) is None, first(t) or 0))]


def held(spark, table, shards, parts=5):
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(parts)
    found = sharding.shard(docs, shards).collect()
    texts = {}
    for doc_id, text in table:
        texts.setdefault(zlib.crc32((text or "").encode()), text)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in table)
    by_shard: dict = {}
    place: dict = {}
    for r in found:
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        by_shard.setdefault(r["shard"], []).append(r)
        place.setdefault(texts[r["text_crc32"]], set()).add(r["shard"])
    for own in by_shard.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    # nulls and empty texts are two groups with one checksum
    whole = [t for t, _ in groups(table) if t]
    assert all(len(place[t]) == 1 for t in whole)
    order = [next(iter(place[t])) for t in whole]
    assert order == sorted(order), "shards are consecutive groups"
    return {k: sum(r["size"] for r in v) for k, v in by_shard.items()}


@pytest.mark.parametrize(("n", "longest", "shards", "tried"), [(200, 40, 8, 64), (200, 400, 8, 3), (30, 5000, 8, 1), (5, 90, 8, 64), (90, 60, 1, 64), (64, 9, 13, 5)])
def test_largest_shard_is_as_small_as_can_be(spark, monkeypatch, n, longest, shards, tried):
    monkeypatch.setattr(sharding.smallest_capacity, "__defaults__", (tried,))
    rng = random.Random(n + longest)
    texts = ["é" * rng.randint(0, longest) + str(rng.randint(0, n // 2)) for _ in range(n)]
    table = list(enumerate(texts))
    found = held(spark, table, shards)
    sizes = [s for _, s in groups(table)]
    assert max(found.values()) <= plain_capacity(sizes, shards)
    assert len(found) == min(shards, len(sizes))
    if max(sizes) * shards < sum(sizes):
        assert min(found.values()) >= sum(sizes) / shards - 2 * max(sizes)


def test_a_text_that_a_third_of_all_rows_have(spark):
    """Its group fills a shard of its own; the others share the rest."""
    rng = random.Random(1)
    table = [(k, "copied text" if k % 3 == 1 else "".join(rng.choices("abcdef ", k=30))) for k in range(900)]
    found = held(spark, table, 8)
    hot = 300 * 12
    assert max(found.values()) == plain_capacity([s for _, s in groups(table)], 8) <= hot + 62
    assert sorted(found.values())[-2] < 0.25 * sum(found.values()) and len(found) == 8


def test_nulls_repeats_and_odd_columns(spark):
    table = [*EDGES, (None, ""), (None, None), (2, None), (2, None)]
    found = held(spark, [r for r in table if r[0] is not None], 3, 2)
    assert sum(found.values()) == sum(len((t or "").encode()) + 1 for i, t in table if i is not None)
    docs = clash(spark.createDataFrame(table, "doc_id long, text string"), ("size", "digest", "place", "start", "end", "shard", "slot", "_part", "_at", "first_id"))
    out = sharding.shard(docs)
    assert out.columns == COLUMNS and out.count() == len(table)
    nulls = {r for r in rows(out.where("size = 1"), "text_crc32")}
    assert nulls == {(0,)}
    assert sharding.shard(docs.limit(0)).count() == 0
    assert rows(sharding.shard(docs.limit(1).select("doc_id", "text")), *COLUMNS) == [(1, 1, 0, "bytes", 0, 0, None)]


def test_main_path_is_native(spark):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    plan = sharding.shard(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
