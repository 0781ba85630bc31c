"""Codebooks and codes against full scans in plain integers."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import vector_codes

from .test_operators import clash, rows

COLUMNS = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(table, parts, entries, rounds):
    """By full scans over lists of integers; all vectors have one length."""
    kept = sorted((r for r in table if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[vector_codes.floor_scaled(float(np.float32(x))) for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assign():
        out = []
        for c in cut:
            found = [min((sum((a - b) ** 2 for a, b in zip(c[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            out.append(found)
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found, strict=True) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in f) for f in found]
    by_label: dict = {}
    for r, e in zip(kept, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    long = lambda x: x if x < 2**63 else None
    label_error = lambda r: None if any(e >= 2**63 for q, e in zip(kept, errors, strict=True) if q[2] == r[2]) else long(by_label[r[2]])
    return [(r[0], "".join(f"{k:02x}" for _, k in f), long(e), label_error(r), digest) for r, f, e in zip(kept, found, errors, strict=True)]


def some_vectors(n, width, seed, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(7)]
    return [(k * 3 - 50, [float(np.float32(x + rng.gauss(0, spread / 9))) for x in rng.choice(centres)], rng.choice([None, 1, 2])) for k in range(n)]


@pytest.mark.parametrize(("n", "parts", "entries", "rounds"), [(300, 4, 16, 2), (300, 16, 64, 2), (20, 4, 64, 3), (90, 2, 1, 1), (60, 8, 9, 0)])
def test_like_full_scans(spark, n, parts, entries, rounds):
    table = some_vectors(n, 16, n + parts)
    table += [(7000, table[3][1], 1), (7001, None, 1), (7002, [None] + [0.5] * 15, 2), (7003, [float("nan")] * 16, None), (7004, [float("inf")] * 16, 1), (None, table[5][1], 2), (table[9][0], table[9][1], 2), (table[9][0], table[9][1], 2)]
    found = vector_codes.compress(spark.createDataFrame(table, SCHEMA).repartition(5), parts, entries, rounds)
    assert rows(found, *COLUMNS) == sorted(plain(table, parts, entries, rounds), key=repr)


def test_large_components_are_exact(spark):
    """Beyond 64 bits: components, distances and sums; an error that fits no long is null."""
    table = some_vectors(80, 4, 3, 1e4) + [(k, [x * 1e30 for x in v], 5) for k, v, _ in some_vectors(40, 4, 4)] + [(900, [3e38, -3e38, 1e-30, 0.0], 6)]
    found = vector_codes.compress(spark.createDataFrame(table, SCHEMA), 2, 12, 2)
    assert rows(found, *COLUMNS) == sorted(plain(table, 2, 12, 2), key=repr)
    doubles = spark.createDataFrame([(1, [1e300, 2.0], 1), (2, [-1e308, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert vector_codes.compress(doubles, 1, 1, 1).count() == 2


def test_odd_tables(spark):
    table = some_vectors(40, 8, 1)
    mixed = clash(spark.createDataFrame([*table, (500, [1.0, 2.0], 1), (501, [], 1), (502, [1.0] * 7, 1)], SCHEMA), ("id", "vector", "code", "error", "part", "entry", "_label", "_vector"))
    found = vector_codes.compress(mixed, 4, 5)
    assert rows(found.where("vec_id < 500"), *COLUMNS) == sorted(plain(table, 4, 5, 2), key=repr)
    assert rows(found.where("vec_id >= 500"), "vec_id", "code", "error") == [(500, None, None), (501, None, None), (502, None, None)]
    assert vector_codes.compress(mixed.limit(0)).count() == 0
    nothing = vector_codes.compress(spark.createDataFrame([(1, None, 1), (2, [], 2)], SCHEMA))
    assert rows(nothing, "vec_id", "code") == [(2, None)]


def test_search_leaves_most_entries_out():
    """Inside the radius only, and exact: ties go to the lower index."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (3, 64, 4))
    centres[:, 40] = centres[:, 11]
    book = vector_codes.Codebooks(centres)
    own = rng.integers(0, 64, 500)
    x = (centres[:, own].transpose(1, 0, 2) + rng.integers(-60, 60, (500, 3, 4))).reshape(500, 12)
    entry, distance, first = book.nearest(x)
    again, _, computed = book.nearest(x, entry)
    full = ((x.reshape(500, 3, 1, 4) - centres[None]) ** 2).sum(3)
    assert (entry == full.argmin(2)).all() and (distance == full.min(2)).all() and (again == entry).all()
    assert computed < first and computed < 500 * 3 * 64 / 8
