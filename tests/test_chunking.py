import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.operators import chunking as C
from tesserae.operators.encode import batches, hash_encoder


def test_fixed_windows(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, "abc"), (3, ""), (4, None)], "id long, text string")
    got = sorted((r["id"], r["chunk_no"], r["chunk"]) for r in C.fixed_windows(df, "text", 4, 1).collect())
    assert got == [(1, 0, "abcd"), (1, 1, "defg"), (1, 2, "ghij"), (2, 0, "abc")]
    with pytest.raises(ValueError):
        C.fixed_windows(df, "text", 4, 4)


def test_sentences(spark):
    texts = ["One. Two!  Three", "", "no end", "...lead. x", "你好。再见！", "a.\n\nb?\t"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = [r[0] for r in df.select(T.sentences(df["t"]), "k").orderBy("k").collect()]
    assert got == [["One.", "Two!", "Three"], [], ["no end"], ["lead.", "x"], ["你好。", "再见！"], ["a.", "b?"]]


def test_sentences_take_about_as_long_as_one_scan(spark):
    # a text of common sentences, and one without a mark
    text, scan = F.explode(F.array(F.repeat(F.lit("Some words of a sentence, and more of them. "), 10_000), F.repeat(F.lit("no mark "), 50_000))), F.lit(r"[^.!?]++(?:[.!?]++|\z)")
    df = spark.range(0, 16, 1, 4).select(text.alias("t")).localCheckpoint()

    def seconds(column):
        start = time.perf_counter()
        assert df.agg(F.sum(F.size(column))).first()[0] >= 16 * 10_000
        return time.perf_counter() - start

    def least(column):
        return min(seconds(column) for _ in range(2))

    assert least(T.sentences(df["t"])) < 4 * least(F.regexp_extract_all("t", scan, F.lit(0))) + 1


@given(st.text("ab .\n", max_size=300), st.integers(2, 40), st.data())
@settings(max_examples=150, deadline=None)
def test_recursive_chunks_hold_all_letters(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    chunks = C.split_recursive(text, size, overlap)
    assert all(len(c) <= size and c == c.strip() and c for c in chunks)
    if overlap == 0:
        assert "".join("".join(chunks).split()) == "".join(text.split())


def test_recursive_golden():
    text = "First paragraph here.\n\nSecond one is a bit longer than that.\nThird line."
    assert C.split_recursive(text, 30, 0) == ["First paragraph here.", "Second one is a bit longer", "than that.", "Third line."]
    assert C.split_recursive("aaaa bbbb cccc", 10, 5) == ["aaaa bbbb", "bbbb cccc"]
    with pytest.raises(ValueError):
        C.split_recursive("x", 5, 5)


def test_semantic_edges():
    assert C.split_semantic("") == [] == C.split_semantic("  \n")
    assert C.split_semantic("one sentence only") == ["one sentence only"]
    same = lambda texts: [[1.0, 0.0]] * len(texts)
    chunks = C.split_semantic("A b c. " * 100, 200, same)
    assert all(len(c) <= 200 for c in chunks) and " ".join(chunks).split() == ("A b c. " * 100).split()


def test_breaks():
    """Directions turn by 5, 60, 5, 70 and 5 degrees; a fifth of the way up five sorted cosines stands that of 60 degrees, itself a break."""
    angles = np.radians(np.cumsum([0, 5, 60, 5, 70, 5]))
    assert C.break_positions(np.stack([np.cos(angles), np.sin(angles)], 1)) == {2, 4}


def test_short_tail_joins_its_neighbour():
    assert C.group_sentences(["x" * 60, "y" * 60, "z"], {1, 2}, 50, 200) == ["x" * 60, "y" * 60 + " z"]
    assert C.group_sentences(["x" * 60, "y"], set(), 50, 60) == ["x" * 60, "y"]


def test_long_semantic_texts_are_split_recursively():
    text = "word. " * 2000
    assert C.split(text, "semantic", 500, 50) == C.split_recursive(text, 500, 50)
    with pytest.raises(ValueError):
        C.split("x", "custom", 10, 1)
    assert C.split("x y", "custom", 10, 1, str.split) == ["x", "y"]


def test_batches_by_fold():
    def slow(lengths):
        order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
        out, now = [0] * len(lengths), []
        number = 0
        for k in order:
            if now:
                area = lengths[now[0]] * (len(now) + 1)
                waste = area - sum(lengths[j] for j in now) - lengths[k]
                if len(now) >= 50 or (area and waste / area > 0.1):
                    number, now = number + 1, []
            now.append(k)
            out[k] = number
        return out

    random.seed(2)
    for _ in range(100):
        lengths = [random.randint(0, 100) for _ in range(random.randint(0, 120))]
        assert batches(lengths) == slow(lengths)
    assert batches([7] * 51).count(0) == 50


def test_hash_encoder_is_unit_length():
    v = hash_encoder(["some words here", ""])
    assert np.isclose((v[0] ** 2).sum(), 1) and not v[1].any()


def test_chunk_documents_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], "id long, text string, extra string")
    got = C.chunk_documents(df, "text", size=10, overlap=0).collect()
    assert [(r["id"], r["extra"], r["chunk_no"], r["chunk"]) for r in got] == [(1, "x", 0, "a b")]
    with pytest.raises(ValueError):
        C.chunk_documents(df, "text", size=5000)
