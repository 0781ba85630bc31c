"""Encoders: a registry of models, and a deterministic hashing encoder as the default.

Real models plug in as functions from a list of texts to a list of vectors.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TERM = re.compile("[a-z]+")
DIM = 64
#: Texts whose terms and vectors a worker holds at once, and terms whose digests it keeps.
SLICE_TEXTS, KEPT_TERMS = 1024, 100_000


@dataclass(frozen=True)
class Model:
    kind: str
    id: str
    name: str
    provider: str
    latency: str


#: The models by kind.
MODELS = [
    Model("dense", "BAAI/bge-small-en-v1.5", "BAAI BGE Small EN v1.5", "Hosted", "Low"),
    Model("dense", "BAAI/bge-large-en-v1.5", "BAAI BGE Large EN v1.5", "Hosted", "Medium"),
    Model("dense", "sentence-transformers/all-MiniLM-L6-v2", "Sentence Transformers MiniLM L6 v2", "Hosted", "Low"),
    Model("dense", "intfloat/multilingual-e5-large", "Intfloat Multilingual E5 Large", "Hosted", "Medium"),
    Model("dense", "jinaai/jina-embeddings-v2-base-code", "Jina Embeddings v2 Base Code", "Hosted", "Low"),
    Model("dense", "text-embedding-3-small", "OpenAI Text Embedding 3 Small", "OpenAI", "Low"),
    Model("dense", "text-embedding-3-large", "OpenAI Text Embedding 3 Large", "OpenAI", "Low"),
    Model("sparse", "prithivida/Splade_PP_en_v1", "Splade PP EN V1", "Hosted", "Low"),
    Model("sparse", "Qdrant/bm25", "BM25", "Hosted", "Low"),
    Model("reranker", "colbert-ir/colbertv2.0", "Colbert v2.0", "Hosted", "Low"),
    Model("reranker", "jinaai/jina-colbert-v2", "Jinaai Colbert v2.0", "Hosted", "Low"),
    Model("reranker", "answerdotai/answerai-colbert-small-v1", "Answerai Colbert Small v1", "Hosted", "Low"),
]


def registry(spark: SparkSession) -> DataFrame:
    rows = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (m.kind, m.id, m.name, m.provider, m.latency)) + ")" for m in MODELS)
    return spark.sql(f"select * from values {rows} as t(kind, model_id, name, provider, latency)")


def check_model(kind: str, model: str) -> None:
    if not any(m.kind == kind and m.id == model for m in MODELS):
        raise ValueError(f"unknown {kind} model: {model}")


def lowered(text: Column) -> Column:
    """In small letters, one for each: a dotted capital I is an i without a mark of its own."""
    return F.lower(F.translate(text, "İ", "i"))


def has_terms(text: Column) -> Column:
    # besides A-Z, a dotted capital I and the sign for Kelvin have small letters of a-z
    return F.coalesce(text.rlike("[A-Za-z\u0130\u212a]"), F.lit(False))


def terms(text: str | None) -> Counter:
    return Counter(TERM.findall((text or "").replace("İ", "i").lower()))


class HashedTerms(dict):
    """Dimension and sign of a term from its digest."""

    def __missing__(self, term: str) -> tuple[int, int]:
        if len(self) > KEPT_TERMS:
            self.clear()
        h = int(hashlib.md5(term.encode()).hexdigest()[:8], 16)
        value = self[term] = (h % DIM, 1 - 2 * (h // DIM % 2))
        return value


_hashed = HashedTerms()


def hash_vector(counts: Counter) -> np.ndarray:
    v = np.zeros(DIM)
    for term, n in counts.items():
        at, sign = _hashed[term]
        v[at] += sign * n
    length = np.sqrt((v * v).sum())
    return v / length if length else v


def hash_encoder(texts: list[str]) -> list[np.ndarray]:
    return [hash_vector(terms(t)) for t in texts]


#: Dimensions of a late-interaction vector.
TOKEN_DIM = 16


class TokenVectors(dict):
    """Unit vector of a term from the bytes of its digest."""

    def __missing__(self, term: str) -> list[float]:
        if len(self) > KEPT_TERMS:
            self.clear()
        v = np.frombuffer(hashlib.md5(term.encode()).digest(), np.uint8) - 127.5
        value = self[term] = (v / np.sqrt((v * v).sum())).tolist()
        return value


_token_vectors = TokenVectors()


def sparse_encoder(texts: list[str]) -> list[dict[str, float]]:
    """Counts of terms."""
    return [{t: float(n) for t, n in terms(text).items()} for text in texts]


def token_encoder(texts: list[str]) -> list[list[list[float]]]:
    """A vector for each distinct term, in order."""
    return [[_token_vectors[t] for t in terms(text)] for text in texts]


#: What stands in for a model of each kind where none is plugged in.
DEFAULTS = {"dense": hash_encoder, "sparse": sparse_encoder, "reranker": token_encoder}
KINDS = {"dense": ("vector", pa.list_(pa.float64()), "array<double>"), "sparse": ("sparse", pa.map_(pa.string(), pa.float64()), "map<string, double>"), "reranker": ("tokens", pa.list_(pa.list_(pa.float64())), "array<array<double>>")}


class Encoders:
    """Encoders by kind and model name; each is made once in a worker, when it is first asked for.

    ``factories`` gives a function that makes the encoder of (kind, model), for
    instance one that loads a model's file.  Other names get the defaults; no
    name, or an empty one, gets a dense encoder and neither of the others.
    """

    _made: dict = {}

    def __init__(self, factories: dict[tuple[str, str], Callable[[], Callable[[list[str]], list]]] | None = None) -> None:
        self.factories = factories or {}

    def get(self, kind: str, model: str | None) -> Callable[[list[str]], list] | None:
        if not model and kind != "dense":
            return None
        factory = self.factories.get((kind, model))
        if factory is None:
            return DEFAULTS[kind]
        if (kind, model) not in self._made:
            self._made[kind, model] = factory()
        return self._made[kind, model]


def in_batches(texts: list[str], encoder: Callable[[list[str]], list], max_items: int = 50, max_waste: float = 0.10) -> list:
    """What the encoder makes of each text; it gets texts of similar length together."""
    out: list = [None] * len(texts)
    groups: dict[int, list[int]] = {}
    for k, b in enumerate(batches([len(t) for t in texts], max_items, max_waste)):
        groups.setdefault(b, []).append(k)
    for members in groups.values():
        for k, v in zip(members, encoder([texts[k] for k in members]), strict=True):
            out[k] = v
    return out


def encode_kinds(df: DataFrame, text_col: str, dense: Column | str | None = None, sparse: Column | str | None = None, reranker: Column | str | None = None, encoders: Encoders | None = None, only: str | None = None) -> DataFrame:
    """Adds ``vector``, ``sparse`` (term to weight) and ``tokens`` (a vector a token) in one pass over the texts.

    ``dense``, ``sparse`` and ``reranker`` are names of models, or columns of them
    for rows of different collections; kinds without one are null, and so are
    all but kind ``only``.  A null text counts as empty.
    """
    encoders = encoders or Encoders()
    given = {"dense": dense, "sparse": sparse, "reranker": reranker}
    named = df.withColumns({f"_{kind}": (m if isinstance(m, Column) else F.lit(m)).cast("string") for kind, m in given.items()})
    at = df.columns.index(text_col)
    n = len(df.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", " + ", ".join(f"{name} {sql}" for name, _, sql in KINDS.values())

    def run(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, SLICE_TEXTS):
                part = batch.slice(start, SLICE_TEXTS)
                texts = [t or "" for t in part.column(at).to_pylist()]
                made = []
                for place, (kind, (_, arrow, _)) in enumerate(KINDS.items()):
                    values: list = [None] * len(texts)
                    of_model: dict = {}
                    for k, model in enumerate(part.column(n + place).to_pylist()):
                        of_model.setdefault(model, []).append(k)
                    for model, members in of_model.items():
                        encoder = encoders.get(kind, model) if only in (None, kind) else None
                        for k, v in zip(members, in_batches([texts[k] for k in members], encoder) if encoder else (), strict=encoder is not None):
                            values[k] = list(v.items()) if kind == "sparse" else [[float(x) for x in row] for row in v] if kind == "reranker" else np.asarray(v, float)
                    made.append(pa.array(values, arrow))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=[*part.schema.names[:n], *[name for name, _, _ in KINDS.values()]])

    return named.mapInArrow(run, schema)


def batches(lengths: list[int], max_items: int = 50, max_waste: float = 0.10) -> list[int]:
    """Batch number of each text; texts longest first, a new batch at max_items or too much padding."""
    order = sorted(range(len(lengths)), key=lambda k: (-lengths[k], k))
    out, number, count, total, longest = [0] * len(lengths), -1, 0, 0, 0
    for k in order:
        n = lengths[k]
        area = longest * (count + 1)
        if number < 0 or count >= max_items or (area > 0 and (area - total - n) / area > max_waste):
            number, count, total, longest = number + 1, 0, 0, n
        out[k], count, total = number, count + 1, total + n
    return out


def encode(df: DataFrame, text_col: str, out_col: str = "vector", encoder: Callable[[list[str]], list] = hash_encoder, max_items: int = 50, max_waste: float = 0.10) -> DataFrame:
    """Add vectors; texts go to the encoder in batches of similar length, results keep their rows.

    A service that takes a plain number of texts at once gets it as ``max_items`` with a ``max_waste`` of 1.
    """
    at = df.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out_col}` array<double>"

    def run(stream):
        for batch in stream:
            for start in range(0, batch.num_rows, SLICE_TEXTS):
                part = batch.slice(start, SLICE_TEXTS)
                texts = [t or "" for t in part.column(at).to_pylist()]
                vectors = [np.asarray(v, float) for v in in_batches(texts, encoder, max_items, max_waste)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*part.schema.names, out_col])

    return df.mapInArrow(run, schema)


def term_frequencies(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): lower-cased runs of a-z."""
    words = F.regexp_extract_all(lowered(F.col(text_col)), F.lit("[a-z]+"), F.lit(0))
    return df.select(F.col(id_col), F.explode(words).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def sparse_arrays(weights: Column) -> Column:
    """A map from index to weight as parallel arrays, indices ascending."""
    entries = F.array_sort(F.map_entries(weights))
    return F.struct(F.transform(entries, lambda e: e["key"]).alias("indices"), F.transform(entries, lambda e: e["value"]).alias("values"))
