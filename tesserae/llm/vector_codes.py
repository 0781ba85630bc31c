"""Vector code compression: product codebooks trained in integers, searched by exponion.

A component x counts as floor(256 * x).  A vector is cut into equal parts, and
each part is coded by the nearest entry of its position's codebook.  The search
starts at the entry that the part had before and scans that entry's neighbours by
distance: an entry nearer than the present one, or as near, lies within twice the
part's distance to the present entry (triangle inequality, in squared integers:
four times).  Nothing outside that ball is looked at, and ties go to the lower
index, so the result is that of a full scan.

Every pass maps the vectors where they lie; only sums per codebook entry are
shuffled, a few rows a task, and only codebooks (parts x entries) reach the
driver.  Codes of earlier rounds are found again rather than written and read,
from the codebooks of those rounds.

Rows whose vector is null or has null or infinite components or NaN are left out;
others all come back, in no order.  A vector whose length isn't that of the
codebooks, which is the length of the first kept vector that can be cut, has a
null code and error and trains nothing.  Null ids are coded, and come last where
seeds are chosen; of equal ids the smaller vector comes first.  Components beyond
``SAFE`` are counted in Python integers, exactly; an error, or a label's sum, that
doesn't fit a long is null.  Empty tables give empty results; further columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import materialize

SCALE = 256
#: Up to this size, components, distances of a part and errors of a vector stay in 64 bits.
SAFE = 2**22
#: Sums travel in limbs, so that decimals hold the sum of any number of tasks.
LIMB = 2**90
#: Rows coded at once.
ROWS = 4096
LONG_MAX = 2**63 - 1


@dataclass
class Codebooks:
    """Entries as (part, entry, position), in Python integers or in 64 bits."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        parts, n, width = self.entries.shape
        flat = self.entries
        apart = np.zeros((parts, n, n), flat.dtype)
        for k in range(width):
            d = flat[:, :, None, k] - flat[:, None, :, k]
            apart = apart + d * d
        # nearest first, ties by index
        self.order = np.argsort(apart, axis=2, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 2)

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.reshape(-1)).encode()).hexdigest()

    def large(self) -> bool:
        return any(abs(int(x)) > SAFE for x in self.entries.reshape(-1))

    def nearest(self, vectors: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Entry and squared distance of each part (rows x parts), and how many distances were computed.

        ``start``: the entries that the parts had before, else the first ones.
        """
        parts, n, width = self.entries.shape
        rows = len(vectors)
        x = vectors.reshape(rows * parts, width)
        part = np.tile(np.arange(parts), rows)
        present = np.zeros(rows * parts, np.int64) if start is None else start.reshape(-1).astype(np.int64)

        def distance(at: np.ndarray, entry: np.ndarray) -> np.ndarray:
            d = x[at] - self.entries[part[at], entry]
            return (d * d).sum(1)

        every = np.arange(rows * parts)
        best, least = present.copy(), distance(every, present)
        radius, computed = 4 * least, len(every)
        active = every
        # the list of an entry begins with itself, or with a lower entry equal to it
        for k in range(n):
            inside = self.apart[part[active], present[active], k] <= radius[active]
            active = active[inside.astype(bool)]
            if not len(active):
                break
            entry = self.order[part[active], present[active], k]
            d = distance(active, entry)
            computed += len(active)
            better = (d < least[active]) | ((d == least[active]) & (entry < best[active]))
            took = active[better.astype(bool)]
            best[took], least[took] = entry[better.astype(bool)], d[better.astype(bool)]
        return best.reshape(rows, parts), least.reshape(rows, parts), computed


def chained(books: list[Codebooks], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances by the last codebooks, each search starting where the one before ended."""
    entry = None
    for book in books:
        entry, distance, _ = book.nearest(vectors, entry)
    return entry, distance


def scaled(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length in a list array, and their components as integers."""
    lengths = np.asarray(values.value_lengths())
    starts = np.asarray(values.offsets)[:-1]
    flat = np.asarray(values.values, np.float64)
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        x = flat[(starts[at][:, None] + np.arange(length)).reshape(-1)].reshape(len(at), length)
        if not x.size or np.abs(x).max() * SCALE <= SAFE:
            yield at, np.floor(x * SCALE).astype(np.int64)
        else:
            yield at, np.array([[floor_scaled(v) for v in row] for row in x.tolist()], object).reshape(len(at), length)


def floor_scaled(value: float) -> int:
    """floor(SCALE * value), exact where the product has no double."""
    n, d = value.as_integer_ratio()
    return SCALE * n // d


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has finite components only; an empty one has."""
    odd = F.exists(F.col(vector_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & ~odd)


def limbs_of(value: int, n: int) -> list[Decimal]:
    out = []
    for _ in range(n - 1):
        out.append(Decimal(value % LIMB))
        value //= LIMB
    return [*out, Decimal(value)]


def entry_sums(kept: DataFrame, books: list[Codebooks], n_limbs: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """Number and componentwise sums of the parts that each entry got."""
    parts, _, width = books[-1].entries.shape
    columns = [f"s{k}_{m}" for k in range(width) for m in range(n_limbs)]

    def run(batches):
        counts: dict[tuple[int, int], int] = {}
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                for _, x in scaled(batch.column(0).slice(start, ROWS)):
                    if x.shape[1] != parts * width:
                        continue
                    entry, _ = chained(books, x)
                    cut = x.reshape(len(x), parts, width)
                    for p in range(parts):
                        for e in np.unique(entry[:, p]).tolist():
                            own = cut[entry[:, p] == e, p]
                            key = (p, e)
                            counts[key] = counts.get(key, 0) + len(own)
                            sums[key] = sums.get(key, 0) + own.sum(0).astype(object)
        keys = sorted(counts)
        arrays = [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())]
        split = [[v for s in sums[k] for v in limbs_of(int(s), n_limbs)] for k in keys]
        arrays += [pa.array([row[c] for row in split], pa.decimal128(38, 0)) for c in range(len(columns))]
        yield pa.RecordBatch.from_arrays(arrays, names=["part", "entry", "n", *columns])

    schema = "part int, entry int, n long, " + ", ".join(f"{c} decimal(38, 0)" for c in columns)
    summed = kept.mapInArrow(run, schema).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns])
    out = {}
    for r in summed.collect():
        out[r["part"], r["entry"]] = r["n"], [sum(int(r[f"s{k}_{m}"]) * LIMB**m for m in range(n_limbs)) for k in range(width)]
    return out


def as_array(entries: list) -> np.ndarray:
    """In 64 bits where that is safe, else in Python integers."""
    wide = np.array(entries, object)
    return wide if any(abs(v) > SAFE for v in wide.reshape(-1)) else wide.astype(np.int64)


def train(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> list[Codebooks]:
    """Codebooks at the start and after each round; the last are final.  Empty if no vector can be cut."""
    kept = usable(vectors, vector_col).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    fits = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    order = [F.col("id").asc_nulls_last(), "vector"]
    first = fits.orderBy(*order).limit(1).collect()
    if not first:
        return []
    length = len(first[0]["vector"])
    own = fits.where(F.size("vector") == length)
    # bounded: one vector for each entry of the codebooks
    seeds = [[floor_scaled(v) for v in r["vector"]] for r in own.orderBy(*order).limit(entries).collect()]
    width = length // parts
    books = [Codebooks(as_array([[s[p * width : (p + 1) * width] for s in seeds] for p in range(parts)]))]
    # bits of the largest component and of the number of rows
    n_limbs = 2 if kept.schema["vector"].dataType.elementType.simpleString() == "float" else 13
    for _ in range(rounds):
        sums = entry_sums(own.select("vector"), books, n_limbs)
        last = books[-1].entries.tolist()
        books.append(Codebooks(as_array([[[s // sums[p, e][0] for s in sums[p, e][1]] if (p, e) in sums else entry for e, entry in enumerate(part)] for p, part in enumerate(last)])))
    return books


def coded(vectors: DataFrame, books: list[Codebooks], id_col: str = "vec_id", vector_col: str = "embedding", *others: str) -> DataFrame:
    """(id, others, code, error) of every usable vector."""
    rows = usable(vectors, vector_col).select(F.col(vector_col).alias("_vector"), id_col, *others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]) + ", code string, error long"

    def run(batches):
        length = books[-1].entries.shape[0] * books[-1].entries.shape[2] if books else None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                codes: list = [None] * part.num_rows
                errors: list = [None] * part.num_rows
                for at, x in scaled(part.column(0)):
                    if x.shape[1] != length:
                        continue
                    entry, distance = chained(books, x)
                    for k, e, d in zip(at.tolist(), entry.astype(np.uint8), distance.sum(1).tolist(), strict=True):
                        codes[k], errors[k] = e.tobytes().hex(), d if d <= LONG_MAX else None
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=[*part.schema.names[1:], "code", "error"])

    return rows.mapInArrow(run, schema)


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per usable vector: its code, its error, the error of its label, and the digest of the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index must fit two hex digits")
    books = train(vectors, parts, entries, rounds, id_col, vector_col)
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    found = materialize(coded(named, books, "vec_id", "vector", "label"), "codes")
    total = F.try_sum(F.col("error").cast("decimal(38, 0)"))
    sums = found.groupBy(F.col("label").alias("_label")).agg(total.alias("_total"), F.count_if(F.col("code").isNotNull() & F.col("error").isNull()).alias("_lost"))
    sums = sums.select("_label", F.when(F.col("_lost") == 0, F.expr("try_cast(_total as bigint)")).alias("label_error"))
    out = found.join(sums, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books[-1].digest if books else hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
