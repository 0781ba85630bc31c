"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that a Python function handles at once.
SLICE_ROWS = 512


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors for intermediate tables.

    Read from ``spark.checkpoint.dir``; only where that is unset (local tests)
    it is a folder in the warehouse, which is shared too.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tesserae-scratch"
    return path.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/tesserae/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, leaving every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have a null fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def words_of(text: str | None) -> list[bytes]:
    r"""ASCII-lower-cased words ``[^\x20\x09-\x0D]+`` as UTF-8 bytes.

    ``bytes.lower`` changes A-Z alone and ``bytes.split`` cuts at exactly the
    six ASCII white-space bytes.
    """
    return text.encode("utf-8", "replace").lower().split() if text else []


def give_back() -> None:
    """Return freed memory of Arrow and of the C library to the system, where the library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_slices(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: str | StructType,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Apply a batch function in bounded slices; ``make`` runs once per task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))
        # workers serve further stages, whose memory this task's buffers would add to
        batch = step = None
        give_back()

    return df.mapInArrow(run, schema)


class WordCache:
    """Values of recent keys, in two generations of bounded size."""

    def __init__(self, limit: int) -> None:
        self.limit, self.young, self.old = limit, {}, {}

    def fetch(self, keys: set, compute: Callable[[list], Iterable]) -> dict:
        """A mapping that has all ``keys``; ``compute`` gives the values of those unknown."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old, unknown = self.young, self.old, []
        for key in keys - young.keys():
            if (value := old.get(key)) is None:
                unknown.append(key)
            else:
                young[key] = value
        if unknown:
            young.update(zip(unknown, compute(unknown), strict=True))
        return young


def text_groups(texts: Iterable[str | None], chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges [start, end) of about ``chars`` characters, one text at least."""
    start = size = end = 0
    for end, text in enumerate(texts, 1):
        size += len(text or "")
        if size >= chars:
            yield start, end
            start, size = end, 0
    if end > start:
        yield start, end
