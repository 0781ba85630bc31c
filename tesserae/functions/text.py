"""Text and identifier expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Marks that end a sentence.
ENDS = ".!?。！？؟"
SENTENCE = rf"[^{ENDS}]++[{ENDS}]++\s*"
#: The same with white space of ASCII only, and white space of any kind.
CLOSED = re.compile(SENTENCE, re.ASCII)
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Texts held as Python's at once.
SLICE = 256


def utf16_length(s: Column) -> Column:
    return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")


def split_at_marks(text: str) -> list[str]:
    """Trimmed sentences of a text; only what lies before its last mark is matched, so the time follows its length."""
    last = max(map(text.rfind, ENDS)) + 1
    found = CLOSED.findall(text[:last])
    found.append(text[last:] if found else text)
    return [part for s in found if (part := s.strip(WHITE))]


@F.arrow_udf(ArrayType(StringType()))
def sentences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Sentences by closing marks; what follows the last one is a sentence too."""
    for s in batches:
        for n in range(0, len(s), SLICE):
            yield pa.array([None if t is None else split_at_marks(t) for t in s.slice(n, SLICE).to_pylist()], pa.list_(pa.string()))


def content_id(text: Column, collection: Column, owner: Column) -> Column:
    """Digest of collection, owner and text in 8-4-4-4-12 form; null for an empty text."""
    digest = F.md5(F.concat_ws(":", collection, owner, text).cast("binary"))
    return F.when(text != "", F.regexp_replace(digest, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def url_extension(url: Column, lower: bool = True) -> Column:
    """Text after the last dot of the path, ``html`` without a dot; the path counts as a whole."""
    path = F.try_parse_url(url, F.lit("PATH"))
    found = F.when(F.contains(path, F.lit(".")), F.element_at(F.split(path, r"\."), -1)).when(path.isNotNull(), F.lit("html"))
    return F.lower(found) if lower else found


def loader_of(url: Column) -> Column:
    """Which loader fetches a URL: by extension (case matters), then by host."""
    extension, host = url_extension(url, lower=False), url_host(url)
    page = F.when(host == "docs.google.com", "google-doc").when(host == "www.youtube.com", "youtube").otherwise("web")
    return F.when(host.isNull(), F.lit(None)).when(extension == "pdf", "pdf").when(extension == "jpeg", "image").otherwise(page)


def google_export_url(url: Column) -> Column:
    doc = F.regexp_extract(url, r"/d/(.*?)/", 1)
    return F.when(doc != "", F.concat(F.lit("https://docs.google.com/document/d/"), doc, F.lit("/export?format=txt")))


def shard_of(key: Column, total: int, size: int) -> Column:
    """Number of a shard: by range for whole keys without a known total, else by checksum."""
    if total <= 0:
        return F.floor(key.cast("double") / size).cast("long")
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(-(-total // size)))
