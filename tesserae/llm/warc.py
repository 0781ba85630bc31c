r"""WARC archives of captured pages and their merged index.

Writing: each record is a gzip member of its own, so an archive can be entered at
any record's offset.  Members are made where the pages are read, before anything
is shuffled; then they are dealt over runs of bounded size, sorted by URL key and
capture time, and written by Spark's text writer, so a lost executor's files are
committed once.  The writer's line separator is a zero byte, and so is the last
byte of a member of under 16 MB: the writer supplies it.  Larger records are
several members, as gzip allows.  Payloads seen before, that is with the digest of
a smaller page id, become revisit records.

Reading: archives are parsed member by member; the digest of a response is
computed anew from the bytes read.

Index: the entries of each archive are a locally sorted run.  Runs are cut at the
bounds of stretches of the key space, and each cut piece travels whole, in its
order; a loser tree merges the pieces of a stretch.  Stretches follow each other,
so the result is one globally ordered capture history.

Defined results: null html is an empty payload; rows with a null id are always
responses; repeated rows are records of their own, responses where the first of
them is one, and dealt over several archives where a page fills more than one; null URLs have an empty key; line breaks within a URL are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import SLICE_ROWS, ascii_lower, materialize, scratch_path
from tesserae.llm.url_rules import host_of, path_of

BREAK = "\r\n"
#: Less than 2 ** 24, so that the size that ends a gzip member has a zero as its last byte.
MEMBER_BYTES = 15_000_000
BITE = 4096
#: What a record holds about besides its payload.
HEAD_BYTES = 600
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "page_id long, url_key string, captured_at string, archive string, offset long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then path and query, for sorting by site."""
    host = F.array_join(F.reverse(F.split(F.regexp_replace(host_of(url), r":\d+$", ""), r"\.")), ",")
    query = F.regexp_extract(url, r"(\?[^#]*)", 1)
    return F.coalesce(F.concat(host, F.lit(")"), ascii_lower(path_of(url)), ascii_lower(query)), F.lit(""))


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, captured_at: Column, run_bytes: int = 32_000_000, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write the pages' records below ``path``; runs hold about ``run_bytes`` of payload at most."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), captured_at.alias("captured_at"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    seen = materialize(rows.select("page_id", "digest", "size"), "digests")
    total = seen.agg(F.sum("size").alias("n")).first()["n"] or 0
    first = seen.where(F.col("page_id").isNotNull() & (F.col("size") >= min_revisit_bytes)).groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    again = seen.join(first, ["digest", "size"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()

    # fewer partitions than the session's would be dealt anew for the join, payloads included
    runs = max(int(total // run_bytes) + 1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # gzipped before they are dealt; which of them are revisits is known only afterwards
    # a page that fills more than a run by itself is dealt over as many; there are fewer of these than runs
    hot = seen.groupBy("page_id", "digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("c")).where((F.col("bytes") + F.col("c") * HEAD_BYTES) > run_bytes)
    hot = F.broadcast(hot.select(F.col("page_id").alias("hot_id"), F.col("digest").alias("hot_digest"), F.ceil((F.col("bytes") + F.col("c") * HEAD_BYTES) / run_bytes).alias("salts")))

    def salted(frame: DataFrame) -> DataFrame:
        """With ``salts``, over how many parts the rows of a page and payload are dealt."""
        met = frame.join(hot, F.col("page_id").eqNullSafe(F.col("hot_id")) & (F.col("digest") == F.col("hot_digest")), "left")
        return met.withColumn("salts", F.coalesce("salts", F.lit(1).cast("long"))).drop("hot_id", "hot_digest")

    again = salted(again).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    again = again.repartition(runs, "page_id", "digest", "salt").hint("merge")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    address = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = rows.withColumn("key", F.regexp_replace(url_key(F.col("url")), r"[\r\n]", " "))
    about = F.concat(
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Target-URI", address),
        line("WARC-Date", F.col("captured_at")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(line("WARC-Page", F.col("page_id").cast("string"))),
        line("WARC-Payload-Length", F.col("size").cast("string")),
        line("WARC-Url-Key", F.col("key")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    response = F.concat(F.lit("WARC/1.1" + BREAK + "WARC-Type: response" + BREAK), about, line("Content-Length", (F.lit(len(HTTP_HEAD)) + F.col("size")).cast("string")), F.lit(BREAK + HTTP_HEAD))
    made = rows.select("page_id", "digest", "key", "captured_at", about.alias("about"), F.encode(F.concat(response, "html", F.lit(BREAK * 2)), "UTF-8").alias("record"))
    packed = made.mapInArrow(in_members, "page_id long, digest string, key string, captured_at string, about string, record binary")
    # whichever part a row goes to, what it refers to is there
    packed = salted(packed).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts"))).drop("salts")
    marked = packed.repartition(runs, "page_id", "digest", "salt").join(again, ["page_id", "digest", "salt"], "left")
    earlier = F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))), line("WARC-Refers-To-Page", F.col("refers_to").cast("string")))
    revisit = F.concat(F.lit("WARC/1.1" + BREAK + "WARC-Type: revisit" + BREAK), "about", earlier, line("Content-Length", F.lit(str(len(HTTP_HEAD)))), F.lit(BREAK + HTTP_HEAD + BREAK * 2))
    is_new = F.col("refers_to").isNull()
    marked = marked.select("page_id", "digest", "key", "captured_at", F.when(is_new, F.lit("")).otherwise(revisit).alias("head"), F.when(is_new, F.col("record")).otherwise(F.lit(b"")).alias("record"))
    ordered = marked.sortWithinPartitions("key", "captured_at", "page_id").select("head", "record").mapInArrow(finished, "member binary")
    # a string of Spark may hold any bytes, and the writer puts them out as they are
    ordered.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def member(data: bytes) -> bytes:
    """``data`` as gzip members of under 16 MB each, without the zero that ends the last one."""
    out = []
    for at in range(0, max(1, len(data)), MEMBER_BYTES):
        deflate = zlib.compressobj(6, wbits=31)
        out.append(deflate.compress(data[at : at + MEMBER_BYTES]) + deflate.flush())
    whole = b"".join(out)
    if whole[-1]:
        raise ValueError("a member does not end with a zero")
    return whole[:-1]


def in_members(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with their last column gzipped."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([member(r.as_py()) for r in part.column(part.num_columns - 1)], pa.binary())], names=part.schema.names)


def finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members as they are, and the heads of revisits gzipped."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([member(h.encode("utf-8", "replace")) if h else r.as_py() for h, r in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)], pa.binary())], names=["member"])


def members(archive: bytes, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each gzip member from the one at ``start`` on."""
    view, at = memoryview(archive), start
    while at < len(view):
        inflate, data, upto = zlib.decompressobj(wbits=31), [], at
        # in small bites, since what follows a member is copied
        while not inflate.eof and upto < len(view):
            data.append(inflate.decompress(view[upto : upto + BITE]))
            upto += BITE
        if not inflate.eof:
            raise ValueError(f"the member at {at} is cut short")
        yield at, b"".join(data)
        at = min(upto, len(view)) - len(inflate.unused_data)


def records(archive: bytes, start: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an archive, from the one at ``start`` on."""
    parts = members(archive, start)
    for offset, data in parts:
        if not data.startswith(b"WARC/1.1\r\n"):
            raise ValueError(f"no record starts at {offset}: {data[:40]!r}")
        while (end := data.find(b"\r\n\r\n")) < 0:
            data += next(parts, (0, b""))[1] or cut_short(offset)
        fields = dict(line.decode("utf-8", "replace").partition(": ")[::2] for line in data[:end].split(b"\r\n")[1:])
        n = int(fields["Content-Length"])
        pieces, size = [data], len(data)
        while size < end + 4 + n + 4:
            pieces.append(next(parts, (0, b""))[1] or cut_short(offset))
            size += len(pieces[-1])
        data = b"".join(pieces)
        if size != end + 8 + n or data[-4:] != b"\r\n\r\n":
            cut_short(offset)
        yield offset, fields, data[end + 4 : -4]


def cut_short(offset: int) -> bytes:
    raise ValueError(f"the record at {offset} is cut short")


def read_index(spark, path: str) -> DataFrame:
    """Entries of all archives below ``path``, those of one archive in its order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "content").where(F.length("content") > 0)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column(0)[k].as_py().rsplit("/", 1)[-1]
                out: list[tuple] = []
                for offset, f, block in records(batch.column(1)[k].as_buffer()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    kind = f["WARC-Type"]
                    digest, size = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["WARC-Payload-Length"])
                    if kind == "response":
                        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                    page, refers = f.get("WARC-Page"), f.get("WARC-Refers-To-Page")
                    out.append((page and int(page), f["WARC-Url-Key"], f["WARC-Date"], name, offset, kind, size, digest, refers and int(refers)))
                if out:
                    yield entries(out)

    return files.mapInArrow(run, ENTRY)


KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def entries(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in ENTRY.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(KINDS)], names=names)


class LoserTree:
    """Merges sorted runs with one comparison a level for each row taken."""

    def __init__(self, runs: list[Iterable]) -> None:
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in self.runs] or [None]
        self.tree = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Whether run ``a`` wins over run ``b``; ended runs lose, equal rows go by run."""
        x, y = self.head[a], self.head[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self._before(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.head[self.tree[0]] is not None:
            leaf = self.tree[0]
            yield self.head[leaf]
            self.head[leaf] = next(self.runs[leaf], None)
            self._play(leaf)


def merge_index(index: DataFrame, stretch_rows: int = 100_000, bound_sample: int = 20) -> DataFrame:
    """The entries in global order: by ``position``, which counts up over URL key, time and id.

    Archives' entries must come in their order, as :func:`read_index` gives them.
    Bounds of stretches come from ``bound_sample`` entries a stretch, chosen by hash.
    """
    n = index.count()
    stretches = int(n // stretch_rows) + 1
    bounds: list[tuple] = []
    if stretches > 1:
        # the place in the archives parts entries that agree in all else
        key = index.select("url_key", "captured_at", F.coalesce("page_id", F.lit(-1)).alias("page_id"), "archive", "offset")
        some = key.orderBy(F.xxhash64("archive", "offset")).limit(bound_sample * stretches).collect()
        found = sorted(map(tuple, some))
        bounds = sorted({found[k * len(found) // stretches] for k in range(1, stretches)})

    def cut(batches):
        """Pieces of runs: consecutive entries of one archive within one stretch, as one row."""
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, archives = entry_keys(batch), batch.column(3).to_pylist()
            edges = [0, *(k for k in range(1, len(keys)) if archives[k] != archives[k - 1]), len(keys)]
            out = []
            for start, end in zip(edges, edges[1:], strict=False):
                at = start
                while at < end:
                    number = bisect_right(bounds, keys[at])
                    upto = bisect_left(keys, bounds[number], at, end) if number < len(bounds) else end
                    out.append((number, f"{archives[at]}:{keys[at][4]:020d}", ipc_bytes(batch.slice(at, upto - at))))
                    at = upto
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["stretch", "run", "piece"])

    def merge(pieces: pa.Table) -> pa.Table:
        stretch = pieces["stretch"][0].as_py()
        order = pc.sort_indices(pieces["run"])
        runs = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in pieces["piece"].take(order)]
        tree = LoserTree([[(key, r, k) for k, key in enumerate(entry_keys(run))] for r, run in enumerate(runs)])
        first = np.cumsum([0, *(len(r) for r in runs)])
        whole = pa.concat_tables(runs)
        got = whole.take(pa.array([int(first[r]) + k for _, r, k in tree], pa.int64()))
        start = stretch << 40
        return got.append_column("position", pa.array(range(start, start + len(got)), pa.int64()))

    return index.mapInArrow(cut, "stretch long, run string, piece binary").groupBy("stretch").applyInArrow(merge, ENTRY + ", position long")


def entry_keys(rows: pa.RecordBatch | pa.Table) -> list[tuple]:
    page, url, when, archive, offset = (rows.column(k).to_pylist() for k in range(5))
    return [(u, w, -1 if p is None else p, a, o) for p, u, w, a, o in zip(page, url, when, archive, offset, strict=True)]


def ipc_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def archive_and_index(pages: DataFrame, captured_at: Column, path: str | None = None, **columns) -> DataFrame:
    """Write the pages as archives, read them back, and return the merged index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, captured_at, **columns)
    return merge_index(materialize(read_index(spark, path), "entries"))
