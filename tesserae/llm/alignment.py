"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

A text is cut into units, before spaces that follow another character than
white space.  No token of either vocabulary crosses such a place, so both
tokenizers end there, and a unit's tokens, groups and links are those it has by
itself: they are found once for a unit and kept.  A text in which a unit doesn't
give back its bytes is encoded whole.

The Python step gives each text's numbers, digest and links; groups with many
links are given as their tokens, and array functions list each id pair of them
once with its number.  All steps are linear in a text's tokens.

Counts of linked ids cover the whole corpus: each document counts once for an
id pair.  The counts meet the documents again by a join, broadcast only where
their number of rows is within ``BROADCAST_ROWS``.

Null and empty texts, and texts whose tokens don't give back their bytes, have
no tokens: numbers of 0 and an empty digest.  Texts of any length are aligned
whole.  Rows are told apart by their place in the input, so null and repeated
ids are harmless; other columns are not looked at.  An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cache, reduce
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import WordCache, map_slices, materialize, text_groups

#: Pairs of ids that may be broadcast: some 50 bytes each.
BROADCAST_ROWS = 1_000_000
#: Links of a group that are listed one by one; larger groups list each id pair once with its number.
LISTED = 64
#: Characters of texts encoded at once, and recent words whose pieces a worker keeps.
BATCH_CHARS, WORDS = 500_000, 200_000
#: Recent units whose links a worker keeps, and the characters of the longest of them.
UNITS, UNIT_CHARS = 100_000, 64
#: What a text is cut into: white space at its start, and no space after another character.
UNIT = re.compile(r"\s*+\S++(?:[^\S ]\s*+\S*+)*+|\s++")
#: Beyond these characters the two libraries' tables of letters, digits and spaces may be of different Unicode versions.
OTHER = re.compile("[^\x00-ɏ]")


def byte_values() -> dict[str, int]:
    """The byte of each character in which a byte-level vocabulary writes its tokens."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class ByteLevel:
    """Ids and token bytes of a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        at = byte_values()
        special = {t["id"] for t in made["added_tokens"]}
        ranks = {bytes(map(at.__getitem__, token)): k for token, k in made["model"]["vocab"].items() if k not in special}
        self.table = {k: token for token, k in ranks.items()}
        self.size = 1 + max(made["model"]["vocab"].values())
        # merges are in the order of their ids, so ranks say the same as the list of merges; tests compare both libraries
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lengths = token_lengths(self.table, self.size)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.whole.no_truncation()
        self.whole.no_padding()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        other = [k for k, t in enumerate(texts) if OTHER.search(t)]
        out = [None if OTHER.search(t) else self.fast.encode_to_numpy(t, disallowed_special=()) for t in texts]
        if other:
            for k, found in zip(other, self.whole.encode_batch([texts[k] for k in other], add_special_tokens=False), strict=True):
                out[k] = np.array(found.ids, np.int32)
        return out


class Pieces:
    """Ids and token bytes of a piece model with byte fallback, which sets a space before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.table = dict(enumerate(map(self._bytes, range(self.size))))
        self.lengths = token_lengths(self.table, self.size)
        self.words = WordCache(WORDS)

    def _bytes(self, k: int) -> bytes:
        piece = self.model.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(k) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """No piece has a space but at its start, so words between single spaces are encoded by themselves, and once."""
        out: list = [None] * len(texts)
        words: dict[int, list[str]] = {}
        for k, text in enumerate(texts):
            own = text.split(" ")
            if "" in own or "▁" in text:
                out[k] = np.array(self.model.encode(text), np.int32)
            else:
                words[k] = own
        known = self.words.fetch({w for own in words.values() for w in own}, lambda new: self.model.encode(new, num_threads=1))
        for k, own in words.items():
            out[k] = np.array([i for w in own for i in known[w]], np.int32)
        return out


def token_lengths(table: dict[int, bytes], size: int) -> np.ndarray:
    out = np.zeros(size, np.int32)
    for k, token in table.items():
        out[k] = len(token)
    return out


@cache
def byte_level(path: str) -> ByteLevel:
    """Read once in a worker's life; workers serve many tasks."""
    return ByteLevel(path)


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Units:
    """Numbers, digest text and links of units of texts; those of recent short ones are kept.

    A unit has: A and B tokens, groups, the groups as text, links as bytes, and
    the groups of more than ``listed`` links.
    """

    #: What a text without tokens has.
    NONE = 0, 0, 0, b"", b"", []

    def __init__(self, byte_level_path: str, piece_path: str, listed: int) -> None:
        self.a, self.b, self.listed = byte_level(byte_level_path), pieces(piece_path), listed
        self.kind = np.int32 if self.a.size * self.b.size < 2**31 else np.int64
        self.known = WordCache(UNITS)
        # ids as text, with room for a mark
        names = [str(k).encode() for k in range(max(self.a.size, self.b.size))]
        self.widths = np.array([len(n) for n in names])
        self.names = np.array(names, f"S{self.widths.max() + 1}").view(np.uint8).reshape(len(names), -1)

    def of_units(self, units: list[str]) -> dict[str, tuple | None]:
        """None where bytes are not given back.  A side encodes units that can follow each other as one text."""
        plain = [u for u in units if not OTHER.search(u) and not u[-1].isspace()]
        others = list(set(units).difference(plain))
        units = plain + others
        said = [u.encode("utf-8", "surrogatepass") for u in units]
        ends, whole = np.cumsum([len(u) for u in said]), b"".join(said)
        a = np.concatenate(self.a.encode(["".join(plain), *others])).astype(np.int64)
        # the piece model sets the first space itself
        own = self.b.model.encode([u[1:] for u in units], num_threads=1)
        b = np.fromiter(chain.from_iterable(own), np.int64)
        a_ends, b_ends = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        cuts = np.intersect1d(a_ends, b_ends, assume_unique=True)
        same = all(b"".join(map(side.table.__getitem__, ids.tolist())) == whole for side, ids in ((self.a, a), (self.b, b)))
        # a unit's tokens give back no more nor less than the unit
        if not same or not np.array_equal(b_ends[np.cumsum([len(x) for x in own]) - 1], ends) or not np.isin(ends, cuts).all():
            half = len(units) // 2
            return self.of_units(units[:half]) | self.of_units(units[half:]) if half else {units[0]: None}
        # a token's group, a group's tokens and its first one
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        n_a, n_b = np.bincount(a_group), np.bincount(b_group)
        a_to, b_to = np.cumsum(n_a), np.cumsum(n_b)
        a_from, b_from = a_to - n_a, b_to - n_b
        # a group's A tokens, then its B tokens
        a_at, b_at = np.arange(len(a)) + b_from[a_group], np.arange(len(b)) + a_to[b_group]
        ids, marks = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[a_at], ids[b_at] = a, b
        marks[a_at[a_to - 1]], marks[b_at[b_to - 1]] = ord("|"), ord(";")
        names, widths = self.names[ids], self.widths[ids]
        names[np.arange(len(ids)), widths] = marks
        text = names[np.arange(names.shape[1]) <= widths[:, None]].tobytes()
        # every A token with each B token of its group
        times = np.where(n_a * n_b <= self.listed, n_b, 0)
        each = times[a_group]
        other = np.arange(each.sum()) + np.repeat(b_from[a_group] - (np.cumsum(each) - each), each)
        links = (np.repeat(a * self.b.size, each) + b[other]).astype(self.kind).tobytes()
        # where units end
        to = np.searchsorted(cuts, ends)
        wide: dict[int, list] = {}
        for g in np.flatnonzero(n_a * n_b > self.listed).tolist():
            wide.setdefault(int(np.searchsorted(to, g)), []).append({"a": a[a_from[g] : a_to[g]].tolist(), "b": b[b_from[g] : b_to[g]].tolist()})
        places = [to + 1, a_to[to], b_to[to], np.cumsum(widths + 1)[a_to[to] + b_to[to] - 1], np.cumsum(n_a * times)[to] * np.dtype(self.kind).itemsize]
        groups, n_a, n_b = (np.diff(x, prepend=0).tolist() for x in places[:3])
        texts, linked_ = ([x[start:end] for start, end in pairwise([0, *at.tolist()])] for x, at in zip((text, links), places[3:], strict=True))
        return dict(zip(units, zip(n_a, n_b, groups, texts, linked_, [wide.get(k, []) for k in range(len(units))], strict=True), strict=True))

    def of_text(self, text: str) -> tuple:
        """Of a text as one unit."""
        return self.of_units([" " + text])[" " + text] or self.NONE

    def of_texts(self, texts: list[str | None]) -> list[tuple]:
        cut = [UNIT.findall(" " + t) if t else [] for t in texts]
        distinct = {u for own in cut for u in own}
        long = [u for u in distinct if len(u) > UNIT_CHARS]
        known = self.known.fetch(distinct.difference(long), lambda new: map(self.of_units(new).__getitem__, new))
        if long:
            known = known | self.of_units(long)
        out = []
        for text, own in zip(texts, cut, strict=True):
            found = [known[u] for u in own]
            if None in found:
                out.append(self.of_text(text))
            elif found:
                n_a, n_b, n_groups, said, links, wide = zip(*found, strict=True)
                out.append((sum(n_a), sum(n_b), sum(n_groups), b"".join(said), b"".join(links), [g for w in wide if w for g in w]))
            else:
                out.append(self.NONE)
        return out


@cache
def units_of(byte_level_path: str, piece_path: str, listed: int) -> Units:
    return Units(byte_level_path, piece_path, listed)


def linked(byte_level_path: str, piece_path: str, listed: int):
    """A batch function: (row, text) to its numbers, digest, links and groups of many links."""

    def make():
        units = units_of(byte_level_path, piece_path, listed)
        pair = pa.from_numpy_dtype(units.kind)
        tokens = pa.list_(pa.int32())
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pair), pa.list_(pa.struct([("a", tokens), ("b", tokens)]))]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            columns: list[list] = [[] for _ in kinds]
            for start, end in text_groups(texts, BATCH_CHARS):
                n_a, n_b, n_groups, said, links, wide = zip(*units.of_texts(texts[start:end]))
                offsets = np.cumsum([0, *map(len, links)]) // np.dtype(units.kind).itemsize
                listed_ = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(links), units.kind)))
                # a mark follows every group
                digests = [hashlib.sha256(t[:-1]).hexdigest() if t else "" for t in said]
                for column, made in zip(columns, (n_a, n_b, n_groups, digests, listed_, wide), strict=True):
                    column.append(made)
            arrays = [pa.concat_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c in column] or [pa.array([], kind)]) for column, kind in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "wide"])

        return step

    return make


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once however often it is named."""
    return F.transform(F.array(value), use)[0]


def runs(values: Column) -> Column:
    """(v, n) of each distinct value, by one sort."""
    def counted(s: Column) -> Column:
        last = F.filter(F.transform(s, lambda x, k: F.when((k == F.size(s) - 1) | (F.get(s, k + 1) != x), k)), lambda k: k.isNotNull())
        return let(last, lambda at: F.transform(at, lambda k, j: F.struct(F.get(s, k).alias("v"), (k - F.coalesce(F.get(at, j - 1), F.lit(-1))).cast("long").alias("n"))))

    return let(F.sort_array(values), counted)


def flat_map(values: Column, each) -> Column:
    return F.flatten(F.transform(values, each))


def aligned(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its numbers and digest, ``pairs`` (one item a link) and ``heavy`` (pair, n) of groups with many links.

    A pair is the A id times the size of vocabulary B plus the B id.
    """
    n_pieces = pieces(piece_path).size
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    # in 32 bits where all pairs fit
    kind_of_pair = "int" if byte_level(byte_level_path).size * n_pieces < 2**31 else "bigint"
    found = map_slices(rows, linked(byte_level_path, piece_path, LISTED), f"row {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<{kind_of_pair}>, wide array<struct<a: array<int>, b: array<int>>>")

    def item(x: Column, y: Column) -> Column:
        return F.struct((x["v"].cast("long") * n_pieces + y["v"]).cast(kind_of_pair).alias("pair"), (x["n"] * y["n"]).alias("n"))

    heavy = flat_map("wide", lambda g: let(runs(g["b"]), lambda bs: flat_map(runs(g["a"]), lambda x: F.transform(bs, lambda y: item(x, y)))))
    return found.select(F.col("row.row").alias("row"), F.col("row.id").alias(id_col), "n_a", "n_b", "n_groups", "groups_sha256", "pairs", heavy.alias("heavy"))


def link_counts(found: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): in how many rows a pair is linked, and whether that is its A id's highest."""
    once = found.select(F.explode(F.array_union("pairs", F.transform("heavy", lambda h: h["pair"]))).alias("pair"))
    counts = materialize(once.groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    a_id = F.expr(f"pair div {n_b}")
    highest = counts.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("highest"))
    return materialize(counts.withColumn("a_id", a_id).join(highest, "a_id").select("pair", "count", (F.col("count") == F.col("highest")).alias("best")), "pairs")


def align(docs: DataFrame, byte_level_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens, groups, links, and how its links stand in the corpus."""
    found = materialize(aligned(docs, byte_level_path, piece_path, id_col, text_col), "aligned")
    counts = link_counts(found, pieces(piece_path).size)
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    one = found.select("row", F.explode("pairs").alias("pair"), F.lit(1).cast("long").alias("n"))
    several = found.where(F.size("heavy") > 0).select("row", F.explode("heavy").alias("h")).select("row", "h.pair", "h.n")

    def summed(links: DataFrame) -> DataFrame:
        return links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("n")).alias("count_sum"))

    sums = reduce(DataFrame.unionByName, [summed(one), summed(several)]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    n_links = F.size("pairs") + F.aggregate("heavy", F.lit(0).cast("long"), lambda s, h: s + h["n"])
    rows = found.select("row", id_col, "n_a", "n_b", "n_groups", n_links.alias("n_links"), "groups_sha256")
    return rows.join(sums, "row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
