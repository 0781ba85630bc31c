"""Best-fit packing of documents into training sequences under several capacities.

A piece needs room for its tokens, a document slot and attention cost (its
length squared, since attention stays within a document).  An open sequence
keeps the residual of each capacity.  The next piece, longest first, goes to the
feasible sequence with the smallest weighted norm of the residual that it leaves,
or the largest weighted dot product of demand and residual, whichever rule is
chosen; where no sequence has room for it under every constraint a new one is
opened.

Scale: the pieces are dealt over groups by a salted hash, each of about
``group_chars`` of text, and each group is packed by one task; a group ends with
a few half-filled sequences at most, so the loss is a fraction of a per mille.
The salt spreads a hot source and repeated rows evenly.  Only (id, piece, length)
is shuffled, never the tokens.

Defined results: a null or empty text is one piece with the closing id alone;
null ids are carried through; repeated rows are packed as often as they occur
(their pieces can't be told apart but by sequence_id and offset).
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.bpe_stream import MergeList
from tesserae.llm.common import map_slices, text_groups

GROUP_CHARS = 1_000_000
#: What a row counts as besides its text when groups are sized.
ROW_CHARS = 200
SLICE_ROWS = 2048
#: Bytes whose words are hashed at once.
STRETCH = 500_000
#: Bytes of letters, and of marks after them, that the numpy path takes.
MOST_LETTERS, MOST_MARKS = 40, 8
#: Marks that the tokenizer's pattern parts from letters before them.
MARKS = b".,;:!?*&%$#|\""

_workers: dict = {}


def _table(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SPACE, IS_MARK = _table(b" \t\n\r\x0b\x0c"), _table(MARKS)
IS_UPPER, IS_ASCII = _table(range(65, 91)), _table([*range(65, 91), *range(97, 123)])
#: Second bytes of the two-byte letters from U+00C0 to U+00FF; the first 31 are capitals whose small letter is 32 further.
IS_LATIN, IS_LATIN_UPPER = _table(set(range(0x80, 0xC0)) - {0x97, 0xB7}), _table(set(range(0x80, 0x9F)) - {0x97})


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def inverse(x: np.ndarray) -> np.ndarray:
    """Of odd numbers modulo 2 ** 64; each step doubles the bits that are right, three at first."""
    y = x.copy()
    for _ in range(5):
        y *= np.uint64(2) - x * y
    return y


class WordTokenizer:
    """Ids of whole texts for a tokenizer that drops white space.

    No token crosses white space, so a text's ids are its words' ids in order,
    and each distinct word of a group of texts is encoded once.  Words of Latin
    letters, before closing marks at most, are merged side by side in numpy, with
    their case folded as the file's normaliser does; all others, and the marks,
    go to the library.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = MergeList(path)
        powers = np.random.default_rng(17).integers(0, 1 << 62, 2, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.powers = list(powers)
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []

    def _library(self, words: list[bytes]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, np.int64) for e in encoded]

    def _powers_of(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Powers 1 to ``n`` of each base, and of its inverse; those of a usual stretch are kept."""
        if n <= STRETCH and self.kept:
            return self.kept
        found = []
        for r in self.powers:
            bases = (r, inverse(np.array([r]))[0])
            found.append(tuple(np.cumprod(np.full(max(n, STRETCH), x, np.uint64)) for x in bases))
        if n <= STRETCH:
            self.kept = found
        return found

    def _keys(self, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of words, wherever they stand in ``b``."""
        key = np.zeros(len(start), np.uint64)
        for power, back in self._powers_of(len(b)):
            # sums of byte times power up to each byte, taken back to a word's first one
            total = b.astype(np.uint64)
            total += np.uint64(1)
            total *= power[: len(b)]
            first_term = total[start]
            np.cumsum(total, out=total)
            h = (total[start + size - 1] - total[start] + first_term) * back[start]
            key = (key ^ h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + size.astype(np.uint64)
        return key

    def _distinct(self, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word of each kind, and each word's kind."""
        end = start + size
        # words in stretches of bytes, so that only their keys and places are held for all; a longer word is one of its own
        cuts, i = [], 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + STRETCH, "right")))
            cuts.append((i, j))
            i = j
        key = np.concatenate([self._keys(b[start[i] : end[j - 1]], start[i:j] - start[i], size[i:j]) for i, j in cuts])
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        # equal keys are equal words, or else the words themselves are compared
        like = start[first[kind]]
        same = (size == size[first[kind]]).all() and all((b[ragged(start[i:j], size[i:j])] == b[ragged(like[i:j], size[i:j])]).all() for i, j in cuts)
        if not same:
            words = [b[s : s + n].tobytes() for s, n in zip(start.tolist(), size.tolist(), strict=True)]
            seen: dict[bytes, int] = {}
            kind = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
            _, first = np.unique(kind, return_index=True)
        return first, kind

    def _words(self, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        after_c3 = np.concatenate([[False], b[:-1] == 0xC3])
        latin = after_c3 & IS_LATIN[b]
        letter = IS_ASCII[b] | latin | np.concatenate([latin[1:], [False]])
        small = b + (32 * (IS_UPPER[b] | (latin & IS_LATIN_UPPER[b]))).astype(np.uint8)
        count = lambda flags: np.concatenate([[0], np.cumsum(flags)])
        letters, marks = count(letter), count(IS_MARK[b])
        n = letters[start + size] - letters[start]
        tail = marks[start + size] - marks[start]
        plain = (n > 0) & (n <= MOST_LETTERS) & (tail <= MOST_MARKS) & (n + tail == size) & (letters[start + n] - letters[start] == n)

        main, extra = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        pools: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        widths = np.where(plain, np.maximum(4, -(-n // 4) * 4), 0)
        for width in np.unique(widths[plain]).tolist():
            rows = np.flatnonzero(widths == width)
            at = np.minimum(start[rows, None] + np.arange(width), len(b) - 1)
            ids, main[rows] = self.merges.merged(small[at], n[rows])
            pools.append((rows, ids.astype(np.int64), main[rows]))
        rest = np.flatnonzero(~plain)
        if len(rest):
            found = self._library([b[start[k] : start[k] + size[k]].tobytes() for k in rest.tolist()])
            main[rest] = [len(f) for f in found]
            pools.append((rest, np.concatenate(found), main[rest]))
        closed = np.flatnonzero(plain & (tail > 0))
        ends = [b[start[k] + n[k] : start[k] + size[k]].tobytes() for k in closed.tolist()]
        kinds = dict.fromkeys(ends)
        kinds = dict(zip(kinds, self._library(list(kinds)), strict=True)) if kinds else {}
        extra[closed] = [len(kinds[e]) for e in ends]

        total = main + extra
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.int64)
        for rows, ids, counts in pools:
            out[ragged(begin[rows], counts)] = ids
        if ends:
            out[ragged(begin[closed] + main[closed], extra[closed])] = np.concatenate([kinds[e] for e in ends])
        return out, total

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        b = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
        if not len(b):
            return [b""] * len(texts)
        word = ~IS_SPACE[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        start, size = edge[::2], edge[1::2] - edge[::2]
        if not len(start):
            return [b""] * len(texts)
        first, kind = self._distinct(b, start, size)
        # the distinct words alone, each with the white space after it
        with_gap = size[first] + 1
        ids, counts = self._words(b[ragged(start[first], with_gap)], np.cumsum(with_gap) - with_gap, size[first])
        begin = np.cumsum(counts) - counts
        out = ids[ragged(begin[kind], counts[kind])].astype("<u4").tobytes()
        upto = np.concatenate([[0], np.cumsum(counts[kind])])
        ends = np.cumsum([len(r) + 1 for r in raw])
        last = upto[np.searchsorted(start, ends)] * 4
        return [out[s:e] for s, e in zip([0, *last[:-1].tolist()], last.tolist(), strict=True)]


def tokenizer(path: str) -> WordTokenizer:
    if path not in _workers:
        _workers[path] = WordTokenizer(path)
    return _workers[path]


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, closing_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids_crc32."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} {dict(source.dtypes)['id']}, piece int, start long, length long, ids_crc32 long"

    def make():
        encoder = tokenizer(tokenizer_path)
        end = np.array([closing_id], "<u4").tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            row, piece, start, length, crc = [], [], [], [], []
            at = 0
            for a, b in text_groups(texts, GROUP_CHARS):
                for ids in encoder.packed(texts[a:b]):
                    ids += end
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[s : s + 4 * capacity]
                        row.append(at)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                    at += 1
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            return pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32"])

        return step

    return map_slices(source, make, schema, SLICE_ROWS)


class OpenSequences:
    """Sequences with room left, by residual tokens; those with the same residual vector are alike."""

    def __init__(self, capacities: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> None:
        self.total = capacities
        self.scale = [w / (c * c) for w, c in zip(weights, capacities, strict=True)]
        self.rule = rule
        self.numbers: dict[tuple[int, int, int], list[int]] = {}
        self.by_tokens: dict[int, set[tuple[int, int, int]]] = {}
        self.present = np.zeros(capacities[0] + 1, bool)

    def put(self, key: tuple[int, int, int], number: int) -> None:
        if key not in self.numbers:
            self.numbers[key] = []
            self.by_tokens.setdefault(key[0], set()).add(key)
            self.present[key[0]] = True
        self.numbers[key].append(number)

    def take(self, key: tuple[int, int, int]) -> int:
        number = self.numbers[key].pop()
        if not self.numbers[key]:
            del self.numbers[key]
            self.by_tokens[key[0]].discard(key)
            self.present[key[0]] = bool(self.by_tokens[key[0]])
        return number

    def best(self, size: int) -> tuple[int, int, int] | None:
        """The residual vector that a piece of ``size`` tokens should go to."""
        cost, (a, b, c) = size * size, self.scale
        best, best_value = None, float("inf")
        levels = np.flatnonzero(self.present[size:]) + size
        if self.rule == "dot":
            levels = levels[::-1]
        for tokens in levels.tolist():
            # no vector of this residual of tokens or of those to come is better than its tokens' part alone
            if best is not None and self._bound(tokens, size) >= best_value:
                break
            for key in self.by_tokens[tokens]:
                if key[1] < 1 or key[2] < cost:
                    continue
                if self.rule == "norm":
                    value = a * (tokens - size) ** 2 + b * (key[1] - 1) ** 2 + c * (key[2] - cost) ** 2
                else:
                    value = -(a * tokens * size + b * key[1] + c * key[2] * cost)
                if value < best_value or (value == best_value and key < best):
                    best, best_value = key, value
        return best

    def _bound(self, tokens: int, size: int) -> float:
        a, b, c = self.scale
        if self.rule == "norm":
            return a * (tokens - size) ** 2
        return -(a * tokens * size + b * self.total[1] + c * self.total[2] * size * size)


def vector_best_fit(lengths: np.ndarray, capacity: int, max_docs: int | None, max_attention: int, weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, pieces taken longest first.

    Without ``max_docs``, a sequence has as many slots as it could hold of the shortest piece: they count in the
    choice of a sequence, and never open one that tokens alone would not.
    """
    max_docs = max_docs or max(1, capacity // max(1, int(lengths.min(initial=capacity))))
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room, filled = OpenSequences((capacity, max_docs, max_attention), weights, rule), 0
    for k in order.tolist():
        size = int(lengths[k])
        key = room.best(size)
        if key is None:
            key, number = (capacity, max_docs, max_attention), filled
            filled += 1
        else:
            number = room.take(key)
        sequence[k], offset[k] = number, capacity - key[0]
        left = (key[0] - size, key[1] - 1, key[2] - size * size)
        if min(left) > 0:
            room.put(left, number)
    return sequence, offset


#: Production parameter: how much each residual counts in the choice.
WEIGHTS = (1.0, 0.05, 0.05)


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    max_docs: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    closing_id: int = 0,
    group_chars: int = 64_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces with sequence_id and gapless offset.

    ``max_docs`` defaults to what each group's shortest piece admits, ``max_attention``
    to the cost of one piece of full length, the least that lets every piece in.  ``group_chars`` is the text of the pieces that one
    task packs, a row counting as ``ROW_CHARS`` besides its text.
    """
    max_attention = max_attention or capacity * capacity
    if max_attention < capacity * capacity:
        raise ValueError("max_attention is less than one full piece costs")
    pieces = pieces_of(docs, tokenizer_path, capacity, closing_id, id_col, text_col)
    chars = docs.select(F.sum(F.coalesce(F.length(F.col(text_col).cast("string")), F.lit(0)) + ROW_CHARS).alias("n")).first()["n"] or 0
    groups = int(chars // group_chars) + 1
    # a task's place in its partition is the same when it runs again, so the salt is too
    salt = F.shiftright(F.monotonically_increasing_id(), 10)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.col(id_col), "piece", "ids_crc32", salt), F.lit(groups)))
    kind = dict(pieces.dtypes)[id_col]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([id_col, "piece"], kind="stable")
        sequence, offset = vector_best_fit(frame["length"].to_numpy(), capacity, max_docs, max_attention, weights, rule)
        out = frame.drop(columns="_group")
        out["sequence_id"] = frame["_group"].to_numpy() + groups * sequence
        out["offset"] = offset
        return out

    schema = f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("_group").applyInPandas(run, schema)


