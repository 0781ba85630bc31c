r"""Byte-level BPE encoding and decoding as streaming transducers.

A merge list has a *sufficient lookahead*: a number of bytes L such that every
token ending at least L bytes before the end of what has been read is final,
whatever follows.  It is computed here from the merge list once
(:func:`sufficient_lookahead`); the encoder then keeps a window of a few L
bytes, emits stable tokens and drops their bytes, so a piece of any length is
encoded in constant memory.  The decoder feeds token bytes to an incremental
UTF-8 automaton, which holds at most three pending bytes.

A text is read in parts.  :class:`TextStream` cuts what it has read at boundaries
that nothing to come can move and keeps the rest, which is bounded: a run of one
kind of characters that grows past the window is handed to a :class:`PieceEncoder`
while it is still being read.  A piece that has ended is a window that is final as
a whole; such windows of many texts are merged side by side.

Why a restart at a stable boundary is right: no merge ever crosses a token
boundary of the final segmentation, so the two sides evolve independently and
the suffix alone yields the same tokens.

Defined results: null and empty text give no tokens and an empty decoding;
null ids are carried through; repeated rows give repeated results; strings of
special tokens found in a text become their ids, as the tokenizers library does.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import WordCache, map_slices, text_groups

#: The pre-tokenizer pattern of byte-level BPE within a chunk without inner white space.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")
#: Unicode White_Space, as the pattern's \s has it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
IS_WHITE = re.compile(f"[{WHITE}]")

#: Where a chunk surely ends: before white space after anything else.
LAST_END = re.compile(f"[^{WHITE}](?=[{WHITE}])")


class Kind:
    """Characters of one kind: with the space that may lead them, and alone."""

    def __init__(self, chars: str, lead: str) -> None:
        self.inner, self.whole = regex.compile(chars + "+"), regex.compile(lead + chars + "+")

    def match(self, text: str):
        return self.whole.match(text)


SPACES, LETTERS, DIGITS, MARKS = Kind(f"[{WHITE}]", ""), Kind(r"\p{L}", " ?"), Kind(r"\p{N}", " ?"), Kind(r"[^\s\p{L}\p{N}]", " ?")

SEGMENT_CHARS = 65536
GROUP_CHARS = 1_000_000
CACHE_ENTRIES = 250_000
CACHED_CHARS = 64
SHORT_CHARS = 24
NO_RULE = 1 << 30
SLOTS = 1 << 18


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class MergeList:
    """Vocabulary, merges by rank and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        of_letter = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        suffix = spec["model"].get("end_of_word_suffix") or ""
        for token, k in vocab.items():
            token = token.removesuffix(suffix) if suffix else token
            self.token_bytes[k] = bytes(of_letter[c] for c in token) if all(c in of_letter for c in token) else token.encode()
        for token, k in self.special.items():
            self.token_bytes[k] = token.encode()
        self.of_byte = [vocab[c] for c in letters]
        #: The last byte of a piece has a symbol of its own where the file marks the ends of words.
        self.of_last = [vocab[c + suffix] for c in letters] if suffix else self.of_byte
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self.by_pair = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(self.rules)}
        made = {*self.of_byte, *self.of_last}
        for a, b, c in self.rules:
            if a not in made or b not in made:
                raise ValueError("a merge uses a token that no earlier merge makes; no bounded lookahead is known")
            made.add(c)
        self.lookahead = sufficient_lookahead(self.rules, [*self.of_byte, *self.of_last], self.token_bytes)

        # an open hash table of pairs: a key's slot, or the next free one after it
        self._slot_key, self._slot_rank = np.full(SLOTS, -1, np.int64), np.full(SLOTS, NO_RULE, np.int32)
        keys = np.array([a << 32 | b for a, b, _ in self.rules], np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self._slot_key[at] >= 0:
                at = (at + 1) % SLOTS
            self._slot_key[at], self._slot_rank[at] = key, rank
        self._made = np.array([c for _, _, c in self.rules], np.int32)
        self._of_byte, self._of_last = np.array(self.of_byte, np.int32), np.array(self.of_last, np.int32)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RULE where no rule merges it or one is -1."""
        keys = (left.astype(np.int64) << 32 | right).ravel()
        at = self._slot(keys)
        held = self._slot_key[at]
        out = np.where(held == keys, self._slot_rank[at], NO_RULE)
        going = np.flatnonzero((held != keys) & (held >= 0) & (keys >= 0))
        while going.size:
            at[going] = (at[going] + 1) % SLOTS
            held = self._slot_key[at[going]]
            hit = held == keys[going]
            out[going[hit]] = self._slot_rank[at[going[hit]]]
            going = going[~hit & (held >= 0)]
        return out.reshape(left.shape)

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of short pieces."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            by_width.setdefault(max(4, -(-len(piece) // 4) * 4), []).append(k)
        for width, members in by_width.items():
            flat = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in members), np.uint8).reshape(-1, width)
            ids, counts = self.merged(flat, np.array([len(pieces[k]) for k in members]))
            packed, start = ids.astype("<u4").tobytes(), 0
            for k, end in zip(members, (np.cumsum(counts) * 4).tolist(), strict=True):
                out[k] = packed[start:end]
                start = end
        return out

    def merged(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one a row of bytes, merged side by side; and how many each has."""
        m, width = flat.shape
        # column `width` is a sentinel on either side
        ids = np.full((m, width + 1), -1, np.int32)
        ids[:, :width] = np.where(np.arange(width)[None, :] >= sizes[:, None], -1, self._of_byte[flat])
        if self.of_last is not self.of_byte:
            rows = np.flatnonzero(sizes)
            ids[rows, sizes[rows] - 1] = self._of_last[flat[rows, sizes[rows] - 1]]
        ranks = np.full((m, width + 1), NO_RULE, np.int32)
        ranks[:, : width - 1] = self._ranks(ids[:, : width - 1], ids[:, 1:width])
        after = np.tile(np.arange(1, width + 2), (m, 1))
        after[:, width] = width
        before = np.tile(np.arange(-1, width), (m, 1))
        before[:, 0] = width
        live = np.arange(m)
        while live.size:
            i = ranks[live].argmin(1)
            rank = ranks[live, i]
            going = rank < NO_RULE
            live, i, rank = live[going], i[going], rank[going]
            j = after[live, i]
            k = after[live, j]
            ids[live, i], ids[live, j] = self._made[rank], -1
            after[live, i] = k
            before[live, k] = i
            ranks[live, j] = NO_RULE
            h = before[live, i]
            ranks[live, i] = self._ranks(ids[live, i], ids[live, k])
            ranks[live, h] = self._ranks(ids[live, h], ids[live, i])
            ranks[live, width] = NO_RULE
        kept = ids >= 0
        return ids[kept], kept.sum(1)

    def packed_window(self, data: bytes) -> bytes:
        return np.array(self.window(data), "<u4").tobytes()

    def window(self, data: bytes) -> list[int]:
        """BPE with a heap over a linked list, for a whole window."""
        ids: list[int] = [self.of_byte[b] for b in data]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(hit[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (hit := self.by_pair.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.by_pair[a, b][1], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (hit := self.by_pair.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (hit[0], left, ids[left], ids[right]))
        return [k for k in ids if k >= 0]


def sufficient_lookahead(rules: list[tuple[int, int, int]], of_byte: list[int], token_bytes: list[bytes]) -> int:
    """Bytes after which a token cannot change, for this merge list.

    Compare the runs over a text and over any longer text, rule by rule.  They
    agree up to a frontier, at first the end of the shorter text.  A rule (x, y)
    moves the frontier left by len(x) only if a token y starts at the frontier
    in one run and not in the other.  ``reach[t]`` bounds how far the frontier
    may have moved when a token t starts at it; one pass over the rules by rank
    propagates it, because a run applies rules in that order.
    """
    reach: dict[int, int] = {k: 0 for k in of_byte}
    for x, y, made in rules:
        moved = reach[y] + len(token_bytes[x]) if y in reach else -1
        grown = reach.get(x, -1)
        if moved >= 0:
            reach[x] = max(reach.get(x, -1), moved)
        if max(moved, grown) >= 0:
            reach[made] = max(reach.get(made, -1), moved, grown)
    return max(reach.values()) + max(map(len, token_bytes))


class PieceEncoder:
    """Encodes one pre-token fed in parts, in memory bounded by the lookahead."""

    def __init__(self, merges: MergeList, lookahead: int | None = None) -> None:
        self.merges, self.held = merges, b""
        self.lookahead = merges.lookahead if lookahead is None else lookahead

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = max(self.lookahead, 1024)
        for at in range(0, len(data), step):
            self.held += data[at : at + step]
            if len(self.held) >= 2 * step:
                out += self._stable(len(self.held) - self.lookahead)
        return out

    def _stable(self, limit: int) -> list[int]:
        out, end = [], 0
        for k in self.merges.window(self.held):
            size = len(self.merges.token_bytes[k])
            if end + size > limit:
                break
            out.append(k)
            end += size
        self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        data, self.held = self.held, b""
        return self.merges.window(data)


class TextStream:
    """Cuts one text, fed in parts, into chunks whose bounds are final; holds a bounded rest.

    ``feed`` and ``finish`` return chunks, or packed ids where a run of letters,
    digits, marks or white space is longer than the window and was encoded while
    it came in.
    """

    def __init__(self, merges: MergeList) -> None:
        self.merges, self.held = merges, ""
        self.window = max(1024, 2 * merges.lookahead)
        self.run: PieceEncoder | None = None
        self.kind = SPACES

    def feed(self, part: str) -> list[str | bytes]:
        out: list[str | bytes] = []
        self.held += part
        if self.run is not None and not self._run_on(out):
            return out
        # a chunk ends for certain before white space that follows something else
        end = max((m.start() + 1 for m in LAST_END.finditer(self.held, max(0, len(self.held) - self.window))), default=0)
        if end:
            out += CHUNK.findall(self.held[:end])
            self.held = self.held[end:]
        while len(self.held) > self.window:
            self._shorten(out)
            if self.run is not None and not self._run_on(out):
                break
        return out

    def _shorten(self, out: list[str | bytes]) -> None:
        """Take what is certain from the front of a rest longer than the window."""
        first, white = CHUNK.match(self.held), SPACES.match(self.held)
        blank = IS_WHITE.match(self.held, first.end() - 1) is not None
        # blanks are final once something else follows them, other chunks once a blank does
        if (white.end() if blank else first.end()) < len(self.held):
            out.append(first.group())
            self.held = self.held[first.end() :]
            return
        if blank:
            self.run, self.kind, lead = PieceEncoder(self.merges), SPACES, white.end() - 1
        else:
            piece = PIECE.match(self.held)
            if piece.end() < len(self.held) - 3:
                # the piece has ended, and no contraction can begin before its end
                out.append(self.merges.packed_window(piece.group().encode("utf-8", "replace")))
                self.held = self.held[piece.end() :]
                return
            kind = next(k for k in (LETTERS, DIGITS, MARKS) if k.match(self.held))
            self.run, self.kind, lead = PieceEncoder(self.merges), kind, piece.end()
        out.append(self._emit(self.held[:lead]))
        self.held = self.held[lead:]

    def _emit(self, text: str) -> bytes:
        return np.array(self.run.feed(text.encode("utf-8", "replace")), "<u4").tobytes()

    def _run_on(self, out: list[str | bytes]) -> bool:
        """Feed the run that is open; whether it has ended."""
        more = self.kind.inner.match(self.held) if self.kind is not SPACES else SPACES.match(self.held)
        upto = more.end() if more else 0
        ended = upto < len(self.held)
        if self.kind is SPACES and upto:
            # the last white space before something else belongs to what follows
            upto -= 1
        out.append(self._emit(self.held[:upto]))
        self.held = self.held[upto:]
        if ended:
            out.append(np.array(self.run.finish(), "<u4").tobytes())
            self.run = None
        return ended

    def finish(self) -> list[str | bytes]:
        out: list[str | bytes] = []
        if self.run is not None:
            # what is held is the last white space of a run that ends the text
            out += [self._emit(self.held), np.array(self.run.finish(), "<u4").tobytes()]
        else:
            out += CHUNK.findall(self.held)
        self.held, self.run = "", None
        return out


class Transducer:
    """Text to little-endian 32-bit ids and back, in bounded parts."""

    def __init__(self, path: str) -> None:
        self.merges = MergeList(path)
        self.pieces, self.chunks = WordCache(CACHE_ENTRIES), WordCache(CACHE_ENTRIES)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _long_piece(self, piece: str) -> bytes:
        encoder = PieceEncoder(self.merges)
        ids = encoder.feed(piece.encode("utf-8", "replace"))
        return np.array(ids + encoder.finish(), "<u4").tobytes()

    def _short_pieces(self, pieces: list[str]) -> list[bytes]:
        return self.merges.many([p.encode("utf-8", "replace") for p in pieces])

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [[c] if IS_WHITE.match(c, len(c) - 1) else PIECE.findall(c) for c in chunks]
        needed = set().union(*cut)
        long = {p: self._long_piece(p) for p in needed if len(p) > SHORT_CHARS}
        known = self.pieces.fetch(needed - long.keys(), self._short_pieces)
        return [b"".join([long[p] if p in long else known[p] for p in ps]) for ps in cut]

    def _packed(self, found: list[list[str | bytes]]) -> list[bytes]:
        """Packed ids of lists of chunks, or of ids that are packed already; the unknown chunks of all lists are encoded together."""
        needed = set().union(*found)
        # ids that are packed already, and chunks too long to be kept
        ready = {c: c for c in needed if type(c) is bytes}
        long = {c: self._chunks([c])[0] for c in needed - ready.keys() if len(c) > CACHED_CHARS}
        known = self.chunks.fetch(needed - ready.keys() - long.keys(), self._chunks)
        if ready or long:
            known = {**{c: known[c] for c in needed - ready.keys() - long.keys()}, **ready, **long}
        return [b"".join(map(known.__getitem__, cs)) for cs in found]

    def encode(self, text: str, part_chars: int = SEGMENT_CHARS) -> Iterator[bytes]:
        """Packed ids of one text, read part by part."""
        for piece in self.cut.split(text) if self.cut and any(s in text for s in self.merges.special) else [text]:
            if piece in self.merges.special:
                yield np.array([self.merges.special[piece]], "<u4").tobytes()
                continue
            stream = TextStream(self.merges)
            for at in range(0, len(piece), part_chars):
                yield self._packed([stream.feed(piece[at : at + part_chars])])[0]
            yield self._packed([stream.finish()])[0]

    def encode_group(self, texts: list[str]) -> list[Iterator[bytes]]:
        """As :meth:`encode` for each text; texts of one part are packed together."""
        plain = [len(t) <= SEGMENT_CHARS and not any(s in t for s in self.merges.special) for t in texts]
        found = []
        for text, single in zip(texts, plain, strict=True):
            if single:
                stream = TextStream(self.merges)
                found.append([*stream.feed(text), *stream.finish()])
        packed = iter(self._packed(found))
        return [iter([next(packed)]) if p else self.encode(t) for t, p in zip(texts, plain, strict=True)]

    def decoder(self) -> Decoder:
        return Decoder(self.merges.token_bytes)


class Decoder:
    """Byte-to-text state machine: ids in, text out as soon as its bytes are complete."""

    def __init__(self, token_bytes: list[bytes]) -> None:
        self.token_bytes = token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, packed: bytes) -> str:
        return self.state.decode(b"".join(map(self.token_bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())))

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    """One per Python worker, kept across its tasks."""
    return Transducer(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 and, if asked, the packed ids and the decoded text."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(source.dtypes)["id"]
    fields = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep_ids

    def make():
        machine = transducer(tokenizer_path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, hashes, plain, kept, decodings = [], [], [], [], []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in text_groups(texts, GROUP_CHARS):
                for stream in machine.encode_group(texts[start:end]):
                    ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
                    decoder = machine.decoder()
                    parts, decoded = [], []
                    for packed in stream:
                        n += len(packed) // 4
                        ids.update(packed)
                        out = decoder.feed(packed)
                        back.update(out.encode())
                        if keep_ids:
                            parts.append(packed)
                            decoded.append(out)
                    out = decoder.finish()
                    back.update(out.encode())
                    counts.append(n)
                    hashes.append(ids.hexdigest())
                    plain.append(back.hexdigest())
                    kept.append(b"".join(parts))
                    decodings.append("".join([*decoded, out]))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(plain, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(kept, pa.binary()), pa.array(decodings, pa.string())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        return step

    return map_slices(source, make, fields)
