r"""Brown class-based bigram language model.

log P(text) = sum over tokens of log P(class | previous class) + log P(word | class).

Every training word has a class of its own, found by exchange in two steps.

*Seed.*  The ``top_words`` most frequent training words are units, all others are
grouped by their shape (last character's hash, length band) into ``shapes`` units.
Exchange clustering moves units between classes while the bigram likelihood of the
whole training corpus grows; its input is the unit-by-unit bigram table, counted
over all training texts, whose size depends on those two parameters alone.

*Words.*  In each of ``word_rounds`` rounds every training word, however rare, is
counted with the classes of its neighbours over all training texts and moves to
the class that raises the likelihood most, given the class-by-class table; words
move at the same time.  The classes of the most likely round are kept, so a round
never lowers the likelihood.  Only a word that no training text has goes by shape.

Word emissions are smoothed by half a count a word and one unknown word per
class; class transitions by interpolation with the class unigram.

Scale: word counts are summed per task before they are shuffled.  A text is not
joined with the whole vocabulary; each task cuts its texts into blocks of bounded
size and writes them once as numbers.  A block asks each part of the vocabulary
for its own distinct words in one row, and gets their places in one row, in the
order of asking, so a common word costs a few bytes a block however often it
occurs.  A round fetches classes by place, and sends back each part's counts.

Defined results: a null or empty text is the end token alone; null ids are not
held out and are learned from; repeated rows count as often as they occur; without training
rows every probability is uniform over what is unknown.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import fold_of, materialize, text_groups, words_of

#: The end of a text, which no word can equal because words hold no white space.
END = b"\n"
GROUP_CHARS = 2_000_000
FLUSH_WORDS = 300_000


def shape_of(word: bytes, top: int, shapes: int) -> int:
    """Unit of a word outside the top words."""
    band = min(len(word) // 3, 5)
    return top + (zlib.crc32(word[-3:]) * 6 + band) % shapes


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts of a column ``text``, the end token included."""

    def run(batches):
        counts: Counter = Counter()

        def flush():
            words = list(counts)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([counts[w] for w in words], pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                counts[END] += 1
                if len(counts) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class BrownModel:
    """Classes of units, class transitions and totals; sized by parameters only."""

    top: list[bytes]
    shapes: int
    class_of: np.ndarray
    log_move: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    total: int
    types: int

    def __post_init__(self) -> None:
        self.unit = {w: k for k, w in enumerate(self.top)}

    def class_of_word(self, word: bytes) -> int:
        k = self.unit.get(word)
        return int(self.class_of[shape_of(word, len(self.top), self.shapes) if k is None else k])


def unit_bigrams(texts: DataFrame, top: list[bytes], shapes: int) -> np.ndarray:
    """Counts of adjacent units over all texts, ends before and after each text."""
    n_units = len(top) + shapes

    def run(batches):
        class Units(dict):
            def __missing__(self, word):
                value = self[word] = shape_of(word, len(top), shapes)
                return value

        known, total = Units(zip(top, range(len(top)), strict=True)), np.zeros(n_units * n_units, np.int64)
        end = known[END]
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in text_groups(texts, GROUP_CHARS):
                flat = [end]
                for text in texts[a:b]:
                    flat.extend(map(known.__getitem__, words_of(text)))
                    flat.append(end)
                x = np.array(flat, np.int64)
                total += np.bincount(x[:-1] * n_units + x[1:], minlength=n_units * n_units)
            if len(known) > FLUSH_WORDS:
                known = Units(zip(top, range(len(top)), strict=True))
                end = known[END]
        where = np.flatnonzero(total)
        for s in range(0, len(where), 10_000):
            part = where[s : s + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["pair", "n"])

    summed = texts.select("text").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(n_units * n_units, np.int64)
    # at most n_units ** 2 rows, whatever the corpus
    got = summed.toPandas()
    out[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out.reshape(n_units, n_units)


def exchange(bigrams: np.ndarray, classes: int, rounds: int = 6) -> np.ndarray:
    """Classes of units by the exchange algorithm.

    Starts with units dealt to classes by rank and moves each unit, most frequent
    first, to the class that raises sum N(c,d) log N(c,d) - sum N(c) log N(c)
    (left and right) most, until a round moves nothing.
    """
    n = len(bigrams)
    count = bigrams.sum(1) + bigrams.sum(0)
    order = np.argsort(-count, kind="stable")
    cls = np.empty(n, np.int64)
    cls[order] = np.arange(n) % classes
    member = np.zeros((n, classes), np.int64)
    member[np.arange(n), cls] = 1
    right, left = bigrams @ member, bigrams.T @ member  # unit x class counts, after and before it
    joint = member.T @ right
    log = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    out_total, in_total = joint.sum(1), joint.sum(0)
    for _ in range(rounds):
        moved = 0
        for w in order.tolist():
            if not count[w]:
                continue
            c, self_loop = cls[w], bigrams[w, w]
            r, l_ = right[w], left[w]  # by current classes; w itself counts within c
            joint[c] -= r
            joint[:, c] -= l_
            joint[c, c] += self_loop
            out_total[c] -= r.sum()
            in_total[c] -= l_.sum()
            r0, l0 = r.copy(), l_.copy()
            r0[c] -= self_loop
            l0[c] -= self_loop
            # gain of joining class d: row d gains r0, column d gains l0, cell (d, d) gains both and the loop
            used_r, used_l = np.flatnonzero(r0), np.flatnonzero(l0)
            rows = (log(joint[:, used_r] + r0[used_r]) - log(joint[:, used_r])).sum(1)
            cols = (log(joint[used_l, :] + l0[used_l][:, None]) - log(joint[used_l, :])).sum(0)
            d = np.arange(classes)
            diagonal = joint[d, d]
            both = log(diagonal + r0 + l0 + self_loop) - log(diagonal)
            once = log(diagonal + r0) - log(diagonal) + log(diagonal + l0) - log(diagonal)
            totals = log(out_total + r.sum()) - log(out_total) + log(in_total + l_.sum()) - log(in_total)
            gain = rows + cols + both - once - totals
            best = int(gain.argmax())
            if gain[best] <= gain[c] + 1e-9:
                best = c
            joint[best] += r0
            joint[:, best] += l0
            joint[best, best] += self_loop
            out_total[best] += r.sum()
            in_total[best] += l_.sum()
            if best != c:
                moved += 1
                cls[w] = best
                right[:, c] -= bigrams[:, w]
                right[:, best] += bigrams[:, w]
                left[:, c] -= bigrams[w]
                left[:, best] += bigrams[w]
        if not moved:
            break
    return cls


def transitions(joint: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each class and class transitions from the class-by-class table."""
    joint = joint.astype(float)
    tokens = joint.sum(0)
    base = (tokens + 0.5) / (tokens + 0.5).sum()
    return tokens, (joint + prior * base) / (joint.sum(1, keepdims=True) + prior)


def train(texts: DataFrame, counts: DataFrame, classes: int, top_words: int, shapes: int, rounds: int, prior: float) -> BrownModel:
    """The seed model of all ``texts``, with classes by unit; ``counts`` are their :func:`word_counts`."""
    totals = counts.agg(F.sum("n").alias("total"), F.count("*").alias("types")).first()
    best = counts.where(F.col("word") != F.lit(END)).orderBy(F.desc("n"), "word").limit(top_words)
    top = [END, *[bytes(r["word"]) for r in best.collect()]]
    bigrams = unit_bigrams(texts, top, shapes)
    cls = exchange(bigrams, classes, rounds)
    member = np.zeros((len(cls), classes), np.int64)
    member[np.arange(len(cls)), cls] = 1
    tokens, move = transitions(member.T @ bigrams @ member, prior)
    model = BrownModel(top, shapes, cls, np.log10(move), tokens, np.zeros(classes), totals["total"] or 0, totals["types"] or 0)
    # distinct words by class, counted by unit on the executors; at most top_words + shapes rows
    n_top = len(top)

    def units(batches):
        for batch in batches:
            found = Counter(u for w in batch.column(0).to_pylist() if (u := model.unit.get(w, -1)) < 0 and (u := shape_of(w, n_top, shapes)) >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["unit", "types"])

    for row in counts.select("word").mapInArrow(units, "unit long, types long").groupBy("unit").agg(F.sum("types").alias("types")).collect():
        model.class_types[cls[row["unit"]]] += row["types"]
    if model.types:
        np.add.at(model.class_types, cls[:n_top], 1)
    return model


def likelihood(joint: np.ndarray) -> float:
    """What exchange raises: sum N(c,d) log N(c,d) - sum N(c) log N(c), left and right."""
    return float(xlogx(joint).sum() - xlogx(joint.sum(1)).sum() - xlogx(joint.sum(0)).sum())


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(keys: np.ndarray, counts: np.ndarray, cls: np.ndarray, joint: np.ndarray, chunk: int = 4000) -> np.ndarray:
    """The best class of each word, all others staying where they are.

    A key is ``word * (2 * classes + 1) + feature``, in order and without repeats;
    feature d counts next words of class d, ``classes + d`` words before of class d,
    and the last one the word next to itself.  The gain is that of :func:`exchange`.
    """
    n_classes, out = len(joint), cls.copy()
    word, feature = np.divmod(keys, 2 * n_classes + 1)
    joint = joint.astype(float)
    out_total, in_total, every = joint.sum(1), joint.sum(0), np.arange(n_classes)
    for first in range(0, len(cls), chunk):
        a, b = np.searchsorted(word, [first, first + chunk])
        w, f, x = word[a:b] - first, feature[a:b], counts[a:b].astype(float)
        c = cls[first : first + chunk].astype(np.int64)
        n, rows = len(c), np.arange(len(c))
        loop = np.zeros(n)
        loop[w[f == 2 * n_classes]] = x[f == 2 * n_classes]
        both_sides = np.zeros((2, n, n_classes))
        usual = f < 2 * n_classes
        both_sides[f[usual] // n_classes, w[usual], f[usual] % n_classes] = x[usual]
        right, left = both_sides
        gain = np.zeros((n, n_classes))
        for side, own, other, table in ((0, right, left, joint.T), (1, left, right, joint)):
            pick = np.flatnonzero(usual & (f // n_classes == side))
            if not len(pick):
                continue
            ew, ek, ex = w[pick], f[pick] % n_classes, x[pick]
            # row: this neighbour class with each class, the word itself taken out
            rest = table[ek]
            rest[np.arange(len(pick)), c[ew]] -= ex
            home = np.flatnonzero(ek == c[ew])
            rest[home] -= other[ew[home]]
            rest[home, ek[home]] += loop[ew[home]]
            ex = ex.copy()
            ex[home] -= loop[ew[home]]
            part = xlogx(rest + ex[:, None]) - xlogx(rest)
            starts = np.flatnonzero(np.r_[True, ew[1:] != ew[:-1]])
            gain[ew[starts]] += np.add.reduceat(part, starts)
        r0, l0, s = right.copy(), left.copy(), loop[:, None]
        r0[rows, c] -= loop
        l0[rows, c] -= loop
        diagonal = np.repeat(joint[every, every][None], n, 0)
        diagonal[rows, c] -= right[rows, c] + left[rows, c] - loop
        gain += xlogx(diagonal + r0 + l0 + s) + xlogx(diagonal) - xlogx(diagonal + r0) - xlogx(diagonal + l0)
        for total, mine in ((out_total, right.sum(1)), (in_total, left.sum(1))):
            rest = np.repeat(total[None], n, 0)
            rest[rows, c] -= mine
            gain -= xlogx(rest + mine[:, None]) - xlogx(rest)
        best = gain.argmax(1)
        out[first : first + chunk] = np.where(gain[rows, best] > gain[rows, c] + 1e-9, best, c)
    return out


def blob_sum(blobs: DataFrame, size: int) -> np.ndarray:
    """Sum of arrays of ``size`` whole numbers over the rows of (key, blob); at most 32 of them go to the driver."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"blob": [sum(np.frombuffer(b, "<i8") for b in frame["blob"]).tobytes()]})

    got = blobs.groupBy(F.pmod("key", F.lit(32))).applyInPandas(add, "blob binary").collect()
    return sum((np.frombuffer(r["blob"], "<i8") for r in got), np.zeros(size, np.int64))


def pack(x: np.ndarray, kind: str, steps: bool = False) -> bytes:
    """An array compressed, by steps from one value to the next where these are small."""
    raw = (np.diff(x, prepend=0) if steps else x).astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(blob: bytes, kind: str, steps: bool = False) -> np.ndarray:
    x = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True), kind)
    return np.cumsum(x) if steps else x


def encode(rows: DataFrame, block_chars: int, n_parts: int, kind: str) -> DataFrame:
    """Texts as numbers, in blocks of about ``block_chars`` characters that a task cuts from its own rows.

    A block has a row for each text (part -2: where its tokens start and how many they
    are), one for all its tokens (part -1: those of texts not held out come first, and
    ``size`` counts them), and one for its distinct words of each part.  In a block 0
    is the end token; words are numbered from 1, part by part.
    """
    schema = f"block long, part int, words binary, id {kind}, held boolean, start int, size int, tokens binary"

    def block_rows(block: int, ids: list, held: list, texts: list) -> list[tuple]:
        lists = [words_of(t) for t in texts]
        parts: dict[int, list[bytes]] = {}
        for word in sorted(set().union(*lists)):
            parts.setdefault(zlib.crc32(word) % n_parts, []).append(word)
        number = {END: 0}
        for part in sorted(parts):
            number.update(zip(parts[part], range(len(number), len(number) + len(parts[part])), strict=True))
        flat, out = [], []
        for last in (False, True):
            for i, h, words in zip(ids, held, lists, strict=True):
                if h == last:
                    out.append((block, -2, None, i, h, len(flat), len(words) + 1, None))
                    flat.extend(map(number.__getitem__, words))
                    flat.append(0)
            if not last:
                learned = len(flat)
        out.append((block, -1, None, None, None, 0, learned, pack(np.array(flat, np.int64), "<i4")))
        out += [(block, part, b"\n".join(words), None, None, None, None, None) for part, words in parts.items()]
        return list(zip(*out, strict=True))

    def run(batches):
        block, kept, chars = TaskContext.get().partitionId() << 32, ([], [], []), 0
        types = None

        def flush():
            nonlocal block, kept, chars
            columns = block_rows(block, *kept)
            block, kept, chars = block + 1, ([], [], []), 0
            for s in range(0, len(columns[0]), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(c[s : s + 2000], t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            types = types or [pa.int64(), pa.int32(), pa.binary(), batch.column(0).type, pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 2, 1)), strict=True):
                for column, value in zip(kept, row, strict=True):
                    column.append(value)
                chars += len(row[2] or "")
                if chars >= block_chars:
                    yield from flush()
        if kept[0]:
            yield from flush()

    return rows.select("id", "text", "held").mapInArrow(run, schema)


def place(coded: DataFrame, counts: DataFrame, seed: BrownModel, n_parts: int) -> DataFrame:
    """The vocabulary by part (block null: counts and seed classes, in order of words), and the place in it of each word that a block asks for.

    A word that isn't in the vocabulary has the place ``-1 - class``.
    """

    def run(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        n_of = dict(zip(map(bytes, known["word"]), known["n"].tolist(), strict=True))
        words = sorted(n_of)
        at = dict(zip(words, range(len(words)), strict=True))
        out = []
        for block, blob in zip(asks["block"], asks["words"], strict=True):
            found = [k if (k := at.get(w)) is not None else -1 - seed.class_of_word(w) for w in bytes(blob).split(b"\n")]
            out.append((block, asks["part"].iloc[0], pack(np.array(found), "<i4", True), None, None))
        if words:
            cls = np.array([seed.class_of_word(w) for w in words])
            out.append((None, known["part"].iloc[0], None, pack(np.array([n_of[w] for w in words]), "<i8"), pack(cls, "<i2")))
        return pd.DataFrame(out, columns=["block", "part", "places", "n", "cls"], dtype=object)

    asks = coded.where("part >= 0").select("block", "part", "words")
    vocabulary = counts.where(F.col("word") != F.lit(END)).select(F.pmod(F.crc32("word"), F.lit(n_parts)).cast("int").alias("part"), "word", "n")
    return asks.groupBy("part").cogroup(vocabulary.groupBy("part")).applyInPandas(run, "block long, part int, places binary, n binary, cls binary")


def answers(places: DataFrame, vocabulary: DataFrame, counted: bool = False) -> DataFrame:
    """Classes of each block's words, and their counts or else their places."""

    def run(asks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        n, cls = (unpack(known["n"].iloc[0], "<i8"), unpack(known["cls"].iloc[0], "<i2")) if len(known) else (np.zeros(1, "<i8"), np.zeros(1, "<i2"))
        out = []
        for block, blob in zip(asks["block"], asks["places"], strict=True):
            p = unpack(blob, "<i4", True)
            at = np.maximum(p, 0)
            out.append((block, asks["part"].iloc[0], None if counted else blob, pack(np.where(p >= 0, n[at], 0), "<i8") if counted else None, pack(np.where(p >= 0, cls[at], -1 - p), "<i2")))
        return pd.DataFrame(out, columns=["block", "part", "places", "n", "cls"], dtype=object)

    return places.groupBy("part").cogroup(vocabulary.groupBy("part")).applyInPandas(run, "block long, part int, places binary, n binary, cls binary")


def tally(coded: DataFrame, answered: DataFrame, end_class: int, classes: int, features: bool) -> DataFrame:
    """Of each block its class bigrams (part -1), and of each part the words' counts with their neighbours' classes."""
    width = 2 * classes + 1

    def run(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = ["block", "part", "keys", "counts"]
        if not len(docs):
            return pd.DataFrame([], columns=columns)
        known = known.sort_values("part")
        block, asked = docs["block"].iloc[0], [unpack(b, "<i4", True) for b in known["places"]]
        cls = np.concatenate([[end_class], *(unpack(b, "<i2") for b in known["cls"])]).astype(np.int64)
        x = np.concatenate([[0], unpack(docs["tokens"].iloc[0], "<i4")[: docs["size"].iloc[0]]]).astype(np.int64)
        a, b = x[:-1], x[1:]
        joint = np.bincount(cls[a] * classes + cls[b], minlength=classes * classes)
        out = [(block, -1, None, joint.astype("<i8").tobytes())]
        if features:
            keys = np.concatenate([a * width + cls[b], b * width + classes + cls[a], a[a == b] * width + 2 * classes])
            keys, n = np.unique(keys[keys >= width], return_counts=True)
            bounds = np.searchsorted(keys, np.cumsum([1, *map(len, asked)]) * width)
            start = 1
            for part, p, i, j in zip(known["part"], asked, bounds[:-1], bounds[1:], strict=True):
                word, feature = np.divmod(keys[i:j], width)
                if i < j:
                    out.append((block, part, pack(p[word - start].astype(np.int64) * width + feature, "<i4", True), pack(n[i:j], "<i4")))
                start += len(p)
        return pd.DataFrame(out, columns=columns)

    return coded.where("part = -1").select("block", "size", "tokens").groupBy("block").cogroup(answered.groupBy("block")).applyInPandas(run, "block long, part int, keys binary, counts binary")


def moved(tallied: DataFrame, vocabulary: DataFrame, joint: np.ndarray) -> DataFrame:
    """The vocabulary with every word in its best class."""

    def run(seen: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(known) or not len(seen):
            return known[["part", "n", "cls"]]
        keys = np.concatenate([unpack(b, "<i4", True) for b in seen["keys"]])
        keys, back = np.unique(keys, return_inverse=True)
        counts = np.bincount(back, np.concatenate([unpack(b, "<i4") for b in seen["counts"]]))
        cls = best_classes(keys, counts, unpack(known["cls"].iloc[0], "<i2"), joint)
        return known[["part", "n"]].assign(cls=[pack(cls, "<i2")])

    return tallied.where("part >= 0").groupBy("part").cogroup(vocabulary.groupBy("part")).applyInPandas(run, "part int, n binary, cls binary")


def refine(coded: DataFrame, placed: DataFrame, seed: BrownModel, word_rounds: int, prior: float) -> tuple[BrownModel, DataFrame, list[float]]:
    """The model with a class for every word, the vocabulary with these classes, and the likelihood of each round."""
    classes, end_class = len(seed.class_tokens), int(seed.class_of[0])
    places = placed.where("block is not null").select("block", "part", "places")
    vocabulary = placed.where("block is null").select("part", "n", "cls")
    values, joint, kept = [], np.zeros((classes, classes), np.int64), vocabulary
    for k in range(word_rounds + 1):
        tallied = materialize(tally(coded, answers(places, vocabulary), end_class, classes, k < word_rounds), "class-tally")
        now = blob_sum(tallied.where("part = -1").select(F.col("block").alias("key"), F.col("counts").alias("blob")), classes * classes).reshape(classes, classes)
        values.append(likelihood(now))
        # words that move together can lower the likelihood; such a round is not kept
        if k and values[-1] <= max(values[:-1]):
            break
        joint, kept = now, vocabulary
        if k < word_rounds:
            vocabulary = materialize(moved(tallied, vocabulary, now), "word-classes")

    def types(frames):
        for frame in frames:
            yield pd.DataFrame({"key": frame["part"], "blob": [np.bincount(unpack(b, "<i2"), minlength=classes).astype("<i8").tobytes() for b in frame["cls"]]})

    class_types = blob_sum(kept.select("part", "cls").mapInPandas(types, "key int, blob binary"), classes).astype(float)
    class_types[end_class] += 1 if seed.types else 0
    tokens, move = transitions(joint, prior)
    return BrownModel(seed.top, seed.shapes, seed.class_of, np.log10(move), tokens, class_types, seed.total, seed.types), kept, values


def score(
    docs: DataFrame,
    folds: int = 5,
    held_fold: int = 1,
    classes: int = 48,
    top_words: int = 1000,
    shapes: int = 300,
    rounds: int = 6,
    prior: float = 20.0,
    block_chars: int = 6_000_000,
    word_rounds: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity."""
    kind = dict(docs.dtypes)[id_col]
    held = F.coalesce(fold_of(F.col(id_col), folds) == held_fold, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), held.alias("held"))
    learned = rows.where(~F.col("held"))
    counts = materialize(word_counts(learned), "word-counts")
    seed = train(learned, counts, classes, top_words, shapes, rounds, prior)
    chars = rows.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    n_blocks = int(chars // block_chars) + 1
    # as many parts of the vocabulary that a part's words, and what blocks ask of it, stay small
    n_parts = max(seed.types // 50_000, n_blocks // 2) + 1
    coded = materialize(encode(rows, block_chars, n_parts, kind), "coded-texts")
    placed = materialize(place(coded, counts, seed, n_parts), "word-places")
    model, vocabulary, _ = refine(coded, placed, seed, word_rounds, prior)
    n_end = counts.where(F.col("word") == F.lit(END)).first()
    n_end = n_end["n"] if n_end else 0
    end_class = int(model.class_of[0])
    base_bottom = model.total + 0.5 * (model.types + 1)
    bottom = model.class_tokens + 0.5 * (model.class_types + 1)
    log_move, train_tokens = model.log_move, model.total
    schema = f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def judge(texts: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("part")
        count = np.concatenate([[n_end], *(unpack(b, "<i8") for b in known["n"])]).astype(float)
        cls = np.concatenate([[end_class], *(unpack(b, "<i2") for b in known["cls"])]).astype(np.int64)
        base = np.log10((count + 0.5) / base_bottom)
        emit = np.log10((count + 0.5) / bottom[cls])
        all_tokens = unpack(texts.loc[texts["part"] == -1, "tokens"].iloc[0], "<i4")
        texts = texts[texts["part"] == -2]
        out = []
        for i, held_out, start, size in zip(texts["id"], texts["held"], texts["start"], texts["size"], strict=True):
            w = all_tokens[start : start + size]
            c = cls[w]
            before = np.concatenate([[cls[0]], c[:-1]])
            total = float(log_move[before, c].sum() + emit[w].sum())
            out.append((i, held_out, len(w), int((count[w] > 0).sum()), train_tokens, float(base[w].sum()), total, 10.0 ** min(-total / len(w), 300.0)))
        return pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    found = answers(placed.where("block is not null").select("block", "part", "places"), vocabulary, True)
    # a null among whole numbers would make pandas turn ids into floats, so ids travel as text
    texts = coded.where("part < 0").select("block", "part", F.col("id").cast("string").alias("id"), "held", "start", "size", "tokens")
    judged = texts.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(judge, schema.replace(f"{id_col} {kind}", f"{id_col} string", 1))
    return judged.withColumn(id_col, F.col(id_col).cast(kind))
