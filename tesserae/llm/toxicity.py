r"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two strings counts their common subsequences of up to ``order``
characters, each weighted by ``decay`` to the power of the stretch it spans in
either string, so letters put in between or left out weaken a match but don't
break it.  Nyström landmarks turn it into a linear model: a word's features are
its kernels with the landmarks, whitened by the landmarks' own kernel matrix.

A text is toxic for its worst word (runs of single letters also count as one
word), which is multiple-instance learning: in each toxic training text the
worst word so far is the positive example, all words of the others are negative
ones, and hard negatives are added round by round.  A logistic curve fitted on
the training texts turns the worst word's margin into a score from 0 to 1.

The classifier is fitted on a bounded sample (``sample`` toxic texts, three times
as many others, all words of each; copies of a text share one text's weight).
Scoring covers every word of every text, against every landmark.  Words are scored
once while they stay in a bounded cache.

Defined results: null and empty texts score as a word without any landmark in
it; null ids are not held out; repeated rows give repeated results; without
labelled texts of both classes every text scores 0.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import WordCache, fold_of, map_slices, text_groups

GROUP_CHARS = 1_000_000
CACHE_ENTRIES = 150_000
#: Longest string that is scored as one; longer words are scored by windows of this size.
MAX_WORD = 12
#: ASCII other than letters, digits and white space is taken out of words.
PUNCTUATION = bytes(b for b in range(0x80) if not chr(b).isalnum() and b not in b" \t\n\r\x0b\x0c")
SPELLED = re.compile(rb"(?<!\S)\w(?:\s+\w){2,}(?!\S)")
GAPS = np.zeros(256, bool)
GAPS[list(b" \t\n\r\x0b\x0c")] = True


def plain(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower().translate(None, PUNCTUATION)


def toxic_words(text: str | None) -> list[bytes]:
    """Words without punctuation, and runs of spelled letters joined."""
    words = plain(text).split()
    # one space between words, whatever stood there and what punctuation left
    data = b" ".join(words)
    b = np.frombuffer(data, np.uint8)
    if len(b) >= 5:
        gap = np.concatenate([[True], GAPS[b], [True]])
        lone = ~gap[1:-1] & gap[:-2] & gap[2:]
        if (lone[:-4] & lone[2:-2] & lone[4:]).any():
            words += [re.sub(rb"\s+", b"", m) for m in SPELLED.findall(data)]
    return words


def windows(word: bytes) -> list[str]:
    """A word as strings of at most MAX_WORD characters, overlapping by half where it is longer."""
    s = word.decode("utf-8", "replace")
    step = MAX_WORD // 2
    return [s] if len(s) <= MAX_WORD else [s[k : k + MAX_WORD] for k in range(0, len(s) - step, step)]


def codes(strings: list[str], width: int) -> np.ndarray:
    raw = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "replace"), np.uint32)
    return raw.reshape(len(strings), width)


def _pairs(source: np.ndarray, target: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Kernel of each row of ``source`` with the same row of ``target``; the padding of the two must differ."""
    # axes: position in word, position in mark, pair
    same = (source.T[:, None] == target.T[None]).astype(np.float32)
    level = same * np.float32(decay * decay)
    total = np.zeros(len(source), np.float32)
    for length in range(2, order + 1):
        reach = level
        for i in range(1, len(same)):
            reach[i] += decay * reach[i - 1]
        for j in range(1, same.shape[1]):
            reach[:, j] += decay * reach[:, j - 1]
        level = np.zeros_like(same)
        level[1:, 1:] = same[1:, 1:] * reach[:-1, :-1] * np.float32(decay * decay)
        total += level.sum((0, 1)) * np.float32(decay ** (-2 * length))
    return total


def kernels(words: list[str], marks: list[str], order: int, decay: float) -> np.ndarray:
    """Sum over lengths 2..order of the gap-weighted subsequence kernel, words x marks."""
    out = np.zeros((len(words), len(marks)), np.float32)
    if not words or not marks:
        return out
    m = max(map(len, marks))
    target = codes(marks, m)
    target = np.where(target == 0, np.uint32(0xFFFFFFFF), target)
    for width, members in by_width(words).items():
        table = codes([words[k] for k in members], width)
        which, mark = np.divmod(np.arange(len(members) * len(marks)), len(marks))
        block = max(16, 200_000 // (width * m))
        rows = np.array(members)
        for s in range(0, len(which), block):
            pick, to = which[s : s + block], mark[s : s + block]
            out[rows[pick], to] = _pairs(table[pick], target[to], order, decay)
    return out


def by_width(words: list[str]) -> dict[int, list[int]]:
    """Places of words by their length, rounded up."""
    found: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        found.setdefault(max(4, -(-len(w) // 3) * 3), []).append(k)
    return found


def own_kernels(words: list[str], order: int, decay: float) -> np.ndarray:
    """Kernel of each word with itself."""
    out = np.ones(len(words), np.float32)
    for width, members in by_width(words).items():
        for s in range(0, len(members), block := max(16, 200_000 // (width * width))):
            rows = members[s : s + block]
            table = codes([words[k] for k in rows], width)
            out[rows] = np.maximum(_pairs(table, np.where(table == 0, np.uint32(0xFFFFFFFF), table), order, decay), 1e-6)
    return out


class SubsequenceWeights:
    """Weighted sums of a word's kernels with all landmarks at once, by way of the subsequences they share.

    The kernel is the inner product of two strings' subsequence weights, so a
    weighted sum of landmarks is one weight for each subsequence of two or three
    characters that some landmark has.  The sums are those of :func:`kernels`.
    """

    def __init__(self, marks: list[str], order: int, decay: float, columns: np.ndarray) -> None:
        if order not in (2, 3):
            raise ValueError("subsequences of two or three characters only")
        self.decay = decay
        alphabet = sorted({c for m in marks for c in m})
        # characters, pairs and triples that no landmark has are number 0, whose weight is 0
        self.letters = np.array([ord(c) for c in alphabet], np.uint32)
        number = {c: k for k, c in enumerate(alphabet, 1)}
        pairs: dict[tuple[int, int], int] = {}
        weight: dict[tuple[int, ...], np.ndarray] = {}
        for mark, column in zip(marks, columns, strict=True):
            c = [number[x] for x in mark]
            for n in range(2, order + 1):
                for at in combinations(range(len(c)), n):
                    key = tuple(c[i] for i in at)
                    pairs.setdefault(key[:2], len(pairs) + 1)
                    weight[key] = weight.get(key, 0) + decay ** (at[-1] - at[0] + 1 - n) * column
        size, n_columns = len(alphabet) + 1, columns.shape[1]
        self.pair = np.zeros((size, size), np.int32)
        self.of_pair = np.zeros((len(pairs) + 1, n_columns), np.float32)
        self.of_triple = np.zeros((len(pairs) + 1, size, n_columns), np.float32)
        for (a, b), k in pairs.items():
            self.pair[a, b] = k
        for key, value in weight.items():
            k = pairs[key[:2]]
            if len(key) == 2:
                self.of_pair[k] = value
            else:
                self.of_triple[k, key[2]] = value

    def sums(self, words: list[str]) -> np.ndarray:
        """One row a word, one column a weighting."""
        out = np.zeros((len(words), self.of_pair.shape[1]), np.float32)
        for width, members in by_width(words).items():
            for s in range(0, len(members), 8192):
                rows = members[s : s + 8192]
                raw = codes([words[k] for k in rows], width)
                at = np.minimum(np.searchsorted(self.letters, raw), len(self.letters) - 1)
                c = np.where(self.letters[at] == raw, at + 1, 0).T
                total = np.zeros((len(rows), out.shape[1]), np.float32)
                for i in range(width - 1):
                    for j in range(i + 1, width):
                        pair = self.pair[c[i], c[j]]
                        some = np.flatnonzero(pair)
                        if not len(some):
                            continue
                        pair = pair[some]
                        part = self.of_pair[pair] * np.float32(self.decay ** (j - i - 1))
                        for k in range(j + 1, width):
                            part += self.of_triple[pair, c[k, some]] * np.float32(self.decay ** (k - i - 2))
                        total[some] += part
                out[rows] = total
        return out


def variants(word: str, n: int, rng: np.random.Generator) -> list[str]:
    """The word with a letter put in, doubled, left out or replaced, past its first one."""
    out = []
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    for k in range(n):
        at = int(rng.integers(1, max(2, len(word) - 1)))
        new = letters[int(rng.integers(len(letters)))]
        out.append([word[:at] + new + word[at:], word[:at] + word[at : at + 1] * 2 + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + new + word[at + 1 :]][k % 4])
    return out


@dataclass
class ToxicityModel:
    """Landmarks, whitening, weights and the logistic curve.

    Features are Nyström features of the normalised subsequence kernel raised to
    ``power``, which is a kernel as well and tells near from far more sharply.
    """

    marks: list[str]
    order: int
    decay: float
    power: int
    own: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    @classmethod
    def blank(cls) -> ToxicityModel:
        return cls([], 3, 0.5, 1, np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0.0, 0.0, 0.0)

    def subsequences(self) -> SubsequenceWeights:
        """The landmarks' normalised subsequence weights, a column each."""
        return SubsequenceWeights(self.marks, self.order, self.decay, np.diag(1 / np.sqrt(self.own)).astype(np.float32))

    def features(self, words: list[str], shared: SubsequenceWeights | None = None) -> np.ndarray:
        """Nyström features, one row a word."""
        shared, out = shared or self.subsequences(), np.empty((len(words), len(self.marks)), np.float32)
        for s in range(0, len(words), 8192):
            part = words[s : s + 8192]
            alike = shared.sums(part) / np.sqrt(own_kernels(part, self.order, self.decay))[:, None]
            out[s : s + 8192] = alike**self.power @ self.whiten
        return out

    def window_margins(self, words: list[str], shared: SubsequenceWeights | None = None) -> np.ndarray:
        return self.features(words, shared) @ self.weights.astype(np.float32) + self.bias

    def margins(self, words: list[bytes], shared: SubsequenceWeights | None = None) -> list[float]:
        """Margin of each word; of a long one, its worst window."""
        if not self.marks:
            return [0.0] * len(words)
        parts, owner = [], []
        for k, word in enumerate(words):
            for w in windows(word):
                parts.append(w)
                owner.append(k)
        shared, best = shared or self.subsequences(), np.full(len(words), -np.inf)
        for s in range(0, len(parts), 50_000):
            np.maximum.at(best, np.array(owner[s : s + 50_000]), self.window_margins(parts[s : s + 50_000], shared))
        return best.tolist()

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))) if self.marks else 0.0


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 25, chunk: int = 4096) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps on the active set; the last weight is the bias."""
    n = x.shape[1] + 1
    w = np.zeros(n)
    penalty = np.full(n, ridge)
    penalty[-1] = 1e-3
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        left, right = np.diag(penalty), np.zeros(n)
        for s in range(0, len(y), chunk):
            pick = np.flatnonzero(active[s : s + chunk]) + s
            xa = np.concatenate([x[pick].astype(float), np.ones((len(pick), 1))], 1)
            left += xa.T @ (xa * weight[pick][:, None])
            right += xa.T @ (weight[pick] * y[pick])
        w = np.linalg.solve(left, right)
        now = y * np.concatenate([x[s : s + chunk].astype(np.float32) @ w[:-1].astype(np.float32) + np.float32(w[-1]) for s in range(0, len(y), chunk)]) < 1
        if (now == active).all():
            break
        active = now
    return w


def logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with targets kept off 0 and 1."""
    target = np.where(label == 1, 1 - 1 / ((weight * label).sum() + 2), 1 / ((weight * (1 - label)).sum() + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * (p * (1 - p) + 1e-6))[:, None]) + 1e-3 * np.eye(2), x.T @ (weight * (target - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


@dataclass
class Bags:
    """Training texts as sets of numbered words: word numbers text by text, and where each text ends.

    Copies of a text share the weight of one.
    """

    vocabulary: pa.StringArray
    words: np.ndarray
    ends: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, texts: pa.ListArray, toxic: np.ndarray, group: np.ndarray | None = None) -> Bags:
        """``group`` numbers the texts that are copies of each other alike."""
        weight = np.ones(len(toxic))
        if group is not None:
            _, back, size = np.unique(group.astype(np.int64) * 2 + toxic, return_inverse=True, return_counts=True)
            weight = 1 / size[back]
        coded = texts.flatten().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        place = np.empty(len(order), np.int32)
        place[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
        sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
        return cls(coded.dictionary.take(order), place[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(sizes), toxic, weight)

    def __post_init__(self) -> None:
        self.owner = np.repeat(np.arange(len(self.ends), dtype=np.int32), np.diff(self.ends, prepend=0))

    def texts_with(self, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each of ``size`` things, the weight of toxic and other texts that have it; ``number`` is the thing of each word, or -1."""
        thing = number[self.words]
        key = self.owner[thing >= 0] * np.int64(size) + thing[thing >= 0]
        key.sort()
        owner, thing = np.divmod(key[np.diff(key, prepend=-1) > 0], size)
        toxic, weight = self.toxic[owner], self.weight[owner]
        return np.bincount(thing[toxic], weight[toxic], size), np.bincount(thing[~toxic], weight[~toxic], size)

    def strings(self, places) -> list[str]:
        return self.vocabulary.take(pa.array(places)).to_pylist()

    def worst(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The highest score of each text with words, and the place of a word that has it."""
        filled = np.flatnonzero(np.diff(self.ends, prepend=0))
        starts = (np.concatenate([[0], self.ends[:-1]]))[filled]
        value = score[self.words]
        top = np.maximum.reduceat(value, starts)
        at = np.where(value == np.repeat(top, np.diff(np.append(starts, len(value)))), np.arange(len(value)), len(value))
        return filled, self.words[np.minimum.reduceat(at, starts)]


def choose_landmarks(bags: Bags, n_toxic: int, n_plain: int, order: int, decay: float, evidence: float = 20.0) -> list[str]:
    """Strings that tell the classes apart (words and their beginnings), unlike each other, and some common words.

    A string tells the classes apart where the likelihood ratio of its texts,
    doubled, is over ``evidence``, however rare it is beside the others.
    """
    n_pos, n_neg = bags.weight[bags.toxic].sum(), bags.weight[~bags.toxic].sum()
    lengths = pc.utf8_length(bags.vocabulary).to_numpy(zero_copy_only=False)
    found: list[tuple[float, str]] = []
    common: Counter = Counter()
    for k in range(3, 9):
        # three characters as whole words only
        whole = lengths >= k if k > 3 else lengths == k
        coded = pc.utf8_slice_codeunits(bags.vocabulary, 0, k).dictionary_encode()
        number = np.where(whole, coded.indices.to_numpy(zero_copy_only=False), -1)
        size = len(coded.dictionary)
        a, b = bags.texts_with(number, size)
        p, q = a / n_pos, b / n_neg
        both = (a + b) / (n_pos + n_neg)
        gain = 2 * (a * np.log(np.maximum(p, 1e-300) / np.maximum(both, 1e-300)) + b * np.log(np.maximum(q, 1e-300) / np.maximum(both, 1e-300)))
        telling = np.flatnonzero((a >= 3) & (p > 2 * q) & (gain > evidence))
        found += zip((gain * (1 + 0.02 * k))[telling].tolist(), coded.dictionary.take(pa.array(telling)).to_pylist(), strict=True)
        often = np.argsort(-b, kind="stable")[: 4 * n_plain]
        common.update(dict(zip(coded.dictionary.take(pa.array(often)).to_pylist(), b[often].tolist(), strict=True)))
    chosen: list[str] = []
    for _, w in sorted(found, key=lambda x: (-x[0], x[1])):
        if len(chosen) >= n_toxic:
            break
        if chosen:
            # neither alike nor one within the other
            k = kernels([w], chosen, order, decay)[0] / np.minimum(own_kernels(chosen, order, decay), own_kernels([w], order, decay)[0])
            if k.max() > 0.6:
                continue
        chosen.append(w)
    plain = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0])) if w not in chosen]
    return chosen + plain[:n_plain] if chosen else []


def fit_bags(bags: Bags, order: int = 3, decay: float = 0.5, power: int = 2, n_toxic: int = 64, n_plain: int = 4, rounds: int = 4, negatives: int = 20_000, disguised: float = 1.0, ridge: float = 1.0) -> ToxicityModel:
    """Fit on the distinct words of toxic and other texts.

    The words' features are held in half precision, so that the driver needs some
    tens of megabytes for them.
    """
    marks = choose_landmarks(bags, n_toxic, n_plain, order, decay)
    if not marks:
        return ToxicityModel.blank()
    own = own_kernels(marks, order, decay)
    gram = kernels(marks, marks, order, decay) / np.sqrt(own[:, None] * own[None])
    values, vectors = np.linalg.eigh(gram.astype(float) ** power)
    whiten = (vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T).astype(np.float32)
    model = ToxicityModel(marks, order, decay, power, own, whiten, np.zeros(0), 0.0, 1.0, 0.0)
    shared = model.subsequences()

    size, n_pos, n_neg = len(bags.vocabulary), bags.weight[bags.toxic].sum(), bags.weight[~bags.toxic].sum()
    in_toxic, in_clean = bags.texts_with(np.arange(size), size)
    lift = np.log((in_toxic + 0.5) / (n_pos + 1)) - np.log((in_clean + 0.5) / (n_neg + 1))
    score = (lift * np.minimum(in_toxic, 5)).astype(np.float32)
    clean_words = np.flatnonzero(in_clean)
    start = np.sort(np.random.default_rng(7).permutation(clean_words)[:negatives])
    telling = np.flatnonzero((lift > 2.5) & (in_toxic >= max(3, 0.01 * n_pos)))
    x = np.empty((size, len(marks)), np.float16)
    for s in range(0, size, 20_000):
        x[s : s + 20_000] = model.features(bags.vocabulary.slice(s, 20_000).to_pylist(), shared)
    fixed = x[np.concatenate([telling, start])]
    hard, rng = np.zeros(0, np.int64), np.random.default_rng(11)
    for _ in range(rounds):
        filled, word = bags.worst(score)
        positive, share = word[bags.toxic[filled]], bags.weight[filled][bags.toxic[filled]]
        # insults are also learned in disguise: variants of those that are the worst word of several texts
        known = set(telling.tolist()) | set(np.flatnonzero(np.bincount(positive, share) > 1.5).tolist())
        often = [w for w in bags.strings(sorted(known)) if len(w) > 3][:400]
        bent = model.features([v for w in often for v in variants(w, 8, rng)], shared)
        rows = np.concatenate([fixed, x[positive], x[hard], bent.astype(np.float16)])
        parts = [(len(telling), 1, 20.0), (len(start), -1, 1.0), (len(positive), 1, 1.0), (len(hard), -1, 1.0), (len(bent), 1, disguised)]
        y = np.concatenate([np.full(n, float(v)) for n, v, _ in parts])
        weight = np.concatenate([np.full(n, c) for n, _, c in parts[:2]] + [share] + [np.full(n, c) for n, _, c in parts[3:]])
        w = squared_hinge(rows, y, weight, ridge)
        model.weights, model.bias = w[:-1], float(w[-1])
        for s in range(0, size, 20_000):
            score[s : s + 20_000] = x[s : s + 20_000].astype(np.float32) @ w[:-1].astype(np.float32) + np.float32(w[-1])
        worst = clean_words[np.argsort(-score[clean_words], kind="stable")[: negatives // 2]]
        hard = np.setdiff1d(worst, start)
    filled, word = bags.worst(score)
    model.slope, model.shift = logistic(score[word].astype(float), bags.toxic[filled].astype(float), bags.weight[filled])
    return model


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, sample: int = 1000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Fit on a bounded sample of labelled texts outside the held-out fold, all words of each."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(fold_of(F.col("id"), folds) != held_fold).where("label in (0, 1)")
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(n) for k, n in ((1, sample), (0, 3 * sample))]
    # at most 4 * sample rows
    picked = F.broadcast(chosen[0].unionByName(chosen[1]).dropDuplicates(["id"]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id").select("id", "text", "label")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [sorted({p for w in toxic_words(t) for p in windows(w)}) for t in batch.column(1).to_pylist()]
            # copies of a text share the words that come first by hash
            keys = [zlib.crc32("\n".join(sorted(w, key=lambda x: (hash_of(x), x))[:4]).encode("utf-8", "replace")) for w in words]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2), pa.array(keys, pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["id", "label", "key", "words"])

        return step

    # Arrow columns, not Python strings: the sample has hundreds of thousands of words
    got = map_slices(rows, make, "id string, label int, key long, words array<string>").toArrow().combine_chunks()
    if not len(got):
        return ToxicityModel.blank()
    got = got.take(pc.sort_indices(got.select(["label", "id"]), [("label", "ascending"), ("id", "ascending")]))
    toxic = got["label"].to_numpy() == 1
    return fit_bags(Bags.of(got["words"].combine_chunks(), toxic, got["key"].to_numpy())) if 0 < toxic.sum() < len(toxic) else ToxicityModel.blank()


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace"))


def _scorer(model: ToxicityModel):
    """A function from texts to their scores and worst words, with a cache of word margins."""
    cache = WordCache(CACHE_ENTRIES)
    shared = model.subsequences() if model.marks else None
    nothing = model.margins([b"\0"], shared)[0]

    def run(texts: list[str | None]) -> tuple[list[float], list[bytes]]:
        scores, worst = [], []
        for a, b in text_groups(texts, GROUP_CHARS):
            lists = [toxic_words(t) for t in texts[a:b]]
            margin = cache.fetch(set().union(*lists), lambda words: model.margins(words, shared))
            for words in lists:
                top = max(words, key=margin.__getitem__, default=b"")
                scores.append(model.probability(max(margin[top], nothing) if words else nothing))
                worst.append(top)
        return scores, worst

    return run


def score(docs: DataFrame, model: ToxicityModel, folds: int = 5, held_fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted and the worst word."""
    held = F.coalesce(fold_of(F.col(id_col), folds) == held_fold, F.lit(False))
    source = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    schema = f"{id_col} {dict(source.dtypes)['id']}, held_out boolean, score double, predicted int, worst_word string"

    def make():
        run = _scorer(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, worst = run(batch.column(2).to_pylist())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([w.decode("utf-8", "replace") for w in worst], pa.string())],
                names=[id_col, "held_out", "score", "predicted", "worst_word"],
            )

        return step

    return map_slices(source, make, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, with all their columns and without a join."""
    at = docs.columns.index(text_col)

    def make():
        run = _scorer(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores, _ = run(batch.column(at).to_pylist())
            return batch.filter(pa.array([s < threshold for s in scores], pa.bool_()))

        return step

    return map_slices(docs, make, docs.schema)
