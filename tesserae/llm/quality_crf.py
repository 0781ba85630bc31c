r"""Line sequence labelling for document quality.

A linear-chain conditional random field reads a document line by line and marks
each line as content or boilerplate by Viterbi decoding; the share of words on
content lines decides retention, after plain word-count rules.

The model is fitted on a bounded sample of labelled documents (``sample`` of
each class, all lines of each, in sequences of ``train_lines``), with every line
taking its document's label at first and lines of bad documents relabelled by the
model once, since such documents hold ordinary lines too.  Everything else covers all
rows and whole texts; the counts are numpy over the UTF-8 bytes of a slice.

Defined results: null and empty text has no words, fails the base rules and is
not kept; null ids are carried through; repeated rows give repeated results;
without labelled rows of both classes the model marks every line as content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_slices, text_groups

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
GROUP_CHARS = 1_000_000
N_FEATURES = 14
BOILERPLATE, CONTENT = 0, 1


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


IS_SPACE, IS_SYMBOL = _table(SPACES), _table(SYMBOLS)
IS_UPPER = _table(bytes(range(65, 91)))
IS_LETTER = _table(bytes([*range(65, 91), *range(97, 123), *range(128, 256)]))
IS_DIGIT = _table(bytes(range(48, 58)))


def _sums(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


@dataclass
class Measured:
    """Counts of a group of documents, and the features of their lines that have words."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_doc: np.ndarray
    line_words: np.ndarray
    features: np.ndarray


def measure(texts: list[str | None]) -> Measured:
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    n = len(raw)
    data = b"\n".join(raw) + b"\n"
    b = np.frombuffer(data, np.uint8)
    sizes = np.fromiter(map(len, raw), np.int64, n)
    doc_start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) if n else np.zeros(0, np.int64)
    doc_end = doc_start + sizes
    word_byte = ~IS_SPACE[b]
    begins = word_byte.copy()
    begins[1:] &= ~word_byte[:-1]
    n_words = _sums(begins, doc_start, doc_end)
    word_chars = _sums(word_byte & ((b & 0xC0) != 0x80), doc_start, doc_end)
    n_symbols = _sums(IS_SYMBOL[b], doc_start, doc_end)

    ids: dict[bytes, int] = {}
    word = np.fromiter((ids.setdefault(w, len(ids)) for w in data.split()), np.int64)
    word_doc = np.repeat(np.arange(n), n_words)
    marked = np.zeros(len(word), bool)
    if len(word) >= 3:
        whole = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        if len(ids) < 1 << 21:
            key = word[whole] << 42 | word[whole + 1] << 21 | word[whole + 2]
        else:
            _, pair = np.unique(word[:-1] << 32 | word[1:], return_inverse=True)
            key = pair[whole] << 32 | word[whole + 2]
        order = np.argsort(key, kind="stable")
        key, where = key[order], whole[order]
        same = (key[1:] == key[:-1]) & (word_doc[where[1:]] == word_doc[where[:-1]])
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        for k in range(3):
            marked[where[twice] + k] = True
    n_repeat = np.bincount(word_doc[marked], minlength=n) if n else np.zeros(0, np.int64)

    ends = np.flatnonzero(b == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line_words = _sums(begins, starts, ends)
    has = line_words > 0
    starts, ends, line_words = starts[has], ends[has], line_words[has]
    line_doc = np.searchsorted(doc_start, starts, side="right") - 1
    dup = np.zeros(len(starts), bool)
    seen: set[bytes] = set()
    last = -1
    for k, (d, s, e) in enumerate(zip(line_doc.tolist(), starts.tolist(), ends.tolist(), strict=True)):
        if d != last:
            seen, last = set(), d
        line = data[s:e]
        if line in seen:
            dup[k] = True
        else:
            seen.add(line)
    n_dup = np.bincount(line_doc[dup], minlength=n) if n else np.zeros(0, np.int64)

    f = np.zeros((len(starts), N_FEATURES), np.float32)
    letters, size = np.maximum(_sums(IS_LETTER[b], starts, ends), 1), np.maximum(ends - starts, 1)
    word_start = np.concatenate([[0], np.cumsum(line_words)[:-1]]) if len(starts) else np.zeros(0, np.int64)
    if len(starts):
        f[:, 0] = 1
        f[:, 1] = np.log1p(line_words) / 5
        f[:, 2] = np.minimum(_sums(IS_SYMBOL[b], starts, ends) / line_words, 3)
        f[:, 3] = np.minimum(_sums(b == 33, starts, ends) / line_words, 2)
        f[:, 4] = _sums(IS_UPPER[b], starts, ends) / letters
        f[:, 5] = np.minimum(_sums(b == 124, starts, ends) / line_words, 1)
        f[:, 6] = _sums(IS_DIGIT[b], starts, ends) / size
        f[:, 7] = _sums(marked, word_start, word_start + line_words) / line_words
        f[:, 8] = dup
        f[:, 9] = np.minimum(size / line_words / 10, 3)
        f[:, 10] = b[ends - 1] == 46
        f[:, 11] = line_words < 5
        f[:, 12] = np.concatenate([[True], line_doc[1:] != line_doc[:-1]])
        f[:, 13] = np.concatenate([line_doc[1:] != line_doc[:-1], [True]])
    return Measured(n_words, word_chars, n_symbols, n_dup, n_repeat, line_doc, line_words, f)


@dataclass
class LineCrf:
    """Weights of a two-label linear-chain CRF: emissions from features, and transitions."""

    emit: np.ndarray
    move: np.ndarray

    @classmethod
    def trusting(cls) -> LineCrf:
        """Marks every line as content."""
        emit = np.zeros((N_FEATURES, 2))
        emit[0, CONTENT] = 1.0
        return cls(emit, np.zeros((2, 2)))

    def viterbi(self, features: np.ndarray, line_doc: np.ndarray) -> np.ndarray:
        """Best labels; documents are decoded side by side, one line of each at a time."""
        n = len(features)
        labels = np.zeros(n, np.int8)
        if not n:
            return labels
        first = np.flatnonzero(np.concatenate([[True], line_doc[1:] != line_doc[:-1]]))
        count = np.diff(np.concatenate([first, [n]]))
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        score = features @ self.emit
        back = np.zeros((n, 2), np.int8)
        best = score[first].copy()
        final = np.zeros((len(first), 2))
        alive_at = np.searchsorted(-count, -np.arange(1, count[0] + 1), side="right")
        for t in range(count[0]):
            alive = alive_at[t]
            if t:
                via = best[:alive, :, None] + self.move[None]
                at = first[:alive] + t
                back[at] = via.argmax(1)
                best[:alive] = via.max(1) + score[at]
            ended = alive_at[t + 1] if t + 1 < count[0] else 0
            final[ended:alive] = best[ended:alive]
        now = final.argmax(1)
        for t in range(count[0] - 1, -1, -1):
            alive = alive_at[t]
            at = first[:alive] + t
            labels[at] = now[:alive]
            now[:alive] = back[at, now[:alive]]
        return labels

    @classmethod
    def fit(cls, features: np.ndarray, line_doc: np.ndarray, labels: np.ndarray, steps: int = 100, rate: float = 0.15, ridge: float = 1e-3) -> LineCrf:
        """Maximum conditional likelihood by Adam; gradients from forward-backward over padded sequences."""
        _, seq = np.unique(line_doc, return_inverse=True)
        pos = np.arange(len(seq)) - np.concatenate([[0], np.cumsum(np.bincount(seq))[:-1]])[seq]
        m, t_max = seq.max() + 1, pos.max() + 1
        x = np.zeros((t_max, m, features.shape[1]))
        y = np.full((t_max, m), -1)
        x[pos, seq], y[pos, seq] = features, labels
        there = y >= 0
        gold = np.zeros((t_max, m, 2))
        gold[pos, seq, labels] = 1
        w, a = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
        mean, var = np.zeros(w.size + 4), np.zeros(w.size + 4)
        for step in range(1, steps + 1):
            e = x @ w
            f = np.zeros((t_max, m, 2))
            f[0] = e[0]
            for t in range(1, t_max):
                f[t] = np.where(there[t][:, None], np.logaddexp.reduce(f[t - 1][:, :, None] + a, axis=1) + e[t], f[t - 1])
            g = np.zeros((t_max, m, 2))
            for t in range(t_max - 2, -1, -1):
                g[t] = np.where(there[t + 1][:, None], np.logaddexp.reduce(a + (e[t + 1] + g[t + 1])[:, None, :], axis=2), 0)
            z = np.logaddexp.reduce(f[0] + g[0], axis=1)
            node = np.exp(f + g - z[None, :, None]) * there[:, :, None]
            grad_w = np.einsum("tmk,tml->kl", x, gold - node)
            grad_a = np.zeros((2, 2))
            if t_max > 1:
                edge = np.exp(f[:-1][:, :, :, None] + a + (e[1:] + g[1:])[:, :, None, :] - z[None, :, None, None]) * there[1:][:, :, None, None]
                grad_a = np.einsum("tmi,tmj->ij", gold[:-1] * there[1:][:, :, None], gold[1:]) - edge.sum((0, 1))
            grad = np.concatenate([grad_w.ravel(), grad_a.ravel()]) / len(labels) - ridge * np.concatenate([w.ravel(), a.ravel()])
            mean, var = 0.9 * mean + 0.1 * grad, 0.99 * var + 0.01 * grad**2
            move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-8)
            w, a = w + move[: w.size].reshape(w.shape), a + move[w.size :].reshape(2, 2)
        return cls(w, a)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 400, train_lines: int = 64, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> LineCrf:
    """Fit on at most ``sample`` documents of each label, chosen by a hash of their id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    # at most 2 * sample rows
    picked = F.broadcast(chosen[0].unionByName(chosen[1]).dropDuplicates(["id"]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(picked, "id")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, texts, marks = (batch.column(k).to_pylist() for k in range(3))
            out = []
            for k, text in enumerate(texts):
                f = measure([text]).features
                if len(f):
                    out.append((str(ids[k]), marks[k], f.astype("<f4").tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["id", "label", "lines"])

        return step

    got = sorted(tuple(r) for r in map_slices(rows.select("id", "text", "label"), make, "id string, label int, lines binary").collect())
    if len({r[1] for r in got}) < 2:
        return LineCrf.trusting()
    lines = [np.frombuffer(r[2], "<f4").reshape(-1, N_FEATURES).astype(float) for r in got]
    x = np.concatenate(lines)
    # a long document is several sequences, so that short ones need no padding to its length
    doc = np.concatenate([k * (1 << 32) + np.arange(len(f)) // train_lines for k, f in enumerate(lines)])
    of_doc = np.repeat([r[1] for r in got], [len(f) for f in lines])
    first = LineCrf.fit(x, doc, of_doc)
    # a bad document's ordinary lines are content; a good one's stay so
    return LineCrf.fit(x, doc, np.where(of_doc == CONTENT, CONTENT, first.viterbi(x, doc)))


def judge(docs: DataFrame, model: LineCrf, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, base verdict, content share and verdict of every document."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = f"{id_col} {dict(source.dtypes)['id']}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, kept boolean, content_share double, n_lines long"

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            columns: list[list[np.ndarray]] = [[] for _ in range(9)]
            for a, b in text_groups(texts, GROUP_CHARS):
                m = measure(texts[a:b])
                content = model.viterbi(m.features, m.line_doc) == CONTENT
                good = np.bincount(m.line_doc, m.line_words * content, b - a)
                share = good / np.maximum(m.n_words, 1)
                failed = (m.n_words < min_words) | (100 * m.n_repeat_words > max_repeat_percent * m.n_words)
                found = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, failed, ~failed & (share >= min_content), share, np.bincount(m.line_doc, minlength=b - a)]
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64()]
            arrays = [pa.array(np.concatenate(c) if c else [], k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *names, "base_failed", "kept", "content_share", "n_lines"])

        return step

    return map_slices(source, make, schema)


def retain(docs: DataFrame, model: LineCrf, min_words: int = 50, max_repeat_percent: int = 50, min_content: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that :func:`judge` keeps, with all their columns and without a join."""
    at = docs.columns.index(text_col)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, keep = batch.column(at).to_pylist(), []
            for a, b in text_groups(texts, GROUP_CHARS):
                m = measure(texts[a:b])
                good = np.bincount(m.line_doc, m.line_words * (model.viterbi(m.features, m.line_doc) == CONTENT), b - a)
                failed = (m.n_words < min_words) | (100 * m.n_repeat_words > max_repeat_percent * m.n_words)
                keep.append(~failed & (good / np.maximum(m.n_words, 1) >= min_content))
            return batch.filter(pa.array(np.concatenate(keep) if keep else [], pa.bool_()))

        return step

    return map_slices(docs, make, docs.schema)
