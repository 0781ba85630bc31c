"""Alignment of two tokenizers against a plain loop over their libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tesserae.llm import alignment

from .test_operators import BYTE_BPE, EDGES, clash, public_tokenizers, rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<s> </s> <unk> <0x41>", "日本語のテキスト、混ざる English 文", "🤷🏽‍♀️🤷🏽‍♀️ zero​width", "a\u0000b\tc\r\nd", "１２３ ３．１４ ½ Ⅻ", "▁▁ U+2581 ▁x", " leading", "   three", "trailing   ", "don't we'll I'M", "ﬁ ligature ＦＵＬＬ", "x" * 700 + " " * 90 + "=" * 333]


def plain(texts):
    """What :func:`alignment.align` must give, by dictionaries and loops."""
    t = Tokenizer.from_file(BYTE_BPE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    at = alignment.byte_values()

    def piece(k):
        return bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()

    documents = []
    for text in texts:
        groups = []
        if text:
            a = t.encode(" " + text, add_special_tokens=False).ids
            b = sp.encode(text)
            xs, ys = [bytes(at[c] for c in t.id_to_token(k)) for k in a], [piece(k) for k in b]
            if b"".join(xs) == b"".join(ys) == (" " + text).encode():
                ends = [[sum(map(len, v[: k + 1])) for k in range(len(v))] for v in (xs, ys)]
                start = 0
                for cut in sorted(set(ends[0]) & set(ends[1])):
                    groups.append(tuple([k for k, e in zip(ids, end, strict=True) if start < e <= cut] for ids, end in ((a, ends[0]), (b, ends[1]))))
                    start = cut
        documents.append(groups)
    held = Counter(p for groups in documents for p in {(x, y) for a, b in groups for x in a for y in b})
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for groups in documents:
        links = [(x, y) for a, b in groups for x in a for y in b]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(held[p] == highest[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


def some_texts():
    rng = random.Random(5)
    words = ["the", "Straße", "naïve", "anti-dis", "x_1", "42", "1999", "\n", "  ", "don't", "https://a.b/c?d=e", "Ünï", "<|endoftext|>", "的", "😀"]
    return [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)] + ODD


@pytest.mark.parametrize("listed", [64, 1])
@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_like_plain_loops(spark, monkeypatch, listed, broadcast):
    monkeypatch.setattr(alignment, "LISTED", listed)
    monkeypatch.setattr(alignment, "BROADCAST_ROWS", broadcast)
    texts = some_texts() + [t for _, t in EDGES if not t or len(t) < 6000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(((k, *r) for k, r in enumerate(plain(texts))), key=repr)
    assert rows(alignment.align(docs, BYTE_BPE, PIECES), *COLUMNS) == want


def test_odd_rows(spark):
    docs = clash(spark.createDataFrame(EDGES, "doc_id long, text string"), ("row", "pair", "n", "pairs", "heavy", "a_ids", "cuts"))
    found = alignment.align(docs, BYTE_BPE, PIECES)
    assert found.columns == COLUMNS and found.count() == len(EDGES)
    by_id = {r["doc_id"]: r for r in found.where("doc_id is not null").collect()}
    assert tuple(by_id[1])[1:] == tuple(by_id[2])[1:] == (0, 0, 0, 0, 0, 0, "")
    # 8,000 times the same five words: every link counts for one document, and A and B differ on some of them
    assert by_id[5]["n_groups"] > 30_000 and by_id[5]["count_sum"] >= by_id[5]["n_links"]
    assert found.where("doc_id is null").count() == 2
    assert alignment.align(docs.limit(0), BYTE_BPE, PIECES).count() == 0


def test_text_without_a_shared_end(spark, monkeypatch):
    """Thousands of tokens in one group: its pairs are listed once each, with their number."""
    a, b = [5, 6, 5, 7] * 500, [9, 9, 8] * 500
    frame = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    got = frame.select(alignment.runs(F.col("a")).alias("a"), alignment.runs(F.col("b")).alias("b")).first()
    assert [tuple(x) for x in got["a"]] == [(5, 1000), (6, 500), (7, 500)]
    assert [tuple(x) for x in got["b"]] == [(8, 500), (9, 1000)]


def test_both_libraries_agree_on_plain_characters():
    """Every character that the faster library sees, between others of each kind."""
    a = alignment.ByteLevel(BYTE_BPE)
    texts = [f" a{c}b {c}{c} 1{c}2 .{c}, {c}" for c in map(chr, range(0x250))]
    assert not any(alignment.OTHER.search(t) for t in texts)
    assert [ids.tolist() for ids in a.encode(texts)] == [e.ids for e in a.whole.encode_batch(texts, add_special_tokens=False)]


def test_words_by_themselves_give_the_pieces_of_the_text():
    b = alignment.Pieces(PIECES)
    assert not any("▁" in b.model.id_to_piece(k).lstrip("▁") for k in range(b.size))
    assert not any(p.startswith("▁▁") and p.strip("▁") for p in map(b.model.id_to_piece, range(b.size)))
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefghinorstuéß.,-_0123456789\n\t的😀", k=rng.randint(1, 14))) for _ in range(rng.randint(1, 30))) for _ in range(500)] + some_texts()
    assert [ids.tolist() for ids in b.encode(texts)] == b.model.encode(texts)


def test_units_have_the_tokens_of_the_text():
    """Cut before a space after another character than white space: no token of either side crosses, however odd the text."""
    rng = random.Random(9)
    alphabet = ["a", "Zb", "1", "23", ".", "'s", "'", "é", "▁", " ", " ", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", " ", "　", "́", "的", "😀", "<s>"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 25))) for _ in range(3000)] + some_texts()
    units = alignment.Units(BYTE_BPE, PIECES, 64)
    assert all("".join(alignment.UNIT.findall(" " + t)) == " " + t for t in texts)
    plainly = [units.of_text(t) for t in texts]
    # the second time from what was kept
    for _ in range(2):
        assert units.of_texts(texts) == plainly


def test_a_unit_is_encoded_once(monkeypatch):
    units, asked = alignment.Units(BYTE_BPE, PIECES, 64), []
    plainly = units.a.encode
    monkeypatch.setattr(units.a, "encode", lambda texts: asked.extend(texts) or plainly(texts))
    units.of_texts(["two words two words", None, "two  words", ""])
    assert sorted("".join(asked)) == sorted(" two words  words")
