"""Every operator against brute force, and over rows that tend to break things."""

import base64
import gzip
import hashlib
import heapq
import random
import re
import subprocess
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import bpe_stream, brown_lm, licenses, minhash, packing, quality_crf, topk, toxicity, url_rules, warc
from tesserae.llm.common import materialize
from tesserae.llm.components import connected_components

from ..conftest import DATA

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SAYS = "the quick brown fox jumps over the lazy dog and then it rests for a while near the river bank "
LONG = "lorem ipsum dolor sit amet " * 8000
#: Ids, texts: empty, null, blank, short, long, equal, repeated, without an id; columns with names that operators use inside.
EDGES = [(1, ""), (2, None), (3, " \n\t "), (4, "One."), (5, LONG), (6, SAYS * 2), (7, SAYS * 2), (7, SAYS * 2), (None, SAYS), (None, None), (8, "x" * 5000), (9, "Ünï cödé 😀 <|endoftext|> the MIT license")]
CLASH = ("id", "key", "rep", "part", "block", "word", "n", "_group", "piece", "rule", "score", "kept", "_set")


def clash(df, names=CLASH):
    return df.withColumns({c: F.lit(0) for c in names})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.fixture(scope="module")
def edges(spark):
    return clash(spark.createDataFrame(EDGES, "doc_id long, text string"))


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.limit(0)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 1 ---------------------------------------------------------------------------


def near_by_hand(texts, percent=75):
    sets, where = {}, defaultdict(list)
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            where[s].append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j, n in Counter(j for s in sets[i] for j in where[s] if j < i).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n) and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return sorted(((i, len(sets[i]), top(i), top(i) == i) for i in sets), key=repr)


def test_near_duplicates(docs):
    want = near_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert rows(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == want


def test_chains_of_copies_link(spark):
    """Copies of copies: neighbours are alike, ends aren't, and ids are in no order."""
    random.seed(4)
    words = [f"w{k}" for k in range(120)]
    texts, ids = [], random.sample(range(1000), 60)
    for i in ids:
        at = random.randrange(len(words))
        words[at] = f"v{i}"
        texts.append((i, " ".join(words)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert rows(minhash.near_duplicates(df), "doc_id", "n_shingles", "component_id", "kept") == near_by_hand(texts)


def test_an_id_with_two_texts_loses_no_link(spark):
    """Each text's links count, and the id ties them together."""
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    data = [(1, one), (1, two), (2, one), (3, two), (4, one + " zz"), (5, two + " yy"), (6, "quite another text of more than five words")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6}
    # both texts stay, once each
    assert rows(minhash.keep_one(df), "doc_id", "text") == sorted([(1, one), (1, two), (6, data[-1][1])], key=repr)


def test_bitmaps_bound_what_sets_have_in_common(spark):
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (5, 40, 150, 300, 300)] + [pool[:300], pool[:310]]
    df = spark.createDataFrame([(bytes([k]), s.tobytes()) for k, s in enumerate(sets)], "id binary, items binary")
    maps = minhash.bitmaps(df)
    pairs = maps.alias("x").join(maps.alias("y"), F.col("x.id") < F.col("y.id")).select("x.id", "y.id", minhash._maps_allow("x", "y", 75)).collect()
    for a, b, allowed in pairs:
        x, y = set(sets[a[0]].tolist()), set(sets[b[0]].tolist())
        assert allowed or 100 * len(x & y) < 75 * len(x | y)
    assert not all(p[2] for p in pairs)


def test_near_duplicates_edges(edges, nothing):
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_duplicates(edges).collect()}
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (1, 4, True)
    assert got[6][1:] == (6, True) and got[7][1:] == (6, False)
    assert got[None][1:] == (None, True)
    assert minhash.near_duplicates(edges).count() == len(EDGES)
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.keep_one(edges)
    assert kept.columns == edges.columns and rows(kept.where("doc_id is not null"), "doc_id") == [(i,) for i in (1, 2, 3, 4, 5, 6, 8, 9)]


def test_components(spark):
    random.seed(1)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 440)]
    up = {x: x for p in pairs for x in p}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert got == {x: top(x) for p in pairs if p[0] != p[1] for x in p}


# 2 ---------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["https://Blog.Example.NET/en/1?x#y", "http://a.net", "http://a.net/q", "https://example.com/de/2", "https://notexample.com/de/2", "http://x.org/fr/1", "http://x.org/en/1", "no url", None, "x://y.org:80/fr/", "http://h?q=/en/"]
    pages = clash(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), ("id", "key", "host", "path", "rule", "verdict", "_set", "_mined"))
    trained = url_rules.mine(spark.createDataFrame([(f"http://bad{k % 3}.org/en/{k}", True) for k in range(60)] + [(f"http://good.org/en/{k}", False) for k in range(60)], "url string, bad boolean"))
    got = {r["page_id"]: r for r in url_rules.judge(pages, trained).collect()}
    assert [got[k]["host"] for k in range(11)] == ["blog.example.net", "a.net", "a.net", "example.com", "notexample.com", "x.org", "x.org", "", "", "y.org:80", "h"]
    assert [got[k]["path"] for k in range(11)] == ["/en/1", "", "/q", "/de/2", "/de/2", "/fr/1", "/en/1", "", "", "/fr/", ""]
    assert [got[k]["rule"] for k in range(11)] == ["example.net/en/", None, "net/", "example.com/de/", None, "org/fr/", None, None, None, None, None]
    assert [got[k]["verdict"] for k in (0, 2, 3, 5)] == ["allow", "block", "block", "allow"]
    more = spark.createDataFrame([(1, "http://bad1.org/en/999"), (1, "http://bad1.org/en/999"), (None, "http://good.org/en/5")], "page_id long, url string")
    assert rows(url_rules.judge(more, trained), "page_id", "verdict") == [(1, "block"), (1, "block"), (None, "allow")]
    assert url_rules.judge(pages.limit(0), trained).count() == 0
    none = url_rules.mine(spark.createDataFrame([], "url string, bad boolean"))
    assert {r["verdict"] for r in url_rules.judge(more, none).collect()} == {"allow"}


# 3 ---------------------------------------------------------------------------


def test_all_tokens_of_a_url_are_judged(spark):
    deep = [f"/p{chr(97 + k)}" for k in range(14)]
    url = lambda host, tail, keys: f"http://{host}.org{''.join(deep)}/{tail}?{'&'.join(f'k{chr(97 + k)}=1' for k in range(13))}&{keys}=1"
    few = lambda tail: f"http://a.org/{tail}"
    trained = url_rules.mine(spark.createDataFrame([(few("spam"), True)] * 30 + [(few("fine"), False)] * 30 + [(few("x?evil=1"), True)] * 30 + [(few("x?good=1"), False)] * 30, "url string, bad boolean"))
    pages = spark.createDataFrame([(1, url("z", "spam", "q")), (2, url("z", "fine", "q")), (3, url("z", "y", "evil")), (4, url("z", "y", "good"))], "page_id long, url string")
    assert rows(url_rules.judge(pages, trained, fixed=[]), "page_id", "verdict") == [(1, "block"), (2, "allow"), (3, "block"), (4, "allow")]


def test_mined_rules_and_matching_equal_brute_force(spark):
    """Every set of up to three tokens counted, every rule tried on every URL."""
    from itertools import combinations

    rng = random.Random(21)
    urls = [(f"http://{rng.choice(['a', 'b', 'c'])}.org/{rng.choice(['x', 'y', 'z'])}/{rng.choice(['p', 'q'])}?{rng.choice(['k', 'm'])}=1",) for _ in range(300)]
    data = [(u, ("/x/" in u and "k=" in u) != (rng.random() < 0.05)) for (u,) in urls]
    labelled = spark.createDataFrame(data, "url string, bad boolean")
    token_sets = [r[0] for r in labelled.select(url_rules.tokens_of(F.col("url"))).collect()]
    n, share = len(data), sum(b for _, b in data) / len(data)
    counts, wrong = Counter(), Counter()
    for tokens, (_, bad) in zip(token_sets, data, strict=True):
        for k in (1, 2, 3):
            for c in combinations(sorted(tokens), k):
                counts[c] += 1
                wrong[c] += bad
    want = {}
    for c, m in counts.items():
        for verdict, hit, base in (("block", wrong[c], share), ("allow", m - wrong[c], 1 - share)):
            if hit >= 8 and hit / m >= 0.6 and hit / m / base >= 1.05:
                want[c, verdict] = hit / m
    want = {(c, v): p for (c, v), p in want.items() if len(c) == 1 or all(p > want.get(((t,), v), 0) for t in c)}
    mined = url_rules.mine(labelled)
    got = {}
    for r in mined.dropDuplicates(["rule_id"]).collect():
        for tokens in product(*r["antecedent"]):
            got[tuple(sorted(tokens)), r["rule_verdict"]] = r["confidence"]
    # tokens of the same URLs are one item, so sets of two of them are not rules beside either
    assert set(got) <= set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    verdicts = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame([(k, u) for k, (u, _) in enumerate(data)], "page_id long, url string"), mined, fixed=[]).collect()}
    for k, tokens in enumerate(token_sets):
        fits = [(p, v) for (c, v), p in want.items() if set(c) <= set(tokens)]
        assert verdicts[k]["confidence"] is None if not fits else abs(verdicts[k]["confidence"] - max(fits)[0]) < 1e-9
        assert verdicts[k]["verdict"] in ({v for p, v in fits if abs(p - max(fits)[0]) < 1e-9} or {"allow"})


@pytest.mark.parametrize("segments", [12, 30])
def test_a_repeated_deep_url_is_mined_in_seconds(spark, segments):
    url = "http://a.org/" + "/".join(f"s{chr(97 + k % 26)}{'x' * (k // 26)}" for k in range(segments))
    start = time.time()
    mined = url_rules.mine(spark.createDataFrame([(url, True)] * 40 + [("http://b.org/fine", False)] * 40, "url string, bad boolean"))
    keys = {r["key"] for r in mined.collect()}
    assert f"p:s{chr(97 + (segments - 1) % 26)}{'x' * ((segments - 1) // 26)}" in keys and time.time() - start < 30


@pytest.mark.parametrize("min_support", [0.05, 0.1])
@pytest.mark.parametrize("whole_items", [4, 12, 40])
def test_a_pair_that_alone_decides_is_mined_among_many_segments(spark, min_support, whole_items):
    """Twelve segments tell a little each; two tell nothing alone and all together."""
    rng = random.Random(9)
    data = []
    for k in range(600):
        u, v = rng.randrange(2), rng.randrange(2)
        bad = u == v
        weak = [f"w{chr(97 + i)}{'yn'[rng.random() < (0.4 if bad else 0.6)]}" for i in range(12)]
        data.append(("http://a.org/" + "/".join([f"u{'ab'[u]}", f"v{'ab'[v]}", *weak]), bad))
    labelled = spark.createDataFrame(data, "url string, bad boolean")
    mined = materialize(url_rules.mine(labelled, min_support=min_support, max_length=2, whole_items=whole_items), "test-rules")
    pairs = {(tuple(t[0] for t in r["antecedent"]), r["rule_verdict"]): r["confidence"] for r in mined.collect()}
    assert pairs[("p:ua", "p:va"), "block"] == pairs[("p:ua", "p:vb"), "allow"] == 1
    judged = url_rules.judge(spark.createDataFrame([(k, u) for k, (u, _) in enumerate(data)], "page_id long, url string"), mined, fixed=[])
    assert {r["page_id"]: r["verdict"] == "block" for r in judged.collect()} == {k: b for k, (_, b) in enumerate(data)}


def test_wide_baskets_give_the_rules_of_whole_ones(spark):
    rng = random.Random(4)
    urls = [("http://a.org/" + "/".join(sorted(rng.sample(["pa", "pb", "pc", "pd", "pe", "pf", "pg", "ph", "pi"], rng.randint(2, 8)))),) for _ in range(250)]
    labelled = spark.createDataFrame([(u, ("/pa" in u and "/pc" in u and "/pe" in u) != (rng.random() < 0.03)) for (u,) in urls], "url string, bad boolean")
    found = [rows(url_rules.mine(labelled, whole_items=w).drop("rule_id"), "key", "antecedent", "rule_verdict", "confidence", "support") for w in (40, 5, 1)]
    assert found[0] == found[1] == found[2] and any(len(r[1]) == 3 for r in found[0])


def test_warc_round_trip(spark, tmp_path):
    data = [(5, "http://b.org/x", "same"), (3, "http://a.org/y", "same"), (9, None, None), (8, "http://a.org/y", ""), (7, "http://a.org/\r\nWARC/1.1\r\n", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (6, "http://c.org", "é" * 100_000), (None, "http://d.org", "same"), (3, "http://a.org/y", "same")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({c: F.lit(0) for c in ("digest", "size", "key", "refers_to", "value")})
    when = F.concat(F.lit("2024-01-01T00:00:0"), F.coalesce("page_id", F.lit(0)).cast("string"), F.lit("Z"))
    got = warc.archive_and_index(pages, when, str(tmp_path / "warc"), run_bytes=50_000)
    firsts = {"same": 3, "": 8}
    want = []
    for i, _, h in data:
        b = (h or "").encode()
        first = firsts.get(h or "", i) if i is not None else None
        new = i is None or first == i
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if new else "revisit", None if new else first))
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    order = [(r["url_key"], r["captured_at"]) for r in got.orderBy("position").collect()]
    assert order == sorted(order)
    assert warc.archive_and_index(pages.limit(0), when, str(tmp_path / "none")).count() == 0


def test_archives_can_be_read_by_anyone_and_entered_anywhere(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h{k % 7}.org/{k}", f"<p>{'hi' * k}</p>") for k in range(40)] + [(99, "http://z.org", "x" * 200)], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), F.lit("2024-01-01T00:00:00Z"), run_bytes=1000)
    read = {}
    for file in (tmp_path / "w").glob("*.txt"):
        data = file.read_bytes()
        # the archive is one gzip file, and the command line's tool agrees
        assert subprocess.run(["gzip", "-dc"], input=data, capture_output=True, check=True).stdout == (gzip.decompress(data) if data else b"")
        for offset, fields, block in warc.records(data):
            assert next(warc.records(data, offset))[1:] == (fields, block)
            read[int(fields["WARC-Page"])] = block.split(b"\r\n\r\n", 1)[1].decode()
        if data:
            with pytest.raises(ValueError):
                list(warc.records(data[:-6]))
    assert read == {r["page_id"]: r["html"] for r in pages.collect()}


def test_records_of_several_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 100)
    data = b"WARC/1.1\r\nContent-Length: 1000\r\nX: " + b"y" * 150 + b"\r\n\r\n" + b"z" * 1000 + b"\r\n\r\n"
    archive = warc.member(data) + b"\0" + warc.member(data) + b"\0"
    found = list(warc.records(archive))
    assert len(found) == 2 and found[1][0] == len(archive) // 2 and all(f[2] == b"z" * 1000 for f in found)


def test_index_merges_sorted_runs(spark):
    rng = random.Random(6)
    runs = {f"a{k}": sorted((f"u{rng.randrange(30):02d}", f"t{rng.randrange(9)}", rng.randrange(1000)) for _ in range(rng.randrange(1, 80))) for k in range(9)}
    data = [(p, u, t, a, k, "response", 0, "", None) for a, run in runs.items() for k, (u, t, p) in enumerate(run)]
    index = spark.createDataFrame(data, warc.ENTRY).coalesce(1)
    for stretch in (20, 10_000):
        got = [(r["url_key"], r["captured_at"], r["page_id"]) for r in warc.merge_index(index, stretch_rows=stretch).orderBy("position").collect()]
        assert got == sorted(x for run in runs.values() for x in run)


def test_ids_far_in_the_future(spark, tmp_path):
    from tesserae.llm.queries import op3_warc_index

    spark.createDataFrame([(10**17, "http://a.org", "x"), (1, "http://a.org", "x"), (None, None, None)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["refers_to"] for r in op3_warc_index(spark, str(tmp_path)).collect()}
    assert got == {10**17: 1, 1: None, None: None}


def test_loser_tree():
    random.seed(3)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(random.choices(range(50), k=random.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))


def test_rows_of_one_page_fill_several_archives(spark, tmp_path):
    """3,000 rows of one page, and 500 without an id; all but the first of the page are revisits or its response."""
    html = "".join(random.Random(1).choices("abcdefgh ", k=2000))
    pages = spark.createDataFrame([(4, "http://a.org/x", html)] * 3000 + [(None, "http://a.org/x", html)] * 500 + [(2, "http://a.org/x", html), (9, "http://b.org", "other")], "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, F.lit("2024-01-01T00:00:00Z"), run_bytes=500_000)
    entries = warc.read_index(spark, path)
    sizes = [r["count"] for r in entries.groupBy("archive").count().collect()]
    assert sum(sizes) == 3502 and max(sizes) < 1000
    index = warc.merge_index(materialize(entries, "entries"), stretch_rows=200)
    rows_ = index.orderBy("position").collect()
    assert [(r["url_key"], r["page_id"] or -1, r["archive"], r["offset"]) for r in rows_] == sorted((r["url_key"], r["page_id"] or -1, r["archive"], r["offset"]) for r in rows_)
    assert max(Counter(r["position"] >> 40 for r in rows_).values()) < 1000
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in rows_)
    assert kinds == {(4, "revisit", 2): 3000, (None, "response", None): 500, (2, "response", None): 1, (9, "response", None): 1}


# 4 ---------------------------------------------------------------------------


def test_topk_is_exact(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 12))
    data = [(i, (centres[i % 6] + 0.3 * rng.normal(size=12)).tolist()) for i in range(900)] + [(i, centres[0].tolist()) for i in range(900, 1200)]
    data += [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12), (None, [1.0] * 12), (2004, [1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({c: F.lit(0) for c in ("v", "block", "dist", "rank", "score")})
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=64, pivots=8)
    kept = [(i, v) for i, v in data if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids = np.array([i for i, _ in kept])
    x = np.floor(256 * np.array([v + [0.0] * (12 - len(v)) for _, v in kept]))
    x[ids == 2004, 1:] = 0
    want = []
    for row in np.flatnonzero(ids % 50 == 0):
        s = x @ x[row]
        s[row] = -np.inf
        want += [(int(ids[row]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(np.lexsort((ids, -s))[:5])]
    assert rows(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert rows(topk.top_k(few, F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 256 * 512)]


def test_topk_of_large_components_is_exact(spark):
    data = [(0, [1e7, 1.0])] + [(k, [1e7, k / 256]) for k in range(1, 40)] + [(50, [-1e7, 3.0]), (51, [9e15, 0.0]), (52, [9e15, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in data}
    want = []
    for q in (0, 50):
        s = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x[q], x[i], strict=True)))), i) for i in x if i != q))[:5]
        want += [(q, n + 1, i, -v) for n, (v, i) in enumerate(s)]
    assert rows(topk.top_k(df, F.col("vec_id") % 50 == 0, block_rows=8, pivots=4), "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    few = spark.createDataFrame([(k, [1e7, k / 256]) for k in (0, 1, 2, 5)], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2, 5]


def test_topk_with_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [5.0]), (1, [2.0]), (2, [3.0])], "vec_id long, embedding array<double>")
    assert rows(topk.top_k(df, F.col("vec_id") == 0), "rank", "vec_id", "score") == [(1, 2, 256 * 768), (2, 1, 256 * 512)]


# 5 ---------------------------------------------------------------------------


def lm_by_hand(texts):
    seen = Counter()
    for i, t in texts:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            seen.update((t or "").encode().lower().split() + ["END"])
    n, v = sum(seen.values()), len(seen)
    out = []
    for i, t in texts:
        w = (t or "").encode().lower().split() + ["END"]
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(seen[x] > 0 for x in w), n, round(sum(np.log10((seen[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)))
    return sorted(out, key=repr)


def test_class_lm(docs):
    got = brown_lm.score(docs, classes=12, top_words=200, shapes=50, block_chars=100_000)
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4)) == lm_by_hand(texts)
    sums = got.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]  # the classes tell more than the word counts


def test_class_lm_edges(spark, edges, nothing):
    got = brown_lm.score(edges, classes=4, top_words=20, shapes=5, block_chars=1000)
    assert rows(got, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4)) == lm_by_hand(EDGES)
    assert brown_lm.score(nothing).count() == 0


def test_class_probabilities_sum_to_one(spark):
    texts = spark.createDataFrame([("a b a c",), ("b d",)], "text string")
    m = brown_lm.train(texts, brown_lm.word_counts(texts), 3, 2, 4, 3, 5.0)
    assert np.allclose((10**m.log_move).sum(1), 1)
    n = {b"a": 2, b"b": 2, b"c": 1, b"d": 1, brown_lm.END: 2}
    total = np.zeros(3)
    for w, k in n.items():
        c = m.class_of_word(w)
        total[c] += (k + 0.5) / (m.class_tokens[c] + 0.5 * (m.class_types[c] + 1))
    rest = 0.5 / (m.class_tokens + 0.5 * (m.class_types + 1))
    assert np.allclose(total + rest, 1)


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    b = rng.poisson(0.3, (40, 40)) + np.kron(np.eye(4, dtype=int)[::-1], rng.poisson(3, (10, 10)))

    def value(cls):
        m = np.eye(4, dtype=int)[cls]
        j = m.T @ b @ m
        log = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0).sum()
        return log(j) - log(j.sum(1)) - log(j.sum(0))

    values = [value(brown_lm.exchange(b, 4, r)) for r in (0, 1, 2, 6)]
    assert values == sorted(values) and values[-1] > values[0]


def test_best_class_of_a_word_is_that_of_brute_force():
    rng = np.random.default_rng(3)
    b, cls, n = rng.poisson(0.4, (30, 30)), rng.integers(0, 5, 30), 5
    b[np.arange(30), (np.arange(30) + 1) % 30] += 1
    member = np.eye(n, dtype=int)[cls]
    keys, counts = [], []
    for w in range(30):
        for d, x in enumerate([*(b @ member)[w], *(b.T @ member)[w], b[w, w]]):
            if x:
                keys.append(w * (2 * n + 1) + d)
                counts.append(x)
    got = brown_lm.best_classes(np.array(keys), np.array(counts), cls, member.T @ b @ member, chunk=7)

    def value(w, c):
        m = np.eye(n, dtype=int)[np.where(np.arange(30) == w, c, cls)]
        return brown_lm.likelihood(m.T @ b @ m)

    assert got.tolist() == [int(np.argmax([value(w, c) for c in range(n)])) for w in range(30)]


def seed_joint(seed, texts):
    member = np.eye(len(seed.class_tokens), dtype=int)[seed.class_of]
    return member.T @ brown_lm.unit_bigrams(texts, seed.top, seed.shapes) @ member


def test_rare_words_get_classes_by_their_neighbours(spark):
    rng = random.Random(5)
    # eight shapes for all words past the top two, each with nouns and verbs, so only their neighbours tell them apart
    nouns, verbs = ([f"{kind}{rng.randrange(10**6):06d}" for _ in range(60)] for kind in "nv")
    texts = spark.createDataFrame([(k, " ".join(f"the {rng.choice(nouns)} will {rng.choice(verbs)}" for _ in range(8))) for k in range(200)], "doc_id long, text string")
    held = texts.select("doc_id", "text").withColumn("held", F.lit(False)).withColumnRenamed("doc_id", "id")
    counts = brown_lm.word_counts(texts)
    seed = brown_lm.train(texts, counts, 5, 2, 8, 6, 20.0)
    coded = brown_lm.encode(held, 3000, 2, "bigint").cache()
    placed = brown_lm.place(coded, counts, seed, 2).cache()
    model, vocabulary, values = brown_lm.refine(coded, placed, seed, 2, 20.0)
    assert max(values) > values[0] and np.allclose(values[0], brown_lm.likelihood(seed_joint(seed, texts)))
    assert model.class_tokens.sum() == seed.class_tokens.sum() and model.class_types.sum() == 123
    cls = {p["part"]: brown_lm.unpack(p["cls"], "<i2") for p in vocabulary.collect()}
    found = {}
    for ask in coded.where("part >= 0").join(placed.select("block", "part", "places"), ["block", "part"]).collect():
        found.update(zip(bytes(ask["words"]).split(b"\n"), cls[ask["part"]][brown_lm.unpack(ask["places"], "<i4", True)].tolist(), strict=True))

    def purity(class_of):
        of = {kind: Counter(class_of(w.encode()) for w in words) for kind, words in (("n", nouns), ("v", verbs))}
        return sum(max(of["n"][c], of["v"][c]) for c in range(5)) / 120

    # the seed mixes nouns and verbs by shape; classes of their own tell nearly all of them apart
    assert purity(seed.class_of_word) < 0.7 and purity(found.__getitem__) > 0.9


# 6 ---------------------------------------------------------------------------


def test_bpe_matches_the_library(docs, edges, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE)
    both = docs.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    want = []
    for i, text in both.collect():
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(bpe_stream.encode_decode(both, BYTE_BPE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert bpe_stream.encode_decode(nothing, BYTE_BPE).count() == 0


def test_bpe_stream_on_odd_texts():
    from tokenizers import Tokenizer

    random.seed(9)
    t, machine = Tokenizer.from_file(BYTE_BPE), bpe_stream.Transducer(BYTE_BPE)
    odd = ["a  b", "a \n b", "\n\nx", "don't I'll", "é́ ​ x\x1cy\x85z", "aaaa" * 2000, "".join(random.choices("thenation", k=9000)), "=-" * 3000, " " * 3000, "😀" * 500]
    odd += ["".join(random.choices("ab \n\t'sé.1 ", k=200)) for _ in range(200)]
    for text, stream in zip(odd, machine.encode_group(odd), strict=True):
        ids = np.frombuffer(b"".join(stream), "<u4").tolist()
        assert ids == t.encode(text, add_special_tokens=False).ids
        decoder = machine.decoder()
        assert "".join(decoder.feed(np.array([k], "<u4").tobytes()) for k in ids) + decoder.finish() == text


def test_texts_stream_in_bounded_memory():
    """Tokens come out while a text is read, in parts of any size, whatever it is made of."""
    from tokenizers import Tokenizer

    rng = random.Random(17)
    t, machine = Tokenizer.from_file(BYTE_BPE), bpe_stream.Transducer(BYTE_BPE)
    odd = ["".join(rng.choices("thenation", k=9000)), "7" * 5000, "=-'" * 2500, " " * 4000 + "x", "a" + "\n" * 4000, " " * 3000 + "\n" + " " * 3000, "x " * 4000, "don't we'll " * 900, "é日本語" * 1500, "ab12!?'s" * 800, "word" * 1000 + "'s" + "9" * 3000 + "'ll" + "?" * 3000 + "'ve " + "\t" * 3000 + "end", " " + "a" * 5000 + " 's"]
    odd += ["".join(rng.choice(["x" * rng.randrange(1, 3000), " " * rng.randrange(1, 2500), "5" * rng.randrange(1, 2000), "'s", "'", "!" * rng.randrange(1, 2000), "\n", "é"]) for _ in range(12)) for _ in range(25)]
    for text in odd:
        want = t.encode(text, add_special_tokens=False).ids
        for size in (13, 100, 1500, 70_000):
            stream, out, held, early = bpe_stream.TextStream(machine.merges), [], 0, 0
            for at in range(0, len(text), size):
                got = machine._packed([stream.feed(text[at : at + size])])[0]
                early += len(got) // 4
                out.append(got)
                held = max(held, len(stream.held) + (len(stream.run.held) if stream.run else 0))
            out.append(machine._packed([stream.finish()])[0])
            assert np.frombuffer(b"".join(out), "<u4").tolist() == want
            assert held < 3 * stream.window + size * 4 and (size > 1500 or early > 0)


def test_the_query_reads_texts_as_streams(monkeypatch, spark):
    """The encoder that keeps a bounded rest is what every text goes through, and long runs are encoded as they come."""
    seen = Counter()
    for cls, name in ((bpe_stream.TextStream, "feed"), (bpe_stream.PieceEncoder, "_stable")):
        plain = getattr(cls, name)
        monkeypatch.setattr(cls, name, lambda self, x, plain=plain, name=name: (seen.update([name]), plain(self, x))[1])
    machine = bpe_stream.Transducer(BYTE_BPE)
    for stream in machine.encode_group(["some words", "x" * 100_000, ""]):
        b"".join(stream)
    assert seen["feed"] >= 4 and seen["_stable"] > 10


def test_window_stays_bounded():
    merges = bpe_stream.MergeList(BYTE_BPE)
    encoder, largest = bpe_stream.PieceEncoder(merges), 0
    data = "".join(random.Random(1).choices("thenation", k=40_000)).encode()
    out = []
    for k in range(0, len(data), 100):
        out += encoder.feed(data[k : k + 100])
        largest = max(largest, len(encoder.held))
    assert out + encoder.finish() == merges.window(data) and largest < 4096


# 7 ---------------------------------------------------------------------------


def test_string_kernel():
    from itertools import combinations

    def slow(s, t, order, decay):
        return sum(decay ** (a[-1] - a[0] + b[-1] - b[0] + 2 - 2 * n) for n in range(2, order + 1) for a in combinations(range(len(s)), n) for b in combinations(range(len(t)), n) if all(s[x] == t[y] for x, y in zip(a, b, strict=True)))

    words = ["idiot", "id-iot", "aaa", "ab", "", "morn", "é😀é"]
    got = toxicity.kernels(words, ["idiot", "aa", "moron", "é😀"], 3, 0.5)
    want = [[slow(w, m, 3, 0.5) for m in ("idiot", "aa", "moron", "é😀")] for w in words]
    assert np.allclose(got, want, rtol=1e-4)


def test_toxicity(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, known)).join(known, "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got["toxic"]).mean() > 0.95
    assert set(got["held_out"]) == {True} and got["score"].between(0, 1).all()


def test_toxicity_edges(spark, docs, labels, edges, nothing):
    model = toxicity.fit(docs, labels)
    got = rows(toxicity.score(edges, model), "doc_id", "held_out", "predicted")
    assert got == sorted(((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 0, 0) for i, _ in EDGES), key=repr)
    assert toxicity.score(nothing, model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0))
    assert {r[0] for r in toxicity.score(edges, blank).select("score").collect()} == {0.0}
    assert toxicity.toxic_words("you i d i o t") [-1] == b"idiot"


@pytest.mark.parametrize("gap", [" - ", " . ", "  ", "\r\n", " \t ", "\n\n"])
def test_spelled_words_are_joined_over_any_gap(gap):
    assert toxicity.toxic_words(f"you {gap.join('idiot')} there")[-1] == b"idiot"
    assert toxicity.toxic_words(gap.join("idiot"))[-1] == b"idiot"
    assert toxicity.toxic_words(f"we{gap}are{gap}a{gap}b{gap}team") == [b"we", b"are", b"a", b"b", b"team"]


# 8 ---------------------------------------------------------------------------


def check_packing(packed, texts, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    want = Counter()
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            want[i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    got = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= capacity
    return bins


def test_packing(docs, edges, nothing):
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    bins = check_packing(packing.pack(docs, WORD_BPE), texts, 2048)
    total = sum(n for b in bins.values() for _, n in b)
    assert len(bins) <= 1.02 * total / 2048 + 2
    check_packing(packing.pack(edges, WORD_BPE), EDGES, 2048)
    check_packing(packing.pack(docs, WORD_BPE, capacity=256, group_chars=50_000), texts, 256)
    assert packing.pack(nothing, WORD_BPE).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_capacities_hold(rule):
    lengths = np.random.default_rng(0).integers(1, 60, 500)
    bins, offset = packing.vector_best_fit(lengths, 100, 3, 4000, (1.0, 0.5, 0.5), rule)
    for b in range(bins.max() + 1):
        mine = lengths[bins == b]
        assert mine.sum() <= 100 and len(mine) <= 3 and (mine**2).sum() <= 4000


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), packing.WEIGHTS, (1.0, 0.7, 0.9)])
def test_best_fit_equals_the_plain_loop(rule, weights):
    lengths = np.random.default_rng(1).integers(1, 90, 300)
    total = (100, 4, 8000)
    bins, _ = packing.vector_best_fit(lengths, *total, weights, rule)
    scale = [w / (c * c) for w, c in zip(weights, total, strict=True)]
    left, placed = [], {}
    for k in sorted(range(300), key=lambda k: (-lengths[k], k)):
        need = (int(lengths[k]), 1, int(lengths[k]) ** 2)

        def value(r, need=need):
            terms = [(x - d) ** 2 for x, d in zip(r, need, strict=True)] if rule == "norm" else [-x * d for x, d in zip(r, need, strict=True)]
            return sum(s * t for s, t in zip(scale, terms, strict=True))

        room = [b for b, r in enumerate(left) if all(x >= d for x, d in zip(r, need, strict=True))]
        # the chosen sequence is as good as any that has room
        mine = [b for b in placed.values() if b[0] == bins[k]]
        if not room:
            assert not mine
            left.append(total)
            placed[k] = (bins[k], len(left) - 1)
        else:
            at = mine[0][1]
            assert at in room and value(left[at]) <= min(map(value, (left[b] for b in room))) + 1e-12
            placed[k] = (bins[k], at)
        at = placed[k][1]
        left[at] = tuple(x - d for x, d in zip(left[at], need, strict=True))


def test_production_weights_matter_and_capacities_open_no_sequence(spark):
    """Packing by tokens alone would choose otherwise, and need as many sequences."""
    assert all(w > 0 for w in packing.WEIGHTS)
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 300, 3000), np.full(20_000, 8), rng.integers(1, 60, 20_000)):
        alone, _ = packing.vector_best_fit(lengths, 2048, 2048, 2048**2, (1.0, 0.0, 0.0))
        used, _ = packing.vector_best_fit(lengths, 2048, None, 2048**2, packing.WEIGHTS)
        assert used.max() <= alone.max() and used.max() + 1 == -(-lengths.sum() // 2048)
    mixed = rng.integers(30, 900, 3000)
    alone, _ = packing.vector_best_fit(mixed, 2048, 2048, 2048**2, (1.0, 0.0, 0.0))
    used, _ = packing.vector_best_fit(mixed, 2048, None, 2048**2, packing.WEIGHTS)
    assert (alone != used).any() and used.max() <= alone.max() + 1
    short = spark.createDataFrame([(k, "a") for k in range(3000)], "doc_id long, text string")
    assert packing.pack(short, WORD_BPE).select("sequence_id").distinct().count() == 3


def test_repeated_rows_are_dealt_over_groups(spark):
    same = spark.range(4000).select(F.lit(1).alias("doc_id"), F.lit("one text").alias("text")).repartition(1)
    bins = check_packing(packing.pack(same, WORD_BPE, group_chars=100_000), [(1, "one text")] * 4000, 2048)
    assert len({b % 9 for b in bins}) > 1


# 9 ---------------------------------------------------------------------------


def lines_by_hand(text):
    t = text or ""
    w, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", t), set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    marked = {j + d for j in range(len(w) - 2) if windows[tuple(w[j : j + 3])] > 1 for d in range(3)}
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), failed


def test_quality(spark, docs, labels, edges, nothing):
    both = docs.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    model = quality_crf.fit(docs, labels)
    got = quality_crf.judge(both, model)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows(got, *columns) == sorted(((i, *lines_by_hand(t)) for i, t in both.collect()), key=repr)
    assert got.where("kept and base_failed").count() == 0
    told = got.where("not base_failed").join(labels, "doc_id").toPandas()
    assert (told["kept"] == (told["quality"] == 1)).mean() > 0.9
    assert quality_crf.judge(nothing, model).count() == 0
    kept = quality_crf.retain(docs, model)
    assert rows(kept, "doc_id") == rows(quality_crf.judge(docs, model).where("kept"), "doc_id")
    assert quality_crf.fit(docs, labels.limit(0)).viterbi(np.zeros((0, quality_crf.N_FEATURES)), np.zeros(0, int)).size == 0


def test_viterbi_and_gradient():
    from itertools import product

    rng = np.random.default_rng(0)
    model = quality_crf.LineCrf(rng.normal(size=(quality_crf.N_FEATURES, 2)), rng.normal(size=(2, 2)))
    x, doc = rng.normal(size=(14, quality_crf.N_FEATURES)), np.repeat([0, 3, 4], [6, 1, 7])
    got = model.viterbi(x, doc)
    for d in (0, 3, 4):
        e = x[doc == d] @ model.emit
        best = max(product((0, 1), repeat=len(e)), key=lambda y: sum(e[k, v] for k, v in enumerate(y)) + sum(model.move[a, b] for a, b in zip(y, y[1:], strict=False)))
        assert tuple(got[doc == d]) == best
    y = rng.integers(0, 2, 14)
    fitted = quality_crf.LineCrf.fit(x, doc, y, steps=300)
    assert (fitted.viterbi(x, doc) == y).mean() > 0.9


# 10 --------------------------------------------------------------------------


def test_licenses(docs, edges, nothing):
    both = docs.select("doc_id", "text").unionByName(edges.select("doc_id", "text"))
    want = []
    for i, t in both.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places, found = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            found |= {label} if at else set()
        want.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))))
    got = licenses.scan(both)
    assert rows(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=repr)
    assert licenses.scan(nothing).count() == 0


@pytest.mark.parametrize(
    "text, labels",
    [
        ("under the MIT License.", "mit"),
        ("Licensed under the GNU General Public License, version 3 or later", "gpl-3"),
        ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
        ("Licensed under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa-4.0"),
        ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"),
        ("a mit licensed thing", ""),
        ("Apache License Version 2.0 apache license version 2", "apache-2,apache-2.0"),
    ],
)
def test_rules_suppress_what_they_contain(spark, text, labels):
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["labels"] == labels


def detections_by_hand(text):
    """Every rule over the whole text, and every pair of detections."""
    norm = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))) + " "
    found = []
    for rank, r in enumerate(licenses.signature_rules()):
        if " " + r.keyword in norm:
            found += [(m.start(), m.end(), rank, r.label, r.priority) for m in re.finditer(f"(?<= )(?:{r.pattern})(?= )", norm)]
    strength = lambda d: (d[4], d[1] - d[0], -d[2])
    return sorted(d for d in found if not any(o[0] <= d[0] and o[1] >= d[1] and strength(o) > strength(d) for o in found))


def test_sweep_equals_all_pairs(spark):
    rng = random.Random(12)
    parts = ["licensed under the", "gnu general public license", "version 3", "or later", "mit license", "cc by nc 4 0", "apache license version 2 0", "and", "the", "creative commons attribution", "spdx license identifier mpl 2 0", "all rights reserved", "released into the public domain", *[r[2] for r in licenses.SENTENCES if not re.search(r"[()?\\]", r[2])]]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(60)]
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert sorted(map(tuple, r["detections"])) == detections_by_hand(texts[r["doc_id"]])
    assert len(licenses.signature_rules()) > 500 and max(len(r["detections"]) for r in got) > 10


def test_a_long_list_of_licenses(spark):
    text = "MIT License, GNU General Public License version 3, Apache License 2.0, and more. " * 2000
    start = time.time()
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_words"] == 28_000 and len(got["detections"]) == 6000 and time.time() - start < 60


def test_base_places(spark):
    text = "under the MIT license under the mit-license x under the mit licenses CC by nc cc by nc"
    got = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (19, 4, 0, 16, "cc-by-nc,mit")
