r"""Near-duplicate documents by MinHash with tensored banding.

Classic banding with L tables of k hashes needs k * L min-hashes.  Here two
collections of ``tables`` tuples of ``width`` min-hashes each are computed, and a
table key joins one tuple of either, so 2 * tables * width hashes serve
tables ** 2 tables of 2 * width hashes: about the square root.  With the
defaults (16 and 3) a pair of similarity 0.75 is missed with a probability of
3e-4 by the keys; every candidate is confirmed on the full shingle sets.

Steps, all as Spark joins and aggregations; nodes are classes of documents with
equal shingle sets, so texts that share an id stay apart until the end:

1. one pass over the texts gives the hashes;
2. a tuple that only one class has can't lead to a partner, so only shared ones
   of either collection are combined into table keys;
3. each class is compared with one leader: the class with the most partners in
   any of its buckets, which is the likely original of a group of copies;
4. classes that are still apart from others of a bucket are compared, round by
   round, with the closest of new random members of their buckets' largest
   components, as long as that finds links;
5. what is then still in different components and shares a table key is compared
   in full, after an exact bound: shingles that fall on different bits of a bitmap
   are different, so the bits that two sets share, and what collides within either,
   bound what they have in common.  The largest component of a bucket meets the
   others, never itself.

Every candidate of the tables is thus confirmed on full sets, or is in one
component by other links, or can't reach the similarity.

Defined results: null or wordless texts have empty sets, are linked with
nothing and kept; texts of fewer than five words are one shingle; rows with a
null id are kept with a null component; repeated rows share their component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_slices, materialize, text_groups, words_of
from tesserae.llm.components import connected_components

GROUP_CHARS = 1_000_000
CACHE_ENTRIES = 150_000
SEED = 20240229
#: Low bits of the min-hashes, 64 a column; they only say which member of a bucket is the closest.
BITS = ["s1", "s2"]
ROUNDS = 2
#: Bits of a bitmap of shingles, 64 a column.
MAP = [f"m{k}" for k in range(32)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd(n: int, salt: int) -> np.ndarray:
    return np.random.default_rng([SEED, salt]).integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    if len(_hashes) > CACHE_ENTRIES:
        _hashes.clear()
    factor = _odd(words, 1)
    out = []
    for text in texts:
        found = words_of(text)
        h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
        if len(h) < words:
            out.append(_mixed((h * factor[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h))) if len(h) else h)
            continue
        n = len(h) - words + 1
        total = h[:n] * factor[0]
        for k in range(1, words):
            total += h[k : k + n] * factor[k]
        out.append(np.unique(_mixed(total)))
    return out


def sketches(docs: DataFrame, tables: int = 16, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, set_key, two collections u and v of tuple hashes, and the hashes' low bits."""
    n_hash = 2 * tables * width
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def make():
        factor, offset, tuple_factor = _odd(n_hash, 2), _odd(n_hash, 3), _odd(width, 4)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            n_rows = len(texts)
            sizes, keys = np.zeros(n_rows, np.int64), [b""] * n_rows
            tuples = np.zeros((n_rows, 2 * tables), np.uint64)
            bits = np.zeros((n_rows, len(BITS)), np.uint64)
            for a, b in text_groups(texts, GROUP_CHARS):
                sets = shingle_sets(texts[a:b])
                sizes[a:b] = [len(s) for s in sets]
                keys[a:b] = [class_key(s) for s in sets]
                filled = np.flatnonzero(sizes[a:b])
                if not len(filled):
                    continue
                x = np.concatenate(sets)
                starts = np.concatenate([[0], np.cumsum(sizes[a:b][filled])[:-1]])
                low = np.empty((len(filled), n_hash), np.uint64)
                for k in range(n_hash):
                    low[:, k] = np.minimum.reduceat((x ^ offset[k]) * factor[k], starts)
                low = _mixed(low)
                tuples[a + filled] = _mixed((low.reshape(len(filled), 2 * tables, width) * tuple_factor).sum(2, dtype=np.uint64))
                seen = np.resize(np.arange(n_hash), 64 * len(BITS))
                bits[a + filled] = ((low[:, seen] & np.uint64(1)).reshape(len(filled), -1, 64) << np.arange(64, dtype=np.uint64)).sum(2, dtype=np.uint64)
            signed = tuples.view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, n_rows * tables + 1, tables), pa.int32()), pa.array(np.ascontiguousarray(part).ravel())) for part in (signed[:, :tables], signed[:, tables:])]
            longs = bits.view(np.int64)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(keys, pa.binary()), *lists, *[pa.array(np.ascontiguousarray(longs[:, k])) for k in range(len(BITS))]],
                names=["id", "n_shingles", "set_key", "u", "v", *BITS],
            )

        return step

    return map_slices(source, make, "id long, n_shingles long, set_key binary, u array<long>, v array<long>, " + ", ".join(f"{c} long" for c in BITS))


def _sizes_allow(left: str, right: str, percent: int) -> Column:
    return F.expr(f"100 * least({left}.n, {right}.n) >= {percent} * greatest({left}.n, {right}.n)")


def _gap(left: str, right: str) -> Column:
    """How many of the sketches' bits differ."""
    return F.expr(" + ".join(f"bit_count({left}.{c} ^ {right}.{c})" for c in BITS))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets (id, items)."""
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("left"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("right"))
    held = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            keep = []
            left, right = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                x, y = np.frombuffer(left[k].as_py(), np.uint64), np.frombuffer(right[k].as_py(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return held.mapInArrow(run, "a binary, b binary")


def full_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, items): the shingle sets of the classes in ``nodes`` (id, doc), each from the text of document ``doc``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    source = source.join(nodes.select("doc").distinct().hint("merge"), "doc", "left_semi")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = shingle_sets(batch.column(0).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array([class_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "items"])

        return step

    found = map_slices(source.select("text"), make, "id binary, items binary")
    # an id may have several texts, and a text several rows
    return found.join(nodes.select("id"), "id", "left_semi").dropDuplicates(["id"])


def class_key(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def bitmaps(sets: DataFrame) -> DataFrame:
    """(id, n, spare, m0, m1, ...): sizes of sets (id, items), bitmaps of their shingles, and how many of these fall on bits taken."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out, size = np.zeros((batch.num_rows, len(MAP)), np.uint64), np.zeros(batch.num_rows, np.int64)
            for k, blob in enumerate(batch.column(1).to_pylist()):
                x = np.frombuffer(blob, np.uint64)
                size[k] = len(x)
                x = x >> np.uint64(20)
                np.bitwise_or.at(out[k], (x >> np.uint64(6)) % np.uint64(len(MAP)), np.uint64(1) << (x & np.uint64(63)))
            spare = size - np.bitwise_count(out).sum(1).astype(np.int64)
            longs = out.view(np.int64)
            columns = [batch.column(0), pa.array(size), pa.array(spare), *[pa.array(np.ascontiguousarray(longs[:, k])) for k in range(len(MAP))]]
            return pa.RecordBatch.from_arrays(columns, names=["id", "n", "spare", *MAP])

        return step

    return map_slices(sets.select("id", "items"), make, "id binary, n long, spare long, " + ", ".join(f"{c} long" for c in MAP))


def _maps_allow(left: str, right: str, percent: int) -> Column:
    """Whether intersection over union can reach the similarity, by the most that two sets can have in common."""
    common = " + ".join(f"bit_count({left}.{c} & {right}.{c})" for c in MAP)
    return F.expr(f"(100 + {percent}) * ({common} + least({left}.spare, {right}.spare)) >= {percent} * ({left}.n + {right}.n)")


def component_classes(docs: DataFrame, percent: int = 75, tables: int = 16, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (id, n_shingles, set_key, ...) of the documents, and (node, component) of the classes that have links."""
    rows = materialize(sketches(docs, tables, width, id_col, text_col), "sketches")
    filled = rows.where("n_shingles > 0 and id is not null")
    classes = filled.groupBy(F.col("set_key").alias("rep")).agg(F.min("id").alias("doc"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("u", "v", *BITS)])
    classes = materialize(classes, "classes")
    sketch = classes.select("rep", "n", *BITS)

    def shared(side: str, part: str) -> DataFrame:
        """(rep, part, c): tuples of one collection that several classes have, and how many."""
        rows = classes.select("rep", F.posexplode(side).alias("i", "value")).select("rep", F.xxhash64("i", "value").alias(part))
        return rows.join(rows.groupBy(part).agg(F.count("*").alias("c")).where("c > 1"), part).select("rep", part, "c")

    live = materialize(shared("u", "part"), "live")
    partners = live.groupBy("rep").agg(F.sum("c").alias("w"))
    keys = live.select("rep", "part").join(shared("v", "other").select("rep", "other"), "rep").join(partners, "rep")
    keys = materialize(keys.select("rep", F.xxhash64("part", "other").alias("key"), "w"), "keys")
    leaders = keys.groupBy("key").agg(F.max_by("rep", "w").alias("leader"), F.max("w").alias("lw"), F.count("*").alias("c")).where("c > 1").drop("c")
    # every class that shares a key with another one, and the leader it meets
    nearest = keys.select("key", "rep").join(leaders, "key").groupBy("rep").agg(F.max_by("leader", F.when(F.col("rep") != F.col("leader"), F.col("lw"))).alias("leader"))
    nearest = materialize(nearest.join(classes.select("rep", "doc"), "rep"), "nearest")
    # the texts are dealt by id, at every size alike
    sets = materialize(full_sets(docs, nearest.select(F.col("rep").alias("id"), "doc"), id_col, text_col), "sets")
    live = live.join(nearest.select("rep"), "rep", "left_semi")

    def ordered(x: str, y: str) -> tuple[Column, Column]:
        return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")

    def component_of(frame: DataFrame, parts: DataFrame) -> DataFrame:
        return frame.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left").select(*frame.columns, F.coalesce("component", "rep").alias("comp"))

    def mixed(members: DataFrame, parts: DataFrame) -> DataFrame:
        """(part, rep, comp, top): members of buckets with several components, and the largest of these."""
        member = component_of(members.select("part", "rep"), parts)
        sizes = member.groupBy("part", "comp").agg(F.count("*").alias("c"))
        top = sizes.groupBy("part").agg(F.max_by("comp", "c").alias("top"), F.count("*").alias("comps")).where("comps > 1").drop("comps")
        return member.join(top, "part")

    def as_edges(parts: DataFrame) -> DataFrame:
        return parts.select(F.col("node").alias("a"), F.col("component").alias("b"))

    tried = with_sizes(nearest.where("rep <> leader").select(*ordered("rep", "leader")).distinct(), sketch, percent)
    tried = materialize(tried, "pairs")
    parts = connected_components(confirmed(tried, sets, percent))

    # random members of each bucket's largest component, against the members outside of it
    inside = materialize(mixed(live, parts).join(sketch, "rep"), "mixed")
    for turn in range(ROUNDS):
        picked = inside.where("comp = top").groupBy("part").agg(*[F.min_by(c, F.xxhash64("rep", "part", F.lit(turn))).alias(f"_{c}") for c in ("rep", "n", *BITS)])
        near = inside.where("comp <> top").alias("x").join(picked.select("part", F.col("_rep").alias("mate"), F.struct(*[F.col(f"_{c}").alias(c) for c in ("n", *BITS)]).alias("y")), "part")
        near = near.where(_sizes_allow("x", "y", percent)).groupBy("rep").agg(F.min_by("mate", _gap("x", "y")).alias("mate"))
        near = materialize(near.select(*ordered("rep", "mate")).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        links = materialize(confirmed(near, sets, percent), "links")
        tried = tried.unionByName(near)
        if links.isEmpty():
            break
        parts = connected_components(as_edges(parts).unionByName(links))
        inside = materialize(mixed(inside, parts).join(sketch, "rep"), "mixed")

    # the rest in full: pairs that share a table key, where sizes and bitmaps allow the similarity
    marked = materialize(bitmaps(sets.join(inside.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")), "bitmaps").withColumnRenamed("id", "rep")
    inside = inside.select("part", "rep", "comp", "top").join(marked, "rep").join(classes.select("rep", "v"), "rep")
    minor, y = inside.where("comp <> top").alias("x"), inside.alias("y")
    met = (F.col("x.part") == F.col("y.part")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.top")) | (F.col("x.rep") < F.col("y.rep")))
    cross = minor.join(y, met & _maps_allow("x", "y", percent) & F.arrays_overlap("x.v", "y.v")).select(*ordered("x.rep", "y.rep")).distinct()
    cross = materialize(cross.join(tried, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        parts = connected_components(as_edges(parts).unionByName(confirmed(cross, sets, percent)))
    return rows, parts


def with_sizes(pairs: DataFrame, sketch: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow the similarity."""
    a = sketch.select(F.col("rep").alias("a"), F.struct("n").alias("x"))
    b = sketch.select(F.col("rep").alias("b"), F.struct("n").alias("y"))
    return pairs.join(a, "a").join(b, "b").where(_sizes_allow("x", "y", percent)).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 75, tables: int = 16, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    rows, parts = component_classes(docs, percent, tables, width, id_col, text_col)
    filled = rows.where("n_shingles > 0 and id is not null")
    members = filled.select("id", "set_key").distinct().join(parts.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    members = materialize(members.select("id", F.coalesce("component", "set_key").alias("component")), "members")
    # an id that several components have ties them together
    tied = members.groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b")
    tied = members.join(tied.select("id", F.col("a").alias("first")), "id").where("component <> first").select(F.col("component").alias("a"), F.col("first").alias("b"))
    if not tied.isEmpty():
        joined = connected_components(tied).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        members = members.join(joined, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    first = members.groupBy("component").agg(F.min("id").alias("component_id"))
    named = members.join(first, "component").groupBy("id").agg(F.min("component_id").alias("component_id"))
    out = rows.select("id", "n_shingles").join(named, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one of each group of near-duplicates.

    The one that stays is that with the smallest id; texts without words and rows
    without an id stay, once for each id and text where ids are repeated.
    """
    rows, parts = component_classes(docs, percent, id_col=id_col, text_col=text_col)
    filled = rows.where("n_shingles > 0 and id is not null").select("id", "set_key").join(parts.select(F.col("node").alias("set_key"), "component"), "set_key", "left")
    filled = filled.select("id", "set_key", F.coalesce("component", "set_key").alias("component"))
    kept = filled.groupBy("component").agg(F.min(F.struct("id", "set_key")).alias("k")).select("k.id", "k.set_key")
    repeated = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id")
    repeated = materialize(repeated, "repeated")
    gone = filled.select("id").distinct().join(kept, "id", "left_anti").unionByName(repeated).distinct()
    gone = materialize(gone, "gone")
    # a document is one column beside its id, so that its columns may have any names
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    left = whole.join(gone, "id", "left_anti").select("document.*")
    if repeated.isEmpty():
        return left
    # rows of repeated ids are told apart by their texts
    text = F.col("document").getField(text_col).cast("string")
    unclear = whole.join(repeated, "id", "left_semi").withColumn("digest", F.sha2(F.coalesce(text, F.lit("")), 256))
    unclear = materialize(unclear.dropDuplicates(["id", "digest"]), "unclear")
    told = map_slices(unclear.select("id", "digest", text.alias("text")), keyed_texts, "id long, digest string, n_shingles long, set_key binary")
    told = told.join(kept.withColumn("stays", F.lit(True)), ["id", "set_key"], "left").where("stays or n_shingles = 0")
    # texts of one class differ in white space or case only; one of them stays
    chosen = told.groupBy("id", F.when(F.col("n_shingles") > 0, F.hex("set_key")).otherwise(F.col("digest")).alias("one")).agg(F.min("digest").alias("digest")).select("id", "digest")
    again = unclear.join(chosen, ["id", "digest"], "left_semi")
    return left.unionByName(again.select("document.*"))


def keyed_texts():
    """A batch function: shingle count and class of each text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_key(s) for s in sets], pa.binary())], names=["id", "digest", "n_shingles", "set_key"])

    return step
