r"""URL filter by association rules.

A labelled URL is a basket of tokens (host labels, domain, path segments, file
extension, query keys, scheme) plus its class.  Frequent tokens that occur in
exactly the same labelled URLs, such as the segments of one deep path, are one
item.  Rules of one item are counted directly, over all tokens.  Spark's FP-growth
mines combinations of up to ``max_length`` items, all of them.  It can't bound
their length, and a basket of n frequent items has 2 ** n, so only baskets of at
most ``whole_items`` are given to it whole.  Of a wider one it gets, for every
choice of up to ``max_length`` groups of items, the items of those groups: a
combination of that length lies in the groups of its own items, and is counted
there in every basket that has it.  What is frequent in either kind of basket is
counted again over all of them.  Rules "items => class" are kept where support,
confidence and lift suffice and no rule of part of the items is as confident.
An inverted index keys every rule by the tokens of its rarest item, so a URL meets
only rules that share a token with it; it fits a rule if it has a token of each item.

URLs are matched by distinct token set, not one by one: numbers are masked, so
many URLs have the same set, and a popular host costs one lookup.  Fixed host
and path rules come first; the longest fitting one decides.

Only DataFrame operations and Spark's own FP-growth are used.

Defined results: a null URL or one without ``://`` has an empty host and path,
no fixed rule, and the verdict of the default; null ids are carried through;
repeated rows give repeated results; without labels nothing is mined and the
default stands.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import ascii_lower, materialize

#: Verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
BLOCK, ALLOW = "=block", "=allow"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct sorted tokens of a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(F.regexp_replace(host, r":\d+$", ""), r"\.")
    segments = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.regexp_replace(ascii_lower(s), r"\d+", "#"))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.element_at(F.split(s, "="), 1))
    found = F.concat(
        F.array(F.concat(F.lit("s:"), F.substring_index(F.coalesce(url, F.lit("")), "://", 1))),
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x)),
        F.when(F.size(labels) > 1, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.expr("cast(array() as array<string>)")),
        F.transform(segments, lambda s: F.concat(F.lit("p:"), s)),
        F.transform(keys, lambda s: F.concat(F.lit("q:"), s)),
        F.when(F.contains(F.coalesce(url, F.lit("")), F.lit("#")), F.array(F.lit("f:"))).otherwise(F.expr("cast(array() as array<string>)")),
    )
    return F.when(_rest(url).isNotNull(), F.array_sort(F.array_distinct(found))).otherwise(F.expr("cast(array() as array<string>)"))


def labelled_pages(pages: DataFrame, labels: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, bad) of pages whose document, the number in the URL's path, is labelled; bad: low quality or toxic."""
    number = F.expr("try_cast(nullif(regexp_extract(_path, '(?:^|/)([0-9]{1,18})(?:[/.]|$)', 1), '') as bigint)")
    urls = pages.select(F.col(url_col).alias("url")).withColumn("_path", path_of(F.col("url"))).withColumn("_doc", number)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_doc")).agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return urls.join(known, "_doc").select("url", "bad")


#: Items of one group in a wide basket.
GROUP_ITEMS = 4


def mine(labelled: DataFrame, min_support: float = 0.0005, min_count: int = 8, min_confidence: float = 0.6, min_lift: float = 1.05, max_length: int = 3, whole_items: int = 12) -> DataFrame:
    """Rules, a row for each key token: rule_id, key, antecedent (the tokens of each item), rule_verdict, confidence, support."""
    spark = labelled.sparkSession
    empty = "rule_id long, key string, antecedent array<array<string>>, rule_verdict string, confidence double, support double"
    rows = labelled.select(tokens_of(F.col("url")).alias("basket"), F.coalesce("bad", F.lit(False)).alias("bad"))
    totals = rows.agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")).first()
    n, bad = totals["n"], totals["bad"]
    if not n:
        return spark.createDataFrame([], empty)
    support = max(min_support, min(1.0, min_count / n))
    # tokens of the same URLs have the same sum of the URLs' hashes
    each = rows.withColumn("h", F.xxhash64("basket", "bad").cast("decimal(38,0)")).withColumn("token", F.explode("basket"))
    tokens = each.groupBy("token").agg(F.count("*").alias("freq"), F.sum(F.col("bad").cast("long")).alias("n_bad"), F.sum("h").alias("h")).where(F.col("freq") >= support * n)
    items = tokens.groupBy("freq", "n_bad", "h").agg(F.min("token").alias("item"), F.sort_array(F.collect_set("token")).alias("tokens")).drop("h")
    items = materialize(items, "url-items")
    single = rules_of(items.select(F.array("item").alias("antecedent"), "freq", "n_bad"), n, bad, support, min_confidence, min_lift)

    # each set of items once, with the URLs that have it
    named = rows.groupBy("basket").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("n_bad")).withColumn("token", F.explode("basket"))
    sets = named.join(items.select(F.explode("tokens").alias("token"), "item"), "token").groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items"), F.first("n").alias("n"), F.first("n_bad").alias("n_bad"))
    sets = materialize(sets.groupBy("items").agg(F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")), "url-sets")
    rules = single
    if max_length > 1 and not sets.isEmpty():
        found = candidates(sets, items, max(2, -(-int(support * n * 1_000_000) // 1_000_000)), max_length, whole_items)
        if found is not None:
            rules = rules.unionByName(rules_of(counted(found, sets, items), n, bad, support, min_confidence, min_lift))
    rules = materialize(rules.select(F.array_sort("antecedent").alias("antecedent"), "rule_verdict", "confidence", "support"), "url-rules")
    # a longer rule must beat every rule of part of its items
    parts = rules.where(F.size("antecedent") > 1).withColumn("part", F.explode(combinations("antecedent", max_length - 1))).where(F.size("part") < F.size("antecedent"))
    beaten = parts.alias("r").join(rules.alias("s"), (F.col("r.part") == F.col("s.antecedent")) & (F.col("r.rule_verdict") == F.col("s.rule_verdict")) & (F.col("s.confidence") >= F.col("r.confidence")))
    beaten = beaten.select(F.col("r.antecedent").alias("antecedent"), F.col("r.rule_verdict").alias("rule_verdict")).distinct()
    rules = rules.join(beaten, ["antecedent", "rule_verdict"], "left_anti").withColumn("rule_id", F.xxhash64("antecedent", "rule_verdict"))
    full = rules.withColumn("item", F.explode("antecedent")).join(items, "item").groupBy("rule_id", "rule_verdict", "confidence", "support")
    full = full.agg(F.sort_array(F.collect_list("tokens")).alias("antecedent"), F.min_by("tokens", F.struct("freq", "item")).alias("keys"))
    return full.select("rule_id", F.explode("keys").alias("key"), "antecedent", "rule_verdict", "confidence", "support")


def rules_of(found: DataFrame, n: int, bad: int, support: float, min_confidence: float, min_lift: float) -> DataFrame:
    """Rules for either verdict that support, confidence and lift suffice for; found: antecedent, freq, n_bad.

    Where most URLs are allowed, nearly every item "implies" it; only what says more than the class's share counts.
    """
    out = None
    for verdict, count, share in (("block", F.col("n_bad"), bad / n), ("allow", F.col("freq") - F.col("n_bad"), 1 - bad / n)):
        part = found.select("antecedent", F.lit(verdict).alias("rule_verdict"), (count / F.col("freq")).alias("confidence"), (count / n).alias("support"))
        part = part.where((F.col("support") >= support) & (F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * share))
        out = part if out is None else out.unionByName(part)
    return out


def combinations(values: str | Column, most: int) -> Column:
    """All choices of 1 to ``most`` items of an array, each in the array's order."""
    values = F.col(values) if isinstance(values, str) else values
    if most <= 1:
        return F.transform(values, lambda x: F.array(x))

    def with_first(x: Column, k: Column) -> Column:
        rest = F.slice(values, k + 2, F.greatest(F.size(values) - k - 1, F.lit(0)))
        return F.concat(F.array(F.array(x)), F.transform(combinations(rest, most - 1), lambda c: F.concat(F.array(x), c)))

    return F.flatten(F.transform(values, with_first))


def candidates(sets: DataFrame, items: DataFrame, least: int, max_length: int, whole_items: int) -> DataFrame | None:
    """Combinations of 2 to ``max_length`` items that ``least`` URLs of one class may have."""
    wide = sets.where(F.size("items") > whole_items)
    n_wide = wide.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_all = sets.agg(F.sum("n")).first()[0]
    # what both kinds of baskets together have often enough, one of them has as often as its part of the threshold
    of_wide = least if n_wide == n_all else min(least - 1, max(2, round(least * n_wide / n_all))) if n_wide else 0
    of_narrow = least + 1 - of_wide if n_wide else least
    parts = []
    if n_wide < n_all:
        parts.append(frequent(sets.where(F.size("items") <= whole_items), of_narrow, max_length))
    if n_wide:
        parts.append(frequent(in_groups(wide, items, max_length), of_wide, max_length))
    found = [p for p in parts if p is not None]
    return (found[0].unionByName(found[-1]) if len(found) > 1 else found[0]).distinct() if found else None


def in_groups(wide: DataFrame, items: DataFrame, max_length: int) -> DataFrame:
    """Sets (tag, items, n, n_bad): of each wide set, the items of every choice of up to ``max_length`` groups.

    Items are dealt to groups in the order of how many URLs have them, to so many
    groups that no set has more than ``GROUP_ITEMS`` of one.
    """
    order = Window.orderBy(F.desc("freq"), "item")
    # items are frequent tokens, whose number the support bounds
    ranked = items.select("item", (F.row_number().over(order) - 1).alias("place"))
    n_items = items.count()
    placed = materialize(wide.withColumn("set_id", F.monotonically_increasing_id()).withColumn("item", F.explode("items")).join(ranked, "item").select("set_id", "n", "n_bad", "item", "place"), "url-places")
    groups = 1
    while groups < n_items and placed.groupBy("set_id", F.pmod("place", F.lit(groups))).count().where(F.col("count") > GROUP_ITEMS).limit(1).count():
        groups = min(n_items, 2 * groups)
    held = placed.groupBy("set_id", F.pmod("place", F.lit(groups)).alias("g")).agg(F.collect_list("item").alias("items"), F.first("n").alias("n"), F.first("n_bad").alias("n_bad"))
    held = held.groupBy("set_id").agg(F.sort_array(F.collect_list(F.struct("g", "items"))).alias("groups"), F.first("n").alias("n"), F.first("n_bad").alias("n_bad"))
    chosen = held.withColumn("choice", F.explode(combinations("groups", max_length)))
    tag = F.array_join(F.transform("choice", lambda c: c["g"].cast("string")), ",")
    return chosen.select(tag.alias("tag"), F.flatten(F.transform("choice", lambda c: c["items"])).alias("items"), "n", "n_bad")


def frequent(sets: DataFrame, least: int, max_length: int) -> DataFrame | None:
    """(items) of 2 to ``max_length`` that ``least`` URLs of one class have together, by FP-growth over the sets' URLs."""
    tag = F.concat("tag", F.lit("\u0002")) if "tag" in sets.columns else F.lit("\u0002")
    marked = lambda mark: F.transform(F.array_append("items", F.lit(mark)), lambda x: F.concat(tag, x))
    urls = lambda mark, n: sets.select(F.explode(F.array_repeat(marked(mark), n.cast("int"))).alias("items"))
    baskets = materialize(urls(BLOCK, F.col("n_bad")).unionByName(urls(ALLOW, F.col("n") - F.col("n_bad"))), "url-baskets")
    n = baskets.count()
    if n < least:
        return None
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=1.0).fit(baskets)
    plain = F.transform("items", lambda x: F.substring_index(x, "\u0002", -1))
    found = model.freqItemsets.where((F.size("items") >= 3) & (F.size("items") <= max_length + 1)).select(plain.alias("items"))
    classed = found.where(F.array_contains("items", BLOCK) | F.array_contains("items", ALLOW))
    return classed.select(F.array_sort(F.array_except("items", F.array(F.lit(BLOCK), F.lit(ALLOW)))).alias("items"))


def counted(found: DataFrame, sets: DataFrame, items: DataFrame) -> DataFrame:
    """(antecedent, freq, n_bad) of combinations over all sets; each meets the sets that have its rarest item."""
    keyed = found.withColumn("item", F.explode("items")).join(items.select("item", "freq"), "item")
    keyed = keyed.groupBy(F.col("items").alias("antecedent")).agg(F.min_by("item", F.struct("freq", "item")).alias("item"))
    met = sets.withColumn("item", F.explode("items")).join(keyed, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
    return met.groupBy("antecedent").agg(F.sum("n").alias("freq"), F.sum("n_bad").alias("n_bad"))


def judge(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str, str]] | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, and the mined rule that spoke."""
    url = F.col("_url")
    df = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    df = df.select("_id", host_of(url).alias("host"), path_of(url).alias("path"), F.array_join(tokens_of(url), "\u0001").alias("_set"))

    tokens = F.split("_set", "\u0001")
    sets = df.select("_set").distinct()
    hits = sets.withColumn("key", F.explode(tokens)).join(rules, "key")
    hits = hits.where(F.forall("antecedent", lambda item: F.arrays_overlap(item, tokens)))
    order = F.struct("confidence", "support", F.col("rule_verdict"), "rule_id")
    mined = hits.groupBy("_set").agg(F.max_by(F.struct("rule_verdict", "antecedent", "confidence"), order).alias("_mined"))

    found = df.join(mined, "_set", "left")
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, host, path in sorted(RULES if fixed is None else fixed, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        chosen = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    found = found.withColumn("_rule", chosen)
    return found.select(
        F.col("_id").alias(id_col),
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "_mined.rule_verdict", F.lit(default)).alias("verdict"),
        F.array_join(F.transform("_mined.antecedent", lambda item: F.array_join(item, "|")), " ").alias("mined_rule"),
        F.col("_mined.confidence").alias("confidence"),
    )
