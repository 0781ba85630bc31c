r"""License scan by ordered signature rules.

Rules are regular expressions over a text's normalised words, some hundreds in
all: sentences of well-known licenses written out by hand, and what families of
names, versions and phrasings generate.  A rule runs only where its keyword
occurs; its detections are intervals of the normalised text.  A detection is
dropped when another of higher priority, or of the same priority and longer, or
equal but of an earlier rule, contains it: one pass over the detections by their
beginnings keeps how far each priority has reached so far.

Everything is one projection of built-in functions: no shuffle, no Python.

Defined results: null and empty texts have no words, no labels and score 0; null
ids are carried through; repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import ascii_lower

#: Phrases that always count, and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: What is no part of a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Label, names as normalised words, versions, whether the name alone is evidence.
FAMILIES = [
    ("apache", ["apache license", "apache software license", "asl"], ["1 0", "1 1", "2 0", "2"]),
    ("gpl", ["gnu general public license", "general public license", "gnu gpl", "gpl"], ["1", "2", "3", "1 0", "2 0", "3 0"]),
    ("lgpl", ["gnu lesser general public license", "lesser general public license", "library general public license", "gnu lgpl", "lgpl"], ["2", "2 1", "3"]),
    ("agpl", ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl"], ["1", "3"]),
    ("gfdl", ["gnu free documentation license", "free documentation license"], ["1 1", "1 2", "1 3"]),
    ("mpl", ["mozilla public license"], ["1 0", "1 1", "2 0"]),
    ("epl", ["eclipse public license"], ["1 0", "2 0"]),
    ("eupl", ["european union public license", "european union public licence"], ["1 1", "1 2"]),
    ("cddl", ["common development and distribution license"], ["1 0", "1 1"]),
    ("osl", ["open software license"], ["2 1", "3 0"]),
    ("artistic", ["artistic license"], ["1 0", "2 0"]),
    ("boost", ["boost software license"], ["1 0"]),
    ("ofl", ["sil open font license", "open font license"], ["1 0", "1 1"]),
    ("odbl", ["open database license"], ["1 0"]),
    ("ms-pl", ["microsoft public license"], []),
    ("mit", ["mit license", "mit licence", "expat license"], []),
    ("isc", ["isc license"], []),
    ("zlib", ["zlib license", "zlib libpng license"], []),
    ("bsd-2-clause", ["bsd 2 clause license", "simplified bsd license", "freebsd license"], []),
    ("bsd-3-clause", ["bsd 3 clause license", "new bsd license", "modified bsd license"], []),
    ("bsd", ["bsd license", "bsd style license"], []),
    ("unlicense", ["the unlicense"], []),
    ("psf", ["python software foundation license"], ["2"]),
    ("cc0", ["cc0", "creative commons zero"], ["1 0"]),
]
#: Parts of Creative Commons licenses, in short and in words.
COMMONS = [("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(atives|s)?"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(atives|s)?")]
COMMONS_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
GRANTS = ["licensed under", "released under", "distributed under", "available under", "published under", "made available under the terms of"]


#: Sentences by which licenses are known, each with its label, keyword and priority.
SENTENCES = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy( of this software)?", 4),
    ("mit", "permission is hereby granted", "permission is hereby granted( free of charge)?", 1),
    ("isc", "permission to use copy modify", "permission to use copy modify and(/| )?(or )?distribute this software for any purpose with or without fee is hereby granted", 4),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms( with or without modification)?( are permitted)?", 3),
    ("bsd-3-clause", "endorse or promote products", "endorse or promote products derived from this software without( specific)? prior written permission", 3),
    ("zlib", "provided as is", "this software is provided as is without any express or implied warranty", 2),
    ("apache-2.0", "you may not use this file", "you may not use this file except in compliance with the license", 3),
    ("apache", "apache org licenses", "apache org licenses( license \\d \\d)?", 3),
    ("gpl", "gnu org licenses", "gnu org licenses( gpl)?", 2),
    ("gpl", "free software foundation", "under the terms of the gnu general public license as published by the free software foundation", 4),
    ("lgpl", "free software foundation", "under the terms of the gnu lesser general public license as published by the free software foundation", 4),
    ("agpl", "free software foundation", "under the terms of the gnu affero general public license as published by the free software foundation", 4),
    ("mpl-2.0", "source code form is subject", "this source code form is subject to the terms of the mozilla public license v 2 0", 4),
    ("mpl", "mozilla org mpl", "mozilla org mpl( \\d \\d)?", 3),
    ("epl", "eclipse org legal epl", "eclipse org legal epl v?\\d\\d?", 3),
    ("boost-1.0", "boost org license", "boost org license 1 0( txt)?", 4),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain", 4),
    ("wtfpl", "what the fuck you want", "do what the fuck you want to( public license)?", 4),
    ("cc0-1.0", "public domain dedication", "cc0( 1 0)?( universal)? public domain dedication", 4),
    ("public-domain", "public domain", "(is|are) in the public domain", 1),
    ("odc-by", "open data commons attribution", "open data commons attribution license", 3),
    ("pddl", "open data commons public domain", "open data commons public domain dedication and license", 3),
    ("gfdl", "free documentation license", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 4),
    ("artistic-2.0", "standard version", "you are permitted to use and create and use modified versions for any purpose without restriction", 3),
    ("beerware", "beer ware", "the beer ware license", 3),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 2),
    ("proprietary", "no part of this publication", "no part of this publication may be reproduced", 2),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file( via any medium)? is strictly prohibited", 2),
    ("non-commercial", "non commercial use only", "for non commercial use only", 1),
    ("research-only", "research purposes only", "for research purposes only", 1),
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


def signature_rules() -> list[Rule]:
    """All rules in order; priority 3: named grant with version, 2: name with version, 1: name, 0: a hint."""
    rules = [Rule(label, keyword, pattern, priority) for label, keyword, pattern, priority in SENTENCES]
    for label, names, versions in FAMILIES:
        for name in names:
            for version in versions:
                full = f"{label}-{version.replace(' ', '.')}"
                exact = f"{name}( version| v)? ?{version}"
                rules.append(Rule(full, name, f"({'|'.join(GRANTS)})( the)?( terms of the)? {exact}( or later| or any later version)?", 3))
                rules.append(Rule(full, name, f"{exact}( or later| or any later version)?", 2))
                rules.append(Rule(full, name, f"version {version} of the {name}", 3))
            rules.append(Rule(label, name, f"({'|'.join(GRANTS)})( the)?( terms of the)? {name}", 2))
            rules.append(Rule(label, name, name, 1))
        for version in versions:
            short = f"{label.replace('-', ' ')} {version}"
            rules.append(Rule(f"{label}-{version.replace(' ', '.')}", "spdx license identifier", f"spdx license identifier {short}( only| or later)?", 4))
        rules.append(Rule(label, "spdx license identifier", f"spdx license identifier {label.replace('-', ' ')}", 3))
    for short, words in COMMONS:
        label = "cc-" + short.replace(" ", "-")
        for version in COMMONS_VERSIONS:
            full = f"{label}-{version.replace(' ', '.')}"
            rules.append(Rule(full, "cc by", f"({'|'.join(GRANTS)})( the| a)? cc {short} {version}", 3))
            rules.append(Rule(full, "cc by", f"cc {short} {version}", 2))
            rules.append(Rule(full, "creative commons", f"creative commons {words} {version}", 2))
            rules.append(Rule(full, "creativecommons org licenses", f"creativecommons org licenses {short} {version}", 4))
        rules.append(Rule(label, "cc by", f"cc {short}", 1))
        rules.append(Rule(label, "creative commons", f"creative commons {words}( license)?", 1))
    rules.append(Rule("public-domain", "public domain", "(released|placed|dedicated) (in|into|to) the public domain", 2))
    rules.append(Rule("creative-commons", "creative commons", "creative commons( license)?", 0))
    rules += [Rule("unknown-license", "licensed under", f"{grant}( the)?( terms of)?( this)?( license)?", 0) for grant in GRANTS[:1]]
    rules.append(Rule("proprietary", "all rights reserved", "all rights reserved", 0))
    return list(dict.fromkeys(rules))


#: Each keyword holds one of these, so a text without any needs no rule.
GATES = ["licen", "spdx", "cc by", "cc0", "commons", "gpl", "asl", "public domain", "all rights reserved", "creativecommons", *sorted({keyword for _, keyword, _, _ in SENTENCES})]


#: A detection, its fields in the order of the sweep.
SPAN = "begin: int, minus_end: int, minus_priority: int, rank: int, label: string"


def _count_words(col: Column) -> Column:
    return F.when(col == "", F.lit(0)).otherwise(F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit(""))) + 1).cast("long")


def _spaces(col: Column) -> Column:
    return F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))


def _rule_array(rules: list[Rule]) -> Column:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"struct({k} as rank, {quote(r.label)} as label, {quote(' ' + r.keyword)} as keyword, {quote('(?<= )(?:' + r.pattern + ')(?= )')} as pattern, {r.priority} as priority)" for k, r in enumerate(rules))
    return F.expr(f"array({rows})")


def scan(docs: DataFrame, rules: list[Rule] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: words, base phrase places, labels, score and the kept detections."""
    rules = signature_rules() if rules is None else rules
    phrases = BASE_PHRASES if phrases is None else phrases
    if ungated := [r for r in rules if not any(g in r.keyword for g in GATES)]:
        raise ValueError(f"no gate holds the keyword of {ungated[0]}")
    top = max([r.priority for r in rules], default=0) + 1
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("_id"), F.trim(F.regexp_replace(ascii_lower(text), GAP, " ")).alias("_plain"))
    df = df.select("_id", _count_words(F.col("_plain")).alias("n_words"), F.concat(F.lit(" "), "_plain", F.lit(" ")).alias("_norm"))

    norm = F.col("_norm")
    pieces = {p: F.when(F.contains(norm, F.lit(f" {p} ")), F.split(norm, f"(?<= ){p}(?= )", -1)) for p in phrases}
    df = df.select("*", *[pieces[p].alias(f"_p{k}") for k, p in enumerate(phrases)])
    places, firsts, lasts, base_labels = [], [], [], []
    for k, (p, label) in enumerate(phrases.items()):
        cut = F.col(f"_p{k}")
        places.append(F.when(cut.isNull(), F.lit(0)).otherwise(F.size(cut) - 1))
        firsts.append(_spaces(F.element_at(cut, 1)) - 1)
        before_last = F.substring(norm, F.lit(1), F.length(norm) - F.length(F.element_at(cut, -1)) - len(p))
        lasts.append(_spaces(before_last) - 1)
        base_labels.append(F.when(cut.isNotNull(), F.lit(label)))
    least = lambda xs: F.array_min(F.array_compact(F.array(*xs)))
    most = lambda xs: F.array_max(F.array_compact(F.array(*xs)))

    def detections(rule: Column) -> Column:
        found = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
        cut = F.split(norm, rule["pattern"], -1)

        # what stands before each find, and its length; the text after the last one has no find
        steps = F.zip_with(cut, found, lambda c, f: F.struct(F.length(c).alias("skip"), F.length(f).alias("size")))
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<struct<{SPAN}>>)").alias("spans"))

        def add(done: Column, x: Column) -> Column:
            begin = done["at"] + x["skip"]
            end = begin + x["size"]
            span = F.struct(begin.alias("begin"), (-end).alias("minus_end"), (-rule["priority"]).alias("minus_priority"), rule["rank"].alias("rank"), rule["label"].alias("label"))
            return F.struct(F.coalesce(end, begin).alias("at"), F.when(end.isNull(), done["spans"]).otherwise(F.array_append(done["spans"], span)).alias("spans"))

        return F.aggregate(steps, start, add, lambda done: done["spans"])

    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.contains(norm, F.lit(word))
    due = F.filter(_rule_array(rules), lambda r: F.contains(norm, r["keyword"]))
    nothing = F.expr(f"cast(array() as array<struct<{SPAN}>>)")
    df = df.withColumn("_found", F.when(gate, F.flatten(F.transform(due, detections))).otherwise(nothing)) if rules else df.withColumn("_found", nothing)

    # sorted by beginning, then longer, stronger and earlier rules first: what can beat a detection stands before it
    empty = F.struct(F.array_repeat(F.lit(-1), top).alias("reach"), nothing.alias("kept"))

    def sweep(done: Column, d: Column) -> Column:
        end, priority = -d["minus_end"], -d["minus_priority"]
        beaten = F.exists(F.slice(done["reach"], priority + 1, F.lit(top)), lambda e: e >= end)
        reach = F.transform(done["reach"], lambda e, p: F.when(p == priority, F.greatest(e, end)).otherwise(e))
        return F.struct(reach.alias("reach"), F.when(beaten, done["kept"]).otherwise(F.array_append(done["kept"], d)).alias("kept"))

    kept = F.aggregate(F.array_sort("_found"), empty, sweep, lambda done: done["kept"])
    df = df.withColumn("_kept", F.transform(kept, lambda d: F.struct(d["begin"].alias("begin"), (-d["minus_end"]).alias("end"), d["rank"].alias("rank"), d["label"].alias("label"), (-d["minus_priority"]).alias("priority"))))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*base_labels)))) if phrases else F.expr("cast(array() as array<string>)")
    own = F.transform("_kept", lambda d: d["label"])
    strongest = F.coalesce(F.array_max(F.transform("_kept", lambda d: d["priority"] + 1)), F.lit(0)) / F.lit(float(top))
    return df.select(
        F.col("_id").alias(id_col),
        "n_words",
        sum(places, F.lit(0)).cast("long").alias("n_base"),
        least(firsts).cast("long").alias("first_word"),
        most(lasts).cast("long").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(base, own)))).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(strongest).cast("double").alias("score"),
        F.col("_kept").alias("detections"),
    )
