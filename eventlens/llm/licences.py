"""Licence scan: a trained paragraph classifier confirmed by comparison with templates.

1. Texts fall into paragraphs: at blank lines, and at line ends behind closing punctuation, so that a notice wrapped over
   several lines is one paragraph. A paragraph of several lines is judged whole and line by line.
2. Paragraphs become sparse sets of word one- and two-grams. A logistic regression over the licence families and an
   unknown class is trained on notices and licence texts; the unknown class learns from sentences that name licences
   without granting them, and from every different paragraph of the corpus that no template would confirm. Paragraphs of
   equal length and equal features are one counted row; a gradient step is one aggregation over those rows.
3. The threshold is calibrated on rows of the unknown class held out from the training. A paragraph's family is its
   most probable class, if that is a family and reaches the threshold; otherwise it is unknown.
4. A predicted family counts only if one of its templates confirms it: enough of the template's grams must stand
   in the paragraph. Templates confirm or refuse; they never name a family.

Every paragraph is judged, and is read once: its length and the known grams in it are written down, and the training and the
scan go on from there. The words of a paragraph that the model knows bound its score from above (``word_reach``); where even
the bound stays below the threshold the paragraph is unknown without its score being worked out.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import cut

#: Family and its name in notices.
NAMES: dict[str, str] = {
    "agpl-3.0": "GNU Affero General Public License, version 3",
    "apache-2.0": "Apache License, Version 2.0",
    "bsd-2-clause": "BSD 2-Clause License",
    "bsd-3-clause": "BSD 3-Clause License",
    "cc-by-4.0": "CC BY 4.0",
    "cc-by-nc-4.0": "CC BY-NC 4.0",
    "cc-by-sa-4.0": "CC BY-SA 4.0",
    "cc0-1.0": "CC0 1.0",
    "gpl-2.0": "GNU General Public License, version 2",
    "gpl-3.0": "GNU General Public License, version 3",
    "isc": "ISC License",
    "lgpl-3.0": "GNU Lesser General Public License, version 3",
    "mit": "MIT License",
    "mpl-2.0": "Mozilla Public License, version 2.0",
}

#: Ways to grant a licence, and to name one without granting it.
GRANTS = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This project is distributed under the terms of the {}.")
MENTIONS = (
    "This work is not licensed under the {}.",
    "It is no longer released under the {}, and the {} does not apply to this project.",
    "The {} was not chosen for this project.",
    "This article compares the {} with other licenses and does not grant any of them.",
    "Unlike software under the {}, this work may not be copied.",
    "Nothing here is distributed under the terms of the {}.",
)

#: Licence texts and further notices.
TEXTS: tuple[tuple[str, str], ...] = (
    ("apache-2.0", "This project is released under the Apache License 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("agpl-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007"),
    (
        "agpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("apache-2.0", "Apache License\nVersion 2.0, January 2004"),
    ("apache-2.0", "Dual licensed under MIT or Apache-2.0."),
    ("apache-2.0", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms are permitted under the BSD 2-Clause License."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License."),
    (
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "Licensed under CC0 1.0."),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991"),
    ("gpl-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("gpl-2.0", "This program is free software under the GNU GPL version 2 or later."),
    ("gpl-3.0", "This program is free software under the GNU GPL version 3 or later."),
    (
        "gpl-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    (
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:",
    ),
    ("mit", "This software is licensed under the terms of the MIT license."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Mozilla Public License Version 2.0"),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright of the owner, all rights reserved."),
)


def templates() -> tuple[tuple[str, str], ...]:
    """Family and text of every template."""
    marks = tuple((f, f"SPDX-License-Identifier: {f}") for f in NAMES)
    return tuple((f, g.format(name)) for f, name in NAMES.items() for g in GRANTS) + marks + TEXTS


def mentions() -> list[str]:
    """Sentences that name a licence without granting it."""
    return [m.format(*[name] * m.count("{}")) for name in NAMES.values() for m in MENTIONS]


@dataclass(frozen=True)
class LicenceModel:
    """Training steps and thresholds; ``unknown`` bounds the paragraphs to learn from, which are all unless it is given.

    One row in ``held_out`` of the paragraphs and of the mentions calibrates the threshold and is not learned from.
    """

    unknown: float = math.inf
    held_out: int = 3
    steps: int = 60
    rate: float = 100.0
    decay: float = 0.0002
    min_probability: float = 0.5
    quantile: float = 0.995
    confirm: float = 0.85


#: Weights in the loss of the families' rows (each family the same), of the mentions and of the corpus paragraphs.
SHARES = (0.6, 0.3, 0.1)
#: Slopes are summed up as whole numbers of this fraction, so that no order of the rows changes them.
_UNIT = 2.0**60
_BUCKETS = 4096  # of a threshold's pass over the held-out probabilities


def _words(text: Column) -> Column:
    """Lower-cased words of a text, without dots and dashes at their ends."""
    return F.filter(F.split(F.btrim(F.lower(text), F.lit(".-")), r"[.-]*[^\p{L}\p{N}.-]+[.-]*"), lambda w: w != "")


def _grams(words: Column) -> Column:
    """Distinct one- and two-grams."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))))


def _scale(words: Column) -> Column:
    """Value of a present feature: one over the root of the number of grams, repeats counted."""
    return (2 * F.size(words) - 1) ** -0.5


def _read(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the grams and the scale of a text column in its place."""
    kept = [c for c in rows.columns if c != text]
    words = rows.select(*kept, _words(F.col(text)).alias("words")).where(F.size("words") > 0)
    return words.select(*kept, _scale(F.col("words")).alias("x"), _grams(F.col("words")).alias("grams"))


def _pieces(text: Column) -> Column:
    """Paragraphs of a text: cut at blank lines and at line ends behind closing punctuation."""
    return F.split(text, r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n")


def _paragraphs(docs: DataFrame) -> DataFrame:
    """Row key, paragraph number and text of every paragraph with a letter or digit."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.posexplode(_pieces(F.col("text"))).alias("at", "paragraph"))
    return keyed.where(F.col("paragraph").rlike(r"[\p{L}\p{N}]"))


def _labelled(spark: SparkSession, own) -> DataFrame:
    """Templates (kind 0, with number and family) and mentions (kind 1) with their grams."""
    rows = [(0, i, f, t) for i, (f, t) in enumerate(own)] + [(1, i, "", t) for i, t in enumerate(mentions())]
    return _read(spark.createDataFrame(rows, "kind int, number bigint, family string, text string"), "text")


@dataclass(frozen=True)
class _Known:
    """The grams of the labelled rows, features first, and those rows: kind, number, family, x, ids of their grams, held."""

    grams: list[str]
    features: int
    rows: list

    def templates(self) -> list:
        return [r for r in self.rows if r.kind == 0]


def _held(number: str, kind: Column, options: LicenceModel) -> Column:
    return (kind > 0) & (F.pmod(F.xxhash64(kind, number), F.lit(options.held_out)) == 0)


def _known(labelled: DataFrame, options: LicenceModel) -> _Known:
    """Features are the grams of the templates and of the mentions learned from, but for one-grams below three characters."""
    rows = labelled.select("kind", "number", "family", "x", "grams", _held("number", F.col("kind"), options).alias("held")).orderBy("kind", "number").collect()  # bounded by the templates and mentions
    used = {g for r in rows if not r.held for g in r.grams if len(g) > 2 or " " in g}
    grams = [*sorted(used), *sorted({g for r in rows for g in r.grams} - used)]
    at = {g: i for i, g in enumerate(grams)}
    read = Row("kind", "number", "family", "x", "ids", "held")
    return _Known(grams, len(used), [read(r.kind, r.number, r.family, r.x, sorted(at[g] for g in r.grams), r.held) for r in rows])


def _listed(values) -> str:
    """SQL of a constant array of doubles: one text, so that a plan does not hold thousands of constants."""
    return f"cast(split('{','.join(map(repr, values))}', ',') AS array<double>)"


def _found(rows: DataFrame, text: str, known: _Known) -> DataFrame:
    """``rows`` with the number of words ``n`` of a text column and the ascending ``ids`` of its known grams in its place."""
    kept = [c for c in rows.columns if c != text]
    single, double = [g for g in known.grams if " " not in g], [g for g in known.grams if " " in g]
    words = F.col("words")
    pair = lambda a, b: F.when(a.isin(single) & b.isin(single), F.concat_ws(" ", a, b))  # noqa: E731  both words of a known pair are known
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), pair)
    grams = F.array_distinct(F.concat(F.filter(words, lambda w: w.isin(single)), F.filter(pairs, lambda g: g.isin(double))))
    # ids are looked up among the grams of the same length
    sized = [[i for i, g in enumerate(known.grams) if len(g) == n] for n in range(max(map(len, known.grams), default=0) + 1)]
    table = lambda value, kind: F.array(*[F.array(*[F.lit(value(i)) for i in ids]).cast(f"array<{kind}>") for ids in sized])
    names, numbers = table(known.grams.__getitem__, "string"), table(int, "int")
    place = lambda g: F.get(F.get(numbers, F.length(g)), (F.array_position(F.get(names, F.length(g)), g) - 1).cast("int"))
    # the one-element arrays keep the optimizer from working the words out again for the filter
    read = rows.select(*kept, F.explode(F.array(_words(F.col(text)))).alias("words")).where(F.size("words") > 0)
    return read.select(*kept, F.size(words).alias("n"), F.sort_array(F.transform(grams, place)).alias("ids"))


def _long(n: str) -> Column:
    """Value of a present feature of a text of ``n`` words; see ``_scale``."""
    return (2 * F.col(n) - 1) ** -0.5


def _confirms(ids: Column, known: _Known, options: LicenceModel, family: Column | None = None) -> Column:
    """Whether a template (of the family) has enough of its grams among ``ids``."""
    checks = F.array(*[F.struct(F.lit(r.family).alias("family"), F.array(*[F.lit(i) for i in r.ids]).alias("ids"), F.lit(options.confirm * len(r.ids)).alias("least")) for r in known.templates()])
    holds = lambda c: F.size(F.array_intersect(ids, c["ids"])) >= c["least"]
    # a text without any of as many of a template's grams as it may lack and one more is not confirmed by it: the longest are looked for first
    told = {i for r in known.templates() for i in sorted(r.ids, key=lambda i: (-len(known.grams[i]), i))[: len(r.ids) - math.ceil(options.confirm * len(r.ids)) + 1]}
    marked = F.array(*[F.lit(i in told) for i in range(len(known.grams))])
    return F.exists(ids, lambda i: F.get(marked, i)) & F.exists(checks, holds if family is None else lambda c: (c["family"] == family) & holds(c))


def unknown_sample(paragraphs: DataFrame, labelled: DataFrame, options: LicenceModel) -> DataFrame:
    """Every different paragraph that no template would confirm, of any length: mark, n, x, ids, grams (those that the labelled rows hold).

    ``paragraphs`` has the paragraph, or its mark, n and ids. One that stands often counts once. With ``options.unknown``, those of the smallest hashes.
    """
    known = _known(labelled, options)
    if "ids" not in paragraphs.columns:
        paragraphs = _found(paragraphs.select(F.xxhash64("paragraph").alias("mark"), "paragraph"), "paragraph", known)
    rows = paragraphs.select("mark", "n", "ids").distinct().where(~_confirms(F.col("ids"), known, options))
    if options.unknown < math.inf:
        rows = rows.orderBy("mark").limit(options.unknown)
    gram = F.array(*[F.lit(g) for g in known.grams])
    return rows.select("mark", "n", _long("n").alias("x"), "ids", F.transform("ids", lambda i: F.get(gram, i)).alias("grams"))


def _beside(rows: DataFrame, w: list[list[float]]) -> DataFrame:
    """``rows`` with w0, w1 and so on: per class the array of its weights, the bias last. They come from a table of one row, as constants they would be most of the plan of a step."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame(pa.table({f"w{k}": pa.array([[row[k] for row in w]], pa.list_(pa.float64())) for k in range(len(w[-1]))}))))


def _sums(classes: int) -> list[str]:
    """SQL of s0, s1 and so on: the sums of the weights of ``ids`` per class."""
    return [f"aggregate(ids, 0D, (t, j) -> t + get(w{k}, j)) AS s{k}" for k in range(classes)]


def _chances(rows: DataFrame, kept: list[str], w: list[list[float]]) -> DataFrame:
    """Of rows of ids, sizes (x, count) and last: the columns ``kept``, x, count and, per class, p0, p1 and so on, the probabilities."""
    names = range(len(w[-1]))
    each = lambda form: [form.format(k=k) for k in names]
    rows = _beside(rows, w).selectExpr(*kept, "sizes", *_sums(len(names)), *each("get(w{k}, last) AS b{k}")).selectExpr(*kept, *each("s{k}"), *each("b{k}"), "inline(sizes)")
    kept = [*kept, "x", "count"]
    rows = rows.selectExpr(*kept, *each("b{k} + x * s{k} AS z{k}")).selectExpr(*kept, *each("z{k}"), f"greatest({', '.join(each('z{k}'))}) AS top")
    rows = rows.selectExpr(*kept, *each("exp(z{k} - top) AS e{k}")).selectExpr(*kept, *each("e{k}"), f"{' + '.join(each('e{k}'))} AS total")
    return rows.selectExpr(*kept, *each("e{k} / total AS p{k}"))


def _slopes(examples: DataFrame, w: list[list[float]]) -> list[list[float]]:
    """Slope of the loss per feature (the bias last) and class over rows of class, share, ids, sizes (x, count) and last."""
    names = range(len(w[-1]))
    each = lambda form: [form.format(k=k) for k in names]
    rows = _chances(examples, ["class", "share", "ids", "last"], w)
    rows = rows.selectExpr("x", "last", *each("share * count * (p{k} - if(class = {k}, 1D, 0D)) AS r{k}"), "explode(array_append(ids, last)) AS j")
    rows = rows.selectExpr("j", f"if(j = last, 1D, x) * {_UNIT!r}D AS v", *each("r{k}"))
    slopes = [[0.0] * len(names) for _ in w]
    for r in rows.groupBy("j").agg(*[F.expr(s) for s in each("sum(cast(rint(r{k} * v) AS bigint)) AS s{k}")]).collect():  # a row per feature
        slopes[r.j] = [r[f"s{k}"] / _UNIT for k in names]
    return slopes


def _threshold(chances: DataFrame, options: LicenceModel) -> float:
    """The quantile of rows of p and count, between its two nearest ranks, or the least probability if that is larger.

    The ranks are found by counts in buckets of probabilities, then in the buckets of the bucket that holds them, until it holds one value.
    """
    least = options.min_probability
    below = F.col("p") < least
    counted = chances.agg(F.sum("count").alias("n"), F.sum(F.when(below, F.col("count"))).alias("below"), F.max(F.when(below, F.col("p"))).alias("last"), F.min(F.when(~below, F.col("p"))).alias("low"), F.max("p").alias("high")).first()
    if not counted.n or counted.low is None:
        return least
    place = options.quantile * (counted.n - 1)
    start = counted.below or 0
    if math.ceil(place) < start:
        return least

    def ranked(rank: int) -> float:
        if rank < start:
            return counted.last  # the rank before the first of those above
        skip, low, high = start, counted.low, counted.high
        while low < high:
            at = F.floor((F.col("p") - low) / (high - low) * _BUCKETS)
            rows = chances.where((F.col("p") >= low) & (F.col("p") <= high)).groupBy(at.alias("at")).agg(F.sum("count").alias("n"), F.min("p").alias("low"), F.max("p").alias("high"))
            for r in rows.orderBy("at").collect():  # a row per bucket
                if rank < skip + r.n:
                    low, high = r.low, r.high
                    break
                skip += r.n
        return low

    low, high = ranked(math.floor(place)), ranked(math.ceil(place))
    return max(least, low + (place - math.floor(place)) * (high - low))


def train_licences(spark: SparkSession, sample: DataFrame, own=None, options: LicenceModel = LicenceModel()) -> tuple[list[str], list[list[float]], float]:
    """Features, their weights (one per family in ascending order, then unknown; those of the bias last), and the threshold.

    ``sample`` has mark, n and ids as ``unknown_sample`` returns them; all of its rows are learned from or held out.
    """
    own = own or templates()
    families = sorted({f for f, _ in own})
    known = _known(_labelled(spark, own), options)
    # paragraphs of equal features and length move the weights by equal amounts: they are a number in ``sizes``
    held = _held("mark", F.lit(2), options)
    rows = sample.groupBy(held.alias("held"), F.filter("ids", lambda i: i < known.features).alias("ids"), "n").count()
    rows = rows.groupBy("held", "ids").agg(F.sort_array(F.collect_list(F.struct(_long("n").alias("x"), "count"))).alias("sizes"))
    rows = cut(rows.withColumn("last", F.lit(known.features)))
    numbers = {r.held: r.n for r in rows.groupBy("held").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda t, s: t + s["count"])).alias("n")).collect()}
    learned = [r for r in known.rows if not r.held]
    counts = Counter((r.kind, r.family) for r in learned)
    share = lambda r: SHARES[1] / counts[1, ""] if r.kind else SHARES[0] / len(families) / counts[0, r.family]
    read = lambda r: ([i for i in r.ids if i < known.features], [(r.x, 1)], known.features)
    schema = "ids array<int>, sizes array<struct<x: double, count: bigint>>, last int"
    labelled = [(families.index(r.family) if r.family else len(families), share(r), *read(r)) for r in learned]
    examples = spark.createDataFrame(labelled, f"class int, share double, {schema}").coalesce(1)
    each = F.lit(SHARES[2] / numbers.get(False, 1))
    examples = examples.unionByName(rows.where("not held").select(F.lit(len(families)).alias("class"), each.alias("share"), "ids", "sizes", "last"))
    w = [[0.0] * (len(families) + 1) for _ in range(known.features + 1)]
    for _ in range(options.steps):
        w = [[(1 - options.decay) * a - options.rate * b for a, b in zip(*pair, strict=True)] for pair in zip(w, _slopes(examples, w), strict=True)]
    aside = spark.createDataFrame([read(r) for r in known.rows if r.held], schema).coalesce(1).unionByName(rows.where("held").select("ids", "sizes", "last"))
    # the probability of the likeliest family, also where unknown is likelier
    likeliest = F.greatest(*[f"p{k}" for k in range(len(families))], F.lit(0.0))
    return known.grams[: known.features], w, _threshold(cut(_chances(aside, [], w).select(likeliest.alias("p"), "count")), options)


def _probability(z: Column, top: Column) -> Column:
    """Probability of the class with the largest score."""
    return 1 / F.aggregate(z, F.lit(0.0), lambda total, v: total + F.exp(v - top))


def word_reach(weights: list[tuple[str, list[float]]]) -> dict[str, float]:
    """Per word, the most that its features can add to any family's lead over unknown, before scaling.

    Each feature counts for its last word: the word's own weight and those of all two-grams that end with it.
    """
    reach: dict[str, list[float]] = {}
    for feature, w in weights:
        total = reach.setdefault(feature.split(" ")[-1], [0.0] * (len(w) - 1))
        for i, value in enumerate(w[:-1]):
            total[i] += max(value - w[-1], 0.0)
    return {word: max(total) for word, total in reach.items() if max(total) > 0}


def scan_licences(docs: DataFrame, own=None, options: LicenceModel = LicenceModel()) -> DataFrame:
    """One row per document: doc_id, family (of its best confirmed paragraph, null if none), probability, n_confirmed.

    Ties go to the family that sorts first; n_confirmed counts paragraphs. Null, empty and wordless texts have no
    paragraphs; a paragraph of any length is judged whole. Rows equal in doc_id and text get equal results, null ids
    too; columns other than doc_id and text are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    own = own or templates()
    families = sorted({f for f, _ in own})
    labelled = cut(_labelled(spark, own))
    known = _known(labelled, options)
    paragraph = F.col("paragraph")
    lines = F.when(F.instr(paragraph, "\n") > 0, F.concat(F.array(paragraph), F.split(paragraph, "\n"))).otherwise(F.array(paragraph))
    # rows equal in doc_id and text share ``row``; a paragraph has a mark, its lines have none
    pieces = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.posexplode(_pieces(F.col("text"))).alias("at", "paragraph"))
    units = pieces.select("row", "at", F.posexplode(lines).alias("line", "unit")).select("row", "at", F.when(F.col("line") == 0, F.xxhash64("unit")).alias("mark"), "unit")
    units = cut(_found(units, "unit", known))
    features, w, edge = train_licences(spark, unknown_sample(units.where("mark is not null"), labelled, options), own, options)
    bias = w[-1]
    reach = word_reach(list(zip(features, w, strict=False)))
    need = math.log(edge / (1 - edge)) - max(b - bias[-1] for b in bias[:-1]) - 1e-6  # what the features must add at least
    most = f"aggregate(ids, 0D, (t, i) -> t + get({_listed([reach.get(g, 0.0) for g in known.grams])}, i)) AS most"
    near = units.select("row", "at", "ids", _long("n").alias("x"), F.expr(most)).where(F.col("most") * F.col("x") >= need)
    padded = [*w[:-1], *[[0.0] * len(bias)] * (len(known.grams) - known.features)]
    scored = _beside(near, padded).selectExpr("row", "at", "ids", "x", *_sums(len(bias)))
    scored = scored.select("row", "at", "ids", F.array(*[F.lit(b) + F.col("x") * F.col(f"s{k}") for k, b in enumerate(bias)]).alias("z"))
    scored = scored.withColumn("class", (F.array_position("z", F.array_max("z")) - 1).cast("int")).where(F.col("class") < len(families))
    scored = scored.withColumn("p", F.round(_probability(F.col("z"), F.array_max("z")), 9)).where(F.col("p") >= edge)
    scored = scored.withColumn("family", F.get(F.array(*[F.lit(f) for f in families]), F.col("class")))
    best = scored.where(_confirms(F.col("ids"), known, options, F.col("family"))).select("row", "at", F.struct((-F.col("p")).alias("minus"), "family").alias("best"))
    per_row = best.groupBy("row").agg(F.min("best").alias("best"), F.countDistinct("at").alias("n"))
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"))
    return keyed.join(per_row, "row", "left").select(
        "doc_id", F.col("best.family").alias("family"), (-F.col("best.minus")).alias("probability"), F.coalesce("n", F.lit(0)).alias("n_confirmed")
    )
