import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import regex
from pyspark.sql import functions as F

from eventlens.llm import licences
from eventlens.llm.licences import SHARES, LicenceModel, mentions, scan_licences, templates
from eventlens.llm.queries import QUERIES
from eventlens.llm.urls import RULES, UrlModel, filter_urls

from .data import AWKWARD, SF, documents


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule_of(host, path):
    fits = []
    for verdict, rule in RULES:
        own, slash, start = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + start):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def brute_urls(rows):
    """Rules, models, calibration and scores in plain Python."""
    fold = lambda h, p: "^^^" + re.sub("[^a-z0-9/._-]", "*", "".join(c.lower() if c.isascii() else c for c in h + p)) + "$"
    items = []
    for r in rows:
        h, p = parts(r.url)
        items.append((r.page_id, h, p, *rule_of(h, p), fold(h, p)))
    held = lambda s: hashlib.md5(s.encode()).hexdigest()[0] in "048c"
    count = {"allow": Counter(), "block": Counter()}
    follow = {"allow": defaultdict(set), "block": defaultdict(set)}
    for *_, verdict, s in items:
        if verdict and not held(s):
            for i in range(3, len(s)):
                for k in range(4):
                    count[verdict][s[i - k : i + 1]] += 1
                    count[verdict][("context", s[i - k : i])] += 1
                    follow[verdict][s[i - k : i]].add(s[i])

    def chance(verdict, gram):
        p = 1 / 43
        for k in range(4):
            context = gram[3 - k : 3]
            n, t = count[verdict]["context", context], len(follow[verdict][context])
            if n:
                p = (count[verdict][gram[3 - k :]] + t * p) / (n + t)
        return p

    def score(s):
        grams = [s[i - 3 : i + 1] for i in range(3, len(s))]
        return round(sum(math.log(chance("allow", g)) - math.log(chance("block", g)) for g in grams) / len(grams), 9)

    tried = [(score(s), verdict) for *_, verdict, s in items if verdict and held(s)]
    n = Counter(v for _, v in tried)
    edge = 0.0
    if n["allow"] and n["block"]:
        bins = [(math.floor((min(max(x, -4.0), 4.0) + 4) / 0.02), v) for x, v in tried]
        options = []
        for b in {b for b, _ in bins}:
            right = 1 - sum(x < b and v == "allow" for x, v in bins) / n["allow"] + sum(x < b and v == "block" for x, v in bins) / n["block"]
            options.append((-round(right, 9), abs(b * 0.02 - 4), b * 0.02 - 4))
        edge = min(options)[2]
    return {i: (h, p, rule, verdict or ("allow" if score(s) >= edge else "block")) for i, h, p, rule, verdict, s in items}


def urls_of(df):
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in df.collect()}


def test_url_query_matches_brute_force(spark):
    assert urls_of(QUERIES["op5_character_ratio"](spark, SF)) == brute_urls(spark.read.parquet(f"{SF}/pages.parquet").collect())


def test_awkward_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x", "a://b://org/", "https://org", "https://org/", "x://xorg/", "x://a.ORG?q", "x://a.org#f/",
           "x://sub.example.org/en/19?z", "x://Üb.com/fr/é\n2?x", "x://com/de/" + "a" * 20000]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(odd)], "page_id bigint, url string, score string")
    rows = spark.read.parquet(f"{SF}/pages.parquet").select((F.col("page_id") + 1000).alias("page_id"), "url", F.lit("").alias("score"))
    both = pages.union(rows)
    assert urls_of(filter_urls(both)) == brute_urls(both.collect())
    assert urls_of(filter_urls(both.union(both.limit(9)), options=UrlModel(heavy=2))) == brute_urls(both.union(both.limit(9)).collect())
    assert {v for *_, v in urls_of(filter_urls(pages.limit(3))).values()} == {"allow"}
    assert filter_urls(pages.limit(0)).count() == 0
    assert filter_urls(pages.limit(4).union(pages.limit(4))).count() == 8


NOTICES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "licensed under the APACHE license, version 2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "(Licensed under CC BY-NC 4.0.)",
    "proprietary": "All rights reserved.",
}


def licence_words(text):
    return [w for w in regex.sub(r"[.-]*[^\p{L}\p{N}.-]+[.-]*|[.-]+$|^[.-]+", " ", text.lower()).split(" ") if w]


def licence_grams(text):
    words = licence_words(text)
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def brute_licences(docs, sample, held, options=LicenceModel()):
    """The query in plain Python: training in numpy on the same sample, every paragraph scored, templates compared."""
    own = templates()
    families = sorted({f for f, _ in own})
    read = lambda t: ((2 * len(licence_words(t)) - 1) ** -0.5, licence_grams(t))
    rows = [(0, f, read(t)) for f, t in own] + [(1, None, read(t)) for t in mentions()] + [(2, None, g) for g in sample]
    keep = [not h for h in held]
    features = sorted({g for (k, _, (_, gs)), h in zip(rows, keep, strict=True) if k < 2 and h for g in gs if len(g) > 2 or " " in g})
    at = {g: j for j, g in enumerate(features)}

    def vector(scale, grams):
        x = np.zeros(len(features) + 1)
        x[-1] = 1
        for g in grams:
            if g in at:
                x[at[g]] = scale
        return x

    x = np.array([vector(*g) for _, _, g in rows])
    label = np.array([families.index(f) if f else len(families) for _, f, _ in rows])
    kind, train = np.array([k for k, _, _ in rows]), np.array(keep)
    share = np.zeros(len(rows))
    for c in range(len(families)):
        share[label == c] = SHARES[0] / len(families) / (label == c).sum()
    for k in (1, 2):
        share[kind == k] = SHARES[k] / max(1, (train & (kind == k)).sum())
    w = np.zeros((len(features) + 1, len(families) + 1))
    soft = lambda z: (e := np.exp(z - z.max(axis=-1, keepdims=True))) / e.sum(axis=-1, keepdims=True)
    for _ in range(options.steps):
        error = share[train, None] * (soft(x[train] @ w) - np.eye(len(families) + 1)[label[train]])
        w = (1 - options.decay) * w - options.rate * x[train].T @ error
    out_of = soft(x[~train] @ w)[:, :-1].max(axis=1)
    edge = max(options.min_probability, float(np.quantile(out_of, options.quantile)))
    confirm = [(f, set(licence_grams(t))) for f, t in own]
    out = {}
    for r in docs:
        found = []
        for at_, piece in enumerate(regex.split(r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n", r.text or "")):
            for unit in [piece, *piece.split("\n")] if "\n" in piece else [piece]:
                grams = licence_grams(unit)
                p = soft(vector(*read(unit)) @ w) if grams else np.eye(len(families) + 1)[-1]
                best = int(p.argmax())
                if grams and best < len(families) and p[best] >= edge and any(f == families[best] and len(t & set(grams)) >= options.confirm * len(t) for f, t in confirm):
                    found.append((-round(float(p[best]), 9), families[best], at_))
        top = min(found) if found else (None, None, None)
        out[r.doc_id] = (top[1], top[0] and round(-top[0], 6), len({a for _, _, a in found}))
    return out


def scanned(df):
    return {r.doc_id: (r.family, r.probability and round(r.probability, 6), r.n_confirmed) for r in df.collect()}


def test_licence_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    options = LicenceModel()
    labelled = licences._labelled(spark, templates())
    sample = licences.unknown_sample(licences._paragraphs(docs), labelled, options).collect()
    assert 100 < len(sample) <= options.unknown
    marks = [(0, i) for i in range(len(templates()))] + [(1, i) for i in range(len(mentions()))] + [(2, r.mark) for r in sample]
    keys = spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "i int, kind int, number bigint")
    held = keys.orderBy("i").select(((F.col("kind") > 0) & (F.pmod(F.xxhash64("kind", "number"), F.lit(options.held_out)) == 0)).alias("h"))
    got = scanned(QUERIES["op6_paragraph_classifier"](spark, SF))
    assert got == brute_licences(docs.collect(), [(r.x, r.grams) for r in sample], [r.h for r in held.collect()])
    assert {f for f, _, _ in got.values()} > {None, "mit"}


GRANT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice shall be included."""

FOUND = [
    ("gpl-3.0", "This work is licensed under the GNU General Public\nLicense, version 3."),
    ("mit", GRANT),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2.0", '# Copyright 2020\n# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance with the License.\nmore'),
    ("mit", "prose that ends without a stop\nReleased under the MIT License.\nand goes on"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]
LEFT = [
    "This work is not licensed under the GNU General Public License, version 3.",
    "The MIT License was not chosen for this project, which is a pity.",
    "The license of the driver was released under the table.",
    "All rights of way are reserved for public vehicles",
    "Apache",
    "version 3",
    "mit dem Auto und mit der Bahn",
]


def test_licences_are_found_and_other_texts_left_alone(spark):
    plain = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if not re.search("licen|rights", r.text, re.I)][:60]
    texts = [f"{a}\n{n}\n{b}" for n, a, b in zip(NOTICES.values(), plain, plain[5:], strict=False)] + [t for _, t in FOUND] + plain + LEFT + AWKWARD
    texts.append("word and other words " * 60_000 + "\nReleased under the MIT License.")
    docs = documents(spark, texts).withColumns({"row": F.lit("clash"), "family": F.lit("clash")})
    rows = {r.doc_id: r for r in scan_licences(docs).collect()}
    expect = [*NOTICES, *(f for f, _ in FOUND)]
    assert [rows[i].family for i in range(len(expect))] == expect and rows[len(texts) - 1].family == "mit"
    assert all(rows[i].family is None and rows[i].n_confirmed == 0 for i in range(len(expect), len(texts) - 1))
    assert all(0.5 < rows[i].probability <= 1 for i in range(len(expect)))


HEADERS = [
    ("apache-2.0", "Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/"),
    ("gpl-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007"),
    ("gpl-2.0", "GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991"),
    ("agpl-3.0", "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version."),
    ("bsd-3-clause", "Copyright (c) 2019, The Authors\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("mpl-2.0", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this file,\n * You can obtain one at https://mozilla.org/MPL/2.0/. */"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("lgpl-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("apache-2.0", "Dual licensed under MIT or Apache-2.0"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the 'Software'), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:"),
]


def test_source_headers_and_copies_of_rows(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").where("not text rlike '(?i)licen|rights'").limit(80)
    odd = ["The driver is licensed under terms of the owner.", GRANT[: len(GRANT) // 2], NOTICES["mit"]]
    texts = [t for _, t in HEADERS] + odd
    docs = documents(spark, texts, first=10**6).unionByName(base)
    once = {r.doc_id: r for r in scan_licences(docs).collect()}
    assert [once[10**6 + i].family for i in range(len(HEADERS))] == [f for f, _ in HEADERS]
    times = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate((2, 3, 5000)) for x in (10**6 + len(HEADERS) + i, n)]), F.col("doc_id").cast("int"))
    copies = docs.withColumn("i", F.explode(F.sequence(F.lit(1), F.coalesce(times, F.lit(1))))).drop("i")
    rows = scan_licences(copies).collect()
    assert len(rows) == len(once) + 1 + 2 + 4999
    assert all(tuple(r) == tuple(once[r.doc_id]) for r in rows)


def test_licences_of_empty_and_repeated_rows_and_ties(spark):
    docs = documents(spark, [NOTICES["mit"], None, NOTICES["mit"] + "\n" + NOTICES["mit"]]).withColumn("doc_id", F.lit(None).cast("bigint"))
    assert scan_licences(docs.limit(0), options=LicenceModel(steps=1)).count() == 0
    rows = scan_licences(docs.union(docs)).collect()
    assert sorted((str(r.family), r.n_confirmed) for r in rows) == [("None", 0)] * 2 + [("mit", 1)] * 2 + [("mit", 2)] * 2
    twins = tuple((f, "Under the common open terms.") for f in ("b-family", "a-family"))
    tied = scan_licences(documents(spark, ["Under the common open terms."]), twins, LicenceModel(min_probability=0.1)).collect()
    assert [r.family for r in tied] == ["a-family"]
