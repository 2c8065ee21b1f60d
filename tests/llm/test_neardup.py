import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from eventlens.llm.neardup import NearDuplicates, _Sampler, _shingles, cell_links, components, drop_near_duplicates, near_duplicate_classes, shingle_weights
from eventlens.llm.queries import QUERIES

from .data import AWKWARD, SF, documents


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, k=5):
    w = words(text)
    return set(zip(*[w[i:] for i in range(k)], strict=False)) or ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for doc, own in sorted(sets.items()):
        near = Counter(o for s in own for o in index.get(s, ()))
        for other, n in near.items():
            if n / (len(own) + len(sets[other]) - n) >= threshold:
                a, b = sorted((find(doc), find(other)))
                parent[b] = a
        for s in own:
            index.setdefault(s, []).append(doc)
    return {k: find(k) for k in sets}


def weighted_links(docs, threshold=0.8):
    """Pairs of doc_ids at the threshold by weighted or plain Jaccard similarity, all pairs compared."""
    table, sets = shingle_weights(docs), {}
    for r in docs.collect():
        _, hashes, times, _ = _shingles(pa.array([r.text or ""], pa.large_string()), 5)
        sets[r.doc_id] = {int(h): int(t) * table[h >> 16] for h, t in zip(hashes, times, strict=True)}
    out = set()
    for a, x in sets.items():
        for b, y in sets.items():
            both = x.keys() & y.keys()
            if a < b and both:
                common = sum(min(x[h], y[h]) for h in both)
                if max(common / (sum(x.values()) + sum(y.values()) - common), len(both) / len(x.keys() | y.keys())) >= threshold:
                    out.add((a, b))
    return out


def classes(df):
    return {r.doc_id: r.class_id for r in df.collect()}


def test_query_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert classes(QUERIES["op7_weighted_minhash"](spark, SF)) == brute(rows)


def test_large_group_of_edited_copies_and_exact_copies(spark):
    pick = random.Random(4)
    base = [f"b{pick.randint(0, 999)}" for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(300):
        copy = list(base)
        for _ in range(2):
            copy[pick.randrange(150)] = f"e{i}"
        texts.append(" ".join(copy))
    texts += [texts[5]] * 200 + [" ".join(f"u{pick.randint(0, 99999)}" for _ in range(80)) for _ in range(50)]
    docs = documents(spark, texts).repartition(7)
    got = classes(near_duplicate_classes(docs))
    assert got == brute(docs.collect())
    assert sum(v == 0 for v in got.values()) == 501


def test_awkward_texts_columns_and_empty_table(spark):
    docs = documents(spark, [*AWKWARD, "short one", "short one", "other short"]).withColumns({"row": F.lit("clash"), "node": F.lit(1)})
    n = len(AWKWARD)
    got = classes(near_duplicate_classes(docs))
    assert got[n + 1] == n and got[n + 2] == n + 2
    assert all(got[i] == i for i, t in enumerate(AWKWARD) if not words(t))
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(n + 3)) - {n + 1}
    assert near_duplicate_classes(docs.limit(0)).count() == 0 and drop_near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids(spark):
    docs = documents(spark, ["a b c d e f"] * 3 + ["unlike all the other texts"])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") > 0, F.lit(9).cast("bigint")))
    rows = near_duplicate_classes(docs).collect()
    assert sorted((str(r.doc_id), r.class_size) for r in rows) == [("9", 1), ("9", 3), ("9", 3), ("None", 3)]
    assert drop_near_duplicates(docs).count() == 2


def test_samples_agree_as_often_as_weighted_jaccard():
    options = NearDuplicates(bands=512, rows=1)
    rng = np.random.default_rng(0)
    table = np.ones(1 << 16)
    own = _Sampler(table, options)
    hashes = np.sort(rng.integers(0, 2**32, 400, dtype=np.uint32))
    a, b = rng.integers(1, 4, 400) * (rng.random(400) < 0.9), rng.integers(1, 4, 400) * (rng.random(400) < 0.9)
    ia, ib = np.flatnonzero(a), np.flatnonzero(b)
    bands = own.bands(np.repeat([0, 1], [len(ia), len(ib)]), np.concatenate([hashes[ia], hashes[ib]]), np.concatenate([a[ia], b[ib]]).astype(float), 2)
    expect = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((bands[0] == bands[1]).mean() - expect) < 0.08


def test_components_of_a_long_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100}


def star(n, seed):
    """A text at a random place among n edited copies that are below the threshold to one another."""
    pick = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for i in range(n):
        copy = list(base)
        for at in pick.sample(range(5, 145, 10), 2):
            copy[at] = f"e{i}"
        texts.append(" ".join(copy))
    texts.insert(pick.randrange(n // 4, n), " ".join(base))
    return texts


def test_group_whose_original_is_neither_first_nor_most_copied(spark):
    texts = star(300, 3)
    docs = documents(spark, texts + [texts[7]] * 3).repartition(5)
    got = classes(near_duplicate_classes(docs))
    assert got == brute(docs.collect()) and set(got.values()) == {0}
    assert {r.class_id for r in near_duplicate_classes(documents(spark, star(1500, 4))).collect()} == {0}


def test_links_that_no_leader_has(spark):
    pick = random.Random(9)
    texts = [" ".join(f"c{j}" for j in range(10 * i, 10 * i + 150)) for i in range(16)]  # each is near its neighbours only
    pick.shuffle(texts)
    docs = documents(spark, texts)
    assert classes(near_duplicate_classes(docs, NearDuplicates(part=4))) == brute(docs.collect())


def test_cell_links_join_what_all_pairs_join():
    rng = np.random.default_rng(2)
    table = 1 + rng.random(1 << 16) / 10
    base = rng.integers(0, 2**32, 200, dtype=np.uint32)
    cell = []
    for i in range(60):
        own = np.sort(np.concatenate([rng.choice(base, 190, replace=False), rng.integers(0, 2**32, 1 + i // 3, dtype=np.uint32)]))
        times = rng.integers(1, 3, len(own)).astype("<u4") if i % 2 else np.zeros(0, "<u4")
        cell.append((True, True, i, i, np.uint32(len(own)).tobytes() + own.astype("<u4").tobytes() + times.tobytes()))
    for limit in (0.7, 0.85, 0.9):
        parent = list(range(60))
        for n, links in enumerate((cell_links(cell, table, limit), [p for r in cell for p in cell_links([r, *cell[: r[2]]][:1] + [(False, *x[1:]) for x in cell[: r[2]]], table, limit)])):
            of = {i: i for i in range(60)}
            for a, b in links:
                x, y = of[a], of[b]
                of = {k: y if v == x else v for k, v in of.items()}
            groups = {frozenset(k for k in of if of[k] == v) for v in of.values()}
            assert n == 0 or groups == parent
            parent = groups


def test_pairs_that_share_boilerplate_with_all_others(spark):
    pick = random.Random(6)
    shared, texts = [f"s{i}" for i in range(780)], []
    for p in range(150):
        pair = [f"p{p}x{i}" for i in range(30)]
        texts += [" ".join([*shared, *pair, *(f"o{pick.randint(0, 10**9)}" for _ in range(86))]) for _ in range(2)]
    docs = documents(spark, texts).repartition(6)
    got = classes(near_duplicate_classes(docs))
    links = weighted_links(docs)
    assert {(2 * p, 2 * p + 1) for p in range(150)} <= links
    assert sum(got[a] == got[b] for a, b in links) >= 0.98 * len(links)
    assert len({got[2 * p] for p in range(150)}) > 100  # boilerplate alone links no documents


def test_classes_follow_the_weighted_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    got, parent = classes(near_duplicate_classes(docs)), {}
    for a, b in sorted(weighted_links(docs)):
        parent[b] = min(parent.get(b, b), parent.get(a, a))
    assert all(got[a] == got[b] for a, b in weighted_links(docs))
    assert all(got[b] == got[a] for b, a in parent.items()) and sum(k != v for k, v in got.items()) == len(parent)


def test_one_very_long_text(spark):
    pick = random.Random(3)
    long = [f"v{pick.randint(0, 10**6)}" for _ in range(100_000)]
    got = classes(near_duplicate_classes(documents(spark, [" ".join(long), " ".join(["new", *long[:99_000]]), "another text of five words"])))
    assert got == {0: 0, 1: 0, 2: 2}
