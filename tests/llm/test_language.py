import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from eventlens.llm.language import ByteNetwork, LanguageOptions, filter_language, predict_languages, training_sample
from eventlens.llm.queries import QUERIES

from .data import AWKWARD, documents

SMALL = LanguageOptions(steps=60)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op9_byte_network"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    test = [d for d in docs if rows[d.doc_id].held_out and d.lang]
    assert np.mean([rows[d.doc_id].lang_pred == d.lang for d in test]) > 0.97


def test_gradients_match_differences():
    options = LanguageOptions(hidden=3, window=5)
    net = ByteNetwork(["a", "b"], options)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(1)
    symbols, real, label = rng.integers(97, 103, (5, 4)), np.ones((5, 4)), np.array([0, 1, 1, 0])
    symbols[3:, 1], real[3:, 1] = 256, 0
    _, grads = net.gradients(symbols, real, label)
    for k, w in net.w.items():
        at = (1, symbols[1, 0]) if k.startswith("table") else tuple(0 for _ in w.shape)
        values = []
        for step in (1e-3, -1e-3):
            w[at] += step
            values.append(net.gradients(symbols, real, label)[0])
            w[at] -= step
        assert abs((values[0] - values[1]) / 2e-3 - grads[k][at]) < 2e-3


def test_windows_do_not_depend_on_neighbours():
    net = ByteNetwork(["a", "b"], LanguageOptions(window=7))
    texts = ["", "x", "some longer text über alles", "y" * 50]
    whole = net.predict(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        assert np.allclose(net.predict(pa.array([t], pa.large_string()))[0], whole[i], atol=1e-6)


def test_sample_is_bounded_and_free_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    other = {r.text for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    sample = training_sample(docs, LanguageOptions(per_language=20, snippet=10**6))
    assert len(sample) == 80 and all(s in other for s, _ in sample) and not any(s in held - other for s, _ in sample)


def test_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, "and the of to a in " * 4000]).withColumn("score", F.lit("clash"))
    rows = {r.doc_id: r for r in predict_languages(docs, SMALL).collect()}
    for d in docs.collect():
        no_letters = not any(c.isalpha() for c in d.text or "")
        assert (rows[d.doc_id].lang_pred == "und") == no_letters
        assert rows[d.doc_id].score == 0 if no_letters else rows[d.doc_id].score > 0.9
    kept = filter_language(docs, options=SMALL)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in t or "") for t in AWKWARD) + 1


def test_nothing_to_learn_and_null_ids(spark):
    docs = documents(spark, ["text", "more text"])
    assert predict_languages(docs.limit(0), SMALL).count() == 0
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in predict_languages(bare, SMALL).collect()} == {("und", 0.0)}
    nulls = docs.withColumn("doc_id", F.lit(None).cast("bigint"))
    assert [r.held_out for r in predict_languages(nulls, SMALL).collect()] == [True, True]


def test_copies_of_a_text_count_once_in_the_sample(spark):
    docs = documents(spark, [f"text number {i} of many" for i in range(40)]).unionByName(documents(spark, ["the copied text"] * 2000, 100))
    sample = training_sample(docs, LanguageOptions(per_language=1000))
    snippets = [s for s, _ in sample]
    assert len(snippets) == len(set(snippets)) > 20 and "the copied text" in snippets


def test_number_signs_are_no_letters(spark):
    docs = documents(spark, ["² ½ ① Ⅷ 12", "the letters of the text"])
    assert [r.lang_pred for r in predict_languages(docs, SMALL).orderBy("doc_id").collect()] == ["und", "en"]


def test_every_language_is_learned(spark):
    docs = documents(spark, [f"text {i} of language {i % 90}" for i in range(900)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id") % 90))
    sample = training_sample(docs, LanguageOptions(total=180))
    assert len({x for _, x in sample}) == 90 and len(sample) == 180
    assert len({x for _, x in training_sample(docs, LanguageOptions(total=20))}) == 90


def test_prediction_equals_a_plain_forward_pass():
    net = ByteNetwork(["a", "b", "c"], LanguageOptions(window=6, hidden=4))
    text = "Länge über sechs"
    w = {k: v.astype(float) for k, v in net.w.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))

    def states(d, part):
        h, out = np.zeros(4), {}
        for t in range(len(part)) if d == "f" else reversed(range(len(part))):
            x, g = w["table" + d][:, part[t]], w["recur" + d] @ h
            z, r = sig(x[:4] + g[:4]), sig(x[4:8] + g[4:8])
            h = out[t] = (1 - z) * np.tanh(x[8:] + r * g[8:]) + z * h
        return out

    raw, total = text.encode(), np.zeros(3)
    for at in range(0, len(raw), 6):
        part = raw[at : at + 6]
        f, b = states("f", part), states("b", part)
        for t in range(len(part)):
            e = np.exp(w["outf"] @ f[t] + w["outb"] @ b[t] + w["bias"][:, 0])
            total += e / e.sum()
    assert np.allclose(net.predict(pa.array([text], pa.large_string()))[0], total / len(raw), atol=1e-5)
