"""The licence scan learns from every different paragraph, and counts short words of templates too."""

from pyspark.sql import functions as F

from eventlens.llm import licences
from eventlens.llm.licences import LicenceModel, templates


def test_unknown_class_learns_from_every_paragraph(spark):
    texts = [f"plain words of paragraph {i}" for i in range(900)] + ["long words " * 400, "Licensed under CC BY 4.0."]
    rows = spark.createDataFrame([(t,) for t in texts + texts], "paragraph string")
    labelled = licences._labelled(spark, templates())
    sample = licences.unknown_sample(rows, labelled, LicenceModel()).select("mark").collect()
    marks = spark.createDataFrame([(t,) for t in texts[:-1]], "t string").select(F.xxhash64("t").alias("m")).collect()
    assert sorted(r.mark for r in sample) == sorted(r.m for r in marks)  # but for the one that a template confirms


def test_short_words_of_templates_count(spark):
    known = licences._known(licences._labelled(spark, templates()), LicenceModel())
    texts = ["Licensed under CC BY 4.0.", "Licensed under the terms", "released under the MIT License, as told"]
    rows = licences._found(spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").alias("paragraph")), "paragraph", known)
    told = lambda family: {r.t for r in rows.where(licences._confirms(F.col("ids"), known, LicenceModel(), F.lit(family))).collect()}
    assert told("cc-by-4.0") == {texts[0]} and told("mit") == {texts[2]}


def test_threshold_is_the_exact_quantile(spark):
    values = [i / 1000 for i in range(1000)] + [0.75] * 40
    rows = spark.createDataFrame([(v, 1 + i % 3) for i, v in enumerate(values)], "p double, count bigint")
    for q in (0.3, 0.7, 0.9, 0.995, 1.0):
        expect = rows.agg(F.expr(f"percentile(p, {q}D, count)").alias("e")).first().e
        assert abs(licences._threshold(rows, LicenceModel(quantile=q)) - max(0.5, expect)) < 1e-12
