"""Evidence tokens and weighted token overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that tell nothing, and the weights of program, condition and trial tokens, and of the name.
EVIDENCE_STOPS = (
    "biopharma", "biotech", "biosciences", "company", "corp", "corporation", "inc", "medicine", "medicines", "pharma", "pharmaceutical",
    "pharmaceuticals", "therapeutic", "therapeutics",
)
EVIDENCE_WEIGHTS = (3.0, 2.0, 1.5)
NAME_BONUS = 4.0


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens without stop words, of four characters or more or with a digit."""
    found = F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9][a-z0-9-]+"), F.lit(0)), lambda x: F.rtrim(x, F.lit("-")))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*EVIDENCE_STOPS) & ((F.length(x) >= 4) | x.rlike("[0-9]"))))


def best_evidence(items: DataFrame, texts: DataFrame, by: list[str], key: str, limit: int) -> DataFrame:
    """The ``limit`` texts of the highest score per item: by, key, score, rank; ties by key.

    ``items`` has a row per token with its ``weight`` and the item's ``name``; ``texts`` has key and text. The score is the
    weights of the shared tokens, and a bonus where the text names the item (letters and digits compared).
    """
    words = texts.select(key, F.explode(tokens(F.col("text"))).alias("token"))
    shared = items.join(words, "token").groupBy(*by, "name", key).agg(F.sum("weight").alias("shared"))
    plain = texts.select(key, F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").alias("_plain"))
    named = (F.length("name") > 0) & F.contains(F.col("_plain"), F.col("name"))
    scored = shared.join(plain, key).select(*by, key, (F.col("shared") + F.when(named, NAME_BONUS).otherwise(0.0)).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= limit)
