"""Small documents with the awkward cases, used by the operator tests."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"

AWKWARD = [
    None,
    "",
    " ",
    "\n\n",
    "  lead and trail  ",
    "tab\tand\vvertical\fform\rreturn",
    "one",
    "a b c d e a b c d e a b c d e",
    "nbsp joins thin space stays 　 wide",
    "éàü ß 中文字符 🙂🙂 é ́x",
    "<s> </s> <unk> <0x0A> <|endoftext|> <|startoftext|>x ▁ ▁▁a",
    "line one\nline one\n \n \nline two",
    "x" * 3000,
    "don't DON'T we'll 1234 5.6.7 a--b  double  spaces",
]


def documents(spark: SparkSession, texts, first: int = 0) -> DataFrame:
    rows = [(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
