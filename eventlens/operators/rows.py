"""Row helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are worked out once per row, whatever refers to them later.

    Plain projections are merged into what follows, so a long case expression that ten later columns and filters mention
    stands ten times in the plan. A generator row is a boundary that the optimizer does not move expressions across.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to spark.checkpoint.dir and continues from there, for rows that several jobs read.

    Without such a folder one is made in local mode; a cluster without it works ``df`` out anew each time.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            return df
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)
