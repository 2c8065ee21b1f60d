"""Session and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


def session(name: str = "eventlens", **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Thresholds:
    """Gates of the event stack."""

    max_lookback_days: int = 20
    post_window_days: int = 6
    deployable_days: tuple[int, int] = (7, 90)
    rolling_windows: int = 6
    rebalance_days: int = 14
    staleness_days: int = 120
    corroborating_sources: int = 2
