"""Small linear models on distributed sums: ridge by Gram matrix, walk-forward fits, column predictions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.numeric import sigmoid
from eventlens.operators.isotonic import isotonic_blocks, isotonic_calibrator
from eventlens.operators.rankstats import average_rank, correlation


@dataclass(frozen=True)
class Ridge:
    """Standardised ridge: means and population deviations of the features, weights, and an unpenalised bias."""

    features: tuple[str, ...]
    means: np.ndarray
    scales: np.ndarray
    weights: np.ndarray
    bias: float

    def predict(self) -> Column:
        """The prediction as one column expression; missing features count as 0."""
        out = F.lit(float(self.bias))
        for name, m, s, w in zip(self.features, self.means, self.scales, self.weights, strict=True):
            out = out + (F.coalesce(F.col(name).cast("double"), F.lit(0.0)) - float(m)) / float(s) * float(w)
        return out


def feature_columns(columns: list[str], ids: tuple[str, ...]) -> list[str]:
    """Feature names: no ids, nothing that looks like a target or like metadata."""
    return [c for c in columns if c not in ids and not c.startswith(("target_", "meta_"))]


def _sums(rows: DataFrame, features: list[str], target: str) -> tuple[DataFrame, list]:
    """Rows with numbered features and target, and the aggregates of a Gram matrix over them."""
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features] + [F.col(target).cast("double")]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    return rows.where(F.col(target).isNotNull()), [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in pairs]]


def _solve(features: list[str], sums: np.ndarray, alpha: float) -> Ridge:
    """The model from n, the sums and the products of all pairs, in the order of ``_sums``."""
    p, n = len(features), sums[0]
    if not n:
        return Ridge(tuple(features), np.zeros(p), np.ones(p), np.zeros(p), 0.0)
    mean, cross = sums[1 : p + 2] / n, np.zeros((p + 1, p + 1))
    cross[np.triu_indices(p + 1)] = sums[p + 2 :] / n
    cross = np.triu(cross) + np.triu(cross, 1).T - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cross)[:p], 0.0))
    scale[scale < 1e-12] = 1.0
    gram = n * cross[:p, :p] / np.outer(scale, scale)
    weights = np.linalg.pinv(gram + alpha * np.eye(p)) @ (n * cross[:p, p] / scale)
    return Ridge(tuple(features), mean[:p], scale, weights, float(mean[p]))


def fit_ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 1.5) -> Ridge:
    """Least squares with an alpha penalty on standardised features; one aggregation of p * p sums, solved on the driver."""
    used, sums = _sums(rows, features, target)
    return _solve(features, np.array([x or 0.0 for x in used.agg(*sums).first()], float), alpha)


def _sub_block(features: list[str], sums: np.ndarray, kept: list[int]) -> np.ndarray:
    """The sums of a model on some of the features, taken from those on all."""
    p = len(features)
    pairs = {pair: i for i, pair in enumerate((i, j) for i in range(p + 1) for j in range(i, p + 1))}
    own = [*kept, p]
    cross = [sums[p + 2 + pairs[own[i], own[j]]] for i in range(len(own)) for j in range(i, len(own))]
    return np.array([sums[0], *[sums[1 + i] for i in own], *cross])


def walk_forward(
    rows: DataFrame, date: str, features: list[str], target: str, embargo_days: int = 90, alpha: float = 1.5, families: dict[str, list[str]] | None = None, refit: bool = False, most_dates: int = 100_000
) -> DataFrame:
    """Rows with the prediction of a model fitted on rows whose target had matured by their date.

    Training rows end ``embargo_days`` before the test date, so no label looks past it. One aggregation gives the
    sums of every date; the models of all dates come from their running totals (a row per date on the driver), and one
    join by date brings the coefficients back. ``families`` adds ``prediction_<name>`` without a family's features: set to 0 in the same model,
    or with ``refit`` in a model of the others, solved from the same sums. More than ``most_dates`` dates are an error: cast timestamps to dates.
    """
    families = families or {}
    used, sums = _sums(rows, features, target)
    tests = sorted(r[0] for r in rows.select(date).where(F.col(date).isNotNull()).distinct().limit(most_dates + 1).collect())
    if len(tests) > most_dates:
        raise ValueError(f"more than {most_dates} dates")
    per_date = sorted((r for r in used.groupBy(date).agg(*sums).collect() if r[0] is not None), key=lambda r: r[0])
    left_out = {name: [i for i, f in enumerate(features) if f in own] for name, own in families.items()}
    totals, done, models = np.zeros(len(sums)), 0, []

    def line(kept: list[int], own: np.ndarray) -> tuple[float, list[float]]:
        model = _solve([features[i] for i in kept], own, alpha)
        some = np.asarray(model.weights) / np.asarray(model.scales)
        slopes = np.zeros(len(features))
        slopes[kept] = some
        return float(model.bias - (some * model.means).sum()), [float(x) for x in slopes]

    for test in tests:
        while done < len(per_date) and per_date[done][0] <= test - timedelta(days=embargo_days):
            totals = totals + np.array(per_date[done][1:], float)
            done += 1
        bias, slopes = line(list(range(len(features))), totals)
        lines = [(bias, slopes)]
        for gone in left_out.values():
            kept = [i for i in range(len(features)) if i not in gone]
            lines.append(line(kept, _sub_block(features, totals, kept)) if refit else (bias, [0.0 if i in gone else x for i, x in enumerate(slopes)]))
        models.append((test, lines))
    kind = rows.schema[date].dataType.simpleString()
    table = rows.sparkSession.createDataFrame(models, f"{date} {kind}, _lines array<struct<bias:double,slopes:array<double>>>")
    joined = rows.join(F.broadcast(table), date)  # one row per date
    for n, name in enumerate(("prediction", *[f"prediction_{f}" for f in families])):
        own = F.get("_lines", F.lit(n))
        score = own["bias"]
        for i, f in enumerate(features):
            score = score + F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.get(own["slopes"], F.lit(i))
        joined = joined.withColumn(name, score)
    return joined.drop("_lines")


def ablation_deltas(predicted: DataFrame, date: str, key: list[str], families: list[str], target: str) -> DataFrame:
    """Per date and family: what the rank correlation and the spread of the extreme fifths lose without it, and how alike both predictions rank.

    ``predicted`` has prediction and prediction_<family>; rows without a target are left out. All families are stacked and ranked together.
    """
    rows = predicted.where(F.col(target).isNotNull())
    lines = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"prediction_{f}").alias("ablated")) for f in families])
    stack = rows.select(date, *key, target, "prediction", F.explode(lines).alias("_a")).select(date, *key, target, "prediction", "_a.*")
    by, w = [date, "family"], Window.partitionBy(date, "family")
    size = F.greatest(F.floor(F.count("*").over(w) / 5), F.lit(1))
    place = lambda c, down: F.row_number().over(w.orderBy(F.desc(c) if down else F.asc(c), *key)) <= size
    ranked = stack.withColumns({"_r0": average_rank("prediction", by), "_r1": average_rank("ablated", by), "_ry": average_rank(target, by)})
    ranked = ranked.withColumns({"_t0": place("prediction", True), "_l0": place("prediction", False), "_t1": place("ablated", True), "_l1": place("ablated", False)})
    mean = lambda flag: F.avg(F.when(F.col(flag), F.col(target)))
    return ranked.groupBy(*by).agg(
        F.count("*").alias("rows"),
        (correlation("_r0", "_ry") - correlation("_r1", "_ry")).alias("rank_ic_delta"),
        ((mean("_t0") - mean("_l0")) - (mean("_t1") - mean("_l1"))).alias("spread_delta"),
        correlation("_r0", "_r1").alias("signal_correlation"),
    )


@dataclass(frozen=True)
class Ensemble:
    """Both linear models, whether the return model was trained on alpha, and the calibration of the blended probability."""

    returns: Ridge
    success: Ridge
    used_alpha: bool
    calibrate: Callable[[Column], Column] | None
    digits: int

    def blended(self, rule: Column) -> Column:
        return F.round(0.40 * rule + 0.60 * sigmoid(self.success.predict()), self.digits)

    def probability(self, rule: Column) -> Column:
        """The calibrated chance of success; ``rule`` is the chance by rules."""
        blend = self.blended(rule)
        return blend if self.calibrate is None else self.calibrate(blend)


def train_ensemble(rows: DataFrame, features: list[str], rule: Column, least: int = 20, coverage: float = 0.80, volatility: str = "market_flow_volatility", digits: int = 5) -> Ensemble | None:
    """Trains the return and success models on rows with target_return_90d and target_catalyst_success; None for fewer than ``least``.

    The return target is target_alpha_90d where at least ``coverage`` of the rows have it, divided by the feature ``volatility`` where that is above
    0.01. The success target is 2 or -2. The blend of rule and model is rounded to ``digits`` (so it has a bounded number of values) and
    calibrated by an isotonic fit, unless outcomes or blends are all equal.
    """
    usable = rows.where("target_return_90d is not null and target_catalyst_success is not null")
    has_alpha = "target_alpha_90d" in rows.columns
    counts = usable.agg(F.count("*").alias("n"), (F.count("target_alpha_90d") if has_alpha else F.lit(0)).alias("a")).first()
    if counts.n < least:
        return None
    alpha = has_alpha and counts.a >= coverage * counts.n
    target = "target_alpha_90d" if alpha else "target_return_90d"
    usable = usable.where(F.col(target).isNotNull())
    scale = F.lit(1.0)
    if volatility in features:
        scale = F.when(F.col(volatility) > 0.01, F.col(volatility)).otherwise(1.0)
    usable = usable.withColumns({"_y": F.col(target) / scale, "_c": F.when(F.col("target_catalyst_success") > 0, 2.0).otherwise(-2.0)})
    model = Ensemble(fit_ridge(usable, features, "_y", 1.5), fit_ridge(usable, features, "_c", 2.0), alpha, None, digits)
    scored = usable.select(model.blended(rule).alias("_x"), F.col("target_catalyst_success").alias("_s"))
    ends = scored.agg(F.min("_x") == F.max("_x"), F.min("_s") == F.max("_s")).first()
    if any(ends):
        return model
    return replace(model, calibrate=isotonic_calibrator(isotonic_blocks(scored, "_x", "_s")))


def without(rows: DataFrame, prefix: str) -> DataFrame:
    """Ablation: columns of a prefix set to 0."""
    return rows.withColumns({c: F.lit(0.0) for c in rows.columns if c.startswith(prefix)})
