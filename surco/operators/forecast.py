"""Daily forecasts per series: fit, predict and walk-forward validation.

A series holds one row per day at most, so the days of a century are the most
a single task gets; the series are spread over the cluster.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.fixed_values import SOURCE_HISTORY

YEAR = 365.25
HARMONICS = 10
CHANGEPOINTS = 25
# Turns of the multiplicative fit at most, and the move, as a part of the scale, at which it stands still.
TURNS, STILL = 50, 1e-6

# Target -> (column, seasonality, fitted on log1p).
TARGETS = {
    "et0": ("et0_mm", "multiplicative", False),
    "precip": ("precipitacion_mm", "additive", True),
}


def training_series(daily: DataFrame, targets: Mapping[str, tuple] = TARGETS, keys: tuple[str, ...] = ("parcela_id",),
                    source: str | None = SOURCE_HISTORY) -> DataFrame:
    """(key, target, ds, y) rows of the historic days; days without a value drop out."""
    if source is not None:
        daily = daily.filter(F.col("fuente") == source)
    pairs = F.array(*[
        F.struct(F.lit(t).alias("target"), F.col(spec[0]).cast("double").alias("y")) for t, spec in targets.items()
    ])
    long = daily.select(*keys, F.col("fecha").alias("ds"), F.explode(pairs).alias("p"))
    return long.select(*keys, "p.target", "ds", "p.y").filter(F.col("y").isNotNull())


def _design(days: np.ndarray, start: float, span: float, knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trend columns (level, slope, slope changes) and yearly Fourier columns."""
    t = (days - start) / span
    trend = np.column_stack([np.ones_like(t), t, *[np.maximum(t - k, 0) for k in knots]])
    angle = 2 * np.pi * np.outer(days / YEAR, np.arange(1, HARMONICS + 1))
    return trend, np.hstack([np.cos(angle), np.sin(angle)])


def _ridge(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.linalg.solve(x.T @ x + np.diag(weights), x.T @ y)


def _forecast(days: np.ndarray, y: np.ndarray, ahead: np.ndarray, mode: str, changepoint_scale: float,
              interval: float) -> np.ndarray:
    """Middle, lower and upper prediction for the days ahead."""
    span = max(days[-1] - days[0], 1.0)
    knots = np.linspace(0, 0.8, CHANGEPOINTS + 2)[1:-1]  # the ridge keeps short series solvable
    scale = max(np.abs(y).max(), 1e-9)
    target = y / scale
    noise = 0.05
    trend, season = _design(days, days[0], span, knots)
    f_trend, f_season = _design(ahead, days[0], span, knots)
    stiff = np.r_[1e-6, 1e-6, np.full(len(knots), noise / changepoint_scale**2)]
    loose = np.full(season.shape[1], noise / 10.0**2)
    both = np.hstack([trend, season])
    beta = _ridge(both, target, np.r_[stiff, loose])
    if mode == "additive":
        fitted, ahead_y = both @ beta, np.hstack([f_trend, f_season]) @ beta
    else:
        # y = trend * (1 + season), from the additive fit on by turns until the fit stands still.
        b_trend = beta[: trend.shape[1]]
        fitted = np.full(len(target), np.inf)
        for _ in range(TURNS):
            before = fitted
            level = trend @ b_trend
            b_season = _ridge(season * level[:, None], target - level, loose)
            factor = 1 + season @ b_season
            b_trend = _ridge(trend * factor[:, None], target, stiff)
            fitted = (trend @ b_trend) * factor
            if np.abs(fitted - before).max() <= STILL:
                break
        else:
            warnings.warn(f"trend and season moved by more than {STILL} of the scale after {TURNS} turns", stacklevel=2)
        ahead_y = (f_trend @ b_trend) * (1 + f_season @ b_season)
    half = interval / 2
    low, high = np.quantile(target - fitted, [0.5 - half, 0.5 + half])
    return np.column_stack([ahead_y, ahead_y + low, ahead_y + high]) * scale


def _days(dates: pd.Series) -> np.ndarray:
    return pd.to_datetime(dates).to_numpy("datetime64[D]").astype(float)


def _dates(days: np.ndarray) -> pd.Series:
    return pd.Series(days.astype("int64").astype("datetime64[D]"))


def fit_predict(series: DataFrame, horizon: int = 14, keys: tuple[str, ...] = ("parcela_id",),
                targets: Mapping[str, tuple] = TARGETS, changepoint_scale: float = 0.05,
                interval: float = 0.5) -> DataFrame:
    """P25, P50 and P75 of the next days of every (key, target) series."""
    names = list(keys)
    specs = {t: (mode, log) for t, (_, mode, log) in targets.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        mode, log = specs[pdf["target"].iloc[0]]
        days, y = _days(pdf["ds"]), pdf["y"].to_numpy(float)
        y = np.log1p(y) if log else y
        ahead = days[-1] + np.arange(1, horizon + 1)
        out = _forecast(days, y, ahead, mode, changepoint_scale, interval)
        out = np.maximum(np.expm1(out) if log else out, 0).round(2)
        return pd.DataFrame({
            **{k: pdf[k].iloc[0] for k in [*names, "target"]},
            "fecha": _dates(ahead).dt.date, "p50": out[:, 0], "p25": out[:, 1], "p75": out[:, 2],
        })

    kinds = dict(series.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in names], "target string, fecha date, p50 double, p25 double, p75 double"])
    return series.groupBy(*names, "target").applyInPandas(run, schema)


# ---- closed form: additive moments ------------------------------------------

# Yearly waves of the closed-form model, its ridge, and the normal quantile of a probability of 0.75.
WAVES, RIDGE, QUARTILE = 3, 1e-6, 0.6744897501960817
DAY_ZERO = 10957  # 2000-01-01, in days since 1970


def features(days: np.ndarray, mode: str) -> np.ndarray:
    """Level, slope in years, yearly waves; in multiplicative mode waves that grow with time as well."""
    t = (days - DAY_ZERO) / YEAR
    angle = 2 * np.pi * np.outer(days / YEAR, np.arange(1, WAVES + 1))
    waves = np.hstack([np.cos(angle), np.sin(angle)])
    grown = [waves * t[:, None]] if mode == "multiplicative" else []
    return np.hstack([np.ones((len(days), 1)), t[:, None], waves, *grown])


def _packed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per row the products that add up to X'X (upper triangle), X'y, y'y and n."""
    i, j = np.triu_indices(x.shape[1])
    return np.hstack([x[:, i] * x[:, j], x * y[:, None], (y * y)[:, None], np.ones((len(y), 1))])


def _slots(mode: str) -> int:
    return _packed(features(np.zeros(1), mode), np.zeros(1)).shape[1]


def moments(series: DataFrame, by: tuple[str, ...], targets: Mapping[str, tuple] = TARGETS) -> DataFrame:
    """`by, target, slot, total`: sums over the rows of (by, target, ds, y), to be fitted or added up further.

    Each task reduces its rows to one array per group before anything is
    shuffled; then the slots of the arrays are added up as rows.
    """
    specs = {t: (mode, log) for t, (_, mode, log) in targets.items()}
    rows = series.select(*by, "target", F.unix_date("ds").alias("_day"), "y")
    schema = T.StructType([*[rows.schema[c] for c in (*by, "target")], T.StructField("part", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = pa.Table.from_batches([batch]).append_column("_row", pa.array(np.arange(len(batch)))).group_by([*by, "target"]).aggregate([("_row", "list")])
            days, y = batch.column("_day").to_numpy(zero_copy_only=False).astype(float), batch.column("y").to_numpy(zero_copy_only=False)
            parts = []
            for target, at in zip(groups.column("target").to_pylist(), groups.column("_row_list").to_pylist(), strict=True):
                mode, log = specs[target]
                values = np.log1p(y[at]) if log else y[at]
                parts.append(_packed(features(days[at], mode), values).sum(axis=0))
            yield pa.RecordBatch.from_arrays(
                [*[groups.column(c).combine_chunks() for c in (*by, "target")], pa.array(parts, pa.list_(pa.float64()))], schema=to_arrow_schema(schema))

    parts = rows.mapInArrow(run, schema)
    return parts.select(*by, "target", F.posexplode("part").alias("slot", "x")).groupBy(*by, "target", "slot").agg(F.sum("x").alias("total"))


def _solved(total: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Coefficients and the residuals' standard deviation."""
    a, cut = np.zeros((width, width)), width * (width + 1) // 2
    a[np.triu_indices(width)] = total[:cut]
    a = a + np.triu(a, 1).T
    b, yy, n = total[cut:cut + width], total[-2], total[-1]
    beta = np.linalg.solve(a + RIDGE * np.eye(width), b)
    return beta, float(np.sqrt(max(0.0, yy - 2 * beta @ b + beta @ a @ beta) / n))


def predicted(sums: DataFrame, by: tuple[str, ...], horizon: int, start: str, targets: Mapping[str, tuple] = TARGETS) -> DataFrame:
    """`by, target, ds, horizonte, p50, p25, p75`: each group's fit for the days after its date `start`, one of `by`.

    Values are not cut at zero nor rounded; a log target comes back from its logarithm.
    """
    specs = {t: (mode, log) for t, (_, mode, log) in targets.items()}
    lists = sums.groupBy(*by, "target").agg(F.array_sort(F.collect_list(F.struct("slot", "total"))).alias("sums"))
    rows = lists.select(*by, "target", F.unix_date(start).alias("_start"), F.col("sums.total").alias("sums"))
    fields = [rows.schema[c] for c in (*by, "target")]
    schema = T.StructType([*fields, T.StructField("ds", T.DateType()), T.StructField("horizonte", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("p50", "p25", "p75")]])
    steps = np.arange(1, horizon + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, days = [], []
            for target, first, total in zip(*(batch.column(c).to_pylist() for c in ("target", "_start", "sums")), strict=True):
                mode, log = specs[target]
                x = features((first + steps).astype(float), mode)
                beta, spread = _solved(np.array(total), x.shape[1])
                middle = (x @ beta)[:, None] + spread * QUARTILE * np.array([0.0, -1.0, 1.0])
                out.append(np.expm1(middle) if log else middle)
                days.append(first + steps)
            take = pa.array(np.repeat(np.arange(len(batch)), horizon))
            values = np.concatenate(out) if out else np.empty((0, 3))
            ds = pa.array(np.concatenate(days) if days else np.empty(0, np.int64), pa.int64()).cast(pa.int32()).cast(pa.date32())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(take) for c in (*by, "target")], ds, pa.array(np.tile(steps, len(batch)), pa.int32()),
                *[pa.array(values[:, i]) for i in range(3)]], schema=to_arrow_schema(schema))

    return rows.mapInArrow(run, schema)


def moment_forecast(series: DataFrame, horizon: int = 14, keys: tuple[str, ...] = ("parcela_id",), targets: Mapping[str, tuple] = TARGETS) -> DataFrame:
    """P25, P50 and P75 of the days after the last one of every (key, target) series, at least zero, to two places.

    A straight trend and yearly waves by least squares, in closed form out of sums over the days; quartiles by the
    residuals' deviation. No series is ever in one task.
    """
    last = series.groupBy(*keys, "target").agg(F.max("ds").alias("_last"))
    out = predicted(moments(series, keys, targets).join(last, [*keys, "target"]), (*keys, "_last"), horizon, "_last", targets)
    return out.select(*keys, "target", F.col("ds").alias("fecha"), *[F.round(F.greatest(F.lit(0.0), p), 2).alias(p) for p in ("p50", "p25", "p75")])


def walk_forward_rows(series: DataFrame, initial: int = 1825, period: int = 90, horizon: int = 14, keys: tuple[str, ...] = ("parcela_id",)) -> DataFrame:
    """`keys, target, corte, ds, horizonte, y`: the days to be predicted from each cutoff.

    Cutoffs count back from the last one that leaves a whole horizon, as long as `initial` days lie before them.
    """
    ends = series.groupBy(*keys, "target").agg(F.min("ds").alias("_first"), F.date_sub(F.max("ds"), horizon).alias("_last"))
    steps = F.sequence(F.lit(0), F.floor((F.datediff("_last", "_first") - initial) / period).cast("int"))
    cuts = ends.filter(F.datediff("_last", "_first") >= initial).select(*keys, "target", F.explode(steps).alias("_step"), "_last")
    cuts = cuts.select(*keys, "target", F.expr(f"date_sub(_last, _step * {period})").alias("corte"))
    asked = cuts.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizonte")).withColumn("ds", F.expr("date_add(corte, horizonte)"))
    return asked.join(series, [*keys, "target", "ds"]).select(*keys, "target", "corte", "ds", "horizonte", "y")


def moment_walk_forward(series: DataFrame, initial: int = 1825, period: int = 90, horizon: int = 14, keys: tuple[str, ...] = ("parcela_id",),
                        targets: Mapping[str, tuple] = TARGETS) -> DataFrame:
    """The rows of `walk_forward_rows` with yhat, yhat_lower and yhat_upper of the closed-form model; log targets as logarithms.

    Days fall into the periods between cutoffs; the sums of a cutoff are the running sums of all periods before it, so
    each day is summed once, whatever the number of cutoffs, and every cutoff is a row of its own to solve.
    """
    names = [*keys, "target"]
    tested = walk_forward_rows(series, initial, period, horizon, keys)
    last = series.groupBy(*names).agg(F.date_sub(F.max("ds"), horizon).alias("_last"))
    steps_back = F.floor(F.datediff("_last", "ds") / period)
    past = series.join(last, names).filter(F.col("ds") <= F.col("_last")).withColumn("corte", F.date_sub("_last", (steps_back * period).cast("int")))
    per = moments(past.select(*names, "corte", "ds", "y"), (*keys, "corte"), targets)
    # A cutoff whose own period has no day still asks for the sums of the earlier ones.
    slots = F.element_at(F.create_map(*[F.lit(v) for t, (_, mode, _) in targets.items() for v in (t, _slots(mode))]), F.col("target"))
    asks = tested.select(*names, "corte").distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    both = per.withColumn("_asks", F.lit(False)).unionByName(asks.select(*names, "corte", "slot", F.lit(0.0).alias("total"), F.lit(True).alias("_asks")))
    so_far = W.partitionBy(*names, "slot").orderBy("corte").rangeBetween(W.unboundedPreceding, W.currentRow)
    sums = both.withColumn("total", F.sum("total").over(so_far)).filter("_asks").drop("_asks")
    found = predicted(sums, (*keys, "corte"), horizon, "corte", {t: (c, m, False) for t, (c, m, _) in targets.items()})
    logs = [t for t, spec in targets.items() if spec[2]]
    actual = tested.withColumn("y", F.when(F.col("target").isin(*logs), F.log1p("y")).otherwise(F.col("y")) if logs else F.col("y"))
    found = found.select(*names, "corte", "ds", F.col("p50").alias("yhat"), F.col("p25").alias("yhat_lower"), F.col("p75").alias("yhat_upper"))
    return actual.join(found, [*names, "corte", "ds"])


def quantile_columns(predictions: DataFrame, target: str, keys: tuple[str, ...] = ("parcela_id",)) -> DataFrame:
    """Predictions of one target in the columns the scenarios expect."""
    rows = predictions.filter(F.col("target") == target)
    return rows.select(*keys, "fecha", *[F.col(p).alias(f"{target}_{p}") for p in ("p25", "p50", "p75")])


def quantiles_wide(predictions: DataFrame, keys: tuple[str, ...] = ("parcela_id",),
                   targets: Mapping[str, tuple] = TARGETS) -> DataFrame:
    """One row per day with the quantiles of every target, out of one pass over the predictions."""
    picks = [
        F.max(F.when(F.col("target") == t, F.col(p))).alias(f"{t}_{p}")
        for t in targets for p in ("p25", "p50", "p75")
    ]
    return predictions.groupBy(*keys, "fecha").agg(*picks)


def walk_forward(series: DataFrame, initial: int = 1825, period: int = 90, horizon: int = 14,
                 keys: tuple[str, ...] = ("parcela_id",), targets: Mapping[str, tuple] = TARGETS,
                 changepoint_scale: float = 0.05, interval: float = 0.5) -> DataFrame:
    """Predictions beside actual values for cutoffs every `period` days.

    Cutoffs count back from the last one that leaves a whole horizon, as long
    as `initial` days of training lie before them.
    """
    names = list(keys)
    specs = {t: (mode, log) for t, (_, mode, log) in targets.items()}
    columns = [*names, "target", "corte", "ds", "horizonte", "y", "yhat", "yhat_lower", "yhat_upper"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        mode, log = specs[pdf["target"].iloc[0]]
        days, y = _days(pdf["ds"]), pdf["y"].to_numpy(float)
        y = np.log1p(y) if log else y
        parts = []
        cutoff = days[-1] - horizon
        while cutoff >= days[0] + initial:
            past = days <= cutoff
            test = (days > cutoff) & (days <= cutoff + horizon)
            if test.any():
                out = _forecast(days[past], y[past], days[test], mode, changepoint_scale, interval)
                parts.append(pd.DataFrame({
                    "corte": _dates(np.full(test.sum(), cutoff)).dt.date,
                    "ds": _dates(days[test]).dt.date,
                    "horizonte": (days[test] - cutoff).astype("int32"),
                    "y": y[test], "yhat": out[:, 0], "yhat_lower": out[:, 1], "yhat_upper": out[:, 2],
                }))
            cutoff -= period
        if not parts:
            return pd.DataFrame(columns=columns)
        whole = pd.concat(parts, ignore_index=True)
        return whole.assign(**{k: pdf[k].iloc[0] for k in [*names, "target"]})[columns]

    kinds = dict(series.dtypes)
    schema = ", ".join([
        *[f"{k} {kinds[k]}" for k in names],
        "target string, corte date, ds date, horizonte int, y double, yhat double, yhat_lower double, yhat_upper double",
    ])
    return series.groupBy(*names, "target").applyInPandas(run, schema)


def errors_by_horizon(df: DataFrame, keys: tuple[str, ...] = ("target",), horizon: str = "horizonte") -> DataFrame:
    gap = F.col("y") - F.col("yhat")
    return df.groupBy(*keys, horizon).agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(F.try_divide(gap, F.col("y")))).alias("mape"),
    )


def forecast_errors(df: DataFrame, keys: tuple[str, ...] = ("target",), horizon: str = "horizonte") -> DataFrame:
    """MAE, RMSE and MAPE per horizon, averaged over the horizons."""
    per = errors_by_horizon(df, keys, horizon)
    return per.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in ("mae", "rmse", "mape")])
