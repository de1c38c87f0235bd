"""Exponential smoothing per series: Holt's trend, or additive Winters with a weekly season, with 95 % bounds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEASON = 7
MOST_STEPS = 30
Z95 = 1.959963984540054
GRID = np.array([0.02, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 1.0])

FORECAST_SCHEMA = "model_name string, day_dt date, actual double, prediction double, lower_bound double, upper_bound double"
RESULT_SCHEMA = (
    "model_name string, series_kind string, dbid long, con_dbid long, series_key string, exsm_model string, seasonality int, "
    "trained_through date, status string, day_dt date, actual double, prediction double, lower_bound double, upper_bound double"
)


def horizon(rows: int, step: int) -> int:
    """Steps ahead: the knob's, at most 30 and at most a quarter of the rows, at least one."""
    return max(1, min(step, MOST_STEPS, rows // 4))


@dataclass
class Fitted:
    predictions: np.ndarray
    forecast: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    parameters: tuple[float, ...]


def _run(y: np.ndarray, p: np.ndarray, season: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One-step predictions (time, parameter set) and the final state, for all parameter sets at once.

    p has rows of level, trend and seasonal rates. Without a season the first two points start level and trend,
    so a straight line is followed exactly; with one, the first two whole seasons do.
    """
    a, b, g = (p[:, k] for k in range(3))
    n, k = len(y), len(p)
    out = np.empty((n, k))
    if season:
        first, second = y[:season].mean(), y[season : 2 * season].mean()
        trend = np.full(k, (second - first) / season)
        level = np.full(k, first - trend[0] * (season + 1) / 2)
        s = np.repeat((y[:season] - (level[0] + trend[0] * np.arange(1, season + 1)))[:, None], k, 1)
        start = 0
    else:
        level, trend, s = np.full(k, y[0]), np.full(k, y[1] - y[0] if n > 1 else 0.0), np.zeros((1, k))
        out[0] = y[0]
        start = 1
    for t in range(start, n):
        old = s[t % season] if season else 0.0
        out[t] = level + trend + old
        before = level
        level = a * (y[t] - old) + (1 - a) * (level + trend)
        if season:
            s[t % season] = g * (y[t] - before - trend) + (1 - g) * old
        trend = b * (level - before) + (1 - b) * trend
    return out, level, trend, s


def fit(y: np.ndarray, steps: int, season: int = 0, rates: tuple[float, float, float] | None = None) -> Fitted:
    """The parameters of least squared one-step error over a grid, refined around the best; deterministic. Given rates
    of level, trend and season are taken as they are."""
    y = np.asarray(y, float)
    if len(y) < (2 * season if season else 2):
        raise ValueError(f"{len(y)} days are too few")
    centre, width = None, None
    best: tuple | None = None
    if rates:
        best = (0.0, rates if season else (*rates[:2], 0.0))
    for _ in range(0 if rates else 5):
        axes = [GRID if centre is None else np.clip(np.array([-1, -0.5, 0, 0.5, 1]) * width + c, 0.0, 1.0) for c in (centre or (0, 0, 0))]
        if not season:
            axes[2] = np.zeros(1)
        p = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
        sse = ((y[:, None] - _run(y, p, season)[0]) ** 2).sum(0)
        i = int(np.argmin(sse))
        if best is None or sse[i] < best[0]:
            best = (float(sse[i]), tuple(float(v) for v in p[i]))
        centre, width = best[1], 0.15 if width is None else width / 2
    p = np.array([best[1]])
    seen, level, trend, s = _run(y, p, season)
    a, b, g = best[1]
    h = np.arange(1, steps + 1)
    ahead = level[0] + trend[0] * h
    if season:
        ahead = ahead + s[(len(y) + h - 1) % season, 0]
    errors = (y - seen[:, 0])[(0 if season else 2) :]
    variance = float((errors**2).mean()) if len(errors) else 0.0
    scale = max(1.0, float(np.abs(y).max()))
    if variance < (1e-12 * scale) ** 2:
        variance = 0.0
    c = a + a * b * h + (g * (1 - a) * (h % season == 0) if season else 0)
    spread = Z95 * np.sqrt(variance * (1 + np.concatenate([[0.0], np.cumsum(c**2)[:-1]])))
    return Fitted(seen[:, 0], ahead, ahead - spread, ahead + spread, best[1])


def on_daily_grid(days: pd.Series, values: pd.Series) -> tuple[pd.DatetimeIndex, np.ndarray, np.ndarray]:
    """Every day from the first to the last, with missing ones interpolated, and which ones were observed."""
    s = pd.Series(values.to_numpy(float), index=pd.DatetimeIndex(days)).sort_index()
    s = s[~s.index.duplicated(keep="last")]
    grid = pd.date_range(s.index[0], s.index[-1], freq="D")
    full = s.reindex(grid)
    return grid, full.interpolate().to_numpy(), full.notna().to_numpy()


def model_name(kind_column: str = "series_kind"):
    """Prefix by kind, and 16 hex digits of the series' identity; parts that are null are skipped."""
    prefix = F.when(F.col(kind_column) == "TBSPC", "CAPT").when(F.col(kind_column) == "CPU", "CAPC").otherwise("CAPD")
    identity = F.concat(F.coalesce(F.col("dbid").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("con_dbid").cast("string"), F.lit("")), F.lit("|"), F.coalesce("series_key", F.lit("")))
    return F.concat(prefix, F.lit("_"), F.substring(F.upper(F.md5(identity)), 1, 16))


def fit_all(series: DataFrame, step: int, rates: tuple[float, float, float] | None = None) -> DataFrame:
    """series: series_kind, dbid, con_dbid, series_key, day_dt, val. One group is one series: its days. Returns each
    model's row repeated for each forecast row; a series that can't be fitted has one row and a FAILED status, and
    never stops the others."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        head = part.iloc[0]
        season = 0 if head["series_kind"] == "TBSPC" else SEASON
        kind = "EXSM_ADDWINTERS" if season else "EXSM_HOLT"
        part = part.dropna(subset=["val"])
        base = {
            "model_name": head["model_name"], "series_kind": head["series_kind"], "dbid": head["dbid"], "con_dbid": head["con_dbid"],
            "series_key": head["series_key"], "exsm_model": kind, "seasonality": season or None,
            "trained_through": part["day_dt"].max() if len(part) else None,
        }
        try:
            if part.empty:
                raise ValueError("no days")
            days, y, known = on_daily_grid(part["day_dt"], part["val"])
            steps = horizon(len(part), step)
            f = fit(y, steps, season, rates)
            rows = [(d.date(), v if k else None, p, None, None) for d, v, k, p in zip(days, y, known, f.predictions) if k]
            future = [(days[-1] + pd.Timedelta(days=h + 1)).date() for h in range(steps)]
            rows += [(d, None, p, lo, hi) for d, p, lo, hi in zip(future, f.forecast, f.lower, f.upper)]
            status = "OK"
        except Exception as error:  # recorded with the model, as each series stands alone
            rows, status = [(None, None, None, None, None)], f"FAILED:{error}"[:200]
        out = pd.DataFrame(rows, columns=["day_dt", "actual", "prediction", "lower_bound", "upper_bound"])
        for k, v in base.items():
            out[k] = v
        out["status"] = status
        out["seasonality"] = out["seasonality"].astype("Int32")
        return out[[c.split()[0] for c in RESULT_SCHEMA.split(", ")]]

    return series.withColumn("model_name", model_name()).groupBy("model_name").applyInPandas(one, RESULT_SCHEMA)
