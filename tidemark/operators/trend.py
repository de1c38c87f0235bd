"""Least-squares trends over a training window that ends on each series' own last day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import day_number, keep_last, quality
from tidemark.operators.daily import CONTAINER, SERIES

HORIZONS = (30, 90, 180, 365)


def linear_fit(daily: DataFrame, key: list[str], value: str, config: Config, last: list[str], recent: bool = False) -> DataFrame:
    """One aggregation per series over its last train_days calendar days: last_day, last_day_n, train_n, slope, icept,
    r2, the last values of `last` as cur_<name>, and the slope over recent_days if asked for.

    The series' last day comes from a window over the same partitioning that the aggregation then reuses: one
    shuffle in all.
    """
    w = W.partitionBy(*key)
    rows = daily.select(*key, "day_dt", value, *(c for c in last if c != value), F.max("day_dt").over(w).alias("last_day"))
    rows = rows.where(F.col("day_dt") > F.date_sub("last_day", config.train_days)).withColumn("day_n", day_number(F.col("day_dt")))
    y, x = F.col(value).cast("double"), F.col("day_n").cast("double")
    near = F.when(F.col("day_dt") > F.date_sub("last_day", config.recent_days), y)
    columns: list[Column] = [
        F.max("last_day").alias("last_day"),
        F.regr_count(y, x).alias("train_n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("icept"),
        F.regr_r2(y, x).alias("r2"),
        *(keep_last(c, "day_dt").alias(f"cur_{c}") for c in last),
    ]
    if recent:
        columns.append(F.regr_slope(near, x).alias("recent_slope"))
    return rows.groupBy(*key).agg(*columns).withColumn("last_day_n", day_number(F.col("last_day")))


def projected(h: int) -> Column:
    return F.col("icept") + F.col("slope") * (F.col("last_day_n") + h)


def tbspc_forecast(daily: DataFrame, config: Config) -> DataFrame:
    """dbid, con_dbid, tablespace_name, last_day, train_n, cur_used, limit_bytes, slope_bpd, icept, r2, proj_*_bytes,
    days_to_full (negative once over the limit), recent_slope_bpd, accel_ratio, quality."""
    fit = linear_fit(daily, SERIES, "used_bytes", config, ["used_bytes", "limit_bytes"], recent=True)
    slope = F.col("slope")
    return fit.select(
        *SERIES,
        "last_day",
        "train_n",
        F.col("cur_used_bytes").alias("cur_used"),
        F.col("cur_limit_bytes").alias("limit_bytes"),
        slope.alias("slope_bpd"),
        "icept",
        "r2",
        *(projected(h).alias(f"proj_{h}_bytes") for h in HORIZONS),
        F.when(slope > 0, F.floor((F.col("cur_limit_bytes") - F.col("cur_used_bytes")) / slope)).alias("days_to_full"),
        F.col("recent_slope").alias("recent_slope_bpd"),
        F.when(slope != 0, F.col("recent_slope") / slope).alias("accel_ratio"),
        quality(F.col("train_n"), slope, F.col("r2"), config.min_train_days, config.r2_gate).alias("quality"),
    )


def cpu_metrics(cpu: DataFrame, dbtime: DataFrame) -> DataFrame:
    """Both metrics of a container, one row a day, without nulls."""
    busy = cpu.select(*CONTAINER, "day_dt", F.lit("BUSY_PCT").alias("metric"), F.col("busy_pct").alias("val"))
    seconds = dbtime.select(*CONTAINER, "day_dt", F.lit("DB_CPU_SEC").alias("metric"), F.col("db_cpu_sec").alias("val"))
    return busy.unionByName(seconds).where(F.col("val").isNotNull())


def cpu_trend(cpu: DataFrame, dbtime: DataFrame, config: Config) -> DataFrame:
    """dbid, con_dbid, metric, last_day, train_n, cur_val, slope_per_day, r2, proj_30, proj_90, days_to_sat, quality."""
    fit = linear_fit(cpu_metrics(cpu, dbtime), [*CONTAINER, "metric"], "val", config, ["val"])
    slope = F.col("slope")
    left = F.greatest(F.lit(0), F.floor((config.cpu_sat_pct - F.col("cur_val")) / slope))
    return fit.select(
        *CONTAINER,
        "metric",
        "last_day",
        "train_n",
        "cur_val",
        slope.alias("slope_per_day"),
        "r2",
        projected(30).alias("proj_30"),
        projected(90).alias("proj_90"),
        F.when((F.col("metric") == "BUSY_PCT") & (slope > 0), left).alias("days_to_sat"),
        quality(F.col("train_n"), slope, F.col("r2"), config.min_train_days, config.r2_gate).alias("quality"),
    )
