"""Anomalies against a rolling median and its median absolute deviation, in one window pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.functions import day_number, greatest_or_null, median_deviation, ratio
from tidemark.operators.daily import CONTAINER, SERIES

#: Fixed value: from a median absolute deviation to a standard deviation.
SIGMA = 1.4826


def robust_baseline(rows: DataFrame, value: str, frame: WindowSpec) -> DataFrame:
    """rows with med, mad_sigma and n_hist over the frame; days without history go, as an inner self-join has it.

    The frame is bounded, so its values fit in an array. The median is an attribute of the window, and the
    deviation one of a one-row generator: filters on what is derived from them can't move below and repeat the
    array work there.
    """
    rows = rows.select(
        "*",
        F.percentile(value, F.lit(0.5)).over(frame).alias("med"),
        F.collect_list(value).over(frame).alias("history"),
        F.count(value).over(frame).alias("n_hist"),
    ).where("n_hist > 0")
    sigma = F.struct((median_deviation(F.col("history"), F.col("med")) * SIGMA).alias("mad_sigma"))
    return rows.select("*", F.inline(F.array(sigma))).drop("history")


def flag(n: Column, least: int, deviation: Column, threshold: Column) -> Column:
    return F.when((n >= least) & (deviation > threshold), "HIGH").when((n >= least) & (-deviation > threshold), "LOW")


def tbspc_anom(delta: DataFrame, config: Config) -> DataFrame:
    """Each day's growth rate against the calendar days before it, mad_window_days long, the day itself left out."""
    frame = W.partitionBy(*SERIES).orderBy("day_n").rangeBetween(-config.mad_window_days, -1)
    rows = delta.where(F.col("used_rate_bpd").isNotNull()).withColumn("day_n", day_number(F.col("day_dt")))
    rows = robust_baseline(rows, "used_rate_bpd", frame)
    dev = F.col("used_rate_bpd") - F.col("med")
    threshold = greatest_or_null(config.mad_k * F.col("mad_sigma"), F.lit(float(config.abs_floor_bytes)))
    return rows.select(
        *SERIES,
        "day_dt",
        "used_delta_bytes",
        "day_gap",
        "used_rate_bpd",
        F.col("med").alias("median_rate_bpd"),
        "mad_sigma",
        "n_hist",
        dev.alias("dev_bpd"),
        threshold.alias("threshold_bpd"),
        ratio(dev, F.col("mad_sigma")).alias("robust_z"),
        flag(F.col("n_hist"), config.tbspc_min_hist, dev, threshold).alias("anomaly_flag"),
    )


def cpu_anom(cpu: DataFrame, config: Config) -> DataFrame:
    """Each day's busy share against the same weekday of the dow_weeks calendar weeks before."""
    rows = cpu.where(F.col("busy_pct").isNotNull()).withColumn("day_n", day_number(F.col("day_dt")))
    frame = W.partitionBy(*CONTAINER, F.pmod("day_n", F.lit(7))).orderBy(F.floor(F.col("day_n") / 7)).rangeBetween(-config.dow_weeks, -1)
    rows = robust_baseline(rows, "busy_pct", frame)
    sigma = greatest_or_null(F.col("mad_sigma"), F.lit(float(config.cpu_min_mad_pct)))
    dev, threshold = F.col("busy_pct") - F.col("med"), config.mad_k * sigma
    return rows.select(
        *CONTAINER,
        "day_dt",
        "busy_pct",
        F.col("med").alias("median_pct"),
        "mad_sigma",
        "n_hist",
        dev.alias("dev_pct"),
        threshold.alias("threshold_pct"),
        ratio(dev, sigma).alias("robust_z"),
        flag(F.col("n_hist"), config.cpu_min_dow_hist, dev, threshold).alias("anomaly_flag"),
    )
