"""Both engines at matched horizons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ["dbid", "con_dbid", "series_kind", "series_key", "horizon_days", "engine", "value", "lower_bound", "upper_bound"]
ESM_HORIZON = 30


def _points(df: DataFrame, kind: str, key: str, horizons: dict[int, str]) -> DataFrame:
    """One row a horizon, in one pass over df."""
    pairs = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon_days"), F.col(c).alias("value")) for h, c in horizons.items()))).alias("p")
    rows = df.where("quality <> 'INSUFFICIENT_HISTORY'").select("dbid", "con_dbid", F.lit(kind).alias("series_kind"), F.col(key).alias("series_key"), pairs)
    none = F.lit(None).cast("double")
    return rows.select("dbid", "con_dbid", "series_kind", "series_key", "p.horizon_days", F.lit("REGR").alias("engine"), "p.value", none.alias("lower_bound"), none.alias("upper_bound"))


def regr_points(forecast: DataFrame, trend: DataFrame) -> DataFrame:
    tablespaces = _points(forecast, "TBSPC", "tablespace_name", {h: f"proj_{h}_bytes" for h in (30, 90, 180, 365)})
    return tablespaces.unionByName(_points(trend, "CPU", "metric", {30: "proj_30", 90: "proj_90"}))


def last_days(daily: DataFrame, cpu: DataFrame, dbtime: DataFrame) -> DataFrame:
    """The last day of every series that a model can have, by the model's kind and key."""
    last = F.max("day_dt").alias("last_day")
    t = daily.groupBy("dbid", "con_dbid", F.col("tablespace_name").alias("series_key")).agg(last).withColumn("series_kind", F.lit("TBSPC"))
    c = cpu.groupBy("dbid", "con_dbid").agg(last).withColumn("series_kind", F.lit("CPU")).withColumn("series_key", F.lit("BUSY_PCT"))
    d = dbtime.groupBy("dbid", "con_dbid").agg(last).withColumn("series_kind", F.lit("DBCPU")).withColumn("series_key", F.lit("DB_CPU_SEC"))
    return t.unionByName(c).unionByName(d)


def esm_points(esm: DataFrame, last: DataFrame) -> DataFrame:
    """The smoothing forecast 30 days ahead, of models trained through their series' last day."""
    ahead = esm.where(F.col("actual").isNull() & (F.col("day_dt") == F.date_add("trained_through", ESM_HORIZON)))
    fresh = ahead.join(last, ["dbid", "con_dbid", "series_kind", "series_key"]).where(F.col("trained_through") == F.col("last_day"))
    return fresh.select(
        "dbid", "con_dbid", F.when(F.col("series_kind") == "TBSPC", "TBSPC").otherwise("CPU").alias("series_kind"), "series_key",
        F.lit(ESM_HORIZON).alias("horizon_days"), F.lit("ESM").alias("engine"), F.col("prediction").alias("value"), "lower_bound", "upper_bound",
    )


def compare(forecast: DataFrame, trend: DataFrame, esm: DataFrame | None, last: DataFrame | None) -> DataFrame:
    points = regr_points(forecast, trend)
    return points if esm is None else points.unionByName(esm_points(esm, last))
