"""The life of smoothing models: training in one job, a registry, stored forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators.smoothing import FORECAST_SCHEMA, fit_all, model_name
from tidemark.sources.versioned import VersionedTable

REGISTRY_SCHEMA = (
    "model_name string, series_kind string, dbid long, con_dbid long, series_key string, exsm_model string, seasonality int, "
    "trained_through date, trained_at timestamp, status string"
)


class Models:
    """Models over the daily series of an engine, kept under a path. Training replaces the models that it trains and
    leaves the others. With `rates` of level, trend and season, models go by those instead of fitted ones."""

    def __init__(self, spark: SparkSession, path: str, rates: tuple[float, float, float] | None = None):
        self.spark, self.rates = spark, rates
        self.registry = VersionedTable(spark, f"{path}/registry", REGISTRY_SCHEMA)
        self.forecasts = VersionedTable(spark, f"{path}/forecasts", FORECAST_SCHEMA)

    def tablespace_candidates(self, forecast: DataFrame, config: Config, top_n: int) -> DataFrame:
        """The top_n series with enough history: soonest full first, then the largest; ties by their key."""
        order = [F.asc_nulls_last("days_to_full"), F.desc_nulls_last("cur_used"), F.asc("dbid"), F.asc("con_dbid"), F.asc("tablespace_name")]
        return forecast.where(F.col("train_n") >= config.min_train_days).orderBy(*order).limit(top_n).select("dbid", "con_dbid", "tablespace_name")

    def train_tablespaces(self, daily: DataFrame, forecast: DataFrame, config: Config, top_n: int = 20) -> None:
        chosen = self.tablespace_candidates(forecast, config, top_n)
        rows = daily.join(F.broadcast(chosen), ["dbid", "con_dbid", "tablespace_name"], "left_semi")
        self._train(
            rows.select(F.lit("TBSPC").alias("series_kind"), "dbid", "con_dbid", F.col("tablespace_name").alias("series_key"), "day_dt", F.col("used_bytes").cast("double").alias("val")),
            config,
        )

    def train_cpu(self, cpu: DataFrame, dbtime: DataFrame, config: Config) -> None:
        busy = cpu.select(F.lit("CPU").alias("series_kind"), "dbid", "con_dbid", F.lit("BUSY_PCT").alias("series_key"), "day_dt", F.col("busy_pct").alias("val"))
        seconds = dbtime.select(F.lit("DBCPU").alias("series_kind"), "dbid", "con_dbid", F.lit("DB_CPU_SEC").alias("series_key"), "day_dt", F.col("db_cpu_sec").alias("val"))
        self._train(busy.unionByName(seconds), config)

    def train_all(self, daily: DataFrame, cpu: DataFrame, dbtime: DataFrame, forecast: DataFrame, config: Config, top_n: int = 20) -> None:
        self.train_tablespaces(daily, forecast, config, top_n)
        self.train_cpu(cpu, dbtime, config)

    def _train(self, series: DataFrame, config: Config) -> None:
        """Mark as TRAINING, fit all series in one job, store forecasts, then the final status."""
        series = series.where(F.col("val").isNotNull())
        columns = [c.split()[0] for c in REGISTRY_SCHEMA.split(", ")]
        names = series.select("series_kind", "dbid", "con_dbid", "series_key").distinct().withColumn("model_name", model_name())
        empty = {"exsm_model": "string", "seasonality": "int", "trained_through": "date"}
        marked = names.select("*", *(F.lit(None).cast(t).alias(c) for c, t in empty.items()), F.current_timestamp().alias("trained_at"), F.lit("TRAINING").alias("status"))
        self.registry.upsert(marked.select(columns), "model_name")
        result = fit_all(series, config.esm_prediction_step, self.rates).persist()
        try:
            forecast = result.where("status = 'OK'").select([c.split()[0] for c in FORECAST_SCHEMA.split(", ")])
            kept = self.forecasts.read().join(result.select("model_name").distinct(), "model_name", "left_anti")
            self.forecasts.write(kept.unionByName(forecast))
            final = result.withColumn("trained_at", F.current_timestamp()).select(columns).dropDuplicates(["model_name"])
            self.registry.upsert(final, "model_name")
        finally:
            result.unpersist()

    def drop_all(self) -> None:
        """Forget every model and forecast."""
        self.registry.write(self.spark.createDataFrame([], REGISTRY_SCHEMA))
        self.forecasts.write(self.spark.createDataFrame([], FORECAST_SCHEMA))

    def get_forecast(self, name: str) -> DataFrame:
        """case_id, actual, prediction, lower_bound, upper_bound of a model; no rows for an unknown one."""
        rows = self.forecasts.read().where(F.col("model_name") == name)
        return rows.select(F.col("day_dt").alias("case_id"), "actual", "prediction", "lower_bound", "upper_bound")

    def esm_forecast(self) -> DataFrame:
        """All forecasts of models that are OK."""
        models = self.registry.read().where("status = 'OK'").select("model_name", "series_kind", "dbid", "con_dbid", "series_key", "seasonality", "trained_through")
        return models.join(self.forecasts.read(), "model_name")

    def ok_count(self) -> int:
        return self.registry.read().where("status = 'OK'").count()
