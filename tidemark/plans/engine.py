"""The engine: lazy relations over a seam, a configuration and, optionally, a folder of models."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import anomaly, daily, trend
from tidemark.plans import compare as comparing
from tidemark.plans.models import Models
from tidemark.sources.seams import Seam


class Engine:
    """All named relations as DataFrames; building them reads no data.

    `cache` persists the three daily relations, which most others share; `close` lets them go.
    """

    def __init__(self, seam: Seam, config: Config | None = None, models_path: str | None = None, cache: bool = False):
        self.seam, self.config, self.cache = seam, config or Config(), cache
        self.spark = seam.snapshot.sparkSession
        self.models = Models(self.spark, models_path) if models_path else None
        self._kept: list[DataFrame] = []

    def _keep(self, df: DataFrame) -> DataFrame:
        if self.cache:
            self._kept.append(df.persist())
        return df

    def close(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    @cached_property
    def tbspc_daily(self) -> DataFrame:
        return self._keep(daily.tbspc_daily(self.seam))

    @cached_property
    def tbspc_delta(self) -> DataFrame:
        return daily.tbspc_delta(self.tbspc_daily)

    @cached_property
    def cpu_daily(self) -> DataFrame:
        return self._keep(daily.cpu_daily(self.seam))

    @cached_property
    def dbtime_daily(self) -> DataFrame:
        return self._keep(daily.dbtime_daily(self.seam))

    @cached_property
    def tbspc_forecast(self) -> DataFrame:
        return trend.tbspc_forecast(self.tbspc_daily, self.config)

    @cached_property
    def cpu_trend(self) -> DataFrame:
        return trend.cpu_trend(self.cpu_daily, self.dbtime_daily, self.config)

    @cached_property
    def tbspc_anom(self) -> DataFrame:
        return anomaly.tbspc_anom(self.tbspc_delta, self.config)

    @cached_property
    def cpu_anom(self) -> DataFrame:
        return anomaly.cpu_anom(self.cpu_daily, self.config)

    @property
    def esm_forecast(self) -> DataFrame | None:
        return self.models.esm_forecast() if self.models else None

    @property
    def compare(self) -> DataFrame:
        last = comparing.last_days(self.tbspc_daily, self.cpu_daily, self.dbtime_daily) if self.models else None
        return comparing.compare(self.tbspc_forecast, self.cpu_trend, self.esm_forecast, last)

    def train_tablespaces(self, top_n: int = 20) -> None:
        self._models().train_tablespaces(self.tbspc_daily, self.tbspc_forecast, self.config, top_n)

    def train_cpu(self) -> None:
        self._models().train_cpu(self.cpu_daily, self.dbtime_daily, self.config)

    def train_all(self, top_n: int = 20) -> None:
        self.train_tablespaces(top_n)
        self.train_cpu()

    def drop_all(self) -> None:
        self._models().drop_all()

    def _models(self) -> Models:
        if self.models is None:
            raise ValueError("this engine has no models_path")
        return self.models

    RELATIONS = {
        "capd_tbspc_daily": "tbspc_daily",
        "capd_tbspc_delta": "tbspc_delta",
        "capd_cpu_daily": "cpu_daily",
        "capd_dbtime_daily": "dbtime_daily",
        "capf_tbspc_forecast": "tbspc_forecast",
        "capf_cpu_trend": "cpu_trend",
        "capa_tbspc_anom": "tbspc_anom",
        "capa_cpu_anom": "cpu_anom",
        "capf_compare": "compare",
    }

    def install(self) -> list[str]:
        """Temp views of contracts and relations, so that SQL can query them; safe to call again."""
        self.seam.create_views()
        names = []
        for view, attribute in self.RELATIONS.items():
            getattr(self, attribute).createOrReplaceTempView(view)
            names.append(view)
        if self.models:
            self.models.esm_forecast().createOrReplaceTempView("capf_esm_forecast")
            self.models.registry.read().createOrReplaceTempView("cap_ml_model")
            names += ["capf_esm_forecast", "cap_ml_model"]
        self.spark.createDataFrame(self.config.rows(), "cfg_name string, cfg_value double").createOrReplaceTempView("cap_config")
        return [*names, "cap_config"]

    def uninstall(self, models: bool = False) -> None:
        """Drop the views; with `models`, the stored models too."""
        from tidemark.sources.contracts import CONTRACTS

        for view in [*self.RELATIONS, "capf_esm_forecast", "cap_ml_model", "cap_config", *("capv_" + c for c in CONTRACTS)]:
            self.spark.catalog.dropTempView(view)
        if models and self.models:
            self.models.registry.drop()
            self.models.forecasts.drop()

    def max_day(self, *relations: DataFrame) -> DataFrame:
        """One row: the greatest day of all relations."""
        days = relations[0].select("day_dt")
        for r in relations[1:]:
            days = days.unionByName(r.select("day_dt"))
        return days.agg(F.max("day_dt").alias("max_day"))
