"""Report relations, each built once as a DataFrame for both renderers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import keep_last, quality
from tidemark.operators.daily import CONTAINER, SERIES
from tidemark.operators.trend import linear_fit
from tidemark.plans.engine import Engine

GB, MB = 1_073_741_824, 1_048_576
LANES = 12
#: r2 from which a prediction counts as of high confidence.
HIGH_R2 = 0.9


def severity(days: Column, warn: int, crit: int) -> Column:
    return F.when(days <= crit, "CRIT").when(days <= warn, "WARN").otherwise("ok")


@dataclass
class Reports:
    engine: Engine

    @property
    def config(self):
        return self.engine.config

    # Tables of the text report

    def days_to_full(self) -> DataFrame:
        """The top_n reliable forecasts by days to full; ties by key."""
        f, c = self.engine.tbspc_forecast, self.config
        return (
            f.where("quality = 'OK' AND days_to_full IS NOT NULL")
            .select(
                *SERIES,
                (F.col("cur_used") / GB).alias("cur_gb"),
                (F.col("limit_bytes") / GB).alias("limit_gb"),
                (F.col("slope_bpd") / MB).alias("slope_mb"),
                "days_to_full",
                severity(F.col("days_to_full"), c.dtf_warn, c.dtf_crit).alias("sev"),
                F.col("accel_ratio").alias("accel"),
                "r2",
                "last_day",
            )
            .orderBy("days_to_full", *SERIES)
            .limit(c.top_n)
        )

    def forecast_table(self) -> DataFrame:
        """Current and projected size of every series, with the smoothing forecast where there is a fresh one."""
        esm = self.engine.compare.where("engine = 'ESM' AND series_kind = 'TBSPC' AND horizon_days = 30")
        esm = esm.select("dbid", "con_dbid", F.col("series_key").alias("tablespace_name"), (F.col("value") / GB).alias("esm30"))
        return (
            self.engine.tbspc_forecast.join(esm, SERIES, "left")
            .select(
                *SERIES,
                F.col("train_n").alias("n"),
                (F.col("cur_used") / GB).alias("cur_gb"),
                *((F.col(f"proj_{h}_bytes") / GB).alias(f"p{h}") for h in (30, 90, 180)),
                "r2",
                "quality",
                "esm30",
            )
            .orderBy("con_dbid", "tablespace_name", "dbid")
        )

    def _recent(self, anomalies: DataFrame, daily: DataFrame) -> DataFrame:
        """Flagged rows of the last anomaly_days before the newest day of the daily relation; that is one row."""
        newest = F.broadcast(self.engine.max_day(daily))
        rows = anomalies.where("anomaly_flag IS NOT NULL").crossJoin(newest)
        return rows.where(F.col("day_dt") > F.date_sub("max_day", self.config.anomaly_days)).drop("max_day")

    def tbspc_anomalies(self) -> DataFrame:
        rows = self._recent(self.engine.tbspc_anom, self.engine.tbspc_daily)
        return rows.select(
            *SERIES,
            "day_dt",
            F.col("day_gap").alias("gap"),
            (F.col("used_delta_bytes") / MB).alias("delta_mb"),
            (F.col("used_rate_bpd") / MB).alias("rate_mb"),
            (F.col("median_rate_bpd") / MB).alias("med_mb"),
            (F.col("threshold_bpd") / MB).alias("thr_mb"),
            F.col("robust_z").alias("z"),
            "anomaly_flag",
        ).orderBy(F.desc("day_dt"), "con_dbid", "tablespace_name", "dbid")

    def cpu_trend_table(self) -> DataFrame:
        return self.engine.cpu_trend.select(
            *CONTAINER, "metric", F.col("train_n").alias("n"), "cur_val", F.col("slope_per_day").alias("slope_day"), "r2", F.col("days_to_sat").alias("days_sat"), "quality"
        ).orderBy("con_dbid", "metric", "dbid")

    def cpu_anomalies(self) -> DataFrame:
        rows = self._recent(self.engine.cpu_anom, self.engine.cpu_daily)
        columns = ["day_dt", "busy_pct", "median_pct", "threshold_pct", F.col("robust_z").alias("z"), "anomaly_flag"]
        return rows.select(*CONTAINER, *columns).orderBy(F.desc("day_dt"), "con_dbid", "dbid")

    def compare_table(self, kind: str) -> DataFrame:
        """Both engines side by side, by series and horizon; tablespaces in GB."""
        unit = GB if kind == "TBSPC" else 1
        cell = lambda e, c: (F.max(F.when(F.col("engine") == e, F.col(c))) / unit)
        rows = self.engine.compare.where(F.col("series_kind") == kind).groupBy("dbid", "con_dbid", "series_key", F.col("horizon_days").alias("h"))
        return rows.agg(
            cell("REGR", "value").alias("regr"), cell("ESM", "value").alias("esm"), cell("ESM", "lower_bound").alias("esm_lo"), cell("ESM", "upper_bound").alias("esm_hi")
        ).orderBy("con_dbid", "series_key", "h", "dbid")

    def ok_models(self) -> int:
        return self.engine.models.ok_count() if self.engine.models else 0

    def shows_esm(self, ok_models: int) -> bool:
        mode = self.config.show_esm.upper()
        return mode == "Y" or (mode == "AUTO" and ok_models > 0)

    # The whole database

    def total_filled(self) -> DataFrame:
        """Used bytes of a container by day; a series counts with its last known value on days that it lacks."""
        d = self.engine.tbspc_daily
        grid = d.select(*CONTAINER, "day_dt").distinct().join(d.select(*SERIES).distinct(), CONTAINER)
        w = W.partitionBy(*SERIES).orderBy("day_dt").rowsBetween(W.unboundedPreceding, W.currentRow)
        filled = grid.join(d.select(*SERIES, "day_dt", "used_bytes"), [*SERIES, "day_dt"], "left")
        filled = filled.withColumn("carried_bytes", F.last("used_bytes", ignorenulls=True).over(w))
        return filled.groupBy(*CONTAINER, "day_dt").agg(F.sum("carried_bytes").alias("all_bytes"))

    def current_totals(self) -> DataFrame:
        """Of a container's last day, not filled: used, limit, and whether all limits are known."""
        day = self.engine.tbspc_daily.groupBy(*CONTAINER, "day_dt").agg(
            F.sum("used_bytes").alias("all_bytes"),
            F.sum("limit_bytes").alias("limit_total"),
            (F.count("*") == F.count("limit_bytes")).cast("int").alias("all_known"),
        )
        return day.groupBy(*CONTAINER).agg(
            keep_last("all_bytes", "day_dt").alias("cur_used"), keep_last("limit_total", "day_dt").alias("cur_limit"), keep_last("all_known", "day_dt").alias("limit_all")
        )

    def total_fit(self) -> DataFrame:
        """The whole database's fit, grade and days to its limit, by the rules of single series."""
        c = self.config
        fit = linear_fit(self.total_filled(), CONTAINER, "all_bytes", c, [])
        rows = fit.join(self.current_totals(), CONTAINER).withColumn("quality", quality(F.col("train_n"), F.col("slope"), F.col("r2"), c.min_train_days, c.r2_gate))
        reach = (F.col("quality") == "OK") & (F.col("slope") > 0) & (F.col("limit_all") == 1) & (F.col("cur_limit") > F.col("cur_used"))
        return rows.select(
            *CONTAINER, "last_day", "last_day_n", "slope", "r2", F.col("train_n").alias("n"), "cur_used", "cur_limit", "limit_all",
            (F.col("icept") + F.col("slope") * (F.col("last_day_n") + 180)).alias("proj_180"),
            "quality",
            F.when(reach, F.floor((F.col("cur_limit") - F.col("cur_used")) / F.col("slope"))).alias("days_to_limit"),
        )

    # What needs attention

    def alerts(self) -> DataFrame:
        """What is forecast to reach its limit within the warning window: kind, dbid, con_dbid, label, days, severity (2 critical)."""
        c = self.config

        def found(df: DataFrame, kind: str, label: Column, days: str) -> DataFrame:
            rows = df.where(F.col(days).isNotNull() & (F.col(days) <= c.dtf_warn))
            return rows.select(
                F.lit(kind).alias("kind"), *CONTAINER, label.alias("label"), F.col(days).cast("long").alias("days"), F.when(F.col(days) <= c.dtf_crit, 2).otherwise(1).alias("severity")
            )

        spaces = found(self.engine.tbspc_forecast.where("quality = 'OK'"), "TBSPC", F.col("tablespace_name"), "days_to_full")
        whole = found(self.total_fit(), "DATABASE", F.lit("The whole database"), "days_to_limit")
        cpu = found(self.engine.cpu_trend.where("metric = 'BUSY_PCT' AND quality = 'OK'"), "CPU", F.lit("Host CPU"), "days_to_sat")
        return spaces.unionByName(whole).unionByName(cpu)

    def unusual_days(self) -> DataFrame:
        """One row: flagged days of both kinds in the report's window."""
        t = self._recent(self.engine.tbspc_anom, self.engine.tbspc_daily).select(F.lit(1).alias("x"))
        c = self._recent(self.engine.cpu_anom, self.engine.cpu_daily).select(F.lit(1).alias("x"))
        return t.unionByName(c).agg(F.count("*").alias("n_unusual"))

    def banner(self) -> DataFrame:
        """One row: state (ok, warn, crit), number of alerts."""
        rows = self.alerts().agg(F.count("*").alias("n_alerts"), F.coalesce(F.max("severity"), F.lit(0)).alias("severity"))
        state = F.when(F.col("n_alerts") == 0, "ok").when(F.col("severity") >= 2, "crit").otherwise("warn")
        return rows.select(state.alias("state"), "n_alerts")

    def prediction_cards(self) -> DataFrame:
        return self.days_to_full().select("*", F.when(F.col("r2") >= HIGH_R2, "high").otherwise("good").alias("confidence"))

    def dominant_quality(self) -> DataFrame:
        """The most frequent grade; ties alphabetically."""
        return self.engine.tbspc_forecast.groupBy("quality").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "quality").limit(1)

    def quality_rollup(self) -> DataFrame:
        n = lambda q: F.coalesce(F.sum((F.col("quality") == q).cast("long")), F.lit(0))
        return self.engine.tbspc_forecast.agg(
            n("FLAT").alias("n_flat"), n("LOW_CONFIDENCE").alias("n_low"), n("INSUFFICIENT_HISTORY").alias("n_short"), n("OK").alias("n_ok")
        )

    # Timeline

    def timeline_bounds(self) -> DataFrame:
        newest = self.engine.max_day(self.engine.tbspc_daily, self.engine.cpu_daily)
        return newest.select(F.date_sub("max_day", self.config.anomaly_days).alias("min_day"), "max_day")

    def timeline_points(self) -> DataFrame:
        """Flagged days of both kinds inside the timeline, with what their tooltips tell."""
        none = lambda t: F.lit(None).cast(t)
        t = self.engine.tbspc_anom.where("anomaly_flag IS NOT NULL").select(
            F.lit("TBSPC").alias("kind"), *CONTAINER, F.col("tablespace_name").alias("label"), "day_dt", "anomaly_flag", "used_delta_bytes", "used_rate_bpd", "median_rate_bpd",
            none("double").alias("busy_pct"), none("double").alias("median_pct"),
        )
        c = self.engine.cpu_anom.where("anomaly_flag IS NOT NULL").select(
            F.lit("CPU").alias("kind"), *CONTAINER, F.lit("Host CPU").alias("label"), "day_dt", "anomaly_flag", none("long").alias("used_delta_bytes"),
            none("double").alias("used_rate_bpd"), none("double").alias("median_rate_bpd"), "busy_pct", "median_pct",
        )
        rows = t.unionByName(c).crossJoin(F.broadcast(self.timeline_bounds()))
        return rows.where((F.col("day_dt") > F.col("min_day")) & (F.col("day_dt") <= F.col("max_day"))).drop("min_day", "max_day")

    def timeline_lanes(self) -> DataFrame:
        """The LANES series with most flagged days, and how many series there are in all."""
        lanes = self.timeline_points().groupBy("kind", *CONTAINER, "label").agg(F.count("*").alias("n"))
        total = lanes.agg(F.count("*").alias("n_lanes"))
        return lanes.orderBy(F.desc("n"), "label", *CONTAINER).limit(LANES).crossJoin(F.broadcast(total))

    # Charts

    def chart_series(self) -> DataFrame:
        """The top_n series for charts, soonest full first, and how many there are in all."""
        f = self.engine.tbspc_forecast
        total = f.agg(F.count("*").alias("n_series"))
        chosen = f.orderBy(F.asc_nulls_last("days_to_full"), "tablespace_name", *CONTAINER).limit(self.config.top_n)
        return chosen.crossJoin(F.broadcast(total))

    def chart_history(self) -> DataFrame:
        """Daily size in GB of the charted series, and the flag of the day."""
        chosen = F.broadcast(self.chart_series().select(*SERIES))
        flags = self.engine.tbspc_anom.where("anomaly_flag IS NOT NULL").select(*SERIES, "day_dt", "anomaly_flag")
        d = self.engine.tbspc_daily.join(chosen, SERIES, "left_semi").join(flags, [*SERIES, "day_dt"], "left")
        return d.select(*SERIES, "day_dt", (F.col("used_bytes") / GB).alias("used_gb"), (F.col("limit_bytes") / GB).alias("limit_gb"), "anomaly_flag").orderBy(*SERIES, "day_dt")

    def chart_esm(self) -> DataFrame:
        chosen = self.chart_series().select(*SERIES).withColumnRenamed("tablespace_name", "series_key")
        esm = self.engine.compare.where("engine = 'ESM' AND series_kind = 'TBSPC'")
        return esm.join(F.broadcast(chosen), ["dbid", "con_dbid", "series_key"], "left_semi")

    def chart_projection(self) -> DataFrame:
        """The end of each reliable series' projection line: the last actual value and the slope over 180 days."""
        rows = self.chart_series().where("quality = 'OK'")
        end = F.col("cur_used") + F.col("slope_bpd") * 180
        return rows.select(*SERIES, F.date_add("last_day", 180).alias("end_day"), (end / GB).alias("end_gb"))

    def total_projection(self) -> DataFrame:
        """The end of each whole database's projection line, if its fit is reliable: the current size and 180 days' growth."""
        end = F.col("cur_used") + F.col("slope") * 180
        return self.total_fit().where("quality = 'OK'").select(*CONTAINER, F.date_add("last_day", 180).alias("end_day"), (end / GB).alias("end_gb"))

    def cpu_projection(self) -> DataFrame:
        """The end of each reliable CPU metric's projection line: the current value and 90 days' change."""
        rows = self.engine.cpu_trend.where("quality = 'OK'")
        return rows.select(*CONTAINER, "metric", F.date_add("last_day", 90).alias("end_day"), (F.col("cur_val") + F.col("slope_per_day") * 90).alias("end_val"))

    def containers(self) -> DataFrame:
        return self.engine.cpu_daily.select(*CONTAINER).union(self.engine.dbtime_daily.select(*CONTAINER)).distinct()

    def has_cpu(self) -> bool:
        return not (self.engine.cpu_daily.isEmpty() and self.engine.dbtime_daily.isEmpty())

    def container_count(self) -> DataFrame:
        return self.engine.tbspc_daily.agg(F.countDistinct("con_dbid").alias("n_containers"))

    def cpu_heroes(self) -> DataFrame:
        """The busy trend of each container, with a headline by its grade and days to saturation."""
        days = F.col("days_to_sat")
        headline = (
            F.when(F.col("quality") == "INSUFFICIENT_HISTORY", "not enough history")
            .when(F.col("quality") == "FLAT", "steady")
            .when(F.col("quality") == "LOW_CONFIDENCE", "no clear trend")
            .when(days.isNull(), "not rising")
            .when(days == 0, "at saturation")
            .otherwise("rising")
        )
        return self.engine.cpu_trend.where("metric = 'BUSY_PCT'").select(*CONTAINER, "last_day", "cur_val", "slope_per_day", "r2", "days_to_sat", "quality", headline.alias("headline"))

    def cpu_history(self) -> DataFrame:
        """Both metrics of every container by day, with the flags of busy days."""
        flags = self.engine.cpu_anom.where("anomaly_flag IS NOT NULL").select(*CONTAINER, "day_dt", "anomaly_flag")
        d = self.engine.cpu_daily.join(self.engine.dbtime_daily.select(*CONTAINER, "day_dt", "db_cpu_sec"), [*CONTAINER, "day_dt"], "full")
        return d.join(flags, [*CONTAINER, "day_dt"], "left").select(*CONTAINER, "day_dt", "busy_pct", "db_cpu_sec", "anomaly_flag").orderBy(*CONTAINER, "day_dt")
