"""Queries over the tables' seam and the DuckDB SQL that each must equal.

The SQL is written with self-joins and aggregates joined back, where the operators use windows, so that the two
don't share a mistake. Both sides round doubles to the same digits; adding zero makes negative zeros plain.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config, ConfigStore
from tidemark.operators import daily
from tidemark.operators.smoothing import fit_all
from tidemark.plans import compare as comparing
from tidemark.plans.engine import Engine
from tidemark.plans.reports import Reports
from tidemark.sources.contracts import CONTRACTS
from tidemark.sources.seams import Seam, open_seam
from tidemark.sources.shared import shared_path
from tidemark.sources.tables import tables_seam

#: The levels of these tables grow by megabytes a day, far below the default floor.
CONFIG = Config(abs_floor_bytes=0)
SENSITIVE = CONFIG.replace(cpu_min_mad_pct=0.5)


@dataclass(frozen=True)
class Query:
    """A relation: how to build it, its columns with the digits to round to (None: exact), and its SQL."""

    build: Callable[[Engine], DataFrame]
    columns: dict[str, int | None]
    sql: str
    config: Config = CONFIG

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Engine(tables_seam(spark, sf_dir), self.config))
        return df.select(*(F.col(c) if d is None else (F.round(F.col(c).cast("double"), d) + F.lit(0.0)).alias(c) for c, d in self.columns.items()))

    def oracle(self) -> str:
        inner = self.sql.strip()
        if not re.match(r"(?is)select|with", inner):
            inner = f"SELECT * FROM {inner}"
        columns = ", ".join(c if d is None else f"CASE WHEN isnan(CAST({c} AS DOUBLE)) THEN NULL ELSE round(CAST({c} AS DOUBLE), {d}) + 0.0 END AS {c}" for c, d in self.columns.items())
        return f"WITH {needed(inner, self.config)} SELECT {columns} FROM ({_filled(inner, self.config)}) AS result"


def exact(*names: str) -> dict[str, None]:
    return dict.fromkeys(names)


def _filled(sql: str, config: Config) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: repr(getattr(config, m[1])), sql)


def needed(sql: str, config: Config) -> str:
    """The CTEs that a statement names, and those that they name, in order."""
    want: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in want and re.search(rf"\b{name}\b", text):
                want.add(name)
                visit(CTES[name])

    visit(sql)
    return ", ".join(f"{n} AS ({_filled(s, config)})" for n, s in CTES.items() if n in want)


def _fit(source: str, key: str, value: str, extra: str = "") -> str:
    """The series' last day joined back, then one aggregate over the training window."""
    on = " AND ".join(f"s.{k} = l.{k}" for k in key.split(", "))
    keys = ", ".join(f"s.{k}" for k in key.split(", "))
    return f"""
      SELECT {keys}, max(l.last_day) AS last_day, date_diff('day', DATE '2020-01-01', max(l.last_day)) AS last_day_n,
        regr_count(s.{value}, {DAY_N}) AS train_n, {_clean(f"regr_slope(CAST(s.{value} AS DOUBLE), {DAY_N})")} AS slope,
        {_clean(f"regr_intercept(CAST(s.{value} AS DOUBLE), {DAY_N})")} AS icept, {_clean(f"regr_r2(CAST(s.{value} AS DOUBLE), {DAY_N})")} AS r2{extra}
      FROM {source} s JOIN (SELECT {key}, max(day_dt) AS last_day FROM {source} GROUP BY {key}) l ON {on}
      WHERE s.day_dt > l.last_day - CAST({{train_days}} AS INTEGER) GROUP BY {keys}"""


DAY_N = "CAST(date_diff('day', DATE '2020-01-01', s.day_dt) AS DOUBLE)"
GRADE = """CASE WHEN {n} < {{min_train_days}} THEN 'INSUFFICIENT_HISTORY' WHEN slope = 0 OR r2 IS NULL THEN 'FLAT' WHEN r2 < {{r2_gate}} THEN 'LOW_CONFIDENCE' ELSE 'OK' END"""


def _clean(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


def _grade(n: str) -> str:
    return GRADE.format(n=n)


def _median(history: str, band: str, key: str, value: str, carried: str, source: str) -> tuple[str, str]:
    """Two passes over a self-join: the median of the band, then the median deviation from it."""
    on = " AND ".join(f"h.{k} = c.{k}" for k in key.split(", "))
    cols = ", ".join(f"c.{k}" for k in f"{key}, day_dt, {carried}".split(", "))
    med = f"SELECT {cols}, median(h.{value}) AS med, count(h.{value}) AS n_hist FROM {source} c JOIN {source} h ON {on} AND {band} GROUP BY {cols}"
    mad = f"""SELECT {cols}, c.med, c.n_hist, median(abs(h.{value} - c.med)) * 1.4826 AS mad_sigma
      FROM {history} c JOIN {source} h ON {on} AND {band} GROUP BY {cols}, c.med, c.n_hist"""
    return med, mad


_ISO = "CAST(l_shipdate AS DATE)"
_TB_MED = _median("anom_med", "h.day_dt BETWEEN c.day_dt - CAST({mad_window_days} AS INTEGER) AND c.day_dt - 1", "dbid, con_dbid, tablespace_name", "used_rate_bpd", "used_rate_bpd, used_delta_bytes, day_gap", "rates")
_WEEKS = "h.day_dt IN (SELECT c.day_dt - CAST(7 * lv AS INTEGER) FROM generate_series(1, {dow_weeks}) AS g(lv))"
_CPU_MED = _median("busy_med", "h.day_dt >= c.day_dt - CAST(7 * {dow_weeks} AS INTEGER) AND h.day_dt < c.day_dt AND date_diff('day', h.day_dt, c.day_dt) % 7 = 0", "dbid, con_dbid", "busy_pct", "busy_pct", "busy")

#: Named relations in DuckDB SQL, in order of need. {knob} stands for a value of the configuration.
CTES = {
    "per_day": f"SELECT {_ISO} AS day, l_linestatus AS st, l_returnflag AS rf, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY ALL",
    "day_total": "SELECT day, CAST(sum(q) AS BIGINT) AS q, date_diff('day', DATE '1995-01-01', day) AS snap_id FROM per_day GROUP BY day",
    "day_run": """SELECT a.day, a.q, a.snap_id, CAST(sum(b.q) AS BIGINT) AS run, (SELECT CAST(sum(q) AS BIGINT) FROM day_total) AS total,
      (SELECT count(*) FROM day_total x WHERE x.day >= a.day) AS back FROM day_total a JOIN day_total b ON b.day <= a.day GROUP BY ALL""",
    "level": """SELECT CASE st WHEN 'O' THEN 101 ELSE 102 END AS con, CASE rf WHEN 'A' THEN 10 WHEN 'N' THEN 11 ELSE 12 END AS ts, day, q
      FROM per_day WHERE st IN ('O', 'F') AND rf IN ('A', 'N', 'R')""",
    "level_run": "SELECT con, ts, day, CAST(sum(q) OVER (PARTITION BY con, ts ORDER BY day) AS BIGINT) AS used, CAST(sum(q) OVER (PARTITION BY con, ts) AS BIGINT) AS final FROM level",
    "hourly": "SELECT date_trunc('hour', ts) AS hour, CAST(sum(abs(CAST(round(value * 100) AS BIGINT))) AS BIGINT) AS q FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "hourly_run": "SELECT hour, CAST(1000000 + floor(epoch(hour) / 3600) AS BIGINT) AS snap_id, CAST(sum(q) OVER (ORDER BY hour) AS BIGINT) AS used FROM hourly",
    "amounts": """SELECT CAST(floor(epoch(ts) / 21600) AS BIGINT) AS snap_id, user_id % 2 + 1 AS instance_number, CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END AS era,
      sum(CASE WHEN event_type IN ('purchase', 'click') THEN u ELSE 0 END) AS busy, sum(CASE WHEN event_type NOT IN ('purchase', 'click') THEN u ELSE 0 END) AS idle,
      sum(CASE WHEN event_type = 'purchase' THEN u ELSE 0 END) AS db_cpu, sum(CASE WHEN event_type IN ('purchase', 'view') THEN u ELSE 0 END) AS db_time,
      sum(CASE WHEN event_type = 'error' THEN u ELSE 0 END) AS bg FROM (SELECT *, abs(CAST(round(value * 100) AS BIGINT)) AS u FROM events WHERE ts IS NOT NULL) GROUP BY 1, 2, 3""",
    "counters": """SELECT snap_id, instance_number, era, CAST(sum(busy) OVER w AS BIGINT) AS busy, CAST(sum(idle) OVER w AS BIGINT) AS idle, CAST(sum(db_cpu) OVER w AS BIGINT) AS db_cpu,
      CAST(sum(db_time) OVER w AS BIGINT) AS db_time, CAST(sum(bg) OVER w AS BIGINT) AS bg FROM amounts WINDOW w AS (PARTITION BY instance_number, era ORDER BY snap_id)""",
    "capv_snapshot": """SELECT CAST(1 AS BIGINT) AS dbid, CAST(1 AS BIGINT) AS con_dbid, CAST(1 AS BIGINT) AS instance_number, CAST(snap_id AS BIGINT) AS snap_id, day + INTERVAL 22 HOUR AS begin_interval_time,
        day + INTERVAL 23 HOUR AS end_interval_time, TIMESTAMP '1995-01-01 00:00:00' AS startup_time FROM day_total
      UNION ALL SELECT 2, 2, 1, snap_id, hour, hour + INTERVAL 1 HOUR, TIMESTAMP '1995-01-01 00:00:00' FROM hourly_run
      UNION ALL SELECT 2, 2, instance_number, snap_id, make_timestamp(snap_id * 21600 * 1000000), make_timestamp(snap_id * 21600 * 1000000) + INTERVAL 359 MINUTE,
        CASE era WHEN 1 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2023-12-01 00:00:00' END FROM counters""",
    "capv_tbspc_usage": """SELECT CAST(1 AS BIGINT) AS dbid, CAST(con AS BIGINT) AS con_dbid, CAST(date_diff('day', DATE '1995-01-01', day) AS BIGINT) AS snap_id, CAST(ts AS BIGINT) AS tablespace_id,
        used AS tablespace_size, CASE WHEN ts = 12 THEN 0 ELSE 2 * final END AS tablespace_maxsize, used AS tablespace_usedsize FROM level_run
      UNION ALL SELECT 1, 101, snap_id, 20, 5000, 0, 5000 FROM day_run
      UNION ALL SELECT 1, 101, snap_id, 21, 1000 + run, 0, 1000 + run FROM day_run WHERE back <= 10
      UNION ALL SELECT 1, 101, snap_id, 22, q, 0, q FROM day_run
      UNION ALL SELECT 1, 101, snap_id, 23, total - run, 0, total - run FROM day_run
      UNION ALL SELECT 1, 101, snap_id, 30, run, 0, run FROM day_run
      UNION ALL SELECT 1, 101, snap_id, 31, run, 0, run FROM day_run
      UNION ALL SELECT 2, 101, snap_id, 40, used, 0, used FROM hourly_run""",
    "capv_tablespace": """SELECT CAST(d AS BIGINT) AS dbid, CAST(c AS BIGINT) AS con_dbid, CAST(i AS BIGINT) AS tablespace_id, n AS tablespace_name, k AS contents, CAST(b AS BIGINT) AS block_size FROM (VALUES
      (1, 101, 10, 'LINES_A', 'PERMANENT', 8192), (1, 101, 11, 'LINES_N', 'PERMANENT', 8192), (1, 101, 12, 'LINES_R', 'PERMANENT', NULL),
      (1, 102, 10, 'LINES_A', 'PERMANENT', 8192), (1, 102, 11, 'LINES_N', 'PERMANENT', 8192), (1, 102, 12, 'LINES_R', 'PERMANENT', NULL),
      (1, 101, 20, 'FLAT', 'PERMANENT', 8192), (1, 101, 21, 'SHORT', 'PERMANENT', 8192), (1, 101, 22, 'NOISY', 'PERMANENT', 8192), (1, 101, 23, 'SHRINK', 'PERMANENT', 8192),
      (1, 101, 30, 'UNDO', 'UNDO', 8192), (1, 101, 31, 'TEMP', 'TEMPORARY', 8192), (2, 101, 40, 'HOURLY', 'PERMANENT', 8192)) AS t(d, c, i, n, k, b)""",
    "capv_datafile": "SELECT dbid, con_dbid, tablespace_id, CAST(8192 AS BIGINT) AS block_size FROM capv_tablespace",
    "capv_osstat": """SELECT CAST(2 AS BIGINT) AS dbid, CAST(101 AS BIGINT) AS con_dbid, CAST(instance_number AS BIGINT) AS instance_number, snap_id, 'BUSY_TIME' AS stat_name, busy AS value FROM counters
      UNION ALL SELECT 2, 101, instance_number, snap_id, 'IDLE_TIME', idle FROM counters UNION ALL SELECT 2, 101, instance_number, snap_id, 'NUM_CPUS', 4 FROM counters
      UNION ALL SELECT 2, 101, instance_number, snap_id, 'NUM_CPU_CORES', 2 FROM counters WHERE instance_number = 1""",
    "capv_time_model": """SELECT CAST(2 AS BIGINT) AS dbid, CAST(101 AS BIGINT) AS con_dbid, CAST(instance_number AS BIGINT) AS instance_number, snap_id, 'DB CPU' AS stat_name, db_cpu AS value FROM counters
      UNION ALL SELECT 2, 101, instance_number, snap_id, 'DB time', db_time FROM counters UNION ALL SELECT 2, 101, instance_number, snap_id, 'background cpu time', bg FROM counters""",
    "snap_time": "SELECT dbid, snap_id, min(end_interval_time) AS ended_at FROM capv_snapshot GROUP BY dbid, snap_id",
    "file_blocks": "SELECT dbid, con_dbid, tablespace_id, max(block_size) AS file_block_size FROM capv_datafile GROUP BY ALL",
    "sized_usage": "SELECT u.*, s.ended_at, CAST(s.ended_at AS DATE) AS day_dt FROM capv_tbspc_usage u JOIN snap_time s ON s.dbid = u.dbid AND s.snap_id = u.snap_id",
    "day_end": """SELECT u.dbid, u.con_dbid, u.tablespace_id, u.day_dt, max(CASE WHEN u.ended_at = m.ended_at THEN u.tablespace_usedsize END) AS used_blocks,
        max(CASE WHEN u.ended_at = m.ended_at THEN u.tablespace_size END) AS size_blocks, max(CASE WHEN u.ended_at = m.ended_at THEN u.tablespace_maxsize END) AS max_blocks, count(*) AS n_samples
      FROM sized_usage u JOIN (SELECT dbid, con_dbid, tablespace_id, day_dt, max(ended_at) AS ended_at FROM sized_usage GROUP BY ALL) m
        ON m.dbid = u.dbid AND m.con_dbid = u.con_dbid AND m.tablespace_id = u.tablespace_id AND m.day_dt = u.day_dt GROUP BY 1, 2, 3, 4""",
    "tbspc_daily": """SELECT l.dbid, l.con_dbid, l.tablespace_id, t.tablespace_name, l.day_dt, l.used_blocks * coalesce(t.block_size, b.file_block_size) AS used_bytes,
        l.size_blocks * coalesce(t.block_size, b.file_block_size) AS size_bytes,
        CASE WHEN l.max_blocks > 0 THEN l.max_blocks ELSE l.size_blocks END * coalesce(t.block_size, b.file_block_size) AS limit_bytes, l.n_samples
      FROM day_end l JOIN capv_tablespace t ON t.dbid = l.dbid AND t.con_dbid = l.con_dbid AND t.tablespace_id = l.tablespace_id
        LEFT JOIN file_blocks b ON b.dbid = l.dbid AND b.con_dbid = l.con_dbid AND b.tablespace_id = l.tablespace_id
      WHERE t.contents NOT IN ('UNDO', 'TEMPORARY') AND coalesce(t.block_size, b.file_block_size) IS NOT NULL""",
    "before": """SELECT c.dbid, c.con_dbid, c.tablespace_name, c.tablespace_id, c.day_dt, max(p.day_dt) AS prev FROM tbspc_daily c
      LEFT JOIN tbspc_daily p ON p.dbid = c.dbid AND p.con_dbid = c.con_dbid AND p.tablespace_name = c.tablespace_name AND p.day_dt < c.day_dt GROUP BY ALL""",
    "tbspc_delta": """SELECT c.dbid, c.con_dbid, c.tablespace_name, c.day_dt, c.used_bytes, c.used_bytes - p.used_bytes AS used_delta_bytes, CAST(date_diff('day', p.day_dt, c.day_dt) AS INTEGER) AS day_gap,
        CASE WHEN p.day_dt IS NOT NULL THEN CAST(c.used_bytes - p.used_bytes AS DOUBLE) / date_diff('day', p.day_dt, c.day_dt) END AS used_rate_bpd
      FROM tbspc_daily c JOIN before b ON b.dbid = c.dbid AND b.con_dbid = c.con_dbid AND b.tablespace_name = c.tablespace_name AND b.day_dt = c.day_dt
        LEFT JOIN tbspc_daily p ON p.dbid = c.dbid AND p.con_dbid = c.con_dbid AND p.tablespace_name = c.tablespace_name AND p.day_dt = b.prev""",
    "os_pivot": """SELECT dbid, con_dbid, instance_number, snap_id, max(CASE WHEN stat_name = 'BUSY_TIME' THEN value END) AS busy, max(CASE WHEN stat_name = 'IDLE_TIME' THEN value END) AS idle,
      max(CASE WHEN stat_name = 'NUM_CPUS' THEN value END) AS cpus, max(CASE WHEN stat_name = 'NUM_CPU_CORES' THEN value END) AS cores FROM capv_osstat GROUP BY 1, 2, 3, 4""",
    "tm_pivot": """SELECT dbid, con_dbid, instance_number, snap_id, max(CASE WHEN stat_name = 'DB CPU' THEN value END) AS db_cpu, max(CASE WHEN stat_name = 'DB time' THEN value END) AS db_time,
      max(CASE WHEN stat_name = 'background cpu time' THEN value END) AS bg_cpu FROM capv_time_model GROUP BY 1, 2, 3, 4""",
    "os_delta": """SELECT p.*, s.end_interval_time, s.startup_time, busy - lag(busy) OVER w AS busy_d, idle - lag(idle) OVER w AS idle_d, lag(s.startup_time) OVER w AS startup_before
      FROM os_pivot p JOIN capv_snapshot s ON s.dbid = p.dbid AND s.snap_id = p.snap_id AND s.instance_number = p.instance_number
      WINDOW w AS (PARTITION BY p.dbid, p.con_dbid, p.instance_number ORDER BY p.snap_id)""",
    "tm_delta": """SELECT p.*, s.end_interval_time, s.startup_time, db_cpu - lag(db_cpu) OVER w AS db_cpu_d, db_time - lag(db_time) OVER w AS db_time_d, bg_cpu - lag(bg_cpu) OVER w AS bg_cpu_d,
        lag(s.startup_time) OVER w AS startup_before FROM tm_pivot p JOIN capv_snapshot s ON s.dbid = p.dbid AND s.snap_id = p.snap_id AND s.instance_number = p.instance_number
      WINDOW w AS (PARTITION BY p.dbid, p.con_dbid, p.instance_number ORDER BY p.snap_id)""",
    "os_kept": "SELECT *, CAST(end_interval_time AS DATE) AS day_dt FROM os_delta WHERE busy_d >= 0 AND idle_d >= 0 AND startup_time = startup_before",
    "tm_kept": "SELECT *, CAST(end_interval_time AS DATE) AS day_dt FROM tm_delta WHERE db_cpu_d >= 0 AND db_time_d >= 0 AND coalesce(bg_cpu_d, 0) >= 0 AND startup_time = startup_before",
    "cpu_daily": """SELECT dbid, con_dbid, day_dt, CAST(100 * sum(busy_d) AS DOUBLE) / nullif(CAST(sum(busy_d) + sum(idle_d) AS DOUBLE), 0) AS busy_pct, round(avg(cpus)) AS num_cpus,
      round(avg(cores)) AS num_cpu_cores, count(*) AS n_intervals FROM os_kept GROUP BY 1, 2, 3""",
    "core_count": """SELECT dbid, CAST(sum(cores) AS BIGINT) AS total_cores FROM (SELECT dbid, instance_number, coalesce(max(CASE WHEN stat_name = 'NUM_CPU_CORES' THEN value END),
      max(CASE WHEN stat_name = 'NUM_CPUS' THEN value END)) AS cores FROM capv_osstat GROUP BY 1, 2) GROUP BY dbid""",
    "dbtime_daily": """SELECT t.dbid, t.con_dbid, t.day_dt, sum(db_cpu_d) / 1e6 AS db_cpu_sec, sum(db_time_d) / 1e6 AS db_time_sec, sum(bg_cpu_d) / 1e6 AS bg_cpu_sec,
      CASE WHEN max(c.total_cores) > 0 THEN sum(db_cpu_d) / 1e6 / max(c.total_cores) END AS db_cpu_per_core, count(*) AS n_intervals
      FROM tm_kept t LEFT JOIN core_count c ON c.dbid = t.dbid GROUP BY 1, 2, 3""",
    "space_fit": _fit(
        "tbspc_daily", "dbid, con_dbid, tablespace_name", "used_bytes",
        f", {_clean(f'regr_slope(CASE WHEN s.day_dt > l.last_day - CAST({{recent_days}} AS INTEGER) THEN CAST(s.used_bytes AS DOUBLE) END, {DAY_N})')} AS recent_slope,"
        " max(CASE WHEN s.day_dt = l.last_day THEN s.used_bytes END) AS cur_used, max(CASE WHEN s.day_dt = l.last_day THEN s.limit_bytes END) AS limit_bytes",
    ),
    "tbspc_forecast": f"""SELECT dbid, con_dbid, tablespace_name, last_day, train_n, cur_used, limit_bytes, slope AS slope_bpd, icept, r2, icept + slope * (last_day_n + 30) AS proj_30_bytes,
      icept + slope * (last_day_n + 90) AS proj_90_bytes, icept + slope * (last_day_n + 180) AS proj_180_bytes, icept + slope * (last_day_n + 365) AS proj_365_bytes,
      CASE WHEN slope > 0 THEN CAST(floor((limit_bytes - cur_used) / slope) AS BIGINT) END AS days_to_full, recent_slope AS recent_slope_bpd,
      CASE WHEN slope <> 0 THEN recent_slope / slope END AS accel_ratio, {_grade("train_n")} AS quality FROM space_fit""",
    "metric_rows": """SELECT dbid, con_dbid, 'BUSY_PCT' AS metric, day_dt, busy_pct AS val FROM cpu_daily WHERE busy_pct IS NOT NULL
      UNION ALL SELECT dbid, con_dbid, 'DB_CPU_SEC', day_dt, db_cpu_sec FROM dbtime_daily WHERE db_cpu_sec IS NOT NULL""",
    "metric_fit": _fit("metric_rows", "dbid, con_dbid, metric", "val", ", max(CASE WHEN s.day_dt = l.last_day THEN s.val END) AS cur_val"),
    "cpu_trend": f"""SELECT dbid, con_dbid, metric, last_day, train_n, cur_val, slope AS slope_per_day, r2, icept + slope * (last_day_n + 30) AS proj_30, icept + slope * (last_day_n + 90) AS proj_90,
      CASE WHEN metric = 'BUSY_PCT' AND slope > 0 THEN greatest(0, CAST(floor(({{cpu_sat_pct}} - cur_val) / slope) AS BIGINT)) END AS days_to_sat, {_grade("train_n")} AS quality FROM metric_fit""",
    "rates": "SELECT * FROM tbspc_delta WHERE used_rate_bpd IS NOT NULL",
    "anom_med": _TB_MED[0],
    "anom_mad": _TB_MED[1],
    "tbspc_anom": """SELECT dbid, con_dbid, tablespace_name, day_dt, used_delta_bytes, day_gap, used_rate_bpd, med AS median_rate_bpd, mad_sigma, n_hist, used_rate_bpd - med AS dev_bpd,
      greatest({mad_k} * mad_sigma, {abs_floor_bytes}) AS threshold_bpd, (used_rate_bpd - med) / nullif(mad_sigma, 0) AS robust_z,
      CASE WHEN n_hist >= {tbspc_min_hist} AND used_rate_bpd - med > greatest({mad_k} * mad_sigma, {abs_floor_bytes}) THEN 'HIGH'
        WHEN n_hist >= {tbspc_min_hist} AND med - used_rate_bpd > greatest({mad_k} * mad_sigma, {abs_floor_bytes}) THEN 'LOW' END AS anomaly_flag FROM anom_mad""",
    "busy": "SELECT * FROM cpu_daily WHERE busy_pct IS NOT NULL",
    "busy_med": _CPU_MED[0],
    "busy_mad": _CPU_MED[1],
    "cpu_anom": """SELECT dbid, con_dbid, day_dt, busy_pct, med AS median_pct, mad_sigma, n_hist, busy_pct - med AS dev_pct, {mad_k} * greatest(mad_sigma, {cpu_min_mad_pct}) AS threshold_pct,
      (busy_pct - med) / nullif(greatest(mad_sigma, {cpu_min_mad_pct}), 0) AS robust_z,
      CASE WHEN n_hist >= {cpu_min_dow_hist} AND busy_pct - med > {mad_k} * greatest(mad_sigma, {cpu_min_mad_pct}) THEN 'HIGH'
        WHEN n_hist >= {cpu_min_dow_hist} AND med - busy_pct > {mad_k} * greatest(mad_sigma, {cpu_min_mad_pct}) THEN 'LOW' END AS anomaly_flag FROM busy_mad""",
    "compare": """SELECT dbid, con_dbid, 'TBSPC' AS series_kind, tablespace_name AS series_key, 30 AS horizon_days, 'REGR' AS engine, proj_30_bytes AS value FROM tbspc_forecast WHERE quality <> 'INSUFFICIENT_HISTORY'
      UNION ALL SELECT dbid, con_dbid, 'TBSPC', tablespace_name, 90, 'REGR', proj_90_bytes FROM tbspc_forecast WHERE quality <> 'INSUFFICIENT_HISTORY'
      UNION ALL SELECT dbid, con_dbid, 'TBSPC', tablespace_name, 180, 'REGR', proj_180_bytes FROM tbspc_forecast WHERE quality <> 'INSUFFICIENT_HISTORY'
      UNION ALL SELECT dbid, con_dbid, 'TBSPC', tablespace_name, 365, 'REGR', proj_365_bytes FROM tbspc_forecast WHERE quality <> 'INSUFFICIENT_HISTORY'
      UNION ALL SELECT dbid, con_dbid, 'CPU', metric, 30, 'REGR', proj_30 FROM cpu_trend WHERE quality <> 'INSUFFICIENT_HISTORY'
      UNION ALL SELECT dbid, con_dbid, 'CPU', metric, 90, 'REGR', proj_90 FROM cpu_trend WHERE quality <> 'INSUFFICIENT_HISTORY'""",
    "recent_tbspc": "SELECT * FROM tbspc_anom WHERE anomaly_flag IS NOT NULL AND day_dt > (SELECT max(day_dt) FROM tbspc_daily) - CAST({anomaly_days} AS INTEGER)",
    "recent_cpu": "SELECT * FROM cpu_anom WHERE anomaly_flag IS NOT NULL AND day_dt > (SELECT max(day_dt) FROM cpu_daily) - CAST({anomaly_days} AS INTEGER)",
    "grid": """SELECT d.dbid, d.con_dbid, d.day_dt, t.tablespace_name FROM (SELECT DISTINCT dbid, con_dbid, day_dt FROM tbspc_daily) d
      JOIN (SELECT DISTINCT dbid, con_dbid, tablespace_name FROM tbspc_daily) t ON t.dbid = d.dbid AND t.con_dbid = d.con_dbid""",
    "filled": """SELECT g.dbid, g.con_dbid, g.day_dt, last_value(f.used_bytes IGNORE NULLS) OVER (PARTITION BY g.dbid, g.con_dbid, g.tablespace_name ORDER BY g.day_dt
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried_bytes
      FROM grid g LEFT JOIN tbspc_daily f ON f.dbid = g.dbid AND f.con_dbid = g.con_dbid AND f.tablespace_name = g.tablespace_name AND f.day_dt = g.day_dt""",
    "total_filled": "SELECT dbid, con_dbid, day_dt, CAST(sum(carried_bytes) AS BIGINT) AS all_bytes FROM filled GROUP BY ALL",
    "whole_fit": _fit("total_filled", "dbid, con_dbid", "all_bytes"),
    "day_totals": "SELECT dbid, con_dbid, day_dt, CAST(sum(used_bytes) AS BIGINT) AS all_bytes, CAST(sum(limit_bytes) AS BIGINT) AS limit_total, CASE WHEN count(*) = count(limit_bytes) THEN 1 ELSE 0 END AS all_known FROM tbspc_daily GROUP BY 1, 2, 3",
    "current_totals": """SELECT t.dbid, t.con_dbid, t.all_bytes AS cur_used, t.limit_total AS cur_limit, t.all_known AS limit_all FROM day_totals t
      JOIN (SELECT dbid, con_dbid, max(day_dt) AS day_dt FROM day_totals GROUP BY ALL) m ON m.dbid = t.dbid AND m.con_dbid = t.con_dbid AND m.day_dt = t.day_dt""",
    "total_graded": f"SELECT w.*, c.cur_used, c.cur_limit, c.limit_all, icept + slope * (last_day_n + 180) AS proj_180, {_grade('train_n')} AS quality FROM whole_fit w JOIN current_totals c ON c.dbid = w.dbid AND c.con_dbid = w.con_dbid",
    "total_fit": """SELECT dbid, con_dbid, last_day, slope, r2, train_n AS n, cur_used, cur_limit, limit_all, proj_180, quality,
      CASE WHEN quality = 'OK' AND slope > 0 AND limit_all = 1 AND cur_limit > cur_used THEN CAST(floor((cur_limit - cur_used) / slope) AS BIGINT) END AS days_to_limit FROM total_graded""",
    "alerts": """SELECT 'TBSPC' AS kind, dbid, con_dbid, tablespace_name AS label, days_to_full AS days, CASE WHEN days_to_full <= {dtf_crit} THEN 2 ELSE 1 END AS severity
        FROM tbspc_forecast WHERE quality = 'OK' AND days_to_full <= {dtf_warn}
      UNION ALL SELECT 'DATABASE', dbid, con_dbid, 'The whole database', days_to_limit, CASE WHEN days_to_limit <= {dtf_crit} THEN 2 ELSE 1 END FROM total_fit WHERE days_to_limit <= {dtf_warn}
      UNION ALL SELECT 'CPU', dbid, con_dbid, 'Host CPU', days_to_sat, CASE WHEN days_to_sat <= {dtf_crit} THEN 2 ELSE 1 END FROM cpu_trend WHERE metric = 'BUSY_PCT' AND quality = 'OK' AND days_to_sat <= {dtf_warn}""",
    "bounds": "SELECT max(day_dt) - CAST({anomaly_days} AS INTEGER) AS min_day, max(day_dt) AS max_day FROM (SELECT day_dt FROM tbspc_daily UNION ALL SELECT day_dt FROM cpu_daily)",
    "points": """SELECT 'TBSPC' AS kind, dbid, con_dbid, tablespace_name AS label, day_dt, anomaly_flag, used_delta_bytes, used_rate_bpd, median_rate_bpd, CAST(NULL AS DOUBLE) AS busy_pct,
        CAST(NULL AS DOUBLE) AS median_pct FROM tbspc_anom, bounds WHERE anomaly_flag IS NOT NULL AND day_dt > min_day AND day_dt <= max_day
      UNION ALL SELECT 'CPU', dbid, con_dbid, 'Host CPU', day_dt, anomaly_flag, NULL, NULL, NULL, busy_pct, median_pct FROM cpu_anom, bounds
        WHERE anomaly_flag IS NOT NULL AND day_dt > min_day AND day_dt <= max_day""",
    "lanes": "SELECT kind, dbid, con_dbid, label, count(*) AS n FROM points GROUP BY ALL",
    "charted": "SELECT * FROM tbspc_forecast ORDER BY days_to_full ASC NULLS LAST, tablespace_name, dbid, con_dbid LIMIT {top_n}",
}



#: Rates of level, trend and season that the checked smoothing queries go by, instead of fitted ones.
RATES = (0.5, 0.2, 0.3)


def _smoothing(prefix: str, rows: str, season: int) -> dict[str, str]:
    """Smoothing at RATES by a recursion over days: missing days are interpolated, the first points start level and trend (with
    a season the first two of it do), and bounds widen with the one-step errors' variance."""
    a, b, g = RATES
    p, least = prefix, 2 * season if season else 2
    # The place of a day in the season, and the season after that day.
    at = f"1 + CAST(y.t % {season or 1} AS INTEGER)"
    old = f"r.s[{at}]" if season else "0.0"
    new_s = f"list_concat(list_concat(r.s[1:{at} - 1], [{g} * (y.y - r.level - r.trend) + {1 - g} * {old}]), r.s[{at} + 1:{season}])" if season else "r.s"
    if season:
        first = f"""SELECT k, CAST(-1 AS BIGINT) AS t, CAST(0 AS DOUBLE) AS pred, m1 - trend * {(season + 1) / 2} AS level, trend, list_transform(ys, lambda v, i: v - (m1 - trend * {(season + 1) / 2} + trend * i)) AS s
          FROM (SELECT k, avg(y) FILTER (t < {season}) AS m1, (avg(y) FILTER (t >= {season}) - avg(y) FILTER (t < {season})) / {season}.0 AS trend, list(y ORDER BY t) FILTER (t < {season}) AS ys
            FROM {p}_y WHERE t < {2 * season} AND n >= {least} GROUP BY k)"""
    else:
        first = f"SELECT z.k, CAST(0 AS BIGINT) AS t, z.y AS pred, z.y AS level, o.y - z.y AS trend, [0.0] AS s FROM {p}_y z JOIN {p}_y o ON o.k = z.k AND o.t = 1 WHERE z.t = 0"
    level = f"{a} * (y.y - {old}) + {1 - a} * (r.level + r.trend)"
    season_term = f" + s[1 + CAST((n + h - 1) % {season} AS INTEGER)]" if season else ""
    c = f"{a} + {a * b} * j" + (f" + CASE WHEN j % {season} = 0 THEN {g * (1 - a)} ELSE 0 END" if season else "")
    return {
        f"{p}_days": f"""SELECT k, kind, min(day_dt) AS first_day, max(day_dt) AS last_day, count(*) AS known, date_diff('day', min(day_dt), max(day_dt)) + 1 AS n FROM {rows} GROUP BY k, kind""",
        f"{p}_grid": f"""SELECT d.k, d.n, i AS t, v.val, last_value(v.val IGNORE NULLS) OVER w AS before, last_value(CASE WHEN v.val IS NOT NULL THEN i END IGNORE NULLS) OVER w AS before_t,
            first_value(v.val IGNORE NULLS) OVER f AS after, first_value(CASE WHEN v.val IS NOT NULL THEN i END IGNORE NULLS) OVER f AS after_t
          FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM {p}_days) d LEFT JOIN {rows} v ON v.k = d.k AND v.day_dt = d.first_day + CAST(i AS INTEGER)
          WINDOW w AS (PARTITION BY d.k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY d.k ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
        f"{p}_y": f"SELECT k, n, t, val, CASE WHEN val IS NOT NULL THEN val ELSE before + (after - before) * (t - before_t) / (after_t - before_t) END AS y FROM {p}_grid",
        f"{p}_run": f"""WITH RECURSIVE r AS ({first} UNION ALL SELECT r.k, y.t, r.level + r.trend + {old}, {level}, {b} * (({level}) - r.level) + {1 - b} * r.trend, {new_s}
          FROM r JOIN {p}_y y ON y.k = r.k AND y.t = r.t + 1) SELECT * FROM r""",
        f"{p}_errors": f"""SELECT r.k, CASE WHEN coalesce(avg(pow(y.y - r.pred, 2)) FILTER (y.t >= {0 if season else 2}), 0) < pow(1e-12 * greatest(1, max(abs(y.y))), 2) THEN 0
          ELSE coalesce(avg(pow(y.y - r.pred, 2)) FILTER (y.t >= {0 if season else 2}), 0) END AS variance FROM {p}_run r JOIN {p}_y y ON y.k = r.k AND y.t = r.t GROUP BY r.k""",
        f"{p}_ahead": f"""SELECT e.k, h, e.level + e.trend * h{season_term} AS pred, 1.959963984540054 * sqrt(variance * (1 + coalesce((SELECT sum(pow({c}, 2)) FROM generate_series(1, 29) AS x(j) WHERE j < h), 0))) AS spread
          FROM (SELECT r.*, d.n, v.variance, unnest(generate_series(1, greatest(1, least({{esm_prediction_step}}, 30, d.known // 4)))) AS h
            FROM {p}_run r JOIN {p}_days d ON d.k = r.k AND r.t = d.n - 1 JOIN {p}_errors v ON v.k = r.k) e""",
        f"smoothed_{p}": f"""SELECT d.kind || '_' || substr(upper(md5(d.k)), 1, 16) AS model_name, '{'EXSM_ADDWINTERS' if season else 'EXSM_HOLT'}' AS exsm_model, x.day_dt, x.actual, x.prediction, x.lower_bound, x.upper_bound
          FROM {p}_days d JOIN (
            SELECT r.k, d.first_day + CAST(r.t AS INTEGER) AS day_dt, y.val AS actual, r.pred AS prediction, CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound
            FROM {p}_run r JOIN {p}_y y ON y.k = r.k AND y.t = r.t JOIN {p}_days d ON d.k = r.k WHERE y.val IS NOT NULL
            UNION ALL SELECT a.k, d.last_day + CAST(h AS INTEGER), NULL, pred, pred - spread, pred + spread FROM {p}_ahead a JOIN {p}_days d ON d.k = a.k) x ON x.k = d.k""",
    }


_ID = "dbid || '|' || con_dbid || '|' ||"
CTES |= {
    "space_rows": f"SELECT 'CAPT' AS kind, {_ID} tablespace_name AS k, day_dt, CAST(max(used_bytes) AS DOUBLE) AS val FROM tbspc_daily GROUP BY ALL",
    "metric_days": f"""SELECT 'CAPC' AS kind, {_ID} 'BUSY_PCT' AS k, day_dt, busy_pct AS val FROM cpu_daily WHERE busy_pct IS NOT NULL
      UNION ALL SELECT 'CAPD', {_ID} 'DB_CPU_SEC', day_dt, db_cpu_sec FROM dbtime_daily WHERE db_cpu_sec IS NOT NULL""",
    **_smoothing("spaces", "space_rows", 0),
    **_smoothing("metrics", "metric_days", 7),
    "esm_candidates": """SELECT * FROM tbspc_forecast WHERE train_n >= {min_train_days} ORDER BY days_to_full ASC NULLS LAST, cur_used DESC NULLS LAST, dbid, con_dbid, tablespace_name LIMIT 20""",
    "esm_points": f"""SELECT c.dbid, c.con_dbid, 'TBSPC' AS series_kind, c.tablespace_name AS series_key, 30 AS horizon_days, 'ESM' AS engine, s.prediction AS value, s.lower_bound, s.upper_bound
        FROM esm_candidates c JOIN smoothed_spaces s ON s.model_name = 'CAPT_' || substr(upper(md5(c.dbid || '|' || c.con_dbid || '|' || c.tablespace_name)), 1, 16)
        WHERE s.actual IS NULL AND s.day_dt = c.last_day + 30
      UNION ALL SELECT c.dbid, c.con_dbid, 'CPU', c.metric, 30, 'ESM', s.prediction, s.lower_bound, s.upper_bound
        FROM cpu_trend c JOIN smoothed_metrics s ON s.model_name = CASE c.metric WHEN 'BUSY_PCT' THEN 'CAPC_' ELSE 'CAPD_' END || substr(upper(md5(c.dbid || '|' || c.con_dbid || '|' || c.metric)), 1, 16)
        WHERE s.actual IS NULL AND s.day_dt = c.last_day + 30""",
}

_T = exact("dbid", "con_dbid", "tablespace_name")
_C = exact("dbid", "con_dbid")
_FORECAST = _T | exact("last_day", "train_n", "cur_used", "limit_bytes") | {"slope_bpd": 1, "icept": -1, "r2": 8} | {f"proj_{h}_bytes": -1 for h in (30, 90, 180, 365)} | exact("days_to_full") | {"recent_slope_bpd": 1, "accel_ratio": 6} | exact("quality")
_TREND = _C | exact("metric", "last_day", "train_n") | {"cur_val": 6, "slope_per_day": 8, "r2": 8, "proj_30": 4, "proj_90": 4} | exact("days_to_sat", "quality")
_ANOM = _T | exact("day_dt", "used_delta_bytes", "day_gap") | {c: 3 for c in ("used_rate_bpd", "median_rate_bpd", "mad_sigma", "dev_bpd", "threshold_bpd")} | {"n_hist": None, "robust_z": 5} | exact("anomaly_flag")
_CPU = _C | exact("day_dt") | {c: 6 for c in ("busy_pct", "median_pct", "mad_sigma", "dev_pct", "threshold_pct", "robust_z")} | exact("n_hist", "anomaly_flag")


def _reports(name: str, *args) -> Callable[[Engine], DataFrame]:
    return lambda e: getattr(Reports(e), name)(*args)


def smoothed(e: Engine) -> DataFrame:
    """Trend smoothing of every tablespace at fixed rates: one-step predictions, then the future with bounds."""
    rows = e.tbspc_daily.groupBy("dbid", "con_dbid", "tablespace_name", "day_dt").agg(F.max("used_bytes").cast("double").alias("val"))
    rows = rows.select(F.lit("TBSPC").alias("series_kind"), "dbid", "con_dbid", F.col("tablespace_name").alias("series_key"), "day_dt", "val")
    return fit_all(rows, e.config.esm_prediction_step, RATES).where("status = 'OK'")


def smoothed_weekly(e: Engine) -> DataFrame:
    """Weekly smoothing of both CPU metrics at fixed rates."""
    busy = e.cpu_daily.select(F.lit("CPU").alias("series_kind"), "dbid", "con_dbid", F.lit("BUSY_PCT").alias("series_key"), "day_dt", F.col("busy_pct").alias("val"))
    seconds = e.dbtime_daily.select(F.lit("DBCPU").alias("series_kind"), "dbid", "con_dbid", F.lit("DB_CPU_SEC").alias("series_key"), "day_dt", F.col("db_cpu_sec").alias("val"))
    return fit_all(busy.unionByName(seconds).where("val IS NOT NULL"), e.config.esm_prediction_step, RATES).where("status = 'OK'")


def at_rates(e: Engine) -> Engine:
    """The same engine with models of all candidates at RATES, trained in the shared folder."""
    made = Engine(e.seam, e.config, models_path=shared_path(e.spark, "models"), cache=True)
    made.models.rates = RATES
    made.train_all(20)
    made.close()
    return made


def _reports_at_rates(name: str, *args) -> Callable[[Engine], DataFrame]:
    return lambda e: getattr(Reports(at_rates(e)), name)(*args)


def repository(e: Engine, mode: str) -> Seam:
    """The engine's contracts again, read by a repository seam from tables shaped as such a repository has them: other names,
    further columns, statistics that nobody asked for, and several files to a tablespace."""
    s, numbered = e.seam, lambda df: df.withColumnRenamed("tablespace_id", "ts#")
    files, other = numbered(s.datafile), lambda df: df.unionByName(df.withColumn("stat_name", F.concat(F.lit("OTHER "), "stat_name")))
    tables = {
        "snapshot": s.snapshot.drop("con_dbid").withColumn("snap_level", F.lit(1)),
        "tbspc_space_usage": s.tbspc_usage.withColumn("rtime", F.lit("-")),
        "tablespace": numbered(s.tablespace).withColumnRenamed("tablespace_name", "tsname"),
        "datafile": files.unionByName(files.withColumn("block_size", F.expr("block_size div 2"))),
        "osstat": other(s.osstat),
        "sys_time_model": other(s.time_model),
    }
    return open_seam(mode, lambda name: next(df for table, df in tables.items() if name.endswith("_" + table)))


def _repository(mode: str) -> dict[str, Query]:
    """A query for each contract of a repository seam."""
    sql = dict.fromkeys(CONTRACTS) | {"datafile": "SELECT dbid, con_dbid, tablespace_id, max(block_size) AS block_size FROM capv_datafile GROUP BY 1, 2, 3"}
    return {
        f"{mode}_{name}": Query(lambda e, name=name: getattr(repository(e, mode), name), exact(*CONTRACTS[name].names), sql[name] or f"capv_{name}")
        for name in CONTRACTS
    }


_BOUNDS = {"value": -1, "lower_bound": -1, "upper_bound": -1}

QUERIES: dict[str, Query] = {
    "seam_snapshot": Query(lambda e: e.seam.snapshot, exact("dbid", "con_dbid", "instance_number", "snap_id", "begin_interval_time", "end_interval_time", "startup_time"), "capv_snapshot"),
    "seam_usage": Query(lambda e: e.seam.tbspc_usage, exact("dbid", "con_dbid", "snap_id", "tablespace_id", "tablespace_size", "tablespace_maxsize", "tablespace_usedsize"), "capv_tbspc_usage"),
    "seam_tablespace": Query(lambda e: e.seam.tablespace, exact("dbid", "con_dbid", "tablespace_id", "tablespace_name", "contents", "block_size"), "capv_tablespace"),
    "seam_datafile": Query(lambda e: e.seam.datafile, exact("dbid", "con_dbid", "tablespace_id", "block_size"), "capv_datafile"),
    "seam_osstat": Query(lambda e: e.seam.osstat, exact("dbid", "con_dbid", "instance_number", "snap_id", "stat_name", "value"), "capv_osstat"),
    "seam_time_model": Query(lambda e: e.seam.time_model, exact("dbid", "con_dbid", "instance_number", "snap_id", "stat_name", "value"), "capv_time_model"),
    **_repository("local"),
    **_repository("warehouse"),
    "snap_time": Query(lambda e: daily.snap_time(e.seam.snapshot), exact("dbid", "snap_id", "ended_at"), "snap_time"),
    "block_size_fallback": Query(lambda e: daily.block_sizes(e.seam.datafile), exact("dbid", "con_dbid", "tablespace_id", "file_block_size"), "file_blocks"),
    "tbspc_daily": Query(lambda e: e.tbspc_daily, _T | exact("tablespace_id", "day_dt", "used_bytes", "size_bytes", "limit_bytes", "n_samples"), "tbspc_daily"),
    "tbspc_delta": Query(lambda e: e.tbspc_delta, _T | exact("day_dt", "used_bytes", "used_delta_bytes", "day_gap") | {"used_rate_bpd": 3}, "tbspc_delta"),
    "cpu_counter_deltas": Query(
        lambda e: daily.counter_deltas(e.seam, e.seam.osstat, {"busy": "BUSY_TIME", "idle": "IDLE_TIME"}, {"cpus": "NUM_CPUS", "cores": "NUM_CPU_CORES"}),
        exact("dbid", "con_dbid", "instance_number", "snap_id", "day_dt", "busy_d", "idle_d", "cpus", "cores"), "os_kept",
    ),
    "time_counter_deltas": Query(
        lambda e: daily.counter_deltas(e.seam, e.seam.time_model, {"db_cpu": "DB CPU", "db_time": "DB time", "bg_cpu": "background cpu time"}, {}, ("bg_cpu",)),
        exact("dbid", "con_dbid", "instance_number", "snap_id", "day_dt", "db_cpu_d", "db_time_d", "bg_cpu_d"), "tm_kept",
    ),
    "cpu_daily": Query(lambda e: e.cpu_daily, _C | exact("day_dt") | {"busy_pct": 8, "num_cpus": 0, "num_cpu_cores": 0} | exact("n_intervals"), "cpu_daily"),
    "core_count": Query(lambda e: daily.core_count(e.seam), exact("dbid", "total_cores"), "core_count"),
    "dbtime_daily": Query(lambda e: e.dbtime_daily, _C | exact("day_dt") | {c: 8 for c in ("db_cpu_sec", "db_time_sec", "bg_cpu_sec", "db_cpu_per_core")} | exact("n_intervals"), "dbtime_daily"),
    "tbspc_forecast": Query(lambda e: e.tbspc_forecast, _FORECAST, "tbspc_forecast"),
    "tbspc_forecast_strict": Query(lambda e: e.tbspc_forecast, _FORECAST, "tbspc_forecast", CONFIG.replace(train_days=30, recent_days=7, r2_gate=0.95)),
    "cpu_trend": Query(lambda e: e.cpu_trend, _TREND, "cpu_trend"),
    "tbspc_anom": Query(lambda e: e.tbspc_anom, _ANOM, "tbspc_anom"),
    "tbspc_anom_default_floor": Query(lambda e: e.tbspc_anom, _ANOM, "tbspc_anom", Config()),
    "tbspc_anom_strict": Query(lambda e: e.tbspc_anom, _ANOM, "tbspc_anom", CONFIG.replace(mad_k=2, mad_window_days=14)),
    "cpu_anom": Query(lambda e: e.cpu_anom, _CPU, "cpu_anom"),
    "cpu_anom_sensitive": Query(lambda e: e.cpu_anom, _CPU, "cpu_anom", SENSITIVE),
    "compare_regr": Query(lambda e: comparing.regr_points(e.tbspc_forecast, e.cpu_trend), _C | exact("series_kind", "series_key", "horizon_days", "engine") | {"value": -1}, "compare"),
    "report_days_to_full": Query(
        _reports("days_to_full"), _T | {"cur_gb": 8, "limit_gb": 8, "slope_mb": 6} | exact("days_to_full", "sev") | {"accel": 6},
        """SELECT *, cur_used / 1073741824 AS cur_gb, limit_bytes / 1073741824 AS limit_gb, slope_bpd / 1048576 AS slope_mb, accel_ratio AS accel,
        CASE WHEN days_to_full <= {dtf_crit} THEN 'CRIT' WHEN days_to_full <= {dtf_warn} THEN 'WARN' ELSE 'ok' END AS sev
        FROM tbspc_forecast WHERE quality = 'OK' AND days_to_full IS NOT NULL ORDER BY days_to_full, dbid, con_dbid, tablespace_name LIMIT {top_n}""",
    ),
    "report_forecast": Query(
        _reports("forecast_table"), _T | exact("n") | {"cur_gb": 8, "p30": 6, "p90": 6, "p180": 6, "r2": 8} | exact("quality"),
        """SELECT *, train_n AS n, cur_used / 1073741824 AS cur_gb, proj_30_bytes / 1073741824 AS p30, proj_90_bytes / 1073741824 AS p90, proj_180_bytes / 1073741824 AS p180 FROM tbspc_forecast""",
    ),
    "report_tbspc_anomalies": Query(
        _reports("tbspc_anomalies"), _T | exact("day_dt", "gap") | {"delta_mb": 6, "rate_mb": 6, "med_mb": 6, "thr_mb": 6, "z": 5} | exact("anomaly_flag"),
        """SELECT *, day_gap AS gap, used_delta_bytes / 1048576 AS delta_mb, used_rate_bpd / 1048576 AS rate_mb, median_rate_bpd / 1048576 AS med_mb, threshold_bpd / 1048576 AS thr_mb, robust_z AS z FROM recent_tbspc""",
    ),
    "report_cpu_trend": Query(
        _reports("cpu_trend_table"), _C | exact("metric", "n") | {"cur_val": 6, "slope_day": 8, "r2": 8} | exact("days_sat", "quality"),
        "SELECT *, train_n AS n, slope_per_day AS slope_day, days_to_sat AS days_sat FROM cpu_trend",
    ),
    "report_cpu_anomalies": Query(_reports("cpu_anomalies"), _C | exact("day_dt") | {"busy_pct": 6, "median_pct": 6, "threshold_pct": 6, "z": 6} | exact("anomaly_flag"), "SELECT *, robust_z AS z FROM recent_cpu", SENSITIVE),
    "report_compare_tbspc": Query(
        _reports("compare_table", "TBSPC"), _C | exact("series_key", "h") | {"regr": 6},
        "SELECT dbid, con_dbid, series_key, horizon_days AS h, max(CASE WHEN engine = 'REGR' THEN value END) / 1073741824 AS regr FROM compare WHERE series_kind = 'TBSPC' GROUP BY 1, 2, 3, 4",
    ),
    "report_compare_cpu": Query(
        _reports("compare_table", "CPU"), _C | exact("series_key", "h") | {"regr": 4},
        "SELECT dbid, con_dbid, series_key, horizon_days AS h, max(CASE WHEN engine = 'REGR' THEN value END) AS regr FROM compare WHERE series_kind = 'CPU' GROUP BY 1, 2, 3, 4",
    ),
    "total_size_filled": Query(_reports("total_filled"), _C | exact("day_dt", "all_bytes"), "total_filled"),
    "total_size_current": Query(_reports("current_totals"), _C | exact("cur_used", "cur_limit", "limit_all"), "current_totals"),
    "total_size_fit": Query(_reports("total_fit"), _C | exact("last_day", "n", "cur_used", "cur_limit", "limit_all") | {"slope": 1, "r2": 8, "proj_180": -1} | exact("quality", "days_to_limit"), "total_fit"),
    "alerts": Query(_reports("alerts"), exact("kind", "dbid", "con_dbid", "label", "days", "severity"), "alerts", CONFIG.replace(dtf_warn=2000, dtf_crit=900)),
    "unusual_days": Query(_reports("unusual_days"), exact("n_unusual"), "SELECT (SELECT count(*) FROM recent_tbspc) + (SELECT count(*) FROM recent_cpu) AS n_unusual", SENSITIVE),
    "banner": Query(
        _reports("banner"), exact("state", "n_alerts"),
        "SELECT CASE WHEN count(*) = 0 THEN 'ok' WHEN max(severity) >= 2 THEN 'crit' ELSE 'warn' END AS state, count(*) AS n_alerts FROM alerts", CONFIG.replace(dtf_warn=2000, dtf_crit=900),
    ),
    "timeline_bounds": Query(_reports("timeline_bounds"), exact("min_day", "max_day"), "bounds"),
    "timeline_points": Query(_reports("timeline_points"), exact("kind", "dbid", "con_dbid", "label", "day_dt", "anomaly_flag", "used_delta_bytes") | {"used_rate_bpd": 3, "median_rate_bpd": 3, "busy_pct": 6, "median_pct": 6}, "points", CONFIG.replace(anomaly_days=3000, cpu_min_mad_pct=0.5)),
    "timeline_lanes": Query(
        _reports("timeline_lanes"), exact("kind", "dbid", "con_dbid", "label", "n", "n_lanes"),
        "SELECT *, (SELECT count(*) FROM lanes) AS n_lanes FROM lanes ORDER BY n DESC, label, dbid, con_dbid LIMIT 12", CONFIG.replace(anomaly_days=3000, cpu_min_mad_pct=0.5),
    ),
    "prediction_cards": Query(
        _reports("prediction_cards"), _T | exact("days_to_full", "confidence"),
        """SELECT *, CASE WHEN r2 >= 0.9 THEN 'high' ELSE 'good' END AS confidence FROM tbspc_forecast WHERE quality = 'OK' AND days_to_full IS NOT NULL
        ORDER BY days_to_full, dbid, con_dbid, tablespace_name LIMIT {top_n}""",
    ),
    "dominant_quality": Query(_reports("dominant_quality"), exact("quality", "n"), "SELECT quality, count(*) AS n FROM tbspc_forecast GROUP BY quality ORDER BY n DESC, quality LIMIT 1"),
    "quality_rollup": Query(
        _reports("quality_rollup"), exact("n_flat", "n_low", "n_short", "n_ok"),
        """SELECT count(*) FILTER (quality = 'FLAT') AS n_flat, count(*) FILTER (quality = 'LOW_CONFIDENCE') AS n_low, count(*) FILTER (quality = 'INSUFFICIENT_HISTORY') AS n_short,
        count(*) FILTER (quality = 'OK') AS n_ok FROM tbspc_forecast""",
    ),
    "chart_series": Query(_reports("chart_series"), _T | exact("days_to_full", "quality", "n_series"), "SELECT *, (SELECT count(*) FROM tbspc_forecast) AS n_series FROM charted"),
    "chart_history": Query(
        _reports("chart_history"), _T | exact("day_dt") | {"used_gb": 8, "limit_gb": 8} | exact("anomaly_flag"),
        """SELECT d.dbid, d.con_dbid, d.tablespace_name, d.day_dt, d.used_bytes / 1073741824 AS used_gb, d.limit_bytes / 1073741824 AS limit_gb, a.anomaly_flag FROM tbspc_daily d
        JOIN charted c ON c.dbid = d.dbid AND c.con_dbid = d.con_dbid AND c.tablespace_name = d.tablespace_name
        LEFT JOIN tbspc_anom a ON a.dbid = d.dbid AND a.con_dbid = d.con_dbid AND a.tablespace_name = d.tablespace_name AND a.day_dt = d.day_dt""",
    ),
    "chart_projection": Query(
        _reports("chart_projection"), _T | exact("end_day") | {"end_gb": 6},
        "SELECT dbid, con_dbid, tablespace_name, last_day + 180 AS end_day, (cur_used + slope_bpd * 180) / 1073741824 AS end_gb FROM charted WHERE quality = 'OK'",
    ),
    "total_projection": Query(
        _reports("total_projection"), _C | exact("end_day") | {"end_gb": 6},
        "SELECT dbid, con_dbid, last_day + 180 AS end_day, (cur_used + slope * 180) / 1073741824 AS end_gb FROM total_fit WHERE quality = 'OK'", CONFIG.replace(r2_gate=0.1),
    ),
    "cpu_projection": Query(
        _reports("cpu_projection"), _C | exact("metric", "end_day") | {"end_val": 4},
        "SELECT dbid, con_dbid, metric, last_day + 90 AS end_day, cur_val + slope_per_day * 90 AS end_val FROM cpu_trend WHERE quality = 'OK'", CONFIG.replace(r2_gate=0.0, min_train_days=2),
    ),
    "smoothing_series": Query(smoothed, exact("model_name", "exsm_model", "day_dt") | {c: -1 for c in ("actual", "prediction", "lower_bound", "upper_bound")}, "smoothed_spaces"),
    "smoothing_weekly": Query(smoothed_weekly, exact("model_name", "exsm_model", "day_dt") | {c: 5 for c in ("actual", "prediction", "lower_bound", "upper_bound")}, "smoothed_metrics"),
    "esm_points": Query(lambda e: at_rates(e).compare.where("engine = 'ESM'"), _C | exact("series_kind", "series_key", "horizon_days", "engine") | _BOUNDS, "esm_points"),
    "report_forecast_esm": Query(
        _reports_at_rates("forecast_table"), _T | {"esm30": 6},
        """SELECT f.dbid, f.con_dbid, f.tablespace_name, e.value / 1073741824 AS esm30 FROM tbspc_forecast f
        LEFT JOIN esm_points e ON e.dbid = f.dbid AND e.con_dbid = f.con_dbid AND e.series_key = f.tablespace_name AND e.series_kind = 'TBSPC'""",
    ),
    "report_compare_esm": Query(
        _reports_at_rates("compare_table", "TBSPC"), _C | exact("series_key", "h") | {c: 6 for c in ("regr", "esm", "esm_lo", "esm_hi")},
        """SELECT coalesce(r.dbid, e.dbid) AS dbid, coalesce(r.con_dbid, e.con_dbid) AS con_dbid, coalesce(r.series_key, e.series_key) AS series_key, coalesce(r.horizon_days, e.horizon_days) AS h,
          r.value / 1073741824 AS regr, e.value / 1073741824 AS esm, e.lower_bound / 1073741824 AS esm_lo, e.upper_bound / 1073741824 AS esm_hi
        FROM (SELECT * FROM compare WHERE series_kind = 'TBSPC') r FULL JOIN (SELECT * FROM esm_points WHERE series_kind = 'TBSPC') e
          ON e.dbid = r.dbid AND e.con_dbid = r.con_dbid AND e.series_key = r.series_key AND e.horizon_days = r.horizon_days""",
    ),
    "chart_esm": Query(
        _reports_at_rates("chart_esm"), _C | exact("series_key", "horizon_days") | _BOUNDS,
        "SELECT e.* FROM esm_points e JOIN charted c ON c.dbid = e.dbid AND c.con_dbid = e.con_dbid AND c.tablespace_name = e.series_key WHERE e.series_kind = 'TBSPC'",
    ),
    "container_union": Query(_reports("containers"), exact("dbid", "con_dbid"), "SELECT dbid, con_dbid FROM cpu_daily UNION SELECT dbid, con_dbid FROM dbtime_daily"),
    "container_count": Query(_reports("container_count"), exact("n_containers"), "SELECT count(DISTINCT con_dbid) AS n_containers FROM tbspc_daily"),
    "cpu_heroes": Query(
        _reports("cpu_heroes"), _C | exact("last_day") | {"cur_val": 6, "slope_per_day": 8} | exact("days_to_sat", "quality", "headline"),
        """SELECT *, CASE WHEN quality = 'INSUFFICIENT_HISTORY' THEN 'not enough history' WHEN quality = 'FLAT' THEN 'steady' WHEN quality = 'LOW_CONFIDENCE' THEN 'no clear trend'
        WHEN days_to_sat IS NULL THEN 'not rising' WHEN days_to_sat = 0 THEN 'at saturation' ELSE 'rising' END AS headline FROM cpu_trend WHERE metric = 'BUSY_PCT'""",
    ),
    "cpu_history": Query(
        _reports("cpu_history"), _C | exact("day_dt") | {"busy_pct": 6, "db_cpu_sec": 8} | exact("anomaly_flag"),
        """SELECT coalesce(c.dbid, d.dbid) AS dbid, coalesce(c.con_dbid, d.con_dbid) AS con_dbid, coalesce(c.day_dt, d.day_dt) AS day_dt, c.busy_pct, d.db_cpu_sec, a.anomaly_flag
        FROM cpu_daily c FULL JOIN dbtime_daily d ON d.dbid = c.dbid AND d.con_dbid = c.con_dbid AND d.day_dt = c.day_dt
        LEFT JOIN cpu_anom a ON a.dbid = c.dbid AND a.con_dbid = c.con_dbid AND a.day_dt = c.day_dt""", SENSITIVE,
    ),
}


def _trained(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose models are trained anew in the shared folder; the daily relations are kept meanwhile."""
    engine = Engine(tables_seam(spark, sf_dir), CONFIG, models_path=shared_path(spark, "models"), cache=True)
    engine.train_all(20)
    return engine


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every model after training: 20 tablespaces by days to full, and both CPU metrics."""
    engine = _trained(spark, sf_dir)
    engine.close()
    return engine.models.registry.read().select("model_name", "series_kind", "dbid", "con_dbid", "series_key", "exsm_model", "seasonality", "trained_through", "status")


def esm_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of all models: history with one-step predictions, future with bounds."""
    engine = _trained(spark, sf_dir)
    engine.close()
    return engine.models.esm_forecast()


def esm_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both engines at matched horizons, with the models' points 30 days ahead."""
    engine = _trained(spark, sf_dir)
    engine.close()
    return engine.compare


REGISTRY_SQL = """
SELECT CASE kind WHEN 'TBSPC' THEN 'CAPT' WHEN 'CPU' THEN 'CAPC' ELSE 'CAPD' END || '_' || substr(upper(md5(dbid || '|' || con_dbid || '|' || key)), 1, 16) AS model_name,
  kind AS series_kind, dbid, con_dbid, key AS series_key, CASE kind WHEN 'TBSPC' THEN 'EXSM_HOLT' ELSE 'EXSM_ADDWINTERS' END AS exsm_model,
  CASE WHEN kind <> 'TBSPC' THEN 7 END AS seasonality, trained_through, 'OK' AS status
FROM (
  SELECT 'TBSPC' AS kind, dbid, con_dbid, tablespace_name AS key, last_day AS trained_through
  FROM (SELECT * FROM tbspc_forecast WHERE train_n >= {min_train_days} ORDER BY days_to_full ASC NULLS LAST, cur_used DESC NULLS LAST, dbid, con_dbid, tablespace_name LIMIT 20)
  UNION ALL SELECT 'CPU', dbid, con_dbid, 'BUSY_PCT', max(day_dt) FROM cpu_daily WHERE busy_pct IS NOT NULL GROUP BY dbid, con_dbid
  UNION ALL SELECT 'DBCPU', dbid, con_dbid, 'DB_CPU_SEC', max(day_dt) FROM dbtime_daily WHERE db_cpu_sec IS NOT NULL GROUP BY dbid, con_dbid)
"""
REGISTRY_COLUMNS = exact("model_name", "series_kind", "dbid", "con_dbid", "series_key", "exsm_model", "seasonality", "trained_through", "status")


def config_knobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored knobs after seeding a new store."""
    store = ConfigStore(spark, shared_path(spark, "config"))
    store.seed()
    return store.read()


#: The knobs and their defaults, as text.
CONFIG_SQL = """SELECT cfg_name, CAST(cfg_value AS DOUBLE) AS cfg_value FROM (VALUES
  ('train_days', 90), ('recent_days', 28), ('min_train_days', 14), ('r2_gate', 0.60), ('mad_k', 3), ('mad_window_days', 28), ('anomaly_report_days', 14), ('cpu_sat_pct', 80),
  ('abs_floor_bytes', 104857600), ('dow_weeks', 8), ('dtf_warn', 90), ('dtf_crit', 30), ('tbspc_min_hist', 7), ('cpu_min_mad_pct', 3), ('cpu_min_dow_hist', 3), ('esm_prediction_step', 30)
) AS t(cfg_name, cfg_value)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {"config_knobs": config_knobs, "model_registry": model_registry, "esm_forecast": esm_forecast, "esm_compare": esm_compare}
    return {name: q.frame for name, q in QUERIES.items()} | own


def oracle_sql() -> dict[str, str]:
    registry = Query(lambda e: e.tbspc_forecast, REGISTRY_COLUMNS, REGISTRY_SQL).oracle()
    return {name: q.oracle() for name, q in QUERIES.items()} | {"config_knobs": CONFIG_SQL, "model_registry": registry}
