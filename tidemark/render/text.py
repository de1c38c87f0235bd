"""The text report: collected relations, bounded by top_n and the report window, laid out in columns."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame

from tidemark.plans.reports import Reports

RULE = "=" * 80


@dataclass(frozen=True)
class Identity:
    """Who and when a report is about; stands in for the session's own context and clock."""

    database: str
    host: str = "-"
    user: str = "-"
    as_of: dt.datetime = dt.datetime(1970, 1, 1)
    container: str | None = None

    @property
    def label(self) -> str:
        return f"{self.database} / {self.container}" if self.container else self.database

    def file_name(self, suffix: str) -> str:
        name = re.sub(r"[^A-Za-z0-9]+", "_", self.database)
        return f"cap_report_{name}_{self.as_of:%Y%m%d%H%M}.{suffix}"


Column = tuple[str, str, Callable[[object], str]]


def number(digits: int) -> Callable[[object], str]:
    return lambda v: "" if v is None else f"{v:.{digits}f}"


def plain(v: object) -> str:
    return "" if v is None else str(v)


def layout(rows: list, columns: list[Column]) -> list[str]:
    """A heading, a rule and the rows; numbers to the right, words to the left."""
    if not rows:
        return ["   no rows selected"]
    cells = [[f(r[name]) for _, name, f in columns] for r in rows]
    heads = [h for h, _, _ in columns]
    widths = [max(len(x) for x in col) for col in zip(heads, *cells)]
    right = [all(isinstance(r[name], (int, float, type(None))) for r in rows) for _, name, _ in columns]
    line = lambda xs: " ".join(x.rjust(w) if r else x.ljust(w) for x, w, r in zip(xs, widths, right)).rstrip()
    return [line(heads), " ".join("-" * w for w in widths), *map(line, cells)]


def _rows(df: DataFrame) -> list:
    return df.collect()


def render(reports: Reports, who: Identity) -> str:
    """Header, six sections and footer. Section 6 is a note where there is nothing to compare."""
    c = reports.config
    ok = reports.ok_models()
    out = [
        RULE, " Capacity report", RULE,
        f" Database : {who.label}", f" Host     : {who.host}", f" Schema   : {who.user}", f" Generated: {who.as_of:%Y-%m-%d %H:%M:%S}",
        f" Limits   : warning within {c.dtf_warn} days, critical within {c.dtf_crit}; CPU saturated at {c.cpu_sat_pct:g}%",
        f" Smoothing: {ok} trained model(s)",
        "." * 80,
        f" A series of fewer than {c.min_train_days} days is graded INSUFFICIENT_HISTORY and isn't predicted.",
        RULE,
    ]
    con = [("CON_DBID", "con_dbid", plain), ("TABLESPACE", "tablespace_name", plain)]

    def section(title: str, notes: list[str], rows: list, columns: list[Column]) -> None:
        out.extend(["", f"== {title} ==", *(f"   {n}" for n in notes), "", *layout(rows, columns)])

    section(
        f"1. Soonest full (the first {c.top_n} of grade OK)", ["ACCEL compares recent growth with that of the whole window."],
        _rows(reports.days_to_full()),
        [*con, ("CUR_GB", "cur_gb", number(2)), ("LIMIT_GB", "limit_gb", number(2)), ("MB/DAY", "slope_mb", number(3)), ("DAYS_FULL", "days_to_full", plain), ("SEV", "sev", plain), ("ACCEL", "accel", number(2))],
    )
    section(
        "2. Forecast of every tablespace in GB", [f"Grades: OK, LOW_CONFIDENCE (R2 below {c.r2_gate:g}), FLAT, INSUFFICIENT_HISTORY."],
        _rows(reports.forecast_table()),
        [*con, ("TRAIN_N", "n", plain), ("CUR_GB", "cur_gb", number(2)), ("+30_GB", "p30", number(2)), ("+90_GB", "p90", number(2)), ("+180_GB", "p180", number(2)), ("R2", "r2", number(3)), ("QUALITY", "quality", plain), ("ESM+30", "esm30", number(2))],
    )
    section(
        f"3. Unusual growth, last {c.anomaly_days} days", ["Rates are a day; GAP counts days since the sample before."],
        _rows(reports.tbspc_anomalies()),
        [*con, ("DAY", "day_dt", plain), ("GAP", "gap", plain), ("DELTA_MB", "delta_mb", number(1)), ("RATE_MB/D", "rate_mb", number(1)), ("MED_MB/D", "med_mb", number(1)), ("THR_MB/D", "thr_mb", number(1)), ("ROBUST_Z", "z", number(1)), ("FLAG", "anomaly_flag", plain)],
    )
    section(
        "4. CPU trend", [f"DAYS_SAT tells when BUSY_PCT reaches {c.cpu_sat_pct:g}%."],
        _rows(reports.cpu_trend_table()),
        [con[0], ("METRIC", "metric", plain), ("TRAIN_N", "n", plain), ("CURRENT", "cur_val", number(2)), ("SLOPE/DAY", "slope_day", number(4)), ("R2", "r2", number(3)), ("DAYS_SAT", "days_sat", plain), ("QUALITY", "quality", plain)],
    )
    section(
        f"5. Unusual CPU days against their weekday, last {c.anomaly_days} days", ["A day is flagged if it is further from the median than THRESH%."],
        _rows(reports.cpu_anomalies()),
        [con[0], ("DAY", "day_dt", plain), ("BUSY%", "busy_pct", number(2)), ("MEDIAN%", "median_pct", number(2)), ("THRESH%", "threshold_pct", number(2)), ("ROBUST_Z", "z", number(1)), ("FLAG", "anomaly_flag", plain)],
    )
    if reports.shows_esm(ok):
        cells = [("HORIZON", "h", plain), ("REGR", "regr", number(2)), ("ESM", "esm", number(2)), ("ESM_LO", "esm_lo", number(2)), ("ESM_HI", "esm_hi", number(2))]
        section("6. Smoothing against regression", [f"{ok} model(s); smoothing has one horizon, of models trained to the last day.", "Tablespaces in GB:"], _rows(reports.compare_table("TBSPC")), [con[0], ("TABLESPACE", "series_key", plain), *cells])
        out.extend(["", "   CPU:", "", *layout(_rows(reports.compare_table("CPU")), [con[0], ("METRIC", "series_key", plain), *cells])])
    else:
        out.extend(["", "== 6. Smoothing against regression ==", "   Skipped: show_esm is N, or AUTO with no trained models."])
    out.extend(["", RULE, " End of report; nothing was written to the sources.", RULE, ""])
    return "\n".join(out)


def write(text: str, folder: str, name: str) -> Path:
    path = Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path
