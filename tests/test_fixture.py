"""The closed-form fixture: every answer is known before the run."""

import datetime as dt

import pytest

from tidemark.config import Config
from tidemark.plans.engine import Engine
from tidemark.plans.reports import Reports
from tidemark.sources.fixture import Fixture

ANCHOR = dt.date(2024, 7, 3)


@pytest.fixture(scope="module")
def fixture(spark):
    return Fixture(spark, ANCHOR)


@pytest.fixture(scope="module")
def engine(fixture, tmp_path_factory):
    e = Engine(fixture.seam(), Config(), models_path=str(tmp_path_factory.mktemp("models")), cache=True)
    yield e
    e.close()


@pytest.fixture(scope="module")
def forecast(engine):
    return {r["tablespace_name"]: r for r in engine.tbspc_forecast.collect()}


@pytest.fixture(scope="module")
def growth(engine):
    return engine.tbspc_anom.collect()


@pytest.fixture(scope="module")
def busy(engine):
    return engine.cpu_anom.collect()


def flags(rows, name, flag=None):
    return [r for r in rows if r["tablespace_name"] == name and r["anomaly_flag"] and flag in (None, r["anomaly_flag"])]


def test_anchor_days(fixture):
    want = fixture.expected()
    assert want["INJECTED_DAY"] == dt.date(2024, 7, 2) and want["PROBE_DAY"] == dt.date(2024, 7, 1)
    assert want["RESTART_DAY"] == dt.date(2024, 5, 4) and want["SPIKE_DAY"] == dt.date(2024, 6, 23)


def test_linear(forecast, growth, fixture):
    r, want = forecast["FIX_LINEAR"], fixture.expected()
    assert r["slope_bpd"] == pytest.approx(want["LINEAR_SLOPE"], rel=1e-6)
    assert r["r2"] > 0.999 and r["quality"] == "OK"
    assert r["days_to_full"] == want["LINEAR_DAYS_TO_FULL"]
    assert (r["cur_used"], r["limit_bytes"]) == (want["LINEAR_CUR_USED"], want["LINEAR_LIMIT"])
    assert r["proj_30_bytes"] == pytest.approx(want["LINEAR_PLUS_30"], rel=1e-9)
    assert r["accel_ratio"] == pytest.approx(1.0) and r["train_n"] == 90
    assert flags(growth, "FIX_LINEAR") == []


def test_spike(forecast, growth, fixture):
    r = forecast["FIX_SPIKE"]
    assert r["quality"] == "LOW_CONFIDENCE"
    assert r["slope_bpd"] == pytest.approx(20_604_145.0954, rel=1e-8)
    assert (round(r["r2"], 5), round(r["accel_ratio"], 4)) == (0.46063, 5.5884)
    high = flags(growth, "FIX_SPIKE", "HIGH")
    assert [h["day_dt"] for h in high] == [fixture.expected()["SPIKE_DAY"]] and flags(growth, "FIX_SPIKE", "LOW") == []
    h = high[0]
    assert (h["n_hist"], h["used_rate_bpd"], h["median_rate_bpd"], h["mad_sigma"], h["threshold_bpd"], h["robust_z"]) == (28, 2_152_726_528, 5_242_880, 0, 104_857_600, None)


def test_flat(forecast, growth):
    r = forecast["FIX_FLAT"]
    assert (r["slope_bpd"], r["r2"], r["days_to_full"], r["accel_ratio"], r["quality"]) == (0, 1, None, None, "FLAT")
    assert flags(growth, "FIX_FLAT") == []


def test_gap(engine, forecast, growth):
    gaps = [r["day_gap"] for r in engine.tbspc_delta.where("tablespace_name = 'FIX_GAP' AND day_gap IS NOT NULL").collect()]
    assert max(gaps) == 4 and flags(growth, "FIX_GAP") == []
    r = forecast["FIX_GAP"]
    assert (r["train_n"], r["days_to_full"], r["quality"]) == (87, 732, "OK") and r["slope_bpd"] == pytest.approx(62_914_560)


def test_rows_of_anomalies(growth, busy):
    count = lambda n: sum(r["tablespace_name"] == n for r in growth)
    assert [count(f"FIX_{n}") for n in ("LINEAR", "SPIKE", "FLAT", "GAP")] == [119, 119, 119, 116]
    assert len(busy) == 112


def test_cpu(engine, busy, fixture):
    want = fixture.expected()
    days = {r["day_dt"]: r for r in engine.cpu_daily.collect()}
    assert len(days) == 119 and want["RESTART_DAY"] not in days
    assert 39 <= days[want["PROBE_DAY"]]["busy_pct"] <= 41
    flagged = [r for r in busy if r["anomaly_flag"]]
    assert [(r["day_dt"], r["anomaly_flag"]) for r in flagged] == [(want["INJECTED_DAY"], "HIGH")]
    r = flagged[0]
    assert [round(r[c], 9) for c in ("busy_pct", "median_pct", "threshold_pct", "robust_z")] == [70, 40, 9, 10] and r["n_hist"] == 8


def test_cpu_trend(engine):
    r = {x["metric"]: x for x in engine.cpu_trend.collect()}
    assert (round(r["BUSY_PCT"]["slope_per_day"], 8), round(r["BUSY_PCT"]["r2"], 6), r["BUSY_PCT"]["quality"]) == (0.02639448, 0.005007, "LOW_CONFIDENCE")
    assert (round(r["DB_CPU_SEC"]["slope_per_day"], 8), r["DB_CPU_SEC"]["cur_val"]) == (0.26394476, 400)
    assert r["BUSY_PCT"]["train_n"] == r["DB_CPU_SEC"]["train_n"] == 89
    assert {x["db_cpu_per_core"] for x in engine.dbtime_daily.where("day_dt = '2024-07-01'").collect()} == {100.0}


def test_whole_database(engine):
    r = Reports(engine).total_fit().collect()[0]
    assert (r["n"], r["cur_used"], r["cur_limit"], r["days_to_limit"]) == (90, 12_213_813_248, 161_480_704_000, 1590)
    assert round(r["slope"], 4) == 93_843_922.5296 and round(r["r2"], 5) == 0.94565


def test_smoothing_lifecycle(engine):
    engine.train_all(20)
    models = {r["series_key"]: r for r in engine.models.registry.read().collect()}
    assert {k: m["status"] for k, m in models.items()} == dict.fromkeys(["FIX_LINEAR", "FIX_SPIKE", "FIX_FLAT", "FIX_GAP", "BUSY_PCT", "DB_CPU_SEC"], "OK")
    assert models["FIX_LINEAR"]["model_name"].startswith("CAPT_") and models["BUSY_PCT"]["seasonality"] == 7
    points = {(r["series_key"], r["horizon_days"]): r for r in engine.compare.where("engine = 'ESM'").collect()}
    # Series of fewer than 120 rows don't reach 30 days.
    assert set(points) == {("FIX_LINEAR", 30), ("FIX_SPIKE", 30), ("FIX_FLAT", 30)}
    r = points["FIX_LINEAR", 30]
    assert r["value"] == pytest.approx(1_677_721_600, rel=0.05) and r["value"] == pytest.approx(1_677_721_600, rel=1e-9)
    assert r["lower_bound"] == r["value"] == r["upper_bound"]
    assert engine.models.get_forecast(models["FIX_LINEAR"]["model_name"]).where("actual IS NULL").count() == 30
    assert engine.models.get_forecast("no such model").count() == 0
    # A retrained subset leaves the others as they are; a stale model isn't compared.
    engine.models.registry.upsert(engine.models.registry.read().where("series_key = 'FIX_FLAT'").selectExpr(*[c if c != "trained_through" else "date_sub(trained_through, 1) AS trained_through" for c in engine.models.registry.read().columns]), "model_name")
    assert engine.compare.where("engine = 'ESM' AND series_key = 'FIX_FLAT'").count() == 0
    engine.train_tablespaces(1)
    assert engine.models.ok_count() == 6
    engine.drop_all()
    assert engine.models.ok_count() == 0 and engine.models.esm_forecast().count() == 0


def test_reports_render(engine, tmp_path):
    from tidemark.render import html, text

    who = text.Identity("My DB", "host", "owner", dt.datetime(2024, 7, 3, 12, 0))
    assert who.file_name("txt") == "cap_report_My_DB_202407031200.txt"
    report = text.render(Reports(engine), who)
    assert "FIX_GAP" in report and "Skipped" in report and "INSUFFICIENT_HISTORY" in report
    page = html.render(Reports(engine), who)
    assert page.count("<svg") >= 6 and "FIX_LINEAR" in page and "http" not in page.replace("http-equiv", "")
    assert text.write(page, str(tmp_path), who.file_name("html")).read_text() == page


def test_sql_views(engine, spark):
    names = engine.install()
    engine.install()
    assert spark.sql("SELECT count(*) AS n FROM capf_tbspc_forecast f JOIN capd_tbspc_daily d USING (dbid, con_dbid, tablespace_name)").collect()[0]["n"] == 4 * 121 - 3
    assert "capf_compare" in names
    engine.uninstall()
    assert not spark.catalog.tableExists("capf_tbspc_forecast")
