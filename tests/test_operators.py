"""What the fixture leaves out: ties, several instances, fallbacks, exclusions, grades, shifts and scalings."""

import datetime as dt

import pytest

from tidemark.config import Config, ConfigStore
from tidemark.operators import anomaly, daily, trend
from tidemark.operators.smoothing import fit, horizon
from tidemark.plans.engine import Engine
from tidemark.plans.reports import Reports
from tidemark.sources import seams
from tidemark.sources.contracts import CONTRACTS, validate
from tidemark.sources.seams import Seam

D = dt.datetime


def make(spark, **tables):
    return Seam(**{name: spark.createDataFrame(tables.get(name, []), schema) for name, schema in CONTRACTS.items()})


def snap(i, when, instance=1, boot=D(2024, 1, 1), dbid=1):
    return (dbid, dbid, instance, i, when - dt.timedelta(hours=1), when, boot)


def spaces(*rows):
    return [(1, 1, i, name, contents, block) for i, name, contents, block in rows]


def test_last_of_day_with_ties(spark):
    seam = make(
        spark,
        snapshot=[snap(1, D(2024, 1, 2, 10)), snap(2, D(2024, 1, 2, 23)), snap(3, D(2024, 1, 2, 23))],
        tbspc_usage=[(1, 1, 1, 5, 100, 0, 90), (1, 1, 2, 5, 20, 0, None), (1, 1, 3, 5, 10, 40, 9)],
        tablespace=spaces((5, "T", "PERMANENT", 10)),
    )
    r = daily.tbspc_daily(seam).collect()[0]
    # The last time has two rows: each measure takes its own greatest.
    assert (r["used_bytes"], r["size_bytes"], r["limit_bytes"], r["n_samples"]) == (90, 200, 400, 3)


def test_exclusions_and_block_size(spark):
    days = [snap(1, D(2024, 1, 2))]
    names = [(1, "A", "PERMANENT", None), (2, "B", "UNDO", 8), (3, "C", "TEMPORARY", 8), (4, "D", None, 8), (5, "E", "PERMANENT", None)]
    seam = make(spark, snapshot=days, tbspc_usage=[(1, 1, 1, i, 2, 0, 1) for i in range(1, 6)], tablespace=spaces(*names), datafile=[(1, 1, 1, 4), (1, 1, 1, 16)])
    assert [(r["tablespace_name"], r["used_bytes"]) for r in daily.tbspc_daily(seam).collect()] == [("A", 16)]


def test_two_ids_under_one_name(spark):
    seam = make(
        spark,
        snapshot=[snap(1, D(2024, 1, 2)), snap(2, D(2024, 1, 3))],
        tbspc_usage=[(1, 1, 1, 1, 1, 0, 1), (1, 1, 1, 2, 5, 0, 5), (1, 1, 2, 2, 6, 0, 6)],
        tablespace=spaces((1, "T", "PERMANENT", 1), (2, "T", "PERMANENT", 1)),
    )
    rows = daily.tbspc_delta(daily.tbspc_daily(seam)).orderBy("day_dt", "tablespace_id").collect()
    assert [(r["day_gap"], r["used_rate_bpd"]) for r in rows] == [(None, None), (0, None), (1, 1.0)]


def counters(values, name, instance=1):
    return [(1, 1, instance, i, name, v) for i, v in enumerate(values, 1)]


def test_counters_over_instances_and_restarts(spark):
    when = [D(2024, 1, 2, h) for h in (1, 2, 3, 4)]
    boots = [D(2024, 1, 1)] * 2 + [D(2024, 1, 2, 2, 30)] * 2
    seam = make(
        spark,
        snapshot=[snap(i, w, 1, b) for i, (w, b) in enumerate(zip(when, boots), 1)] + [snap(i, w, 2) for i, w in enumerate(when, 1)],
        osstat=counters([10, 30, 100, 110], "BUSY_TIME") + counters([0, 20, 100, 130], "IDLE_TIME") + counters([0, 10, 5, 25], "BUSY_TIME", 2) + counters([0, 30, 60, 90], "IDLE_TIME", 2)
        + counters([4] * 4, "NUM_CPUS") + counters([8] * 4, "NUM_CPUS", 2) + counters([2] * 4, "NUM_CPU_CORES"),
        time_model=counters([0, 2_000_000, 0, 4_000_000], "DB CPU") + counters([0, 1, 0, 1], "DB time"),
    )
    r = daily.cpu_daily(seam).collect()[0]
    # Kept: 1 (20, 20), 4 (10, 30) of the first; 2 (10, 30) and 4 (20, 30) of the second, whose third went back.
    assert r["n_intervals"] == 4 and r["busy_pct"] == pytest.approx(100 * 60 / 170)
    t = daily.dbtime_daily(seam).collect()[0]
    # Background time is unknown and may be; cores are 2 of the first and CPUs of the second.
    assert (t["db_cpu_sec"], t["bg_cpu_sec"], t["n_intervals"], t["db_cpu_per_core"]) == (6.0, None, 2, 0.6)


def series(spark, values, start=dt.date(2024, 1, 1), name="T", limit=1000):
    rows = [(1, 1, 1, name, start + dt.timedelta(days=i), v, v, limit, 1) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "dbid long, con_dbid long, tablespace_id long, tablespace_name string, day_dt date, used_bytes long, size_bytes long, limit_bytes long, n_samples long")


@pytest.mark.parametrize(
    ("values", "grade", "days"),
    [
        ([10 * i for i in range(20)], "OK", 81),
        ([10 * i for i in range(5)], "INSUFFICIENT_HISTORY", 96),
        ([7] * 20, "FLAT", None),
        ([(i * 7919) % 100 for i in range(20)], "LOW_CONFIDENCE", None),
        ([1000 + 10 * i for i in range(20)], "OK", -19),
        ([5], "INSUFFICIENT_HISTORY", None),
    ],
)
def test_grades(spark, values, grade, days):
    r = trend.tbspc_forecast(series(spark, values), Config()).collect()[0]
    assert r["quality"] == grade
    if grade != "LOW_CONFIDENCE":
        assert r["days_to_full"] == days


def test_saturation_is_clamped(spark):
    rows = [(1, 1, dt.date(2024, 1, 1) + dt.timedelta(days=i), 70.0 + i, 1.0, 1.0, 1) for i in range(20)]
    cpu = spark.createDataFrame(rows, "dbid long, con_dbid long, day_dt date, busy_pct double, num_cpus double, num_cpu_cores double, n_intervals long")
    none = spark.createDataFrame([], "dbid long, con_dbid long, day_dt date, db_cpu_sec double")
    assert [r["days_to_sat"] for r in trend.cpu_trend(cpu, none, Config()).collect()] == [0]


def test_low_flag_and_missing_history(spark):
    delta = daily.tbspc_delta(series(spark, [100 * i for i in range(12)] + [200]))
    rows = anomaly.tbspc_anom(delta, Config(abs_floor_bytes=10)).orderBy("day_dt").collect()
    assert len(rows) == 11 and [r["anomaly_flag"] for r in rows][-1] == "LOW"


def test_properties(spark):
    values = [(i * 37) % 50 + 3 * i for i in range(60)]
    base = trend.tbspc_forecast(series(spark, values), Config()).collect()[0]
    scaled = trend.tbspc_forecast(series(spark, [4 * v for v in values]), Config()).collect()[0]
    assert scaled["slope_bpd"] == pytest.approx(4 * base["slope_bpd"]) and scaled["r2"] == pytest.approx(base["r2"])
    moved = trend.tbspc_forecast(series(spark, values, dt.date(2024, 3, 9)), Config()).collect()[0]
    assert moved["slope_bpd"] == pytest.approx(base["slope_bpd"])
    line = [5 * i if i not in (7, 8, 20) else None for i in range(60)]
    assert trend.tbspc_forecast(series(spark, line), Config()).collect()[0]["slope_bpd"] == pytest.approx(5)
    flags = lambda s: [r["anomaly_flag"] for r in anomaly.tbspc_anom(daily.tbspc_delta(s), Config(abs_floor_bytes=0, mad_k=1)).orderBy("day_dt").collect()]
    assert flags(series(spark, values)) == flags(series(spark, values, dt.date(2024, 3, 9)))


def test_gap_fill_holds_totals(spark):
    a, b = series(spark, [1, 2, 3, 4]), series(spark, [10, None, None, 40], name="U")

    class Some(Engine):
        def __init__(self):
            self.config, self.spark, self.tbspc_daily = Config(), spark, a.unionByName(b)

    r = Reports(Some())
    assert [x["all_bytes"] for x in r.total_filled().orderBy("day_dt").collect()] == [11, 12, 13, 44]


def test_contracts(spark):
    with pytest.raises(ValueError, match="stat_name: missing"):
        validate(spark.createDataFrame([(1,)], "dbid long"), "osstat")
    with pytest.raises(ValueError, match="seam_mode"):
        seams.open_seam("remote", None)
    wide = spark.createDataFrame([(1, 1, 1, 8, "x")], "dbid int, con_dbid int, tablespace_id int, block_size int, extra string")
    assert validate(wide, "datafile").schema == CONTRACTS["datafile"]


def test_repository_seam(spark, tmp_path):
    source = {
        "dba_hist_snapshot": spark.createDataFrame([(7, 1, 1, D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 1))], "dbid long, instance_number long, snap_id long, begin_interval_time timestamp_ntz, end_interval_time timestamp_ntz, startup_time timestamp_ntz"),
        "dba_hist_tbspc_space_usage": spark.createDataFrame([], CONTRACTS["tbspc_usage"]),
        "dba_hist_tablespace": spark.createDataFrame([(7, 7, 3, "T", "PERMANENT", 8)], "dbid long, con_dbid long, `ts#` long, tsname string, contents string, block_size long"),
        "dba_hist_datafile": spark.createDataFrame([(7, 7, 3, 8), (7, 7, 3, 16)], "dbid long, con_dbid long, `ts#` long, block_size long"),
        "dba_hist_osstat": spark.createDataFrame([(7, 7, 1, 1, "BUSY_TIME", 5), (7, 7, 1, 1, "LOAD", 5)], CONTRACTS["osstat"]),
        "dba_hist_sys_time_model": spark.createDataFrame([(7, 7, 1, 1, "DB CPU", 5), (7, 7, 1, 1, "parse", 5)], CONTRACTS["time_model"]),
    }
    for name, df in source.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    seam = seams.open_seam(None, seams.parquet_reader(spark, str(tmp_path)))
    assert seam.snapshot.collect()[0]["con_dbid"] == 7 and seam.datafile.collect()[0]["block_size"] == 16
    assert seam.osstat.count() == seam.time_model.count() == 1
    plan = seam.osstat._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(stat_name" in plan


def test_config(spark, tmp_path):
    store = ConfigStore(spark, str(tmp_path / "config"))
    store.seed()
    store.update(r2_gate=0.7)
    store.seed(Config(r2_gate=0.1))
    assert store.load(top_n=3) == Config(r2_gate=0.7, top_n=3)
    with pytest.raises(ValueError, match="unknown"):
        store.update(nonsense=1)
    store.table.write(store.read().where("cfg_name <> 'mad_k'"))
    with pytest.raises(ValueError, match="mad_k"):
        store.load()
    with pytest.raises(ValueError):
        Config(mad_k=None)


def test_versions_survive_a_lost_write(spark, tmp_path):
    """A write that failed leaves a folder without a mark of success; the next one goes beside it."""
    from tidemark.sources.versioned import VersionedTable

    table = VersionedTable(spark, str(tmp_path / "t"), "x int")
    table.write(spark.createDataFrame([(1,)], "x int"))
    (tmp_path / "t" / "v00000001").mkdir()
    assert table.read().count() == 1
    table.write(spark.createDataFrame([(2,), (3,)], "x int"))
    assert sorted(r["x"] for r in table.read().collect()) == [2, 3] and table.versions() == ["v00000000", "v00000002"]
    table.vacuum()
    assert sorted(f.name for f in (tmp_path / "t").iterdir()) == ["v00000002"] and table.read().count() == 2


def test_shared_folder(spark):
    """Where driver and executors are apart, an unset folder is an error; else there is one for the application."""
    from types import SimpleNamespace

    from tidemark.sources import shared

    def session(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master))
    assert shared.shared_dir(session("local[4]")).startswith("file:/")
    path = shared.shared_path(spark, "x")
    assert spark.sparkContext.applicationId in path
    spark.range(3).write.parquet(path)
    shared.delete(spark, path)
    shared.delete(spark, path)


def test_smoothing():
    f = fit([3 + 2 * i for i in range(40)], 5)
    assert list(f.forecast) == pytest.approx([83, 85, 87, 89, 91]) and list(f.lower) == list(f.upper)
    week = [10, 12, 15, 11, 9, 4, 3]
    s = fit([week[i % 7] + 0.5 * i for i in range(70)], 7, 7)
    assert list(s.forecast) == pytest.approx([week[i % 7] + 0.5 * i for i in range(70, 77)], abs=0.2)
    assert [horizon(n, 30) for n in (0, 8, 119, 120, 500)] == [1, 2, 29, 30, 30]
    noisy = fit([(i * 7919) % 101 for i in range(50)], 10)
    width = noisy.upper - noisy.lower
    assert (width[1:] >= width[:-1]).all() and width[0] > 0
    with pytest.raises(ValueError):
        fit([1, 2, 3], 2, 7)


def test_failed_series_dont_stop_others(spark):
    from tidemark.operators.smoothing import fit_all

    rows = [("CPU", 1, 1, "BUSY_PCT", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0) for i in range(5)]
    rows += [("TBSPC", 1, 1, "T", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "series_kind string, dbid long, con_dbid long, series_key string, day_dt date, val double")
    status = {r["series_key"]: r["status"] for r in fit_all(df, 30).select("series_key", "status").distinct().collect()}
    assert status["T"] == "OK" and status["BUSY_PCT"].startswith("FAILED:")


def test_alert_states(spark):
    from tidemark.render import html

    a = {"kind": "TBSPC", "dbid": 1, "con_dbid": 1, "label": "A&B", "days": 5, "severity": 2}
    assert "crit" in html.banner([a], 0, Config(), False) and "A&amp;B" in html.banner([a], 1, Config(), False)
    both = html.banner([a | {"severity": 1}, a | {"kind": "CPU", "label": "Host CPU", "days": 2, "severity": 1}], 0, Config(), True)
    assert "warn" in both and "2 limits" in both and both.index("Host CPU [1]") < both.index("A&amp;B")
    assert "No limit" in html.banner([], 2, Config(), False) and "2 flagged days" in html.banner([], 2, Config(), False)


def test_timeline():
    from tidemark.render import html

    key = {"kind": "CPU", "dbid": 1, "con_dbid": 1, "label": "Host <CPU>"}
    bounds = {"min_day": dt.date(2024, 1, 1), "max_day": dt.date(2024, 1, 11)}
    point = key | {"day_dt": dt.date(2024, 1, 6), "busy_pct": 71.4, "median_pct": None}
    strip = html.timeline([key | {"n_lanes": 3}], [point], bounds)
    assert "left:50.0%" in strip and "Host &lt;CPU&gt;" in strip and "2 further series" in strip and "load 71 %" in strip
    assert "no days" in html.timeline([], [], {"min_day": None, "max_day": None}) and "flagged" in html.timeline([], [], bounds)


def test_phrases():
    from tidemark.render import parts as p

    assert [p.time_phrase(d) for d in (None, 0, 1, 59, 90, 730, 500)] == ["an unknown time", "less than a day", "about 1 day", "about 59 days", "about 3 months", "about 2 years", "about 1.4 years"]
    assert (p.size_phrase(2048), p.size_phrase(1.25), p.nz(None), p.pct_of(5, 0), p.pct_of(30, 10)) == ("2.00 TB", "1.2 GB", "–", None, 100.0)
    assert p.lin(1, 2, 2, 0, 10) == 5 and "circle" in p.polyline([(1, 2)], "x")
    day = dt.date(2024, 1, 1)
    notes = [p.growth_note(day, change, pace, median) for change, pace, median in ((2**30, 30, 4), (2**30, 50, 4), (2**30, 1, 4), (-(2**31), -5, 4), (2**30, 5, 0), (None, None, None))]
    want = ["+1.0 GB; 7.5 times", "+1.0 GB; 12 times", "+1.0 GB; 25% of", "-2.0 GB", "+1.0 GB; the median pace is none", "+0.0 GB; the median pace is none"]
    assert all(w in n for w, n in zip(want, notes)) and notes[3] == "2024-01-01: -2.0 GB"
    assert p.busy_note(day, 70.4, 40) == "2024-01-01: load 70 %; this weekday's median is 40 %"


def test_ingest(spark, tmp_path):
    from tidemark.streaming.ingest import ingest, stored

    df = spark.createDataFrame([(1, 1, 1, 1, "BUSY_TIME", 5)], CONTRACTS["osstat"])
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest(spark, "osstat", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert stored(spark, "osstat", str(tmp_path / "out")).count() == 1
