"""The HTML dashboard: one page without outside resources, rendered from a bounded number of collected relations."""

from __future__ import annotations

from collections import defaultdict

from tidemark.plans.reports import Reports
from tidemark.render import parts as p
from tidemark.render.text import Identity

CSS = """
:root{color-scheme:light dark;--bg:#fff;--fg:#1c2430;--muted:#6b7686;--line:#dfe4ea;--ok:#1f8a4c;--warn:#b7791f;--crit:#c53030;--a:#2563a8;--b:#8a5cc2}
@media (prefers-color-scheme:dark){:root{--bg:#12161c;--fg:#e4e9f0;--muted:#93a0b0;--line:#2c3440;--ok:#4cc384;--warn:#e0a94a;--crit:#f27272;--a:#6aa8ee;--b:#b795ea}}
body{margin:0 auto;max-width:1180px;padding:16px;background:var(--bg);color:var(--fg);font:14px/1.5 system-ui,sans-serif}
nav a{margin-right:12px}table{border-collapse:collapse;width:100%}th,td{padding:4px 8px;border-bottom:1px solid var(--line);text-align:left}td.n{text-align:right}
.cards{display:grid;grid-template-columns:repeat(auto-fit,minmax(420px,1fr));gap:12px}.card,.glance{border:1px solid var(--line);border-radius:8px;padding:10px}
.glance.ok{border-color:var(--ok)}.glance.warn{border-color:var(--warn)}.glance.crit{border-color:var(--crit)}.muted{color:var(--muted)}
.pill{border:1px solid;border-radius:9px;padding:0 7px;font-size:12px}.ok{color:var(--ok)}.warn{color:var(--warn)}.crit{color:var(--crit)}
.strips{display:grid;grid-template-columns:max-content 1fr;gap:6px 14px}.strips dd{margin:0}.strip{position:relative;height:18px;border-bottom:1px solid var(--line);background:repeating-linear-gradient(to left,var(--line) 0 1px,transparent 1px var(--week))}
.strip i{position:absolute;bottom:3px;width:10px;height:10px;margin-left:-5px;border-radius:50%;background:var(--crit)}
.bar{display:inline-block;width:80px;height:8px;background:var(--line)}.fill{display:block;height:8px;background:currentColor}
svg{width:100%}.grid,.lane{stroke:var(--line)}.tick{fill:var(--muted);font-size:10px}.history,.projection{fill:none;stroke:var(--a);stroke-width:2}.projection{stroke-dasharray:5 4}
circle.history{fill:var(--a)}.limit,circle.mark{stroke:var(--crit)}.limit{stroke-dasharray:2 3}circle.mark{fill:var(--crit)}.bounds{stroke:var(--b)}circle.esm{fill:var(--b)}.key{margin-right:12px;font-size:12px}
"""

GLOSSARY = {
    "Days to full": "Current distance to the limit divided by the growth a day of the fitted line.",
    "R2": "The share of the variation that the fitted line explains; the grade depends on it.",
    "Acceleration": "Recent growth divided by growth over the whole training window.",
    "Robust z": "The deviation from the median in units of the median absolute deviation.",
    "Smoothing": "A second forecast by exponential smoothing, 30 days ahead, with 95 % bounds.",
}


def _table(heads: list[str], rows: list[list[str]], empty: str) -> str:
    if not rows:
        return f'<p class="muted">{p.esc(empty)}</p>'
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    head = "".join(f"<th>{p.esc(h)}{p.info_icon(GLOSSARY[h]) if h in GLOSSARY else ''}</th>" for h in heads)
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"


def count_of(n: int, thing: str) -> str:
    return f"{n} {thing}{'' if n == 1 else 's'}"


def banner(alerts: list, unusual: int, config, many: bool) -> str:
    """The state of everything: which limits are expected inside the warning window, soonest first."""
    limits = {"TBSPC": "its size limit", "DATABASE": "the sum of all limits", "CPU": f"{config.cpu_sat_pct:g} % load"}
    lead = f"{count_of(len(alerts), 'limit') if alerts else 'No limit'} expected to be met within {config.dtf_warn} days."
    rows = []
    for a in sorted(alerts, key=lambda a: (a["days"], -a["severity"], a["kind"], a["label"], a["con_dbid"])):
        container = f" [{a['con_dbid']}]" if many and a["kind"] != "TBSPC" else ""
        rows.append([p.esc(a["label"]) + container, limits[a["kind"]], p.time_phrase(a["days"])])
    state = ("ok", "warn", "crit")[max((a["severity"] for a in alerts), default=0)]
    aside = f"<p>{count_of(unusual, 'flagged day')} since {config.anomaly_days} days before the newest one.</p>" if unusual else ""
    return f'<div class="glance {state}"><p>{lead}</p>{_table(["Series", "Limit", "Expected"], rows, "") if rows else ""}{aside}</div>'


def timeline(lanes: list, points: list, bounds) -> str:
    """A strip of days for each series, with flagged days as dots at their share of the window."""
    if not bounds or bounds["max_day"] is None:
        return '<p class="muted">There are no days to look at.</p>'
    if not lanes:
        return '<p class="muted">No day in this window is flagged.</p>'
    first, days = bounds["min_day"], (bounds["max_day"] - bounds["min_day"]).days
    flagged = defaultdict(list)
    for q in points:
        note = p.growth_note(q["day_dt"], q["used_delta_bytes"], q["used_rate_bpd"], q["median_rate_bpd"]) if q["kind"] == "TBSPC" else p.busy_note(q["day_dt"], q["busy_pct"], q["median_pct"])
        flagged[q["kind"], q["dbid"], q["con_dbid"], q["label"]].append(((q["day_dt"] - first).days / max(1, days), note))
    strips = ""
    for row in lanes:
        dots = "".join(f'<i style="left:{share:.1%}" title="{p.esc(note)}"></i>' for share, note in sorted(flagged[row["kind"], row["dbid"], row["con_dbid"], row["label"]]))
        strips += f'<dt>{p.esc(row["label"])}</dt><dd class="strip">{dots}</dd>'
    rest = lanes[0]["n_lanes"] - len(lanes)
    hidden = f'<p class="muted">{rest} further series with flagged days left out.</p>' if rest > 0 else ""
    return f'<dl class="strips" style="--week:{700 / max(1, days):.3f}%">{strips}</dl><p class="muted">{first} to {bounds["max_day"]}; a line a week.</p>{hidden}'


def render(reports: Reports, who: Identity) -> str:
    """Sections 0 to 6. Each relation is collected once; charts are grouped here, not queried one by one."""
    c = reports.config
    ok = reports.ok_models()
    alerts, unusual = reports.alerts().collect(), reports.unusual_days().collect()[0]["n_unusual"]
    whole, filled = reports.total_fit().orderBy("dbid", "con_dbid").collect(), defaultdict(list)
    for r in reports.total_filled().orderBy("day_dt").collect():
        filled[r["dbid"], r["con_dbid"]].append((r["day_dt"], r["all_bytes"] / 2**30))
    heroes = reports.cpu_heroes().orderBy("dbid", "con_dbid").collect()
    lanes, points = reports.timeline_lanes().collect(), reports.timeline_points().collect()
    bounds = reports.timeline_bounds().collect()
    cards, rollup = reports.prediction_cards().collect(), reports.quality_rollup().collect()[0]
    dominant = reports.dominant_quality().collect()
    forecast = reports.forecast_table().collect()
    chosen, history = reports.chart_series().collect(), defaultdict(list)
    for r in reports.chart_history().collect():
        history[r["dbid"], r["con_dbid"], r["tablespace_name"]].append(r)
    ends = {(r["dbid"], r["con_dbid"], r["tablespace_name"]): (r["end_day"], r["end_gb"]) for r in reports.chart_projection().collect()}
    esm = {(r["dbid"], r["con_dbid"], r["series_key"]): r for r in reports.chart_esm().collect()} if reports.shows_esm(ok) else {}
    totals_end = {(r["dbid"], r["con_dbid"]): (r["end_day"], r["end_gb"]) for r in reports.total_projection().collect()}
    cpu_end = {(r["dbid"], r["con_dbid"], r["metric"]): (r["end_day"], r["end_val"]) for r in reports.cpu_projection().collect()}
    trend, busy_days = reports.cpu_trend_table().collect(), reports.cpu_anomalies().collect()
    growth = reports.tbspc_anomalies().collect()
    cpu = defaultdict(list)
    for r in reports.cpu_history().collect():
        cpu[r["dbid"], r["con_dbid"]].append(r)
    many = reports.container_count().collect()[0]["n_containers"] > 1
    name = lambda r, label: label + (f" (con_dbid {r['con_dbid']})" if many else "")

    out = [f"<h2 id='s0'>At a glance</h2>{banner(alerts, unusual, c, many)}<div class='cards'>"]
    for r in whole:
        end = totals_end.get((r["dbid"], r["con_dbid"]))
        limit = r["cur_limit"] / 2**30 if r["limit_all"] == 1 else None
        out.append(p.chart(name(r, "Whole database"), filled[r["dbid"], r["con_dbid"]], projection=end, limit=limit))
        reach = f", limit in {p.time_phrase(r['days_to_limit'])}" if r["days_to_limit"] is not None else ""
        out.append(f"<div class='card'><h4>{p.size_phrase(r['cur_used'] / 2**30)} {p.quality_pill(r['quality'])}</h4><p>{p.bar(p.pct_of(r['cur_used'], r['cur_limit'] if limit else None))}{reach}</p></div>")
    for r in heroes:
        days = f", {c.cpu_sat_pct:g}% in {p.time_phrase(r['days_to_sat'])}" if r["days_to_sat"] is not None else ""
        out.append(f"<div class='card'><h4>{name(r, 'Host CPU')}: {p.nz(r['cur_val'], 1)}% busy {p.quality_pill(r['quality'])}</h4><p>{p.bar(p.pct_of(r['cur_val'], 100), p.cpu_bar_class(r['cur_val'], c.cpu_sat_pct))} {r['headline']}{days}</p></div>")
    out.append(f"</div><h3>Unusual days, last {c.anomaly_days} days</h3>{timeline(lanes, points, bounds[0] if bounds else None)}")
    if cards:
        out.append("<div class='cards'>" + "".join(f"<div class='card'><h4>{p.esc(r['tablespace_name'])} {p.sev_pill(r['sev'])}</h4><p>Full in {p.time_phrase(r['days_to_full'])}, with {r['confidence']} confidence.</p></div>" for r in cards) + "</div>")
    else:
        out.append(f"<p class='muted'>No reliable prediction; most series are {p.esc(dominant[0]['quality']) if dominant else 'empty'}.</p>")
    out.append(f"<p class='muted'>Not predicted: {rollup['n_flat']} flat, {rollup['n_low']} of low confidence, {rollup['n_short']} with too little history.</p>")

    out.append("<h2 id='s1'>1. Days to full</h2>" + _table(["Tablespace", "Used", "Limit", "MB a day", "Days", "Severity", "Acceleration"], [[p.esc(name(r, r["tablespace_name"])), p.size_phrase(r["cur_gb"]), p.size_phrase(r["limit_gb"]), p.nz(r["slope_mb"], 3), str(r["days_to_full"]), p.sev_pill(r["sev"]), p.nz(r["accel"])] for r in cards], "No tablespace is reliably filling up."))
    out.append("<h2 id='s2'>2. Forecast</h2>" + _table(["Tablespace", "Days", "Now", "+30", "+90", "+180", "R2", "Quality", "Smoothing +30"], [[p.esc(name(r, r["tablespace_name"])), str(r["n"]), *(p.size_phrase(r[k]) for k in ("cur_gb", "p30", "p90", "p180")), p.nz(r["r2"], 3), p.quality_pill(r["quality"]), p.size_phrase(r["esm30"])] for r in forecast], "No series."))
    out.append("<div class='cards'>")
    for r in chosen:
        key = (r["dbid"], r["con_dbid"], r["tablespace_name"])
        rows = history[key]
        marks = [(h["day_dt"], h["used_gb"], f"{h['day_dt']}: {h['anomaly_flag']}") for h in rows if h["anomaly_flag"]]
        point = esm.get(key)
        fresh = None
        if point:
            fresh = (r["last_day"].fromordinal(r["last_day"].toordinal() + 30), *(point[k] / 2**30 for k in ("value", "lower_bound", "upper_bound")))
        out.append(p.chart(name(r, r["tablespace_name"]), [(h["day_dt"], h["used_gb"]) for h in rows], projection=ends.get(key), limit=r["limit_bytes"] / 2**30 if r["limit_bytes"] else None, marks=marks, esm=fresh))
    hidden = (chosen[0]["n_series"] - len(chosen)) if chosen else 0
    out.append("</div>" + (f"<p class='muted'>{hidden} more series aren't charted.</p>" if hidden > 0 else ""))
    out.append(f"<h2 id='s3'>3. Growth anomalies</h2>" + _table(["Tablespace", "Day", "Gap", "MB", "MB a day", "Median", "Threshold", "Robust z", "Flag"], [[p.esc(name(r, r["tablespace_name"])), str(r["day_dt"]), str(r["gap"]), *(p.nz(r[k], 1) for k in ("delta_mb", "rate_mb", "med_mb", "thr_mb", "z")), p.esc(r["anomaly_flag"])] for r in growth], "No unusual growth."))
    out.append("<h2 id='s4'>4. CPU trend</h2>" + _table(["Container", "Metric", "Days", "Now", "Slope a day", "R2", "Days to saturation", "Quality"], [[str(r["con_dbid"]), p.esc(r["metric"]), str(r["n"]), p.nz(r["cur_val"]), p.nz(r["slope_day"], 4), p.nz(r["r2"], 3), p.nz(r["days_sat"], 0), p.quality_pill(r["quality"])] for r in trend], "No CPU history." if reports.has_cpu() else "The source has no host or time statistics."))
    out.append("<div class='cards'>")
    for key, rows in sorted(cpu.items()):
        for metric, column, unit in (("BUSY_PCT", "busy_pct", "%"), ("DB_CPU_SEC", "db_cpu_sec", "s")):
            line = [(r["day_dt"], r[column]) for r in rows if r[column] is not None]
            end = cpu_end.get((*key, metric))
            marks = [(r["day_dt"], r[column], f"{r['day_dt']}: {r['anomaly_flag']}") for r in rows if r["anomaly_flag"] and metric == "BUSY_PCT"]
            out.append(p.chart(f"{metric} ({key[0]}/{key[1]})", line, projection=end, limit=c.cpu_sat_pct if metric == "BUSY_PCT" else None, marks=marks, unit=unit))
    out.append("</div><h2 id='s5'>5. CPU anomalies</h2>" + _table(["Container", "Day", "Busy %", "Median %", "Threshold %", "Robust z", "Flag"], [[str(r["con_dbid"]), str(r["day_dt"]), *(p.nz(r[k]) for k in ("busy_pct", "median_pct", "threshold_pct", "z")), p.esc(r["anomaly_flag"])] for r in busy_days], "No unusual CPU days."))
    out.append("<h2 id='s6'>6. Smoothing against regression</h2>")
    if reports.shows_esm(ok):
        for kind, digits in (("TBSPC", 2), ("CPU", 2)):
            out.append(_table(["Container", "Series", "Horizon", "Regression", "Smoothing", "Low", "High"], [[str(r["con_dbid"]), p.esc(r["series_key"]), f"+{r['h']}", *(p.nz(r[k], digits) for k in ("regr", "esm", "esm_lo", "esm_hi"))] for r in reports.compare_table(kind).collect()], "Nothing to compare."))
    else:
        out.append("<p class='muted'>Skipped: show_esm is N, or AUTO with no trained models.</p>")
    glossary = "".join(f"<dt>{p.esc(k)}</dt><dd>{p.esc(v)}</dd>" for k, v in GLOSSARY.items())
    nav = "".join(f"<a href='#s{i}'>{t}</a>" for i, t in enumerate(("Glance", "Full", "Forecast", "Growth", "CPU", "CPU days", "Smoothing")))
    head = f"<h1>Capacity report: {p.esc(who.label)}</h1><p class='muted'>Host {p.esc(who.host)}, schema {p.esc(who.user)}, {who.as_of:%Y-%m-%d %H:%M:%S}; warning within {c.dtf_warn} days, critical within {c.dtf_crit}; {ok} smoothing model(s).</p><nav>{nav}</nav>"
    foot = f"<h2>Glossary</h2><dl>{glossary}</dl><footer class='muted'>Read only: nothing was created or modified.</footer>"
    return f"<!doctype html><html lang='en'><head><meta charset='utf-8'><meta name='viewport' content='width=device-width'><title>Capacity report: {p.esc(who.label)}</title><style>{CSS}</style></head><body>{head}{''.join(out)}{foot}</body></html>"
