"""Tuning knobs: a frozen value object whose fields become literals in plans, and its stored form."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.versioned import VersionedTable


@dataclass(frozen=True)
class Config:
    """Defaults of all knobs. `replace` makes a changed copy; an unknown or missing knob is an error."""

    train_days: int = 90
    recent_days: int = 28
    min_train_days: int = 14
    r2_gate: float = 0.60
    mad_k: float = 3
    mad_window_days: int = 28
    #: Stored for compatibility only; reports go by anomaly_days.
    anomaly_report_days: int = 14
    cpu_sat_pct: float = 80
    abs_floor_bytes: int = 104_857_600
    dow_weeks: int = 8
    dtf_warn: int = 90
    dtf_crit: int = 30
    tbspc_min_hist: int = 7
    cpu_min_mad_pct: float = 3
    cpu_min_dow_hist: int = 3
    esm_prediction_step: int = 30
    # Presentation
    top_n: int = 10
    anomaly_days: int = 30
    show_esm: str = "AUTO"

    def __post_init__(self):
        for f in dataclasses.fields(self):
            value = getattr(self, f.name)
            if value is None:
                raise ValueError(f"knob {f.name} is missing")
            if f.name != "show_esm" and not isinstance(value, (int, float)):
                raise ValueError(f"knob {f.name} must be a number, not {value!r}")
        if self.show_esm.upper() not in ("AUTO", "Y", "N"):
            raise ValueError("show_esm is AUTO, Y or N")

    def replace(self, **knobs) -> Config:
        return dataclasses.replace(self, **knobs)

    def rows(self) -> list[tuple[str, float]]:
        """The stored knobs; presentation isn't stored."""
        return [(f.name, float(getattr(self, f.name))) for f in dataclasses.fields(self) if f.name not in ("top_n", "anomaly_days", "show_esm")]


SCHEMA = "cfg_name string, cfg_value double"


class ConfigStore:
    """A table of knobs at a path. Seeding adds what is missing and never overwrites."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path, SCHEMA)

    def read(self) -> DataFrame:
        return self.table.read()

    def seed(self, config: Config | None = None) -> None:
        new = self.spark.createDataFrame((config or Config()).rows(), SCHEMA)
        old = self.read()
        self.table.write(old.unionByName(new.join(old, "cfg_name", "left_anti")))

    def update(self, **knobs: float) -> None:
        known = {n for n, _ in Config().rows()}
        if bad := set(knobs) - known:
            raise ValueError(f"unknown knobs: {sorted(bad)}")
        self.table.upsert(self.spark.createDataFrame([(k, float(v)) for k, v in knobs.items()], SCHEMA), "cfg_name")

    def load(self, **presentation) -> Config:
        """The stored knobs; any that is missing is an error."""
        stored = {r["cfg_name"]: r["cfg_value"] for r in self.read().collect()}
        kinds = {f.name: f.type for f in dataclasses.fields(Config)}
        names = [n for n, _ in Config().rows()]
        if missing := [n for n in names if stored.get(n) is None]:
            raise ValueError(f"knobs missing from the store: {missing}")
        return Config(**{n: int(stored[n]) if kinds[n] == "int" else stored[n] for n in names}, **presentation)
