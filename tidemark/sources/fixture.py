"""A deterministic fixture: 121 days of known series with closed-form answers, for a given anchor date."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.seams import Seam

# Fixed values of the fixture.
DBID = 42424242
DAYS = 121
RESTART, SPIKE = 60, 110
BLOCK = 8192
CENTISECONDS = 34_560_000
LIMIT_BLOCKS = 6_553_600
GAP_DAYS = (100, 101, 102)


def weekday(day: dt.date) -> int:
    """0 is Monday."""
    return (day - dt.date(2020, 1, 6)).days % 7


class Fixture:
    """The six tables for an anchor (the last snapshot's date), and what the analyses must answer."""

    def __init__(self, spark: SparkSession, anchor: dt.date):
        self.spark, self.base = spark, anchor - dt.timedelta(days=DAYS - 1)
        days = [self.base + dt.timedelta(days=i) for i in range(DAYS)]
        self.injected = max(i for i in range(90, DAYS) if weekday(days[i]) == 1)
        self.probe = max(i for i in range(61, 120) if weekday(days[i]) < 5 and i != self.injected)
        self.days = days

    def _range(self) -> DataFrame:
        return self.spark.range(DAYS).withColumnRenamed("id", "i")

    def _at(self, day: Column, hour: int) -> Column:
        base = F.lit(self.base.isoformat()).cast("timestamp_ntz")
        return (base + F.make_dt_interval(day.cast("int"), F.lit(hour))).cast("timestamp_ntz")

    def seam(self) -> Seam:
        i = F.col("i")
        ids = [F.lit(DBID).cast("long").alias("dbid"), F.lit(DBID).cast("long").alias("con_dbid")]
        snap = (1000 + i).alias("snap_id")
        one = F.lit(1).cast("long").alias("instance_number")
        snapshot = self._range().select(
            *ids, one, snap, self._at(i, 22).alias("begin_interval_time"), self._at(i, 23).alias("end_interval_time"),
            F.when(i < RESTART, self._at(F.lit(-5), 0)).otherwise(self._at(F.lit(RESTART), 0)).alias("startup_time"),
        )
        levels = {
            10: (1280 * i + 12800, F.lit(LIMIT_BLOCKS)),
            11: (640 * i + 6400 + F.when(i >= SPIKE, 262144).otherwise(0), F.lit(LIMIT_BLOCKS)),
            12: (F.lit(51200), F.lit(0)),
            13: (7680 * i + 6400, F.lit(LIMIT_BLOCKS)),
        }
        usage = None
        for ts, (used, limit) in levels.items():
            rows = self._range().where(~i.isin(*GAP_DAYS)) if ts == 13 else self._range()
            rows = rows.select(
                *ids, snap, F.lit(ts).cast("long").alias("tablespace_id"), used.cast("long").alias("tablespace_size"),
                limit.cast("long").alias("tablespace_maxsize"), used.cast("long").alias("tablespace_usedsize"),
            )
            usage = rows if usage is None else usage.unionByName(rows)
        names = [(10, "FIX_LINEAR"), (11, "FIX_SPIKE"), (12, "FIX_FLAT"), (13, "FIX_GAP")]
        tablespace = self.spark.createDataFrame(
            [(DBID, DBID, ts, name, "PERMANENT", BLOCK) for ts, name in names],
            "dbid long, con_dbid long, tablespace_id long, tablespace_name string, contents string, block_size long",
        )
        datafile = tablespace.select("dbid", "con_dbid", "tablespace_id", "block_size")
        day = F.date_add(F.lit(self.base.isoformat()).cast("date"), i.cast("int"))
        week = F.pmod(F.datediff(day, F.lit("2020-01-06").cast("date")), F.lit(7))
        # Tenths, so that running sums stay whole.
        busy = F.when(i == self.injected, 7).when(week >= 5, 2).otherwise(4)
        w = W.partitionBy(i >= RESTART).orderBy("i")
        run = self._range().withColumn("b", F.sum(busy).over(w)).withColumn("n", F.count("*").over(w))
        b, n = F.col("b"), F.col("n")

        def stats(named: dict[str, Column]) -> DataFrame:
            pairs = F.explode(F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v.cast("long"))))).alias("stat_name", "value")
            return run.select(*ids, one, snap, pairs)

        osstat = stats({"BUSY_TIME": b * (CENTISECONDS // 10), "IDLE_TIME": (10 * n - b) * (CENTISECONDS // 10), "NUM_CPUS": F.lit(4), "NUM_CPU_CORES": F.lit(4)})
        model = stats({"DB CPU": b * 100_000_000, "DB time": b * 120_000_000, "background cpu time": n * 50_000_000})
        return Seam(snapshot, usage, tablespace, datafile, osstat, model)

    def expected(self) -> dict[str, float | str | dt.date]:
        """Answers that are stored, not derived."""
        return {
            "LINEAR_SLOPE": 10_485_760.0,
            "LINEAR_DAYS_TO_FULL": 4990,
            "LINEAR_CUR_USED": 1_363_148_800,
            "LINEAR_LIMIT": 53_687_091_200,
            "LINEAR_PLUS_30": 1_677_721_600.0,
            "SPIKE_DAY": self.days[SPIKE],
            "INJECTED_DAY": self.days[self.injected],
            "PROBE_DAY": self.days[self.probe],
            "RESTART_DAY": self.days[RESTART],
            "GAP_MAX": 4,
        }
