"""A seam over order and event tables: running sums of line items as levels, of events as counters.

All values stay whole numbers. Levels: one snapshot a ship date; one series for each line status (container) and
return flag, and synthetic ones for every grade of a fit, for excluded contents and for several samples a day.
Counters: snapshots of six hours over two instances that restart on 2024-01-15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.seams import Seam

# Fixed values of this mapping.
DBID, EVENT_DBID = 1, 2
BLOCK = 8192
EPOCH = "1995-01-01"
FLAGS = {"A": 10, "N": 11, "R": 12}
STATUS = {"O": 101, "F": 102}
RESTART = "2024-01-15 00:00:00"
NAMES = [
    # container, id, name, contents, block size
    *((DBID, con, FLAGS[f], f"LINES_{f}", "PERMANENT", None if f == "R" else BLOCK) for con in (101, 102) for f in FLAGS),
    (DBID, 101, 20, "FLAT", "PERMANENT", BLOCK),
    (DBID, 101, 21, "SHORT", "PERMANENT", BLOCK),
    (DBID, 101, 22, "NOISY", "PERMANENT", BLOCK),
    (DBID, 101, 23, "SHRINK", "PERMANENT", BLOCK),
    (DBID, 101, 30, "UNDO", "UNDO", BLOCK),
    (DBID, 101, 31, "TEMP", "TEMPORARY", BLOCK),
    (EVENT_DBID, 101, 40, "HOURLY", "PERMANENT", BLOCK),
]


def _lit(value) -> Column:
    return F.lit(value).cast("long")


def _snapshots(days: DataFrame, dbid: int, snap: Column, start: Column, end: Column, boot: Column, instance: Column) -> DataFrame:
    return days.select(
        _lit(dbid).alias("dbid"), _lit(dbid).alias("con_dbid"), instance.cast("long").alias("instance_number"), snap.cast("long").alias("snap_id"),
        start.alias("begin_interval_time"), end.alias("end_interval_time"), boot.alias("startup_time"),
    )


def tables_seam(spark: SparkSession, sf_dir: str) -> Seam:
    """Read lineitem (four columns) and events (four columns) of a folder as the six contracts."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_quantity", "l_returnflag", "l_linestatus")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "user_id", "event_type", "value")

    day = F.to_date("l_shipdate")
    per_day = lines.where(F.col("l_shipdate").isNotNull()).groupBy(day.alias("day"), "l_linestatus", "l_returnflag").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    snap = F.datediff("day", F.lit(EPOCH).cast("date"))
    all_days = per_day.groupBy("day").agg(F.sum("q").alias("q"))

    def at(hour: int) -> Column:
        return (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(hour))).cast("timestamp_ntz")

    boot = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    level_snaps = _snapshots(all_days, DBID, snap, at(22), at(23), boot, F.lit(1))

    flags = F.create_map(*(F.lit(x) for kv in FLAGS.items() for x in kv))
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    keyed = per_day.where(F.col("l_linestatus").isin(*STATUS) & F.col("l_returnflag").isin(*FLAGS)).select(
        status[F.col("l_linestatus")].alias("con"), flags[F.col("l_returnflag")].alias("ts"), "day", "q"
    )
    w = W.partitionBy("con", "ts").orderBy("day")
    series = keyed.withColumn("used", F.sum("q").over(w)).withColumn("final", F.max("used").over(W.partitionBy("con", "ts")))
    limit = F.when(F.col("ts") == FLAGS["R"], 0).otherwise(2 * F.col("final"))

    def usage(df: DataFrame, dbid: int, con: Column, ts: Column, used: Column, limit: Column, snap_id: Column) -> DataFrame:
        return df.select(
            _lit(dbid).alias("dbid"), con.cast("long").alias("con_dbid"), snap_id.cast("long").alias("snap_id"), ts.cast("long").alias("tablespace_id"),
            used.cast("long").alias("tablespace_size"), limit.cast("long").alias("tablespace_maxsize"), used.cast("long").alias("tablespace_usedsize"),
        )

    real = usage(series, DBID, F.col("con"), F.col("ts"), F.col("used"), limit, snap)
    whole = W.orderBy("day").rowsBetween(W.unboundedPreceding, W.currentRow)
    # One row a day: a few thousand at any scale factor.
    totals = all_days.select("*", F.sum("q").over(whole).alias("run"), F.sum("q").over(W.partitionBy()).alias("total"), F.row_number().over(W.orderBy(F.desc("day"))).alias("back"))
    zero = F.lit(0)
    made = {
        20: F.lit(5000),
        21: F.when(F.col("back") <= 10, 1000 + F.col("run")),
        22: F.col("q"),
        23: F.col("total") - F.col("run"),
        30: F.col("run"),
        31: F.col("run"),
    }
    # All in one pass over the days.
    pairs = F.explode(F.array(*(F.struct(F.lit(ts).alias("ts"), used.cast("long").alias("used")) for ts, used in made.items()))).alias("p")
    synthetic = totals.select("day", pairs).select("day", "p.ts", "p.used").where("used IS NOT NULL")
    synthetic = usage(synthetic, DBID, F.lit(101), F.col("ts"), F.col("used"), zero, snap)

    units = F.round(F.col("value") * 100).cast("long")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    hourly = events.where("ts is not null").groupBy(hour.alias("hour")).agg(F.sum(F.abs(units)).alias("q"))
    hourly = hourly.withColumn("used", F.sum("q").over(W.orderBy("hour")))
    seconds = F.unix_seconds(F.col("hour").cast("timestamp"))
    hour_id = F.floor(seconds / 3600)
    hour_snaps = _snapshots(hourly, EVENT_DBID, 1_000_000 + hour_id, F.col("hour"), F.col("hour") + F.make_dt_interval(F.lit(0), F.lit(1)), boot, F.lit(1))
    hourly_usage = usage(hourly, EVENT_DBID, F.lit(101), F.lit(40), F.col("used"), zero, 1_000_000 + hour_id)
    usages = real.unionByName(synthetic).unionByName(hourly_usage)

    six = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600)
    restart = F.lit(RESTART).cast("timestamp_ntz")
    kind = F.col("event_type")
    amounts = (
        events.where("ts is not null")
        .select(six.alias("snap_id"), (F.pmod("user_id", F.lit(2)) + 1).alias("instance_number"), (F.col("ts") >= restart).cast("int").alias("era"), kind.alias("kind"), F.abs(units).alias("u"))
        .groupBy("snap_id", "instance_number", "era")
        .agg(
            *(
                F.sum(F.when(cond, F.col("u")).otherwise(0)).alias(name)
                for name, cond in {
                    "busy": F.col("kind").isin("purchase", "click"),
                    "idle": ~F.col("kind").isin("purchase", "click"),
                    "db_cpu": F.col("kind") == "purchase",
                    "db_time": F.col("kind").isin("purchase", "view"),
                    "bg": F.col("kind") == "error",
                }.items()
            )
        )
    )
    run = W.partitionBy("instance_number", "era").orderBy("snap_id")
    counters = amounts.select("snap_id", "instance_number", "era", *(F.sum(c).over(run).alias(c) for c in ("busy", "idle", "db_cpu", "db_time", "bg")))
    begin = F.timestamp_seconds(F.col("snap_id") * 21600).cast("timestamp_ntz")
    booted = F.when(F.col("era") == 1, restart).otherwise(F.lit("2023-12-01 00:00:00").cast("timestamp_ntz"))
    event_snaps = _snapshots(counters, EVENT_DBID, F.col("snap_id"), begin, begin + F.make_dt_interval(F.lit(0), F.lit(5), F.lit(59)), booted, F.col("instance_number"))

    def stats(named: dict[str, Column]) -> DataFrame:
        pairs = F.explode(F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v.cast("long"))))).alias("stat_name", "value")
        rows = counters.select(_lit(EVENT_DBID).alias("dbid"), _lit(101).alias("con_dbid"), F.col("instance_number").cast("long").alias("instance_number"), F.col("snap_id").cast("long").alias("snap_id"), pairs)
        return rows.where("value is not null")

    cores = F.when(F.col("instance_number") == 1, 2)
    dim = spark.createDataFrame(NAMES, "dbid long, con_dbid long, tablespace_id long, tablespace_name string, contents string, block_size long")
    return Seam(
        snapshot=level_snaps.unionByName(hour_snaps).unionByName(event_snaps),
        tbspc_usage=usages,
        tablespace=dim,
        datafile=dim.select("dbid", "con_dbid", "tablespace_id", F.lit(BLOCK).cast("long").alias("block_size")),
        osstat=stats({"BUSY_TIME": F.col("busy"), "IDLE_TIME": F.col("idle"), "NUM_CPUS": F.lit(4), "NUM_CPU_CORES": cores}),
        time_model=stats({"DB CPU": F.col("db_cpu"), "DB time": F.col("db_time"), "background cpu time": F.col("bg")}),
    )
