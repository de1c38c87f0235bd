"""The six source contracts that every analysis is written against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_L, _S, _TS = T.LongType(), T.StringType(), T.TimestampNTZType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


SNAPSHOT = _struct(dbid=_L, con_dbid=_L, instance_number=_L, snap_id=_L, begin_interval_time=_TS, end_interval_time=_TS, startup_time=_TS)
TBSPC_USAGE = _struct(dbid=_L, con_dbid=_L, snap_id=_L, tablespace_id=_L, tablespace_size=_L, tablespace_maxsize=_L, tablespace_usedsize=_L)
TABLESPACE = _struct(dbid=_L, con_dbid=_L, tablespace_id=_L, tablespace_name=_S, contents=_S, block_size=_L)
DATAFILE = _struct(dbid=_L, con_dbid=_L, tablespace_id=_L, block_size=_L)
OSSTAT = _struct(dbid=_L, con_dbid=_L, instance_number=_L, snap_id=_L, stat_name=_S, value=_L)
TIME_MODEL = OSSTAT

CONTRACTS = {
    "snapshot": SNAPSHOT,
    "tbspc_usage": TBSPC_USAGE,
    "tablespace": TABLESPACE,
    "datafile": DATAFILE,
    "osstat": OSSTAT,
    "time_model": TIME_MODEL,
}

# The statistics that the analyses use.
OSSTAT_NAMES = ["BUSY_TIME", "IDLE_TIME", "IOWAIT_TIME", "NUM_CPUS", "NUM_CPU_CORES", "PHYSICAL_MEMORY_BYTES"]
TIME_MODEL_NAMES = ["DB CPU", "DB time", "background cpu time"]


def validate(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the contract's columns, in its order and types; an error names every column that lacks or differs.

    Numeric columns may be any whole or decimal type and are cast; timestamps may be with or without zone.
    """
    have = {f.name.lower(): f.dataType for f in df.schema.fields}
    problems, columns = [], []
    for want in CONTRACTS[name].fields:
        kind = have.get(want.name)
        fits = kind is not None and (
            kind == want.dataType
            or (isinstance(want.dataType, T.LongType) and isinstance(kind, (T.IntegralType, T.DecimalType)))
            or (isinstance(want.dataType, T.TimestampNTZType) and isinstance(kind, (T.TimestampType, T.DateType)))
        )
        if not fits:
            problems.append(f"{want.name}: {kind.simpleString() if kind else 'missing'}, not {want.dataType.simpleString()}")
        else:
            columns.append(df[want.name].cast(want.dataType).alias(want.name))
    if problems:
        raise ValueError(f"{name} breaks its contract: " + "; ".join(problems))
    return df.select(*columns)
