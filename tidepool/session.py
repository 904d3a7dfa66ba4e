"""Session builder, snapshot tables in the shared folder, and time helpers that don't depend on the session's zone."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_scratch: dict[str, str] = {}


def build_session(app: str = "tidepool", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, adaptive execution and Arrow; conf adds or overrides settings (dots written as __)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return reach_workers(b.getOrCreate())


def reach_workers(spark: SparkSession) -> SparkSession:
    """Let the Python workers import this package from where the driver did."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where that is unset, a session of one machine
    (master local) gets a folder of its own; any other raises RuntimeError, as its executors would not see that folder.

    Everything below it that this process wrote is removed at its exit.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="tidepool-")
            atexit.register(shutil.rmtree, base, True)
        _scratch[app] = f"{base.rstrip('/')}/tidepool-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; a cluster's own cleaning then applies
        if path.startswith("/") or path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: dict[tuple, str] = {}


def stamp(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """What tells one state of stored tables from another: where they are, their size and when they were written."""
    said = [sf_dir]
    for n in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{n}.parquet")
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        said.append((n, status.getLen(), status.getModificationTime()))
    return tuple(said)


def kept(spark: SparkSession, name: str, state: tuple, build: Callable[[str], object]) -> str:
    """The folder in which build(folder) left what is derived from tables of that state: made once a session, and
    again if it was removed."""
    key = (spark.sparkContext.applicationId, name, state)
    if key not in _kept or not _exists(spark, _kept[key]):
        path = fresh_path(spark, name)
        build(path)
        _kept[key] = path
    return _kept[key]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ; the session's time zone plays no part."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def month_of(us: Column) -> Column:
    """YYYY-MM of microseconds since 1970, null for null."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(us / F.lit(86_400_000_000)).cast("int"))
    return F.date_format(day, "yyyy-MM")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: Keys that are treated apart at most, and rows of a key up to which it never is: what stays together in one task is then at
#: most HOT_ROWS rows, or one part in MOST_HOT of all.
MOST_HOT, HOT_ROWS = 10_000, 200_000


def hot_keys(counts: DataFrame, key: str, n: str = "n", rows: int = HOT_ROWS) -> list:
    """The keys of counts (key, n) with more than rows rows and more than one part in MOST_HOT of all: so many at most."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return [r[0] for r in counts.filter((F.col(n) > rows) & (F.col(n) * MOST_HOT > total)).select(key).collect()]


def join_small(rows: DataFrame, small: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """rows joined with small (a row a key): rows of hot keys, which hot_keys bounds, by broadcast, the others by a shuffle."""
    if not hot:
        return rows.join(small, key, how)
    apart = F.coalesce(F.col(key).isin(hot), F.lit(False))
    return rows.filter(apart).join(F.broadcast(small.filter(F.col(key).isin(hot))), key, how).unionByName(rows.filter(~apart).join(small.filter(~F.col(key).isin(hot)), key, how))
