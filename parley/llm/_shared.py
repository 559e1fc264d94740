"""Helpers that the operators of this subpackage share.

``shared_dir`` names the folder that the driver and all executors can reach. It is read
from ``spark.checkpoint.dir``; only a local session (tests) falls back to a temporary
folder, because there every task runs on the driver's machine.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage or outlive a job; reachable by all executors."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="parley-shared-")
    return _FALLBACK[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, mode: str = "error") -> None:
    """Write Parquet, and let go of the shuffle files behind it: the table takes their place."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.set(CLEANUP, before)


_PATHS: dict[int, tuple[DataFrame, str]] = {}  # materialised tables that may be released, by object


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, safe to lose executors."""
    path = new_path(df.sparkSession, tag)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (out, path)
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialised tables whose last reader is done."""
    for t in tables:
        drop_path(t.sparkSession, _PATHS.pop(id(t))[1])


def last_of(steps: Callable[[], DataFrame], tag: str) -> DataFrame:
    """The written result of ``steps``; all that was materialised on the way is deleted."""
    before = set(_PATHS)
    out = materialise(steps(), tag)
    release(*(t for k, (t, _) in list(_PATHS.items()) if k not in before and t is not out))
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids have no fold (null)."""
    return F.crc32(doc_id.cast("string")) % F.lit(folds)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column of ``columns`` has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
