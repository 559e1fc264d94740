"""Readers and writers of messages, threads, golden sets, labelled sets and logs."""

from __future__ import annotations

import json
import warnings
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.schemas import GOLDEN, RAW_MESSAGE, THREAD


def read_messages(spark: SparkSession, path: str, rename: dict[str, str] | None = None) -> DataFrame:
    """CSV messages, every column text, with ``ordinal``, which follows the order of the file.

    A missing file raises. Quoted line breaks are part of a text.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    raw = raw.withColumnsRenamed({v: k for k, v in rename.items()}) if rename else raw
    names = [c.split()[0] for c in RAW_MESSAGE.split(", ")]
    rows = raw.select(*(F.col(n).cast("string") if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names))
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_threads(threads: DataFrame, path: str) -> None:
    threads.select("thread_id", "tweets", "terminal").write.mode("overwrite").json(path)


def read_threads(spark: SparkSession, path: str) -> DataFrame:
    """Threads as JSON lines; blank lines are skipped, a bad line raises."""
    return spark.read.schema(THREAD).option("mode", "FAILFAST").json(path)


def run_stage(spark: SparkSession, source: str, target: str, stage) -> int:
    """threads -> ``stage`` -> JSON lines; how many rows were written."""
    stage(read_threads(spark, source)).write.mode("overwrite").json(target)
    return spark.read.text(target).count()


def read_golden(spark: SparkSession, path: str, least: int = 150, most: int = 250) -> DataFrame:
    """A golden set of a .json list, a .json object with ``examples``, or .jsonl. Too few rows raise, too many warn."""
    suffix = Path(path).suffix
    if suffix == ".jsonl":
        rows = spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)
    elif suffix == ".json":
        whole = spark.read.option("wholetext", True).text(path)
        listed = f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in _columns(GOLDEN))}>>"
        items = F.when(F.trim("value").startswith("["), F.from_json("value", listed)).otherwise(F.from_json("value", f"struct<examples:{listed}>")["examples"])
        rows = whole.select(F.inline(items))
    else:
        raise ValueError(f"unknown golden set format {suffix}")
    n = rows.count()
    if n < least:
        raise ValueError(f"{n} golden examples, at least {least} are needed")
    if n > most:
        warnings.warn(f"{n} golden examples, over {most}", stacklevel=2)
    return rows


def _columns(ddl: str) -> list[str]:
    """Columns of a DDL string; commas inside angle brackets don't separate."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]


def read_labelled(spark: SparkSession, path: str, text: str = "text", label: str = "label") -> DataFrame:
    """A labelled set (text, label) from a local Parquet or CSV copy."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label"))


def append_log(df: DataFrame, path: str, only: str | None = None) -> None:
    """Append JSON lines; a failed write is told and swallowed. ``only`` keeps the rows that it is true for."""
    try:
        (df.where(only) if only else df).write.mode("append").json(path)
    except Exception as e:  # a log must not end the work it is about
        warnings.warn(f"log {path}: {e}", stacklevel=2)


def log_escalations(decisions: DataFrame, path: str) -> None:
    append_log(decisions, path, "bypassed")


def write_report(report: dict[str, Any], path: str) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(report, indent=2, default=str), "utf-8")


def first_text(df: DataFrame, names: list[str], alias: str = "text") -> DataFrame:
    """The first of the columns that holds more than blanks."""
    there = [c for c in names if c in df.columns]
    value = F.coalesce(*(F.when(F.trim(F.col(c)) != "", F.col(c)) for c in there)) if there else F.lit(None).cast("string")
    return df.withColumn(alias, value)
