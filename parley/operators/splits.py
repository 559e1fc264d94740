"""Stratified splits and samples. Order within a stratum is by a hash of the key, so membership is stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def _numbered(rows: DataFrame, key: str, label: str, seed: str) -> DataFrame:
    """Rows plus _n, the size of their class, and _i, their place in it.

    A class is numbered in 4096 even groups, the first digits of the hash that orders it; one row a group gives the places before it.
    """
    tagged = rows.withColumn("_g", F.substring(_order(key, seed), 1, 3))
    groups = tagged.groupBy(F.col(label).alias("_of"), F.col("_g").alias("_at")).agg(F.count("*").alias("_m"))
    w = W.partitionBy("_of")
    before = F.coalesce(F.sum("_m").over(w.orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select("_of", "_at", F.sum("_m").over(w).alias("_n"), before.alias("_before"))
    nth = F.row_number().over(W.partitionBy(label, "_g").orderBy(_order(key, seed), key))
    placed = tagged.withColumn("_i", nth).join(groups, F.col(label).eqNullSafe(F.col("_of")) & F.col("_g").eqNullSafe(F.col("_at")))
    return placed.withColumn("_i", F.col("_i") + F.col("_before")).drop("_g", "_of", "_at", "_before")


def split(rows: DataFrame, key: str, label: str, share: float = 0.2, seed: str = "42") -> DataFrame:
    """Rows plus split: train or val. Each class of two or more has both; a single row trains."""
    val = F.when(F.col("_n") == 1, 0).otherwise(F.greatest(F.lit(1), F.least(F.col("_n") - 1, F.bround(F.col("_n") * share).cast("long"))))
    return _numbered(rows, key, label, seed).withColumn("split", F.when(F.col("_i") <= val, "val").otherwise("train")).drop("_n", "_i")


def split3(rows: DataFrame, key: str, label: str, val: float = 0.15, test: float = 0.15, seed: str = "42") -> DataFrame:
    """Rows plus split: train, val or test; a class of two has no test row, one of three or more has all."""
    n = F.col("_n")
    nv = F.when(n == 1, 0).when(n == 2, 1).otherwise(F.greatest(F.lit(1), F.bround(n * val).cast("long")))
    nt = F.when(n < 3, 0).otherwise(F.greatest(F.lit(1), F.bround(n * test).cast("long")))
    nt = F.least(nt, F.greatest(n - 1 - nv, F.lit(0)))
    return _numbered(rows, key, label, seed).withColumn("split", F.when(F.col("_i") <= nv, "val").when(F.col("_i") <= nv + nt, "test").otherwise("train")).drop("_n", "_i")


def allocate(sizes: dict[str, int], target: int) -> dict[str, int]:
    """Seats of each stratum: proportional, at least one, at most its size; the largest strata give or take the difference."""
    total = sum(sizes.values())
    if total <= target:
        return dict(sizes)
    seats = {k: max(1, min(n, round(n / total * target))) for k, n in sizes.items() if n}
    largest = sorted(seats, key=lambda k: -sizes[k])
    step = -1 if sum(seats.values()) > target else 1
    moved = True
    while sum(seats.values()) != target and moved:
        moved = False
        for k in largest:
            if sum(seats.values()) == target:
                break
            if (step < 0 and seats[k] > 1) or (step > 0 and seats[k] < sizes[k]):
                seats[k] += step
                moved = True
    return seats


def sample(rows: DataFrame, key: str, label: str, target: int, seed: str = "42") -> DataFrame:
    """About ``target`` rows, strata in proportion. A stratum is a label: one row each reaches the driver."""
    tagged = rows.withColumn("_s", F.coalesce(F.col(label).cast("string"), F.lit("unknown")))
    sizes = {r["_s"]: r["n"] for r in tagged.groupBy("_s").agg(F.count("*").alias("n")).orderBy("_s").collect()}
    seats = allocate(sizes, target)
    if not seats:
        return rows
    m = F.create_map(*(F.lit(x) for kv in seats.items() for x in kv))
    nth = F.row_number().over(W.partitionBy("_s").orderBy(_order(key, seed), key))
    return tagged.withColumn("_i", nth).where(F.col("_i") <= F.try_element_at(m, F.col("_s"))).drop("_s", "_i")


def merge_sparse(rows: DataFrame, label: str, least: int, other: str = "Other") -> DataFrame:
    """Labels with fewer than ``least`` rows become ``other``."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    return rows.join(counts.withColumnRenamed(label, "_l"), F.col(label).eqNullSafe(F.col("_l"))).withColumn(label, F.when(F.col("_n") < least, other).otherwise(F.col(label))).drop("_n", "_l")


def pure(rows: DataFrame, label: str, probability: str, least: float = 0.7, unclassified: str = "Unclassified") -> DataFrame:
    return rows.where(~F.col(label).cast("string").isin(unclassified, "-1") & (F.col(probability) >= least))


def require_classes(rows: DataFrame, label: str, least: int = 3) -> int:
    n = rows.agg(F.countDistinct(label)).first()[0]
    if n < least:
        raise ValueError(f"{n} classes are left of at least {least}")
    return n


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    """(label, weight): n / (classes * rows of the class)."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("k"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(label, (F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))
