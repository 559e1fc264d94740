"""Reply graphs and threads.

Edges are the children that messages declare and the parents they name. Threads are the paths
from roots to leaves, found level by level: a level's frontier is written to the shared folder,
so depth costs neither plan size nor lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def response_ids(raw: Column) -> Column:
    """Comma-separated ids: trimmed, distinct, in order; null and nan are none."""
    ids = F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "nan")))
    return F.coalesce(ids, F.array().cast("array<string>"))


def vertices(messages: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row an id: the last one in order."""
    order = F.col(ordinal) if ordinal else F.monotonically_increasing_id()
    return messages.withColumn("_o", order).withColumn("_n", F.row_number().over(W.partitionBy("tweet_id").orderBy(F.desc("_o")))).where("_n = 1").drop("_o", "_n")


def edges(messages: DataFrame) -> DataFrame:
    """(src, dst, pos) between messages that exist; declared children keep their place, healed ones follow."""
    v = messages.select("tweet_id")
    declared = messages.select(F.col("tweet_id").alias("src"), F.posexplode(response_ids(F.col("response_tweet_id"))).alias("pos", "dst"))
    named = messages.where("in_response_to_tweet_id IS NOT NULL").select(F.trim("in_response_to_tweet_id").alias("src"), F.lit(1 << 30).alias("pos"), F.col("tweet_id").alias("dst"))
    both = declared.select("src", "dst", "pos").unionByName(named.select("src", "dst", "pos")).groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    return both.join(v.withColumnRenamed("tweet_id", "src"), "src", "left_semi").join(v.withColumnRenamed("tweet_id", "dst"), "dst", "left_semi").select("src", "dst", "pos")


def edge_audit(messages: DataFrame) -> DataFrame:
    """Declared children that don't exist, or that name another parent: (src, dst, issue)."""
    declared = messages.select(F.col("tweet_id").alias("src"), F.explode(response_ids(F.col("response_tweet_id"))).alias("dst"))
    child = messages.select(F.col("tweet_id").alias("dst"), F.trim("in_response_to_tweet_id").alias("parent"), F.lit(True).alias("known"))
    got = declared.join(child, "dst", "left")
    return got.where(F.col("known").isNull() | ~F.col("parent").eqNullSafe(F.col("src"))).select("src", "dst", F.when(F.col("known").isNull(), "missing").otherwise("disagrees").alias("issue"))


def roots(messages: DataFrame) -> DataFrame:
    return messages.where("in_response_to_tweet_id IS NULL").select("tweet_id")


def orphans(messages: DataFrame) -> DataFrame:
    """Messages whose parent doesn't exist; they begin no thread, but may be reached as a declared child."""
    named = messages.where("in_response_to_tweet_id IS NOT NULL").withColumn("_p", F.trim("in_response_to_tweet_id"))
    return named.join(messages.select(F.col("tweet_id").alias("_p")), "_p", "left_anti").select("tweet_id")


def shared_folder(spark) -> str:
    """Where frontiers are written: the cluster's shared folder, or a temporary one in a local session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="parley-graph-")


def paths(messages: DataFrame, most_depth: int = 10_000) -> DataFrame:
    """(path array<string>) from roots to leaves. A child already on the path ends it there: the
    path is emitted once for each such child, besides the longer ones through other children."""
    spark, e = messages.sparkSession, edges(messages)
    folder = f"{shared_folder(spark)}/paths-{uuid.uuid4().hex}"
    e.write.parquet(f"{folder}/edges")
    e = spark.read.parquet(f"{folder}/edges")
    roots(messages).select(F.array("tweet_id").alias("path")).write.parquet(f"{folder}/front=0")
    for depth in range(most_depth):
        front = spark.read.schema("path array<string>").parquet(f"{folder}/front={depth}")
        if front.isEmpty():
            break
        step = front.join(e, F.element_at("path", -1) == F.col("src"), "left")
        cyclic = F.array_contains("path", F.col("dst"))
        step.where(F.col("dst").isNull() | cyclic).select("path").write.parquet(f"{folder}/done={depth}")
        step.where(F.col("dst").isNotNull() & ~cyclic).select(F.concat("path", F.array("dst")).alias("path")).write.parquet(f"{folder}/front={depth + 1}")
    else:
        raise RecursionError(f"a path is longer than {most_depth}")
    if not depth:
        return front
    return spark.read.schema("path array<string>").parquet(*[f"{folder}/done={d}" for d in range(depth)])


def threads(messages: DataFrame, handle: str | None = None) -> DataFrame:
    """(thread_id, path_id, tweets, terminal): paths with a brand's message, in order of time, then id.

    thread_id is the earliest message's id and need not be unique; path_id is.
    """
    p = paths(messages).withColumn("path_id", F.monotonically_increasing_id())
    steps = p.select("path_id", F.explode("path").alias("tweet_id"))
    fields = [c for c in messages.columns if c != "ordinal"]
    got = steps.join(messages, "tweet_id").groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("tweet_id").alias("_id"), F.struct(*fields).alias("t")))).alias("s"))
    got = got.select("path_id", F.transform("s", lambda x: x["t"]).alias("tweets"))
    brand = F.exists("tweets", lambda t: ~t["inbound"])
    if handle:
        brand = brand | F.exists("tweets", lambda t: F.lower(t["author_id"]) == handle.lower())
    return got.where(brand).select(F.col("tweets")[0]["tweet_id"].alias("thread_id"), "path_id", "tweets", (~F.element_at("tweets", -1)["inbound"]).alias("terminal"))


def turn_count(tweets: Column) -> Column:
    return F.size(tweets)


def long_threads(t: DataFrame, most: int = 20) -> DataFrame:
    return t.where(F.size("tweets") > most)


def participants(tweets: Column) -> Column:
    """Authors in the order of their first message."""
    return F.array_distinct(F.transform(tweets, lambda t: t["author_id"]))
