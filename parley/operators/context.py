"""Context windows, transcripts and thread features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.text import expand_udf, mask_urls_col, word_count


def turn_label(inbound: Column, text: Column) -> Column:
    return F.concat(F.when(inbound, "Customer").otherwise("Agent"), F.lit(": "), text)


def transcript(tweets: Column, separator: str = "\n") -> Column:
    return F.array_join(F.transform(tweets, lambda t: turn_label(t["inbound"], t["text"])), separator)


def context_windows(threads: DataFrame, most: int | None = None, separator: str = "\n", inbound_only: bool = False) -> DataFrame:
    """A row a turn: its label, the labels of the ``most`` turns before it (all, if None), and both joined.

    ``inbound_only`` drops agents' rows after the windows are cut.
    """
    if most is not None and most < 0:
        raise ValueError("most must not be negative")
    labels = F.transform("tweets", lambda t: turn_label(t["inbound"], t["text"]))
    rows = threads.select("thread_id", *(["path_id"] if "path_id" in threads.columns else []), labels.alias("_l"), F.posexplode("tweets").alias("turn_index", "t"), F.size("tweets").alias("turn_count"))
    first = F.lit(1) if most is None else F.greatest(F.lit(1), F.col("turn_index") + 1 - most)
    history = F.slice("_l", first, F.col("turn_index") + 1 - first)
    rows = rows.withColumn("history", history).withColumn("current", F.element_at("_l", F.col("turn_index") + 1))
    out = rows.withColumn("context", F.array_join(F.concat("history", F.array("current")), separator)).withColumn("inbound", F.col("t.inbound")).withColumn("tweet_id", F.col("t.tweet_id"))
    out = out.where("inbound") if inbound_only else out
    return out.drop("_l", "t")


def map_texts(threads: DataFrame, change) -> DataFrame:
    """Threads with ``change`` (a column function without Python) applied to every text."""
    return threads.withColumn("tweets", F.transform("tweets", lambda t: t.withField("text", change(t["text"]))))


def mask_threads(threads: DataFrame) -> DataFrame:
    return map_texts(threads, mask_urls_col)


def expand_threads(threads: DataFrame) -> DataFrame:
    """Contractions written out in every text: exploded for the Arrow function, then put together again."""
    keyed = threads.withColumn("_k", F.monotonically_increasing_id())
    rows = keyed.select("*", F.posexplode("tweets").alias("_i", "_t")).withColumn("_x", expand_udf(F.col("_t.text")))
    rows = rows.withColumn("_t", F.col("_t").withField("text", F.col("_x")))
    others = [F.first(c).alias(c) for c in threads.columns if c != "tweets"]
    got = rows.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_i", "_t"))).alias("_s"), *others)
    return got.withColumn("tweets", F.transform("_s", lambda x: x["_t"])).select(*threads.columns)


def follow_ups(tweets: Column) -> Column:
    """Customer turns after the first agent turn."""
    i = F.transform(tweets, lambda t, i: F.when(~t["inbound"], i))
    first = F.array_min(F.array_compact(i))
    return F.when(first.isNull(), 0).otherwise(F.size(F.filter(tweets, lambda t, k: t["inbound"] & (k > first))))


def time_of_day(at: Column) -> Column:
    h = F.hour(at)
    return F.when((h >= 9) & (h < 17), "business_hours").when((h >= 17) & (h < 23), "evening").otherwise("overnight")


def day_of_week(at: Column) -> Column:
    return F.when(F.weekday(at) < 5, "weekday").otherwise("weekend")


def sentiment_category(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def features(threads: DataFrame, compound: Column | None = None) -> DataFrame:
    """Volume features of customer-initiated threads. ``compound`` is a sentiment score in -1..1 (0 if not given)."""
    first = F.col("tweets")[0]
    score = F.lit(0.0) if compound is None else compound
    return threads.where(first["inbound"]).select(
        "thread_id", follow_ups(F.col("tweets")).alias("follow_up_count"), sentiment_category(score).alias("sentiment_category"), word_count(first["text"]).alias("text_length"),
        time_of_day(first["created_at"]).alias("time_of_day"), day_of_week(first["created_at"]).alias("day_of_week"),
    )


def corpus(threads: DataFrame) -> DataFrame:
    """(doc_id, query_text, resolution_text): the first message of a customer and the first agent reply, if that isn't blank."""
    reply = F.filter("tweets", lambda t, i: (i > 0) & ~t["inbound"])
    rows = threads.where(F.col("tweets")[0]["inbound"]).select(F.col("thread_id").alias("doc_id"), F.col("tweets")[0]["text"].alias("query_text"), F.try_element_at(reply, F.lit(1))["text"].alias("resolution_text"))
    return rows.where(F.coalesce(F.trim("resolution_text"), F.lit("")) != "")


def repeated_resolutions(docs: DataFrame) -> DataFrame:
    return docs.groupBy("resolution_text").agg(F.count("*").alias("n")).where("n > 1")
