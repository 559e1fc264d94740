"""Cleaning and validating raw messages, and filtering them to one brand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import sanitize

TRUE_WORDS, TRUE_WORDS_BRAND = ("true", "1", "t", "yes"), ("true", "1", "t")
#: Reject reasons in the order of the checks.
REASONS = ("author", "tweet_id", "duplicate", "date")


def parse_date(text: Column) -> Column:
    """ISO timestamps, or weekday month day time zone year; null if neither."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(F.substring(text, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy")))


def blank_id(value: Column) -> Column:
    """Ids that are null, empty, or the words nan or none."""
    return F.coalesce(F.lower(F.trim(value)).isin("", "nan", "none"), F.lit(True))


def optional_id(value: Column) -> Column:
    return F.when((F.trim(value) != "") & (F.lower(F.trim(value)) != "nan"), value)


def judged(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Raw messages with ``reject``: null, or the first check that fails.

    A first occurrence with a bad date still makes later ones duplicates. Ids come out trimmed,
    authors as they were. Only rows with valid ids compete for being first.
    """
    rows = raw.withColumn("_id", F.trim("tweet_id"))
    fine = ~blank_id(F.col("author_id")) & ~blank_id(F.col("tweet_id"))
    nth = F.row_number().over(W.partitionBy(F.when(fine, F.col("_id")).otherwise(F.concat(F.lit("\u0000"), F.col(ordinal).cast("string")))).orderBy(ordinal))
    rows = rows.withColumn("_nth", nth).withColumn("_at", parse_date(F.col("created_at")))
    reason = F.when(blank_id(F.col("author_id")), "author").when(blank_id(F.col("tweet_id")), "tweet_id").when(F.col("_nth") > 1, "duplicate").when(F.col("_at").isNull(), "date")
    return rows.withColumn("reject", reason)


def clean(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Valid messages with typed columns."""
    return judged(raw, ordinal).where("reject IS NULL").select(
        F.col("_id").alias("tweet_id"), "author_id", F.coalesce(F.lower(F.trim("inbound")).isin(*TRUE_WORDS), F.lit(False)).alias("inbound"), F.col("_at").alias("created_at"),
        sanitize(F.col("text")).alias("text"), optional_id(F.col("response_tweet_id")).alias("response_tweet_id"), optional_id(F.col("in_response_to_tweet_id")).alias("in_response_to_tweet_id"),
    )


def reject_counts(raw: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row: total, valid, and rejects by reason."""
    counts = [F.count_if(F.col("reject") == r).alias(f"rejected_{r}") for r in REASONS]
    return judged(raw, ordinal).agg(F.count("*").alias("total"), F.count_if(F.col("reject").isNull()).alias("valid"), *counts)


def filter_brand(messages: DataFrame, handle: str, threads: DataFrame | None = None) -> DataFrame:
    """Messages by the brand, and customers' messages in the given threads; no match is an error.

    ``threads`` has the array column tweets; without it only the brand's own messages stay.
    """
    direct = F.col("author_id") == handle
    out = messages.where(direct)
    if threads is not None:
        ids = threads.select(F.explode(F.col("tweets.tweet_id")).alias("tweet_id")).distinct()
        out = out.unionByName(messages.where(~direct & F.col("inbound")).join(ids, "tweet_id", "left_semi"))
    if out.isEmpty():
        raise ValueError(f"no message of {handle}")
    return out
