"""Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.config import MIN_SAMPLE, REPEAT_HOURS
from parley.operators.telemetry import review_cost


def deduplicate(messages: DataFrame, key: str = "tweet_id", at: str = "created_at", late: str = "1 hour") -> DataFrame:
    """The first message of an id within the watermark."""
    return messages.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def repeat_contacts(responses: DataFrame, threads: DataFrame, hours: int = REPEAT_HOURS, late: str = "1 hour") -> DataFrame:
    """First responses (thread_id, customer_id, intent, first_response_at) joined outer with later threads of the customer and intent.

    repeat_thread_id is null once the watermark has passed the window; until then nothing is emitted.
    """
    a = responses.withWatermark("first_response_at", late)
    b = threads.select(F.col("thread_id").alias("repeat_thread_id"), F.col("customer_id").alias("_c"), F.col("intent").alias("_i"), F.col("created_at").alias("_at")).withWatermark("_at", late)
    window = F.expr(f"_at > first_response_at AND _at <= first_response_at + INTERVAL {hours} HOURS")
    return a.join(b, (F.col("customer_id") == F.col("_c")) & (F.col("intent") == F.col("_i")) & (F.col("thread_id") != F.col("repeat_thread_id")) & window, "leftOuter").drop("_c", "_i", "_at")


def review_windows(reviews: DataFrame, length: str = "1 day", at: str = "timestamp", late: str = "1 hour", least: int = MIN_SAMPLE, **costs) -> DataFrame:
    """Review sums by time window and tier, an extension: 1, 7 or 30 days."""
    rows = review_cost(reviews, **costs).withWatermark(at, late)
    got = rows.groupBy(F.window(at, length), F.col("escalation_tier").alias("tier")).agg(F.avg("ratio").alias("mean_ratio"), F.sum("operational_cost").alias("total_cost"), F.sum("error_value").alias("total_value"), F.count("*").alias("n_events"))
    return got.withColumn("low_confidence", F.col("n_events") < least)


def dialog(turns: DataFrame, expire: str = "1 day") -> DataFrame:
    """Turns (thread_id, turn, text) -> (thread_id, turn, passed, topic), the topic kept as state; idle threads expire."""
    import re

    away, battery, screen = (re.compile(p, re.I) for p in (r"\b(buy|purchase|pricing|store hours|weather|refund)\b", r"\bbattery\b", r"\bscreen|display\b"))
    millis = int(pd.Timedelta(expire).total_seconds() * 1000)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        topic = state.get[0] if state.exists else ""
        rows = [r for f in frames for r in zip(f["turn"], f["text"], strict=True)]
        out = []
        for turn, text in sorted(rows, key=lambda r: r[0]):
            text = (text or "").strip()
            ok = not ("battery" in topic and away.search(text))
            if ok:
                topic = "battery troubleshooting" if battery.search(text) else "screen repair" if screen.search(text) else topic
            out.append((key[0], turn, ok, topic))
        state.update((topic,))
        state.setTimeoutDuration(millis)
        yield pd.DataFrame(out, columns=["thread_id", "turn", "passed", "topic"])

    return turns.groupBy("thread_id").applyInPandasWithState(run, "thread_id string, turn int, passed boolean, topic string", "topic string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def round_robin(tickets: DataFrame, agents: dict[str, list[str]]) -> DataFrame:
    """Tickets (ticket_id, pool) -> agent in turn, the cursor of each pool kept as state; the first goes to index 1."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        crew, out = agents[key[0]], []
        for t in sorted(x for f in frames for x in f["ticket_id"]):
            last = (last + 1) % len(crew)
            out.append((t, key[0], crew[last]))
        state.update((last,))
        yield pd.DataFrame(out, columns=["ticket_id", "pool", "agent"])

    return tickets.groupBy("pool").applyInPandasWithState(run, "ticket_id long, pool string, agent string", "last int", "append", GroupStateTimeout.NoTimeout)


def draft_locks(requests: DataFrame, minutes: float = 30) -> DataFrame:
    """Requests (thread_id, owner, at timestamp) -> granted: a lock is free, one's own, or as old as the limit."""
    limit = pd.Timedelta(minutes=minutes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, since = (state.get[0], pd.Timestamp(state.get[1])) if state.exists else ("", pd.NaT)
        out = []
        for at, who in sorted((pd.Timestamp(a), w) for f in frames for a, w in zip(f["at"], f["owner"], strict=True)):
            ok = not owner or who == owner or at - since >= limit
            if ok:
                owner, since = who, at
            out.append((key[0], who, at, ok))
        state.update((owner, since.isoformat()))
        yield pd.DataFrame(out, columns=["thread_id", "owner", "at", "granted"])

    return requests.groupBy("thread_id").applyInPandasWithState(run, "thread_id string, owner string, at timestamp, granted boolean", "owner string, since string", "append", GroupStateTimeout.NoTimeout)


def append_sink(stream: DataFrame, path: str, checkpoint: str):
    """An append-only JSON log of a stream."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def triage_each_batch(stream: DataFrame, act, checkpoint: str):
    """Calls ``act(batch, id)`` for each micro-batch; the helpdesk's own answers make a repeat harmless."""
    return stream.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint)
