"""Containment, review value per cost, repeat contact and the dashboard.

An undefined metric is null and a bad one is 0; neither is ever turned into the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.config import CSAT_RESOLVED, INTENT_SIMILARITY, MIN_SAMPLE, MINUTE_COST, REPEAT_HOURS, SEVERITY_WEIGHTS, SLA_PENALTY, ConfigurationError
from parley.functions.similarity import similarity


def with_aliases(events: DataFrame, aliases: dict[str, Column]) -> DataFrame:
    """Fill columns that are absent or null from other columns that are there."""
    for name, value in aliases.items():
        events = events.withColumn(name, F.coalesce(F.col(name), value) if name in events.columns else value)
    return events


def review_aliases(events: DataFrame) -> DataFrame:
    """duration_seconds, sla_target_seconds, severity_level and status as the columns that costs use."""
    c, has = F.col, set(events.columns)
    out: dict[str, Column] = {}
    if "duration_seconds" in has:
        out |= {"reviewer_minutes": c("duration_seconds") / 60, "actual_response_delay_minutes": c("duration_seconds") / 60}
    if "sla_target_seconds" in has:
        out["sla_target_minutes"] = F.floor(c("sla_target_seconds") / 60).cast("int")
    if "severity_level" in has:
        out["error_severity"] = c("severity_level")
    if "status" in has:
        out["error_caught"] = c("status").isin("rejected", "error")
    return with_aliases(events, out)


def containment_aliases(events: DataFrame) -> DataFrame:
    c, has = F.col, set(events.columns)
    out: dict[str, Column] = {}
    if "is_contained" in has:
        out["contained"] = c("is_contained")
    if "escalated_to_human" in has:
        out["contained"] = F.coalesce(out.get("contained", F.lit(None)), ~c("escalated_to_human"))
    if "repeat_contact_within_window" in has:
        out["had_repeat_contact_within_48h"] = c("repeat_contact_within_window")
    return with_aliases(events, out)


def resolved(csat: Column, repeat: Column, least: float = CSAT_RESOLVED) -> Column:
    """True, false or null: the customer's score decides, else the absence of a repeat contact."""
    return F.when(csat.isNotNull(), csat >= least).when(repeat.isNotNull(), ~repeat)


def conflicting(csat: Column, repeat: Column, least: float = CSAT_RESOLVED) -> Column:
    return F.coalesce((csat >= least) == repeat, F.lit(False))


def containment_rate(events: DataFrame) -> DataFrame:
    """One row; 0.0 without events."""
    return events.agg(F.coalesce(F.avg(F.col("contained").cast("double")), F.lit(0.0)).alias("containment_rate"))


def resolution_rate(events: DataFrame, least: float = CSAT_RESOLVED) -> DataFrame:
    """One row: the rate within contained events (null if none is verified), verified and pending counts."""
    status = F.when(F.col("contained"), resolved(F.col("csat_score"), F.col("had_repeat_contact_within_48h"), least))
    return events.select("contained", status.alias("s")).agg(
        (F.count_if("s") / F.nullif(F.count("s"), F.lit(0))).alias("resolution_rate"),
        F.count("s").alias("verified_count"),
        F.count_if(F.col("contained") & F.col("s").isNull()).alias("pending_count"),
    )


def review_cost(events: DataFrame, minute: float = MINUTE_COST, penalty: float = SLA_PENALTY, weights: dict[str, float] | None = None) -> DataFrame:
    """Events plus operational_cost, error_value and ratio (null at no cost)."""
    if minute <= 0 or penalty <= 0:
        raise ConfigurationError("rates must be positive")
    weights = SEVERITY_WEIGHTS if weights is None else weights
    late = F.greatest(F.lit(0.0), F.col("actual_response_delay_minutes") - F.col("sla_target_minutes"))
    value = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else None
    known = F.try_element_at(value, F.col("error_severity")) if weights else F.lit(None).cast("double")
    out = events.withColumn("operational_cost", F.col("reviewer_minutes") * minute + late * penalty)
    out = out.withColumn("error_value", F.when(F.col("error_caught"), F.coalesce(known, F.lit(float(weights.get("unknown", 15.0))))).otherwise(0.0))
    return out.withColumn("ratio", F.round(F.col("error_value") / F.when(F.round("operational_cost", 4) != 0, F.col("operational_cost")), 4))


def review_rollup(events: DataFrame, label: str = "7d", least: int = MIN_SAMPLE, **costs) -> DataFrame:
    """A row for all and one a tier: mean of the events' ratios (each rounded), sums, count, low_confidence."""
    if least < 1:
        raise ConfigurationError("the sample size must be 1 or more")
    rows = review_cost(events, **costs).select(F.col("escalation_tier").alias("tier"), "operational_cost", "error_value", "ratio")
    tiers = rows.groupBy("tier").agg(F.sum("ratio").alias("_r"), F.count("ratio").alias("_k"), F.sum("operational_cost").alias("total_cost"), F.sum("error_value").alias("total_value"), F.count("*").alias("n_events"))
    # The row for all sums the tiers' rows, and is there without any event, too.
    every = tiers.agg(F.sum("_r").alias("_r"), F.coalesce(F.sum("_k"), F.lit(0)).alias("_k"), F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"), F.coalesce(F.sum("total_value"), F.lit(0.0)).alias("total_value"), F.coalesce(F.sum("n_events"), F.lit(0)).alias("n_events"))
    every = every.withColumn("tier", F.lit(None).cast(rows.schema["tier"].dataType)).withColumn("window", F.lit(label))
    got = every.unionByName(tiers.withColumn("window", F.concat(F.lit(label + ":"), F.coalesce("tier", F.lit("")))))
    return got.select("window", "tier", (F.col("_r") / F.nullif(F.col("_k"), F.lit(0))).alias("mean_ratio"), "total_cost", "total_value", "n_events", (F.col("n_events") < least).alias("low_confidence"))


def repeat_contacts(events: DataFrame, threads: DataFrame, hours: int = REPEAT_HOURS, least: float = INTENT_SIMILARITY) -> DataFrame:
    """Events plus had_repeat_contact: another thread of the customer in (first response, + hours] with a like intent.

    The join is by customer and by day buckets of the window, so a busy customer's threads meet
    only events whose window can hold them. Intents are compared once for each pair of values.
    """
    span = hours * 3600
    e = events.withColumn("_e", F.monotonically_increasing_id())
    at = F.unix_seconds("first_response_at")
    left = e.select("_e", "customer_id", "thread_id", "intent", "first_response_at", F.explode(F.array(F.floor(at / span), F.floor(at / span) + 1)).alias("_b"))
    right = threads.select("customer_id", F.col("thread_id").alias("_t"), F.col("intent").alias("_i"), F.col("created_at").alias("_c"), F.floor(F.unix_seconds("created_at") / span).alias("_b"))
    met = left.join(right, ["customer_id", "_b"]).where((F.col("thread_id") != F.col("_t")) & (F.col("_c") > F.col("first_response_at")) & (F.col("_c") <= F.col("first_response_at") + F.expr(f"INTERVAL {hours} HOURS")))
    met = met.select("_e", "intent", "_i").distinct()
    pairs = met.select("intent", "_i").distinct().withColumn("_s", similarity(F.col("intent"), F.col("_i")))
    hit = met.join(pairs, ["intent", "_i"]).where(F.col("_s") >= least).select("_e").distinct().withColumn("_hit", F.lit(True))
    return e.join(hit, "_e", "left").withColumn("had_repeat_contact", F.coalesce("_hit", F.lit(False))).drop("_e", "_hit")


def dashboard(containment: DataFrame, reviews: DataFrame, label: str = "Last 7 Days", least_csat: float = CSAT_RESOLVED, **costs) -> DataFrame:
    """One row: resolution first, containment as context (null without events), review sums and a map by tier."""
    raw = containment.agg(F.avg(F.col("contained").cast("double")).alias("raw_containment_rate"))
    roll = review_rollup(reviews, label, **costs)
    body = F.struct("mean_ratio", "total_cost", "total_value", "n_events", "low_confidence")
    # One row a tier: the map is small whatever the events.
    tiers = roll.agg(F.max(F.when(F.col("window") == label, body)).alias("review_summary"), F.map_from_entries(F.collect_list(F.when(F.col("window") != label, F.struct(F.coalesce("tier", F.lit("")).alias("k"), body.alias("v"))))).alias("by_tier"))
    return resolution_rate(containment, least_csat).crossJoin(raw).crossJoin(tiers).withColumn("window_label", F.lit(label))


def kpi_rollup(events: DataFrame) -> DataFrame:
    """Web roll-up: total value over total cost (0.01 in place of no cost); only high and critical errors count as caught."""
    cost = F.coalesce(F.sum("operational_cost"), F.lit(0.0))
    value = F.coalesce(F.sum("error_value"), F.lit(0.0))
    return events.agg(cost.alias("cost"), value.alias("value"), (value / F.when(cost == 0, 0.01).otherwise(cost)).alias("ratio"), F.count("*").alias("n"), F.count_if(F.col("error_caught") & F.col("error_severity").isin("high", "critical")).alias("errors_caught"))


def of_tier(events: DataFrame, tier: str | None = None) -> DataFrame:
    """Reviews of one tier; all of them without a tier, or for "all"."""
    return events if tier in (None, "", "all") else events.where(F.col("escalation_tier") == tier)


def verdict(weight: Column, cost: Column) -> Column:
    """struct(ratio, surplus_percent, band) of one review in the calculator."""
    ratio = weight / F.when(cost == 0, 0.01).otherwise(cost)
    band = F.when(ratio >= 2.0, "excellent").when(ratio >= 1.0, "positive").when(ratio >= 0.5, "marginal").otherwise("negative")
    return F.struct(ratio.alias("ratio"), ((ratio - 1) * 100).alias("surplus_percent"), band.alias("band"))
