"""Severity, confidence, escalation, tags, deadlines, assignment and handoff."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.config import CONFIDENCE_GATE, CRITICAL_INTENTS, FALLBACK_TAG, INTENT_SKILLS, SEVERE_LABEL, SLA_MINUTES, TAGS, ConfigurationError, Pool

# Words of legal threats and hazards.
SEVERE_WORDS = ["lawyer", "attorney", "sue", "lawsuit", "legal action", "fire hazard", "caught fire", "battery explosion", "exploded", "injured", "burn", "hospital"]
# Intents that a specialist takes at the standard tier.
TECHNICAL = ("hardware_failure", "software_update_failure", "technical_support", "bug_report", "system_outage", "network_issue")


def keyword_pattern(words: list[str]) -> str:
    """Whole words or phrases, longer ones first; nothing matches an empty list."""
    words = sorted((w.strip() for w in words if w.strip()), key=len, reverse=True)
    return r"(?iU)\b(" + "|".join(re.escape(w) for w in words) + r")\b" if words else r"(?!x)x"


def severe(text: Column, words: list[str] = SEVERE_WORDS) -> Column:
    return F.coalesce(text.rlike(keyword_pattern(words)), F.lit(False))


def severe_words(text: Column, words: list[str] = SEVERE_WORDS) -> Column:
    """Words found, in small letters, each once, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(keyword_pattern(words)), F.lit(1 if any(w.strip() for w in words) else 0))
    return F.array_distinct(F.transform(found, F.lower))


def consensus(flag: Column, label: Column, target: str = SEVERE_LABEL) -> Column:
    """struct(is_severe, is_disagreement): words and label must agree."""
    same = F.coalesce(label == target, F.lit(False))
    return F.struct((flag & same).alias("is_severe"), (flag & ~same).alias("is_disagreement"))


def disagreements(messages: DataFrame, target: str = SEVERE_LABEL) -> DataFrame:
    """Messages whose words are severe and whose label isn't, with the words."""
    got = messages.withColumn("matched_keywords", severe_words(F.col("text"))).where((F.size("matched_keywords") > 0) & ~F.col("label").eqNullSafe(F.lit(target)))
    return got.select("text", "matched_keywords", F.col("label").alias("llm_label"))


def gate(confidence: Column, least: float = CONFIDENCE_GATE) -> Column:
    return confidence >= least


def route(text: Column, intent: Column, confidence: Column, least: float = CONFIDENCE_GATE, audited: bool = False) -> Column:
    """struct(bypassed, bypass_reason, predicted_intent, confidence, escalation_tier).

    Severe words bypass to critical and hide the intent; an unsure or absent prediction goes to
    urgent if its intent is critical, else to standard; a sure one isn't escalated.
    """
    flag, unsure = severe(text), confidence.isNull() | (confidence < least)
    tier = F.when(flag, "critical").when(unsure & F.coalesce(intent.isin(*CRITICAL_INTENTS), F.lit(False)), "urgent").when(unsure, "standard").otherwise("none")
    reason = F.when(flag, F.concat(F.lit("severity keywords: "), F.array_join(severe_words(text), ", ")))
    return F.struct(flag.alias("bypassed"), reason.alias("bypass_reason"), F.when(~flag, intent).alias("predicted_intent"), F.when(~flag, confidence).alias("confidence"), tier.alias("escalation_tier"))


def _map(d: dict) -> Column:
    return F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))))


def tags(intent: Column, tier: Column, mapping: dict[str, list[str]] | None = None, fallback: str = FALLBACK_TAG) -> Column:
    """Tags of intent and tier, else of the intent, else the fallback; critical and urgent add Urgent once."""
    m = _map(mapping or TAGS)
    base = F.coalesce(F.try_element_at(m, F.concat(intent, F.lit(":"), tier)), F.try_element_at(m, intent), F.array(F.lit(fallback)))
    return F.when(tier.isin("critical", "urgent") & ~F.array_contains(base, "Urgent"), F.concat(base, F.array(F.lit("Urgent")))).otherwise(base)


def sla_minutes(tier: Column, minutes: dict[str, int] | None = None) -> Column:
    """Minutes of a tier; an unknown tier raises when it is met."""
    m = _map(minutes or SLA_MINUTES)
    return F.coalesce(F.try_element_at(m, tier), F.raise_error(F.concat(F.lit("no deadline for tier "), F.coalesce(tier, F.lit("null")))).cast("int"))


def pool_name(tier: Column, intent: Column) -> Column:
    special = F.coalesce(F.lower(F.trim(intent)).isin(*TECHNICAL), F.lit(False))
    return F.when(tier == "critical", "escalation_critical").when((tier == "urgent") | ((tier == "standard") & special), "technical_specialist").otherwise("standard_support")


def assign(tickets: DataFrame, pools: dict[str, Pool], last: dict[str, int] | None = None, skills: dict[str, str] | None = None, order: str = "ticket_id", success: str | None = None) -> DataFrame:
    """Tickets (escalation_tier, predicted_intent) plus pool, strategy and agent.

    Critical tickets with an intent go to the first agent of the pool that has its skill; others,
    and those without a match, take turns: the next agent after the last one, which moves on only
    when an assignment succeeds (``success`` names a boolean column; all do by default).
    """
    if not pools:
        raise ConfigurationError("no pools")
    last, skills = last or {}, INTENT_SKILLS if skills is None else skills
    expert = {f"{p.name}:{i}": next((a for a in p.agents if s in p.skills.get(a, ())), None) for p in pools.values() for i, s in skills.items()}
    expert = {k: v for k, v in expert.items() if v}
    rows = tickets.withColumn("pool", pool_name(F.col("escalation_tier"), F.col("predicted_intent")))
    by_skill = F.when(F.col("escalation_tier") == "critical", F.try_element_at(_map(expert), F.concat("pool", F.lit(":"), F.col("predicted_intent")))) if expert else F.lit(None).cast("string")
    rows = rows.withColumn("_expert", by_skill)
    done = F.when(F.col("_expert").isNull(), F.col(success).cast("int") if success else F.lit(1)).otherwise(0)
    # A pool's order is its meaning; the cursor needs its tickets in one sequence.
    before = F.coalesce(F.sum(done).over(W.partitionBy("pool").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cursor = F.coalesce(F.try_element_at(_map({k: v for k, v in last.items()}), F.col("pool")), F.lit(0)) if last else F.lit(0)
    agents = _map({p.name: list(p.agents) for p in pools.values()})[F.col("pool")]
    turn = F.element_at(agents, (F.pmod(cursor + before + 1, F.size(agents)) + 1).cast("int"))
    return rows.withColumn("strategy", F.when(F.col("_expert").isNotNull(), "skill_based").otherwise("round_robin")).withColumn("agent", F.coalesce("_expert", turn)).drop("_expert")


def handoff(decisions: DataFrame, hits: DataFrame, docs: DataFrame, length: int = 200) -> DataFrame:
    """Decisions (thread_id, predicted_intent, escalation_tier) plus the note's text with snippets of their hits.

    A hit without a document keeps a placeholder; of documents that share an id the last by pos counts.
    """
    known = docs.groupBy("doc_id").agg(F.max_by("resolution_text", "pos").alias("resolution_text"))
    snippet = F.when(F.col("resolution_text").isNull(), F.lit("[document not found]")).when(F.length("resolution_text") > length, F.concat(F.substring("resolution_text", 1, length), F.lit("..."))).otherwise(F.col("resolution_text"))
    lines = hits.join(known, "doc_id", "left").select("thread_id", "rank", F.concat(F.lit("- "), F.col("doc_id"), F.lit(": "), snippet).alias("line"))
    notes = lines.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("s")).select("thread_id", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("snippets"))
    head = F.concat(F.lit("Intent: "), F.coalesce("predicted_intent", F.lit("unknown")), F.lit("\nTier: "), F.col("escalation_tier"))
    return decisions.join(notes, "thread_id", "left").withColumn("note", F.concat_ws("\n", head, F.lit("Related resolutions:"), F.coalesce("snippets", F.lit("- none")))).drop("snippets")
