"""Fixed values of the engine and readers for their overrides in YAML files."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml


class ConfigurationError(ValueError):
    """A required setting is missing or out of range."""


def load_yaml(path: str | Path) -> dict[str, Any]:
    """A YAML file as a dict; a missing or empty file is an empty dict."""
    p = Path(path)
    return (yaml.safe_load(p.read_text("utf-8")) or {}) if p.is_file() else {}


# Review costs and the value of caught errors.
MINUTE_COST, SLA_PENALTY, MIN_SAMPLE = 0.75, 1.50, 10
SEVERITY_WEIGHTS = {"low": 10.0, "medium": 25.0, "high": 75.0, "critical": 200.0, "unknown": 15.0}
# Containment and repeat contact.
CSAT_RESOLVED, REPEAT_HOURS, INTENT_SIMILARITY = 4.0, 48, 0.7
# Routing.
CONFIDENCE_GATE = 0.65
CRITICAL_INTENTS = ("Outrage_Escalation", "Legal_Threat", "Safety_Hazard")
SEVERE_LABEL = "Outrage_Escalation"
SLA_MINUTES = {"critical": 15, "urgent": 60, "standard": 240, "none": 1440}
FALLBACK_TAG = "Uncategorized"
TAGS = {
    "Billing_Issue": ["Billing", "Finance"],
    "Hardware_Failure": ["Hardware", "Technical_Support"],
    "Account_Recovery": ["Account_Access", "Security"],
    "Device_Performance_Degradation": ["Performance", "Device"],
    "Software_Update_Failure": ["Software", "Update_Issue"],
    "Outrage_Escalation": ["Escalation", "Customer_Care"],
    "Legal_Threat": ["Legal", "Compliance"],
    "Safety_Hazard": ["Safety", "Hazard"],
    "General_Inquiry": ["General_Support"],
    "Billing_Issue:critical": ["Billing", "Finance", "Executive_Escalation"],
}
INTENT_SKILLS = {
    "Legal_Threat": "legal_liaison",
    "Safety_Hazard": "safety_lead",
    "Outrage_Escalation": "retention_specialist",
    "Billing_Issue": "billing",
    "Hardware_Failure": "hardware_repair",
    "Software_Update_Failure": "software_troubleshooting",
}
# Topics and names that the rails act on.
RESTRICTED = ("political_discourse", "competitor_comparison")
COMPETITORS = ["Samsung", "Google Pixel", "OnePlus", "Xiaomi", "Huawei", "Motorola", "Oppo", "Vivo", "Sony Xperia", "Zendesk", "Freshdesk", "Intercom", "Salesforce", "Front"]
POLITICAL_TERMS = ["election", "vote", "democrat", "republican", "parliament", "president", "prime minister", "senate", "congress", "ballot", "campaign donation", "political party", "geopolitics", "voting"]
WARRANTY_TERMS = ["free replacement guaranteed", "lifetime warranty", "promise to fix free of charge", "we guarantee free", "100% money back unconditionally"]


@dataclass(frozen=True)
class Pool:
    """Agents of one tier, in their order, and the skills of each."""

    name: str
    tier: str
    agents: tuple[str, ...]
    skills: dict[str, tuple[str, ...]] = field(default_factory=dict)


def load_pools(path: str | Path) -> dict[str, Pool]:
    """Agent pools of a YAML file; a pool without agents is an error."""
    data = load_yaml(path).get("pools") or {}
    if not data:
        raise ConfigurationError(f"no pools in {path}")
    out = {}
    for name, p in data.items():
        agents = tuple(p.get("agent_ids") or ())
        if not agents:
            raise ConfigurationError(f"pool {name} has no agents")
        out[name] = Pool(name, p.get("tier", "standard"), agents, {a: tuple(s) for a, s in (p.get("agent_skills") or {}).items()})
    return out


def load_review_costs(path: str | Path) -> dict[str, Any]:
    """Review cost settings; all four keys must be there and the rates positive."""
    data = load_yaml(path)
    missing = [k for k in ("minute_cost_rate", "sla_penalty_per_minute", "min_sample_size", "severity_weights") if k not in data]
    if missing:
        raise ConfigurationError(f"missing {missing} in {path}")
    if data["minute_cost_rate"] <= 0 or data["sla_penalty_per_minute"] <= 0 or data["min_sample_size"] < 1:
        raise ConfigurationError("rates and sample size must be positive")
    return data


def load_telemetry(path: str | Path) -> dict[str, Any]:
    """Containment settings over their defaults."""
    return {"csat_threshold": CSAT_RESOLVED, "repeat_contact_window_hours": REPEAT_HOURS, "intent_similarity_threshold": INTENT_SIMILARITY} | load_yaml(path)


def load_topics(path: str | Path) -> dict[str, Any]:
    """Restricted topics; empty categories are an error, absent term lists take their defaults."""
    data = load_yaml(path)
    if not data.get("restricted_categories"):
        raise ConfigurationError("restricted_categories must not be empty")
    return {"competitor_names": [], "political_keywords": POLITICAL_TERMS, "warranty_prohibited_terms": WARRANTY_TERMS} | data


def load_helpdesk(path: str | Path) -> dict[str, Any]:
    """Tag, SLA and client settings over their defaults."""
    return {"fallback_tag": FALLBACK_TAG, "tag_mapping": TAGS, "sla_durations": SLA_MINUTES, "client": {"timeout_seconds": 10.0, "max_retries": 3, "backoff_factor": 0.5}} | load_yaml(path)
