"""Safety functions: personal data, toxicity, competitors, identifiers, rails."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.config import COMPETITORS, POLITICAL_TERMS, RESTRICTED, WARRANTY_TERMS

# Patterns of social security and card numbers.
SSN_NAMED = r"\b((?:SSN|Social Security(?: Number)?|Tax ID)(?:\s+is|\s*[:#=])?\s*)(\d{3}[-\s]?\d{2}[-\s]?\d{4}|\d{9})\b"
SSN_PLAIN = r"\b\d{3}[-\s]\d{2}[-\s]\d{4}\b"
CARD = r"\b(?:\d{4}[-\s]\d{4}[-\s]\d{4}[-\s]\d{4}|\d{4}[-\s]\d{6}[-\s]\d{5}|\d{13,19})\b"
SSN_MASK, CARD_MASK = "[REDACTED_SSN]", "[REDACTED_CREDIT_CARD]"
# Toxicity patterns and their weights.
TOXIC = [
    (r"\b(?:kill\s+yourself|go\s+die|hope\s+you\s+die)\b", 1.0),
    (r"\b(?:beat\s+you\s+up|i\s+will\s+hurt\s+you|threaten)\b", 0.9),
    (r"\b(?:fuck\s+you|fucking\s+(?:idiot|moron|fool|loser|stupid))\b", 1.0),
    (r"\b(?:fuck\s*off|fuck\s+you|bitch|bastard|asshole|dipshit|dickhead)\b", 0.9),
    (r"\b(?:bullshit|crap|dammit|shit)\b", 0.5),
    (r"\b(?:you\s+are\s+(?:an?\s+)?(?:idiot|moron|fool|imbecile|loser|incompetent|clown|trash))\b", 0.85),
    (r"\b(?:shut\s+up|piss\s+off)\b", 0.8),
    (r"\b(?:stupid|pathetic|moron|idiot|incompetent|dumbass)\b", 0.75),
    (r"\b(?:useless|lazy|brainless|worthless)\b", 0.7),
    (r"\b(?:are\s+you\s+(?:blind|deaf|dumb))\b", 0.75),
    (r"\b(?:waste\s+of\s+time|waste\s+of\s+space)\b", 0.6),
]
# Framings of a competitor's name.
NEUTRAL = [
    r"\bcompatible\s+with\b", r"\bcompatibility\s+with\b", r"\bworks\s+with\b", r"\bsupport(?:ed|s)?\s+(?:on|for|with)\b", r"\bsupports?\b", r"\bconnect(?:s|ed|ing)?\s+to\b", r"\badapter\s+for\b", r"\bswitch(?:ing)?\s+from\b",
    r"\btransfer(?:ring)?\s+from\b", r"\bmigrat(?:e|ing|ion)\s+from\b", r"\bmigration\b", r"\balso\s+works\s+on\b", r"\bintegrat(?:e|es|ed|ing|ion)?\s*(?:with|into|to)?\b", r"\bsimilar\s+to\b", r"\bdata\s+export\b", r"\bexport(?:ing)?\s+to\b",
]
LOADED = [
    r"\brecommend(?:ed|ing|s)?\b", r"\bsuggest(?:ed|ing|s)?\b", r"\bprefer(?:red|ring|s)?\b", r"\bbetter\s+than\b", r"\bbetter\b", r"\bworse\s+than\b", r"\bworse\b", r"\bworst\b", r"\bsuperior\s+to\b", r"\bsuperior\b", r"\binferior\s+to\b", r"\binferior\b",
    r"\bchoose\b", r"\bopt\s+for\b", r"\bgo\s+with\b", r"\bbuy\b", r"\bpurchase\b", r"\btry\b", r"\bconsider\b", r"\bswitch\s+to\b", r"\balternative\s+to\b", r"\balternative\b", r"\bcompetitor\b", r"\bterrible\b", r"\bhorrible\b", r"\bgarbage\b",
    r"\bjunk\b", r"\btrash\b", r"\bavoid\b", r"\bflawed\b", r"\bfaulty\b", r"\bsucks?\b", r"\bsubpar\b", r"\bpoor\s+quality\b", r"\boverpriced\b", r"\buseless\b", r"\bbroken\b",
]
TICKET_ID = r"^TCKT-\d{6}$"


def luhn(digits: str | None) -> bool:
    """Luhn's check over the digits of a string; fewer than two fail."""
    d = [int(c) for c in re.sub(r"\D", "", digits or "")]
    return len(d) > 1 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def mask_ssn(text: Column) -> Column:
    """Named and plain social security numbers masked; no Python."""
    return F.regexp_replace(F.regexp_replace(text, "(?iU)" + SSN_NAMED, "$1" + SSN_MASK.replace("[", r"\[").replace("]", r"\]")), "(?U)" + SSN_PLAIN, SSN_MASK.replace("[", r"\[").replace("]", r"\]"))


def mask_cards(text: Column) -> Column:
    """Card numbers that pass Luhn's check masked, by folding over the candidates found."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit("(" + CARD + ")"), F.lit(1)))
    good = F.filter(found, lambda c: F.call_function("luhn_check", F.regexp_replace(c, r"\D", "")))
    # Longest first, each as a whole token: a number is no match inside a longer run of digits.
    ordered = F.reverse(F.array_sort(F.transform(good, lambda c: F.struct(F.length(c), c.alias("c")))))
    return F.when(F.size(good) == 0, text).otherwise(F.aggregate(ordered, text, lambda acc, x: F.regexp_replace(acc, F.concat(F.lit(r"\b\Q"), x["c"], F.lit(r"\E\b")), F.lit(r"\[REDACTED_CREDIT_CARD\]"))))


def mask_pii(text: Column) -> Column:
    """struct(text, types): social security numbers first, then cards; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    first = mask_ssn(text)
    whole = mask_cards(first)
    types = F.array_compact(F.array(F.when(first != text, F.lit("ssn")), F.when(whole != first, F.lit("credit_card"))))
    return F.struct(whole.alias("text"), types.alias("types"))


def toxicity(text: Column) -> Column:
    """Largest weight found plus a tenth of all weights times counts, at most 1."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = [(F.regexp_count(low, F.lit("(?U)" + p)), w) for p, w in TOXIC]
    most = F.greatest(*(F.when(n > 0, F.lit(w)).otherwise(F.lit(0.0)) for n, w in counts))
    more = sum((n * F.lit(w) * F.lit(0.1) for n, w in counts[1:]), counts[0][0] * F.lit(counts[0][1]) * F.lit(0.1))
    return F.least(F.lit(1.0), most + more)


def is_toxic(text: Column, threshold: float = 0.7) -> Column:
    return F.round(toxicity(text), 4) >= threshold


_NEUTRAL, _LOADED = (re.compile("|".join(p), re.I) for p in (NEUTRAL, LOADED))


def competitor_mention(text: str | None, names: list[str] = COMPETITORS) -> str | None:
    """The first name (in their order) that the text recommends or runs down; plain or factual mentions pass.

    A sentence that names one and is loaded blocks; one that is neutral only passes; one that is
    neither blocks if the text as a whole is loaded.
    """
    if not text:
        return None
    sentences = re.split(r"[.!?\n;]+", text)
    loaded = bool(_LOADED.search(text))
    for name in names:
        own = re.compile(rf"\b{re.escape(name.strip())}(?:'s|s)?\b", re.I)
        for s in filter(own.search, sentences):
            if _LOADED.search(s.strip()) or (loaded and not _NEUTRAL.search(s.strip())):
                return name
    return None


def competitor_udf(text: Column, names: list[str] = COMPETITORS) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: competitor_mention(t, names), na_action="ignore")

    return run(text)


def valid_id(value: Column, pattern: str = TICKET_ID) -> Column:
    return F.coalesce(F.trim(value).rlike(pattern), F.lit(False))


def valid_ticket_tags(tags: Column, pattern: str = TICKET_ID, prefix: str = "id:") -> Column:
    """Whether all tags that carry an id carry a well-formed one."""
    return F.forall(tags, lambda t: F.when(t.startswith(prefix), valid_id(F.substring(t, len(prefix) + 1, 1_000_000), pattern)).when(t.rlike("(?i)^TCKT-"), valid_id(t, pattern)).otherwise(True))


def _names(terms: list[str], plural: bool) -> str:
    return r"(?iU)\b(?:" + "|".join(re.escape(t) for t in terms) + r")" + (r"(?:'s|s)?" if plural else "") + r"\b"


def _result(rail: str, cases: list[tuple[Column, Column, str]]) -> Column:
    """struct(passed, triggered_rail, reason, action) of the first case that holds."""
    none = F.lit(None).cast("string")
    out = F.struct(F.lit(True).alias("passed"), none.alias("triggered_rail"), none.alias("reason"), none.alias("action"))
    for hit, reason, action in reversed(cases):
        out = F.when(hit, F.struct(F.lit(False).alias("passed"), F.lit(rail).alias("triggered_rail"), reason.alias("reason"), F.lit(action).alias("action"))).otherwise(out)
    return out


def input_rail(text: Column, competitors: list[str] = COMPETITORS, political: list[str] = POLITICAL_TERMS, restricted: tuple[str, ...] = RESTRICTED) -> Column:
    """Blocks politics, then competitors; blank texts pass."""
    t, cases = F.coalesce(text, F.lit("")), []
    if "political_discourse" in restricted and political:
        cases.append((t.rlike(_names(political, True)), F.lit("political discourse"), "redirect"))
    if "competitor_comparison" in restricted and competitors:
        cases.append((t.rlike(_names(competitors, True)), F.concat(F.lit("competitor comparison: "), F.regexp_extract(t, "(" + _names(competitors, True) + ")", 1)), "redirect"))
    return _result("input", cases)


def output_rail(text: Column, competitors: list[str] = COMPETITORS, warranty: list[str] = WARRANTY_TERMS) -> Column:
    """Blocks competitors, then promises of warranty; blank texts pass."""
    t = F.coalesce(text, F.lit(""))
    return _result("output", [
        (t.rlike(_names(competitors, True)), F.concat(F.lit("competitor mention: "), F.regexp_extract(t, "(" + _names(competitors, True) + ")", 1)), "redirect"),
        (t.rlike(_names(warranty, False)), F.concat(F.lit("warranty commitment: "), F.regexp_extract(t, "(" + _names(warranty, False) + ")", 1)), "redirect_warranty"),
    ])


AWAY = r"(?iU)\b(buy|purchase|pricing|store hours|weather|refund)\b"
BATTERY, SCREEN = r"(?iU)\bbattery\b", r"(?iU)\bscreen|display\b"  # the second is as loose as it looks


def dialog_rail(texts: Column) -> Column:
    """Fold over a thread's texts in order: array<struct(passed, topic, turns)>, the state after each text.

    A text that leaves battery trouble for shopping or weather is rejected and changes nothing.
    """
    start = F.array().cast("array<struct<passed:boolean,topic:string,turns:int>>")

    def step(acc: Column, text: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        topic, turns, t = last["topic"], F.coalesce(last["turns"], F.lit(0)), F.trim(F.coalesce(text, F.lit("")))
        off = F.coalesce(F.lower(topic).contains("battery"), F.lit(False)) & t.rlike(AWAY)
        new = F.when(t.rlike(BATTERY), F.lit("battery troubleshooting")).when(t.rlike(SCREEN), F.lit("screen repair")).otherwise(topic)
        return F.concat(acc, F.array(F.struct((~off).alias("passed"), F.when(off, topic).otherwise(new).alias("topic"), F.when(off, turns).otherwise(turns + 1).alias("turns"))))

    return F.aggregate(texts, start, step)
