"""Operators around injected callables: encoders, judges, generators. A failure of one row is that row's null."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.config import COMPETITORS, WARRANTY_TERMS
from parley.functions.guards import CARD, SSN_NAMED, SSN_PLAIN, TICKET_ID, TOXIC, competitor_mention, luhn


def scored(fn: Callable[..., float], *columns: Column, failed: float | None = None) -> Column:
    """A scorer over columns, row by row in Arrow batches; an exception is ``failed``."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        def one(args: tuple) -> float | None:
            try:
                return float(fn(*args))
            except Exception:
                return failed

        return pd.Series([one(a) for a in zip(*series, strict=True)], dtype="float64")

    return run(*columns)


def answered(fn: Callable[..., str], *columns: Column, prefix: str = "[ERROR]") -> Column:
    """A generator over columns; an exception is an answer that begins with ``prefix``."""

    @F.pandas_udf("string")
    def run(*series: pd.Series) -> pd.Series:
        def one(args: tuple) -> str:
            try:
                return str(fn(*args))
            except Exception as e:
                return f"{prefix} {e}"

        return pd.Series([one(a) for a in zip(*series, strict=True)], dtype="object")

    return run(*columns)


def is_error(answer: Column, prefix: str = "[ERROR]") -> Column:
    return F.coalesce(answer.startswith(prefix), F.lit(False))


def judge_relevant(fn: Callable[[str, str], str], question: Column, context: Column) -> Column:
    """YES or NO of a judge (YES first), asked again once; null if neither answer says either."""

    @F.pandas_udf("boolean")
    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> bool | None:
            for _ in range(2):
                try:
                    said = fn(a, b).upper()
                except Exception:
                    continue
                if "YES" in said:
                    return True
                if "NO" in said:
                    return False
            return None

        return pd.Series([one(a, b) for a, b in zip(q, c, strict=True)], dtype="object")

    return run(question, context)


def supported_in_batches(fn: Callable[[str, str], bool], fact: Column, contexts: Column, size: int = 3) -> Column:
    """Whether any batch of ``size`` contexts supports the fact; later batches aren't asked after a yes."""

    @F.pandas_udf("boolean")
    def run(f: pd.Series, c: pd.Series) -> pd.Series:
        def one(a: str, texts) -> bool:
            texts = list(texts) if texts is not None else []
            for i in range(0, len(texts), size):
                try:
                    if fn(a, "\n".join(texts[i : i + size])):
                        return True
                except Exception:
                    continue
            return False

        return pd.Series([one(a, t) for a, t in zip(f, c, strict=True)])

    return run(fact, contexts)


def decompose(said: Column, reference: Column) -> Column:
    """Facts of a reference: a JSON list that a model said, else its lines, else the reference's sentences."""
    body = F.regexp_replace(F.coalesce(said, F.lit("")), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    clean = lambda a: F.filter(F.transform(a, lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")
    listed = F.from_json(body, "array<string>")
    lines, sentences = clean(F.split(body, "\n")), clean(F.split(F.coalesce(reference, F.lit("")), r"(?<=[.!?])\s+"))
    return F.when(F.size(F.coalesce(listed, F.array().cast("array<string>"))) > 0, clean(listed)).when(F.size(lines) > 0, lines).otherwise(sentences)


REPLY = "struct<reply_text:string,confidence:double,ticket_tags:array<string>,requires_human_review:boolean>"


def parse_response(raw: Column) -> Column:
    """The reply (fields of ``REPLY``) of JSON, in a fence anywhere in the text or alone; null if it isn't that, or the confidence isn't within 0 to 1."""
    fenced = F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    got = F.from_json(F.when(fenced != "", fenced).otherwise(F.trim(raw)), REPLY)
    full = F.struct(got["reply_text"].alias("reply_text"), got["confidence"].alias("confidence"), F.coalesce(got["ticket_tags"], F.array().cast("array<string>")).alias("ticket_tags"), F.coalesce(got["requires_human_review"], F.lit(False)).alias("requires_human_review"))
    return F.when(got["confidence"].between(0, 1) & got["reply_text"].isNotNull(), full)


def mask_text(text: str) -> tuple[str, list[str]]:
    """Personal data of one text masked, and the kinds found; the plain twin of ``guards.mask_pii``."""
    kinds: list[str] = []
    named = re.sub(SSN_NAMED, r"\1[REDACTED_SSN]", text, flags=re.I)
    out = re.sub(SSN_PLAIN, "[REDACTED_SSN]", named)
    if out != text:
        kinds.append("ssn")
    cards = re.sub(CARD, lambda m: "[REDACTED_CREDIT_CARD]" if luhn(m[0]) else m[0], out)
    return cards, kinds + ["credit_card"] * (cards != out)


def toxicity_of(text: str) -> float:
    hits = [(len(re.findall(p, text.lower())), w) for p, w in TOXIC]
    return round(min(1.0, max([w for n, w in hits if n], default=0.0) + sum(n * w * 0.1 for n, w in hits)), 4)


FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.I | re.S)
#: What a correction asks for, by the validator that failed.
ADVICE = {
    "pii_masking": "Leave out social security and card numbers.",
    "schema_validation": 'Answer with JSON only: {"reply_text": string, "ticket_tags": [string], "requires_human_review": boolean, "confidence": number from 0 to 1}.',
    "id_format": f"Write ticket ids as {TICKET_ID}, such as TCKT-123456.",
    "competitor_check": "Neither recommend nor run down other brands.",
    "toxicity_check": "Stay polite and professional.",
}


def reply_of(text: str) -> dict[str, Any] | None:
    """The reply in a text, checked by its contract; null if it isn't one."""
    fenced = FENCE.search(text)
    try:
        got = json.loads(fenced[1] if fenced else text.strip())
        reply, confidence, tags, review = got["reply_text"], got["confidence"], got.get("ticket_tags", []), got.get("requires_human_review", False)
        confidence = float(confidence)
        if not (isinstance(reply, str) and isinstance(tags, list) and all(isinstance(t, str) for t in tags) and isinstance(review, bool) and 0 <= confidence <= 1):
            return None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return {"reply_text": reply, "ticket_tags": tags, "requires_human_review": review, "confidence": confidence}


def well_formed(value: str) -> bool:
    return re.match(TICKET_ID, value.strip()) is not None


def validate(raw: str, toxic: float = 0.7, competitors: list[str] = COMPETITORS) -> dict[str, Any]:
    """One attempt: personal data masked first, then the contract, ids in tags and text, competitors and tone. ``failed`` has (validator, reason) pairs."""
    masked, kinds = mask_text(raw)
    reply, failed = reply_of(masked), []
    if reply is None:
        return {"reply": None, "failed": [("schema_validation", "the answer is not the JSON that was asked for")], "pii": kinds, "masked": masked}
    reply["requires_human_review"] |= bool(kinds)
    named = [t[3:] if t.startswith("id:") else t for t in reply["ticket_tags"] if t.startswith("id:") or t.upper().startswith("TCKT-")]
    if not all(map(well_formed, named)):
        failed.append(("id_format", f"a tag holds a malformed id: {reply['ticket_tags']}"))
    odd = next((x for x in re.findall(r"\bTCKT-\w+\b", reply["reply_text"], re.I | re.A) if not well_formed(x)), None)
    if odd:
        failed.append(("id_format", f"the reply holds a malformed id: {odd}"))
    rival = competitor_mention(reply["reply_text"], competitors)
    if rival:
        failed.append(("competitor_check", f"the reply judges {rival}"))
    score = toxicity_of(reply["reply_text"])
    if score >= toxic:
        failed.append(("toxicity_check", f"the reply's toxicity is {score:.2f}, {toxic} or more"))
    return {"reply": reply, "failed": failed, "pii": kinds, "masked": masked}


def correction_prompt(last: str, failed: list[tuple[str, str]]) -> str:
    """What was wrong, what to do about it, and the last answer."""
    wrong, names = "\n".join(f"- {reason}" for _, reason in failed), {name for name, _ in failed}
    return f"Your last answer was not accepted:\n{wrong}\n\nPlease change it:\n" + "\n".join(f"- {text}" for name, text in ADVICE.items() if name in names) + f"\n\nLast answer:\n{last}"


GUARDED = "id string, validated boolean, reply_text string, ticket_tags array<string>, requires_human_review boolean, confidence double, escalate boolean, reason string, failed_validators array<string>, failure_reasons array<string>, retry_count int, masked_pii_types array<string>"


def guarded(raw: str | None, retry: Callable[[str], str] | None, retries: int = 2) -> tuple:
    """One answer through at most ``retries`` corrections, as the columns of ``GUARDED`` after the id."""
    if raw is None or not raw.strip():
        return (False, None, None, None, None, True, "the answer is empty", ["empty_input"], ["the answer is empty"], 0, [])
    text, pii = raw, []
    for n in range(retries + 1):
        got = validate(text)
        pii += [k for k in got["pii"] if k not in pii]
        if not got["failed"]:
            r = got["reply"]
            return (True, r["reply_text"], r["ticket_tags"], r["requires_human_review"], r["confidence"], False, None, [], [], n, pii)
        if n == retries or retry is None:
            break
        try:
            text = retry(correction_prompt(got["masked"], got["failed"]))
        except Exception:
            break
        if text is None or not text.strip():
            break
    names, reasons = list(dict.fromkeys(name for name, _ in got["failed"])), [reason for _, reason in got["failed"]]
    return (False, None, None, None, None, True, f"not valid after {n} retries: " + "; ".join(reasons), names, reasons, n, pii)


def validate_and_correct(rows: DataFrame, retry: Callable[[str], str] | None = None, retries: int = 2) -> DataFrame:
    """Rows (id, raw) through the guard. Masked personal data alone passes, for a human to review; what stays invalid has no reply and escalates."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(i, *guarded(raw, retry, retries)) for i, raw in zip(f["id"], f["raw"], strict=True)], columns=[c.split()[0] for c in GUARDED.split(", ")])

    return rows.select(F.col("id").cast("string").alias("id"), "raw").mapInPandas(run, GUARDED)


def swap_verdicts(pairs: DataFrame, judge: Callable[[str, str, str], str]) -> DataFrame:
    """Pairs (item_id, query, a, b) judged in both orders, each order asked again once if it fails: (item_id, forward, backward, verdict)."""
    from parley.operators.evaluation import swap_verdict

    @F.pandas_udf("string")
    def ask(q: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        def one(*args: str) -> str | None:
            for _ in range(2):
                try:
                    said = str(judge(*args)).strip().lower()
                except Exception:
                    continue
                if said in ("position_1", "position_2", "tie"):
                    return said
            return None

        return pd.Series([one(*args) for args in zip(q, x, y, strict=True)], dtype="object")

    both = pairs.select("item_id", ask("query", "a", "b").alias("forward"), ask("query", "b", "a").alias("backward"))
    return both.withColumn("verdict", swap_verdict(F.col("forward"), F.col("backward")))


TURNS = "thread_id string, turn int, rail string, response string"


def process_turns(rows: DataFrame, generate: Callable[[str], str], competitors: list[str] = COMPETITORS, warranty: list[str] = WARRANTY_TERMS) -> DataFrame:
    """Turns (thread_id, turn, text) through the input, dialog and output rails; the generator is asked between them.

    The dialog state is a thread's own, so a thread is one group.
    """
    from parley.config import POLITICAL_TERMS

    names = lambda words, tail="": re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + ")" + tail + r"\b", re.I)
    rivals, politics, promises = names(competitors, "(?:'s|s)?"), names(POLITICAL_TERMS, "(?:'s|s)?"), names(warranty)
    away = re.compile(r"\b(buy|purchase|pricing|store hours|weather|refund)\b", re.I)

    def thread(f: pd.DataFrame) -> pd.DataFrame:
        topic, out = "", []
        for t, text in sorted(zip(f["turn"], f["text"], strict=True), key=lambda x: x[0]):
            text, rail, said = (text or "").strip(), None, None
            if text and (politics.search(text) or rivals.search(text)):
                rail = "input"
            elif text and "battery" in topic and away.search(text):
                rail = "dialog"
            else:
                topic = "battery troubleshooting" if re.search(r"\bbattery\b", text, re.I) else "screen repair" if re.search(r"\bscreen|display\b", text, re.I) else topic
                try:
                    said = generate(text)
                except Exception:
                    rail = "generation"
                else:
                    if rivals.search(said) or promises.search(said):
                        rail, said = "output", None
            out.append((f["thread_id"].iloc[0], t, rail, said))
        return pd.DataFrame(out, columns=["thread_id", "turn", "rail", "response"])

    return rows.groupBy("thread_id").applyInPandas(thread, TURNS)


RUBRICS = {"helpfulness": "How well does the answer solve the customer's problem?", "empathy": "Does the answer meet the customer's mood?", "brand_tone": "Is the answer polite, clear and in the brand's voice?"}


def judge_prompt(query: Column, response: Column, rubric: str) -> Column:
    return F.concat(F.lit(f"Rubric: {rubric}\n{RUBRICS[rubric]}\nScore from 1 to 5.\nQuestion: "), F.coalesce(query, F.lit("")), F.lit("\nAnswer: "), F.coalesce(response, F.lit("")), F.lit("\nScore:"))


def compare(items: DataFrame, approaches: dict[str, Callable[[str], str | None]], score: Callable[[str, str], float]) -> DataFrame:
    """Items (item_id, query) through each approach: (item_id, approach, response, declined, error, score). No answer is a decline."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for i, q in zip(f["item_id"], f["query"], strict=True):
                for name, fn in approaches.items():
                    said = error = points = None
                    try:
                        said = fn(q)
                    except Exception as e:
                        error = str(e)
                    if said is not None:
                        try:
                            points = float(score(q, said))
                        except Exception:
                            points = None
                    out.append((i, name, said, said is None and error is None, error, points))
            yield pd.DataFrame(out, columns=["item_id", "approach", "response", "declined", "error", "score"])

    return items.select(F.col("item_id").cast("string").alias("item_id"), "query").mapInPandas(run, "item_id string, approach string, response string, declined boolean, error string, score double")


def train_intents(rows: DataFrame, features: int = 1 << 14, text: str = "text", label: str = "label"):
    """A bag-of-words logistic regression with balanced class weights, in place of a transformer's head."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer, StringIndexer

    from parley.operators.splits import class_weights

    weighted = rows.join(class_weights(rows, label), label)
    return Pipeline(stages=[StringIndexer(inputCol=label, outputCol="_y", handleInvalid="keep"), RegexTokenizer(inputCol=text, outputCol="_w", pattern=r"[^a-z0-9]+"), HashingTF(inputCol="_w", outputCol="_x", numFeatures=features), LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="weight", maxIter=30)]).fit(weighted)


def claim_supported(fn: Callable[[str, str], float], claim: Column, contexts: Column, least: float = 0.5) -> Column:
    """Whether a context supports the claim, or, if none does alone, all of them together; a failed score is 0."""

    @F.pandas_udf("boolean")
    def run(c: pd.Series, t: pd.Series) -> pd.Series:
        def score(premise: str, claim: str) -> float:
            try:
                return float(fn(premise, claim))
            except Exception:
                return 0.0

        def one(claim: str, texts) -> bool:
            texts = [x for x in (texts if texts is not None else []) if x]
            return any(score(x, claim) >= least for x in texts) or (len(texts) > 1 and score("\n".join(texts), claim) >= least)

        return pd.Series([one(a, b) for a, b in zip(c, t, strict=True)])

    return run(claim, contexts)


def encode(fn: Callable[[list[str]], Any], text: Column, most_words: int | None = None) -> Column:
    """Vectors of an injected encoder, a batch of texts at a time, cut to its ``most_words``; unit length."""
    import numpy as np

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t or "" for t in s]
            if most_words is not None:
                texts = [" ".join(t.split()[:most_words]) if len(t.split()) > most_words else t for t in texts]
            v = np.asarray(fn(texts), dtype=float)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series((v / np.where(n == 0, 1, n)).tolist())

    return run(text)


def normalise_items(items: DataFrame) -> DataFrame:
    """Evaluation items under common names: item_id, query, response, contexts, from whichever of the usual columns is there and filled."""
    names = {"item_id": ("item_id", "example_id", "thread_id", "id"), "query": ("query", "tweet_text", "text"), "response": ("generated_response", "response", "answer"), "contexts": ("retrieved_contexts", "contexts")}
    out = []
    for name, options in names.items():
        there = [F.col(c) for c in options if c in items.columns]
        kind = "array<string>" if name == "contexts" else "string"
        out.append((F.coalesce(*there).cast(kind) if there else F.lit(None).cast(kind)).alias(name))
    return items.select(*out)
