"""Evaluation statistics: agreement, classification, retrieval quality, judges, length bias, failures."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.functions.text import estimate_tokens

KAPPA_GATE, MASS = 0.60, 0.5
RATIO_VALUES = 50_000  # different scores that a ratio scale compares on the driver
GRID = 4096  # groups of confidences whose sums are added up in one task


# Classification


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support); a zero division is 0."""
    c = confusion(rows, truth, predicted)
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    h = c.where(F.col("truth") == F.col("predicted")).select(F.col("truth").alias("label"), F.col("n").alias("hit"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = t.join(p, "label", "full").join(h, "label", "left").select("label", z("support").alias("support"), z("said").alias("said"), z("hit").alias("hit"))
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    rows = rows.withColumn("precision", rate(F.col("hit"), F.col("said"))).withColumn("recall", rate(F.col("hit"), F.col("support")))
    return rows.withColumn("f1", rate(2.0 * F.col("hit"), F.col("said") + F.col("support"))).select("label", "precision", "recall", "f1", "support")


def scores(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro F1, the plain mean over classes."""
    acc = rows.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))
    return acc.crossJoin(class_report(rows, truth, predicted).agg(F.avg("f1").alias("macro_f1")))


def worst_classes(rows: DataFrame, truth: str, predicted: str, k: int = 5) -> DataFrame:
    return class_report(rows, truth, predicted).orderBy("f1", F.desc("support"), "label").limit(k)


def threshold_recall(rows: DataFrame, truth: str, predicted: str, confidence: str) -> DataFrame:
    """(threshold, macro_recall) at 0 and each confidence: a row below the threshold counts as not predicted.

    True positives are summed from the top of the confidences, class by class, so no row meets every threshold.
    """
    classes = rows.groupBy(F.col(truth).alias("c")).agg(F.count("*").alias("n"))
    k = classes.agg(F.count("*").alias("k"))  # one row
    right = rows.where(F.col(truth) == F.col(predicted)).groupBy(F.col(truth).alias("c"), F.col(confidence).alias("threshold")).agg(F.count("*").alias("hit"))
    gain = right.join(classes, "c").groupBy("threshold").agg(F.sum(F.col("hit") / F.col("n")).alias("gain"))
    steps = rows.select(F.col(confidence).alias("threshold")).union(rows.sparkSession.range(1).select(F.lit(0.0))).distinct().join(gain, "threshold", "left")
    # Sums from the top within groups of near confidences; only the groups' own sums go through one window.
    grid = F.floor(F.col("threshold") * GRID)
    steps = steps.select("threshold", grid.alias("grid"), F.coalesce("gain", F.lit(0.0)).alias("gain"))
    groups = steps.groupBy("grid").agg(F.sum("gain").alias("all"))
    over = F.coalesce(F.sum("all").over(W.orderBy(F.desc("grid")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    groups = groups.select(F.col("grid").alias("of"), over.alias("over"))
    own = F.sum("gain").over(W.partitionBy("grid").orderBy(F.desc("threshold")))
    found = steps.withColumn("g", own).join(groups, F.col("grid").eqNullSafe(F.col("of")))
    return found.crossJoin(F.broadcast(k)).select("threshold", ((F.col("over") + F.col("g")) / F.col("k")).alias("macro_recall"))


def calibrate_threshold(rows: DataFrame, truth: str, predicted: str, confidence: str, target: float = 0.9, reference_compat: bool = True) -> float:
    """The smallest threshold that meets the target recall, which is 0 if any does, and 0 if none does.

    ``reference_compat=False`` gives the largest one that still meets it.
    """
    if reference_compat:
        return 0.0
    got = threshold_recall(rows, truth, predicted, confidence).where(F.col("macro_recall") >= target).agg(F.max("threshold")).first()[0]
    return float(got or 0.0)


# Agreement


def discretize(score: Column) -> Column:
    """Half up, within 1 to 5."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.floor(score + 0.5))).cast("int")


def weighted_kappa(rows: DataFrame, human: str, judge: str) -> DataFrame:
    """One row (kappa, n): quadratic weights over categories 1 to 5; rows without a human score don't count. Null if chance disagreement is nothing."""
    r = rows.where(F.col(human).isNotNull() & F.col(judge).isNotNull()).select(F.col(human).cast("int").alias("h"), F.col(judge).cast("int").alias("j"))
    o = r.groupBy("h", "j").agg(F.count("*").alias("n"))  # at most 25 rows
    mh, mj, total = o.groupBy("h").agg(F.sum("n").alias("a")), o.groupBy("j").agg(F.sum("n").alias("b")), o.agg(F.sum("n").alias("t"), F.sum((F.col("h") - F.col("j")) ** 2 * F.col("n")).alias("seen"))
    e = mh.crossJoin(mj).agg(F.sum((F.col("h") - F.col("j")) ** 2 * F.col("a") * F.col("b")).alias("chance"))
    return total.crossJoin(e).select((1 - F.col("seen") / F.nullif(F.col("chance") / F.col("t"), F.lit(0.0))).alias("kappa"), F.coalesce("t", F.lit(0)).alias("n"))


def judge_calibration(rows: DataFrame, human: str, judge: str, over: float = KAPPA_GATE) -> dict:
    """kappa, passed (strictly above the gate), n; fewer than two pairs or a single category is an error."""
    r = weighted_kappa(rows, human, judge).first()
    if r["n"] < 2:
        raise ValueError("fewer than two labelled pairs")
    if r["kappa"] is None:
        raise ValueError("insufficient score variance")
    return {"kappa": r["kappa"], "passed": r["kappa"] > over, "n_examples": r["n"], "threshold": over}


def _pairable(rows: DataFrame, unit: str, score: str) -> DataFrame:
    """(u, v, m): scores of units with two or more of them, m in number."""
    v = rows.where(F.col(score).isNotNull()).select(F.col(unit).alias("u"), F.col(score).cast("double").alias("v"))
    return v.join(v.groupBy("u").agg(F.count("*").alias("m")).where("m >= 2"), "u")


def _by_variance(v: DataFrame, x: str) -> tuple[float, float]:
    """Seen and expected disagreement of squared differences: over pairs they are variances, so no pair is formed."""
    seen = v.groupBy("u").agg(F.count("*").alias("m"), F.var_samp(x).alias("s")).agg(F.sum(F.col("m") * F.col("s"))).first()[0]
    n, s = v.agg(F.count("*"), F.var_samp(x)).first()
    return seen, n * s


def _nominal(v: DataFrame) -> tuple[float, float]:
    unequal = (F.col("m") ** 2 - F.col("same")) / (F.col("m") - 1)
    per = lambda *unit: v.groupBy(*unit, "v").agg(F.count("*").alias("n")).groupBy(*unit).agg(F.sum("n").alias("m"), F.sum(F.col("n") ** 2).alias("same"))
    return per("u").agg(F.sum(unequal)).first()[0], per().agg(F.sum(unequal)).first()[0]


def _ratio(v: DataFrame) -> tuple[float, float]:
    """Pairs of different values: within units on the executors, over all units a value at a time on the driver."""
    delta = lambda c, k: F.when(c + k == 0, 0.0).otherwise(((c - k) / (c + k)) ** 2)
    n = v.groupBy("u", "m", F.col("v").alias("c")).agg(F.count("*").alias("n"))
    other = n.select("u", F.col("c").alias("k"), F.col("n").alias("nk"))
    seen = n.join(other, "u").agg(F.sum(F.col("n") * F.col("nk") * delta(F.col("c"), F.col("k")) / (F.col("m") - 1))).first()[0]
    got = v.groupBy("v").agg(F.count("*").alias("n")).limit(RATIO_VALUES + 1).collect()
    if len(got) > RATIO_VALUES:
        raise ValueError(f"a ratio scale takes at most {RATIO_VALUES} different values")
    x, many = np.array([r["v"] for r in got]), np.array([r["n"] for r in got], float)
    chance = 0.0
    for c, nc in zip(x, many, strict=True):
        both = c + x
        chance += nc * float(many @ np.divide(c - x, both, out=np.zeros_like(x), where=both != 0) ** 2)
    return seen, chance / (many.sum() - 1)


def krippendorff_alpha(rows: DataFrame, unit: str = "example_id", rater: str = "annotator_id", score: str = "score", level: str = "ordinal") -> float:
    """Alpha over a table of scores. An ordinal distance is the difference of mid-ranks, so it is a variance like the interval one."""
    counts = rows.where(F.col(score).isNotNull()).groupBy(unit).agg(F.countDistinct(rater).alias("r"))
    overlap, raters = counts.where("r >= 2").count(), rows.agg(F.countDistinct(rater)).first()[0]
    if overlap < 2 or raters < 2:
        raise ValueError("alpha needs two raters and two examples that two of them rated")
    v = _pairable(rows, unit, score)
    if level == "nominal":
        seen, chance = _nominal(v)
    elif level == "ratio":
        seen, chance = _ratio(v)
    elif level == "interval":
        seen, chance = _by_variance(v, "v")
    else:
        # One row a distinct value meets the window.
        n = v.groupBy("v").agg(F.count("*").alias("n"))
        middle = n.select("v", (F.sum("n").over(W.orderBy("v")) - F.col("n") / 2).alias("x"))
        seen, chance = _by_variance(v.join(middle, "v"), "x")
    return 1.0 if chance == 0 else 1 - seen / chance


# Retrieval quality


def context_precision(judged: DataFrame, item: str = "item_id") -> DataFrame:
    """Average precision of (item, rank, relevant). Failed judgments (null) go before ranking, so later ranks move up; 0 without a relevant one, null without any judgment."""
    w = W.partitionBy(item).orderBy("rank")
    r = judged.where("relevant IS NOT NULL").withColumn("_k", F.row_number().over(w)).withColumn("_r", F.sum(F.col("relevant").cast("int")).over(w))
    got = r.groupBy(item).agg(F.coalesce(F.avg(F.when(F.col("relevant"), F.col("_r") / F.col("_k"))), F.lit(0.0)).alias("context_precision"))
    return judged.select(item).distinct().join(got, item, "left")


def context_recall(facts: DataFrame, item: str = "item_id") -> DataFrame:
    """Share of supported facts (item, supported); a failed judgment isn't support."""
    return facts.groupBy(item).agg(F.avg(F.coalesce("supported", F.lit(False)).cast("double")).alias("context_recall"))


def faithfulness(claims: DataFrame, item: str = "item_id", least: float = 0.5) -> DataFrame:
    """Share of claims (item, claim, context, score) that some context supports; null where there is no claim or context, failed scores count as 0."""
    each = claims.where("claim IS NOT NULL AND context IS NOT NULL").groupBy(item, "claim").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("s"))
    return claims.select(item).distinct().join(each.groupBy(item).agg(F.avg((F.col("s") >= least).cast("double")).alias("faithfulness")), item, "left")


def ragas(items: DataFrame, *metrics: DataFrame, item: str = "item_id") -> DataFrame:
    for m in metrics:
        items = items.join(m, item, "left")
    return items


def weighted_score(logprobs: DataFrame, item: str = "item_id") -> DataFrame:
    """Expected score over digits 1 to 5 of (item, token, logprob); little mass on digits is low confidence, none is null."""
    digit = F.try_cast(F.trim("token"), "int") if hasattr(F, "try_cast") else F.expr("try_cast(trim(token) AS int)")
    p = logprobs.select(item, digit.alias("d"), F.exp("logprob").alias("p")).withColumn("p", F.when(F.col("d").between(1, 5), F.col("p")))
    got = p.groupBy(item).agg((F.sum(F.col("d") * F.col("p")) / F.nullif(F.sum("p"), F.lit(0.0))).alias("weighted_score"), F.coalesce(F.sum("p"), F.lit(0.0)).alias("mass"))
    return got.withColumn("low_confidence", F.col("mass") < MASS)


# Judges and bias


def ensemble(judgments: DataFrame, item: str = "item_id", over: float = 2.0) -> DataFrame:
    """(item, scores, final_score, recused_provider, high_disagreement, recusal_unverified) of (item, response_provider, provider, pos, score).

    A judge of the response's provider is left out. Scores of one provider are halved together in their order: (old + new) / 2.
    """
    own = F.lower(F.trim("response_provider"))
    rows = judgments.withColumn("_own", F.when(own != "", own)).withColumn("_p", F.lower(F.trim("provider")))
    active = rows.where(F.col("_own").isNull() | (F.col("_p") != F.col("_own")))
    by = active.groupBy(item, F.col("_p").alias("provider")).agg(F.array_sort(F.collect_list(F.struct("pos", "score"))).alias("s"))
    fold = F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.col("s")[0]["score"], lambda a, x: (a + x["score"]) / 2)
    each = by.select(item, "provider", fold.alias("score")).groupBy(item).agg(F.map_from_entries(F.collect_list(F.struct("provider", "score"))).alias("scores"), F.median("score").alias("final_score"), (F.max("score") - F.min("score") > over).alias("high_disagreement"))
    who = rows.groupBy(item).agg(F.max(F.when(F.col("_p") == F.col("_own"), F.col("_own"))).alias("recused_provider"), F.max(F.col("_own").isNull()).alias("recusal_unverified"))
    return who.join(each, item, "left")


def swap_verdict(forward: Column, backward: Column) -> Column:
    """a, b, tie, inconsistent or failed, from the verdicts of (a, b) and of (b, a)."""
    f = F.when(forward == "position_1", "a").when(forward == "position_2", "b").when(forward == "tie", "tie")
    b = F.when(backward == "position_1", "b").when(backward == "position_2", "a").when(backward == "tie", "tie")
    return F.when(f.isNull() | b.isNull(), "failed").when(f == b, f).otherwise("inconsistent")


def length_residuals(rows: DataFrame, score: str = "score", tokens: str = "token_count") -> DataFrame:
    """Rows plus adjusted score, slope, intercept and skipped. Rows without tokens keep their score; so do all under 10 rows or without variance."""
    ok = F.col(tokens) > 0
    fit = rows.where(ok).agg(F.regr_slope(score, tokens).alias("slope"), F.regr_intercept(score, tokens).alias("intercept"), F.count("*").alias("_n"), F.var_pop(tokens).alias("_v"))  # one row
    fit = fit.withColumn("skipped", (F.col("_n") < 10) | F.coalesce(F.col("_v") < 1e-12, F.lit(True)))
    out = rows.crossJoin(F.broadcast(fit))
    out = out.withColumn("slope", F.when(~F.col("skipped"), F.col("slope"))).withColumn("intercept", F.when(~F.col("skipped"), F.col("intercept")))
    return out.withColumn("adjusted", F.when(ok & ~F.col("skipped"), F.col(score) - (F.col("intercept") + F.col("slope") * F.col(tokens))).otherwise(F.col(score).cast("double"))).drop("_n", "_v")


def length_bucket(tokens: Column, edges: tuple[int, ...] = (50, 150, 400)) -> Column:
    """0 below the first edge (and below zero), and one more at each edge."""
    return sum(((tokens >= e).cast("int") for e in edges), F.lit(0))


def with_tokens(rows: DataFrame, text: str) -> DataFrame:
    return rows.withColumn("token_count", estimate_tokens(F.col(text)))


# Comparison of approaches


def approach_summary(rows: DataFrame, metrics: tuple[str, ...] = ("context_precision", "context_recall", "faithfulness", "score")) -> DataFrame:
    """A row an approach: counts and rates of answers, declines and errors, mean and count of each metric."""
    n = F.count("*")
    err, dec = F.count_if(F.col("error").isNotNull()), F.count_if(F.col("error").isNull() & F.col("declined"))
    means = [x for m in metrics for x in (F.avg(m).alias(f"mean_{m}"), F.count(m).alias(f"n_{m}"))]
    return rows.groupBy("approach").agg(n.alias("n"), err.alias("errors"), dec.alias("declined"), (err / n).alias("error_rate"), (dec / n).alias("decline_rate"), *means)


def uplift(summary: DataFrame, base: str, metric: str) -> DataFrame:
    """Difference of each approach's mean to the base's; null if either is."""
    b = summary.where(F.col("approach") == base).select(F.col(f"mean_{metric}").alias("_b"))
    return summary.crossJoin(F.broadcast(b)).select("approach", (F.col(f"mean_{metric}") - F.col("_b")).alias("uplift"))


# Failures

# Lexicons of the failure heuristics.
ADVERSARIAL = [r"ignore\s+(all\s+)?previous\s+(instructions|directives|prompts|rules)", r"reveal\s+(your|the)\s+(system|initial|hidden)\s+prompt", r"you\s+are\s+now\s+(a|an|in|unrestricted)", r"disregard\s+(all\s+)?(prior|previous)\s+instructions", r"system\s*prompt\s*leak", r"developer\s+mode\s+output", r"ignore\s+previous"]
POLICY = ["refund", "warranty", "window", "return", "policy", "guarantee", "coverage", "receipt", "30-day", "14-day", "terms", "replacement"]
SARCASTIC = ["great job", "love it", "fantastic", "brilliant", "wonderful", "so helpful", "thanks a lot", "super helpful", "amazing job", "best service ever"]
NEGATIVE = ["broken", "broke", "break", "useless", "terrible", "worst", "fails", "failing", "fail", "ruined", "unacceptable", "crashed", "crash", "horrible", "sucks", "hate", "brick", "bricked", "waste of money", "not working", "garbage"]


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def failure_tags(query: Column, response: Column, precision: Column, recall: Column, faithful: Column, tone: Column | None = None, turn_count: Column | None = None, thread_length: Column | None = None, intent: Column | None = None, sentiment: Column | None = None) -> Column:
    """array<struct(mode, confidence)> of the heuristics that fire; none is unclassified.

    Without a thread length an item counts as a fragment, whatever its turn count.
    """
    null = F.lit(None).cast("double")
    q, r = F.lower(F.coalesce(query, F.lit(""))), F.lower(F.coalesce(response, F.lit("")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    length = F.coalesce(thread_length, F.lit(1)) if thread_length is not None else F.lit(1)
    turns = F.coalesce(turn_count, length) if turn_count is not None else length
    fragment = (turns <= 1) | (length <= 1) | F.trim(q).rlike(r"(?U)^(it|that|still|also|why|then|yes)\b")
    low = yes(recall < 0.5) | yes(precision < 0.5)
    loose, tight = yes(faithful < 0.6), yes(faithful >= 0.6)
    pos, neg = _any(q, SARCASTIC), _any(q, NEGATIVE)
    mood = (pos & neg) | (yes(sentiment == "negative") & pos if sentiment is not None else F.lit(False)) | (yes(F.lower(intent).isin("praise", "positive", "compliment")) & (pos | neg) if intent is not None else F.lit(False))
    flat = F.coalesce(tone if tone is not None else null, F.lit(5.0)) < 3.0
    hops = q.rlike(r"(?U)\b(and|but|as well as|while|whereas|in addition to)\b") & (F.size(F.split(q, r"(?U)[,;]|\band\b|\bbut\b")) >= 2)
    tag = lambda hit, mode, conf: F.when(hit, F.struct(F.lit(mode).alias("mode"), conf.alias("confidence")))
    return F.array_compact(
        F.array(
            tag(low & fragment, "conversational_truncation", F.when(F.coalesce(recall, F.lit(0.0)) < 0.3, 0.75).otherwise(0.60)),
            tag(tight & flat & mood, "sarcasm_sentiment_inversion", F.lit(0.70)),
            tag(hops & loose & yes(precision >= 0.5), "multi_hop_reasoning_deficit", F.lit(0.68)),
            tag((yes(precision >= 0.6) | yes(recall >= 0.6)) & loose & (_any(q, POLICY) | _any(r, POLICY)), "stale_knowledge_indexing", F.lit(0.72)),
            tag(F.coalesce(query, F.lit("")).rlike("(?iU)" + "|".join(f"(?:{p})" for p in ADVERSARIAL)), "adversarial_extraction", F.lit(0.65)),
        )
    )


def ordinal_entropy(p: list[float]) -> float:
    """Entropy of a score distribution, for reports."""
    return -sum(x * math.log(x) for x in p if x > 0)
