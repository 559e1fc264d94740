"""Follow-up volume: dispersion, a negative binomial fit, and the risk of too many follow-ups."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OVERDISPERSED = 1.5
#: Categories and the baseline of each, which comes first.
LEVELS = {"sentiment_category": ("neutral", "negative", "positive"), "time_of_day": ("business_hours", "evening", "overnight"), "day_of_week": ("weekday", "weekend")}


def dispersion(rows: DataFrame, count: str = "follow_up_count") -> DataFrame:
    """One row: n, mean, sample variance (0 for one row), ratio, is_overdispersed."""
    d = rows.agg(F.count(count).alias("n"), F.coalesce(F.avg(count), F.lit(0.0)).alias("mean"), F.coalesce(F.var_samp(count), F.lit(0.0)).alias("variance"))
    ratio = F.when(F.col("mean") > 0, F.col("variance") / F.col("mean")).otherwise(0.0)
    return d.withColumn("ratio", ratio).withColumn("is_overdispersed", F.col("ratio") > OVERDISPERSED)


@dataclass
class CountModel:
    """A fitted model: coefficients by name, dispersion alpha, fit statistics."""

    coefficients: dict[str, float] = field(default_factory=dict)
    pvalues: dict[str, float] = field(default_factory=dict)
    alpha: float = 0.0
    aic: float = 0.0
    bic: float = 0.0
    sample_size: int = 0
    converged: bool = False

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f)

    @staticmethod
    def load(path: str) -> CountModel:
        with open(path, encoding="utf-8") as f:
            return CountModel(**json.load(f))


def design(levels: dict[str, tuple[str, ...]] = LEVELS) -> list[tuple[str, str, str]]:
    """(name, column, level) of the dummy variables, baselines left out."""
    return [(f"C({c}, Treatment('{v[0]}'))[T.{x}]", c, x) for c, v in levels.items() for x in v[1:]]


def _loglik(y: np.ndarray, mu: np.ndarray, alpha: float, w: np.ndarray) -> float:
    r = 1 / alpha
    terms = np.array([math.lgamma(v + r) - math.lgamma(v + 1) for v in y]) - math.lgamma(r) + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu))
    return float((w * terms).sum())


def _scoring(x: np.ndarray, y: np.ndarray, w: np.ndarray, alpha: float, beta: np.ndarray, steps: int) -> tuple[np.ndarray, bool]:
    """Fisher scoring for the coefficients at a given alpha."""
    for _ in range(steps):
        mu = np.exp(np.clip(x @ beta, -30, 30))
        z = w * mu / (1 + alpha * mu)
        move = np.linalg.lstsq((x * z[:, None]).T @ x, x.T @ (w * (y - mu) / (1 + alpha * mu)), rcond=None)[0]
        beta = beta + move
        if np.abs(move).max() < 1e-10:
            return beta, True
    return beta, False


def fit(rows: DataFrame, steps: int = 200) -> CountModel:
    """Negative binomial regression (log link, variance mu + alpha mu^2) of follow_up_count on the features.

    Rows are counted by all features and the response first: the three categories, lengths and
    counts have few combinations, and those are what the driver optimises over.
    """
    need = ["follow_up_count", *LEVELS, "text_length"]
    missing = [c for c in need if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    t = rows.select(*need).groupBy(*need).agg(F.count("*").alias("w")).toPandas()
    y, w = t["follow_up_count"].to_numpy(float), t["w"].to_numpy(float)
    terms = design()
    scale = max(1.0, float(t["text_length"].max()))
    x = np.column_stack([np.ones(len(t)), *[(t[c] == v).to_numpy(float) for _, c, v in terms], t["text_length"].to_numpy(float) / scale])
    names = ["Intercept", *[n for n, _, _ in terms], "text_length"]
    beta, ok = np.zeros(x.shape[1]), False
    beta[0] = math.log(max(1e-6, (w @ y) / w.sum()))
    # The likelihood over log alpha, coefficients refitted at each step: golden section.
    lo, hi, g = math.log(1e-6), math.log(1e3), (math.sqrt(5) - 1) / 2

    def at(log_alpha: float) -> float:
        nonlocal beta, ok
        beta, ok = _scoring(x, y, w, math.exp(log_alpha), beta, steps)
        return _loglik(y, np.exp(np.clip(x @ beta, -30, 30)), math.exp(log_alpha), w)

    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = at(a), at(b)
    for _ in range(60):
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = at(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = at(b)
    alpha = math.exp((lo + hi) / 2)
    ll = at(math.log(alpha))
    mu = np.exp(np.clip(x @ beta, -30, 30))
    info = (x * (w * mu * (1 + alpha * y) / (1 + alpha * mu) ** 2)[:, None]).T @ x  # observed
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0))
    p = [math.erfc(abs(v / s) / math.sqrt(2)) if s else 1.0 for v, s in zip(beta, se, strict=True)]
    beta = beta / np.array([1.0] * (len(names) - 1) + [scale])
    n, k = int(w.sum()), len(names) + 1
    return CountModel(dict(zip(names, beta.tolist(), strict=True)), dict(zip(names, p, strict=True)), alpha, 2 * k - 2 * ll, k * math.log(n) - 2 * ll, n, ok)


def mean_column(model: CountModel) -> Column:
    """The expected count of a feature row."""
    c = model.coefficients
    out = F.lit(c.get("Intercept", 0.0)) + F.lit(c.get("text_length", 0.0)) * F.col("text_length")
    for name, column, level in design():
        out = out + F.when(F.col(column) == level, c.get(name, 0.0)).otherwise(0.0)
    return F.exp(out)


def breach_risk(mu: Column, alpha: float, over: int = 2) -> Column:
    """P(Y > over): one minus the sum of the probabilities up to it, each from the one before; Poisson for alpha up to 1e-6."""
    if alpha <= 1e-6:
        first, ratio = F.exp(-mu), lambda k: mu / k
    else:
        r = 1 / alpha
        p = F.lit(r) / (F.lit(r) + mu)
        first, ratio = F.pow(p, F.lit(r)), lambda k: (F.lit(r) + k - 1) / k * (1 - p)
    start = F.struct(first.alias("p"), first.alias("s"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(over)), start, lambda a, k: F.struct((a["p"] * ratio(k)).alias("p"), (a["s"] + a["p"] * ratio(k)).alias("s")))["s"] if over > 0 else first
    return F.when(mu <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - total)))
