"""Quality by regularised quadratic discriminant analysis.

Each whole text is reduced to document statistics (lengths, character classes, word and line
repetition, entropy), each passed through a log or logit so that classes are near normal.
Class means and covariances are sums over all labelled rows, gathered per task and added up
on the driver (a few kilobytes whatever the input). Covariances shrink towards the pooled one and towards
their diagonal (Friedman's two parameters); a text's score is the logistic of the difference
of the two log densities, whose Mahalanobis terms use Cholesky factors computed once.

Defined results: null and empty texts have all-zero statistics and are scored like any
others; repeated rows are scored alike; null ids are never learned from nor held out; null
labels are ignored, an id with several labels takes the largest; with fewer than two rows of
a class the score is the constant share of class 1 (0.5 without labels); an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._shared import crc_fold, documents, materialise

FOLDS, OUT = 4, 2
TO_POOLED, TO_DIAGONAL = 0.2, 0.1
_CLASS = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 0 if _i >= 128 else 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if _c.isdigit() else 4 if _c in " \t\r\v\f" else 5 if _c == "\n" else 6 if _c in ".,;:'\"-" else 7 if _c in "!?" else 8
NAMES = ("bytes", "words", "word_length", "word_spread", "unique", "top_word", "lines", "unique_lines", "short_words", "entropy", "pair_entropy", "upper", "digit", "space", "newline", "plain_mark", "cry", "symbol", "symbol_words", "sentence", "repeat3", "high")


def _logit(p: float, n: float) -> float:
    k = p * n
    return float(np.log((k + 0.5) / (n - k + 0.5)))


_SYMBOL_END = re.compile(rb"[^\w\s.,;:'\"\-\x80-\xff]+(?=\s|$)")


def statistics(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return np.zeros(len(NAMES))
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9)
    words = raw.lower().split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally: dict[bytes, int] = {}
    for w in words:
        tally[w] = tally.get(w, 0) + 1
    lines = raw.split(b"\n")
    grams = set(zip(words, words[1:], words[2:], strict=False))
    p = counts[counts > 0] / n
    freq = np.fromiter(tally.values(), np.float64, len(tally)) / m if tally else np.ones(1)
    marks = len(_SYMBOL_END.findall(raw))
    return np.array(
        [
            np.log1p(n), np.log1p(len(words)), np.log(lengths.mean() + 0.5), np.log(lengths.std() + 0.5), _logit(len(tally) / m, m), np.log(freq.max()),
            np.log1p(len(lines)), _logit(len(set(lines)) / len(lines), len(lines)), _logit(float((lengths <= 3).mean()), m), -float((p * np.log(p)).sum()), -float((freq * np.log(freq)).sum()),
            *(_logit(float(kinds[k]) / n, n) for k in (2, 3, 4, 5, 6, 7, 8)), _logit(min(1.0, marks / m), m), np.log((kinds[6] + 0.5) / m), _logit(1 - len(grams) / max(1, m - 2) if m > 2 else 0.0, m), _logit(float(kinds[0]) / n, n),
        ]
    )


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [statistics(t).astype(np.float32) for t in batch.column("text").to_pylist()]
        yield batch.drop_columns(["text"]).append_column("stats", pa.array(got, pa.list_(pa.float32())))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    n, s, q = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        y = np.asarray(batch.column("label"))
        x = np.asarray(batch.column("stats").flatten(), np.float64).reshape(-1, d)
        for k in (0, 1):
            z = x[y == k]
            n[k] += len(z)
            s[k] += z.sum(axis=0)
            q[k] += z.T @ z
    yield pa.RecordBatch.from_arrays([pa.array(range(2), pa.int32()), pa.array(n), pa.array(list(s)), pa.array([m.ravel() for m in q])], names=["label", "n", "s", "q"])


class Discriminant:
    """Means, Cholesky factors and log determinants of the two classes."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        d = s.shape[1]
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.flat = n.min() < 2
        if self.flat:
            return
        self.mean = s / n[:, None]
        scatter = q - n[:, None, None] * self.mean[:, :, None] * self.mean[:, None, :]
        pooled = scatter.sum(axis=0) / (n.sum() - 2)
        self.factor, self.const = [], []
        for k in (0, 1):
            own = scatter[k] / (n[k] - 1)
            cov = (1 - TO_POOLED) * own + TO_POOLED * pooled
            cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + 1e-3 * np.eye(d)
            chol = np.linalg.cholesky(cov)
            self.factor.append(np.linalg.inv(chol))
            self.const.append(np.log(n[k] / n.sum()) - np.log(np.diag(chol)).sum())

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.share)
        density = [self.const[k] - 0.5 * (((x - self.mean[k]) @ self.factor[k].T) ** 2).sum(axis=1) for k in (0, 1)]
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def _score(model: Discriminant):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("stats").flatten(), np.float64).reshape(-1, len(NAMES))
            yield batch.drop_columns(["stats"]).append_column("score", pa.array(model.score(x)))

    return run


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; texts are read once."""
    rows = docs.select("doc_id", F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == OUT, F.lit(False)).alias("held_out"), "text")
    schema = rows.drop("text").select("*", F.lit(None).cast("array<float>").alias("stats")).schema
    stats = materialise(rows.mapInArrow(_statistics, schema), "statistics")
    known = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    learn = stats.where(~F.col("held_out")).join(known, "doc_id").select("label", "stats")
    sums = learn.mapInArrow(_moments, "label int, n double, s array<double>, q array<double>")
    # One row for each position of the sums, added up on the executors: 1 + d + d*d rows a class reach the driver.
    flat = sums.select("label", F.posexplode(F.concat(F.array("n"), "s", "q")).alias("at", "value")).groupBy("label", "at").agg(F.sum("value").alias("value")).collect()
    d = len(NAMES)
    table = np.zeros((2, 1 + d + d * d))
    for r in flat:
        table[r["label"], r["at"]] = r["value"]
    model = Discriminant(table[:, 0], table[:, 1 : 1 + d], table[:, 1 + d :].reshape(2, d, d))
    out = stats.select("doc_id", "held_out", F.lit(0.0).alias("score")).schema
    return stats.mapInArrow(_score(model), out).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
