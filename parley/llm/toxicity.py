"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words (value 1 if present) and word stems of 4 to 7 letters
(value: their rate among the words, saturating at one in 40), hashed into 2**20 buckets. A
chi-square test over the labelled sample keeps the ``TERMS`` buckets that tell the classes
apart; the machine learns a weight and a factor vector for each, so that pairs (an insult
with a group mention) have a weight of their own that an additive model lacks:

    y = b + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)

The labelled sample is bounded: of the ``SAMPLE`` labelled ids with the smallest hashes, at most ``SAMPLE`` different
texts (by the hashes of id and text). It is written once and read for each step of the fit. Term counts come from that
sample; the scores cover every row and the whole text.

Defined results: null and empty texts have no terms and score by the bias; repeated rows are
scored alike and count once in the sample; null ids have fold null, count as not held out and are never learned from;
rows of ``labels`` with a null label are ignored and an id with several labels takes the
largest; without labels of both classes, or without a term that four texts share, every score
is the constant share of toxic rows (0 if there are none); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._shared import crc_fold, documents, fresh, materialise, release

BUCKETS, TERMS, FACTORS, SAMPLE, FOLDS = 1 << 20, 1024, 6, 20_000, 5
WORDS = re.compile(r"\w+")
STEMS = (4, 5, 6, 7)
MEMO = 100_000


def hashed(word: str) -> tuple[int, list[int]]:
    """Bucket of a word, and of its stems."""
    stems = [zlib.crc32(f"^{word[:n]}".encode("utf-8", "replace")) & (BUCKETS - 1) for n in STEMS if len(word) > n]
    return zlib.crc32(word.encode("utf-8", "replace")) & (BUCKETS - 1), stems


class Terms:
    """Terms of texts, with the buckets of recent words kept; ``only`` maps the buckets in use to their columns."""

    def __init__(self, only: dict[int, int] | None = None) -> None:
        self.only, self.memo = only, {}

    def of_word(self, word: str) -> tuple[tuple[int, bool], ...]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            whole, stems = hashed(word)
            pairs = [(whole, True), *((s, False) for s in stems)]
            if self.only is not None:
                pairs = [(self.only[b], w) for b, w in pairs if b in self.only]
            got = self.memo[word] = tuple(pairs)
        return got

    def __call__(self, text: str | None) -> dict[int, float]:
        counts = Counter(WORDS.findall((text or "").lower()))
        total, out = counts.total(), {}
        for word, n in counts.items():
            for b, whole in self.of_word(word):
                out[b] = 40.0 * total if whole else out.get(b, 0.0) + 40.0 * n
        return {b: min(1.0, v / total) for b, v in out.items()}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms, sums = Terms(), np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            sums[label, list(terms(text))] += 1
    at = np.flatnonzero(sums.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["bucket", "clean", "toxic"])


def _collect(only: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(only)
        for batch in batches:
            got = [terms(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("key"), pa.array([list(g) for g in got], pa.list_(pa.int32())), pa.array([list(g.values()) for g in got], pa.list_(pa.float32()))],
                names=["label", "key", "at", "value"],
            )

    return run


class Machine:
    """A fitted factorization machine over the columns of ``only``."""

    def __init__(self, only: dict[int, int], b: float, w: np.ndarray, v: np.ndarray) -> None:
        self.only, self.b, self.w, self.v = only, b, w, v

    def score(self, x: dict[int, float]) -> float:
        if not x:
            return float(1 / (1 + np.exp(-self.b)))
        at, val = np.fromiter(x, np.int64, len(x)), np.fromiter(x.values(), np.float64, len(x))
        xv = self.v[at] * val[:, None]
        y = self.b + self.w[at] @ val + 0.5 * float((xv.sum(axis=0) ** 2 - (xv**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def fit(x: np.ndarray, y: np.ndarray, only: dict[int, int], steps: int = 900, rate: float = 0.05, decay: float = 3e-5, seed: int = 1) -> Machine:
    """Log loss with L2 decay by Adam over mini-batches; classes weigh by the root of their share."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    weight = np.where(y > 0, np.sqrt((1 - share) / share), 1.0).astype(np.float32)
    # Linear weights start from each term's shrunk log odds, so a term that is rarely alone still counts alone.
    seen, hit = (x > 0).sum(axis=0), (x[y > 0] > 0).sum(axis=0)
    odds = (hit + 10 * share) / (seen - hit + 10 * (1 - share))
    start = 0.8 * (np.log(odds) - np.log(share / (1 - share)))
    p = [np.full(1, np.log(share / (1 - share)), np.float32), start.astype(np.float32), rng.normal(0, 0.02, (m, FACTORS)).astype(np.float32)]
    mom, var = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for t in range(1, steps + 1):
        pick = rng.integers(0, n, min(n, 2048))
        xb, yb, wb = x[pick], y[pick], weight[pick]
        xv = xb @ p[2]
        out = p[0] + xb @ p[1] + 0.5 * ((xv**2).sum(axis=1) - (xb**2) @ (p[2] ** 2).sum(axis=1))
        g = ((1 / (1 + np.exp(-np.clip(out, -30, 30))) - yb) * wb / len(pick)).astype(np.float32)
        grads = [np.array([g.sum()], np.float32), xb.T @ g + decay * p[1], (xb * g[:, None]).T @ xv - ((xb**2).T @ g)[:, None] * p[2] + 5 * decay * p[2]]
        for q, d, a, s in zip(p, grads, mom, var, strict=True):
            a += 0.1 * (d - a)
            s += 0.01 * (d * d - s)
            q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Machine(only, float(p[0][0]), p[1].astype(np.float64), p[2].astype(np.float64))


def labelled_sample(labels: DataFrame, label: str, fold_out: int, folds: int, most: int) -> DataFrame:
    """At most ``most`` rows (doc_id, label): the learnable ids with the smallest hashes."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold(F.col("doc_id"), folds) != fold_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).where(F.col("label").isin(0, 1))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def sample_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc, key, label, text): the sampled ids' different texts, at most SAMPLE of them, written once; doc and key are the hashes that order them."""
    # The ids are bounded by SAMPLE (16 bytes a row), so they may be broadcast.
    sample = labelled_sample(labels, "toxic", 0, FOLDS, SAMPLE)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = rows.select(F.xxhash64("doc_id").alias("doc"), F.xxhash64("text").alias("key"), "label", "text").dropDuplicates(["doc", "key"])
    return materialise(rows, "toxic-sample")


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    table = sample_texts(docs, labels)
    order = F.struct("doc", "key")
    last = table.select("doc", "key").orderBy("doc", "key").limit(SAMPLE).agg(F.max(order).alias("last")).first()["last"]
    here = order <= F.struct(F.lit(last["doc"]), F.lit(last["key"])) if last else F.lit(False)
    machine = fitted(table.where(here))
    release(table)
    return machine


def fitted(rows: DataFrame) -> Machine:
    """The machine of labelled texts (key, label, text), SAMPLE at most."""
    counts = rows.select("text", "label").mapInArrow(_count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 4")
    size = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, pos = size["n"], size["toxic"] or 0
    share = pos / n if n else 0.0
    flat = Machine({}, float(np.log((share + 1e-9) / (1 - share + 1e-9))), np.zeros(0), np.zeros((0, FACTORS)))
    if not 0 < pos < n:
        return flat
    both, expected = F.col("clean") + F.col("toxic"), (F.col("clean") + F.col("toxic")) * F.lit(pos / n)
    chi = (F.col("toxic") - expected) ** 2 / expected + (F.col("toxic") - expected) ** 2 / (both - expected)
    best = counts.select("bucket", chi.alias("chi")).orderBy(F.desc("chi"), "bucket").limit(TERMS).collect()
    only = {r["bucket"]: i for i, r in enumerate(best)}
    if not only:
        return flat
    got = rows.select("text", "label", "key").mapInArrow(_collect(only), "label int, key long, at array<int>, value array<float>").toArrow()
    got = got.sort_by([("label", "ascending"), ("key", "ascending")])  # rows arrive in any order; fitting must not depend on it
    x, y = np.zeros((got.num_rows, len(only)), np.float32), np.asarray(got["label"]).astype(np.float32)
    at = got["at"].combine_chunks()
    x[np.repeat(np.arange(len(y)), np.asarray(at.value_lengths())), np.asarray(at.flatten())] = np.asarray(got["value"].combine_chunks().flatten())
    del got, at
    return fit(x, y, only)


def _score(machine: Machine, text: str, score: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.only)
        for batch in batches:
            scores = [machine.score(terms(t)) for t in batch.column(text).to_pylist()]
            yield batch.drop_columns([text]).append_column(score, pa.array(scores, pa.float64()))

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """(columns of ``keep``, held_out, score, predicted) of every row of ``docs``; ``keep`` is doc_id by default.

    A column of ``keep`` that is named like one of the three gives way to it.
    """
    machine = train(docs, labels)
    keep = [c for c in keep or ["doc_id"] if c.lower() not in ("held_out", "score", "predicted")]
    text, score = fresh(keep, "text_", "score_")
    rows = docs.select(*keep, F.coalesce(crc_fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), F.col("text").alias(text))
    schema = rows.drop(text).select("*", F.lit(0.0).alias(score)).schema
    return rows.mapInArrow(_score(machine, text, score), schema).withColumnRenamed(score, "score").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay as they are."""
    machine = train(docs, labels)
    text, score = fresh(docs.columns, "text_", "score_")
    rows = docs.withColumn(text, F.col("text"))
    return rows.mapInArrow(_score(machine, text, score), docs.select("*", F.lit(0.0).alias(score)).schema).where(F.col(score) < threshold).drop(score)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
