"""Saved retrieval indexes: Parquet tables and a manifest with the corpus' hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parley.operators.retrieval import B, K1, CorpusMismatchError, corpus_hash


def _manifest(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], "corpus_hash string, kind string, k1 double, b double, model string").write.mode("overwrite").parquet(f"{path}/manifest")


def _check(spark: SparkSession, path: str, corpus: DataFrame | None) -> dict:
    row = spark.read.parquet(f"{path}/manifest").first().asDict()
    if corpus is not None and corpus_hash(corpus) != row["corpus_hash"]:
        raise CorpusMismatchError(f"the index at {path} is of another corpus")
    return row


def save_bm25(index: dict[str, DataFrame], corpus: DataFrame, path: str) -> None:
    for name, table in index.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    _manifest(corpus.sparkSession, path, (corpus_hash(corpus), "bm25", K1, B, None))


def load_bm25(spark: SparkSession, path: str, expected: DataFrame | None = None) -> dict[str, DataFrame]:
    """An index; with ``expected`` it must be of that corpus."""
    _check(spark, path, expected)
    return {n: spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "stats", "docs")}


def save_dense(vectors: DataFrame, corpus: DataFrame, path: str, model: str, built_from: str | None = None) -> None:
    """Vectors (doc_id, pos, vector); ``built_from`` is the hash of the corpus they were made of, which must be this one's."""
    own = corpus_hash(corpus)
    if built_from is not None and built_from != own:
        raise CorpusMismatchError("the vectors were made of another corpus")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    _manifest(corpus.sparkSession, path, (own, "dense", None, None, model))


def load_dense(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    _check(spark, path, expected)
    return spark.read.parquet(f"{path}/vectors")


def save_taxonomy(clusters: DataFrame, assignments: DataFrame, path: str) -> None:
    clusters.write.mode("overwrite").json(f"{path}/clusters")
    assignments.write.mode("overwrite").json(f"{path}/assignments")


def load_taxonomy(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/clusters"), spark.read.json(f"{path}/assignments")
