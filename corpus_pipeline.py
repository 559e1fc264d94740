"""A training corpus in five stages, each run over all that the one before kept.

toxicity drops what the factorization machine rejects; simhash keeps the smallest id of each
group of near-duplicates: rows whose SimHashes the binary trie self-join links (2 or fewer differing bits), and rows of
a Jaccard similarity of 0.8 or more over five-word shingles, compared exactly, which 2 bits are too few for; decontaminate drops documents that hold a benchmark item; secrets
replaces found spans by their kind; mixing gives each document's words taken for the mix.
Every stage is a function of (spark, docs, sf_dir) and returns the columns of ``documents``
(the last one adds size, source_size, target and taken).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._shared import fresh, last_of, materialise, new_path
from parley.llm.components import components
from parley.llm.decontaminate import leaks
from parley.llm.mixing import mix
from parley.llm.nearcopies import near_copies, row_key
from parley.llm.secrets import redact
from parley.llm.simhash import near_duplicates
from parley.llm.toxicity import drop_toxic


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine doesn't reject. A row is scored where it stands, so nothing is joined back."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one of the smallest id, rows without an id after all others; of one id the smallest text hash.

    A group is joined by chains of links of either kind: the trie's components and the exact near copies' meet at their rows.
    """
    key = fresh(docs.columns, "key_")[0]
    named = docs.withColumn(key, row_key())

    def kept() -> DataFrame:
        # A row's order within its group, without its text.
        names = named.select(F.col(key).alias("k"), F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", key).alias("place")).distinct()
        prints = near_duplicates(named.select(F.col(key).alias("doc_id"), "text"))
        prints = prints.select(F.col("doc_id").alias("p"), F.xxhash64(F.lit("print"), "component_id").alias("print")).distinct()
        both = near_copies(docs).distinct().join(prints, F.col("row_key") == F.col("p")).select("row_key", "root", "print")
        both = materialise(both, "both-roots")
        whole = components(both, "root", "print").withColumnRenamed("root", "group")
        groups = both.join(whole, F.col("root") == F.col("node"), "left").join(names, F.col("row_key") == F.col("k"))
        groups = groups.groupBy(F.coalesce("group", "root").alias("group"))
        return groups.agg(F.min("place").alias("place")).select(F.col(f"place.{key}").alias("kept_"))

    first = last_of(kept, "kept-rows")
    return named.join(first, F.col(key) == F.col("kept_"), "left_semi").dropDuplicates([key]).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item, told apart by id and text, so rows without an id are judged as all others."""
    key = fresh(docs.columns, "key_")[0]
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = last_of(lambda: leaks(docs.select(row_key().alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("hit_")).distinct(), "leaks")
    return docs.withColumn(key, row_key()).join(hit, F.col(key) == F.col("hit_"), "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced."""
    return redact(docs, new_path(spark, "ledger")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("simhash", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: SQL can express neither the trained machine nor the retrieval; the tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
