"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a word budget (``source_targets``). A document's key is ``-ln(u) / w`` with
``u`` uniform from a hash of the document and ``w`` its quality weight; small keys come
first, which is weighted sampling without replacement. A budget of E whole source sizes and
a rest takes every document E times (complete epochs come first), then walks the key order
and takes documents until the prefix sum reaches the rest; the document at the border is
taken in part, so a source ends within one word of its budget.

No source is ever sorted in one task: keys fall into about sqrt(rows) buckets of a source,
bucket sums are prefix-summed, and rows are sorted only inside their bucket. The buckets follow the
distribution of the source's keys, which its weights determine (a class for each eighth of a power of two), so they are even for any weights.

Defined results: null text has size 0 and is taken 0 times; the null source is a source of
its own and sorts last; rows that repeat an id count as separate documents (equal keys are
ordered by size, then text hash; fully equal rows are interchangeable); rows without an id draw by their text; a weight
that is null or not above zero counts as 2^-32; an empty table
gives an empty result. Extra columns are carried through ``mix`` unless their name is one
that it adds, in which case the added one replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.llm._shared import documents, materialise

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#$%&*|!~^=+<>{}[]\\/@_"
BROADCAST_SOURCES = 50_000  # rows of under 100 bytes each; beyond that the join shuffles
ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.25 for texts of which a quarter or more are symbols."""
    n = F.length(text)
    share = (n - F.length(F.translate(text, SYMBOLS, ""))) / F.greatest(n, F.lit(1))
    return F.coalesce(1.0 - F.least(F.lit(0.75), 3.0 * share), F.lit(1.0))


def unit_hash(*parts: Column) -> Column:
    """A double in (0, 1) from 52 bits of the parts' MD5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """Budget of each source: (source, source_size, ...) -> adds ``target``.

    Weights repeat over the sources in code-point order, null last. Budgets share the sum of
    all sizes; none is above ``cap`` times its size and what the cap leaves goes to the
    others by weight. The fixed point has a closed form: sort by cap / weight; the capped
    sources are a prefix of that order, and the first level that fits is the answer.
    """
    nth = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("heft", F.sum("weight").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.col("heft") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("fits", F.col("level") * F.col("weight") <= F.col("most"))
    s = s.withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)["level"])
    target = F.when(F.col("final").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("final") * F.col("weight")))
    return s.select(*sizes.columns, target.alias("target"))


def share_below(key: str, classes: str) -> Column:
    """How many of a source's rows are expected to have a smaller key, from its weight classes (array of w, n)."""
    return F.aggregate(classes, F.lit(0.0), lambda a, c: a + c["n"] * (1 - F.exp(-F.col(key) * c["w"])))


def mix(docs: DataFrame, weight: Column | None = None, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (its columns ``carry``, all by default) plus size, source_size, target and taken (words, repeats counted)."""
    text = F.col("text")
    weight = quality_weight(text) if weight is None else weight
    keep = [c for c in carry or docs.columns if c.lower() not in ADDED]
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null|"), F.coalesce(F.md5(text), F.lit(""))))
    rows = docs.select(
        F.struct(*keep).alias("_row"),  # no name of a carried column meets one of ours
        "source",
        word_count(text).alias("size"),
        (-F.log(unit_hash(F.lit(seed), name))).alias("_draw"),
        F.when(weight > 0, weight.cast("double")).otherwise(F.lit(2.0**-32)).alias("_weight"),
        F.md5(text).alias("_tie"),
    )
    rows = rows.withColumn("_key", F.col("_draw") / F.col("_weight")).withColumn("_class", F.round(8 * F.log2("_weight"))).drop("_draw", "_weight")
    # What the sums need is written once; texts that are carried aren't, they are counted a second time instead.
    light = materialise(rows if "text" not in keep else rows.drop("_row"), "mix-rows")
    rows = rows if "text" in keep else light
    classes = light.groupBy("source", "_class").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    sources = classes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("_n"), F.collect_list(F.struct(F.pow(F.lit(2.0), F.col("_class") / 8).alias("w"), F.col("n").alias("n"))).alias("_classes"))
    plan = source_targets(sources).withColumnRenamed("source", "_source")
    plan = plan.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("_rest", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    plan = plan.withColumn("_buckets", F.ceil(F.sqrt(F.col("_n"))).cast("double"))
    plan = materialise(plan, "mix-plan")
    plan = F.broadcast(plan) if plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else plan

    def dealt(x: DataFrame) -> DataFrame:
        x = x.join(plan, x["source"].eqNullSafe(plan["_source"])).drop("_source")
        return x.withColumn("_bucket", F.floor(share_below("_key", "_classes") / F.col("_n") * F.col("_buckets"))).drop("_classes", "_n", "_class")

    rows = dealt(rows)
    sums = dealt(light).groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_source"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    rows = rows.join(sums, rows["source"].eqNullSafe(sums["_source"]) & (rows["_bucket"] == sums["_b"])).drop("_source", "_b")
    inside = W.partitionBy("source", "_bucket").orderBy("_key", "size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    taken = (F.col("_epochs") * F.col("size") + part).cast("long")
    return rows.select("_row.*", "size", "source_size", "target", taken.alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; texts are reduced to a weight before any row moves."""
    docs = documents(spark, sf_dir)
    return mix(docs, carry=["doc_id"])


#: The same mix for DuckDB, with whole windows in place of buckets.
OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(text) AS tie,
    COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    COALESCE(1.0::DOUBLE - least(0.75::DOUBLE, 3.0::DOUBLE * ((length(text) - length(translate(text, '#$%&*|!~^=+<>{}[]\/@_', '')))::DOUBLE / greatest(length(text), 1)::DOUBLE)), 1.0::DOUBLE) AS w,
    (('0x' || substr(md5('mix|' || COALESCE(doc_id::VARCHAR, 'null|' || COALESCE(md5(text), ''))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER () - COALESCE(sum(most) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - COALESCE(sum(weight) OVER (ORDER BY most / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM n),
f AS (SELECT first(level ORDER BY most / weight, level) AS final FROM l WHERE level * weight <= most),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN most ELSE least(most, final * weight) END AS target FROM l LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
b AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS rest,
  COALESCE(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, d.size, d.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM b
"""
