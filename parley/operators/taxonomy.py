"""Intent taxonomy: clusters, their examples, names and purity.

Clusters come from k-means over unit vectors, in place of a density clustering that Spark
lacks: labels differ from such a one, and points farther from their centre than ``noise`` of all
distances allows are left out as cluster -1.
"""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parley.operators.retrieval import unit

# Seed labels and the words that suggest them, in order.
SEEDS = [
    ("Software_Update_Failure", ["update", "ios", "install", "upgrade", "download error"]),
    ("Device_Performance_Degradation", ["battery", "slow", "freeze", "crash", "drain", "heat", "lag"]),
    ("Account_Recovery", ["password", "apple id", "login", "locked", "reset", "icloud"]),
    ("Outrage_Escalation", ["lawyer", "sue", "unacceptable", "furious", "danger", "exploded", "fire"]),
]


def cluster(vectors: DataFrame, k: int, noise: float = 0.95, seed: int = 42) -> DataFrame:
    """Rows plus cluster_id, probability (1 at the centre, 0 at the limit) and distance."""
    rows = vectors.withColumn("_v", array_to_vector(unit(F.col("vector"))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster_id").fit(rows)
    centers = F.array(*(F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()))  # k vectors
    out = model.transform(rows).withColumn("_c", centers[F.col("cluster_id")])
    d = F.sqrt(F.aggregate(F.zip_with(vector_to_array(F.col("_v")), "_c", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x))
    out = out.withColumn("distance", d)
    limit = out.agg(F.percentile_approx("distance", noise, 10_000).alias("_limit"))  # one row
    out = out.crossJoin(F.broadcast(limit))
    p = F.greatest(F.lit(0.0), 1 - F.col("distance") / F.when(F.col("_limit") == 0, 1.0).otherwise(F.col("_limit")))
    return out.withColumn("probability", p).withColumn("cluster_id", F.when(F.col("distance") > F.col("_limit"), -1).otherwise(F.col("cluster_id"))).drop("_v", "_c", "_limit")


def centroids(rows: DataFrame) -> DataFrame:
    """(cluster_id, centroid): the mean vector of each cluster."""
    flat = rows.where("cluster_id <> -1").select("cluster_id", F.posexplode("vector").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg("x").alias("x"))
    return flat.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def representatives(rows: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """The k rows nearest to each cluster's centroid, with their order."""
    near = rows.where("cluster_id <> -1").join(F.broadcast(centroids(rows)), "cluster_id")  # one row a cluster
    d = F.aggregate(F.zip_with("vector", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    return near.withColumn("_d", d).withColumn("nth", F.row_number().over(W.partitionBy("cluster_id").orderBy("_d", key))).where(F.col("nth") <= k).drop("_d", "centroid")


def suggest_label(text: Column, cluster_id: Column) -> Column:
    out = F.when(cluster_id == -1, "Unclassified")
    for name, words in SEEDS:
        out = out.when(F.lower(text).rlike("|".join(words)), name)
    return out.otherwise(F.concat(F.lit("Cluster_"), cluster_id.cast("string")))


def sanitize_label(label: Column, cluster_id: Column) -> Column:
    """A proposed name as Words_With_Underscores; quotes, prefixes and list numbers go, nothing usable is Cluster_n."""
    s = F.regexp_replace(F.trim(label), "^[\"'`]+|[\"'`]+$", "")
    s = F.trim(F.regexp_replace(F.trim(s), "(?i)^(?:(?:label|category|intent|name):\\s*)+", ""))
    s = F.trim(F.regexp_replace(s, r"^(?:\d+\s*[.)\-]\s*|\d+\s*[:./-]\s*)", ""))
    good = r"^[A-Z][A-Za-z0-9]*(?:_[A-Z0-9][A-Za-z0-9]*)*$"
    words = F.array_join(F.transform(F.regexp_extract_all(s, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000)))), "_")
    return F.when(s.rlike(good), s).when(words.rlike(good), words).otherwise(F.concat(F.lit("Cluster_"), cluster_id.cast("string")))


def resolve_collisions(labels: DataFrame) -> DataFrame:
    """(cluster_id, label): repeated labels get _2, _3 in order of the cluster; -1 is exempt."""
    nth = F.row_number().over(W.partitionBy("label").orderBy("cluster_id"))
    free = (F.col("cluster_id") == -1) | (F.col("label") == "Unclassified")
    return labels.withColumn("_n", nth).withColumn("label", F.when(free, "Unclassified").when(F.col("_n") > 1, F.concat("label", F.lit("_"), F.col("_n").cast("string"))).otherwise(F.col("label"))).drop("_n")


def purity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster_id").agg(F.coalesce(F.avg("probability"), F.lit(0.0)).alias("purity"), F.count("*").alias("size"))


def induce(rows: DataFrame, k: int, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(clusters with label, purity and size; assignments)."""
    got = cluster(rows, k)
    words = representatives(got, key=key).groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", text))), lambda s: s[text]), " ").alias("_t"))
    named = purity(got).join(words, "cluster_id", "left").withColumn("label", suggest_label(F.coalesce("_t", F.lit("")), F.col("cluster_id"))).drop("_t")
    return resolve_collisions(named), got


def zero_shot(vectors: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, class_id, similarity): the class (class_id, vector) nearest to each row; ties to the smaller class. Classes are few: their count is checked before they are sent to all."""
    from parley.operators.retrieval import dot

    c = classes.select("class_id", unit(F.col("vector")).alias("_c"))
    few = c.limit(10_001).count() <= 10_000
    met = vectors.select("doc_id", unit(F.col("vector")).alias("_v")).crossJoin(F.broadcast(c) if few else c)
    best = met.groupBy("doc_id").agg(F.min_by(F.struct("class_id", dot(F.col("_v"), F.col("_c")).alias("similarity")), F.struct((-dot(F.col("_v"), F.col("_c"))).alias("s"), "class_id")).alias("b"))
    return best.select("doc_id", "b.class_id", "b.similarity")
