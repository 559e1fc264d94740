"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors get one more component that makes all norms equal (queries get a zero there), which
turns the largest inner product into the least distance. Centroids come from a balanced
k-means of a sample: clusters over the mean size are split until none is above
``BALANCE`` times it. Each vector joins the list of its nearest centroid and of further ones
whose distance is within 1 + one of ``BOUNDARIES`` of it (at most ``COPIES``). By the counts of all vectors the
lists are laid end to end, neighbouring centroids together, and cut into shards of ``SHARD`` entries; a list that is longer
spreads over several, so a vector repeated a million times makes no long task.

A query walks a graph over the centroids best first, keeps the lists whose centroid is within
a ratio of the nearest, and goes once to each shard that holds a part of them, ``QUERIES`` at a time. There it meets its lists only;
scores are double precision products of the original vectors. A shard reports a query's best ``k`` as
one row in the final order (score, then smaller id), so ties across shards end exactly.

There are about as many lists as a list has members, ``CENTROIDS`` at most; the sample (chosen by hash) has
``SAMPLE`` vectors or eight a centroid. Every vector is indexed.
The ratio comes from the data: up to ``ASKED`` sampled vectors are queries whose true neighbours in the
sample are found by brute force, and it is the least one, ``1 + RATIO`` at least, at which the lists
kept hold ``TARGET`` of them. Of the boundaries the one counts at which those queries meet the fewest
entries: where most lists must be read, wide replication only repeats vectors. A query's lists are added to until they hold k other vectors for sure.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; shorter vectors
count as if they ended in zeros; of the rows that repeat an id with equal vectors one
counts; rows of one id with different vectors are queries of their own, and no row is a candidate for a
query of its id; fewer candidates than k give shorter answers; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._shared import materialise

K, EVERY = 20, 20
SAMPLE, CENTROIDS, FLAT = 20_000, 65_536, 1024  # up to FLAT centroids come from one k-means, more from two levels
BALANCE, COPIES, BOUNDARIES, SHARD = 1.5, 3, (0.05, 0.02, 0.01, 0.005), 16_384
QUERIES, TOGETHER = 8192, 64  # queries that meet a shard in one row, and in one product
RATIO, DEGREE, BEAM = 0.15, 24, 48
RUN = 64  # neighbouring scores of which the largest stands for all
ASKED, TARGET = 500, 0.97


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, all of one length; floats stay floats until they are used."""
    kind = "float" if table.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull())
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0))
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    return rows.select("vec_id", F.concat("vector", F.array_repeat(F.lit(0).cast(kind), F.lit(width) - F.size("vector"))).alias("vector")).dropDuplicates()


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def balanced_centroids(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """About k centroids of the sample; clusters that stay too large are split in two."""
    if k > FLAT:
        top = balanced_centroids(x, int(k**0.5), seed)
        near = np.concatenate([_distances(x[i : i + 4096], top).argmin(axis=1) for i in range(0, len(x), 4096)])
        return np.concatenate([balanced_centroids(x[near == j], max(1, round(k * (near == j).mean())), seed) for j in range(len(top)) if (near == j).any()])
    rng = np.random.default_rng(seed)
    uniq = np.unique(x, axis=0)
    k = min(k, len(uniq))
    c = uniq[rng.choice(len(uniq), k, replace=False)].copy()
    for _ in range(8):
        near = _distances(uniq, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, uniq)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        for big in np.flatnonzero(n > BALANCE * len(uniq) / k):
            mine = uniq[near == big]
            c[n.argmin()], n[n.argmin()] = mine[rng.integers(len(mine))], n[big] // 2
    return c


class Graph:
    """Neighbour lists over the centroids, searched best first for many queries at once."""

    def __init__(self, c: np.ndarray) -> None:
        self.c = c
        near = np.concatenate([np.argsort(_distances(c[i : i + 1024], c), axis=1, kind="stable")[:, 1 : DEGREE + 1] for i in range(0, len(c), 1024)])
        # A few long edges keep the graph connected.
        far = np.random.default_rng(5).integers(0, len(c), (len(c), 4))
        self.edges = np.concatenate((near, far), axis=1)
        self.entry = np.unique(np.linspace(0, len(c) - 1, min(len(c), 32)).astype(int))

    def search(self, q: np.ndarray, ratio: float) -> list[np.ndarray]:
        """Centroids within 1 + ratio of the nearest for each query, nearest first."""
        out = []
        norm = (self.c * self.c).sum(axis=1)
        for x in q:
            known = np.full(len(self.c), np.inf)
            done = np.zeros(len(self.c), bool)
            xx, todo = float(x @ x), self.entry
            while len(todo):
                known[todo] = np.sqrt(np.maximum(xx - 2 * self.c[todo] @ x + norm[todo], 0))
                # Grow from every centroid inside the limit, and at least from the BEAM nearest.
                limit = max((1 + ratio) * known.min(), np.partition(known, min(BEAM, len(known) - 1))[min(BEAM, len(known) - 1)])
                grow = np.flatnonzero((known <= limit) & ~done & np.isfinite(known))
                done[grow] = True
                todo = np.unique(self.edges[grow])
                todo = todo[~np.isfinite(known[todo])]
            keep = np.flatnonzero(known <= (1 + ratio) * known.min())
            out.append(keep[np.argsort(known[keep], kind="stable")])
        return out


def lift(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(largest - (x * x).sum(axis=1), 0))
    return np.concatenate((x, extra[:, None]), axis=1)


def _nearest(x: np.ndarray, c: np.ndarray, block: int = 250) -> tuple[np.ndarray, np.ndarray]:
    """The nearest COPIES centroids of each vector, nearest first, and their distances."""
    m = min(COPIES, len(c))
    near, away = np.zeros((len(x), m), np.int64), np.zeros((len(x), m))
    turned, norm = -2 * c.T, (c * c).sum(axis=1)
    for lo in range(0, len(x), block):
        part = x[lo : lo + block]
        d = part @ turned
        d += norm
        rows = np.arange(len(part))
        for j in range(m):
            at = d.argmin(axis=1)
            near[lo : lo + block, j], away[lo : lo + block, j] = at, d[rows, at]
            d[rows, at] = np.inf
    return near, np.sqrt(np.maximum(away + (x * x).sum(axis=1)[:, None], 0))


def _joined(away: np.ndarray, boundary: float) -> np.ndarray:
    """Which of its nearest lists a vector joins."""
    return away <= (1 + boundary) * away[:, :1]


def fitted(x: np.ndarray, c: np.ndarray, largest: float, k: int, seed: int = 11) -> tuple[float, float]:
    """(ratio, boundary): the ratio at which sampled queries reach TARGET of their true neighbours in the sample ``x``, and the boundary at which that takes the fewest entries."""
    if len(x) < 2:
        return RATIO, BOUNDARIES[0]
    near, far = _nearest(lift(x, largest, False), c)
    asked = np.random.default_rng(seed).permutation(len(x))[:ASKED]
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    m = min(k, len(x) - 1)
    true = np.argpartition(-s, m - 1, axis=1)[:, :m]
    d = np.sqrt(_distances(lift(x[asked], largest, True), c))
    least = d.min(axis=1)
    away = np.take_along_axis(d[:, None, :], near[true].reshape(len(asked), 1, -1), axis=2).reshape(len(asked), m, -1)
    found = []
    for boundary in BOUNDARIES:
        joins = _joined(far, boundary)
        reach = np.where(joins[true], away, np.inf).min(axis=2) / np.maximum(least, 1e-12)[:, None]
        ratio = max(RATIO, float(np.quantile(reach, TARGET, method="higher")) - 1 + 1e-9)
        met = (d <= (1 + ratio) * least[:, None]) @ np.bincount(near[joins], minlength=len(c)).astype(float)
        found.append((float(met.mean()), ratio, boundary))
    return min(found, key=lambda f: f[0])[1:]


def _assign(shared, boundary: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, largest = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                x = matrix(part.column("vector"))
                near, away = _nearest(lift(x, largest, False), graph.c)
                row, nth = np.nonzero(_joined(away, boundary))
                yield pa.RecordBatch.from_arrays([pa.array(near[row, nth].astype(np.int32)), part.column("vec_id").take(pa.array(row)), part.column("vector").take(pa.array(row))], names=["list", "vec_id", "vector"])

    return run


def _route(shared, sizes: np.ndarray, k: int, ratio: float):
    """Each query's lists, by shard. They hold COPIES * (k + 1) entries or more, so k other vectors at least, or are all lists."""
    ends = np.cumsum(sizes)
    low, high = (ends - sizes) // SHARD, (ends - 1) // SHARD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, largest = shared.value
        for batch in batches:
            x = matrix(batch.column("vector"))
            q = lift(x, largest, True)
            rows, shards, lists = [], [], []
            for i, found in enumerate(graph.search(q, ratio)):
                if sizes[found].sum() < COPIES * (k + 1):
                    near = np.argsort(_distances(q[i : i + 1], graph.c)[0], kind="stable")
                    found = near[: int(np.searchsorted(np.cumsum(sizes[near]), COPIES * (k + 1))) + 1]
                found = found[sizes[found] > 0]
                n = high[found] - low[found] + 1
                at = np.repeat(low[found] - np.cumsum(n) + n, n) + np.arange(n.sum())
                order = np.argsort(at, kind="stable")
                at, what = at[order], np.repeat(found, n)[order]
                cut = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else at
                rows += [i] * len(cut)
                shards += at[cut].tolist()
                lists += np.split(what.astype(np.int32), cut[1:]) if len(cut) else []
            if rows:
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), *(batch.column(c).take(take) for c in ("query", "vec_id", "vector")), pa.array(lists, pa.list_(pa.int32()))], names=["shard", "query", "vec_id", "vector", "lists"])

    return run


def best(s: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of the scores ``s`` of q against x, ids once each; recomputed, so that equal vectors get equal scores."""
    m = COPIES * k
    # The m-th largest of the runs' maxima is no more than the m-th largest score: what is below is passed over at once.
    tops = np.maximum.reduceat(s, np.arange(0, len(s), RUN)) if len(s) > RUN * m else s[:0]
    low = np.partition(tops, len(tops) - m)[len(tops) - m] if len(tops) > m else -np.inf
    some = np.flatnonzero(s >= low - 1e-9 * max(1.0, abs(low))) if low > -np.inf else np.flatnonzero(s > -np.inf)
    m = min(m, len(some))
    if not m:
        return ids[:0], s[:0]
    edge = np.partition(s[some], len(some) - m)[len(some) - m]
    at = some[s[some] >= edge - 1e-9 * max(1.0, abs(edge))]
    exact = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -exact))
    got, exact = ids[at][order], exact[order]
    new = np.sort(np.unique(got, return_index=True)[1])[:k]
    return got[new], exact[new]


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked, members in zip(batch.column("queries"), batch.column("members"), strict=True):
                asked, members = asked.values, members.values
                lists = np.asarray(members.field("list"))
                order = np.argsort(lists, kind="stable")
                lists, ids, x = lists[order], np.asarray(members.field("vec_id"))[order], matrix(members.field("vector"))[order]
                heads = np.flatnonzero(np.concatenate(([True], lists[1:] != lists[:-1])))
                tails = np.append(heads[1:], len(lists))
                for lo in range(0, len(asked), TOGETHER):
                    part = asked.slice(lo, TOGETHER)
                    qx, own = matrix(part.field("vector")), np.asarray(part.field("vec_id"))
                    want = part.field("lists")
                    row, what = np.repeat(np.arange(len(part)), np.asarray(want.value_lengths())), np.asarray(want.flatten())
                    s = np.full((len(part), len(ids)), -np.inf)
                    for a, b in zip(heads, tails, strict=True):
                        mine = row[what == lists[a]]
                        s[mine, a:b] = qx[mine] @ x[a:b].T
                    s[own[:, None] == ids] = -np.inf
                    got = [best(s[r], qx[r], ids, x, k) for r in range(len(part))]
                    yield pa.RecordBatch.from_arrays([part.field("query"), part.field("vec_id"), pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64()))], names=["query", "query_id", "ids", "scores"])

    return run


def search(table: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id ``every`` divides."""
    spark = table.sparkSession
    rows = materialise(usable(table), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("largest")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not size["n"]:
        return spark.createDataFrame([], schema)
    k_lists = int(min(CENTROIDS, max(1, round(size["n"] ** 0.5))))
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < max(SAMPLE, 8 * k_lists) / size["n"]).select("vec_id", "vector").toArrow()
    if not sample.num_rows:  # a sample of a tiny table may be empty
        sample = rows.limit(1).toArrow()
    x = matrix(sample["vector"].combine_chunks())
    x = x[np.lexsort((*x.T, np.asarray(sample["vec_id"])))]
    c = balanced_centroids(lift(x, size["largest"], False), k_lists)
    # Neighbouring centroids get neighbouring numbers, by the direction in which they spread most.
    c = c[np.argsort((c - c.mean(axis=0)) @ np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0], kind="stable")]
    graph = Graph(c)
    ratio, boundary = fitted(x, graph.c, size["largest"], k)
    # At most CENTROIDS vectors and DEGREE edges each.
    shared = spark.sparkContext.broadcast((graph, size["largest"]))
    kind = rows.schema["vector"].dataType.simpleString()
    lists = materialise(rows.mapInArrow(_assign(shared, boundary), f"list int, vec_id long, vector {kind}"), "lists")
    sizes = np.zeros(len(graph.c), np.int64)
    for r in lists.groupBy("list").agg(F.count("*").alias("n")).collect():  # one row a centroid
        sizes[r["list"]] = r["n"]
    ends = np.cumsum(sizes)
    layout = spark.createDataFrame([(i, int(e - n), int(n)) for i, (e, n) in enumerate(zip(ends, sizes, strict=True))], "l int, base long, n long")
    within = F.floor(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n"))
    placed = lists.join(F.broadcast(layout), F.col("list") == F.col("l")).withColumn("shard", F.floor((F.col("base") + within) / F.lit(SHARD)))
    members = placed.groupBy("shard").agg(F.collect_list(F.struct("list", "vec_id", "vector")).alias("members"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.xxhash64("vec_id", "vector").alias("query"), "vec_id", "vector")
    asked = materialise(queries.mapInArrow(_route(shared, sizes, k, ratio), f"shard long, query long, vec_id long, vector {kind}, lists array<int>"), "asked")
    parts = asked.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("parts")).withColumnRenamed("shard", "at")
    share = asked.join(F.broadcast(parts), F.col("shard") == F.col("at")).withColumn("part", F.pmod(F.xxhash64("query", F.lit(2)), F.col("parts")).cast("int"))
    share = share.groupBy("shard", "part").agg(F.collect_list(F.struct("query", "vec_id", "vector", "lists")).alias("queries"))
    # A shard is sent once for QUERIES of its queries, so no task gets all of a popular one's.
    members = members.join(F.broadcast(parts), F.col("shard") == F.col("at")).select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "members")
    met = share.join(members, ["shard", "part"]).select("queries", "members")
    found = met.mapInArrow(_score(k), "query long, query_id long, ids array<long>, scores array<double>")
    # One row a query and shard; merged as arrays, so nothing is exploded but the k of the answer.
    pair = F.transform(F.arrays_zip("scores", "ids"), lambda z: F.struct((F.lit(0.0) - z["scores"]).alias("less"), z["ids"].alias("id")))
    whole = found.select("query", "query_id", pair.alias("pairs")).groupBy("query", "query_id").agg(F.slice(F.array_distinct(F.array_sort(F.flatten(F.collect_list("pairs")))), 1, k).alias("pairs"))
    out = whole.select("query_id", F.posexplode("pairs").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (F.lit(0.0) - F.col("x.less")).alias("score"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
