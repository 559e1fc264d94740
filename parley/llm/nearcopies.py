"""Near copies by exact Jaccard similarity of five-word shingles, 0.8 or more.

Words are those of the SimHash (ASCII lower case, split at white space); a text of fewer words
than a shingle is one shingle. Rows with equal shingle sets are one node.

Two sets of similarity 0.8 share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, in any
one order of all shingles, and the shorter has it among its first ``n - ceil(8/9 n) + 1``; so no pair is
lost by meeting on those only. The order puts shingles that a sample of the texts repeats last; it
decides about speed, not about results.

1. Nodes that share such a shingle are compared with up to ``HUBS`` of the nodes that have it, so a group of
   n copies costs n pairs, not n * n. A shingle with no more nodes than hubs is done.
2. What is left are pairs whose nodes are still in different components after that. Every node outside the largest
   component of a shingle is compared with all nodes of other components there whose lengths,
   positions and ``BITS`` admit the similarity. In a group of copies that hang together nothing is left for this.

Each node has a string of parities: bit i tells whether an odd number of its shingles fall on i. Two
sets differ in at least as many shingles as their strings in bits, which rules most pairs out before a set is moved.
The rest are compared by the whole sets, as joins: nothing holds a group in memory.

Nodes are 64-bit hashes of sets of 64-bit hashes: the chance that any two of n shingles are mixed up is n * n / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm._shared import materialise, release
from parley.llm.components import components

SHINGLE, HUBS, BITS = 5, 8, 1024
SAMPLE, SHARE, COMMON = 10_000, 0.05, 500_000  # rows of the sample: the larger of both; shingles in the order's table
U = np.uint64
ODDS = tuple(map(U, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))


def row_key() -> Column:
    """32 bytes that tell rows by id and text; nulls differ from all values."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part("doc_id"), F.lit(" "), part("text")).cast("binary"), 256))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: those of their words, mixed in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), U, len(words))
    k = min(SHINGLE, len(w))
    n, h = len(w) - k + 1, U(k)
    for i in range(k):
        h = (h ^ w[i : i + n]) * ODDS[i]
        h ^= h >> U(29)
    h *= ODDS[0]
    return np.unique((h ^ (h >> U(32))).view(np.int64))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column("text"):
            yield pa.RecordBatch.from_arrays([pa.array(shingles(text.as_py()))], names=["token"])


def _nodes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, times = shared.value
        for batch in batches:
            nodes, sizes, firsts, odd = [], [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py())
                nodes.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                sizes.append(len(s))
                odd.append(np.packbits(np.bincount(s & (BITS - 1), minlength=BITS).astype(np.uint8) & 1).view(np.int64))
                count = np.zeros(len(s), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    count = np.where(common[at] == s, times[at], 0)
                firsts.append(s[np.lexsort((s, count))[: len(s) - (4 * len(s) + 4) // 5 + 1]])
            yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array(np.array(nodes, U).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))], names=["row_key", "node", "n", "first", "odd"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of the rows; of equal rows that follow each other one counts."""
    last = None
    for batch in batches:
        for lo in range(0, len(batch), 500):
            part = batch.slice(lo, 500)
            nodes = part.column("node").to_pylist()
            new = [i for i, x in enumerate(nodes) if x != (nodes[i - 1] if i else last)]
            last = nodes[-1]
            got = [shingles(part.column("text")[i].as_py()) for i in new]
            yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(new, pa.int64())), pa.array(got, pa.list_(pa.int64()))], names=["node", "shingles"])


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of the rows repeats, ``COMMON`` at most, and how often."""
    chance = F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.where(chance < min(1.0, max(SHARE, SAMPLE / max(1, rows.count())))).select("text").mapInArrow(_tokens, "token long")
    counts = materialise(drawn.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "frequent")
    least, total = 2, 0
    for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count("*").alias("of")).orderBy(F.desc("n")).collect():
        total += r["of"]
        if total > COMMON:
            least = r["n"] + 1
            break
    got = counts.where(F.col("n") >= least).orderBy("token").toArrow()
    return np.asarray(got["token"]), np.asarray(got["n"])


def _possible(n: str, pos: str, m: str, at: str) -> Column:
    """Whether sets of n and m shingles that meet at these places can be 0.8 similar."""
    longest = F.least(F.col(pos), F.col(at)) + F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * longest >= 4 * (F.col(n) + F.col(m)))


def _near(x: str, y: str, n: str, m: str) -> Column:
    """Whether sets of these parities can be 0.8 similar: their difference is at most a ninth of both."""
    apart = sum(F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(BITS // 64))
    return 9 * apart <= F.col(n) + F.col(m)


def _similar(pairs: DataFrame, rows: DataFrame, own: DataFrame) -> DataFrame:
    """Those of the (a, b) that are 0.8 similar or more, by their whole sets."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    one = own.groupBy("node").agg(F.min("row_key").alias("k")).join(need, "node")
    texts = rows.join(one, F.col("row_key") == F.col("k")).select("node", "text")
    sets = materialise(texts.mapInArrow(_sets, "node long, shingles array<long>"), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return materialise(pairs.join(left, "a").join(right, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b"), "near")


def near_copies(docs: DataFrame) -> DataFrame:
    """(row_key, root long) of every row: rows of one root are joined by a chain of near copies."""
    spark = docs.sparkSession
    rows = docs.select(row_key().alias("row_key"), "text")
    shared = spark.sparkContext.broadcast(frequent(rows))
    whole = materialise(rows.mapInArrow(_nodes(shared), "row_key binary, node long, n int, first array<long>, odd array<long>"), "shingles")
    own = materialise(whole.select("row_key", "node"), "row-nodes")
    nodes = materialise(whole.groupBy("node").agg(F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("first").alias("first")), "nodes")
    release(whole)
    parity = materialise(nodes.select("node", "n", "odd"), "parities")
    tokens = nodes.select("node", "n", F.posexplode("first").alias("pos", "token")).repartition("token")
    often = tokens.groupBy("token").agg(F.count("*").alias("of")).where("of > 1").select(F.col("token").alias("t"), "of")
    met = materialise(tokens.join(often, F.col("token") == F.col("t")).drop("t"), "met")
    release(nodes)
    hubs = met.groupBy("token").agg(F.first("of").alias("of"), *(F.min_by(F.struct("node", "n", "pos"), F.xxhash64("node", F.lit(i))).alias(f"h{i}") for i in range(HUBS)))
    hubs = materialise(hubs.select(F.col("token").alias("t"), F.array_distinct(F.array(*(f"h{i}" for i in range(HUBS)))).alias("hubs"), (F.size("hubs") < F.col("of")).alias("more")), "hubs")
    first = met.join(hubs, F.col("token") == F.col("t")).select("node", "n", "pos", F.explode("hubs").alias("h")).select("node", "n", "pos", F.col("h.node").alias("b"), F.col("h.n").alias("m"), F.col("h.pos").alias("at"))
    first = first.where((F.col("node") != F.col("b")) & _possible("n", "pos", "m", "at"))
    pairs = first.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    pairs = pairs.join(parity.toDF("a", "n", "x"), "a").join(parity.toDF("b", "m", "y"), "b").where(_near("x", "y", "n", "m")).select("a", "b")
    pairs = materialise(pairs, "pairs")
    found = _similar(pairs, rows, own)
    label = materialise(components(found).select(F.col("node").alias("x"), "root"), "label")

    # Shingles whose nodes aren't all hubs and not all in one component.
    open_ = met.join(hubs.where("more").select("t"), F.col("token") == F.col("t"), "left_semi")
    named = open_.join(label, F.col("node") == F.col("x"), "left").withColumn("root", F.coalesce("root", "node")).drop("x")
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select(F.col("token").alias("t"))
    named = materialise(named.join(mixed, F.col("token") == F.col("t"), "left_semi").join(parity.select(F.col("node").alias("x"), "odd"), F.col("node") == F.col("x")).drop("x"), "mixed")
    if not named.isEmpty():
        most = named.groupBy("token", "root").count().groupBy("token").agg(F.max_by("root", "count").alias("most"))
        minor = named.join(most.withColumnRenamed("token", "t"), F.col("token") == F.col("t")).where(F.col("root") != F.col("most"))
        minor = minor.select(F.col("token").alias("t"), F.col("node").alias("b"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("root").alias("other"), F.col("odd").alias("odds"))
        # The shorter one has the shared shingle early.
        early = F.when(F.col("n") <= F.col("m"), 9 * F.col("pos") <= F.col("n")).otherwise(9 * F.col("at") <= F.col("m"))
        rest = named.join(minor, (F.col("token") == F.col("t")) & (F.col("root") != F.col("other")) & _possible("n", "pos", "m", "at") & early & _near("odd", "odds", "n", "m"))
        rest = rest.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        found = found.union(_similar(materialise(rest, "rest"), rows, own))
        label = components(found).select(F.col("node").alias("x"), "root")
    return own.select("row_key", "node").join(label, F.col("node") == F.col("x"), "left").select("row_key", F.coalesce("root", "node").alias("root"))
