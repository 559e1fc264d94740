"""SimHash near-duplicates by a binary trie self-join.

Fingerprints: ASCII letters lower-cased, words split at ASCII white space, 3-word shingles
with repeats, XXH64 (seed 42) of each; a bit is set if it is set in over half the hashes.

Join: within two differing bits, at least one of three blocks of bits is equal. Each
distinct fingerprint is therefore entered three times, once per block, in a trie whose bit
order starts with that block; node pairs are walked together from there, adding differing
bits and dropping a pair of nodes once the sum passes the budget. A subtree that holds more
than ``MOST`` fingerprints is dealt out again by a second block of the bits that are left,
and then by a third, so no task ever holds an unbounded subtree. A pair is counted only in
the first block (and sub-block) that it has equal.

Copies collapse to their fingerprint before anything is joined; a subtree reports a spanning
forest and the number of partners, never its pairs.

Defined results: null and empty texts have fingerprint zero and link as any other; repeated
rows each get a row; rows with a null id get a fingerprint and their group's component, which
is the smallest non-null id (null if the group has none); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._shared import documents, materialise
from parley.llm.components import components

SHINGLE, BUDGET, MOST = 3, 2, 1000
PIECE = 200_000  # shingles of a text whose bits are added up at once


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    one, n, ones = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    a, b = starts.tolist(), ends.tolist()
    for i in range(0, n, PIECE):
        h = np.fromiter((one(joined[x:y], 42) for x, y in zip(a[i : i + PIECE], b[i : i + PIECE], strict=True)), np.uint64, min(PIECE, n - i))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.array([fingerprint(t.as_py()) for t in batch.column("text")], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.int64())], names=["doc_id", "fp"])


def sizes(bits: int) -> list[int]:
    """Widths of the three blocks of ``bits``, from the top."""
    return [bits - 2 * (bits // 3), bits // 3, bits // 3]


def split(v: np.ndarray, bits: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's value, and the other bits moved together."""
    width, below = sizes(bits)[block], sum(sizes(bits)[block + 1 :])
    mine = (v >> np.uint64(below)) & np.uint64((1 << width) - 1)
    return mine, (v >> np.uint64(below) >> np.uint64(width)) << np.uint64(below) | v & np.uint64((1 << below) - 1)


def descend(v: np.ndarray, path: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Follow a path of blocks: the bits that make the key, the free bits and their number."""
    key, bits = np.zeros_like(v), 64
    for block in path:
        mine, v = split(v, bits, block)
        width = sizes(bits)[block]
        key, bits = key << np.uint64(width) | mine, bits - width
    return key, v, bits


def first_equal(diff: np.ndarray, path: list[int]) -> np.ndarray:
    """Whether pairs with these differing bits have no equal block before the ones of ``path``."""
    out, bits = np.ones(len(diff), bool), 64
    for block in path:
        for before in range(block):
            out &= split(diff, bits, before)[0] != 0
        diff, bits = split(diff, bits, block)[1], bits - sizes(bits)[block]
    return out


def trie_pairs(keys: np.ndarray, bounds: np.ndarray, bits: int, budget: int = BUDGET, leaf: int = 24) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j within a root whose ``keys`` (sorted in each root) differ in at most ``budget`` of the low ``bits``.

    ``bounds`` are the roots' borders. Node pairs are walked in whole levels as (lo, hi) of both
    nodes and the bits in which their prefixes differ; those over the budget are dropped.
    Small node pairs are finished key by key.
    """
    front = (bounds[:-1], bounds[1:], bounds[:-1], bounds[1:], np.zeros(len(bounds) - 1, np.int64))
    for bit in range(bits - 1, -2, -1):
        a0, a1, b0, b1, _ = front
        small = (a1 - a0) * (b1 - b0) <= (leaf * leaf if bit >= 0 else np.iinfo(np.int64).max)
        x0, x1, y0, y1 = (v[small] for v in front[:4])
        total = (x1 - x0) * (y1 - y0)
        cuts = np.searchsorted(np.cumsum(total), np.arange(0, total.sum() + 1, 2_000_000))
        for lo, hi in zip(cuts, [*cuts[1:], len(total)], strict=True):
            part = total[lo:hi]
            at = np.repeat(np.arange(lo, hi), part)
            k = np.arange(part.sum()) - np.repeat(np.cumsum(part) - part, part)
            wide = (y1 - y0)[at]
            i, j = x0[at] + k // wide, y0[at] + k % wide
            ok = i < j
            ok[ok] = np.bitwise_count(keys[i[ok]] ^ keys[j[ok]]) <= budget
            yield i[ok], j[ok]
        if small.all():
            return
        a0, a1, b0, b1, err = (v[~small] for v in front)
        ones = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])  # a node's right child starts there
        apart = (a0 != b0) | (a1 != b1)
        kids = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1), tuple(v[apart] for v in (am, a1, b0, bm, err + 1))]
        front = tuple(np.concatenate(v) for v in zip(*kids, strict=True))
        live = (front[0] < front[1]) & (front[2] < front[3]) & (front[4] <= budget)
        front = tuple(v[live] for v in front)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], tell) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes; ``tell`` gets every batch of pairs."""
    root = np.arange(n)
    for i, j in pairs:
        tell(i, j)
        while len(i):
            a, b = root[i], root[j]
            far = a != b
            i, j, a, b = i[far], j[far], a[far], b[far]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _expand(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            paths = np.asarray(batch.column("path")) if level else np.zeros(len(fp), np.int32)
            for block in range(3):
                for old in np.unique(paths):
                    mine = np.flatnonzero(paths == old)
                    path = (int(old) * 3 + block) if level else block
                    key = descend(fp[mine], digits(path, level + 1))[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), path, np.int32)), pa.array(key.view(np.int64)), batch.column("fp").take(pa.array(mine)), batch.column("n").take(pa.array(mine))], names=["path", "key", "fp", "n"])

    return run


def digits(path: int, level: int) -> list[int]:
    """A path of blocks from its number in base 3."""
    return [path // 3**k % 3 for k in range(level - 1, -1, -1)]


def _walk(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, lists = np.asarray(batch.column("path")), batch.column("members")
            for p in np.unique(paths):
                mine = lists.take(pa.array(np.flatnonzero(paths == p)))
                bounds = np.concatenate(([0], np.cumsum(np.asarray(mine.value_lengths())))).astype(np.int64)
                flat = mine.flatten()
                fp, n = np.asarray(flat.field("fp")).view(np.uint64), np.asarray(flat.field("n"))
                path = digits(int(p), level)
                _, rest, bits = descend(fp, path)
                order = np.lexsort((rest, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
                fp, n, rest = fp[order], n[order], rest[order]
                links, seen = np.zeros(len(fp), np.int64), np.zeros(len(fp), bool)

                def tell(i, j, fp=fp, n=n, links=links, seen=seen, path=path):
                    seen[i] = seen[j] = True
                    own = first_equal(fp[i] ^ fp[j], path)
                    np.add.at(links, i[own], n[j[own]])
                    np.add.at(links, j[own], n[i[own]])

                root = forest(len(fp), trie_pairs(rest, bounds, bits), tell)
                yield pa.RecordBatch.from_arrays([pa.array(fp[seen].view(np.int64)), pa.array(fp[root[seen]].view(np.int64)), pa.array(links[seen])], names=["fp", "root", "links"])

    return run


def trie_self_join(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(fp long, n long), fp distinct -> (fp, root, links): a forest that joins all within the budget.

    ``links`` is to be summed by fp: documents of other fingerprints within the budget. A
    fingerprint without partners has no row.
    """
    out, rows = None, prints.select("fp", F.col("n").cast("long").alias("n"))
    for level in (1, 2, 3):
        dealt = rows.mapInArrow(_expand(level - 1), "path int, key long, fp long, n long")
        shared = dealt.groupBy("path", "key").agg(F.count("*").alias("width")).where("width > 1")
        dealt = materialise(dealt.join(shared, ["path", "key"]), "trie")
        last = level == 3
        small = dealt if last else dealt.where(F.col("width") <= most)
        sets = small.groupBy("path", "key").agg(F.collect_list(F.struct("fp", "n")).alias("members")).select("path", "members")
        found = sets.mapInArrow(_walk(level), "fp long, root long, links long")
        out = found if out is None else out.union(found)
        rows = dealt.where(F.col("width") > most).select("path", "fp", "n")
        if last or rows.isEmpty():
            return out
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long, component_id, n_links) of every row; n_links counts other rows within the budget."""
    own = materialise(docs.select("doc_id", "text").mapInArrow(_fingerprints, docs.select(F.col("doc_id"), F.lit(0).cast("long").alias("fp")).schema), "simhash")
    classes = own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    found = materialise(trie_self_join(classes.select("fp", "n")), "links")
    links = found.groupBy("fp").agg(F.sum("links").alias("links"))
    root = components(found, "fp", "root")
    classes = classes.join(root, classes["fp"] == root["node"], "left").drop("node").withColumn("root", F.coalesce("root", "fp"))
    top = classes.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    classes = classes.join(top, classes["root"] == top["r"]).join(links, "fp", "left")
    classes = classes.select(F.col("fp").alias("_fp"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return own.join(classes, own["fp"] == classes["_fp"]).select("doc_id", "fp", "component_id", "n_links")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    got = near_duplicates(documents(spark, sf_dir))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")
