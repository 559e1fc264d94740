"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms over all documents.
2. Benchmark items are cut into windows of ``ITEM`` words, documents into passages
   of ``PASSAGE`` words, each a TF-IDF vector over the benchmark's terms. One distributed pass over all documents
   is the range finder of a randomised SVD: each passage is added, with a random sign, to one of the columns of a test product A'S (S sparse, the
   expectation of A'S S'A is A'A), summed per task. Power rounds and Rayleigh-Ritz over the windows and that product give the latent space.
3. All overlapping passages of all documents are searched in two ways. A passage and a window meet if their latent cosine
   is ``NEAR`` or more, where the passage has its whole TF-IDF norm, terms outside the benchmark included; so a passage with less than
   ``NEAR`` squared of its energy in benchmark terms can't reach it and isn't projected. They also meet if the passage holds
   terms of ``LIKELY`` of the window's own weight (an index finds all such pairs, whatever else the passage holds
   and however common the item is).
4. Candidates are checked by a longest common subsequence of words (32-bit hashes), weighted by IDF, between the item and
   the text around the passage. ``SURE`` of the item's weight is a leak; from ``LIKELY`` on, the item's
   answer (its last ``ANSWER`` words) must also be there, which is what a paraphrase keeps. ``lcs_share`` is
   that of the first passage that is sure, else the best.

Items of fewer than ``LEAST`` words are too short for shares: they are leaks where they stand word for word
and chance doesn't explain it, that is if their words' IDF sums to ``RARE`` more than any single word's can.

Counts, sketch and search cover every document. Items are taken in blocks of about ``BLOCK``
(fewer if they are long), so no step holds more of the benchmark than that.

Defined results: null and empty texts (of either table) have no passages and no leaks; repeated
rows of ``documents`` each report; every
different text of an item id is searched, and a document reports an id once, with its best share; items
without an id report a null item_id; texts are read whole
whatever their length; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from parley.llm._shared import documents

BUCKETS = 1 << 18
ITEM, PASSAGE = 16, 32  # words; strides are half, so any ITEM words lie inside one passage
RANK, EXTRA, ROUNDS = 256, 16, 2
BLOCK, BYTES = 20_000, 4_000_000  # items, and bytes of their texts, of a block
LEAST, RARE = 5, 1.0
CORPUS = 0.1  # weight of the corpus in the latent space, against the windows
NEAR = 0.4
SURE, LIKELY, ANSWER = 0.55, 0.4, 8
PART = 4096
TOGETHER = 2000  # passages compared at once
#: Bytes between words: ASCII other than letters and digits. Other characters are letters here.
BLANK = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(BLANK).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def buckets_of(words: list[bytes] | set[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (BUCKETS - 1)


def cut(n: int, width: int) -> np.ndarray:
    """Starts of windows of ``width`` at half strides that cover n words; the last one ends with them."""
    if n <= width:
        return np.zeros(1 if n else 0, np.int64)
    return np.unique(np.append(np.arange(0, n - width, width // 2), n - width))


class Space:
    """Benchmark terms, their weights and the latent basis; windows of the items as unit latent vectors."""

    def __init__(self, items: list[tuple]) -> None:
        self.words = [(i, hashes_of(words_of(t))) for i, t in items]
        self.names, self.whole = [i for i, w in self.words if len(w) >= LEAST], [w for _, w in self.words if len(w) >= LEAST]
        self.ids = [w & (BUCKETS - 1) for w in self.whole]
        terms = np.unique(np.concatenate(self.ids)) if self.ids else np.zeros(0, np.int64)
        self.column = np.full(BUCKETS, -1, np.int32)
        self.column[terms] = np.arange(len(terms))
        self.terms, self.buckets = len(terms), terms
        self.owner, rows = [], []
        for k, ids in enumerate(self.ids):
            for s in cut(len(ids), ITEM):
                self.owner.append(k)
                rows.append(ids[s : s + ITEM])
        self.rows, self.owner = rows, np.array(self.owner, np.int64)
        self.width = min(RANK + EXTRA, self.terms)

    def weigh(self, idf: np.ndarray, most: float) -> None:
        """All that the corpus's IDF decides; ``most`` is what a single word can have."""
        self.idf, self.weight = idf, idf[self.buckets].astype(np.float32)
        # Short items by their first word.
        self.short: dict[int, list[tuple]] = {}
        for i, w in self.words:
            if 0 < len(w) < LEAST and idf[w & (BUCKETS - 1)].sum() >= most + RARE:
                self.short.setdefault(int(w[0]), []).append((i, w))
        self.short_heads = np.array(sorted(self.short), np.int64)
        self._index()

    def _index(self) -> None:
        """Windows by their heaviest terms: without those, less than LIKELY of a window's weight is left."""
        width = max(map(len, self.rows), default=0)
        self.held = np.full((len(self.rows), width), -1, np.int64)  # distinct columns of each window
        self.part = np.zeros((len(self.rows), width))  # their shares of its weight
        self.rest = np.zeros(len(self.rows))  # share outside the index
        window, term, share = [], [], []
        for j, ids in enumerate(self.rows):
            u, n = np.unique(ids, return_counts=True)
            w = n * (self.idf[u].astype(np.float64) + 1e-6)
            order = np.argsort(-w, kind="stable")
            u, w = self.column[u[order]], w[order] / w.sum()
            left = np.append(np.cumsum(w[::-1])[::-1], 0.0)
            k = int(np.argmax(left < LIKELY - 1e-9))
            self.held[j, : len(u)], self.part[j, : len(u)], self.rest[j] = u, w, left[k]
            window += [j] * k
            term += u[:k].tolist()
            share += w[:k].tolist()
        order = np.argsort(np.array(term, np.int64), kind="stable")
        self.window, self.share = np.array(window, np.int64)[order], np.array(share)[order]
        self.first = np.searchsorted(np.array(term, np.int64)[order], np.arange(self.terms + 1))

    def holding(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (passage, window) where the passage holds terms of LIKELY of the window's weight; terms of passages in order, each once."""
        key = row * self.terms + col
        n = self.first[col + 1] - self.first[col]
        at = np.repeat(self.first[col] - np.cumsum(n) + n, n) + np.arange(n.sum())
        pair, where = np.unique(np.repeat(row, n) * len(self.rows) + self.window[at], return_inverse=True)
        sums = np.bincount(where, self.share[at], len(pair))
        pair = pair[sums + self.rest[pair % len(self.rows)] >= LIKELY - 1e-9]
        row, window = pair // len(self.rows), pair % len(self.rows)
        want = row[:, None] * self.terms + self.held[window]
        here = (key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want) & (self.held[window] >= 0) if len(key) else want < 0
        ok = (self.part[window] * here).sum(axis=1) >= LIKELY - 1e-9
        return row[ok], window[ok]

    def times(self, rows: list[np.ndarray], basis: np.ndarray) -> np.ndarray:
        """TF-IDF rows (as lists of buckets) times a terms x k basis."""
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        col, weight = self.column[flat], self.idf[flat]
        hit = col >= 0
        row = np.repeat(np.arange(len(rows)), lens)[hit]
        got = basis[col[hit]] * weight[hit, None]
        out = np.zeros((len(rows), basis.shape[1]), np.float32)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else row
        if len(row):
            out[row[first]] = np.add.reduceat(got, first, axis=0)
        return out

    def back(self, rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        """The transposed product: terms x k."""
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        col, hit = self.column[flat], self.column[flat] >= 0
        row, weight = np.repeat(np.arange(len(rows)), lens)[hit], self.idf[flat][hit]
        out = np.zeros((self.terms, y.shape[1]), np.float32)
        order = np.argsort(col[hit], kind="stable")
        c = col[hit][order]
        if len(c):
            first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
            out[c[first]] = np.add.reduceat(y[row[order]] * weight[order, None], first, axis=0)
        return out


SURVEY = "part int, sums array<float>, counts array<long>"


def _survey(shared):
    """Partial sums over documents: their number and frequencies by bucket (parts below 0), and A'S of passages without IDF, a row for each run of PART."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column, terms, width = shared.value
        total, seen, n = np.zeros(terms * width, np.float32), np.zeros(BUCKETS, np.int64), 0
        place = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, key in zip(batch.column("text"), np.asarray(batch.column("key")).view(np.uint64), strict=True):
                ids = buckets_of(words_of(text.as_py()))
                n += 1
                if not len(ids):
                    continue
                order = np.arange(len(ids))
                place[ids] = order
                seen[ids[place[ids] == order]] += 1  # each bucket once
                if not terms:
                    continue
                # Column and sign of each passage, from its row's hash and its place.
                dice = (np.arange(1, -(-len(ids) // PASSAGE) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ key
                dice = (dice ^ (dice >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                side, sign = ((dice >> np.uint64(33)) % np.uint64(width)).astype(np.int64), np.where(dice >> np.uint64(32) & np.uint64(1), np.float32(1), np.float32(-1))
                col = column[ids]
                hit = np.flatnonzero(col >= 0)
                np.add.at(total, col[hit].astype(np.int64) * width + side[hit // PASSAGE], sign[hit // PASSAGE])
        if n:
            run_of = PART * max(1, width)
            sums = [total[i : i + run_of] for i in range(0, len(total), run_of)]
            counts = [seen[i : i + PART] for i in range(0, BUCKETS, PART)]
            none, zero = np.zeros(0, np.float32), np.zeros(0, np.int64)
            parts = pa.array([-1, *(-2 - i for i in range(len(counts))), *range(len(sums))], pa.int32())
            yield pa.RecordBatch.from_arrays([parts, pa.array([none] * (1 + len(counts)) + sums, pa.list_(pa.float32())), pa.array([np.array([n]), *counts] + [zero] * len(sums), pa.list_(pa.int64()))], names=["part", "sums", "counts"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = [None, None]
    for k, name in enumerate(("sums", "counts")):
        for x in table[name]:
            v = np.asarray(x.values)
            total[k] = v.copy() if total[k] is None else total[k] + v
    return pa.table({"part": table["part"][:1].cast(pa.int32()), "sums": pa.array([total[0]], pa.list_(pa.float32())), "counts": pa.array([total[1]], pa.list_(pa.int64()))})


def survey(docs: DataFrame, space: Space | None) -> tuple[np.ndarray, int, np.ndarray]:
    """(document frequencies by bucket, documents, A'S of the space's terms without IDF); BUCKETS numbers whatever the corpus, and terms x width."""
    terms, width = (space.terms, space.width) if space else (0, 0)
    shared = docs.sparkSession.sparkContext.broadcast((space.column if space else None, terms, width))
    rows = docs.select("text", F.xxhash64("doc_id", "text").alias("key"))
    got = {r["part"]: r for r in rows.mapInArrow(_survey(shared), SURVEY).groupBy("part").applyInArrow(_add, SURVEY).collect()}
    shared.unpersist()
    if not got:
        return np.zeros(BUCKETS), 0, np.zeros((terms, max(1, width)), np.float32)
    seen = np.concatenate([np.asarray(got[-2 - i]["counts"]) for i in range(BUCKETS // PART)])
    sums = [np.asarray(got[i]["sums"], np.float32) for i in range(len(got) - 1 - BUCKETS // PART)]
    return seen, got[-1]["counts"][0], (np.concatenate(sums) if sums else np.zeros(0, np.float32)).reshape(terms, width)


def latent_basis(space: Space, factor: np.ndarray, passages: float, seed: int = 7) -> np.ndarray:
    """terms x k orthonormal columns: the leading right singular vectors of the windows and, by B = A'S (``factor``), all passages."""
    factor = factor * space.weight[:, None] * np.float32(np.sqrt(CORPUS * len(space.rows) / max(1.0, passages)))
    basis = np.random.default_rng(seed).normal(size=(space.terms, space.width)).astype(np.float32)
    for _ in range(ROUNDS + 1):
        q, _ = np.linalg.qr(basis)
        q = q.astype(np.float32)
        basis = space.back(space.rows, space.times(space.rows, q)) + factor @ (factor.T @ q)
    # Rayleigh-Ritz in the last range: q'A'A q.
    values, vectors = np.linalg.eigh((q.T @ basis + basis.T @ q) / 2)
    return (q @ vectors[:, np.argsort(-values)[:RANK]]).astype(np.float32)


def weighted_lcs(a: np.ndarray, weight: np.ndarray, b: np.ndarray) -> float:
    """Largest weight of a common subsequence of two id sequences; weights belong to ``a``."""
    best = np.zeros(len(b) + 1)
    for x, w in zip(a, weight, strict=True):
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w * (b == x)))
    return float(best[-1])


_SEEN = np.zeros(BUCKETS, bool)


def verify(item: np.ndarray, near: np.ndarray, idf: np.ndarray) -> tuple[bool, float]:
    weight = idf[item & (BUCKETS - 1)].astype(np.float64) + 1e-6
    # No subsequence weighs more than the words that both have.
    _SEEN[near & (BUCKETS - 1)] = True
    both = _SEEN[item & (BUCKETS - 1)]
    _SEEN[near & (BUCKETS - 1)] = False
    if weight[both].sum() < LIKELY * weight.sum():
        return False, 0.0
    share = weighted_lcs(item, weight, near) / weight.sum()
    if share >= SURE or share < LIKELY:
        return share >= SURE, share
    tail = item[-ANSWER:]
    return weighted_lcs(tail, weight[-ANSWER:], near) >= 0.8 * weight[-ANSWER:].sum(), share


def project(cols: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``weighted`` that ``cols`` names (-1: none), a sum for each row of ``cols``."""
    cols = -np.sort(-cols, axis=1)  # hits first
    hits = (cols >= 0).sum(axis=1)
    order = np.argsort(-hits, kind="stable")
    cols, hits = cols[order], hits[order]
    out = np.zeros((len(cols), weighted.shape[1]), np.float32)
    for j in range(int(hits.max(initial=0))):
        some = int(np.searchsorted(-hits, -j))  # rows with more than j hits
        out[:some] += weighted[cols[:some, j]]
    back = np.empty_like(out)
    back[order] = out
    return back


def passages_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a text's overlapping passages, and their buckets (-1 behind a shorter text)."""
    starts = cut(len(ids), PASSAGE)
    if len(ids) < PASSAGE:
        ids = np.concatenate((ids, np.full(PASSAGE - len(ids), -1, ids.dtype)))
    return starts, np.where(ids < 0, -1, ids & (BUCKETS - 1)).astype(np.int32)[starts[:, None] + np.arange(PASSAGE)]


def near(space: Space, weighted: np.ndarray, windows: np.ndarray, texts: list[np.ndarray], own: np.ndarray, starts: np.ndarray, table: np.ndarray, found: dict) -> None:
    """Candidates among passages (text, start, buckets) checked; ``found`` gets the share of each pair."""
    rows = np.sort(table, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    new &= rows >= 0
    at, flat = np.nonzero(new)[0], rows[new]
    # Each distinct term's count: the places up to the next one, which pads never follow.
    place = np.flatnonzero(new)
    ends = np.minimum(np.append(place[1:], rows.size), (at + 1) * PASSAGE)
    e = ((ends - place) * space.idf[flat].astype(np.float64)) ** 2
    col = space.column[flat]
    hit = col >= 0
    whole, inside = np.bincount(at, e, len(rows)), np.bincount(at[hit], e[hit], len(rows))
    row, window = space.holding(at[hit], col[hit].astype(np.int64))
    latent = inside >= NEAR * NEAR * whole * (1 - 1e-6)
    keep = latent.copy()
    keep[row] = True
    kept = np.flatnonzero(keep)
    if not len(kept):
        return
    p = project(np.where(table[kept] >= 0, space.column[table[kept]], -1), weighted)
    p /= np.maximum(np.sqrt(whole[kept]), 1e-9)[:, None].astype(np.float32)
    # No cosine is above the passage's own length in the latent space.
    near_ = latent[kept] & (np.sqrt((p * p).sum(axis=1)) >= NEAR * (1 - 1e-4))
    keep[kept] = near_
    keep[row] = True
    p, near_ = p[keep[kept]], near_[keep[kept]]
    kept = np.flatnonzero(keep)
    cos = p @ windows.T
    met = (cos >= NEAR) & near_[:, None]
    met[(np.cumsum(keep) - 1)[row], window] = True
    for r, j in zip(*np.nonzero(met), strict=True):
        i, s, k = int(own[kept[r]]), int(starts[kept[r]]), int(space.owner[j])
        known = found.get((i, k), (0.0, 0.0))[0]
        if known < SURE:
            item = space.whole[k]
            ok, share = verify(item, texts[i][max(0, s - len(item)) : s + PASSAGE + len(item)], space.idf)
            if ok and share > known:
                found[i, k] = (share, float(cos[r, j]))


def short_items(space: Space, ids: np.ndarray) -> list:
    """Names of short items that stand in a text word for word."""
    out = []
    for at in np.flatnonzero(np.isin(ids, space.short_heads)).tolist() if len(space.short_heads) else ():
        out += [i for i, w in space.short[int(ids[at])] if np.array_equal(ids[at : at + len(w)], w)]
    return out


def _search(shared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, basis, windows = shared.value
        weighted = basis * space.weight[:, None]
        for batch in batches:
            names, found, best, texts = batch.column("doc_id").to_pylist(), {}, {}, []
            held, size = [], 0

            def check(found=found, texts=texts) -> None:
                own, starts, table = (np.concatenate(x) for x in zip(*held, strict=True))
                for lo in range(0, len(own), TOGETHER):
                    part = slice(lo, lo + TOGETHER)
                    near(space, weighted, windows, texts, own[part], starts[part], table[part], found)

            for i, text in enumerate(batch.column("text")):
                ids = hashes_of(words_of(text.as_py()))
                texts.append(ids)
                for name in short_items(space, ids):
                    best[i, name] = (1.0, 1.0)
                if len(ids) and space.rows:
                    starts, table = passages_of(ids)
                    held.append((np.full(len(starts), i), starts, table))
                    size += len(starts)
                if size >= TOGETHER:
                    check()
                    held, size = [], 0
            if held:
                check()
            for (i, k), x in found.items():
                at = (i, space.names[k])
                best[at] = max(best.get(at, x), x)
            if best:
                keys = sorted(best, key=str)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in keys], batch.column("doc_id").type), pa.array([k for _, k in keys], kind), pa.array([best[x][0] for x in keys]), pa.array([best[x][1] for x in keys])], names=["doc_id", "item_id", "lcs_share", "cosine"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, lcs_share, cosine): items that a document holds. A document without a leak has no row."""
    spark = docs.sparkSession
    schema = docs.select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("lcs_share"), F.lit(0.0).alias("cosine")).schema
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(-(-size["n"] // BLOCK), -(-(size["bytes"] or 0) // BYTES))
    if not blocks:
        return spark.createDataFrame([], schema)
    rows = docs.select("doc_id", "text")
    kind = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = idf = most = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        space = Space([(r["item_id"], r["text"]) for r in mine])
        if not space.words:
            continue
        seen, n, factor = survey(docs, space)
        if idf is None:
            idf, most = np.log((n + 2) / (seen + 1)).astype(np.float32), float(np.log(n + 2))
        space.weigh(idf, most)
        if not space.rows and not space.short:
            continue
        basis = latent_basis(space, factor, float(seen.sum()) / PASSAGE) if space.rows else np.zeros((0, 1), np.float32)
        windows = space.times(space.rows, basis)
        windows /= np.maximum(np.linalg.norm(windows, axis=1, keepdims=True), 1e-9)
        shared = spark.sparkContext.broadcast((space, basis, windows))
        # Rows of one id and text find the same, so blocks are put together by both.
        both = rows if blocks == 1 else rows.select(F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).alias("doc_id"), "text")
        found = both.mapInArrow(_search(shared, kind), schema if blocks == 1 else T.StructType([T.StructField("doc_id", both.schema["doc_id"].dataType), *schema.fields[1:]]))
        if blocks > 1:
            found = found.groupBy("doc_id", "item_id").agg(F.count("*").cast("int").alias("copies"), F.max(F.struct("lcs_share", "cosine")).alias("best"))
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], schema)
    if blocks == 1:
        return out
    best = out.groupBy("doc_id", "item_id").agg(F.max("copies").alias("copies"), F.max("best").alias("best"))
    best = best.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return best.select(F.col("doc_id.doc_id").alias("doc_id"), "item_id", "best.lcs_share", "best.cosine")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of all benchmark items into all documents."""
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
