"""Removal of repeated 50-byte strings, by a run-length index of a BWT.

A byte of a document goes if a ``LENGTH``-byte string that covers it also starts in a document
with a smaller id. Exact, in four passes of bounded tasks:

1. Anchors. Among the starts of ``GRAM``-byte strings in a window of ``LENGTH`` bytes the one
   with the least hash is the window's anchor; equal windows have equal anchors. An anchor's
   context is all that its windows can cover. Tasks send (hash of anchor, hash of context) to
   buckets, each pair once per task; further documents of the pair in that task are marked on the spot.
2. Buckets. Documents that have a context which a smaller id has too lose all of it. An anchor
   seen in one context only is settled. Contexts that differ around a shared anchor go on.
   Of those only contexts that agree with another on a half around the anchor can share a window.
3. Index. The bytes of those contexts, one copy of each, form a ``RunIndex`` per bucket; streaming
   them through it gives, for each window, the least id that has it.
4. Cut. Marks come back to the documents by id, and the rest is hashed.

Contexts inside long copies agree, so only the rims of copies and edits reach the index. A
string in a third of all documents costs a bucket one row per task, not per document.

Context hashes have 64 bits, of which 24 tell which half agrees: two different contexts of one
anchor that agree on both halves pass as equal with a chance of 2**-40 a pair, others with less.
Windows are compared byte by byte in the index.

Defined results: null text is empty; a document shorter than ``LENGTH`` bytes keeps all;
documents of one id (repeated rows) don't count as smaller than each other; rows with a null id
lose nothing and take nothing from others; an empty table gives no rows; texts are cut into
overlapping pieces for the hashing, so their length doesn't bound anything; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm._shared import documents, materialise
from parley.llm.runindex import LENGTH, RunIndex

GRAM = 20
SPAN = LENGTH - GRAM  # an anchor starts 0 to SPAN bytes after its window does
PIECE = 1 << 20  # bytes hashed at once; positions must fit in PLACE bits
PLACE = 21
FLUSH = 16 << 20  # bytes of text whose anchors a task gathers before it sends them
BUCKET = 8 << 20  # bytes of text to a bucket
FINER = 4  # index buckets to each of those: an index holds about 30 times its strings' bytes while it is built
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0x9E3779B97F4A7C15)
    return x ^ (x >> U(32))


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings of the buffer."""
    n = len(buf) - GRAM + 1
    words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    return _mix(words[:n] * U(0x9E3779B97F4A7C15) + words[8 : 8 + n] * U(0xC2B2AE3D27D4EB4F) + words[GRAM - 8 : GRAM - 8 + n] * U(0x165667B19E3779F9))


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, from, to, anchor, context) of the anchors of a buffer of pieces; from and to bound the context."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),) * 2
    if len(buf) < LENGTH:
        return none
    h = gram_hashes(buf)
    v = h >> U(PLACE) << U(PLACE) | np.arange(len(h), dtype=U)
    m = v
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])  # over 2, 4, 8, 16
    m = np.minimum(m[: len(m) - (SPAN - 15)], m[SPAN - 15 :])
    edge = np.zeros(len(buf) + 1, np.int32)
    whole = ends - starts >= LENGTH
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - LENGTH + 1, -1)
    at = (m[np.cumsum(edge[: len(m)]) > 0] & U((1 << PLACE) - 1)).astype(np.int64)
    if not len(at):
        return none
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    piece = np.searchsorted(starts, at, "right") - 1
    a, b = np.maximum(starts[piece], at - SPAN), np.minimum(ends[piece], at + LENGTH)
    # A window has SPAN / 2 bytes or more on one side of its anchor: contexts that share one agree on
    # that half, whose hashes make the low 24 bits (0: the half isn't whole).
    half = SPAN // 2
    left = np.where(at - a >= half, h[np.maximum(at - half, 0)] % U(4095) + U(1), U(0))
    right = np.where(b - at >= GRAM + half, h[np.minimum(at + half, len(h) - 1)] % U(4095) + U(1), U(0))
    near = (a, np.maximum(a, at - SPAN + GRAM), at, np.minimum(at + GRAM // 2, b - GRAM), b - GRAM)
    c = (at - a).astype(U) * U(1000003) + (b - at).astype(U)
    for k in near:
        c = _mix(c * U(0x9E3779B97F4A7C15) + h[k])
    return piece, a, b, h[at], c >> U(24) << U(24) | left << U(12) | right


def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of at most about PIECE bytes: (bytes, starts, ends, text number, offset in the text)."""
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def out():
        lens = np.fromiter((len(x[0]) for x in held), np.int64, len(held))
        ends = np.cumsum(lens)
        buf = np.frombuffer(b"".join(x[0] for x in held) + bytes(8), np.uint8)[: int(ends[-1])]
        return buf, ends - lens, ends, np.array([x[1] for x in held]), np.array([x[2] for x in held])

    for i, t in enumerate(texts):
        for off in range(0, max(1, len(t) - LENGTH + 1), PIECE - LENGTH):
            part = t[off : off + PIECE - 1]
            if size + len(part) > PIECE and held:
                yield out()
                held, size = [], 0
            held.append((part, i, off))
            size += len(part)
    if held:
        yield out()


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


SENT = "bucket int, docs binary, counts binary, anchors binary, contexts binary, mark_docs binary, marks binary"


def _send(buckets: int):
    def flush(doc: list[np.ndarray], anchor: list[np.ndarray], context: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        d, a, c = np.concatenate(doc), np.concatenate(anchor), np.concatenate(context)
        order = np.lexsort((d, c))
        d, a, c = d[order], a[order], c[order]
        new = np.concatenate(([True], c[1:] != c[:-1]))
        least = d[new][np.cumsum(new) - 1]
        marked = d > least  # of the rest, rows after the first are the same document's
        side = (_mix(d[marked].astype(U)) % U(buckets)).astype(np.int64)
        md, mc = d[marked], c[marked]
        d, a, c = d[new], a[new], c[new]
        to = (_mix(a) % U(buckets)).astype(np.int64)
        order, late = np.lexsort((d, to)), np.argsort(side, kind="stable")
        d, a, c, to, md, mc, side = d[order], a[order], c[order], to[order], md[late], mc[late], side[late]
        cut, late_cut = np.searchsorted(to, np.arange(buckets + 1)), np.searchsorted(side, np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            x, y = slice(cut[b], cut[b + 1]), slice(late_cut[b], late_cut[b + 1])
            if x.start == x.stop and y.start == y.stop:
                continue
            ids, counts = np.unique(d[x], return_counts=True)
            rows.append((b, ids.tobytes(), counts.astype(np.uint32).tobytes(), a[x].tobytes(), c[x].tobytes(), md[y].tobytes(), mc[y].tobytes()))
            if len(rows) == 64 or b == buckets - 1:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=[x.split()[0] for x in SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for buf, starts, ends, number, _ in pieces(_texts(batch)):
                piece, _, _, a, c = anchors(buf, starts, ends)
                for x, y in zip(held, (ids[number[piece]], a, c), strict=True):
                    x.append(y)
                size += len(buf)
                if size >= FLUSH:
                    yield from flush(*held)
                    held, size = ([], [], []), 0
        if held[0] and sum(map(len, held[0])):
            yield from flush(*held)

    return run


def _ints(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), kind)


MARKED = "doc_id long, marks binary, asks binary"


def _settle(table: pa.Table) -> pa.Table:
    """A bucket: documents with the contexts that they lose whole (marks), and those whose bytes are asked for."""
    d = np.repeat(_ints(table["docs"], np.int64), _ints(table["counts"], np.uint32))
    a, c = _ints(table["anchors"], U), _ints(table["contexts"], U)
    order = np.lexsort((d, c, a))
    d, a, c = d[order], a[order], c[order]
    head = np.concatenate(([True], c[1:] != c[:-1])) if len(c) else np.zeros(0, bool)
    least = d[head][np.cumsum(head) - 1] if len(c) else d
    lose = d > least
    # Contexts of one anchor that agree on a half: the first document of each is asked for the bytes.
    ask = np.zeros(len(d), bool)
    for half in ((c[head] >> U(12)) & U(4095), c[head] & U(4095)):
        _, at, times = np.unique(_mix(a[head] + half), return_inverse=True, return_counts=True)
        ask[np.flatnonzero(head)[(times[at] > 1) & (half > 0)]] = True
    md, mc = np.concatenate((d[lose], _ints(table["mark_docs"], np.int64))), np.concatenate((c[lose], _ints(table["marks"], U)))
    docs = np.unique(np.concatenate((md, d[ask])))
    by, to = np.argsort(md, kind="stable"), np.lexsort((c[ask], d[ask]))
    md, mc, qd = md[by], mc[by], d[ask][to]
    pair = np.stack((a[ask][to], c[ask][to]), axis=1)
    x, y = np.searchsorted(md, docs), np.searchsorted(md, docs, "right")
    u, v = np.searchsorted(qd, docs), np.searchsorted(qd, docs, "right")
    return pa.table({"doc_id": pa.array(docs), "marks": pa.array([mc[i:j].tobytes() for i, j in zip(x, y, strict=True)], pa.binary()), "asks": pa.array([pair[i:j].tobytes() for i, j in zip(u, v, strict=True)], pa.binary())})


CONTEXTS = "bucket int, doc_id long, context long, bytes binary"


def _answer(buckets: int):
    """The asked contexts' bytes, each sent to its anchor's bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, asks = np.asarray(batch.column("doc_id")), batch.column("asks").to_pylist()
            out: list[tuple[int, int, int, bytes]] = []
            for buf, starts, ends, number, _ in pieces(_texts(batch)):
                piece, a, b, anchor, context = anchors(buf, starts, ends)
                text = number[piece]
                for i in np.unique(text):
                    lo, hi = np.searchsorted(text, [i, i + 1])
                    want = np.frombuffer(b"".join(asks[i] or ()), U).reshape(-1, 2)
                    _, at = np.unique(context[lo:hi], return_index=True)
                    at = at[np.isin(context[lo:hi][at], want[:, 1])] + lo
                    to = _mix(anchor[at]) % U(buckets)
                    out += [(int(t), int(ids[i]), int(x), buf[p:q].tobytes()) for t, x, p, q in zip(to, context[at].view(np.int64), a[at], b[at], strict=True)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["bucket", "doc_id", "context", "bytes"])

    return run


PARTS = "doc_id long, context long, windows long"


def _index(table: pa.Table) -> pa.Table:
    """A bucket's contexts through the index: which windows of each a smaller id has."""
    docs, contexts, strings = np.asarray(table["doc_id"]), np.asarray(table["context"]), table["bytes"].to_pylist()
    order = np.lexsort((docs, contexts))
    new = np.concatenate(([True], contexts[order][1:] != contexts[order][:-1]))
    order = order[new]  # a text met in two tasks asks twice
    docs, contexts, strings = docs[order], contexts[order], [strings[i] for i in order]
    windows = np.zeros(len(docs), np.int64)
    for at, place, least in RunIndex(strings, docs).stream():
        hit = least < docs[at]
        windows[at[hit]] |= np.int64(1) << place[hit]
    some = windows > 0
    return pa.table({"doc_id": docs[some], "context": contexts[some], "windows": windows[some]})


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, marks, parts = _texts(batch), batch.column("marks").to_pylist(), batch.column("parts").to_pylist()
        gone: dict[int, np.ndarray] = {}
        todo = [i for i in range(len(texts)) if marks[i] or parts[i]]
        for buf, starts, ends, number, offset in pieces([texts[i] for i in todo]):
            piece, a, b, _, context = anchors(buf, starts, ends)
            for k in np.unique(number[piece]):
                i = todo[k]
                if i not in gone:
                    gone[i] = np.zeros(len(texts[i]) + 1, np.int32)
                mine = number[piece] == k if len(number) > 1 else slice(None)
                shift = (offset - starts)[piece][mine]
                p, q, c = a[mine] + shift, b[mine] + shift, context[mine]
                whole = np.isin(c, np.frombuffer(b"".join(marks[i] or ()), U))
                np.add.at(gone[i], p[whole], 1)
                np.add.at(gone[i], q[whole], -1)
                if parts[i]:
                    known = {x["context"]: x["windows"] for x in parts[i]}
                    some = np.flatnonzero(np.isin(c.view(np.int64), np.fromiter(known, np.int64, len(known))))
                    bits = np.fromiter((known[x] for x in c[some].view(np.int64).tolist()), np.int64, len(some))
                    nth, shifts = np.nonzero(bits[:, None] >> np.arange(SPAN + 1) & 1)
                    w = p[some][nth] + shifts
                    np.add.at(gone[i], w, 1)
                    np.add.at(gone[i], w + LENGTH, -1)
        rows = []
        for i, t in enumerate(texts):
            if i in gone:
                off = np.cumsum(gone[i][:-1]) > 0
                n = int(off.sum())
                spans = int(off[0]) + int((off[1:] & ~off[:-1]).sum()) if n else 0
                kept = np.frombuffer(t, np.uint8)[~off].tobytes()
            else:
                n, spans, kept = 0, 0, t
            rows.append((len(t), n, spans, hashlib.sha256(kept).hexdigest(), kept))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row; ``kept`` holds the remaining bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = rows.where(F.col("doc_id").isNotNull())
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    sent = known.where(F.octet_length("text") >= LENGTH).mapInArrow(_send(buckets), SENT)
    settled = materialise(sent.groupBy("bucket").applyInArrow(_settle, MARKED), "settled")
    asks = settled.where(F.length("asks") > 0).groupBy("doc_id").agg(F.collect_list("asks").alias("asks"))
    contexts = known.join(asks, "doc_id").mapInArrow(_answer(buckets * FINER), CONTEXTS)
    parts = materialise(contexts.groupBy("bucket").applyInArrow(_index, PARTS), "parts")
    marks = settled.where(F.length("marks") > 0).select("doc_id", "marks", F.lit(None).cast("struct<context:long,windows:long>").alias("part"))
    marks = marks.union(parts.select("doc_id", F.lit(None).cast("binary"), F.struct("context", "windows")))
    marks = marks.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("marks").alias("marks"), F.collect_list("part").alias("parts"))
    joined = rows.join(marks, F.col("doc_id") == F.col("id"), "left").select("doc_id", "text", "marks", "parts")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of all documents."""
    return removals(documents(spark, sf_dir)).drop("kept")
