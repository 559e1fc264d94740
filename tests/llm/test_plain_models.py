"""The classifiers' whole queries against plain versions, with null, repeated and conflicting labels and rows."""

import random
import struct
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from parley.llm import langid, quality, toxicity

random.seed(21)
EN = "the of and to in is that for it was on are with as his they be at one have this from".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split()
LABELS = "doc_id long, quality int, toxic int"


def prose(pool, n):
    return " ".join(random.choice(pool) + random.choice(["", "", "", "er", "ing"]) for _ in range(n))


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def hash64(*values):
    """XXH64 of a row's columns, each seeded by the one before; a null leaves the seed."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), seed)
    return seed


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def rows_of(n, text):
    """n documents, some repeated, some ids with two texts, null ids and null and empty texts."""
    rows = [(i, text(i)) for i in range(n)]
    return [*rows, rows[3], rows[3], (5, text(6)), (None, text(0)), (None, text(1)), (n, None), (n + 1, ""), (n + 2, "...")]


def labels_of(n, label):
    """Labels with nulls, repeats, conflicts (the largest counts), values outside 0 and 1, null ids and unknown ids."""
    rows = [(i, label(i)) for i in range(n)] + [(n, 1), (n + 1, 0), (7, 0), (7, 1), (8, None), (9, None), (9, 0), (None, 1), (10**9, 1), (11, label(11))]
    return [r for r in rows if r[0] not in (20, 21)] + [(20, None)]


def plain_labels(rows):
    out = {}
    for i, y in rows:
        if i is not None and y is not None:
            out[i] = max(y, out.get(i, y))
    return out


def compare(got, want):
    got = sorted(map(tuple, got), key=str)
    want = sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[3] == w[3] and abs(g[2] - w[2]) < 1e-6


def test_quality_equals_plain(spark, docs):
    rows = rows_of(120, lambda i: prose(EN, 50 + i % 7) + (" !!! $$ ### " * 3 if i % 3 == 0 else "."))
    labels = labels_of(120, lambda i: int(i % 3 != 0))
    y = plain_labels(labels)
    stat = [np.float32(quality.statistics(t)).astype(float) for _, t in rows]
    x = [np.array([s for (i, _), s in zip(rows, stat, strict=True) if fold(i, 4) not in (None, 2) and y.get(i) == k]) for k in (0, 1)]
    n = [len(v) for v in x]
    d = len(quality.NAMES)
    pooled = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in x) / (sum(n) - 2)
    density = []
    for v in x:
        c = (1 - quality.TO_POOLED) * np.cov(v.T) + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(d)
        z = np.array(stat) - v.mean(axis=0)
        density.append(np.log(len(v) / sum(n)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    score = 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))
    want = [(i, fold(i, 4) == 2, s, int(s >= 0.7)) for (i, _), s in zip(rows, score, strict=True)]
    lab = spark.createDataFrame([(i, q, None) for i, q in labels], LABELS)
    got = quality.quality(docs(rows), lab).select("doc_id", "held_out", "score", "predicted").collect()
    compare(got, want)


def plain_terms(text):
    words = toxicity.WORDS.findall((text or "").lower())
    out = {}
    for b in {zlib.crc32(w.encode()) % toxicity.BUCKETS for w in words}:
        out[b] = 1.0
    for w in words:
        for k in toxicity.STEMS:
            b = zlib.crc32(f"^{w[:k]}".encode()) % toxicity.BUCKETS
            if len(w) > k and out.get(b) != 1.0:
                out[b] = out.get(b, 0.0) + 40 / len(words)
    return {b: min(1.0, v) for b, v in out.items()}


@pytest.mark.parametrize("most", [20_000, 60])
def test_toxicity_equals_plain(spark, docs, monkeypatch, most):
    monkeypatch.setattr(toxicity, "SAMPLE", most)
    rows = rows_of(150, lambda i: prose(EN, 40) + (" idiot " + random.choice(EN) if i % 4 == 0 else ""))
    labels = labels_of(150, lambda i: int(i % 4 == 0))
    y = {i: k for i, k in plain_labels(labels).items() if fold(i, 5) != 0}
    ids = sorted(y, key=lambda i: (signed(hash64(i)), i))[:most]
    sample = sorted({(signed(hash64(i)), signed(hash64(t)), y[i], t) for i, t in rows if i in ids}, key=lambda r: r[:2])[:most]
    sample.sort(key=lambda r: (r[2], r[1]))
    terms = [plain_terms(t) for *_, t in sample]
    share = sum(k for _, _, k, _ in sample) / len(sample)
    chi = []
    for b in set().union(*terms):
        n, bad = sum(b in t for t in terms), sum(r[2] for r, t in zip(sample, terms, strict=True) if b in t)
        if n >= 4:
            chi.append((-((bad - n * share) ** 2 / (n * share) + (bad - n * share) ** 2 / (n - n * share)), b))
    only = {b: j for j, (_, b) in enumerate(sorted(chi)[: toxicity.TERMS])}
    x = np.zeros((len(sample), len(only)), np.float32)
    for r, t in enumerate(terms):
        for b, v in t.items():
            if b in only:
                x[r, only[b]] = v
    m = toxicity.fit(x, np.array([r[2] for r in sample], np.float32), only)
    want = []
    for i, t in rows:
        v = {only[b]: v for b, v in plain_terms(t).items() if b in only}
        z = m.b + sum(m.w[a] * p for a, p in v.items()) + sum(m.v[a] @ m.v[b] * v[a] * v[b] for a in v for b in v if a < b)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        want.append((i, fold(i, 5) == 0, s, int(s >= 0.5)))
    lab = spark.createDataFrame([(i, None, k) for i, k in labels], LABELS)
    compare(toxicity.toxicity(docs(rows), lab).select("doc_id", "held_out", "score", "predicted").collect(), want)


def test_langid_equals_plain(docs):
    rows = [(i, t, None if i in (4, 9) else "en" if i is not None and i % 2 else "de", "s") for i, t in rows_of(90, lambda i: prose(EN if i % 2 else DE, 30 + 5 * (i % 40)))]
    known = [(i, t, lang) for i, t, lang, _ in rows if lang is not None and t is not None and fold(i, 4) not in (None, 2)]
    names = sorted({k for *_, k in known}, key=lambda k: (-sum(x == k for *_, x in known), k))
    coders = []
    for name in names:
        mine = sorted((hash64(i, t) % (1 << 40) / (1 << 40), langid.cuts(langid.plain(t))) for i, t, k in known if k == name)
        assert len(mine) <= langid.PER_LANGUAGE
        data = zstandard.ZstdCompressionDict(b" ".join(m for _, m in mine if m), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=langid.LEVEL)  # sizes depend on it
        params = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
        coders.append(zstandard.ZstdCompressor(dict_data=data, compression_params=params))
    want = []
    for i, t, *_ in rows:
        raw = langid.plain(t)
        sums = [sum(len(c.compress(raw[a : a + langid.PIECE])) for a in range(0, len(raw), langid.PIECE)) for c in coders]
        best = min(range(len(sums)), key=lambda j: sums[j])
        gap = (sorted(sums)[1] - sums[best]) / max(1, len(raw)) ** 0.5
        want.append((i, fold(i, 4) == 2, 1 / (1 + np.exp(-4 * gap)) if raw else 0.0, names[best] if raw else "und"))
    compare(langid.languages(docs(rows)).select("doc_id", "held_out", "score", "lang_pred").collect(), want)
