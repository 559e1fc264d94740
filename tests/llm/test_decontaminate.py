"""Benchmark items that share a passage with other words, or that many documents hold."""

import random

import numpy as np
import pytest

from parley.llm import decontaminate


def test_short_and_widely_leaked_items(docs, spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    vocab, own = [word() for _ in range(3000)], [word() for _ in range(1500)]
    short = [(i, " ".join(rng.choice(own) for _ in range(5 + i % 6))) for i in range(30)]
    wide = (50, " ".join(rng.choice(own) for _ in range(18)))
    rows, leaks = [], set()
    for i in range(300):
        t = [rng.choice(vocab) for _ in range(200)]
        if i % 3 == 0:
            t[50:50] = wide[1].split()
            leaks.add((i, 50))
        if i % 10 == 1:
            t[120:120] = short[i // 10][1].split()
            leaks.add((i, i // 10))
        rows.append((i, " ".join(t)))
    bench = spark.createDataFrame([*short, wide], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(rows), bench).collect()} == leaks


@pytest.mark.parametrize("block", [20_000, 4])
def test_every_text_of_an_item_id(docs, spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(4000)]
    items = [(i // 2 if i < 8 else None, " ".join(rng.sample(vocab, 20))) for i in range(10)]
    rows, leaks = [], []
    for i in range(10):
        t = rng.choices(vocab, k=60) + items[i][1].split() + rng.choices(vocab, k=60)
        rows.append((i, " ".join(t)))
        leaks.append((i, items[i][0]))
    rows += [rows[0], (20, items[2][1] + " " + items[3][1]), (None, rows[5][1]), (21, " ".join(rng.choices(vocab, k=90)))]
    leaks += [leaks[0], (20, 1), (None, 2)]
    got = decontaminate.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert got.columns == ["doc_id", "item_id", "lcs_share", "cosine"]
    assert sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=str) == sorted(leaks, key=str)


@pytest.mark.parametrize("words", [5, 10, 16, 24])
def test_items_in_rare_surroundings(docs, spark, words):
    """Verbatim items inside texts whose every other word is unique."""
    rng = random.Random(words)
    common = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(600)]
    items = [(i, " ".join(rng.sample(common, words))) for i in range(20)]
    unique = iter(range(10**6))
    rows = [(i, " ".join([f"u{next(unique)}" for _ in range(60)] + [items[i][1]] + [f"u{next(unique)}" for _ in range(60)])) for i in range(20)]
    rows += [(100 + i, " ".join(rng.choices(common, k=120))) for i in range(80)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {x for x in got if x[0] < 100} == {(i, i) for i in range(20)}


def test_short_items_word_for_word(docs, spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choices([f"w{i}" for i in range(300)], k=n))
    items = [(1, "zig zag"), (2, "zebra"), (3, "w1"), (4, "w1 w2"), (5, "")]
    rows = [(i, prose(80)) for i in range(300)] + [(900, prose(20) + " Zig, zag! " + prose(20)), (901, "zag zig"), (902, "a zebra"), (903, "zig w1 zag")]
    got = decontaminate.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["lcs_share"]) for r in got] == [(900, 1, 1.0)]


def plain_leaks(rows, items):
    """Every passage of every document verified against every item, without any search."""
    idf = np.log((len(rows) + 2) / (np.bincount([b for _, t in rows for b in set(decontaminate.buckets_of(decontaminate.words_of(t)).tolist())], minlength=decontaminate.BUCKETS) + 1)).astype(np.float32)
    out = set()
    for i, text in rows:
        ids = decontaminate.hashes_of(decontaminate.words_of(text))
        for k, item in items:
            want = decontaminate.hashes_of(decontaminate.words_of(item))
            weight = idf[want & (decontaminate.BUCKETS - 1)].astype(float) + 1e-6
            for s in decontaminate.cut(len(ids), decontaminate.PASSAGE):
                region = ids[max(0, s - len(want)) : s + decontaminate.PASSAGE + len(want)]
                share = plain_lcs(want, weight, region) / weight.sum()
                tail = plain_lcs(want[-decontaminate.ANSWER :], weight[-decontaminate.ANSWER :], region) >= 0.8 * weight[-decontaminate.ANSWER :].sum()
                if share >= decontaminate.SURE or (share >= decontaminate.LIKELY and tail):
                    out.add((i, k))
                    break
    return out


def plain_lcs(a, weight, b):
    best = [0.0] * (len(b) + 1)
    for x, w in zip(a, weight, strict=True):
        last = best[:]
        for j, y in enumerate(b):
            best[j + 1] = max(last[j + 1], best[j], last[j] + w if x == y else 0.0)
    return best[-1]


def test_leaks_equal_brute_force(docs, spark):
    """Verbatim items, items with words changed or dropped, spread out, halves with and without the answer."""
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.randrange(6, 40)))) for k in range(12)]
    rows = []
    for i in range(60):
        words = items[i % 12][1].split()
        kind = i // 12
        if kind == 1:
            words = [w if rng.random() < 0.7 else rng.choice(vocab) for w in words]
        elif kind == 2:
            words = [w for w in words if rng.random() < 0.75]
        elif kind == 3:
            words = words[len(words) // 2 :]
        elif kind == 4:
            words = words[: len(words) // 3]
        rows.append((i, " ".join(rng.choices(vocab, k=rng.randrange(50)) + words + rng.choices(vocab, k=rng.randrange(50)))))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plain_leaks(rows, items)
    assert got == want and len(want) > 20
