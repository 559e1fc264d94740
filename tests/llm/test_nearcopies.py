"""Near copies of the pipeline, against brute force."""

import random

import pytest

from parley.llm import nearcopies
from parley.llm._shared import materialise


def plain(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("hubs", [8, 1])
def test_near_copies_equal_brute_force(docs, monkeypatch, hubs):
    monkeypatch.setattr(nearcopies, "HUBS", hubs)
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    line = prose(30)
    texts = [prose(60) + " " + line for _ in range(30)]
    for edits in (1, 2, 3, 4, 6, 8):
        base = prose(120)
        texts += [base] + [edited(rng, base, edits) for _ in range(15)]
    texts += [None, "", "two words", "Two  words", line, line + " a", texts[0]]
    got = {(r["doc_id"]): r["root"] for r in docs(list(enumerate(texts))).select("doc_id", nearcopies.row_key().alias("row_key")).join(materialise(nearcopies.near_copies(docs(list(enumerate(texts)))), "t"), "row_key").collect()}
    want = plain(texts)
    assert len(got) == len(texts) and len(set(want)) < len(texts) - 30
    assert len(set(zip(want, (got[i] for i in range(len(texts))), strict=True))) == len(set(want)) == len(set(got.values()))


def test_stage_drops_near_copies(docs, spark):
    """Pairs that the stage's rule of 0.8 joins, though their SimHashes differ in more than two bits."""
    import corpus_pipeline
    from parley.llm.simhash import fingerprint

    rng = random.Random(8)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(150)) for _ in range(12)]
    near = [edited(rng, t, 2) for t in base]
    assert sum((fingerprint(a) ^ fingerprint(b)).bit_count() > 2 for a, b in zip(base, near, strict=True)) >= 6
    got = corpus_pipeline.drop_near_duplicates(spark, docs([*enumerate(base), *((100 + i, t) for i, t in enumerate(near))]), "").collect()
    assert sorted(r["doc_id"] for r in got) == list(range(12))
