"""The index's walk over its strings."""

import random

import numpy as np

from parley.llm import runindex


def test_stream_needs_no_search_and_equals_brute_force(monkeypatch):
    rng = random.Random(5)
    base = "".join(rng.choice("abcd ") for _ in range(400)).encode()
    strings = [base[a : a + 80] for a in (rng.randrange(320) for _ in range(60))] + [b"x" * 70, b"x" * 49, b"", b"short"]
    owners = np.array([rng.randrange(1000) for _ in strings])
    least: dict[bytes, int] = {}
    for s, o in zip(strings, owners, strict=True):
        for i in range(len(s) - 49):
            least[s[i : i + 50]] = min(least.get(s[i : i + 50], 10**9), int(o))
    index = runindex.RunIndex(strings, owners)
    assert len(index.find(base[100:150])) == 2
    # A search a byte cost as much as the sorting of the index.
    monkeypatch.setattr(runindex.np, "searchsorted", None)
    got = {(int(s), int(i)): int(o) for a, p, l in index.stream() for s, i, o in zip(a, p, l, strict=True)}
    assert got == {(n, i): least[s[i : i + 50]] for n, s in enumerate(strings) for i in range(len(s) - 49)}
