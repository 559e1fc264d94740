"""What a query of op5 reads, and the selection from many scores."""

import numpy as np

from parley.llm import ann


def test_lists_that_must_all_be_read_are_not_replicated_widely():
    """Vectors without clusters: most lists are kept, and the entries met stay about the number of vectors."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6000, 48))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    largest = float((x * x).sum(axis=1).max())
    c = ann.balanced_centroids(ann.lift(x, largest, False), 77)
    ratio, boundary = ann.fitted(x, c, largest, 20)
    near, away = ann._nearest(ann.lift(x, largest, False), c)
    plain = ann._distances(ann.lift(x, largest, False), c)
    assert (np.sort(plain, axis=1)[:, : ann.COPIES] ** 0.5 - away).max() < 1e-6 and (near[:, 0] == plain.argmin(axis=1)).mean() > 0.999
    joins = ann._joined(away, boundary)
    sizes = np.bincount(near[joins], minlength=len(c))
    met = [sizes[found].sum() for found in ann.Graph(c).search(ann.lift(x[:200], largest, True), ratio)]
    assert joins.sum() > len(x) and np.mean(met) < 1.2 * len(x)


def test_best_of_many_scores_equals_sorting():
    rng = np.random.default_rng(2)
    for few in (0, 3, 30, 9000):
        x = rng.integers(-2, 3, size=(9000, 6)).astype(float)
        q, ids = rng.normal(size=6), rng.permutation(9000) // 2
        s = np.full(9000, -np.inf)
        some = rng.permutation(9000)[:few]
        s[some] = x[some] @ q
        got, scores = ann.best(s, q, ids, x, 20)
        want = sorted({(-float((x[i] * q).sum()), int(ids[i])) for i in some})
        once = list(dict.fromkeys(i for _, i in want))[:20]
        assert got.tolist() == once and np.allclose(scores, [next(-v for v, j in want if j == i) for i in once])
