"""The pipeline's simhash stage takes the links of the trie self-join."""

import random

from parley.llm.nearcopies import shingles
from parley.llm.simhash import fingerprint


def test_stage_drops_what_the_trie_links(docs, spark):
    """Texts of equal SimHash whose five-word shingles are less than 0.8 similar, alone and in a chain with a near copy."""
    import corpus_pipeline

    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    # One unit, repeated over and over, outweighs in its SimHash what stands around it once.
    unit = prose(5)  # an odd number of shingles, so no bit is even
    a, b = (" ".join(unit * 400 + prose(12)) for _ in range(2))
    c = b + " end"
    x, y, z = (set(shingles(t).tolist()) for t in (a, b, c))
    assert (fingerprint(a) ^ fingerprint(b)).bit_count() <= 2 and 5 * len(x & y) < 4 * len(x | y) and 5 * len(y & z) >= 4 * len(y | z)
    other = " ".join(prose(80))
    got = corpus_pipeline.drop_near_duplicates(spark, docs([(1, a), (2, b), (3, c), (4, other), (None, None), (5, "")]), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 4, 5]
