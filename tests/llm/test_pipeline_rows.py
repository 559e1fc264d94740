"""Stage decisions on rows that share an id or have none."""

import random

import corpus_pipeline


def test_rows_are_judged_one_by_one(docs, spark, tmp_path):
    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    a, b, c, d, item = prose(100), prose(100), prose(100), prose(100), prose(25)
    # Another text under a used id stays; a copy without an id goes; a group of rows without an id keeps one.
    got = corpus_pipeline.drop_near_duplicates(spark, docs([(1, a), (1, b), (2, a), (None, a + " end"), (None, c), (None, c + " end"), (3, d), (3, d)]), "").collect()
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in got)
    assert len(texts) == 4 and {(1, a), (1, b), (3, d)} < set(texts) and texts[0][1] in (c, c + " end")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, a + " " + item), (None, b), (4, c), (4, c + " " + item)]
    got = corpus_pipeline.drop_leaks(spark, docs(rows), str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, b), (4, c)])
