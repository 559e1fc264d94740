"""Queries over texts against their SQL on odd rows."""

import pytest

import __spark_entry__ as entry

TEXTS = [
    "Bestä einpfach. Best wishes to you.\nHiß there now", "HELLO\u00e9 out there, you", "thank\u017f for all this! Than\u212as for all this", "hı there my friend", "H\u0130 there my friend",
    "\u00a0\u3000Leading spaces of all kinds\u00a0", "a sentence.\x0bnext one here\x0b\n\u2003inner spaces\u2003\nline two\u2028", "1. first point - \n* second point 9", "part one\x01part two of it", None, "", "best", "okay_then it is", "regards2 to all",
]


@pytest.fixture
def against_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")

    def run(query, **tables):
        con = duckdb.connect()
        for name, (rows, schema) in tables.items():
            df = spark.createDataFrame(rows, schema)
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        df = entry.queries()[query](spark, str(tmp_path))
        got = [tuple(r) for r in df.collect()]
        return sorted(got, key=str), sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()[query]})").fetchall(), key=str)

    return run


def test_claims_equal_their_sql_on_odd_texts(against_sql):
    got, want = against_sql("claims", documents=([*enumerate(TEXTS), (None, "no id, but a claim")], "doc_id long, text string"))
    assert got == want and len(got) > 8


def test_bm25_ties_and_nulls_equal_the_sql(against_sql):
    """Many documents of the same words in another order tie, null texts have no length, and nothing fills up."""
    import random

    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(400):
        some = random.Random(i % 5).choices(words, k=30)
        rng.shuffle(some)
        docs.append((i, " ".join(some)))
    docs += [(1000 + i, None) for i in range(100)] + [(None, "w1 w2 w3"), (2000, "rare \u212aelvin \u0130x")]
    items = [(i, " ".join(rng.sample(words, 20))) for i in range(20)] + [(50, "rare"), (51, "kelvin ix"), (52, None)]
    got, want = against_sql("bm25_topk", documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    assert got == want and len(got) > 200
