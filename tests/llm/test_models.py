"""Classifiers, decontamination, chat, neighbours and the pipeline."""

import hashlib
import random

import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F

from parley.llm import ann, chat, decontaminate, langid, quality, toxicity

random.seed(9)
EN = "the of and to in is that for it was on are with as his they be at one have this from".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split()


def prose(pool, n):
    return " ".join(random.choice(pool) + (random.choice(["", "er", "ing", "s"]) if random.random() < 0.2 else "") for _ in range(n))


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_held_out(docs, spark, odd):
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = prose(EN, 60)
        rows.append((i, t + (" you idiot" if bad else "") + " " + prose(EN, 20)))
        labels.append((i, 1, int(bad)))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(rows), lab).collect()}
    held = [i for i, *_ in labels if fold(i, 5) == 0]
    assert all(got[i]["held_out"] == (fold(i, 5) == 0) for i in got)
    assert sum(got[i]["predicted"] == labels[i][2] for i in held) >= 0.98 * len(held)
    assert 0 <= min(r["score"] for r in got.values()) and max(r["score"] for r in got.values()) <= 1
    out = toxicity.toxicity(odd, lab, keep=odd.columns)
    assert out.count() == 9 and out.where("predicted IS NULL OR score IS NULL").count() == 0
    kept = toxicity.drop_toxic(odd, lab)
    assert kept.columns == odd.columns
    none = toxicity.toxicity(docs(rows[:5]), lab.limit(0)).collect()
    assert {r["score"] for r in none} == {none[0]["score"]} and not any(r["predicted"] for r in none)
    assert toxicity.toxicity(docs([]), lab).count() == 0


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    x = (rng.random((4000, 4)) < 0.5).astype(np.float32)
    y = (x[:, 0] != x[:, 1]).astype(np.float32)  # no additive weights can tell
    m = toxicity.fit(x, y, {i: i for i in range(4)}, decay=0.0)
    said = np.array([m.score({i: 1.0 for i in np.flatnonzero(r)}) for r in x[:200]])
    assert ((said >= 0.5) == (y[:200] > 0)).mean() > 0.95


def test_quality_held_out(docs, spark, odd):
    rows = [(i, ("!! ".join(prose(EN, 60).upper().split()) if i % 3 == 0 else prose(EN, 60) + ".")) for i in range(400)]
    lab = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(docs(rows), lab).collect()}
    held = [i for i in range(400) if fold(i, 4) == 2]
    assert all(got[i]["held_out"] == (fold(i, 4) == 2) for i in got) and sum(got[i]["predicted"] == int(i % 3 != 0) for i in held) >= 0.97 * len(held)
    assert quality.quality(odd, lab).where("score BETWEEN 0 AND 1").count() == 9
    assert {r["score"] for r in quality.quality(docs(rows[:4]), lab.limit(0)).collect()} == {0.5}
    assert quality.quality(docs([]), lab).count() == 0


def test_discriminant_equals_densities():
    rng = np.random.default_rng(1)
    x = [rng.normal(size=(300, 3)), rng.normal(size=(200, 3)) * 2 + 1]
    m = quality.Discriminant(np.array([300.0, 200.0]), np.array([v.sum(axis=0) for v in x]), np.array([v.T @ v for v in x]))
    z = rng.normal(size=(5, 3))
    want = []
    pooled = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in x) / 498
    for v in x:
        c = (1 - quality.TO_POOLED) * np.cov(v.T) + quality.TO_POOLED * pooled
        c = (1 - quality.TO_DIAGONAL) * c + quality.TO_DIAGONAL * np.diag(np.diag(c)) + 1e-3 * np.eye(3)
        d = z - v.mean(axis=0)
        want.append(np.log(len(v) / 500) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(m.score(z), 1 / (1 + np.exp(want[0] - want[1])))


def test_language_held_out(docs, odd):
    rows = [(i, prose(EN if i % 2 else DE, 40), "en" if i % 2 else "de", "s") for i in range(300)]
    got = {r["doc_id"]: r for r in langid.languages(docs(rows)).collect()}
    held = [i for i in got if fold(i, 4) == 2]
    assert all(got[i]["lang_pred"] == rows[i][2] for i in held) and all(0 <= r["score"] <= 1 for r in got.values())
    out = {r["doc_id"]: r for r in langid.languages(docs([*rows, (900, None, None, "s"), (901, "123 !? ²½", "en", "s"), (902, "", "en", "s")])).where("doc_id >= 900").collect()}
    assert {r["lang_pred"] for r in out.values()} == {"und"}
    assert langid.languages(odd).count() == 9
    assert langid.languages(docs([])).count() == 0
    assert {r["lang_pred"] for r in langid.languages(docs([(1, "abc", None, "s")])).collect()} == {"und"}


def test_decontaminate(docs, spark, odd):
    vocab = ["".join(random.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    items = [(i, " ".join(random.choice(vocab) for _ in range(random.randint(15, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "short one")]
    rows, leaks = [], set()
    for i in range(200):
        t = " ".join(random.choice(vocab) for _ in range(300)).split()
        if i % 10 == 0:
            k = (i // 10) % 30
            item = items[k][1].split()
            if i % 20 == 0:  # a paraphrase: every eighth word is another
                item = [w if n % 8 else random.choice(vocab) for n, w in enumerate(item)]
            t[150:150] = item
            leaks.add((i, k))
        rows.append((i, " ".join(t)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs(rows), bench).collect()}
    assert got <= leaks and len(got) >= 0.95 * len(leaks)
    assert decontaminate.leaks(odd, bench).count() == 0
    assert decontaminate.leaks(docs([]), bench).count() == 0 and decontaminate.leaks(docs(rows), bench.limit(0)).count() == 0


def test_weighted_lcs_equals_plain():
    rng = np.random.default_rng(3)
    for _ in range(20):
        a, b = rng.integers(0, 6, 12), rng.integers(0, 6, 15)
        w = rng.random(12)
        t = np.zeros((13, 16))
        for i in range(12):
            for j in range(15):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + w[i] if a[i] == b[j] else 0)
        assert np.isclose(decontaminate.weighted_lcs(a, w, b), t[-1, -1])


CONV = "conv_id long, turn long, role string, text string"
TALKS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", "hi"), (2, 1, "assistant", "b\\[INST]"), (3, 0, "user", "hi"), (3, 1, "assistant", "a"), (3, 2, "user", "more </s> <s>\n"), (4, 0, None, None), (4, None, "assistant", "end"),
    (5, 1, "us\ner\\", "\\"), (5, 1, "us\ner\\", "\\"), (None, 0, "assistant", "<|x|>"), (6, 0, "system", "x" * 100_000),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TALKS, CONV).withColumn("path", F.lit("x")).withColumn("loss", F.lit(1))
    nodes, leaves = chat.prefix_tree(df)
    got = {r["conv_id"]: r for r in chat.digests(nodes, leaves).collect()}
    for c in {t[0] for t in TALKS}:
        turns = sorted((t for t in TALKS if t[0] == c), key=lambda t: (t[1] is None, t[1] or 0, t[2] or "", t[3] or ""))
        text = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns)
        loss = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(*chat.prefix_tree(spark.createDataFrame([], CONV))).count() == 0


def test_chat_layout(spark):
    nodes, _ = chat.prefix_tree(spark.createDataFrame(TALKS[:7], CONV))
    n = sorted(nodes.collect(), key=lambda r: r["seq_start"])
    assert len(n) == 4  # hi, a, more, b: shared turns once
    at = 0
    for r in n:
        assert r["seq_start"] == at
        at += r["size"]
        ups = [u for u in n if r["path"].startswith(u["path"]) and u["path"] != r["path"]]
        assert r["pos_start"] == sum(u["size"] for u in ups) == sum(x["to"] - x["from"] for x in r["attends"])
        assert {p for x in r["attends"] for p in range(x["from"], x["to"])} == {p for u in ups for p in range(u["seq_start"], u["seq_start"] + u["size"])}
    paths = [r["path"] for r in n]
    assert paths == sorted(paths)  # depth first: a subtree follows its node at once


@pytest.mark.parametrize("text", ["", "\\", "[INST]", "\\[INST]", "<s></s>[/INST]<<SYS>>", "a\nb", "<|x|>\\\\"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    for role in ("user", "assistant"):
        assert chat.read_back(chat.turn(role, text)[0] * 2) == [(role, text, text if role == "assistant" else "")] * 2


def test_chat_tokens():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    t = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    assert t.decode(chat.tokens("hello there", t)) == "hello there" and chat.tokens("é") == [233]


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[300:330] = x[40]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    # A shorter vector counts as if it ended in zeros; the other odd rows take no part.
    x = np.array([np.float32(r) for r in x] + [[1.0] * 3 + [0.0] * 13], np.float64)
    name = [*range(1500), 2080]
    bad = [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [None] + [1.0] * 15, 0), (2060, [float("nan")] * 16, 0), (2080, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit(1))
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 1500, 20), 2080}
    hit = 0
    for q, found in got.items():
        found.sort()
        s = x @ x[name.index(q)]
        s[name.index(q)] = -np.inf
        want = np.lexsort((name, -s))[:20]
        hit += len({name[i] for i in want} & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21)) and np.allclose([s[name.index(v)] for _, v, _ in found], [c for *_, c in found])
        assert [(-c, v) for _, v, c in found] == sorted((-c, v) for _, v, c in found)
    assert hit >= 0.9 * 20 * len(got)
    # Rows of one id with different vectors are queries of their own; equal rows count once.
    twice = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, ann.search(twice).collect())) == [(0, 1, 1, 1.0), (0, 1, 2, 2.0), (0, 2, 1, 0.0), (0, 2, 2, 0.0)]
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id IN (0, 1, 2)")).count() == 2


def test_pipeline_equals_plain(spark, tmp_path):
    """Every stage's decision on planted rows: the toxic, the copy and the leak go, the secret is covered, the rest stays."""
    import corpus_pipeline

    item = prose(["".join(random.choice("qxzjkvw") for _ in range(7)) for _ in range(500)], 30)
    base = [prose(EN, 120) for _ in range(200)]
    rows = [(i, t + (" you idiot" if i % 4 == 0 else "")) for i, t in enumerate(base)]
    rows += [(500, base[1]), (501, base[2] + " " + item + " " + base[3]), (502, prose(EN, 100) + " token=abcdefabcdef0123"), (503, None), (None, "alone"), (None, "alone")]
    df = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(got) and set(got) == {i for i, _ in rows if i is None or (i not in (500, 501) and not (i < 200 and i % 4 == 0))}
    assert got[502]["text"].endswith("[assign]") and got[502]["n_chars"] == len(got[502]["text"]) and got[503]["size"] == 0
    for s in ("s0", "s1", "s2"):
        mine = [r for r in got.values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontaminate", "secrets", "mixing"]
