"""Deduplication, secrets and mixing, against brute force and on odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import mixing, repeats, secrets, simhash
from parley.llm._shared import new_path
from parley.llm.components import components
from parley.llm.runindex import RunIndex

random.seed(5)


def plain_removal(rows):
    """Brute force of the removal: sets of all 50-byte strings by id."""
    seen, out = set(), []
    ids = sorted({i for i, _ in rows if i is not None})
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i in ids:
        mine = set()
        for j, t in texts:
            if j == i:
                gone = bytearray(len(t))
                for q in range(len(t) - 49):
                    mine.add(t[q : q + 50])
                    if t[q : q + 50] in seen:
                        gone[q : q + 50] = b"\1" * 50
                out.append((i, len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
        seen |= mine
    out += [(None, len(t), 0, 0, hashlib.sha256(t).hexdigest()) for j, t in texts if j is None]
    return sorted(out, key=str)


def words(n, pool=40):
    return " ".join(random.choice("abcdefgh") * random.randint(1, 4) + str(random.randrange(pool)) for _ in range(n))


def repeated_rows():
    line, base = "x" * 30 + "licensed under the terms " * 3, words(300)
    rows = [(i, words(60, 9000) + line + words(30, 9000)) for i in range(30, 10, -1)]
    rows += [(100 + i, base[: 200 + i] + "EDIT" + base[200 + i * 7 :]) for i in range(12)] + [(i, base) for i in (50, 51, 200)] + [(300, "ab" * 200), (301, "ab" * 40), (302, base[100:149]), (303, base[100:150]), (304, "é" * 40), (305, "é" * 40)]
    return rows + [(1, None), (2, ""), (7, base[:120]), (7, base[:120]), (None, base)]


def test_repeats_equal_brute_force(docs, monkeypatch):
    rows = repeated_rows()
    got = repeats.removals(docs(rows)).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_removal(rows)


def test_repeats_in_many_pieces_and_buckets(docs, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 700)
    monkeypatch.setattr(repeats, "FLUSH", 3000)
    monkeypatch.setattr(repeats, "BUCKET", 4000)
    rows = repeated_rows()
    df = docs(rows)
    total = repeats.BUCKET
    assert total == 4000
    # Tasks import the module anew; the pieces are cut here, on the driver's side, too.
    texts = [(t or "").encode() for _, t in rows]
    for buf, starts, ends, number, offset in repeats.pieces(texts):
        assert len(buf) <= 1400
        for s, e, k, o in zip(starts, ends, number, offset, strict=True):
            assert bytes(buf[s:e]) == texts[k][o : o + e - s]
    got = repeats.removals(df).drop("kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_removal(rows)


def test_repeats_odd_and_empty(odd, docs):
    assert repeats.removals(odd).count() == 9
    assert repeats.removals(docs([])).count() == 0


def test_run_index_finds_and_streams():
    base = bytes(random.choice(b"ab") for _ in range(90))
    strings = [base[i : i + random.randint(0, 60)] for i in range(20)]
    owners = np.arange(20)[::-1].copy()
    index = RunIndex(strings, owners, 12)
    assert index.runs <= index.size
    got = {(int(a), int(p)): int(o) for at, pos, least in index.stream() for a, p, o in zip(at, pos, least, strict=True)}
    assert got == {(i, p): min(int(owners[j]) for j, t in enumerate(strings) if s[p : p + 12] in t) for i, s in enumerate(strings) for p in range(len(s) - 11)}
    whole = b"\xff".join(strings) + b"\xff"
    for p in (b"a", b"ba", base[3:9], b"zz"):
        n, at = index.find(p)
        assert n == sum(s.startswith(p, k) for s in strings for k in range(len(s)))
        assert (at is None) == (n == 0) and (n == 0 or whole[at : at + len(p)] == p)
    assert list(RunIndex([], np.zeros(0, np.int64)).stream()) == []


def plain_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_groups(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(fps)
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))], links


def test_simhash_equal_brute_force(docs):
    base = words(200, 4000)
    rows = [(i, words(40, 4000)) for i in range(60)] + [(100 + i, base + f" tail{i}") for i in range(40)] + [(200, base), (201, base.upper()), (202, None), (203, ""), (204, "two words"), (205, "one")]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(rows)).collect()}
    fps = [plain_fingerprint(t) for _, t in rows]
    groups, links = plain_groups(fps)
    least = {g: min(rows[i][0] for i in range(len(rows)) if groups[i] == g) for g in set(groups)}
    for (i, _), f, g, n in zip(rows, fps, groups, links, strict=True):
        assert got[i]["fp"] % 2**64 == f and got[i]["component_id"] == least[g] and got[i]["n_links"] == n


@pytest.mark.parametrize("most", [1000, 3])
def test_trie_join_deals_large_subtrees_again(spark, most):
    rng = random.Random(7)
    keys = {0, 1, 3, 7, (1 << 64) - 1}
    centre = rng.getrandbits(64)
    for _ in range(150):
        keys.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        keys.add(rng.getrandbits(64))
    keys = sorted(keys)
    df = spark.createDataFrame([(k - (1 << 64) if k >> 63 else k, 1) for k in keys], "fp long, n long")
    found = simhash.trie_self_join(df, most).collect()
    groups, links = plain_groups(keys)
    got = {}
    for r in found:
        got[r["fp"] % 2**64] = got.get(r["fp"] % 2**64, 0) + r["links"]
    assert got == {k: n for k, n in zip(keys, links, strict=True) if n}
    forest = {k: k for k in keys}

    def find(x):
        while forest[x] != x:
            x = forest[x]
        return x

    for r in found:
        a, b = find(r["fp"] % 2**64), find(r["root"] % 2**64)
        forest[max(a, b)] = min(a, b)
    assert [find(k) for k in keys] == [keys[g] for g in groups]


def test_simhash_odd_and_empty(odd, docs):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 9 and {r["component_id"] for r in got if r["doc_id"] == 3 or r["fp"] == got[0]["fp"]} <= {1, 2, 3, 4, 5, 6}
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (102, 101)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets(docs, spark):
    texts = [
        (1, "API_Key = 'abcdEFGH1234' and token=secret=aaaaaaaaaaaaaaaa"), (2, "AKIAABCDEFGHIJKLMN AKIAA 0123456789abcdef0"), (3, "token=password: longlonglonglong"), (4, "é" * 5 + "passwd:0123456789abcdef0123"),
        (5, "-----BEGIN RSA PRIVATE KEY----- postgres://me:pw@h"), (6, None), (7, "ſecret=aaaaaaaaaaaaaaaa"), (1, "other"),
    ]
    got = secrets.findings(docs(texts), new_path(spark, "ledger")).collect()
    rules = [(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2), (r"AKIA[A-Z0-9]+", 18, 0), (r"[0-9a-f]+", 16, 0)]
    want = []
    for i, t in texts:
        spans = sorted((m.start(), k, m.end()) for k, (p, n, g) in enumerate(rules) for m in re.finditer(p, t or "", re.A) if len(m[g]) >= n)
        want.append((i, *(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(",".join(f"{secrets.BASE[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()))
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    assert {r["spans"].split(":")[0] for r in got if r["doc_id"] == 5} == {"pem"} and "dsn" in next(r["spans"] for r in got if r["doc_id"] == 5)


def test_ledger_scans_only_what_is_new(docs, spark, monkeypatch):
    path = new_path(spark, "ledger")
    secrets.update_ledger(docs([(1, "a"), (2, "a"), (3, "b"), (4, None)]), path)
    assert secrets.read_ledger(spark, path).count() == 3
    secrets.update_ledger(docs([(1, "a"), (9, "c"), (5, "")]), path)
    assert secrets.read_ledger(spark, path).count() == 4
    found = secrets.findings(docs([(1, "a"), (2, "a")]), path)
    assert found.count() == 2 and secrets.read_ledger(spark, path).count() == 4


@pytest.mark.parametrize("few", [5000, 0])
def test_a_changed_rule_is_scanned_alone(docs, spark, monkeypatch, few):
    monkeypatch.setattr(secrets, "FEW", few)
    path, rows = new_path(spark, "ledger"), docs([(1, "token=abcdefabcdef0123"), (2, "token=abcdefabcdef0123"), (None, "b")])
    before = sorted(map(str, secrets.findings(rows, path).collect()))
    monkeypatch.setitem(secrets.VERSIONS, "hex", "9")
    assert [r["n_hex"] for r in secrets.digests(spark, path).where("spans != ''").collect()] == [0]  # no findings of a rule that isn't in force
    assert sorted(map(str, secrets.findings(rows, path).collect())) == before
    scans = sorted((r["rules"], r["spans"]) for r in secrets.read_ledger(spark, path).collect())
    assert [r for r, _ in scans] == [["assign@1", "access@1", "hex@1", "pem@2", "prefixed@1", "jwt@1", "dsn@1"]] * 2 + [["hex@9"]] * 2
    assert [x for r, x in scans if r == ["hex@9"]] == ["", "hex:6:22"]


def test_findings_of_all_versions_of_a_path(docs, spark):
    path = new_path(spark, "ledger")
    for texts in ([(1, "token=abcdefabcdef0123"), (2, "b")], [(1, "clean now"), (2, "b"), (3, "token=abcdefabcdef0123")], [(1, "clean now")]):
        secrets.update_ledger(docs(texts), path)
        secrets.record_paths(docs(texts), path)
    got = secrets.history(spark, path).collect()
    assert sorted((r["doc_id"], r["spans"]) for r in got) == [(1, "assign:0:22,hex:6:22"), (3, "assign:0:22,hex:6:22")]
    assert spark.read.parquet(f"{path}/paths").count() == 4 and secrets.history(spark, new_path(spark, "none")).count() == 0


def test_redact(docs, odd, spark):
    d = docs([(1, "x token=abcdefabcdef0123 y"), (2, "plain"), (3, None)])
    got = {r["doc_id"]: r for r in secrets.redact(d, new_path(spark, "ledger")).collect()}
    assert got[1]["text"] == "x [assign] y" and got[1]["n_chars"] == 12 and got[2]["text"] == "plain" and got[3]["text"] is None
    out = secrets.redact(odd, new_path(spark, "ledger"))
    assert out.columns == odd.columns and out.count() == 9 and {r["spans"] for r in out.collect()} == {"x"}
    assert secrets.findings(odd, new_path(spark, "ledger")).count() == 9
    assert secrets.findings(docs([]), new_path(spark, "ledger")).count() == 0


def waterfill(sizes, cap=3.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        heft = sum(w[s] for s in free)
        share = {s: (total - sum(fixed.values())) * w[s] / heft for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5, "": 7}, {"a": 1}, {"x": 0, "y": 50}, {f"s{i}": i * i for i in range(20)}])
def test_source_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in waterfill(sizes).items()}


@pytest.mark.parametrize("weights", [[0.25], [1.0], [0.25, 0.5, 1.0, 40.0]])
def test_buckets_are_even_for_any_weights(spark, weights):
    n, keys = 20_000, 100
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("id") % len(weights) + 1).cast("int"))
    rows = spark.range(n).withColumn("key", -F.log(mixing.unit_hash(F.col("id").cast("string"))) / w)
    rows = rows.withColumn("classes", F.array(*(F.struct(F.lit(x).alias("w"), F.lit(n // len(weights)).alias("n")) for x in weights)))
    got = [r["count"] for r in rows.groupBy(F.floor(mixing.share_below("key", "classes") / n * keys).alias("b")).count().collect()]
    assert len(got) == keys and max(got) < 1.4 * n / keys and min(got) > 0.6 * n / keys


def test_mix_without_ids(docs):
    """Rows without an id draw by their texts, and the same texts draw the same."""
    rows = [(None, " ".join(f"w{i}" for i in range(k % 9))) for k in range(60)]
    got = mixing.mix(docs(rows), weight=F.lit(0.25)).collect()
    assert len(got) == 60 and sum(r["taken"] for r in got) == round(got[0]["target"])
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(rows), weight=F.lit(0.25)).collect()))


def test_mix(docs, odd):
    rows = [(i, "w " * random.randint(0, 40), "en", random.choice(["a", "b", "b", "b", "c", None])) for i in range(300)]
    got = mixing.mix(docs(rows)).collect()
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine) and sum(r["size"] for r in mine) == mine[0]["source_size"]
        epochs = int(mine[0]["target"] // mine[0]["source_size"])
        assert all(r["taken"] >= epochs * r["size"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs(rows)).collect()))
    out = mixing.mix(odd)
    assert out.count() == 9 and {"_key", "_row", "taken"} <= set(out.columns) and out.where(F.col("doc_id") == 1).first()["size"] == 0
    assert mixing.mix(docs([])).count() == 0
