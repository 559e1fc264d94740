from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parley.operators import clean, context, graph
from parley.schemas import MESSAGE, RAW_MESSAGE
from parley.sources import tables

T0 = datetime(2024, 1, 1, 10)


def msgs(spark, rows):
    """rows: (id, inbound, minute, children, parent)"""
    data = [(i, "brand" if not b else f"c{i}", b, T0 + timedelta(minutes=m), f"text {i}", ch, p) for i, b, m, ch, p in rows]
    return spark.createDataFrame(data, MESSAGE)


def paths(spark, rows):
    return sorted(tuple(r["path"]) for r in graph.paths(msgs(spark, rows)).collect())


def test_orphan_begins_nothing(spark):
    rows = [("1", True, 0, "2", None), ("2", False, 1, None, "1"), ("3", True, 2, None, "99999")]
    assert paths(spark, rows) == [("1", "2")]
    assert [r[0] for r in graph.orphans(msgs(spark, rows)).collect()] == ["3"]


def test_declared_child_with_missing_parent_is_reached(spark):
    rows = [("1", True, 0, "4", None), ("2", False, 1, None, "1"), ("4", True, 2, None, "999")]
    assert paths(spark, rows) == [("1", "2"), ("1", "4")]
    assert [(r["dst"], r["issue"]) for r in graph.edge_audit(msgs(spark, rows)).collect()] == [("4", "disagrees")]


def test_cycle_ends_the_path_and_a_good_child_goes_on(spark):
    assert paths(spark, [("1", True, 0, "2", None), ("2", False, 1, "1", "1")]) == [("1", "2")]
    rows = [("1", True, 0, "2", None), ("2", False, 1, "1,3", "1"), ("3", True, 2, None, "2")]
    assert paths(spark, rows) == [("1", "2"), ("1", "2", "3")]


def test_rootless_cycle_and_empty(spark):
    assert paths(spark, [("1", True, 0, None, "2"), ("2", False, 1, None, "1")]) == []
    assert paths(spark, []) == []


def test_branches_share_a_thread_id(spark):
    rows = [("1", True, 0, "2", None), ("2", False, 1, "3, 4", "1"), ("3", True, 2, None, "2"), ("4", True, 3, None, "2")]
    t = graph.threads(msgs(spark, rows)).collect()
    assert [r["thread_id"] for r in t] == ["1", "1"] and not any(r["terminal"] for r in t) and t[0]["path_id"] != t[1]["path_id"]


def test_threads_need_a_brand_and_order_by_time_then_id(spark):
    rows = [("10", True, 0, "11", None), ("11", True, 1, None, "10"), ("20", True, 0, "21", None), ("21", False, 1, None, "20"), ("3", True, 5, "1", None), ("1", True, 5, "2", "3"), ("2", False, 6, None, "1")]
    t = {r["thread_id"]: [x["tweet_id"] for x in r["tweets"]] for r in graph.threads(msgs(spark, rows)).collect()}
    assert t == {"20": ["20", "21"], "1": ["1", "3", "2"]}


def test_response_ids(one):
    assert one(graph.response_ids, " 1, 2 ,,1,nan") == ["1", "2"]
    assert one(graph.response_ids, None) == []


def test_last_duplicate_wins(spark):
    m = msgs(spark, [("1", True, 0, None, None)]).withColumn("ordinal", F.lit(1)).unionByName(msgs(spark, [("1", False, 0, None, None)]).withColumn("ordinal", F.lit(2)))
    assert [r["inbound"] for r in graph.vertices(m, "ordinal").collect()] == [False]


def raw(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RAW_MESSAGE + ", ordinal long")


GOOD = "Tue Oct 31 22:10:47 +0000 2017"


def test_cleaning_order(spark):
    rows = [
        (" 1 ", " a ", "True", GOOD, "x\x00y", "2, 3", None), ("2", "  ", "t", GOOD, "x", None, None), ("3", "a", "yes", "soon", "x", None, None), ("3", "a", "no", GOOD, "x", None, None),
        (None, "a", "1", GOOD, "x", None, None), ("4", "a", "0", "2023-01-15T12:30:00Z", None, "nan", "1"), ("1", "b", "1", GOOD, "dup", None, None),
    ]
    got = {r["tweet_id"]: r for r in clean.clean(raw(spark, rows)).collect()}
    assert sorted(got) == ["1", "4"]
    assert got["1"]["author_id"] == " a " and got["1"]["inbound"] and got["1"]["text"] == "xy" and got["1"]["created_at"] == datetime(2017, 10, 31, 22, 10, 47)
    assert got["4"]["text"] == "" and got["4"]["response_tweet_id"] is None and not got["4"]["inbound"]
    c = clean.reject_counts(raw(spark, rows)).first().asDict()
    assert c == {"total": 7, "valid": 2, "rejected_author": 1, "rejected_tweet_id": 1, "rejected_duplicate": 2, "rejected_date": 1}


def test_brand_filter(spark):
    m = msgs(spark, [("1", True, 0, "2", None), ("2", False, 1, None, "1"), ("3", True, 2, None, None)])
    t = graph.threads(m)
    assert sorted(r["tweet_id"] for r in clean.filter_brand(m, "brand", t).collect()) == ["1", "2"]
    assert [r["tweet_id"] for r in clean.filter_brand(m, "brand").collect()] == ["2"]
    with pytest.raises(ValueError):
        clean.filter_brand(m, "nobody")


def thread(spark):
    return graph.threads(msgs(spark, [("1", True, 0, "2", None), ("2", False, 1, "3", "1"), ("3", True, 2, "4", "2"), ("4", False, 3, None, "3")]))


@pytest.mark.parametrize(("most", "want"), [(None, [0, 1, 2, 3]), (0, [0, 0, 0, 0]), (1, [0, 1, 1, 1]), (2, [0, 1, 2, 2]), (9, [0, 1, 2, 3])])
def test_context_windows(spark, most, want):
    rows = context.context_windows(thread(spark), most).orderBy("turn_index").collect()
    assert [len(r["history"]) for r in rows] == want
    assert rows[0]["context"] == "Customer: text 1"


def test_context_inbound_only_and_errors(spark):
    rows = context.context_windows(thread(spark), None, inbound_only=True).orderBy("turn_index").collect()
    assert [r["turn_index"] for r in rows] == [0, 2] and rows[1]["history"][1] == "Agent: text 2"
    with pytest.raises(ValueError):
        context.context_windows(thread(spark), -1)


def test_features_and_corpus(spark):
    f = context.features(thread(spark)).first()
    assert (f["follow_up_count"], f["time_of_day"], f["day_of_week"], f["text_length"]) == (1, "business_hours", "weekday", 2)
    c = context.corpus(thread(spark)).first()
    assert (c["doc_id"], c["resolution_text"]) == ("1", "text 2")
    assert context.corpus(graph.threads(msgs(spark, [("1", False, 0, None, None)]))).isEmpty()


def test_text_stages_keep_order(spark):
    t = thread(spark).withColumn("tweets", F.transform("tweets", lambda x: x.withField("text", F.concat(F.lit("I'm at http://a.b/c "), x["tweet_id"]))))
    assert [x["text"] for x in context.mask_threads(context.expand_threads(t)).first()["tweets"]] == [f"I am at <url> {i}" for i in "1234"]


def test_thread_files(spark, tmp_path):
    tables.write_threads(thread(spark), str(tmp_path / "t"))
    back = tables.read_threads(spark, str(tmp_path / "t")).first()
    assert back["thread_id"] == "1" and len(back["tweets"]) == 4 and back["terminal"]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{oops\n")
    with pytest.raises(Exception):
        tables.read_threads(spark, str(tmp_path / "bad")).collect()


def test_csv(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n1,a,True,2023-01-15T12:30:00Z,"two\nlines, ""quoted""",2,\n')
    r = clean.clean(tables.read_messages(spark, str(p))).first()
    assert r["text"] == 'two\nlines, "quoted"'
    with pytest.raises(Exception):
        tables.read_messages(spark, str(tmp_path / "none.csv"))
