from datetime import datetime, timedelta

from parley.streaming import live

T0 = datetime(2024, 1, 1)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).parquet(str(path))


def drain(stream, name, mode="append"):
    # A timeout by processing time would go on with empty batches.
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_deduplicate(spark, tmp_path):
    s = feed(spark, tmp_path / "m", [("1", T0), ("1", T0 + timedelta(minutes=1)), ("2", T0)], "tweet_id string, created_at timestamp")
    assert sorted(r["tweet_id"] for r in drain(live.deduplicate(s), "dedup")) == ["1", "2"]


def test_dialog_state(spark, tmp_path):
    s = feed(spark, tmp_path / "t", [("a", 1, "battery"), ("a", 2, "refund"), ("b", 1, "refund")], "thread_id string, turn int, text string")
    assert {(r["thread_id"], r["turn"]): r["passed"] for r in drain(live.dialog(s), "dialog")} == {("a", 1): True, ("a", 2): False, ("b", 1): True}


def test_round_robin_state(spark, tmp_path):
    s = feed(spark, tmp_path / "k", [(i, "p") for i in range(4)], "ticket_id long, pool string")
    assert [r["agent"] for r in sorted(drain(live.round_robin(s, {"p": ["a", "b", "c"]}), "robin"))] == ["b", "c", "a", "b"]


def test_locks(spark, tmp_path):
    rows = [("t", "x", T0), ("t", "y", T0 + timedelta(minutes=5)), ("t", "y", T0 + timedelta(minutes=30))]
    s = feed(spark, tmp_path / "l", rows, "thread_id string, owner string, at timestamp")
    assert [r["granted"] for r in sorted(drain(live.draft_locks(s), "locks"), key=lambda r: r["at"])] == [True, False, True]


def test_review_windows(spark, tmp_path):
    rows = [("u", 4.0, 60, 0.0, True, "low", T0), ("u", 4.0, 60, 0.0, True, "low", T0 + timedelta(days=3))]
    s = feed(spark, tmp_path / "r", rows, "escalation_tier string, reviewer_minutes double, sla_target_minutes int, actual_response_delay_minutes double, error_caught boolean, error_severity string, timestamp timestamp")
    got = drain(live.review_windows(s), "reviews", "update")
    assert len(got) == 2 and all(r["total_cost"] == 3.0 for r in got)
