import datetime as dt

import pytest
from pyspark.sql import functions as F

from evidra.operators import activity as A
from evidra.operators import claims as C
from evidra.operators import review as R
from evidra.streaming import flows, state

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def feed(spark, tmp_path, batches, schema):
    """One parquet file per batch, read back as a stream one file at a time."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_presence_carries_topic_and_expires(spark, tmp_path):
    schema = "actor long, at timestamp, seq long, doing string, topic string"
    rows = [[(1, at(0), 1, "reading", "x"), (1, at(3), 2, "reading", None), (1, at(60), 3, "typing", None)], [(2, at(5000), 4, "idle", None)], [(2, at(9000), 5, "idle", None)]]
    out = drain(state.presence(feed(spark, tmp_path, rows, schema)), "presence")
    mine = [(r.doing, r.topic, r.online) for r in out if r.actor == 1]
    assert mine == [("reading", "x", True), ("typing", "x", True), ("typing", "x", False)]


def test_quota_counts_admitted_rows_only(spark, tmp_path):
    schema = "actor long, at timestamp, seq long, kind string, item string"
    hours = [0, 1, 2, 3, 24.5, 25, 25.5, 49]
    rows = [[(1, at(int(h * 3600)), i, "submit", "") for i, h in enumerate(hours)],
            [(2, at(0), 100, "lease", "a"), (2, at(1), 101, "lease", "b"), (2, at(2), 102, "lease", "c"), (2, at(3), 103, "lease", "d"), (2, at(4), 104, "release", "a"), (2, at(5), 105, "lease", "d"), (2, at(4000), 106, "lease", "e")]]
    got = {r.seq: r.ok for r in drain(state.quotas(feed(spark, tmp_path, rows, schema), quota=3, watermark="7 days"), "quota")}
    admitted = []
    for i, h in enumerate(hours):
        ok = sum(t > h * 3600 - 86400 for t in admitted) < 3
        assert got[i] == ok
        if ok:
            admitted.append(h * 3600)
    assert [got[k] for k in range(100, 107)] == [True, True, True, False, True, True, True]


def test_unique_requests_match_batch(spark, tmp_path):
    schema = "visitor long, target string, at timestamp, seq long"
    rows = [[(v, str((v * 7 + i) % 6), at(i * 20000), v * 100 + i) for v in range(4) for i in range(k, k + 6)] for k in (0, 6)]
    stream = drain(state.unique_requests(feed(spark, tmp_path, rows, schema), 2, "30 days"), "requests")
    from evidra.operators.metrics import distinct_requests
    batch = distinct_requests(spark.createDataFrame([r for b in rows for r in b], schema), 2)
    counts = {}
    for r in stream:
        counts[r.target] = counts.get(r.target, 0) + 1
    assert counts == {r.target: r.n for r in batch.collect()}


def test_review_grace(spark, tmp_path):
    schema = "claim_id long, at timestamp, kind string"
    rows = [[(1, at(0), "proposed"), (2, at(0), "proposed")], [(2, at(100), "review")], [(3, at(5000), "proposed")], [(4, at(9000), "review")]]
    out = drain(state.review_grace(feed(spark, tmp_path, rows, schema), 600), "grace")
    assert sorted(r.claim_id for r in out) == [1, 3]


def test_intake_load_and_sessions_match_batch(spark, tmp_path):
    schema = "id string, actor long, at timestamp, seq long, error boolean"
    rows = [[(f"s{i % 7}", i % 3, at(i * 37 + b * 1000), b * 100 + i, i % 4 == 0) for i in range(20)] for b in range(3)] + [[("late", 9, at(10 ** 6), 999, False)], [("later", 9, at(2 * 10 ** 6), 1000, False)]]
    flat = spark.createDataFrame([r for b in rows for r in b], schema)
    ids = drain(flows.intake(feed(spark, tmp_path / "a", rows, schema), "id"), "intake")
    assert sorted(r.id for r in ids) == sorted({r[0] for b in rows for r in b})
    load = drain(flows.load(feed(spark, tmp_path / "b", rows, schema), "1 minute", "1 hour"), "load")
    want = {(r.start, r.n, r.errors) for r in A.minute_load(flat).collect() if r.start < at(900000)}
    assert {(r.start, r.n, r.errors) for r in load if r.start < at(900000)} == want
    got = drain(flows.activity_sessions(feed(spark, tmp_path / "c", rows, schema), 300, "1 hour"), "sessions")
    want = {(r.actor, r.start, r.n) for r in A.sessions(flat, 300).collect() if r.start < at(900000)}
    assert {(r.actor, r.start, r.n) for r in got if r.start < at(900000)} == want


def test_folded_verdicts_give_the_batch_status(spark, tmp_path):
    schema = "claim_id long, reviewer string, reviewer_kind string, model_family string, verdict string, seq long"
    verdicts = ["supports", "does_not_support", "out_of_scope", "supports_with_qualification"]
    rows = [[(c, f"r{(c + i + b) % 5}", "human" if (c + i) % 6 == 0 else "agent", f"f{(c * i + b) % 3}", verdicts[(c + i * b) % 4], b * 1000 + i * 10 + c) for c in range(8) for i in range(3)] for b in range(3)]
    path = str(tmp_path / "log")
    q = (flows.latest_verdicts(feed(spark, tmp_path, rows, schema)).writeStream.outputMode("update").foreachBatch(flows.append_batches(path))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    batch = R.review_status(spark.createDataFrame([r for b in rows for r in b], schema))
    assert {(r.claim_id, r.status) for r in flows.current_status(spark, path).collect()} == {(r.claim_id, r.status) for r in batch.collect()}


def test_feed_tail_and_rechecks(spark, tmp_path):
    schema = "seq long, actor long"
    rows = [[(b * 10 + i, i) for i in range(10)] for b in range(3)]
    path = str(tmp_path / "tail")
    q = (feed(spark, tmp_path / "f", rows, schema).writeStream.foreachBatch(flows.keep_feed_tail(path, 12)).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    assert sorted(r.seq for r in spark.read.parquet(f"{path}/upto=2").collect()) == list(range(18, 30))
    schema = "claim_id long, check string, result string, checked date, seq long"
    rows = [[(1, "page", "same", dt.date(2024, 1, 1), 1), (1, "retraction", "current", dt.date(2024, 1, 1), 2)], [(1, "page", "changed", dt.date(2024, 2, 1), 3), (2, "retraction", "retracted", dt.date(2024, 1, 1), 4)]]
    out = drain(flows.latest_rechecks(feed(spark, tmp_path / "r", rows, schema)), "rechecks", "complete")
    want = C.latest_checks(spark.createDataFrame([r for b in rows for r in b], schema)).collect()
    assert {(r.claim_id, r.check, r.result) for r in out} == {(r.claim_id, r.check, r.result) for r in want}


def test_publish_only_touched_shards(spark, tmp_path):
    schema = "id long, v string"
    whole = [(i, "v0") for i in range(300)]
    spark.createDataFrame(whole, schema).createOrReplaceTempView("stream_state")
    from evidra.sources.publish import bundles, write_bundles
    out = str(tmp_path / "pub")
    write_bundles(bundles(spark.table("stream_state"), "c", "id", ["id", "v"]), out)
    spark.createDataFrame([(i, "v1" if i in (5, 6) else "v0") for i in range(300)], schema).createOrReplaceTempView("stream_state")

    def current(touched):
        from evidra.functions.hashing import shard_of
        s = spark.table("stream_state").withColumn("kind", F.lit("c")).withColumn("shard", shard_of("c", F.col("id").cast("string")))
        return s.join(touched, ["kind", "shard"], "left_semi").select("id", "v")
    q = (feed(spark, tmp_path / "t", [[(5, "v1")], [(6, "v1")]], schema).writeStream.foreachBatch(flows.publish_changes(current, "c", "id", ["id", "v"], out))
         .option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start())
    q.awaitTermination(180)
    assert q.exception() is None
    back = spark.read.json(out)
    assert back.count() == 300 and back.where("body LIKE '%v1%'").count() == 2


def test_suppress_repeats(spark):
    rows = [(1, at(0), 1, "a"), (1, at(5), 2, "a"), (1, at(14), 3, "a"), (1, at(30), 4, "b"), (1, at(31), 5, "a"), (1, at(86399), 6, "c"), (1, at(86403), 7, "c")]
    df = spark.createDataFrame([(*r, None) for r in rows], "actor long, at timestamp, seq long, doing string, topic string")
    assert sorted(r.seq for r in A.suppress_repeats(df).collect()) == [1, 3, 4, 5, 6]
    assert A.suppress_repeats(df).columns == df.columns


def steady(topics=lambda i: "x"):
    return [(1, at(86_340 + 5 * i), i, "reading", topics(i)) for i in range(40)]


def test_steady_activity_shows_again(spark, tmp_path):
    """An event every 5 seconds is shown every 10, over midnight too; a changed topic is shown at once, a missing one is the last."""
    schema = "actor long, at timestamp, seq long, doing string, topic string"
    for name, rows, want in (("same", steady(), list(range(0, 40, 2))),
                             ("topic", steady(lambda i: "x" if i < 3 else "y" if i == 3 else None), [0, 2, 3, *range(5, 40, 2)])):
        assert sorted(r.seq for r in A.suppress_repeats(spark.createDataFrame(rows, schema)).collect()) == want
        out = drain(state.presence(feed(spark, tmp_path / name, [rows[:15], rows[15:]], schema), watermark="1 hour"), f"steady_{name}")
        assert sorted(r["at"] for r in out if r.online) == [rows[i][1] for i in want]


def test_refused_today_counted_tomorrow(spark, tmp_path):
    from evidra.operators.metrics import distinct_requests
    schema = "visitor long, target string, at timestamp, seq long"
    rows = [[(1, "a", at(0), 1), (1, "b", at(10), 2)], [(1, "b", at(86_400 + 5), 3), (1, "a", at(86_400 + 6), 4), (1, "c", at(86_400 + 7), 5)]]
    flat = [r for b in rows for r in b]
    assert {r.target: r.n for r in distinct_requests(spark.createDataFrame(flat, schema), 1).collect()} == {"a": 1, "b": 1}
    out = drain(state.unique_requests(feed(spark, tmp_path, rows, schema), 1, "30 days"), "refused")
    assert sorted((r.target, r.seq) for r in out) == [("a", 1), ("b", 3)]
