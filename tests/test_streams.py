"""Streams whose surroundings change: rules, late rows, answers without a request."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardline.operators import gateway, risk, ruletree, searches
from wardline.operators.timeline import MICROS
from wardline.plans import catalog, fixtures
from wardline.session import scratch_dir
from wardline.sources.rules import ReloadedRules
from wardline.streaming import operators as streams

T0 = 1_704_067_200_000_000
MINUTE = 60 * MICROS


def put(spark, folder, name, rows, ddl):
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/{name}")


def rule(name, pattern):
    return {"id": name, "name": name, "pattern": pattern, "detail": "d"}


def test_rules_change_between_batches(spark, tmp_path):
    file = tmp_path / "rules.json"
    rules = ReloadedRules(spark, str(file), "sk-canary")
    with pytest.raises(Exception):
        rules.current()  # nothing to fall back on yet
    stream = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def judge(rows, now):
        return gateway.inspect_ingress(rows, now, mode="reverse").select("id", "decision", "rule")

    def run(name, ids, text):
        put(spark, tmp_path / "in", name, [(i, text) for i in ids], "id long, text string")
        streams.inspect_reloading(stream, rules, judge, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()

    file.write_text(json.dumps([rule("first", "alpha")]))
    run("a", [1, 2], "alpha and beta")
    before = rules.version
    file.write_text(json.dumps([rule("second", "beta"), rule("third", "alpha")]))
    run("b", [3], "alpha and beta")
    after = rules.version
    file.write_text('[{"id": "brok')  # half written: the last good rules stay
    run("c", [4], "only beta")
    got = {r["id"]: (r["rule"], r["rules_version"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: ("first", before), 2: ("first", before), 3: ("second", after), 4: ("second", after)} and before != after


EVENT = "event_id long, user string, us long, action string, rule string"


def test_late_rows_are_counted(spark):
    folder = scratch_dir(spark, "late")
    at = lambda i, minute: (i, "u", T0 + minute * MINUTE, "dlp_block", "r")
    put(spark, folder, "0", [at(i, i) for i in range(20)], EVENT)
    put(spark, folder, "1", [at(100, 60)], EVENT)  # the watermark goes to minute 50
    put(spark, folder, "2", [at(200, 1), at(201, 2), at(202, 3), at(203, 55)], EVENT)  # three are late
    put(spark, folder, "3", [at(300, 120), at(301, 51)], EVENT)
    raw = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    stream = raw.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "10 minutes")
    query = streams.start_available(searches.brute_force(streams.deduplicated(stream)), scratch_dir(spark, "late-out"))
    query.awaitTermination()
    rows = streams.late_rows(spark, query).collect()
    assert sum(r["late"] for r in rows) == 3 and {r["operator"] for r in rows} == {"dedupeWithinWatermark"}


def test_answers_find_who_asked(spark):
    ddl = "flow_id long, user string, us long"
    requests = spark.createDataFrame([(1, "a", T0), (1, "late copy", T0 + 5), (2, "b", T0), (3, "c", T0 + MINUTE), (5, None, T0)], ddl)
    answers = spark.createDataFrame(
        [(1, T0 + MINUTE, "x"), (2, T0 + 11 * MINUTE, "x"), (3, T0, "x"), (4, T0, "x"), (5, T0 + 1, "x"), (1, T0 + 2 * MINUTE, "y")], "flow_id long, us long, user string"
    )
    timed = lambda df: df.withColumn("ts", F.timestamp_micros("us"))
    got = gateway.with_user(timed(answers), timed(requests)).select("flow_id", "us", "user").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, T0 + MINUTE, "a"), (1, T0 + 2 * MINUTE, "a"), (2, T0 + 11 * MINUTE, None), (3, T0, None), (4, T0, None), (5, T0 + 1, None)], key=str
    )
    assert gateway.with_user(timed(answers), timed(requests.limit(0))).where("user is not null").count() == 0


def test_replayed_tables_run_in_several_batches(spark, sf):
    stream = streams.as_stream(spark, catalog.ev240(spark, sf), "several")
    out = scratch_dir(spark, "several-out")
    query = streams.start_available(searches.brute_force(stream), out)
    query.awaitTermination()
    assert len({p.batchId for p in query.recentProgress if p.numInputRows}) >= streams.LEAST_FILES
    assert sum(p.numInputRows for p in query.recentProgress) == fixtures.gateway_events(spark, sf, 240).count()


def test_one_user_of_many_rows(spark):
    """A flood of one user and a quiet one: streams equal the batch operators on all closed rows."""
    rng = np.random.default_rng(4)
    n = 20_000
    us = np.concatenate([np.sort(rng.integers(0, 300 * MINUTE // 1000, n)) * 1000, rng.integers(0, 300 * MINUTE, 200)]) + T0
    frame = pd.DataFrame({
        "event_id": range(len(us)), "user": ["u"] * n + ["quiet"] * 200, "us": us, "action": rng.choice(["dlp_block", "dlp_flagged", "ai_inference"], len(us)),
        "severity": rng.choice(["low", "high", "critical"], len(us)), "rule": "r", "layer": "L2_DLP_Regex", "source": "ai-gateway",
        "prompt_preview": "p", "casb_action": None, "risk_score": "1",
    })
    df = spark.createDataFrame(frame, "event_id long, user string, us long, action string, severity string, rule string, layer string, source string, prompt_preview string, casb_action string, risk_score string")
    closed = int(us.max()) // 1000 * 1000 - 10 * MINUTE
    got = streams.run_available(spark, streams.risk_stream(streams.as_stream(spark, df.drop("risk_score"), "flood-risk")), "flood-risk")
    want = risk.risk_asof(df.drop("risk_score")).where(F.col("us") <= closed).select(*got.columns)
    assert got.count() == want.count() > 15_000 and got.exceptAll(want).isEmpty()
    got = streams.run_available(spark, streams.frequency_rules_stream(streams.as_stream(spark, df, "flood-rules")), "flood-rules")
    want = ruletree.frequency_rules(df).where(F.col("us") <= closed).select(*got.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).isEmpty()


def test_tasks_share_a_micro_batch(spark):
    """Each file of a replayed table is one micro-batch and is read by several tasks; no row is lost or doubled."""
    words = F.concat(*[F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"-{i}")), 256) for i in range(32)])
    df = spark.range(6000).select(F.col("id").alias("us"), words.alias("text"))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "16384")
    seen = []

    def look(rows, number):
        per_task = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.sum("us").alias("us")).collect()
        seen.append([(r["n"], r["us"]) for r in per_task])

    try:
        stream = streams.as_stream(spark, df, "shared")
        stream.writeStream.foreachBatch(look).option("checkpointLocation", scratch_dir(spark, "shared")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert len([b for b in seen if b]) == streams.LEAST_FILES
    assert min(len(b) for b in seen if b) > 1
    assert (sum(n for b in seen for n, _ in b), sum(us for b in seen for _, us in b)) == (6000, 6000 * 5999 // 2)
