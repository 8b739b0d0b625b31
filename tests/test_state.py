"""Sequential operators against plain simulations, streams in several batches, skew and sinks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.operators import replay, respond, risk, ruletree, searches, token_bucket
from wardline.operators.timeline import HOUR, MICROS, running
from wardline.plans import fixtures as X
from wardline.sources import gateway as feed
from wardline.streaming import operators as streams


def simulate_bucket(times):
    tokens, last, out = 60_000_000, times[0], []  # 12,000,000 units are one token
    for t in times:
        tokens, last = min(60_000_000, tokens + t - last), t
        ok = tokens >= 12_000_000
        tokens -= 12_000_000 if ok else 0
        out.append(ok)
    return out


@pytest.mark.parametrize("mean_gap", [200_000, 3_000_000, 11_000_000, 13_000_000, 30_000_000])
def test_token_bucket_equals_simulation(spark, mean_gap):
    rnd = random.Random(mean_gap)
    rows, expected, eid = [], {}, 0
    for user in "abc":
        t, times = 1_704_067_200_000_000, []
        for _ in range(400):
            t += rnd.choice([0, 12_000_000, 60_000_000, int(rnd.expovariate(1 / mean_gap))])
            times.append(t)
        for t, ok in zip(times, simulate_bucket(times)):
            rows.append((user, 0, t, eid))
            expected[eid] = ok
            eid += 1
    df = spark.createDataFrame(rows, "user string, epoch long, us long, event_id long").repartition(5)
    got = {r["event_id"]: r["token"] for r in token_bucket.token_bucket(df).collect()}
    assert got == expected


def test_cell_pieces_agree_with_direct_replay():
    rnd = np.random.default_rng(3)
    for n in (1, 4, 40, 600):
        times = np.sort(rnd.integers(0, token_bucket.CELL, n))
        ends, filled, value = token_bucket.cell_pieces(times, 0)
        for v in rnd.integers(-token_bucket.FULL, 1, 300):
            i = int(np.searchsorted(ends, v))
            got = value[i] if filled[i] else int(v) + value[i]
            assert got == token_bucket.run_cell(times, np.array([v]))[0][0]
        if n == 600:
            assert len(ends) < 60  # busy cells have few pieces


def simulate_gateway(requests):
    """The loop, literally: full event log per user, decayed sums, float-free."""
    users, out = {}, {}
    for q in sorted(requests, key=lambda q: (q["us"], q["event_id"])):
        u = users.setdefault(q["user"], {"log": [], "held": False, "bucket": None, "talk": []})
        now = q["us"]
        n = sum(max(0, p * HOUR - r * (now - t)) for t, p, r in u["log"] if now - t < 24 * HOUR)
        pattern, level = None, n / (10 * HOUR)
        if u["held"] or level >= 50:
            u["held"], d = True, "quarantined"
        else:
            ok = True
            if level >= 26:
                tokens, last = u["bucket"] or (60_000_000, now)
                tokens = min(60_000_000, tokens + now - last)
                ok = tokens >= 12_000_000
                u["bucket"] = (tokens - 12_000_000 if ok else tokens, now)
            if not ok:
                d = "rate_limited"
            else:
                if q["evasion"]:
                    u["log"].append((now, 50, 5))
                    u["talk"].append((now, "evasion_attempt", "high", "Evasion"))
                if q["high_entropy"]:
                    u["log"].append((now, 20, 5))
                if q["rule"]:
                    u["log"].append((now, q["p_rule"], q["r_rule"]))
                    u["talk"].append((now, "dlp_block", q["severity"], q["rule"]))
                    d = "blocked"
                else:
                    u["talk"].append((now, "ai_inference", "none", ""))
                    d = "allowed"
                    pattern = replay.find_pattern([m for m in u["talk"][-20:] if now - m[0] < 900 * MICROS])
                    if pattern:
                        u["log"].append((now, 20, 5))
        out[q["event_id"]] = (d, pattern or "")
    return out


def loop_rows(seed, users=6, n=260, gap=240):
    rnd, rows, t = random.Random(seed), [], 1_704_067_200_000_000
    for i in range(n):
        t += int(rnd.expovariate(1 / gap) * MICROS)
        if rnd.random() < 0.02:
            t += 30 * HOUR
        rule = rnd.choice([None] * 6 + ["A", "B"])
        rows.append({
            "user": f"u{rnd.randrange(users)}", "us": t, "event_id": i, "evasion": rnd.random() < 0.15,
            "high_entropy": rnd.random() < 0.1, "rule": rule, "p_rule": 100 if rule else 0,
            "r_rule": 10 if rule else 3, "severity": "critical" if rule else None,
        })
    return rows


@pytest.mark.parametrize("seed, gap", [(1, 240), (2, 60), (3, 5)])
def test_replay_equals_simulation(spark, seed, gap):
    rows = loop_rows(seed, gap=gap)
    df = spark.createDataFrame(rows, replay.REQUEST_DDL).repartition(3)
    got = {r["event_id"]: (r["decision"], r["pattern"]) for r in replay.replay_gateway(df).collect()}
    assert got == simulate_gateway(rows)
    assert len({d for d, _ in got.values()}) >= 3


def test_replay_stream_in_batches_equals_simulation(spark, tmp_path):
    rows = sorted(loop_rows(7), key=lambda r: r["us"])
    path = str(tmp_path / "in")
    for i in range(0, len(rows), 90):  # one file after another: four micro-batches
        part = rows[i : i + 90]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, replay.REQUEST_DDL).coalesce(1).write.mode("append").parquet(path)
    src = (
        spark.readStream.schema(replay.REQUEST_DDL).option("maxFilesPerTrigger", 1).parquet(path)
        .withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", "10 minutes")
    )
    out = streams.run_available(spark, streams.replay_stream(src), "loop-test")
    got = {r["event_id"]: (r["decision"], r["pattern"]) for r in out.collect()}
    closed = rows[-1]["us"] // 1000 * 1000 - 600 * MICROS
    expected = simulate_gateway(rows)
    assert got == {r["event_id"]: expected[r["event_id"]] for r in rows if r["us"] <= closed}


def test_running_is_exact_across_slots(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randrange(0, 5 * HOUR), i, rnd.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, us long, event_id long, x long")
    for inclusive in (True, False):
        out = running(df, ["k"], "us", ["us", "event_id"], {"s": F.col("x")}, {"m": F.col("x")}, inclusive=inclusive)
        for r in out.collect():
            seen = [x for k, us, i, x in rows if k == r["k"] and ((us, i) < (r["us"], r["event_id"]) or (inclusive and i == r["event_id"]))]
            assert (r["s"], r["m"]) == ((sum(seen), max(seen)) if seen else (None, None))


def test_asof_score_of_a_hot_user_is_spread_over_tasks(spark):
    n = 4000
    df = spark.range(n).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("user"),
        (F.lit(1_704_067_200_000_000) + F.col("id") * 20 * MICROS).alias("us"),
        F.lit("dlp_flagged").alias("action"), F.lit("low").alias("severity"),
    )
    scored = risk.risk_asof(df)
    assert scored.count() == n
    last = scored.filter("user = 'hot'").orderBy(F.desc("us")).first()
    times = [i * 20 * MICROS for i in range(0, n, 3)]
    expected = sum(max(0, 5 * HOUR - (times[-1] - t)) for t in times)
    assert last["risk_score"] == pytest.approx(round(expected / (10 * HOUR), 2), abs=0.01)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "_slot" in plan and "SinglePartition" not in plan


def test_points_fall_back_to_the_first_row_of_the_action(spark):
    df = spark.createDataFrame([("dlp_block", "low"), ("egress_flagged", "critical"), ("ai_inference", "none"), ("dlp_monitor", "low")], "action string, severity string")
    got = {(r["action"], r["severity"]): (r["p10"], r["r10"]) for r in risk.risk_points(df).collect()}
    assert got == {("dlp_block", "low"): (100, 1), ("egress_flagged", "critical"): (30, 10), ("ai_inference", "none"): (0, 3), ("dlp_monitor", "low"): (80, 1)}


def test_four_blocks_raise_brute_force_and_breach(spark):
    t0 = 1_704_067_200_000_000
    rows = [(i, "eve", t0 + i * MICROS, "dlp_block", "critical", "r", f"p{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "event_id long, user string, us long, action string, severity string, rule string, prompt_preview string")
    assert searches.brute_force(df).first()["block_count"] == 4
    r = searches.behavioral_risk(df).orderBy(F.desc("end_us")).first()
    assert (r["risk_status"], r["risk_score"], r["last_prompt"]) == ("CRITICAL_BREACH", 400, "p3")


@pytest.mark.parametrize("counts, status", [((0, 3, 0, 0), "HIGH_BEHAVIORAL_RISK"), ((0, 0, 5, 0), "MEDIUM_BEHAVIORAL_RISK"), ((0, 0, 0, 7), "LOW_BEHAVIORAL_RISK"), ((0, 2, 4, 6), None)])
def test_behavioral_status(spark, counts, status):
    sev = [s for s, n in zip(["critical", "high", "medium", "low"], counts) for _ in range(n)]
    rows = [(i, "u", 1_704_067_200_000_000 + i, "dlp_flagged", s, "r", "p") for i, s in enumerate(sev)]
    df = spark.createDataFrame(rows, "event_id long, user string, us long, action string, severity string, rule string, prompt_preview string")
    got = searches.behavioral_risk(df).orderBy(F.desc("end_us")).limit(1).collect()
    assert [r["risk_status"] for r in got] == ([status] if status else [])


def test_best_match_is_one_of_all_matches(spark, sf):
    e = X.siem_events(spark, sf, 240)
    every = ruletree.match_all(e).select("event_id", "rule_id")
    best = ruletree.match_best(e).select("event_id", "rule_id")
    assert best.join(every, ["event_id", "rule_id"], "left_anti").count() == 0


def test_layer_aliases_widen_rules(spark):
    df = spark.createDataFrame([(1, "u", 1, "dlp_block", "high", "r", "L2_DLP_Regex_Ingress", "ai-gateway", "9")], "event_id long, user string, us long, action string, severity string, rule string, layer string, source string, risk_score string")
    assert ruletree.match_action(df).count() == 0
    assert ruletree.match_action(df, layer_aliases=ruletree.LAYER_ALIASES).first()["rule_id"] == 100116


def test_envelope_source_and_alert_sink(spark, tmp_path):
    src = tmp_path / "feed"
    src.mkdir()
    (src / "a.json").write_text(
        '{"sourcetype": "_json", "index": "gateway", "event": {"event_id": 1, "us": 5, "action": "dlp_block", "user": "u"}}\n'
        '{"sourcetype": "_json", "index": "other", "event": {"event_id": 2, "us": 6}}\n'
    )
    got = feed.read_gateway_events(spark, str(src)).collect()
    assert [(r["event_id"], r["action"]) for r in got] == [(1, "dlp_block")]

    sink = feed.alert_sink(str(tmp_path / "alerts"), "q")
    stream = feed.stream_gateway_events(spark, str(src)).select("event_id", "user")
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    back = lambda: spark.read.json(str(tmp_path / "alerts")).count()
    assert back() == 1
    sink(feed.read_gateway_events(spark, str(src)).select("event_id", "user"), 0)  # a replayed batch
    assert back() == 1

    feed.write_alert_jsonl(feed.read_gateway_events(spark, str(src)), str(tmp_path / "log"))
    feed.write_alert_jsonl(feed.read_gateway_events(spark, str(src)), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_unblock_rearms_the_audit_log(spark):
    ddl = "event_id long, user string, us long, risk_score double, risk_level string"
    t = 1_704_067_200_000_000
    req = [(1, "u", t, 55.0, "critical"), (2, "u", t + 10, 5.0, "normal"), (3, "u", t + 30, 5.0, "normal"), (4, "u", t + 40, 51.0, "critical")]
    d = respond.enforce(spark.createDataFrame(req, ddl), spark.createDataFrame([("u", t + 20)], "user string, us long"))
    assert [r["decision"] for r in d.orderBy("us").collect()] == ["quarantined", "quarantined", "allowed", "quarantined"]
    log = respond.audit_log(d, spark.createDataFrame([("u", t + 20)], "user string, us long"))
    assert [(r["action"], r["us"] - t) for r in log.orderBy("us").collect()] == [("quarantine", 0), ("unblocked", 20), ("quarantine", 40)]


def test_detections_stream_in_small_batches(spark, sf):
    e = X.gateway_events(spark, sf, 240)
    src = streams.as_stream(spark, e, "brute-test")
    got = streams.run_available(spark, searches.brute_force(streams.deduplicated(src)), "brute-test")
    closed = e.agg(F.max("us")).first()[0] // 1000 * 1000 - 600 * MICROS
    batch = searches.brute_force(e).filter(F.col("end_us") <= closed)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_vocabulary_is_consistent():
    assert len(V.DLP_RULES) == 12 and len(V.TECHNIQUES) == 17 and len(V.ACTION_RULES) == 11
    assert len(V.CONFUSABLE_FROM) == len(set(V.CONFUSABLE_FROM)) == len(V.CONFUSABLE_TO)
