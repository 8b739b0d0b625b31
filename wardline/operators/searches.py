"""Windowed searches over the event index, alert muting and the dashboard panels."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.operators.timeline import HOUR, MICROS, running, with_lookback

TICK = "5 minutes"


def _windowed(events: DataFrame, length: str, slide: str | None, aggs: list[Column]) -> DataFrame:
    """Aggregate per user and window [start, end); partial sums run before the shuffle."""
    src = events.filter(F.col("user").isNotNull())
    if "ts" not in src.columns:
        src = src.withColumn("ts", F.timestamp_micros("us"))
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    return src.groupBy(win.alias("w"), "user").agg(*aggs)


def _flat(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(
        F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "user", *cols
    )


def _rules() -> Column:
    """Distinct rule names; bounded by the rules table, so the set stays small in any group."""
    return F.array_join(F.sort_array(F.collect_set("rule")), "|").alias("rules")


def brute_force(events: DataFrame) -> DataFrame:
    """Every 5 minutes, over the last 5: users with at least 3 blocked prompts."""
    hit = events.filter("action = 'dlp_block'")
    g = _windowed(hit, TICK, None, [F.count("*").alias("block_count"), _rules()])
    return _flat(g.filter("block_count >= 3"), "block_count", "rules")


def probe_strike(events: DataFrame) -> DataFrame:
    """Every 5 minutes, over the last 10: at least 1 blocked and 2 flagged prompts."""
    hit = events.filter(F.col("action").isin("dlp_block", "dlp_flagged"))
    g = _windowed(
        hit, "10 minutes", TICK,
        [
            F.count_if(F.col("action") == "dlp_block").alias("blocks"),
            F.count_if(F.col("action") == "dlp_flagged").alias("flags"),
            _rules(),
        ],
    )
    return _flat(g.filter("blocks >= 1 and flags >= 2"), "blocks", "flags", "rules")


def slow_exfil(events: DataFrame, require_no_blocks: bool = False) -> DataFrame:
    """Every 5 minutes, over the last 15: at least 5 flagged prompts."""
    hit = events.filter(F.col("action").isin("dlp_block", "dlp_flagged")) if require_no_blocks else events.filter(
        "action = 'dlp_flagged'"
    )
    flagged = F.col("action") == "dlp_flagged"
    g = _windowed(
        hit, "15 minutes", TICK,
        [
            F.count_if(flagged).alias("flag_count"),
            F.count_if(~flagged).alias("_blocks"),
            F.array_join(F.sort_array(F.collect_set(F.when(flagged, F.col("rule")))), "|").alias("rules"),
        ],
    )
    return _flat(g.filter("flag_count >= 5 and _blocks = 0"), "flag_count", "rules")


_SPANS = {
    "brute_force": (TICK, None, ("dlp_block",)),
    "probe_strike": ("10 minutes", TICK, ("dlp_block", "dlp_flagged")),
    "slow_exfil": ("15 minutes", TICK, ("dlp_flagged",)),
}


def alert_prompts(events: DataFrame, alerts: DataFrame, search: str) -> DataFrame:
    """Distinct prompts behind each alert of a search, one row each.

    Kept as rows, not as an array in the alert: a flood of prompts in one window then spreads
    over tasks instead of filling one aggregation buffer.
    """
    length, slide, actions = _SPANS[search]
    src = events.filter(F.col("user").isNotNull() & F.col("action").isin(*actions)).withColumn(
        "ts", F.timestamp_micros("us")
    )
    win = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = src.select("user", "prompt_preview", win.alias("w")).select(
        "user", "prompt_preview", F.unix_micros("w.start").alias("start_us")
    )
    return rows.join(alerts.select("user", "start_us"), ["user", "start_us"], "left_semi").distinct()


def _let_through(batches: Iterator[pd.DataFrame], period: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by user, island and time: keep those a period or more after the last one kept."""
    key, last = None, None
    for pdf in batches:
        keep = []
        for user, island, t in zip(pdf["user"], pdf["island"], pdf["t"]):
            if (user, island) != key:
                key, last = (user, island), None
            fires = last is None or t - last >= period
            last = t if fires else last
            keep.append(fires)
        yield pdf.loc[keep, ["user", "t"]]


def suppress(alerts: DataFrame, minutes: int, us: str = "end_us") -> DataFrame:
    """Drop alerts of a user that fall within ``minutes`` of the last one let through.

    An alert that comes ``minutes`` or more after the one before it always passes, so a user's alerts
    fall into islands that are judged apart: each is walked once, in order, holding one instant.
    """
    period = minutes * 60 * MICROS
    times = alerts.select("user", F.col(us).alias("t")).distinct()
    at = with_lookback(times, "t", min(period, HOUR), HOUR) if period <= HOUR else None
    if at is None:
        w = Window.partitionBy("user").orderBy("t")
        marked = times.withColumn("_prev", F.lag("t").over(w))
    else:
        w = Window.partitionBy("user", "_slot").orderBy("t")
        marked = at.withColumn("_prev", F.lag("t").over(w)).filter("_home").drop("_slot", "_home")
    opens = F.col("_prev").isNull() | (F.col("t") - F.col("_prev") >= period)
    islands = running(marked, ["user"], "t", ["t"], maxes={"island": F.when(opens, F.col("t"))}).select("user", "island", "t")
    kept = (
        islands.repartition("user", "island").sortWithinPartitions("user", "island", "t")
        .mapInPandas(lambda batches: _let_through(batches, period), islands.select("user", "t").schema)
        .withColumnRenamed("t", us)
    )
    return alerts.join(kept, ["user", us], "left_semi")


_BEHAVIOR_COUNTS = {
    s: f"{s[:4] if s == 'critical' else s[:3] if s == 'medium' else s}_count" for s in V.BEHAVIOR_WEIGHTS
}


def _with_status(g: DataFrame) -> DataFrame:
    score = sum((F.col(_BEHAVIOR_COUNTS[s]) * w for s, w in V.BEHAVIOR_WEIGHTS.items()), F.lit(0))
    status = F.lit("NOMINAL")
    for severity, least, name in reversed(V.BEHAVIOR_STATUS):
        status = F.when(F.col(_BEHAVIOR_COUNTS[severity]) >= least, name).otherwise(status)
    return g.withColumns({"risk_score": score, "risk_status": status}).filter("risk_status <> 'NOMINAL'")


def _rolled(batches: Iterator[pd.DataFrame], span: int) -> Iterator[pd.DataFrame]:
    """Instants sorted by user, slot and time: counts and rules of the last ``span``.  Every instant enters once and
    leaves once; what is held are the instants of one span."""
    names = list(_BEHAVIOR_COUNTS.values())
    key, held, totals, latest, rules = None, deque(), [0] * len(names), {}, ""
    for pdf in batches:
        out = []
        for user, slot, t, home, prompt, now, *counts in zip(*(pdf[c] for c in ("user", "_slot", "us", "_home", "last_prompt", "_rules", *names))):
            if (user, slot) != key:
                key, held, totals, latest, rules = (user, slot), deque(), [0] * len(names), {}, ""
            changed = False
            while held and held[0][0] <= t - span:
                gone, its_rules, its_counts = held.popleft()
                totals = [a - b for a, b in zip(totals, its_counts)]
                for r in its_rules:
                    if latest[r] == gone:
                        del latest[r]
                        changed = True
            held.append((t, now, counts))
            totals = [a + b for a, b in zip(totals, counts)]
            for r in now:
                changed |= r not in latest
                latest[r] = t
            if changed:
                rules = "|".join(sorted(latest))
            if home:
                out.append((user, t, prompt, rules, *totals))
        yield pd.DataFrame(out, columns=["user", "us", "last_prompt", "triggered_rules", *names])


def behavioral_risk(events: DataFrame, seconds: int = 120) -> DataFrame:
    """Weighted severity counts of the ``seconds`` up to and including each event of a user; the first
    threshold met names the status.

    The window rolls with the events, so a burst is seen wherever it lies.  A user's time is cut into slots
    plus the look-back, which spreads a flood over tasks; each slot is walked once.  Equal instants count
    together and give one row.
    """
    span = seconds * MICROS
    src = events.filter(F.col("user").isNotNull() & F.col("action").isin(*V.BEHAVIOR_ACTIONS))
    # One row per instant, counted before the shuffle.
    instants = src.groupBy("user", "us").agg(
        *[F.count_if(F.col("severity") == s).alias(n) for s, n in _BEHAVIOR_COUNTS.items()],
        F.max(F.struct("event_id", "prompt_preview"))["prompt_preview"].alias("last_prompt"),
        F.collect_set("rule").alias("_rules"),
    )
    cut = with_lookback(instants, "us", span, max(HOUR // 12, span))
    counts = ", ".join(f"{n} bigint" for n in _BEHAVIOR_COUNTS.values())
    rolled = (
        cut.repartition("user", "_slot").sortWithinPartitions("user", "_slot", "us")
        .mapInPandas(lambda batches: _rolled(batches, span), f"user string, us bigint, last_prompt string, triggered_rules string, {counts}")
    )
    return _with_status(rolled).select(
        (F.col("us") - span + 1).alias("start_us"), F.col("us").alias("end_us"), "user",
        "risk_status", "risk_score", *_BEHAVIOR_COUNTS.values(), "triggered_rules", "last_prompt",
    )


def behavioral_risk_windows(events: DataFrame, window: str = "2 minutes", slide: str | None = None) -> DataFrame:
    """The same over fixed (or, with ``slide``, overlapping) windows; works on streams too."""
    src = events.filter(F.col("action").isin(*V.BEHAVIOR_ACTIONS))
    g = _windowed(
        src, window, slide,
        [F.count_if(F.col("severity") == s).alias(n) for s, n in _BEHAVIOR_COUNTS.items()]
        + [
            F.max_by("prompt_preview", F.struct("us", "event_id")).alias("last_prompt"),
            F.array_join(F.sort_array(F.collect_set("rule")), "|").alias("triggered_rules"),
        ],
    )
    return _flat(_with_status(g), "risk_status", "risk_score", *_BEHAVIOR_COUNTS.values(), "triggered_rules", "last_prompt")


def _last_day(events: DataFrame, now_us: int, hours: int = 24) -> DataFrame:
    return events.filter((F.col("us") >= now_us - hours * 3600 * MICROS) & (F.col("us") < now_us))


def flagged_count(events: DataFrame, now_us: int) -> DataFrame:
    return _last_day(events, now_us).filter("action = 'dlp_flagged'").agg(F.count("*").alias("n"))


def allowed_count(events: DataFrame, now_us: int) -> DataFrame:
    return _last_day(events, now_us).filter("action = 'ai_inference'").agg(F.count("*").alias("n"))


def latest_alerts(events: DataFrame, now_us: int, n: int = 20, hours: int = 24) -> DataFrame:
    """Newest blocked or flagged prompts: one page (top-n, no full sort)."""
    return (
        _last_day(events, now_us, hours)
        .filter(F.col("action").isin("dlp_block", "dlp_flagged"))
        .select("us", "event_id", "user", "action", "rule", "severity", "prompt_preview")
        .orderBy(F.desc("us"), F.desc("event_id"))
        .limit(n)
    )


def allowed_trend(events: DataFrame, bucket_minutes: int = 60) -> DataFrame:
    """Allowed prompts per bucket and the change against the bucket before (none counts as zero)."""
    size = bucket_minutes * 60 * MICROS
    start = (F.floor(F.col("us") / size) * size).cast("long")
    n = events.filter("action = 'ai_inference'").groupBy(start.alias("start_us")).agg(F.count("*").alias("n"))
    before = n.select((F.col("start_us") + size).alias("start_us"), F.col("n").alias("prev"))
    return n.join(before, "start_us", "left").select(
        "start_us", "n", (F.col("n") - F.coalesce("prev", F.lit(0))).alias("delta")
    )


def block_redact_log(events: DataFrame) -> DataFrame:
    """Blocks and redactions, newest first."""
    return (
        events.filter(F.col("action").isin("dlp_block", "dlp_redact"))
        .select("us", "event_id", "user", "action", "rule", "severity", "prompt_preview")
        .orderBy(F.desc("us"), F.desc("event_id"))
    )
