"""Risk points, the time-decayed score at every event, snapshots and profiles.

Scores are exact: points and rates are whole tenths, times are microseconds, and the sums are
decimals, so no result depends on the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.operators.timeline import HOUR, running
from wardline.session import landed

DAY = V.RISK_LOOKBACK_HOURS * HOUR


def points_tenths(action: Column, severity: Column) -> Column:
    """Points of (action, severity); else of the action's first table row; else none."""
    exact = F.lit(None).cast("int")
    for a, s, p in reversed(V.RISK_POINTS_TENTHS):
        exact = F.when((action == a) & (severity == s), p).otherwise(exact)
    first: dict[str, int] = {}
    for a, _, p in V.RISK_POINTS_TENTHS:
        first.setdefault(a, p)
    fallback = F.lit(0)
    for a, p in first.items():
        fallback = F.when(action == a, p).otherwise(fallback)
    return F.coalesce(exact, fallback).cast("long")


def rate_tenths(severity: Column) -> Column:
    rate = F.lit(V.DECAY_DEFAULT_TENTHS)
    for s, r in V.DECAY_TENTHS.items():
        rate = F.when(severity == s, r).otherwise(rate)
    return rate.cast("long")


def risk_points(events: DataFrame) -> DataFrame:
    """Add ``p10`` (points) and ``r10`` (points lost per hour), both in tenths."""
    action, severity = F.col("action"), F.col("severity")
    return events.withColumns(
        {"p10": points_tenths(action, severity), "r10": rate_tenths(severity)}
    )


def level_of(score_x: Column, unit: int = 1) -> Column:
    """Level of a score given in units of 1/``unit`` points; compare before rounding."""
    out = F.lit("normal")
    for name, threshold in reversed(V.RISK_LEVELS):
        out = F.when(score_x >= threshold * unit, F.lit(name)).otherwise(out)
    return out


def _rounded(n: Column) -> Column:
    """n / (10 h) points, half up to hundredths."""
    x = (n * F.lit(20) + F.lit(HOUR)).cast("decimal(38,0)")
    return F.floor(x / F.lit(2 * HOUR)).cast("double") / F.lit(100.0)


def _score_columns(n: Column) -> dict[str, Column]:
    return {"risk_score": _rounded(n), "risk_level": level_of(n, 10 * HOUR)}


def risk_asof(events: DataFrame, keys: tuple[str, ...] = ("user",)) -> DataFrame:
    """Score and level of the user right after every event.

    An event counts for the age below a day while its decayed points are positive.  So it adds a
    line (value A, slope B) when it happens and takes the same line away when it runs out; the
    score is the running sum of lines, evaluated at the row.  Linear, one pass, and cut into time
    slots by :func:`running`, where the literal reading would be a quadratic range join.
    """
    src = risk_points(events.filter(F.col("user").isNotNull()))
    u = F.lit(HOUR)
    counts = F.col("p10") > 0
    height = (F.col("p10") * u).cast("long")
    life = F.least(F.lit(DAY), F.floor(height / F.col("r10")).cast("long") + 1)
    a = (height + F.col("r10") * F.col("us")).cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(20,0)")
    b = F.col("r10").cast("decimal(20,0)")
    begin = F.struct(
        F.col("us").alias("t"),
        F.lit(1).alias("kind"),
        F.when(counts, a).otherwise(zero).alias("A"),
        F.when(counts, b).otherwise(zero).alias("B"),
    )
    end = F.struct(
        (F.col("us") + life).alias("t"), F.lit(0).alias("kind"), (-a).alias("A"), (-b).alias("B")
    )
    steps = F.when(counts, F.array(begin, end)).otherwise(F.array(begin))
    lines = src.select(*src.columns, F.explode(steps).alias("_x"))
    lines = lines.select(
        *src.columns,
        F.col("_x.t").alias("_t"),
        F.col("_x.kind").alias("_kind"),
        F.col("_x.A").alias("_A"),
        F.col("_x.B").alias("_B"),
    )
    summed = running(
        lines, keys, "_t", ["_t", "_kind", "event_id"], sums={"_SA": F.col("_A"), "_SB": F.col("_B")}
    )
    n = (F.col("_SA").cast("decimal(38,0)") - (F.col("_SB") * F.col("us").cast("decimal(20,0)")).cast("decimal(38,0)"))
    return (
        summed.filter("_kind = 1")
        .withColumn("_n", n)
        .select(*src.columns, *[c.alias(k) for k, c in _score_columns(F.col("_n")).items()])
    )


def _decayed(now: int | Column) -> Column:
    left = F.col("p10") * F.lit(HOUR) - F.col("r10") * ((now if isinstance(now, Column) else F.lit(now)) - F.col("us"))
    return F.greatest(F.lit(0).cast("long"), left).cast("decimal(20,0)")


def risk_snapshot(events: DataFrame, now_us: int) -> DataFrame:
    """Score and level per user at one instant (partial, then final aggregation)."""
    recent = events.filter(
        F.col("user").isNotNull() & (F.col("us") > now_us - DAY) & (F.col("us") <= now_us)
    )
    total = risk_points(recent).groupBy("user").agg(F.sum(_decayed(now_us)).alias("_n"))
    return total.select("user", *[c.alias(k) for k, c in _score_columns(F.col("_n")).items()])


def iso_second(us: Column) -> Column:
    """UTC ISO text cut to the second, whatever the session time zone."""
    sec = F.floor(us / 1_000_000).cast("long")
    day = F.floor(sec / 86400).cast("int")
    rest = sec - day.cast("long") * 86400
    two = lambda x: F.lpad(F.floor(x).cast("int").cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day).cast("string"), F.lit("T"),
        two(rest / 3600), F.lit(":"), two((rest % 3600) / 60), F.lit(":"), two(rest % 60), F.lit("Z"),
    )


def user_profiles(events: DataFrame) -> DataFrame:
    """First and last seen, totals, and the score stored at the user's last event.

    The score at the last event needs no sweep over time: one aggregation finds the last instant, a second
    adds up the points of the day before it, decayed to it."""
    known = events.filter(F.col("user").isNotNull())
    seen = known.groupBy("user").agg(
        F.min("us").alias("_first"),
        F.max("us").alias("_last"),
        F.count("*").alias("total_events"),
        F.count_if(F.col("action").contains("block")).alias("total_blocks"),
        F.count_if(F.col("action").contains("flag")).alias("total_flags"),
    )
    recent = risk_points(known.select("user", "us", "action", "severity")).filter("p10 > 0").join(seen.select("user", "_last"), "user")
    points = recent.filter(F.col("us") > F.col("_last") - DAY).groupBy("user").agg(F.sum(_decayed(F.col("_last"))).alias("_n"))
    scored = seen.join(points, "user", "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("decimal(20,0)")))
    return scored.select(
        "user",
        *[c.alias(k) for k, c in _score_columns(F.col("_n").cast("decimal(38,0)")).items()],
        iso_second(F.col("_first")).alias("first_seen"),
        iso_second(F.col("_last")).alias("last_seen"),
        "total_events", "total_blocks", "total_flags",
    )


def top_risk_users(events: DataFrame, now_us: int, n: int = 10) -> DataFrame:
    """The n users with the highest stored score, reported with their score of now."""
    top = user_profiles(events).orderBy(F.desc("risk_score"), "user").limit(n).drop("risk_score", "risk_level")
    return top.join(risk_snapshot(events, now_us), "user", "left").select(
        "user",
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("risk_level", F.lit("normal")).alias("risk_level"),
        "first_seen", "last_seen", "total_events", "total_blocks", "total_flags",
    )


def currently_quarantined(events: DataFrame, now_us: int) -> DataFrame:
    return risk_snapshot(events, now_us).filter("risk_level = 'critical'")


def with_epoch(events: DataFrame, resets: DataFrame) -> DataFrame:
    """Number the stretches between a user's resets (``epoch``); a reset at the same instant is first."""
    marks = resets.select("user", "us").distinct()
    both = events.withColumn("_kind", F.lit(1)).unionByName(
        marks.withColumn("_kind", F.lit(0)), allowMissingColumns=True
    )
    out = running(
        both, ["user"], "us", ["us", "_kind", "event_id"],
        sums={"epoch": F.when(F.col("_kind") == 0, 1).otherwise(0)},
    )
    return out.filter("_kind = 1").drop("_kind")


def apply_resets(events: DataFrame, resets: DataFrame) -> DataFrame:
    """Events that survive: those after the user's latest reset (a reset deletes what came before)."""
    last = resets.groupBy("user").agg(F.max("us").alias("_reset"))
    return (
        events.join(last, "user", "left")
        .filter(F.col("_reset").isNull() | (F.col("us") >= F.col("_reset")))
        .drop("_reset")
    )


def risk_asof_with_resets(events: DataFrame, resets: DataFrame) -> DataFrame:
    """:func:`risk_asof` where every reset zeroes the user's score."""
    marked = landed(with_epoch(events.filter(F.col("user").isNotNull()), resets), "epochs")
    return risk_asof(marked, ("user", "epoch"))
