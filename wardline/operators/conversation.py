"""Multi-turn attack patterns over each user's recent messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.operators.timeline import MICROS, with_lookback

LOOKBACK = V.HISTORY_SECONDS * MICROS


def _rank(c: Column, table: dict[str, int]) -> Column:
    out = F.lit(0)
    for k, n in table.items():
        out = F.when(c == k, n).otherwise(out)
    return out


def history(events: DataFrame, with_prompt: bool = False) -> DataFrame:
    """Add ``recent``: the user's last 20 messages younger than 15 minutes, oldest first.

    Empty when fewer than three remain.  Only a quarter of an hour of earlier rows matters, so
    the window runs per (user, hour) over rows plus that look-back, never over a whole user.
    """
    entry = [
        F.col("us"), F.col("event_id"), F.col("action"), F.col("severity"), F.col("rule"),
        _rank(F.col("severity"), V.SEVERITY_RANK).alias("s"),
        _rank(F.col("action"), V.ACTION_RANK).alias("a"),
    ]
    if with_prompt:
        entry.append(F.substring("prompt_preview", 1, V.HISTORY_PREVIEW).alias("prompt"))
    src = with_lookback(events.filter(F.col("user").isNotNull()), "us", LOOKBACK)
    w = (
        Window.partitionBy("user", "_slot")
        .orderBy("us", "event_id")
        .rowsBetween(-(V.HISTORY_MESSAGES - 1), 0)
    )
    seen = src.withColumn("_all", F.collect_list(F.struct(*entry)).over(w)).filter("_home")
    now = F.col("us")
    young = F.filter(F.col("_all"), lambda h: now - h["us"] < LOOKBACK)
    out = seen.withColumn("recent", young)
    keep = F.when(F.size("recent") >= 3, F.col("recent")).otherwise(F.slice("recent", 1, 0))
    return out.select(*events.columns, keep.alias("recent"))


def escalation_steps(h: Column) -> Column:
    """Neighbouring messages where the severity or the action grows worse."""
    n = F.greatest(F.size(h) - 1, F.lit(0))
    rises = F.zip_with(
        F.slice(h, 1, n),
        F.slice(h, 2, n),
        lambda x, y: (y["s"] > x["s"]) | (y["a"] > x["a"]),
    )
    return F.size(F.filter(rises, lambda up: up))


_HOSTILE = ("dlp_flagged", "dlp_block", "egress_block")


def pivot_counts(h: Column) -> Column:
    """struct(benign, hostile): the leading benign messages and the hostile run after them."""
    start = F.struct(
        F.lit(0).alias("benign"), F.lit(0).alias("hostile"), F.lit(False).alias("over")
    )

    def step(acc: Column, m: Column) -> Column:
        calm, bad = m["action"] == "ai_inference", m["action"].isin(*_HOSTILE)
        back = calm & (acc["hostile"] > 0)
        going = ~acc["over"] & ~back
        one = F.lit(1)
        return F.struct(
            F.when(going & calm, acc["benign"] + one).otherwise(acc["benign"]).alias("benign"),
            F.when(going & bad, acc["hostile"] + one).otherwise(acc["hostile"]).alias("hostile"),
            (acc["over"] | back).alias("over"),
        )

    return F.aggregate(h, start, step)


def persistent_rule(h: Column) -> Column:
    """struct(rule, n): the first rule, by first appearance, hit at least three times."""
    hits = F.transform(
        F.filter(h, lambda m: m["action"].isin("dlp_block", "dlp_flagged")),
        lambda m: F.coalesce(m["rule"], F.lit("unknown")),
    )
    counted = F.transform(
        F.array_distinct(hits),
        lambda r: F.struct(r.alias("rule"), F.size(F.filter(hits, lambda x: x == r)).alias("n")),
    )
    return F.get(F.filter(counted, lambda x: x["n"] >= 3), F.lit(0))


def pattern_column(h: Column, user: Column) -> Column:
    """struct(pattern, description, count, mitre_attack, mitre_atlas) or NULL; first kind wins."""
    steps, pivot, stuck = escalation_steps(h), pivot_counts(h), persistent_rule(h)
    who = F.concat(F.lit("User '"), user, F.lit("' "))

    def pack(kind: str, text: Column, n: Column) -> Column:
        attack, atlas = V.PATTERN_TAGS[kind]
        return F.struct(
            F.lit(kind).alias("pattern"),
            F.concat(who, text).alias("description"),
            n.cast("int").alias("count"),
            F.lit(attack).alias("mitre_attack"),
            F.lit(atlas).alias("mitre_atlas"),
        )

    s = lambda c: c.cast("string")
    return F.when(
        F.size(h) >= 3,
        F.when(
            steps >= 3,
            pack(
                "intent_escalation",
                F.concat(F.lit("showed escalating threat severity across "), s(F.size(h)), F.lit(" recent messages")),
                steps,
            ),
        )
        .when(
            (pivot["benign"] >= 2) & (pivot["hostile"] >= 2),
            pack(
                "topic_pivot",
                F.concat(F.lit("pivoted from "), s(pivot["benign"]), F.lit(" benign to "), s(pivot["hostile"]), F.lit(" hostile prompts")),
                pivot["hostile"],
            ),
        )
        .when(
            stuck.isNotNull(),
            pack(
                "persistence",
                F.concat(F.lit("triggered '"), stuck["rule"], F.lit("' "), s(stuck["n"]), F.lit(" times in recent history")),
                stuck["n"],
            ),
        ),
    )


def detect_patterns(events: DataFrame, at_action: str | None = "ai_inference") -> DataFrame:
    """Patterns found right after an allowed message (a blocked one ends the request earlier)."""
    h = history(events)
    if at_action:
        h = h.filter(F.col("action") == at_action)
    found = h.withColumn("_p", pattern_column(F.col("recent"), F.col("user"))).filter("_p is not null")
    return found.select("event_id", "user", "us", "_p.*")


def pattern_events(patterns: DataFrame) -> DataFrame:
    """The ``multi_turn_pattern`` telemetry event and the risk event each pattern brings."""
    kinds = F.explode(F.array(F.lit("multi_turn_pattern"), F.lit("dlp_flagged"))).alias("action")
    return patterns.select(
        "event_id", "user", "us", kinds,
        F.lit("high").alias("severity"),
        F.concat(F.lit("Multi-Turn: "), F.col("pattern")).alias("rule"),
        F.lit("Conv_Tracker").alias("layer"),
        F.col("pattern").alias("pattern_type"),
        F.col("description").alias("pattern_description"),
        "mitre_attack", "mitre_atlas",
    )


def user_history(events: DataFrame, user: str, n: int = V.HISTORY_MESSAGES) -> DataFrame:
    """The last n messages of one user, newest first (top-n, no full sort)."""
    return (
        events.filter(F.col("user") == user)
        .select("event_id", "us", F.substring("prompt_preview", 1, V.HISTORY_PREVIEW).alias("prompt"),
                "action", "severity", "rule", "layer")
        .orderBy(F.desc("us"), F.desc("event_id"))
        .limit(n)
    )


def active_users(events: DataFrame, n: int = V.HISTORY_USERS) -> DataFrame:
    """The n most recently active users."""
    return (
        events.filter(F.col("user").isNotNull())
        .groupBy("user")
        .agg(F.max("us").alias("last_us"))
        .orderBy(F.desc("last_us"), "user")
        .limit(n)
    )
