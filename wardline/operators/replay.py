"""Replaying the closed loop: gate by score, inspect what passes, score what was found.

Inspection does not depend on the gate, so it is done first, in bulk.  What is left is a fold per
user over a few numbers per request.  Batch form: each user's time line is cut wherever nothing
of the past can matter (no risk for a day, no message for a quarter of an hour); pieces are
folded independently, in streaming order, without loading a piece into memory; the one thing that
does outlive a cut -- quarantine -- is carried over afterwards by a running maximum.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.operators.risk import DAY, level_of, points_tenths, rate_tenths
from wardline.operators.timeline import HOUR, MICROS, running, with_lookback
from wardline.operators.token_bucket import FULL, PAUSE
from wardline.session import landed

LOOKBACK = V.HISTORY_SECONDS * MICROS

#: What the fold needs of an inspected request.
REQUEST_DDL = (
    "user string, us long, event_id long, evasion boolean, high_entropy boolean, rule string, "
    "p_rule long, r_rule long, severity string"
)

_HIGH_RATE = V.DECAY_TENTHS["high"]
_POINTS = {(a, s): p for a, s, p in V.RISK_POINTS_TENTHS}
_P_EVASION, _P_FLAG = _POINTS["evasion_attempt", "high"], _POINTS["dlp_flagged", "high"]


def as_requests(inspected: DataFrame) -> DataFrame:
    """Inspected prompts (forward mode) with ``event_id, user, us`` to the fold's input."""
    block = F.get(F.filter("events", lambda e: e["action"] == "dlp_block"), F.lit(0))
    sev = block["severity"]
    p = F.when(sev.isNotNull(), points_tenths(F.lit("dlp_block"), sev)).otherwise(0)
    return inspected.select(
        "user", "us", "event_id",
        F.exists("events", lambda e: e["action"] == "evasion_attempt").alias("evasion"),
        "high_entropy",
        block["rule"].alias("rule"),
        p.cast("long").alias("p_rule"),
        rate_tenths(F.coalesce(sev, F.lit("none"))).alias("r_rule"),
        sev.alias("severity"),
    )


def new_risk() -> dict:
    """Points of the last day: a heap of (end, height, rate) lines and the sums over it."""
    return {"ends": [], "height": 0, "rate": 0}


def new_state() -> dict:
    return {"live": new_risk(), "v": None, "held": False, "recent": []}


def add_points(live: dict, t: int, p: int, r: int) -> None:
    """From ``t`` on a line ``p * HOUR - r * (now - t)`` counts, until it runs out or is a day old."""
    end = t + DAY if r <= 0 else min(t + DAY, t - (-p * HOUR // r))
    height = p * HOUR + r * t
    heapq.heappush(live["ends"], [end, height, r])
    live["height"] += height
    live["rate"] += r


def score(live: dict, now: int) -> int:
    """Sum of decayed points in tenths times hours-in-microseconds; drops what ran out.

    Each line enters and leaves the sums once, so a run over n events takes n log n steps."""
    while live["ends"] and live["ends"][0][0] <= now:
        _, height, r = heapq.heappop(live["ends"])
        live["height"] -= height
        live["rate"] -= r
    return live["height"] - live["rate"] * now


def take_token(state: dict, now: int) -> bool:
    v = now - FULL if state["v"] is None else max(state["v"], now - FULL)
    ok = now - v >= PAUSE
    state["v"] = v + PAUSE if ok else v
    return ok


def find_pattern(recent: list) -> str | None:
    """Name of the multi-turn pattern in (us, action, severity, rule) records, if any."""
    if len(recent) < 3:
        return None
    ranks = [(V.SEVERITY_RANK.get(r[2], 0), V.ACTION_RANK.get(r[1], 0)) for r in recent]
    rises = sum(b[0] > a[0] or b[1] > a[1] for a, b in zip(ranks, ranks[1:]))
    if rises >= 3:
        return "intent_escalation"
    marks = "".join("b" if r[1] == "ai_inference" else "h" for r in recent if r[1] in V.ACTION_RANK)
    calm = len(marks) - len(marks.lstrip("b"))
    hostile = len(marks[calm:]) - len(marks[calm:].lstrip("h"))
    if calm >= 2 and hostile >= 2:
        return "topic_pivot"
    rules = [r[3] for r in recent if r[1] in ("dlp_block", "dlp_flagged")]
    return "persistence" if any(rules.count(x) >= 3 for x in rules) else None


def step(state: dict, us: int, evasion: bool, entropy: bool, rule, p_rule: int, r_rule: int, severity):
    """One request: (decision, score before it, pattern).  Gated requests add nothing."""
    n = score(state["live"], us)
    unit = 10 * HOUR
    if state["held"] or n >= V.RISK_LEVELS[0][1] * unit:
        state["held"] = True
        return "quarantined", n, None
    if n >= V.RISK_LEVELS[1][1] * unit and not take_token(state, us):
        return "rate_limited", n, None
    notes = []
    if evasion:
        add_points(state["live"], us, _P_EVASION, _HIGH_RATE)
        notes.append((us, "evasion_attempt", "high", "Evasion"))
    if entropy:
        add_points(state["live"], us, _P_FLAG, _HIGH_RATE)
    blocked = rule is not None
    if blocked:
        add_points(state["live"], us, p_rule, r_rule)
        notes.append((us, "dlp_block", severity, rule))
    else:
        notes.append((us, "ai_inference", "none", ""))
    state["recent"] = (state["recent"] + notes)[-V.HISTORY_MESSAGES:]
    pattern = None
    if not blocked:
        pattern = find_pattern([r for r in state["recent"] if us - r[0] < LOOKBACK])
        if pattern:
            add_points(state["live"], us, _P_FLAG, _HIGH_RATE)
    return ("blocked" if blocked else "allowed"), n, pattern


_FOLD_COLS = ["event_id", "us", "evasion", "high_entropy", "rule", "p_rule", "r_rule", "severity"]


def fold_rows(state: dict, pdf: pd.DataFrame) -> list[tuple]:
    """Fold time-ordered rows of one user; (event_id, decision, score, pattern) per row."""
    out = []
    for eid, us, ev, en, rule, p, r, sev in pdf[_FOLD_COLS].itertuples(index=False):
        rule = rule if isinstance(rule, str) else None
        out.append((eid, *step(state, int(us), bool(ev), bool(en), rule, int(p), int(r), sev)))
    return out


def _fold_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows arrive sorted by piece and time; the state of the current piece is all that is kept."""
    current, state = None, None
    for pdf in batches:
        out = []
        for user, piece, eid, us, ev, en, rule, p, r, sev in pdf[["user", "piece", *_FOLD_COLS]].itertuples(index=False):
            if (user, piece) != current:
                current, state = (user, piece), new_state()
            rule = rule if isinstance(rule, str) else None
            decision, n, pattern = step(state, int(us), bool(ev), bool(en), rule, int(p), int(r), sev)
            out.append((eid, user, us, piece, decision, str(n), pattern))
        yield pd.DataFrame(out, columns=["event_id", "user", "us", "piece", "decision", "n", "pattern"])


def cut_pieces(requests: DataFrame) -> DataFrame:
    """Add ``piece``: starts where no earlier message is younger than 15 minutes and no earlier
    risk younger than a day."""
    risky = F.col("evasion") | F.col("high_entropy") | F.col("rule").isNotNull()
    w = Window.partitionBy("user", "_slot").orderBy("us", "event_id")
    src = with_lookback(requests, "us", LOOKBACK)
    src = src.withColumn("_prev", F.lag("us").over(w)).filter("_home").drop("_slot", "_home")
    order = ["us", "event_id"]
    seen = running(
        src, ["user"], "us", order, maxes={"_risk": F.when(risky, F.col("us"))}, inclusive=False
    )
    quiet = F.col("_prev").isNull() | (F.col("us") - F.col("_prev") >= LOOKBACK)
    clean = F.col("_risk").isNull() | (F.col("us") - F.col("_risk") >= DAY)
    opened = running(
        seen, ["user"], "us", order, maxes={"piece": F.when(quiet & clean, F.col("us"))}
    )
    return opened.drop("_prev", "_risk")


def _finish(df: DataFrame) -> DataFrame:
    n = F.col("n").cast("decimal(38,0)")
    hundredths = F.floor((n * 20 + HOUR).cast("decimal(38,0)") / F.lit(2 * HOUR))
    return df.select(
        "event_id", "user", "us", "decision",
        (hundredths.cast("double") / 100.0).alias("risk_score"),
        level_of(n, 10 * HOUR).alias("risk_level"),
        F.coalesce("pattern", F.lit("")).alias("pattern"),
    )


def replay_gateway(requests: DataFrame) -> DataFrame:
    """Decision, score before the request and pattern for every request (:data:`REQUEST_DDL`)."""
    # Inspection is the dear part: its verdicts, a few numbers per request, are landed once.
    rows = landed(requests.filter(F.col("user").isNotNull()), "verdicts")
    pieces = cut_pieces(rows)
    folded = landed(
        pieces.repartition("user", "piece")
        .sortWithinPartitions("user", "piece", "us", "event_id")
        .mapInPandas(
            _fold_partition,
            "event_id long, user string, us long, piece long, decision string, n string, pattern string",
        ),
        "outcomes",
    )
    # Quarantine outlives a cut: every request of later pieces is refused and adds nothing.
    first = folded.filter("decision = 'quarantined'").groupBy("user").agg(F.min("piece").alias("_held"))
    out = folded.join(first, "user", "left")
    later = F.col("_held").isNotNull() & (F.col("piece") > F.col("_held"))
    return _finish(
        out.withColumns(
            {
                "decision": F.when(later, "quarantined").otherwise(F.col("decision")),
                "n": F.when(later, "0").otherwise(F.col("n")),
                "pattern": F.when(~later, F.col("pattern")),
            }
        )
    )
