"""Streaming twins of the batch operators."""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
from collections import Counter
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline import vocab as V
from wardline.operators import conversation, replay, risk, ruletree, searches
from wardline.operators.timeline import HOUR, MICROS
from wardline.session import landed, scratch_dir
from wardline.sources.gateway import SOURCE
from wardline.sources.rules import ReloadedRules
from wardline.streaming.ordered import Fold, ordered

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def deduplicated(stream: DataFrame) -> DataFrame:
    """Drop re-sent events within the watermark."""
    return stream.dropDuplicatesWithinWatermark(["event_id"])


def detections_stream(stream: DataFrame) -> dict[str, DataFrame]:
    """The scheduled searches as continuous append-mode queries."""
    return {
        "brute_force": searches.brute_force(stream),
        "probe_strike": searches.probe_strike(stream),
        "slow_exfil": searches.slow_exfil(stream),
        "behavioral_risk": searches.behavioral_risk_windows(stream),
    }


# ------------------------------------------------------------------ risk

def _risk_start() -> dict:
    """No lines that count, none to run out."""
    return replay.new_risk()


def _risk_fold(live: dict, rows: pd.DataFrame) -> list[tuple]:
    """(event_id, us, score) at every row; ``live`` takes in the lines of the rows and loses what ran out."""
    out = []
    for eid, us, p, r in zip(*(rows[c].tolist() for c in ("event_id", "us", "p10", "r10"))):
        replay.score(live, us)
        if p > 0:
            replay.add_points(live, us, p, r)
        out.append((eid, us, str(replay.score(live, us))))
    return out


class _RiskFold(Fold):
    """The sums over the lines that count now; a line itself waits as a row until it runs out."""

    state_ddl = "height:decimal(38,0),rate:decimal(38,0)"

    def start(self) -> tuple:
        return Decimal(0), Decimal(0)

    def run(self, state, rows, until):
        live = _risk_start() | {"height": int(state[0]), "rate": int(state[1])}
        user = rows[0][1]
        for us, _, _, a, b, line in rows:
            if line:
                heapq.heappush(live["ends"], [us, a, b])
        events = [(eid, us, a, b) for us, _, eid, a, b, line in rows if not line]
        out = _risk_fold(live, pd.DataFrame(events, columns=["event_id", "us", "p10", "r10"])) if events else []
        replay.score(live, until - 1)
        again = [(end, user, None, height, rate, True) for end, height, rate in live["ends"]]
        kept = (Decimal(live["height"]), Decimal(live["rate"])) if live["height"] or live["rate"] else None
        return kept, out, again


def risk_stream(stream: DataFrame) -> DataFrame:
    """Score and level at every event; the state is the user's points of the last day."""
    src = risk.risk_points(stream).withColumns({"a": F.col("p10"), "b": F.col("r10"), "line": F.lit(False)})
    out = ordered(
        src, _RiskFold(), "us long, user string, event_id long, a long, b long, line boolean",
        "event_id long, us long, n string",
    )
    n = F.col("n").cast("decimal(38,0)")
    hundredths = F.floor((n * 20 + HOUR).cast("decimal(38,0)") / F.lit(2 * HOUR))
    return out.select(
        "event_id", "us", (hundredths.cast("double") / 100.0).alias("risk_score"),
        risk.level_of(n, 10 * HOUR).alias("risk_level"),
    )


# ------------------------------------------------------------------ conversation patterns

_ENTRY = "us:bigint,event_id:bigint,action:string,severity:string,rule:string,s:int,a:int"
_ENTRY_NAMES = [f.split(":")[0] for f in _ENTRY.split(",")]


class _TalkFold(Fold):
    """The last messages of a quarter of an hour, at most as many as the tests look at."""

    state_ddl = f"recent:array<struct<{_ENTRY}>>"

    def __init__(self, at_action: str | None):
        self.at_action = at_action

    def start(self) -> tuple:
        return ([],)

    def run(self, state, rows, until):
        recent, out = [tuple(r) for r in state[0]], []
        for us, user, eid, action, severity, rule, s, a in rows:
            recent = [h for h in recent if us - h[0] < conversation.LOOKBACK]
            recent = (recent + [(us, eid, action, severity, rule, s, a)])[-V.HISTORY_MESSAGES:]
            # only what a test will find something in is handed on
            if self.at_action in (None, action) and replay.find_pattern([(h[0], h[2], h[3], h[4] or "unknown") for h in recent]):
                out.append((eid, user, us, [dict(zip(_ENTRY_NAMES, h)) for h in recent]))
        return (recent,), out, []


def detect_patterns_stream(stream: DataFrame, at_action: str | None = "ai_inference") -> DataFrame:
    """State is at most 20 messages of 15 minutes; the pattern tests are the batch expressions."""
    src = stream.withColumns(
        {
            "s": conversation._rank(F.col("severity"), V.SEVERITY_RANK),
            "a": conversation._rank(F.col("action"), V.ACTION_RANK),
        }
    )
    out = ordered(
        src, _TalkFold(at_action),
        "us long, user string, event_id long, action string, severity string, rule string, s int, a int",
        f"event_id long, user string, us long, recent array<struct<{_ENTRY}>>",
        keep_us=conversation.LOOKBACK,
    )
    p = conversation.pattern_column(F.col("recent"), F.col("user"))
    return out.withColumn("_p", p).filter("_p is not null").select("event_id", "user", "us", "_p.*")


# ------------------------------------------------------------------ frequency rules

class _FrequencyFold(Fold):
    """Counts per parent rule and instant within the longest span; equal instants count together."""

    state_ddl = "seen:array<struct<parent:string,us:bigint,n:bigint>>"

    def start(self) -> tuple:
        return ([],)

    def run(self, state, rows, until):
        out = []
        times: dict[str, list[int]] = {}
        upto: dict[str, list[int]] = {}  # events up to and with each instant

        def add(parent: str, us: int, n: int) -> None:
            t, total = times.setdefault(parent, []), upto.setdefault(parent, [])
            t.append(us)
            total.append(n + (total[-1] if total else 0))

        def count(parent: str, low: int, high: int) -> int:
            t, total = times[parent], upto[parent]
            i, j = bisect.bisect_left(t, low), bisect.bisect_right(t, high)
            return (total[j - 1] if j else 0) - (total[i - 1] if i else 0)

        for parent, us, n in sorted(tuple(r) for r in state[0]):
            add(parent, us, n)
        for us, group in itertools.groupby(rows, key=lambda r: r[0]):
            found = [(user, eid, parents.split(",")) for _, user, eid, parents in group]
            for parent, n in Counter(p for _, _, parents in found for p in parents if p).items():
                add(parent, us, n)
            for user, eid, parents in found:
                for rid, level, least, span, parent, *_ in V.FREQUENCY_RULES:
                    if str(parent) in parents and (n := count(str(parent), us - span * MICROS, us)) >= least:
                        out.append((eid, user, us, rid, level, n))
        low = rows[-1][0] - max(r[3] for r in V.FREQUENCY_RULES) * MICROS
        kept = [
            (parent, us, total[i] - (total[i - 1] if i else 0))
            for parent, total in upto.items() for i, us in enumerate(times[parent]) if us >= low
        ]
        return (kept,), out, []


def frequency_rules_stream(stream: DataFrame, source: str = SOURCE) -> DataFrame:
    parents = sorted({r[4] for r in V.FREQUENCY_RULES})
    ids = F.transform(
        ruletree._matched(stream, ("base", "severity", "action"), source, ruletree.PRODUCT, "casb_action", None),
        lambda m: m["rule_id"].cast("string"),
    )
    wanted = F.array_join(F.array_intersect(ids, F.array(*[F.lit(str(p)) for p in parents])), ",")
    return ordered(
        stream.withColumn("parents", wanted).filter("parents <> ''"), _FrequencyFold(),
        "us long, user string, event_id long, parents string",
        "event_id long, user string, us long, rule_id int, level int, matches long",
        keep_us=max(r[3] for r in V.FREQUENCY_RULES) * MICROS,
    )


# ------------------------------------------------------------------ closed loop

class _LoopFold(Fold):
    state_ddl = "packed:string"

    def start(self) -> tuple:
        return (json.dumps(replay.new_state()),)

    def run(self, state, rows, until):
        kept = json.loads(state[0])
        out = []
        for us, user, eid, evasion, entropy, rule, p, r, severity in rows:
            decision, n, pattern = replay.step(kept, us, bool(evasion), bool(entropy), rule, int(p), int(r), severity)
            out.append((eid, user, us, decision, str(n), pattern))
        return (json.dumps(kept),), out, []


def replay_stream(stream: DataFrame) -> DataFrame:
    """The closed loop over a stream of inspected requests (plus ``ts`` with a watermark)."""
    out = ordered(
        stream, _LoopFold(),
        "us long, user string, event_id long, evasion boolean, high_entropy boolean, rule string, "
        "p_rule long, r_rule long, severity string",
        "event_id long, user string, us long, decision string, n string, pattern string",
    )
    return replay._finish(out)


# ------------------------------------------------------------------ inspection under changing rules

def inspect_reloading(
    stream: DataFrame, rules: ReloadedRules, inspect: Callable[[DataFrame, list[dict]], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Run ``inspect(rows, rules)`` over every micro-batch with the rules then in force.

    Rows land in ``out/batch=N`` with ``rules_version``; a batch that is run again replaces its own folder, so every
    row is judged once and one batch never mixes two versions."""

    def judge(rows: DataFrame, number: int) -> None:
        version, now = rules.current()
        inspect(rows, now).withColumn("rules_version", F.lit(version)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ------------------------------------------------------------------ running

def start_available(stream: DataFrame, out: str) -> StreamingQuery:
    """Start a run over everything available, into ``out/rows`` with its checkpoint beside it."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available into a fresh table folder and read it back."""
    out = scratch_dir(spark, name)
    start_available(stream, out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def late_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """batch, operator, late: rows that came behind the watermark, from the query's progress.

    An operator that adds up before its state counts groups; put :func:`deduplicated` first, which sees single
    rows, and the others get none.  Spark keeps the last ``spark.sql.streaming.numRecentProgressUpdates`` batches."""
    rows = [
        (p.batchId, o.operatorName, o.numRowsDroppedByWatermark)
        for p in query.recentProgress for o in p.stateOperators if o.numRowsDroppedByWatermark
    ]
    return spark.createDataFrame(rows, "batch long, operator string, late long").groupBy("batch", "operator").agg(F.max("late").alias("late"))


#: Rows of one file of a replayed table, and the least number of files.
FILE_ROWS, LEAST_FILES = 1_000_000, 5
#: Bytes of a row group of such a file: a micro-batch is dealt over tasks by row groups.
ROW_GROUP = 1 << 20


def as_stream(spark: SparkSession, df: DataFrame, name: str, watermark: str = "10 minutes", files_per_batch: int = 1) -> DataFrame:
    """Replay a table: land ``df`` as files, one after the other in time, and read them as a stream in that order.

    Files hold about ``FILE_ROWS`` rows, so their number grows with the table; at least ``LEAST_FILES`` make
    a small table run in several micro-batches too.  The table is dealt by time first, so that a file is cut out of
    the few parts that overlap it and not out of the whole.  A file stays whole, since files of one time would have to
    meet in one micro-batch; its row groups are small, so that many tasks share the work on it."""
    rows = landed(df, f"{name}-table")
    files = max(LEAST_FILES, rows.count() // FILE_ROWS)
    cuts = sorted({int(c) for c in rows.approxQuantile("us", [i / files for i in range(1, files)], 0.25 / files)})
    dealt = landed(rows.repartitionByRange(4 * files, "us"), f"{name}-dealt")
    path = scratch_dir(spark, f"{name}-in")
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = dealt if low is None else dealt.where(F.col("us") > low)
        part = part if high is None else part.where(F.col("us") <= high)
        part.coalesce(1).write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{i:06d}")
    raw = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/*")
    return raw.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", watermark)
