"""Response decisions: quarantine that sticks, throttling, model downgrade, and their audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.operators.timeline import running
from wardline.operators.token_bucket import token_bucket
from wardline.session import landed


def sticky_quarantine(requests: DataFrame, unblocks: DataFrame) -> DataFrame:
    """Add ``epoch`` (unblocks so far) and ``quarantined``: a critical request now or earlier in
    the epoch, even if the score has decayed since."""
    marks = unblocks.select("user", "us").distinct().withColumn("_kind", F.lit(0))
    both = (
        requests.filter(F.col("user").isNotNull())
        .withColumn("_kind", F.lit(1))
        .unionByName(marks, allowMissingColumns=True)
    )
    at = F.struct("us", "_kind")
    out = running(
        both, ["user"], "us", ["us", "_kind", "event_id"],
        sums={"epoch": 1 - F.col("_kind")},
        maxes={
            "_hit": F.when(F.col("risk_level") == "critical", at),
            "_freed": F.when(F.col("_kind") == 0, at),
        },
    )
    held = F.col("_hit").isNotNull() & (F.col("_freed").isNull() | (F.col("_hit") > F.col("_freed")))
    return out.filter("_kind = 1").withColumn("quarantined", held).drop("_kind", "_hit", "_freed")


def enforce(requests: DataFrame, unblocks: DataFrame) -> DataFrame:
    """Add ``decision`` (allowed / rate_limited / quarantined), ``downgraded`` and ``forced_model`` to
    requests that carry ``risk_score`` and ``risk_level``."""
    gated = landed(sticky_quarantine(requests, unblocks), "gated")
    throttled = F.coalesce((F.col("risk_level") == "high") & ~F.col("quarantined"), F.lit(False))
    # Only throttled requests meet the bucket's answers; all others pass by without a join.
    few = gated.filter(throttled)
    slow = few.join(token_bucket(few.select("user", "epoch", "us", "event_id")), "event_id", "left")
    out = slow.unionByName(gated.filter(~throttled).withColumn("token", F.lit(None).cast("boolean")))
    decision = (
        F.when(F.col("quarantined"), "quarantined")
        .when(throttled & ~F.col("token"), "rate_limited")
        .otherwise("allowed")
    )
    return out.withColumn("decision", decision).withColumn(
        "downgraded", (F.col("decision") == "allowed") & F.col("risk_level").isin("high", "elevated")
    ).withColumn("forced_model", F.when(F.col("downgraded"), V.DOWNGRADE_MODEL)).drop("token")


def audit_log(decisions: DataFrame, unblocks: DataFrame) -> DataFrame:
    """First quarantine, rate limit and downgrade per user and epoch, plus effective unblocks.  A downgrade
    names the model asked for (column ``model``, if the requests carry one) and the model forced.

    Minima per (user, epoch), so a busy user shrinks to a row on the map side.
    """
    model = F.col("model") if "model" in decisions.columns else F.lit(None).cast("string")
    entry = F.struct("us", "event_id", "risk_score", model.alias("model"))
    first = decisions.groupBy("user", "epoch").agg(
        F.min(F.when(F.col("decision") == "quarantined", entry)).alias("quarantine"),
        F.min(
            F.when((F.col("risk_level") == "high") & (F.col("decision") != "quarantined"), entry)
        ).alias("rate_limit_applied"),
        F.min(F.when(F.col("downgraded"), entry)).alias("model_downgrade"),
    )
    kinds = ["quarantine", "rate_limit_applied", "model_downgrade"]
    rows = first.select(
        "user", "epoch",
        F.explode(F.array(*[F.struct(F.lit(k).alias("action"), F.col(k).alias("e")) for k in kinds])).alias("x"),
    ).filter("x.e is not null")
    acted = rows.select(
        "user", "epoch",
        F.col("x.action").alias("action"),
        F.col("x.e.us").alias("us"),
        F.col("x.e.risk_score").alias("risk_score"),
        F.when(F.col("x.action") == "model_downgrade", F.col("x.e.model")).alias("original_model"),
        F.when(F.col("x.action") == "model_downgrade", V.DOWNGRADE_MODEL).alias("forced_model"),
    )
    # An unblock is logged only if the epoch it ends had put the user in quarantine.
    ended = _numbered(unblocks).withColumn("epoch", F.col("no") - 1)
    freed = ended.join(
        acted.filter("action = 'quarantine'").select("user", "epoch"), ["user", "epoch"], "left_semi"
    ).select(
        "user", "epoch", F.lit("unblocked").alias("action"), "us", F.lit(None).cast("double").alias("risk_score"),
        F.lit(None).cast("string").alias("original_model"), F.lit(None).cast("string").alias("forced_model"),
    )
    return acted.unionByName(freed)


def _numbered(unblocks: DataFrame) -> DataFrame:
    return running(
        unblocks.select("user", "us").distinct(), ["user"], "us", ["us"], sums={"no": F.lit(1)}
    )


def quarantined_users(decisions: DataFrame, unblocks: DataFrame) -> DataFrame:
    """Users in quarantine at the end of the log."""
    marks = unblocks.select("user", "us").distinct().groupBy("user").agg(F.count("*").alias("last_epoch"))
    held = decisions.filter("decision = 'quarantined'").groupBy("user").agg(F.max("epoch").alias("epoch"))
    return (
        held.join(marks, "user", "left")
        .filter(F.col("epoch") == F.coalesce("last_epoch", F.lit(0)))
        .select("user")
    )


def audit_tail(log: DataFrame, n: int = 50) -> DataFrame:
    return log.orderBy(F.desc("us"), "user", "action").limit(n)


def response_events(decisions: DataFrame) -> DataFrame:
    """Telemetry of gated requests."""
    return decisions.filter(F.col("decision") != "allowed").select(
        "event_id", "user", "us",
        F.when(F.col("decision") == "quarantined", "user_quarantined").otherwise("user_rate_limited").alias("action"),
        "risk_score",
        F.when(F.col("decision") == "quarantined", F.col("risk_level")).alias("risk_level"),
    )
