"""Identity, role gate, coverage and compliance reports, training data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.functions.text import collapse_spaces, fold_confusables, strip_invisible
from wardline.operators.respond import audit_tail, quarantined_users
from wardline.operators.risk import top_risk_users


def attach_identity(df: DataFrame, users: DataFrame, default: str = V.DEFAULT_USER) -> DataFrame:
    """Fill a missing user and add ``uid``, ``role`` (NULL when the directory lacks the user).

    No broadcast hint: Spark ships the directory when its size allows and otherwise sort-merges,
    where AQE splits a hot user's partition.
    """
    role = F.lit("standard")
    for gid, name in V.ROLE_BY_GID.items():
        role = F.when(F.col("gid") == gid, name).otherwise(role)
    directory = users.select(F.col("user"), "uid", role.alias("role"))
    return df.withColumn("user", F.coalesce("user", F.lit(default))).join(directory, "user", "left")


def rbac_gate(df: DataFrame, admin: str = "is_admin") -> DataFrame:
    """Add ``rbac``: unknown users and standard users on administrative prompts are blocked,
    developers pass with a monitor event."""
    asks = F.col(admin)
    return df.withColumns(
        {
            "rbac": F.when(F.col("role").isNull(), "block").when(asks & (F.col("role") == "standard"), "block").otherwise("allow"),
            "rbac_action": F.when(F.col("role").isNull(), "dlp_block")
            .when(asks & (F.col("role") == "standard"), "dlp_block")
            .when(asks, "dlp_monitor")
            .otherwise("ai_inference"),
        }
    )


def technique_coverage(matches: DataFrame) -> DataFrame:
    """The technique matrix with the number of alerts seen per technique; ``gap`` marks holes."""
    spark = matches.sparkSession
    matrix = spark.createDataFrame(V.TECHNIQUES, "id string, name string, covered boolean, layer string")
    seen = (
        matches.select(F.explode("techniques").alias("id")).groupBy("id").agg(F.count("*").alias("alerts"))
    )
    return (
        matrix.join(seen, "id", "left")
        .select("id", "name", "covered", "layer", F.coalesce("alerts", F.lit(0)).alias("alerts"))
        .withColumn("gap", ~F.col("covered"))
    )


def compliance_report(
    events: DataFrame, decisions: DataFrame, log: DataFrame, unblocks: DataFrame, matches: DataFrame, now_us: int
) -> DataFrame:
    """Report sections as tagged rows: section, item, detail, number."""
    top = top_risk_users(events, now_us).select(
        F.lit("risk_user").alias("section"), F.col("user").alias("item"),
        F.col("risk_level").alias("detail"), F.col("risk_score").alias("number"),
    )
    held = quarantined_users(decisions, unblocks).select(
        F.lit("quarantined").alias("section"), F.col("user").alias("item"),
        F.lit("").alias("detail"), F.lit(1.0).alias("number"),
    )
    acts = audit_tail(log, 20).select(
        F.lit("response").alias("section"), F.col("user").alias("item"),
        F.col("action").alias("detail"), F.col("us").cast("double").alias("number"),
    )
    cover = technique_coverage(matches).select(
        F.lit("technique").alias("section"), F.col("id").alias("item"),
        F.when(F.col("covered"), "covered").otherwise("gap").alias("detail"),
        F.col("alerts").cast("double").alias("number"),
    )
    return top.unionByName(held).unionByName(acts).unionByName(cover)


def training_set(labelled: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Distinct texts with one label each; INJECTION wins where copies disagree.

    Copies collapse in the map-side aggregate, so a text that makes up a third of the rows
    reaches the reducer as one row per task.
    """
    return labelled.groupBy(text).agg(
        F.min(label).alias("label"), F.count("*").alias("copies")
    )


def training_selection(scored: DataFrame, text: str = "text", label: str = "truth") -> DataFrame:
    """Prompts a classifier got wrong (injections not ``blocked``, safe ones that were), for labelling and
    the next training round; one row per text after folding lookalikes, invisible characters, case and
    spacing.  INJECTION wins where copies disagree."""
    wrong = scored.filter((F.col(label) == "INJECTION") != F.col("blocked"))
    folded = F.lower(collapse_spaces(fold_confusables(strip_invisible(F.col(text)))))
    return wrong.groupBy(folded.alias("folded")).agg(
        F.min(label).alias("label"), F.min(text).alias("text"), F.count("*").alias("copies")
    )


def export_training_set(df: DataFrame, path: str) -> None:
    df.select("text", "label").write.mode("overwrite").json(path)
