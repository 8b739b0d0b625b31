"""Case-management records built from alerts and violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V


def case_severity(level: Column) -> Column:
    """struct(id, name) of an alert level."""
    pack = lambda i, n: F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"))
    out = pack(*V.CASE_SEVERITY_DEFAULT)
    for upper, i, name in reversed(V.CASE_SEVERITY):
        out = F.when((level >= 0) & (level <= upper), pack(i, name)).otherwise(out)
    return out


def _field(df: DataFrame, names: list[str], default: str) -> Column:
    have = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default))


def case_records(
    alerts: DataFrame,
    title_prefix: str = "Gateway: ",
    source: str = "siem-gateway",
    tag: str = "siem,gateway",
    search_url: str = "https://siem.local/search?q=user%3D%22{user}%22",
    console_url: str = "https://console.local",
    endpoint_url: str = "https://console.local/agents?agent={agent}",
    customer_id: int = 1,
) -> DataFrame:
    """Flat case rows.  ``alerts``: rule_id, level, description, event time and event fields."""
    f = lambda names, default: _field(alerts, names, default)
    rule_id = F.col("rule_id").cast("string")
    title = F.coalesce(F.col("description"), F.lit("Unknown Alert"))
    user, rule = f(["user", "user_id"], "unknown"), f(["rule", "casb_rule"], "N/A")
    prompt = f(["prompt_preview", "prompt"], "N/A")
    severity, action = f(["severity"], "unknown"), f(["action"], "unknown")
    agent, agent_id = f(["agent"], "manager"), f(["agent_id"], "000")
    when = f(["timestamp", "us"], "")
    fill = lambda url, name, c: F.replace(F.lit(url), F.lit("{" + name + "}"), c)
    shadow = (rule_id == str(V.SHADOW_AI_RULE)) | title.contains("Shadow AI")
    link = F.when(shadow, fill(endpoint_url, "agent", agent_id)).otherwise(F.lit(console_url))
    sev = case_severity(F.col("level"))
    lines = F.concat(
        F.lit("**Rule ID:** "), rule_id, F.lit(" (Level "), F.col("level").cast("string"), F.lit(")\n"),
        F.lit("**Agent:** "), agent, F.lit("\n**Timestamp:** "), when, F.lit("\n\n---\n\n"),
        F.lit("**Action:** `"), action, F.lit("`\n**Severity:** `"), F.upper(severity),
        F.lit("`\n**DLP Rule Triggered:** `"), rule, F.lit("`\n**User ID:** `"), user,
        F.lit("`\n**Prompt Preview:** `"), prompt, F.lit("`\n\n---\n\n**Investigation Links:**\n- [User history]("),
        fill(search_url, "user", user), F.lit(")\n- [Endpoint]("), link, F.lit(")"),
    )
    return alerts.select(
        F.concat(F.lit(title_prefix), title).alias("alert_title"),
        lines.alias("alert_description"),
        F.lit(source).alias("alert_source"),
        F.concat(F.lit("rule-"), rule_id).alias("alert_source_ref"),
        link.alias("alert_source_link"),
        sev["id"].alias("alert_severity_id"),
        sev["name"].alias("alert_severity"),
        F.lit(1).alias("alert_status_id"),
        F.lit(customer_id).alias("alert_customer_id"),
        when.alias("alert_source_event_time"),
        F.concat(F.lit(tag + ","), severity, F.lit(","), action).alias("alert_tags"),
        F.to_json(F.struct(*[F.col(c) for c in alerts.columns])).alias("alert_source_content"),
    )


def violation_records(events: DataFrame, profile: str = "gateway") -> DataFrame:
    """Violation tickets; the gateway profile adds user, layer and action."""
    f = lambda names, default: _field(events, names, default)
    extra, tags, source = [], ["AI_SECURITY", "SOC", "INFRA"], "Infrastructure"
    if profile == "gateway":
        tags, source = ["AI_SECURITY", "CASB", "DLP"], "Gateway"
        extra = [f(["user"], "anonymous").alias("user"), f(["layer"], "L2").alias("layer"), F.lit("blocked").alias("action")]
    keep = ["event_id"] if "event_id" in events.columns else []
    return events.select(
        *keep,
        F.concat(F.lit("CASB Violation: "), f(["rule"], "Unknown Violation")).alias("title"),
        f(["detail"], "No details provided.").alias("description"),
        F.upper(f(["severity"], "medium")).alias("severity"),
        F.lit(source).alias("source"),
        F.lit(",".join(tags)).alias("tags"),
        *extra,
    )
