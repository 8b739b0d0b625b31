"""Filters over endpoint telemetry (process, network, DNS events)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.sources.chat import contains_any


def shadow_ai_dns(events: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """DNS queries for assistant domains; each raises the shadow-AI alert."""
    q = F.lower("query_name")
    hits = events.filter((F.col("event_id") == 22) & contains_any(q, domains or V.SHADOW_AI_DOMAINS))
    return hits.withColumns(
        {
            "rule_id": F.lit(V.SHADOW_AI_RULE),
            "description": F.concat(F.lit("Shadow AI: DNS query for "), F.col("query_name")),
        }
    )


def shadow_ai_processes(events: DataFrame) -> DataFrame:
    return events.filter(
        (F.col("event_id") == 1)
        & (
            contains_any(F.lower("image"), V.SHADOW_AI_IMAGES)
            | contains_any(F.lower("command_line"), V.SHADOW_AI_COMMANDS)
        )
    )


def shadow_ai_connections(events: DataFrame) -> DataFrame:
    return events.filter(
        (F.col("event_id") == 3) & contains_any(F.lower("destination_hostname"), V.SHADOW_AI_HOSTS)
    )


def endpoint_baseline(events: DataFrame) -> DataFrame:
    """Process starts below System integrity, web traffic, and shadow-AI name lookups."""
    e = F.col("event_id")
    lookup = contains_any(F.lower("query_name"), V.SHADOW_AI_DOMAINS_SHORT)
    return events.filter(
        ((e == 1) & (F.coalesce(F.col("integrity_level"), F.lit("")) != "System"))
        | ((e == 3) & F.col("destination_port").isin(V.BASELINE_PORTS))
        | ((e == 22) & lookup)
    )


def security_channel_filter(events: DataFrame) -> DataFrame:
    return events.filter(~F.col("event_id").isin(V.NOISY_EVENT_IDS))


def unproxied_editor_launches(events: DataFrame) -> DataFrame:
    """Editor starts that lack one of the two enforcement flags."""
    cmd = F.lower(F.coalesce(F.col("command_line"), F.lit("")))
    lacks = F.lit(False)
    for flag in V.EDITOR_FLAGS:
        lacks = lacks | ~cmd.contains(flag)
    return events.filter((F.col("event_id") == 1) & F.col("image").endswith(V.EDITOR_IMAGE) & lacks)
