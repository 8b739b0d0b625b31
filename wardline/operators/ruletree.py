"""The alert rule tree: field tests per event, frequency rules per user, routing.

Rules are a fixed handful of field tests, so matching is one expression per event (an array of
matched rules), not a join; only the frequency rules shuffle, by (user, parent rule, hour).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.operators.timeline import HOUR, MICROS, sliding_counts
from wardline.sources.gateway import SOURCE

PRODUCT = "Gateway"

#: Producers and rules disagree on some layer names; pass this to accept both.
LAYER_ALIASES = {"L2_DLP_Regex_Ingress": "L2_DLP_Regex", "L1_Entropy": "L1_Entropy_Analysis"}


def _action(df: DataFrame, field: str | None) -> Column:
    return F.coalesce(F.col(field), F.col("action")) if field and field in df.columns else F.col("action")


def fill(template: str, df: DataFrame, product: str = PRODUCT) -> Column:
    """``$(field)`` templates filled from the row; missing fields become empty."""
    out, rest = [], template.replace("{product}", product)
    while "$(" in rest:
        head, _, tail = rest.partition("$(")
        name, _, rest = tail.partition(")")
        out.append(F.lit(head))
        out.append(F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(""))
    out.append(F.lit(rest))
    return F.concat(*out)


def _hit(df: DataFrame, pos: int, rule_id: int, level: int, template: str, groups, techniques, product: str) -> Column:
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    return F.struct(
        F.lit(level).alias("level"),
        F.lit(-pos).alias("neg_pos"),
        F.lit(rule_id).alias("rule_id"),
        fill(template, df, product).alias("description"),
        arr(groups).alias("groups"),
        arr(techniques).alias("techniques"),
    )


def _tests(
    df: DataFrame, source: str, product: str, action_field: str | None, layer_aliases: dict[str, str] | None
) -> dict[str, list[tuple[Column, Column]]]:
    base = F.col("source") == source
    layer = F.col("layer")
    for alias, name in (layer_aliases or {}).items():
        layer = F.when(F.col("layer") == alias, name).otherwise(layer)
    pos = 0
    rid, level, text, groups, tags = V.BASE_RULE
    out = {"base": [(base, _hit(df, pos, rid, level, text, groups, tags, product))], "severity": [], "action": []}
    for rid, level, severity, text, groups, tags in V.SEVERITY_RULES:
        pos += 1
        out["severity"].append(
            (base & (F.col("severity") == severity), _hit(df, pos, rid, level, text, groups, tags, product))
        )
    for rid, level, action, where, text, groups, tags in V.ACTION_RULES:
        pos += 1
        on = base & (_action(df, action_field) == action)
        if where is not None:
            on = on & (layer == where)
        out["action"].append((on, _hit(df, pos, rid, level, text, groups, tags, product)))
    return out


def _matched(
    events: DataFrame, kinds: tuple[str, ...], source: str, product: str,
    action_field: str | None, layer_aliases: dict[str, str] | None,
) -> Column:
    tests = _tests(events, source, product, action_field, layer_aliases)
    picked = [F.when(on, hit) for kind in kinds for on, hit in tests[kind]]
    return F.array_compact(F.array(*picked))


def _exploded(events: DataFrame, matched: Column) -> DataFrame:
    return events.select(*events.columns, F.explode(matched).alias("_m")).select(
        *events.columns, "_m.rule_id", "_m.level", "_m.description", "_m.groups", "_m.techniques"
    )


def match_base(events: DataFrame, source: str = SOURCE, product: str = PRODUCT) -> DataFrame:
    return _exploded(events, _matched(events, ("base",), source, product, None, None))


def match_severity(events: DataFrame, source: str = SOURCE, product: str = PRODUCT) -> DataFrame:
    return _exploded(events, _matched(events, ("severity",), source, product, None, None))


def match_action(
    events: DataFrame, source: str = SOURCE, product: str = PRODUCT,
    action_field: str | None = "casb_action", layer_aliases: dict[str, str] | None = None,
) -> DataFrame:
    return _exploded(events, _matched(events, ("action",), source, product, action_field, layer_aliases))


def match_all(
    events: DataFrame, source: str = SOURCE, product: str = PRODUCT,
    action_field: str | None = "casb_action", layer_aliases: dict[str, str] | None = None,
) -> DataFrame:
    """One row per (event, matched rule)."""
    kinds = ("base", "severity", "action")
    return _exploded(events, _matched(events, kinds, source, product, action_field, layer_aliases))


def match_best(
    events: DataFrame, source: str = SOURCE, product: str = PRODUCT,
    action_field: str | None = "casb_action", layer_aliases: dict[str, str] | None = None,
) -> DataFrame:
    """The highest level per event, ties by rule order; picked inside the row, no shuffle."""
    tests = _tests(events, source, product, action_field, layer_aliases)
    flat = [pair for kind in ("base", "severity", "action") for pair in tests[kind]]
    # Rank with plain numbers first (level, then file order); only the winner's texts are put
    # together.  explode over one element keeps filters on the result from being pushed into the
    # rank, where Catalyst would repeat it once per mention.
    ranks = [F.when(on, level * 1000 - pos) for pos, ((on, _), level) in enumerate(zip(flat, _levels()))]
    ranked = events.select(*events.columns, F.explode(F.array(F.greatest(*ranks))).alias("_best"))
    level = F.ceil(F.col("_best") / 1000).cast("int")
    ranked = ranked.filter("_best is not null").select(
        *events.columns, level.alias("_level"), (level * 1000 - F.col("_best")).alias("_pos")
    )
    texts = [V.BASE_RULE[2:], *[r[3:] for r in V.SEVERITY_RULES], *[r[4:] for r in V.ACTION_RULES]]
    ids = [r[0] for r in (V.BASE_RULE, *V.SEVERITY_RULES, *V.ACTION_RULES)]
    described = F.lit(None).cast("string")
    for pos, (template, _, _) in enumerate(texts):
        described = F.when(F.col("_pos") == pos, fill(template, ranked, product)).otherwise(described)
    words = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    nth = F.col("_pos") + 1
    return ranked.select(
        *events.columns,
        F.element_at(F.array(*[F.lit(i) for i in ids]), nth).alias("rule_id"),
        F.col("_level").alias("level"),
        described.alias("description"),
        F.element_at(F.array(*[words(g) for _, g, _ in texts]), nth).alias("groups"),
        F.element_at(F.array(*[words(t) for _, _, t in texts]), nth).alias("techniques"),
    )


def _levels() -> list[int]:
    """Level per rule, in the order of :func:`_tests`."""
    return [V.BASE_RULE[1], *[r[1] for r in V.SEVERITY_RULES], *[r[1] for r in V.ACTION_RULES]]


def frequency_rules(
    events: DataFrame, source: str = SOURCE, product: str = PRODUCT, action_field: str | None = "casb_action"
) -> DataFrame:
    """Rules that fire when a user's matches of a parent rule reach a count within a time span.

    The current event counts, and so do all others of its instant.  Counts are a sweep over quarter hours
    (:func:`timeline.sliding_counts`), so a burst costs as much as it has events.
    """
    user_events = events.filter(F.col("user").isNotNull())
    parents = sorted({r[4] for r in V.FREQUENCY_RULES})
    ids = F.transform(_matched(user_events, ("base", "severity", "action"), source, product, action_field, None),
                      lambda m: m["rule_id"])
    wanted = F.array_intersect(ids, F.array(*[F.lit(p) for p in parents]))
    narrow = user_events.select("event_id", "user", "us", F.explode(wanted).alias("parent"))
    spans = sorted({r[3] for r in V.FREQUENCY_RULES})
    counted = sliding_counts(narrow, ["user", "parent"], "us", {f"_n{s}": s * MICROS for s in spans})
    fired = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("parent") == parent) & (F.col(f"_n{span}") >= times),
                    F.struct(
                        F.lit(rid).alias("rule_id"), F.lit(level).alias("level"),
                        F.col(f"_n{span}").alias("matches"),
                        fill(text, counted, product).alias("description"),
                        F.array(*[F.lit(t) for t in tags]).alias("techniques"),
                    ),
                )
                for rid, level, times, span, parent, text, groups, tags in V.FREQUENCY_RULES
            ]
        )
    )
    return counted.select("event_id", "user", "us", F.explode(fired).alias("_f")).select(
        "event_id", "user", "us", "_f.*"
    )


def high_risk_score(events: DataFrame) -> DataFrame:
    """Events whose ``risk_score`` text is a whole number of 80 or more."""
    rid, level, pattern, tag = V.HIGH_SCORE_RULE
    return events.filter(F.col("risk_score").rlike(pattern)).select(
        *events.columns, F.lit(rid).alias("rule_id"), F.lit(level).alias("level"), F.lit(tag).alias("technique")
    )


def technique_tags(matches: DataFrame) -> DataFrame:
    """One row per (match, technique)."""
    kept = [c for c in matches.columns if c not in ("techniques", "groups", "description")]
    return matches.select(*kept, F.explode("techniques").alias("technique"))


def group_tags(matches: DataFrame) -> DataFrame:
    kept = [c for c in matches.columns if c not in ("techniques", "groups", "description")]
    return matches.select(*kept, F.explode("groups").alias("rule_group"))


def route_alerts(alerts: DataFrame) -> DataFrame:
    """Add ``route``: notify (level 12 and up, at most 12 an hour), log (level 3 and up) or drop.

    The rank is only needed up to 12, which Spark cuts before the shuffle, so an hour full of
    alerts does not meet in one task.
    """
    hour = F.floor(F.col("us") / HOUR).cast("long")
    key = F.struct("us", "event_id", "rule_id")
    w = Window.partitionBy("_hour").orderBy("us", "event_id", "rule_id")
    loud = alerts.filter(F.col("level") >= V.NOTIFY_LEVEL).select("event_id", "rule_id", "us", hour.alias("_hour"))
    # One row per hour: the last alert that still goes out.
    cut = (
        loud.withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") <= V.NOTIFY_PER_HOUR)
        .groupBy("_hour")
        .agg(F.max(key).alias("_cut"))
    )
    loud_enough = F.col("level") >= V.NOTIFY_LEVEL
    return (
        alerts.withColumn("_hour", hour)
        .join(cut, "_hour", "left")
        .select(
            *alerts.columns,
            F.when(loud_enough & (key <= F.col("_cut")), "notify")
            .when(F.col("level") >= V.LOG_LEVEL, "log")
            .otherwise("drop")
            .alias("route"),
        )
    )
