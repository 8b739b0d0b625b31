"""The rules table: ordered, with defaults filled and the canary put in as a literal."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import vocab as V

RULE_FIELDS = (
    "id string, name string, pattern string, detail string, "
    "enabled boolean, severity string, scope string"
)


def _java_literal(token: str) -> str:
    return re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", token)


def _require(canary: str) -> str:
    if not canary:
        raise ValueError("an empty canary token would match every response")
    return canary


def _finish(df: DataFrame, canary: str) -> DataFrame:
    """Defaults and the canary, which enters a pattern as a quoted literal."""
    quoted = F.lit(_java_literal(_require(canary)))
    return df.select(
        "pos",
        "id",
        "name",
        F.replace(F.col("pattern"), F.lit(V.CANARY_PLACEHOLDER), quoted).alias("pattern"),
        "detail",
        F.coalesce("enabled", F.lit(True)).alias("enabled"),
        F.coalesce("severity", F.lit("high")).alias("severity"),
        F.coalesce("scope", F.lit("both")).alias("scope"),
    )


def load_rules(spark: SparkSession, path: str, canary: str) -> DataFrame:
    """Rules of a JSON array file in file order (``pos``)."""
    raw = spark.read.text(path, wholetext=True)
    fields = ", ".join(f"{n}: {t}" for n, t in (f.split() for f in RULE_FIELDS.split(", ")))
    parsed = raw.select(F.posexplode(F.from_json("value", f"array<struct<{fields}>>")).alias("pos", "r"))
    return _finish(parsed.select("pos", "r.*"), canary)


def shipped_rules(spark: SparkSession, canary: str) -> DataFrame:
    rows = [
        (i, r["id"], r["name"], r["pattern"], r["detail"], r["enabled"], r["severity"], r["scope"])
        for i, r in enumerate(V.DLP_RULES)
    ]
    return _finish(spark.createDataFrame(rows, f"pos int, {RULE_FIELDS}"), canary)


def compile_rules(rules: DataFrame, scope: str | None = None) -> list[dict]:
    """The enabled rules of one direction as plain dicts, for building an expression.

    Rules are written by people, so the table is small; any number is compiled, and
    :func:`wardline.operators.inspect.first_match` tests them in chunks.
    """
    keep = rules.filter("enabled")
    if scope:
        other = {"ingress": "egress", "egress": "ingress"}[scope]
        keep = keep.filter(F.col("scope") != other)
    return [r.asDict() for r in sorted(keep.collect(), key=lambda r: r["pos"])]


class ReloadedRules:
    """Rules of a file that may change under way: read again whenever its time or size differs.

    A file that cannot be read or holds no rules leaves the last good ones in force."""

    def __init__(self, spark: SparkSession, path: str, canary: str, scope: str | None = None):
        self.spark, self.path, self.canary, self.scope = spark, path, canary, scope
        self.stamp, self.version, self.rules = None, "", []

    def _stamp(self) -> tuple:
        seen = self.spark.read.format("binaryFile").load(self.path).select("modificationTime", "length", F.sha2("content", 256).alias("sha"))
        return tuple(seen.first())

    def current(self) -> tuple[str, list[dict]]:
        """Version (start of the file's SHA-256) and rules now in force."""
        try:
            stamp = self._stamp()
            if stamp != self.stamp:
                rules = compile_rules(load_rules(self.spark, self.path, self.canary), self.scope)
                if rules:
                    self.stamp, self.version, self.rules = stamp, stamp[2][:12], rules
        except Exception:  # noqa: BLE001 - missing, half written or not JSON
            if not self.rules:
                raise
        if not self.rules:
            raise ValueError(f"no rules in {self.path}")
        return self.version, self.rules
