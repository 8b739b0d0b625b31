"""Table layouts of the engine."""

from pyspark.sql import types as T

_S = T.StringType()

#: One gateway event; every field nullable, as producers fill different subsets.
EVENT_FIELDS = [
    ("event_id", T.LongType()), ("us", T.LongType()), ("action", _S), ("user", _S), ("layer", _S),
    ("rule", _S), ("severity", _S), ("source", _S), ("prompt_preview", _S), ("risk_score", _S),
    ("risk_level", _S), ("evasion_techniques", _S), ("language", _S),
    ("edit_distance_ratio", T.DoubleType()), ("original_preview", _S), ("normalized_preview", _S),
    ("pattern_type", _S), ("pattern_description", _S), ("mitre_attack", _S), ("mitre_atlas", _S),
    ("alert", _S), ("model", _S), ("response_preview", _S), ("total_tokens", T.LongType()),
    ("duration_ms", T.DoubleType()), ("status", _S), ("error", _S),
]
GATEWAY_EVENT = T.StructType([T.StructField(n, t) for n, t in EVENT_FIELDS])

ENVELOPE = T.StructType(
    [
        T.StructField("sourcetype", _S),
        T.StructField("index", _S),
        T.StructField("time", T.DoubleType()),
        T.StructField("event", GATEWAY_EVENT),
    ]
)
