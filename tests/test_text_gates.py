"""Cheap tests in front of the text steps must not change a text that the steps would change."""

import random

from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.functions import decode, text


def test_gates_keep_results(spark):
    rng = random.Random(3)
    pieces = ["ab", " ", "  ", "\n", "\t ", " ", " ", "h1", "p@ss", "2024", "l33t!", "İ", "K", "vtaber", "VTABER", "flfgrz", "​",
              "а", "ﬁ", "ä", "ä", "aWdub3JlIGFsbCBwcmV2aW91cw==", "69676e6f72652061", "69:67 6e6f:726520 616c"]
    texts = ["", " ", *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(1500))]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").repartition(3)
    c, space = F.col("t"), f"[{V.SPACE_CLASS}]+"
    turned, low, low_turned = text.rot13(c), F.lower(c), F.lower(text.rot13(c))
    appears = F.lit(False)
    for word in V.ROT13_KEYWORDS:
        appears = appears | (low_turned.contains(word) & ~low.contains(word))
    leet, plain_words = f"[{V.LEET_FROM}]", F.filter(F.split(c, space), lambda w: w != "")
    fixed = F.transform(plain_words, lambda w: F.when(w.rlike(leet) & w.rlike(r"\p{L}") & (F.length(w) > 3), F.translate(w, V.LEET_FROM, V.LEET_TO)).otherwise(w))
    pairs = {
        "strip": (text.strip_invisible(c), F.regexp_replace(c, f"[{V.INVISIBLE}]", "")),
        "fold": (text.fold_confusables(c), F.translate(c, V.CONFUSABLE_FROM, V.CONFUSABLE_TO)),
        "rot13": (text.rot13_if_keyword(c), F.when(appears, turned).otherwise(c)),
        "collapse": (text.collapse_spaces(c), F.trim(F.regexp_replace(c, space, " "))),
        "words": (text.words(c), plain_words),
        "leet": (text.reverse_leet(c), F.array_join(fixed, " ")),
        "base64": (decode.decode_base64_segments(c), text.runs_replaced(decode.decode_base64_segments(c), "(?!)", lambda r: r)),
    }
    got = df.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(k) for k, (a, b) in pairs.items()]).collect()
    for row in got:
        for k in pairs:
            assert row[k]["a"] == row[k]["b"], (k, row["t"])


def test_texts_that_no_step_changes_are_not_cut(spark):
    """A long word without blanks is walked once by every step."""
    import time

    df = spark.createDataFrame([("ab" * 200_000,), ("g" * 400_000 + "1",), ("9" * 300_000,)], "t string")
    start = time.time()
    assert [r[0] for r in df.select(text.reverse_leet(F.col("t"))).collect()][0] == "ab" * 200_000
    assert time.time() - start < 30


def test_inspection_computes_only_what_is_read(spark):
    """The edit ratio is dear; a reader of decisions does not pay for it, a reader of ``norm`` gets it."""
    from wardline.operators.gateway import inspect_ingress

    df = spark.createDataFrame([(1, "one\ntwo  h3llo")], "id int, text string")
    rules = [{"id": "r", "name": "r", "pattern": "two", "severity": "high", "detail": ""}]
    out = inspect_ingress(df, rules)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" in plan(out) and "edit_distance_ratio" in plan(out)
    assert "edit_distance_ratio" not in plan(out.select("id", "decision", "events"))
    row = out.first()
    assert row["decision"] == "block" and row["norm"]["text"] == "one two hello" and row["norm"]["edit_distance_ratio"] > 0
