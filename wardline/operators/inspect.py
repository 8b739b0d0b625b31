"""Rule matching, redaction, canary and block-list tests over whole texts (layers 1 to 3)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.functions.literals import may_match

#: Java's ``\b \d \s`` are ASCII unless told otherwise; rule authors expect Unicode classes.
UNICODE = "(?U)"
#: Rules in one expression.
CHUNK = 100


def found(c: Column, pattern: str) -> Column:
    """Whether ``pattern`` matches somewhere; tried only where a literal that it needs stands."""
    match, may = c.rlike(UNICODE + pattern), may_match(c, pattern)
    return match if may is None else may & match


def _rule_struct(rule: dict, c: Column, with_match: bool) -> Column:
    fields = [F.lit(rule[k]).alias(k) for k in ("id", "name", "severity", "detail")]
    if with_match:
        fields.append(
            F.regexp_extract(c, UNICODE + rule["pattern"], 0).alias("matched")
        )
    return F.struct(*fields)


def first_match(c: Column, rules: list[dict], with_match: bool = False, may: list[Column | None] | None = None) -> Column:
    """struct of the first rule (file order) found in ``c``, else NULL.

    ``may``: for each rule a test that holds wherever it matches, or None.

    A ``case when`` for each ``CHUNK`` rules, the first that hits wins: stops at the first hit, needs
    no join and no shuffle.
    """
    if not rules:
        return F.lit(None).cast(
            "struct<id:string,name:string,severity:string,detail:string"
            + (",matched:string>" if with_match else ">")
        )
    chains = []
    for i in range(0, len(rules), CHUNK):
        chain = F
        for j, rule in enumerate(rules[i : i + CHUNK], i):
            here = found(c, rule["pattern"]) if not may or may[j] is None else may[j] & c.rlike(UNICODE + rule["pattern"])
            chain = chain.when(here, _rule_struct(rule, c, with_match))
        chains.append(chain)
    return F.coalesce(*chains) if len(chains) > 1 else chains[0]


def redact(df: DataFrame, col: str, rules: list[dict], out: str = "redacted") -> DataFrame:
    """Replace every match of every rule in turn; add ``out`` and ``violated`` (rule names).

    Each step reads the previous step's column twice (test, replace), which stops Catalyst from
    folding the chain into one exponentially large expression.
    """
    keep = df.columns
    cur = df.withColumn("_t0", F.col(col))
    hits = []
    for i, rule in enumerate(rules):
        t, pattern = F.col(f"_t{i}"), UNICODE + rule["pattern"]
        label = f"[REDACTED:{rule['name']}]".replace("\\", "\\\\").replace("$", "\\$")
        cur = cur.select(
            *keep,
            *[f"_h{j}" for j in hits],
            found(t, rule["pattern"]).alias(f"_h{i}"),
            F.when(found(t, rule["pattern"]), F.regexp_replace(t, pattern, label)).otherwise(t).alias(f"_t{i + 1}"),
        )
        hits.append(i)
    names = F.array_compact(
        F.array(*[F.when(F.col(f"_h{i}"), F.lit(r["name"])) for i, r in enumerate(rules)])
    )
    # explode over one element keeps later filters from being pushed into (and unfolding) the chain
    both = F.struct(F.col(f"_t{len(rules)}").alias(out), names.alias("violated"))
    return cur.select(*keep, F.explode(F.array(both)).alias("_r")).select(*keep, f"_r.{out}", "_r.violated")


def all_matches(df: DataFrame, col: str, rules: list[dict]) -> DataFrame:
    """One row per (input row, rule) with the number of matches; no join, rows multiply by hits."""
    c = F.col(col)

    def matches(pattern: str) -> Column:
        n, may = F.regexp_count(c, F.lit(UNICODE + pattern)), may_match(c, pattern)
        return n if may is None else F.when(~may, 0).otherwise(n)

    counted = F.array(
        *[
            F.struct(
                F.lit(r["id"]).alias("rule_id"),
                F.lit(r["name"]).alias("rule"),
                matches(r["pattern"]).alias("matches"),
            )
            for r in rules
        ]
    )
    hit = F.explode(F.filter(counted, lambda x: x["matches"] > 0)).alias("_m")
    return df.select(*[n for n in df.columns if n != col], hit).select(
        *[n for n in df.columns if n != col], "_m.*"
    )


def canary_hit(c: Column, token: str) -> Column:
    if not token:
        raise ValueError("an empty canary token would match every response")
    return c.contains(token)


def mask_pii(c: Column) -> Column:
    """Fixed labels over fixed patterns; a key block goes through to its END line."""
    for pattern, label in V.PII_MASKS:
        c = F.regexp_replace(c, UNICODE + pattern, label.replace("$", "\\$"))
    return c


def backtest_rule(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Try a candidate pattern on a whole corpus: ``is_match`` and ``matched`` per row."""
    check_pattern(df, pattern)
    c = F.col(col)
    return df.withColumns(
        {
            "is_match": found(c, pattern),
            "matched": F.when(found(c, pattern), F.regexp_extract(c, UNICODE + pattern, 0)),
        }
    )


def backtest_summary(tested: DataFrame) -> DataFrame:
    return tested.agg(
        F.count("*").alias("rows"),
        F.count_if("is_match").alias("hits"),
        F.round(F.count_if("is_match") / F.count("*"), 6).alias("hit_rate"),
    )


def check_pattern(df: DataFrame, pattern: str) -> None:
    """Reject a pattern Spark cannot compile before any data is read."""
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(UNICODE + pattern)).collect()
    except Exception as e:
        raise ValueError(f"invalid pattern: {pattern!r}") from e


def blocklist_rules(phrases: DataFrame, id_col: str, phrase_col: str) -> DataFrame:
    """Literal phrases as rows of the rules table (escaped, case kept)."""
    escaped = F.regexp_replace(F.col(phrase_col), r"([^\p{L}\p{N}_ ])", r"\\$1")
    return phrases.select(
        F.concat(F.lit("blocklist_"), F.col(id_col).cast("string")).alias("id"),
        F.concat(F.lit("Blocklist: "), F.col(phrase_col)).alias("name"),
        escaped.alias("pattern"),
        F.lit("Blocked phrase.").alias("detail"),
        F.lit(True).alias("enabled"),
        F.lit("high").alias("severity"),
        F.lit("both").alias("scope"),
    )


#: Characters of the phrases that one automaton holds; about 40 bytes of a worker's memory each.
AUTOMATON_CHARS = 4_000_000
#: Longer phrases stand in it by so many first characters and are compared whole where those are found.
HEAD = 500

_automata: dict = {}


def _automaton(number: str, phrases: list[str]):
    """Aho-Corasick automaton over the heads of ``phrases``, each with the numbers of its phrases; a worker keeps
    the one it used last."""
    if number not in _automata:
        import ahocorasick

        heads: dict[str, list[int]] = {}
        for i, phrase in enumerate(phrases):
            heads.setdefault(phrase[:HEAD], []).append(i)
        made = ahocorasick.Automaton()
        for head, places in heads.items():
            made.add_word(head, tuple(places))
        made.make_automaton()
        _automata.clear()
        _automata[number] = made
    return _automata[number]


def _found(machine, phrases: list[str], text: str) -> list[int]:
    """Numbers of the phrases in ``text``."""
    hits: set[int] = set()
    for end, places in machine.iter(text):
        for i in places:
            if i not in hits and (len(phrases[i]) <= HEAD or text.startswith(phrases[i], end + 1 - HEAD)):
                hits.add(i)
    return sorted(hits)


def _scan(docs: DataFrame, doc_id: str, col: str, part: DataFrame, id_col: str, phrase_col: str) -> DataFrame:
    """Hits of one part of the phrases: each text is read once, and only its hits become rows."""
    rows = part.toArrow()  # about AUTOMATON_CHARS characters
    number = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast((rows.column(phrase_col).to_pylist(), rows.column(id_col).combine_chunks()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, ids = sent.value
        machine = _automaton(number, phrases) if phrases else None
        for batch in batches:
            row, hit = [], []
            for i, text in enumerate(batch.column(1).to_pylist() if machine is not None else []):
                if text:
                    found = _found(machine, phrases, text)
                    hit += found
                    row += [i] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), ids.take(pa.array(hit, pa.int64()))], [doc_id, id_col])

    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((docs, doc_id), (part, id_col))}
    return docs.select(doc_id, col).mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()))


def blocklist_hits(
    docs: DataFrame, doc_id: str, col: str, phrases: DataFrame, id_col: str, phrase_col: str
) -> DataFrame:
    """(doc, phrase) pairs where the text contains the phrase literally; any number of phrases.

    The phrases become an Aho-Corasick automaton, so a text is read once however many there are; nothing is
    exploded or shuffled.  The size of the list is counted first: beyond ``AUTOMATON_CHARS`` it is dealt by
    hash into parts of about that size, and the texts are read once for each.  Empty and NULL phrases are in
    no text; ids that share a phrase, and repeated texts, each give their rows.
    """
    wanted = phrases.where(F.length(phrase_col) > 0).select(id_col, phrase_col)
    chars = wanted.agg(F.sum(F.length(phrase_col))).first()[0] or 0
    parts = -(-chars // AUTOMATON_CHARS) or 1
    hits = [
        _scan(docs, doc_id, col, wanted.where(F.pmod(F.xxhash64(phrase_col), F.lit(parts)) == i), id_col, phrase_col)
        for i in range(parts)
    ]
    return reduce(DataFrame.unionByName, hits)
