"""Registered queries and, where DuckDB can say the same thing, their SQL.

The SQL is written on its own terms (range self-joins, recursion, lags over joined history), not
by transcribing the DataFrame plan, so that agreement means something.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.functions import decode, entropy, text
from wardline.operators import (
    cases, classify, conversation, endpoint, gateway, governance, inspect, normalize, replay, respond, risk,
    ruletree, searches, token_bucket,
)
from wardline.operators.timeline import HOUR, MICROS
from wardline.plans import fixtures as X
from wardline.sources import chat, rules as rule_source
from wardline.sources import gateway as feed
from wardline.session import landed, scratch_dir
from wardline.streaming import operators as streams

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def q_(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


RISK_FACTOR = 8  # risk levels spread over all four classes
SIEM_FACTOR = 240  # minutes-wide windows see several events of a user
NOW = X.now_us(RISK_FACTOR)
SIEM_NOW = X.now_us(SIEM_FACTOR)
G8, G240 = X.gateway_sql(RISK_FACTOR), X.gateway_sql(SIEM_FACTOR)
S240 = X.siem_sql(SIEM_FACTOR)


def ev8(s, d):
    return X.gateway_events(s, d, RISK_FACTOR)


def ev240(s, d):
    return X.gateway_events(s, d, SIEM_FACTOR)


def siem240(s, d):
    return X.siem_events(s, d, SIEM_FACTOR)


# ======================================================================= sources and parsing

HOSTS_SQL = " OR ".join(f"contains(host, {q_(d)})" for d in V.FORWARD_DOMAINS)


@query("filter_ai_chat", f"""
    SELECT page_id, url, method FROM (
      SELECT *, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM ({X.WEB_FLOWS_SQL}))
    WHERE method = 'POST' AND contains(url, 'chat/completions') AND ({HOSTS_SQL})""")
def filter_ai_chat(s, d):
    return chat.filter_ai_chat(X.web_flows(s, d))


@query("last_user_message", f"""
    SELECT request_id, message FROM ({X.LAST_MESSAGE_SQL}) WHERE length(trim(message)) >= 2""")
def last_user_message(s, d):
    return chat.last_user_message(X.chat_requests(s, d)).select("request_id", "message")


@query("extract_user_request", f"""
    SELECT request_id, CASE WHEN contains(message, '<userRequest>') THEN
        trim(split_part(split_part(message, '<userRequest>', 2), '</userRequest>', 1), ' ' || chr(9) || chr(10) || chr(13))
      ELSE message END AS request
    FROM ({X.LAST_MESSAGE_SQL}) WHERE length(trim(message)) >= 2""")
def extract_user_request(s, d):
    m = chat.last_user_message(X.chat_requests(s, d))
    return m.select("request_id", chat.extract_user_request(F.col("message")).alias("request"))


@query("reassemble_sse", f"SELECT flow_id, text FROM ({X.SSE_TEXT_SQL})")
def reassemble_sse(s, d):
    return X.sse_bodies(s, d).select("flow_id", chat.reassemble_sse(F.col("body")).alias("text"))


@query("reassemble_chunks", f"SELECT flow_id, text FROM ({X.SSE_TEXT_SQL})")
def reassemble_chunks(s, d):
    return chat.reassemble_chunks(X.sse_lines(s, d))


@query("prompt_size_gate", f"""
    SELECT prompt_id, length(text) AS prompt_chars, CASE WHEN length(text) > 32000 THEN 413 ELSE 200 END AS status
    FROM ({X.PROMPTS_SQL})""")
def prompt_size_gate(s, d):
    return chat.prompt_size_gate(X.prompts(s, d), "text").select("prompt_id", "prompt_chars", "status")


@query("decode_siem_json", f"""
    SELECT event_id, action, user, rule, severity FROM ({S240}) WHERE source = 'ai-gateway'""")
def decode_siem_json(s, d):
    fields = ["source", "event_id", "action", "user", "rule", "severity"]
    lines = siem240(s, d).select(
        F.replace(F.to_json(F.struct(*fields)), F.lit('{"source":"'), F.lit('{"source": "')).alias("line")
    )
    return feed.decode_siem_json(lines).select("event.event_id", "event.action", "event.user", "event.rule", "event.severity")


GOOD_LINES_SQL = f"""
    SELECT event_id, user, us, action, severity, rule, layer, risk_score FROM ({G240})
    WHERE event_id % 50 NOT IN (7, 9) AND event_id % 7 <> 3"""
_LINE_COLUMNS = ["event_id", "user", "us", "action", "severity", "rule", "layer", "risk_score"]


@query("read_gateway_events", GOOD_LINES_SQL)
def read_gateway_events(s, d):
    return feed.read_gateway_events(s, X.gateway_lines(s, d, SIEM_FACTOR)).select(*_LINE_COLUMNS)


@query("bad_gateway_lines", f"""
    SELECT CASE WHEN event_id % 50 = 7 THEN {q_(X.BAD_LINE)} || event_id ELSE event_id || ' at soon' END AS line
    FROM ({G240}) WHERE event_id % 50 IN (7, 9)""")
def bad_gateway_lines(s, d):
    """Lines that are no events, in a table of their own."""
    bad = feed.bad_gateway_lines(s, X.gateway_lines(s, d, SIEM_FACTOR))
    named = F.concat(F.get_json_object("line", "$.event.event_id"), F.lit(" at "), F.get_json_object("line", "$.event.us"))
    return bad.select(F.coalesce(named, "line").alias("line"))


@query("stream_gateway_events", GOOD_LINES_SQL)
def stream_gateway_events(s, d):
    """The same lines as a file stream in several micro-batches."""
    stream = feed.stream_gateway_events(s, X.gateway_lines(s, d, SIEM_FACTOR), files_per_batch=1)
    return streams.run_available(s, stream.select(*_LINE_COLUMNS), "gateway-events")


# ======================================================================= normaliser

INVIS_SQL = q_("[" + V.INVISIBLE + "]")
SPACE_SQL = q_("[" + V.SPACE_CLASS + "]+")
def rot_sql(c: str) -> str:
    return f"translate({c}, {q_(text._ROT_FROM)}, {q_(text._ROT_TO)})"


LEET_SQL = f"translate(w, {q_(V.LEET_FROM)}, {q_(V.LEET_TO)})"


@query("strip_invisible", f"""
    SELECT prompt_id, regexp_replace(text, {INVIS_SQL}, '', 'g') AS clean,
      length(regexp_replace(text, {INVIS_SQL}, '', 'g')) <> length(text) AS changed FROM ({X.PROMPTS_SQL})""")
def strip_invisible(s, d):
    c = text.strip_invisible(F.col("text"))
    return X.prompts(s, d).select("prompt_id", c.alias("clean"), (F.length(c) != F.length("text")).alias("changed"))


@query("fold_confusables", f"""
    SELECT prompt_id, translate(text, {q_(V.CONFUSABLE_FROM)}, {q_(V.CONFUSABLE_TO)}) AS folded FROM ({X.PROMPTS_SQL})""")
def fold_confusables(s, d):
    return X.prompts(s, d).select("prompt_id", text.fold_confusables(F.col("text")).alias("folded"))


def rot_hit(c: str) -> str:
    """Keyword test over lower-cased columns ``{c}_rot`` and ``{c}_low``."""
    return " OR ".join(f"(contains({c}_rot, '{w}') AND NOT contains({c}_low, '{w}'))" for w in V.ROT13_KEYWORDS)


@query("rot13_if_keyword", f"""
    SELECT prompt_id, CASE WHEN {rot_hit('t')} THEN {rot_sql('t')} ELSE t END AS turned, ({rot_hit('t')}) AS changed
    FROM (SELECT prompt_id, text AS t, lower({rot_sql('text')}) AS t_rot, lower(text) AS t_low FROM ({X.PROMPTS_SQL}))""")
def rot13_if_keyword(s, d):
    c = text.rot13_if_keyword(F.col("text"))
    return X.prompts(s, d).select("prompt_id", c.alias("turned"), (c != F.col("text")).alias("changed"))


@query("reverse_leet", f"""
    SELECT prompt_id, array_to_string(list_transform(
        list_filter(regexp_split_to_array(text, {SPACE_SQL}), lambda w: w <> ''),
        lambda w: CASE WHEN regexp_matches(w, '[{V.LEET_FROM}]') AND regexp_matches(w, '\\p{{L}}') AND length(w) > 3
          THEN {LEET_SQL} ELSE w END), ' ') AS letters
    FROM ({X.PROMPTS_SQL})""")
def reverse_leet(s, d):
    return X.prompts(s, d).select("prompt_id", text.reverse_leet(F.col("text")).alias("letters"))


def _script_sql() -> str:
    cols = ", ".join(
        f"length(regexp_replace(text, {q_('[^' + span + ']')}, '', 'g')) AS {name}" for name, span in V.SCRIPT_RANGES
    )
    names = [n for n, _ in V.SCRIPT_RANGES]
    total, top = " + ".join(names), f"greatest({', '.join(names)})"
    arms = " ".join(f"WHEN {n} = {top} THEN '{n}'" for n in names)
    return f"""
    SELECT prompt_id, CASE WHEN {total} = 0 THEN 'latin' WHEN {top} < 0.7 * ({total}) THEN 'mixed' {arms} END AS script
    FROM (SELECT prompt_id, {cols} FROM (
      SELECT doc_id AS prompt_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN left(text, 6) || ' приветпривет'
        WHEN 2 THEN left(text, 9) || ' 世界世界世界' ELSE text || ' привет' END AS text FROM documents))"""


@query("dominant_script", _script_sql())
def dominant_script(s, d):
    i, t = F.col("doc_id") % 4, F.col("text")
    mixed = (
        F.when(i == 0, t).when(i == 1, F.concat(F.left(t, F.lit(6)), F.lit(" приветпривет")))
        .when(i == 2, F.concat(F.left(t, F.lit(9)), F.lit(" 世界世界世界"))).otherwise(F.concat(t, F.lit(" привет")))
    )
    docs = X.table(s, d, "documents").select(F.col("doc_id").alias("prompt_id"), mixed.alias("text"))
    return docs.select("prompt_id", text.dominant_script(F.col("text")).alias("script"))


@query("edit_ratio", f"""
    SELECT prompt_id, round(1 - same / n, 4) AS ratio FROM (
      SELECT prompt_id, greatest(length(a), length(b)) AS n,
        len(list_filter(generate_series(1, least(length(a), length(b))), lambda i: ca[i] = cb[i])) AS same
      FROM (SELECT prompt_id, a, b, string_split(a, '') AS ca, string_split(b, '') AS cb FROM (
        SELECT prompt_id, replace(lower(text), ' ', '') AS a,
          replace(lower(regexp_replace(text, {INVIS_SQL}, '', 'g')), ' ', '') AS b FROM ({X.PROMPTS_SQL}))))""")
def edit_ratio(s, d):
    p = X.prompts(s, d).withColumn("clean", text.strip_invisible(F.col("text")))
    return p.select("prompt_id", text.edit_ratio(F.col("text"), F.col("clean")).alias("ratio"))


# Decoding in SQL: the runs a step may decode are cut out, read as bytes in hex digits and put back.

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))  # the compatibility characters that stand in the tables
_NARROW = "".join(map(chr, range(0x21, 0x7F)))


def unicode_sql(c: str) -> str:
    return f"translate(translate({c}, {q_(_WIDE)}, {q_(_NARROW)}), {q_(V.CONFUSABLE_FROM)}, {q_(V.CONFUSABLE_TO)})"


def readable_sql(digits: str) -> str:
    """The text of hex digits between blanks; NULL unless letters, marks, numbers, signs and white space."""
    text_of = f"""try(decode(unhex(array_to_string(list_filter(regexp_extract_all({digits}, {q_(decode.VALID + '|..')}),
        lambda y: length(y) > 2 OR y < '80'), ''))))"""
    return f"""list_transform([{text_of}], lambda t: CASE WHEN t <> '' AND regexp_matches(t,
        '^[\\pL\\pM\\pN\\pP\\pS\\pZ\\t\\n\\v\\f\\r\\x1c-\\x1f\\x85]*$') THEN ' ' || t || ' ' END)[1]"""


def runs_sql(c: str, pattern: str, decoded_run: str) -> str:
    """``c`` with every run replaced by ``decoded_run`` (of ``run``).  A blank goes in front, so that a run at the
    start needs no anchor, and comes off again where it was not part of a run that was decoded."""
    runs = f"list_transform(regexp_extract_all(' ' || {c}, {q_(pattern)}), lambda run: [run, {decoded_run}])"
    return f"""list_transform([{{'gaps': string_split_regex(' ' || {c}, {q_(pattern)}), 'runs': {runs}}}], lambda v:
        substr(array_to_string(list_transform(list_zip(v.gaps, v.runs), lambda z: z[1] || coalesce(z[2][2], z[2][1], '')), ''),
          CASE WHEN v.gaps[1] = '' AND v.runs[1][2] IS NOT NULL THEN 1 ELSE 2 END))[1]"""


_DATA, _PADS = "regexp_extract(run, '[A-Za-z0-9+/]{20,}')", "length(regexp_extract(run, '[A-Za-z0-9+/]{20,}(=*)', 1))"
BASE64_RUN_SQL = f"""CASE WHEN length({_DATA}) % 4 = 0 OR (length({_DATA}) % 4 = 2 AND {_PADS} = 2) OR (length({_DATA}) % 4 = 3 AND {_PADS} >= 1)
    THEN {readable_sql(f"hex(from_base64({_DATA} || repeat('=', (4 - length({_DATA}) % 4) % 4)))")} END"""
_DIGITS = r"regexp_replace(regexp_replace(run, '^(?:0x|\\x)', ''), '[: \t\n\v\f\r]', '', 'g')"
HEX_RUN_SQL = f"CASE WHEN regexp_full_match({_DIGITS}, '[0-9a-fA-F]+') THEN {readable_sql(f'upper({_DIGITS})')} END"
_BLANK = f"[{V.SPACE_CLASS}"
BASE64_SQL_PATTERN = V.BASE64_SEGMENT.replace(r"(?:^|[\s", f"(?:{_BLANK}").replace(r"[\s", _BLANK)
HEX_SQL_PATTERN = V.HEX_SEGMENT.replace(r"[:\s]", f"[:{V.SPACE_CLASS}]")


def decoded_sql(src: str, c: str) -> str:
    """``src`` with u, p, b, h: ``c`` after NFKC and lookalikes, percent, base64 and hex decoding."""
    return f"""
    SELECT *, {runs_sql('b', HEX_SQL_PATTERN, HEX_RUN_SQL)} AS h
    FROM (SELECT *, {runs_sql('p', BASE64_SQL_PATTERN, BASE64_RUN_SQL)} AS b
    FROM (SELECT *, url_decode(u) AS p
    FROM (SELECT *, {unicode_sql(c)} AS u FROM ({src}))))"""


@query("decode_segments", f"""
    SELECT page_id, h AS text, u <> html AS by_unicode, p <> u AS by_url, b <> p AS by_base64, h <> b AS by_hex
    FROM ({decoded_sql('SELECT page_id, html FROM pages', 'html')})""")
def decode_segments(s, d):
    """Percent, base64, hex and NFKC decoding of page sources."""
    p = decode.decoded(X.table(s, d, "pages"), "html", ["page_id"])
    return p.select("page_id", "_d.text", *[F.col(f"_d.{k}").alias(f"by_{k}") for k in decode.STEPS])


# Layer 0, stage by stage.
def norm_sql(src: str) -> str:
    """All stages of the texts of ``src`` (prompt_id, user, text)."""
    return f"""
    SELECT prompt_id, user, original, clean, u, p, b, h, turned, letters,
      CASE WHEN {' + '.join(n for n, _ in V.SCRIPT_RANGES)} = 0 THEN 'latin'
        WHEN greatest({', '.join(n for n, _ in V.SCRIPT_RANGES)}) < 0.7 * ({' + '.join(n for n, _ in V.SCRIPT_RANGES)}) THEN 'mixed'
        {' '.join(f"WHEN {n} = greatest({', '.join(m for m, _ in V.SCRIPT_RANGES)}) THEN '{n}'" for n, _ in V.SCRIPT_RANGES)} END AS lang
    FROM (SELECT *, {', '.join(f"length(regexp_replace(letters, {q_('[^' + span + ']')}, '', 'g')) AS {name}" for name, span in V.SCRIPT_RANGES)}
    FROM (SELECT *, array_to_string(list_transform(
        list_filter(regexp_split_to_array(turned, {SPACE_SQL}), lambda w: w <> ''),
        lambda w: CASE WHEN regexp_matches(w, '[{V.LEET_FROM}]') AND regexp_matches(w, '\\p{{L}}') AND length(w) > 3
          THEN {LEET_SQL} ELSE w END), ' ') AS letters
    FROM (SELECT *, CASE WHEN {rot_hit('h')} THEN {rot_sql('h')} ELSE h END AS turned
    FROM (SELECT *, lower(h) AS h_low, lower({rot_sql('h')}) AS h_rot
    FROM ({decoded_sql(f"SELECT prompt_id, user, text AS original, regexp_replace(text, {INVIS_SQL}, '', 'g') AS clean FROM ({src})", 'clean')})))))"""


NORM_SQL = norm_sql(X.PROMPTS_SQL)
TECH_SQL = """array_to_string(list_filter([
      CASE WHEN length(clean) <> length(original) THEN 'invisible_chars' END,
      CASE WHEN u <> clean THEN 'unicode_confusables' END,
      CASE WHEN p <> u THEN 'url_encoding' END,
      CASE WHEN b <> p THEN 'base64_encoding' END,
      CASE WHEN h <> b THEN 'hex_encoding' END,
      CASE WHEN turned <> h THEN 'rot13' END,
      CASE WHEN letters <> turned THEN 'leetspeak' END,
      CASE WHEN lang NOT IN ('latin', 'other') THEN 'non_latin_script:' || lang END], lambda x: x IS NOT NULL), ', ')"""
RATIO_SQL = """list_transform([{'a': string_split(replace(lower(original), ' ', ''), ''), 'b': string_split(replace(lower(letters), ' ', ''), '')}],
      lambda v: round(1 - len(list_filter(generate_series(1, least(len(v.a), len(v.b))), lambda i: v.a[i] = v.b[i])) / greatest(len(v.a), len(v.b)), 4))[1]"""


@query("normalize_prompts", f"""
    SELECT prompt_id, letters AS text, length(original) AS original_length, length(letters) AS normalized_length,
      {RATIO_SQL} AS edit_distance_ratio, lang AS language, tech <> '' AS evasion_detected, tech AS techniques
    FROM (SELECT *, {TECH_SQL} AS tech FROM ({NORM_SQL}))""")
def normalize_prompts(s, d):
    n = normalize.normalize_prompts(X.prompts(s, d))
    return n.select(
        "prompt_id", "norm.text", "norm.original_length", "norm.normalized_length", "norm.edit_distance_ratio",
        "norm.language", "norm.evasion_detected",
        F.array_join("norm.evasion_techniques", ", ").alias("techniques"),
    )


@query("evasion_events", f"""
    SELECT prompt_id, user, 'evasion_attempt' AS action, 'high' AS severity, tech AS evasion_techniques, lang AS language,
      {RATIO_SQL} AS edit_distance_ratio, left(original, 200) AS original_preview, left(letters, 200) AS normalized_preview
    FROM (SELECT *, {TECH_SQL} AS tech FROM ({NORM_SQL})) WHERE tech <> ''""")
def evasion_events(s, d):
    return normalize.evasion_events(normalize.normalize_prompts(X.prompts(s, d)))


# ======================================================================= inspection

@query("shannon_entropy", f"""
    SELECT prompt_id, round(sum(-p * log2(p)), 6) AS entropy FROM (
      SELECT prompt_id, count(*) / max(n) AS p FROM (
        SELECT prompt_id, length(text) AS n, unnest(string_split(text, '')) AS ch FROM ({X.PROMPTS_SQL}))
      GROUP BY prompt_id, ch)
    GROUP BY prompt_id""")
def shannon_entropy(s, d):
    return X.prompts(s, d).select("prompt_id", F.round(entropy.shannon_entropy(F.col("text")), 6).alias("entropy"))


# A dense token planted on every sixth document; the rest must be found by windows, or not at all.
DENSE = " Zq7RkX2vLw9TbN4mYc8HsJ6dGf3PaQe5UoVi1EtKyMxBn0WzCpDhFgSjAl"


@query("entropy_violation", f"""
    WITH p AS (SELECT doc_id AS prompt_id, CASE WHEN doc_id % 6 = 0 THEN text || {q_(DENSE)} ELSE text END AS text FROM documents),
    cand AS (
      SELECT prompt_id, 0 AS kind, i AS pos, w[i] AS c FROM (
        SELECT prompt_id, w, unnest(generate_series(1, len(w))) AS i FROM (
          SELECT prompt_id, list_filter(regexp_split_to_array(text, {SPACE_SQL}), lambda x: x <> '') AS w FROM p))
      WHERE length(w[i]) >= 50
      UNION ALL
      SELECT prompt_id, 1, i, substring(text, CAST(i AS INT) + 1, 80) FROM (
        SELECT prompt_id, text, unnest(range(0, length(text) - 60, 40)) AS i FROM p WHERE length(text) >= 50)),
    h AS (SELECT prompt_id, kind, pos, any_value(c) AS c, sum(-n / len * log2(n / len)) AS h FROM (
        SELECT prompt_id, kind, pos, any_value(c) AS c, any_value(length(c)) AS len, ch, count(*) AS n FROM (
          SELECT *, unnest(string_split(c, '')) AS ch FROM cand)
        GROUP BY prompt_id, kind, pos, ch)
      GROUP BY prompt_id, kind, pos)
    SELECT p.prompt_id, f.h IS NOT NULL AS flagged, coalesce(round(f.h, 2), 0) AS score, coalesce(left(f.c, 80), '') AS snippet
    FROM p LEFT JOIN (SELECT * FROM h WHERE h >= 4.8 QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY kind, pos) = 1) f
      USING (prompt_id)""")
def entropy_violation(s, d):
    docs = X.table(s, d, "documents").select(
        F.col("doc_id").alias("prompt_id"),
        F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit(DENSE))).otherwise(F.col("text")).alias("text"),
    )
    return docs.withColumn("_e", entropy.entropy_violation(F.col("text"))).select("prompt_id", "_e.*")


def compiled(s: SparkSession, scope: str | None = None) -> list[dict]:
    return rule_source.compile_rules(rule_source.shipped_rules(s, X.CANARY), scope)


def _rules_sql(scope: str | None) -> list[tuple[str, str, str, str]]:
    other = {"ingress": "egress", "egress": "ingress", None: None}[scope]
    return [
        (r["id"], r["name"], r["pattern"].replace(V.CANARY_PLACEHOLDER, X.CANARY), r["severity"])
        for r in V.DLP_RULES if r["scope"] != other
    ]


def _first_sql(scope: str, what: int, c: str = "text") -> str:
    arms = " ".join(f"WHEN regexp_matches({c}, {q_(r[2])}) THEN {q_(r[what])}" for r in _rules_sql(scope))
    return f"CASE {arms} END"


@query("dlp_first_match", f"""
    SELECT prompt_id, {_first_sql('ingress', 0)} AS rule_id, {_first_sql('ingress', 3)} AS severity FROM ({X.PROMPTS_SQL})""")
def dlp_first_match(s, d):
    m = X.prompts(s, d).withColumn("_m", inspect.first_match(F.col("text"), compiled(s, "ingress")))
    return m.select("prompt_id", F.col("_m.id").alias("rule_id"), "_m.severity")


EGRESS_FOUND = "CASE " + " ".join(
    f"WHEN regexp_matches(text, {q_(r[2])}) THEN regexp_extract(text, {q_(r[2])}, 0)" for r in _rules_sql("egress")
) + " END"


@query("dlp_first_match_egress", f"""
    SELECT prompt_id, {_first_sql('egress', 0)} AS rule_id, {EGRESS_FOUND} AS matched FROM ({X.PROMPTS_SQL})""")
def dlp_first_match_egress(s, d):
    m = X.prompts(s, d).withColumn("_m", inspect.first_match(F.col("text"), compiled(s, "egress"), with_match=True))
    return m.select("prompt_id", F.col("_m.id").alias("rule_id"), "_m.matched")


def _redact_sql(src: str, key: str, col: str) -> str:
    sql = f"SELECT {key}, {col} AS t, '' AS v FROM ({src})"
    for _, name, pattern, _ in _rules_sql("egress"):
        sql = f"""SELECT {key}, regexp_replace(t, {q_(pattern)}, {q_('[REDACTED:' + name + ']')}, 'g') AS t,
          v || CASE WHEN regexp_matches(t, {q_(pattern)}) THEN {q_(name + '|')} ELSE '' END AS v FROM ({sql})"""
    return f"SELECT {key}, t AS redacted, rtrim(v, '|') AS violated FROM ({sql})"


@query("redact", _redact_sql(X.PROMPTS_SQL, "prompt_id", "text"))
def redact(s, d):
    r = inspect.redact(X.prompts(s, d), "text", compiled(s, "egress"))
    return r.select("prompt_id", "redacted", F.array_join("violated", "|").alias("violated"))


@query("dlp_all_matches", " UNION ALL ".join(
    f"""SELECT prompt_id, {q_(r[0])} AS rule_id, len(regexp_extract_all(text, {q_(r[2])})) AS matches
        FROM ({X.PROMPTS_SQL}) WHERE regexp_matches(text, {q_(r[2])})""" for r in _rules_sql(None)))
def dlp_all_matches(s, d):
    return inspect.all_matches(X.prompts(s, d).select("prompt_id", "text"), "text", compiled(s)).drop("rule")


@query("canary_hits", f"""
    SELECT prompt_id, 'intrusion_detected' AS action, 'critical' AS severity, 403 AS status
    FROM ({X.PROMPTS_SQL}) WHERE contains(text, {q_(X.CANARY)})""")
def canary_hits(s, d):
    return X.prompts(s, d).filter(inspect.canary_hit(F.col("text"), X.CANARY)).select(
        "prompt_id", F.lit("intrusion_detected").alias("action"), F.lit("critical").alias("severity"), F.lit(403).alias("status")
    )


_MASKED = "text"
for _p, _label in V.PII_MASKS[:3]:
    _MASKED = f"regexp_replace({_MASKED}, {q_(_p)}, {q_(_label)}, 'g')"
for _kind in ("RSA ", "EC ", "OPENSSH ", ""):
    _MASKED = (
        f"regexp_replace({_MASKED}, {q_(f'-----BEGIN {_kind}PRIVATE KEY-----(?s:.*?)-----END {_kind}PRIVATE KEY-----')}, "
        f"{q_(V.PII_MASKS[3][1])}, 'g')"
    )


@query("mask_pii", f"SELECT prompt_id, {_MASKED} AS masked FROM ({X.PROMPTS_SQL})")
def mask_pii(s, d):
    return X.prompts(s, d).select("prompt_id", inspect.mask_pii(F.col("text")).alias("masked"))


_LEX = " + ".join(f"CAST(contains(lower(w), '{k}') AS INT)" for k in V.ROT13_KEYWORDS)


INJECTION_SQL = f"""
    WITH p AS (SELECT prompt_id, length(text) AS n, text FROM ({X.PROMPTS_SQL})),
    s AS (SELECT prompt_id, max(1 - pow(0.5, {_LEX})) AS sc FROM (
      SELECT prompt_id, substring(text, CAST(i AS INT) + 1, 512) AS w FROM (
        SELECT prompt_id, text, unnest(range(0, n, 448)) AS i FROM p WHERE n > 10)) GROUP BY prompt_id)
    SELECT prompt_id, CASE WHEN sc IS NULL THEN 'safe' WHEN sc >= 0.85 THEN 'INJECTION' ELSE 'SAFE' END AS label,
      coalesce(round(sc, 4), 0) AS injection_score, coalesce(round(1 - sc, 4), 1) AS safe_score, coalesce(sc >= 0.85, false) AS blocked
    FROM p LEFT JOIN s USING (prompt_id)"""


@query("score_injection", INJECTION_SQL)
def score_injection(s, d):
    return classify.score_injection(X.prompts(s, d).select("prompt_id", "text")).drop("text")


@query("blocklist_hits", """
    SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def blocklist_hits(s, d):
    return inspect.blocklist_hits(
        X.table(s, d, "documents"), "doc_id", "text",
        X.table(s, d, "benchmark").withColumnRenamed("text", "phrase"), "item_id", "phrase",
    )


@query("blocklist_rules", """
    SELECT 'blocklist_' || item_id AS id, 'Blocklist: ' || text AS name,
      regexp_replace(text, '([^\\p{L}\\p{N}_ ])', '\\\\\\1', 'g') AS pattern, 'high' AS severity, 'both' AS scope
    FROM benchmark""")
def blocklist_rules(s, d):
    return inspect.blocklist_rules(X.table(s, d, "benchmark"), "item_id", "text").select("id", "name", "pattern", "severity", "scope")


_TEST = r"(?i)[a-z]*tion[a-z]*"


@query("backtest_rule", f"""
    SELECT prompt_id, regexp_matches(text, {q_(_TEST)}) AS is_match,
      CASE WHEN regexp_matches(text, {q_(_TEST)}) THEN regexp_extract(text, {q_(_TEST)}, 0) END AS matched FROM (
      SELECT doc_id AS prompt_id, text FROM documents)""")
def backtest_rule(s, d):
    docs = X.table(s, d, "documents").select(F.col("doc_id").alias("prompt_id"), "text")
    return inspect.backtest_rule(docs, "text", _TEST).drop("text")


@query("backtest_summary", f"""
    SELECT count(*) AS rows, count(*) FILTER (WHERE regexp_matches(text, {q_(_TEST)})) AS hits,
      round(count(*) FILTER (WHERE regexp_matches(text, {q_(_TEST)})) / count(*), 6) AS hit_rate
    FROM documents""")
def backtest_summary(s, d):
    docs = X.table(s, d, "documents").select("doc_id", "text")
    return inspect.backtest_summary(inspect.backtest_rule(docs, "text", _TEST))


def _flat_events(df: DataFrame, of: str = "events") -> DataFrame:
    return df.withColumn(of, F.array_join(F.transform(of, lambda e: F.concat_ws(":", e["action"], e["severity"])), "|"))


def dense_sql(src: str) -> str:
    """prompt_id of the texts of ``src`` (prompt_id, text) in which a long word or a window is dense."""
    return f"""
    SELECT DISTINCT prompt_id FROM (
      SELECT prompt_id, kind, pos, sum(-n / len * log2(n / len)) AS h FROM (
        SELECT prompt_id, kind, pos, any_value(length(c)) AS len, ch, count(*) AS n FROM (
          SELECT *, unnest(string_split(c, '')) AS ch FROM (
            SELECT prompt_id, 0 AS kind, i AS pos, w[i] AS c FROM (
              SELECT prompt_id, w, unnest(generate_series(1, len(w))) AS i FROM (
                SELECT prompt_id, list_filter(regexp_split_to_array(text, {SPACE_SQL}), lambda x: x <> '') AS w FROM ({src})))
            WHERE length(w[i]) >= 50
            UNION ALL
            SELECT prompt_id, 1, i, substring(text, CAST(i AS INT) + 1, 80) FROM (
              SELECT prompt_id, text, unnest(range(0, length(text) - 60, 40)) AS i FROM ({src}) WHERE length(text) >= 50)))
        GROUP BY prompt_id, kind, pos, ch)
      GROUP BY prompt_id, kind, pos) WHERE h >= 4.8"""


def ingress_sql(original: bool, src: str = X.PROMPTS_SQL) -> str:
    """Forward mode: prompt_id, user, rule, its severity, techniques and entropy flag."""
    pick = lambda what: _first_sql("ingress", what, "letters") if not original else (
        f"coalesce({_first_sql('ingress', what, 'original')}, {_first_sql('ingress', what, 'letters')})"
    )
    return f"""
    WITH n AS MATERIALIZED (SELECT * FROM ({norm_sql(src)})), dense AS ({dense_sql('SELECT prompt_id, letters AS text FROM n')})
    SELECT prompt_id, user, {pick(1)} AS rule, {pick(3)} AS rule_severity, {TECH_SQL} AS tech,
      prompt_id IN (SELECT prompt_id FROM dense) AS high_entropy FROM n"""


@query("inspect_ingress", f"""
    SELECT prompt_id, CASE WHEN rule IS NULL THEN 'allow' ELSE 'block' END AS decision, coalesce(rule, '') AS rule,
      CASE WHEN tech <> '' THEN 'Evasion: ' || tech ELSE '' END AS evasion FROM ({ingress_sql(False)})""")
def inspect_ingress(s, d):
    r = gateway.inspect_ingress(X.prompts(s, d), compiled(s, "ingress"))
    ev = F.get(F.filter("events", lambda e: e["action"] == "evasion_attempt"), F.lit(0))
    return r.select("prompt_id", "decision", "rule", F.coalesce(ev["rule"], F.lit("")).alias("evasion"))


@query("inspect_ingress_full", f"""
    SELECT prompt_id, CASE WHEN rule IS NULL THEN 'allow' ELSE 'block' END AS decision, coalesce(rule, '') AS rule, high_entropy,
      concat_ws('|', CASE WHEN tech <> '' THEN 'evasion_attempt:high' END, CASE WHEN high_entropy THEN 'dlp_flagged:high' END,
        CASE WHEN rule IS NULL THEN 'ai_inference:none' ELSE 'dlp_block:' || rule_severity END) AS events
    FROM ({ingress_sql(True)})""")
def inspect_ingress_full(s, d):
    r = gateway.inspect_ingress(X.prompts(s, d), compiled(s, "ingress"), inspect_original=True)
    return _flat_events(r).select("prompt_id", "decision", "rule", "high_entropy", "events")


@query("inspect_ingress_message", f"""
    WITH t AS MATERIALIZED ({X.PROMPTS_SQL}), dense AS ({dense_sql('SELECT prompt_id, text FROM t')}),
    i AS (SELECT prompt_id, blocked FROM ({INJECTION_SQL}))
    SELECT prompt_id, CASE WHEN blocker = '' THEN 'allow' ELSE 'block' END AS decision, blocker AS blocked_by, coalesce(rule, '') AS rule,
      CASE blocker WHEN 'entropy' THEN 'ingress_block:high' WHEN 'injection' THEN 'ingress_block:critical'
        WHEN 'rule' THEN 'ingress_block:' || rule_severity ELSE 'ai_inference:none' END AS events
    FROM (SELECT *, CASE WHEN prompt_id IN (SELECT prompt_id FROM dense) THEN 'entropy' WHEN blocked THEN 'injection'
        WHEN rule IS NOT NULL THEN 'rule' ELSE '' END AS blocker
      FROM (SELECT prompt_id, blocked, {_first_sql('ingress', 1)} AS rule, {_first_sql('ingress', 3)} AS rule_severity
        FROM t JOIN i USING (prompt_id)))""")
def inspect_ingress_message(s, d):
    r = gateway.inspect_ingress(X.prompts(s, d), compiled(s, "ingress"), mode="message")
    return _flat_events(r).select("prompt_id", "decision", "blocked_by", "rule", "events")


@query("inspect_ingress_reverse", f"""
    WITH t AS MATERIALIZED ({X.PROMPTS_SQL}), dense AS ({dense_sql('SELECT prompt_id, text FROM t')})
    SELECT prompt_id, CASE WHEN blocker = '' THEN 'allow' ELSE 'block' END AS decision, blocker AS blocked_by, coalesce(rule, '') AS rule,
      CASE blocker WHEN 'entropy' THEN 'ingress_block:high' WHEN 'rule' THEN 'ingress_block:' || rule_severity ELSE 'ai_inference:none' END AS events
    FROM (SELECT *, CASE WHEN prompt_id IN (SELECT prompt_id FROM dense) THEN 'entropy' WHEN rule IS NOT NULL THEN 'rule' ELSE '' END AS blocker
      FROM (SELECT prompt_id, {_first_sql('ingress', 1)} AS rule, {_first_sql('ingress', 3)} AS rule_severity FROM t))""")
def inspect_ingress_reverse(s, d):
    r = gateway.inspect_ingress(X.prompts(s, d), compiled(s, "ingress"), mode="reverse")
    return _flat_events(r).select("prompt_id", "decision", "blocked_by", "rule", "events")


@query("ingress_events", f"""
    SELECT prompt_id, user, CAST(row_number() OVER (PARTITION BY prompt_id ORDER BY nth) - 1 AS INT) AS step, action, severity, rule, layer
    FROM (
      SELECT prompt_id, user, 0 AS nth, 'evasion_attempt' AS action, 'high' AS severity, 'Evasion: ' || tech AS rule, 'L0_Normalizer' AS layer
      FROM r WHERE tech <> ''
      UNION ALL SELECT prompt_id, user, 1, 'dlp_flagged', 'high', 'High Entropy (Log Only)', 'L1_Entropy_Analysis' FROM r WHERE high_entropy
      UNION ALL SELECT prompt_id, user, 2, 'dlp_block', rule_severity, rule, 'L2_DLP_Regex_Ingress' FROM r WHERE rule IS NOT NULL
      UNION ALL SELECT prompt_id, user, 3, 'ai_inference', 'none', '', '' FROM r WHERE rule IS NULL)""".replace(
    "SELECT prompt_id, user, CAST", f"WITH r AS MATERIALIZED ({ingress_sql(False)}) SELECT prompt_id, user, CAST", 1))
def ingress_events(s, d):
    """The recorded events of every inspected prompt, one row each."""
    r = gateway.inspect_ingress(X.prompts(s, d), compiled(s, "ingress"))
    return gateway.emitted_events(r, ["prompt_id", "user"])


REQUESTS_SQL = f"""
    SELECT request_id AS prompt_id, CAST(request_id % 50 AS VARCHAR) AS user, CASE WHEN contains(message, '<userRequest>') THEN
        trim(split_part(split_part(message, '<userRequest>', 2), '</userRequest>', 1), ' ' || chr(9) || chr(10) || chr(13))
      ELSE message END AS text
    FROM ({X.LAST_MESSAGE_SQL}) WHERE length(trim(message)) >= 2"""


@query("decide_requests", f"""
    SELECT prompt_id AS request_id, user, CASE WHEN rule IS NULL THEN 'allow' ELSE 'block' END AS decision, coalesce(rule, '') AS rule,
      high_entropy, tech AS techniques FROM ({ingress_sql(False, REQUESTS_SQL)})""")
def decide_requests(s, d):
    """From request bodies to decisions: last user message, typed request, layers 0 to 2."""
    r = gateway.decide_requests(X.chat_requests(s, d), compiled(s, "ingress"))
    return r.select("request_id", "user", "decision", "rule", "high_entropy", F.array_join("norm.evasion_techniques", ", ").alias("techniques"))


@query("inspect_egress", f"""
    SELECT flow_id, CASE WHEN leak THEN 'block' WHEN rule IS NOT NULL THEN 'redact' ELSE 'pass' END AS decision,
      CASE WHEN leak THEN 'Critical: Honeypot exfiltrated. Modifying response.' WHEN rule IS NOT NULL THEN redacted ELSE body END AS delivered,
      CASE WHEN leak THEN 'Canary Token Exfiltration' WHEN rule IS NOT NULL THEN replace(violated, '|', ', ') ELSE '' END AS rule,
      NOT leak AND rule IS NOT NULL AND violated = '' AS unredacted,
      CASE WHEN leak THEN 403 ELSE 200 END AS status,
      CASE WHEN leak THEN 'dlp_block:critical' WHEN rule IS NOT NULL THEN 'dlp_redact:high' ELSE '' END AS events,
      CASE WHEN leak THEN 'intrusion_detected:critical' WHEN rule IS NOT NULL THEN 'egress_flagged:high' ELSE '' END AS risk_events
    FROM (SELECT flow_id, contains(text, {q_(X.CANARY)}) AS leak, {_first_sql('egress', 1)} AS rule FROM ({X.SSE_TEXT_SQL}))
    JOIN ({X.SSE_BODY_SQL}) USING (flow_id) JOIN ({_redact_sql(X.SSE_BODY_SQL, 'flow_id', 'body')}) USING (flow_id)""")
def inspect_egress(s, d):
    r = gateway.inspect_egress(X.sse_bodies(s, d), compiled(s, "egress"), X.CANARY)
    return _flat_events(_flat_events(r), "risk_events").select(
        "flow_id", "decision", "delivered", "rule", "unredacted", "status", "events", "risk_events"
    )


def _egress_events_sql(leak_event: str, hit_event: str) -> str:
    """One event an answer at most; the names of all rules that redacted are its rule."""
    return f"""
    SELECT flow_id, us, user, 0 AS step, CASE WHEN leak THEN '{leak_event}' ELSE '{hit_event}' END AS action,
      CASE WHEN leak THEN 'critical' ELSE 'high' END AS severity,
      CASE WHEN leak THEN 'Canary Token Exfiltration' ELSE replace(violated, '|', ', ') END AS rule
    FROM (SELECT flow_id, contains(text, {q_(X.CANARY)}) AS leak, {_first_sql('egress', 1)} AS rule FROM ({X.SSE_TEXT_SQL}))
    JOIN ({_redact_sql(X.SSE_BODY_SQL, 'flow_id', 'body')}) USING (flow_id) JOIN ({X.FLOW_USER_SQL}) USING (flow_id)
    WHERE leak OR rule IS NOT NULL"""


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("us"))


def _user_events(df: DataFrame) -> DataFrame:
    return df.select("flow_id", F.unix_micros("ts").alias("us"), "user", "step", "action", "severity", "rule")


@query("egress_events", _egress_events_sql("dlp_block", "dlp_redact"))
def egress_events(s, d):
    """Telemetry of answers with the user who asked."""
    return _user_events(gateway.egress_events(_timed(X.flow_answers(s, d)), _timed(X.flow_requests(s, d)), compiled(s, "egress"), X.CANARY))


@query("egress_risk_events", _egress_events_sql("intrusion_detected", "egress_flagged"))
def egress_risk_events(s, d):
    """What answers add to the risk of the user who asked."""
    return _user_events(gateway.egress_events(
        _timed(X.flow_answers(s, d)), _timed(X.flow_requests(s, d)), compiled(s, "egress"), X.CANARY, "risk_events"))


@query("inspect_egress_message", f"""
    SELECT prompt_id, CASE WHEN leak OR rule IS NOT NULL THEN 'block' ELSE 'pass' END AS decision,
      CASE WHEN leak THEN 'Blocked: Honeypot Exfiltrated.' WHEN rule IS NOT NULL THEN 'Blocked: ' || rule || ' detected in stream.'
        ELSE text END AS delivered,
      CASE WHEN leak THEN 'Canary Token Exfiltration' ELSE coalesce(rule, '') END AS rule
    FROM (SELECT prompt_id, text, contains(text, {q_(X.CANARY)}) AS leak, {_first_sql('egress', 1)} AS rule FROM ({X.PROMPTS_SQL}))""")
def inspect_egress_message(s, d):
    r = gateway.inspect_egress(X.prompts(s, d), compiled(s, "egress"), X.CANARY, col="text", mode="message")
    return r.select("prompt_id", "decision", "delivered", "rule")


# ======================================================================= risk

POINTS_SQL = ", ".join(f"('{a}', '{s}', {p}, {i})" for i, (a, s, p) in enumerate(V.RISK_POINTS_TENTHS))


def points_sql(src: str) -> str:
    return f"""
    SELECT e.*, coalesce(x.p, f.p, 0) AS p10,
      CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 3 WHEN 'low' THEN 1 ELSE 3 END AS r10
    FROM ({src}) e
    LEFT JOIN (SELECT * FROM (VALUES {POINTS_SQL}) t(a, s, p, i)) x ON x.a = e.action AND x.s = e.severity
    LEFT JOIN (SELECT a, arg_min(p, i) AS p FROM (VALUES {POINTS_SQL}) t(a, s, p, i) GROUP BY a) f ON f.a = e.action"""


def score_sql(n: str) -> str:
    return f"((20 * {n} + {HOUR}) // {2 * HOUR}) / 100.0"


def level_sql(n: str, unit: int = 10 * HOUR) -> str:
    arms = " ".join(f"WHEN {n} >= {t * unit} THEN '{name}'" for name, t in V.RISK_LEVELS)
    return f"CASE {arms} ELSE 'normal' END"


def asof_sql(src: str, extra: str = "") -> str:
    return f"""
    WITH p AS ({points_sql(src)})
    SELECT e.event_id, any_value(e.user) AS user, any_value(e.us) AS us, any_value(e.action) AS action,
      sum(CAST(greatest(0, q.p10 * {HOUR} - q.r10 * (e.us - q.us)) AS HUGEINT)) AS n
    FROM p e JOIN p q ON q.user = e.user AND q.us > e.us - {24 * HOUR}
      AND (q.us < e.us OR (q.us = e.us AND q.event_id <= e.event_id)) {extra}
    GROUP BY e.event_id"""


SCORED_SQL = f"SELECT event_id, user, us, action, CAST({score_sql('n')} AS DOUBLE) AS risk_score, {level_sql('n')} AS risk_level FROM ({asof_sql(G8)})"


@query("risk_points", f"SELECT event_id, CAST(p10 AS BIGINT) AS p10, CAST(r10 AS BIGINT) AS r10 FROM ({points_sql(S240)})")
def risk_points(s, d):
    return risk.risk_points(siem240(s, d)).select("event_id", "p10", "r10")


@query("risk_asof", f"SELECT event_id, user, us, risk_score, risk_level FROM ({SCORED_SQL})")
def risk_asof(s, d):
    e = ev8(s, d).select("event_id", "user", "us", "action", "severity")
    return risk.risk_asof(e).select("event_id", "user", "us", "risk_score", "risk_level")


def snapshot_sql(src: str, now: int) -> str:
    return f"""
    SELECT user, CAST({score_sql('n')} AS DOUBLE) AS risk_score, {level_sql('n')} AS risk_level FROM (
      SELECT user, sum(CAST(greatest(0, p10 * {HOUR} - r10 * ({now} - us)) AS HUGEINT)) AS n
      FROM ({points_sql(src)}) WHERE us > {now - 24 * HOUR} AND us <= {now} GROUP BY user)"""


@query("risk_snapshot", snapshot_sql(G8, NOW))
def risk_snapshot(s, d):
    return risk.risk_snapshot(ev8(s, d), NOW)


ISO_SQL = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%SZ')"
PROFILES_SQL = f"""
    SELECT user, arg_max(risk_score, us) AS risk_score, arg_max(risk_level, us) AS risk_level,
      {ISO_SQL.format('min(us)')} AS first_seen, {ISO_SQL.format('max(us)')} AS last_seen, count(*) AS total_events,
      count(*) FILTER (WHERE contains(action, 'block')) AS total_blocks,
      count(*) FILTER (WHERE contains(action, 'flag')) AS total_flags
    FROM ({SCORED_SQL}) GROUP BY user"""


@query("user_profiles", PROFILES_SQL)
def user_profiles(s, d):
    return risk.user_profiles(ev8(s, d))


TOP_SQL = f"""
    SELECT t.user, coalesce(n.risk_score, 0.0) AS risk_score, coalesce(n.risk_level, 'normal') AS risk_level,
      first_seen, last_seen, total_events, total_blocks, total_flags
    FROM (SELECT * FROM ({PROFILES_SQL}) ORDER BY risk_score DESC, user LIMIT 10) t
    LEFT JOIN ({snapshot_sql(G8, NOW)}) n USING (user)"""


@query("top_risk_users", TOP_SQL)
def top_risk_users(s, d):
    return risk.top_risk_users(ev8(s, d), NOW)


R8 = X.resets_sql(RISK_FACTOR)


@query("apply_resets", f"""
    SELECT event_id, user, us FROM ({G8}) e
    WHERE NOT EXISTS (SELECT 1 FROM ({R8}) r WHERE r.user = e.user AND r.us > e.us)""")
def apply_resets(s, d):
    return risk.apply_resets(ev8(s, d), X.resets(s, d, RISK_FACTOR)).select("event_id", "user", "us")


RESET_SCORED_SQL = f"""
    SELECT event_id, user, us, CAST({score_sql('n')} AS DOUBLE) AS risk_score, {level_sql('n')} AS risk_level FROM (
    {asof_sql(G8, f'AND NOT EXISTS (SELECT 1 FROM ({R8}) r WHERE r.user = e.user AND r.us > q.us AND r.us <= e.us)')})"""


@query("risk_asof_with_resets", RESET_SCORED_SQL)
def risk_asof_with_resets(s, d):
    e = ev8(s, d).select("event_id", "user", "us", "action", "severity")
    return risk.risk_asof_with_resets(e, X.resets(s, d, RISK_FACTOR)).select("event_id", "user", "us", "risk_score", "risk_level")


@query("currently_quarantined", f"SELECT user, risk_score, risk_level FROM ({snapshot_sql(G240, SIEM_NOW)}) WHERE risk_level = 'critical'")
def currently_quarantined(s, d):
    return risk.currently_quarantined(ev240(s, d), SIEM_NOW)


# ======================================================================= conversations

HIST_SQL = f"""
    SELECT e.event_id AS ev, e.user AS who, e.us AS ev_us, h.*, row_number() OVER (PARTITION BY e.event_id ORDER BY h.us, h.event_id) AS pos
    FROM (SELECT *, row_number() OVER (PARTITION BY user ORDER BY us, event_id) AS rn FROM ({G240})) e
    JOIN (SELECT *, row_number() OVER (PARTITION BY user ORDER BY us, event_id) AS rn FROM ({G240})) h
      ON h.user = e.user AND h.rn BETWEEN e.rn - 19 AND e.rn AND e.us - h.us < 900000000"""
SEV_SQL = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"
ACT_SQL = "CASE action WHEN 'dlp_flagged' THEN 2 WHEN 'dlp_block' THEN 4 WHEN 'egress_block' THEN 5 ELSE 0 END"
HCTE = f"WITH hist AS (SELECT * FROM ({HIST_SQL}) QUALIFY count(*) OVER (PARTITION BY ev) >= 3)"


@query("history", f"{HCTE} SELECT ev AS event_id, string_agg(event_id, ',' ORDER BY pos) AS recent FROM hist GROUP BY ev")
def history(s, d):
    h = conversation.history(ev240(s, d)).filter("size(recent) > 0")
    return h.select("event_id", F.array_join(F.transform("recent", lambda m: m["event_id"].cast("string")), ",").alias("recent"))


STEPS_SQL = f"""
    SELECT ev, any_value(who) AS who, any_value(ev_us) AS ev_us, count(*) AS n, count(*) FILTER (WHERE up) AS steps FROM (
      SELECT ev, who, ev_us, s > lag(s) OVER w OR a > lag(a) OVER w AS up
      FROM (SELECT *, {SEV_SQL} AS s, {ACT_SQL} AS a FROM hist) WINDOW w AS (PARTITION BY ev ORDER BY pos)) GROUP BY ev"""
PIVOT_SQL = """
    SELECT ev, count(*) FILTER (WHERE action = 'ai_inference' AND pos < fb) AS benign,
      count(*) FILTER (WHERE bad AND pos < coalesce(back, 99)) AS hostile
    FROM (SELECT *, min(CASE WHEN action = 'ai_inference' AND pos > fb THEN pos END) OVER (PARTITION BY ev) AS back
      FROM (SELECT *, coalesce(min(CASE WHEN bad THEN pos END) OVER (PARTITION BY ev), 99) AS fb
        FROM (SELECT *, action IN ('dlp_flagged', 'dlp_block', 'egress_block') AS bad FROM hist)))
    GROUP BY ev"""
STUCK_SQL = """
    SELECT ev, arg_min(rule, first) AS rule, arg_min(n, first) AS n FROM (
      SELECT ev, rule, min(pos) AS first, count(*) AS n FROM hist WHERE action IN ('dlp_block', 'dlp_flagged') GROUP BY ev, rule)
    WHERE n >= 3 GROUP BY ev"""


@query("escalation", f"{HCTE} SELECT ev AS event_id, steps FROM ({STEPS_SQL})")
def escalation(s, d):
    h = conversation.history(ev240(s, d)).filter("size(recent) > 0")
    return h.select("event_id", conversation.escalation_steps(F.col("recent")).alias("steps"))


@query("topic_pivot", f"{HCTE} SELECT ev AS event_id, benign, hostile FROM ({PIVOT_SQL})")
def topic_pivot(s, d):
    h = conversation.history(ev240(s, d)).filter("size(recent) > 0")
    return h.withColumn("_p", conversation.pivot_counts(F.col("recent"))).select("event_id", "_p.benign", "_p.hostile")


@query("persistence", f"{HCTE} SELECT ev AS event_id, rule, n FROM ({STUCK_SQL})")
def persistence(s, d):
    h = conversation.history(ev240(s, d)).filter("size(recent) > 0")
    return h.withColumn("_p", conversation.persistent_rule(F.col("recent"))).filter("_p is not null").select("event_id", "_p.rule", "_p.n")


def patterns_sql(at_action: str | None) -> str:
    arm = lambda k, i: f"'{V.PATTERN_TAGS[k][i]}'"
    only = f"WHERE ev IN (SELECT event_id FROM ({G240}) WHERE action = '{at_action}')" if at_action else ""
    return f"""{HCTE}
    SELECT ev AS event_id, who AS user, ev_us AS us, pattern,
      'User ''' || who || ''' ' || CASE pattern
        WHEN 'intent_escalation' THEN 'showed escalating threat severity across ' || n || ' recent messages'
        WHEN 'topic_pivot' THEN 'pivoted from ' || benign || ' benign to ' || hostile || ' hostile prompts'
        ELSE 'triggered ''' || rule || ''' ' || rn || ' times in recent history' END AS description,
      CASE pattern WHEN 'intent_escalation' THEN steps WHEN 'topic_pivot' THEN hostile ELSE rn END AS count,
      CASE pattern WHEN 'intent_escalation' THEN {arm('intent_escalation', 0)} WHEN 'topic_pivot' THEN {arm('topic_pivot', 0)} ELSE {arm('persistence', 0)} END AS mitre_attack,
      CASE pattern WHEN 'intent_escalation' THEN {arm('intent_escalation', 1)} WHEN 'topic_pivot' THEN {arm('topic_pivot', 1)} ELSE {arm('persistence', 1)} END AS mitre_atlas
    FROM (SELECT a.*, p.benign, p.hostile, k.rule, k.n AS rn,
        CASE WHEN steps >= 3 THEN 'intent_escalation' WHEN benign >= 2 AND hostile >= 2 THEN 'topic_pivot'
          WHEN k.rule IS NOT NULL THEN 'persistence' END AS pattern
      FROM ({STEPS_SQL}) a JOIN ({PIVOT_SQL}) p USING (ev) LEFT JOIN ({STUCK_SQL}) k USING (ev) {only})
    WHERE pattern IS NOT NULL"""


@query("detect_patterns", patterns_sql("ai_inference"))
def detect_patterns(s, d):
    return conversation.detect_patterns(ev240(s, d))


@query("detect_patterns_everywhere", patterns_sql(None))
def detect_patterns_everywhere(s, d):
    return conversation.detect_patterns(ev240(s, d), at_action=None)


@query("pattern_events", f"""
    SELECT event_id, user, us, action, 'high' AS severity, 'Multi-Turn: ' || pattern AS rule, pattern AS pattern_type
    FROM ({patterns_sql('ai_inference')}) CROSS JOIN (VALUES ('multi_turn_pattern'), ('dlp_flagged')) t(action)""")
def pattern_events(s, d):
    p = conversation.pattern_events(conversation.detect_patterns(ev240(s, d)))
    return p.select("event_id", "user", "us", "action", "severity", "rule", "pattern_type")


@query("user_history", f"""
    SELECT event_id, us, left(prompt_preview, 200) AS prompt, action, severity, rule, layer FROM ({G240})
    WHERE user = '7' ORDER BY us DESC, event_id DESC LIMIT 20""")
def user_history(s, d):
    return conversation.user_history(ev240(s, d), "7")


@query("active_users", f"SELECT user, max(us) AS last_us FROM ({G240}) GROUP BY user ORDER BY last_us DESC, user LIMIT 1000")
def active_users(s, d):
    return conversation.active_users(ev240(s, d))


# ======================================================================= responses

PACE = 2500  # squeezes scored requests further, so that buckets run dry


def paced_requests(s, d):
    """Scored requests (with resets) at a pace that makes the token bucket refuse some."""
    e = ev8(s, d).select("event_id", "user", "us", "action", "severity")
    scored = risk.risk_asof_with_resets(e, X.resets(s, d, RISK_FACTOR)).drop("epoch")
    return scored.withColumn("us", (F.lit(X.BASE_US) + F.floor((F.col("us") - X.BASE_US) / PACE)).cast("long"))


def paced_unblocks(s, d):
    return X.resets(s, d, RISK_FACTOR).withColumn(
        "us", (F.lit(X.BASE_US) + F.floor((F.col("us") - X.BASE_US) / PACE)).cast("long")
    )


PACED_SQL = f"SELECT event_id, user, {X.BASE_US} + (us - {X.BASE_US}) // {PACE} AS us, risk_score, risk_level FROM ({RESET_SCORED_SQL})"
UNBLOCK_SQL = f"SELECT DISTINCT user, {X.BASE_US} + (us - {X.BASE_US}) // {PACE} AS us FROM ({R8})"
STICKY_SQL = f"""
    SELECT e.*, bool_or(risk_level = 'critical') OVER (PARTITION BY user, epoch ORDER BY us, event_id) AS quarantined FROM (
      SELECT q.*, (SELECT count(*) FROM ({UNBLOCK_SQL}) u WHERE u.user = q.user AND u.us <= q.us) AS epoch
      FROM ({PACED_SQL}) q) e"""


@query("sticky_quarantine", f"SELECT event_id, user, us, epoch, quarantined FROM ({STICKY_SQL})")
def sticky_quarantine(s, d):
    r = respond.sticky_quarantine(paced_requests(s, d), paced_unblocks(s, d))
    return r.select("event_id", "user", "us", "epoch", "quarantined")


def bucket_sql(src: str) -> str:
    """Refill and spend one request at a time, in units of 1/12,000,000 token (one token = 12 s)."""
    return f"""
    WITH RECURSIVE q AS MATERIALIZED (SELECT user, epoch, us, event_id, row_number() OVER (PARTITION BY user, epoch ORDER BY us, event_id) AS rn FROM ({src})),
    b AS (
      SELECT user, epoch, rn, us, event_id, true AS token, CAST(48000000 AS BIGINT) AS level FROM q WHERE rn = 1
      UNION ALL
      SELECT q.user, q.epoch, q.rn, q.us, q.event_id,
        least(60000000, b.level + q.us - b.us) >= 12000000,
        CASE WHEN least(60000000, b.level + q.us - b.us) >= 12000000 THEN least(60000000, b.level + q.us - b.us) - 12000000
          ELSE least(60000000, b.level + q.us - b.us) END
      FROM b JOIN q ON q.user = b.user AND q.epoch = b.epoch AND q.rn = b.rn + 1)
    SELECT event_id, token FROM b"""


RATE_FACTOR = 5000


@query("token_bucket", bucket_sql(f"SELECT event_id, user, us, 0 AS epoch FROM ({X.gateway_sql(RATE_FACTOR)})"))
def token_bucket_query(s, d):
    e = X.gateway_events(s, d, RATE_FACTOR).select("event_id", "user", "us")
    return token_bucket.token_bucket(e, ("user",)).select("event_id", "token")


ENFORCE_SQL = f"""
    WITH g AS MATERIALIZED ({STICKY_SQL}),
    t AS ({bucket_sql("SELECT * FROM g WHERE risk_level = 'high' AND NOT quarantined")})
    SELECT g.*, decision, decision = 'allowed' AND risk_level IN ('high', 'elevated') AS downgraded FROM (
      SELECT g.*, CASE WHEN quarantined THEN 'quarantined' WHEN token = false THEN 'rate_limited' ELSE 'allowed' END AS decision
      FROM g LEFT JOIN t USING (event_id)) g"""


@query("enforce", f"SELECT event_id, user, risk_level, decision, downgraded FROM ({ENFORCE_SQL})")
def enforce(s, d):
    return respond.enforce(paced_requests(s, d), paced_unblocks(s, d)).select("event_id", "user", "risk_level", "decision", "downgraded")


AUDIT_SQL = f"""
    WITH d AS MATERIALIZED ({ENFORCE_SQL}),
    q AS (SELECT user, epoch, 'quarantine' AS action, min(us) AS us FROM d WHERE decision = 'quarantined' GROUP BY user, epoch)
    SELECT user, action, us FROM q
    UNION ALL SELECT user, 'rate_limit_applied', min(us) FROM d WHERE risk_level = 'high' AND decision <> 'quarantined' GROUP BY user, epoch
    UNION ALL SELECT user, 'model_downgrade', min(us) FROM d WHERE downgraded GROUP BY user, epoch
    UNION ALL SELECT u.user, 'unblocked', u.us FROM (
      SELECT user, us, row_number() OVER (PARTITION BY user ORDER BY us) AS no FROM ({UNBLOCK_SQL})) u
      JOIN q ON q.user = u.user AND q.epoch = u.no - 1"""


@query("audit_log", f"""
    SELECT *, CASE WHEN action = 'model_downgrade' THEN {q_(V.DOWNGRADE_MODEL)} END AS forced_model FROM ({AUDIT_SQL})""")
def audit_log(s, d):
    u = paced_unblocks(s, d)
    return respond.audit_log(respond.enforce(paced_requests(s, d), u), u).select("user", "action", "us", "forced_model")


@query("audit_tail", f"SELECT * FROM ({AUDIT_SQL}) ORDER BY us DESC, user, action LIMIT 50")
def audit_tail(s, d):
    return respond.audit_tail(audit_log(s, d).drop("forced_model"))


HELD_SQL = f"""
    SELECT DISTINCT d.user FROM ({ENFORCE_SQL}) d
    WHERE decision = 'quarantined' AND epoch = (SELECT count(*) FROM ({UNBLOCK_SQL}) u WHERE u.user = d.user)"""


@query("quarantined_users", HELD_SQL)
def quarantined_users(s, d):
    u = paced_unblocks(s, d)
    return respond.quarantined_users(respond.enforce(paced_requests(s, d), u), u)


@query("response_events", f"""
    SELECT event_id, user, us, CASE decision WHEN 'quarantined' THEN 'user_quarantined' ELSE 'user_rate_limited' END AS action,
      risk_score, CASE WHEN decision = 'quarantined' THEN risk_level END AS risk_level
    FROM ({ENFORCE_SQL}) WHERE decision <> 'allowed'""")
def response_events(s, d):
    return respond.response_events(respond.enforce(paced_requests(s, d), paced_unblocks(s, d)))


# ======================================================================= searches

TICK = 300 * MICROS


def sliding_sql(src: str, ticks: int) -> str:
    return f"""SELECT *, (us // {TICK} - unnest(range(0, {ticks}))) * {TICK} AS start_us FROM ({src})"""


RULES_SQL = "array_to_string(list_sort(list_distinct(list(rule))), '|') AS rules"
BRUTE_SQL = f"""
    SELECT start_us, start_us + {TICK} AS end_us, user, count(*) AS block_count, {RULES_SQL}
    FROM ({sliding_sql(G240, 1)}) WHERE action = 'dlp_block' GROUP BY start_us, user HAVING count(*) >= 3"""
PROBE_SQL = f"""
    SELECT * FROM (SELECT start_us, start_us + {2 * TICK} AS end_us, user, count(*) FILTER (WHERE action = 'dlp_block') AS blocks,
      count(*) FILTER (WHERE action = 'dlp_flagged') AS flags, {RULES_SQL}
    FROM ({sliding_sql(G240, 2)}) WHERE action IN ('dlp_block', 'dlp_flagged') GROUP BY start_us, user) WHERE blocks >= 1 AND flags >= 2"""
SLOW_SQL = f"""
    SELECT start_us, start_us + {3 * TICK} AS end_us, user, count(*) AS flag_count, {RULES_SQL}
    FROM ({sliding_sql(G240, 3)}) WHERE action = 'dlp_flagged' GROUP BY start_us, user HAVING count(*) >= 5"""


@query("brute_force", BRUTE_SQL)
def brute_force(s, d):
    return searches.brute_force(ev240(s, d))


@query("probe_strike", PROBE_SQL)
def probe_strike(s, d):
    return searches.probe_strike(ev240(s, d))


@query("slow_exfil", SLOW_SQL)
def slow_exfil(s, d):
    return searches.slow_exfil(ev240(s, d))


@query("slow_exfil_without_blocks", f"""
    SELECT start_us, start_us + {3 * TICK} AS end_us, user, count(*) FILTER (WHERE action = 'dlp_flagged') AS flag_count,
      array_to_string(list_sort(list_distinct(list(rule) FILTER (WHERE action = 'dlp_flagged'))), '|') AS rules
    FROM ({sliding_sql(G240, 3)}) WHERE action IN ('dlp_block', 'dlp_flagged') GROUP BY start_us, user
    HAVING count(*) FILTER (WHERE action = 'dlp_flagged') >= 5 AND count(*) FILTER (WHERE action = 'dlp_block') = 0""")
def slow_exfil_without_blocks(s, d):
    return searches.slow_exfil(ev240(s, d), require_no_blocks=True)


@query("alert_prompts", f"""
    SELECT DISTINCT e.user, e.prompt_preview, e.start_us FROM ({sliding_sql(G240, 2)}) e
    JOIN ({PROBE_SQL}) a USING (user, start_us) WHERE e.action IN ('dlp_block', 'dlp_flagged')""")
def alert_prompts(s, d):
    e = ev240(s, d)
    return searches.alert_prompts(e, searches.probe_strike(e), "probe_strike")


def suppress_sql(alerts: str, minutes: int) -> str:
    gap = minutes * 60 * MICROS
    return f"""
    WITH RECURSIVE a AS MATERIALIZED ({alerts}),
    f AS (SELECT user, min(end_us) AS t FROM a GROUP BY user
      UNION ALL SELECT f.user, min(a.end_us) FROM f JOIN a ON a.user = f.user AND a.end_us >= f.t + {gap} GROUP BY f.user, f.t)
    SELECT a.* FROM a JOIN f ON f.user = a.user AND f.t = a.end_us"""


@query("suppress_brute_force", suppress_sql(BRUTE_SQL, 10))
def suppress_brute_force(s, d):
    return searches.suppress(brute_force(s, d), V.SUPPRESS_MINUTES["brute_force"])


@query("suppress_probe_strike", suppress_sql(PROBE_SQL, 15))
def suppress_probe_strike(s, d):
    return searches.suppress(probe_strike(s, d), V.SUPPRESS_MINUTES["probe_strike"])


@query("suppress_slow_exfil", suppress_sql(SLOW_SQL, 20))
def suppress_slow_exfil(s, d):
    return searches.suppress(slow_exfil(s, d), V.SUPPRESS_MINUTES["slow_exfil"])


BEHAVIOR_LIST = ", ".join(q_(a) for a in V.BEHAVIOR_ACTIONS)


def behavior_sql(minutes: int) -> str:
    w = minutes * 60 * MICROS
    return f"""
    SELECT * FROM (SELECT *, 100 * crit_count + 50 * high_count + 25 * med_count + 10 * low_count AS risk_score,
      CASE WHEN crit_count >= 1 THEN 'CRITICAL_BREACH' WHEN high_count >= 3 THEN 'HIGH_BEHAVIORAL_RISK'
        WHEN med_count >= 5 THEN 'MEDIUM_BEHAVIORAL_RISK' WHEN low_count >= 7 THEN 'LOW_BEHAVIORAL_RISK' ELSE 'NOMINAL' END AS risk_status
    FROM (SELECT us // {w} * {w} AS start_us, us // {w} * {w} + {w} AS end_us, user,
        count(*) FILTER (WHERE severity = 'critical') AS crit_count, count(*) FILTER (WHERE severity = 'high') AS high_count,
        count(*) FILTER (WHERE severity = 'medium') AS med_count, count(*) FILTER (WHERE severity = 'low') AS low_count,
        arg_max(prompt_preview, us) AS last_prompt, array_to_string(list_sort(list_distinct(list(rule))), '|') AS triggered_rules
      FROM ({S240}) WHERE action IN ({BEHAVIOR_LIST}) GROUP BY ALL))
    WHERE risk_status <> 'NOMINAL'"""


def rolling_sql(seconds: int) -> str:
    span = seconds * MICROS
    counts = ", ".join(
        f"count(*) FILTER (WHERE e.severity = '{s}') AS {n}_count"
        for s, n in (("critical", "crit"), ("high", "high"), ("medium", "med"), ("low", "low"))
    )
    return f"""
    WITH e AS MATERIALIZED (SELECT * FROM ({S240}) WHERE action IN ({BEHAVIOR_LIST}))
    SELECT * FROM (SELECT *, 100 * crit_count + 50 * high_count + 25 * med_count + 10 * low_count AS risk_score,
      CASE WHEN crit_count >= 1 THEN 'CRITICAL_BREACH' WHEN high_count >= 3 THEN 'HIGH_BEHAVIORAL_RISK'
        WHEN med_count >= 5 THEN 'MEDIUM_BEHAVIORAL_RISK' WHEN low_count >= 7 THEN 'LOW_BEHAVIORAL_RISK' ELSE 'NOMINAL' END AS risk_status
    FROM (SELECT t.us - {span} + 1 AS start_us, t.us AS end_us, t.user, {counts},
        arg_max(e.prompt_preview, (e.us, e.event_id)) AS last_prompt, array_to_string(list_sort(list_distinct(list(e.rule))), '|') AS triggered_rules
      FROM (SELECT DISTINCT user, us FROM e) t JOIN e ON e.user = t.user AND e.us > t.us - {span} AND e.us <= t.us
      GROUP BY t.user, t.us))
    WHERE risk_status <> 'NOMINAL'"""


@query("behavioral_risk", rolling_sql(120))
def behavioral_risk(s, d):
    return searches.behavioral_risk(siem240(s, d))


@query("behavioral_risk_windows", behavior_sql(2))
def behavioral_risk_windows(s, d):
    return searches.behavioral_risk_windows(siem240(s, d))


@query("behavioral_risk_hourly", behavior_sql(60))
def behavioral_risk_hourly(s, d):
    return searches.behavioral_risk_windows(siem240(s, d), "60 minutes")


DAY_SQL = f"us >= {SIEM_NOW - 24 * HOUR} AND us < {SIEM_NOW}"


@query("flagged_count", f"SELECT count(*) AS n FROM ({G240}) WHERE action = 'dlp_flagged' AND {DAY_SQL}")
def flagged_count(s, d):
    return searches.flagged_count(ev240(s, d), SIEM_NOW)


@query("allowed_count", f"SELECT count(*) AS n FROM ({G240}) WHERE action = 'ai_inference' AND {DAY_SQL}")
def allowed_count(s, d):
    return searches.allowed_count(ev240(s, d), SIEM_NOW)


@query("latest_alerts", f"""
    SELECT us, event_id, user, action, rule, severity, prompt_preview FROM ({G240})
    WHERE action IN ('dlp_block', 'dlp_flagged') AND {DAY_SQL} ORDER BY us DESC, event_id DESC LIMIT 20""")
def latest_alerts(s, d):
    return searches.latest_alerts(ev240(s, d), SIEM_NOW)


@query("allowed_trend", f"""
    WITH n AS (SELECT us // {15 * 60 * MICROS} * {15 * 60 * MICROS} AS start_us, count(*) AS n FROM ({G240}) WHERE action = 'ai_inference' GROUP BY 1)
    SELECT a.start_us, a.n, a.n - coalesce(b.n, 0) AS delta FROM n a LEFT JOIN n b ON b.start_us = a.start_us - {15 * 60 * MICROS}""")
def allowed_trend(s, d):
    return searches.allowed_trend(ev240(s, d), 15)


@query("block_redact_log", f"""
    SELECT us, event_id, user, action, rule, severity, prompt_preview FROM ({G240}) WHERE action IN ('dlp_block', 'dlp_redact')""")
def block_redact_log(s, d):
    return searches.block_redact_log(ev240(s, d))


# ======================================================================= rule tree

def _desc_sql(template: str) -> str:
    parts, rest = [], template.replace("{product}", "Gateway")
    while "$(" in rest:
        head, _, tail = rest.partition("$(")
        name, _, rest = tail.partition(")")
        parts += [q_(head), f"coalesce({name}, '')"]
    return " || ".join(parts + [q_(rest)])


def _match_arms(kinds: str) -> list[str]:
    pick = "event_id, user, us"
    arms, pos = [], 0
    if "b" in kinds:
        rid, level, t, groups, tags = V.BASE_RULE
        arms.append(f"SELECT {pick}, {rid} AS rule_id, {level} AS level, {_desc_sql(t)} AS description, 0 AS pos, '' AS techniques, '' AS groups FROM s WHERE source = 'ai-gateway'")
    for rid, level, sev, t, groups, tags in V.SEVERITY_RULES:
        pos += 1
        if "s" in kinds:
            arms.append(f"SELECT {pick}, {rid} AS rule_id, {level} AS level, {_desc_sql(t)} AS description, {pos} AS pos, {q_(','.join(tags))} AS techniques, {q_(','.join(groups))} AS groups FROM s WHERE source = 'ai-gateway' AND severity = '{sev}'")
    for rid, level, act, layer, t, groups, tags in V.ACTION_RULES:
        pos += 1
        if "a" in kinds:
            more = f"AND layer = '{layer}'" if layer else ""
            arms.append(f"SELECT {pick}, {rid} AS rule_id, {level} AS level, {_desc_sql(t)} AS description, {pos} AS pos, {q_(','.join(tags))} AS techniques, {q_(','.join(groups))} AS groups FROM s WHERE source = 'ai-gateway' AND action = '{act}' {more}")
    return arms


def matches_sql(kinds: str) -> str:
    return f"WITH s AS MATERIALIZED ({S240}) " + " UNION ALL ".join(_match_arms(kinds))


_M = ["event_id", "user", "us", "rule_id", "level", "description"]
_MS = ", ".join(_M)


@query("match_base", f"SELECT {_MS} FROM ({matches_sql('b')})")
def match_base(s, d):
    return ruletree.match_base(siem240(s, d)).select(*_M)


@query("match_severity", f"SELECT {_MS} FROM ({matches_sql('s')})")
def match_severity(s, d):
    return ruletree.match_severity(siem240(s, d)).select(*_M)


@query("match_action", f"SELECT {_MS} FROM ({matches_sql('a')})")
def match_action(s, d):
    return ruletree.match_action(siem240(s, d)).select(*_M)


@query("match_all", f"SELECT {_MS} FROM ({matches_sql('bsa')})")
def match_all(s, d):
    return ruletree.match_all(siem240(s, d)).select(*_M)


BEST_SQL = f"SELECT {_MS} FROM ({matches_sql('bsa')}) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY level DESC, pos) = 1"


@query("match_best", BEST_SQL)
def match_best(s, d):
    return ruletree.match_best(siem240(s, d)).select(*_M)


def frequency_sql() -> str:
    arms = []
    for rid, level, times, span, parent, t, groups, tags in V.FREQUENCY_RULES:
        arms.append(f"""
        SELECT event_id, any_value(user) AS user, any_value(us) AS us, {rid} AS rule_id, {level} AS level, count(*) AS matches, any_value(descr) AS description
        FROM (SELECT a.event_id, a.user, a.us, {_desc_sql(t).replace('coalesce(user', 'coalesce(a.user')} AS descr
          FROM m a JOIN m b ON b.user = a.user AND b.rule_id = {parent} AND b.us BETWEEN a.us - {span * MICROS} AND a.us WHERE a.rule_id = {parent})
        GROUP BY event_id HAVING count(*) >= {times}""")
    return f"WITH m AS MATERIALIZED ({matches_sql('bsa')}) " + " UNION ALL ".join(arms)


@query("frequency_rules", frequency_sql())
def frequency_rules(s, d):
    return ruletree.frequency_rules(siem240(s, d)).drop("techniques")


@query("high_risk_score", f"SELECT event_id, risk_score, '100101s' AS rule_id, 12 AS level FROM ({S240}) WHERE regexp_matches(risk_score, '^([0-9]{{3,}}|[89][0-9])$')")
def high_risk_score(s, d):
    return ruletree.high_risk_score(siem240(s, d)).select("event_id", "risk_score", "rule_id", "level")


@query("technique_tags", f"SELECT event_id, rule_id, unnest(string_split(techniques, ',')) AS technique FROM ({matches_sql('bsa')}) WHERE techniques <> ''")
def technique_tags(s, d):
    return ruletree.technique_tags(ruletree.match_all(siem240(s, d))).select("event_id", "rule_id", "technique")


@query("group_tags", f"SELECT event_id, rule_id, unnest(string_split(groups, ',')) AS rule_group FROM ({matches_sql('bsa')}) WHERE groups <> ''")
def group_tags(s, d):
    return ruletree.group_tags(ruletree.match_all(siem240(s, d))).select("event_id", "rule_id", "rule_group")


@query("route_alerts", f"""
    SELECT event_id, rule_id, level, CASE WHEN level >= 12 AND rn <= 12 THEN 'notify' WHEN level >= 3 THEN 'log' ELSE 'drop' END AS route
    FROM (SELECT *, row_number() OVER (PARTITION BY level >= 12, us // {HOUR} ORDER BY us, event_id, rule_id) AS rn FROM ({BEST_SQL}))""")
def route_alerts(s, d):
    return ruletree.route_alerts(ruletree.match_best(siem240(s, d))).select("event_id", "rule_id", "level", "route")


# ======================================================================= cases

CASE_SEV = lambda i: f"CASE WHEN level <= 6 THEN {['2', q_('Low')][i]} WHEN level <= 9 THEN {['3', q_('Medium')][i]} WHEN level <= 12 THEN {['4', q_('High')][i]} WHEN level <= 19 THEN {['5', q_('Critical')][i]} ELSE {['3', q_('Medium')][i]} END"


@query("case_severity", f"SELECT event_id, level, {CASE_SEV(0)} AS severity_id, {CASE_SEV(1)} AS severity_name FROM ({BEST_SQL})")
def case_severity(s, d):
    m = ruletree.match_best(siem240(s, d)).withColumn("_c", cases.case_severity(F.col("level")))
    return m.select("event_id", "level", F.col("_c.id").alias("severity_id"), F.col("_c.name").alias("severity_name"))


@query("case_records", f"""
    SELECT event_id, 'Gateway: ' || description AS alert_title, 'rule-' || rule_id AS alert_source_ref, {CASE_SEV(0)} AS alert_severity_id,
      'siem,gateway,' || severity || ',' || action AS alert_tags, CAST(us AS VARCHAR) AS alert_source_event_time,
      '**Rule ID:** ' || rule_id || ' (Level ' || level || ')' || chr(10) || '**Agent:** manager' || chr(10) || '**Timestamp:** ' || us
        || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '**Action:** `' || action || '`' || chr(10) || '**Severity:** `' || upper(severity)
        || '`' || chr(10) || '**DLP Rule Triggered:** `' || rule || '`' || chr(10) || '**User ID:** `' || user || '`' || chr(10)
        || '**Prompt Preview:** `' || prompt_preview || '`' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
        || '**Investigation Links:**' || chr(10) || '- [User history](https://siem.local/search?q=user%3D%22' || user || '%22)' || chr(10)
        || '- [Endpoint](https://console.local)' AS alert_description
    FROM ({BEST_SQL}) b JOIN (SELECT event_id, severity, action, rule, prompt_preview FROM ({S240})) USING (event_id)""")
def case_records(s, d):
    m = ruletree.match_best(siem240(s, d)).drop("groups", "techniques")
    c = cases.case_records(m)
    key = F.get_json_object("alert_source_content", "$.event_id").cast("long").alias("event_id")
    return c.select(key, "alert_title", "alert_source_ref", "alert_severity_id", "alert_tags", "alert_source_event_time", "alert_description")


@query("violation_records", f"""
    SELECT event_id, 'CASB Violation: ' || rule AS title, 'No details provided.' AS description, upper(severity) AS severity, 'Gateway' AS source,
      'AI_SECURITY,CASB,DLP' AS tags, user, layer, 'blocked' AS action FROM ({G240}) WHERE action = 'dlp_block'""")
def violation_records(s, d):
    return cases.violation_records(ev240(s, d).filter("action = 'dlp_block'"))


# ======================================================================= endpoints

def _any_sql(c: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {q_(n)})" for n in needles) + ")"


@query("shadow_ai_dns", f"""
    SELECT row_id, query_name, 100200 AS rule_id FROM ({X.ENDPOINT_SQL}) WHERE event_id = 22 AND {_any_sql('query_name', V.SHADOW_AI_DOMAINS)}""")
def shadow_ai_dns(s, d):
    return endpoint.shadow_ai_dns(X.endpoint_events(s, d)).select("row_id", "query_name", "rule_id")


@query("shadow_ai_processes", f"""
    SELECT row_id, image, command_line FROM ({X.ENDPOINT_SQL}) WHERE event_id = 1
      AND ({_any_sql('image', V.SHADOW_AI_IMAGES)} OR {_any_sql('command_line', V.SHADOW_AI_COMMANDS)})""")
def shadow_ai_processes(s, d):
    return endpoint.shadow_ai_processes(X.endpoint_events(s, d)).select("row_id", "image", "command_line")


@query("shadow_ai_connections", f"""
    SELECT row_id, destination_hostname FROM ({X.ENDPOINT_SQL}) WHERE event_id = 3 AND {_any_sql('destination_hostname', V.SHADOW_AI_HOSTS)}""")
def shadow_ai_connections(s, d):
    return endpoint.shadow_ai_connections(X.endpoint_events(s, d)).select("row_id", "destination_hostname")


@query("endpoint_baseline", f"""
    SELECT row_id, event_id FROM ({X.ENDPOINT_SQL}) WHERE (event_id = 1 AND integrity_level <> 'System')
      OR (event_id = 3 AND destination_port IN (80, 443)) OR (event_id = 22 AND {_any_sql('query_name', V.SHADOW_AI_DOMAINS_SHORT)})""")
def endpoint_baseline(s, d):
    return endpoint.endpoint_baseline(X.endpoint_events(s, d)).select("row_id", "event_id")


@query("security_channel_filter", f"""
    SELECT row_id, event_id FROM ({X.ENDPOINT_SQL}) WHERE event_id NOT IN ({', '.join(map(str, V.NOISY_EVENT_IDS))})""")
def security_channel_filter(s, d):
    return endpoint.security_channel_filter(X.endpoint_events(s, d)).select("row_id", "event_id")


@query("unproxied_editor_launches", f"""
    SELECT row_id, command_line FROM ({X.ENDPOINT_SQL}) WHERE event_id = 1 AND image LIKE '%Code.exe'
      AND NOT (contains(command_line, '--extensions-dir') AND contains(command_line, '--proxy-server'))""")
def unproxied_editor_launches(s, d):
    return endpoint.unproxied_editor_launches(X.endpoint_events(s, d)).select("row_id", "command_line")


# ======================================================================= identity and governance

ROLE_SQL = "CASE gid WHEN 5001 THEN 'developer' ELSE 'standard' END"


@query("attach_identity", f"""
    SELECT e.event_id, e.user, i.uid, CASE WHEN i.user IS NOT NULL THEN {ROLE_SQL} END AS role
    FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'copilot_user' ELSE user END AS user FROM ({G240})) e
    LEFT JOIN ({X.IDENTITY_SQL}) i USING (user)""")
def attach_identity(s, d):
    e = ev240(s, d).withColumn("user", F.when(F.col("event_id") % 11 != 0, F.col("user")))
    return governance.attach_identity(e, X.identity(s, d)).select("event_id", "user", "uid", "role")


ADMIN_SQL = ", ".join(q_(r) for r in X.ADMIN_RULES)


@query("rbac_gate", f"""
    SELECT event_id, user, CASE WHEN role IS NULL OR (admin AND role = 'standard') THEN 'block' ELSE 'allow' END AS rbac,
      CASE WHEN role IS NULL OR (admin AND role = 'standard') THEN 'dlp_block' WHEN admin THEN 'dlp_monitor' ELSE 'ai_inference' END AS rbac_action
    FROM (SELECT e.event_id, e.user, rule IN ({ADMIN_SQL}) AS admin, CASE WHEN i.user IS NOT NULL THEN {ROLE_SQL} END AS role
      FROM ({G240}) e LEFT JOIN ({X.IDENTITY_SQL}) i USING (user))""")
def rbac_gate(s, d):
    e = governance.attach_identity(ev240(s, d), X.identity(s, d)).withColumn("is_admin", F.col("rule").isin(*X.ADMIN_RULES))
    return governance.rbac_gate(e).select("event_id", "user", "rbac", "rbac_action")


MATRIX_SQL = ", ".join(f"({q_(i)}, {q_(n)}, {str(c).lower()}, {q_(layer)})" for i, n, c, layer in V.TECHNIQUES)
COVERAGE_SQL = f"""
    SELECT id, name, covered, layer, coalesce(n, 0) AS alerts, NOT covered AS gap FROM (VALUES {MATRIX_SQL}) t(id, name, covered, layer)
    LEFT JOIN (SELECT technique AS id, count(*) AS n FROM (
      SELECT unnest(string_split(techniques, ',')) AS technique FROM ({matches_sql('bsa')}) WHERE techniques <> '') GROUP BY 1) USING (id)"""


@query("technique_coverage", COVERAGE_SQL)
def technique_coverage(s, d):
    return governance.technique_coverage(ruletree.match_all(siem240(s, d)))


@query("compliance_report", f"""
    SELECT 'risk_user' AS section, user AS item, risk_level AS detail, risk_score AS number FROM ({TOP_SQL})
    UNION ALL SELECT 'quarantined', user, '', 1.0 FROM ({HELD_SQL})
    UNION ALL SELECT 'response', user, action, CAST(us AS DOUBLE) FROM (SELECT * FROM ({AUDIT_SQL}) ORDER BY us DESC, user, action LIMIT 20)
    UNION ALL SELECT 'technique', id, CASE WHEN covered THEN 'covered' ELSE 'gap' END, CAST(alerts AS DOUBLE) FROM ({COVERAGE_SQL})""")
def compliance_report(s, d):
    u = paced_unblocks(s, d)
    decided = landed(respond.enforce(paced_requests(s, d), u), "decisions")
    log = respond.audit_log(decided, u)
    return governance.compliance_report(ev8(s, d), decided, log, u, ruletree.match_all(siem240(s, d)), NOW)


@query("training_set", f"SELECT text, min(label) AS label, count(*) AS copies FROM ({X.LABELLED_SQL}) GROUP BY text")
def training_set(s, d):
    return governance.training_set(X.labelled(s, d))


@query("training_selection", f"""
    WITH p AS (SELECT text, label, length(text) AS n FROM ({X.LABELLED_SQL})),
    s AS (SELECT text, label, max(1 - pow(0.5, {_LEX})) AS sc FROM (
      SELECT text, label, substring(text, CAST(i AS INT) + 1, 512) AS w FROM (
        SELECT DISTINCT text, label, n, unnest(range(0, n, 448)) AS i FROM p WHERE n > 10)) GROUP BY text, label),
    w AS (SELECT p.text, p.label, CASE WHEN coalesce(sc, 0) >= 0.5 THEN 'false_alarm' ELSE 'missed' END AS reason
      FROM p LEFT JOIN s ON s.text = p.text AND s.label = p.label WHERE (p.label = 'INJECTION') <> (coalesce(sc, 0) >= 0.5))
    SELECT folded, min(label) AS label, min(text) AS text, count(*) AS copies FROM (
      SELECT *, lower(trim(regexp_replace(translate(regexp_replace(text, {INVIS_SQL}, '', 'g'),
        {q_(V.CONFUSABLE_FROM)}, {q_(V.CONFUSABLE_TO)}), {SPACE_SQL}, ' ', 'g'))) AS folded FROM w)
    GROUP BY folded""")
def training_selection(s, d):
    scored = classify.score_injection(X.labelled(s, d).withColumnRenamed("label", "truth"), threshold=0.5)
    return governance.training_selection(scored, label="truth")


@query("train_injection_model")
def train_injection_model(s, d):
    """Fit on the labelled documents, score every document with the model."""
    model = classify.train_injection_model(governance.training_set(X.labelled(s, d)))
    return classify.apply_injection_model(model, X.table(s, d, "documents").select("doc_id", "text"))


# ======================================================================= closed loop

LOOP_STEP_US = 20 * 60 * MICROS


def loop_requests(s, d):
    """Every prompt as a request, one per 20 minutes, inspected in full."""
    p = X.prompts(s, d).select(
        F.col("prompt_id").alias("event_id"), "user", "text",
        (F.lit(X.BASE_US) + F.col("prompt_id") * LOOP_STEP_US).alias("us"),
    )
    return replay.as_requests(gateway.inspect_ingress(p, compiled(s, "ingress"), compat=False))


@query("replay_gateway")
def replay_gateway(s, d):
    return replay.replay_gateway(loop_requests(s, d))


# ======================================================================= streams

def closed_sql(src: str) -> str:
    """The watermark after the last row: 10 minutes before the newest event, whole milliseconds."""
    return f"((SELECT max(us) FROM ({src})) // 1000 * 1000 - 600000000)"


def stream240(s, d, name):
    return streams.as_stream(s, siem240(s, d), name)


@query("brute_force_stream", f"SELECT * FROM ({BRUTE_SQL}) WHERE end_us <= {closed_sql(G240)}")
def brute_force_stream(s, d):
    src = streams.as_stream(s, ev240(s, d), "brute")
    return streams.run_available(s, searches.brute_force(streams.deduplicated(src)), "brute")


@query("probe_strike_stream", f"SELECT * FROM ({PROBE_SQL}) WHERE end_us <= {closed_sql(G240)}")
def probe_strike_stream(s, d):
    return streams.run_available(s, searches.probe_strike(streams.as_stream(s, ev240(s, d), "probe")), "probe")


@query("slow_exfil_stream", f"SELECT * FROM ({SLOW_SQL}) WHERE end_us <= {closed_sql(G240)}")
def slow_exfil_stream(s, d):
    return streams.run_available(s, searches.slow_exfil(streams.as_stream(s, ev240(s, d), "slow")), "slow")


@query("behavioral_risk_stream", f"SELECT * FROM ({behavior_sql(2)}) WHERE end_us <= {closed_sql(S240)}")
def behavioral_risk_stream(s, d):
    return streams.run_available(s, searches.behavioral_risk_windows(stream240(s, d, "behavior")), "behavior")


@query("risk_stream", f"SELECT event_id, us, risk_score, risk_level FROM ({SCORED_SQL}) WHERE us <= {closed_sql(G8)}")
def risk_stream(s, d):
    e = ev8(s, d).select("event_id", "user", "us", "action", "severity")
    return streams.run_available(s, streams.risk_stream(streams.as_stream(s, e, "risk")), "risk")


@query("detect_patterns_stream", f"SELECT * FROM ({patterns_sql('ai_inference')}) WHERE us <= {closed_sql(G240)}")
def detect_patterns_stream(s, d):
    return streams.run_available(s, streams.detect_patterns_stream(streams.as_stream(s, ev240(s, d), "talk")), "talk")


@query("frequency_rules_stream", f"""
    SELECT event_id, user, us, rule_id, level, matches FROM ({frequency_sql()}) WHERE us <= {closed_sql(f"SELECT us FROM ({S240}) WHERE source = 'ai-gateway'")}""")
def frequency_rules_stream(s, d):
    src = streams.as_stream(s, siem240(s, d).filter("source = 'ai-gateway'"), "freq")
    return streams.run_available(s, streams.frequency_rules_stream(src), "freq")


@query("alert_jsonl", BRUTE_SQL)
def alert_jsonl(s, d):
    """Alerts through the JSON-lines sink; a batch that is written again replaces its own lines."""
    alerts = searches.brute_force(ev240(s, d))
    path = scratch_dir(s, "alerts")
    sink = feed.alert_sink(path, "brute_force")
    sink(alerts.limit(0), 1)
    for _ in range(2):
        sink(alerts, 0)
    return s.read.schema(alerts.schema).json(f"{path}/query=brute_force").select(*alerts.columns)


@query("egress_events_stream", _egress_events_sql("dlp_block", "dlp_redact"))
def egress_events_stream(s, d):
    """Requests and answers as two streams, joined by flow and time."""
    answers = streams.as_stream(s, X.with_heartbeat(X.flow_answers(s, d)), "answers")
    requests = streams.as_stream(s, X.with_heartbeat(X.flow_requests(s, d)), "requests")
    seen = gateway.egress_events(answers, requests, compiled(s, "egress"), X.CANARY)
    return streams.run_available(s, _user_events(seen), "egress")


@query("inspect_ingress_stream", ORACLES["inspect_ingress_reverse"])
def inspect_ingress_stream(s, d):
    """Prompts as a stream, inspected with a rules file that is read again for every micro-batch."""
    folder = scratch_dir(s, "ingress-stream")
    fields = ", ".join(f"'{n}', {n}" for n in ("id", "name", "pattern", "detail", "severity", "scope"))
    shipped = rule_source.shipped_rules(s, X.CANARY).orderBy("pos").coalesce(1)
    shipped.agg(F.to_json(F.collect_list(F.expr(f"named_struct({fields})"))).alias("value")).write.text(f"{folder}/rules")
    rules = rule_source.ReloadedRules(s, f"{folder}/rules/part-*", X.CANARY, "ingress")
    prompts = X.prompts(s, d).withColumn("us", F.col("prompt_id"))
    stream = streams.as_stream(s, prompts, "prompts")

    def judge(rows, now):
        r = gateway.inspect_ingress(rows, now, mode="reverse")
        return _flat_events(r).select("prompt_id", "decision", "blocked_by", "rule", "events")

    streams.inspect_reloading(stream, rules, judge, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return s.read.parquet(f"{folder}/rows").drop("batch", "rules_version")


@query("replay_stream")
def replay_stream(s, d):
    return streams.run_available(s, streams.replay_stream(streams.as_stream(s, loop_requests(s, d), "loop")), "loop")
