"""Chat bodies: which flows to look at, the user's own words, the streamed answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V

#: Messages and contents stay unparsed, so that the JSON type of each is known: one odd entry does not spoil the
#: others, and a text may look like an array.
_MESSAGES = "struct<messages: array<variant>>"
_CHUNK = "struct<choices: array<struct<delta: struct<content: string>>>>"


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def contains_any(c: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | c.contains(n)
    return hit


def filter_ai_chat(
    df: DataFrame, url: str = "url", method: str = "method", domains: list[str] | None = None
) -> DataFrame:
    """POSTs to a chat-completion path on one of the assistant domains."""
    u = F.col(url)
    return df.filter(
        (F.col(method) == "POST")
        & u.contains(V.CHAT_PATH)
        & contains_any(host_of(u), domains or V.FORWARD_DOMAINS)
    )


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _content_text(content: Column) -> Column:
    """A message's text: plain, or the texts of the objects of an array joined by a blank."""
    parts = F.filter(F.try_variant_get(content, "$", "array<variant>"), lambda p: _is(p, "OBJECT"))
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit(""))), " ")
    return F.when(_is(content, "ARRAY"), joined).otherwise(F.try_variant_get(content, "$", "string"))


def last_user_message(df: DataFrame, body: str = "body", out: str = "message") -> DataFrame:
    """Text of the last ``user`` message; a body that is not JSON counts as the text itself.

    Entries of ``messages`` that are no objects are passed over.  Rows with fewer than two non-blank characters
    have nothing to inspect and are dropped.
    """
    b = F.col(body)
    parsed = F.from_json(b, _MESSAGES)
    mine = F.filter(parsed["messages"], lambda m: _is(m, "OBJECT") & (F.try_variant_get(m, "$.role", "string") == "user"))
    last = F.when(F.size(mine) > 0, F.try_variant_get(F.element_at(mine, -1), "$.content", "variant"))
    is_json = parsed.isNotNull() & b.rlike(r"^\s*[\{]") & F.get_json_object(b, "$").isNotNull()
    text = F.when(is_json, _content_text(last)).otherwise(b)
    strip = F.regexp_replace(F.col(out), f"^[{V.SPACE_CLASS}]+|[{V.SPACE_CLASS}]+$", "")
    return df.withColumn(out, text).filter(F.length(strip) >= 2)


def extract_user_request(c: Column) -> Column:
    """What the user typed inside ``<userRequest>``; unchanged where there is none."""
    inner = F.regexp_extract(c, r"(?s)<userRequest>\s*(.*?)(?:</userRequest>|$)", 1)
    inner = F.regexp_replace(inner, f"^[{V.SPACE_CLASS}]+|[{V.SPACE_CLASS}]+$", "")
    return F.when(c.contains("<userRequest>") & (inner != ""), inner).otherwise(c)


def _line_text(line: Column) -> Column:
    """Concatenated delta contents of one ``data:`` line; NULL for other or broken lines."""
    ok = line.startswith("data: ") & ~line.startswith("data: [DONE]")
    chunk = F.from_json(F.substr(line, F.lit(7)), _CHUNK)
    text = F.array_join(
        F.transform(chunk["choices"], lambda ch: F.coalesce(ch["delta"]["content"], F.lit(""))), ""
    )
    return F.when(ok & (text != ""), text)


def reassemble_sse(c: Column) -> Column:
    """The answer text of an event-stream body; the raw body when no text could be read."""
    lines = F.transform(F.split(c, "\n"), F.trim)
    text = F.array_join(F.array_compact(F.transform(lines, _line_text)), "")
    return F.when(text != "", text).otherwise(c)


def reassemble_chunks(df: DataFrame, flow: str = "flow_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """The same from one row per line; a group holds the lines of one answer."""
    read = df.select(flow, seq, _line_text(F.trim(F.col(line))).alias("t"), F.col(line).alias("raw"))
    lines = read.groupBy(flow).agg(F.sort_array(F.collect_list(F.struct(seq, "t", "raw"))).alias("_l"))
    text = F.array_join(F.array_compact(F.transform("_l", lambda x: x["t"])), "")
    raw = F.array_join(F.transform("_l", lambda x: F.coalesce(x["raw"], F.lit(""))), "\n")
    return lines.select(flow, text.alias("text"), raw.alias("_raw")).select(
        flow, F.when(F.col("text") != "", F.col("text")).otherwise(F.col("_raw")).alias("text")
    )


def prompt_size_gate(df: DataFrame, col: str = "body", max_chars: int = V.PROMPT_MAX_CHARS) -> DataFrame:
    """Oversized prompts get decision 413, all others 200."""
    n = F.length(F.col(col))
    return df.withColumns({"prompt_chars": n, "status": F.when(n > max_chars, 413).otherwise(200)})
