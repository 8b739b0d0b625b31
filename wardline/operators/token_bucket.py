"""Rate limiting a user's requests exactly, without one task per user.

State is one number V, the moment at which the bucket would have been empty: at time t it holds
min(cap, (t - V) / pause) tokens, ``pause`` being the time one token takes.  A request lifts V to
at least t - cap*pause; when t - V >= pause it is allowed and V moves on by one pause.  A refused
request changes nothing.

Allowed or not depends on everything before, so the history is cut into one-minute cells (a full
refill takes a minute).  Pass 1 finds, for every cell on its own, how *any* entering V leaves it --
a short list of pieces, since V keeps its phase until the bucket fills up.  Pass 2 chains those
lists per user: one row per minute, however busy the minutes were.  Pass 3 replays each cell from
its now known entering V.  All arithmetic is in whole microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import vocab as V
from wardline.operators.timeline import MICROS, chunked, sorted_runs

PAUSE = 60 * MICROS // V.BUCKET_PER_MINUTE
FULL = V.BUCKET_TOKENS * PAUSE
CELL = FULL


def run_cell(times: np.ndarray, entering: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaving V for each entering V, and whether the bucket was full on the way (phase lost)."""
    v = entering.astype(np.int64).copy()
    filled = np.zeros(len(v), dtype=bool)
    pos = np.zeros(len(v), dtype=np.int64)
    live = np.arange(len(v))
    while len(live):
        # the next allowed request is the first at or after V + pause
        j = np.maximum(np.searchsorted(times, v[live] + PAUSE, side="left"), pos[live])
        inside = j < len(times)
        live, j = live[inside], j[inside]
        floor = times[j] - FULL
        filled[live] |= v[live] <= floor
        v[live] = np.maximum(v[live], floor) + PAUSE
        pos[live] = j + 1
    return v, filled


def cell_pieces(times: np.ndarray, start: int) -> tuple[list[int], list[bool], list[int]]:
    """The cell as a function of the entering V in (start - FULL, start].

    Behaviour can only change where V is a whole number of pauses before some request, so the
    right ends of the pieces are known up front; equal neighbours are merged.
    """
    back = np.arange(1, V.BUCKET_TOKENS + 2 + CELL // PAUSE) * PAUSE
    ends = np.unique((times[:, None] - back[None, :]).ravel())
    ends = ends[(ends > start - FULL) & (ends < start)]
    ends = np.concatenate([[start - FULL], ends, [start]])
    out, filled = run_cell(times, ends)
    value = np.where(filled, out, out - ends)
    last = np.ones(len(ends), dtype=bool)
    last[:-1] = (value[1:] != value[:-1]) | (filled[1:] != filled[:-1])
    return ends[last].tolist(), filled[last].tolist(), value[last].tolist()


def allowed_in_cell(times: np.ndarray, v: int) -> np.ndarray:
    ok = np.zeros(len(times), dtype=bool)
    at = 0
    while True:
        at = max(int(np.searchsorted(times, v + PAUSE, side="left")), at)
        if at >= len(times):
            return ok
        ok[at] = True
        v = max(v, int(times[at]) - FULL) + PAUSE
        at += 1


def _pieces(cells: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in chunked(sorted_runs(batches, cells)):
            rows = []
            for r in found:
                key = [r[k][0] for k in cells]
                rows.append([*key, *cell_pieces(np.sort(r["us"]), int(key[-1]) * CELL)])
            yield pd.DataFrame(rows, columns=cells + ["ends", "filled", "value"])

    return run


def _chain(keys: list[str]):
    """Cells arrive sorted by key and time: only V of the current key is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, v = None, 0
        for pdf in batches:
            entering = []
            for *key, no, ends, filled, value in pdf[keys + ["_cell", "ends", "filled", "value"]].itertuples(index=False):
                lowest = int(no) * CELL - FULL
                v = max(v, lowest) if key == current else lowest
                current = key
                entering.append(v)
                i = int(np.searchsorted(np.asarray(ends), v, side="left"))
                v = int(value[i]) if filled[i] else v + int(value[i])
            yield pdf[keys + ["_cell"]].assign(_v=np.asarray(entering, dtype=np.int64))

    return run


def _replay(cells: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in chunked(sorted_runs(batches, cells)):
            ids, oks = [], []
            for r in found:  # the first row of a cell brings its entering V
                ids.append(r["event_id"][1:])
                oks.append(allowed_in_cell(r["us"][1:], int(r["_v"][0])))
            yield pd.DataFrame({"event_id": np.concatenate(ids), "token": np.concatenate(oks)})

    return run


def token_bucket(requests: DataFrame, keys: tuple[str, ...] = ("user", "epoch")) -> DataFrame:
    """(event_id, token): whether the bucket, full at each key's first request, allows a request."""
    keys = list(keys)
    cells = keys + ["_cell"]
    ddl = ", ".join(f"`{k}` {requests.schema[k].dataType.simpleString()}" for k in keys) + ", _cell long"
    src = requests.select(*keys, F.floor(F.col("us") / CELL).cast("long").alias("_cell"), "us", "event_id")
    per_cell = (
        src.select(*cells, "us")
        .repartition(*cells)
        .sortWithinPartitions(*cells)
        .mapInPandas(_pieces(cells), f"{ddl}, ends array<long>, filled array<boolean>, value array<long>")
    )
    entering = (
        per_cell.repartition(*keys).sortWithinPartitions(*cells).mapInPandas(_chain(keys), f"{ddl}, _v long")
    )
    # The entering V goes in as one more row, ahead of the requests of its cell: no join, and the
    # requests are shuffled once.
    marks = entering.select(
        *cells, (F.col("_cell") * CELL - 1).alias("us"), F.lit(-1).cast("long").alias("event_id"), "_v"
    )
    return (
        src.withColumn("_v", F.lit(0).cast("long"))
        .unionByName(marks)
        .repartition(*cells)
        .sortWithinPartitions(*cells, "us", "event_id")
        .mapInPandas(_replay(cells), "event_id long, token boolean")
    )
