"""Per-key time lines that survive a key holding a third of all rows.

A plain ``Window.partitionBy(user)`` puts a whole user into one task.  Both helpers here cut
a user's time line into slots first, so the unit of work is (user, slot) and only one small
row per slot -- bounded by the time span, not by the traffic -- ever meets at the user level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000
HOUR = 3600 * MICROS


def slot_of(us: Column | str, slot_us: int) -> Column:
    us = F.col(us) if isinstance(us, str) else us
    return F.floor(us / F.lit(slot_us)).cast("long")


def running(
    df: DataFrame,
    keys: Sequence[str],
    us: str,
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
    slot_us: int = HOUR // 4,
    inclusive: bool = True,
    peers: bool = False,
) -> DataFrame:
    """Running sums and maxima per key, as a two-level prefix; without the row itself if not inclusive, with
    all rows of its instant if ``peers`` (``order`` is then the instant alone).

    Level one runs inside (keys, slot).  Level two runs over one pre-aggregated row per
    (keys, slot) and carries the value of all earlier slots in.  ``order`` must sort ties;
    ``us`` must be its first component.  Keys must not be null.
    """
    sums, maxes = sums or {}, maxes or {}
    keys = list(keys)
    cells = keys + ["_slot"]
    src = df.withColumn("_slot", slot_of(us, slot_us))
    src = src.withColumns({f"_v_{n}": c for n, c in {**sums, **maxes}.items()})

    inside = Window.partitionBy(*cells).orderBy(*order)
    if peers:
        inside = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        inside = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)

    totals = src.groupBy(*cells).agg(
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxes],
    )
    carry = totals.select(
        *cells,
        *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_c_{n}") for n in maxes],
    )
    local = src.select(
        *df.columns,
        "_slot",
        *[F.sum(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in sums],
        *[F.max(f"_v_{n}").over(inside).alias(f"_l_{n}") for n in maxes],
    )
    joined = local.join(carry, cells, "left")
    return joined.select(
        *df.columns,
        *[
            F.coalesce(F.col(f"_c_{n}") + F.col(f"_l_{n}"), F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n)
            for n in sums
        ],
        # greatest() skips nulls, which is what a running maximum needs
        *[_later(F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n in maxes],
    )


def _later(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | (b > a), b).otherwise(a)


def sliding_counts(df: DataFrame, keys: Sequence[str], us: str, spans: dict[str, int]) -> DataFrame:
    """Add, per name in ``spans``, how many rows of the key lie in the last so many microseconds, both ends
    and all rows of the current instant included.

    A sweep: a row enters every count at its instant and leaves each just after its span; a count is the
    running sum of both.  Work grows with the rows, not with how many share a look-back.
    """
    moments = [F.struct(F.col(us).alias("at"), F.lit(-1).alias("leaves"))]
    moments += [F.struct((F.col(us) + span + 1).alias("at"), F.lit(i).alias("leaves")) for i, span in enumerate(spans.values())]
    swept = df.select(*df.columns, F.explode(F.array(*moments)).alias("_m")).select(*df.columns, F.col("_m.at").alias("_at"), F.col("_m.leaves").alias("_leaves"))
    steps = {
        name: F.when(F.col("_leaves") == -1, 1).when(F.col("_leaves") == i, -1).otherwise(0) for i, name in enumerate(spans)
    }
    return running(swept, keys, "_at", ["_at"], steps, peers=True).where("_leaves = -1").drop("_at", "_leaves")


def with_lookback(df: DataFrame, us: str, lookback_us: int, slot_us: int = HOUR) -> DataFrame:
    """Add ``_slot`` and ``_home``; rows needed by the next slot's look-back appear there too.

    A window over (key, ``_slot``) then sees every row of the last ``lookback_us`` for each
    row with ``_home`` true.  Each row is copied at most once.
    """
    if lookback_us > slot_us:
        raise ValueError("look-back must fit in one slot")
    home = slot_of(us, slot_us)
    tail = F.pmod(F.col(us), F.lit(slot_us)) >= slot_us - lookback_us
    out = df.withColumn("_home_slot", home)
    out = out.withColumn(
        "_slot",
        F.explode(
            F.when(tail, F.array(F.col("_home_slot"), F.col("_home_slot") + 1)).otherwise(
                F.array(F.col("_home_slot"))
            )
        ),
    )
    return out.withColumn("_home", F.col("_slot") == F.col("_home_slot")).drop("_home_slot")


def sorted_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of equal keys out of key-sorted Arrow batches, as columns; holds one group at a time."""
    held = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if pdf.empty:
            continue
        change = np.zeros(len(pdf), dtype=bool)
        change[0] = True
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        for k in keys:
            change[1:] |= cols[k][1:] != cols[k][:-1]
        starts = np.flatnonzero(change)
        for lo, hi in zip(starts[:-1], starts[1:]):
            yield {c: v[lo:hi] for c, v in cols.items()}
        held = pdf.iloc[starts[-1]:]
    if held is not None:
        yield {c: held[c].to_numpy() for c in held.columns}


def chunked(items: Iterator, size: int = 2000) -> Iterator[list]:
    """Lists of up to ``size`` items, so that output frames are neither tiny nor huge."""
    items = iter(items)
    while part := list(islice(items, size)):
        yield part
