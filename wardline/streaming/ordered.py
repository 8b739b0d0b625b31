"""Per-user state in event-time order.

Rows of a user are held until the watermark has passed them, then folded in time order.  So the
result does not depend on how arrivals were split into micro-batches, and equals the batch
operator's on everything the watermark has closed.  Rows later than the watermark are dropped by
Spark before they get here.

Users are dealt over buckets, and state is read and written per bucket: a call to the state store is a round trip
to the JVM, so a call per user and minute costs more than the folds.  What waits lies in a map state, in parts of some
hundred rows next to each other in time; a part is read once time gets to it.  A task holds the parts that overlap
the instant it has reached, however many rows a bucket has.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Users meet in so many buckets; the number of users in one is what its task holds the small states of.
BUCKETS = 1024
#: Rows of a part, and rows that are folded together.
PART, HOLD = 500, 20_000


class Parts:
    """Rows that wait, in parts by time.  Every row begins with its time."""

    def __init__(self, handle: StatefulProcessorHandle, row_ddl: str):
        self.rows = handle.getMapState("waiting", "number long", f"rows array<struct<{row_ddl}>>")
        self.index = handle.getValueState("index", "following long, parts array<struct<low:bigint,number:bigint>>")

    def load(self) -> None:
        """Where the parts begin, for the time of one call."""
        self.following, parts = self.index.get() or (0, [])
        self.lows = [tuple(p) for p in parts]
        heapq.heapify(self.lows)

    def save(self) -> None:
        self.index.update((self.following, self.lows))

    def add(self, rows: list[tuple]) -> None:
        rows = sorted(rows, key=itemgetter(0))
        for i in range(0, len(rows), PART):
            part = rows[i : i + PART]
            self.rows.updateValue((self.following,), (part,))
            heapq.heappush(self.lows, (part[0][0], self.following))
            self.following += 1

    def first(self) -> int | None:
        """When the oldest part begins."""
        return self.lows[0][0] if self.lows else None

    def take(self) -> list[tuple]:
        """Rows of the oldest part, which is removed."""
        number = heapq.heappop(self.lows)[1]
        found = [tuple(r) for r in self.rows.getValue((number,))[0]]
        self.rows.removeKey((number,))
        return found


class Fold:
    """What to do with a user's rows in time order.

    ``state_ddl`` and ``start`` describe a small typed state.  ``run`` gets it with time-ordered rows before
    ``until`` and returns the new state (None: as at the start), the output rows, and rows that shall come again
    at their own time, which is not before ``until``."""

    state_ddl = ""

    def start(self) -> tuple:
        raise NotImplementedError

    def run(self, state: tuple, rows: list[tuple], until: int) -> tuple[tuple | None, list[tuple], list[tuple]]:
        raise NotImplementedError


def _plain(pdf: pd.DataFrame, longs: list[bool]) -> list[tuple]:
    """Rows as tuples with None for NULL; pandas reads whole numbers beside a NULL as floats."""
    columns = []
    for name, whole in zip(pdf.columns, longs):
        c, there = pdf[name], pdf[name].notna()
        if there.all():
            columns.append(c.tolist())
        else:
            columns.append([(int(v) if whole else v) if t else None for v, t in zip(c.tolist(), there.tolist())])
    return list(zip(*columns))


class OrderedFold(StatefulProcessor):
    def __init__(self, fold: Fold, row_ddl: str, out_columns: list[str], keep_us: int | None):
        fields = [f.split() for f in row_ddl.split(", ")]
        self.fold, self.row_ddl, self.out_columns, self.keep_us = fold, row_ddl, out_columns, keep_us
        self.columns, self.longs = [f[0] for f in fields], [f[1] in ("long", "int") for f in fields]
        self.user, self.event = self.columns.index("user"), self.columns.index("event_id")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = Parts(handle, self.row_ddl.replace(", ", ",").replace(" ", ":"))
        self.users = handle.getValueState("users", f"users array<struct<user:string,last:bigint,{self.fold.state_ddl}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.parts.load()
        before = first = self.parts.first()
        for pdf in rows:
            if len(pdf):
                self.parts.add(_plain(pdf[self.columns], self.longs))
        first = self.parts.first()
        if first is not None:
            self.parts.save()
            if before is None or first < before:
                self._wake_at(first)
        return iter([])

    def _wake_at(self, us: int) -> None:
        """When the timer fires, all closed rows are folded."""
        self.handle.registerTimer(-(-us // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        closed = timerValues.getCurrentWatermarkInMs() * 1000
        self.parts.load()
        known = self.users.get() if self.users.exists() else None
        users = {u[0]: (u[1], tuple(u[2:])) for u in known[0]} if known else {}
        first = self.parts.first()
        if first is not None and first <= closed:
            yield from self._fold_closed(users, closed)
            self.parts.save()
        elif not users:
            return
        if self.keep_us is not None:  # forget users whose past can no longer matter
            users = {u: kept for u, kept in users.items() if closed < kept[0] + self.keep_us}
        if users:
            self.users.update(([(u, last, *state) for u, (last, state) in users.items()],))
        elif known:
            self.users.clear()
        waits = [] if self.parts.first() is None else [self.parts.first()]
        if not waits and users and self.keep_us is not None:
            waits = [min(last for last, _ in users.values()) + self.keep_us]
        for us in waits:
            self._wake_at(max(us, closed + 1000))

    def _fold_closed(self, users: dict, closed: int) -> Iterator[pd.DataFrame]:
        parts, held = self.parts, []
        while True:
            ready: list[tuple] = []
            while not ready:
                until = closed + 1
                while parts.lows and parts.first() <= closed:
                    if len(held) >= HOLD and min(r[0] for r in held) < parts.first():
                        until = parts.first()
                        break
                    held += parts.take()
                ready = [r for r in held if r[0] < until]
                if until > closed:
                    break
            held = [r for r in held if r[0] >= until]
            out, again = self._fold(users, ready, until)
            if out:
                yield pd.DataFrame(out, columns=self.out_columns)
            parts.add(again)
            if until > closed:
                parts.add(held)
                return

    def _fold(self, users: dict, rows: list[tuple], until: int) -> tuple[list[tuple], list[tuple]]:
        rows.sort(key=lambda r: (r[0], r[self.event] is None, r[self.event] or 0))
        of: dict[str, list[tuple]] = {}
        for r in rows:
            of.setdefault(r[self.user], []).append(r)
        out, again = [], []
        for user, own in of.items():
            state = users[user][1] if user in users else self.fold.start()
            state, found, later = self.fold.run(state, own, until)
            out += found
            again += later
            if state is None:
                users.pop(user, None)
            else:
                users[user] = (own[-1][0], state)
        return out, again

    def close(self) -> None:
        pass


def ordered(
    stream: DataFrame, fold: Fold, row_ddl: str, out_ddl: str, keep_us: int | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Apply ``fold`` per user to a stream that has ``user``, ``us``, ``event_id`` and a watermark on ``ts``.

    ``row_ddl``: what the fold needs of a row, ``us`` first, ``user`` and ``event_id`` among it.
    ``keep_us``: a user's state is dropped once the watermark is so far beyond the last row (None: never).
    ``buckets``: more of them hold fewer users each; fixed for the life of a checkpoint."""
    columns = [f.split()[0] for f in row_ddl.split(", ")]
    src = stream.filter(F.col("user").isNotNull() & F.col("us").isNotNull())
    src = src.select(F.pmod(F.xxhash64("user"), F.lit(buckets)).alias("bucket"), "ts", *columns)
    return src.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=OrderedFold(fold, row_ddl, [f.split()[0] for f in out_ddl.split(", ")], keep_us),
        outputStructType=out_ddl,
        outputMode="Append",
        timeMode="EventTime",
    )
