"""The ordered fold: state is read per bucket and part, not per user and minute, and a hot user is read part by part."""

from wardline.operators.timeline import MICROS
from wardline.streaming import operators as streams
from wardline.streaming.ordered import HOLD, PART, OrderedFold, Parts

T0 = 1_704_067_200_000_000
RISK = "us long, user string, event_id long, a long, b long, line boolean"


class Store(dict):
    calls = 0

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def getValue(self, key):
        self.calls += 1
        return self[key]

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def processor(fold, ddl, columns):
    made = OrderedFold(fold, ddl, columns, None)
    made.parts = Parts.__new__(Parts)
    made.parts.rows, made.parts.following, made.parts.lows = Store(), 0, []
    return made


def test_rows_of_many_users_share_calls():
    p = processor(streams._RiskFold(), RISK, ["event_id", "us", "n"])
    rows = [(T0 + i * 3600 * MICROS, f"u{i % 700}", i, 5, 10, False) for i in range(2000)]
    p.parts.add(rows)
    found = sum((f.event_id.tolist() for f in p._fold_closed({}, T0 + 2000 * 3600 * MICROS)), [])
    assert sorted(found) == list(range(2000))
    assert p.parts.rows.calls < 2000 / 4  # 2000 rows in 2000 minutes of 700 users


def test_hot_user_is_read_in_parts_and_in_order():
    n = 3 * HOLD
    p = processor(streams._RiskFold(), RISK, ["event_id", "us", "n"])
    rows = [(T0 + i * MICROS, "u", i, 5, 10, False) for i in range(n)]
    for k in range(6):  # arrivals in no order
        p.parts.add(rows[k::6])
    closed = T0 + (n // 2) * MICROS
    users = {}
    frames = list(p._fold_closed(users, closed))
    assert [i for f in frames for i in f.event_id] == list(range(n // 2 + 1)) and len(frames) > 1
    assert max(len(f) for f in frames) < HOLD + 7 * PART
    # the rest waits, and lines that have not run out come again
    more = list(p._fold_closed(users, T0 + n * MICROS))
    assert [i for f in more for i in f.event_id] == list(range(n // 2 + 1, n))
    live, want = streams._risk_start(), {}
    for us, _, i, a, b, _ in rows:
        streams.replay.score(live, us)
        streams.replay.add_points(live, us, a, b)
        want[i] = str(streams.replay.score(live, us))
    assert {i: v for f in frames + more for i, v in zip(f.event_id, f.n)} == want
