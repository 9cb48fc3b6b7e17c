import datetime as dt
import random

from stagecraft.operators.logs import bookmark_state, login_sessions

T0 = dt.datetime(2024, 1, 1)


def brute(events):
    """Reference stack semantics: each logout closes the most recent open login."""
    out, stacks = [], {}
    for user, ts, seq, action in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        st = stacks.setdefault(user, [])
        if action == "login":
            st.append(ts)
        elif st:
            out.append((user, st.pop(), ts))
    for user, st in stacks.items():
        out += [(user, t, None) for t in st]
    return sorted(out, key=lambda r: (r[0], r[1], r[2] or dt.datetime.max))


def sessions(spark, events, blocks=None):
    df = spark.createDataFrame(events, "username string, ts timestamp_ntz, seq long, action string")
    got = [tuple(r) for r in login_sessions(df, blocks=blocks).collect()]
    return sorted(got, key=lambda r: (r[0], r[1], r[2] or dt.datetime.max))


def test_login_sessions_fixture(spark):
    t = [T0 + dt.timedelta(minutes=i) for i in range(7)]
    ev = [("u", t[1], 1, "login"), ("u", t[2], 2, "login"), ("u", t[3], 3, "logout"),
          ("u", t[4], 4, "logout"), ("u", t[5], 5, "logout"), ("u", t[6], 6, "login")]
    assert sessions(spark, ev) == [("u", t[1], t[4]), ("u", t[2], t[3]), ("u", t[6], None)]


def test_login_sessions_random_vs_stack(spark):
    rnd = random.Random(7)
    ev = []
    for seq in range(1500):
        user = "hot" if rnd.random() < 0.6 else f"u{rnd.randrange(6)}"
        ev.append((user, T0 + dt.timedelta(seconds=rnd.randrange(4000)), seq,
                   "login" if rnd.random() < 0.55 else "logout"))
    want = brute(ev)
    # several block counts: the carried prefix sums must not depend on them
    for blocks in (1, 3, 17):
        assert sessions(spark, ev, blocks) == want


def test_bookmark_state(spark):
    t = [T0 + dt.timedelta(minutes=i) for i in range(5)]
    log = spark.createDataFrame(
        [("u", "k", t[0], "add", 0), ("u", "k", t[1], "add", 1), ("u", "k", t[2], "remove", 2),
         ("u", "k", t[3], "add", 3), ("v", "k", t[0], "add", 4)],
        "user string, potential_no string, ts timestamp_ntz, action string, seq long")
    got = sorted((r[0], r[2]) for r in bookmark_state(log).collect())
    assert got == [("u", t[3]), ("v", t[0])]
