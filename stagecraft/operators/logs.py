"""Folds over event logs (L1 bookmark state, L2 login sessions).

The reference mutates two small stores row by row (insert / delete bookmark,
insert login / close latest open login).  As table operations these are
folds over an append-only log, computed for every user at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequences import assign_blocks, running_sum


def bookmark_state(log: DataFrame) -> DataFrame:
    """L1: live bookmarks from ``log(user, potential_no, ts, action, seq)``.

    A ``remove`` deletes every earlier row of that (user, key); adds are not
    de-duplicated.  The latest remove per (user, key) is a map-side-combined
    aggregate, joined back to the adds (no per-group window).
    """
    log = log.filter(F.col("user").isNotNull() & F.col("potential_no").isNotNull())
    at = F.struct(F.col("ts"), F.col("seq"))
    last_rm = (log.filter(F.col("action") == "remove").groupBy("user", "potential_no")
               .agg(F.max(at).alias("_rm")))
    adds = log.filter(F.col("action") == "add")
    j = adds.join(last_rm, ["user", "potential_no"], "left")
    return (j.filter(F.col("_rm").isNull() | (at > F.col("_rm")))
            .select("user", "potential_no", F.col("ts").alias("timestamp"), "seq"))


def login_sessions(log: DataFrame, blocks: int | None = None) -> DataFrame:
    """L2: ``(username, login_time, logout_time)`` from ``log(username, ts, action, seq)``.

    Each logout closes the user's most recent still-open login (a stack);
    a logout with nothing open is ignored; unclosed logins get a null logout.

    With ``S`` the running sum of +1 (login) / -1 (logout) and ``M`` its
    running minimum floored at 0, the open depth is ``S - M``; a logout is
    ignored exactly when it lowers ``M``.  A login opening depth ``h`` and the
    logout closing it share level ``h``; within a level logins and logouts
    alternate, so the k-th login of a level pairs with the k-th logout.  Both
    running sums are block-parallel (``sequences.running_sum``) and the pairing
    is an equi-join on (user, level, k).
    """
    return _paired(log, blocks).select("username", "login_time", "logout_time")


def _paired(log: DataFrame, blocks: int | None) -> DataFrame:
    """Each login with its number in the log, its logout's time and whether it has one."""
    ev = (log.filter(F.col("username").isNotNull() & F.col("action").isin("login", "logout"))
          .select("username", "ts", "seq", "action"))
    order = [F.col("ts").asc_nulls_last(), F.col("seq").asc_nulls_last()]
    is_in = F.col("action") == "login"
    # one block assignment (materialised) serves both running sums: blocks are
    # contiguous in (user, ts, seq), hence also within every (user, level)
    ev = assign_blocks(ev, ["username"], order, blocks)
    s = running_sum(ev, ["username"], order, F.when(is_in, 1).otherwise(-1), "_s",
                    prev_min_out="_pm")
    floor_before = F.least(F.lit(0), F.coalesce(F.col("_pm"), F.lit(0)))
    s = s.withColumn("_ignored", ~is_in & (F.col("_s") < floor_before))
    live = s.filter(~F.col("_ignored"))
    # depth after the event = S - min(0, running min); running min after a
    # kept event equals the floor before it (kept events never lower it).
    depth = F.col("_s") - floor_before
    live = live.withColumn("_lvl", F.when(is_in, depth).otherwise(depth + 1))
    k = running_sum(live, ["username", "_lvl"], order, F.when(is_in, 1).otherwise(0), "_k")
    ins = k.filter(F.col("action") == "login").select(
        "username", "_lvl", "_k", F.col("ts").alias("login_time"), "seq")
    outs = k.filter(F.col("action") == "logout").select(
        "username", "_lvl", "_k", F.col("ts").alias("logout_time"), F.lit(True).alias("_out"))
    return (ins.join(outs, ["username", "_lvl", "_k"], "left")
            .withColumn("_out", F.coalesce("_out", F.lit(False))))


def fold_bookmarks(state: DataFrame | None, day: DataFrame) -> DataFrame:
    """L1 carried on: live bookmarks after a day's log, from those before it.

    The state is ``bookmark_state``'s result.  A removal acts on earlier rows only, and what it
    left is all that later days can touch, so the state and the day's log are enough.  Days are
    folded in order.
    """
    if state is not None:
        before = state.select("user", "potential_no", F.col("timestamp").alias("ts"), F.lit("add").alias("action"), "seq")
        day = before.unionByName(day.select("user", "potential_no", "ts", "action", "seq"))
    return bookmark_state(day)


def fold_sessions(still_open: DataFrame | None, day: DataFrame,
                  blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """L2 carried on: (sessions closed on the day, logins open after it), from those open before it.

    The state is each user's stack of open logins, as rows ``(username, ts, seq)``; a logout
    with nothing open is ignored and leaves no trace.  Days are folded in order.
    """
    log = day.select("username", "ts", "action", "seq")
    if still_open is not None:
        log = still_open.select("username", "ts", F.lit("login").alias("action"), "seq").unionByName(log)
    found = _paired(log, blocks)
    return (found.where("_out").select("username", "login_time", "logout_time"),
            found.where("not _out").select("username", F.col("login_time").alias("ts"), "seq"))


__all__ = ["bookmark_state", "login_sessions", "fold_bookmarks", "fold_sessions"]
