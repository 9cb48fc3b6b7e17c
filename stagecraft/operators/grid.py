"""Stage-movement grid.

The reference fills the grid with two Python loops over the rows.  Here every
status row emits at most three (stage, metric vector) contributions -- one for
its previous stage, one for its current stage, one for its own stage (zeros,
so every stage that occurs gets a grid row) -- and a single ``groupBy(stage)``
sums them.  The aggregate is combined map-side, so the shuffle carries one
small vector per stage per task whatever the row count or key skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import (ALERT_PINK_STAGES, ALERT_RED_STAGE, CLOSED_STAGE, FLAG,
                       GRID_EXCLUDED_STAGES, GRID_MAX_ROWS, GRID_METRICS, KEY, c)
from ..functions.text import NO_STAGE_NUMBER, stage_sort_number

PS, CS, STAGE = "Previous Status Stage", "Current Status Stage", "Stage"
STAGE_NAME = "Stage Name"


def _col_or_null(df: DataFrame, name: str) -> Column:
    return c(name) if name in df.columns else F.lit(None).cast("string")


def stage_universe(df: DataFrame) -> DataFrame:
    """A4: distinct non-null values over Stage, PS and CS."""
    names = [n for n in (STAGE, PS, CS) if n in df.columns]
    if not names:
        raise ValueError("none of the stage columns is present")
    return (df.select(F.explode(F.array(*[c(n) for n in names])).alias(STAGE_NAME))
            .filter(F.col(STAGE_NAME).isNotNull()).distinct())


def stage_movement_grid(df: DataFrame) -> DataFrame:
    """A5: per stage OB, Added-New, Added-Old, Moved, Dropped, CB (bigint)."""
    ps, cs, st = _col_or_null(df, PS), _col_or_null(df, CS), _col_or_null(df, STAGE)
    flag = _col_or_null(df, FLAG)
    existing = F.coalesce(flag == "Existing", F.lit(False))
    new = F.coalesce(flag == "New", F.lit(False))
    differ = ps.isNotNull() & cs.isNotNull() & (ps != cs)
    moved = existing & differ & (cs != CLOSED_STAGE)
    dropped = differ & (cs == CLOSED_STAGE)

    def one(b: Column) -> Column:
        return F.when(b, F.lit(1)).otherwise(F.lit(0))

    zero = F.lit(0)
    contrib = F.array(
        F.struct(ps.alias("s"), one(existing).alias("ob"), one(new).alias("an"),
                 zero.alias("ao"), one(moved).alias("mv"), one(dropped).alias("dr")),
        F.struct(cs.alias("s"), zero.alias("ob"), zero.alias("an"), one(moved).alias("ao"),
                 zero.alias("mv"), zero.alias("dr")),
        F.struct(st.alias("s"), zero.alias("ob"), zero.alias("an"), zero.alias("ao"),
                 zero.alias("mv"), zero.alias("dr")),
    )
    g = (df.select(F.inline(contrib)).filter(F.col("s").isNotNull())
         .groupBy(F.col("s").alias(STAGE_NAME))
         .agg(*[F.sum(F.col(x)).cast("bigint").alias(n)
                for x, n in zip(("ob", "an", "ao", "mv", "dr"), GRID_METRICS)]))
    return g.withColumn("CB", F.col("OB") + F.col("Added-New") + F.col("Added-Old")
                        - F.col("Moved") - F.col("Dropped"))


def filter_stage_at_least(grid: DataFrame, higher_stage: str = "All") -> DataFrame:
    """grid rows whose stage number >= that of ``higher_stage``; no number = +inf."""
    if higher_stage == "All":
        return grid
    import re
    m = re.match(r"(\d+)", str(higher_stage))
    n = int(m.group(1)) if m else NO_STAGE_NUMBER
    return grid.filter(stage_sort_number(F.col(STAGE_NAME)) >= F.lit(n))


def filter_exclude_stages(grid: DataFrame, stages=GRID_EXCLUDED_STAGES) -> DataFrame:
    """drop the listed stages from the grid (after all counts)."""
    return grid.filter(~F.col(STAGE_NAME).isin(list(stages)))


def grid_total_row(grid: DataFrame) -> DataFrame:
    """Append ``Total`` = column sums over the grid rows except ``0 - Closed``."""
    # each grid row counts for its own stage and, unless closed, for the total, so the
    # grid is computed once; a constant zero row makes the total of an empty grid
    names = F.array(F.col(STAGE_NAME), F.when(F.col(STAGE_NAME) != CLOSED_STAGE, F.lit("Total")))
    rows = (grid.select(F.explode(names).alias("_s"), *GRID_METRICS).filter(F.col("_s").isNotNull())
            .withColumnRenamed("_s", STAGE_NAME))
    zero = grid.sparkSession.range(1).select(
        F.lit("Total").alias(STAGE_NAME), *[F.lit(0).cast("bigint").alias(n) for n in GRID_METRICS])
    return (rows.unionByName(zero).groupBy(STAGE_NAME)
            .agg(*[F.sum(n).cast("bigint").alias(n) for n in GRID_METRICS]))


def _display_order(stage: Column) -> list[Column]:
    is_total = (stage == "Total").cast("int")
    return [is_total, stage_sort_number(stage), stage]


def sort_stage_number(grid: DataFrame) -> DataFrame:
    """O1: order by leading stage number (missing last), then name; Total last."""
    return grid.orderBy(*_display_order(F.col(STAGE_NAME)))


def limit_rows(grid: DataFrame, n: int = GRID_MAX_ROWS) -> DataFrame:
    """O3: the first ``n`` rows in display order, for showing a grid only: reports and
    exports use the whole grid."""
    return sort_stage_number(grid).limit(n)


def grid_alerts(grid: DataFrame) -> DataFrame:
    """Q6: cell alert labels on shown grid rows (Total row included)."""
    s, dr, an = F.col(STAGE_NAME), F.col("Dropped"), F.col("Added-New")
    return grid.withColumns({
        "dropped_alert": F.when(s.isin(ALERT_PINK_STAGES) & (dr >= 1), F.lit("lightpink"))
                          .when((s == ALERT_RED_STAGE) & (dr >= 1), F.lit("lightcoral")),
        "added_alert": F.when(an >= 1, F.lit("lightgreen")),
    })


def finish_grid(grid: DataFrame, higher_stage: str = "All") -> DataFrame:
    """F14 -> F15 -> A6 -> O1 on a computed grid: all stages, and the Total row last."""
    g = filter_exclude_stages(filter_stage_at_least(grid, higher_stage))
    return sort_stage_number(grid_total_row(g))


# ---------------------------------------------------------------- drill-down (Q7)

DRILL_METRICS = GRID_METRICS


def drill_predicate(df: DataFrame, stages, metric: str) -> Column:
    """Rows behind one grid column for the chosen stages.

    Null counts as "not in" and as "not equal" (pandas mask semantics).
    """
    sel = list(stages)
    ps, cs, st = _col_or_null(df, PS), _col_or_null(df, CS), _col_or_null(df, STAGE)
    flag = _col_or_null(df, FLAG)

    def isin(x: Column) -> Column:
        return F.coalesce(x.isin(sel), F.lit(False)) if sel else F.lit(False)

    existing = flag.eqNullSafe("Existing")
    closed = cs.eqNullSafe(CLOSED_STAGE)
    preds = {
        "OB": isin(ps) & existing,
        "Added-New": isin(ps) & flag.eqNullSafe("New"),
        "Added-Old": existing & isin(cs) & ~isin(ps),
        "Moved": existing & isin(ps) & ~isin(cs) & ~closed,
        "Dropped": isin(ps) & closed,
        "CB": isin(st) & existing,
    }
    if metric not in preds:
        return F.lit(False)
    return preds[metric]


def drill_down(df: DataFrame, stages, metrics, key: str = KEY) -> DataFrame:
    """Q7 + U3: distinct non-null keys behind the chosen grid cells (union over metrics)."""
    cond = F.lit(False)
    for m in metrics:
        cond = cond | drill_predicate(df, stages, m)
    return df.filter(cond & c(key).isNotNull()).select(c(key)).distinct()


def drill_down_by_metric(df: DataFrame, stages, key: str = KEY) -> DataFrame:
    """Q7 for every grid column at once: distinct ``(metric, key)`` pairs."""
    tagged = df.select(c(key), F.array(*[
        F.when(drill_predicate(df, stages, m), F.lit(m)) for m in DRILL_METRICS]).alias("_m"))
    return (tagged.filter(c(key).isNotNull())
            .select(F.explode("_m").alias("metric"), c(key))
            .filter(F.col("metric").isNotNull()).distinct())


__all__ = ["stage_universe", "stage_movement_grid", "filter_stage_at_least",
           "filter_exclude_stages", "grid_total_row", "sort_stage_number", "limit_rows",
           "grid_alerts", "finish_grid", "drill_predicate", "drill_down",
           "drill_down_by_metric"]
