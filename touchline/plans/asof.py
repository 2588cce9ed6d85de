"""As-of lookup of trailing history: the last rows of a key strictly before each row.

Input rows carry a key, a time in microseconds, an id that breaks ties and a flag that
says whether the row counts as history. One hash exchange by key serves three windows:
trailing sums over history rows, the same per sub-group, and the strict as-of pick-up.
Keys too large for one task are cut into time blocks; each block starts with the last
few history rows before it, so trailing sums stay whole across the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.plans.ordering import BLOCK, BLOCK_ROWS, SALT, Blocks, join_on, plan_blocks, spread

# name -> (value column, first row, last row), rows counted back from the newest: (5, 1) = last five
Frames = dict[str, tuple[str, int, int]]


def asof_trailing(rows: DataFrame, keys: Sequence[str], frames: Frames, *, us: str = "us", id: str = "match_id",
                  history: str = "is_hist", sub: str | None = None, sub_frames: Frames | None = None,
                  lists: dict[str, tuple[str, int]] | None = None, asked: str | None = None,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``last`` (seq, us and the frame sums as of the newest earlier history row).

    ``lists`` maps a name to (column, n): the column's values of the last n rows, oldest first.
    With a boolean ``sub`` column also add ``last_sub``: the same over the history rows that
    share the row's own ``sub`` value. Both are NULL without earlier history.
    With a boolean ``asked`` column only rows where it is true are given back; ``seq`` is then exact up to the deepest frame, as
    history that no asked row can reach is left out before the wide windows.
    """
    keys = list(keys)
    sub_frames, lists = sub_frames or {}, lists or {}
    blocks = plan_blocks(rows, [*keys, us], block_rows=block_rows, split_ties=False)
    part = keys
    rows = rows.withColumn("_target", F.lit(True) if asked is None else F.coalesce(F.col(asked), F.lit(False)))
    used = [*frames.values(), *sub_frames.values(), *[(v, n, 1) for v, n in lists.values()]]
    depth = max((first for _, first, _ in used), default=0)
    if blocks:
        values = sorted({v for v, _, _ in used})
        rows = _cut_with_carry(rows, blocks, keys, us, id, history, sub, values, depth)
        part = [*keys, BLOCK, SALT]
    rows = spread(rows, blocks.rows, *part)
    if asked is not None:
        rows = _within_reach(rows, part, us, id, history, sub, depth)

    def summary(group: list[str], wanted: Frames, wanted_lists=()):
        w = Window.partitionBy(*group).orderBy(us, id)
        return F.struct(
            F.row_number().over(w).alias("seq"), F.col(us).alias("us"),
            *[F.sum(v).over(w.rowsBetween(1 - first, 1 - last)).alias(name)
              for name, (v, first, last) in wanted.items()],
            *[F.collect_list(lists[name][0]).over(w.rowsBetween(1 - lists[name][1], 0)).alias(name)
              for name in wanted_lists])

    is_hist = F.col(history)
    earlier = Window.partitionBy(*part).orderBy(us).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_all", summary([*part, history], frames, lists))
    if sub:
        rows = rows.withColumn("_sub", summary([*part, history, sub], sub_frames))
        own = F.col(sub)
        rows = rows.withColumn(
            "last_sub",
            F.when(own, F.max(F.when(is_hist & own, F.col("_sub"))).over(earlier))
            .otherwise(F.max(F.when(is_hist & ~own, F.col("_sub"))).over(earlier)))
    rows = rows.withColumn("last", F.max(F.when(is_hist, F.col("_all"))).over(earlier))
    return rows.filter("_target").drop("_all", "_sub", "_target", BLOCK, SALT)


def _within_reach(rows: DataFrame, part, us, id, history, sub, depth) -> DataFrame:
    """Targets, history from the first target of the part on, and the last ``depth`` history rows before it (of each sub-group)."""
    here = Window.partitionBy(*part)
    early = F.col(us) < F.col("_first")  # rows without a time are kept
    group = [*part, "_early", *([sub] if sub else [])]
    newest = Window.partitionBy(*group).orderBy(F.col(us).desc(), F.col(id).desc())
    found = rows.withColumn("_first", F.min(F.when(F.col("_target"), F.col(us))).over(here)).withColumn("_any", F.max("_target").over(here))
    found = found.filter(F.col("_target") | (F.col("_any") & F.col(history)))
    found = found.withColumn("_early", F.coalesce(early & F.col(history) & ~F.col("_target"), F.lit(False))).withColumn("_n", F.row_number().over(newest))
    return found.filter(~F.col("_early") | (F.col("_n") <= depth)).drop("_first", "_any", "_early", "_n")


def _cut_with_carry(rows: DataFrame, blocks: Blocks, keys, us, id, history, sub, values, depth) -> DataFrame:
    """Assign blocks and prepend to each block the last ``depth`` history rows before it.

    Only keys that a split point names lie in several blocks, at most one for each point; the others carry nothing.
    """
    cut = blocks.assign(rows, salt_on=id)
    group = [*keys, sub] if sub else list(keys)
    named = sorted({p[: len(keys)] for p in blocks.points})
    several = cut.join(F.broadcast(cut.sparkSession.createDataFrame(named, T.StructType([blocks.schema[k] for k in keys]))), keys, "left_semi")
    spans = several.select(*group, BLOCK, SALT).distinct()
    newest = Window.partitionBy(*group, BLOCK, SALT).orderBy(F.col(us).desc(), F.col(id).desc())
    # Sorted in tasks by their rows: sorting where the rows are read would take memory by the size of a file's split.
    narrow = several.filter(F.col(history)).select(*group, BLOCK, SALT, us, id, *values)
    tails = (
        spread(narrow, blocks.rows, *group, BLOCK, SALT)
        .withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= depth)
        .groupBy(*group, BLOCK).agg(F.collect_list(F.struct(us, id, *values)).alias("_tail"))
    )

    def last_rows(nested):
        return F.slice(F.reverse(F.array_sort(F.flatten(nested))), 1, depth)

    # Non-empty tails hold at least one row each, so `depth` of them hold all that can be needed.
    recent = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(1 - depth, 0)
    state = tails.select(*group, BLOCK, last_rows(F.collect_list("_tail").over(recent)).alias("_state"))
    before = Window.partitionBy(*group).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    # Sub-groups carry apart: every block of a key needs the tails of both sub-groups.
    places = spans.select(*keys, BLOCK).distinct()
    if sub:
        places = places.withColumn(sub, F.explode(F.array(F.lit(True), F.lit(False))))
    carried = (
        join_on(places, state, [*group, BLOCK], "left")
        .withColumn("_carry", F.last("_state", ignorenulls=True).over(before))
        .select(*group, BLOCK, F.explode("_carry").alias("_r")))
    carried = join_on(carried, spans.select(*keys, BLOCK, SALT).distinct(), [*keys, BLOCK]).select(
        *group, BLOCK, SALT, F.col(f"_r.{us}").alias(us), F.col(f"_r.{id}").alias(id),
        *[F.col(f"_r.{v}").alias(v) for v in values], F.lit(True).alias(history), F.lit(False).alias("_target"))
    return cut.unionByName(carried, allowMissingColumns=True)


def asof_count(rows: DataFrame, keys: Sequence[str], *, us: str = "us", id: str = "match_id",
               history: str = "is_hist", out: str = "count_before", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number of history rows of the key strictly before each row, exact at any depth."""
    keys = list(keys)
    counted = F.coalesce(F.col(history), F.lit(False)).cast("long")

    def earlier(part):
        w = Window.partitionBy(*part).orderBy(us).rangeBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(counted).over(w), F.lit(0))

    blocks = plan_blocks(rows, [*keys, us], block_rows=block_rows, split_ties=False)
    if not blocks:
        return rows.withColumn(out, earlier(keys))
    cut = spread(blocks.assign(rows, salt_on=id), blocks.rows, *keys, BLOCK, SALT)
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cut.groupBy(*keys, BLOCK).agg(F.sum(counted).alias("_n"))
        .select(*keys, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        join_on(cut.withColumn("_within", earlier([*keys, BLOCK, SALT])), starts, [*keys, BLOCK])
        .withColumn(out, F.col("_start") + F.col("_within"))
        .drop("_start", "_within", BLOCK, SALT)
    )


def trailing_rows(rows: DataFrame, keys: Sequence[str], frames: Frames, *, us: str = "us", id: str = "match_id",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sums over the rows before each row in (time, id) order: frame (5, 1) is the five rows before.

    Sums are NULL, and ``<name>_n`` is 0, where no such row exists.
    """
    keys = list(keys)
    rows = rows.withColumn("_hist", F.lit(True)).withColumn("_target", F.lit(True))
    blocks = plan_blocks(rows, [*keys, us, id], block_rows=block_rows)
    part = keys
    if blocks:
        depth = max(first for _, first, _ in frames.values())
        rows = _cut_with_carry(rows, blocks, keys, us, id, "_hist", None, sorted({v for v, _, _ in frames.values()}), depth)
        part = [*keys, BLOCK]
    w = Window.partitionBy(*part).orderBy(us, id)
    for name, (value, first, last) in frames.items():
        frame = w.rowsBetween(-first, -last)
        rows = rows.withColumn(name, F.sum(value).over(frame)).withColumn(f"{name}_n", F.count(value).over(frame))
    return rows.filter("_target").drop("_hist", "_target", BLOCK, SALT)
