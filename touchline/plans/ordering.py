"""Ordered blocks: cut a total order into balanced, contiguous pieces.

A window without a partition, or with one very hot partition key, sends all of its rows
to one task. Here the order is cut at sampled split points, so each piece is an ordinary
window partition, and pieces are put together by a prefix scan over one summary row per
piece. Inputs of at most ``block_rows`` rows (counted first) need no cutting.
"""

from __future__ import annotations

import json
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.plans.materialize import materialize, short_methods

BLOCK_ROWS = 2_000_000   # rows one window task may hold
TASK_ROWS = 250_000      # rows one task gets of an exchange for wide windows
SCAN_COLUMNS = 11        # columns that one scan aggregates
TREE_POINTS = 64         # split points that are compared in compiled code
MAX_BLOCKS = 16_384      # bounds the split points kept on the driver
SAMPLES_PER_BLOCK = 20
LEVELS = 1_000           # values that a column may have to be folded whole
BRACKET = 0.005          # distance of a bracket's ends from the wanted quantile
SKETCH_ACCURACY = 2000   # ranks are off by at most a 2000th, a tenth of the distance

BLOCK, SALT = "_blk", "_salt"


@dataclass
class Blocks:
    """Sorted split points over ``cols``; empty points mean one block."""

    cols: list[str]
    schema: T.StructType
    points: list[tuple] = field(default_factory=list)
    salts: dict[int, int] = field(default_factory=dict)  # block number -> pieces of one tied value
    rows: int = 0  # of the table the blocks were planned for

    def __bool__(self) -> bool:
        return bool(self.points)

    def _literal(self) -> Column:
        names = [f"c{i}" for i in range(len(self.cols))]
        fields = ",".join(f"{n}:{self.schema[c].dataType.simpleString()}" for n, c in zip(names, self.cols))
        rows = [dict(zip(names, p)) for p in self.points]
        return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{fields}>>")

    def number(self) -> Column:
        """How many split points are at or below the row: a binary search, folded JVM-side if there are too many for compiled code."""
        if len(self.points) <= TREE_POINTS:
            return self._tree(0, len(self.points))
        points = self._literal()
        row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(self.cols)])
        top = 1 << max(0, len(self.points).bit_length() - 1)
        steps = [top >> i for i in range(top.bit_length())]
        return F.aggregate(
            F.array(*[F.lit(s) for s in steps]), F.lit(0),
            lambda low, step: F.when(F.get(points, low + step - 1) <= row, low + step).otherwise(low),
        )

    def _tree(self, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(self._reaches(self.points[mid]), self._tree(mid + 1, high)).otherwise(self._tree(low, mid))

    def _reaches(self, point: tuple) -> Column:
        """Whether the row is at or above the point, column by column; NULLs come first and points hold none."""
        out = F.lit(True)
        for c, v in reversed(list(zip(self.cols, point, strict=True))):
            value = F.lit(v).cast(self.schema[c].dataType)
            out = F.coalesce((F.col(c) > value) | ((F.col(c) == value) & out), F.lit(False))
        return out

    def assign(self, df: DataFrame, salt_on: str | None = None) -> DataFrame:
        df = df.withColumn(BLOCK, self.number())
        if salt_on is None:
            return df
        if not self.salts:
            return df.withColumn(SALT, F.lit(0))
        pieces = F.from_json(F.lit(json.dumps({str(k): v for k, v in self.salts.items()})), "map<string,int>")
        pieces = F.coalesce(F.try_element_at(pieces, F.col(BLOCK).cast("string")), F.lit(1))
        return df.withColumn(SALT, F.pmod(F.xxhash64(salt_on), pieces).cast("int"))


def spread(df: DataFrame, rows: int, *cols: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """Exchange by ``cols`` so that a task gets about ``task_rows`` of the ``rows``, however many there are.

    Beyond one task's rows the number of partitions is given, at least the session's own, as exchanges without one may be coalesced by their
    bytes, which are few beside the memory that windows over their rows take.
    """
    if rows <= task_rows:
        return df.repartition(*cols)
    spark = df.sparkSession
    own = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(own, math.ceil(rows / task_rows)), *cols)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that also matches NULL keys, so no row without a key gets lost."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(right, same, how).drop(*[f"_r_{k}" for k in keys])


def plan_blocks(df: DataFrame, cols: Sequence[str], *, block_rows: int = BLOCK_ROWS,
                split_ties: bool = True, seed: int = 11) -> Blocks:
    """Choose split points for ``cols`` so that blocks hold about ``block_rows`` rows.

    With ``split_ties=False`` equal values of ``cols`` stay in one block; a value heavy enough
    to fill several blocks gets a block of its own, to be salted. The last column must then be
    a long (its successor closes that block).
    """
    cols = list(cols)
    keys = df.select(*cols)
    blocks = Blocks(cols, keys.schema)
    n = blocks.rows = keys.count()
    if n <= block_rows:
        return blocks
    wanted = min(MAX_BLOCKS, math.ceil(n / block_rows))
    fraction = min(1.0, wanted * SAMPLES_PER_BLOCK / n)
    sample = sorted(tuple(r) for r in keys.sample(fraction, seed).na.drop().collect())  # NULLs sort into block 0
    if not sample:
        return blocks
    cuts = [sample[len(sample) * i // wanted] for i in range(1, wanted)]
    if split_ties:
        blocks.points = sorted(set(cuts))
        return blocks
    times = Counter(cuts)
    heavy = {v: m for v, m in times.items() if m > 1}
    closing = {v[:-1] + (v[-1] + 1,) for v in heavy}
    blocks.points = sorted(set(cuts) | closing)
    blocks.salts = {blocks.points.index(v) + 1: m for v, m in heavy.items()}
    return blocks


def with_rank(df: DataFrame, order: Sequence[str], *, by: Sequence[str] = (), out: str = "rank",
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """0-based position of each row by ``order`` (unique within ``by``) without a one-task sort."""
    by, order = list(by), list(order)
    blocks = plan_blocks(df, by + order, block_rows=block_rows)
    if not blocks:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    cut = blocks.assign(df)
    sizes = cut.groupBy(*by, BLOCK).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*by, BLOCK, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    if not by:
        starts = F.broadcast(starts)  # at most MAX_BLOCKS rows
    within = Window.partitionBy(*by, BLOCK).orderBy(*order)
    return (
        join_on(cut.withColumn("_row", F.row_number().over(within)), starts, [*by, BLOCK])
        .withColumn(out, (F.col("_start") + F.col("_row") - 1).cast("long"))
        .drop("_start", "_row", BLOCK)
    )


def prefix_sums(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, *,
                out: str = "running", peak: str | None = None, few: bool = False,
                block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Running sum of ``value`` within ``by`` along ``order``, and its running peak (at least 0).

    ``few`` says that groups are few (models), so that the block sums, a row per block and group, can go to every task.
    """
    by, order = list(by), list(order)
    blocks = plan_blocks(df, by + order, block_rows=block_rows)
    if not blocks:
        w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        done = df.withColumn(out, F.sum(value).over(w))
        return done.withColumn(peak, F.greatest(F.lit(0.0), F.max(out).over(w))) if peak else done
    w = Window.partitionBy(*by, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.assign(df).withColumn("_sum", F.sum(value).over(w))
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        local.groupBy(*by, BLOCK).agg(F.sum(value).alias("_total"), F.max("_sum").alias("_high"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(before), F.lit(0.0)))
        .withColumn("_peak", F.greatest(
            F.lit(0.0), F.coalesce(F.max(F.col("_start") + F.col("_high")).over(before), F.lit(0.0))))
        .select(*by, BLOCK, "_start", "_peak")
    )
    done = join_on(local, F.broadcast(pieces) if few else pieces, [*by, BLOCK]).withColumn(out, F.col("_start") + F.col("_sum"))
    if peak:
        done = done.withColumn(peak, F.greatest("_peak", F.max(out).over(w)))
    return done.drop("_sum", "_start", "_peak", BLOCK)


def narrow_scans(df: DataFrame, columns: dict[str, list[Column]]) -> dict:
    """Aggregates (named) over many columns as one row, a few columns to a scan: code for all at once is too large to be compiled."""
    out: dict = {}
    parts = list(columns.values())
    for i in range(0, len(parts), SCAN_COLUMNS):
        out |= df.agg(*[a for part in parts[i : i + SCAN_COLUMNS] for a in part]).first().asDict()
    return out


@dataclass
class Levels:
    """What one scan tells of columns: rows, values that are not NULL, and (value, times) in order where values are few."""

    rows: int
    counts: dict[str, int]
    few: dict[str, list[tuple[float, int]]]

    def quantile(self, column: str, q: float) -> float:
        """Exact linear-interpolation quantile of a column with few values."""
        upto = list(accumulate(times for _, times in self.few[column]))
        return interpolated(upto[-1], q, lambda rank: self.few[column][bisect_right(upto, rank)][0])


def column_levels(df: DataFrame, cols: Sequence[str], *, most: int = LEVELS) -> Levels:
    """Rows, counts and the distinct values of columns that have at most ``most`` of them, all columns in one scan.

    A task folds its rows to (value, times) per column in Arrow batches and gives a column up once it has more values; what is
    folded is summed by value, and a column with more values in all stays out of the result.
    """
    cols = list(cols)
    rows, counted, level, many = range(4)

    def summed(parts):
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        few = len(values) <= most and not np.isnan(values[-1:]).any()
        return [(values, np.bincount(at, np.concatenate([t for _, t in parts])).astype(np.int64))] if few else None

    def fold(batches):
        n, counts = 0, np.zeros(len(cols), np.int64)
        held: list = [[(np.empty(0), np.empty(0, np.int64))] for _ in cols]
        for batch in batches:
            n += batch.num_rows
            for i in range(len(cols)):
                column = batch.column(i)
                counts[i] += len(column) - column.null_count
                if held[i] is None:
                    continue
                new, times = column.drop_null().value_counts().flatten()
                held[i].append((new.to_numpy(zero_copy_only=False) + 0.0, times.to_numpy(zero_copy_only=False)))  # -0.0 is 0.0
                if sum(len(v) for v, _ in held[i]) > 4 * most:
                    held[i] = summed(held[i])
        held = [parts and summed(parts) for parts in held]
        out = [(rows, -1, None, n), *[(counted, i, None, int(c)) for i, c in enumerate(counts)]]
        for i, found in enumerate(held):
            out += [(many, i, None, 1)] if found is None else [(level, i, float(v), int(t)) for v, t in zip(*found[0])]
        kind, c, v, t = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(c, pa.int32()), pa.array(v, pa.float64()), pa.array(t, pa.int64())], ["kind", "c", "v", "n"])

    narrow = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    folded = narrow.mapInArrow(fold, "kind int, c int, v double, n long").groupBy("kind", "c", "v").agg(F.sum("n").alias("n"))
    sized = folded.withColumn("size", F.count("*").over(Window.partitionBy("kind", "c")))
    with short_methods(df.sparkSession):
        found = sized.where((F.col("kind") != level) | (F.col("size") <= most)).collect()  # at most ``most`` rows and two a column
    counts = dict.fromkeys(cols, 0) | {cols[r["c"]]: r["n"] for r in found if r["kind"] == counted}
    over = {cols[r["c"]] for r in found if r["kind"] == many}
    few: dict[str, list[tuple[float, int]]] = {}
    for r in found:
        if r["kind"] == level and cols[r["c"]] not in over:
            few.setdefault(cols[r["c"]], []).append((r["v"], r["n"]))
    return Levels(sum(r["n"] for r in found if r["kind"] == rows), counts, {c: sorted(v) for c, v in few.items()})


def exact_quantiles(df: DataFrame, quantiles: dict[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles of numeric columns, as driver scalars.

    A sketch of each column (one scan) gives values close around each wanted rank; a counting scan tells how many rows lie below
    and up to these, which proves the bracket or moves its unproven end outwards; only values inside brackets are folded to
    (value, count) and moved. What is shuffled is a share of about ``2 * BRACKET`` of the distinct values, however many columns.
    """
    cols = list(quantiles)
    doubles = {c: F.col(c).cast("double") for c in cols}
    sketch = narrow_scans(df, {c: [F.count(doubles[c]).alias(f"n{i}"), F.percentile_approx(
        doubles[c], [x for q in quantiles[c] for x in (max(0.0, q - BRACKET), min(1.0, q + BRACKET))], SKETCH_ACCURACY).alias(f"e{i}")]
        for i, c in enumerate(cols)})
    totals = {i: sketch[f"n{i}"] for i in range(len(cols)) if sketch[f"n{i}"]}
    # (column, wanted place) -> the bracket's ends, None where it is open, and the ranks in it.
    brackets = {(i, j): [*sketch[f"e{i}"][2 * j : 2 * j + 2], *_ranks(totals[i], q)] for i in totals for j, q in enumerate(quantiles[cols[i]])}
    if not brackets:
        return {c: [None] * len(quantiles[c]) for c in cols}
    below = {at: 0 for at in brackets}
    counts = narrow_scans(df, {at: [F.count_if(doubles[cols[at[0]]] < b[0]).alias("b{}_{}".format(*at)),
                                    F.count_if(doubles[cols[at[0]]] <= b[1]).alias("t{}_{}".format(*at))] for at, b in brackets.items()})
    for (i, j), b in brackets.items():
        if counts[f"b{i}_{j}"] > b[2]:
            b[0] = None
        else:
            below[i, j] = counts[f"b{i}_{j}"]
        if counts[f"t{i}_{j}"] <= b[3]:
            b[1] = None
    # Ends that are equal and proven are the wanted values; such columns (many ties) need not be read again.
    found = {(i, j, k): b[0] + 0.0 for (i, j), b in brackets.items() if b[0] is not None and b[0] == b[1] for k in b[2:]}
    brackets = {at: b for at, b in brackets.items() if (*at, b[2]) not in found}
    found |= _ranked(df, doubles, cols, brackets, below) if brackets else {}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for j, q in enumerate(quantiles[c]):
            if i not in totals:
                out[c].append(None)
                continue
            out[c].append(interpolated(totals[i], q, lambda rank: found[i, j, rank]))
    return out


def interpolated(n: int, q: float, value: Callable[[int], float]) -> float:
    """The quantile between the values at the two ranks around it; tied values stay what they are to the last bit."""
    low, high = _ranks(n, q)
    a, b, at = value(low), value(high), q * (n - 1)
    return a if a == b else (high - at) * a + (at - low) * b


def _ranked(df: DataFrame, doubles: dict[str, Column], cols: list[str], brackets: dict, below: dict) -> dict:
    """(column, wanted place, rank) -> value, from the values inside the brackets folded and in order."""
    inside = []
    for (i, j), b in brackets.items():
        v = doubles[cols[i]]
        held = v.isNotNull() & (F.lit(True) if b[0] is None else v >= b[0]) & (F.lit(True) if b[1] is None else v <= b[1])
        inside.append(F.when(held, F.struct(F.lit(i).alias("c"), F.lit(j).alias("j"), v.alias("v"))))
    parts = [df.select(F.explode(F.array_compact(F.array(*inside[i : i + SCAN_COLUMNS]))).alias("cell")) for i in range(0, len(inside), SCAN_COLUMNS)]
    cells = reduce(DataFrame.union, parts).select("cell.*").groupBy("c", "j", "v").agg(F.count("*").alias("n"))
    levels = materialize(cells.repartitionByRange("c", "j", "v").withColumn(BLOCK, F.spark_partition_id()), "levels")
    sizes = levels.groupBy("c", "j", BLOCK).agg(F.sum("n").alias("size"))
    before = Window.partitionBy("c", "j").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    wanted = sorted({(i, j, k - below[i, j]) for (i, j), b in brackets.items() for k in b[2:]})
    ranks = F.broadcast(df.sparkSession.createDataFrame(wanted, "c int, j int, k long"))  # two for each quantile
    keys = ["c", "j", BLOCK]
    held = starts.join(ranks, ["c", "j"]).where("k >= start AND k < start + size").groupBy(*keys, "start").agg(F.collect_list("k").alias("ks"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))
    picked = levels.join(held, keys).withColumn("upto", upto).select("c", "j", "v", "n", "upto", F.explode("ks").alias("k"))
    return {(r["c"], r["j"], r["k"] + below[r["c"], r["j"]]): r["v"] for r in picked.where("k < upto AND k >= upto - n").collect()}


def _ranks(n: int, q: float) -> tuple[int, int]:
    at = q * (n - 1)
    return math.floor(at), math.ceil(at)


def quantile_table(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(by, edges): exact linear-interpolation quantiles of ``value`` in each group, as a table; groups with a NULL key are left out.

    As :func:`exact_quantiles`, but nothing goes to the driver, whatever the number of groups.
    """
    by, v = list(by), F.col(value).cast("double").alias("v")
    keyed = df.select(*by, v).dropna()
    counts = keyed.groupBy(*by, "v").agg(F.count("*").alias("n"))
    levels = materialize(counts.repartitionByRange(*by, "v").withColumn(BLOCK, F.spark_partition_id()), "levels")
    sizes = levels.groupBy(*by, BLOCK).agg(F.sum("n").alias("size"))
    before = Window.partitionBy(*by).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    probs_ = F.posexplode(F.array(*[F.lit(float(q)) for q in probs])).alias("i", "q")
    wanted = levels.groupBy(*by).agg(F.sum("n").alias("total")).select(*by, "total", probs_)
    wanted = wanted.withColumn("at", F.col("q") * (F.col("total") - 1)).withColumns({"low": F.floor("at"), "high": F.ceil("at")})
    ranks = wanted.select(*by, F.explode(F.array("low", "high")).alias("k")).distinct()
    held = starts.join(ranks, by).where("k >= start AND k < start + size").groupBy(*by, BLOCK, "start").agg(F.collect_list("k").alias("ks"))
    upto = F.col("start") + F.sum("n").over(Window.partitionBy(*by, BLOCK).orderBy("v"))
    picked = levels.join(held, [*by, BLOCK]).withColumn("upto", upto).select(*by, "v", "n", "upto", F.explode("ks").alias("k"))
    found = materialize(picked.where("k < upto AND k >= upto - n").select(*by, "k", "v"), "ranks")
    ends = wanted.join(found.withColumnsRenamed({"k": "low", "v": "a"}), [*by, "low"]).join(found.withColumnsRenamed({"k": "high", "v": "b"}), [*by, "high"])
    point = F.struct("i", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low"))).alias("x"))
    return ends.groupBy(*by).agg(F.array_sort(F.collect_list(point)).alias("e")).select(*by, F.col("e.x").alias("edges"))
