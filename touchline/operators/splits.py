"""Time-aware splits: every split is a range of positions in (date, id) order.

Positions are found once on the two order columns; the wide rows are then labelled by
comparing them with a handful of boundary rows, so no wide row is shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.match import DAY_US, micros, season_sort_key
from touchline.plans.ordering import BLOCK_ROWS, with_rank

ORDER = ["us", "id"]
SPLITS = ["train", "val", "test"]


def _keyed(df: DataFrame, id: str) -> DataFrame:
    return df.select(micros().alias("us"), F.col(id).alias("id"))


def positions(df: DataFrame, id: str = "match_id", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(us, id, rank) of every row."""
    return with_rank(_keyed(df, id), ORDER, block_rows=block_rows)


def boundary_rows(df: DataFrame, ranks: Sequence[int], id: str = "match_id", *,
                  block_rows: int = BLOCK_ROWS) -> dict[int, tuple[int, int]]:
    """The (us, id) at each wanted position; as many driver rows as positions asked for."""
    found = positions(df, id, block_rows=block_rows).filter(F.col("rank").isin(*[int(r) for r in set(ranks)])).collect()
    return {r["rank"]: (r["us"], r["id"]) for r in found}


def _before(bound: tuple[int, int] | None, us: Column, id: Column) -> Column:
    """Row lies before the boundary row; an absent boundary is the end of the data."""
    if bound is None:
        return F.lit(True)
    return (us < bound[0]) | ((us == bound[0]) & (id < bound[1]))


def label_by_rank(df: DataFrame, cuts: Sequence[tuple[str | None, int]], id: str = "match_id", *,
                  out: str = "split", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Label rows by position: ``cuts`` are (label, end position) in order; NULL labels drop out later."""
    bounds = boundary_rows(df, [end for _, end in cuts], id, block_rows=block_rows)
    us, key = micros(), F.col(id)
    label = F.lit(None).cast("string")
    for name, end in reversed(list(cuts)):
        label = F.when(_before(bounds.get(end), us, key), F.lit(name)).otherwise(label)
    return df.withColumn(out, label)


def temporal_split(df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, *, gap_days: int = 0,
                   gap_mode: str = "drop", id: str = "match_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``split``: the first rows train, the next validate, the rest test.

    A gap drops rows dated within ``gap_days`` after the previous part ("drop"); "compat"
    shifts validation and test by the number of validation rows outside the gap.
    """
    if abs(train + val + test - 1.0) > 0.01:
        raise ValueError("ratios must sum to 1")
    n = df.count()
    train_end, val_end = int(n * train), int(n * (train + val))
    if gap_days <= 0:
        return label_by_rank(df, [("train", train_end), ("val", val_end), ("test", n)], id, block_rows=block_rows)
    last = boundary_rows(df, [train_end - 1, val_end - 1], id, block_rows=block_rows)
    limits = {r: us + gap_days * DAY_US for r, (us, _) in last.items()}
    if gap_mode == "compat":
        marked = label_by_rank(df, [("train", train_end), ("val", val_end), ("test", n)], id, block_rows=block_rows)
        shift = marked.filter((F.col("split") == "val") & (micros() > limits[train_end - 1])).count()
        cuts = [("train", train_end), (None, train_end + shift), ("val", min(n, val_end + shift)), ("test", n)]
        return label_by_rank(df, cuts, id, block_rows=block_rows)
    marked = label_by_rank(df, [("train", train_end), ("val", val_end), ("test", n)], id, block_rows=block_rows)
    close = ((F.col("split") == "val") & (micros() <= limits[train_end - 1])) | (
        (F.col("split") == "test") & (micros() <= limits[val_end - 1]))
    return marked.withColumn("split", F.when(~close, F.col("split")))


def split_summary(split: DataFrame) -> DataFrame:
    """Size and date span per part."""
    return split.filter("split IS NOT NULL").groupBy("split").agg(
        F.count("*").alias("n"), F.min("match_date").alias("start"), F.max("match_date").alias("end"))


def rolling_bounds(n: int, n_splits: int, val: float = 0.15, test: float = 0.15) -> list[tuple[int, int, int, int]]:
    """(split number, train end, validation end, test end) from the newest split backwards."""
    size, val_size, out = int(n * test), int(n * val), []
    for i in range(n_splits):
        test_end = n - i * size
        val_end = test_end - size
        train_end = val_end - val_size
        if train_end <= 0:
            break
        out.append((i, train_end, val_end, test_end))
    return out


def rolling_split(df: DataFrame, n_splits: int, *, val: float = 0.15, test: float = 0.15, id: str = "match_id",
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Membership rows (id, split number, part); at most ``n_splits`` copies of a row."""
    n = df.count()
    plan = rolling_bounds(n, n_splits, val, test)
    bounds = boundary_rows(df, [r for _, *ends in plan for r in ends], id, block_rows=block_rows)
    us, key = micros(), F.col(id)
    parts = []
    for number, train_end, val_end, test_end in plan:
        part = F.when(_before(bounds.get(train_end), us, key), "train").when(_before(bounds.get(val_end), us, key), "val").when(
            _before(bounds.get(test_end), us, key), "test")
        parts.append(F.struct(F.lit(number).alias("split_no"), part.alias("part")))
    return df.select(id, "match_date", F.inline(F.array(*parts))).filter("part IS NOT NULL")


def expanding_split(df: DataFrame, *, min_train: int = 100, val_size: int = 50, test_size: int = 50, step: int = 50,
                    id: str = "match_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per split with its end positions and boundary dates.

    The number of splits grows with the data, so rows are not copied into splits here;
    ``split_members`` gives the rows of one.
    """
    n = df.count()
    splits = max(0, (n - min_train - val_size - test_size) // step + 1)
    start = F.col("split_no") * step
    table = df.sparkSession.range(splits).select(F.col("id").alias("split_no")).select(
        "split_no", (start + min_train).alias("train_end_pos"), (start + min_train + val_size).alias("val_end_pos"),
        (start + min_train + val_size + test_size).alias("test_end_pos"))
    marks = {"train_end": F.col("train_end_pos") - 1, "val_start": F.col("train_end_pos"), "val_end": F.col("val_end_pos") - 1,
             "test_start": F.col("val_end_pos"), "test_end": F.col("test_end_pos") - 1}
    wanted = table.select("split_no", F.inline(F.array(*[
        F.struct(F.lit(k).alias("mark"), v.alias("rank")) for k, v in marks.items()])))
    dated = wanted.join(positions(df, id, block_rows=block_rows), "rank").groupBy("split_no").agg(*[
        F.max(F.when(F.col("mark") == k, F.timestamp_micros("us"))).cast("timestamp_ntz").alias(k) for k in marks])
    return table.join(dated, "split_no")


def split_members(df: DataFrame, train_end: int, val_end: int, test_end: int, id: str = "match_id", *,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of one split, labelled; rows past its test part are dropped."""
    cuts = [("train", train_end), ("val", val_end), ("test", test_end), (None, df.count())]
    return label_by_rank(df, cuts, id, block_rows=block_rows).filter("split IS NOT NULL")


def season_split(df: DataFrame, train: int = 3, val: int = 1, test: int = 1, season: str = "season_id") -> DataFrame:
    """The last seasons test, those before validate, those before train; older rows drop out."""
    newest = Window.orderBy(season_sort_key(season).desc())  # one row per season
    ranked = df.select(season).distinct().withColumn("_age", F.row_number().over(newest))
    have = ranked.count()
    if have < train + val + test:
        raise ValueError(f"not enough seasons ({have})")
    age = F.col("_age")
    label = F.when(age <= test, "test").when(age <= test + val, "val").when(age <= test + val + train, "train")
    chosen = ranked.select(season, label.alias("split")).filter("split IS NOT NULL")
    return df.join(chosen, season)


def backtest_split(df: DataFrame, share: float = 0.3, id: str = "match_id", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The first ``int(n * (1 - share))`` rows fit, the rest are scored."""
    n = df.count()
    return label_by_rank(df, [("fit", int(n * (1 - share))), ("score", n)], id, block_rows=block_rows)


def calibration_split(df: DataFrame, share: float = 0.2, id: str = "match_id", *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The last ``int(n * share)`` rows validate."""
    n = df.count()
    return label_by_rank(df, [("train", n - int(n * share)), ("val", n)], id, block_rows=block_rows)
