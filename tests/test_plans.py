"""Block-wise plans against brute force on data with hot keys and ties."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators.history import side_features
from touchline.plans import ordering
from touchline.plans.asof import asof_count, asof_trailing, trailing_rows
from touchline.plans.ordering import column_levels, exact_quantiles, narrow_scans, plan_blocks, prefix_sums, spread, with_rank


def rows_with_hot_key(n=3000, seed=5, ties=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = 1 if rng.random() < 0.4 else rng.randint(2, 60)
        us = 500 if ties and key == 1 and rng.random() < 0.6 else rng.randint(0, 1000)
        out.append((key, us, i, rng.random() < 0.8, rng.random() < 0.5, rng.randint(0, 3)))
    return pd.DataFrame(out, columns=["k", "us", "match_id", "is_hist", "sub", "v"])


def brute(pdf, n, sub=False):
    """Sum over the last n history rows strictly before, and how many there are."""
    want = {}
    for (_, g) in pdf.groupby("k"):
        hist = g[g.is_hist].sort_values(["us", "match_id"])
        for r in g.itertuples():
            h = hist[hist.us < r.us]
            if sub:
                h = h[h["sub"] == r.sub]
            last = h.tail(n)
            want[r.match_id] = (len(h), int(last.v.sum()) if len(last) else None)
    return want


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("block_rows", [100, 10_000_000])
def test_asof_trailing_equals_brute_force(spark, ties, block_rows):
    pdf = rows_with_hot_key(ties=ties)
    df = spark.createDataFrame(pdf).repartition(5)
    got = asof_trailing(df, ["k"], {"s": ("v", 4, 1), "old": ("v", 6, 4)}, sub="sub", sub_frames={"s": ("v", 3, 1)},
                        lists={"l": ("v", 4)}, block_rows=block_rows).select(
        "match_id", "last.s", "last.old", "last.l", F.col("last_sub.s").alias("sub_s")).collect()
    assert len(got) == len(pdf)
    all4, sub3 = brute(pdf, 4), brute(pdf, 3, sub=True)
    all6, all3 = brute(pdf, 6), brute(pdf, 3)
    for r in got:
        assert r["s"] == all4[r["match_id"]][1]
        assert (sum(r["l"]) if r["l"] is not None else None) == all4[r["match_id"]][1]
        assert r["sub_s"] == sub3[r["match_id"]][1]
        n, six = all6[r["match_id"]]
        if n >= 4:
            assert r["old"] == six - all3[r["match_id"]][1]


def test_heavy_tie_gets_its_own_salted_block(spark):
    df = spark.createDataFrame(rows_with_hot_key(ties=True))
    blocks = plan_blocks(df, ["k", "us"], block_rows=100, split_ties=False)
    assert blocks and blocks.salts
    sizes = blocks.assign(df, salt_on="match_id").groupBy("k", "_blk", "_salt").count().agg(F.max("count")).first()[0]
    assert sizes < 400  # the tied value alone has over 700 rows


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("block_rows", [100, 10_000_000])
def test_asof_count(spark, ties, block_rows):
    pdf = rows_with_hot_key(ties=ties)
    got = asof_count(spark.createDataFrame(pdf), ["k"], block_rows=block_rows).select("match_id", "count_before").collect()
    want = brute(pdf, 1)
    assert {r["match_id"]: r["count_before"] for r in got} == {k: v[0] for k, v in want.items()}


@pytest.mark.parametrize("block_rows", [100, 10_000_000])
def test_trailing_rows(spark, block_rows):
    pdf = rows_with_hot_key()
    got = trailing_rows(spark.createDataFrame(pdf), ["k"], {"s": ("v", 5, 1)}, block_rows=block_rows)
    got = {r["match_id"]: (r["s"], r["s_n"]) for r in got.collect()}
    for _, g in pdf.groupby("k"):
        g = g.sort_values(["us", "match_id"])
        for i, r in enumerate(g.itertuples()):
            prev = g.iloc[max(0, i - 5):i].v
            assert got[r.match_id] == (int(prev.sum()) if len(prev) else None, len(prev))


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("block_rows", [70, 10_000_000])
def test_with_rank(spark, by, block_rows):
    pdf = rows_with_hot_key(ties=True)
    got = with_rank(spark.createDataFrame(pdf), ["us", "match_id"], by=by, block_rows=block_rows).toPandas()
    pdf = pdf.sort_values(["us", "match_id"])
    pdf["want"] = pdf.groupby("k").cumcount() if by else range(len(pdf))
    both = got.merge(pdf[["match_id", "want"]], on="match_id")
    assert len(both) == len(pdf) and (both["rank"] == both["want"]).all()


@pytest.mark.parametrize("block_rows", [90, 10_000_000])
def test_prefix_sums_and_peak(spark, block_rows):
    pdf = rows_with_hot_key(ties=True)
    pdf["x"] = (pdf.v - 1.6).astype(float)
    got = prefix_sums(spark.createDataFrame(pdf), ["k"], ["us", "match_id"], "x", peak="peak", block_rows=block_rows).toPandas()
    pdf = pdf.sort_values(["us", "match_id"])
    pdf["want"] = pdf.groupby("k").x.cumsum()
    pdf["want_peak"] = pdf.groupby("k").want.cummax().clip(lower=0)
    both = got.merge(pdf[["match_id", "want", "want_peak"]], on="match_id")
    assert len(both) == len(pdf)
    assert (both.running - both.want).abs().max() < 1e-9 and (both.peak - both.want_peak).abs().max() < 1e-9


def test_exact_quantiles(spark):
    rng = random.Random(3)
    pdf = pd.DataFrame({"a": [rng.gauss(0, 1) for _ in range(4001)], "b": [float(rng.randint(0, 4)) for _ in range(4001)]})
    pdf.loc[::7, "a"] = None
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None))), {"a": qs, "b": qs})
    for c in "ab":
        assert got[c] == pytest.approx(list(pdf[c].quantile(qs)), abs=1e-12)


def test_quantiles_at_the_border_of_two_values(spark):
    df = spark.range(10_000).select((F.col("id") % 2).cast("double").alias("half"), (F.col("id") % 5 < 2).cast("int").alias("some"), F.lit(None).cast("double").alias("none"))
    got = exact_quantiles(df, {"half": [0.25, 0.5, 0.75], "some": [0.5, 0.6, 0.9], "none": [0.5]})
    assert got == {"half": [0.0, 0.5, 1.0], "some": [0.0, pytest.approx(0.4), 1.0], "none": [None]}


def test_blocks_follow_key_order(spark):
    df = spark.createDataFrame([(f"k{i % 3}", i) for i in range(300)], "k string, us long")
    blocks = plan_blocks(df, ["k", "us"], block_rows=50)
    rows = sorted((r["k"], r["us"], r["_blk"]) for r in blocks.assign(df).collect())
    assert [r[2] for r in rows] == sorted(r[2] for r in rows) and rows[-1][2] > 3


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([(None if i % 2 else 1, i % 5, i, float(i)) for i in range(300)], "k int, us int, match_id int, x double")
    got = with_rank(df, ["us", "match_id"], by=["k"], block_rows=40)
    assert got.count() == 300 and got.filter("k IS NULL").agg(F.max("rank")).first()[0] == 149
    sums = prefix_sums(df, ["k"], ["us", "match_id"], "x", block_rows=40)
    assert sums.filter("k IS NULL").agg(F.max("running")).first()[0] == sum(i for i in range(300) if i % 2)


def test_spread_bounds_the_rows_of_a_task(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 500)
    assert spread(df, 1_000_000_000, "k").rdd.getNumPartitions() == 4000
    assert max(r["n"] for r in spread(df, 1000, "k", task_rows=50).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()) < 200
    assert "REPARTITION_BY_NUM" not in spread(df, 1000, "k")._jdf.queryExecution().executedPlan().toString()
    # Few partitions that the session's own would cover get their number too, or they are coalesced by bytes.
    assert "REPARTITION_BY_NUM" in spread(df, 1000, "k", task_rows=900)._jdf.queryExecution().executedPlan().toString()


def test_team_windows_get_tasks_by_their_rows(spark, make_matches, monkeypatch):
    monkeypatch.setattr(ordering.spread, "__kwdefaults__", {"task_rows": 10})
    df = make_matches([(i % 40, 40 + i % 7, 1, 0) for i in range(200)])
    plan = side_features(df, (3,))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [team_id" in plan and ", 40" in plan  # 400 rows of teams


def test_narrow_scans_give_one_row_for_all_columns(spark):
    cols = [f"c{i}" for i in range(25)]
    df = spark.range(50).select(*[(F.col("id") * i).cast("double").alias(c) for i, c in enumerate(cols)])
    asked = {c: [F.sum(c).alias(f"s_{c}"), F.max(c).alias(f"m_{c}")] for c in cols}
    scans = []
    df.agg = lambda *a, agg=df.agg: scans.append(len(a)) or agg(*a)
    row = narrow_scans(df, asked)
    assert row == {f"s_c{i}": 1225.0 * i for i in range(25)} | {f"m_c{i}": 49.0 * i for i in range(25)} and scans == [22, 22, 6]


def test_tails_are_sorted_in_tasks_by_their_rows(spark, monkeypatch):
    """Where the rows are read nothing is sorted: the limit to the newest rows of a block stands behind an exchange by rows."""
    monkeypatch.setattr(ordering.spread, "__kwdefaults__", {"task_rows": 30})
    got = asof_trailing(spark.createDataFrame(rows_with_hot_key()), ["k"], {"s": ("v", 4, 1)}, sub="sub", sub_frames={"s": ("v", 3, 1)}, block_rows=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and plan.count(", 100") >= 2  # 3,000 rows, the windows' and the tails'


@pytest.mark.parametrize("limit", [0, 64])
def test_compiled_and_folded_search_give_the_same_blocks(spark, monkeypatch, limit):
    monkeypatch.setattr(ordering, "TREE_POINTS", limit)
    rows = [(None if i % 11 == 0 else f"k{i % 3}", None if i % 13 == 0 else float("nan") if i % 17 == 0 else i / 7, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x double, id long")
    points = [("k0", 5.0, 3), ("k0", 5.0, 35), ("k1", 0.0, 0), ("k1", 30.0, 211), ("k2", float("nan"), 200)]
    blocks = ordering.Blocks(["k", "x", "id"], df.schema, points)

    def order(v):
        return [(v_ is not None, v_ != v_, 0 if v_ is None or v_ != v_ else v_) for v_ in v]

    want = {r[2]: sum(order(p) <= order(r) for p in points) for r in rows}
    assert {r["id"]: r["n"] for r in df.select("id", blocks.number().alias("n")).collect()} == want
    assert ("lambda" in df.select(blocks.number())._jdf.queryExecution().optimizedPlan().toString()) == (limit == 0)


def test_tied_columns_are_not_read_again_for_quantiles(spark, monkeypatch):
    asked = []
    ranked = ordering._ranked
    monkeypatch.setattr(ordering, "_ranked", lambda df, doubles, cols, brackets, below: asked.append(sorted(brackets)) or ranked(df, doubles, cols, brackets, below))
    df = spark.range(10_001).select((F.col("id") % 3).alias("tied"), F.col("id").cast("double").alias("apart"), F.lit(-0.0).alias("one"))
    assert exact_quantiles(df, {"tied": [0.5, 0.9], "apart": [0.5], "one": [0.5]}) == {"tied": [1.0, 2.0], "apart": [5000.0], "one": [0.0]}
    assert asked == [[(1, 0)]]
    assert exact_quantiles(df, {"tied": [0.5]}) == {"tied": [1.0]} and len(asked) == 1


@pytest.mark.parametrize("block_rows", [100, 10_000_000])
def test_asked_rows_get_what_all_rows_get(spark, block_rows):
    pdf = rows_with_hot_key(ties=True)
    df = spark.createDataFrame(pdf).repartition(5).withColumn("asked", F.expr("match_id % 7 = 0 AND us > 300 OR NOT is_hist AND us > 900"))
    frames = {"s": ("v", 4, 1), "old": ("v", 6, 4)}
    cols = ["match_id", "last.s", "last.old", F.least("last.seq", F.lit(6)).alias("n"), F.col("last_sub.s").alias("sub_s"), F.least("last_sub.seq", F.lit(6)).alias("sub_n")]
    whole = asof_trailing(df, ["k"], frames, sub="sub", sub_frames={"s": ("v", 3, 1)}, block_rows=block_rows)
    some = asof_trailing(df, ["k"], frames, sub="sub", sub_frames={"s": ("v", 3, 1)}, asked="asked", block_rows=block_rows)
    want = whole.filter("asked").select(*cols).orderBy("match_id").collect()
    assert want and some.select(*cols).orderBy("match_id").collect() == want


def test_levels_of_all_columns_in_one_scan(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 0.0, -0.0, 1.5, 7.0]), rng.random(), 0.1, None if i % 2 else 4.0, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "few double, lots double, same double, gaps double, none double").repartition(7)
    cols = df.columns
    levels = column_levels(df, cols, most=50)
    assert levels.rows == 3000 and levels.counts["none"] == 0 and levels.counts["gaps"] == 1500
    assert set(levels.few) == {"few", "same", "gaps"} and [v for v, _ in levels.few["few"]] == [0.0, 1.5, 7.0]
    pdf = df.toPandas()
    for c in levels.few:
        for q in (0.0, 0.3, 0.5, 1.0):
            assert levels.quantile(c, q) == pytest.approx(pdf[c].quantile(q))
