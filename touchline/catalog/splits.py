"""Splits and preprocessing over the finished matches."""

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from touchline.catalog.base import query
from touchline.functions.match import is_finished
from touchline.operators import prep as P
from touchline.operators import splits as S
from touchline.plans.materialize import fresh_path

DONE = "status = 'FINISHED' AND home_score IS NOT NULL AND away_score IS NOT NULL"
RANKED = f"SELECT id AS match_id, match_date, season_id, row_number() OVER (ORDER BY match_date, id) - 1 AS r, count(*) OVER () AS n FROM matches WHERE {DONE}"


def done(t):
    return t.matches.filter(is_finished()).withColumnRenamed("id", "match_id")


PARTS = "CASE WHEN r < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train' WHEN r < CAST(floor(n * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END"
SPLIT = f"SELECT match_id, match_date, r, n, {PARTS} AS split FROM ({RANKED})"
query("M1_temporal_split", f"SELECT match_id, split FROM ({SPLIT})")(lambda t: S.temporal_split(done(t)).select("match_id", "split"))
query("M1_split_summary", f'SELECT split, count(*) AS n, min(match_date) AS "start", max(match_date) AS "end" FROM ({SPLIT}) GROUP BY split')(
    lambda t: S.split_summary(S.temporal_split(done(t))))
GAP = f"""WITH s AS (SELECT * FROM ({SPLIT})), lim AS (SELECT max(match_date) FILTER (WHERE split = 'train') + INTERVAL '30' DAY AS tl,
    max(match_date) FILTER (WHERE split = 'val') + INTERVAL '30' DAY AS vl FROM s)"""
query("M2_temporal_split_gap", f"""{GAP} SELECT match_id, CASE WHEN split = 'val' AND match_date <= tl THEN NULL WHEN split = 'test' AND match_date <= vl THEN NULL ELSE split END AS split
    FROM s, lim""")(lambda t: S.temporal_split(done(t), gap_days=30).select("match_id", "split"))
query("M2_temporal_split_gap_compat", f"""{GAP}, k AS (SELECT count(*) AS shift FROM s, lim WHERE split = 'val' AND match_date > tl),
    e AS (SELECT CAST(floor(any_value(n) * 0.7::DOUBLE) AS BIGINT) AS te, CAST(floor(any_value(n) * (0.7::DOUBLE + 0.15::DOUBLE)) AS BIGINT) AS ve FROM s)
    SELECT match_id, CASE WHEN r < te THEN 'train' WHEN r < te + shift THEN NULL WHEN r < ve + shift THEN 'val' ELSE 'test' END AS split FROM s, k, e""")(
    lambda t: S.temporal_split(done(t), gap_days=30, gap_mode="compat").select("match_id", "split"))
ROLL = " UNION ALL ".join(f"""SELECT match_id, {i} AS split_no, CASE WHEN r < e - 2 * sz THEN 'train' WHEN r < e - sz THEN 'val' WHEN r < e THEN 'test' END AS part
    FROM (SELECT *, CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS sz, n - {i} * CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS e FROM ({RANKED})) WHERE r < e""" for i in range(3))
query("M3_rolling_split", f"SELECT match_id, split_no, part FROM ({ROLL})")(
    lambda t: S.rolling_split(done(t), 3).select("match_id", "split_no", "part"))
query("M4_expanding_split", f"""SELECT k AS split_no, 100 + 50 * k AS train_end_pos, 150 + 50 * k AS val_end_pos, 200 + 50 * k AS test_end_pos,
    a.match_date AS train_end, b.match_date AS val_start, c.match_date AS val_end, d.match_date AS test_start, e.match_date AS test_end
    FROM (SELECT range AS k FROM range((SELECT (count(*) - 200) // 50 + 1 FROM matches WHERE {DONE})))
    JOIN ({RANKED}) a ON a.r = 99 + 50 * k JOIN ({RANKED}) b ON b.r = 100 + 50 * k JOIN ({RANKED}) c ON c.r = 149 + 50 * k
    JOIN ({RANKED}) d ON d.r = 150 + 50 * k JOIN ({RANKED}) e ON e.r = 199 + 50 * k""")(lambda t: S.expanding_split(done(t)))
query("M5_season_split", f"""SELECT match_id, season_id, CASE WHEN a = 1 THEN 'test' WHEN a = 2 THEN 'val' ELSE 'train' END AS split
    FROM (SELECT match_id, season_id, dense_rank() OVER (ORDER BY season_id DESC) AS a FROM ({RANKED})) WHERE a <= 5""")(
    lambda t: S.season_split(done(t)).select("match_id", "season_id", "split"))
query("M6_backtest_split", f"SELECT match_id, CASE WHEN r < CAST(floor(n * (1 - 0.3::DOUBLE)) AS BIGINT) THEN 'fit' ELSE 'score' END AS split FROM ({RANKED})")(
    lambda t: S.backtest_split(done(t)).select("match_id", "split"))
query("M7_calibration_split", f"SELECT match_id, CASE WHEN r < n - CAST(floor(n * 0.2::DOUBLE) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM ({RANKED})")(
    lambda t: S.calibration_split(done(t)).select("match_id", "split"))

NUMS = ["odds_home", "odds_draw", "odds_away", "num_bookmakers", "home_score"]


def r9(df, cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


def numbers(t):
    return t.matches.select(F.col("id").alias("match_id"), *[F.col(c).cast("double").alias(c) for c in NUMS])


FILLS = {"median": "SELECT median({0}) FROM matches", "mean": "SELECT avg({0}) FROM matches",
         "most_frequent": "SELECT {0} FROM matches WHERE {0} IS NOT NULL GROUP BY {0} ORDER BY count(*) DESC, {0} LIMIT 1"}
for how, fill in FILLS.items():
    filled = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), ({fill.format(c)})), 9) AS {c}" for c in NUMS)
    query(f"M8_impute_{how}", f"SELECT id AS match_id, {filled} FROM matches")(
        lambda t, how=how: r9(P.ExactImputer(columns=NUMS, strategy=how).fit(numbers(t)).transform(numbers(t)), NUMS))
query("M8_impute_constant_flags", "SELECT id AS match_id, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), -1.0::DOUBLE) AS {c}, CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}_missing" for c in NUMS) + " FROM matches")(
    lambda t: P.ExactImputer(columns=NUMS, strategy="constant", fillValue=-1.0, indicators=True).fit(numbers(t)).transform(numbers(t)))
IMPUTED = "SELECT id AS match_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM matches)) AS {c}" for c in NUMS) + " FROM matches"
SCALED = "SELECT match_id, " + ", ".join(
    f"round(({c} - (SELECT avg({c}) FROM ({IMPUTED}))) / (SELECT stddev_pop({c}) FROM ({IMPUTED})), 9) AS {c}" for c in NUMS) + f" FROM ({IMPUTED})"


def scaled(t):
    model = P.feature_pipeline(NUMS, vector=None).fit(numbers(t))
    return model, model.transform(numbers(t))


query("M9_standard_scale", SCALED)(lambda t: r9(scaled(t)[1], NUMS))
query("M9_inverse_scale", "SELECT match_id, " + ", ".join(f"round({c}, 9) AS {c}" for c in NUMS) + f" FROM ({IMPUTED})")(
    lambda t: r9((lambda m, df: m.stages[1].inverse(df))(*scaled(t)), NUMS))
query("M10_variance_select", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n FROM matches HAVING var_pop({c}) > 1" for c in NUMS))(
    lambda t: numbers(t).agg(F.count("*").alias("n")).select(F.explode(F.array(*[
        F.lit(c) for c in P.variance_select(numbers(t), NUMS, 1.0)])).alias("feature"), "n"))


@query("S11_feature_pipeline_save_load", SCALED)
def pipeline_roundtrip(t):
    path = fresh_path(t.spark, "pipeline")
    model, _ = scaled(t)
    model.write().overwrite().save(path)
    return r9(PipelineModel.load(path).transform(numbers(t)), NUMS)


TRAIN_FILLED = f"""SELECT s.match_id, s.split, {", ".join(f"coalesce(CAST(m.{c} AS DOUBLE), f.{c}) AS {c}" for c in NUMS)}
    FROM ({SPLIT}) s JOIN matches m ON m.id = s.match_id,
    (SELECT {", ".join(f"median(x.{c}) AS {c}" for c in NUMS)} FROM ({SPLIT}) y JOIN matches x ON x.id = y.match_id WHERE y.split = 'train') f"""


@query("M11_pipeline", f"""WITH v AS ({TRAIN_FILLED}), p AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in NUMS)} FROM v WHERE split = 'train')
    SELECT match_id, split, {", ".join(f"round(({c} - m_{c}) / s_{c}, 9) AS {c}" for c in NUMS)} FROM v, p""")
def fit_on_train_only(t):
    rows = S.temporal_split(done(t)).select("match_id", "split", *[F.col(c).cast("double").alias(c) for c in NUMS])
    return r9(P.feature_pipeline(NUMS, vector=None).fit(rows.filter("split = 'train'")).transform(rows), NUMS)
