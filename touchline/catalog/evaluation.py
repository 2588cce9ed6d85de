"""Classification, calibration, betting and drift queries over the stored predictions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.catalog.base import query
from touchline.operators import calibration as K
from touchline.operators import evaluation as E
from touchline.operators import history as H


def scored(t):
    return E.scored_frame(t.predictions, t.matches)


def r9(df, *cols, digits=9):
    """Sums of doubles depend on their order: round on both sides."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


def metric(*cols, names=None):
    def run(t):
        m = r9(E.classification_metrics(scored(t)), *cols)
        return m.select("model_version_id", *cols)
    return run


P_LABEL = "CASE label WHEN 0 THEN prob_home WHEN 1 THEN prob_draw ELSE prob_away END"
BRIER = """(power(prob_home - CAST(label = 0 AS DOUBLE), 2) + power(prob_draw - CAST(label = 1 AS DOUBLE), 2) + power(prob_away - CAST(label = 2 AS DOUBLE), 2)) / 3"""
TOP2 = """CAST(list_contains(list_slice(list_sort([struct_pack(p := -prob_home, c := 0), struct_pack(p := -prob_draw, c := -1), struct_pack(p := -prob_away, c := -2)]), 1, 2), struct_pack(p := -({0}), c := -label)) AS DOUBLE)""".format(P_LABEL)
EPS = "2.220446049250313e-16"
LOGLOSS = f"-ln(greatest(least({P_LABEL}, 1 - {EPS}), {EPS}))"
BASIC = f"""SELECT model_version_id, count(*) AS n, avg(CAST(label = pred AS DOUBLE)) AS accuracy, avg({LOGLOSS}) AS log_loss,
    avg(-ln({P_LABEL} + 1e-10)) AS log_loss_eps, avg({BRIER}) AS brier_score, avg({TOP2}) AS top_2_accuracy
    FROM scored GROUP BY model_version_id"""
for key, col in (("E1_accuracy", "accuracy"), ("E2_log_loss_clip", "log_loss"), ("E3_log_loss_eps", "log_loss_eps"),
                 ("E4_brier", "brier_score"), ("E8_top2_accuracy", "top_2_accuracy")):
    query(key, f"SELECT model_version_id, round({col}, 9) AS {col} FROM ({BASIC})")(metric(col))

query("E5_confusion", f"SELECT model_version_id, label, pred, n FROM (" + " UNION ALL ".join(
    f"SELECT model_version_id, {i} AS label, {j} AS pred, count(*) FILTER (WHERE label = {i} AND pred = {j}) AS n FROM scored GROUP BY model_version_id"
    for i in range(3) for j in range(3)) + ")")(lambda t: E.confusion(scored(t)))
PRF = " UNION ALL ".join(f"""SELECT model_version_id, {i} AS cls, '{o}' AS outcome,
    coalesce(count(*) FILTER (WHERE label = {i} AND pred = {i}) / nullif(CAST(count(*) FILTER (WHERE pred = {i}) AS DOUBLE), 0), 0) AS "precision",
    coalesce(count(*) FILTER (WHERE label = {i} AND pred = {i}) / nullif(CAST(count(*) FILTER (WHERE label = {i}) AS DOUBLE), 0), 0) AS recall,
    coalesce(2 * count(*) FILTER (WHERE label = {i} AND pred = {i}) / nullif(CAST(count(*) FILTER (WHERE label = {i}) + count(*) FILTER (WHERE pred = {i}) AS DOUBLE), 0), 0) AS f1,
    count(*) FILTER (WHERE label = {i}) AS support, count(*) FILTER (WHERE pred = {i}) AS called, count(*) AS n
    FROM scored GROUP BY model_version_id""" for i, o in enumerate("HDA"))
query("E6_prf_per_class", f"""SELECT model_version_id, outcome, round("precision", 9) AS "precision", round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM ({PRF})""")(
    lambda t: r9(E.prf_per_class(scored(t)), "precision", "recall", "f1"))
MACRO = f"""SELECT model_version_id, """ + ", ".join(
    f"""sum("{m}") / count(*) FILTER (WHERE support + called > 0) AS {m}_macro, sum("{m}" * support) / any_value(n) AS {m}_weighted"""
    for m in ("precision", "recall", "f1")) + f" FROM ({PRF}) GROUP BY model_version_id"
MACRO_COLS = [f"{m}_{k}" for m in ("precision", "recall", "f1") for k in ("macro", "weighted")]
query("E7_prf_macro_weighted", f"SELECT model_version_id, {', '.join(f'round({c}, 9) AS {c}' for c in MACRO_COLS)} FROM ({MACRO})")(
    metric(*MACRO_COLS))
KAPPA = f"""SELECT model_version_id, (po - pe) / (1 - pe) AS cohen_kappa FROM (
    SELECT model_version_id, any_value(accuracy) AS po, sum(support * CAST(called AS DOUBLE)) / (any_value(n) * CAST(any_value(n) AS DOUBLE)) AS pe
    FROM (SELECT p.*, b.accuracy FROM ({PRF}) p JOIN ({BASIC}) b USING (model_version_id)) GROUP BY model_version_id)"""
query("E9_cohen_kappa", f"SELECT model_version_id, round(cohen_kappa, 9) AS cohen_kappa FROM ({KAPPA})")(metric("cohen_kappa"))
query("E10_outcome_accuracy", f"""SELECT model_version_id, outcome, round("precision", 9) AS accuracy FROM ({PRF})""")(
    lambda t: r9(E.outcome_accuracy(scored(t)), "accuracy"))

BET_SUMS = """SELECT model_version_id, count(*) AS total_bets, count(*) FILTER (WHERE hit = 1) AS winning_bets, count(*) FILTER (WHERE hit = 0) AS losing_bets,
    sum(stake) AS total_stake, sum(stake * odds * hit) AS total_return, avg(odds) FILTER (WHERE hit = 1) AS average_winning_odds,
    avg(odds) FILTER (WHERE hit = 0) AS average_losing_odds, avg(kelly) AS average_kelly_fraction,
    avg(profit) / (stddev_pop(profit) + 1e-10) AS sharpe_ratio FROM bets GROUP BY model_version_id"""
BET_COLS = ["total_stake", "total_return", "average_winning_odds", "average_losing_odds", "average_kelly_fraction", "sharpe_ratio"]
BET_MORE = ["profit_loss", "roi_percent", "yield_percent", "win_rate", "optimal_kelly_fraction"]
BETTING = f"""SELECT *, total_return - total_stake AS profit_loss, (total_return - total_stake) / total_stake * 100 AS roi_percent,
    (total_return - total_stake) / total_stake * 100 AS yield_percent, CAST(winning_bets AS DOUBLE) / total_bets AS win_rate,
    average_kelly_fraction * 4 AS optimal_kelly_fraction FROM ({BET_SUMS})"""
query("E11_betting_sim", f"""SELECT model_version_id, total_bets, winning_bets, losing_bets, {", ".join(f"round({c}, 6) AS {c}" for c in BET_COLS + BET_MORE)}
    FROM ({BETTING})""")(lambda t: r9(E.betting_sim(E.bets(scored(t))), *BET_COLS, *BET_MORE, digits=6))
query("E14_sharpe", f"SELECT model_version_id, round(sharpe_ratio, 6) AS sharpe_ratio FROM ({BETTING})")(
    lambda t: r9(E.betting_sim(E.bets(scored(t))), "sharpe_ratio", digits=6).select("model_version_id", "sharpe_ratio"))
CURVE = """SELECT model_version_id, match_id, cls, sum(profit) OVER (PARTITION BY model_version_id ORDER BY match_date, match_id, cls ROWS UNBOUNDED PRECEDING) AS equity,
    match_date FROM bets"""
query("E12_equity_curve", f"SELECT model_version_id, match_id, cls, round(equity, 6) AS equity FROM ({CURVE})")(
    lambda t: r9(E.equity_curve(E.bets(scored(t))), "equity", digits=6).select("model_version_id", "match_id", "cls", "equity"))
DRAWDOWN = f"""SELECT model_version_id, greatest(0.0::DOUBLE, max(CASE WHEN peak > 0 THEN (peak - equity) / (peak + 1e-10) ELSE 0 END)) AS max_drawdown FROM (
    SELECT model_version_id, equity, greatest(0.0::DOUBLE, max(equity) OVER (PARTITION BY model_version_id ORDER BY match_date, match_id, cls ROWS UNBOUNDED PRECEDING)) AS peak
    FROM ({CURVE})) GROUP BY model_version_id"""
query("E13_max_drawdown", f"SELECT model_version_id, round(max_drawdown, 6) AS max_drawdown FROM ({DRAWDOWN})")(
    lambda t: r9(E.max_drawdown(E.bets(scored(t))), "max_drawdown", digits=6))

EDGES = K.linspace_edges()
LEFT_OPEN = f"CASE WHEN prob > 0 AND prob <= 1 THEN {' + '.join(f'CAST(prob > {e!r}::DOUBLE AS INT)' for e in EDGES[1:-1])} END"
CLOSED = f"CASE WHEN prob >= 0 AND prob <= 1 THEN {' + '.join(f'CAST(prob > {e!r}::DOUBLE AS INT)' for e in EDGES[1:-1])} END"


def binned(expr):
    return f"""SELECT * FROM (SELECT model_version_id, cls, {expr} AS bin, count(*) AS n, avg(prob) AS mean_predicted, avg(CAST(hit AS DOUBLE)) AS mean_actual
        FROM by_class GROUP BY ALL) WHERE bin IS NOT NULL"""


ECE_SUM = f"""SELECT b.model_version_id, sum(abs(mean_predicted - mean_actual) * b.n / CAST(t.n AS DOUBLE)) AS expected_calibration_error,
    max(abs(mean_predicted - mean_actual)) AS maximum_calibration_error
    FROM ({binned(LEFT_OPEN)}) b JOIN (SELECT model_version_id, count(*) AS n FROM scored GROUP BY 1) t USING (model_version_id) GROUP BY b.model_version_id"""
ECE_COLS = ["expected_calibration_error", "maximum_calibration_error"]
query("E15_ece_mce_sum", f"SELECT model_version_id, {', '.join(f'round({c}, 9) AS {c}' for c in ECE_COLS)} FROM ({ECE_SUM})")(
    lambda t: r9(K.ece_mce_sum(scored(t)), *ECE_COLS))
query("E16_calibration_curve", f"""SELECT model_version_id, cls, CAST(bin AS INT) AS bin, round(mean_predicted, 9) AS mean_predicted, round(mean_actual, 9) AS mean_actual
    FROM ({binned(LEFT_OPEN)})""")(lambda t: r9(K.calibration_curve(scored(t)), "mean_predicted", "mean_actual"))
LOW, HIGH = (f"list_extract([{', '.join(repr(e) + '::DOUBLE' for e in EDGES)}], g.bin + {k})" for k in (1, 2))
BINS = f"""SELECT g.model_version_id, g.cls, CAST(g.bin AS INT) AS bin, {LOW} AS bin_lower, {HIGH} AS bin_upper,
    coalesce(mean_predicted, ({LOW} + {HIGH}) / 2) AS mean_predicted, coalesce(mean_actual, 0.0::DOUBLE) AS mean_actual, coalesce(n, 0) AS count
    FROM (SELECT DISTINCT model_version_id, cls, unnest(range(10)) AS bin FROM by_class) g
    LEFT JOIN ({binned(CLOSED)}) b ON b.model_version_id = g.model_version_id AND b.cls = g.cls AND b.bin = g.bin"""
query("E17_calibration_bins", f"""SELECT model_version_id, cls, bin, bin_lower, bin_upper, round(mean_predicted, 9) AS mean_predicted,
    round(mean_actual, 9) AS mean_actual, count FROM ({BINS})""")(
    lambda t: r9(K.calibration_bins(scored(t)), "mean_predicted", "mean_actual"))
QUANTILES = "[" + ", ".join(f"{i / 10!r}" for i in range(11)) + "]"
QBINS = f"""SELECT g.model_version_id, g.cls, CAST(g.bin AS INT) AS bin, e[g.bin + 1] AS bin_lower, e[g.bin + 2] AS bin_upper,
    coalesce(avg(prob), (e[g.bin + 1] + e[g.bin + 2]) / 2) AS mean_predicted, coalesce(avg(CAST(hit AS DOUBLE)), 0.0::DOUBLE) AS mean_actual, count(prob) AS count
    FROM (SELECT model_version_id, cls, quantile_cont(prob, {QUANTILES}) AS e, unnest(range(10)) AS bin FROM by_class GROUP BY model_version_id, cls) g
    LEFT JOIN by_class b ON b.model_version_id = g.model_version_id AND b.cls = g.cls AND b.prob <= e[g.bin + 2] AND (b.prob > e[g.bin + 1] OR (g.bin = 0 AND b.prob >= e[1])) GROUP BY g.model_version_id, g.cls, g.bin, e"""
query("E17_calibration_bins_quantile", f"""SELECT model_version_id, cls, bin, round(bin_lower, 9) AS bin_lower, round(bin_upper, 9) AS bin_upper,
    round(mean_predicted, 9) AS mean_predicted, round(mean_actual, 9) AS mean_actual, count FROM ({QBINS})""")(
    lambda t: r9(K.quantile_bins(scored(t)), "bin_lower", "bin_upper", "mean_predicted", "mean_actual"))


def errors(t):
    return K.calibration_errors(K.calibration_bins(scored(t)))


ERRORS = f"""SELECT model_version_id, cls, sum(abs(mean_predicted - mean_actual) * count) / sum(count) AS ece, max(abs(mean_predicted - mean_actual)) AS mce,
    sqrt(sum(power(mean_predicted - mean_actual, 2) * count) / sum(count)) AS rmse,
    CASE WHEN count(*) > 1 THEN corr(mean_predicted, mean_actual) ELSE 1.0::DOUBLE END AS correlation
    FROM ({BINS}) WHERE count > 0 GROUP BY model_version_id, cls"""
query("E18_calibration_errors", f"SELECT model_version_id, cls, round(ece, 9) AS ece, round(mce, 9) AS mce, round(rmse, 9) AS rmse FROM ({ERRORS})")(
    lambda t: r9(errors(t), "ece", "mce", "rmse").drop("correlation"))
query("E19_calibration_corr", f"SELECT model_version_id, cls, round(correlation, 9) AS correlation FROM ({ERRORS})")(
    lambda t: r9(errors(t), "correlation").select("model_version_id", "cls", "correlation"))
OVERALL = f"SELECT model_version_id, avg(ece) AS overall_ece, 1.0::DOUBLE - least(avg(ece), 1.0::DOUBLE) AS reliability_score FROM ({ERRORS}) GROUP BY model_version_id"
query("E20_calibration_overall", f"SELECT model_version_id, round(overall_ece, 9) AS overall_ece, round(reliability_score, 9) AS reliability_score FROM ({OVERALL})")(
    lambda t: r9(K.calibration_overall(errors(t)), "overall_ece", "reliability_score"))
query("E21_hosmer_lemeshow_chi2", f"""SELECT model_version_id, cls, round(sum(power(mean_actual * count - mean_predicted * count, 2) / (mean_predicted * count + 1e-10)), 6) AS chi2
    FROM ({QBINS}) WHERE count > 0 GROUP BY model_version_id, cls""")(
    lambda t: r9(K.hosmer_lemeshow(scored(t)), "chi2", digits=6).select("model_version_id", "cls", "chi2"))
CHI2 = f"SELECT model_version_id, cls, sum(power(mean_actual * count - mean_predicted * count, 2) / (mean_predicted * count + 1e-10)) AS chi2, count(*) AS bins FROM ({QBINS}) WHERE count > 0 GROUP BY model_version_id, cls"
# The lower tail as the power series of the incomplete gamma function, term by term.
query("E21_hosmer_lemeshow_pvalue", f"""SELECT model_version_id, cls, round(CASE WHEN bins > 2 THEN any_value(chi2) ELSE 0.0::DOUBLE END, 6) AS chi2,
    round(CASE WHEN bins <= 2 OR any_value(chi2) <= 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - sum(exp(-chi2 / 2 + ((bins - 1) / 2.0::DOUBLE + n) * ln(greatest(chi2, 1e-300::DOUBLE) / 2) - lgamma((bins - 1) / 2.0::DOUBLE + n + 1))) END, 9) AS p_value
    FROM ({CHI2}) CROSS JOIN range(0, 4000) r(n) GROUP BY model_version_id, cls, bins""")(
    lambda t: r9(r9(K.hosmer_lemeshow(scored(t)), "chi2", digits=6), "p_value"))
query("E22_calibration_large", """SELECT model_version_id, cls, round(avg(power(prob - hit, 2)), 9) AS brier_score,
    round(avg(CAST(hit AS DOUBLE)) - avg(prob), 9) AS calibration_intercept FROM by_class GROUP BY model_version_id, cls""")(
    lambda t: r9(K.calibration_large(scored(t)), "brier_score", "calibration_intercept"))


@query("E23_reliability_data", f"""SELECT b.model_version_id, list_extract(['Home Win', 'Draw', 'Away Win'], b.cls + 1) AS name, b.bin,
    round(b.mean_predicted, 9) AS predicted, round(b.mean_actual, 9) AS actual, b.count AS n, round(e.ece, 9) AS ece, round(e.mce, 9) AS mce
    FROM ({BINS}) b JOIN ({ERRORS}) e ON e.model_version_id = b.model_version_id AND e.cls = b.cls WHERE b.count > 0""")
def reliability(t):
    bins = K.calibration_bins(scored(t))
    lists = K.reliability_data(bins, K.calibration_errors(bins))
    used = bins.filter("count > 0").select("model_version_id", "cls", "bin", F.row_number().over(
        Window.partitionBy("model_version_id", "cls").orderBy("bin")).alias("i"))
    flat = lists.join(used, ["model_version_id", "cls"]).select(
        "model_version_id", "name", "bin", F.element_at("predicted", F.col("i")).alias("predicted"),
        F.element_at("actual", F.col("i")).alias("actual"), F.element_at("counts", F.col("i")).alias("n"), "ece", "mce")
    return r9(flat, "predicted", "actual", "ece", "mce")


GRADE = "CASE WHEN ece < 0.05::DOUBLE THEN 'Excellent' WHEN ece < 0.1::DOUBLE THEN 'Good' WHEN ece < 0.15::DOUBLE THEN 'Acceptable' ELSE 'Poor' END"
query("E24_calibration_grade", f"""SELECT model_version_id, scope, round(ece, 9) AS ece, {GRADE} AS grade FROM (
    SELECT model_version_id, substr('HDA', cls + 1, 1) AS scope, ece FROM ({ERRORS})
    UNION ALL SELECT model_version_id, 'overall', overall_ece FROM ({OVERALL}))""")(lambda t: r9(K.calibration_grade(errors(t)), "ece"))
query("E25_calibration_issues", f"""SELECT model_version_id, cls, type, round(size, 9) AS size FROM (
    SELECT model_version_id, cls, 'overconfidence' AS type, avg(mean_predicted - mean_actual) AS size FROM ({BINS}) WHERE count > 0 AND mean_predicted > 0.7::DOUBLE GROUP BY ALL
    UNION ALL SELECT model_version_id, cls, 'underconfidence', avg(mean_actual - mean_predicted) FROM ({BINS}) WHERE count > 0 AND mean_predicted < 0.3::DOUBLE GROUP BY ALL)
    WHERE size > 0.1::DOUBLE
    UNION ALL SELECT model_version_id, cls, 'draw_calibration', round(ece, 9) FROM ({ERRORS}) WHERE cls = 1 AND ece > 0.15::DOUBLE""")(
    lambda t: r9(K.calibration_issues(K.calibration_bins(scored(t)), errors(t)), "size"))

ALL = ["accuracy", "log_loss", "brier_score", "top_2_accuracy", "f1_macro", "f1_weighted", "cohen_kappa", *ECE_COLS,
       "roi_percent", "sharpe_ratio", "max_drawdown"]
EVALUATED = f"""SELECT b.model_version_id, b.n, b.accuracy, b.log_loss, b.brier_score, b.top_2_accuracy, m.f1_macro, m.f1_weighted, k.cohen_kappa,
    e.expected_calibration_error, e.maximum_calibration_error, x.total_bets, x.roi_percent, x.sharpe_ratio, d.max_drawdown, f.f1 AS f1_draw,
    r.date_from, r.date_to
    FROM ({BASIC}) b JOIN ({MACRO}) m USING (model_version_id) JOIN ({KAPPA}) k USING (model_version_id) JOIN ({ECE_SUM}) e USING (model_version_id)
    JOIN ({BETTING}) x USING (model_version_id) JOIN ({DRAWDOWN}) d USING (model_version_id)
    JOIN (SELECT model_version_id, f1 FROM ({PRF}) WHERE cls = 1) f USING (model_version_id)
    JOIN (SELECT model_version_id, min(match_date) AS date_from, max(match_date) AS date_to FROM scored GROUP BY 1) r USING (model_version_id)"""


def evaluated(t):
    return E.evaluate_predictions(scored(t))


query("E26_evaluate_predictions", f"""SELECT model_version_id, n, total_bets, date_from, date_to, {", ".join(f"round({c}, 6) AS {c}" for c in ALL)} FROM ({EVALUATED})""")(
    lambda t: r9(evaluated(t), *ALL, digits=6).select("model_version_id", "n", "total_bets", "date_from", "date_to", *ALL))
query("E27_metric_targets", " UNION ALL ".join(
    f"""SELECT model_version_id, '{m}' AS metric, round({m}, 6) AS value, {x!r}::DOUBLE AS target, {m} {'>=' if up else '<='} {x!r}::DOUBLE AS passed FROM ({EVALUATED})"""
    for m, x, up in E.METRIC_TARGETS))(
    lambda t: r9(E.metric_targets(E.classification_metrics(scored(t))), "value", digits=6))
RULES = [("accuracy < 0.5::DOUBLE", "low_accuracy"), ("f1_macro < 0.4::DOUBLE", "low_f1"), ("f1_draw < 0.25::DOUBLE", "weak_draws"),
         ("expected_calibration_error > 0.1::DOUBLE", "poor_calibration"), ("roi_percent < 0", "losing_bets"), ("max_drawdown > 0.3::DOUBLE", "deep_drawdown")]
FOUND = " UNION ALL ".join(f"SELECT model_version_id, '{c}' AS advice FROM ({EVALUATED}) WHERE {r}" for r, c in RULES)
query("E28_recommendations", f"""SELECT * FROM ({FOUND}) UNION ALL SELECT DISTINCT model_version_id, 'satisfactory' FROM scored
    WHERE model_version_id NOT IN (SELECT model_version_id FROM ({FOUND}))""")(lambda t: E.recommendations(evaluated(t)))
query("A8_compare_models", f"""SELECT (SELECT model_version_id FROM ({EVALUATED}) ORDER BY accuracy DESC, model_version_id LIMIT 1) AS best_accuracy,
    (SELECT model_version_id FROM ({EVALUATED}) ORDER BY log_loss, model_version_id LIMIT 1) AS best_log_loss,
    (SELECT model_version_id FROM ({EVALUATED}) ORDER BY f1_macro DESC, model_version_id LIMIT 1) AS best_f1_macro,
    (SELECT model_version_id FROM ({EVALUATED}) ORDER BY roi_percent DESC, model_version_id LIMIT 1) AS best_roi_percent""")(
    lambda t: E.compare_models(evaluated(t)))


def shrunk(t):
    """A stand-in for calibrated predictions: probabilities pulled half-way to one third."""
    return scored(t).withColumns({p: (F.col(p) + 1.0 / 3) / 2 for p in ("prob_home", "prob_draw", "prob_away")})


def prob_metrics(src):
    cls = " UNION ALL ".join(f"SELECT model_version_id, {i} AS cls, prob_{o} AS prob, CAST(label = {i} AS INT) AS hit FROM {src}" for i, o in enumerate(("home", "draw", "away")))
    return f"""SELECT model_version_id, avg({BRIER}) AS brier_score, avg(-ln({P_LABEL} + 1e-10)) AS log_loss, any_value(ece) AS expected_calibration_error
        FROM {src} JOIN (SELECT b.model_version_id, sum(abs(mp - ma) * b.n / CAST(t.n AS DOUBLE)) AS ece FROM
          (SELECT model_version_id, cls, {LEFT_OPEN} AS bin, count(*) AS n, avg(prob) AS mp, avg(CAST(hit AS DOUBLE)) AS ma FROM ({cls}) GROUP BY ALL) b
          JOIN (SELECT model_version_id, count(*) AS n FROM scored GROUP BY 1) t USING (model_version_id) GROUP BY 1) USING (model_version_id) GROUP BY model_version_id"""


SHRUNK = """(SELECT match_id, model_version_id, label, (prob_home + 1.0::DOUBLE / 3) / 2 AS prob_home, (prob_draw + 1.0::DOUBLE / 3) / 2 AS prob_draw,
    (prob_away + 1.0::DOUBLE / 3) / 2 AS prob_away FROM scored) sh"""
query("E29_calibration_delta", " UNION ALL ".join(
    f"""SELECT model_version_id, '{m}' AS metric, round(b.{m}, 9) AS before, round(a.{m}, 9) AS after, round(b.{m} - a.{m}, 9) AS improvement, b.{m} - a.{m} > 0 AS improved
    FROM ({prob_metrics('scored')}) b JOIN ({prob_metrics(SHRUNK)}) a USING (model_version_id)""" for m in K.DELTA_METRICS))(
    lambda t: r9(K.calibration_delta(K.probability_metrics(scored(t)), K.probability_metrics(shrunk(t))), "before", "after", "improvement"))
query("E30_auc", """SELECT model_version_id, cls, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS auc FROM (
    SELECT *, coalesce(sum(neg) OVER (PARTITION BY model_version_id, cls ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
      SELECT model_version_id, cls, prob, CAST(sum(hit) AS DOUBLE) AS pos, CAST(sum(1 - hit) AS DOUBLE) AS neg FROM by_class GROUP BY ALL)) GROUP BY model_version_id, cls""")(
    lambda t: r9(E.roc_auc(scored(t)), "auc"))
query("E30_ndcg", """SELECT g.model_version_id, round(dcg / ideal, 9) AS ndcg FROM (
    SELECT model_version_id, sum(gain * discount) AS dcg FROM (
      SELECT model_version_id, prob_home, avg(CAST(label = 0 AS INT)) AS gain, sum(1.0::DOUBLE / log2(place + 1)) AS discount FROM (
        SELECT *, row_number() OVER (PARTITION BY model_version_id ORDER BY prob_home DESC, match_id) AS place FROM scored) GROUP BY ALL) GROUP BY 1) g
    JOIN (SELECT model_version_id, sum(1.0::DOUBLE / log2(place + 1)) AS ideal FROM (
        SELECT model_version_id, label, row_number() OVER (PARTITION BY model_version_id ORDER BY CAST(label = 0 AS INT) DESC) AS place FROM scored) WHERE label = 0 GROUP BY 1) i USING (model_version_id)""")(
    lambda t: r9(E.ndcg_home(scored(t)), "ndcg"))

CUT = "1998-01-01 00:00:00"
PERIODS = f"""SELECT q.model_version_id, q.period, log_loss, accuracy, roi FROM (
    SELECT model_version_id, CASE WHEN match_date < TIMESTAMP '{CUT}' THEN 'baseline' ELSE 'recent' END AS period, avg({LOGLOSS}) AS log_loss,
      avg(CAST(label = pred AS DOUBLE)) AS accuracy FROM scored GROUP BY ALL) q
    LEFT JOIN (SELECT model_version_id, CASE WHEN match_date < TIMESTAMP '{CUT}' THEN 'baseline' ELSE 'recent' END AS period, sum(profit) / sum(stake) AS roi
      FROM bets GROUP BY ALL) m ON m.model_version_id = q.model_version_id AND m.period = q.period"""
query("E31_drift_alerts", f"""SELECT b.model_version_id, round(b.log_loss, 9) AS baseline_log_loss, round(b.accuracy, 9) AS baseline_accuracy, round(b.roi, 9) AS baseline_roi,
    round(r.log_loss, 9) AS recent_log_loss, round(r.accuracy, 9) AS recent_accuracy, round(r.roi, 9) AS recent_roi, x.alert
    FROM ({PERIODS}) b JOIN ({PERIODS}) r ON r.model_version_id = b.model_version_id AND b.period = 'baseline' AND r.period = 'recent'
    LEFT JOIN LATERAL (SELECT unnest(list_filter([CASE WHEN r.log_loss > b.log_loss * 1.1::DOUBLE THEN 'log_loss_drift' END, CASE WHEN r.accuracy < b.accuracy * 0.9::DOUBLE THEN 'accuracy_drift' END,
      CASE WHEN r.roi < b.roi - 0.05::DOUBLE THEN 'roi_drift' END], lambda a: a IS NOT NULL)) AS alert) x ON TRUE""")(
    lambda t: r9(E.drift_alerts(E.period_metrics(scored(t), CUT)),
                 *[f"{p}_{m}" for p in ("baseline", "recent") for m in ("log_loss", "accuracy", "roi")]))

CONF = """least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1 - (-(prob_home * log2(prob_home + 1e-10) + prob_draw * log2(prob_draw + 1e-10) + prob_away * log2(prob_away + 1e-10))) / log2(3)) * 0.5::DOUBLE
    + {0} / 50.0::DOUBLE * 0.3::DOUBLE + {1} * 0.2::DOUBLE))"""
COMPLETE = "(CASE WHEN odds_home IS NULL THEN 42 ELSE 50 END)"
LATE = "(CASE WHEN month(match_date) BETWEEN 4 AND 7 THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END)"


def confidence(df):
    complete = F.when(F.col("odds_home").isNull(), 42).otherwise(50)
    return E.confidence_score(complete, {"is_late_season": F.month("match_date").between(4, 7)})


query("E32_confidence_score", f"SELECT match_id, model_version_id, round({CONF.format(COMPLETE, LATE)}, 9) AS confidence_score FROM scored")(
    lambda t: scored(t).select("match_id", "model_version_id", F.round(confidence(None), 9).alias("confidence_score")))
query("C11_favourite_baseline", """SELECT count(*) AS n, round(avg(CAST(pred = label AS DOUBLE)), 9) AS accuracy FROM (
    SELECT CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS label,
      CASE WHEN odds_home <= odds_draw AND odds_home <= odds_away THEN 0 WHEN odds_draw <= odds_away THEN 1 ELSE 2 END AS pred
    FROM matches WHERE status = 'FINISHED' AND home_score IS NOT NULL AND odds_home IS NOT NULL AND odds_draw IS NOT NULL AND odds_away IS NOT NULL)""")(
    lambda t: r9(E.classification_metrics(E.favourite_baseline(t.matches), []), "accuracy").select("n", "accuracy"))


@query("C12_rules_fallback", f"""SELECT match_id, model_version_id, round(s, 6) AS confidence_score,
    {", ".join(f"round(CASE WHEN s < 0.4::DOUBLE THEN r{o} WHEN s < 0.6::DOUBLE THEN 0.7::DOUBLE * prob_{o} + 0.3::DOUBLE * r{o} ELSE prob_{o} END, 9) AS prob_{o}" for o in ("home", "draw", "away"))}
    FROM (SELECT *, (0.43::DOUBLE + up) / (1.04::DOUBLE) AS rhome, 0.33::DOUBLE / 1.04::DOUBLE AS rdraw, (0.28::DOUBLE - up) / 1.04::DOUBLE AS raway FROM (
      SELECT s.*, {CONF.format(COMPLETE, LATE)} AS s, CASE WHEN f.h > f.a THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS up
      FROM scored s JOIN (SELECT match_id, coalesce(avg(pts) FILTER (WHERE is_home), 0) AS h, coalesce(avg(pts) FILTER (WHERE NOT is_home), 0) AS a FROM earlier WHERE rn <= 5 GROUP BY match_id) f USING (match_id)
      UNION ALL SELECT s.*, {CONF.format(COMPLETE, LATE)}, 0.0::DOUBLE FROM scored s WHERE match_id NOT IN (SELECT match_id FROM earlier)))""")
def rules_fallback(t):
    form = H.team_features(t.matches, (5,)).select("match_id", "home_points_last_5", "away_points_last_5")
    df = scored(t).join(form, "match_id")
    out = E.with_fallback(df, confidence(df))
    return r9(r9(out, "prob_home", "prob_draw", "prob_away"), "confidence_score", digits=6).select(
        "match_id", "model_version_id", "confidence_score", "prob_home", "prob_draw", "prob_away")


LABELS = "SELECT id, CASE WHEN home_score > away_score THEN 0 WHEN home_score = away_score THEN 1 ELSE 2 END AS label FROM matches WHERE status = 'FINISHED' AND home_score IS NOT NULL AND away_score IS NOT NULL"


def labels(t):
    from touchline.functions.match import encode_target, is_finished, match_result
    return t.matches.filter(is_finished()).select(encode_target(match_result()).alias("label"))


query("A5_class_weights", f"""SELECT label, count(*) AS n, round(sum(count(*)) OVER () / CAST(count(*) OVER () * count(*) AS DOUBLE), 9) AS weight
    FROM ({LABELS}) GROUP BY label""")(lambda t: r9(E.class_weights(labels(t)), "weight"))
query("A5_class_weights_effective", f"""SELECT label, count(*) AS n, round((1 - 0.9999::DOUBLE) / (1 - power(0.9999::DOUBLE, count(*))), 9) AS weight
    FROM ({LABELS}) GROUP BY label""")(lambda t: r9(E.class_weights(labels(t), beta=0.9999), "weight"))
