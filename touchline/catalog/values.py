"""Value bets, odds functions and scalar expressions."""

from pyspark.sql import functions as F

from touchline.catalog.base import AS_OF, query
from touchline.functions import match as fm
from touchline.functions import odds as fo
from touchline.operators import joins as J
from touchline.operators import value_bets as V
from touchline.operators.evaluation import scored_frame
from touchline.operators.history import team_rows

PICK_ODDS = "CASE p.predicted_outcome WHEN 'H' THEN m.odds_home WHEN 'D' THEN m.odds_draw ELSE m.odds_away END"
PICK_PROB = "CASE p.predicted_outcome WHEN 'H' THEN p.prob_home WHEN 'D' THEN p.prob_draw ELSE p.prob_away END"
PREDICTED_BETS = f"""
SELECT p.id AS prediction_id, p.match_id, m.home_team_id, m.away_team_id, m.match_date, p.predicted_outcome,
       {PICK_PROB} AS predicted_probability, {PICK_ODDS} AS market_odds,
       {PICK_PROB} * {PICK_ODDS} - 1 AS expected_value,
       greatest(0.0::DOUBLE, (({PICK_ODDS} - 1) * {PICK_PROB} - (1 - {PICK_PROB})) / ({PICK_ODDS} - 1)) AS kelly_fraction,
       p.confidence
FROM predictions p JOIN matches m ON m.id = p.match_id
WHERE p.model_version_id = 2 AND m.status = 'SCHEDULED'
  AND m.match_date >= TIMESTAMP '{AS_OF}' AND m.match_date <= TIMESTAMP '{AS_OF}' + INTERVAL '30' DAY
  AND m.odds_home IS NOT NULL AND m.odds_draw IS NOT NULL AND m.odds_away IS NOT NULL
  AND {PICK_ODDS} <= 10.0 AND {PICK_PROB} * {PICK_ODDS} - 1 >= 0.05::DOUBLE"""


def flagship(t, limit=None):
    return V.value_bets_predicted(t.predictions, t.matches, 2, AS_OF, ahead=30, limit=limit)


query("C3_value_bets_predicted", PREDICTED_BETS)(flagship)
query("L3_topk_ev", PREDICTED_BETS + " ORDER BY expected_value DESC, prediction_id LIMIT 20")(
    lambda t: flagship(t, 20))
query("A11_value_bet_summary", f"""SELECT count(*) AS bets, round(avg(expected_value), 9) AS avg_ev,
    round(avg(market_odds), 9) AS avg_odds, round(avg(kelly_fraction), 9) AS avg_kelly FROM ({PREDICTED_BETS})""")(
    lambda t: V.value_bet_summary(flagship(t)).select(
        "bets", *[F.round(c, 9).alias(c) for c in ("avg_ev", "avg_odds", "avg_kelly")]))
query("S9_json_sink", f"""SELECT prediction_id, match_id, predicted_outcome, expected_value FROM ({PREDICTED_BETS})""")(
    lambda t: V.value_bets_json(flagship(t)).select(F.from_json(
        "value_bet", "prediction_id long, match_id long, predicted_outcome string, expected_value double").alias("v"))
    .select("v.*"))


def model_scored(t, model=2):
    probs = t.predictions.filter(F.col("model_version_id") == model).select("match_id", "prob_home", "prob_draw", "prob_away")
    return t.matches.withColumnRenamed("id", "match_id").join(probs, "match_id")


UPCOMING_PRICED = f"""FROM predictions p JOIN matches m ON m.id = p.match_id
      WHERE p.model_version_id = 2 AND m.status = 'SCHEDULED' AND m.match_date >= TIMESTAMP '{AS_OF}'
        AND m.match_date <= TIMESTAMP '{AS_OF}' + INTERVAL '30' DAY
        AND m.odds_home IS NOT NULL AND m.odds_draw IS NOT NULL AND m.odds_away IS NOT NULL"""
ALL_BETS = f"""
SELECT x.match_id, h.name AS home_team, a.name AS away_team, x.match_date,
       substr('HDA', x.cls + 1, 1) AS bet_type, x.prob AS model_probability,
       x.odds AS market_odds, x.prob - 1 / x.odds AS edge, x.prob * x.odds - 1 AS expected_value
FROM ({" UNION ALL ".join(f"SELECT p.match_id, m.match_date, m.home_team_id, m.away_team_id, {i} AS cls, p.prob_{o} AS prob, m.odds_{o} AS odds {UPCOMING_PRICED}" for i, o in enumerate(("home", "draw", "away")))}) x
JOIN teams h ON h.id = x.home_team_id JOIN teams a ON a.id = x.away_team_id
WHERE x.odds > 1 AND x.prob - 1 / x.odds >= 0.05::DOUBLE"""

query("C2_value_bets_all_outcomes", ALL_BETS)(
    lambda t: V.value_bets_all_outcomes(model_scored(t), t.teams, AS_OF, ahead=30, limit=None))
query("L2_topk_edge", f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY edge DESC, match_id, bet_type) AS rn FROM ({ALL_BETS})) WHERE rn <= 20")(
    lambda t: V.value_bets_all_outcomes(model_scored(t), t.teams, AS_OF, ahead=30))

query("J14_outcome_unpivot", """SELECT match_id, model_version_id, cls, CASE cls WHEN 0 THEN 'H' WHEN 1 THEN 'D' ELSE 'A' END AS outcome,
    prob, odds FROM (SELECT p.match_id, p.model_version_id, c.cls,
      CASE c.cls WHEN 0 THEN prob_home WHEN 1 THEN prob_draw ELSE prob_away END AS prob,
      CASE c.cls WHEN 0 THEN odds_home WHEN 1 THEN odds_draw ELSE odds_away END AS odds
      FROM predictions p JOIN matches m ON m.id = p.match_id CROSS JOIN (SELECT 0 AS cls UNION ALL SELECT 1 UNION ALL SELECT 2) c)""")(
    lambda t: V.outcome_unpivot(J.prediction_match(t.predictions, t.matches))
    .select("match_id", "model_version_id", "cls", "outcome", "prob", "odds"))

IMPLIED = """SELECT id AS match_id, 1 / odds_home AS raw_home, 1 / odds_draw AS raw_draw, 1 / odds_away AS raw_away,
    1 / odds_home + 1 / odds_draw + 1 / odds_away - 1 AS odds_margin,
    1 / odds_home / (1 / odds_home + 1 / odds_draw + 1 / odds_away) AS norm_home,
    1 / odds_draw / (1 / odds_home + 1 / odds_draw + 1 / odds_away) AS norm_draw,
    1 / odds_away / (1 / odds_home + 1 / odds_draw + 1 / odds_away) AS norm_away FROM matches"""
query("F1_implied_probs", IMPLIED)(
    lambda t: t.matches.select(F.col("id").alias("match_id"), *[c.alias(n) for n, c in fo.implied_probs().items()]))

QUALITY = """CASE WHEN num_bookmakers IS NULL THEN 1.0::DOUBLE WHEN num_bookmakers = 0 THEN 0.2::DOUBLE
    ELSE least(1.0::DOUBLE, CAST(num_bookmakers AS DOUBLE) / 5) END"""
ODDS_FEATURES = f"""SELECT i.match_id,
    coalesce(norm_home, 0.45::DOUBLE) AS implied_prob_home, coalesce(norm_draw, 0.28::DOUBLE) AS implied_prob_draw,
    coalesce(norm_away, 0.27::DOUBLE) AS implied_prob_away, coalesce(odds_margin, 0.05::DOUBLE) AS bookmaker_margin,
    coalesce(m.odds_home / m.odds_away, 1.0::DOUBLE) AS odds_home_away_ratio,
    CAST(CASE WHEN norm_home IS NULL OR (norm_home >= norm_draw AND norm_home >= norm_away) THEN 0
              WHEN norm_draw >= norm_away THEN 1 ELSE 2 END AS INT) AS favorite_outcome,
    CASE WHEN norm_home IS NULL THEN 0.45::DOUBLE ELSE greatest(norm_home, norm_draw, norm_away) END AS favorite_implied_prob,
    {QUALITY} AS odds_quality_score
    FROM ({IMPLIED}) i JOIN matches m ON m.id = i.match_id"""
query("F2_odds_features", ODDS_FEATURES)(
    lambda t: t.matches.select(F.col("id").alias("match_id"), *[c.alias(n) for n, c in fo.odds_features().items()]))
query("F3_odds_quality", f"SELECT id AS match_id, {QUALITY} AS odds_quality FROM matches")(
    lambda t: t.matches.select(F.col("id").alias("match_id"), fo.odds_quality().alias("odds_quality")))
query("F4_odds_transform", f"""SELECT match_id, norm_home - norm_away AS odds_balance, norm_draw AS draw_likelihood,
    greatest(norm_home, norm_draw, norm_away) AS market_certainty FROM ({IMPLIED})""")(
    lambda t: t.matches.select(F.col("id").alias("match_id"), *[c.alias(n) for n, c in fo.odds_transform().items()]))
query("F4_odds_transform_fit", """SELECT round(avg(s), 9) AS overround_mean, round(stddev_samp(s), 9) AS overround_std
    FROM (SELECT 1 / odds_home + 1 / odds_draw + 1 / odds_away AS s FROM matches)""")(
    lambda t: t.matches.select((fo.implied_probs()["odds_margin"] + 1).alias("s")).agg(
        F.round(F.avg("s"), 9).alias("overround_mean"), F.round(F.stddev_samp("s"), 9).alias("overround_std")))

CALENDAR = """CAST(isodow(match_date) - 1 AS INT) AS day_of_week, CAST(month(match_date) AS INT) AS month,
    CAST(isodow(match_date) >= 6 AS INT) AS is_weekend,
    CAST(date_diff('day', make_date(year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END, 8, 1), CAST(match_date AS DATE)) AS INT) AS days_from_season_start"""
query("F5_calendar", f"SELECT id AS match_id, {CALENDAR} FROM matches")(
    lambda t: t.matches.select(F.col("id").alias("match_id"), *[c.alias(n) for n, c in fm.calendar().items()]))

query("F6_expected_value", """SELECT match_id, model_version_id, cls, prob * odds - 1 AS expected_value FROM by_class""")(
    lambda t: classes(t).select("match_id", "model_version_id", "cls", fo.expected_value("prob", "odds").alias("expected_value")))
query("F7_kelly", """SELECT match_id, model_version_id, cls, CASE WHEN odds > 1
    THEN greatest(0.0::DOUBLE, ((odds - 1) * prob - (1 - prob)) / (odds - 1)) ELSE 0.0::DOUBLE END AS kelly FROM by_class""")(
    lambda t: classes(t).select("match_id", "model_version_id", "cls", fo.kelly("prob", "odds").alias("kelly")))
query("F8_edge", "SELECT match_id, model_version_id, cls, prob - 1 / odds AS edge FROM by_class")(
    lambda t: classes(t).select("match_id", "model_version_id", "cls", fo.edge("prob", "odds").alias("edge")))
query("F9_argmax_outcome", """SELECT id AS prediction_id, predicted_outcome AS outcome, greatest(prob_home, prob_draw, prob_away) AS top
    FROM predictions""")(
    lambda t: t.predictions.select(F.col("id").alias("prediction_id"), fo.predicted_outcome().alias("outcome"),
                                   fo.confidence().alias("top")))
query("F10_points", "SELECT match_id, is_home, gf, ga, pts FROM hist")(
    lambda t: team_rows(t.matches).filter("is_hist")
    .select("match_id", "is_home", "gf", "ga", F.col("points").alias("pts")))


def classes(t):
    return V.outcome_unpivot(scored_frame(t.predictions, t.matches))


URL_SQL = """SELECT t.id AS tournament_id, s.id AS season_id,
    concat('https://odds.example/football/', lower(replace(t.country, ' ', '-')), '/', t.url_slug, '-', replace(s.name, '/', '-'), '/results/') AS url
    FROM tournaments t JOIN seasons s ON s.tournament_id = t.id"""


def season_pages(t):
    tour = t.tournaments.withColumnRenamed("id", "tournament_id").drop("name")
    return t.seasons.withColumnRenamed("id", "season_id").join(tour, "tournament_id").select(
        "tournament_id", "season_id", "name",
        F.concat(F.lit("https://odds.example/football/"), F.lower(F.replace("country", F.lit(" "), F.lit("-"))),
                 F.lit("/"), "url_slug", F.lit("-"), F.replace("name", F.lit("/"), F.lit("-")), F.lit("/results/")).alias("url"))


TITLE = """array_to_string(list_transform(string_split({0}, ' '), lambda x: concat(upper(x[1]), lower(substr(x, 2)))), ' ')"""
query("F11_parse_league_url", f"""SELECT url, {TITLE.format("replace(c, '-', ' ')")} AS country, s AS slug, {TITLE.format("replace(s, '-', ' ')")} AS league_name
    FROM (SELECT url, regexp_extract(url, '/football/([^/]+)/', 1) AS c,
          regexp_extract(url, '/football/[^/]+/([^/]+?)(?:-\\d{{4}}-\\d{{4}})?/results/', 1) AS s FROM ({URL_SQL}))""")(
    lambda t: season_pages(t).select("url", *[c.alias(n) for n, c in fm.parse_league_url("url").items()]))
query("F12_season_url", f"""SELECT season_id, CASE WHEN sfx = '2001-2002' THEN base ELSE concat(left(base, length(base) - length('/results/')), '-', sfx, '/results/') END AS url
    FROM (SELECT season_id, regexp_replace(url, '-\\d{{4}}-\\d{{4}}/', '/') AS base, regexp_extract(url, '(\\d{{4}}-\\d{{4}})/results', 1) AS sfx FROM ({URL_SQL}))""")(
    lambda t: season_pages(t)
    .withColumn("base", F.regexp_replace("url", r"-\d{4}-\d{4}/", "/"))
    .withColumn("sfx", F.regexp_extract("url", r"(\d{4}-\d{4})/results", 1))
    .select("season_id", fm.season_url("base", "sfx", F.col("sfx") == "2001-2002").alias("url")))
query("F13_parse_match_ts", """SELECT id AS match_id, date_trunc('minute', match_date) AS parsed, date_trunc('day', match_date) AS parsed_day,
    TIMESTAMP '2001-01-01 00:00:00' AS parsed_default FROM matches""")(
    lambda t: t.matches.select(
        F.col("id").alias("match_id"), F.date_format("match_date", "dd MMM yyyy").alias("d"),
        F.date_format("match_date", "HH:mm").alias("h"))
    .select("match_id", fm.parse_match_ts(F.col("d"), F.col("h")).alias("parsed"),
            fm.parse_match_ts(F.col("d"), F.lit("n/a")).alias("parsed_day"),
            fm.parse_match_ts(F.lit("n/a"), F.col("h"), fm.ntz(AS_OF)).alias("parsed_default")))
query("F14_round2", "SELECT id AS prediction_id, round(prob_home, 2) AS prob_home, round(confidence, 2) AS confidence FROM predictions")(
    lambda t: t.predictions.select(F.col("id").alias("prediction_id"), fm.round2("prob_home").alias("prob_home"),
                                   fm.round2("confidence").alias("confidence")))
query("F16_season_sort_key", "SELECT id, start_year AS sort_key FROM seasons")(
    lambda t: t.seasons.select("id", fm.season_sort_key("name").alias("sort_key")))
query("F17_double_chance", """SELECT id AS prediction_id, prob_home + prob_draw AS home_or_draw, prob_draw + prob_away AS draw_or_away,
    prob_home + prob_away AS home_or_away FROM predictions""")(
    lambda t: t.predictions.select(F.col("id").alias("prediction_id"), *[c.alias(n) for n, c in fo.double_chance().items()]))
