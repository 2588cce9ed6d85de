"""Scans, filters, joins, counts, sorts and set operations."""

from pyspark.sql import functions as F

from touchline.catalog.base import AS_OF, query
from touchline.catalog.values import ODDS_FEATURES, CALENDAR, flagship
from touchline.functions import match as fm
from touchline.functions.odds import odds_features
from touchline.operators import features as X
from touchline.operators import joins as J
from touchline.operators import listing as L
from touchline.operators import value_bets as V
from touchline.operators.history import team_rows
from touchline.operators.models import latest_n
from touchline.plans.materialize import fresh_path
from touchline.schema import MATCH_FEATURE_COLUMNS
from touchline.sources import feature_store as S
from touchline.sources import registry as R
from touchline.sources import tables as T

NOW = f"TIMESTAMP '{AS_OF}'"
ALL_ODDS = "odds_home IS NOT NULL AND odds_draw IS NOT NULL AND odds_away IS NOT NULL"
DONE = "status = 'FINISHED' AND home_score IS NOT NULL AND away_score IS NOT NULL"
RESULT = "CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' WHEN home_score = away_score THEN 'D' END"


# --- scans and sinks ---------------------------------------------------------------------
@query("S1_scan_matches", f"SELECT {', '.join(MATCH_FEATURE_COLUMNS)} FROM matches")
def scan_matches(t):
    path = fresh_path(t.spark, "matches")
    T.write_parquet(T.match_frame(t.matches), path)
    return T.scan_matches(t.spark, path)


query("S3_match_frame", f"SELECT {', '.join(MATCH_FEATURE_COLUMNS)} FROM matches")(lambda t: T.match_frame(t.matches))
query("S12_jobs_scan", "SELECT id, task_id, status, started_at FROM task_executions")(
    lambda t: L.list_by(t.task_executions, [F.col("started_at").desc(), "id"]).select("id", "task_id", "status", "started_at"))

# --- filters -----------------------------------------------------------------------------
query("P1_match_result", f"""SELECT id, {RESULT} AS result, CASE WHEN status = 'FINISHED' THEN {RESULT} END AS listed_result FROM matches""")(
    lambda t: t.matches.select("id", fm.match_result().alias("result"), fm.match_result(True).alias("listed_result")))
query("P2_encode_targets", f"""SELECT id, CAST(CASE r WHEN 'H' THEN 0 WHEN 'D' THEN 1 WHEN 'A' THEN 2 END AS INT) AS code,
    CAST(CASE r WHEN 'H' THEN 0 WHEN 'A' THEN 2 ELSE 1 END AS INT) AS array_code, r AS decoded FROM (SELECT id, {RESULT} AS r FROM matches)""")(
    lambda t: t.matches.select("id", fm.match_result().alias("r")).select(
        "id", fm.encode_target("r").alias("code"), fm.encode_target("r", unknown=1).alias("array_code"),
        fm.decode_target(fm.encode_target("r")).alias("decoded")))
LISTED = f"""SELECT id, match_date, status, home_team_id, away_team_id, CASE WHEN status = 'FINISHED' THEN {RESULT} END AS result FROM matches
    WHERE status = 'FINISHED' AND match_date >= TIMESTAMP '1995-01-01' AND match_date <= TIMESTAMP '1999-12-31' AND {ALL_ODDS}"""
LIST_FILTERS = dict(status="FINISHED", start="1995-01-01 00:00:00", end="1999-12-31 00:00:00", has_all_odds=True)


def listed(t):
    return L.list_matches(t.matches, **LIST_FILTERS).select("id", "match_date", "status", "home_team_id", "away_team_id", "result")


query("P3_list_matches", LISTED)(listed)
query("P3_list_matches_total", f"SELECT count(*) AS total FROM ({LISTED})")(lambda t: L.count_rows(listed(t)))
query("P3_list_matches_no_odds", f"SELECT id, match_date, status FROM matches WHERE NOT ({ALL_ODDS})")(
    lambda t: L.list_matches(t.matches, has_all_odds=False).select("id", "match_date", "status"))
query("P3_list_matches_ahead", f"SELECT id, match_date, status FROM matches WHERE match_date >= {NOW} AND match_date <= {NOW} + INTERVAL '30' DAY")(
    lambda t: L.list_matches(t.matches, days_ahead=30, as_of=AS_OF).select("id", "match_date", "status"))
query("P3_list_matches_team", "SELECT id, match_date, status FROM matches WHERE home_team_id = 7 OR away_team_id = 7")(
    lambda t: L.list_matches(t.matches, team_id=7).select("id", "match_date", "status"))
query("L1_order_offset_limit", f"SELECT * FROM ({LISTED}) ORDER BY match_date, id LIMIT 100 OFFSET 50")(
    lambda t: L.page(listed(t), ["match_date", "id"], offset=50, limit=100))
query("P4_season_matches", f"SELECT id, match_date, status FROM matches WHERE season_id = 19952 AND status = 'FINISHED' AND season_id IN (SELECT id FROM seasons)")(
    lambda t: L.season_matches(t.matches, t.seasons, 19952, status="FINISHED").select("id", "match_date", "status"))
query("P5_historical_matches", f"SELECT id, match_date, home_score, away_score FROM matches WHERE {DONE} AND match_date >= TIMESTAMP '1994-01-01' AND match_date <= TIMESTAMP '1998-06-30' AND tournament_id = 2")(
    lambda t: L.historical_matches(t.matches, start="1994-01-01 00:00:00", end="1998-06-30 00:00:00", tournament_id=2)
    .select("id", "match_date", "home_score", "away_score"))
PRED = "SELECT p.id, p.match_id, p.model_version_id, p.predicted_at FROM predictions p JOIN matches m ON m.id = p.match_id WHERE"
query("P6_list_predictions", f"{PRED} {DONE} AND p.model_version_id = 2 AND p.confidence >= 0.4::DOUBLE AND p.predicted_at >= TIMESTAMP '1995-01-01' AND p.predicted_at <= TIMESTAMP '2000-01-01'")(
    lambda t: L.list_predictions(t.predictions, t.matches, model_version_id=2, has_result=True, min_confidence=0.4,
                                 start="1995-01-01 00:00:00", end="2000-01-01 00:00:00").select("id", "match_id", "model_version_id", "predicted_at"))
query("P6_list_predictions_open", f"{PRED} m.status IN ('SCHEDULED', 'LIVE')")(
    lambda t: L.list_predictions(t.predictions, t.matches, has_result=False).select("id", "match_id", "model_version_id", "predicted_at"))
query("P7_query_matches", f"SELECT id, match_date FROM matches WHERE status = 'SCHEDULED' AND match_date <= {NOW} + INTERVAL '60' DAY AND tournament_id IN (SELECT id FROM tournaments WHERE name = 'League ASIA')")(
    lambda t: L.query_matches(t.matches, t.tournaments, days_ahead=60, tournament="League ASIA", as_of=AS_OF).select("id", "match_date"))
query("P7_query_matches_ids", "SELECT id, match_date FROM matches WHERE id IN (SELECT match_id FROM predictions WHERE confidence > 0.5::DOUBLE)")(
    lambda t: L.query_matches(t.matches, t.tournaments, ids=t.predictions.filter("confidence > 0.5D").select(F.col("match_id").alias("id"))).select("id", "match_date"))
query("P8_ilike_search", "SELECT 'team' AS kind, id, name FROM teams WHERE name ILIKE '%00001%' UNION ALL SELECT 'tournament', id, name FROM tournaments WHERE name ILIKE '%league_a%' UNION ALL SELECT 'season', id, name FROM seasons WHERE name ILIKE '%1995%'")(
    lambda t: L.ilike_search(t.teams, "00001").select(F.lit("team").alias("kind"), "id", "name")
    .unionByName(L.ilike_search(t.tournaments, "league_a").select(F.lit("tournament").alias("kind"), "id", "name"))
    .unionByName(L.ilike_search(t.seasons, "1995").select(F.lit("season").alias("kind"), "id", "name")))
query("P9_upcoming_cli", f"""SELECT id, match_date FROM (SELECT id, match_date FROM matches WHERE status = 'SCHEDULED' ORDER BY match_date DESC, id DESC LIMIT 100)
    WHERE match_date >= {NOW} AND match_date <= {NOW} + INTERVAL '212' DAY""")(
    lambda t: L.upcoming_cli(t.matches, AS_OF, 212).select("id", "match_date"))
query("P10_get_by_id", "SELECT id, name FROM teams WHERE id = 3 UNION ALL SELECT id, name FROM tournaments WHERE id = 3 UNION ALL SELECT id, status FROM matches WHERE id = 3")(
    lambda t: L.get_by_id(t.teams, 3).select("id", "name").unionByName(L.get_by_id(t.tournaments, 3).select("id", "name"))
    .unionByName(L.get_by_id(t.matches, 3).select("id", F.col("status").alias("name"))))
TASKS = "SELECT DISTINCT task_id AS id, concat('task ', CAST(task_id AS VARCHAR)) AS name, CASE WHEN task_id < 2 THEN 'scrape' ELSE 'train' END AS task_type, task_id <> 3 AS is_active FROM task_executions"


def tasks(t):
    return t.task_executions.select(F.col("task_id").alias("id")).distinct().select(
        "id", F.concat(F.lit("task "), F.col("id").cast("string")).alias("name"),
        F.when(F.col("id") < 2, "scrape").otherwise("train").alias("task_type"), (F.col("id") != 3).alias("is_active"))


query("P13_schedule_filter", f"SELECT * FROM ({TASKS}) WHERE task_type = 'train' AND is_active")(
    lambda t: L.list_by(tasks(t), ["name"], task_type="train", is_active=True))


def registry(t):
    """Model versions with metrics measured on the stored predictions."""
    from touchline.operators.evaluation import classification_metrics, scored_frame
    m = classification_metrics(scored_frame(t.predictions, t.matches)).select(
        F.col("model_version_id").cast("long").alias("id"),
        F.create_map(F.lit("training_samples"), F.col("n").cast("double"), F.lit("test_accuracy"), F.col("accuracy")).alias("metrics"))
    return R.registry_at(t.model_versions.join(m, "id", "left").withColumn(
        "metrics", F.when(F.col("id") != 3, F.col("metrics"))).withColumn(
        "hyperparameters", F.when(F.col("id") == 2, F.lit('{"feature_names": ["a", "b", "c"]}'))),
        {1: "2000-01-01 00:00:00", 2: "2000-02-01 00:00:00", 3: "2000-03-01 00:00:00"})


query("P14_model_list", """SELECT id, version, algorithm, is_active, 'model_v2' AS active_version, CAST(CASE WHEN id = 2 THEN 3 ELSE 0 END AS INT) AS features_count
    FROM model_versions WHERE algorithm = 'gbt' AND id IN (SELECT model_version_id FROM predictions)""")(
    lambda t: R.model_list(registry(t), algorithm="gbt").select("id", "version", "algorithm", "is_active", "active_version", "features_count"))
query("P15_jobs_list", "SELECT id, task_id, status, started_at FROM task_executions WHERE status = 'completed' ORDER BY started_at DESC, id LIMIT 100 OFFSET 20")(
    lambda t: L.page(t.task_executions.filter("status = 'completed'"), [F.col("started_at").desc(), "id"], 20, 100).select("id", "task_id", "status", "started_at"))
query("P16_model_detail", """SELECT v.id, v.version, v.accuracy, CAST(CASE WHEN v.id = 3 THEN 0 ELSE s.n END AS BIGINT) AS training_data_size,
    CASE WHEN v.id = 2 THEN '{"feature_names": ["a", "b", "c"]}' ELSE '{}' END AS hyperparameters
    FROM model_versions v LEFT JOIN (SELECT model_version_id, count(*) AS n FROM scored GROUP BY 1) s ON s.model_version_id = v.id""")(
    lambda t: R.model_detail(registry(t)).select("id", "version", "accuracy", "training_data_size", "hyperparameters"))
query("P17_ensure_features", f"SELECT match_id, 0.0::DOUBLE AS absent, implied_prob_home, odds_quality_score FROM ({ODDS_FEATURES})")(
    lambda t: X.ensure_features(odds_set(t), ["absent", "implied_prob_home", "odds_quality_score"]))


def odds_set(t):
    return t.matches.select(F.col("id").alias("match_id"), *[c.alias(n) for n, c in odds_features().items()])


def calendar_set(t):
    return t.matches.select(F.col("id").alias("match_id"), *[c.alias(n) for n, c in fm.calendar().items()])


# --- joins -------------------------------------------------------------------------------
query("J1_match_names", "SELECT m.id, h.name AS home_team, a.name AS away_team FROM matches m JOIN teams h ON h.id = m.home_team_id JOIN teams a ON a.id = m.away_team_id")(
    lambda t: J.match_names(t.matches, t.teams).select("id", "home_team", "away_team"))
INFO = """SELECT m.id, h.name AS home_team, a.name AS away_team, m.match_date, m.status, m.home_score, m.away_score, t.name AS tournament_name, s.name AS season_name
    FROM matches m JOIN tournaments t ON t.id = m.tournament_id JOIN seasons s ON s.id = m.season_id JOIN teams h ON h.id = m.home_team_id JOIN teams a ON a.id = m.away_team_id"""
query("J2_match_info", INFO)(lambda t: J.match_info(t.matches, t.tournaments, t.seasons, t.teams))
query("J2_match_info_first_hit", INFO + """ WHERE m.tournament_id = (SELECT min(id) FROM tournaments WHERE name ILIKE '%league%') AND m.season_id = (SELECT min(id) FROM seasons WHERE name ILIKE '%199%')
    AND (m.home_team_id = (SELECT min(id) FROM teams WHERE name ILIKE '%supplier%') OR m.away_team_id = (SELECT min(id) FROM teams WHERE name ILIKE '%supplier%'))""")(
    lambda t: J.match_info(t.matches, t.tournaments, t.seasons, t.teams, tournament="league", season="199", team="supplier"))
query("J3_prediction_match", "SELECT p.id AS prediction_id, p.match_id, m.status, m.match_date, p.confidence FROM predictions p JOIN matches m ON m.id = p.match_id")(
    lambda t: J.prediction_match(t.predictions, t.matches).select("prediction_id", "match_id", "status", "match_date", "confidence"))
query("J4_upcoming_predictions", f"""SELECT p.id, p.match_id, m.match_date, v.version, p.confidence FROM predictions p JOIN matches m ON m.id = p.match_id JOIN model_versions v ON v.id = p.model_version_id
    WHERE m.status = 'SCHEDULED' AND m.match_date >= {NOW} AND m.match_date <= {NOW} + INTERVAL '30' DAY""")(
    lambda t: J.upcoming_predictions(t.predictions, t.matches, t.model_versions, AS_OF, 30).select("id", "match_id", "match.match_date", "model.version", "confidence"))
query("J5_prediction_history", f"""SELECT p.id AS prediction_id, p.match_id, p.predicted_at, {RESULT} AS actual_result FROM predictions p JOIN matches m ON m.id = p.match_id
    WHERE {DONE} AND p.predicted_at >= TIMESTAMP '1997-01-01' AND p.predicted_at <= TIMESTAMP '1999-01-01'""")(
    lambda t: J.prediction_history(t.predictions, t.matches, start="1997-01-01 00:00:00", end="1999-01-01 00:00:00").select("prediction_id", "match_id", "predicted_at", "actual_result"))


def stored(t):
    """Features of finished matches in version v1, of priced ones in v2."""
    done = t.matches.filter(fm.is_finished()).select(F.col("id").alias("match_id"))
    priced = t.matches.filter("odds_home IS NOT NULL").select(F.col("id").alias("match_id"))
    v1 = S.to_feature_rows(odds_set(t).join(done, "match_id", "left_semi"), "v1", AS_OF)
    v2 = S.to_feature_rows(calendar_set(t).join(priced, "match_id", "left_semi"), "v2", "2001-02-01 00:00:00")
    return v1.unionByName(v2)


ids = lambda t: t.matches.select(F.col("id").alias("match_id"))
query("S4_feature_store_write", f"""SELECT match_id, 'v1' AS feature_schema_version, implied_prob_home, odds_quality_score, CAST(favorite_outcome AS DOUBLE) AS favorite_outcome
    FROM ({ODDS_FEATURES}) WHERE match_id IN (SELECT id FROM matches WHERE {DONE})
    UNION ALL SELECT id, 'v2', NULL, NULL, NULL FROM matches WHERE odds_home IS NOT NULL""")(lambda t: store_roundtrip(t))


def store_roundtrip(t):
    path = fresh_path(t.spark, "features")
    S.write_features(S.merge_features(stored(t), stored(t)), path, "overwrite")
    rows = S.read_features(t.spark, path)
    return rows.select("match_id", "feature_schema_version", *[
        F.try_element_at("features", F.lit(n)).alias(n) for n in ("implied_prob_home", "odds_quality_score", "favorite_outcome")])


query("J6_features_by_date", f"""SELECT f.match_id, f.implied_prob_home, f.bookmaker_margin, m.match_date FROM ({ODDS_FEATURES}) f JOIN matches m ON m.id = f.match_id
    WHERE m.{DONE} AND m.match_date >= TIMESTAMP '1996-01-01' AND m.match_date <= TIMESTAMP '1996-12-31'""")(
    lambda t: S.features_by_date(stored(t), t.matches, "v1", ["implied_prob_home", "bookmaker_margin"], start="1996-01-01 00:00:00", end="1996-12-31 00:00:00"))
query("J7_missing_features", f"SELECT id AS match_id FROM matches WHERE NOT ({DONE})")(lambda t: S.missing_features(ids(t), stored(t), "v1"))
query("U3_except_ids", "SELECT id AS match_id FROM matches EXCEPT SELECT id FROM matches WHERE odds_home IS NOT NULL")(
    lambda t: S.missing_features(ids(t), stored(t), "v2"))
query("J8_unpredicted_matches", "SELECT id, match_date, status FROM matches WHERE id NOT IN (SELECT match_id FROM predictions WHERE model_version_id = 2)")(
    lambda t: J.unpredicted_matches(t.matches, t.predictions, 2).select("id", "match_date", "status"))
query("J9_teams_in_tournament", "SELECT id, name FROM teams WHERE id IN (SELECT home_team_id FROM matches WHERE tournament_id = 1 UNION SELECT away_team_id FROM matches WHERE tournament_id = 1)")(
    lambda t: J.teams_in_tournament(t.teams, t.matches, 1))
query("U1_union_distinct", "SELECT tournament_id, home_team_id AS team_id FROM matches UNION SELECT tournament_id, away_team_id FROM matches")(
    lambda t: J.tournament_team_ids(t.matches))
query("U2_union_all_perspectives", "SELECT match_id, team_id, is_home FROM sides")(
    lambda t: team_rows(t.matches).select("match_id", "team_id", "is_home"))
query("U4_missing_columns", "SELECT 'absent' AS missing, count(*) AS matches FROM matches")(
    lambda t: odds_set(t).agg(F.count("*").alias("matches")).select(
        F.explode(F.array(*[F.lit(c) for c in X.missing_columns(odds_set(t), ["absent", "implied_prob_home"])])).alias("missing"), "matches"))


query("J10_is_cached", f"SELECT id AS match_id, coalesce({DONE}, FALSE) AS cached FROM matches")(lambda t: S.is_cached(ids(t), stored(t), "v1"))
query("J13_compose_features", f"""SELECT o.match_id, o.implied_prob_home, c.day_of_week, c.month FROM ({ODDS_FEATURES}) o FULL JOIN
    (SELECT id AS match_id, {CALENDAR} FROM matches) c ON c.match_id = o.match_id""")(
    lambda t: X.compose_features([odds_set(t), calendar_set(t)]).select("match_id", "implied_prob_home", "day_of_week", "month"))
query("J15_match_detail", f"""SELECT m.id, t.name AS tournament_name, s.name AS season_name, h.name AS home_team, a.name AS away_team, CASE WHEN m.status = 'FINISHED' THEN {RESULT} END AS result
    FROM matches m LEFT JOIN tournaments t ON t.id = m.tournament_id LEFT JOIN seasons s ON s.id = m.season_id JOIN teams h ON h.id = m.home_team_id JOIN teams a ON a.id = m.away_team_id""")(
    lambda t: J.match_detail(t.matches, t.tournaments, t.seasons, t.teams).select("id", "tournament_name", "season_name", "home_team", "away_team", "result"))
query("C9_match_predictions", "SELECT p.id AS prediction_id, p.match_id, v.version, v.algorithm, p.confidence FROM predictions p LEFT JOIN model_versions v ON v.id = p.model_version_id")(
    lambda t: J.match_predictions(t.predictions, t.model_versions).select("prediction_id", "match_id", "version", "algorithm", "confidence"))
query("J20_feature_lookup", f"SELECT match_id, implied_prob_away, odds_quality_score FROM ({ODDS_FEATURES}) WHERE match_id IN (SELECT match_id FROM predictions WHERE model_version_id = 1) AND match_id IN (SELECT id FROM matches WHERE {DONE})")(
    lambda t: S.lookup(t.predictions.filter("model_version_id = 1").select("match_id"), stored(t), "v1", ["implied_prob_away", "odds_quality_score"]))
query("F15_json_map", f"SELECT match_id, feature_schema_version, CASE WHEN feature_schema_version = 'v1' THEN implied_prob_home ELSE -1.0::DOUBLE END AS value FROM (SELECT match_id, 'v1' AS feature_schema_version, implied_prob_home FROM ({ODDS_FEATURES}) WHERE match_id IN (SELECT id FROM matches WHERE {DONE}) UNION ALL SELECT id, 'v2', NULL FROM matches WHERE odds_home IS NOT NULL)")(
    lambda t: S.feature_value(stored(t), "implied_prob_home", -1.0))

# --- aggregates --------------------------------------------------------------------------
query("A1_tournament_season_counts", "SELECT t.id, t.name, t.country, count(s.id) AS seasons FROM tournaments t LEFT JOIN seasons s ON s.tournament_id = t.id GROUP BY ALL")(
    lambda t: L.tournament_season_counts(t.tournaments, t.seasons).select("id", "name", "country", "seasons"))
query("A2_season_match_counts", "SELECT s.id, s.name, t.name AS tournament_name, count(m.id) AS matches FROM seasons s JOIN tournaments t ON t.id = s.tournament_id LEFT JOIN matches m ON m.season_id = s.id GROUP BY ALL")(
    lambda t: L.season_match_counts(t.seasons, t.tournaments, t.matches).select("id", "name", "tournament_name", "matches"))
query("A3_team_matches_played", "SELECT t.id, t.name, count(s.match_id) AS played FROM teams t LEFT JOIN sides s ON s.team_id = t.id GROUP BY ALL")(
    lambda t: L.team_matches_played(t.teams, t.matches))
query("A4_db_stats", """SELECT (SELECT count(*) FROM tournaments) AS tournaments, (SELECT count(*) FROM seasons) AS seasons, (SELECT count(*) FROM teams) AS teams,
    (SELECT count(*) FROM matches) AS matches, (SELECT count(*) FROM matches WHERE status = 'FINISHED') AS finished, (SELECT count(*) FROM matches WHERE status = 'SCHEDULED') AS scheduled,
    (SELECT count(*) FROM model_versions) AS models, (SELECT count(DISTINCT task_id) FROM task_executions) AS tasks""")(
    lambda t: L.db_stats(t.tournaments, t.seasons, t.teams, t.matches, t.model_versions, t.task_executions))
query("A6_feature_schema_stats", f"""SELECT 'v1' AS feature_schema_version, (SELECT count(*) FROM matches WHERE {DONE}) AS "rows",
    'bookmaker_margin,favorite_implied_prob,favorite_outcome,implied_prob_away,implied_prob_draw,implied_prob_home,odds_home_away_ratio,odds_quality_score' AS names, {NOW} AS first_computed, {NOW} AS last_computed
    UNION ALL SELECT 'v2', (SELECT count(*) FROM matches WHERE odds_home IS NOT NULL), 'day_of_week,days_from_season_start,is_weekend,month', TIMESTAMP '2001-02-01', TIMESTAMP '2001-02-01'""")(
    lambda t: S.schema_stats(stored(t)).select("feature_schema_version", "rows", F.array_join("feature_names", ",").alias("names"), "first_computed", "last_computed"))
query("A9_scraping_stats", """SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed,
    count(*) FILTER (WHERE status = 'running') AS running, count(*) FILTER (WHERE status = 'pending') AS pending, CAST(sum(matches_scraped) AS BIGINT) AS matches_scraped,
    round(avg(duration_seconds) FILTER (WHERE status = 'completed'), 9) AS avg_duration,
    round(count(*) FILTER (WHERE status = 'completed') / CAST(count(*) FILTER (WHERE status IN ('completed', 'failed')) AS DOUBLE) * 100, 9) AS success_rate FROM task_executions""")(
    lambda t: L.scraping_stats(t.task_executions).withColumns({c: F.round(c, 9) for c in ("avg_duration", "success_rate")}))
ROI = f"""SELECT p.*, CASE WHEN m.status = 'FINISHED' AND {RESULT} IS NOT NULL AND o IS NOT NULL THEN CASE WHEN {RESULT} = p.predicted_outcome THEN o - 1 ELSE -1.0::DOUBLE END END AS actual_roi
    FROM (SELECT p.*, CASE p.predicted_outcome WHEN 'H' THEN odds_home WHEN 'D' THEN odds_draw ELSE odds_away END AS o FROM predictions p JOIN matches x ON x.id = p.match_id) p JOIN matches m ON m.id = p.match_id"""
VB = f"""SELECT p.id FROM predictions p JOIN matches m ON m.id = p.match_id WHERE p.model_version_id = 2 AND m.status = 'SCHEDULED' AND m.match_date >= {NOW} AND m.match_date <= {NOW} + INTERVAL '30' DAY AND {ALL_ODDS}
    AND (CASE p.predicted_outcome WHEN 'H' THEN m.odds_home WHEN 'D' THEN m.odds_draw ELSE m.odds_away END) <= 10
    AND p.confidence * (CASE p.predicted_outcome WHEN 'H' THEN m.odds_home WHEN 'D' THEN m.odds_draw ELSE m.odds_away END) - 1 >= 0.05::DOUBLE"""
query("A10_dashboard_stats", f"""SELECT count(*) AS total_predictions, round(sum(actual_roi), 6) AS total_roi, round(count(*) FILTER (WHERE actual_roi > 0) / CAST(count(actual_roi) AS DOUBLE), 9) AS win_rate,
    round(avg(confidence), 9) AS avg_confidence, (SELECT count(*) FROM matches WHERE status = 'SCHEDULED' AND match_date >= {NOW} AND match_date <= {NOW} + INTERVAL '7' DAY) AS upcoming_matches,
    (SELECT count(*) FROM ({VB})) AS value_bets, (SELECT max(accuracy) FROM model_versions WHERE is_active) AS active_accuracy FROM ({ROI})""")(
    lambda t: L.dashboard_stats(L.with_actual_roi(t.predictions, t.matches), t.matches, t.model_versions, flagship(t), AS_OF)
    .withColumns({"total_roi": F.round("total_roi", 6), "win_rate": F.round("win_rate", 9), "avg_confidence": F.round("avg_confidence", 9)}))
query("A12_prediction_summary", """SELECT count(*) AS total, round(avg(confidence), 9) AS avg_confidence, count(*) FILTER (WHERE predicted_outcome = 'H') AS home,
    count(*) FILTER (WHERE predicted_outcome = 'D') AS draw, count(*) FILTER (WHERE predicted_outcome = 'A') AS away FROM predictions""")(
    lambda t: L.prediction_summary(t.predictions).withColumn("avg_confidence", F.round("avg_confidence", 9)))
query("A13_model_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE is_active) AS active, round(avg(coalesce(accuracy, 0)), 9) AS avg_accuracy FROM model_versions
    WHERE id IN (SELECT model_version_id FROM predictions)""")(
    lambda t: L.model_summary(registry(t)).withColumn("avg_accuracy", F.round("avg_accuracy", 9)))
query("A14_last_execution", """SELECT task_id, id, status, duration_seconds, started_at FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY started_at DESC, id DESC) AS rn FROM task_executions) WHERE rn = 1""")(
    lambda t: L.last_execution(t.task_executions))
query("L5_jobs_by_task", "SELECT task_id, id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY started_at DESC, id DESC) AS rn FROM task_executions) WHERE rn <= 10")(
    lambda t: L.jobs_by_task(t.task_executions).select("task_id", "id"))

# --- sorts, registry, store upkeep ---------------------------------------------------------
query("L4_latest_n", f"SELECT id, match_date FROM matches WHERE {DONE} AND {ALL_ODDS} ORDER BY match_date DESC, id DESC LIMIT 1000")(
    lambda t: latest_n(t.matches, 1000).select("id", "match_date"))


query("L7_seasons_sorted", "SELECT id, name, start_year, end_year FROM seasons WHERE tournament_id = 2")(
    lambda t: L.list_by(t.seasons, [F.col("start_year").desc(), F.col("end_year").desc()], tournament_id=2).select("id", "name", "start_year", "end_year"))
query("M23_active_model", "SELECT id, version, version = 'model_v3' AS is_active, 'model_v2' AS previous_version FROM model_versions WHERE id IN (SELECT model_version_id FROM predictions)")(
    lambda t: R.activate(registry(t), "model_v3").select("id", "version", "is_active", "previous_version"))
query("M24_delete_model_row", "SELECT id, match_id, model_version_id FROM predictions WHERE model_version_id <> 1")(
    lambda t: R.delete_model(t.model_versions, t.predictions, "model_v1")[1].select("id", "match_id", "model_version_id"))
query("C10_feature_store_delete", f"SELECT id AS match_id, 'v1' AS feature_schema_version FROM matches WHERE {DONE} AND id NOT IN (SELECT match_id FROM predictions WHERE model_version_id = 1) UNION ALL SELECT id, 'v2' FROM matches WHERE odds_home IS NOT NULL")(
    lambda t: S.delete_features(stored(t), "v1", t.predictions.filter("model_version_id = 1").select("match_id")).select("match_id", "feature_schema_version"))
query("C10_clear_schema", f"SELECT count(*) AS deleted FROM matches WHERE {DONE}")(
    lambda t: S.deleted_count(stored(t), S.delete_features(stored(t), "v1")))
query("C8_constant_predictions", "SELECT id AS match_id, 2 AS model_version_id, 0.4::DOUBLE AS prob_home, 0.3::DOUBLE AS prob_draw, 0.3::DOUBLE AS prob_away, 'H' AS predicted_outcome, 0.4::DOUBLE AS confidence FROM matches WHERE status = 'SCHEDULED' AND id NOT IN (SELECT match_id FROM predictions WHERE model_version_id = 2)")(
    lambda t: V.constant_predictions(t.matches.filter("status = 'SCHEDULED'"), t.predictions, 2))
