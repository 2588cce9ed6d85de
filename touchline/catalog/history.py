"""Form, head-to-head and league queries."""

from pyspark.sql import functions as F

from touchline.catalog.base import AS_OF, query
from touchline.operators import history as H


def mean(expr, cond, table="e"):
    return f"coalesce(sum({expr}) FILTER (WHERE {cond}) / CAST(count(*) FILTER (WHERE {cond}) AS DOUBLE), 0.0::DOUBLE)"


def side_form(n):
    c = f"rn <= {n}"
    win = "CASE WHEN gf > ga THEN 1 ELSE 0 END"
    return (f"{mean('pts', c)} AS points_last_{n}, {mean(win, c)} AS win_rate_{n}, {mean('gf', c)} AS goals_for_avg_{n}, "
            f"{mean('ga', c)} AS goals_against_avg_{n}, {mean('gf', c)} - {mean('ga', c)} AS goal_diff_avg_{n}")


TREND = """CASE WHEN count(*) FILTER (WHERE rn <= 6) >= 4
    THEN sum(pts) FILTER (WHERE rn <= 3) / 3::DOUBLE - sum(pts) FILTER (WHERE rn BETWEEN 4 AND 6) / CAST(count(*) FILTER (WHERE rn BETWEEN 4 AND 6) AS DOUBLE)
    ELSE 0.0::DOUBLE END"""
REST = """coalesce(CAST(least(floor((epoch_us(any_value(match_date)) - epoch_us(max(hist_date))) / 86400000000.0), 14) AS DOUBLE), 7.0::DOUBLE)"""
SIDE = f"""SELECT s.match_id, s.is_home, f.*, v.* FROM sides s,
    LATERAL (SELECT {", ".join(side_form(n) for n in H.WINDOWS)}, {TREND} AS form_trend, {REST} AS rest_days,
             CAST(least(count(*), 5) AS BIGINT) AS matches_last_14_days
             FROM earlier e WHERE e.match_id = s.match_id AND e.is_home = s.is_home) f,
    LATERAL (SELECT {", ".join(mean('pts', f'rn <= {n}') + f' AS venue_form_{n}' for n in H.WINDOWS)}
             FROM earlier_venue e WHERE e.match_id = s.match_id AND e.is_home = s.is_home) v"""
FORM_COLS = [f"{f}_{n}" for n in H.WINDOWS for f in ("points_last", "win_rate", "goals_for_avg", "goals_against_avg", "goal_diff_avg")]


def wide(names, extra=""):
    """Home and away rows side by side."""
    def out(side, c):
        if c.startswith("venue_form_"):
            return f"{side}_{side}_form_{c.rsplit('_', 1)[1]}"
        return f"{side}_{c}"
    cols = ", ".join(f"{s[0]}.{c} AS {out(s, c)}" for c in names for s in ("home", "away"))
    return f"SELECT h.match_id, {cols}{extra} FROM ({SIDE}) h JOIN ({SIDE}) a ON h.match_id = a.match_id WHERE h.is_home AND NOT a.is_home"


VENUE_COLS = [f"venue_form_{n}" for n in H.WINDOWS]
query("W1_team_form", wide(FORM_COLS))(
    lambda t: H.team_form(t.matches).select("match_id", *[f"{s}_{c}" for c in FORM_COLS for s in H.SIDES]))
query("W2_venue_form", wide(VENUE_COLS))(
    lambda t: H.team_form(t.matches).select("match_id", *[f"{s}_{s}_form_{n}" for n in H.WINDOWS for s in H.SIDES]))
query("W3_form_trend", wide(["form_trend"]))(
    lambda t: H.team_form(t.matches).select("match_id", "home_form_trend", "away_form_trend"))
query("W4_form_diff", f"SELECT match_id, home_points_last_5 - away_points_last_5 AS form_diff FROM ({wide(['points_last_5'])})")(
    lambda t: H.team_form(t.matches).select("match_id", "form_diff"))
query("W6_rest_days", wide(["rest_days"], ", h.rest_days - a.rest_days AS rest_days_diff"))(
    lambda t: H.team_features(t.matches, (3,)).select("match_id", "home_rest_days", "away_rest_days", "rest_days_diff"))
query("W7_fixture_density", f"""SELECT m.id AS match_id, {", ".join(f"""(SELECT count(*) FROM hist h WHERE h.team_id = m.{s}_team_id
      AND h.match_date < m.match_date AND h.match_date >= m.match_date - INTERVAL '14' DAY) AS {s}_matches_last_14_days""" for s in H.SIDES)}
    FROM matches m""")(lambda t: H.density_by_match(t.matches))
query("W7_fixture_density_true_14d", """SELECT s.match_id, s.is_home, count(h.match_id) AS matches_in_window FROM sides s
    LEFT JOIN hist h ON h.team_id = s.team_id AND h.match_date < s.match_date AND h.match_date >= s.match_date - INTERVAL '14' DAY
    GROUP BY s.match_id, s.is_home""")(lambda t: H.fixture_density(t.matches))
query("W10_basic_features", f"""SELECT match_id, home_points_last_5 AS home_form, away_points_last_5 AS away_form,
    home_goals_for_avg_5 AS home_goals_scored, away_goals_for_avg_5 AS away_goals_scored,
    home_goals_against_avg_5 AS home_goals_conceded, away_goals_against_avg_5 AS away_goals_conceded
    FROM ({wide(["points_last_5", "goals_for_avg_5", "goals_against_avg_5"])})""")(lambda t: H.basic_features(t.matches))


def rate_cols(n):
    return [f"{r}_rate_{n}" for r in ("draw", "loss")]


RATES = ", ".join(f"{mean(f'CASE WHEN gf {op} ga THEN 1 ELSE 0 END', f'rn <= {n}')} AS {r}_rate_{n}"
                  for n in H.WINDOWS for r, op in (("draw", "="), ("loss", "<")))
query("W17_draw_loss_rates", f"""SELECT h.match_id, {", ".join(f"{s[0]}.{c} AS {s}_{c}" for n in H.WINDOWS for c in rate_cols(n) for s in H.SIDES)}
    FROM (SELECT s.match_id, s.is_home, f.* FROM sides s, LATERAL (SELECT {RATES} FROM earlier e WHERE e.match_id = s.match_id AND e.is_home = s.is_home) f) h
    JOIN (SELECT s.match_id, s.is_home, f.* FROM sides s, LATERAL (SELECT {RATES} FROM earlier e WHERE e.match_id = s.match_id AND e.is_home = s.is_home) f) a
    ON h.match_id = a.match_id WHERE h.is_home AND NOT a.is_home""")(
    lambda t: H.team_form(t.matches, rates=("win", "draw", "loss"))
    .select("match_id", *[f"{s}_{c}" for n in H.WINDOWS for c in rate_cols(n) for s in H.SIDES]))

query("J11_team_history_asof", """SELECT e.match_id, e.is_home, s.team_id, CAST(e.rn AS INT) AS rn, e.hist_id, e.gf, e.ga, e.pts AS points
    FROM earlier e JOIN sides s ON s.match_id = e.match_id AND s.is_home = e.is_home WHERE e.rn <= 10""")(
    lambda t: H.team_history_asof(t.matches))
query("J11_team_history_home", """SELECT match_id, is_home, team_id, CAST(rn AS INT) AS rn, hist_id FROM (
    SELECT s.match_id, s.is_home, s.team_id, h.match_id AS hist_id,
      row_number() OVER (PARTITION BY s.match_id, s.is_home ORDER BY h.match_date DESC, h.match_id DESC) AS rn
    FROM sides s JOIN hist h ON h.team_id = s.team_id AND h.is_home AND h.match_date < s.match_date) WHERE rn <= 5""")(
    lambda t: H.team_history_asof(t.matches, 5, "home").select("match_id", "is_home", "team_id", "rn", "hist_id"))
query("J12_h2h_asof", """SELECT e.match_id, CAST(e.rn AS INT) AS rn, e.hist_id, e.hist_date, m.home_team_id, m.away_team_id,
    m.home_score, m.away_score, CASE WHEN m.home_score > m.away_score THEN 'H' WHEN m.home_score < m.away_score THEN 'A' ELSE 'D' END AS result
    FROM meetings e JOIN matches m ON m.id = e.hist_id WHERE e.rn <= 5""")(lambda t: H.h2h_asof(t.matches))
query("W15_match_h2h", """SELECT e.match_id, CAST(e.rn AS INT) AS rn, e.hist_id,
    CASE WHEN m.home_score > m.away_score THEN 'H' WHEN m.home_score < m.away_score THEN 'A' ELSE 'D' END AS result
    FROM meetings e JOIN matches m ON m.id = e.hist_id WHERE e.rn <= 20""")(
    lambda t: H.h2h_asof(t.matches, 20).select("match_id", "rn", "hist_id", "result"))

H2H = f"""SELECT m.id AS match_id, x.* FROM matches m, LATERAL (SELECT
    count(*) AS h2h_matches_count, count(*) FILTER (WHERE home_goals > away_goals) AS h2h_home_wins,
    count(*) FILTER (WHERE home_goals = away_goals) AS h2h_draws, count(*) FILTER (WHERE home_goals < away_goals) AS h2h_away_wins,
    {mean('CASE WHEN home_goals > away_goals THEN 1 ELSE 0 END', 'rn <= 5')} AS h2h_home_win_rate,
    {mean('home_goals + away_goals', 'rn <= 5')} AS h2h_avg_total_goals, {mean('home_goals', 'rn <= 5')} AS h2h_home_avg_goals,
    {mean('away_goals', 'rn <= 5')} AS h2h_away_avg_goals, {mean('pts', 'rn <= 3')} AS h2h_recent_home_form
    FROM meetings e WHERE e.match_id = m.id AND e.rn <= 5) x"""
query("W5_h2h_stats", H2H)(lambda t: H.h2h_stats(t.matches))
query("W5_h2h_stats_two_years", H2H.replace("AND e.rn <= 5) x", "AND e.rn <= 5 AND e.hist_date >= m.match_date - INTERVAL '730' DAY) x"))(
    lambda t: H.h2h_stats(t.matches, max_years_back=2))
query("A7_match_count_before", """SELECT s.match_id, s.is_home, s.team_id, count(h.match_id) AS count_before FROM sides s
    LEFT JOIN hist h ON h.team_id = s.team_id AND h.match_date < s.match_date GROUP BY ALL""")(
    lambda t: H.match_count_before(t.matches))

BREAKDOWN = f"""SELECT t.id AS team_id, {", ".join(f"coalesce(sum({e}) / CAST(count(b.match_id) AS DOUBLE), 0.0::DOUBLE) AS {a}" for e, a in (
    ("pts", "avg_points"), ("CAST(gf > ga AS INT)", "win_rate"), ("CAST(gf = ga AS INT)", "draw_rate"),
    ("CAST(gf < ga AS INT)", "loss_rate"), ("gf", "avg_goals_for"), ("ga", "avg_goals_against")))}
    FROM teams t LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rn
        FROM hist WHERE match_date < TIMESTAMP '{AS_OF}') b ON b.team_id = t.id AND b.rn <= 5 GROUP BY t.id"""
query("W8_form_breakdown", BREAKDOWN)(lambda t: H.form_breakdown(t.matches, t.teams, AS_OF))
query("W9_form_breakdown_api", f"""SELECT team_id, round(avg_points, 2) AS avg_points, round(win, 2) AS win_rate, round(draw, 2) AS draw_rate,
    round(1.0::DOUBLE - win - draw, 2) AS loss_rate, round(avg_goals_for, 2) AS avg_goals_for, round(avg_goals_against, 2) AS avg_goals_against
    FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 2 - 2 * win)) AS draw FROM (
      SELECT *, CASE WHEN avg_points >= 1 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (avg_points - 1) / 2)) ELSE 0.0::DOUBLE END AS win FROM ({BREAKDOWN})))""")(
    lambda t: H.form_breakdown_api(t.matches, t.teams, AS_OF))
query("W11_rolling_form_sql", """SELECT match_id, team_id, is_home, avg(pts) OVER w AS avg_points_last_5,
    avg(gf) OVER w AS avg_goals_for_last_5, avg(ga) OVER w AS avg_goals_against_last_5 FROM hist
    WINDOW w AS (PARTITION BY team_id ORDER BY match_date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")(
    lambda t: H.rolling_form(t.matches))
query("W12_weighted_momentum", """SELECT s.match_id, s.is_home, 0.0::DOUBLE + coalesce(p1, 0) * 1.0::DOUBLE + coalesce(p2, 0) * 0.95::DOUBLE + coalesce(p3, 0) * 0.85::DOUBLE
      + coalesce(p4, 0) * 0.7::DOUBLE + coalesce(p5, 0) * 0.5::DOUBLE AS momentum
    FROM sides s, LATERAL (SELECT max(pts) FILTER (WHERE rn = 1) AS p1, max(pts) FILTER (WHERE rn = 2) AS p2, max(pts) FILTER (WHERE rn = 3) AS p3,
      max(pts) FILTER (WHERE rn = 4) AS p4, max(pts) FILTER (WHERE rn = 5) AS p5 FROM earlier e WHERE e.match_id = s.match_id AND e.is_home = s.is_home) x""")(
    lambda t: H.weighted_momentum(t.matches))
query("W14_team_matches", """SELECT team_id, CAST(rn AS INT) AS rn, match_id FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rn
    FROM hist) WHERE rn <= 20""")(lambda t: H.team_matches(t.matches))
query("L5_topn_per_group", """SELECT team_id, CAST(rn AS INT) AS rn, match_id FROM (SELECT *, row_number() OVER (PARTITION BY team_id ORDER BY match_date DESC, match_id DESC) AS rn
    FROM hist WHERE NOT is_home) WHERE rn <= 5""")(lambda t: H.team_matches(t.matches, 5, "away"))
query("J16_match_preview", f"""SELECT m.id, h.name AS home_team, a.name AS away_team, m.match_date, t.name AS tournament,
    round(f.home_points_last_5, 2) AS home_avg_points, round(f.away_points_last_5, 2) AS away_avg_points
    FROM matches m JOIN teams h ON h.id = m.home_team_id JOIN teams a ON a.id = m.away_team_id
    JOIN tournaments t ON t.id = m.tournament_id JOIN ({wide(["points_last_5"])}) f ON f.match_id = m.id""")(
    lambda t: H.match_preview(t.matches, t.teams, t.tournaments))
query("A15_team_record", """SELECT team_id, count(*) AS played, CAST(sum(CAST(gf > ga AS INT)) AS BIGINT) AS wins,
    CAST(sum(CAST(gf = ga AS INT)) AS BIGINT) AS draws, CAST(sum(CAST(gf < ga AS INT)) AS BIGINT) AS losses,
    CAST(sum(gf) AS BIGINT) AS goals_for, CAST(sum(ga) AS BIGINT) AS goals_against FROM hist GROUP BY team_id""")(
    lambda t: H.team_record(t.matches))
query("A16_league_table", """SELECT tournament_id, season_id, team_id, CAST(sum(pts) AS BIGINT) AS points, CAST(sum(gf) AS BIGINT) AS goals_for,
    CAST(sum(ga) AS BIGINT) AS goals_against, CAST(sum(gf) - sum(ga) AS BIGINT) AS goal_diff,
    CAST(rank() OVER (PARTITION BY tournament_id, season_id ORDER BY sum(pts) DESC, sum(gf) - sum(ga) DESC) AS INT) AS position
    FROM hist GROUP BY tournament_id, season_id, team_id""")(lambda t: H.league_table(t.matches))
query("A17_training_rows", """SELECT id AS match_id, match_date, tournament_id, season_id, home_team_id, away_team_id, home_score, away_score,
    odds_home, odds_draw, odds_away, CASE WHEN home_score > away_score THEN 'H' WHEN home_score < away_score THEN 'A' ELSE 'D' END AS result,
    1 / odds_home AS implied_prob_home, 1 / odds_draw AS implied_prob_draw, 1 / odds_away AS implied_prob_away,
    CAST(dayofweek(match_date) AS INT) AS day_of_week, CAST(month(match_date) AS INT) AS month,
    (epoch_us(match_date) - epoch_us(lag(match_date) OVER (PARTITION BY home_team_id ORDER BY match_date, id))) / 86400000000.0::DOUBLE AS home_rest_days
    FROM matches WHERE status = 'FINISHED' AND home_score IS NOT NULL AND odds_home IS NOT NULL""")(
    lambda t: H.training_rows(t.matches))
query("W16_tournament_context", """SELECT match_id, season_progress,
    CASE WHEN season_progress < 0.2::DOUBLE THEN 'early' WHEN season_progress <= 0.75::DOUBLE THEN 'mid' ELSE 'late' END AS season_stage,
    home_league_position, away_league_position, home_league_position - away_league_position AS position_diff,
    home_points_total, away_points_total, home_points_total - away_points_total AS points_diff
    FROM (WITH md AS (SELECT id AS match_id, season_id, home_team_id, away_team_id, CAST(match_date AS DATE) AS d FROM matches),
      days AS (SELECT DISTINCT season_id, d FROM md),
      members AS (SELECT DISTINCT season_id, team_id FROM (SELECT season_id, home_team_id AS team_id FROM md UNION ALL SELECT season_id, away_team_id FROM md)),
      st AS (SELECT y.season_id, y.d, y.team_id, coalesce(sum(h.pts), 0) AS pts, coalesce(sum(h.gf - h.ga), 0) AS gd
             FROM (SELECT days.season_id, days.d, members.team_id FROM days JOIN members ON members.season_id = days.season_id) y
             LEFT JOIN hist h ON h.season_id = y.season_id AND h.team_id = y.team_id AND CAST(h.match_date AS DATE) < y.d GROUP BY ALL),
      rk AS (SELECT *, rank() OVER (PARTITION BY season_id, d ORDER BY pts DESC, gd DESC) AS pos FROM st)
      SELECT md.match_id,
        (SELECT count(*) FROM md x WHERE x.season_id = md.season_id AND x.d < md.d) / CAST((SELECT count(*) FROM md x WHERE x.season_id = md.season_id) AS DOUBLE) AS season_progress,
        CAST(h.pos AS INT) AS home_league_position, CAST(a.pos AS INT) AS away_league_position,
        CAST(h.pts AS BIGINT) AS home_points_total, CAST(a.pts AS BIGINT) AS away_points_total
      FROM md JOIN rk h ON h.season_id = md.season_id AND h.d = md.d AND h.team_id = md.home_team_id
      JOIN rk a ON a.season_id = md.season_id AND a.d = md.d AND a.team_id = md.away_team_id)""")(
    lambda t: H.tournament_context(t.matches))
