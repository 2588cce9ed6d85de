"""Registry of queries and their oracle SQL.

``@query(key, sql)`` registers a function of :class:`Tables`. Oracle text may use the names
of the shared table expressions below; the ones it needs are put in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from touchline.sources.fixtures import Tables, derive

AS_OF = "2001-01-01 00:00:00"

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# Shared table expressions, in dependency order.
CTES: dict[str, str] = {
    "teams": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "tournaments": """SELECT CAST(r_regionkey AS BIGINT) AS id, concat('League ', r_name) AS name, r_name AS country,
        concat(lower(replace(r_name, ' ', '-')), '-league') AS url_slug FROM region""",
    "matches": """WITH n AS (SELECT CAST(floor(count(*) / 5) AS BIGINT) AS per_t FROM supplier),
        b AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS match_date, o_custkey % 5 AS t, per_t,
                     (o_orderkey * 7 + o_custkey) % per_t AS hi
              FROM orders CROSS JOIN n),
        d AS (SELECT b.*, (hi + 1 + (id * 3 + c) % (per_t - 1)) % per_t AS ai,
                     CASE WHEN id % 97 = 0 THEN 'LIVE' WHEN match_date >= TIMESTAMP '2001-01-01 00:00:00' THEN 'SCHEDULED' ELSE 'FINISHED' END AS status,
                     20 + (id * 37 + c) % 40 AS wh, 20 + (id * 11 + c) % 11 AS wd, 15 + (id * 29 + c) % 35 AS wa,
                     year(match_date) - CASE WHEN month(match_date) < 8 THEN 1 ELSE 0 END AS sy
              FROM b)
        SELECT id, t AS tournament_id, CAST(sy AS BIGINT) * 10 + t AS season_id,
               hi * 5 + t AS home_team_id, ai * 5 + t AS away_team_id, match_date, status,
               CASE WHEN status = 'FINISHED' THEN CAST((id * 31 + c * 17) % 5 AS INT) END AS home_score,
               CASE WHEN status = 'FINISHED' THEN CAST((id * 13 + c * 7 + 3) % 4 AS INT) END AS away_score,
               CASE WHEN id % 11 <> 0 THEN CAST(floor(CAST(10000 * (wh + wd + wa) AS DOUBLE) / (105 * wh)) AS DOUBLE) / 100 END AS odds_home,
               CASE WHEN id % 11 <> 0 THEN CAST(floor(CAST(10000 * (wh + wd + wa) AS DOUBLE) / (105 * wd)) AS DOUBLE) / 100 END AS odds_draw,
               CASE WHEN id % 11 <> 0 THEN CAST(floor(CAST(10000 * (wh + wd + wa) AS DOUBLE) / (105 * wa)) AS DOUBLE) / 100 END AS odds_away,
               CASE WHEN id % 17 <> 0 THEN CAST(id % 13 AS INT) END AS num_bookmakers
        FROM d""",
    "seasons": """SELECT season_id AS id, tournament_id, concat(CAST(sy AS VARCHAR), '/', CAST(sy + 1 AS VARCHAR)) AS name,
               CAST(sy AS INT) AS start_year, CAST(sy + 1 AS INT) AS end_year
        FROM (SELECT DISTINCT season_id, tournament_id, CAST((season_id - tournament_id) / 10 AS BIGINT) AS sy FROM matches) x""",
    "model_versions": """SELECT CAST(v.id AS BIGINT) AS id, concat('model_v', CAST(v.id AS VARCHAR)) AS version,
               CASE WHEN v.id = 3 THEN 'random_forest' ELSE 'gbt' END AS algorithm, v.id = 2 AS is_active,
               CASE WHEN v.id < 3 THEN 0.5::DOUBLE + CAST(v.id AS DOUBLE) / 100 END AS accuracy
        FROM (SELECT 1 AS id UNION ALL SELECT 2 UNION ALL SELECT 3) v""",
    "predictions": """WITH w AS (
          SELECT m.id AS match_id, v.id AS model_version_id, m.match_date,
                 20 + (m.id * 37 + v.id * 5) % 40 AS a, 20 + (m.id * 11 + v.id * 3) % 11 AS b, 15 + (m.id * 29 + v.id * 7) % 35 AS c
          FROM matches m CROSS JOIN (SELECT 1 AS id UNION ALL SELECT 2 UNION ALL SELECT 3) v
          WHERE m.id % 3 <> v.id - 1),
        q AS (SELECT match_id, model_version_id, match_date, CAST(a AS DOUBLE) / (a + b + c) AS prob_home,
                     CAST(b AS DOUBLE) / (a + b + c) AS prob_draw, CAST(c AS DOUBLE) / (a + b + c) AS prob_away FROM w)
        SELECT match_id * 10 + model_version_id AS id, match_id, model_version_id, prob_home, prob_draw, prob_away,
               CASE WHEN prob_home >= prob_draw AND prob_home >= prob_away THEN 'H' WHEN prob_draw >= prob_away THEN 'D' ELSE 'A' END AS predicted_outcome,
               greatest(prob_home, prob_draw, prob_away) AS confidence, match_date - INTERVAL '1' DAY AS predicted_at
        FROM q""",
    "task_executions": """SELECT event_id AS id, user_id % 4 AS task_id,
               CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status,
               ts AS started_at, CASE WHEN event_type <> 'signup' THEN value END AS duration_seconds,
               CAST(CASE WHEN event_type = 'purchase' THEN event_id % 50 ELSE 0 END AS INT) AS matches_scraped
        FROM events""",
    # Two rows per finished match, one per side.
    "hist": """SELECT id AS match_id, match_date, season_id, tournament_id, home_team_id AS team_id, away_team_id AS other_id, TRUE AS is_home,
               home_score AS gf, away_score AS ga,
               CASE WHEN home_score > away_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END AS pts
        FROM matches WHERE status = 'FINISHED' AND home_score IS NOT NULL AND away_score IS NOT NULL
        UNION ALL
        SELECT id, match_date, season_id, tournament_id, away_team_id, home_team_id, FALSE, away_score, home_score,
               CASE WHEN away_score > home_score THEN 3 WHEN home_score = away_score THEN 1 ELSE 0 END
        FROM matches WHERE status = 'FINISHED' AND home_score IS NOT NULL AND away_score IS NOT NULL""",
    # Two rows per match of any status.
    "sides": """SELECT id AS match_id, match_date, home_team_id AS team_id, TRUE AS is_home FROM matches
        UNION ALL SELECT id, match_date, away_team_id, FALSE FROM matches""",
    # Brute-force as-of join: every earlier match of the team, numbered from the newest.
    "earlier": """SELECT s.match_id, s.is_home, s.match_date, h.match_id AS hist_id, h.match_date AS hist_date, h.gf, h.ga, h.pts,
               row_number() OVER (PARTITION BY s.match_id, s.is_home ORDER BY h.match_date DESC, h.match_id DESC) AS rn
        FROM sides s JOIN hist h ON h.team_id = s.team_id AND h.match_date < s.match_date""",
    "earlier_venue": """SELECT s.match_id, s.is_home, h.gf, h.ga, h.pts,
               row_number() OVER (PARTITION BY s.match_id, s.is_home ORDER BY h.match_date DESC, h.match_id DESC) AS rn
        FROM sides s JOIN hist h ON h.team_id = s.team_id AND h.is_home = s.is_home AND h.match_date < s.match_date""",
    "meetings": """SELECT m.id AS match_id, h.match_id AS hist_id, h.match_date AS hist_date, h.gf AS home_goals, h.ga AS away_goals, h.pts,
               row_number() OVER (PARTITION BY m.id ORDER BY h.match_date DESC, h.match_id DESC) AS rn
        FROM matches m JOIN hist h ON h.team_id = m.home_team_id AND h.other_id = m.away_team_id AND h.match_date < m.match_date""",
    # Evaluation frame: stored predictions of finished matches with the coded label.
    "scored": """SELECT p.match_id, p.model_version_id, p.prob_home, p.prob_draw, p.prob_away, m.match_date,
               m.odds_home, m.odds_draw, m.odds_away,
               CASE WHEN m.home_score > m.away_score THEN 0 WHEN m.home_score = m.away_score THEN 1 ELSE 2 END AS label,
               CASE p.predicted_outcome WHEN 'H' THEN 0 WHEN 'D' THEN 1 ELSE 2 END AS pred
        FROM predictions p JOIN matches m ON m.id = p.match_id
        WHERE m.status = 'FINISHED' AND m.home_score IS NOT NULL AND m.away_score IS NOT NULL""",
    # Evaluation frame by class.
    "by_class": """SELECT match_id, model_version_id, match_date, 0 AS cls, prob_home AS prob, odds_home AS odds, CAST(label = 0 AS INT) AS hit FROM scored
        UNION ALL SELECT match_id, model_version_id, match_date, 1, prob_draw, odds_draw, CAST(label = 1 AS INT) FROM scored
        UNION ALL SELECT match_id, model_version_id, match_date, 2, prob_away, odds_away, CAST(label = 2 AS INT) FROM scored""",
    "bets": """SELECT *, stake * odds * hit - stake AS profit FROM (
          SELECT *, CASE WHEN kelly > 0 THEN kelly ELSE 1.0::DOUBLE END AS stake FROM (
            SELECT *, CASE WHEN odds - 1 > 0 THEN greatest(0.0::DOUBLE, ((odds - 1) * prob - (1 - prob)) / (odds - 1)) * 0.25::DOUBLE ELSE 0.0::DOUBLE END AS kelly
            FROM by_class WHERE odds IS NOT NULL AND match_id IN (SELECT id FROM matches WHERE odds_home IS NOT NULL AND odds_draw IS NOT NULL AND odds_away IS NOT NULL)
              AND prob - 1 / odds > 0))""",
}


def expand(sql: str) -> str:
    """Put the shared expressions that ``sql`` names (directly or not) in front of it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    if not needed:
        return sql
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {head},\nanswer AS ({sql})\nSELECT * FROM answer"


def query(key: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``, with its oracle where SQL can say it."""

    def register(fn: Callable[[Tables], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, path: fn(derive(spark, path))
        if sql is not None:
            ORACLES[key] = expand(sql)
        return fn

    return register
