"""Filtered listings, lookups, paging and summary counts.

Listings come unpaged and ordered; ``page`` applies offset and limit. The total of a
listing is ``count_rows`` over the same filters, without the sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.match import days, is_finished, match_result, ntz
from touchline.functions.odds import has_odds
from touchline.schema import MATCH_STATUSES


def page(df: DataFrame, order: Sequence[str | Column], offset: int = 0, limit: int = 50) -> DataFrame:
    """One page in a stable order; a top-(offset + limit), not a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)


def count_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def match_filter(matches: DataFrame, *, status: str | None = None, tournament_id: int | None = None,
                 season_id: int | None = None, team_id: int | None = None, start=None, end=None,
                 days_ahead: int | None = None, has_all_odds: bool | None = None, as_of=None) -> DataFrame:
    """The match listing's filters; falsy ids do not filter, dates are inclusive."""
    if status is not None and status not in MATCH_STATUSES:
        raise ValueError(f"status must be one of {MATCH_STATUSES}")
    if days_ahead is not None and not 1 <= days_ahead <= 365:
        raise ValueError("days_ahead must be 1..365")
    rows = matches
    if status:
        rows = rows.filter(F.col("status") == status)
    if tournament_id:
        rows = rows.filter(F.col("tournament_id") == tournament_id)
    if season_id:
        rows = rows.filter(F.col("season_id") == season_id)
    if team_id:
        rows = rows.filter((F.col("home_team_id") == team_id) | (F.col("away_team_id") == team_id))
    if start is not None:
        rows = rows.filter(F.col("match_date") >= ntz(start))
    if end is not None:
        rows = rows.filter(F.col("match_date") <= ntz(end))
    if days_ahead:
        rows = rows.filter(F.col("match_date").between(ntz(as_of), ntz(as_of) + days(days_ahead)))
    if has_all_odds is not None:
        rows = rows.filter(has_odds() if has_all_odds else ~has_odds())
    return rows


def list_matches(matches: DataFrame, **filters) -> DataFrame:
    """Filtered matches with their result, which needs status FINISHED here."""
    return match_filter(matches, **filters).withColumn("result", match_result(require_finished=True))


def season_matches(matches: DataFrame, seasons: DataFrame, season_id: int, *, status: str | None = None,
                   team_id: int | None = None) -> DataFrame:
    """Matches of an existing season; an unknown season gives none."""
    known = seasons.filter(F.col("id") == season_id).select(F.col("id").alias("season_id"))
    return match_filter(matches, status=status, team_id=team_id).join(known, "season_id", "left_semi")


def historical_matches(matches: DataFrame, *, start=None, end=None, tournament_id: int | None = None,
                       require_results: bool = True) -> DataFrame:
    rows = match_filter(matches, start=start, end=end, tournament_id=tournament_id)
    return rows.filter(is_finished()) if require_results else rows


def list_predictions(predictions: DataFrame, matches: DataFrame, *, match_id: int | None = None,
                     model_version_id: int | None = None, has_result: bool | None = None, start=None, end=None,
                     min_confidence: float | None = None) -> DataFrame:
    """Prediction listing; the match is joined only where its result matters."""
    rows = predictions
    if match_id:
        rows = rows.filter(F.col("match_id") == match_id)
    if model_version_id:
        rows = rows.filter(F.col("model_version_id") == model_version_id)
    if start is not None:
        rows = rows.filter(F.col("predicted_at") >= ntz(start))
    if end is not None:
        rows = rows.filter(F.col("predicted_at") <= ntz(end))
    if min_confidence:
        rows = rows.filter(F.col("confidence") >= min_confidence)
    if has_result is not None:
        wanted = is_finished() if has_result else F.col("status").isin("SCHEDULED", "LIVE")
        rows = rows.join(matches.filter(wanted).select(F.col("id").alias("match_id")), "match_id", "left_semi")
    return rows


def query_matches(matches: DataFrame, tournaments: DataFrame, *, ids: DataFrame | None = None, status: str = "SCHEDULED",
                  days_ahead: int | None = None, tournament: str | None = None, as_of=None) -> DataFrame:
    """Prediction candidates. Given ids win over every other filter; the date has no lower bound."""
    if ids is not None:
        return matches.join(ids, "id", "left_semi")
    rows = matches.filter(F.col("status") == status)
    if days_ahead is not None:
        rows = rows.filter(F.col("match_date") <= ntz(as_of) + days(days_ahead))
    if tournament:
        hit = tournaments.filter(F.col("name") == tournament).select(F.col("id").alias("tournament_id"))
        rows = rows.join(hit, "tournament_id", "left_semi")
    return rows


def ilike_search(df: DataFrame, text: str, column: str = "name") -> DataFrame:
    """Case-insensitive substring search; ``%`` and ``_`` in the text stay wildcards."""
    return df.filter(F.col(column).ilike(f"%{text}%"))


def upcoming_cli(matches: DataFrame, as_of, ahead: int = 7, newest: int = 100) -> DataFrame:
    """Scheduled matches in the window, looked for among the ``newest`` latest scheduled only."""
    latest = matches.filter(F.col("status") == "SCHEDULED").orderBy(F.col("match_date").desc(), F.col("id").desc()).limit(newest)
    return latest.filter(F.col("match_date").between(ntz(as_of), ntz(as_of) + days(ahead)))


def get_by_id(df: DataFrame, id: int, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == id)


def list_by(df: DataFrame, order: Sequence[str | Column], **equals) -> DataFrame:
    """Equality filters (None skips) and an order: schedules, models and jobs share it."""
    for column, value in equals.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df.orderBy(*order)


# --- counts and summaries -----------------------------------------------------------------

def tournament_season_counts(tournaments: DataFrame, seasons: DataFrame) -> DataFrame:
    counts = seasons.groupBy(F.col("tournament_id").alias("id")).agg(F.count("*").alias("seasons"))
    return tournaments.join(counts, "id", "left").withColumn("seasons", F.coalesce("seasons", F.lit(0)))


def season_match_counts(seasons: DataFrame, tournaments: DataFrame, matches: DataFrame) -> DataFrame:
    counts = matches.groupBy(F.col("season_id").alias("id")).agg(F.count("*").alias("matches"))
    t = tournaments.select(F.col("id").alias("tournament_id"), F.col("name").alias("tournament_name"))
    return seasons.join(t, "tournament_id").join(counts, "id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def team_matches_played(teams: DataFrame, matches: DataFrame) -> DataFrame:
    sides = matches.select(F.explode(F.array("home_team_id", "away_team_id")).alias("id"))
    counts = sides.groupBy("id").agg(F.count("*").alias("played"))
    return teams.join(counts, "id", "left").withColumn("played", F.coalesce("played", F.lit(0)))


def db_stats(tournaments: DataFrame, seasons: DataFrame, teams: DataFrame, matches: DataFrame, models: DataFrame,
             tasks: DataFrame) -> DataFrame:
    """Global row counts in one row: counts are stacked as rows and folded, not cross-joined."""
    one = {"tournaments": tournaments, "seasons": seasons, "teams": teams, "models": models, "tasks": tasks.select("task_id").distinct()}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("k"), "n") for name, df in one.items()]
    by_status = matches.agg(
        F.count("*").alias("matches"), F.count_if(F.col("status") == "FINISHED").alias("finished"),
        F.count_if(F.col("status") == "SCHEDULED").alias("scheduled"))
    parts.append(by_status.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("k"), F.col(c).alias("n")) for c in by_status.columns]))))
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    names = [*one, "matches", "finished", "scheduled"]
    return stacked.agg(*[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in names])


def scraping_stats(jobs: DataFrame) -> DataFrame:
    """Job totals per status, matches, mean duration of completed jobs and the success rate."""
    done, bad = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return jobs.agg(
        F.count("*").alias("total_jobs"), done.alias("completed"), bad.alias("failed"),
        F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.coalesce(F.sum("matches_scraped"), F.lit(0)).alias("matches_scraped"),
        F.avg(F.when(F.col("status") == "completed", F.col("duration_seconds"))).alias("avg_duration"),
        F.when(done + bad > 0, done / (done + bad) * 100).otherwise(F.lit(0.0)).alias("success_rate"))


def last_execution(runs: DataFrame) -> DataFrame:
    """Newest run per task."""
    newest = F.max_by(F.struct("id", "status", "duration_seconds", "started_at"), F.struct("started_at", "id"))
    return runs.groupBy("task_id").agg(newest.alias("run")).select("task_id", "run.*")


def jobs_by_task(runs: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` runs of each task."""
    newest = Window.partitionBy("task_id").orderBy(F.col("started_at").desc(), F.col("id").desc())
    return runs.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)


def prediction_summary(predictions: DataFrame) -> DataFrame:
    pick = F.col("predicted_outcome")
    return predictions.agg(
        F.count("*").alias("total"), F.avg("confidence").alias("avg_confidence"),
        F.count_if(pick == "H").alias("home"), F.count_if(pick == "D").alias("draw"), F.count_if(pick == "A").alias("away"))


def model_summary(models: DataFrame) -> DataFrame:
    return models.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"),
                      F.avg(F.coalesce("accuracy", F.lit(0.0))).alias("avg_accuracy"))


def dashboard_stats(predictions: DataFrame, matches: DataFrame, models: DataFrame, value_bets: DataFrame, as_of, ahead: int = 7) -> DataFrame:
    """Totals of the dashboard in one row; ``predictions`` carries ``actual_roi`` (NULL while open)."""
    roi = F.col("actual_roi")
    sums = predictions.agg(
        F.count("*").alias("total_predictions"), F.sum(roi).alias("total_roi"),
        F.coalesce(F.count_if(roi > 0) / F.nullif(F.count(roi), F.lit(0)), F.lit(0.0)).alias("win_rate"),
        F.avg("confidence").alias("avg_confidence"))
    soon = match_filter(matches, status="SCHEDULED", start=as_of).filter(F.col("match_date") <= ntz(as_of) + days(ahead))
    return sums.withColumns({
        "upcoming_matches": soon.agg(F.count("*")).scalar(),
        "value_bets": value_bets.agg(F.count("*")).scalar(),
        "active_accuracy": models.filter("is_active").agg(F.max("accuracy")).scalar()})


def with_actual_roi(predictions: DataFrame, matches: DataFrame) -> DataFrame:
    """Profit of one unit on the predicted outcome of finished, priced matches; NULL otherwise."""
    games = matches.select(F.col("id").alias("match_id"), "odds_home", "odds_draw", "odds_away",
                           match_result(require_finished=True).alias("result"))
    pick = F.col("predicted_outcome")
    odds = F.when(pick == "H", F.col("odds_home")).when(pick == "D", F.col("odds_draw")).otherwise(F.col("odds_away"))
    return predictions.join(games, "match_id").withColumn("actual_roi", F.when(
        F.col("result").isNotNull() & odds.isNotNull(), F.when(F.col("result") == pick, odds - 1).otherwise(F.lit(-1.0))))
