"""Page parsing on pages rendered from the matches, batch merges and validation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from touchline.catalog.base import AS_OF, query
from touchline.functions.match import is_finished, micros, ntz
from touchline.operators import ingest as I
from touchline.operators import joins as J
from touchline.operators import quality as Q
from touchline.plans.materialize import materialize
from touchline.plans.ordering import with_rank
from touchline.sources import pages as G

DONE = "status = 'FINISHED' AND home_score IS NOT NULL AND away_score IS NOT NULL"
PAGE_ROWS = 50


def odds_text(c):
    return F.when(F.col(c).isNotNull(), F.concat(F.lit("<p>"), F.format_string("%.2f", F.col(c)), F.lit("</p>"))).otherwise(F.lit(""))


def game_html(score):
    return F.concat(
        F.lit('<div data-testid="game-row"><div data-testid="time-item">'), F.date_format("match_date", "HH:mm"), F.lit("</div>"),
        *[x for side in ("home", "away") for x in (F.lit('<a title="'), F.col(f"{side}_team"), F.lit('" href="#">'), F.col(f"{side}_team"), F.lit("</a>"))],
        score, odds_text("odds_home"), odds_text("odds_draw"), odds_text("odds_away"),
        F.coalesce(F.concat(F.lit("<div>"), F.col("num_bookmakers").cast("string"), F.lit("</div>")), F.lit("")), F.lit("</div>"))


def paged(rows):
    """Pages of at most PAGE_ROWS consecutive rows per season."""
    ranked = with_rank(rows.withColumn("us", micros()), ["us", "id"], by=["season_id"], out="pos")
    return ranked.withColumn("page_id", F.concat_ws("-", F.col("season_id").cast("string"), F.floor(F.col("pos") / PAGE_ROWS).cast("string")))


def render(rows, lead):
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat(lead, F.col("game")).alias("h"))))
    body = F.array_join(F.transform(parts, lambda p: p["h"]), "")
    return rows.groupBy("page_id").agg(F.concat(F.lit('<html><body><main><div class="eventRow">'), body, F.lit(
        "</div></main><footer>Contact 99 1.23 7</footer></body></html>")).alias("html"))


def results_pages(t):
    rows = paged(J.match_names(t.matches.filter(is_finished()), t.teams))
    day = F.date_format("match_date", "dd MMM yyyy")
    changed = F.lag(day).over(Window.partitionBy("page_id").orderBy("pos"))
    rows = rows.withColumn("lead", F.when(changed.isNull() | (changed != day), F.concat(
        F.lit('<div data-testid="date-header">'), day, F.lit("</div>"))).otherwise(F.lit("")))
    score = F.concat(F.lit("<div>"), F.col("home_score").cast("string"), F.lit(" – "), F.col("away_score").cast("string"), F.lit("</div>"))
    return render(rows.withColumn("game", game_html(score)), F.col("lead"))


NAMED = "SELECT m.*, h.name AS home_team, a.name AS away_team FROM matches m JOIN teams h ON h.id = m.home_team_id JOIN teams a ON a.id = m.away_team_id"
# Without a bookmaker count the row's last number is the away odds, whose whole part is read instead.
BOOKS = "CASE WHEN odds_home IS NOT NULL THEN nullif(coalesce(num_bookmakers, CAST(floor(odds_away) AS INT)), 0) END AS num_bookmakers"
query("S5_pages_to_results", f"SELECT date_trunc('minute', match_date) AS match_date, home_team, away_team, home_score, away_score, odds_home, odds_draw, odds_away, {BOOKS} FROM ({NAMED}) WHERE {DONE}")(
    lambda t: G.pages_to_results(results_pages(t)).drop("page_id", "pos"))


def upcoming_pages(t):
    tour = t.tournaments.select(F.col("id").alias("tournament_id"), F.col("name").alias("tournament"), "country", "url_slug")
    named = J.match_names(t.matches.filter("status = 'SCHEDULED'"), t.teams).join(tour, "tournament_id", "left")
    rows = paged(named)
    day = F.date_format("match_date", "dd MMM")
    first = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")) == 1
    before = F.lag(day).over(Window.partitionBy("page_id").orderBy("pos"))
    league = F.concat(F.lit('<div data-testid="sport-country-league-item"><a data-testid="header-country-item" href="/football/">'), F.col("country"),
                      F.lit('</a><a data-testid="header-tournament-item" href="/football/x/'), F.col("url_slug"), F.lit('/">'), F.col("tournament"), F.lit("</a></div>"))
    date = F.concat(F.lit('<div data-testid="secondary-header"><div class="text-black-main">Today, '), day, F.lit("</div></div>"))
    rows = rows.withColumn("lead", F.concat(F.when(first, league).otherwise(F.lit("")), F.when(first | (before != day), date).otherwise(F.lit(""))))
    return render(rows.withColumn("game", game_html(F.lit(""))), F.col("lead"))


TITLE = "concat(upper(substr({0}, 1, 1)), lower(substr({0}, 2)))"
query("S6_pages_to_upcoming", f"""SELECT x.name AS tournament_name, CASE WHEN x.country = 'MIDDLE EAST' THEN 'Middle East' ELSE {TITLE.format('x.country')} END AS country, x.url_slug AS tournament_slug,
    date_trunc('minute', match_date) AS match_date, home_team, away_team, odds_home, odds_draw, odds_away, {BOOKS} FROM ({NAMED}) m JOIN tournaments x ON x.id = m.tournament_id WHERE status = 'SCHEDULED'""")(
    lambda t: G.pages_to_upcoming(upcoming_pages(t), as_of=AS_OF).drop("page_id", "pos"))
query("W13_carry_forward", f"SELECT date_trunc('day', match_date) AS header, count(*) AS n FROM matches WHERE {DONE} GROUP BY 1")(
    lambda t: G.pages_to_results(results_pages(t)).groupBy(F.date_trunc("day", "match_date").cast("timestamp_ntz").alias("header")).agg(F.count("*").alias("n")))


def listing_pages(t):
    """One page per tournament with its season links and a pagination bar sized by its matches."""
    link = F.concat(F.lit('<a href="/football/x/'), F.col("url_slug"),
                    F.when(F.col("start_year") >= 2000, F.lit("")).otherwise(F.concat(F.lit("-"), F.replace("name", F.lit("/"), F.lit("-")))),
                    F.lit('/results/">'), F.col("name"), F.lit("</a>"))
    tour = t.tournaments.select(F.col("id").alias("tournament_id"), "url_slug")
    seasons = t.seasons.join(tour, "tournament_id").groupBy("tournament_id").agg(F.array_join(F.array_sort(F.collect_list(link)), " ").alias("s"))
    counts = t.matches.groupBy("tournament_id").agg(F.ceil(F.count("*") / PAGE_ROWS).cast("string").alias("n"))
    return seasons.join(counts, "tournament_id").select(F.col("tournament_id").alias("page_id"), F.concat(
        F.lit("<body>"), F.col("s"), F.lit('<a class="pagination-link" href="#">1</a><a class="pagination-link" href="#">'), F.col("n"),
        F.lit('</a><a class="pagination-link" href="#">Next</a></body>')).alias("html"))


query("S7_season_links", """SELECT tournament_id AS page_id, name, CASE WHEN start_year < 2000 THEN replace(name, '/', '-') END AS url_suffix, start_year >= 2000 AS is_current FROM seasons""")(
    lambda t: G.season_links(listing_pages(t)))
query("S8_page_count", "SELECT tournament_id AS page_id, CAST(greatest(1, ceil(count(*) / 50.0)) AS INT) AS page_count FROM matches GROUP BY 1")(
    lambda t: G.page_count(listing_pages(t)))


# --- batch merges ------------------------------------------------------------------------
def raw_upcoming(t):
    """Every open match twice (new odds, then odds that may be missing), and each again a year later."""
    tour = t.tournaments.select(F.col("id").alias("tournament_id"), F.col("name").alias("tournament_name"), "country", F.col("url_slug").alias("tournament_slug"))
    opened = J.match_names(t.matches.filter("status <> 'FINISHED'"), t.teams).join(tour, "tournament_id", "left")
    cols = ["tournament_slug", "tournament_name", "country", "home_team", "away_team", "match_date"]
    one = opened.select((F.col("id") * 4).alias("seq"), *cols, *[(F.col(o) + 1).alias(o) for o in I.ODDS])
    two = opened.select((F.col("id") * 4 + 1).alias("seq"), *cols, *[F.when(F.col("num_bookmakers") > 6, F.col(o) + 2).alias(o) for o in I.ODDS])
    later = opened.select((F.col("id") * 4 + 2).alias("seq"), *cols[:3], F.when(F.col("status") == "LIVE", F.concat("home_team", F.lit(" B"))).otherwise(F.col("home_team")).alias("home_team"),
                          "away_team", (F.col("match_date") + F.expr("INTERVAL '400' DAY")).alias("match_date"), *I.ODDS)
    # A scraped batch is a stored table; write it once instead of deriving it at every use.
    return materialize(one.unionByName(two).unionByName(later), "raw")


RAW = """SELECT * FROM (WITH o AS (SELECT m.*, h.name AS home_team, a.name AS away_team FROM matches m JOIN teams h ON h.id = m.home_team_id JOIN teams a ON a.id = m.away_team_id WHERE m.status <> 'FINISHED')
    SELECT id * 4 AS seq, tournament_id, home_team, away_team, match_date, odds_home + 1 AS odds_home, odds_draw + 1 AS odds_draw, odds_away + 1 AS odds_away FROM o
    UNION ALL SELECT id * 4 + 1, tournament_id, home_team, away_team, match_date, CASE WHEN num_bookmakers > 6 THEN odds_home + 2 END, CASE WHEN num_bookmakers > 6 THEN odds_draw + 2 END, CASE WHEN num_bookmakers > 6 THEN odds_away + 2 END FROM o
    UNION ALL SELECT id * 4 + 2, tournament_id, CASE WHEN status = 'LIVE' THEN concat(home_team, ' B') ELSE home_team END, away_team, match_date + INTERVAL '400' DAY, odds_home, odds_draw, odds_away FROM o)"""
ALL_TEAMS = f"""SELECT id, name FROM teams UNION ALL SELECT (SELECT max(id) FROM teams) + row_number() OVER (ORDER BY s), name FROM (
    SELECT name, min(s) AS s FROM (SELECT home_team AS name, seq * 2 AS s FROM ({RAW}) UNION ALL SELECT away_team, seq * 2 + 1 FROM ({RAW})) WHERE name NOT IN (SELECT name FROM teams) GROUP BY name)"""
query("J19_get_or_create_dim", ALL_TEAMS)(lambda t: I.get_or_create_dim(t.teams, I.team_names(raw_upcoming(t)), "name"))
query("J19_tournaments_kept", "SELECT id, name, country, url_slug FROM tournaments")(
    lambda t: I.get_or_create_dim(t.tournaments, I.tournament_rows(raw_upcoming(t)), "url_slug"))


def resolved(t):
    raw = raw_upcoming(t)
    teams = materialize(I.get_or_create_dim(t.teams, I.team_names(raw), "name"), "teams")
    return I.resolve(raw, teams, t.tournaments)


MERGED_COLS = ["id", "tournament_id", "home_team_id", "away_team_id", "match_date", "status", "odds_home", "odds_draw", "odds_away"]
FOLDED_ODDS = ", ".join(f"""(arg_max(struct_pack(v := {o}), CASE WHEN odds_home IS NOT NULL THEN seq END)).v AS last_{o}, (arg_min(struct_pack(v := {o}), seq)).v AS first_{o}""" for o in I.ODDS)
FOLD = f"""SELECT h.id AS home_team_id, a.id AS away_team_id, r.match_date, min(seq) AS seq, arg_min(tournament_id, seq) AS tournament_id,
    {FOLDED_ODDS},
    count(*) FILTER (WHERE odds_home IS NOT NULL) > 0 AS priced
    FROM ({RAW}) r JOIN ({ALL_TEAMS}) h ON h.name = r.home_team JOIN ({ALL_TEAMS}) a ON a.name = r.away_team GROUP BY h.id, a.id, r.match_date"""
query("J17_upsert_upcoming", f"""WITH f AS ({FOLD})
    SELECT m.id, m.tournament_id, m.home_team_id, m.away_team_id, m.match_date, m.status, {", ".join(f"CASE WHEN f.priced THEN f.last_{o} ELSE m.{o} END AS {o}" for o in I.ODDS)}
    FROM matches m LEFT JOIN f ON f.home_team_id = m.home_team_id AND f.away_team_id = m.away_team_id AND f.match_date = m.match_date
    UNION ALL SELECT (SELECT max(id) FROM matches) + row_number() OVER (ORDER BY f.seq), tournament_id, home_team_id, away_team_id, match_date, 'SCHEDULED',
    {", ".join(f"CASE WHEN f.priced THEN f.last_{o} ELSE f.first_{o} END" for o in I.ODDS)}
    FROM f WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.home_team_id = f.home_team_id AND m.away_team_id = f.away_team_id AND m.match_date = f.match_date)""")(
    lambda t: I.upsert_upcoming(t.matches, resolved(t)).select(*MERGED_COLS))


def raw_results(t):
    """Results for every open match (blocked by the open row) and a replay of each a year later, twice."""
    score = {"home_score": (F.col("id") % 4).cast("int"), "away_score": (F.col("id") % 3).cast("int")}
    opened = t.matches.filter("status <> 'FINISHED'").withColumns(score).withColumn("seq", F.col("id") * 4)
    later = opened.withColumn("match_date", F.col("match_date") + F.expr("INTERVAL '400' DAY")).withColumn("seq", F.col("seq") + 1)
    again = later.withColumn("seq", F.col("seq") + 1).withColumn("home_score", F.col("home_score") + 1)
    return opened.unionByName(later).unionByName(again).drop("id", "season_id", "status")


RESULT_COLS = ["id", "tournament_id", "home_team_id", "away_team_id", "match_date", "status", "home_score", "away_score", "num_bookmakers"]
NEW_RESULTS = """SELECT (SELECT max(id) FROM matches) + row_number() OVER (ORDER BY seq) AS id, tournament_id, home_team_id, away_team_id, match_date, 'FINISHED' AS status, home_score, away_score, num_bookmakers
    FROM (SELECT *, row_number() OVER (PARTITION BY tournament_id, home_team_id, away_team_id, match_date ORDER BY seq) AS k FROM (
      SELECT id * 4 + 1 AS seq, tournament_id, home_team_id, away_team_id, match_date + INTERVAL '400' DAY AS match_date, CAST(id % 4 AS INT) AS home_score, CAST(id % 3 AS INT) AS away_score, num_bookmakers FROM matches WHERE status <> 'FINISHED'))  n
    WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM matches m WHERE m.tournament_id = n.tournament_id AND m.home_team_id = n.home_team_id AND m.away_team_id = n.away_team_id AND m.match_date = n.match_date)"""
query("J18_insert_results", f"SELECT {', '.join(RESULT_COLS)} FROM matches UNION ALL {NEW_RESULTS}")(
    lambda t: I.insert_results(t.matches, raw_results(t)).select(*RESULT_COLS))
query("J18_insert_results_update", f"""SELECT m.id, m.tournament_id, m.home_team_id, m.away_team_id, m.match_date, 'FINISHED' AS status,
    CASE WHEN m.status = 'FINISHED' THEN m.home_score ELSE CAST(f.id % 4 AS INT) END AS home_score, CASE WHEN m.status = 'FINISHED' THEN m.away_score ELSE CAST(f.id % 3 AS INT) END AS away_score,
    CASE WHEN m.status = 'FINISHED' THEN m.num_bookmakers ELSE coalesce(f.num_bookmakers, m.num_bookmakers) END AS num_bookmakers
    FROM matches m LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tournament_id, home_team_id, away_team_id, match_date ORDER BY id) AS k FROM matches WHERE status <> 'FINISHED') WHERE k = 1) f
      ON f.tournament_id = m.tournament_id AND f.home_team_id = m.home_team_id AND f.away_team_id = m.away_team_id AND f.match_date = m.match_date
    UNION ALL {NEW_RESULTS}""")(lambda t: I.insert_results(t.matches, raw_results(t), update_existing=True).select(*RESULT_COLS))


# --- validation ----------------------------------------------------------------------------
def spoiled_predictions(t):
    return t.predictions.withColumns({
        "prob_home": F.when(F.col("confidence") > 0.55, F.col("prob_home") + 1).otherwise(F.col("prob_home")),
        "predicted_outcome": F.when(F.col("prob_draw") > 0.3, "X").otherwise(F.col("predicted_outcome"))})


query("P11_validate_rows", """SELECT id, prob_bad, out_bad FROM (SELECT id, CASE WHEN confidence > 0.55::DOUBLE THEN prob_home + 1 ELSE prob_home END > 1 AS prob_bad, prob_draw > 0.3::DOUBLE AS out_bad FROM predictions) WHERE prob_bad OR out_bad""")(
    lambda t: Q.quarantine(Q.validate(spoiled_predictions(t), Q.prediction_rules())).select(
        "id", F.array_contains("violations", "prob_home_range").alias("prob_bad"), F.array_contains("violations", "outcome_domain").alias("out_bad")))
query("P11_good_rows", "SELECT id FROM predictions WHERE NOT (confidence > 0.55::DOUBLE AND prob_home > 0) AND NOT prob_draw > 0.3::DOUBLE")(
    lambda t: Q.good_rows(Q.validate(spoiled_predictions(t), Q.prediction_rules())).select("id"))


def spoiled_matches(t):
    return t.matches.withColumns({
        "odds_draw": F.when(F.col("num_bookmakers") == 3, F.lit(1.0)).otherwise(F.col("odds_draw")),
        "home_score": F.when(F.col("num_bookmakers") == 5, F.col("home_score") + 14).otherwise(F.col("home_score")),
        "away_team_id": F.when(F.col("num_bookmakers") == 7, F.col("home_team_id")).when(F.col("num_bookmakers") == 8, F.lit(-1)).otherwise(F.col("away_team_id"))})


query("P12_dq_rules", f"""SELECT id, violation FROM (WITH s AS (SELECT id, match_date, home_team_id, odds_home, odds_away, away_score,
      CASE WHEN num_bookmakers = 3 THEN 1.0::DOUBLE ELSE odds_draw END AS odds_draw, CASE WHEN num_bookmakers = 5 THEN home_score + 14 ELSE home_score END AS home_score,
      CASE num_bookmakers WHEN 7 THEN home_team_id WHEN 8 THEN -1 ELSE away_team_id END AS away_team_id FROM matches)
    {" UNION ALL ".join(f"SELECT id, '{c}' AS violation FROM s WHERE {w}" for c, w in (
        ("odds_home_range", "odds_home < 1.01::DOUBLE OR odds_home > 100"), ("odds_draw_range", "odds_draw < 1.01::DOUBLE OR odds_draw > 100"),
        ("odds_away_range", "odds_away < 1.01::DOUBLE OR odds_away > 100"),
        ("odds_margin", "1 / odds_home + 1 / odds_draw + 1 / odds_away <= 1 OR 1 / odds_home + 1 / odds_draw + 1 / odds_away >= 1.3::DOUBLE"),
        ("home_score_range", "home_score < 0 OR home_score > 15"), ("away_score_range", "away_score < 0 OR away_score > 15"),
        ("date_in_future", f"match_date > TIMESTAMP '{AS_OF}'"), ("date_too_old", "match_date <= TIMESTAMP '1990-01-01'"), ("same_teams", "home_team_id = away_team_id"),
        ("unknown_team", "home_team_id NOT IN (SELECT id FROM teams) OR away_team_id NOT IN (SELECT id FROM teams)")))})""")(
    lambda t: Q.validate(Q.with_known_teams(spoiled_matches(t), t.teams), Q.match_quality_rules(AS_OF)).select("id", F.explode("violations").alias("violation")))
