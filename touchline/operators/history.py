"""Team and head-to-head history: rolling form, rest and league context without looking ahead.

Everything runs on the team view, two rows per match. History is finished matches with
both scores; a match sees only matches strictly before its own date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from touchline.functions.match import DAY_US, is_finished, match_result, micros, ntz, points, round2
from touchline.plans.asof import asof_count, asof_trailing, trailing_rows
from touchline.plans.ordering import BLOCK_ROWS, join_on, prefix_sums, spread

WINDOWS = (3, 5, 10)
SIDES = ("home", "away")
# Momentum weights, newest match first.
MOMENTUM_WEIGHTS = [1.0, 0.95, 0.85, 0.7, 0.5]
REST_DEFAULT, REST_CAP, DENSITY_CAP = 7.0, 14, 5


def team_rows(matches: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Two rows per match, one per side, with goals and points from that side."""

    def side(home: bool) -> Column:
        own, other = SIDES if home else reversed(SIDES)
        gf, ga = F.col(f"{own}_score"), F.col(f"{other}_score")
        return F.struct(
            F.lit(home).alias("is_home"), F.col(f"{own}_team_id").alias("team_id"),
            F.col(f"{other}_team_id").alias("other_id"), gf.alias("gf"), ga.alias("ga"),
            points(gf, ga).alias("points"), (gf > ga).cast("int").alias("win"),
            (gf == ga).cast("int").alias("draw"), (gf < ga).cast("int").alias("loss"))

    return matches.select(
        F.col("id").alias("match_id"), "match_date", micros().alias("us"), "tournament_id", "season_id", *keep,
        is_finished().alias("is_hist"), F.inline(F.array(side(True), side(False))))


def _form_frames(windows: Sequence[int], rates: Sequence[str]) -> dict:
    frames = {f"{v}_{n}": (v, n, 1) for n in windows for v in ("points", "gf", "ga", *rates)}
    frames["points_1_3"] = ("points", 3, 1)
    frames["points_4_6"] = ("points", 6, 4)
    return frames


def _mean(struct: str, name: str, n: int) -> Column:
    """Integer sum over the matches that exist, 0 without any."""
    have = F.least(F.col(f"{struct}.seq"), F.lit(n))
    return F.coalesce(F.col(f"{struct}.{name}") / have, F.lit(0.0))


def side_features(matches: DataFrame, windows: Sequence[int] = WINDOWS, *, rates: Sequence[str] = ("win",), asked: str | None = None,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Form, venue form, trend, rest and density per (match, side), or of the matches where the column ``asked`` is true."""
    looked = asof_trailing(
        team_rows(matches, [asked] if asked else []), ["team_id"], _form_frames(windows, rates), sub="is_home",
        sub_frames={f"points_{n}": ("points", n, 1) for n in windows}, asked=asked, block_rows=block_rows)
    seq, n_old = F.coalesce(F.col("last.seq"), F.lit(0)), F.col("last.seq") - 3
    features: dict[str, Column] = {}
    for n in windows:
        features[f"points_last_{n}"] = _mean("last", f"points_{n}", n)
        for rate in rates:
            features[f"{rate}_rate_{n}"] = _mean("last", f"{rate}_{n}", n)
        features[f"goals_for_avg_{n}"] = _mean("last", f"gf_{n}", n)
        features[f"goals_against_avg_{n}"] = _mean("last", f"ga_{n}", n)
        features[f"goal_diff_avg_{n}"] = features[f"goals_for_avg_{n}"] - features[f"goals_against_avg_{n}"]
        features[f"venue_form_{n}"] = _mean("last_sub", f"points_{n}", n)
    features["form_trend"] = F.when(
        seq >= 4, F.col("last.points_1_3") / 3 - F.col("last.points_4_6") / F.least(n_old, F.lit(3))).otherwise(F.lit(0.0))
    rest = F.floor((F.col("us") - F.col("last.us")) / DAY_US)
    features["rest_days"] = F.coalesce(F.least(rest, F.lit(REST_CAP)).cast("double"), F.lit(REST_DEFAULT))
    features["matches_last_14_days"] = F.least(seq, F.lit(DENSITY_CAP)).cast("long")
    return looked.select("match_id", "is_home", *[c.alias(n) for n, c in features.items()])


def by_match(sides: DataFrame, columns: Sequence[str], n: int | None = None) -> DataFrame:
    """One row per match: each side column as home_ and away_ column.

    Side columns travel as one struct and the away struct is picked up behind the home one: a
    single exchange of the side rows, where a conditional aggregate would carry every column twice. With their number ``n`` the
    exchange has as many partitions as they need.
    """
    pair = Window.partitionBy("match_id").orderBy(F.col("is_home").desc())
    packed = sides.select("match_id", "is_home", F.struct(*columns).alias("home"))
    packed = packed if n is None else spread(packed, n, "match_id")
    rows = packed.withColumn("away", F.lead("home").over(pair)).filter("is_home")
    return rows.select("match_id", *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in SIDES for c in columns])


def form_columns(windows: Sequence[int] = WINDOWS, rates: Sequence[str] = ("win",)) -> list[str]:
    names = [f"{s}_{f}_{n}" for n in windows for s in SIDES
             for f in ("points_last", *[f"{r}_rate" for r in rates], "goals_for_avg", "goals_against_avg", "goal_diff_avg")]
    names += [f"{s}_{s}_form_{n}" for n in windows for s in SIDES]
    return [*names, "home_form_trend", "away_form_trend", "form_diff"]


def team_features(matches: DataFrame, windows: Sequence[int] = WINDOWS, *, rates: Sequence[str] = ("win",), asked: str | None = None,
                  block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Form, rest and density features of both sides, one row per match (where the column ``asked`` is true)."""
    sides = side_features(matches, windows, rates=rates, asked=asked, block_rows=block_rows)
    given = matches.filter(asked) if asked else matches
    wide = by_match(sides, [c for c in sides.columns if c not in ("match_id", "is_home")], 2 * given.count())
    for n in windows:
        for s in SIDES:
            wide = wide.withColumnRenamed(f"{s}_venue_form_{n}", f"{s}_{s}_form_{n}")
    diff = (F.col("home_points_last_5") - F.col("away_points_last_5")) if 5 in windows else F.lit(0.0)
    return wide.withColumns({
        "form_diff": diff, "rest_days_diff": F.col("home_rest_days") - F.col("away_rest_days")})


def team_form(matches: DataFrame, windows: Sequence[int] = WINDOWS, *, rates: Sequence[str] = ("win",),
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The form features alone; pass rates=("win", "draw", "loss") for all three rates."""
    return team_features(matches, windows, rates=rates, block_rows=block_rows).select(
        "match_id", *form_columns(windows, rates))


def basic_features(matches: DataFrame, n: int = 5, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The six fallback features: points, goals scored and conceded of both sides."""
    wide = team_features(matches, (n,), block_rows=block_rows)
    return wide.select("match_id", *[
        F.col(f"{s}_{f}_{n}").alias(f"{s}_{a}")
        for f, a in (("points_last", "form"), ("goals_for_avg", "goals_scored"), ("goals_against_avg", "goals_conceded"))
        for s in SIDES])


def team_history_asof(matches: DataFrame, limit: int = 10, venue: str = "all", *,
                      block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each side of each match, its last ``limit`` earlier matches, newest first (rn = 1)."""
    rows = team_rows(matches)
    if venue != "all":
        rows = rows.withColumn("is_hist", F.col("is_hist") & (F.col("is_home") == (venue == "home")))
    looked = asof_trailing(rows.withColumn("entry", F.struct("match_id", "gf", "ga", "points")), ["team_id"], {},
                           lists={"entries": ("entry", limit)}, block_rows=block_rows)
    return (
        looked.select("match_id", "is_home", "team_id", F.posexplode(F.reverse("last.entries")).alias("pos", "e"))
        .select("match_id", "is_home", "team_id", (F.col("pos") + 1).alias("rn"),
                F.col("e.match_id").alias("hist_id"), "e.gf", "e.ga", "e.points"))


def pair_rows(matches: DataFrame) -> DataFrame:
    """Matches keyed by the unordered pair of teams, values oriented to the lower team id."""
    home_low = F.col("home_team_id") < F.col("away_team_id")
    low = F.when(home_low, F.col("home_score")).otherwise(F.col("away_score"))
    high = F.when(home_low, F.col("away_score")).otherwise(F.col("home_score"))
    return matches.withColumnRenamed("id", "match_id").withColumns({
        "us": micros(), "is_hist": is_finished(), "home_low": home_low,
        "low_team": F.least("home_team_id", "away_team_id"), "high_team": F.greatest("home_team_id", "away_team_id"),
        "low_goals": low, "high_goals": high, "low_win": (low > high).cast("int"), "high_win": (high > low).cast("int"),
        "low_points": points(low, high), "high_points": points(high, low)})


H2H_COLUMNS = ["h2h_matches_count", "h2h_home_wins", "h2h_draws", "h2h_away_wins", "h2h_home_win_rate",
               "h2h_avg_total_goals", "h2h_home_avg_goals", "h2h_away_avg_goals", "h2h_recent_home_form"]


YEAR_US = 365 * DAY_US


def with_h2h(matches: DataFrame, meetings: int = 5, *, max_years_back: int | None = None, asked: str | None = None,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the head-to-head features of the last ``meetings`` earlier meetings; keeps the match columns.

    With a column ``asked`` only matches where it is true are given back.
    ``max_years_back`` (off by default) leaves out meetings more than that many years of 365 days before.
    """
    rows = pair_rows(matches)
    if max_years_back is None:
        values = ["low_goals", "high_goals", "low_win", "high_win"]
        frames = {v: (v, meetings, 1) for v in values}
        frames |= {v: (v, min(3, meetings), 1) for v in ("low_points", "high_points")}
        looked = asof_trailing(rows, ["low_team", "high_team"], frames, asked=asked, block_rows=block_rows)
        looked = looked.withColumn("n", F.least(F.coalesce(F.col("last.seq"), F.lit(0)), F.lit(meetings)))
    else:
        looked = _recent_meetings(rows, meetings, max_years_back, asked, block_rows)

    def of(side_low: Column, kind: str) -> Column:
        return F.coalesce(F.when(side_low, F.col(f"last.low_{kind}")).otherwise(F.col(f"last.high_{kind}")), F.lit(0))

    n, home_low = F.col("n"), F.col("home_low")
    home = {k: of(home_low, k) for k in ("win", "goals", "points")}
    away = {k: of(~home_low, k) for k in ("win", "goals")}

    def mean(total: Column, count: Column = n) -> Column:
        return F.when(n > 0, total / count).otherwise(F.lit(0.0))

    exprs = [n, home["win"], n - home["win"] - away["win"], away["win"], mean(home["win"]),
             mean(home["goals"] + away["goals"]), mean(home["goals"]), mean(away["goals"]),
             mean(home["points"], F.least(n, F.lit(3)))]
    counts = set(H2H_COLUMNS[:4])
    added = [(e.cast("long") if c in counts else e).alias(c) for c, e in zip(H2H_COLUMNS, exprs)]
    return looked.select("match_id", *[c for c in matches.columns if c != "id"], *added)


def _recent_meetings(rows: DataFrame, meetings: int, years: int, asked: str | None, block_rows: int) -> DataFrame:
    """The last meetings as a short list per match, those too old removed, summed up again."""
    values = ["low_goals", "high_goals", "low_win", "high_win", "low_points", "high_points"]
    looked = asof_trailing(rows.withColumn("entry", F.struct("us", *values)), ["low_team", "high_team"], {},
                           lists={"entries": ("entry", meetings)}, asked=asked, block_rows=block_rows)
    oldest = F.col("us") - years * YEAR_US
    looked = looked.withColumn("_near", F.filter("last.entries", lambda e: e["us"] >= oldest))
    newest = F.slice(F.reverse("_near"), 1, 3)

    def total(entries: Column, v: str) -> Column:
        return F.aggregate(entries, F.lit(0), lambda acc, e: acc + e[v])

    return looked.withColumn("n", F.coalesce(F.array_size("_near"), F.lit(0))).withColumn(
        "last", F.struct(*[total(newest if v.endswith("points") else F.col("_near"), v).alias(v) for v in values]))


def h2h_stats(matches: DataFrame, meetings: int = 5, *, max_years_back: int | None = None,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    return with_h2h(matches, meetings, max_years_back=max_years_back, block_rows=block_rows).select("match_id", *H2H_COLUMNS)


def h2h_asof(matches: DataFrame, limit: int = 5, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each match, the last ``limit`` earlier meetings of its teams, newest first, with their result."""
    rows = pair_rows(matches).withColumn("entry", F.struct(
        "match_id", "match_date", "home_team_id", "away_team_id", "home_score", "away_score"))
    looked = asof_trailing(rows, ["low_team", "high_team"], {}, lists={"entries": ("entry", limit)}, block_rows=block_rows)
    return (
        looked.select("match_id", F.posexplode(F.reverse("last.entries")).alias("pos", "e"))
        .select("match_id", (F.col("pos") + 1).alias("rn"), F.col("e.match_id").alias("hist_id"),
                F.col("e.match_date").alias("hist_date"), "e.home_team_id", "e.away_team_id",
                "e.home_score", "e.away_score")
        .withColumn("result", match_result()))


def match_count_before(matches: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Finished matches of each side before the match; only the home score must be known."""
    counts = (F.col("status") == "FINISHED") & F.col("home_score").isNotNull()
    scored = matches.withColumn("away_score", F.when(counts, F.coalesce("away_score", F.lit(0))).otherwise(F.col("away_score")))
    rows = team_rows(scored)
    return asof_count(rows, ["team_id"], block_rows=block_rows).select("match_id", "is_home", "team_id", "count_before")


def fixture_density(matches: DataFrame, window_days: int = 14, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Finished matches of each side within the days before the match (a true time window)."""
    rows = team_rows(matches).select("match_id", "is_home", "team_id", "us", "is_hist")
    points_in_time = rows.withColumn("start", F.lit(False)).unionByName(
        rows.select("match_id", "is_home", "team_id", (F.col("us") - window_days * DAY_US).alias("us"),
                    F.lit(False).alias("is_hist"), F.lit(True).alias("start")))
    counted = asof_count(points_in_time, ["team_id"], block_rows=block_rows)
    return counted.groupBy("match_id", "is_home").agg(
        F.sum(F.when(F.col("start"), -F.col("count_before")).otherwise(F.col("count_before"))).alias("matches_in_window"))


def density_by_match(matches: DataFrame, window_days: int = 14, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Finished matches of both sides within the days before the match (a true time window), a row for each row of ``matches``.

    A side's number is a difference of two counts, before the match and before the window. A team or date that is not known has
    no matches; rows that repeat are given back as often as they came, each with the number of one.
    """
    known = F.col("is_hist") & F.col("team_id").isNotNull() & F.col("us").isNotNull()
    at = [F.struct(F.col("us").alias("us"), known.alias("is_hist"), F.lit(False).alias("start")),
          F.struct((F.col("us") - window_days * DAY_US).alias("us"), F.lit(False).alias("is_hist"), F.lit(True).alias("start"))]
    sides = team_rows(matches).select("match_id", "is_home", "team_id", "other_id", F.col("us").alias("played"), F.inline(F.array(*at)))
    counted = asof_count(sides, ["team_id"], block_rows=block_rows)
    own, other = F.col("team_id"), F.col("other_id")
    home, start = F.col("is_home"), F.col("start")
    keys = ["match_id", "played", F.when(home, own).otherwise(other).alias("home_id"), F.when(home, other).otherwise(own).alias("away_id")]

    def in_window(side: Column) -> Column:
        return F.max(F.when(side & ~start, F.col("count_before"))) - F.max(F.when(side & start, F.col("count_before")))

    names = [f"{s}_matches_last_{window_days}_days" for s in SIDES]
    found = counted.groupBy(*keys).agg(*[in_window(c).alias(n) for c, n in zip((home, ~home), names)], F.count_if(home & ~start).alias("copies"))
    return found.select("match_id", *names, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def rolling_form(matches: DataFrame, n: int = 5, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Averages over the ``n`` rows before, in (date, id) order of the team's finished matches."""
    names = {"avg_points": "points", "avg_goals_for": "gf", "avg_goals_against": "ga"}
    looked = trailing_rows(team_rows(matches.filter(is_finished())), ["team_id"],
                           {a: (v, n, 1) for a, v in names.items()}, block_rows=block_rows)
    return looked.select("match_id", "team_id", "is_home", *[
        (F.col(a) / F.col(f"{a}_n")).alias(f"{a}_last_{n}") for a in names])


def weighted_momentum(matches: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Points of the last five matches weighted by recency; missing matches count nothing."""
    frames = {f"p{i}": ("points", i, i) for i in range(1, len(MOMENTUM_WEIGHTS) + 1)}
    looked = asof_trailing(team_rows(matches), ["team_id"], frames, block_rows=block_rows)
    total = sum((F.coalesce(F.col(f"last.p{i}"), F.lit(0)) * F.lit(w) for i, w in enumerate(MOMENTUM_WEIGHTS, 1)), F.lit(0.0))
    return looked.select("match_id", "is_home", total.alias("momentum"))


def last_matches(matches: DataFrame, reference_date, n: int, venue: str = "all") -> DataFrame:
    """Each team's last ``n`` finished matches before a date. The limit applies before the exchange too."""
    rows = team_rows(matches.filter(is_finished() & (F.col("match_date") < ntz(reference_date))))
    if venue != "all":
        rows = rows.filter(F.col("is_home") == (venue == "home"))
    newest = Window.partitionBy("team_id").orderBy(F.col("us").desc(), F.col("match_id").desc())
    return rows.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= n)


def form_breakdown(matches: DataFrame, teams: DataFrame, reference_date, n: int = 5) -> DataFrame:
    """Points, rates and goals per team over its last ``n`` matches; zeros without history."""
    names = {"points": "avg_points", "win": "win_rate", "draw": "draw_rate", "loss": "loss_rate",
             "gf": "avg_goals_for", "ga": "avg_goals_against"}
    stats = last_matches(matches, reference_date, n).groupBy("team_id").agg(*[
        (F.sum(v) / F.count("*")).alias(a) for v, a in names.items()])
    return teams.select(F.col("id").alias("team_id")).join(stats, "team_id", "left").na.fill(0.0, list(names.values()))


def form_breakdown_api(matches: DataFrame, teams: DataFrame, reference_date, n: int = 5) -> DataFrame:
    """The variant that derives all rates from the average points; the loss rate may be negative."""
    p = F.col("avg_points")
    win = F.when(p >= 1, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (p - 1) / 2))).otherwise(F.lit(0.0))
    draw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 - 2 * F.col("win_rate")))
    base = form_breakdown(matches, teams, reference_date, n)
    return (
        base.withColumn("win_rate", win).withColumn("draw_rate", draw)
        .withColumn("loss_rate", 1.0 - F.col("win_rate") - F.col("draw_rate"))
        .select("team_id", *[round2(c).alias(c) for c in base.columns if c != "team_id"]))


def team_matches(matches: DataFrame, limit: int = 20, venue: str = "all") -> DataFrame:
    """Newest finished matches per team, by venue."""
    return last_matches(matches, "9999-12-31 00:00:00", limit, venue).select("team_id", "rn", "match_id")


def match_preview(matches: DataFrame, teams: DataFrame, tournaments: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Match with names and both teams' average points over five matches."""
    from touchline.operators.joins import match_names

    form = team_features(matches, (5,), block_rows=block_rows).select(
        F.col("match_id").alias("id"), round2("home_points_last_5").alias("home_avg_points"),
        round2("away_points_last_5").alias("away_avg_points"))
    t = tournaments.select(F.col("id").alias("tournament_id"), F.col("name").alias("tournament"))
    return match_names(matches, teams).join(t, "tournament_id", "left").join(form, "id").select(
        "id", "home_team", "away_team", "match_date", "tournament", "home_avg_points", "away_avg_points")


def league_table(matches: DataFrame) -> DataFrame:
    """Standings per tournament and season."""
    totals = (
        team_rows(matches.filter(is_finished()))
        .groupBy("tournament_id", "season_id", "team_id")
        .agg(F.sum("points").alias("points"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"))
        .withColumn("goal_diff", F.col("goals_for") - F.col("goals_against")))
    place = Window.partitionBy("tournament_id", "season_id").orderBy(F.desc("points"), F.desc("goal_diff"))
    return totals.withColumn("position", F.rank().over(place))


def team_record(matches: DataFrame) -> DataFrame:
    """Played, won, drawn, lost and goals per team."""
    return team_rows(matches.filter(is_finished())).groupBy("team_id").agg(
        F.count("*").alias("played"), F.sum("win").alias("wins"), F.sum("draw").alias("draws"),
        F.sum("loss").alias("losses"), F.sum("gf").alias("goals_for"), F.sum("ga").alias("goals_against"))


def tournament_context(matches: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Season progress and stage, league points and position of both sides before the match day.

    A team's standing changes on days it has played; such a change takes its old standing out and puts its new one in. The
    position is one more than the number of teams then above, a sum of such changes over earlier days and higher standings,
    counted by :func:`counts_above`. No table of days by teams is made; ``season_id`` may be NULL and a season of any size.
    """
    day = F.to_date("match_date")
    rows = team_rows(matches).withColumn("day", day)
    season = F.coalesce(F.col("season_id").cast("string"), F.lit("")).alias("season")  # NULL is a season too
    daily = rows.groupBy(season, "team_id", "day").agg(
        F.sum(F.when(F.col("is_hist"), F.col("points"))).alias("p"), F.sum(F.when(F.col("is_hist"), F.col("gf") - F.col("ga"))).alias("gd"))
    upto = Window.partitionBy("season", "team_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    # Standings before and after each of a team's days, which are as many as it has matches at most.
    daily = daily.select("season", "team_id", "day", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"{c}_after") for c in ("p", "gd")],
                         F.coalesce("p", F.lit(0)).alias("p_day"), F.coalesce("gd", F.lit(0)).alias("gd_day"))
    daily = daily.withColumns({c: F.col(f"{c}_after") - F.col(f"{c}_day") for c in ("p", "gd")})
    changes = daily.where("p_day <> 0 OR gd_day <> 0").select("season", "day", F.inline(F.array(
        F.struct(F.col("p"), F.col("gd"), F.lit(-1).alias("weight")), F.struct(F.col("p_after").alias("p"), F.col("gd_after").alias("gd"), F.lit(1).alias("weight")))))
    first = daily.select("season", "team_id").distinct().groupBy("season").agg(F.count("*").cast("int").alias("weight")).select(
        "season", F.lit(None).cast("date").alias("day"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("gd"), "weight")
    placed = counts_above(daily.select("season", "team_id", "day", "p", "gd"), changes.unionByName(first), block_rows=block_rows)
    standing = placed.select("season", "team_id", "day", F.col("p").alias("points_total"), (F.col("above") + 1).cast("int").alias("league_position"))
    sides = rows.select("match_id", "is_home", season, "team_id", "day").join(standing, ["season", "team_id", "day"])
    wide = by_match(sides, ["league_position", "points_total"])

    season_days = matches.groupBy(season, day.alias("day")).agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("season").orderBy("day")
    progress = season_days.select(
        "season", "day",
        (F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
         / F.sum("n").over(Window.partitionBy("season"))).alias("season_progress"))
    stage = F.when(F.col("season_progress") < 0.2, "early").when(F.col("season_progress") <= 0.75, "mid").otherwise("late")
    return (
        matches.select(F.col("id").alias("match_id"), season, day.alias("day")).join(progress, ["season", "day"])
        .join(wide, "match_id")
        .select("match_id", "season_progress", stage.alias("season_stage"),
                "home_league_position", "away_league_position",
                (F.col("home_league_position") - F.col("away_league_position")).alias("position_diff"),
                "home_points_total", "away_points_total",
                (F.col("home_points_total") - F.col("away_points_total")).alias("points_diff")))


def counts_above(asked: DataFrame, changes: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``asked`` (season, team_id, day, p, gd) with ``above``: the weight of changes on earlier days at a higher (p, gd).

    Offline dominance counting by divide and conquer over time. Days are numbered in binary; two days part at one bit, where the
    earlier has 0 and the later 1. So at each bit the changes with 0 and the rows asked with 1 that agree in all higher bits form a
    group, and a running sum down the standings of the group gives each row its share of the count. A row takes part in half of the
    bits on average, and a group of any size is summed in blocks. Changes without a day come before all days.
    """
    first = asked.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    bits = max(1, ((first["b"] - first["a"]).days + 1).bit_length()) if first["a"] else 1
    number = F.coalesce(F.datediff("day", F.lit(first["a"])) + 1, F.lit(0))

    def parted(df: DataFrame, bit: int) -> DataFrame:
        has = [F.when(F.shiftright("t", i).bitwiseAND(F.lit(1)) == bit, F.struct(F.lit(i).alias("bit"), F.shiftright("t", i + 1).alias("node"))) for i in range(bits)]
        return df.select("*", F.inline(F.array_compact(F.array(*has))))

    folded = changes.withColumn("t", number).groupBy("season", "t", "p", "gd").agg(F.sum("weight").alias("weight")).where("weight <> 0")
    here = parted(folded, 0).groupBy("season", "bit", "node", "p", "gd").agg(F.sum("weight").cast("double").alias("weight"))
    rows = parted(asked.withColumn("t", number), 1)
    # Of equal standings the rows asked come first: they count what is strictly above them.
    both = rows.select("season", "bit", "node", (-F.col("p")).alias("low_p"), (-F.col("gd")).alias("low_gd"), F.lit(0).alias("kind"), "team_id", "t", F.lit(0.0).alias("weight")).unionByName(
        here.select("season", "bit", "node", (-F.col("p")).alias("low_p"), (-F.col("gd")).alias("low_gd"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("team_id"), F.lit(0).alias("t"), "weight"))
    summed = prefix_sums(both, ["season", "bit", "node"], ["low_p", "low_gd", "kind", "team_id", "t"], "weight", out="above", block_rows=block_rows)
    total = summed.where("kind = 0").groupBy("season", "team_id", "t").agg(F.sum("above").cast("long").alias("above"))
    return asked.withColumn("t", number).join(total, ["season", "team_id", "t"]).drop("t")


def training_rows(matches: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Finished matches with odds: result, raw implied probabilities, calendar and days since the last home match."""
    rows = matches.filter(is_finished() & F.col("odds_home").isNotNull()).withColumn("us", micros())
    looked = trailing_rows(rows.withColumn("t", F.col("us")), ["home_team_id"], {"previous": ("t", 1, 1)}, id="id", block_rows=block_rows)
    return looked.select(
        F.col("id").alias("match_id"), "match_date", "tournament_id", "season_id", "home_team_id", "away_team_id",
        "home_score", "away_score", "odds_home", "odds_draw", "odds_away", match_result().alias("result"),
        (1 / F.col("odds_home")).alias("implied_prob_home"), (1 / F.col("odds_draw")).alias("implied_prob_draw"),
        (1 / F.col("odds_away")).alias("implied_prob_away"),
        (F.dayofweek("match_date") - 1).alias("day_of_week"), F.month("match_date").alias("month"),
        ((F.col("us") - F.col("previous")) / DAY_US).alias("home_rest_days"))
