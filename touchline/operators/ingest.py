"""Merging scraped rows into the match tables, as set operations over a whole batch.

The row-by-row rules of arrival order are kept by folding each key's rows first: the fold
is a map-side aggregation by sequence number, so a key repeated any number of times costs
one row in the exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.plans.materialize import materialize
from touchline.plans.ordering import BLOCK_ROWS, with_rank
from touchline.schema import ODDS


def _first(value, known: Column | None = None) -> Column:
    """Value of the earliest row, or of the earliest row where ``known`` holds."""
    return F.min_by(value, F.col("seq") if known is None else F.when(known, F.col("seq")))


def get_or_create_dim(dim: DataFrame, wanted: DataFrame, key: str, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The dimension with the wanted rows that were missing; new ids follow the largest in arrival order.

    ``wanted`` has one row per key and the order column ``seq``.
    """
    fresh = wanted.join(dim.select(key), key, "left_anti")
    top = F.coalesce(dim.agg(F.max("id")).scalar(), F.lit(0))
    numbered = with_rank(fresh, ["seq"], out="_rank", block_rows=block_rows)
    added = numbered.withColumn("id", top + 1 + F.col("_rank")).drop("_rank", "seq")
    return dim.unionByName(added.select(*dim.columns))


def team_names(raw: DataFrame) -> DataFrame:
    """Each team name once, with the place where it first appears."""
    names = raw.select(F.inline(F.array(
        F.struct(F.col("home_team").alias("name"), (F.col("seq") * 2).alias("seq")),
        F.struct(F.col("away_team").alias("name"), (F.col("seq") * 2 + 1).alias("seq")))))
    return names.groupBy("name").agg(F.min("seq").alias("seq"))


def tournament_rows(raw: DataFrame) -> DataFrame:
    """Each slug once, with the name and country of its first row."""
    return raw.filter(F.col("tournament_slug").isNotNull() & (F.col("tournament_slug") != "")).groupBy(
        F.col("tournament_slug").alias("url_slug")).agg(
        _first(F.coalesce("tournament_name", F.lit("Unknown"))).alias("name"),
        _first(F.coalesce("country", F.lit("Unknown"))).alias("country"), F.min("seq").alias("seq"))


def resolve(raw: DataFrame, teams: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Replace names and slugs by ids."""
    home = teams.select(F.col("name").alias("home_team"), F.col("id").alias("home_team_id"))
    away = teams.select(F.col("name").alias("away_team"), F.col("id").alias("away_team_id"))
    t = tournaments.select(F.col("url_slug").alias("tournament_slug"), F.col("id").alias("tournament_id"))
    return raw.join(home, "home_team").join(away, "away_team").join(t, "tournament_slug", "left")


def _same(key: list[str]) -> Column:
    """Equal keys, NULL like NULL, where the other side's are prefixed by an underscore."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key])


def _unknown(rows: DataFrame, matches: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(matches.select(*[F.col(c).alias(f"_{c}") for c in key]), _same(key), "left_anti")


def _numbered(matches: DataFrame, added: DataFrame, key: list[str], first_id: int | None, ids: DataFrame | None, block_rows: int) -> DataFrame:
    """New rows with the columns of ``matches``: ids from the table ``ids`` (key, new_id), else in arrival order from ``first_id`` or
    after the largest stored id."""
    if ids is not None:
        named = ids.select(F.col("new_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in key])
        numbered = added.drop("id").join(named, _same(key))
    else:
        top = F.coalesce(matches.agg(F.max("id")).scalar(), F.lit(0)) if first_id is None else F.lit(first_id - 1)
        ranked = with_rank(added.drop("id"), ["seq"], out="_rank", block_rows=block_rows)
        numbered = ranked.withColumn("id", top + 1 + F.col("_rank"))
    return numbered.select(*[
        (F.col(c) if c in numbered.columns else F.lit(None)).cast(matches.schema[c].dataType).alias(c) for c in matches.columns])


def fresh_ids(matches: DataFrame, resolved: DataFrame, key: list[str], first_id: int, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, new_id) of the batch's keys that are not stored yet, in arrival order from ``first_id``."""
    fresh = _unknown(resolved.groupBy(*key).agg(F.min("seq").alias("seq")), matches, key)
    ranked = with_rank(fresh, ["seq"], out="_rank", block_rows=block_rows)
    return ranked.select(*key, (F.col("_rank") + first_id).cast("long").alias("new_id"))


UPCOMING_KEY = ["home_team_id", "away_team_id", "match_date"]
RESULT_KEY = ["tournament_id", *UPCOMING_KEY]


# Arrival numbers that a stored row may carry: of its first row, of the row that priced it, of the one that named its tournament.
SEQS = ["first_seq", "odds_seq", "tournament_seq"]


def fold_upcoming(resolved: DataFrame) -> DataFrame:
    """One row per (home, away, date): last odds that count, first odds, first known tournament, and the ``seq`` of each."""
    priced = F.col("odds_home").isNotNull() & (F.col("odds_home") != 0)
    named = F.col("tournament_id").isNotNull()
    odds = F.struct(*ODDS)
    return resolved.groupBy(*UPCOMING_KEY).agg(
        F.max_by(odds, F.when(priced, F.col("seq"))).alias("last_odds"), F.max(F.when(priced, F.col("seq"))).alias("new_odds_seq"),
        _first(odds).alias("first_odds"), _first(F.col("tournament_id"), named).alias("new_tournament"),
        F.min(F.when(named, F.col("seq"))).alias("new_tournament_seq"), F.min("seq").alias("seq"))


def upsert_upcoming(matches: DataFrame, resolved: DataFrame, *, first_id: int | None = None, ids: DataFrame | None = None,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All matches after the batch: priced rows replace odds, missing tournaments fill in, new keys append.

    The folded batch is written once and joined to the stored rows by key; its keys that no stored row has are found among the keys
    that both have, so stored rows are neither written nor, beside a small batch, moved. Where ``matches`` carries ``SEQS``, rows may come out of order over
    several batches: odds and tournament of a row with a later or earlier ``seq`` then win as they would in one batch, and what was
    stored before any batch (no ``seq``) counts as earliest.
    """
    folded = materialize(fold_upcoming(resolved), "folded")
    known = matches.select(*UPCOMING_KEY).join(folded.select(*UPCOMING_KEY), UPCOMING_KEY, "left_semi").distinct()
    added = folded.join(known, UPCOMING_KEY, "left_anti")
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in matches.schema if f.name not in UPCOMING_KEY]
    stored_rows = matches.withColumn("_stored", F.lit(True)).join(folded, UPCOMING_KEY, "left")
    new_rows = added.select("*", *blank, F.lit(None).cast("boolean").alias("_stored"))
    fresh, seqs = F.col("_stored").isNull(), set(SEQS) <= set(matches.columns)
    stored = {c: F.col(c) if seqs else F.lit(None).cast("long") for c in SEQS}
    priced = F.col("last_odds").isNotNull() & (stored["odds_seq"].isNull() | (stored["odds_seq"] < F.col("new_odds_seq")))
    first = F.col("last_odds").isNull() & stored["odds_seq"].isNull() & (fresh | F.coalesce(stored["first_seq"] > F.col("seq"), F.lit(False)))
    named = F.col("new_tournament").isNotNull() & (
        F.col("tournament_id").isNull() | F.coalesce(stored["tournament_seq"] > F.col("new_tournament_seq"), F.lit(False)))
    changed = {
        **{o: F.when(priced, F.col("last_odds")[o]).when(first, F.col("first_odds")[o]).otherwise(F.col(o)) for o in ODDS},
        "tournament_id": F.when(named, F.col("new_tournament")).otherwise(F.col("tournament_id")),
        "status": F.when(fresh, F.lit("SCHEDULED")).otherwise(F.col("status"))}
    if seqs:
        changed |= {
            "first_seq": F.when(fresh, F.col("seq")).when(stored["first_seq"].isNotNull(), F.least("first_seq", "seq")),
            "odds_seq": F.when(priced, F.col("new_odds_seq")).otherwise(stored["odds_seq"]),
            "tournament_seq": F.when(named, F.col("new_tournament_seq")).otherwise(stored["tournament_seq"])}
    kept = stored_rows.withColumns(changed).select(*matches.columns)
    return kept.unionByName(_numbered(matches, new_rows.withColumns(changed), UPCOMING_KEY, first_id, ids, block_rows))


def insert_results(matches: DataFrame, resolved: DataFrame, *, update_existing: bool = False,
                   first_id: int | None = None, ids: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All matches after the batch: the first row of an unknown key is inserted as finished.

    Existing rows stay as they are, so an earlier scheduled row blocks its result, unless
    ``update_existing`` completes matches that are not finished yet.
    """
    values = ["home_score", "away_score", *ODDS, "num_bookmakers"]
    first = resolved.groupBy(*RESULT_KEY).agg(_first(F.struct(*values)).alias("v"), F.min("seq").alias("seq"))
    fresh = _unknown(first, matches, RESULT_KEY).select(
        *RESULT_KEY, "seq", "v.*", F.lit("FINISHED").alias("status"))
    kept = matches
    if update_existing:
        opened = F.col("v").isNotNull() & (F.col("status") != "FINISHED")
        found = first.select("v", *[F.col(c).alias(f"_{c}") for c in RESULT_KEY])
        kept = matches.join(found, _same(RESULT_KEY), "left").withColumns({
            **{c: F.when(opened, F.coalesce(F.col(f"v.{c}"), F.col(c))).otherwise(F.col(c)) for c in values},
            "status": F.when(opened, "FINISHED").otherwise(F.col("status"))}).select(*matches.columns)
    return kept.unionByName(_numbered(matches, fresh, RESULT_KEY, first_id, ids, block_rows))
