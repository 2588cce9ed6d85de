"""Stored result, fixture and listing pages to rows.

A page is cut at its marked elements in document order; one fold over the pieces carries
the headers seen so far into each game row. It is all column expressions on the page's own
row, so parsing needs no exchange and copies of a page do not meet anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.match import ntz, parse_match_ts

# Element marks, patterns and defaults of the pages.
DATE_HEADER, GAME_ROW, TIME_ITEM = "date-header", "game-row", "time-item"
LEAGUE_ITEM, UPCOMING_HEADER = "sport-country-league-item", "secondary-header"
COUNTRY_LINK, TOURNAMENT_LINK = "header-country-item", "header-tournament-item"
RESULT_DATE = r"\d{1,2} [A-Za-z]+ \d{4}"
UPCOMING_DATE = r"(\d{1,2}\s+[A-Za-z]+)|(Today)|(Tomorrow)"
SCORE = r"(\d+)\s*[–-]\s*(\d+)"
ODD = r"(\d+\.\d+)"
SEASON_NAME = r"\d{4}/\d{4}"
SEASON_SUFFIX = r"-(\d{4}-\d{4})"
DEFAULT_TIME, DEFAULT_TOURNAMENT, DEFAULT_COUNTRY = "00:00", "Unknown Tournament", "World"
MAX_BOOKMAKERS = 100
PAGE_END = r"(?s)(</main>|</section>|<nav|<footer|</body>).*$"


def _text(html: Column) -> Column:
    """Visible text with single spaces."""
    plain = F.regexp_replace(html, r"<[^>]*>", " ")
    plain = F.replace(F.replace(plain, F.lit("&amp;"), F.lit("&")), F.lit("&nbsp;"), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _inner(html: Column, mark: str) -> Column:
    """Text of the element that carries the mark; NULL if there is none."""
    pattern = rf'data-testid="{mark}"[^>]*>([^<]*)<'
    return F.when(html.rlike(pattern), F.trim(F.regexp_extract(html, pattern, 1)))


def _mark(piece: Column) -> Column:
    return F.regexp_extract(piece, r'^<div[^>]*data-testid="([^"]+)"', 1)


def carry_forward(html: Column, marks: list[str], headers: dict[str, Callable[[Column], Column]]) -> Column:
    """Game rows of a page in order, each with the last value seen of every header.

    A header function gives its value for a piece, or NULL where the piece does not set it.
    """
    cut = rf'(?=<div[^>]*data-testid="(?:{"|".join(marks)})")'
    row_type = "array<struct<piece:string," + ",".join(f"{n}:string" for n in headers) + ">>"
    start = F.struct(F.array().cast(row_type).alias("rows"), *[F.lit(None).cast("string").alias(n) for n in headers])

    def step(seen: Column, raw: Column) -> Column:
        piece = F.regexp_replace(raw, PAGE_END, "")
        row = F.struct(piece.alias("piece"), *[seen[n].alias(n) for n in headers])
        rows = F.when(_mark(piece) == GAME_ROW, F.concat(seen["rows"], F.array(row))).otherwise(seen["rows"])
        return F.struct(rows.alias("rows"), *[F.coalesce(value(piece), seen[n]).alias(n) for n, value in headers.items()])

    return F.aggregate(F.split(html, cut), start, step)["rows"]


def _rows(pages: DataFrame, marks: list[str], headers: dict[str, Callable[[Column], Column]]) -> DataFrame:
    kept = [c for c in pages.columns if c != "html"]
    rows = pages.select(*kept, F.posexplode(carry_forward(F.col("html"), marks, headers)).alias("pos", "r"))
    return rows.select(*kept, "pos", "r.*")


def _games(rows: DataFrame) -> DataFrame:
    """Add what a game row shows; text, titles and numbers are extracted once each."""
    rows = rows.withColumns({
        "text": _text(F.col("piece")),
        "titles": F.regexp_extract_all("piece", F.lit(r'<a[^>]*\stitle="([^"]*)"'), F.lit(1)),
        "time": F.coalesce(_inner(F.col("piece"), TIME_ITEM), F.lit(DEFAULT_TIME)),
    }).filter(F.size("titles") >= 2)
    rows = rows.withColumns({
        "odds": F.regexp_extract_all("text", F.lit(ODD), F.lit(1)),
        "score": F.regexp_extract("text", SCORE, 0),
        "last": F.regexp_extract(F.try_element_at(F.split("text", " "), F.lit(-1)), r"^([+-]?\d+)", 1),
    })
    count = F.when(F.size("odds") >= 3, F.col("last").try_cast("int"))
    return rows.withColumns({
        "home_team": F.get("titles", 0), "away_team": F.get("titles", 1),
        "home_score": F.regexp_extract("score", SCORE, 1).try_cast("int"),
        "away_score": F.regexp_extract("score", SCORE, 2).try_cast("int"),
        "odds_home": F.get("odds", 0).cast("double"), "odds_draw": F.get("odds", 1).cast("double"),
        "odds_away": F.get("odds", 2).cast("double"), "num_bookmakers": F.when(count != 0, count)})


def pages_to_results(pages: DataFrame, *, as_of=None) -> DataFrame:
    """Result rows of stored pages; rows without two teams or a score are no results.

    A row whose date is missing or unreadable gets ``as_of`` (NULL if not given).
    """
    def date(piece: Column) -> Column:
        text = _text(piece)
        return F.when((_mark(piece) == DATE_HEADER) & text.rlike(RESULT_DATE), text)

    rows = _games(_rows(pages, [DATE_HEADER, GAME_ROW], {"date": date})).filter(F.col("home_score").isNotNull())
    books = F.col("num_bookmakers")
    return rows.select(
        *[c for c in pages.columns if c != "html"], "pos",
        parse_match_ts(F.col("date"), F.col("time"), ntz(as_of) if as_of is not None else None).alias("match_date"),
        "home_team", "away_team", "home_score", "away_score", "odds_home", "odds_draw", "odds_away",
        F.when(books < MAX_BOOKMAKERS, books).alias("num_bookmakers"))


def _slug(piece: Column) -> Column:
    link = F.regexp_extract(piece, rf'<a[^>]*data-testid="{TOURNAMENT_LINK}"[^>]*>', 0)
    parts = F.filter(F.split(F.regexp_extract(link, r'href="([^"]*)"', 1), "/"), lambda x: x != "")
    return F.try_element_at(parts, F.lit(-1))


def pages_to_upcoming(pages: DataFrame, *, as_of) -> DataFrame:
    """Fixture rows with the tournament and date headers above them; no score needed."""
    def league(value: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda piece: F.when(_mark(piece) == LEAGUE_ITEM, value(piece))

    def date(piece: Column) -> Column:
        text = _text(piece)
        day = F.trim(F.replace(F.replace(text, F.lit("Today, "), F.lit("")), F.lit("Tomorrow, "), F.lit("")))
        return F.when((_mark(piece) == UPCOMING_HEADER) & text.rlike(UPCOMING_DATE), day)

    rows = _rows(pages, [LEAGUE_ITEM, UPCOMING_HEADER, GAME_ROW], {
        "country": league(lambda p: _inner(p, COUNTRY_LINK)), "tournament": league(lambda p: _inner(p, TOURNAMENT_LINK)),
        "slug": league(_slug), "date": date})
    rows = _games(rows)
    now = ntz(as_of)
    year = F.year(now).cast("string")
    full = F.when(F.contains("date", year), F.col("date")).otherwise(F.concat_ws(" ", "date", year))
    stamp = F.concat_ws(" ", full, "time")
    return rows.select(
        *[c for c in pages.columns if c != "html"], "pos",
        F.coalesce(F.nullif("tournament", F.lit("")), F.lit(DEFAULT_TOURNAMENT)).alias("tournament_name"),
        F.initcap(F.coalesce(F.nullif("country", F.lit("")), F.lit(DEFAULT_COUNTRY))).alias("country"),
        F.col("slug").alias("tournament_slug"),
        F.coalesce(F.when(F.col("date").isNotNull(), F.try_to_timestamp(stamp, F.lit("d MMM yyyy H:mm")).cast("timestamp_ntz")), now).alias("match_date"),
        "home_team", "away_team", "odds_home", "odds_draw", "odds_away", "num_bookmakers")


def _links(pages: DataFrame) -> DataFrame:
    kept = [c for c in pages.columns if c != "html"]
    link = F.explode(F.regexp_extract_all("html", F.lit(r"(<a\s[^>]*>[^<]*</a>)"), F.lit(1)))
    return pages.select(*kept, link.alias("link")).withColumns({
        "href": F.regexp_extract("link", r'href="([^"]*)"', 1), "text": _text(F.col("link"))})


def season_links(pages: DataFrame) -> DataFrame:
    """Season name, address suffix and whether it is the current season."""
    kept = [c for c in pages.columns if c != "html"]
    suffix = F.regexp_extract("href", SEASON_SUFFIX, 1)
    return _links(pages).filter(F.col("text").rlike(SEASON_NAME)).select(
        *kept, F.col("text").alias("name"), F.nullif(suffix, F.lit("")).alias("url_suffix"),
        (~F.contains("href", F.lit("-20")) & ~F.contains("href", F.lit("-19"))).alias("is_current"))


def page_count(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Highest number among the pagination links, at least 1, per listing."""
    numbers = _links(pages).filter(F.contains("link", F.lit("pagination")) & F.col("text").rlike(r"^\d+$"))
    top = numbers.groupBy(key).agg(F.max(F.col("text").cast("int")).alias("top"))
    return pages.select(key).distinct().join(top, key, "left").select(
        key, F.greatest(F.lit(1), F.coalesce("top", F.lit(1))).alias("page_count"))
