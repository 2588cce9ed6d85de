"""Column expressions about matches: results, labels, dates and page text."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from touchline.schema import OUTCOMES

DAY_US = 86_400_000_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ntz(value: datetime | str | Column) -> Column:
    """A zone-less timestamp literal."""
    if isinstance(value, Column):
        return value
    text = value if isinstance(value, str) else value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def micros(ts: Column | str = "match_date") -> Column:
    """Microseconds since the epoch; the session zone is UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))


def is_finished() -> Column:
    """History rows: finished with both scores known."""
    return (F.col("status") == "FINISHED") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull()


def match_result(require_finished: bool = False) -> Column:
    """H, D or A; NULL without both scores (and, on request, unless the match is finished)."""
    h, a = F.col("home_score"), F.col("away_score")
    known = h.isNotNull() & a.isNotNull()
    if require_finished:
        known = known & (F.col("status") == "FINISHED")
    return F.when(known, F.when(h > a, "H").when(h < a, "A").otherwise("D"))


def encode_target(label: Column | str, unknown: int | None = None) -> Column:
    """H, D, A to 0, 1, 2. Unknown labels give NULL, or ``unknown`` (1 in array form)."""
    c = col(label)
    coded = F.when(c == "H", 0).when(c == "D", 1).when(c == "A", 2)
    return coded if unknown is None else F.coalesce(coded, F.lit(unknown))


def decode_target(code: Column | str) -> Column:
    c = col(code)
    return F.when(c == 0, OUTCOMES[0]).when(c == 1, OUTCOMES[1]).when(c == 2, OUTCOMES[2])


def points(gf: Column | str, ga: Column | str) -> Column:
    gf, ga = col(gf), col(ga)
    return F.when(gf > ga, 3).when(gf == ga, 1).otherwise(0)


def calendar(ts: Column | str = "match_date") -> dict[str, Column]:
    """Monday-based weekday, month, weekend flag and whole days since the last 1 August."""
    ts = col(ts)
    start_year = F.year(ts) - F.when(F.month(ts) < 8, 1).otherwise(0)
    return {
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "days_from_season_start": F.datediff(ts.cast("date"), F.make_date(start_year, F.lit(8), F.lit(1))),
    }


def season_sort_key(season: Column | str) -> Column:
    return F.split(col(season).cast("string"), "/")[0].cast("int")


# The results-page address and the date formats of the pages.
LEAGUE_URL = r"/football/([^/]+)/([^/]+?)(?:-\d{4}-\d{4})?/results/"
PAGE_TIME_FORMATS = ["d MMM yyyy H:mm", "d MMM yyyy"]


def parse_league_url(url: Column | str) -> dict[str, Column]:
    """Country, slug and league name of a results address; all NULL where it does not match."""
    url = col(url)
    ok = url.rlike(LEAGUE_URL)

    def title(text: Column) -> Column:
        return F.initcap(F.replace(text, F.lit("-"), F.lit(" ")))

    country, slug = F.regexp_extract(url, LEAGUE_URL, 1), F.regexp_extract(url, LEAGUE_URL, 2)
    return {
        "country": F.when(ok, title(country)),
        "slug": F.when(ok, slug),
        "league_name": F.when(ok, title(slug)),
    }


def season_url(base_url: Column | str, suffix: Column | str, is_current: Column | str) -> Column:
    """Put the season suffix behind the league slug; current seasons keep the base address."""
    base_url, suffix, is_current = col(base_url), col(suffix), col(is_current)
    put = F.regexp_replace(base_url, F.lit(r"/([^/]+)/results/"), F.concat(F.lit("/$1-"), suffix, F.lit("/results/")))
    return F.when(is_current | suffix.isNull(), base_url).otherwise(put)


def parse_match_ts(date: Column, time: Column, default: Column | None = None) -> Column:
    """Date and time as on the page; the date alone if the time is unreadable; else ``default``."""
    stamp = F.regexp_replace(F.concat_ws(" ", F.trim(date), F.trim(time)), r"\s+", " ")
    day = F.regexp_replace(F.trim(date), r"\s+", " ")
    found = F.coalesce(
        F.try_to_timestamp(stamp, F.lit(PAGE_TIME_FORMATS[0])), F.try_to_timestamp(day, F.lit(PAGE_TIME_FORMATS[1]))
    ).cast("timestamp_ntz")
    return found if default is None else F.coalesce(found, default)


def round2(x: Column | str) -> Column:
    return F.round(col(x), 2)
