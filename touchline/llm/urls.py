"""URL filters: host-suffix and path-prefix expressions, met on short hash prefixes and confirmed by whole digests.

Native throughout. Each url gives one expression for every suffix of its host (cut at dots) with every prefix of its path whose
length some rule has. Expressions and rules meet in an equi-join on the first ``PREFIX`` hex digits of SHA-256; the whole digest
is then compared. The longest rule wins; of rules of one length block goes before allow, then the smaller text. The host is what
stands between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; the path runs on to ``?`` or ``#``.

Rule path lengths are collected as a set of integers, none beyond ``PATH_MOST``; longer rule paths are refused. The rule side is
broadcast only where Spark's size check allows it; a host that holds a third of all rows is then split by AQE like any hot key.
Several expressions of one row are folded by a partial aggregate on the row's own number, so no group is larger than a url's
labels times the path lengths.

Cases: a NULL url or one without ``://`` has an empty host and path and gets the default verdict. Rules with a NULL part are left
out, repeated rules count once; without rules every row gets the default. Rows are never merged, repeated ids included. ``pages``
may have any other columns; they are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8
PATH_MOST = 2048
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for each row; ``rules`` has host, path and verdict ('block' or 'allow')."""
    rules = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict").distinct()
    lengths = sorted(r["n"] for r in rules.select(F.length("path").alias("n")).distinct().limit(PATH_MOST + 2).collect())
    if lengths and lengths[-1] > PATH_MOST:
        raise ValueError(f"a rule's path is longer than {PATH_MOST}")
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(key).alias("page_key"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(sizes, lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    asked = rows.withColumn("expression", F.explode_outer(expressions)).withColumn("digest", F.sha2("expression", 256))
    asked = asked.withColumn("short", F.substring("digest", 1, PREFIX))
    text = F.concat("host", "path")
    listed = rules.select(F.sha2(F.concat("host", F.lit("\n"), "path"), 256).alias("r_digest"), text.alias("r_rule"), F.col("verdict").alias("r_verdict"))
    listed = listed.withColumn("r_short", F.substring("r_digest", 1, PREFIX))
    met = asked.join(listed, F.col("short") == F.col("r_short"), "left")
    # Confirmed by the whole digest. Smallest first: longer rules, block before allow, then the text.
    order = F.when(F.col("digest") == F.col("r_digest"), F.struct((-F.length("r_rule")).alias("n"), (F.col("r_verdict") != "block").alias("a"), F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict")))
    best = met.groupBy("row").agg(F.first("page_key").alias("page_key"), F.first("host").alias("host"), F.first("path").alias("path"), F.min(order).alias("best"))
    return best.select(F.col("page_key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
