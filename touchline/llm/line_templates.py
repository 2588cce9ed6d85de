"""Line dedup by a log-template tree: lines whose template recurs across documents are dropped.

The tree has a fixed depth: token count, then the first ``LEAD`` tokens, then a line's templates. Digits are variable from the start
(``[0-9]+`` becomes ``#``). Below the leading tokens each (leaf, position, token) is counted, and a token that is rare at its
position becomes a wildcard, so fields of any number and place are generalised. What is rare depends on the template: a line stands
for one template for each power of two times ``min_docs`` that separates the counts of its tokens, as long as more than half of its
tokens stay. A field in the leading tokens is not generalised, nor is a word that is as frequent there through another template.

A template recurs if it stands in at least ``min_docs`` different surroundings, whatever the number of copies. A line's
surrounding is the least hash among the document's other own lines. A line is a document's own unless it, or its template with
nine tenths of its tokens, stands in ``min_docs`` different texts; blank lines are left out. Where the other own lines hold less than
one ``OWN``-th of the document's words, it is a copy or near copy as far as this line goes, and its surrounding is the least
leaf among its other recurring lines: copies have one, near copies a few. So lines that only recur because their documents
are copies stay for document dedup, and so do lines that make up nine tenths of the documents that hold them.

Native throughout: hashes of lines and counts move, tokens only of lines whose leaf holds ``min_docs`` of them; text moves twice, as lines
to be cut into tokens and as documents to meet their lists of dropped lines. Nothing is collected.

Cases: NULL and empty texts stay as they are. Lines of fewer than ``min_tokens`` tokens stay. A document all of whose lines go
keeps empty text (:func:`drop_lines` leaves it out). Repeated rows count as copies of one document. A line repeated within a
document counts once. ``docs`` keeps its columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.plans.materialize import materialize

LEAD = 2
MIN_DOCS = 10
MIN_TOKENS = 3
OWN = 10


def _masked(text: Column) -> Column:
    """The masked lines of a text; digits are masked in the whole text at once."""
    return F.transform(F.split(F.regexp_replace(text, "[0-9]+", "#"), "\n"), F.trim)


def _tokens(line: Column) -> Column:
    """Split at runs of blanks; only lines with a run, tab or carriage return need a pattern."""
    plain = ~(F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")))
    return F.when(plain, F.split(line, " ")).otherwise(F.split(line, r"[ \t\r]+"))


def _key(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k_text"), F.xxhash64(doc_id, F.length(text)).alias("k_doc")]


def _lines(docs: DataFrame) -> DataFrame:
    """(k_text, k_doc, line): a row for each distinct masked line of a row, without blank ones."""
    masked = F.filter(F.array_distinct(_masked(F.col("text"))), lambda x: F.btrim(x, F.lit(" \t\r")) != "")
    # The keys are taken before the lines are dealt out: beside explode() they would be hashed for each line. The plain explode()
    # would also get a filter on its size, which masks every text a second time.
    rows = docs.where("text <> ''").select(*_key(F.col("doc_id"), F.col("text")), masked.alias("lines"))
    return rows.select("k_text", "k_doc", F.explode_outer("lines").alias("line")).where("line is not null")


def _templates(docs: DataFrame, once: DataFrame, min_docs: int, min_tokens: int) -> DataFrame:
    """(hash, texts, template, near): a row for each template of a line; ``near`` if it holds nine tenths of the tokens."""
    lines = once.where(F.col("words") >= min_tokens).groupBy("hash", "leaf", "words").agg(F.count("*").alias("texts"), F.min("k_text").alias("k_text"))
    hot = lines.groupBy("leaf").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_docs).select("leaf")
    # Each line's text comes from one document, so that a frequent line moves on as one row.
    carrier = lines.join(hot, "leaf", "left_semi").join(once.select("k_text", "hash", "k_doc"), ["k_text", "hash"])
    texts = _lines(docs).withColumn("hash", F.xxhash64("line"))
    cut = carrier.join(texts, ["k_text", "k_doc", "hash"]).select("hash", "leaf", "words", "texts", "line").dropDuplicates(["hash"])
    cut = materialize(cut, "cut")
    tokens = cut.select("hash", "leaf", "words", "texts", F.posexplode(F.slice(_tokens(F.col("line")), LEAD + 1, F.col("words"))).alias("at", "token"))
    tokens = tokens.select("hash", "leaf", "words", "texts", F.xxhash64("leaf", "at", "token").alias("token"))
    often = tokens.groupBy("token").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_docs)
    often = often.select("token", F.floor(F.log2(F.col("n") / min_docs)).cast("int").alias("level"))
    kept = F.array_sort(F.collect_list(F.struct("token", "level"))).alias("kept")
    met = tokens.join(often, "token").groupBy("hash", "leaf", "words", "texts").agg(kept)
    levels = F.array_distinct(F.transform("kept", lambda k: k["level"]))

    def of(level: Column) -> Column:
        stay = F.transform(F.filter("kept", lambda k: k["level"] >= level), lambda k: k["token"])
        return F.struct(F.xxhash64("leaf", stay).alias("template"), (F.size(stay) + F.least("words", F.lit(LEAD))).alias("constant"))

    each = met.select("hash", "words", "texts", F.explode(F.transform(levels, of)).alias("of")).where(2 * F.col("of.constant") > F.col("words"))
    short = lines.where(F.col("words") <= LEAD).join(hot, "leaf", "left_semi").select("hash", "texts", F.col("leaf").alias("template"), F.lit(True).alias("near"))
    return each.select("hash", "texts", "of.template", (10 * F.col("of.constant") >= 9 * F.col("words")).alias("near")).union(short)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(k_text, k_doc, gone): for each text that holds lines of recurring templates, the hashes of those masked lines."""
    occ = _lines(docs).select("k_text", "k_doc", F.xxhash64("line").alias("hash"), _tokens(F.col("line")).alias("tokens"))
    occ = occ.select("k_text", "k_doc", "hash", F.size("tokens").alias("words"), F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEAD)).alias("leaf"))
    occ = materialize(occ, "lines")
    once = materialize(occ.groupBy("k_text", "hash", "leaf", "words").agg(F.min("k_doc").alias("k_doc")), "once")
    templates = materialize(_templates(docs, once, min_docs, min_tokens), "templates")

    same = once.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("hash")
    alike = templates.where("near").groupBy("template").agg(F.sum("texts").alias("n")).where(F.col("n") >= min_docs).select("template")
    shared = same.union(templates.where("near").join(alike, "template", "left_semi").select("hash")).distinct()
    flagged = materialize(once.join(shared.withColumn("shared", F.lit(True)), "hash", "left"), "flagged")
    own = F.col("shared").isNull()

    def two(value: Column) -> Column:
        return F.slice(F.array_sort(F.collect_set(value)), 1, 2)

    around = flagged.groupBy("k_text").agg(F.sum("words").alias("all"), F.sum(F.when(own, F.col("words")).otherwise(0)).alias("own"),
                                           two(F.when(own, F.col("hash"))).alias("own_two"), two(F.when(~own, F.col("leaf"))).alias("shared_two"))

    def other(pair: Column, but: Column) -> Column:
        return F.coalesce(F.get(F.filter(pair, lambda x: x != but), F.lit(0)), F.lit(0))

    asked = flagged.join(templates.select("hash").distinct(), "hash", "left_semi").join(around, "k_text")
    rest = F.col("own") - F.when(own, F.col("words")).otherwise(0)
    place = F.when((rest > 0) & (OWN * rest >= F.col("all")), other(F.col("own_two"), F.col("hash"))).otherwise(other(F.col("shared_two"), F.col("leaf")))
    places = asked.select("hash", place.alias("place")).distinct().join(templates.select("hash", "template"), "hash")
    often = places.groupBy("template", "place").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("template")
    gone = materialize(templates.join(often, "template", "left_semi").select("hash").distinct(), "gone")
    return occ.select("k_text", "k_doc", "hash").join(gone, "hash", "left_semi").groupBy("k_text", "k_doc").agg(F.collect_set("hash").alias("gone"))


def mark(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, prefix: str = "t_") -> DataFrame:
    """``docs`` with the columns ``t_lines`` (all), ``t_dropped`` (both counts) and ``t_text``, the lines that stay; ``prefix`` is theirs."""
    gone = recurring_lines(docs.select("doc_id", "text"), min_docs, min_tokens)
    key = _key(docs["doc_id"], docs["text"])
    joined = docs.join(gone, (key[0] == gone["k_text"]) & (key[1] == gone["k_doc"]), "left")
    lines = F.split(docs["text"], "\n")
    stays = F.zip_with(lines, _masked(docs["text"]), lambda x, m: F.when(~F.array_contains(gone["gone"], F.xxhash64(m)), x))
    count, kept = f"{prefix}lines", f"{prefix}text"
    n_lines = F.when(docs["text"] == "", 0).otherwise(F.coalesce(F.size(lines), F.lit(0)))
    # The lines that stay are listed first and counted and joined from the list, so that a text is masked once.
    listed = joined.select(*[docs[c] for c in docs.columns], n_lines.cast("long").alias(count), F.when(gone["gone"].isNotNull(), F.array_compact(stays)).alias(kept))
    return listed.select(*docs.columns, count, F.coalesce(F.col(count) - F.size(kept), F.lit(0).cast("long")).alias(f"{prefix}dropped"),
                         F.coalesce(F.array_join(kept, "\n"), F.col("text")).alias(kept))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``docs`` with recurring lines cut from ``text`` (and ``n_chars`` counted anew); documents with no line left go."""
    prefix = "t_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    text, dropped = F.col(f"{prefix}text"), F.col(f"{prefix}dropped")
    marked = mark(docs, min_docs, min_tokens, prefix).where((dropped == 0) | (F.trim(text) != ""))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(dropped > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return marked.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
