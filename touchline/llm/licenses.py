"""License scan by an exact set-similarity join, native throughout.

Two findings per document. Base: the places where a license's phrase stands word by word. Method: every text block that
holds enough of a notice template's words, by containment: ``|block and template| >= share * |template|`` over distinct words.
A template's blocks are windows over the words of the whole text, across line breaks: twice as long as the template, one each half
length. So a notice of up to one and a half lengths stands whole in one, and words that lie further apart never meet.

The join: template words are ordered by frequency in the whole corpus, rarest first (documents that
hold the word). A block that meets the
threshold holds one of the template's first ``n - need + 1`` words (prefix filter), has at least ``need`` words (length filter),
and from the place of the first shared word on there are words enough left (positional filter). What passes is confirmed by the
exact overlap. Only blocks that hold a prefix word leave the scan, so no text is shuffled.

Templates are the fixed table below or the caller's own, at most ``TEMPLATES_MOST``; their sets travel as literals in the plan.

Cases: NULL text is empty and has no words; blocks without words match nothing. Repeated rows are judged one by one. A phrase's
places may overlap. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEMPLATES_MOST = 64
GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # what stands between words
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Usual notice wordings with their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the mozilla public license version 2 0": "mpl-2",
}


def _words(text: Column) -> Column:
    """Lower-cased words (A-Z only) of a short text."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), f"[{GAP}]+"), lambda w: w != "")


_NO_ENTRY = "('', 0, 0, 1, 1, array(''), '')"  # the empty word is in no block


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _phrase(words: str) -> str:
    """A pattern that takes the first of the words where the others follow it; ``(?i)`` folds A-Z only."""
    first, *rest = words.split()
    return rf"(?i)(?<![^{GAP}]){first}(?=" + "".join(rf"[{GAP}]+{w}" for w in rest) + rf"(?![^{GAP}]))"


def _count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, f"[{GAP}]+"), "")).cast("long")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, share: float = 0.9) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the matching blocks per row of ``docs``.

    ``score`` is the highest containment of any template in any block, 1 where a base phrase was found.
    """
    if len(templates) > TEMPLATES_MOST:
        raise ValueError("too many templates")
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))  # numbered before any explode
    folded = docs.withColumn("folded", F.lower("text"))  # only to leave rows out early; any A-Z word is in it
    sets = [(sorted(set(t.split())), label) for t, label in templates.items()]
    lengths = [t.split() for t in templates]
    need = [max(1, -(-round(share * 1000) * len(s) // 1000)) for s, _ in sets]
    vocabulary = sorted({w for s, _ in sets for w in s})
    # The global order: documents that hold each template word, counted over the whole corpus.
    held = folded.select(F.explode(F.array_intersect(F.split("folded", f"[{GAP}]+"), F.array(*map(F.lit, vocabulary)).cast("array<string>"))).alias("w"))
    counts = {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    ordered = [sorted(s, key=rank.get) for s, _ in sets]
    prefixes = sorted({w for s, n in zip(ordered, need, strict=True) for w in s[: len(s) - n + 1]})

    none = F.array().cast("array<struct<n:bigint,first:bigint,last:bigint,label:string>>")

    def places(phrase: str, label: str) -> Column:
        """Count, first and last of the phrase's places: the text is cut at each, and the words before each cut are counted."""
        parts = F.split("text", _phrase(phrase))

        def step(state: Column, part: Column) -> Column:
            at = state["words"] + _count(part)
            return F.struct((at + 1).alias("words"), (state["n"] + 1).alias("n"), F.coalesce(state["first"], at).alias("first"), at.alias("last"))

        zero, unknown = F.lit(0).cast("long"), F.lit(None).cast("long")
        start = F.struct(zero.alias("words"), zero.alias("n"), unknown.alias("first"), unknown.alias("last"))
        found = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, step,
                            lambda state: F.array(F.named_struct(F.lit("n"), state["n"], F.lit("first"), state["first"], F.lit("last"), state["last"], F.lit("label"), F.lit(label))))
        return F.when(F.size(parts) > 1, found).otherwise(none)

    def holds(word: str) -> Column:
        return F.contains("folded", F.lit(word))

    def any_of(tests: list[Column]) -> Column:
        return reduce(or_, tests, F.lit(False))

    base = F.flatten(F.array(none, *[F.when(reduce(and_, map(holds, p.split())), places(p, label)).otherwise(none) for p, label in phrases.items()]))
    no_block = F.array().cast("array<struct<kind:int,words:array<string>>>")

    def windows(kind: int) -> Column:
        """Template ``kind``'s blocks that hold one of its prefix words."""
        size = len(lengths[kind])
        first = F.array(*map(F.lit, ordered[kind][: len(ordered[kind]) - need[kind] + 1]))

        def of(words: Column) -> Column:
            starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(words) - size - 1), F.lit(max(1, size // 2)))
            cut = F.transform(starts, lambda at: F.slice(words, at + 1, 2 * size))
            return F.transform(F.filter(cut, lambda w: F.arrays_overlap(w, first)), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("words")))

        return F.transform(F.array(_words(F.col("text"))), of)[0]

    def hit(kind: int) -> Column:
        first = ordered[kind][: len(ordered[kind]) - need[kind] + 1]
        return any_of([holds(w) for w in first]) & F.col("text").rlike(rf"(?i)(?<![^{GAP}])(?:{'|'.join(first)})(?![^{GAP}])")

    found = F.flatten(F.array(no_block, *[F.when(hit(k), windows(k)).otherwise(no_block) for k in range(len(ordered))]))
    rows = folded.select("doc_id", "row", _count(F.col("text")).alias("n_words"),
                         base.alias("base"), F.explode_outer(found).alias("window"))
    rows = rows.select("doc_id", "row", "n_words", "base", F.col("window.kind").alias("kind"), F.array_join("window.words", " ").alias("block"),
                       F.array_distinct("window.words").alias("ordered"))

    # The templates as a small inverted list: prefix word and template to its place in the order.
    entries = [(w, k, i, len(s), need[k], s, sets[k][1]) for k, s in enumerate(ordered) for i, w in enumerate(s[: len(s) - need[k] + 1])]
    values = ", ".join("({}, {}, {}, {}, {}, array({}), {})".format(_quoted(w), k, i, size, n, ", ".join(map(_quoted, s)), _quoted(label)) for w, k, i, size, n, s, label in entries)
    posted = docs.sparkSession.sql(f"select * from values {values or _NO_ENTRY} as t(word, kind, place, size, need, words, label)")
    asked = rows.withColumn("word", F.explode_outer(F.array_intersect("ordered", F.array(*map(F.lit, prefixes)).cast("array<string>"))))
    met = asked.join(posted, ["word", "kind"], "left")
    overlap = F.size(F.array_intersect("ordered", "words"))
    possible = (F.size("ordered") >= F.col("need")) & (F.col("size") - F.col("place") >= F.col("need"))
    good = F.when(possible, F.when(overlap >= F.col("need"), overlap / F.col("size")))
    met = met.withColumn("containment", good)
    found = F.when(F.col("containment").isNotNull(), F.struct(F.col("label"), F.col("block"), F.col("containment")))
    each = met.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("base").alias("base"),
                                  F.collect_set(found).alias("blocks"))
    base_labels = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    labels = F.array_sort(F.array_union(base_labels, F.transform("blocks", lambda b: b["label"])))
    n_base = F.aggregate("base", F.lit(0).cast("long"), lambda n, b: n + b["n"])
    first, last = F.array_min(F.transform("base", lambda b: b["first"])), F.array_max(F.transform("base", lambda b: b["last"]))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
    return each.select("doc_id", "n_words", n_base.alias("n_base"), first.alias("first_word"), last.alias("last_word"),
                       F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "blocks")
