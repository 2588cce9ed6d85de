"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, and a limit on perplexity for each language.

The model is one of words (A-Z lower-cased, cut at white space), ``ORDER`` (two at least) long, over all trusted documents, so it grows with them.
Each text stands between start signs and an end sign. Counts, continuation counts, count-of-count discounts and history totals
are groupings and joins of count tables. Words are 64-bit hashes.

Scoring is a join of the documents' n-grams with the count tables, sharded by hash: a block of texts asks for its distinct n-grams
of every length (see :mod:`blocks`), a shard answers with their counts and, as histories, their totals and what discounts leave over,
and the block interpolates. No table of the model goes to the driver or to every task, and counts meet histories only there.

Questions take more room than the texts, so texts are scored in up to ``ROUNDS`` slices, one after the other, and what a slice moved is
freed before the next. The model is stored once for all of them, packed, a row for each shard. Trusted texts are gathered by the same
slices, and their n-grams counted by as many slices of the first word. Every slice is worked through; only their order in time is set.

Limits come from trusted texts that were not counted (one in ``HELD`` by hash), as counted ones look too good. A short text says
little, so its mean loss counts with ``PRIOR`` words of its language's mean. A document is kept if the resulting score is at most the
``quantile`` of held-out texts of its language times ``slack``; a language without them, or NULL, has the limit of all together.

Cases: texts that are NULL or without words have no perplexity and are kept. Without trusted documents, or without held-out ones,
everything is kept. Equal texts count once, and are trusted if a document of theirs is. Repeated label rows count once; a document
with labels that contradict each other is not trusted. Other columns stay as they are.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm import blocks, text
from touchline.plans.materialize import materialize, shuffles_freed

ORDER = 2
HELD = 3
PRIOR = 50
QUANTILE = 0.99
SLACK = 1.5
ROUNDS = 6
ROUND_BYTES = 1 << 24  # of text, for which a round is worth its jobs
BROADCAST_ROWS = 1_000_000  # short keys of rejected texts sent to all tasks at most
LANGUAGES = 10_000
LEAST = 0.01  # discount; a corpus too small for good estimates must leave something to unseen n-grams
START, END = 1, 2  # stand for words
_SUMS = ["n", "total", "left"]
_MANY = 255  # counts from here on are no single bytes
_ZSTD = pa.Codec("zstd", 1)
_U = np.uint64


def _fold(words: list[np.ndarray]) -> np.ndarray:
    """The hash of n-grams whose words are given column by column."""
    code = words[0]
    for k, w in enumerate(words[1:], 2):
        code = text.mix(code * _U(31) + w + _U(k))
    return code


def _padded(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All rows' words on end, each row after ``order - 1`` start signs and before an end sign; the rows' begins; their numbers of words."""
    data, offsets = text.buffers(column)
    data = text.LOWER[data]
    starts, ends, first = text.words(data, offsets, text.NOT_SPACE)
    n = np.diff(first)
    begins = np.concatenate([[0], np.cumsum(n + order)])
    out = np.full(begins[-1], START, _U)
    out[np.arange(len(starts)) + order - 1 + np.repeat(begins[:-1] - first[:-1], n)] = text.word_hashes(data, starts, ends)
    out[begins[1:] - 1] = END
    return out, begins, n


def _places(begins: np.ndarray, before: int) -> np.ndarray:
    """Places of all rows from the ``before``-th of each on."""
    n = np.diff(begins) - before
    return np.arange(n.sum()) + np.repeat(begins[:-1] + before - np.concatenate([[0], np.cumsum(n)[:-1]]), n)


def _grams(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams of each length that end at the last start sign (not those of full order) or later; the rows' numbers of words."""
    words, begins, n = _padded(column, order)
    ends = [_places(begins, max(order - 2, k - 1)) for k in range(1, order + 1)]
    return [_fold([words[at - k + 1 + i] for i in range(k)]) for k, at in enumerate(ends, 1)], n


def _once(batches):
    """Each text once for a scan task, as its size in bytes and the compressed text: blocks keep all texts in shuffle files."""
    seen: set[str] = set()
    for batch in batches:
        take = []
        for i, key in enumerate(batch.column(0).to_pylist()):
            if key not in seen:
                seen.add(key)
                take.append(i)
        for lo in range(0, len(take), 1024):
            part = batch.take(pa.array(take[lo : lo + 1024], pa.int64()))
            raw = (value.encode() for value in part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([struct.pack("<Q", len(r)) + _ZSTD.compress(r, asbytes=True) for r in raw], pa.binary())], ["key", "text"])


def _texts(table: pa.Table) -> pa.Array:
    """The texts that :func:`_once` compressed."""
    raw = (value.as_buffer() for value in table.column("text"))
    whole = [_ZSTD.decompress(r.slice(8), struct.unpack_from("<Q", r)[0], asbytes=True) for r in raw]
    return pa.array(whole, pa.large_binary()).view(pa.large_string())


def _distinct(table: pa.Table) -> pa.Table:
    keys = table.column("key").to_pylist()
    return table.take(pa.array(sorted({key: i for i, key in enumerate(keys)}.values()), pa.int64()))


def _names(k: int) -> list[str]:
    return [f"w{i}" for i in range(1, k + 1)]


def _block(key: Column | str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _dealt(docs: DataFrame, n_blocks: int, rounds: int) -> list[DataFrame]:
    """(key, text, block) of each slice of the texts; equal texts are in one slice and block."""
    rows = docs.where("text is not null")
    slices = [rows.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(rounds)) == i) for i in range(rounds)] if rounds > 1 else [rows]
    once = [r.select(F.md5("text").alias("key"), "text").mapInArrow(_once, "key string, text binary") for r in slices]
    return [o.withColumn("block", _block("key", n_blocks)) for o in once]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def counted_texts(dealt: list[DataFrame], counted: DataFrame) -> DataFrame:
    """(text): each text once, compressed, whose key is in ``counted`` (block, key)."""

    def pick(table, keys):
        chosen = set(keys.column("key").to_pylist())
        table = _distinct(table)
        return table.filter(pa.array([key in chosen for key in table.column("key").to_pylist()], pa.bool_())).select(["text"])

    return _all([materialize(part.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(pick, "text binary"), "counted") for part in dealt])


def _count(column: pa.Array, order: int, part: int, parts: int) -> pa.RecordBatch:
    """(w1, .., n) of the texts' n-grams of full order whose first word is in the slice."""
    words, begins, _ = _padded(column, order)
    at = _places(begins, order - 1)
    at = at[words[at - order + 1] % _U(parts) == part]
    columns = [words[at - order + 1 + i].view(np.int64) for i in range(order)]
    by = np.lexsort(columns)
    columns = [c[by] for c in columns]
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([pa.array(c[first]) for c in columns] + [pa.array(np.diff(np.append(first, len(by))).astype(np.int64))], [*_names(order), "n"])


def count_grams(texts: DataFrame, order: int, rounds: int) -> DataFrame:
    """(w1, .., n): how often each n-gram of full order occurs in the compressed texts, written slice by slice of the first word."""

    def rows(part):
        def count(batches):
            for batch in batches:
                sizes = [struct.unpack_from("<Q", t.as_buffer())[0] for t in batch.column(0)]
                lo = 0
                while lo < len(sizes):
                    hi, held = lo + 1, sizes[lo]
                    while hi < len(sizes) and held + sizes[hi] <= blocks.BLOCK_BYTES:
                        held += sizes[hi]
                        hi += 1
                    yield _count(_texts(pa.Table.from_batches([batch.slice(lo, hi - lo)])), order, part, rounds)
                    lo = hi

        return texts.mapInArrow(count, ", ".join(f"{c} long" for c in [*_names(order), "n"]))

    return _all([materialize(rows(i).groupBy(*_names(order)).agg(F.sum("n").alias("n")), "grams") for i in range(rounds)])


def _discounts(counts: DataFrame) -> tuple[list[float], dict]:
    """Discounts for counts of 1, 2 and 3 or more (without the counts they are made of, a half, one and one and a half); counts of counts."""
    of = counts.agg(F.count("*").alias("all"), F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (of[f"n{i}"] for i in (1, 2, 3, 4))
    if not n1 or not n2 or not n3:
        return [0.5, 1.0, 1.5], of
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return [min(max(d, LEAST), float(i)) for i, d in enumerate(raw, 1)], of


@dataclass
class Model:
    """Tables (w1, .., n, total, left) of n-grams of every length and of histories; discounts by length; the words' own sums."""

    tables: list[DataFrame]
    discounts: list[list[float]]
    words: int
    total: float
    left: float


def train(counts: DataFrame, order: int) -> Model | None:
    """The model of the written counts of n-grams of full order; None where there are none."""
    levels = {order: counts}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct words before the shorter n-gram
        shorter = levels[k + 1].select(*[F.col(f"w{i + 1}").alias(f"w{i}") for i in range(1, k + 1)])
        levels[k] = materialize(shorter.groupBy(*_names(k)).agg(F.count("*").alias("n")), "grams")
    tables, discounts = [], []
    for k in range(1, order + 1):
        d, of = _discounts(levels[k])
        if not of["all"]:
            return None
        discounts.append(d)
        tables.append(levels[k].select(*_names(k), F.col("n").cast("float").alias("n"), F.lit(0).cast("float").alias("total"), F.lit(0).cast("float").alias("left")))
        some = [F.count_if(F.col("n") == 1) * d[0], F.count_if(F.col("n") == 2) * d[1], F.count_if(F.col("n") > 2) * d[2]]
        if k == 1:
            words, total = of["all"], float(of["total"])
            left = of["n1"] * d[0] + of["n2"] * d[1] + (words - of["n1"] - of["n2"]) * d[2]
        else:
            sums = levels[k].groupBy(*_names(k - 1)).agg(F.sum("n").cast("float").alias("total"), sum(some[1:], some[0]).cast("float").alias("left"))
            tables.append(sums.select(*_names(k - 1), F.lit(0).cast("float").alias("n"), "total", "left"))
    return Model(tables, discounts, words, total, left)


def _coded(tables: list[DataFrame], shards: int) -> DataFrame:
    """(shard, code, n, total, left) of the tables of n-grams and histories."""
    shift = 64 - (shards.bit_length() - 1)

    def code(batches):
        for batch in batches:
            codes = _fold([c.to_numpy().view(_U) for c in batch.columns[:-3]])
            shard = (codes >> _U(shift)).astype(np.int32) if shards > 1 else np.zeros(len(codes), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(codes.view(np.int64)), *batch.columns[-3:]], ["shard", "code", *_SUMS])

    return _all([t.mapInArrow(code, f"shard int, code long, {', '.join(f'{c} float' for c in _SUMS)}") for t in tables])


def _sharded(tables: list[DataFrame], shards: int) -> DataFrame:
    """(shard, codes, sums) of the model, both packed: a row for each shard that any code falls to."""
    shift = 64 - (shards.bit_length() - 1)

    def pack(key, rows):
        codes, at = np.unique(rows.column("code").to_numpy().view(_U), return_inverse=True)
        sums = _packed(*(np.bincount(at, rows.column(c).to_numpy(), len(codes)).astype("<f4") for c in _SUMS))
        base = key[0].as_py() << shift if shards > 1 else 0
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([blocks.pack(codes, base)], pa.binary()), pa.array([sums], pa.binary())], ["shard", "codes", "sums"])

    return _coded(tables, shards).groupBy("shard").applyInArrow(pack, "shard int, codes binary, sums binary")


def _packed(n: np.ndarray, total: np.ndarray, left: np.ndarray) -> bytes:
    """Counts as a byte each, large ones behind; totals and left-over discounts of the histories alone, behind a bit for each code."""
    many, history = n >= _MANY, (total != 0) | (left != 0)
    return b"".join([struct.pack("<II", len(n), many.sum()), np.minimum(n, _MANY).astype(np.uint8).tobytes(), np.packbits(history).tobytes(),
                     *(x.astype("<f4").tobytes() for x in (n[many], total[history], left[history]))])


def _unpacked(reply: bytes) -> np.ndarray:
    """The three sums of each code as rows."""
    size, many = struct.unpack_from("<II", reply)
    out = np.zeros((len(_SUMS), size), "<f4")
    out[0] = counts = np.frombuffer(reply, np.uint8, size, 8)
    bits = np.frombuffer(reply, np.uint8, -(-size // 8), 8 + size)
    history = np.unpackbits(bits, count=size).astype(bool)
    rest = np.frombuffer(reply, "<f4", many + 2 * int(history.sum()), 8 + size + len(bits))
    out[0, counts == _MANY] = rest[:many]
    out[1:, history] = rest[many:].reshape(2, -1)
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled as good and not toxic, and never otherwise."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("t_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("t_id")


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, held): MD5 of each trusted text, and whether it is held out for the limits."""
    rows = docs.where("text is not null").select("doc_id", F.md5("text").alias("key"))
    keys = rows.join(trusted_ids(labels), F.col("doc_id") == F.col("t_id"), "left_semi").select("key").distinct()
    return keys.withColumn("held", F.pmod(F.xxhash64("key", F.lit(9)), F.lit(HELD)) == 0)


def score(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, loss, n) per distinct text with words: minus the logarithm of its probability, and the number of its words and its end; written."""
    total = blocks.octets(docs, "text")
    n_blocks, shards = blocks.sizes(docs, "text", total)
    rounds = min(ROUNDS, 1 + total // ROUND_BYTES)
    n_blocks = -(-n_blocks // rounds)
    dealt = _dealt(docs, n_blocks, rounds)
    counted = trusted.where("not held").select(_block("key", n_blocks).alias("block"), "key")
    model = train(count_grams(counted_texts(dealt, counted), order, rounds), order)
    if model is None:
        return docs.sparkSession.createDataFrame([], "key string, loss double, n long")
    discounts, words, overall, left_over = model.discounts, model.words, model.total, model.left
    shift = 64 - (shards.bit_length() - 1)

    def ask(key, table):
        codes = np.concatenate(_grams(_texts(_distinct(table)), order)[0])
        return blocks.questions(key[0].as_py(), np.unique(codes), shards)

    def answer(key, questions, rows):
        """Per block, the sums of its values, packed; 0 for what was never counted."""
        if not questions.num_rows:
            return blocks.answers(key[0].as_py(), [])
        codes, sums = np.empty(0, _U), np.zeros((len(_SUMS), 0), "<f4")
        if rows.num_rows:
            codes = blocks.unpack(rows.column("codes")[0].as_py(), key[0].as_py() << shift if shards > 1 else 0)
            sums = _unpacked(rows.column("sums")[0].as_py())
        sums = np.append(sums, np.zeros((len(_SUMS), 1), "<f4"), 1)
        out = []
        for block, values, _ in blocks.asked(questions, shards):
            place = np.searchsorted(codes, values)
            place[np.append(codes, _U(0))[place] != values] = len(codes)
            out.append((block, _packed(*sums[:, place])))
        return blocks.answers(key[0].as_py(), out)

    def finish(key, table, reply):
        table = _distinct(table)
        codes, n = _grams(_texts(table), order)
        at = np.unique(np.concatenate(codes), return_inverse=True)[1]
        got = [_unpacked(r) for r in blocks.replies(reply)]
        count, total, left = (np.concatenate([g[i] for g in got])[at].astype(np.float64) for i in range(len(_SUMS)))
        ends = np.cumsum([0, *(len(c) for c in codes)])
        edges = np.cumsum(n + 2)
        after, before = np.ones(ends[1], bool), np.ones(ends[1], bool)  # n-grams that end at a word or the end; that something follows
        after[edges - n - 2], before[edges - 1] = False, False
        p = np.full(after.sum(), 1 / (words + 1))
        for k in range(1, order + 1):
            seen = count[ends[k - 1] : ends[k]]
            seen = seen if k == order else seen[after]
            if k == 1:
                all_, rest = overall, left_over
            else:
                all_, rest = total[ends[k - 2] : ends[k - 1]][before], left[ends[k - 2] : ends[k - 1]][before]
            share = (seen - np.array([0.0, *discounts[k - 1]])[np.minimum(seen, 3).astype(int)] + rest * p) / np.maximum(all_, 1)
            p = np.where(all_ > 0, share, p)
        loss = -np.bincount(np.repeat(np.arange(len(n)), n + 1), np.log(p), len(n))
        has = n > 0
        return pa.table({"key": table.column("key").filter(pa.array(has)), "loss": pa.array(loss[has]), "n": pa.array((n + 1)[has].astype(np.int64))})

    stored = materialize(_sharded(model.tables, shards), "model")

    def scored(part):
        asked = part.groupBy("block").applyInArrow(ask, blocks.QUESTION)
        answered = asked.groupBy("shard").cogroup(stored.groupBy("shard")).applyInArrow(answer, blocks.ANSWER)
        return part.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(finish, "key string, loss double, n long")

    return _all([materialize(scored(part), "scores") for part in dealt])


def limits(scored: DataFrame, quantile: float = QUANTILE, slack: float = SLACK) -> tuple[DataFrame, dict]:
    """(l_lang, l_mean, l_limit) of each language with held-out texts, and the same of all; ``scored`` has lang, key, loss, n and held.

    A text counts once for each language and once for all, however many rows it has.
    """
    known = materialize(scored.where("held and loss is not null").select("lang", "key", "loss", "n").distinct(), "held")
    texts = known.select("key", "loss", "n").distinct()
    mean = (F.sum("loss") / F.sum("n")).alias("l_mean")
    cut = (F.percentile_approx(_score(F.col("l_mean")), quantile, 100_000) * slack).alias("l_limit")
    overall = texts.agg(mean).first()["l_mean"]
    every = {"mean": overall, "limit": texts.withColumn("l_mean", F.lit(overall).cast("double")).agg(cut).first()["l_limit"]}
    means = known.where("lang is not null").groupBy(F.col("lang").alias("l_lang")).agg(mean)
    # A row of a few values for each language; sent whole only where their number is known to be small.
    means = _sent(materialize(means, "means"))
    by_lang = known.join(means, F.col("lang") == F.col("l_lang")).groupBy("l_lang").agg(F.first("l_mean").alias("l_mean"), cut)
    return _sent(materialize(by_lang, "limits")), every


def _sent(by_lang: DataFrame) -> DataFrame:
    return F.broadcast(by_lang) if by_lang.count() <= LANGUAGES else by_lang


def _score(mean: Column) -> Column:
    """Perplexity with ``PRIOR`` words of the language's mean loss added."""
    return F.exp((F.col("loss") + PRIOR * mean) / (F.col("n") + PRIOR))


def _judged(docs: DataFrame, labels: DataFrame, quantile: float, slack: float, order: int) -> DataFrame:
    with shuffles_freed(docs.sparkSession):
        trusted = materialize(trusted_texts(docs, labels), "trusted")
        scores = score(docs, trusted, order)
    rows = docs.select("doc_id", "lang", F.md5("text").alias("key"))
    scored = materialize(rows.join(scores.join(trusted.where("held"), "key", "left"), "key", "left"), "judged")
    by_lang, every = limits(scored, quantile, slack)
    out = scored.join(by_lang, F.col("lang") == F.col("l_lang"), "left")
    out = out.withColumn("mean", F.coalesce("l_mean", F.lit(every["mean"]).cast("double")))
    out = out.withColumn("limit", F.coalesce("l_limit", F.lit(every["limit"]).cast("double"))).withColumn("score", _score(F.col("mean")))
    return out.withColumn("perplexity", F.exp(F.col("loss") / F.col("n"))).withColumn("keep", _kept(F.col("score"), F.col("limit")))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, order: int = ORDER) -> DataFrame:
    """(doc_id, lang, perplexity, score, limit, keep) for each row of ``docs`` (doc_id, text, lang)."""
    return _judged(docs, labels, quantile, slack, order).select("doc_id", "lang", "perplexity", "score", "limit", "keep")


def _kept(value: Column, limit: Column) -> Column:
    return value.isNull() | limit.isNull() | (value <= limit)


def drop_poor(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, order: int = ORDER) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns and order of columns stay."""
    poor = _judged(docs, labels, quantile, slack, order).where("not keep").select(F.col("key").alias("p_key"), F.col("lang").alias("p_lang")).distinct()
    poor = materialize(poor, "poor")
    same = (F.md5(docs["text"]) == poor["p_key"]) & docs["lang"].eqNullSafe(poor["p_lang"])
    # A list of known size goes to the texts; beyond it texts move to the list's partitions.
    return docs.join(F.broadcast(poor) if poor.count() <= BROADCAST_ROWS else poor, same, "left_anti")
