"""Exact top-k search by inner product with a three-phase uniform threshold.

Components become ``floor(SCALE * x)``, longs, so scores are exact. The dimensions are cut into ``LISTS`` runs; a vector's score
is the sum of its partial scores over the runs, and each run holds one score list per query, spread over blocks of vectors.

1. Every block gives each query its ``DEPTH * k`` best partial scores; per run the best of them are gathered and scored in full.
   The k-th best full score ``t`` is a safe cutoff: no result is below it.
2. Cutoffs go out with the queries. A vector that reaches ``t`` reaches ``t / LISTS`` in some run, so each block gives all its
   entries from there on, however many, and these lists are sufficient. An entry absent from a run is below that threshold, which
   bounds a vector's score from above. Vectors whose bound is below the k-th best score known by then go.
3. What is left and lacks an entry is scored in full.

Blocks hold about ``BLOCK_ROWS`` vectors and meet the queries in blocks of ``QUERY_ROWS``, so a task holds one of each. Equal vectors
are one entry with its ``k + 1`` least ids, and equal queries one query asked for ``k + 1`` rows, its own among them.

Nothing of the data is broadcast or collected but the number of vectors of each length and the largest components.

Cases: vectors that are NULL or hold NULL, NaN or infinity take no part, nor do rows without id. Vectors meet those of their own
length (also empty ones, all scores 0). Repeated rows count once; rows that share an id but not the vector are queries and
candidates of their own. Ties go to the smaller id. Queries get all candidates where there are fewer than ``k``. Vectors so large
that a score could leave the range of a long are refused with an error. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.plans.materialize import materialize

SCALE = 1024  # fixed value of the contract
LISTS = 2
DEPTH = 4
BLOCK_ROWS = 8192
QUERY_ROWS = 8192
_STEP = 256  # queries multiplied at a time
_NONE = -(1 << 63)  # the cutoff of a query with fewer candidates than it asks for
_FOUND = "qid long, list int, cids array<long>, parts array<long>"


def _usable(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    array = column.combine_chunks()
    return np.asarray(array.flatten(), np.int64).reshape(len(array), -1)


def _products(q: np.ndarray, v: np.ndarray):
    """Blocks of inner products (first query, long matrix); floating point only where it is exact."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * q.shape[1]
    kind = np.float64 if most < 1 << 53 else np.int64
    turned = np.ascontiguousarray(v.T.astype(kind))
    for lo in range(0, len(q), _STEP):
        yield lo, (q[lo : lo + _STEP].astype(kind) @ turned).astype(np.int64)


@F.arrow_udf(T.LongType())
def _score(a: pa.Array, b: pa.Array) -> pa.Array:
    """Inner products of two columns of equally long vectors."""
    ends = np.concatenate([[0], np.cumsum(np.diff(a.offsets.to_numpy()))])
    total = np.concatenate([[0], np.cumsum(a.flatten().to_numpy().astype(np.int64) * b.flatten().to_numpy().astype(np.int64))])
    return pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())


def _lists(classes: DataFrame, lists: int) -> DataFrame:
    """(dim, list, id, part): every vector cut into its runs; a run's first dimension is ``dim * list / lists``."""
    cut = [(F.floor(F.col("dim") * j / lists), F.floor(F.col("dim") * (j + 1) / lists)) for j in range(lists)]
    runs = F.array(*[F.slice("x", (a + 1).cast("int"), (b - a).cast("int")) for a, b in cut])
    return classes.select("*", F.posexplode(runs).alias("list", "part")).drop("x")


def _listed(have: DataFrame, want: DataFrame, entries) -> DataFrame:
    """What ``entries(products, cutoffs)`` picks for each block of vectors and queries: per query the vectors and partial scores."""

    def meet(key, v, q):
        rows = []
        if v.num_rows and q.num_rows:
            ids = v.column("cid").to_numpy()
            qids = q.column("qid").to_pylist()
            cutoff = q.column("cutoff").to_numpy()
            for lo, scores in _products(_matrix(q.column("part")), _matrix(v.column("part"))):
                for i, at in enumerate(entries(scores, cutoff[lo : lo + len(scores)])):
                    if len(at):
                        rows.append((qids[lo + i], ids[at], scores[i][at]))
        return pa.table({"qid": pa.array([r[0] for r in rows], pa.int64()), "list": pa.array([key[1].as_py()] * len(rows), pa.int32()), "cids": pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                         "parts": pa.array([r[2] for r in rows], pa.list_(pa.int64()))})

    keys = ["dim", "list", "vectors", "queries"]
    found = have.groupBy(*keys).cogroup(want.groupBy(*keys)).applyInArrow(meet, _FOUND)
    return found.select("qid", "list", F.explode(F.arrays_zip("cids", "parts")).alias("e")).select("qid", "list", F.col("e.cids").alias("cid"), F.col("e.parts").alias("part"))


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(qid, cutoff): each query's k-th best score, for those with so many."""
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc()))
    return scored.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("qid").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of highest score for each row that ``is_query`` holds for."""
    usable = vectors.where(_usable(F.col(vector)) & F.col(key).isNotNull())
    scaled = F.transform(vector, lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long"))
    rows = usable.select(F.col(key).cast("long").alias("id"), scaled.alias("x"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.groupBy("id", "x").agg(F.max("q").alias("q"))
    asked = k + 1  # a query finds itself too
    nth = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    least = rows.withColumn("nth", nth).where(F.col("nth") <= asked).groupBy("x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = materialize(least.select(F.monotonically_increasing_id().alias("cid"), F.size("x").alias("dim"), "x", "ids"), "vectors")
    wanted = rows.where("q").join(classes.select(F.col("cid").alias("qid"), "x"), "x")
    wanted = materialize(wanted.select("qid", F.col("id").alias("query_id")), "queries")
    queries = materialize(classes.join(wanted.select(F.col("qid").alias("cid")).distinct(), "cid", "left_semi").select(F.col("cid").alias("qid"), "dim", "x"), "queries")

    size = classes.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"), F.max("dim").alias("dim")).first()
    if (size["most"] or 0) ** 2 * (size["dim"] or 0) >= 1 << 63:
        raise ValueError("components so large that a score may not fit a long")
    v_blocks, q_blocks = max(1, -(-size["n"] // BLOCK_ROWS)), max(1, -(-queries.count() // QUERY_ROWS))
    every = F.sequence(F.lit(0), F.lit(q_blocks - 1))
    have = _lists(classes.select("cid", "dim", "x"), lists).withColumn("vectors", F.pmod(F.xxhash64("cid"), F.lit(v_blocks)).cast("int")).withColumn("queries", F.explode(every))

    def want(cutoffs: DataFrame | None) -> DataFrame:
        known = queries.withColumn("cutoff", F.lit(0).cast("long")) if cutoffs is None else queries.join(cutoffs, "qid", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(_NONE)))
        cut = _lists(known, lists).withColumn("queries", F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).cast("int"))
        return cut.withColumn("vectors", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))

    # Phase 1: the heads of the score lists, scored in full.
    depth = DEPTH * asked

    def heads(scores, _):
        if scores.shape[1] <= depth:
            yield from (np.arange(scores.shape[1]) for _ in scores)
            return
        yield from np.argpartition(scores, scores.shape[1] - depth, axis=1)[:, -depth:]

    nth = F.row_number().over(Window.partitionBy("qid", "list").orderBy(F.col("part").desc()))
    gathered = _listed(have, want(None), heads).withColumn("nth", nth).where(F.col("nth") <= depth).select("qid", "cid").distinct()
    scored = materialize(_full(gathered, classes, queries), "scored")
    cutoffs = materialize(_kth(scored, asked), "cutoffs")

    # Phase 2: every entry that a result may have in some list.
    def sufficient(scores, cutoff):
        least = np.where(cutoff == _NONE, _NONE, -(-cutoff // lists))  # rounded up
        for row, t in zip(scores, least, strict=True):
            yield np.flatnonzero(row >= t)

    met = _listed(have, want(cutoffs), sufficient).groupBy("qid", "cid").agg(F.sum("part").alias("score"), F.count("*").alias("n"))
    met = materialize(met.join(scored.select("qid", "cid"), ["qid", "cid"], "left_anti"), "met")
    known = scored.unionByName(met.where(F.col("n") == lists).drop("n"))
    best = materialize(_kth(known, asked), "cutoffs")

    # Phase 3: the vectors whose bound reaches the better cutoff and that lack an entry.
    absent = F.col("n") - lists  # negative: what is absent is at most ceil(first / lists) - 1
    bound = F.col("score") - absent * (F.ceil(F.col("first") / lists) - 1)
    partial = met.where(F.col("n") < lists).join(cutoffs.withColumnRenamed("cutoff", "first"), "qid").join(best, "qid")
    rest = _full(partial.where(bound >= F.col("cutoff")).select("qid", "cid"), classes, queries)
    results = known.join(best, "qid", "left").where(F.col("cutoff").isNull() | (F.col("score") >= F.col("cutoff"))).drop("cutoff").unionByName(rest)

    # Of equal scores the classes with the least ids hold the least ids.
    named = results.join(classes.select("cid", "ids"), "cid")
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("ids")[0]))
    members = named.withColumn("nth", nth).where(F.col("nth") <= asked).select("qid", "cid", "score", F.explode("ids").alias("vec_id"))
    nth = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("score").desc(), "vec_id", "cid"))
    ranked = members.withColumn("nth", nth).where(F.col("nth") <= asked)
    listed = ranked.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("nth", "cid", "vec_id", "score"))).alias("found"))
    out = wanted.join(listed, "qid")
    others = F.filter("found", lambda f: (f["vec_id"] != F.col("query_id")) | (f["cid"] != F.col("qid")))
    out = out.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))


def _full(pairs: DataFrame, classes: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, cid, score): the whole inner products of pairs."""
    return pairs.join(classes.select("cid", "x"), "cid").join(queries.select("qid", F.col("x").alias("y")), "qid").select("qid", "cid", _score("x", "y").alias("score"))
