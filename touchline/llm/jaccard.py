"""N-gram Jaccard join by vertical partitioning.

1. Equal texts are one class (an MD5 of the text); each scan task sends a text once, so a group of copies moves little.
2. The global n-gram order is (rarity class, hash). Document frequencies are counted by shards of the hash space (see
   :mod:`blocks`); n-grams of one document alone come first and can be left out of all that follows.
3. Prefix filter: two sets that meet the threshold share an n-gram among the first ``n - ceil(t n) + 1`` of each. In text whose
   n-grams are its own this prefix holds nothing shared, and the document ends here.
4. N-grams are dealt by the top bits of their hashes into ``FRAGMENTS`` fragments, not by segments of the order of rarity. Overlaps of
   a candidate pair are counted in each fragment by itself and summed.
5. Candidates of a prefix n-gram are first compared with one centre each (``STARS`` turns with other centres), so most of a group
   of near copies joins at a cost in proportion to its size. What lies outside a group's largest component is then compared with
   the whole group, in blocks of bounded size, so no link between components is lost and no pair list is ever written out.

Result per row: the set's size, the class's component and the smallest id in it. Cases: NULL or empty text and text without words
have an empty set and link with nothing; with fewer words than ``size`` the whole sequence is the one n-gram. Rows without
``doc_id`` keep their class but never name a component. n-grams are compared by 64-bit hashes. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import blocks, text
from touchline.llm.graph import components
from touchline.plans.materialize import materialize

FRAGMENTS = 4
STARS = 1
OUTLIERS, NODES = 512, 2048  # of a block when the rest is compared, at most
OUTLIER_TOKENS, NODE_TOKENS = 1 << 18, 1 << 20  # n-grams of a block on average, at most
_PARSED = f"node string, n long, entries array<struct<token:long,pos:int>>, {', '.join(f'f{i} array<long>' for i in range(FRAGMENTS))}"


def _sets(table: pa.Table, size: int):
    """Distinct (row, hash) pairs of a block's rows, sorted by hash."""
    data, offsets = text.buffers(table.column("text"))
    data = text.LOWER[data]
    starts, ends, first = text.words(data, offsets, text.NOT_SPACE)
    hashes = text.word_hashes(data, starts, ends)
    at, found = text.window_hashes(hashes, first, size)
    rows = np.searchsorted(first, at, "right") - 1
    n = np.diff(first)
    for short in range(1, size):  # rows with fewer words
        take = np.flatnonzero(n == short)
        value = np.zeros(len(take), np.uint64)
        for k in range(short):
            value = text.mix(value * np.uint64(31) + hashes[first[take] + k])
        rows, found = np.concatenate([rows, take]), np.concatenate([found, text.mix(value + np.uint64(short))])
    order = np.lexsort((rows, found))
    rows, found = rows[order], found[order]
    keep = np.ones(len(rows), bool)
    keep[1:] = (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])
    rows, found = rows[keep], found[keep]
    new = np.ones(len(rows), bool)
    new[1:] = found[1:] != found[:-1]
    return rows, found, new


def _once(batches):
    """Each text once for a scan task."""
    seen: set[str] = set()
    for batch in batches:
        nodes = batch.column(0).to_pylist()
        take = []
        for i, node in enumerate(nodes):
            if node not in seen:
                seen.add(node)
                take.append(i)
        for lo in range(0, len(take), 1024):
            yield batch.take(pa.array(take[lo : lo + 1024]))


def _distinct(table: pa.Table) -> pa.Table:
    nodes = table.column("node").to_pylist()
    return table.take(pa.array(sorted({node: i for i, node in enumerate(nodes)}.values())))


def _parse(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per distinct text: its set's size, the shared n-grams of its prefix and all its shared n-grams by fragment."""
    n_blocks, shards = blocks.sizes(docs, "text")
    once = docs.where("text is not null").select(F.md5("text").alias("node"), "text").mapInArrow(_once, "node string, text string")
    dealt = once.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(n_blocks)).cast("int"))

    def ask(key, table):
        rows, found, new = _sets(_distinct(table), size)
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(found)))

        def extra(lo: int, hi: int) -> bytes:  # counts over one
            more = np.flatnonzero(counts[lo:hi] > 1)
            return more.astype("<u4").tobytes() + counts[lo:hi][more].astype("<u4").tobytes()

        return blocks.questions(key[0].as_py(), found[at], shards, extra)

    def answer(key, table):
        """Per block, a byte for each value: 0 for one document alone, else four steps for each doubling of the count."""
        parts = list(blocks.asked(table, shards))
        every, counts = np.concatenate([v for _, v, _ in parts]), []
        for _, v, e in parts:
            c = np.ones(len(v), np.int64)
            where, much = np.frombuffer(e, "<u4").reshape(2, -1)
            c[where] = much
            counts.append(c)
        values, group = np.unique(every, return_inverse=True)
        total = np.bincount(group, np.concatenate(counts), len(values))
        rarity = np.floor(4 * np.log2(total)).astype(np.uint8)[group]
        ends = np.cumsum([len(v) for _, v, _ in parts])
        return blocks.answers(key[0].as_py(), [(b, rarity[e - len(v) : e].tobytes()) for (b, v, _), e in zip(parts, ends, strict=True)])

    def finish(key, table, reply):
        table = _distinct(table)
        rows, found, new = _sets(table, size)
        rarity = np.frombuffer(b"".join(blocks.replies(reply)), np.uint8)[np.cumsum(new) - 1] if len(rows) else np.empty(0, np.uint8)
        n = np.bincount(rows, minlength=len(table))
        shared = rarity > 0
        alone = n - np.bincount(rows[shared], minlength=len(table))
        rows, found, rarity = rows[shared], found[shared], rarity[shared]
        order = np.lexsort((found, rarity, rows))
        rows, found = rows[order], found[order]
        first = np.searchsorted(rows, np.arange(len(table) + 1))
        pos = np.arange(len(rows)) - first[rows] + alone[rows]  # place in the row's whole order
        prefix = n - (percent * n + 99) // 100 + 1
        entry = pos < prefix[rows]
        candidate = np.zeros(len(table), bool)
        candidate[rows[entry]] = True
        values = found.view(np.int64)
        struct = pa.StructArray.from_arrays([pa.array(values[entry]), pa.array(pos[entry].astype(np.int32))], ["token", "pos"])
        out = {"node": table.column("node"), "n": pa.array(n, pa.int64()),
               "entries": pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[entry], np.arange(len(table) + 1)), pa.int32()), struct)}
        part = (found >> np.uint64(62)).astype(int)  # four fragments
        for i in range(FRAGMENTS):
            take = candidate[rows] & (part == i)
            out[f"f{i}"] = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[take], np.arange(len(table) + 1)), pa.int32()), pa.array(values[take]))
        return pa.table(out)

    asked = dealt.groupBy("block").applyInArrow(ask, blocks.QUESTION)
    answered = asked.groupBy("shard").applyInArrow(answer, blocks.ANSWER)
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(finish, _PARSED)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose overlaps, counted per fragment and summed, meet the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("frag").alias("frag"), F.col("tokens").alias("ta"), F.col("n").alias("na"))
    right = sets.select(F.col("node").alias("b"), "frag", F.col("tokens").alias("tb"), F.col("n").alias("nb"))
    partial = pairs.join(left, "a").join(right, ["b", "frag"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).alias("part"))
    summed = partial.groupBy("a", "b").agg(F.sum("part").alias("both"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return summed.where(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def _tagged(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Prefix entries of n-grams that still lie in several components, with the components."""
    if labels is None:
        tagged = entries.withColumn("comp", F.col("node"))
    else:
        tagged = entries.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    groups = tagged.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("head")).where("lo <> hi")
    return materialize(tagged.join(groups.select("token", "head"), "token"), "open")


def _star(rows: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of every node with its n-gram's centre of this turn, unless they are connected or of too different size."""
    centre = rows.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "comp")).alias("c"))
    both = rows.join(materialize(centre.select("token", F.col("c.node").alias("o_node"), F.col("c.n").alias("o_n"), F.col("c.comp").alias("o_comp")), "centres"), "token")
    return both.where("comp <> o_comp").select(F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"), "n", "o_n").distinct()


def _rest(rows: DataFrame, parsed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components that are left, all pairs considered.

    Nodes that share open n-grams form a cluster. Those outside a cluster's largest component are compared with all its nodes, in
    blocks of bounded size; a task returns one link for each node and component at most.
    """
    clusters = components(rows.select(F.col("node").alias("a"), F.col("head").alias("b")))
    nodes = rows.select("node", "comp", "n").distinct().join(clusters.withColumnRenamed("comp", "cluster"), "node")
    parts = nodes.groupBy("cluster", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("w")).groupBy("cluster").agg(F.sum("m").alias("m"), F.sum("w").alias("w"), F.max(F.struct("m", "comp", "w")).alias("main"))
    outside = F.greatest(F.ceil((F.col("m") - F.col("main.m")) / OUTLIERS), F.ceil((F.col("w") - F.col("main.w")) / OUTLIER_TOKENS))
    parts = parts.select("cluster", F.greatest(F.ceil(F.col("m") / NODES), F.ceil(F.col("w") / NODE_TOKENS)).alias("n_right"), outside.alias("n_left"), F.col("main.comp").alias("main"))
    held = nodes.join(materialize(parts, "clusters"), "cluster").join(parsed.select("node", *[f"f{i}" for i in range(FRAGMENTS)]), "node")
    held = materialize(held.withColumn("left", F.pmod(F.xxhash64("node"), "n_left").cast("int")).withColumn("right", F.pmod(F.xxhash64("node"), "n_right").cast("int")), "nodes")
    keep = ["cluster", "left", "right", "node", "comp", "n", *[f"f{i}" for i in range(FRAGMENTS)]]
    some = held.where("comp <> main").withColumn("right", F.explode(F.sequence(F.lit(0), (F.col("n_right") - 1).cast("int")))).select(*keep)
    every = held.withColumn("left", F.explode(F.sequence(F.lit(0), (F.col("n_left") - 1).cast("int")))).select(*keep)

    def compare(key, one, other):
        n, nodes_, comps = other.column("n").to_numpy(), other.column("node").to_pylist(), np.array(other.column("comp").to_pylist(), object)
        names, sizes, own = one.column("node").to_pylist(), one.column("n").to_numpy(), one.column("comp").to_pylist()
        both = np.zeros((len(names), len(nodes_)), np.int64)
        for i in range(FRAGMENTS if len(names) and len(nodes_) else 0):  # partial overlaps by fragment, summed
            mine, theirs = one.column(f"f{i}").combine_chunks(), other.column(f"f{i}").combine_chunks()
            values, at = np.unique(np.asarray(mine.flatten()), return_inverse=True)
            if not len(values):
                continue
            tokens = np.asarray(theirs.flatten())
            place = np.minimum(np.searchsorted(values, tokens), len(values) - 1)
            known = values[place] == tokens
            of = np.repeat(np.arange(len(nodes_)), np.diff(np.asarray(theirs.offsets)))[known]
            place, edges = place[known], np.asarray(mine.offsets) - np.asarray(mine.offsets)[0]
            for row in range(len(names)):
                has = np.zeros(len(values), bool)
                has[at[edges[row] : edges[row + 1]]] = True
                both[row] += np.bincount(of[has[place]], minlength=len(nodes_))
        a, b = [], []
        for row, name in enumerate(names):
            linked = np.flatnonzero((100 * both[row] >= percent * (sizes[row] + n - both[row])) & (comps != own[row]))
            for c in {comps[j]: j for j in linked.tolist()}.values():
                a.append(name)
                b.append(nodes_[c])
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    by = ["cluster", "left", "right"]
    return some.groupBy(*by).cogroup(every.groupBy(*by)).applyInArrow(compare, "a string, b string")


def _links(parsed: DataFrame, percent: int) -> DataFrame | None:
    """Components (node, comp) over all links between different texts; None where there is no candidate."""
    entries = materialize(parsed.select("node", "n", F.explode("entries").alias("e")).select("node", "n", "e.token"), "entries")
    frag = F.explode(F.array(*[F.struct(F.lit(i).alias("frag"), F.col(f"f{i}").alias("tokens")) for i in range(FRAGMENTS)]))
    sets = parsed.where(F.size("entries") > 0).select("node", "n", frag.alias("s")).select("node", "n", "s.frag", "s.tokens")
    links, labels = None, None
    for turn in range(STARS + 1):
        rows = _tagged(entries, labels)
        if rows.isEmpty():
            return labels
        if turn < STARS:
            pairs = _star(rows, turn).where(f"100 * least(n, o_n) >= {percent} * greatest(n, o_n)").select("a", "b")
            new = materialize(_verified(pairs, sets, percent), "links")
        else:
            new = materialize(_rest(rows, parsed, percent), "links")
        links = new if links is None else links.union(new)
        labels = components(links)
    return labels


def link(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key (MD5), n_shingles, component_key, component_id, n_members (rows of the
    component, itself included).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_key"))
    parsed = materialize(_parse(docs.select("text"), size, percent), "parsed")
    labels = _links(parsed, percent)
    sets = parsed.where("n > 0").select(F.col("node").alias("text_key"), F.col("n").alias("n_shingles"))
    if labels is None:
        sets = sets.withColumn("component_key", F.col("text_key"))
    else:
        sets = sets.join(labels.select(F.col("node").alias("text_key"), "comp"), "text_key", "left")
        sets = sets.withColumn("component_key", F.coalesce("comp", "text_key")).drop("comp")
    classes = base.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).join(sets, "text_key")
    groups = classes.groupBy("component_key").agg(F.min("least").alias("component_id"), F.sum("copies").alias("members"))
    named = classes.drop("least", "copies").join(groups, "component_key")
    out = base.join(named, "text_key", "left")
    return out.select("doc_id", "text_key", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "component_key",
                      F.when(F.col("component_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                      F.coalesce("members", F.lit(1)).cast("long").alias("n_members"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows with an empty set all stay."""
    linked = link(docs, size, percent)
    empty = linked.where("component_key is null").select("doc_id", "text_key").distinct()
    best = linked.where("component_key is not null").groupBy("component_key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("i"), "doc_id", "text_key")).alias("w"))
    prefix = "k_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    k_id, k_text, k_one = prefix + "id", prefix + "text", prefix + "one"
    keys = empty.select(F.col("doc_id").alias(k_id), F.col("text_key").alias(k_text), F.lit(False).alias(k_one))
    keys = keys.union(best.select("w.doc_id", "w.text_key", F.lit(True)))
    text_key = F.md5(F.coalesce(docs["text"], F.lit("")))
    joined = docs.join(keys, docs["doc_id"].eqNullSafe(keys[k_id]) & (text_key == keys[k_text]))
    one = joined.where(F.col(k_one)).dropDuplicates([k_id, k_text])
    return joined.where(~F.col(k_one)).unionByName(one).select(*docs.columns)
