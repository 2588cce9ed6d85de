"""Substring dedup by membership of word windows in indexed reference blocks.

Documents are cut by ``doc_id`` into reference blocks. Each block's index is the sorted list of the hashes of its word windows.
Every window of a document is looked up in all earlier blocks and the earlier part of its own, and the words of windows found go.
This takes the place of relative Lempel-Ziv factors: a run of found windows need not be one passage of any reference, no source or
position is kept, and words are not compared beyond the hashes of their windows.

Exactness: windows are compared by 64-bit hashes; two different windows meet with a chance of 2**-64 per pair.
Text moves once; hashes move as packed lists (see :mod:`blocks`), one entry per block and window, so a passage that a third of
all documents share costs one entry per block.

Cases: NULL or empty text has no words. Rows with the same ``doc_id`` count as one document: a window is earlier in it only at a
smaller start. Rows without an id come after all others, as one document. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import blocks, text

RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string"
LAST = np.iinfo(np.int64).max


def _read(table: pa.Table, window: int):
    """The block's rows in document order with their words, windows and the windows' groups."""
    ids = np.array([LAST if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    table = table.take(pa.array(np.argsort(ids, kind="stable")))
    ids = np.sort(ids, kind="stable")
    data, offsets = text.buffers(table.column("text"))
    starts, ends, first = text.words(data, offsets, text.NOT_SPACE)
    at, hashes = text.window_hashes(text.word_hashes(data, starts, ends), first, window)
    row = np.searchsorted(first, at, "right") - 1
    if (np.diff(ids) == 0).any():  # several rows of one id: order by id, then start within the row
        order = np.lexsort((at - first[row], ids[row], hashes))
    else:
        order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    return table, ids, data, offsets, starts, ends, first, at, row, order, new, sorted_hashes[new]


def drop_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): word counts, removed word spans and the kept words joined by one space."""
    n_blocks, shards = blocks.sizes(docs, "text")
    marks = [i / n_blocks for i in range(1, n_blocks)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), marks, 100 * n_blocks).alias("b")).first()["b"] or []
    bounds = np.unique(np.array(found, np.int64))

    @F.arrow_udf("int")
    def block_of(ids: pa.Array) -> pa.Array:
        values = np.array(ids.fill_null(LAST))
        return pa.array(np.searchsorted(bounds, values).astype(np.int32))

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", block_of("doc_id"))

    def ask(key, table):
        return blocks.questions(key[0].as_py(), _read(table, window)[-1], shards)

    def answer(key, table):
        """Per block, a bit for each value: some earlier block holds it."""
        parts = list(blocks.asked(table, shards))
        every = np.concatenate([v for _, v, _ in parts])
        order = np.argsort(every, kind="stable")
        again = np.zeros(len(every), bool)
        again[order[1:]] = every[order[1:]] == every[order[:-1]]
        ends = np.cumsum([len(v) for _, v, _ in parts])
        return blocks.answers(key[0].as_py(), [(b, np.packbits(again[e - len(v) : e]).tobytes()) for (b, v, _), e in zip(parts, ends, strict=True)])

    def parse(key, table, reply):
        table, ids, data, offsets, starts, ends, first, at, row, order, new, values = _read(table, window)
        sizes = np.diff(blocks.cuts(values, shards)[0])
        bits = [np.unpackbits(np.frombuffer(r, np.uint8), count=n) for r, n in zip(blocks.replies(reply), sizes[sizes > 0], strict=True)]
        elsewhere = np.concatenate(bits).astype(bool) if bits else np.empty(0, bool)
        group = np.cumsum(new) - 1
        head = order[np.flatnonzero(new)][group] if len(order) else order  # the first window of each one's group
        own = (ids[row[order]] > ids[row[head]]) | ((at - first[row])[order] > (at - first[row])[head])
        repeated = np.zeros(len(at), bool)
        repeated[order] = elsewhere[group] | own if len(order) else False
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, at[repeated], 1)
        np.add.at(change, at[repeated] + window, -1)
        gone = np.cumsum(change[:-1]) > 0
        return _result(table, data, offsets, starts, ends, first, gone)

    asked = dealt.groupBy("block").applyInArrow(ask, blocks.QUESTION)
    answered = asked.groupBy("shard").applyInArrow(answer, blocks.ANSWER)
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(parse, RESULT)


def _result(table, data, offsets, starts, ends, first, gone) -> pa.Table:
    n = np.diff(first)
    removed = np.concatenate([[0], np.cumsum(gone)])
    n_removed = removed[first[1:]] - removed[first[:-1]]
    # Kept words with the byte after each made a space; a word at its row's end has none and is last.
    keep = np.flatnonzero(~gone)
    out, change = data.copy(), np.zeros(len(data) + 2, np.int8)
    row_end = np.repeat(offsets[1:], n)
    spaced = keep[ends[keep] < row_end[keep]]
    out[ends[spaced]] = 0x20
    change[starts[keep]] += 1
    stops = ends[keep] + (ends[keep] < row_end[keep])
    np.add.at(change, stops, -1)
    mask = np.cumsum(change[: len(data)], dtype=np.int8) > 0
    count = np.concatenate([[0], np.cumsum(mask)])
    flat = out[mask].tobytes()
    a, b = count[offsets[:-1]], count[offsets[1:]]
    kept = [flat[i:j].rstrip(b" ").decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    # Spans of removed words, cut at row ends.
    edge = gone.copy()
    if len(gone):
        begins = first[:-1][n > 0]
        edge[1:] &= ~gone[:-1]
        edge[begins] = gone[begins]
        close = gone.copy()
        close[:-1] &= ~gone[1:]
        lasts = first[1:][n > 0] - 1
        close[lasts] = gone[lasts]
    else:
        close = edge
    lo, hi = np.flatnonzero(edge), np.flatnonzero(close) + 1
    of = np.searchsorted(lo, first)
    base = first[np.searchsorted(first, lo, "right") - 1] if len(lo) else lo
    pairs = pa.StructArray.from_arrays([pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64())], ["start", "stop"])
    return pa.table({
        "doc_id": table.column("doc_id"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
        "spans": pa.ListArray.from_arrays(pa.array(of, pa.int32()), pairs), "kept": pa.array(kept, pa.string())})
