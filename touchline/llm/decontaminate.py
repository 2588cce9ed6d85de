"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, texts scanned once.

Words are ``[0-9a-z]`` or beyond ASCII after lower-casing A-Z. A window is ``window`` consecutive words of an item; a shorter item
is one window. Windows become patterns of space-bounded words; a text is normalised the same way, scanned once, and each match is
mapped back to word numbers and to character offsets of the original text.

The patterns go to the tasks as one broadcast of at most ``AUTOMATON_BYTES``. A larger benchmark is dealt into several such parts
by hash and texts pass through one automaton after the other; each merges its findings into the row, so nothing is grouped.

Cases: NULL and wordless texts have no words and no hits. NULL items and wordless items have no window. Several items with one
window are all reported; repeated items count once. ``docs`` keeps all its columns, whatever their names; findings come in one
struct column whose name the caller may choose.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import text

AUTOMATON_BYTES = 16 << 20
_FOUND = "n_words long, hits array<struct<start:long,stop:long>>, chars array<struct<start:long,stop:long>>, items array<long>"
_WORD_BYTES = bytes(int(text.LOWER[b]) if text.ALNUM[b] else 0x20 for b in range(256))


def normal(value: str | None) -> str:
    """The words between single spaces, with one at either end; a byte is a character."""
    words = (value or "").encode().translate(_WORD_BYTES).split(b" ")
    return " " + "".join(w.decode("latin-1") + " " for w in words if w)


def windows(items: DataFrame, window: int) -> DataFrame:
    """(item_id, phrase): each item's distinct windows as space-bounded words."""

    def cut(batches):
        for batch in batches:
            out = []
            for item, value in zip(batch["item_id"], batch["text"], strict=True):
                words = [w for w in normal(value).split(" ") if w]  # bytes 85 and A0 are white space to a bare split()
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    out.append((item, " " + " ".join(words[i : i + window]) + " "))
            yield pd.DataFrame(out, columns=["item_id", "phrase"])

    rows = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInPandas(cut, "item_id long, phrase string").distinct()


_BUILT: dict = {}


def _automaton(handle):
    """The automaton of a broadcast, built once per worker."""
    if _BUILT.get("key") != handle.value[0]:
        made = ahocorasick.Automaton()
        for phrase, items in handle.value[1]:
            made.add_word(phrase, (len(phrase), items))
        if len(made):
            made.make_automaton()
        _BUILT.update(key=handle.value[0], made=made)
    return _BUILT["made"]


def _char_spans(value: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as character offsets of the original."""
    raw = value.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = text.words(data, np.array([0, len(data)]), text.ALNUM)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


def _scan(value: str | None, made) -> tuple[int, list, list, list]:
    line = normal(value)
    n = line.count(" ") - 1
    if not n or not len(made):
        return n, [], [], []
    change, items = None, set()
    for end, (size, of) in made.iter(line):
        if change is None:
            change, number = np.zeros(n + 1, np.int32), np.cumsum(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        a = int(number[end - size + 1]) - 1  # the word after the pattern's first space
        change[a] += 1
        change[int(number[end]) - 1] -= 1
        items.update(of)
    if change is None:
        return n, [], [], []
    hit = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)
    runs = [(int(a), int(b)) for a, b in edges]
    return n, runs, _char_spans(value, runs), sorted(items)


def _scanner(handle):
    """A function from a text column to its findings by the automaton of ``handle``."""

    @F.arrow_udf(f"struct<{_FOUND}>")
    def scan(values: pa.Array) -> pa.Array:
        made = _automaton(handle)
        rows = [_scan(v, made) for v in values.to_pylist()]
        spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        named = [[[{"start": a, "stop": b} for a, b in r[k]] for r in rows] for k in (1, 2)]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array(named[0], spans), pa.array(named[1], spans),
                                           pa.array([r[3] for r in rows], pa.list_(pa.int64()))], ["n_words", "hits", "chars", "items"])

    return scan


def find(docs: DataFrame, items: DataFrame, window: int = 10, into: str = "found") -> DataFrame:
    """``docs`` with the struct ``into``: n_words, hit word runs, the same as characters, and the items found."""
    spark = docs.sparkSession
    pairs = windows(items, window)
    total = pairs.agg(F.sum(F.length("phrase") + 64).alias("n")).first()["n"] or 0
    parts = max(1, -(-total // AUTOMATON_BYTES))
    out = docs
    for part in range(parts):
        chosen = pairs.where(F.pmod(F.xxhash64("phrase", "item_id"), F.lit(parts)) == part)
        patterns = [(r["phrase"], r["ids"]) for r in chosen.groupBy("phrase").agg(F.collect_list("item_id").alias("ids")).collect()]
        handle = spark.sparkContext.broadcast((uuid.uuid4().hex, patterns))

        scan = _scanner(handle)
        if part == 0:
            out = out.withColumn(into, scan("text"))
        else:
            both = F.struct(F.col(into).alias("x"), scan("text").alias("y"))
            out = out.withColumn(into, F.arrow_udf(_merged, f"struct<{_FOUND}>")(both))
    return out


def _merged(both: pa.Array) -> pa.Array:
    """Two findings of one text: runs joined where they meet or overlap, items of either."""

    def join(runs):
        out: list[dict] = []
        for r in sorted(runs, key=lambda r: (r["start"], r["stop"])):
            if out and r["start"] <= out[-1]["stop"]:
                out[-1] = {"start": out[-1]["start"], "stop": max(out[-1]["stop"], r["stop"])}
            else:
                out.append(dict(r))
        return out

    rows = []
    for r in both.to_pylist():
        x, y = r["x"], r["y"]
        rows.append({"n_words": x["n_words"], "hits": join(x["hits"] + y["hits"]), "chars": join(x["chars"] + y["chars"]),
                     "items": sorted({*x["items"], *y["items"]})})
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.array(rows, pa.struct([("n_words", pa.int64()), ("hits", spans), ("chars", spans), ("items", pa.list_(pa.int64()))]))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of any item."""
    name, taken = "found", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return find(docs, items, window, name).where(F.size(f"{name}.hits") == 0).select(*docs.columns)
