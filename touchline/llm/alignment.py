"""Alignment of two tokenizers: which tokens of one lie over which of the other, and how often corpus-wide.

Tokenizer A is a byte-level one of the tokenizers library and gets a space and the text; B is a sentencepiece model, which adds that
space itself. Both are sequences over the same bytes. Where tokens of A and B end together a group ends; every two tokens with
common bytes are a link.

A text is cut into units: before a space that follows a character which is no white space, but for a text's last one, A's pattern and B's merges
both start anew (no piece goes on after ``▁``; checked when the model is read), so a unit has the same tokens alone as in its text. Equal units of
a block of texts are found by Arrow, encoded once, and aligned by array operations over all of them.

1. Texts are dealt into blocks of about ``BLOCK_BYTES`` as they come and written. Each block's distinct pairs (A id, B id) with their
   numbers of links form packed lists, one for each of ``CELLS`` cells of the hash space.
2. The lists' keys are united up a tree of fan-in ``FAN``; each cell's distinct pairs get a minimal perfect hash: at every level keys
   alone at their place of a bit array stay there, the others go on, and a key's number is the rank of its bit. Keys are kept
   by number, so that a look-up is verified.
3. Lists become dense vectors of counts indexed by that number, summed up the same tree.
4. Blocks ask the cells for their own pairs' counts and get each with the mark whether no other pair of its B id has more; the blocks
   are aligned again and sum what they find.

Bounds: a cell has at most ``|A| * |B| / CELLS`` pairs whatever the corpus; a task holds one block, or ``FAN`` lists of one cell. To the
tasks go the tokenizer files (``FILE_BYTES`` each at most) and one number per B id; pairs are never collected or broadcast.

Cases: texts that are NULL, empty, or that A or B doesn't give back byte by byte (as with ``▁`` in a text) have no tokens: zeros, and
groups are ''. Strings of special tokens are plain text. Repeated rows count each time. Texts may be of any length, also without
spaces. ``docs`` keeps all columns, whatever their names, but for a column named like the new one, which is refused.
"""

from __future__ import annotations

import json
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from touchline.llm import text
from touchline.plans.materialize import materialize

BLOCK_BYTES = 3 << 20
FILE_BYTES = 64 << 20
CELLS = 256
FAN = 64
GAMMA = 2  # places per key at each level of the hash
JOINT_BYTES = 1 << 14  # units are encoded in strings of about this size
LONG = 1 << 16  # longer strings, single units all of them, are left to the library that takes any length
SPACE = "▁"
# Fixed value: where byte-level tokenizers cut before they merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Characters beyond ASCII that are white space, as UTF-8.
_WHITE = [0xC285, 0xC2A0, 0xE19A80, 0xE1A08E, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
_U = np.uint64
_FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")] + [T.StructField("groups", T.StringType())])


class Units(NamedTuple):
    """The distinct units of some texts: numbers of tokens, groups and links, all links on end, and what the texts consist of."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    links: np.ndarray  # a * |B| + b
    tokens: tuple  # ids, ends in bytes and last token of each group, for both tokenizers
    at: np.ndarray  # the unit at each place
    first: np.ndarray  # the place of each text's first (one more at the end)


def _byte_of() -> dict[str, int]:
    """The byte of each character in which a byte-level vocabulary is written: printable ones are themselves, others follow U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}


def _ranks(spec: dict, byte: dict[str, int]) -> dict[bytes, int]:
    """Entries as bytes with their ids, which have to be in the order of the merges."""
    model, pre = spec["model"], spec["pre_tokenizer"]
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not spec["normalizer"]
    if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        raise ValueError("only byte-level merges by rank without a normaliser are read")
    return {bytes(byte[c] for c in entry): i for entry, i in vocab.items() if i < 256 + len(merges)}


class Aligner:
    """Both tokenizers; A by the rank-based library, which is several times faster, and long strings by the other."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        byte = _byte_of()
        entries = self.a.get_vocab(with_added_tokens=True)
        ranks = _ranks(json.loads(a_file), byte)
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            a_bytes[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        n = self.b.get_piece_size()
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(map(self.b.id_to_piece, range(n)))]
        if any(SPACE in self.b.id_to_piece(i).lstrip(SPACE) for i in range(n)):
            raise ValueError("pieces that go on after a space are not read")
        self.size_a, self.size_b = len(a_bytes), n
        self.bytes = [pa.array(x, pa.large_binary()) for x in (a_bytes, b_bytes)]
        self.sizes = [np.array([len(y) for y in x], np.int64) for x in (a_bytes, b_bytes)]
        # Ids as written in groups: A's before a comma and before the bar, B's before a comma, before the next group, and last.
        self.written = pa.array([f"{i}{end}" for size, ends in ((self.size_a, ",|"), (n, (",", ";", ""))) for end in ends for i in range(size)], pa.large_string())

    def _tokens(self, strings: list[str]) -> list[list[np.ndarray]]:
        a = [self.fast.encode_ordinary(s) if len(s) <= LONG else self.a.encode(s, add_special_tokens=False).ids for s in strings]
        return [[np.array(ids, np.int64) for ids in a], [np.array(ids, np.int64) for ids in self.b.encode([s[1:] for s in strings], num_threads=1)]]

    def _given_back(self, side: int, ids: np.ndarray, data: np.ndarray) -> bool:
        if self.sizes[side][ids].sum() != len(data):
            return False
        return np.array_equal(_content(self.bytes[side].take(pa.array(ids)))[0], data)

    def _encoded(self, data: np.ndarray, ends: np.ndarray, joint: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Which units are given back, and the ids of those on end, for A and for B.

        Neighbours of which the former ends in no white space are encoded as one string, as they would be within a text.
        """
        ok = np.ones(len(ends), bool)
        found: list[list[np.ndarray]] = [[], []]
        first = np.concatenate([[0], ends[:-1]])
        # A string ends with a unit that ends in white space, before the unit of empty texts, at a multiple of JOINT_BYTES, and last.
        stops = np.flatnonzero(~joint | np.append(ends[1:] - ends[:-1] == 1, True) | (ends // JOINT_BYTES != np.append(ends[1:], ends[-1:] + JOINT_BYTES) // JOINT_BYTES)) + 1 if len(ends) else np.empty(0, np.int64)
        for lo in range(0, len(stops), 16):
            of = stops[lo : lo + 16]
            units = np.concatenate([[stops[lo - 1] if lo else 0], of])
            spans = [data[first[i] : ends[j - 1]] for i, j in zip(units[:-1], units[1:], strict=True)]
            for i, j, span, *ids in zip(units[:-1], units[1:], spans, *self._tokens([x.tobytes().decode() for x in spans]), strict=True):
                if all(self._given_back(side, x, span) for side, x in enumerate(ids)):
                    for side in (0, 1):
                        found[side].append(ids[side])
                    continue
                for k in range(i, j):  # one of these units isn't given back
                    own = data[first[k] : ends[k]]
                    alone = [x[0] for x in self._tokens([own.tobytes().decode()])]
                    ok[k] = all(self._given_back(side, x, own) for side, x in enumerate(alone))
                    for side in (0, 1) if ok[k] else ():
                        found[side].append(alone[side])
        return ok, [np.concatenate([np.empty(0, np.int64), *x]) for x in found]

    def units(self, values: pa.Array | pa.ChunkedArray) -> Units:
        wide = pa.large_string()
        data, offsets = text.buffers(pc.binary_join_element_wise(pa.scalar(" ", wide), pc.fill_null(values, "").cast(wide), pa.scalar("", wide)))
        starts = _starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
        encoded = column.dictionary_encode()
        own, ends = _content(encoded.dictionary)
        ok, ids = self._encoded(own, ends, _no_white_before(own, ends))
        # Places of the units given back, all on end.
        sizes = np.diff(np.concatenate([[0], ends]))
        kept = np.flatnonzero(ok)
        unit_ends = np.cumsum(sizes[kept])
        token_ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids, strict=True)]
        is_end = [np.zeros(int(sizes[kept].sum()) + 1, bool) for _ in ids]
        for mark, x in zip(is_end, token_ends, strict=True):
            mark[x] = True
        either, both = np.flatnonzero(is_end[0] | is_end[1]), np.flatnonzero(is_end[0] & is_end[1])
        a, b = (x[np.searchsorted(e, either)] for x, e in zip(ids, token_ends, strict=True))

        def per_unit(at):
            out = np.zeros(len(ok), np.int64)
            out[kept] = np.diff(np.searchsorted(at, np.concatenate([[0], unit_ends]), "right"))
            return out

        numbers = [per_unit(x) for x in (*token_ends, both, either)]
        last = [np.searchsorted(e, both) for e in token_ends]
        at_unit_end = np.zeros(len(is_end[0]), bool)
        at_unit_end[unit_ends] = True
        return Units(ok, *numbers, a * self.size_b + b, (ids, last, at_unit_end[both]), encoded.indices.to_numpy().astype(np.int64), np.searchsorted(starts, offsets))

    def groups(self, units: Units) -> pa.Array:
        """Each unit's groups as written."""
        ids, last, closes = units.tokens
        closing = [np.zeros(len(x), np.int64) for x in ids]
        closing[0][last[0]] = 1
        closing[1][last[1]] = np.where(closes, 2, 1)
        # A group's tokens of A come before its tokens of B.
        group = [np.searchsorted(e, np.arange(len(x))) for e, x in zip(last, ids, strict=True)]
        through = [np.concatenate([[0], e + 1]) for e in last]
        order = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        order[np.arange(len(ids[0])) + through[1][group[0]]] = ids[0] + self.size_a * closing[0]
        order[np.arange(len(ids[1])) + through[0][group[1] + 1]] = 2 * self.size_a + ids[1] + self.size_b * closing[1]
        ends = np.concatenate([[0], np.cumsum(units.n_a + units.n_b)])
        return _joined(self.written.take(pa.array(order)), ends, "")


def _content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary column on end, and each row's end."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _joined(strings: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), pa.scalar(by, pa.large_string()))


def _no_white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is certainly no white space; False at the first three places."""
    late = at >= 3
    if not late.any():
        return late
    at = np.maximum(at, 3)
    last = data[at - 1].astype(np.int32)
    two = (data[at - 2].astype(np.int32) << 8) | last
    three = (data[at - 3].astype(np.int32) << 16) | two
    return late & (((last > 0x20) & (last < 0x7F)) | ((last >= 0x80) & ~np.isin(two, _WHITE) & ~np.isin(three, _WHITE)))


def _starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the units: of every text, and spaces after a character that is no white space."""
    at = np.flatnonzero(data == 0x20)
    begins = np.zeros(len(data), bool)
    begins[at[_no_white_before(data, at)]] = True
    begins[offsets[1:] - 1] = False  # a last space has no token of B without what is before it
    begins[offsets[:-1]] = True
    return np.flatnonzero(begins)


def _whole(units: Units) -> np.ndarray:
    """Whether each text consists of units that both tokenizers give back."""
    bad = np.concatenate([[0], np.cumsum(~units.ok[units.at])])
    return bad[units.first[1:]] == bad[units.first[:-1]]


def _counted(aligner: Aligner, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of some texts, ascending, with their numbers of links."""
    units = aligner.units(values)
    times = np.bincount(units.at[np.repeat(_whole(units), np.diff(units.first))], minlength=len(units.ok))
    return _summed(units.links, np.repeat(times, units.n_links))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts; those of 0 go."""
    order = np.argsort(keys, kind="stable")
    keys, total = keys[order], np.concatenate([[0], np.cumsum(counts[order])])
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    sums = np.diff(total[edges])
    return keys[edges[:-1]][sums > 0], sums[sums > 0]


# --- minimal perfect hashing -----------------------------------------------------------------


def _hashed(keys: np.ndarray, level: int) -> np.ndarray:
    return text.mix(keys.astype(_U) + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))


def cell_of(keys: np.ndarray) -> np.ndarray:
    return ((_hashed(keys, -1) >> _U(32)) * _U(CELLS) >> _U(32)).astype(np.int32)


def _place(keys: np.ndarray, level: int, words: int) -> np.ndarray:
    return ((_hashed(keys, level) >> _U(32)) * _U(64 * words) >> _U(32)).astype(np.int64)


class PerfectHash:
    """Numbers 0 .. n - 1 for n distinct keys; for other keys any number or -1."""

    def __init__(self, words: np.ndarray, sizes: list[int]):
        self.words, self.sizes = words, sizes
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        words, sizes = [np.empty(0, _U)], []
        while len(keys):
            size = -(-GAMMA * len(keys) // 64)
            at = _place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=64 * size) == 1
            words.append(np.packbits(alone, bitorder="little").view(_U))
            keys = keys[~alone[at]]
            sizes.append(size)
        return cls(np.concatenate(words), sizes)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out, left, first = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = _place(keys[left], level, size)
            word, bit = self.words[first + (at >> 6)], (at & 63).astype(_U)
            here = (word >> bit) & _U(1) == 1
            out[left[here]] = (self.rank[first + (at >> 6)] + np.bitwise_count(word & ((_U(1) << bit) - _U(1))))[here]
            left, first = left[~here], first + size
        return out


def _look_up(cell: dict, keys: np.ndarray) -> np.ndarray:
    """The keys' numbers in a cell's table; a key that isn't there is an error."""
    at = PerfectHash(np.frombuffer(cell["words"], _U), cell["sizes"]).numbers(keys)
    if (at < 0).any() or (np.asarray(cell["keys"])[at] != keys).any():
        raise KeyError("a pair has no number")
    return at


# --- tables --------------------------------------------------------------------------------


def _flat(column: pa.ChunkedArray, kind=np.int64) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *[c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]]).astype(kind)


def _row(**columns) -> pa.Table:
    kinds = {"cell": pa.int32(), "at": pa.int32(), "words": pa.binary(), "sizes": pa.list_(pa.int32())}
    return pa.table({k: pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in columns.items()})


def _up(rows: DataFrame, groups: int, merge, schema: str) -> DataFrame:
    """Rows (cell, at, ..) of each cell merged up a tree until one is left."""
    while groups > 1:
        groups = -(-groups // FAN)
        rows = rows.withColumn("at", F.floor(F.col("at") / FAN).cast("int")).groupBy("cell", "at").applyInArrow(merge, schema)
    return rows


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(handle) -> Aligner:
    """The tokenizers of a broadcast, made once per worker."""
    key, a_file, b_file = handle.value
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_file, b_file)
    return _ALIGNERS[key]


class Corpus(NamedTuple):
    """Blocks (row, block) of the documents, each block's pairs by cell (cell, block, at, keys, counts), and the cells' tables."""

    blocks: DataFrame
    lists: DataFrame
    groups: int
    tables: DataFrame
    handle: object
    size_b: int


def count(docs: DataFrame, a_path: str, b_path: str) -> Corpus:
    """The first pass over ``docs`` and the tables (cell, words, sizes, keys, counts) of all pairs."""
    spark = docs.sparkSession
    files = []
    for path in (a_path, b_path):
        with open(path, "rb") as f:  # on the driver; tasks get the broadcast
            files.append(f.read(FILE_BYTES + 1))
        if len(files[-1]) > FILE_BYTES:
            raise ValueError(f"{path} is larger than FILE_BYTES")
    size_b = sentencepiece.SentencePieceProcessor(model_proto=files[1]).get_piece_size()
    handle = spark.sparkContext.broadcast((uuid.uuid4().hex, *files))

    def deal(batches):
        task, total = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            ends = total + np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(task + (ends - sizes) // BLOCK_BYTES)], ["row", "block"])

    dealt = T.StructType([T.StructField("row", docs.schema), T.StructField("block", T.LongType())])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    blocks = materialize(rows.mapInArrow(deal, dealt), "blocks")

    def gather(batches):
        block, held = None, []

        def packed():
            keys, counts = _summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            cells = cell_of(keys)
            order = np.argsort(cells, kind="stable")
            present, first = np.unique(cells[order], return_index=True)
            ends = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order])) for x in (keys, counts)]
            return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array([block] * len(present), pa.int64()), *lists], ["cell", "block", "keys", "counts"])

        for batch in batches:
            numbers = batch.column("block").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1], [True]])) if len(numbers) else []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held and numbers[lo] != block:
                    yield packed()
                    held = []
                block = int(numbers[lo])
                held.append(_counted(_aligner(handle), batch.column("text").slice(lo, hi - lo)))
        if held:
            yield packed()

    lists = materialize(blocks.select(F.col("row.text").alias("text"), "block").mapInArrow(gather, "cell int, block long, keys array<long>, counts array<long>"), "lists")
    groups = max(1, -(-lists.select("block").distinct().count() // FAN))
    lists = lists.withColumn("at", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))

    def united(key, t):
        return _row(cell=key[0].as_py(), at=key[1].as_py(), keys=np.unique(_flat(t.column("keys"))))

    def numbered(key, t):
        keys = np.unique(_flat(t.column("keys")))
        made = PerfectHash.build(keys)
        in_order = np.empty_like(keys)
        in_order[made.numbers(keys)] = keys
        return _row(cell=key[0].as_py(), words=made.words.tobytes(), sizes=made.sizes, keys=in_order)

    known = "cell int, at int, keys array<long>"
    keys = _up(lists.select("cell", "at", "keys").groupBy("cell", "at").applyInArrow(united, known), groups, united, known)
    functions = materialize(keys.groupBy("cell").applyInArrow(numbered, "cell int, words binary, sizes array<int>, keys array<long>"), "functions")

    def dense(key, own, table):
        cell = table.to_pylist()[0]
        vector = np.zeros(len(cell["keys"]), np.int64)
        np.add.at(vector, _look_up(cell, _flat(own.column("keys"))), _flat(own.column("counts")))
        return _row(cell=key[0].as_py(), at=key[1].as_py(), counts=vector)

    def added(key, t):
        return _row(cell=key[0].as_py(), at=key[1].as_py(), counts=sum(_each(t.column("counts"))))

    known = "cell int, at int, counts array<long>"
    vectors = _meet(lists, functions, groups, dense, known)
    tables = materialize(functions.join(_up(vectors, groups, added, known).drop("at"), "cell"), "tables")
    return Corpus(blocks, lists, groups, tables, handle, size_b)


def _each(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Each row's list."""
    return [c.slice(i, 1).flatten().to_numpy() for c in column.chunks for i in range(len(c))]


def _meet(lists: DataFrame, tables: DataFrame, groups: int, work, schema: str) -> DataFrame:
    """Each group of a cell's lists together with the cell's table."""

    def both(key, own, table):
        if own.num_rows and table.num_rows:
            return work(key, own, table)
        return pa.table({n: pa.array([], k) for n, k in zip(empty.names, empty.types, strict=True)})

    empty = pa.schema([(f.name, {"int": pa.int32(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_())}[f.dataType.simpleString()])
                       for f in T.StructType.fromDDL(schema)])
    every = tables.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return lists.groupBy("cell", "at").cogroup(every.groupBy("cell", "at")).applyInArrow(both, schema)


def pair_counts(corpus: Corpus) -> DataFrame:
    """(a, b, n): every pair that a link holds together, with its number of links."""
    pairs = corpus.tables.select(F.explode(F.arrays_zip("keys", "counts")).alias("p")).select("p.*")
    size = F.lit(corpus.size_b)
    return pairs.select(F.expr(f"keys div {corpus.size_b}").alias("a"), (F.col("keys") % size).alias("b"), F.col("counts").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, into: str = "aligned") -> DataFrame:
    """``docs`` with the struct ``into``: n_a, n_b, n_groups, n_links, n_best, count_sum, and groups as ``a1,a2|b1;a3|b2,b3``."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {into}; name another one in into")
    corpus = count(docs, a_path, b_path)
    handle, size_b = corpus.handle, corpus.size_b
    most = np.zeros(size_b, np.int64)  # one number per B id
    for r in pair_counts(corpus).groupBy("b").agg(F.max("n").alias("n")).collect():
        most[r["b"]] = r["n"]

    def answers(key, own, table):
        cell = table.to_pylist()[0]
        rows = []
        for block, of in zip(own.column("block").to_pylist(), _each(own.column("keys")), strict=True):
            counts = np.asarray(cell["counts"], np.int64)[_look_up(cell, of)]
            rows.append((block, of, counts, counts == most[of % size_b]))
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("block", "keys", "counts", "best"), kinds, strict=True))})

    told = _meet(corpus.lists.drop("counts"), corpus.tables, corpus.groups, answers, "block long, keys array<long>, counts array<long>, best array<boolean>")

    def realign(key, block, known):
        row = block.column("row").combine_chunks()
        aligner = _aligner(handle)
        units = aligner.units(pc.struct_field(row, "text"))
        whole = _whole(units)
        keys, counts, best = _flat(known.column("keys")), _flat(known.column("counts")), _flat(known.column("best"))
        order = np.argsort(keys)
        keys, counts, best = keys[order], counts[order], best[order]
        place = np.searchsorted(keys, units.links)
        here = place < len(keys)
        here[here] = keys[place[here]] == units.links[here]  # pairs of texts that are not given back have no count
        ends = np.cumsum(np.concatenate([[0], units.n_links]))

        def per_unit(of):
            values = np.zeros(len(units.links), np.int64)
            values[here] = of[place[here]]
            return np.diff(np.concatenate([[0], np.cumsum(values)])[ends])

        def per_text(of):
            total = np.concatenate([[0], np.cumsum(of[units.at])])
            return pa.array(np.where(whole, total[units.first[1:]] - total[units.first[:-1]], 0), pa.int64())

        numbers = [units.n_a, units.n_b, units.n_groups, units.n_links, per_unit(best), per_unit(counts)]
        joined = _joined(aligner.groups(units).take(pa.array(units.at)), units.first, ";")
        groups = pc.if_else(pa.array(whole), joined, pa.scalar("", pa.large_string())).cast(pa.string())
        return pa.table({"row": row, "found": pa.StructArray.from_arrays([*map(per_text, numbers), groups], _FOUND.names)})

    out = T.StructType([T.StructField("row", docs.schema), T.StructField("found", _FOUND)])
    done = corpus.blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(realign, out)
    return done.select("row.*", F.col("found").alias(into))
