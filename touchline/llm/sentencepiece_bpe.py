"""SentencePiece encoding and decoding for merge-type vocabularies, from the model file alone.

A text is prefixed with a space, spaces become ``▁``, and it is cut before each run of ``▁`` and between words and ASCII marks: no piece of
the vocabulary holds such a place (read from the model's pieces), so no merge crosses a cut. In each part an
agenda of adjacent symbol pairs, ordered by score and then by place, merges the best pair until none is in the vocabulary. The
distinct short parts of a piece of the batch go together, an agenda to a row of a matrix, one merge of each row at a time; parts
are remembered in a bounded table. Symbols that stay unknown become bytes. With ``check`` each Arrow batch is compared with the
sentencepiece library's own result and the outcome is a column; the query and the pipeline do so over whole tables.

The model goes to the tasks as one broadcast of the file (half a megabyte; ``MODEL_BYTES`` is the most accepted).

Cases: NULL counts as empty; empty text has no ids and decodes to ''. Texts may be of any length. All columns of ``docs`` stay.
"""

from __future__ import annotations

import gc
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import text

MODEL_BYTES = 64 << 20
PIECE_BYTES = 1 << 19  # of text whose parts are merged together; a longer text is a piece of its own
REMEMBERED = 250_000
WIDTHS = (8, 12, 16, 24, 48)  # most characters of the parts that share a matrix
SHORT = WIDTHS[-1]
NEVER = np.iinfo(np.int32).max  # rank of a pair that is no piece
SPACE = "▁"
RESULT = "struct<ids:array<int>,decoded:string,agrees:boolean>"


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message."""
    i = 0

    def number():
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, raw[i : i + size]
        i += size


class Codec:
    """Encoder and decoder of one model."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces in the file format

    def __init__(self, model: bytes):
        self.model, self.pieces, self.kinds, scores, options, spec = model, [], [], [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, self.NORMAL))
            elif number == 2:
                options = dict(_fields(value))
            elif number == 3:
                spec = dict(_fields(value))
        if options.get(3, 1) != 2 or spec.get(1, b"") != b"identity" or spec.get(4, 1) or spec.get(5, 1) != 1:
            raise ValueError("only merge-type models with identity normalisation that keep spaces are read")
        if any(k in (self.USER, self.UNUSED) for k in self.kinds):
            raise ValueError("user-defined and unused pieces are not read")
        self.dummy = bool(spec.get(3, 1))
        self.rank = {p: -s for p, s, k in zip(self.pieces, scores, self.kinds, strict=True) if k == self.NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.NORMAL}
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == self.BYTE}
        self.value = {i: b for b, i in self.byte.items()}
        self.cut = re.compile(self._cuts())
        # Two generations of ids as bytes: when the newer is full it becomes the older, so frequent parts are soon known again.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self._pair_table()
        # Pieces that decode by themselves: words and single-byte characters.
        self.plain = [chr(self.value[i]) if self.value.get(i, 128) < 128 else None if i in self.value or k != self.NORMAL else p.replace(SPACE, " ")
                      for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        self.library = None

    def _cuts(self) -> str:
        """Pattern of the parts: none ends between two characters that stand side by side in a piece."""
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            return r"(?s:.+)"
        beside: dict[str, set[str]] = {}
        for p in self.id:
            for a, b in zip(p, p[1:], strict=False):
                beside.setdefault(a, set()).add(b)
                beside.setdefault(b, set()).add(a)
        marks = {c for c in map(chr, range(128)) if not c.isalnum() and not any(x.isascii() and x.isalnum() for x in beside.get(c, ()))}
        joined = {x for c in marks for x in beside.get(c, ())} - marks - {SPACE}  # other characters that stand beside a mark in a piece
        mark, join = (re.escape("".join(sorted(x))) for x in (marks, joined))
        ends = f"(?![{join}])" if join else ""
        return "|".join([f"{SPACE}*(?:[^{SPACE}{mark}{join}]++{ends}", *([f"[{mark}]++{ends}"] if mark else []), f"[^{SPACE}]+)", f"{SPACE}+"])

    def _pair_table(self) -> None:
        """Numbers of symbols (pieces by their ids, then other characters of pieces, then one for all that is in no piece) and the pairs that make a piece."""
        number = dict(self.id)
        for c in sorted({c for p in self.id for c in p}):
            number.setdefault(c, len(self.pieces) + len(number) - len(self.id))
        self.lone = len(self.pieces) + len(number) - len(self.id)
        self.symbol = np.full(0x110000, self.lone, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.symbol[ord(c)] = i
        place = {r: i for i, r in enumerate(sorted(set(self.rank.values())))}
        pairs = sorted((number[p[:i]] * (self.lone + 1) + number[p[i:]], place[self.rank[p]], self.id[p])
                       for p in self.id for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.pair, self.pair_rank, self.pair_symbol = (np.array([*column, last], kind) for column, last, kind in zip(
            zip(*pairs, strict=True) if pairs else ((), (), ()), (np.iinfo(np.int64).max, NEVER, self.lone), (np.int64, np.int32, np.int32), strict=True))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``NEVER``: no piece) and the symbol it makes."""
        key = left.astype(np.int64) * (self.lone + 1) + right
        at = np.searchsorted(self.pair, key)
        return np.where(self.pair[at] == key, self.pair_rank[at], NEVER), self.pair_symbol[at]

    def merged_together(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of short parts after all merges, a row for each, and how many they are: best score first, leftmost on ties."""
        width = max(map(len, parts))
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        out = self.symbol[np.array(parts, f"U{width}").view(np.uint32).reshape(len(parts), width)]
        out[np.arange(width) >= size[:, None]] = self.lone  # merges with nothing
        rows, symbols = np.arange(len(parts)), out
        rank, makes = self._ranks(symbols[:, :-1], symbols[:, 1:])
        while rank.shape[1]:
            best = rank.argmin(1)
            goes = rank[np.arange(len(rows)), best] != NEVER
            if not goes.all():
                out[rows[~goes], : symbols.shape[1]] = symbols[~goes]
                rows, symbols, rank, makes, best = rows[goes], symbols[goes], rank[goes], makes[goes], best[goes]
                if not len(rows):
                    break
            line, later = np.arange(len(rows)), np.arange(rank.shape[1]) >= best[:, None]
            joined = makes[line, best]
            symbols = np.where(later, symbols[:, 1:], symbols[:, :-1])
            symbols[line, best] = joined
            size[rows] -= 1
            rank, makes = (np.where(later[:, :-1], x[:, 1:], x[:, :-1]) for x in (rank, makes))
            for first in (best - 1, best):  # the pairs that the new symbol is in
                has = (first >= 0) & (first < rank.shape[1])
                i, j = line[has], first[has]
                rank[i, j], makes[i, j] = self._ranks(symbols[i, j], symbols[i, j + 1])
        else:
            out[rows, : symbols.shape[1]] = symbols
        return out, size

    def merged(self, part: str) -> list[str]:
        """A long part's symbols after all merges: best score first, leftmost on ties."""
        rank, push, pop = self.rank, heapq.heappush, heapq.heappop
        symbols: list[str] = list(part)
        last = len(symbols) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        agenda = [(rank[pair], i, pair) for i, pair in enumerate(map(str.__add__, symbols, symbols[1:])) if pair in rank]
        heapq.heapify(agenda)
        while agenda:
            _, a, joined = pop(agenda)
            b = after[a]
            if b > last or not symbols[a] or symbols[a] + symbols[b] != joined:
                continue
            symbols[a], symbols[b] = joined, ""
            c = after[a] = after[b]
            if c <= last:
                before[c] = a
                pair = joined + symbols[c]
                if pair in rank:
                    push(agenda, (rank[pair], a, pair))
            z = before[a]
            if z >= 0:
                pair = symbols[z] + joined
                if pair in rank:
                    push(agenda, (rank[pair], z, pair))
        return [s for s in symbols if s]

    def _ids(self, symbols: list[str]) -> bytes:
        """Ids of symbols, those that are no piece as their bytes."""
        out: list[int] = []
        for symbol in symbols:
            if symbol in self.id:
                out.append(self.id[symbol])
            elif self.byte:
                out.extend(self.byte[b] for b in symbol.encode())
            else:
                out.append(self.unknown)
        return np.array(out, "<i4").tobytes()

    def _cut_at(self, part: str, symbols: list[int]) -> list[str]:
        """The part cut into its symbols: pieces, and single characters."""
        out, at = [], 0
        for s in symbols:
            out.append(self.pieces[s] if s < len(self.pieces) else part[at])
            at += len(out[-1])
        return out

    def _parts_ids(self, parts: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each part with its ids as bytes."""
        by_width: list[list[str]] = [[] for _ in WIDTHS]
        for part in parts:
            if len(part) > SHORT:
                yield part, self._ids(self.merged(part))
            else:
                by_width[_WIDTH[len(part)]].append(part)
        for group in filter(None, by_width):
            symbols, size = self.merged_together(group)
            held = np.arange(symbols.shape[1]) < size[:, None]
            flat = symbols[held].astype("<i4")
            ends = np.cumsum(size)
            others = np.flatnonzero(((symbols >= len(self.pieces)) & held).any(1)).tolist()
            raw, stops = flat.tobytes(), (4 * ends).tolist()
            ids = [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]
            for i in others:
                ids[i] = self._ids(self._cut_at(group[i], symbols[i, : size[i]].tolist()))
            yield from zip(group, ids, strict=True)

    def encode_all(self, values: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes, four to an id."""
        space, cut = SPACE if self.dummy else "", self.cut.findall
        cuts = [cut(space + v.replace(" ", SPACE)) if v else [] for v in values]
        parts = list(set().union(*cuts))
        ids = dict(zip(parts, map(self.known.get, parts), strict=True))
        fresh = {part: self.older.get(part) for part, have in ids.items() if have is None}
        fresh.update(self._parts_ids([part for part, have in fresh.items() if have is None]))
        ids.update(fresh)
        if len(self.known) >= REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update(fresh if max(map(len, fresh), default=0) <= SHORT else {part: have for part, have in fresh.items() if len(part) <= SHORT})
        return [b"".join(map(ids.__getitem__, parts)) for parts in cuts]

    def encode(self, value: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([value])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Pieces on end, ``▁`` as spaces without the one put in front; runs of byte pieces as UTF-8, bad bytes replaced."""
        try:
            whole = "".join(map(self.plain.__getitem__, ids))
            return whole[1:] if self.dummy and ids and ids[0] not in self.value and whole[0] == " " else whole
        except TypeError:  # byte or other pieces among them
            pass
        out, run, first = [], bytearray(), True
        for i in [*ids, None]:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run, first = bytearray(), False
            if i is None:
                break
            if self.kinds[i] == self.CONTROL:
                continue
            piece = " ⁇ " if self.kinds[i] == self.UNKNOWN else self.pieces[i].replace(SPACE, " ")
            if first and self.dummy and self.kinds[i] != self.UNKNOWN:
                piece = piece.removeprefix(" ")
            out.append(piece)
            first = False
        return "".join(out)

    def agrees(self, values: list[str], ids: list[list[int]], decoded: list[str]) -> list[bool]:
        """Per text, whether the library gives the same ids and the same decoded text."""
        if self.library is None:
            self.library = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        theirs = self.library.encode(values, num_threads=1)
        back = self.library.decode(theirs, num_threads=1) if values else []
        return [a == b and c == d for a, b, c, d in zip(ids, theirs, decoded, back, strict=True)]


#: Number of the matrix for a part of each length.
_WIDTH = [next(k for k, w in enumerate(WIDTHS) if n <= w) for n in range(SHORT + 1)]


def _utf8(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is part of no character."""
    out, i = [], 0
    while i < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + size].decode())
                i += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_CODECS: dict[int, Codec] = {}


def _codec(handle) -> Codec:
    raw = handle.value
    key = hash(raw)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def encode(docs: DataFrame, model_path: str, into: str = "pieces", check: bool = False) -> DataFrame:
    """``docs`` with the struct ``into``: ids, the text decoded from them, and with ``check`` whether the library agrees (else NULL)."""
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {into}; name another one in into")
    with open(model_path, "rb") as f:  # on the driver; tasks get the broadcast
        raw = f.read(MODEL_BYTES + 1)
    if len(raw) > MODEL_BYTES:
        raise ValueError("the model is larger than MODEL_BYTES")
    handle = docs.sparkSession.sparkContext.broadcast(raw)

    @F.arrow_udf(RESULT)
    def run(values: pa.Array) -> pa.Array:
        codec = _codec(handle)
        ids, decoded, agrees = [], [], []
        gc.disable()  # nothing here is cyclic, and the tables of known parts are slow to walk
        for lo, hi in text.pieces(values, PIECE_BYTES):
            part = [v or "" for v in values[lo:hi].to_pylist()]
            raw = codec.encode_all(part)
            own = [np.frombuffer(r, "<i4").tolist() for r in raw]
            back = [codec.decode(i) for i in own]
            agrees += codec.agrees(part, own, back) if check else [None] * len(part)
            ends = np.cumsum([0, *(len(i) for i in own)]).astype(np.int32)
            ids.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<i4"))))
            decoded.append(pa.array(back, pa.string()))
        gc.enable()
        if not ids:
            ids, decoded = [pa.array([], pa.list_(pa.int32()))], [pa.array([], pa.string())]
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(decoded), pa.array(agrees, pa.bool_())], ["ids", "decoded", "agrees"])

    return docs.withColumn(into, run("text"))
