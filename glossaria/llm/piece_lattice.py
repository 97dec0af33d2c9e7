"""SentencePiece encoding and decoding over a relational lattice (operator 9).

Encoding finds the segmentation into pieces with the highest sum of scores, as the
unigram form of the library does. A file whose scores are numbers of merges has no
probabilities: its pieces get those of a law of ranks (see :func:`rank_score`), so the
sum is a likelihood, too. Texts are cut where no piece of the vocabulary can
cross, into units (a word with the spaces before it, a run of signs); the distinct
units of a chunk of rows go through the lattice once:

1. the substrings of bounded length are exploded from the chunk's distinct windows (from
   each position of a unit, the longest substring that a piece could be),
2. equi-joined to the piece table (its size is fixed by the vocabulary and checked
   before it is broadcast),
3. grouped by unit into edges for each end position: those of each window of the unit, and
4. folded with the higher-order function ``aggregate``, which keeps the best score of
   the last positions and the last piece of each.

All steps are narrow. A chunk's window rows come before its units, and those before its
document rows, and narrow operators keep that order, so a chunk's windows, units and
documents meet without a shuffle; the later steps verify the order and fail otherwise. A lost
task is computed again from its input split alone.
"""

from __future__ import annotations

import ctypes
import math
import re
import struct
import zlib
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ddl, field_of, map_rows

SPACE = "▁"
#: Characters of text in a chunk; positions folded in one inner array.
CHUNK_CHARS, BLOCK = 32_000_000, 256
#: Documents whose ids leave a task at once; positions of units, and units, that go through the lattice in one pack.
ROWS, PACK, PACK_UNITS = 128, 20_000, 2000
#: Characters of a beginning that decide how long a piece there can be.
DEPTH = 5
#: Units kept for all chunks, and rows, picked by a hash, among which they are counted.
#: They spare work and change no result: what they lack goes through its chunk's lattice.
HOT_UNITS, HOT_ROWS = 300_000, 30_000
#: Entries that a piece table may have, as it is broadcast, and characters of its longest piece.
BROADCAST_PIECES, LONGEST = 1_000_000, 127
#: Added to a piece's rank in the law of ranks; scores are multiples of 1/256, whose sums are exact.
RANK_SHIFT, UNUSED_SCORE = 1000, -40.0


@dataclass
class Pieces:
    """A vocabulary: scores of the pieces that a lattice may use, and all pieces' text."""

    text: list[str]
    usable: dict[str, int]
    scores: list[float]
    bytes_at: list[int]
    unknown: int
    dummy_prefix: bool

    def __post_init__(self):
        own = [self.scores[i] for i in self.usable.values()]
        self.unknown_score = min(own, default=0.0) - 10
        self.longest = max(map(len, self.usable), default=1)
        # Lengths worth trying after each beginning of up to DEPTH characters.
        self.reach: dict[str, int] = {}
        for p in self.usable:
            for k in range(1, DEPTH + 1):
                self.reach[p[:k]] = max(self.reach.get(p[:k], 1), len(p) if k == DEPTH else min(len(p), k))
        # Where some piece joins a letter and a sign, the letter counts as a sign, unless
        # pieces join it to letters, too; then the sign counts as a letter.
        signs = {a if _is_word(a) else b for a, b in self._crossings(_is_word)}
        as_letters: set[str] = set()
        if self._crossings(lambda c: _is_word(c) and c not in signs):
            as_letters, signs = {b if _is_word(a) else a for a, b in self._crossings(_is_word)}, set()
        more, less = "".join(map(re.escape, sorted(as_letters))), "".join(map(re.escape, sorted(signs)))
        letters = rf"[^\W_{less}]" if not more else rf"(?:[^\W_]|[{more}])"
        others = rf"(?:[^\w{SPACE}]|[_{less}])" if not more else rf"(?:(?![{more}])(?:[^\w{SPACE}]|_))"
        whole = any(SPACE in p.lstrip(SPACE) for p in self.usable)
        self.units = re.compile(r"(?s).+" if whole else rf"{SPACE}*{letters}+|{SPACE}*{others}+|{SPACE}+")
        self.raw = [b"" for _ in self.text]
        for i, t in enumerate(self.text):
            self.raw[i] = t.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes_at):
            self.raw[i] = bytes([b])

    def _crossings(self, letter) -> set[tuple[str, str]]:
        """Neighbours within a piece of which one is a letter and one a sign."""
        return {(a, b) for p in self.usable for a, b in zip(p, p[1:]) if SPACE not in (a, b) and letter(a) != letter(b)}

    def normal(self, text: str | None) -> str:
        if not text:
            return ""
        return (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)

    def reach_of(self, start: str) -> int:
        """Characters of the longest substring that a piece could be, where up to ``DEPTH`` characters are ``start``."""
        return next((n for k in range(len(start), 0, -1) if (n := self.reach.get(start[:k]))), 1)

    def of_character(self, code: int) -> list[int]:
        """Pieces of a character that the vocabulary lacks: its bytes, or the unknown piece."""
        if not self.bytes_at:
            return [self.unknown]
        return [self.bytes_at[b] for b in chr(code).encode("utf-8", "replace")]

    def decode(self, ids) -> str:
        raw = self.raw
        out = b"".join([raw[i] for i in ids])
        if self.dummy_prefix and out[:1] == b" ":
            out = out[1:]
        return out.decode("utf-8", "replace")


def rank_score(score: float) -> float:
    """The logarithm of a probability in proportion to 1 / (rank + ``RANK_SHIFT``), for a score that
    is less a rank; scores that keep a piece from being merged are far below all others."""
    return -round(256 * math.log(RANK_SHIFT - score)) / 256 if score > -1e8 else UNUSED_SCORE


_WORD = re.compile(r"[^\W_]")


def _is_word(c: str) -> bool:
    return _WORD.match(c) is not None


@lru_cache(maxsize=4)
def load_pieces(path: str) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    text = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    usable = {t: i for i, t in enumerate(text) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))}
    by_byte = {i for i in range(len(text)) if model.is_byte(i)}
    bytes_at = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if by_byte else []
    score = rank_score if proto.trainer_spec.model_type == proto.trainer_spec.BPE else float
    if len(usable) > BROADCAST_PIECES or max(map(len, usable), default=0) > LONGEST:
        raise ValueError(f"{len(usable)} pieces of up to {max(map(len, usable), default=0)} characters; {BROADCAST_PIECES} of up to {LONGEST} are the most")
    return Pieces(text, usable, [score(model.get_score(i)) for i in range(len(text))], bytes_at, model.unk_id(), proto.normalizer_spec.add_dummy_prefix)


def release() -> None:
    """Gives unused memory back to the system, where its C library can: workers stay, and each takes its turn at every task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def _released(task):
    def run(batches):
        yield from task(batches)
        release()

    return run


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    rows = pa.table({"piece": pa.array(list(pieces.usable), pa.string()), "id": pa.array(list(pieces.usable.values()), pa.int32())})
    return spark.createDataFrame(rows)


# Rows on the way: windows have a number from 0 and their text; packs of units have _UNITS, and in
# ``doc`` the first unit's number, how many there are, how many positions each has, and the number
# of each position's window; documents have _DOCUMENT, and in ``doc`` the size and checksum of the
# text, how many units it has, and their numbers as _packed. Behind the grouping, units have a number and their edges.
_CUT, _PASS = "no int, window string", "doc binary"
_HEAD, _HEAD_SIZE = "<qq", 16
_DOC, _DOC_SIZE, _WIDE = "<qqq", 24, 0xFFFF
_DOCUMENT, _UNITS = -1, -2


#: Beginnings whose windows are remembered at a time.
BEGINNINGS = 50_000


class _Numbers(dict):
    """Numbers from 0 for keys, in the order in which they are first asked for."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def _packed(refs: np.ndarray) -> bytes:
    """16 bits a number; those that don't fit follow with 32. The commonest units have the least numbers."""
    return np.minimum(refs, _WIDE).astype(np.uint16).tobytes() + refs[refs >= _WIDE].tobytes()


def _unpacked(raw: bytes, at: int, n: int) -> np.ndarray:
    refs = np.frombuffer(raw, np.uint16, n, at).astype(np.int32)
    refs[refs == _WIDE] = np.frombuffer(raw, np.int32, offset=at + 2 * n)
    return refs


def _unit_rows(units: list[str], first: int, pieces: Pieces):
    """Columns ``no``, ``window`` and ``doc`` of the windows of ``units``, then of their packs; ``first`` is the first one's number."""
    windows, packs, at = _Numbers(), [], 0
    known: dict[str, int] = {}  # a beginning's window or, where that is longer, less its length

    def learn(start: str) -> int:
        if len(known) >= BEGINNINGS:
            known.clear()
        n = pieces.reach_of(start)
        known[start] = x = -n if n > DEPTH else windows[start[:n]]
        return x

    while at < len(units):
        counts, refs, begin = [], [], at
        while at < len(units) and len(refs) < PACK and len(counts) < PACK_UNITS:
            unit = units[at]
            counts.append(len(unit))
            for i in range(len(unit)):
                start = unit[i : i + DEPTH]
                x = known.get(start)
                if x is None:
                    x = learn(start)
                refs.append(x if x >= 0 else windows[unit[i : i - x]])
            at += 1
        packs.append(struct.pack(_HEAD, first + begin, len(counts)) + np.array(counts, np.int32).tobytes() + np.array(refs, np.int32).tobytes())
    names = list(windows)
    for at in range(0, len(names), 10_000):
        some = names[at : at + 10_000]
        yield pa.array(range(at, at + len(some)), pa.int32()), pa.array(some, pa.string()), pa.nulls(len(some), pa.binary())
    for pack in packs:
        yield pa.array([_UNITS], pa.int32()), pa.nulls(1, pa.string()), pa.array([pack], pa.binary())


def _cut_task(path: str, keep: T.StructType, hot):
    """Texts to unit rows and document rows, chunk by chunk."""
    arrow = to_arrow_schema(keep)
    names = ["no", "window", *keep.fieldNames(), "doc"]

    def run(batches):
        pieces = load_pieces(path)
        find = pieces.units.findall
        index = _Numbers((u, i) for i, u in enumerate(hot.value.to_pylist()))
        n_hot = len(index)
        held, docs, size = [], [], 0

        def flush():
            units = list(islice(index, n_hot, None))
            for no, window, doc in _unit_rows(units, 0, pieces):
                yield pa.RecordBatch.from_arrays([no, window, *[pa.nulls(len(no), f.type) for f in arrow], doc], names)
            at = 0
            for columns, n in held:
                yield pa.RecordBatch.from_arrays([pa.array([_DOCUMENT] * n, pa.int32()), pa.nulls(n, pa.string()), *columns, pa.array(docs[at : at + n], pa.binary())], names)
                at += n
            held.clear()
            docs.clear()
            for unit in units:
                del index[unit]

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for text in part.column(part.num_columns - 1).to_pylist():
                    data = (text or "").encode("utf-8", "replace")
                    found = find(pieces.normal(text))
                    refs = np.fromiter(map(index.__getitem__, found), np.int32, len(found))
                    docs.append(struct.pack(_DOC, len(data), zlib.crc32(data), len(refs)) + _packed(refs))
                    size += len(text or "")
                held.append((part.columns[:-1], part.num_rows))
                if size >= CHUNK_CHARS:
                    yield from flush()
                    size = 0
            part = batch = None  # else the last texts stay while a chunk leaves
        release()
        yield from flush()

    return run


#: An edge: where its start's score is in the fold's array, its weight, its piece and length as one number.
_EDGE = pa.struct([("at", pa.int32()), ("w", pa.float64()), ("code", pa.int32())])
#: code = length * 2**24 + id + 2**22, so that of equal scores the longer piece is the maximum.
_LENGTH, _ZERO = 24, 1 << 22


def _grouped(no, end, start, length, ident, weight, longest):
    """Units' numbers, and for each unit blocks of positions of edges that end there.

    Edges of one unit after another; ``start`` and ``end`` are places in the unit, and ``length`` is between them.
    """
    at = np.where(end <= BLOCK, start, start - (end - 1) // BLOCK * BLOCK + longest - 1)
    code = (length.astype(np.int64) << _LENGTH) + ident + _ZERO
    new_unit = np.concatenate([[True], no[1:] != no[:-1]])
    new_end = new_unit | np.concatenate([[True], end[1:] != end[:-1]])
    ends = np.flatnonzero(new_end)
    first = np.flatnonzero(new_unit[ends])
    n_ends = np.diff(np.append(first, len(ends)))
    blocks = (n_ends + BLOCK - 1) // BLOCK
    block_at = np.concatenate([f + np.arange(0, n, BLOCK) for f, n in zip(first, n_ends, strict=True)]) if (blocks > 1).any() else first
    edges = pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(weight, pa.float64()), pa.array(code, pa.int32())], fields=list(_EDGE))
    level = pa.ListArray.from_arrays(pa.array(np.append(ends, len(no)), pa.int32()), edges)
    level = pa.ListArray.from_arrays(pa.array(np.append(block_at, len(ends)), pa.int32()), level)
    return no[ends[first]], pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(blocks)]), pa.int32()), level)


def _unit_edges(raw: bytes, table, longest: int):
    """What :func:`_grouped` returns of a pack of units; ``table`` has each window's first edge and end, and the edges."""
    stops, length, ident, weight = table
    first, n = struct.unpack_from(_HEAD, raw)
    numbers = np.frombuffer(raw, np.int32, offset=_HEAD_SIZE)
    counts, refs = numbers[:n], numbers[n:]
    if len(refs) != counts.sum() or refs.max() >= len(stops) - 1:
        raise RuntimeError("a unit came before its windows")
    starts, many = stops[refs], stops[refs + 1] - stops[refs]
    edge = np.repeat(starts - np.cumsum(many) + many, many) + np.arange(many.sum())
    position = np.repeat(np.arange(len(refs)), many)
    end = position + length[edge]
    order = np.argsort(end.astype(np.uint16) if len(refs) < 1 << 16 else end, kind="stable")
    edge, position, end = edge[order], position[order], end[order]
    unit, base = np.repeat(np.arange(first, first + n), counts), np.repeat(np.cumsum(counts) - counts, counts)
    before = base[position]
    return _grouped(unit[position], end - before, position - before, length[edge], ident[edge], weight[edge], longest)


def _window_edges(parts, scores: np.ndarray, unknown_score: float):
    no, length, ident = (np.concatenate(c) for c in zip(*parts, strict=True))
    if no[0] or not np.isin(np.diff(no), (0, 1)).all():
        raise RuntimeError("windows aren't in their chunk's order")
    return np.append(np.flatnonzero(np.diff(no, prepend=-1)), len(no)), length, ident, np.where(ident >= 0, scores[np.maximum(ident, 0)], unknown_score)


def _group_task(batches, longest: int, scores: np.ndarray, unknown_score: float):
    """Windows' joined substrings, in order, and packs of units to one row a unit: edges by end position, in blocks."""
    parts, table = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        no = batch.column(0).to_numpy()
        kind = np.minimum(no, 0)
        passed = [batch.schema.field(i) for i in range(3, batch.num_columns)]
        names = ["no", "blocks", *[f.name for f in passed]]
        turns = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]]))
        for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            if kind[a] == _DOCUMENT:
                empty = pa.nulls(b - a, pa.list_(pa.list_(pa.list_(_EDGE))))
                yield pa.RecordBatch.from_arrays([part.column(0), empty, *part.columns[3:]], names)
            elif kind[a] == _UNITS:
                if table is None:
                    table = _window_edges(parts, scores, unknown_score)
                for raw in part.column(batch.num_columns - 1).to_pylist():
                    units, lists = _unit_edges(raw, table, longest)
                    yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), lists, *[pa.nulls(len(units), f.type) for f in passed]], names)
            else:
                if table is not None:
                    parts, table = [], None
                parts.append(tuple(part.column(i).to_numpy(zero_copy_only=False) for i in range(3)))


def _last_pieces(numbers: pa.Array, lists: pa.Array, pieces: Pieces):
    """(number, ids) of units, back from the last piece of each position."""
    codes = lists.flatten().to_numpy()
    steps, ids = (codes >> _LENGTH).tolist(), ((codes & (1 << _LENGTH) - 1) - _ZERO).tolist()
    ends = np.cumsum(np.concatenate([[0], lists.value_lengths().to_numpy()])).tolist()
    for no, x, at in zip(numbers.to_pylist(), ends, ends[1:]):
        own = []
        while at > x:
            i = ids[at - 1]
            at -= steps[at - 1]
            if i >= 0:
                own.append(i)
            else:
                own += reversed(pieces.of_character(-1 - i))
        own.reverse()
        yield no, own


def _join_task(path: str, keep: T.StructType, hot, finish):
    """Units' last pieces to ids, documents' references to ids, and what ``finish`` makes of them."""
    names = [*keep.fieldNames(), *finish.names]

    def run(batches):
        pieces = load_pieces(path)
        base_ids, base_ends = hot.value
        ids, ends = array("i"), array("q", [0])
        table = None
        n_keep = len(keep)
        for batch in batches:
            kind = batch.column(0).to_numpy() < 0
            turns = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1], [True]])) if len(kind) else [0]
            for a, b in zip(turns[:-1], turns[1:], strict=True):
                part = batch.slice(int(a), int(b - a))
                if not kind[a]:
                    if table is not None:
                        ids, ends, table = array("i"), array("q", [0]), None
                    for no, own in _last_pieces(part.column(0), part.column(1), pieces):
                        if no != len(ends) - 1:
                            raise RuntimeError("units aren't in their chunk's order")
                        ids.extend(own)
                        ends.append(len(ids))
                    continue
                if table is None:
                    table = np.concatenate([base_ids, np.array(ids, np.int32)]), np.concatenate([base_ends, np.array(ends[1:], np.int64) + base_ends[-1]])
                values, stops = table
                for at in range(0, part.num_rows, ROWS):
                    some, heads, out = part.slice(at, ROWS), [], []
                    for raw in some.column(2 + n_keep).to_pylist():
                        *head, count = struct.unpack_from(_DOC, raw)
                        heads.append(head)
                        refs = _unpacked(raw, _DOC_SIZE, count)
                        if len(refs) and refs.max() >= len(stops) - 1:
                            raise RuntimeError("a document came before its units")
                        starts, n = stops[refs], stops[refs + 1] - stops[refs]
                        total = int(n.sum())
                        out.append(values[np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)] if total else np.zeros(0, np.int32))
                    columns = finish.make(pieces, out, *(pa.array(v, pa.int64()) for v in zip(*heads, strict=True)))
                    yield pa.RecordBatch.from_arrays([*[some.column(2 + i) for i in range(n_keep)], *columns], names)

    return run


def fold_viterbi(blocks, longest: int):
    """For each position of a unit the code of the last piece of the best path to it.

    The inner fold appends each position's best (score, code) to an array that begins
    with those of the ``longest`` positions before its block, of the first block with its
    start's; the outer one appends the blocks' arrays. So arrays stay short, and long units
    near-linear.
    """
    seed = F.array(F.struct(F.lit(0.0).alias("w"), F.lit(0).alias("code")))

    def position(acc, ends):
        return F.array_append(acc, F.array_max(F.transform(ends, lambda e: F.struct((F.get(acc, e["at"])["w"] + e["w"]).alias("w"), e["code"].alias("code")))))

    def last(done):
        return F.slice(done, F.greatest(F.lit(-longest), -F.size(done)), longest)

    def block(done, ends):
        return F.array_append(done, F.aggregate(ends, last(F.element_at(done, -1)), position))

    whole = F.aggregate(blocks, F.array(seed), block)
    parts = F.transform(whole, lambda b, i: F.slice(b, F.when(i <= 1, 2).otherwise(longest + 1), BLOCK))
    short = F.slice(F.aggregate(F.get(blocks, 0), seed, position), 2, BLOCK)
    return F.when(F.size(blocks) == 1, short).otherwise(F.flatten(parts))["code"]


class AllIds:
    """The ids themselves."""

    schema, names = "ids array<int>, n_bytes long, crc long", ("ids", "n_bytes", "crc")

    @staticmethod
    def make(pieces: Pieces, ids: list[np.ndarray], n_bytes: pa.Array, crc: pa.Array) -> list[pa.Array]:
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
        return [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32())), n_bytes, crc]


class Digest:
    """Counts and checksums of the ids and of the text that they decode to."""

    schema = "n_bytes long, n_pieces long, ids_crc32 long, decoded_bytes long, text_crc32 long, lossless boolean"
    names = ("n_bytes", "n_pieces", "ids_crc32", "decoded_bytes", "text_crc32", "lossless")

    @staticmethod
    def make(pieces: Pieces, ids: list[np.ndarray], n_bytes: pa.Array, crc: pa.Array) -> list[pa.Array]:
        back = [pieces.decode(i.tolist()).encode("utf-8", "replace") for i in ids]
        crcs = pa.array([zlib.crc32(i.astype("<i4").tobytes()) for i in ids], pa.int64())
        same = [len(b) == n and zlib.crc32(b) == c for b, n, c in zip(back, n_bytes.to_pylist(), crc.to_pylist(), strict=True)]
        return [n_bytes, pa.array([len(i) for i in ids], pa.int64()), crcs, pa.array([len(b) for b in back], pa.int64()), crc, pa.array(same, pa.bool_())]


@dataclass
class HotUnits:
    """Encoded units, broadcast: their texts, and ids with the end of each unit's."""

    units: Broadcast
    ids: np.ndarray
    ends: np.ndarray


def _lattice(cut: DataFrame, pieces: Pieces, passed: T.StructType) -> DataFrame:
    """(no, back, and the columns ``passed``) of rows (no, window, and those); the last of them is ``doc``."""
    names = passed.fieldNames()
    subs = cut.select("no", "window", F.explode_outer(F.sequence(F.lit(1), F.length("window"))).alias("len"), *names)
    subs = subs.select("no", "len", F.expr("left(window, len)").alias("sub"), *names)
    table = piece_table(cut.sparkSession, pieces)
    edges = subs.join(F.broadcast(table), F.col("sub") == F.col("piece"), "left").filter("no < 0 or len = 1 or id is not null")
    edges = edges.select("no", "len", F.coalesce("id", -1 - F.ascii("sub")).alias("id"), *names)
    edge, longest, scores, unknown = "array<array<array<struct<at: int, w: double, code: int>>>>", pieces.longest, np.array(pieces.scores), pieces.unknown_score
    grouped = edges.mapInArrow(_released(lambda batches: _group_task(batches, longest, scores, unknown)), T.StructType(list(ddl(f"no int, blocks {edge}").fields) + list(passed.fields)))
    return grouped.select("no", fold_viterbi(F.col("blocks"), pieces.longest).alias("back"), *names)


def hot_units(df: DataFrame, model: str, text_col: str = "text", units: int = HOT_UNITS, rows: int = HOT_ROWS) -> HotUnits:
    """The commonest units of about ``rows`` rows, through the lattice; at most ``units``."""
    spark, pieces = df.sparkSession, load_pieces(model)
    n = max(1, df.count())
    text = df.select(F.col(f"`{text_col}`").alias("text"))
    if n > rows:
        text = text.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * rows / n))

    def count(batches):
        find, seen = load_pieces(model).units.findall, Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for t in batch.column(0).slice(at, 64).to_pylist():
                    seen.update(find(load_pieces(model).normal(t)))
            if len(seen) > units:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])
                seen = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])

    best = text.mapInArrow(_released(count), ddl("unit string, n long")).groupBy("unit").agg(F.sum("n").alias("n")).filter(f"n > 1 and length(unit) <= {BLOCK}").orderBy(F.desc("n"), "unit").limit(units)
    chosen = best.select("unit").toArrow()["unit"].combine_chunks()
    shared = spark.sparkContext.broadcast(chosen)

    def rows_of(batches):
        for batch in batches:
            if batch.num_rows:
                some = batch.column(0)
                for columns in _unit_rows(shared.value.take(some).to_pylist(), some[0].as_py(), load_pieces(model)):
                    yield pa.RecordBatch.from_arrays(list(columns), ["no", "window", "doc"])

    cut = spark.range(0, len(chosen), 1, max(1, len(chosen) // 10_000)).mapInArrow(_released(rows_of), ddl(f"{_CUT}, {_PASS}"))
    done = _lattice(cut, pieces, ddl(_PASS)).select("no", "back").toArrow().sort_by("no").combine_chunks()
    ids, ends = array("i"), array("q", [0])
    for part in done.to_batches(max_chunksize=10_000):
        for _, own in _last_pieces(part.column(0), part.column(1), pieces):
            ids.extend(own)
            ends.append(len(ids))
    if len(ends) != len(chosen) + 1:
        raise RuntimeError("units were lost")
    del done
    release()
    return HotUnits(shared, np.array(ids, np.int32), np.array(ends, np.int64))


def encode(df: DataFrame, model: str, keep: list[str], text_col: str = "text", finish=AllIds) -> DataFrame:
    """The columns ``keep``, ``ids`` (piece ids of the whole text, in order), ``n_bytes`` and
    ``crc`` (of the text's UTF-8) for each row of ``df``.

    ``model`` is the path of a model file, present on every executor. Null and empty
    texts have no ids. Characters that the vocabulary lacks become their bytes' pieces
    or, without such pieces, the unknown piece. Ties go to the longer last piece.
    Repeated rows give equal rows; ids may be null; an empty table gives an empty table.
    A word of a million characters without a break takes a task over a minute. Texts are read
    once, and a bounded sample of them before, for the units kept for all chunks.
    ``finish`` may reduce the ids where they are made, as :class:`Digest` does.
    """
    pieces = load_pieces(model)
    own = T.StructType([T.StructField(f"k{i}", field_of(df, c).dataType) for i, c in enumerate(keep)])
    hot = hot_units(df, model, text_col)
    coded = df.sparkSession.sparkContext.broadcast((hot.ids, hot.ends))
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias("text"))
    passed = T.StructType(list(own.fields) + list(ddl(_PASS).fields))
    cut = source.mapInArrow(_released(_cut_task(model, own, hot.units)), T.StructType(list(ddl(_CUT).fields) + list(passed.fields)))
    out = _lattice(cut, pieces, passed).mapInArrow(_released(_join_task(model, own, coded, finish)), T.StructType(list(own.fields) + list(ddl(finish.schema).fields)))
    return out.toDF(*keep, *finish.names)


def decode(df: DataFrame, model: str, keep: list[str], ids_col: str = "ids") -> DataFrame:
    """The columns ``keep`` and ``text``, from piece ids; null ids give null, no ids an empty text."""

    def factory():
        pieces = load_pieces(model)
        return lambda rows: ([None if r is None else pieces.decode(r) for r in rows],)

    return map_rows(df, keep, [ids_col], "text string", factory)


def encoding_digest(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_bytes``, ``n_pieces``, ``ids_crc32``, ``decoded_bytes``, ``text_crc32`` and
    ``lossless`` (the decoded text equals the text) for each row of ``df``, as :func:`encode` has them."""
    return encode(df, model, [id_col], text_col, Digest)
