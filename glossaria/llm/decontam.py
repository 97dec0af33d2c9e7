"""Benchmark decontamination by a prefix-filtered set join (operator 4).

A window is ``WINDOW`` consecutive words of a benchmark item (all its words, if it
has fewer). It is joined as the sequence of its word shingles, ordered by rarity
over all documents. A document that holds the window holds all its shingles, so the
prefix that must match is the single rarest one. A match fixes where the window
would start; bounds on position and length follow; the rest of its shingles are
then looked up at their places, which verifies exact containment.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_rows, materialise

WINDOW, SHINGLE = 10, 3
#: UTF-8 bytes and words of benchmark text in one block; each block is one pass over the documents.
BLOCK_BYTES, PIECE_WORDS = 4_000_000, 500_000

# Bytes that no word has become spaces; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text: digits, a-z and characters beyond ASCII."""
    data = (text or "").encode("utf-8", "replace").translate(_TABLE)
    return [w for w in data.split(b" ") if w]


@dataclass
class ShingleIndex:
    """The shingles of a block of items as sorted numbers, exact (no hashing)."""

    vocabulary: dict[bytes, int]
    codes: dict[int, np.ndarray]  # by words in a shingle
    first_id: dict[int, int]

    def lookup(self, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the shingles of ``size`` words that the index has."""
        known = self.codes.get(size)
        if known is None or len(ids) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = ids[: len(ids) - size + 1] >= 0
        for k in range(1, size):
            ok = ok & (ids[k : len(ids) - size + 1 + k] >= 0)
        at = np.flatnonzero(ok)
        code = np.zeros(len(at), np.int64)
        for k in range(size):
            code = code << 20 | ids[at + k]
        where = np.minimum(np.searchsorted(known, code), len(known) - 1)
        hit = known[where] == code
        return at[hit], where[hit] + self.first_id[size]

    def matches(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """Words of a text, and places and numbers of all its shingles in the index."""
        own = words(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in own), np.int64, len(own))
        found = [self.lookup(ids, k) for k in self.codes] or [(np.zeros(0, np.int64),) * 2]
        return len(own), np.concatenate([p for p, _ in found]).tolist(), np.concatenate([s for _, s in found]).tolist()


def pieces(items: Iterable[tuple[str, str | None]], most: int = PIECE_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items' words in lists of at most ``most`` words; longer items are cut so that no window is."""
    held, n = [], 0
    for item, text in items:
        own = words(text)
        for at in range(0, max(1, len(own) - WINDOW + 1), most - WINDOW + 1):
            part = own[at : at + most]
            if held and n + len(part) > most:
                yield held
                held, n = [], 0
            held.append((item, part))
            n += len(part)
    if held:
        yield held


def index_items(items: list[tuple[str, list[bytes]]]) -> tuple[ShingleIndex, pa.Table, pa.Table]:
    """The index of some items' words, their distinct windows (window, n, shingles), and the
    items (window, item) of each, so that what many items have is looked for once."""
    vocabulary: dict[bytes, int] = {}
    windows: dict[tuple, int] = {}
    owners = set()
    for item, own in items:
        ids = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in own)
        for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
            owners.add((windows.setdefault(ids[at : at + WINDOW], len(windows)), item))
    by_size: dict[int, list] = {}  # windows of equal length, as rows of numbers
    for part, w in windows.items():
        by_size.setdefault(len(part), []).append((w, *part))
    made, codes = [], {}
    for n, rows in by_size.items():
        k, table = min(SHINGLE, n), np.array(rows, np.int64)
        code = np.zeros((len(table), n - k + 1), np.int64)
        for i in range(k):
            code = code << 20 | table[:, 1 + i : n - k + 2 + i]
        made.append((n, k, table[:, 0], code))
        codes.setdefault(k, []).append(code.ravel())
    codes = {k: np.unique(np.concatenate(c)) for k, c in sorted(codes.items())}
    first, start = {}, 0
    for k, c in codes.items():
        first[k], start = start, start + len(c)
    parts = [pa.table({"window": pa.array(w, pa.int32()), "n": pa.array(np.full(len(w), n), pa.int32()), "shingles": pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * code.shape[1], pa.int32()), pa.array(np.searchsorted(codes[k], code.ravel()) + first[k], pa.int32()))}) for n, k, w, code in made]
    empty = pa.table({"window": pa.array([], pa.int32()), "n": pa.array([], pa.int32()), "shingles": pa.array([], pa.list_(pa.int32()))})
    owned = sorted(owners)
    return ShingleIndex(vocabulary, codes, first), pa.concat_tables([empty, *parts]), pa.table({"window": pa.array([w for w, _ in owned], pa.int32()), "item": pa.array([i for _, i in owned], pa.string())})


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items' words in blocks of about ``BLOCK_BYTES`` or ``PIECE_WORDS``, of which the driver holds one at a time."""
    own = items.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = 1 + int(own.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES
    for k in range(n):
        yield from pieces((r[0], r[1]) for r in own.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).toLocalIterator())


def _hits(found: DataFrame, windows: DataFrame, owners: DataFrame) -> DataFrame:
    """(row, item, start, n): windows that occur, from the matched shingles of a block.

    The tables of a block, bounded by ``PIECE_WORDS``, are broadcast.
    """
    places = found.select("row", "n_words", F.explode(F.arrays_zip("at", "shingle")).alias("m")).select("row", "n_words", F.col("m.at").alias("at"), F.col("m.shingle").alias("shingle"))
    rarity = places.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"))
    # Each window's shingles by rarity; only the rarest is joined with the documents.
    each = windows.select("window", F.posexplode("shingles").alias("offset", "shingle")).join(F.broadcast(rarity), "shingle", "left")
    prefix = each.groupBy("window").agg(F.min(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "shingle", "offset")).alias("rarest")).filter("rarest.rows > 0")
    prefix = prefix.select("window", F.col("rarest.shingle").alias("shingle"), F.col("rarest.offset").alias("offset")).join(windows.select("window", "n", F.size("shingles").alias("need")), "window")
    candidates = places.join(F.broadcast(prefix), "shingle").withColumn("start", F.col("at") - F.col("offset")).filter("start >= 0 and start + n <= n_words").select("row", "window", "n", "need", "start")
    # Verification: every shingle of the window at its place in the row.
    wanted = candidates.join(F.broadcast(windows.select("window", F.posexplode("shingles").alias("offset", "shingle"))), "window").withColumn("at", F.col("start") + F.col("offset"))
    there = wanted.join(places.select("row", "at", "shingle"), ["row", "at", "shingle"])
    whole = there.groupBy("row", "window", "start", "n", "need").agg(F.count(F.lit(1)).alias("got")).filter("got = need")
    return whole.join(F.broadcast(owners), "window").select("row", "item", "start", "n")


def find_windows(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, hits): a number, id and word count for each row of ``df``, and each occurrence
    (row, item, start, n) of an item's window in it.

    The items are taken in blocks of bounded size; a block's index is broadcast and its
    tables of windows, too, as they are bounded with it. Texts are read once a block
    and never shuffled; what is shuffled are matched shingles.
    """
    spark = df.sparkSession
    given = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows, hits = None, None
    blocks = _blocks(items, item_col, item_text_col)
    block, after = next(blocks, []), next(blocks, None)
    if after is not None:
        given = materialise(given.withColumn("row", F.monotonically_increasing_id()), "texts")
    while block is not None:
        index, windows, owners = index_items(block)
        shared = spark.sparkContext.broadcast(index)
        found = map_rows(given, [c for c in given.columns if c != "text"], ["text"], "n_words long, at array<int>, shingle array<int>", lambda s=shared: lambda t: list(zip(*map(s.value.matches, t), strict=True)))
        if "row" not in given.columns:
            found = found.withColumn("row", F.monotonically_increasing_id())
        found = materialise(found, "matches")
        rows = found.select("row", "id", "n_words") if rows is None else rows
        got = _hits(found, spark.createDataFrame(windows), spark.createDataFrame(owners))
        if after is not None:
            got = materialise(got, "hits")
        hits = got if hits is None else hits.union(got)
        block, after = after, next(blocks, None)
    return rows, hits


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: the id, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` and ``contaminated``.

    ``n_hit`` counts words inside any occurrence of a window, ``n_items`` the items with
    an occurring window; the digest is of their ids, sorted as strings and joined with
    commas (of the empty string, if none). Null and empty texts have no words; null and
    empty items no window. Texts count whole; an item of any length is looked for, in parts
    that share nine words. Repeated rows get equal rows; ids may be null and repeat; other
    columns are not read, whatever their names. Without documents the result is empty,
    without items nothing is hit.
    """
    rows, hits = find_windows(df, items, id_col, text_col, item_col, item_text_col)
    hits = materialise(hits, "hits")
    covered = hits.select("row", F.explode(F.sequence("start", F.expr("start + n - 1"))).alias("at")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.groupBy("row").agg(F.collect_set("item").alias("items"))
    out = rows.join(covered.join(named, "row"), "row", "left")
    found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(found), ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
