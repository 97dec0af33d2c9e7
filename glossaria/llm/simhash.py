"""Near-duplicate documents by SimHash and pivot distance tables (operator 8).

Fingerprints within ``distance`` bits are linked. Candidates: the 64 bits are cut
into blocks, of which a pair within the distance shares some ``SHARED`` whatever the
bits that differ, so every linked pair meets under one of the keys made of
``SHARED`` blocks. Within a key, the distances of each fingerprint to many
reference fingerprints (pivots) are tabulated; the triangle inequality discards a
pair if any coordinate differs by more than the distance; survivors are verified.
Equal fingerprints are one node, and a key with many nodes yields a spanning forest
of its links instead of all of them, so hot groups stay small and no link is lost.

:func:`similar_rows` links whole texts by the Jaccard similarity of their shingles.
Fingerprints within the distance come first, and each of their links is verified by
its texts. As similar texts may differ in more bits than any table of keys can serve
(0.8: 10 of 64 on average), pairs that meet under a key of least shingle hashes are
verified, too, until no two groups share an untested one. Edited copies of one text can
all meet under a key while few are similar enough, so pairs are first held against an
upper bound of their similarity, from how many hashes each set has in each of some ranges:
a pair beyond it is no link, whatever its texts, and only the others' texts are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, discard, map_rows, materialise

SEED, SHINGLE, DISTANCE = 42, 4, 4
#: Words of a shingle and least similarity of linked texts; bits in which they may differ.
#: At 0.8 they differ in 9.7 bits, with a deviation of 2.9: one pair in 10 million is beyond 24.
SIMILAR_SHINGLE, SIMILARITY, WIDE = 5, 0.8, 24
#: Keys of least hashes and hashes in a key: at 0.8, one pair in 300,000 shares none.
BANDS, WIDTH = 32, 5
#: Ranges of hashes whose numbers bound a pair's similarity, a byte each; pairs bounded at once.
RANGES, AT_ONCE = 256, 16_384
#: Widths of the blocks, blocks in a key: 7 blocks less 4 differing bits leave 3.
BLOCKS, SHARED = (10, 9, 9, 9, 9, 9, 9), 3
#: Runs of up to this many nodes are compared all at once, longer ones by pivot windows.
SMALL, STRIPE = 8, 2048

_STARTS = np.cumsum([0, *BLOCKS[:-1]])
_MASKS = np.array([((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, _STARTS, strict=True)], np.uint64)
_KEYS = list(combinations(range(len(BLOCKS)), SHARED))


def _pivots(n: int = 32) -> np.ndarray:
    """Fixed reference fingerprints, by the splitmix64 sequence."""
    out, x = [], 0
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & (1 << 64) - 1
        z = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        z = (z ^ z >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        out.append(z ^ z >> 31)
    return np.array(out, np.uint64)


PIVOTS = _pivots()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, repeats included, in parts of bounded length."""
    digest, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        if words:
            yield np.array([digest(joined, SEED)], np.uint64)
        return
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    for at in range(0, n, 1 << 16):
        to = min(n, at + (1 << 16))
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)], np.uint64)


def majority(parts) -> int:
    """Bit by bit, whether over half of the hashes have it; 0 without a hash."""
    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit majority of the hashes of all word shingles; 0 without a word."""
    return majority(shingle_hashes(_words(text), size))


def shingle_set(text: str | None, size: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    parts = list(shingle_hashes(_words(text), size))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


@lru_cache(maxsize=1)
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    a, b = (rng.integers(0, 1 << 64, BANDS * WIDTH, np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def range_counts(own: np.ndarray) -> bytes:
    """How many of a set's hashes are in each range; only zeros if a number takes more than a byte."""
    n = np.bincount((own >> np.uint64(56)).astype(np.intp), minlength=RANGES)
    return n.astype(np.uint8).tobytes() if n.max() <= 255 else bytes(RANGES)


def may_be_similar(counts: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (i, j) of sets can reach ``similarity``, by rows of :func:`range_counts` and their sums.

    Two sets share no more of a range than the lesser of their numbers in it, so no pair
    that reaches it is left out; sets whose numbers aren't known may be similar to any.
    """
    ok = np.zeros(len(i), bool)
    for at in range(0, len(i), AT_ONCE):
        a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
        most = np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64)
        ok[at : at + AT_ONCE] = (most >= similarity * (sizes[a] + sizes[b] - most)) | (sizes[a] == 0) | (sizes[b] == 0)
    return ok


def sketch(text: str | None, size: int = SIMILAR_SHINGLE) -> tuple[int, int, list[int], bytes]:
    """Fingerprint and checksum of a text's set of shingles, its keys of least hashes, and its :func:`range_counts`."""
    own = shingle_set(text, size)
    if not len(own):
        return 0, 0, [], b""
    a, b = _mixers()
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 2048):
        least = np.minimum(least, (own[at : at + 2048, None] * a + b).min(axis=0))
    keys = [xxhash.xxh64_intdigest(k.tobytes(), i) - (1 << 63) for i, k in enumerate(least.reshape(BANDS, WIDTH))]
    return majority([own]), xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63), keys, range_counts(own)


def pivot_table(fps: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int16)


def survivors(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Which pairs (i, j) pass every pivot coordinate and the exact check."""
    alive = np.arange(len(i))
    for k in range(0, table.shape[1], 4):
        if not len(alive):
            return alive
        a, b = table[i[alive], k : k + 4], table[j[alive], k : k + 4]
        alive = alive[np.abs(a - b).max(axis=1) <= distance]
    return alive[np.bitwise_count(fps[i[alive]] ^ fps[j[alive]]) <= distance]


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links within ``distance`` connect, at most n - 1.

    Sorted by the first pivot's coordinate, a fingerprint can be linked only to those
    in a window of that coordinate. Stripes bound the memory whatever n is.
    """
    table = pivot_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    n, root = len(fps), np.arange(len(fps))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    upper = np.searchsorted(table[:, 0], table[:, 0] + distance, "right")
    for a in range(0, n, 64):
        b = min(n, a + 64)
        for c in range(a, int(upper[b - 1]), STRIPE):
            d = min(int(upper[b - 1]), c + STRIPE)
            near = np.abs(table[a:b, None, 1] - table[None, c:d, 1]) <= distance
            near &= root[a:b, None] != root[None, c:d]
            i, j = np.nonzero(near)
            i, j = i + a, j + c
            ok = i < j
            i, j = i[ok], j[ok]
            for s in survivors(fps, table, i, j, distance):
                x, y = find(int(i[s])), find(int(j[s]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    left.append(i[s])
                    right.append(j[s])
        for x in range(a, b):
            root[x] = find(x)
    return fps[np.array(left, int)], fps[np.array(right, int)]


def key_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every fingerprint under each of its keys (a number that no other block choice shares)."""
    keys = []
    for k, blocks in enumerate(_KEYS):
        value, shift = np.zeros(len(fps), np.uint64), 0
        for b in blocks:
            value |= ((fps & _MASKS[b]) >> np.uint64(_STARTS[b])) << np.uint64(shift)
            shift += BLOCKS[b]
        keys.append(value | np.uint64(k << 40))
    return np.concatenate(keys).astype(np.int64), np.tile(fps, len(_KEYS))


_FIRST = np.full(1 << len(BLOCKS), -1)
for _k in reversed(range(len(_KEYS))):
    _need = sum(1 << b for b in _KEYS[_k])
    for _m in range(1 << len(BLOCKS)):
        if _m & _need == _need:
            _FIRST[_m] = _k


def _links_of_runs(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys; a pair of a short run counts under its first key only."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    out = [spanning_links(fps[s : s + n]) for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True)]
    some = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    if len(some):
        k, f = keys[some], fps[some]
        table = pivot_table(f)
        for lag in range(1, SMALL):
            i = np.flatnonzero(k[lag:] == k[:-lag]) if lag < len(k) else np.zeros(0, int)
            j = i + lag
            s = survivors(f, table, i, j)
            a, b = f[i[s]], f[j[s]]
            same = ((a ^ b)[:, None] & _MASKS[None, :]) == 0
            first = _FIRST[(same << np.arange(len(BLOCKS))).sum(1)]
            own = first == k[i[s]] >> 40
            out.append((a[own], b[own]))
    return np.concatenate([a for a, _ in out] or [np.zeros(0, np.uint64)]), np.concatenate([b for _, b in out] or [np.zeros(0, np.uint64)])


def _link_task(batches):
    """Over rows sorted by key: the links of every run, also of runs that go on in the next batch."""
    keys, fps = [], []

    def flush(last: bool):
        k, f = np.concatenate(keys), np.concatenate(fps)
        cut = len(k) if last else int(np.searchsorted(k, k[-1], "left"))
        keys[:], fps[:] = [k[cut:]], [f[cut:]]
        if cut:
            a, b = _links_of_runs(k[:cut], f[:cut])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            if sum(map(len, keys)) >= 100_000 and keys[-1][-1] != keys[0][0]:
                yield from flush(False)
    if keys:
        yield from flush(True)


def link_fingerprints(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints in column ``fp`` as all links do."""

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                k, f = key_rows(batch.column(0).slice(at, 4096).to_numpy().view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f.view(np.int64))], ["key", "fp"])

    rows = nodes.select("fp").mapInArrow(spread, ddl("key long, fp long"))
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_link_task, ddl("a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); the root is the smallest node reachable.

    Alternates the two star operations, each a grouped minimum and a join on the node,
    with a table written after each round, until the links no longer change; the rounds
    grow with the square of the logarithm of the longest chain.
    """

    def star(edges: DataFrame, small: bool) -> DataFrame:
        least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        near = edges.join(least, "u")
        if small:  # edges point from the larger node to the smaller
            return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        return near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()

    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, False)
        after = materialise(star(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), True), "stars")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _shared_keys(batches):
    """Over rows sorted by key: those whose key another row has, too."""
    held, told = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys = rows.column(0).to_numpy()
        again = keys[1:] == keys[:-1]
        there = np.concatenate([[told], again]) | np.concatenate([again, [False]])
        held, told = rows.slice(rows.num_rows - 1), bool(len(again) and again[-1]) or (told and rows.num_rows == 1)
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(there[:-1]))
    if held is not None and told:
        yield held


def untested_pairs(node: np.ndarray, fp: np.ndarray, root: np.ndarray, limit: int, counts: np.ndarray | None = None, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one key's nodes with different roots, within ``WIDE`` bits, that ``counts`` (if
    given) let reach ``similarity``: for each node that isn't of the commonest root the
    ``limit`` nearest. Also whether that left any out.

    A run that would take over 100 million comparisons has, while ``limit`` is small, each node
    compared with its neighbours in fingerprint order and with the first node alone; that
    joins what is alike, and what isn't yet joined is compared with all later.
    """
    _, kind, many = np.unique(root, return_inverse=True, return_counts=True)
    rest = np.flatnonzero(kind != many.argmax())
    if not len(rest):
        return node[:0], node[:0], False
    sizes = None if counts is None else counts.sum(axis=1, dtype=np.int64)
    if len(rest) * len(node) > 100_000_000 and limit < 1000:
        order = np.lexsort((fp, pivot_table(fp, PIVOTS[:1])[:, 0]))
        i = np.concatenate([order[lag:] for lag in range(1, 5)] + [order[1:]])
        j = np.concatenate([order[:-lag] for lag in range(1, 5)] + [np.full(len(order) - 1, order[0])])
        ok = (kind[i] != kind[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= WIDE)
        i, j = i[ok], j[ok]
        if counts is not None:
            ok = may_be_similar(counts, sizes, i, j, similarity)
            i, j = i[ok], j[ok]
        return node[i], node[j], True
    left, right, more = [], [], False
    for a in range(0, len(rest), 64):
        own, found = rest[a : a + 64], []
        for c in range(0, len(node), 1 << 16):
            d = np.bitwise_count(fp[own, None] ^ fp[None, c : c + (1 << 16)])
            x, y = np.nonzero((d <= WIDE) & (kind[own, None] != kind[None, c : c + (1 << 16)]))
            if counts is not None:
                ok = may_be_similar(counts, sizes, own[x], y + c, similarity)
                x, y = x[ok], y[ok]
            found.append((x, y + c, d[x, y]))
        x, y, d = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((y, d, x))
        x, y = x[order], y[order]
        rank = np.arange(len(x)) - np.searchsorted(x, x)
        more |= bool((rank >= limit).any())
        left.append(node[own[x[rank < limit]]])
        right.append(node[y[rank < limit]])
    return np.concatenate(left), np.concatenate(right), more


def _pairs_task(limit: int, similarity: float):
    """Over rows (key, node, fp, root, counts) sorted by key: untested pairs, and one of -1 if some were left out."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            rows = pa.Table.from_batches(held).combine_chunks()
            keys, node, fp, root = (rows.column(i).to_numpy() for i in range(4))
            counts = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, RANGES)
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1], "left"))
            held[:] = rows.slice(cut).to_batches()
            if not cut:
                return
            starts = np.flatnonzero(np.concatenate([[True], keys[1:cut] != keys[: cut - 1]]))
            got = [untested_pairs(node[s:e], fp[s:e].view(np.uint64), root[s:e], limit, counts[s:e], similarity) for s, e in zip(starts, [*starts[1:], cut], strict=True)]
            a, b = (np.concatenate([g[k] for g in got]) for k in (0, 1))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            if any(g[2] for g in got):
                pairs = np.concatenate([pairs, [[-1, -1]]])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 20_000 and batch.column(0)[-1] != held[0].column(0)[0]:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return run


def verified(pairs: DataFrame, rows: DataFrame, similarity: float = SIMILARITY, size: int = SIMILAR_SHINGLE, few: int = 500_000) -> DataFrame:
    """Those of ``pairs`` (a, b) of numbers ``at`` whose whole texts are similar enough.

    Only texts that a pair names are shuffled: up to ``few`` numbers are broadcast to pick them.
    """
    named = materialise(pairs.select(F.col("a").alias("named")).union(pairs.select("b")).distinct(), "named")
    hint = F.broadcast if named.count() <= few else (lambda x: x)
    texts = materialise(rows.join(hint(named), F.col("at") == F.col("named"), "left_semi").select("at", "text"), "named-texts")

    def run(batches):
        @lru_cache(maxsize=64)
        def own(at: int, text: str | None) -> np.ndarray:
            return shingle_set(text, size)

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p, q = own(a, x), own(b, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    one = texts.select(F.col("at").alias("a"), F.col("text").alias("x"))
    two = texts.select(F.col("at").alias("b"), F.col("text").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, ddl("a long, b long"))


def similar_rows(rows: DataFrame, similarity: float = SIMILARITY, size: int = SIMILAR_SHINGLE) -> DataFrame:
    """(at, root) for each row of ``rows`` (at, text), whose ``at`` are different numbers from 0.

    ``root`` is the least ``at`` that links reach. Linked are rows whose sets of ``size``-word
    shingles (fewer words: the whole sequence) have a Jaccard similarity of ``similarity`` or
    more; rows without a word, null texts among them, are alike. Rows with the same set are
    one node. Every link is verified by whole texts; a pair is missed only if its fingerprints
    differ in over ``WIDE`` bits or it shares none of ``BANDS`` keys (see there). Of a hot key
    one task holds 32 + ``RANGES`` bytes a node. An empty table gives an empty table.
    """

    def prints(texts):
        got = [sketch(t, size) for t in texts]
        return np.array([g[0] for g in got], np.uint64).view(np.int64), *([g[k] for g in got] for k in (1, 2, 3))

    seen = materialise(map_rows(rows, ["at"], ["text"], "fp long, content long, keys array<long>, counts binary", lambda: prints), "sketches")
    nodes = materialise(seen.groupBy("fp", "content").agg(F.min("at").alias("node"), F.any_value("keys").alias("keys")), "nodes")
    spread = nodes.select(F.explode("keys").alias("key"), "node", "fp").repartition("key").sortWithinPartitions("key")
    shared = spread.mapInArrow(_shared_keys, ddl("key long, node long, fp long"))
    shared = materialise(shared.join(seen.select(F.col("at").alias("node"), "counts"), "node"), "shared")

    # Operator 8 itself: fingerprints within the distance, then those that are equal.
    of_print = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    near = link_fingerprints(of_print)
    near = near.join(of_print.select(F.col("fp").alias("a"), F.col("first").alias("one")), "a").join(of_print.select(F.col("fp").alias("b"), F.col("first").alias("two")), "b").select("one", "two")
    near = near.union(nodes.join(of_print, "fp").filter("node <> first").select("first", "node"))
    tested = materialise(near.select(F.least("one", "two").alias("a"), F.greatest("one", "two").alias("b")).distinct(), "tested")
    links, limit = materialise(verified(tested, rows, similarity, size), "verified"), 4
    while True:
        roots = materialise(components(links), "roots")
        known = shared.join(roots, "node", "left").select("key", "node", "fp", F.coalesce("root", "node").alias("root"), "counts")
        pairs = known.repartition("key").sortWithinPartitions("key").mapInArrow(_pairs_task(limit, similarity), ddl("a long, b long")).distinct()
        pairs = materialise(pairs, "pairs")
        new = materialise(pairs.filter("a >= 0").join(tested, ["a", "b"], "left_anti"), "new")
        if not new.isEmpty():
            links = links.union(materialise(verified(new, rows, similarity, size), "verified"))
            tested = tested.union(new)
        elif pairs.isEmpty() or pairs.filter("a < 0").isEmpty():
            break
        limit *= 8
    grouped = nodes.join(roots, "node", "left").select("fp", "content", F.coalesce("root", "node").alias("root"))
    return seen.join(grouped, ["fp", "content"]).select("at", "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``df``: its id, ``fingerprint`` and ``component_id``.

    ``component_id`` is the smallest id reachable over links, the row's own included;
    it is null only if no id of the component is known. Null, empty and blank texts
    have fingerprint zero, linked like any other. Repeated rows and ids keep their
    rows; long texts are hashed whole, in parts. An empty table gives an empty table. Only
    id and text are read, whatever other columns are called, the text once: fingerprints
    are written to the shared folder.
    """
    prints = materialise(map_rows(df, [id_col], [text_col], "fp long", lambda: lambda texts: (np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64).tolist(),)).withColumnRenamed(id_col, "id"), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(link_fingerprints(nodes))
    linked = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    linked = materialise(linked, "linked")
    groups = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = linked.join(groups, "root").select(F.col("fp").alias("_fp"), "component_id")
    out = prints.join(by_print, prints.fp == by_print._fp)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
