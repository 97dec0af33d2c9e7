"""Token counts by byte-pair merging with a heap over a linked list (operator 1).

Symbols of a pre-token form a doubly linked list. A heap holds the ranks of the
adjacent pairs; the lowest is popped, its two symbols are joined and the new
neighbours are pushed. A popped entry is stale, and passed over, if the pair now
at its place has another rank. The count is the number of initial symbols less
the number of merges; identifiers are never made.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Splits text before the merges, as byte-level vocabularies of this family do.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Counts that a worker remembers, and the longest pre-token remembered.
CACHE_SIZE, CACHE_CHARS = 400_000, 48
#: Texts beyond so many characters are matched one by one, never listed.
LIST_CHARS = 1_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class BpeCounter(dict):
    """Counts of pre-tokens; what is missing is counted, and remembered if short."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] << 24 | vocab[b], (rank, vocab[a + b]))
        self.words = regex.compile(WORDS)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None

    def __missing__(self, word: str) -> int:
        n = self.merge(word.encode("utf-8", "replace"))
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[word] = n
        return n

    def merge(self, data: bytes) -> int:
        """Symbols that are left of ``data`` after all merges."""
        n = len(data)
        if n < 2:
            return n
        ranks = self.ranks
        symbol = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get(symbol[i] << 24 | symbol[i + 1])
            if found:
                heap.append(found[0] << 32 | i)
        heapq.heapify(heap)
        merges = 0
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            left = symbol[i]
            j = after[i]
            if left < 0 or j >= n:
                continue
            found = ranks.get(left << 24 | symbol[j])
            if not found or found[0] != rank:
                continue
            merges += 1
            symbol[i], symbol[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if new := ranks.get(found[1] << 24 | symbol[k]):
                    heapq.heappush(heap, new[0] << 32 | i)
            h = before[i]
            if h >= 0 and (new := ranks.get(symbol[h] << 24 | found[1])):
                heapq.heappush(heap, new[0] << 32 | h)
        return n - merges

    def plain(self, text: str) -> int:
        if len(text) > LIST_CHARS:
            return sum(self[m.group()] for m in self.words.finditer(text))
        return sum(map(self.__getitem__, self.words.findall(text)))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; a special string inside it is one token."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        total, at = 0, 0
        for m in self.special.finditer(text):
            total += self.plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self.plain(text[at:])


@lru_cache(maxsize=4)
def counter(path: str) -> BpeCounter:
    return BpeCounter(path)


def count_tokens(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row for each row of ``df``: its id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    ``tokenizer`` is the path of a byte-level BPE vocabulary in JSON, present on
    every executor. Narrow: no shuffle, nothing broadcast. A null text counts as
    empty (0 bytes, 0 tokens, not over the limit); null and repeated ids pass
    through; an empty table gives an empty table; columns other than the two named
    are not read. Memory follows the longest text and the bounded cache.
    """

    def factory():
        count = counter(tokenizer).count

        def fn(texts):
            texts = [t or "" for t in texts]
            tokens = [count(t) for t in texts]
            return [len(t.encode("utf-8", "replace")) for t in texts], tokens, [n > limit for n in tokens]

        return fn

    return map_rows(df, [id_col], [text_col], "n_bytes long, n_tokens long, over_limit boolean", factory)


def token_totals(counts: DataFrame, by: str | None = None) -> DataFrame:
    """Sums of what :func:`count_tokens` returned, in all or for each ``by``."""
    return counts.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count_if("over_limit").alias("n_over_limit"))
