"""Language-model scores by compression cross-entropy (operator 2).

Two dictionaries are gathered from counts over the whole corpus: one of in-domain
rows, one of all rows. Both may have ``GROWTH`` times the square root of the corpus's
bytes (25 MB: 0.3 MB, 0.5 GB: 1.4 MB, 30 GB: 11 MB), at least ``DICTIONARY``, so rarer
terms enter as the corpus grows. Match tables are as long as the dictionary: a Python
worker holds up to 18 times its bytes for each of the two. A text's cross-entropy under a dictionary is the size of its
zstandard frames, block by block, with that dictionary. The score is the difference
of the two sizes over their sum: above 0, the text is closer to the domain.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, map_rows, materialise, probable_members

#: Least bytes of a dictionary; bytes of text compressed at once; longest term; level.
DICTIONARY, BLOCK, TERM, LEVEL = 96 * 1024, 16 * 1024, 48, 3
#: Bytes of a dictionary for the square root of a byte of the corpus.
GROWTH = 64
#: Different terms that a task holds before it passes its counts on.
HELD = 400_000


def _terms(data: bytes) -> list[bytes]:
    """White-space-separated words with the space before them, longer ones in pieces."""
    return [p for w in data.split() for p in ([b" " + w] if len(w) < TERM else [w[i : i + TERM] for i in range(0, len(w), TERM)])]


def term_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, n) over all rows: each task adds up, then terms are shuffled once."""

    def run(batches):
        def out(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        seen = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for text in batch.column(0).slice(at, 64).to_pylist():
                    seen.update(_terms((text or "").encode("utf-8", "replace")))
                if len(seen) > HELD:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    return df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, ddl("term binary, n long")).groupBy("term").agg(F.sum("n").alias("n"))


def rows_of(df: DataFrame, members: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``df`` whose id is in the column ``member`` of ``members``, which has each id once.

    Only the text of probable members is shuffled, by the same plan at every size; the
    join verifies them. Null ids are no members.
    """
    near = probable_members(df, members, id_col)
    return near.join(members.select("member").hint("shuffle_merge"), near[id_col] == F.col("member"), "left_semi")


def dictionary_size(counts: DataFrame) -> int:
    """Bytes of a dictionary for the corpus that was counted."""
    counted = counts.agg(F.sum(F.col("n") * F.length("term"))).first()[0] or 0
    return max(DICTIONARY, GROWTH * math.isqrt(counted))


def dictionary(counts: DataFrame, size: int = DICTIONARY) -> bytes:
    """The terms that save most bytes, up to ``size``, the best last, where matches are cheapest.

    Bytes are added up by what their terms save, which finds the least saving that fits
    whole; only terms from there on come to the driver. Ties are broken by the term.
    """
    saved = counts.select("term", (F.col("n") * F.length("term")).alias("saved"))
    levels = saved.groupBy("saved").agg(F.sum(F.length("term")).alias("bytes")).orderBy(F.col("saved").desc())
    least, left = None, size
    for level, n in levels.toLocalIterator():
        if n > left:
            break
        least, left = level, left - n
    else:
        level = None
    whole = saved.filter(F.col("saved") >= least).orderBy(F.col("saved").desc(), "term").select("term").toArrow()["term"].to_pylist() if least is not None else []
    some = saved.filter(F.col("saved") == level).orderBy("term").limit(left).select("term").toArrow()["term"].to_pylist() if level is not None else []
    for term in some:
        if len(term) > left:
            break
        whole.append(term)
        left -= len(term)
    return b"".join(reversed(whole))


def compressor(content: bytes):
    """A function from bytes to the sum of the sizes of their compressed blocks."""
    options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:
        compress = zstandard.ZstdCompressor(level=LEVEL, **options).compress
    else:
        # the level's own tables are for 128 Ki positions and would forget the others
        log = max(17, min(24, len(content).bit_length()))
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, window_log=max(18, min(27, (len(content) + BLOCK).bit_length())), hash_log=log, chain_log=log, **options)
        known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(compression_params=params)
        compress = zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress
    return lambda data: sum(len(compress(data[at : at + BLOCK])) for at in range(0, len(data), BLOCK))


def score(df: DataFrame, domain: bytes, general: bytes, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, ``n_bytes``, ``domain_bytes``, ``general_bytes``, both cross-entropies
    in bits a byte, and ``score``. Null and empty texts: sizes and entropies 0, score 0."""

    def factory():
        one, two = compressor(domain), compressor(general)

        def fn(texts):
            data = [(t or "").encode("utf-8", "replace") for t in texts]
            n, a, b = [len(d) for d in data], [one(d) for d in data], [two(d) for d in data]
            bits = lambda sizes: [8.0 * s / m if m else 0.0 for s, m in zip(sizes, n, strict=True)]
            return n, a, b, bits(a), bits(b), [(y - x) / (x + y) if x + y else 0.0 for x, y in zip(a, b, strict=True)]

        return fn

    return map_rows(df, keep, [text_col], "n_bytes long, domain_bytes long, general_bytes long, domain_bits double, general_bits double, score double", factory)


def compression_scores(df: DataFrame, domain: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Gathers one dictionary from all texts of ``domain``, one from all of ``df``, and scores each row of ``df``.

    No row in ``domain``: its dictionary is empty. Terms that save equally much enter in
    their own order. Null texts count as empty; long texts are compressed whole, block by
    block; ids are only kept, so they may be null or repeat. Repeated rows give equal rows
    and count each time; an empty table gives an empty table; columns that aren't named
    are not read, so their names can't clash. Counts are written to the shared folder;
    two dictionaries of at most :func:`dictionary_size` bytes go to the tasks.
    """
    every, own = materialise(term_counts(df, text_col), "terms"), materialise(term_counts(domain, text_col), "terms")
    size = dictionary_size(every)
    return score(df, dictionary(own, size), dictionary(every, size), keep, text_col)
