"""Pieces shared by the operators: scratch tables and row-wise Arrow mapping."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_SCRATCH: dict[str, str] = {}


def _forget(session: SparkSession, path: str) -> None:
    try:
        jvm = session.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone already, and with it the way to delete
        pass


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, removed when it ends.

    The setting is read from the session. Only where it is unset and the master is
    local, as in tests, a temporary folder takes its place; on a cluster that is an
    error, as its machines don't share such a folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        if not root:
            root = "file://" + tempfile.mkdtemp(prefix="glossaria-")
            spark.conf.set("spark.checkpoint.dir", root)
        _SCRATCH[app] = f"{root.rstrip('/')}/glossaria-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _SCRATCH[app])
    return _SCRATCH[app]


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again, which cuts its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that :func:`materialise` returned."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/glossaria-" in path:
            _forget(df.sparkSession, path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever its letters' case."""
    taken, name = {c.lower() for c in df.columns}, f"__{base}"
    while name.lower() in taken:
        name += "_"
    return name


def ddl(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def field_of(df: DataFrame, name: str) -> T.StructField:
    """The field that a name means to Spark: letters' case counts only if two names differ by it alone."""
    if name in df.columns:
        return df.schema[name]
    return df.select(F.col(f"`{name}`")).schema[0]


def map_rows(
    df: DataFrame,
    keep: Sequence[str],
    given: Sequence[str],
    added: str,
    factory: Callable[[], Callable[..., Sequence[Sequence]]],
    rows: int = 256,
) -> DataFrame:
    """Adds columns that Python computes from the columns ``given``, row by row.

    ``factory()`` runs once in a task and returns a function from lists, one for
    each given column, to lists, one for each column of the DDL string ``added``.
    It is called with at most ``rows`` rows at a time, so what it holds is bounded.
    The columns ``keep`` pass through as Arrow data; all other columns are dropped.
    """
    extra = ddl(added)
    schema = T.StructType([T.StructField(c, field_of(df, c).dataType) for c in keep] + list(extra.fields))
    arrow = to_arrow_schema(extra)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = factory()
        names = [f.name for f in schema.fields]
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn(*(part.column(i).to_pylist() for i in range(n_keep, part.num_columns)))
                cols = [part.column(i) for i in range(n_keep)]
                cols += [pa.array(v, f.type) for v, f in zip(got, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names)

    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], *[F.col(f"`{c}`").alias(f"g{i}") for i, c in enumerate(given)])
    return source.mapInArrow(run, schema)


def beside(given: Column, added: str, factory: Callable[[], Callable[[list], Sequence[Sequence]]], rows: int = 256) -> Column:
    """A struct that Python computes from one column, as :func:`map_rows` does, next to its row.

    Only that column goes to Python and only the struct comes back; all else of the row
    stays where it is, whatever its names. The expression is evaluated once for a row.
    """
    schema = ddl(added)
    arrow = to_arrow_schema(schema)

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = factory()
        for array in arrays:
            parts = []
            for at in range(0, len(array), rows):
                got = fn(array.slice(at, rows).to_pylist())
                parts.append(pa.StructArray.from_arrays([pa.array(v, f.type) for v, f in zip(got, arrow, strict=True)], fields=list(arrow)))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct(list(arrow)))

    return F.arrow_udf(run, schema).asNondeterministic()(given)


def probable_members(df: DataFrame, members: DataFrame, column: str, bits: int = 1 << 27) -> DataFrame:
    """``df`` without rows whose ``column`` surely isn't in the column ``member`` of ``members``.

    A bitmap of hashes, 32 bits a member and ``bits`` (16 MB) at most, is broadcast and asked
    twice; nulls go. What is left holds every member, and by chance a few others: with more
    members than the bitmap is made for, more of them, never fewer members.
    """
    n = members.count()
    size = min(bits, max(1 << 15, 1 << (32 * n).bit_length()))
    place = lambda c, seed: F.pmod(F.xxhash64(F.lit(seed), c), F.lit(size))
    marked = members.select(F.explode(F.array(*[place(F.col("member"), k) for k in (1, 2)])).alias("at"))
    pages = marked.groupBy((F.col("at") / (1 << 15)).cast("long").alias("page")).agg(F.bitmap_construct_agg((F.col("at") % (1 << 15)).cast("int")).alias("bits")).toArrow()
    bitmap = np.zeros(size >> 3, np.uint8)
    for page, part in zip(pages["page"].to_pylist(), pages["bits"].to_pylist(), strict=True):
        bitmap[page << 12 : (page + 1) << 12] = np.frombuffer(part, np.uint8)
    shared = df.sparkSession.sparkContext.broadcast(bitmap)

    def asked(first: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        there = shared.value
        for pair in first:
            a, b = (x.to_numpy(zero_copy_only=False) for x in pair)
            yield pa.array((there[a >> 3] >> (a & 7) & there[b >> 3] >> (b & 7) & 1).astype(bool))

    own = F.col(f"`{column}`")
    return df.filter(own.isNotNull()).filter(F.arrow_udf(asked, "boolean")(place(own, 1), place(own, 2)))


def crc_of_id(id_col: str):
    """crc32 of the id written as text; null where the id is null."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
