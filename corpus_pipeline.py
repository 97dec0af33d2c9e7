"""A corpus through five stages, each written and read again as the next one's input.

Language ID, quality, near-duplicates, decontamination and encoding: every stage works
on all that its predecessor kept. The first four return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm import decontam, langid, piece_lattice, quality, simhash
from glossaria.llm.common import fresh, materialise
from glossaria.llm.queries import tokenizer_path

#: A language is rejected if its calibrated probability is lower, a text if its quality is.
MIN_LANGUAGE, MIN_QUALITY = 0.5, 0.5
#: Ids that may be broadcast to drop rows; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def _kept(docs: DataFrame, judged: Column, condition: str) -> DataFrame:
    """Rows for which ``condition`` holds of ``judged``, which it calls j; only texts go to Python."""
    name = fresh(docs, "judged")
    own = docs.withColumn(name, judged)
    return own.filter(F.expr(condition.replace("j.", f"`{name}`."))).select(*[f"`{c}`" for c in docs.columns])


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as one column beside their number ``at``, written so that numbers stay."""
    return materialise(docs.select(F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("at")), "numbered")


def _without(numbered: DataFrame, drop: DataFrame) -> DataFrame:
    """Rows whose number isn't in column ``at`` of ``drop``, whose size decides how they are joined."""
    drop = materialise(drop.select(F.col("at").alias("dropped")).distinct(), "drop")
    hint = F.broadcast if drop.count() <= BROADCAST_IDS else (lambda x: x)
    return numbered.join(hint(drop), F.col("at") == F.col("dropped"), "left_anti").select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a language that the model knows; its score must reach ``MIN_LANGUAGE``.

    Null, empty and letterless texts go. Rows are judged one by one by their whole text:
    null and repeated ids and repeated rows stay or go like any other.
    """
    model = langid.train(docs, langid.not_held_out())
    return _kept(docs, langid.prediction(docs, model, F.col("text")), f"j.lang_pred <> 'und' and j.score >= {MIN_LANGUAGE}")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that the quality model scores ``MIN_QUALITY`` or more.

    A null text counts as empty. Without labels every score is 0.5, and all rows stay.
    Rows are judged one by one, whatever their ids.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, quality.not_held_out("id"))
    return _kept(docs, quality.prediction(docs, model, F.col("text")), f"j.score >= {MIN_QUALITY}")


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates one row: that with the smallest id, the first such.

    Near-duplicates have a Jaccard similarity of 0.8 or more over shingles of five words, or
    are linked by such. Null ids come after all others; null, empty and blank texts are alike.
    Rows are dropped one by one, whatever ids they share.
    """
    rows = _numbered(docs)
    order = F.struct(F.col("row.doc_id").isNull().alias("unknown"), F.col("row.doc_id").alias("id"), "at")
    groups = materialise(simhash.similar_rows(rows.select("at", F.col("row.text").alias("text"))), "groups")
    many = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("root")
    placed = rows.select("at", order.alias("place")).join(groups.join(many, "root", "left_semi"), "at")
    first = placed.groupBy("root").agg(F.min("place").alias("first"))
    return _without(rows, placed.join(first, "root").filter("place.at <> first.at").select("at"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a window of a benchmark item, and no other row of their id.

    Null and empty texts and items hold no window; repeated rows go together.
    """
    rows = _numbered(docs)
    found = decontam.contamination(rows.select("at", F.col("row.text").alias("text")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "at")
    return _without(rows, found.filter("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, one row for each row; null and empty texts have no ids."""
    return piece_lattice.encode(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id", "lang", "source"]).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("quality", good_quality),
    ("near_duplicates", unique),
    ("decontamination", uncontaminated),
    ("encoding", encoded),
]

#: Trained models and fingerprints have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
