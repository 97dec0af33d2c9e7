"""Language identification by sparse multinomial logistic regression (operator 6).

Features are TF-IDF weights of hashed character n-grams. The model is trained with
follow-the-regularised-leader (per-coordinate rates, elastic-net penalty) on a
stratified sample of labelled rows, and its probabilities are calibrated with a
temperature fitted on rows that the training left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, crc_of_id, ddl, map_rows

#: Hash buckets, n-gram lengths, characters hashed at once.
BUCKETS, LENGTHS, CHUNK = 1 << 15, (1, 2, 3), 1 << 18
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of the whole, lower-cased text, and how often each occurs."""
    total = None
    over = max(LENGTHS) - 1
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    for at in range(0, len(text), CHUNK):
        tail = text[max(0, at - over) : at] if at else " "
        codes = np.frombuffer((tail + text[at : at + CHUNK]).lower().encode("utf-32-le", "replace"), np.uint32)
        old = len(tail.lower()) if at else 0
        h, found = np.zeros(len(codes), np.uint32), []
        for n in range(1, over + 2):
            if n > len(codes):
                break
            h = (h[: len(codes) - n + 1] if n == 1 else h[:-1]) * np.uint32(1000003) ^ codes[n - 1 :]
            if n in LENGTHS:
                mixed = ((h + np.uint32(n)) * _MIX) >> shift
                found.append(mixed[max(0, old - n + 1) :])
        part = np.bincount(np.concatenate(found), minlength=BUCKETS)
        total = part if total is None else total + part
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    buckets = np.flatnonzero(total)
    return buckets, total[buckets]


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # labels x (buckets + 1), the last for the intercept
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * self.idf[at]
        size = np.sqrt((x * x).sum())
        return np.append(at, BUCKETS), np.append(x / size if size else x, 1.0)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at, x = self.vector(at, counts)
        return self.weights[:, at] @ x

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest label and its calibrated probability; ``und`` and 0 without a letter."""
        if not self.labels or not has_letter(text):
            return "und", 0.0
        p = softmax(self.logits(*gram_counts(text)) / self.temperature)
        return self.labels[int(p.argmax())], float(p.max())


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7) -> np.ndarray:
    """Weights by follow-the-regularised-leader, proximal form, one row at a time.

    Three tables of ``k`` times ``BUCKETS`` 32-bit numbers are held: 0.4 MB a label.
    """
    z = np.zeros((k, BUCKETS + 1), np.float32)
    n = np.zeros_like(z)
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            zi, ni = z[:, at], n[:, at]
            w = solve(zi, ni)
            p = softmax(w @ x)
            p[y[i]] -= 1
            g = np.outer(p, x)
            more = ni + g * g
            z[:, at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[:, at] = more
    return solve(z, n).astype(np.float32)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log-loss, by golden-section search.

    Targets are smoothed as if one more row had been wrong (1 - 1 / (rows + 2)), so the
    loss has its minimum inside the range also where all rows are told apart.
    """
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    wrong = 1 / (len(y) + 2)
    target = np.full(logits.shape, wrong / (logits.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - wrong

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(-(target * (z - np.log(np.exp(z).sum(axis=1, keepdims=True)))).sum(axis=1).mean())

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(df: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """In how many texts of ``df`` each bucket occurs, and the number of texts.

    Each task adds up its rows; at most ``BUCKETS`` rows come to the driver.
    """

    def run(batches):
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    if text:
                        total[gram_counts(text)[0]] += 1
                    n += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], ["bucket", "n"])

    rows = df.select(F.col(f"`{text_col}`")).mapInArrow(run, ddl("bucket int, n long")).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out, n = np.zeros(BUCKETS, np.int64), 0
    for bucket, count in rows:
        if bucket < 0:
            n = count
        else:
            out[bucket] = count
    return out, n


def stratified(df: DataFrame, by: str, per_class: int, id_col: str, seed: int = 11, in_all: int | None = None) -> tuple[DataFrame, dict]:
    """Rows of ``df`` picked by a hash of their id, about ``per_class`` for each value of ``by``
    and about ``in_all`` at most; also the number of rows of each value, counted over all of ``df``.

    The shares of the values, which the driver holds, are broadcast.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    if in_all and sizes:
        per_class = min(per_class, max(1, in_all // len(sizes)))
    kind = df.schema[by].dataType.simpleString()
    shares = df.sparkSession.createDataFrame([(v, min(1.0, per_class / n)) for v, n in sorted(sizes.items(), key=str)], f"_value {kind}, _share double")
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")), F.lit(1 << 30)) / float(1 << 30)
    picked = df.join(F.broadcast(shares), F.col(f"`{by}`") == F.col("_value")).filter(place < F.col("_share"))
    return picked.select(*[f"`{c}`" for c in df.columns]), sizes


def bounded(df: DataFrame, rows: int, seed: int = 13) -> DataFrame:
    """``df``, or about ``rows`` random rows of it if ids that repeat make it more than twice as large."""
    n = df.count()
    return df if n <= 2 * rows else df.sample(rows / n, seed=seed)


def train(df: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_class: int = 1000, in_all: int = 10_000) -> LanguageModel:
    """Fits on the rows where ``usable`` holds and text, label and id aren't null.

    Document frequencies are counted over all such rows. The weights are fitted on
    about ``per_class`` rows for each label (all, if there are fewer) and ``in_all``
    in all, twice that at most, so the driver holds a bounded sample; any number of
    labels may be learned, at 0.4 MB of the driver's memory for each. A fifth of the
    sample fits only the temperature. No rows: a model without labels.
    """
    own = df.filter(usable).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").alias("label")).filter("id is not null and text is not null and label is not null")
    sample, sizes = stratified(own, "label", per_class, "id", in_all=in_all)
    sample = bounded(sample, in_all)
    labels = sorted(sizes)
    df_counts, n = document_frequencies(own)
    model = LanguageModel(labels, np.zeros((len(labels), BUCKETS + 1), np.float32), np.log((1 + n) / (1 + df_counts)) + 1)
    if not labels:
        return model

    def features():
        def fn(texts):
            counts = [gram_counts(t if has_letter(t) else "") for t in texts]
            return [a.astype(np.int32) for a, _ in counts], [c.astype(np.int32) for _, c in counts]

        return fn

    taken = map_rows(sample, ["id", "label"], ["text"], "at array<int>, n array<int>", features).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    rows, y = [], []
    index = {v: i for i, v in enumerate(labels)}
    for at, counts, label in zip(taken["at"], taken["n"], taken["label"].to_pylist(), strict=True):
        if len(at.values):
            at, x = model.vector(at.values.to_numpy(), counts.values.to_numpy())
            rows.append((at.astype(np.int32), x.astype(np.float32)))
            y.append(index[label])
    del taken
    pa.default_memory_pool().release_unused()
    y = np.array(y, np.int64)
    aside = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~aside)
    model.weights = train_ftrl([rows[i] for i in fit], y[fit], len(labels))
    logits = np.array([model.weights[:, rows[i][0]] @ rows[i][1] for i in np.flatnonzero(aside)], np.float64).reshape(-1, len(labels))
    model.temperature = fit_temperature(logits, y[aside])
    return model


def prediction(df: DataFrame, model: LanguageModel, text: Column) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a column of texts of ``df``.

    Null texts and texts without a letter get ``und`` and 0; the whole text counts.
    The model is broadcast: labels x buckets weights, whatever the input's size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        predict = shared.value.predict
        return lambda texts: list(zip(*map(predict, texts), strict=True))

    return beside(text, "lang_pred string, score double", factory)


def not_held_out(id_col: str = "doc_id") -> Column:
    """Rows to learn from: crc32 of the id as text isn't 2 modulo 4 (null ids teach nothing)."""
    return crc_of_id(id_col) % 4 != 2


def identify_languages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Trains on ``df`` without the held-out rows and predicts every row.

    Returns the id, ``held_out``, ``lang_pred`` and ``score``. Only the text enters a
    prediction, however long it is. A null id is never learned from and not held out. Of
    equal scores the label that sorts first is predicted. Repeated rows give equal rows; an
    empty table gives an empty table; other columns are not read, whatever their names.
    """
    model = train(df, not_held_out(id_col), id_col, text_col, label_col)
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = own.select("id", prediction(own, model, F.col("text")).alias("p"))
    return out.select(F.col("id").alias(id_col), F.coalesce(crc_of_id("id") % 4 == 2, F.lit(False)).alias("held_out"), "p.lang_pred", "p.score")
