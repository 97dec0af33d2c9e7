"""Quality scores by a generalised additive model with pairwise interactions (operator 10).

Every feature has a lookup table over its bins, every chosen pair of features one
over their coarse bins. The tables are learned by boosting that visits one feature
after another, each time with a tree of few leaves; a score is the sum of looked-up
values, added for a whole block of rows at a time.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, crc_of_id, map_rows
from .langid import bounded, stratified

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "digits", "upper", "space", "points", "symbols", "wide", "entropy",
    "distinct_words", "top_word", "distinct_pairs", "repeated_lines", "line_length", "short_words", "runs", "markup", "longest_word",
)
_KINDS = np.full(256, 7, np.int64)  # 7: other symbols
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:!?'\"-()", b"<>{}[]=/\\|", bytes(range(128, 256)))):
    _KINDS[list(_bytes)] = _kind


def features(text: str | None) -> list[float]:
    """What the model knows of a whole text; zeros for an empty one."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * len(FEATURES)
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = counts[counts > 0] / n
    kinds = np.bincount(_KINDS, counts, minlength=8) / n
    words = data.split()
    m = max(1, len(words))
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        np.log1p(n), np.log1p(len(words)), (n - kinds[3] * n) / m, kinds[0] + kinds[1], kinds[2], kinds[1], kinds[3], kinds[4], kinds[7], kinds[6], float(-(share * np.log2(share)).sum()),
        len(seen) / m, max(seen.values(), default=0) / m, len(set(zip(words, words[1:]))) / max(1, len(words) - 1), 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))),
        sum(c for w, c in seen.items() if len(w) <= 3) / m, sum(a == b for a, b in zip(words, words[1:])) / m, kinds[5], np.log1p(max(map(len, seen), default=0)),
    ]


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features."""
        f = np.full(len(x), self.intercept)
        bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        for table, b in zip(self.tables, bins, strict=True):
            f += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            f += table[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-f))


def _split(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """The best gain and place of one cut through ordered bins."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    total, mass = g.sum(), h.sum()
    gain = a * a / (b + ridge) + (total - a) ** 2 / (mass - b + ridge) - total * total / (mass + ridge)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 2.0) -> np.ndarray:
    """A value for each bin: Newton steps of the leaves of a tree over ordered bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, cut, k = max((*_split(g[a:b], h[a:b], ridge), k) for k, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, float]:
    """Four leaves over a grid: a cut across the first axis, one across the second on each side."""
    _, cut = _split(g.sum(1), h.sum(1), ridge)
    out, gain = np.zeros_like(g), -(g.sum() ** 2) / (h.sum() + ridge)
    for rows in (slice(0, cut), slice(cut, None)):
        if g[rows].size:
            values = shallow_tree(g[rows].sum(0), h[rows].sum(0), 2, ridge)
            out[rows] = values
            gain += float((values * g[rows].sum(0)).sum())
    return out, gain


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int = 32, rounds: int = 150, n_pairs: int = 6, pair_rounds: int = 60, rate: float = 0.1, coarse_bins: int = 8) -> AdditiveModel:
    """The model of rows ``x`` with labels ``y`` (0 or 1) and weights ``w``.

    No rows, or one label only: constant, with the smoothed share of label 1.
    """
    k = x.shape[1]
    w = w / w.mean() if len(w) else w
    share = ((w * y).sum() + 1) / (w.sum() + 2)
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, j], cuts)) if len(x) else np.zeros(0) for j in range(k)]
    coarse = [np.arange(len(e) + 1) * coarse_bins // (len(e) + 1) for e in edges]
    model = AdditiveModel(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], coarse, [], [])
    if not len(x) or y.min() == y.max():
        return model
    b = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]
    f = np.full(len(x), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-f))
        return w * (y - p), w * p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            size = len(edges[j]) + 1
            step = rate * shallow_tree(np.bincount(b[j], g, size), np.bincount(b[j], h, size))
            model.tables[j] += step
            f += step[b[j]]
    c = [coarse[j][b[j]] for j in range(k)]
    grid = lambda i, j, v: np.bincount(c[i] * coarse_bins + c[j], v, coarse_bins**2).reshape(coarse_bins, coarse_bins)
    g, h = slopes()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(k) for j in range(k) if i != j), reverse=True)
    for _, i, j in gains:
        if len(model.pairs) < n_pairs and (j, i) not in model.pairs:
            model.pairs.append((i, j))
    model.pair_tables = [np.zeros((coarse_bins, coarse_bins)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for table, (i, j) in zip(model.pair_tables, model.pairs, strict=True):
            g, h = slopes()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, h))[0]
            table += step
            f += step[c[i], c[j]]
    return model


def train(df: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 6000) -> AdditiveModel:
    """Fits on labelled rows of ``df`` whose id fulfils ``usable``.

    About ``per_class`` ids of each label are picked by a hash (all, if there are
    fewer) and weighted back to the shares among all labels; only they are broadcast
    (some 10 bytes for each of 24,000 at most) to find their texts, and only their
    features come to the driver, for twice as many rows at most where ids repeat. A text
    labelled both ways counts for both.
    """
    own = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(usable)
    sample, sizes = stratified(own, "label", per_class, "id")
    sample = bounded(sample.distinct(), 2 * per_class)
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(sample), "id")
    texts = bounded(texts, 2 * per_class)
    got = map_rows(texts, ["id", "label"], ["text"], "x array<double>", lambda: lambda t: ([features(v) for v in t],)).toArrow().sort_by([("id", "ascending"), ("label", "ascending")])
    y = got["label"].to_numpy().astype(float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), len(FEATURES))
    weight = {v: n / max(1, (y == v).sum()) for v, n in sizes.items()}
    return fit(x, y, np.array([weight[int(v)] for v in y]))


def prediction(df: DataFrame, model: AdditiveModel, text: Column) -> Column:
    """A struct of ``score`` for a column of texts of ``df``; null texts count as empty.

    The broadcast model has some thousand numbers, whatever the input's size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        m = shared.value
        return lambda texts: (m.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))).tolist(),)

    return beside(text, "score double", factory)


def not_held_out(id_col: str) -> Column:
    """Ids to learn from: crc32 of the id as text isn't 1 modulo 3."""
    return crc_of_id(id_col) % 3 != 1


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Trains without the held-out rows and scores every row of ``df``.

    Returns the id, ``held_out``, ``score`` and ``predicted``. Only the text enters a
    score. Without labels every score is 0.5. Null ids aren't held out and teach
    nothing; empty texts get the score of all-zero features; texts count whole, however
    long; repeated rows give equal rows; a score of exactly 0.5 predicts 1; an empty table
    gives an empty table; other columns are not read, whatever their names.
    """
    model = train(df, labels, not_held_out("id"), id_col, text_col, label_col)
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = own.select("id", prediction(own, model, F.col("text"))["score"].alias("score"))
    return out.select(F.col("id").alias(id_col), F.coalesce(crc_of_id("id") % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
