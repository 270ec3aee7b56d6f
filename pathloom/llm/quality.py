"""Quality: Bradley-Terry pairwise ranking of documents.

Each labelled pair of a good and a poor document is a preference; the chance that the first is preferred is
the logistic function of the difference of their scores, and a score is a weighted sum of features of the
text, so the fit is logistic loss on feature differences. Features are measures of the text (shares of
character classes, repetition of words, pairs of words and lines, lengths), each cut at quantiles of the
sample into steps. The cut between good and poor is the quantile of the sample's scores at its share of poor
documents; a score over all is the logistic function of the distance to that cut.

Null and empty texts have all measures 0. Scoring reads whole texts. Equal rows score alike; without both
labels in the sample all scores are 0.5; an empty table gives no row. Columns besides doc_id and text are not
read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .linear import fold, minimise, sample, sigmoid


def _classes() -> np.ndarray:
    """Byte -> class: upper, lower, digit, space, line end, sentence marks, bar, exclamation, other marks, beyond ASCII."""
    out = np.full(256, 9)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 5 if c in ".,;:?'\"()-" else 6 if c == "|" else 7 if c == "!" else 8
    return out


CLASSES = _classes()
MEASURES = 22


def measures(text: str | None) -> list[float]:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * MEASURES
    shares = np.bincount(CLASSES[raw], minlength=10) / n
    words = text.split()
    w = max(len(words), 1)
    counts = Counter(words)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    line_n = max(len(lines), 1)
    letters = sum(len(x) for x in words)
    return [
        *shares.tolist(),
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        letters / w,
        len(counts) / w,
        len(counts) / w * float(np.log1p(w)),
        max(counts.values(), default=0) / w,
        len(pairs) / max(w - 1, 1),
        sum(a == b for a, b in zip(words, words[1:])) / w,
        len(set(lines)) / line_n,
        letters / line_n / 100,
        sum(1 for x in words if x.isupper() and len(x) > 1) / w,
        sum(1 for x in words if not (x[-1].isalnum() or x[-1] in ".,;:?'\"()")) / w,
    ]


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, and the measures of the text."""

    def run(batches):
        for batch in batches:
            rows = [measures(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])

    chosen = docs.select(*keep, F.col("text").alias("_text"))
    return chosen.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]) + ", x array<double>")


class QualityModel:
    """cuts: per measure the ascending steps; weights: per step, added up for the steps passed."""

    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray, middle: float, spread: float):
        self.cuts, self.weights, self.middle, self.spread = cuts, weights, middle, spread

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid((steps_of(x, self.cuts) @ self.weights - self.middle) / self.spread)


def steps_of(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([(x[:, i, None] > c[None, :]).astype(np.float64) for i, c in enumerate(cuts)], 1)


def fit_measures(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, steps: int = 12, l2: float = 0.3) -> QualityModel:
    """pairs: how many preferences are drawn, with a fixed seed, from those the labels give."""
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        return QualityModel([np.zeros(1)] * MEASURES, np.zeros(MEASURES), 0.0, 1.0)
    levels = np.linspace(0, 1, steps + 2)[1:-1]
    # steps at quantiles of each label's documents, so that a small class has its own
    cuts = [np.unique(np.concatenate([np.quantile(x[g, i], levels) for g in (good, poor)])) for i in range(x.shape[1])]
    f = steps_of(x, cuts)
    rng = np.random.default_rng(7)
    total = min(pairs, len(good) * len(poor))
    a, b = rng.choice(good, total), rng.choice(poor, total)

    # sum over pairs of log(1 + exp(-(s_a - s_b))), by document: gradients gather at the documents
    def loss(w):
        s = f @ w
        z = s[a] - s[b]
        r = -sigmoid(-z) / total
        g = f.T @ (np.bincount(a, r, len(s)) - np.bincount(b, r, len(s)))
        return np.mean(np.logaddexp(0, -z)) + 0.5 * l2 * (w @ w) / len(y), g + l2 * w / len(y)

    w = minimise(loss, np.zeros(f.shape[1]))
    s = np.sort(f @ w)
    at = len(poor)  # the quantile at the share of poor documents
    middle = float((s[at - 1] + s[min(at, len(s) - 1)]) / 2)
    return QualityModel(cuts, w, middle, float(max(s.std(), 1e-9) / 4))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, limit: int = 8_000) -> QualityModel:
    """Fits on at most `limit` labelled documents outside the held-out fold."""
    small_batches(docs.sparkSession)
    chosen = sample(labels, "quality", parts, held, limit)
    rows = sorted(tuple(r) for r in measured(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), ["doc_id", "label"]).collect())  # at most `limit` rows
    return fit_measures(np.array([r[2] for r in rows], np.float64).reshape(-1, MEASURES), np.array([r[1] for r in rows]))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (false without an id), score, predicted for each row of docs."""
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            x = np.array([measures(t) for t in batch.column(1).to_pylist()], np.float64).reshape(-1, MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
