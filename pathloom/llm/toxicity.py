"""Toxicity: a logistic classifier on the presence of words and word beginnings, with a counterfactual penalty.

For each labelled text that names a group, copies are made with its identity terms swapped for others of the
same list, with the beginnings of words that go and come with them, and the fit is charged for the square of the
change in score. What a term alone adds to the score
is so driven towards what every other term adds, and neutral mentions of a group stay low.

Null and empty texts get the score of a text without known words. Words are compared in lower case; scoring
reads whole texts. Equal rows score alike; without labels every score is the prior 0.5 shrunk by one
pseudo-negative; an empty table gives no row. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import cut, small_batches
from .linear import fold, minimise, sample, sigmoid

#: Terms that name groups, by kind; terms of a kind are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man", "girl", "boy", "female", "male", "transgender"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "muslims", "christians", "jews"),
    ("black", "white", "asian", "african", "latino", "european", "arab", "hispanic"),
    ("immigrants", "refugees", "foreigners", "citizens", "natives"),
    ("old", "young", "elderly", "blind", "deaf", "disabled"),
    ("frauen", "männer", "juden", "muslime", "christen", "ausländer"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros"),
)

LETTERS = re.compile(r"[^\W\d_]+")


def key(word: str) -> int:
    """64-bit key of a word, signed."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


#: Lengths of the beginnings of words that count besides whole words, for inflected and compound forms.
BEGINNINGS = (3, 4, 5, 6, 7)


TERMS = frozenset(t for group in IDENTITY_TERMS for t in group)


def words_of(text: str | None) -> set[str]:
    return set(LETTERS.findall((text or "").lower()))


def keys_of(words: set[str]) -> set[int]:
    """Keys of the words and of their beginnings."""
    begun = {w[:n] for n in BEGINNINGS for w in words if len(w) > n}
    return {key(w) for w in words} | {key("^" + b) for b in begun}


def word_keys(text: str | None) -> set[int]:
    """Keys of the distinct words of the text and of their beginnings."""
    return keys_of(words_of(text))


def own_keys(text: str | None) -> list[tuple[int, int]]:
    """Key of each identity term in the text, with each key that the text has from no other word."""
    words = words_of(text)
    out = []
    for t in sorted(words & TERMS):
        alike = {w for w in words if w != t and w[: min(BEGINNINGS)] == t[: min(BEGINNINGS)]}
        out += [(key(t), k) for k in sorted(keys_of({t}) - keys_of(alike))]
    return out


def counted(docs: DataFrame) -> DataFrame:
    """key, df, df1: in how many texts each key is, and in how many toxic ones; under the null key, how many there are."""

    def run(batches):
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = [np.fromiter(word_keys(t), np.int64) for t in batch.column(0).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            vocab, where, df = np.unique(flat, return_inverse=True, return_counts=True)
            df1 = np.bincount(where, weights=np.repeat(labels, [len(k) for k in keys]), minlength=len(vocab)).astype(np.int64)
            totals = pa.array([None], pa.int64()), pa.array([len(labels)]), pa.array([int(labels.sum())])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([t, pa.array(x)]) for t, x in zip(totals, (vocab, df.astype(np.int64), df1))], ["key", "df", "df1"])

    parts = docs.select("text", "label").mapInArrow(run, "key long, df long, df1 long")
    return parts.groupBy("key").agg(F.sum("df").alias("df"), F.sum("df1").alias("df1"))


def telling(counts: DataFrame, words: int, gain_least: float) -> np.ndarray:
    """The `words` keys whose presence tells most of the label (chi-square, above `gain_least`), ascending."""
    totals = counts.where("key IS NULL").first()
    n, n1 = (totals["df"], totals["df1"]) if totals else (0, 0)
    expected = F.col("df") * float(n1)
    gain = F.expr(f"pow(df1 - df * {n1}D / {max(n, 1)}D, 2)") / (F.greatest(expected / max(n, 1) * (1 - n1 / max(n, 1)), F.lit(1e-9)) * F.greatest(1 - F.col("df") / max(n, 1), F.lit(1e-9)))
    best = counts.where("key IS NOT NULL AND df >= 3").select("key", gain.alias("gain")).where(F.col("gain") > gain_least)
    return np.array(sorted(r["key"] for r in best.orderBy(F.desc("gain"), "key").limit(words).collect()), np.int64)


def keyed(docs: DataFrame, chosen: np.ndarray) -> DataFrame:
    """label, which of the keys `chosen`, ascending, each text has, and its own_keys of them."""
    known = set(chosen.tolist())

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = [np.intersect1d(np.fromiter(word_keys(t), np.int64), chosen, assume_unique=True).tobytes() for t in texts]
            own = [np.array([p for p in own_keys(t) if p[1] in known], np.int64).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(keys, pa.binary()), pa.array(own, pa.binary())], ["label", "keys", "own"])

    return docs.select("text", "label").mapInArrow(run, "label int, keys binary, own binary")


class ToxicityModel:
    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.bias + sum(self.weights.get(k, 0.0) for k in word_keys(text))))


def with_terms(chosen: np.ndarray) -> np.ndarray:
    """The keys and those of the identity terms, ascending."""
    return np.unique(np.concatenate([chosen, np.array([key(t) for group in IDENTITY_TERMS for t in group], np.int64)]))


def counterfactuals(rows: list[tuple], at: dict[int, int]):
    """Copies of the texts with a term swapped: the text of each, and its kind of change; of each kind, the columns that change, and by how much.

    at: columns of the keys that count. A copy has the keys that all words but the term give, and those of the term put in.
    """
    keys = {key(t): keys_of({t}) & at.keys() for t in TERMS}
    kinds = [[key(t) for t in group] for group in IDENTITY_TERMS]
    others = {t: [u for u in group if u != t] for group in kinds for t in group}
    text, change, changes = [], [], {}
    for d, (_, has, *rest) in enumerate(rows):
        has = set(np.asarray(has, np.int64).tolist())
        # without a list of them, no other word is taken to give a term's beginnings
        pairs = np.asarray(rest[0]).reshape(-1, 2).tolist() if rest else [(t, k) for t in others.keys() & has for k in keys[t] & has]
        own = {}
        for t, k in pairs:
            own.setdefault(t, set()).add(k)
        for t in sorted(own):
            for u in others[t]:
                text.append(d)
                change.append(changes.setdefault((frozenset(own[t] - keys[u]), frozenset(keys[u] - has)), len(changes)))
    parts = [(c, at[k], by) for (gone, put), c in changes.items() for ks, by in ((gone, -1.0), (put, 1.0)) for k in sorted(ks)]
    of, column, by = (np.array(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    return np.array(text, np.int64), np.array(change, np.int64), of, column, by, len(changes)


def fit_words(rows: list[tuple], chosen: np.ndarray | None = None, l2: float = 0.01, fairness: float = 5.0) -> ToxicityModel:
    """rows: label, which of the keys `chosen` the text has, and its own_keys of them as a flat array, which may lack.

    chosen: ascending, with the identity terms; by default all keys of the rows.
    """
    labels = np.array([r[0] for r in rows] or [0], np.float64)
    doc = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    flat = np.concatenate([np.zeros(0, np.int64), *(np.asarray(r[1], np.int64) for r in rows)])
    chosen = with_terms(flat) if chosen is None else chosen
    column = np.searchsorted(chosen, flat)
    sd, change, of, changed, by, changes = counterfactuals(rows, {int(k): i for i, k in enumerate(chosen)})
    # a pseudo-negative empty text keeps the prior defined
    y = np.append(labels, 0.0) if len(rows) else np.array([0.0])
    rows_n = len(y)

    def loss(x):
        w, b = x[:-1], x[-1]
        z = b + np.bincount(doc, weights=w[column], minlength=rows_n)
        p = sigmoid(z)
        value = np.mean(np.logaddexp(0, z) - y * z) + 0.5 * l2 * (w @ w) / np.sqrt(rows_n)
        r = (p - y) / rows_n
        g = np.append(np.bincount(column, weights=r[doc], minlength=len(w)) + l2 * w / np.sqrt(rows_n), r.sum())
        if len(sd):
            q = sigmoid(z[sd] + np.bincount(of, weights=by * w[changed], minlength=changes)[change])
            d = p[sd] - q
            value += fairness * np.mean(d * d)
            gp, gq = 2 * fairness * d * p[sd] * (1 - p[sd]) / len(sd), -2 * fairness * d * q * (1 - q) / len(sd)
            gz = np.bincount(sd, weights=gp + gq, minlength=rows_n)
            g[:-1] += np.bincount(column, weights=gz[doc], minlength=len(w)) + np.bincount(changed, weights=by * np.bincount(change, weights=gq, minlength=changes)[of], minlength=len(w))
            g[-1] += gz.sum()
        # terms that the sample never shows keep no weight of their own
        return value, g

    x = minimise(loss, np.zeros(len(chosen) + 1))
    return ToxicityModel({int(k): float(v) for k, v in zip(chosen, x[:-1]) if v}, float(x[-1]))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, limit: int = 12_000, words: int = 4000, gain_least: float = 20.0) -> ToxicityModel:
    """Fits on at most `limit` labelled documents outside the held-out fold.

    words: how many words the model may weigh. They are chosen by counts made on the executors, and only their
    presence comes to the driver.
    """
    small_batches(docs.sparkSession)
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample(labels, "toxic", parts, held, limit)), "doc_id").select("text", "label")
    chosen = with_terms(telling(cut(counted(drawn)), words, gain_least))
    rows = keyed(drawn, chosen).collect()  # at most `limit` rows of at most `words` keys and the terms
    return fit_words([(y, np.frombuffer(k, "<i8"), np.frombuffer(o, "<i8")) for y, k, o in sorted((r["label"], bytes(r["keys"]), bytes(r["own"])) for r in rows)], chosen)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """row, the columns of docs as one, and score."""
    small_batches(docs.sparkSession)
    weights, bias = model.weights, model.bias

    def run(batches):
        for batch in batches:
            z = [bias + sum(weights.get(k, 0.0) for k in word_keys(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigmoid(np.array(z, np.float64)))], ["row", "score"])

    rows = docs.select(F.struct("*").alias("row"), docs["text"].alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["row"], StructField("score", DoubleType())]))


def toxicity_digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out (false without an id), score, predicted for each row of docs."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).select("row.doc_id", "score")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs less those that score at least `threshold`, columns as given, whatever their names."""
    return score(docs, fit(docs, labels)).where(F.col("score") < threshold).select("row.*")
