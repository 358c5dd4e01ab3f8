"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import keyed, materialize, scratch, table

#: Labelled rows that a model is fitted on, at most, for each grade; features that it has at most.
SAMPLE, FEATURES = 6_000, 4_096
#: A feature is taken from this standard score on, and from so many rows of the sample.
SCORE, ROWS = 4.0, 4
#: Words whose features a task remembers.
REMEMBER = 150_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of a word: itself and its first 3, 4, 5 and 6 characters, so that unseen forms of a stem are known."""
    text = word.decode(errors="ignore")
    parts = {f"={text}", *(f"^{text[:k]}" for k in (3, 4, 5, 6) if len(text) >= k)}
    return tuple(xxhash.xxh3_64_intdigest(p) - 2**63 for p in parts)


def words_of(text: str | None) -> list[bytes]:
    """Small-letter words: runs of letters and of all beyond ASCII."""
    return text.encode().translate(_LETTERS).split() if text else []


@dataclass
class OrdinalModel:
    """P(grade >= k) = 1 / (1 + exp(threshold_k - weights * x)); one weight a feature for all thresholds, which ascend."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """(rows, grades - 1) of P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_features: int, grades: int, l2: float = 1e-6, steps: int = 500, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by gradient descent (Adam) on the likelihood of the grades; rows weigh `weight`.

    Entries are (row, feature, value). The first threshold is free, each further one adds a softplus, so they keep their order.
    """
    k = grades - 1
    free = np.zeros(n_features + k)
    free[n_features:] = 1.0
    m, v = np.zeros_like(free), np.zeros_like(free)
    weight = weight / weight.sum()
    rows = np.arange(len(grade))
    for t in range(1, steps + 1):
        w, raw = free[:n_features], free[n_features:]
        cut = np.concatenate(([raw[0]], raw[0] + np.cumsum(np.log1p(np.exp(raw[1:])))))
        x = np.bincount(row, weights=value * w[feature], minlength=len(grade))
        below = np.concatenate((np.zeros((len(grade), 1)), 1 / (1 + np.exp(np.clip(x[:, None] - cut[None, :], -40, 40))), np.ones((len(grade), 1))), axis=1)
        slope = below * (1 - below)
        p = np.maximum(below[rows, grade + 1] - below[rows, grade], 1e-12)
        up, low = slope[rows, grade + 1] / p, slope[rows, grade] / p
        d_x = weight * (up - low)  # of the negative log-likelihood
        d_cut = np.zeros((len(grade), k + 2))
        d_cut[rows, grade + 1] -= weight * up
        d_cut[rows, grade] += weight * low
        g_cut = d_cut[:, 1 : k + 1].sum(axis=0)
        g = np.concatenate((np.bincount(feature, weights=value * d_x[row], minlength=n_features) + l2 * w, [g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] / (1 + np.exp(-raw[1:]))))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = free[n_features:]
    return free[:n_features], np.concatenate(([raw[0]], raw[0] + np.cumsum(np.log1p(np.exp(raw[1:])))))


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows, which bounds what a task holds as Python objects."""
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _counts(only: np.ndarray | None):
    """(grade, text) to rows (grade, features, counts) of each text: hashes of all its features, or places of the given ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = None if only is None else {f: i for i, f in enumerate(only.tolist())}
        for batch in _slices(batches, 128):
            feats, counts = [], []
            for text in batch.column("text").to_pylist():
                own: dict[int, int] = {}
                for w in words_of(text):
                    for f in word_features(w):
                        if place is None or (f := place.get(f)) is not None:
                            own[f] = own.get(f, 0) + 1
                feats.append(list(own))
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column("grade"), pa.array(feats, pa.list_(pa.int64() if only is None else pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["grade", "features", "counts"])

    return run


def _fit(docs: DataFrame, grades: DataFrame, key: str, text: str, sample: int) -> OrdinalModel | None:
    known = grades.where("grade is not null").groupBy(key).agg(F.max("grade").cast("int").alias("grade"))
    sizes = {r["grade"]: r["n"] for r in known.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None
    picked = None
    for g in sizes:
        part = known.where(F.col("grade") == g).orderBy(F.xxhash64(key), key).limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    rows = materialize(docs.select(key, F.col(text).alias("text")).join(F.broadcast(materialize(picked, "picked")), key).select("grade", "text"), "sample")
    every = rows.mapInArrow(_counts(None), "grade int, features array<long>, counts array<int>")
    seen = every.select((F.col("grade") > 0).cast("long").alias("bad"), F.explode("features").alias("f")).groupBy("f").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= ROWS)
    total = rows.agg(F.sum((F.col("grade") > 0).cast("long")).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    n_bad, n_good = total["bad"] or 0, (total["n"] or 0) - (total["bad"] or 0)
    if not n_bad or not n_good:
        return None
    rate = F.col("n") / F.lit(total["n"])
    z = (F.col("bad") / F.lit(n_bad) - (F.col("n") - F.col("bad")) / F.lit(n_good)) / F.sqrt(rate * (1 - rate) * (1 / n_bad + 1 / n_good) + 1e-12)
    chosen = seen.withColumn("z", z).where(F.col("z") >= SCORE).orderBy(F.desc("z"), "f").limit(FEATURES).select("f")
    features = np.sort(chosen.toArrow()["f"].to_numpy())
    got = rows.mapInArrow(_counts(features), "grade int, features array<int>, counts array<int>").toArrow()
    per = np.array(pc.list_value_length(got["features"].combine_chunks()))
    feature = pc.list_flatten(got["features"]).to_numpy()
    value = np.log1p(pc.list_flatten(got["counts"]).to_numpy().astype(float))
    grade = np.searchsorted(sorted(sizes), got["grade"].to_numpy())
    share = np.bincount(grade, minlength=len(sizes))
    weight = np.array([sizes[g] for g in sorted(sizes)])[grade] / share[grade]
    weights, thresholds = fit_ordinal(np.repeat(np.arange(len(grade)), per), feature, value, grade, weight, len(features), len(sizes))
    return OrdinalModel(features, weights, thresholds)


def fit_toxicity(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> OrdinalModel | None:
    """A model of `grades` (key, grade from 0), or None without two different grades.

    It is fitted on the `sample` rows of each grade with the least key hash, weighted back to the grades' shares; that bound is
    the only one. Features that come with grades above 0 far more often than chance are counted in Spark, and the few that
    are kept go to the driver with the sample's counts of them.
    """
    with scratch():
        return _fit(docs, grades, key, text, sample)


def score_toxicity(docs: DataFrame, model: OrdinalModel | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, severity (the expected grade), p_toxic (of a grade above the lowest), toxic (p_toxic >= 0.5).

    Null and empty texts, and all texts without a model, have no feature: they get the severity of such texts, or 0. Rows are
    independent: no shuffle; repeated rows each get their score; an empty input gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        place = {int(f): i for i, f in enumerate(model.features)} if model else {}
        seen: dict[bytes, tuple[int, ...]] = {}
        for batch in _slices(batches, 512):
            scores = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column(1).to_pylist()):
                own: dict[int, int] = {}
                for w in words_of(t):
                    fs = seen.get(w)
                    if fs is None:
                        if len(seen) >= REMEMBER:
                            seen.clear()
                        seen[w] = fs = tuple(place[f] for f in word_features(w) if f in place)
                    for f in fs:
                        own[f] = own.get(f, 0) + 1
                if own:
                    scores[i] = float(model.weights[list(own)] @ np.log1p(np.array(list(own.values()), dtype=float)))
            above = model.at_least(scores) if model else np.zeros((batch.num_rows, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)], names=[key, "severity", "p_toxic", "toxic"])

    return docs.select(key, text).mapInArrow(run, keyed(docs, key, "severity double, p_toxic double, toxic boolean"))


def label_grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 not toxic, 1 toxic in a text of quality, 2 toxic in one without. Rows without a toxic label have none."""
    return labels.select("doc_id", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") == 1, F.when(F.col("quality") == 0, 2).otherwise(1)).alias("grade"))


def keep_clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs whose text the model does not call toxic, with all their columns."""
    model = fit_toxicity(docs, label_grades(labels), key, text)
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    return score_toxicity(held, model, "_row", "_text").where("not toxic").select("_row.*")


def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, label_grades(table(spark, sf_dir, "labels"))))
