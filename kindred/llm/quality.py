"""Ordinal cumulative-link regression on graded ratings, over hashed text.

One weight for each hashed feature (the distinct words of a text, the beginnings of its longer words
and a few coarse measures of its shape) that tells the grades apart, and ordered thresholds shared by all grades: P(grade <= g) = sigmoid(threshold_g - score).
The model gives the expected grade and the probability of the tail at or above a grade, by which
documents are selected.

The fit uses at most ``FIT_ROWS`` labelled documents, the first ones by a hash of their ids. How often
their features go with each grade is counted where they lie; only the telling features, at most
``FIT_FEATURES``, go to the driver, where the fit runs. Every document is then scored where it lies,
without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialize, session_of, table, text_or_empty
from kindred.llm.hashing import GOLD, U, groups, mix, word_hashes

#: Hashed features.
SPACE = 1 << 18
#: Labelled documents that the model is fitted on, at most.
FIT_ROWS = 12_000
#: Features that may have a weight, at most: those that tell most.
FIT_FEATURES = 4096
#: Features seen in fewer of these have no weight.
SEEN = 4
#: Bytes of a word's beginning.
BEGINNING = 4
#: Features have a weight if their likelihood ratio against the grades (2 n times the mutual information) is at least
#: LEAST and this share of the fitted documents: thousands of words that say nothing by themselves would outvote the one that does.
LEAST, TELLING = 20.0, 1 / 60
#: Grades: 0 poor, 1 sound but toxic, 2 sound and clean.
GRADES = 3
#: A document is kept if its tail probability of the best grade is at least this.
#: Chosen on held-out toxic and clean documents together (README).
CUT = 0.7
_SYMBOL = np.array([b < 128 and not chr(b).isalnum() and not chr(b).isspace() and chr(b) not in ".,;:'\"()-" for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def _shape(text: str, words: int, distinct: int) -> np.ndarray:
    """Hashes of coarse measures: share of symbols, capitals, digits and distinct words, words and length of lines."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n, lines = max(1, len(data)), text.count("\n") + 1
    measures = [
        int(min(20, 100 * _SYMBOL[data].sum() / n)),
        int(20 * _UPPER[data].sum() / n),
        int(20 * _DIGIT[data].sum() / n),
        int(12 * distinct / max(1, words)) if words >= 30 else 30,
        int(np.log2(words + 1)),
        int(np.log2(words / lines + 1)),
        int(min(20, 40 * text.count("|") / max(1, words))),
    ]
    return np.array([(i + 1) * 1000 + x for i, x in enumerate(measures)], U)


def features(texts: list[str], space: int = SPACE) -> list[np.ndarray]:
    """For each text the ascending distinct ids of its features."""
    out = []
    for i, j in groups(texts):
        hashes, begin = word_hashes(texts[i:j])
        ids = hashes % U(space)
        starts, first = word_hashes(texts[i:j], BEGINNING)
        starts %= U(space)
        for text, a, b, c, d in zip(texts[i:j], begin, begin[1:], first, first[1:]):
            distinct = np.unique(ids[a:b])
            shape = mix(_shape(text, int(b - a), len(distinct)) * GOLD) % U(space)
            out.append(np.unique(np.concatenate([distinct, starts[c:d], shape])).astype(np.int32))
    return out


def telling(found: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which features have a weight: those seen often enough whose presence depends on the grade, and of these the ``FIT_FEATURES`` that tell most.

    ``found`` counts the documents of each grade (a column) that have a feature (a row), ``rows`` the documents of each grade.
    """
    n, seen = rows.sum(), found.sum(axis=1)
    ratio = np.zeros(len(found))
    for g in range(len(rows)):
        for count, total in ((found[:, g], seen), (rows[g] - found[:, g], n - seen)):
            ratio += 2 * count * np.log(np.maximum(count, 1) * n / np.maximum(total * rows[g], 1))
    told = (seen >= SEEN) & (ratio >= max(LEAST, TELLING * n))
    most = np.argsort(-np.where(told, ratio, -1), kind="stable")[:FIT_FEATURES]
    out = np.zeros(len(found), bool)
    out[most] = told[most]
    return out


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, ids: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[x].sum() for x in ids], np.float64)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1 .. grades - 1, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


class Likelihood:
    """The penalised mean log likelihood, negated, of grades given feature entries (``row``, ``col``).

    Its parameters are the weights, the first threshold, and the logarithms of the steps to the
    others, so that thresholds stay in order.
    """

    def __init__(self, row: np.ndarray, col: np.ndarray, grades: np.ndarray, n_weights: int, n_grades: int, shrink: float) -> None:
        self.row, self.col, self.grades, self.m, self.k = row, col, grades, n_weights, n_grades - 1
        self.n, self.shrink = len(grades), shrink / np.sqrt(len(grades))

    def thresholds(self, x: np.ndarray) -> np.ndarray:
        return x[self.m] + np.concatenate([[0], np.cumsum(np.exp(x[self.m + 1 :]))])

    def _ends(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(grade <= own), P(grade < own) and their difference."""
        cut, g = np.concatenate([[-np.inf], self.thresholds(x), [np.inf]]), self.grades
        score = np.bincount(self.row, x[: self.m][self.col], minlength=self.n)
        high = np.where(g == self.k, 1.0, sigmoid(np.where(g == self.k, 0, cut[g + 1]) - score))
        low = np.where(g == 0, 0.0, sigmoid(np.where(g == 0, 0, cut[g]) - score))
        return high, low, np.maximum(high - low, 1e-9)

    def value(self, x: np.ndarray) -> float:
        return float(-np.log(self._ends(x)[2]).mean() + self.shrink / 2 * (x[: self.m] ** 2).sum())

    def gradient(self, x: np.ndarray) -> np.ndarray:
        high, low, p = self._ends(x)
        g, k, n, w = self.grades, self.k, self.n, x[: self.m]
        by_cut = np.bincount(g + 1, -high * (1 - high) / p, minlength=k + 2)[1 : k + 1] + np.bincount(g, low * (1 - low) / p, minlength=k + 2)[1 : k + 1]
        above = np.cumsum(by_cut[::-1])[::-1]  # a threshold moves with the first one and every step before it
        by_weight = np.bincount(self.col, (1 - high - low)[self.row], minlength=self.m) / n + self.shrink * w
        return np.concatenate([by_weight, above[:1] / n, above[1:] * np.exp(x[self.m + 1 :]) / n])


def fit(ids: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, space: int = SPACE, rounds: int = 1000, rate: float = 0.1, shrink: float = 0.0002) -> Model:
    """Penalised maximum likelihood by Adam. Without rows, every text is sure of the best grade."""
    if not len(ids):
        return Model(np.zeros(space), np.full(n_grades - 1, -1e9))
    flat = np.concatenate(ids)
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    found = np.stack([np.bincount(flat[grades[row] == g], minlength=space) for g in range(n_grades)], axis=1)
    counts = np.bincount(grades, minlength=n_grades)
    common = telling(found, counts)
    used = np.flatnonzero(common)
    place = np.full(space, -1)
    place[used] = np.arange(len(used))
    loss = Likelihood(row[common[flat]], place[flat[common[flat]]], grades, len(used), n_grades, shrink)
    share = np.clip(np.cumsum(counts)[:-1] / len(ids), 1e-3, 1 - 1e-3)
    cut = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    x = np.concatenate([np.zeros(len(used)), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, rounds + 1):
        gradient = loss.gradient(x)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(space)
    weights[used] = x[: len(used)]
    return Model(weights, loss.thresholds(x))


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade: 0 if the quality is 0, else 1 if toxic, else 2. Of repeated labels the worst counts; rows with a null are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").dropna()
    return known.groupBy("doc_id").agg(F.min(F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).otherwise(2)).alias("grade"))


def drawn(grades: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, the first ones by a hash of the id: the same in every run. Twice as many are sorted, at most about."""
    step = max(1, grades.count() // (2 * most))
    some = grades.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    return some.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, grades: DataFrame, most: int = FIT_ROWS, n_grades: int = GRADES, space: int = SPACE) -> Model:
    """A model of (doc_id, grade) rows, on at most ``most`` of them. Of documents that share an id one counts, by its features."""
    chosen = materialize(drawn(grades, most), "quality-draw")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([x.tolist() for x in features(batch.column(2).to_pylist(), space)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "grade", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "text").mapInArrow(read, "doc_id long, grade int, ids array<int>")
    rows = materialize(rows.groupBy("doc_id", "grade").agg(F.min("ids").alias("ids")), "quality-features")
    counts = np.zeros(n_grades, np.int64)
    for r in rows.groupBy("grade").count().collect():
        counts[r.grade] = r["count"]
    each = rows.select("grade", F.explode("ids").alias("id")).groupBy("id").agg(*[F.count_if(F.col("grade") == g).alias(f"g{g}") for g in range(n_grades)])
    seen = each.where(" + ".join(f"g{g}" for g in range(n_grades)) + f" >= {SEEN}").toPandas().sort_values("id")  # at most `space` rows
    used = seen["id"].to_numpy()[telling(seen.drop(columns="id").to_numpy(np.int64), counts)]
    told = F.array_sort(F.array_intersect("ids", F.lit(used.tolist()).cast("array<int>")))  # at most `most` rows of at most FIT_FEATURES numbers
    held = sorted((r.doc_id, r.grade, r.ids) for r in rows.select("doc_id", "grade", told.alias("ids")).collect())
    return fit([np.array(x, np.int32) for _, _, x in held], np.array([g for _, g, _ in held], np.int64), n_grades, space)


def rater(docs: DataFrame, model: Model, at: int):
    """What gives each batch's tails, from its column ``at``, on the executors."""
    shared = session_of(docs).sparkContext.broadcast((model.weights, model.thresholds))  # its size is fixed by the feature space

    def tails(batch: pa.RecordBatch) -> np.ndarray:
        own = Model(*shared.value)
        return own.tails(own.score(features([x or "" for x in batch.column(at).to_pylist()], len(own.weights))))

    return tails


def rated(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with expected_grade and tail (the probability of the best grade).

    A null text counts as empty. Null ids and repeated rows are rated by their own texts; texts of
    any length are read whole. No rows give no rows. The other columns need names of their own.
    """
    names, tails = docs.columns, rater(docs, model, docs.columns.index(text_col))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = tails(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.sum(axis=1)), pa.array(found[:, -1])], names=[*names, "expected_grade", "tail"])

    schema = docs.select("*", F.lit(0.0).alias("expected_grade"), F.lit(0.0).alias("tail")).schema
    return docs.mapInArrow(rate, schema)


def selected(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The documents whose tail probability is at least ``cut``, with their columns as they are.

    A null text counts as empty. Ids may be null or repeat: each row is rated by its own text.
    Columns may have any names: they are numbered meanwhile. Without labels every row is kept.
    """
    names = docs.columns
    model = train(docs.select("doc_id", "text"), graded(labels))
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])
    tails = rater(docs, model, names.index("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(tails(batch)[:, -1] >= cut))

    kept = numbered.mapInArrow(keep, numbered.schema)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def op10_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    """Each document's expected grade (0 to 2), its tail probability, and whether it is kept; nulls and repeats as in ``rated``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    return rated(docs, model).select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail", 6).alias("tail"), (F.col("tail") >= CUT).alias("kept"))
