"""Toxicity scores by a linear classifier over character n-grams (operator 8).

A feature is the presence of a character n-gram of a word (with its borders,
short n-grams and the whole) anywhere in the text. Each feature is scaled by its naive Bayes log-count
ratio between the two classes, and a logistic regression is fitted over the
scaled features. Features whose ratio is not significant are left out, which
keeps the model small and a very long text from gathering noise.

The model is fitted on the driver from a bounded sample of labelled rows:
``per_class`` labelled documents of each class that have a text, chosen by the
hash of their doc_id, and of a longer text a passage of ``longest`` characters
at a place chosen by the same. Class sizes are counted over all labels. Scoring
reads every whole text and needs no shuffle.

Defined results: a null text counts as empty; an empty text has the score of
the intercept; rows without a label are not learnt from; of several labels of
one document the highest counts. Without a positive or without a negative
label every text has the (bounded) share of positives as its score, and
without any label 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import bound_batches, checkpoint, held_out, passage, read_table, text_or_empty

SIZES = (2, 3, 4, 5, 6)
#: A word with its borders is an n-gram of its own up to this length.
WHOLE = 26
PUNCTUATION = "\"'`.,;:!?()[]{}<>«»“”„‘’…"
THRESHOLD = 0.3
#: Words that a worker remembers, and the longest of them.
MEMO, MEMO_LENGTH = 200_000, 40


def grams(word: str) -> set[str]:
    padded = f" {word.strip(PUNCTUATION)} "
    out = {padded[i:i + n] for n in SIZES for i in range(len(padded) - n + 1)}
    if len(padded) <= WHOLE:
        out.add(padded)
    return out


def features(text: str) -> set[str]:
    out: set[str] = set()
    for word in set(text.lower().split()):
        out |= grams(word)
    return out


@dataclass
class Model:
    """Weights by n-gram, already multiplied by their log-count ratios, and the intercept."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0

    def scorer(self):
        """A function from a text to its score, with a bounded memory of words."""
        names = list(self.weights)
        ids = {g: i for i, g in enumerate(names)}
        value = np.array([self.weights[g] for g in names] or [0.0])
        known: dict[str, tuple[int, ...]] = {}

        def of(word: str) -> tuple[int, ...]:
            found = tuple(ids[g] for g in grams(word) if g in ids)
            if len(word) <= MEMO_LENGTH:
                if len(known) >= MEMO:
                    known.clear()
                known[word] = found
            return found

        def score(text: str) -> float:
            present: set[int] = set()
            for word in set(text.lower().split()):
                found = known.get(word)
                if found is None:
                    found = of(word)
                if found:
                    present.update(found)
            z = self.intercept + float(value[sorted(present)].sum() if present else 0.0)
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def _logistic(rows: list[np.ndarray], scale: np.ndarray, label: np.ndarray, penalty: float, rounds: int):
    """Weights of the scaled features and the intercept, by accelerated gradient steps."""
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if rows else np.empty(0, int)
    x = scale[col]
    # the squared length of a row bounds the curvature
    step = 4 / (max(1.0, np.bincount(doc, x * x, len(rows)).max(initial=0.0)) + 4 * penalty + 1)
    w, b = np.zeros(len(scale)), 0.0
    ahead_w, ahead_b = w, b
    for i in range(rounds):
        z = np.bincount(doc, x * ahead_w[col], len(rows)) + ahead_b
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
        grad = np.bincount(col, x * off[doc], len(scale)) / len(rows) + penalty * ahead_w
        new_w, new_b = ahead_w - step * grad, ahead_b - step * off.mean()
        push = i / (i + 3)
        ahead_w, ahead_b = new_w + push * (new_w - w), new_b + push * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit_texts(texts: list[str], labels: list[int], share: float, significance: float = 4.0, least: int = 4,
              penalty: float = 1e-5, rounds: int = 300) -> Model:
    """Fit on texts with labels 0 and 1; ``share`` is the share of label 1 among all labels."""
    y = np.array(labels, float)
    sides = Counter(labels)
    if not sides[0] or not sides[1]:
        return Model({}, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    numbers: dict[str, int] = {}  # a text is kept as the numbers of its n-grams, 4 bytes each
    rows = [np.array([numbers.setdefault(g, len(numbers)) for g in sorted(features(t))], np.int32) for t in texts]
    p, q = (sum((np.bincount(r, minlength=len(numbers)) for r, label in zip(rows, labels) if label == side),
                np.zeros(len(numbers))) for side in (1, 0))
    ratio = np.log((p + 0.5) / (sides[1] + 1)) - np.log((q + 0.5) / (sides[0] + 1))
    # the two shares of documents must differ by so many standard errors of their common share
    common = (p + q) / len(rows)
    error = np.sqrt(common * (1 - common) * (1 / sides[1] + 1 / sides[0]))
    used = (p + q >= least) & (np.abs(p / sides[1] - q / sides[0]) > significance * error)
    place = np.cumsum(used) - 1
    scale = ratio[used]
    rows = [np.sort(place[r[used[r]]]) for r in rows]
    w, b = _logistic(rows, scale, y, penalty, rounds)
    # the sample holds the classes in another proportion than the table does
    b += np.log(share / (1 - share)) - np.log(sides[1] / sides[0])
    weights = w * scale
    return Model({g: float(weights[place[i]]) for g, i in numbers.items() if used[i]}, float(b))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, longest: int = 10_000) -> Model:
    """Fit on labelled documents that are not held out."""
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        return Model({}, -30.0)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text <> ''")
    there = checkpoint(known.join(whole.select(F.col("doc_id").alias("of_doc")).distinct(),
                                  F.col("doc_id").cast("long") == F.col("of_doc")).select("of_doc", "label"))
    part = passage(F.col("text"), F.col("doc_id"), longest)
    texts, marks = [], []
    for label in (0, 1):
        ids = there.filter(F.col("label") == label).orderBy(F.xxhash64("of_doc"), "of_doc").limit(per_class)
        rows = (whole.join(F.broadcast(ids.select("of_doc")), F.col("doc_id") == F.col("of_doc")).groupBy("doc_id")
                .agg(F.min(F.struct(F.xxhash64("text").alias("h"), part.alias("text"))).alias("t")).collect())
        rows = sorted((r["doc_id"], r["t"]["text"]) for r in rows)
        texts += [text for _, text in rows]
        marks += [label] * len(rows)
    return fit_texts(texts, marks, counts.get(1, 0) / total)


def score_column(model: Model):
    """A Column function: text to score."""
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.scorer()
        for batch in texts:
            yield pa.array([of(t.as_py()) for t in batch], pa.float64())

    return score


def score_documents(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in a new column."""
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, score_column(model)(text_or_empty("text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return score_documents(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
