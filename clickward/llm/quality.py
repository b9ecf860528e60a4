"""Quality classifier: Bradley-Terry pairwise ranking of documents.

Labelled documents form preference pairs, one of label 1 over one of label 0.
Each document's merit is linear in features of its text, and the chance that
the first of a pair is preferred is the logistic of the merit difference, so
the weights come from logistic regression without intercept on feature
differences. The cut between good and poor is a quantile of the merits of the
training documents: of all quantiles, the one with the fewest errors among
them, the middle one of equals. The score is the logistic of the merit above the cut.

The fit uses at most `FIT_ROWS` training documents (those with the smallest
hashes) and `PAIRS_EACH` partners each; scoring reads every document whole.

Defined cases: a null, empty or blank text has features of zero and gets a
score like any other; labels other than 0 and 1, null labels and labels
without document are ignored; a document labelled twice with both values is in
no pair; without any pair every score is 0.5; rows without doc_id are scored
and never trained on; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickward.session import materialize

FIT_ROWS = 20_000
PAIRS_EACH = 4
QUANTILES = 1000
FEATURES = (
    "log_words",
    "word_length",
    "upper_letters",
    "digits",
    "exclamations",
    "bars",
    "marks",
    "stops",
    "other_ascii",
    "non_ascii",
    "repeated_neighbours",
    "repeated_words",
    "repeated_pairs",
    "repeated_lines",
    "word_variety",
    "capital_words",
    "marked_words",
    "line_length",
)

_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER.copy()
_LETTER[ord("a") : ord("z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = (_class(b"!"), _class(b"|"), _class(b"#*$%&<>@^~=_\\/{}[]+"), _class(b".,;:?'\"()-"))
_SPACE = _class(b" \t\n\x0b\x0c\r")
_HIGH = np.arange(256) >= 128
_PLAIN = ~(_LETTER | _DIGIT | _SPACE | _HIGH | _CLASSES[0] | _CLASSES[1] | _CLASSES[2] | _CLASSES[3])


def text_features(text: str) -> list[float]:
    """The numbers of FEATURES, from counts of bytes, words and lines."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    bins = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = float(bins.sum() - bins[_SPACE].sum())
    n = len(words)
    kinds = len(set(words))
    beside = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    letters = float(bins[_LETTER].sum())
    return [
        float(np.log1p(n)),
        min(solid / n, 40.0) / 10,
        float(bins[_UPPER].sum()) / max(letters, 1.0),
        float(bins[_DIGIT].sum()) / solid,
        *[float(bins[c].sum()) / solid for c in _CLASSES],
        float(bins[_PLAIN].sum()) / solid,
        float(bins[_HIGH].sum()) / solid,
        beside / n,
        1 - kinds / n,
        1 - pairs / max(n - 1, 1) if n > 1 else 0.0,
        1 - len(set(lines)) / len(lines),
        kinds / n**0.8,
        sum(w[:1].isupper() for w in words) / n,
        sum(w[-1:] in b"#*$%&|!<>" for w in words) / n,
        float(np.log1p(len(raw) / len(lines))) / 10,
    ]


@dataclass(frozen=True)
class Ranking:
    """Merit weights and the merit at which good begins."""

    weights: tuple[float, ...] = (0.0,) * len(FEATURES)
    cut: float = 0.0

    def score(self, text: Column) -> Column:
        """Logistic of the merit above the cut: 0.5 and more is good."""
        weights, cut = np.asarray(self.weights), self.cut

        def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in parts:
                merit = np.asarray([text_features(t) for t in texts], float).reshape(-1, len(FEATURES)) @ weights
                yield pd.Series(1 / (1 + np.exp(-np.clip(merit - cut, -500, 500))))

        return F.pandas_udf(judge, "double")(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, quality, features) of at most `fit_rows` labelled documents that are not held out."""
    agreed = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("other"))
        .where(F.col("quality") == F.col("other"))
    )
    chosen = agreed.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def make(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([text_features(t) for t in texts], dtype=object)

    features = F.pandas_udf(make, "array<double>")("text")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.select("doc_id", "quality", features.alias("features"))


def preference_pairs(rows: DataFrame, each: int = PAIRS_EACH) -> DataFrame:
    """(difference, label): every document of the larger side beside `each` of the other.

    Half of the pairs are turned round, so that both outcomes occur.
    """
    order = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = materialize(rows.withColumn("rank", F.row_number().over(order) - 1).coalesce(8), "training")
    sizes = {r["quality"]: r["count"] for r in ranked.groupBy("quality").count().collect()}
    many = 1 if sizes.get(1, 0) >= sizes.get(0, 0) else 0
    few = max(1, sizes.get(1 - many, 0))
    turns = ranked.where(F.col("quality") == many).select(
        F.col("features").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("turn"), "rank"
    )
    turns = turns.withColumn("slot", (F.col("rank") * each + F.col("turn")) % few)
    others = ranked.where(F.col("quality") == 1 - many).select(F.col("features").alias("b"), F.col("rank").alias("slot"))
    won = (F.col("rank") + F.col("turn")) % 2
    sign = F.when(won == many, 1.0).otherwise(-1.0)
    pairs = turns.join(others, "slot")
    return pairs.select(
        F.zip_with("a", "b", lambda a, b: (a - b) * sign).alias("difference"), won.cast("double").alias("label")
    )


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Ranking:
    rows = materialize(training_rows(docs, labels, fit_rows), "training-features")
    pairs = materialize(preference_pairs(rows).coalesce(6), "preference-pairs")
    if pairs.isEmpty():
        return Ranking()
    model = LogisticRegression(
        featuresCol="vector", labelCol="label", fitIntercept=False, regParam=1e-4, maxIter=60
    ).fit(pairs.select(array_to_vector("difference").alias("vector"), "label"))
    weights = model.coefficients.toArray()
    # Bounded: the training rows, fit_rows at most.
    known = rows.select("features", "quality").toPandas()
    merit, good = np.stack(known["features"].to_list()) @ weights, known["quality"].to_numpy() == 1
    cuts = np.unique(np.quantile(merit, np.linspace(0, 1, QUANTILES + 1)))
    # Errors at each cut: good ones below it and poor ones at or above it.
    lost = np.searchsorted(np.sort(merit[good]), cuts, side="left")
    passed = (~good).sum() - np.searchsorted(np.sort(merit[~good]), cuts, side="left")
    best = np.flatnonzero(lost + passed == (lost + passed).min())
    return Ranking(tuple(float(w) for w in weights), float(cuts[best[len(best) // 2]]))


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of `docs`."""
    ranking = learn(docs, labels, fit_rows)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ranking.score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that score as good."""
    ranking = learn(docs, labels)
    return docs.where(ranking.score(F.col("text")) >= 0.5)
