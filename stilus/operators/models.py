"""Classifiers on text features: attribution by n-grams, verification by feature differences and by the
distances of compression models. The features are tables of this library, the models Spark ML's."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stilus.functions import features as f
from stilus.functions import grams as g
from stilus.functions import text as t
from stilus.session import materialize, spread


def ngram_features(docs: DataFrame, train: DataFrame, key: str, text: str, grams, most: int, min_share: float) -> DataFrame:
    """(key, features): TF-IDF vectors of length 1 over the grams found in at least min_share of the
    training texts, at most `most` of them; a text without any has a vector of zeros. Both sets' weights
    take their document frequencies from the training set."""
    n = train.count()
    ids = materialize(t.frequent(t.ngram_counts(spread(train), grams, key), n, min_share, most), "ids")
    width = ids.count()
    tf = t.array_counts(spread(docs), [key], grams).withColumnRenamed("term", "gram").join(F.broadcast(ids.select("gram", F.col("n_docs").alias("__docs"))), "gram")  # at most `most`
    w = tf.select(key, "gram", ((1 + F.log(F.col("n").cast("double"))) * (F.log(F.lit(1.0 + n) / (1 + F.col("__docs"))) + 1)).alias("weight"))
    unit = f.dense_vectors(w, key, F.broadcast(ids), width, unit=True)
    zero = F.array_repeat(F.lit(0.0), width)
    return docs.select(key).join(unit, key, "left").select(key, F.coalesce("features", zero).alias("features"))


#: Rows laid out as doubles at once.
_ROWS = 1024


@dataclass
class NgramModel:
    """A fitted n-gram classifier: what it reads, its grams with the training texts that hold them, the
    largest training value of each, the candidates and their coefficients."""

    kind: str
    vocabulary: g.Vocabulary
    docs: np.ndarray
    total: int
    names: list
    top: np.ndarray | None = None
    coefficients: np.ndarray | None = None
    intercepts: np.ndarray | None = None

    def features(self, counts: np.ndarray) -> np.ndarray:
        """TF-IDF vectors of length 1, each place over its largest training value once that is known."""
        x = g.weights(counts, self.docs, self.total)
        return x if self.top is None else x / np.where(self.top > 0, self.top, 1.0)

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each candidate."""
        parts = [self.features(counts[i : i + _ROWS]) @ self.coefficients.T + self.intercepts for i in range(0, len(counts), _ROWS)]
        z = np.concatenate([np.zeros((0, len(self.names))), *parts])
        highest = z.max(axis=1, keepdims=True)
        e = np.exp(z - np.where(np.isinf(highest), 0.0, highest))
        out = np.where(np.isinf(highest), np.arange(len(self.names)) == z.argmax(axis=1)[:, None], e)  # a lone candidate's intercept has no bound
        return out / out.sum(axis=1, keepdims=True)


def _classes(df: DataFrame, kinds: list[str]) -> np.ndarray | None:
    return g.word_classes(df.sparkSession) if "word" in kinds else None


def ngram_models(train: DataFrame, label: str, text: str, kinds: list[str], low: int = 1, high: int = 3, most: int = 1000, min_share: float = 0.1, iterations: int = 50, regularise: float = 0.001) -> list[NgramModel]:
    """For each of the kinds a multinomial logistic regression over TF-IDF n-grams scaled by their largest
    training value: the grams found in at least min_share of the training texts, at most `most` of them.

    Texts without a label train nothing; null texts count as empty. Labels are whole numbers. The texts
    are read twice for all kinds; what is written is each text's counts of the grams."""
    known, classes = spread(train.where(F.col(label).isNotNull()).select(label, text)), _classes(train, kinds)
    total, seen, models = known.count(), materialize(g.gram_counts(known, text, kinds, low, high, classes), "grams"), []
    for k in kinds:
        rows = t.frequent(seen.where(F.col("kind") == k), total, min_share, most).orderBy("id").collect()  # at most `most`
        vocabulary = g.Vocabulary([r["gram"].split(g.KINDS[k]) if g.KINDS[k] else list(r["gram"]) for r in rows])
        models.append(NgramModel(k, vocabulary, np.array([r["n_docs"] for r in rows], np.int64), total, []))
    vocabularies = [m.vocabulary for m in models]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *map(g.packed, g.counts(b.column(1), kinds, vocabularies, classes))], ["label", *kinds])

    x = spread(materialize(known.mapInArrow(counted, ", ".join([f"label {dict(train.dtypes)[label]}", *(f"{k} binary" for k in kinds)])), "train_grams"))
    names = [r[0] for r in x.select("label").distinct().orderBy("label").collect()]  # one row per candidate
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("label")) - 1
    for m in models:
        m.names = names
        _fit(m, x.select(place.cast("double").alias("label"), F.col(m.kind).alias("counts")), iterations, regularise)
    return models


def _fit(model: NgramModel, counts: DataFrame, iterations: int, regularise: float) -> None:
    width = model.vocabulary.width

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for b in batches:
            for part in (b.slice(i, _ROWS) for i in range(0, b.num_rows, _ROWS)):
                yield part, model.features(g.unpacked(part.column(1), width))

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = np.zeros(width)
        for _, v in vectors(batches):
            top = np.maximum(top, v.max(axis=0))
        yield pa.RecordBatch.from_arrays([g.lists(top[None, :])], ["top"])

    def laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in vectors(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), g.lists(v)], ["label", "features"])

    tops = counts.mapInArrow(largest, "top array<double>").collect()  # a row per task
    model.top = np.array([r["top"] for r in tops]).reshape(-1, width).max(axis=0, initial=0.0)
    fitted = counts.mapInArrow(laid_out, "label double, features array<double>").select("label", array_to_vector("features").alias("features"))
    found = LogisticRegression(maxIter=iterations, regParam=regularise, family="multinomial").fit(fitted)
    model.coefficients, model.intercepts = found.coefficientMatrix.toArray(), found.interceptVector.toArray()


def ngram_attribution(train: DataFrame, test: DataFrame, key: str, label: str, text: str, kind: str = "char", low: int = 1, high: int = 3, most: int = 1000, min_share: float = 0.1, iterations: int = 50, regularise: float = 0.001) -> DataFrame:
    """(key, candidate, probability): for each test text the probability of each training label, by
    `ngram_models`."""
    (model,), classes = ngram_models(train, label, text, [kind], low, high, most, min_share, iterations, regularise), _classes(train, [kind])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (counts,) = g.counts(b.column(1), [kind], [model.vocabulary], classes)
            yield pa.RecordBatch.from_arrays([b.column(0), g.lists(model.probabilities(counts))], [key, "p"])

    rows = spread(test).select(key, text).mapInArrow(scored, f"`{key}` {dict(test.dtypes)[key]}, p array<double>")
    return rows.select(key, F.posexplode("p").alias("i", "probability")).select(key, F.get(F.array(*[F.lit(n) for n in model.names]), F.col("i")).alias("candidate"), "probability")


def ngram_vote(models: list[NgramModel], docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, candidate, score): `soft_vote` on the probabilities of models of the same candidates, taken
    within the row: the highest mean, ties to the smaller candidate."""
    names, kinds, classes = models[0].names, [m.kind for m in models], _classes(docs, [m.kind for m in models])
    if any(m.names != names for m in models):
        raise ValueError("models of different candidates")

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = g.counts(b.column(1), kinds, [m.vocabulary for m in models], classes)
            mean = sum(m.probabilities(c) for m, c in zip(models, counts)) / len(models)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(mean.argmax(axis=1).astype(np.int32)), pa.array(mean.max(axis=1))], [key, "i", "m"])

    rows = spread(docs).select(key, text).mapInArrow(voted, f"`{key}` {dict(docs.dtypes)[key]}, i int, m double")
    return rows.select(key, F.get(F.array(*[F.lit(n) for n in names]), F.col("i")).alias("candidate"), F.round("m", 9).alias("score"))


def best_candidate(probabilities: DataFrame, key: str) -> DataFrame:
    """(key, candidate): the most probable, ties to the smaller."""
    best = probabilities.groupBy(key).agg(F.min(F.struct(F.negate("probability").alias("p"), F.col("candidate").alias("c"))).alias("b"))
    return best.select(key, F.col("b.c").alias("candidate"))


def difference_features(pairs: DataFrame, vectors: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """`pairs` with features: the absolute differences of the standardised vectors of both members,
    standardised again over the pairs. vectors: (key, features)."""
    scaled = f.standard_scaled(vectors, "features", vectors)
    first, second = (scaled.select(F.col(key).alias(x), F.col("features").alias(f"__{x}")) for x in (a, b))
    both = pairs.join(first, a).join(second, b)
    gap = materialize(both.select(*pairs.columns, f.abs_difference(F.col(f"__{a}"), F.col(f"__{b}")).alias("features")), "gaps")  # read for its scales and again
    return f.standard_scaled(gap, "features", gap)


def verification_model(train: DataFrame, label: str = "same", features: str | Column = "features", iterations: int = 50, regularise: float = 0.001):
    """A logistic regression of the label on an array of features."""
    data = train.select(array_to_vector(F.col(features) if isinstance(features, str) else features).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(maxIter=iterations, regParam=regularise).fit(data)


def verification_scores(model, pairs: DataFrame, keys: list[str], features: str | Column = "features") -> DataFrame:
    """(keys, score): the probability that a pair is of one author."""
    rows = pairs.select(*keys, array_to_vector(F.col(features) if isinstance(features, str) else features).alias("features"))
    return model.transform(rows).select(*keys, vector_to_array("probability")[1].alias("score"))


def save_model(model, path: str) -> None:
    """A fitted model in Spark ML's own format; an existing target is an error."""
    model.write().save(path)


def load_model(path: str) -> LogisticRegressionModel:
    return LogisticRegressionModel.load(path)


def sweep(grid: dict[str, list], run, best: str = "accuracy") -> list[dict]:
    """Every combination of a grid's values with the figures that run(**values) gives, the best first.
    A loop over settings on the driver; each run is distributed."""
    names = sorted(grid)
    rows = [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]
    return sorted((r | run(**r) for r in rows), key=lambda r: -r[best])
