"""Scorers and metrics: counts of prediction by partial matching (scored in `ppm`), embedding distances,
nearest neighbours, and the usual figures for attribution and verification (more in `evaluation`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.operators.windows import context_counts


# -- prediction by partial matching ------------------------------------------------------------
def ppm_counts(df: DataFrame, author: str, text: str, order: int = 5) -> DataFrame:
    """(author, k, ctx, ch, n): the model of each author as a flat table of counts."""
    return context_counts(df, author, text, order)


def merge_models(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.unionByName(b).groupBy(*keys).agg(F.sum("n").alias("n"))


def subtract_model(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a less those of b; a negative result fails, zeros go."""
    d = a.withColumnRenamed("n", "na").join(b.withColumnRenamed("n", "nb"), keys, "full")
    n = F.coalesce("na", F.lit(0)) - F.coalesce("nb", F.lit(0))
    return d.select(*keys, F.when(n < 0, F.raise_error(F.lit("a model can't be taken from a smaller one"))).otherwise(n).cast("long").alias("n")).where("n > 0")


def normalise_scores(scores: DataFrame, key: str, author: str, score: str, corpus: DataFrame | None = None, plain: bool = False) -> DataFrame:
    """(key, author, err, rank): the score less the author's mean over a corpus, ranked per document, ties
    to the smaller author. corpus: scores of a set of known documents; none stands for the scored
    documents themselves; `plain` leaves the scores as they are."""
    if plain:
        err = scores.select(key, author, F.round(score, 9).alias("err"))
    else:
        mean = (scores if corpus is None else corpus).groupBy(author).agg(F.avg(score).alias("m"))
        err = scores.join(mean, author).select(key, author, F.round(F.col(score) - F.col("m"), 9).alias("err"))
    return err.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("err", author)))


# -- distances ---------------------------------------------------------------------------------
def _pairs(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)))


def manhattan(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def cosine(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y) / (F.sqrt(_pairs(a, a, lambda x, y: x * y)) * F.sqrt(_pairs(b, b, lambda x, y: x * y)))


def kernel(d: Column) -> Column:
    return F.exp(-0.09 * d * d * d) + 1e-10


def shifted_euclidean(a: Column, b: Column) -> Column:
    """Euclid's distance with 1e-10 under the root, so that it has a slope at 0."""
    return F.sqrt(_pairs(a, b, lambda x, y: (x - y) * (x - y)) + 1e-10)


def cosine_share(a: Column, b: Column) -> Column:
    """The cosine moved to 0..1."""
    return (cosine(a, b) + 1) / 2


def negated(d: Column) -> Column:
    """The kernel -d."""
    return F.negate(d)


def two_margin_loss(similarity: Column, same: Column, same_margin: float = 0.5, different_margin: float = 1.5) -> Column:
    """Squared shortfall of a same-author similarity below one margin, squared excess of another one
    above the other margin."""
    return F.when(same == 1, F.pow(F.greatest(F.lit(same_margin) - similarity, F.lit(0.0)), 2.0)).otherwise(F.pow(F.greatest(similarity - different_margin, F.lit(0.0)), 2.0))


def contrastive_loss(distance: Column, similarity: Column, same: Column, margin: float = 0.5) -> Column:
    """Half the squared distance of a same-author pair, half the squared shortfall of another pair's
    similarity below the margin."""
    return 0.5 * F.when(same == 1, F.pow(distance, 2.0)).otherwise(F.pow(F.greatest(F.lit(margin) - similarity, F.lit(0.0)), 2.0))


#: Distances and kernels by name; both may be extended by further column functions.
DISTANCES = {"euclidean": euclidean, "manhattan": manhattan, "shifted": shifted_euclidean, "cosine": lambda a, b: 1 - cosine(a, b)}
KERNELS = {"exponential": kernel, "negated": negated}


def similarity(a: Column, b: Column, distance: str = "euclidean", kernel_name: str = "exponential") -> Column:
    """The similarity of two vectors by a distance and a kernel given by name."""
    if distance not in DISTANCES or kernel_name not in KERNELS:
        raise ValueError(f"known distances: {sorted(DISTANCES)}, kernels: {sorted(KERNELS)}")
    return KERNELS[kernel_name](DISTANCES[distance](a, b))


#: Bytes of one side that may be sent to every task; beyond it both sides are cut into blocks.
SENT_BYTES = 64 << 20


def against_blocks(small: DataFrame, rows: DataFrame, blocks: int = 16, row_bytes: int = 1024) -> DataFrame:
    """Every row of `small`, a set stated by the caller, beside every row of `rows`.

    While `small` is known to be under SENT_BYTES it is sent to every task; beyond it both sides are
    dealt into blocks and each two blocks meet in one task."""
    n = small.count()
    if n * row_bytes <= SENT_BYTES:
        return rows.crossJoin(F.broadcast(small))
    parts = max(1, -(-n * row_bytes // SENT_BYTES))
    deal = lambda df, name, k: df.withColumn(name, F.pmod(F.xxhash64(*df.columns), F.lit(k)).cast("int"))
    spread = lambda df, name, k: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    left, right = spread(deal(small, "__s", parts), "__r", blocks), spread(deal(rows, "__r", blocks), "__s", parts)
    return right.join(left, ["__s", "__r"]).drop("__s", "__r")


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query, key, distance, rank): the k nearest other rows of each query, ties by id.

    The query set is stated by the caller and meets the rows in blocks; each task keeps only its k best
    per query before the shuffle."""
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("__q"))
    d = against_blocks(q, rows).where(F.col("query") != F.col(key)).select("query", key, F.round(euclidean(F.col("__q"), F.col(vector)), 9).alias("distance"))
    return d.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", key))).where(F.col("rank") <= k)


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, profile): the mean vector of each key."""
    at = df.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return at.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: F.round(s["x"], 6)).alias("profile"))  # one entry per dimension


# -- metrics: columns truth (0/1) and score, 0.5 is no decision ----------------------------------
def verification_metrics(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: n, c_at_1, f1, f05u, brier."""
    t, s = F.col(truth), F.col(score).cast("double")
    none, yes = s == 0.5, s > 0.5
    count = lambda c, name: F.count_if(c).cast("double").alias(name)
    a = df.where(t.isNotNull() & s.isNotNull()).agg(
        F.count(F.lit(1)).cast("double").alias("n"), count(none, "u"), count(~none & (yes == (t == 1)), "right"), count(yes & (t == 1), "tp"), count(yes & (t == 0), "fp"), count(~yes & ~none & (t == 1), "fn"), F.avg((s - t) * (s - t)).alias("b")
    )
    n, u, right, tp, fp, fn = (F.col(c) for c in ("n", "u", "right", "tp", "fp", "fn"))
    r = lambda c, name: F.round(c, 9).alias(name)
    return a.select(n.cast("long").alias("n"), r(F.try_divide(right + u * right / n, n), "c_at_1"), r(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), "f1"), r(F.coalesce(F.try_divide(1.25 * tp, 1.25 * tp + 0.25 * (fn + u) + fp), F.lit(0.0)), "f05u"), r(1 - F.col("b"), "brier"))


def class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: accuracy, macro_accuracy, macro_precision, macro_recall, macro_f1 over the classes of
    truths and predictions (macro_accuracy: of truths)."""
    ok = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull())
    by = ok.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = by.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("nt"), F.lit(0).cast("long").alias("np")), F.struct(F.col("p").alias("c"), F.lit(0).cast("long").alias("nt"), F.col("n").alias("np")))).alias("s"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    per = per.groupBy("s.c").agg(F.sum("s.nt").alias("nt"), F.sum("s.np").alias("np"), (F.sum("hit") / 2).alias("hit"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    rec, pre = z(F.try_divide(F.col("hit"), F.col("nt"))), z(F.try_divide(F.col("hit"), F.col("np")))
    f1 = z(F.try_divide(2 * F.col("hit"), F.col("nt") + F.col("np")))
    return per.agg(*[F.round(c, 9).alias(n) for c, n in ((F.sum("hit") / F.sum("nt"), "accuracy"), (F.avg(F.when(F.col("nt") > 0, rec)), "macro_accuracy"), (F.avg(pre), "macro_precision"), (F.avg(rec), "macro_recall"), (F.avg(f1), "macro_f1"))])


def threshold_search(df: DataFrame, truth: str, score: str, steps: int = 100) -> DataFrame:
    """(threshold, accuracy) at evenly spaced thresholds from the least to the largest score.

    Scores are counted into the steps they pass, so the rows aren't multiplied by the thresholds."""
    ok = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(F.col(truth).alias("t"), F.col(score).cast("double").alias("s"))
    lo, hi, n, neg = ok.agg(F.min("s"), F.max("s"), F.count(F.lit(1)), F.sum(1 - F.col("t"))).first()
    grid = ok.sparkSession.createDataFrame([(i, lo + (hi - lo) * i / (steps - 1)) for i in range(steps)] if n else [], "i int, threshold double")
    width = (hi - lo) / (steps - 1) if n and hi > lo else 1.0
    last = F.least(F.floor((F.col("s") - F.lit(lo)) / F.lit(width) + 1e-9), F.lit(steps - 1)).cast("int")
    gain = ok.groupBy(last.alias("i")).agg(F.sum(2 * F.col("t") - 1).alias("g"))
    w = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)  # one row per step
    return grid.join(gain, "i", "left").withColumn("g", F.sum(F.coalesce("g", F.lit(0))).over(w)).select(F.round("threshold", 9).alias("threshold"), F.round((F.lit(neg) + F.col("g")) / F.lit(n), 9).alias("accuracy"))
