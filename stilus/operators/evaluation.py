"""Evaluation of attribution and verification answers beyond the single figures in `scoring`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.operators import scoring as m
from stilus.session import materialize


def binarize(score: Column, threshold: float = 0.5, triple: bool = False) -> Column:
    """1 from the threshold on and 0 below; with `triple` a score at the threshold keeps its value."""
    s = score.cast("double")
    return F.when(s > threshold if triple else s >= threshold, 1.0).when(s < threshold, 0.0).otherwise(s)


def _valid(df: DataFrame, truth: str, score: str) -> DataFrame:
    return df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(F.col(truth).cast("int").alias("t"), F.col(score).cast("double").alias("s"))


def running_totals(df: DataFrame, order: str, columns: list[str], descending: bool = False) -> DataFrame:
    """`df` with, for each of `columns`, `below_<name>`: its sum over the rows before a row in the order
    of the distinct values of `order`. A range sort, sums per partition and their offsets: no task sees
    all rows."""
    sign = F.col(order).desc() if descending else F.col(order).asc()
    at = materialize(df.orderBy(sign).withColumn("__p", F.spark_partition_id()), "ordered")
    sums = at.groupBy("__p").agg(*[F.sum(c).alias(c) for c in columns]).orderBy("__p").collect()  # one row per partition
    offsets, total = [], [0.0] * len(columns)
    for r in sums:
        offsets.append((r["__p"], *total))
        total = [t + float(r[c] or 0) for t, c in zip(total, columns)]
    o = df.sparkSession.createDataFrame(offsets or [(0, *total)], "__p int, " + ", ".join(f"__o_{c} double" for c in columns))
    w = Window.partitionBy("__p").orderBy(sign).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(F.broadcast(o), "__p")
    for c in columns:
        out = out.withColumn(f"below_{c}", F.sum(c).over(w) - F.col(c) + F.col(f"__o_{c}"))
    return out.drop("__p", *[f"__o_{c}" for c in columns])


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve, equal scores counting half; 0 where a class is missing."""
    per = _valid(df, truth, score).groupBy("s").agg(F.sum("t").cast("double").alias("p"), F.sum(1 - F.col("t")).cast("double").alias("q"))
    ranked = running_totals(per, "s", ["q"])
    return ranked.agg(F.round(F.coalesce(F.try_divide(F.sum(F.col("p") * (F.col("below_q") + F.col("q") / 2)), F.sum("p") * F.sum("q")), F.lit(0.0)), 9).alias("auc"))


def roc_curve(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(threshold, fpr, tpr): a point per distinct score, counting as positive what reaches it; rates of
    a missing class are null."""
    per = _valid(df, truth, score).groupBy("s").agg(F.sum("t").cast("double").alias("p"), F.sum(1 - F.col("t")).cast("double").alias("q"))
    total = per.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))
    above = running_totals(per, "s", ["p", "q"], descending=True).crossJoin(F.broadcast(total))  # one row
    rate = lambda c: F.round(F.try_divide(F.col(f"below_{c}") + F.col(c), F.col(f"n{c}")), 9)
    return above.select(F.col("s").alias("threshold"), rate("q").alias("fpr"), rate("p").alias("tpr"))


def confusion(df: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy; a score from the threshold on counts as positive."""
    v = _valid(df, truth, score).withColumn("y", binarize(F.col("s"), threshold).cast("int"))
    n = lambda t, y, name: F.count_if((F.col("t") == t) & (F.col("y") == y)).alias(name)
    c = v.agg(n(1, 1, "tp"), n(0, 1, "fp"), n(0, 0, "tn"), n(1, 0, "fn"))
    return c.withColumn("accuracy", F.round(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")), 9))


def evaluate_all(df: DataFrame, truth: str, score: str) -> DataFrame:
    """One row: auc, c_at_1, f05u, f1, brier and their mean `overall`, each rounded to 3 places, the
    mean taken before rounding."""
    one = auc(df, truth, score).crossJoin(m.verification_metrics(df, truth, score))  # one row each
    names = ["auc", "c_at_1", "f05u", "f1", "brier"]
    mean = sum(F.col(c) for c in names) / len(names)
    return one.select(*[F.round(c, 3).alias(c) for c in names], F.round(mean, 3).alias("overall"))


def pan_evaluation(gold: DataFrame, answers: DataFrame, key: str, truth: str, value: str) -> DataFrame:
    """`evaluate_all` of answers joined to the gold: a gold pair without an answer counts as 0.5, an
    answer without a gold pair fails the query. Of repeated answers the largest counts."""
    g = gold.groupBy(key).agg(F.max(truth).alias("__t"))
    a = answers.groupBy(key).agg(F.max(value).alias("__v"))
    both = g.withColumn("__g", F.lit(1)).join(a.withColumn("__a", F.lit(1)), key, "full")
    checked = both.select(F.when(F.col("__g").isNull(), F.raise_error(F.concat(F.lit("an answer without a gold pair: "), F.col(key).cast("string")))).otherwise(F.col("__t")).cast("int").alias("t"), F.coalesce("__v", F.lit(0.5)).alias("v"))
    return evaluate_all(materialize(checked, "pan"), "t", "v")


def verification_set(df: DataFrame, truth: str, score: str, threshold: float = 0.5) -> DataFrame:
    """One row: accuracy, macro_accuracy, micro and macro recall and precision, threshold, auc, f1 of
    the answers cut at the threshold."""
    y = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).select(F.col(truth).cast("int").alias("t"), binarize(F.col(score), threshold).cast("int").alias("y"))
    figures = class_figures(y, "t", "y")
    c = confusion(df, truth, score, threshold)
    f1 = F.round(F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)), 9).alias("f1")
    one = figures.crossJoin(auc(df, truth, score)).crossJoin(c.select(f1))  # one row each
    return one.select("accuracy", "macro_accuracy", "micro_recall", "macro_recall", "micro_precision", "macro_precision", F.lit(float(threshold)).alias("threshold"), "auc", "f1")


def class_figures(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: `class_metrics` and the micro recall, precision and F1, which for one answer per row are
    the accuracy."""
    c = m.class_metrics(df, truth, pred)
    return c.select("*", *[F.col("accuracy").alias(f"micro_{x}") for x in ("recall", "precision", "f1")])


def top_k_accuracy(scores: DataFrame, key: str, candidate: str, score: str, truth: DataFrame, ks: tuple[int, ...] = tuple(range(2, 11))) -> DataFrame:
    """(k, accuracy): the share of documents whose true class is among the k highest scores; of equal
    scores the larger class comes first. truth: (key, candidate). A document whose class has no score
    is no hit. No ranking: the scores that come before the true one are counted."""
    true = truth.select(F.col(key).alias("__k"), F.col(candidate).alias("__c")).distinct()
    own = scores.join(true, (F.col(key) == F.col("__k")) & (F.col(candidate) == F.col("__c"))).select(F.col("__k"), F.col("__c"), F.col(score).alias("__s"))
    before = (F.col(score) > F.col("__s")) | ((F.col(score) == F.col("__s")) & (F.col(candidate) > F.col("__c")))
    rank = scores.join(own, F.col(key) == F.col("__k")).groupBy("__k").agg(F.count_if(before).alias("before"))
    total = true.select("__k").distinct().agg(F.count(F.lit(1)).alias("n"))
    hits = rank.agg(*[F.count_if(F.col("before") < k).alias(f"k{k}") for k in ks])
    one = hits.crossJoin(total)  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.try_divide(F.col(f"k{k}").cast("double"), F.col("n")), 9).alias("accuracy")) for k in ks])).alias("s")).select("s.*")


def class_aucs(scores: DataFrame, candidate: str, score: str, truth: str) -> DataFrame:
    """(candidate, n, auc): one against the rest, from rows (candidate, score, truth): a row per document
    and candidate with the document's true class. Ranks within a candidate's scores come from counts of
    its distinct scores."""
    per = scores.groupBy(F.col(candidate).alias("c"), F.col(score).alias("s")).agg(F.count_if(F.col(truth) == F.col(candidate)).cast("double").alias("p"), F.count_if(F.col(truth) != F.col(candidate)).cast("double").alias("q"))
    w = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = per.withColumn("b", F.sum("q").over(w) - F.col("q"))
    return ranked.groupBy("c").agg(F.sum("p").cast("long").alias("n"), F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc")).select(F.col("c").alias(candidate), "n", F.round("auc", 9).alias("auc"))


def pair_aucs(scores: DataFrame, candidate: str, score: str, truth: str) -> DataFrame:
    """(a, b, n, auc) of each two classes a < b: the mean of the AUC of a's score and of b's score over
    the documents of a and b; n their number. Meant for few classes: a row per two of them."""
    rows = scores.select(F.col(candidate).alias("c"), F.col(score).alias("s"), F.col(truth).alias("t"))
    per = rows.groupBy("c", "s", "t").agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = per.where("c = t").select("c", "s", F.col("n").alias("p"))
    # of each candidate's score: its own documents against those of every other class
    w = Window.partitionBy("c", "o").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    others = per.where("c <> t").select("c", F.col("t").alias("o"), "s", F.col("n").alias("q"), F.lit(0.0).alias("p"))
    mine = own.join(others.select("c", "o").distinct(), "c").select("c", "o", "s", F.lit(0.0).alias("q"), "p")
    both = others.unionByName(mine).groupBy("c", "o", "s").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    one = both.withColumn("b", F.sum("q").over(w) - F.col("q")).groupBy("c", "o").agg(F.sum("p").alias("np"), F.sum("q").alias("nq"), F.try_divide(F.sum(F.col("p") * (F.col("b") + F.col("q") / 2)), F.sum("p") * F.sum("q")).alias("auc"))
    return one.groupBy(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b")).agg(F.max(F.col("np") + F.col("nq")).cast("long").alias("n"), F.round(F.avg("auc"), 9).alias("auc")).where("auc IS NOT NULL")


def multiclass_auc(scores: DataFrame, candidate: str, score: str, truth: str) -> DataFrame:
    """One row: ovr_weighted_auc, ovr_macro_auc, ovo_weighted_auc, ovo_macro_auc."""
    r, o = class_aucs(scores, candidate, score, truth).where("auc IS NOT NULL"), pair_aucs(scores, candidate, score, truth)
    figures = lambda df, name: df.agg(F.round(F.sum(F.col("auc") * F.col("n")) / F.sum("n"), 9).alias(f"{name}_weighted_auc"), F.round(F.avg("auc"), 9).alias(f"{name}_macro_auc"))
    return figures(r, "ovr").crossJoin(figures(o, "ovo"))  # one row each


def best_accuracy(df: DataFrame, truth: str, score: str, points: int = 5) -> DataFrame:
    """(threshold, accuracy): of evenly spaced thresholds from the least to the largest score the most
    accurate, the last of equal ones."""
    steps = m.threshold_search(df, truth, score, points)
    return steps.agg(F.max(F.struct("accuracy", "threshold")).alias("b")).select("b.threshold", "b.accuracy")


def accuracy_at(df: DataFrame, truth: str, score: str, threshold: float | None = None) -> DataFrame:
    """(threshold, accuracy) at a threshold; none, or 0, stands for the mean score."""
    v = _valid(df, truth, score)
    cut = F.lit(float(threshold)) if threshold else None
    mean = v.agg(F.avg("s").alias("cut")) if cut is None else v.limit(1).agg(cut.alias("cut"))
    hit = v.crossJoin(F.broadcast(mean)).agg(F.max("cut").alias("threshold"), F.avg(((F.col("s") >= F.col("cut")).cast("int") == F.col("t")).cast("double")).alias("accuracy"))
    return hit.select(F.round("threshold", 9).alias("threshold"), F.round("accuracy", 9).alias("accuracy"))


def threshold_figures(df: DataFrame, truth: str, score: str, steps: int = 100) -> DataFrame:
    """One row: accuracy, auc, c_at_1, f05u, f1, overall, threshold at the most accurate of evenly spaced
    thresholds, the last of equal ones. AUC and c@1 don't depend on the threshold; F1 and F0.5u take
    scores above it as positive and leave out, or count as undecided, those at it."""
    best = best_accuracy(df, truth, score, steps).select("threshold", "accuracy")
    v = _valid(df, truth, score)
    lo, hi = v.agg(F.min("s"), F.max("s")).first()
    if lo is None:
        return best.limit(0).select(*[F.lit(0.0).alias(c) for c in ("accuracy", "auc", "c_at_1", "f05u", "f1", "overall", "threshold")])
    s, t, cut = F.col("s"), F.col("t"), F.col("threshold")
    count = lambda c, name: F.count_if(c).cast("double").alias(name)
    at = v.crossJoin(F.broadcast(best)).groupBy("threshold", "accuracy").agg(count((s > cut) & (t == 1), "tp"), count((s > cut) & (t == 0), "fp"), count((s < cut) & (t == 1), "fn"), count(s == cut, "u"))
    tp, fp, fn, u = (F.col(c) for c in ("tp", "fp", "fn", "u"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cut_figures = at.select("threshold", "accuracy", z(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), z(F.try_divide(1.25 * tp, 1.25 * tp + 0.25 * (fn + u) + fp)).alias("f05u"))
    one = cut_figures.crossJoin(auc(df, truth, score)).crossJoin(m.verification_metrics(df, truth, score).select("c_at_1"))  # one row each
    names = ["accuracy", "auc", "c_at_1", "f05u", "f1"]
    return one.select(*[F.round(c, 9).alias(c) for c in names], F.round(sum(F.col(c) for c in names) / len(names), 9).alias("overall"), "threshold")


def similarity_summary(df: DataFrame, score: str) -> DataFrame:
    """One row: min, max, mean, std (population) and median of a score."""
    r = lambda c, name: F.round(c, 9).alias(name)
    return df.agg(r(F.min(score), "min"), r(F.max(score), "max"), r(F.avg(score), "mean"), r(F.stddev_pop(score), "std"), r(F.median(score), "median"))


def soft_vote(parts: list[DataFrame], key: str, candidate: str, score: str) -> DataFrame:
    """(key, candidate, score): of the mean of several models' scores per document and candidate the
    highest, ties to the smaller candidate. A pair must stand in all models to count."""
    every = parts[0].select(key, candidate, score)
    for p in parts[1:]:
        every = every.unionByName(p.select(key, candidate, score))
    mean = every.groupBy(key, candidate).agg(F.avg(score).alias("__m"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == len(parts))
    best = mean.groupBy(key).agg(F.min(F.struct(F.negate("__m").alias("m"), F.col(candidate).alias("c"))).alias("b"))
    return best.select(key, F.col("b.c").alias(candidate), F.round(F.negate("b.m"), 9).alias(score))
