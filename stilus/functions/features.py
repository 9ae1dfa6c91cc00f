"""Features of linguistic entries and encoded inputs: lexicon rates, tag statistics, masked sequences,
vocabularies with reserved ids, padded tensors, feature vectors and their scaling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stilus.functions.text import array_counts, ngrams_between
from stilus.session import materialize

# The part-of-speech tags that have statistics, in their order.
POS_TAGS = ("CC", "CD", "DT", "EX", "FW", "IN", "JJ", "JJR", "JJS", "LS", "MD", "NN", "NNS", "NNP", "NNPS", "PDT", "POS", "PRP", "PRP$", "RB", "RBR", "RBS", "RP", "SYM", "TO", "UH", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "WDT", "WP", "WP$", "WRB")


def word_stats(tokens: Column) -> tuple[Column, Column]:
    """(number of tokens, mean characters per token); the mean is null without tokens."""
    total = F.aggregate(tokens, F.lit(0), lambda a, x: a + F.coalesce(F.length(x), F.lit(0)))
    return F.size(tokens), F.try_divide(total.cast("double"), F.size(tokens))


def lexicon_rates(df: DataFrame, key: str, tokens: str, lexicons: DataFrame) -> DataFrame:
    """(key, lexicon, rate): the share of a record's tokens that are words of each lexicon; lexicons:
    (lexicon, word), words in small letters. Tokens are compared as they stand. Records without tokens
    have no row; a lexicon no token of a record belongs to has the rate 0."""
    rows = df.where(F.size(tokens) > 0)
    hits = array_counts(rows, [key], F.col(tokens)).join(lexicons.distinct().withColumnRenamed("word", "term"), "term").groupBy(key, "lexicon").agg(F.sum("n").alias("hits"))
    names = lexicons.agg(F.sort_array(F.collect_set("lexicon")).alias("names"))  # one entry per lexicon
    every = rows.select(key, F.size(tokens).alias("size")).crossJoin(F.broadcast(names)).select(key, "size", F.explode("names").alias("lexicon"))
    return every.join(hits, [key, "lexicon"], "left").select(key, "lexicon", F.round(F.coalesce("hits", F.lit(0)) / F.col("size"), 6).alias("rate"))


def masked_tokens(tokens: Column, tags: Column, keep: list[str]) -> Column:
    """Each token that is in `keep` as it stands, every other one as its tag."""
    return F.zip_with(tokens, tags, lambda w, t: F.when(w.isin(*keep), w).otherwise(t))


def masked_ngrams(tokens: Column, tags: Column, keep: list[str], high: int = 3) -> Column:
    """The 1- to `high`-grams of `masked_tokens`."""
    return ngrams_between(F.filter(masked_tokens(tokens, tags, keep), lambda x: x.isNotNull()), 1, high, " ")


def tag_stats(df: DataFrame, key: str, tokens: str, tags: str) -> DataFrame:
    """(key, tag, fraction, mean_length) for each tag of POS_TAGS: its distinct tokens over those of all
    these tags, and the mean length of its tokens; 0 where there is none. Within the row."""
    pairs = df.where(F.col(tokens).isNotNull() & F.col(tags).isNotNull()).select(key, F.arrays_zip(F.col(tokens).alias("w"), F.col(tags).alias("t")).alias("z"))
    own = lambda tag: F.transform(F.filter("z", lambda x: (x["t"] == tag) & x["w"].isNotNull()), lambda x: x["w"])
    per = F.transform(F.array(*[F.lit(t) for t in POS_TAGS]), lambda tag: F.struct(tag.alias("tag"), own(tag).alias("w")))
    counted = pairs.select(key, F.explode(F.array(F.transform(per, lambda x: F.struct(x["tag"].alias("tag"), F.size(F.array_distinct(x["w"])).alias("d"), F.try_divide(F.aggregate(x["w"], F.lit(0.0), lambda a, w: a + F.length(w)), F.size(x["w"])).alias("m"))))).alias("s"))
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["d"])
    return counted.select(key, total.alias("total"), F.explode("s").alias("s")).select(key, "s.tag", F.round(F.coalesce(F.try_divide(F.col("s.d"), F.col("total")), F.lit(0.0)), 6).alias("fraction"), F.round(F.coalesce("s.m", F.lit(0.0)), 6).alias("mean_length"))


# -- ids, padding and masks ---------------------------------------------------------------------
#: Reserved ids: padding, unknown, begin and end of text, begin and end of a cut line.
RESERVED = ("<ZP>", "<UNK>", "<SOS>", "<EOS>", "<SLB>", "<ELB>")


def id_table(counts: DataFrame, term: str, n: str, least: int, most: int, reserved: tuple[str, ...] = RESERVED) -> DataFrame:
    """(term, id): reserved terms from 0, then the terms with n >= least, at most `most`, by n and then
    by term. `most` bounds what one task numbers."""
    from pyspark.sql import Window

    top = counts.where(F.col(n) >= least).orderBy(F.desc(n), term).limit(most)
    own = top.select(F.col(term).alias("term"), (F.row_number().over(Window.orderBy(F.desc(n), F.col(term))) + len(reserved) - 1).cast("long").alias("id"))
    first = counts.sparkSession.createDataFrame([(t, i) for i, t in enumerate(reserved)], "term string, id long")
    return first.unionByName(own)


def to_ids(df: DataFrame, key: str, tokens: str, ids: DataFrame, unknown: int = 1) -> DataFrame:
    """(key, ids ARRAY<BIGINT>): each token's id, `unknown` where it has none, in order."""
    own = ids.select("term", F.col("id").alias("__i"))
    each = df.select(key, F.posexplode(tokens).alias("pos", "term")).join(own, "term", "left").select(key, "pos", F.coalesce("__i", F.lit(unknown)).alias("id"))
    seq = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("s")).select(key, F.transform("s", lambda x: x["id"]).alias("ids"))  # one record's tokens
    empty = F.array().cast("array<bigint>")
    return df.select(key).join(seq, key, "left").select(key, F.coalesce("ids", empty).alias("ids"))


def padded_ids(ids: Column, length: int, pad: int = 0) -> Column:
    """The first `length` ids, filled up with `pad`."""
    cut = F.slice(ids, 1, length)
    return F.concat(cut, F.array_repeat(F.lit(pad).cast("bigint"), F.greatest(F.lit(length) - F.size(cut), F.lit(0))))


def additive_mask(size: Column, length: int, low: int = -5000) -> Column:
    """0 for each of the first `size` places of `length`, `low` for the rest."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < size, 0).otherwise(low))


def nested_chars(tokens: Column) -> Column:
    """Each token as the array of its characters."""
    return F.transform(tokens, lambda w: F.filter(F.split(w, ""), lambda c: c != ""))


# -- vectors ------------------------------------------------------------------------------------
def dense_vectors(weights: DataFrame, key: str, ids: DataFrame, width: int, unit: bool = False) -> DataFrame:
    """(key, features ARRAY<DOUBLE>): the weights (key, gram, weight) laid out by the ids (gram, id) of
    at most `width` grams, if `unit` scaled to length 1; records without any of them have no row."""
    rows = weights.join(ids.select("gram", F.col("id").alias("__i")), "gram").groupBy(key).agg(F.collect_list(F.struct(F.col("__i").alias("id"), "weight")).alias("s"))  # at most width entries

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            out = np.zeros((len(batch), width))
            for i, s in enumerate(batch["s"]):
                for e in s:
                    out[i, e["id"]] = e["weight"]
            if unit:
                out /= np.sqrt((out * out).sum(axis=1))[:, None]
            yield pd.DataFrame({key: batch[key], "features": list(out)})

    return rows.mapInPandas(lay_out, f"`{key}` {dict(weights.dtypes)[key]}, features array<double>")


def column_scales(vectors: DataFrame, features: str) -> DataFrame:
    """(i, max_abs, mean, std): per place of the vectors its largest absolute value, mean and population
    standard deviation: one row per place."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            rows = [v for v in batch["v"] if v is not None]
            for width in {len(v) for v in rows}:
                x = np.array([v for v in rows if len(v) == width], float)
                mean = x[0] + (x - x[0]).mean(axis=0)
                yield pd.DataFrame({"i": np.arange(width), "n": len(x), "low": x.min(axis=0), "high": x.max(axis=0), "m": mean, "s": ((x - mean) ** 2).sum(axis=0)})

    # a batch's figures by place, not a row for each place of each vector
    each = materialize(vectors.select(F.col(features).alias("v")).mapInPandas(partial, "i int, n long, low double, high double, m double, s double"), "scales")
    n, m, mean = F.col("n"), F.col("m"), F.col("mean")
    whole = each.groupBy("i").agg(F.greatest(F.abs(F.min("low")), F.abs(F.max("high"))).alias("max_abs"), (F.sum(n * m) / F.sum(n)).alias("mean"))
    # a place that never changes has no spread, not one of rounding
    std = F.when(F.min("low") == F.max("high"), 0.0).otherwise(F.sqrt(F.sum(F.col("s") + n * (m - mean) * (m - mean)) / F.sum(n)))
    return each.join(F.broadcast(whole), "i").groupBy("i").agg(F.first("max_abs").alias("max_abs"), F.first("mean").alias("mean"), std.alias("std"))


def _arrays(scales: DataFrame, *columns: str) -> list[Column]:
    rows = scales.orderBy("i").select(*columns).collect()  # one row per place
    return [F.array(*[F.lit(float(r[c])) for r in rows]) for c in columns]


def max_abs_scaled(vectors: DataFrame, features: str, fitted: DataFrame) -> DataFrame:
    """Each place over its largest absolute value in `fitted`, where that isn't 0."""
    (top,) = _arrays(column_scales(fitted, features), "max_abs")
    return vectors.withColumn(features, F.zip_with(features, top, lambda x, m: F.when(m > 0, x / m).otherwise(x)))


def standard_scaled(vectors: DataFrame, features: str, fitted: DataFrame) -> DataFrame:
    """Each place less its mean over its standard deviation in `fitted`; a constant place is only
    moved."""
    mean, std = _arrays(column_scales(fitted, features), "mean", "std")
    scale = F.arrays_zip(mean.alias("m"), std.alias("s"))
    return vectors.withColumn(features, F.zip_with(features, scale, lambda x, p: (x - p["m"]) / F.when(p["s"] > 0, p["s"]).otherwise(1.0)))


def abs_difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def union_features(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(key, features): several parts (name, DataFrame of key, features) side by side, in their order,
    for the keys that all of them have."""
    out = None
    for name, part in parts:
        own = part.select(key, F.col("features").alias(name))
        out = own if out is None else out.join(own, key)
    return out.select(key, F.concat(*[name for name, _ in parts]).alias("features"))


def lsa(vectors: DataFrame, key: str, features: str, factors: int = 63) -> DataFrame:
    """(key, factors): the vectors in the space of the largest singular values, by distributed SVD."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    rows = vectors.select(key, features).rdd.map(lambda r: IndexedRow(r[0], Vectors.dense(r[1])))
    matrix = IndexedRowMatrix(rows)
    svd = matrix.computeSVD(min(factors, matrix.numCols()), computeU=True)
    s = svd.s.toArray()
    out = svd.U.rows.map(lambda r: (r.index, [float(x) for x in r.vector.toArray() * s]))
    return vectors.sparkSession.createDataFrame(out, f"`{key}` long, factors array<double>")
