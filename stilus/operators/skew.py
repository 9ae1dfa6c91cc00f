"""Per-key results without the imbalance of a few hot keys.

Two-stage salted aggregation: rows of heavy keys get a salt, partial results are computed per
(key, salt) and then merged per key. Light keys keep salt 0, so they cost no extra rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stilus.session import materialize


#: Rows that tell which keys are heavy, about; which they are touches only how the work is spread.
SAMPLE_ROWS = 200_000


def heavy_keys(df: DataFrame, key: str, min_share: float, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Keys that hold about `min_share` of the rows or more, told by a sample of about `rows` rows.

    Every key above that share of a table no larger than the sample is among them, and of a larger one
    all but surely, keys from half the share on counting; at most 2 / min_share come out, so they may be
    sent to every task. Results never depend on them. An empty table gives no row.
    """
    if not 0 < min_share <= 1:
        raise ValueError("min_share lies in (0, 1]")
    n = df.count()
    share = min(1.0, rows / max(n, 1))
    some = df.select(key) if share == 1 else df.select(key).sample(False, share, seed=7)
    counts = some.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") >= F.lit(min_share / 2 * share * n)).orderBy(F.desc("n"), key).limit(int(2 / min_share) + 1)
    return df.sparkSession.createDataFrame([(r[0],) for r in top.collect()], df.select(key).schema)


def with_salt(df: DataFrame, key: str, scatter: Sequence[str], min_share: float = 0.01, salts: int = 64, name: str = "salt") -> DataFrame:
    """`df` with the INT column `name`: 0 for light keys and null keys, 0..salts-1 for heavy ones.

    The salt is a hash of the columns `scatter`, so a repeated task gives each row the same salt.
    A row's salt column replaces any column of that name.
    """
    hot = heavy_keys(df, key, min_share).select(F.col(key).alias("__hot"))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in scatter]), F.lit(salts)).cast("int")
    joined = df.join(F.broadcast(hot), df[key] == F.col("__hot"), "left")
    return joined.withColumn(name, F.when(F.col("__hot").isNotNull(), spread).otherwise(F.lit(0))).drop("__hot")


def salted_aggregate(df: DataFrame, key: str, scatter: Sequence[str], partial: Sequence[Column], merge: Sequence[Column], min_share: float = 0.01, salts: int = 64) -> DataFrame:
    """One row per non-null `key`: `partial` per (key, salt), then `merge` of those per key.

    partial: aggregates over the rows, each with an alias; merge: aggregates over these aliases.
    Null keys have no row in the result; an empty table gives none.
    """
    salted = with_salt(df.where(F.col(key).isNotNull()), key, scatter, min_share, salts, "__salt")
    return salted.groupBy(key, "__salt").agg(*partial).groupBy(key).agg(*merge)


def word_count(text: Column) -> Column:
    """Words of `text` between white space; null counts as 0."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")), F.lit(0))


SPLITS = ("train", "AA_val", "AA_test", "cross_topic_test")


def author_profile(texts: DataFrame, key: str = "labels", text: str = "text", split: str = "split", splits: Sequence[str] = SPLITS, min_share: float = 0.01, salts: int = 64) -> DataFrame:
    """One row per author: rows, distinct texts and words, in all and per split.

    Distinct texts are counted within (author, salt), where the salt of a hot author is a hash of
    the text: equal texts meet in one salt, so the counts of the salts add up. Texts are compared
    by their 256-bit digest, which keeps long texts out of the shuffle.

    Null author: no row. Null text: counts as a row, neither as a text nor as words; the empty text
    is a text. A split outside `splits` or null counts only in the totals. Extra columns are ignored.
    """
    slim = texts.select(F.col(key), F.col(split).alias("__split"), F.sha2(F.col(text), 256).alias("__text"), word_count(F.col(text)).alias("__words"))
    salted = with_salt(slim.where(F.col(key).isNotNull()), key, ["__text"], min_share, salts, "__salt")
    # one row per (author, salt, split, text): copies fall together before the first shuffle
    parts = salted.groupBy(key, "__salt", "__split", "__text").agg(F.count(F.lit(1)).alias("__n"), F.sum("__words").alias("__w"))
    wide = [F.sum("__n").alias("n_rows"), F.countDistinct("__text").alias("n_texts"), F.sum("__w").alias("n_words")]
    merge = [F.sum("n_rows").alias("n_rows"), F.sum("n_texts").alias("n_texts"), F.sum("n_words").alias("n_words")]
    for s in splits:
        here = F.col("__split") == s
        wide += [F.sum(F.when(here, F.col("__n")).otherwise(0)).alias(f"rows_{s}"), F.count(F.when(here, F.col("__text"))).alias(f"texts_{s}"), F.sum(F.when(here, F.col("__w")).otherwise(0)).alias(f"words_{s}")]
        merge += [F.sum(f"{what}_{s}").alias(f"{what}_{s}") for what in ("rows", "texts", "words")]
    return parts.groupBy(key, "__salt").agg(*wide).groupBy(key).agg(*merge)


def dominant_keys(df: DataFrame, key: str, share: float, scatter: Sequence[str]) -> DataFrame:
    """Keys holding at least `share` of the rows with a key, from salted per-key counts: one pass, whose
    counts also give the total."""
    counts = salted_aggregate(df, key, scatter, [F.count(F.lit(1)).alias("n")], [F.sum("n").alias("n")], min_share=share)
    counts = materialize(counts, "key_counts")  # one narrow row per key
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= F.lit(share) * F.lit(float(total))).select(key)
