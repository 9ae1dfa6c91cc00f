"""Finished data sets: splits of the known corpora, their files and statistics, and checks of what was
written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stilus.operators import corpus as c
from stilus.operators.skew import word_count
from stilus.sources import readers


# -- splits ---------------------------------------------------------------------------------------
def parted(aa: DataFrame, parts: tuple[tuple[str, int], ...], seed: int = 0) -> DataFrame:
    """(author, seq, part): tenths of each author's rows, dealt by hash; every row falls into a part."""
    return c.stratified_split(aa, parts, seed).withColumn("part", F.coalesce("part", F.lit(parts[-1][0])))


def with_given_test(train: DataFrame, test: DataFrame, train_tenths: int = 8, seed: int = 0) -> DataFrame:
    """(author, seq, part): a given training set cut into train and val within each author, beside a
    given test set whose authors the training set knows."""
    own = parted(train, (("train", train_tenths), ("val", 10 - train_tenths)), seed)
    known = c.restrict_to(test, train).select("author", "seq", F.lit("test").alias("part"))
    return own.unionByName(known)


def cross_domain(aa: DataFrame, domain: str, rules: dict[str, list], seed: int = 0) -> DataFrame:
    """(author, seq, part): rows of the iid domains cut 6/2/2, rows of each other domain halved into its
    val and test; authors that the iid domains don't know are left out of the others. rules: part name
    (`iid` or the name of a cross set) to values of `domain`; an unknown value fails the query."""
    routed = aa.withColumn("__d", c.route(aa, domain, rules))
    iid = routed.where("__d = 'iid'")
    out = parted(iid, (("train", 6), ("val", 2), ("test", 2)), seed)
    for name in rules:
        if name != "iid":
            cross = c.restrict_to(routed.where(F.col("__d") == name), iid)
            out = out.unionByName(parted(cross, ((f"{name}_val", 5), (f"{name}_test", 5)), seed))
    return out


def disjoint_authors(aa: DataFrame, seed: int = 0) -> DataFrame:
    """(author, seq, part): authors dealt by hash 8/1/1 into a training pool, unique_val and unique_test;
    the pool's rows cut 6/4 within each author, the second part halved without regard to authors."""
    deal = c.uniform(seed, "author") % 10
    pool = aa.where(deal < 8)
    inside = parted(pool, (("train", 6), ("rest", 4)), seed)
    half = F.when(F.col("part") == "train", "train").when(c.uniform(seed + 1, "seq") % 2 == 0, "val").otherwise("test")
    return inside.select("author", "seq", half.alias("part")).unionByName(aa.where(deal >= 8).select("author", "seq", F.when(deal == 8, "unique_val").otherwise("unique_test").alias("part")))


def normalised_pairs(pairs: DataFrame) -> DataFrame:
    """(id, text0, text1, same) of pairs with their authors: line breaks and tabs as spaces, ends trimmed."""
    plain = lambda x: F.trim(F.translate(x, "\t\n\r", "   "))
    return pairs.select("id", plain(F.col("text0")).alias("text0"), plain(F.col("text1")).alias("text1"), (F.col("author0") == F.col("author1")).cast("int").alias("same"))


def sampled_pairs(aa: DataFrame, seed: int = 0) -> DataFrame:
    """(same, text0, text1) of the verification set of an attribution set."""
    clean = c.dedup_per_author(aa)
    labels = c.relabel_first_seen(clean)
    ids = c.positive_pairs(clean, seed).unionByName(c.negative_pairs(clean, labels, seed))
    text = clean.select("seq", "text")
    first = text.select(F.col("seq").alias("seq0"), F.col("text").alias("text0"))
    second = text.select(F.col("seq").alias("seq1"), F.col("text").alias("text1"))
    return ids.join(first, "seq0").join(second, "seq1").select("same", "text0", "text1")


# -- statistics -----------------------------------------------------------------------------------
def set_statistics(aa: DataFrame, label: str) -> DataFrame:
    """(metric, value DOUBLE) of one attribution set: authors, documents, words, and documents and words
    per author; the median of documents is cut to a whole number. An empty set has no row."""
    per = aa.groupBy("author").agg(F.count(F.lit(1)).alias("t"), F.sum(word_count(F.col("text")).cast("long")).alias("w"))
    d = lambda x: x.cast("double")
    n, t, w = F.count(F.lit(1)), F.sum("t"), F.sum("w")
    figures = {"number of authors": n, "number of documents": t, "number of words": w, "docs per author": d(t) / n, "words per author": d(w) / n}
    for col, name in (("t", "docs"), ("w", "words")):
        median = F.median(col)
        figures |= {f"max {name} per author": F.max(col), f"min {name} per author": F.min(col), f"mean {name} per author": F.avg(col), f"median {name} per author": F.floor(median) if col == "t" else median, f"std {name} per author": F.stddev_pop(col)}
    one = per.agg(n.alias("__n"), *[F.round(d(v), 6).alias(k) for k, v in figures.items()]).where("__n > 0")
    return one.select(F.explode(F.array(*[F.struct(F.lit(f"{label} {k}").alias("metric"), F.col(k).alias("value")) for k in figures])).alias("s")).select("s.*")


def pair_statistics(av: DataFrame, label: str) -> DataFrame:
    """(metric, value DOUBLE): positive and negative pairs of a verification set."""
    one = av.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("same").cast("double")).alias("p")).where("n > 0")
    rows = F.array(F.struct(F.lit(f"{label} number positive pairs").alias("metric"), F.col("p").alias("value")), F.struct(F.lit(f"{label} number negative pairs").alias("metric"), (F.col("n") - F.col("p")).alias("value")))
    return one.select(F.explode(rows).alias("s")).select("s.*")


def summary(sets: dict[str, DataFrame], pairs: dict[str, DataFrame]) -> DataFrame:
    """(metric, value) of several attribution sets and verification sets."""
    out = None
    for part in [set_statistics(df, k) for k, df in sets.items()] + [pair_statistics(df, k) for k, df in pairs.items()]:
        out = part if out is None else out.unionByName(part)
    return out


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_statistics(stats: DataFrame, path: str) -> None:
    """The statistics as one JSON object with sorted keys. A row per metric: a bounded set."""
    spark = stats.sparkSession
    values = {r["metric"]: r["value"] for r in stats.collect()}
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(json.dumps(values, indent=4, sort_keys=True).encode()))
    out.close()


def _guard(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    if fs.exists(p) and len(fs.listStatus(p)) > 0:
        raise FileExistsError(f"{path} isn't empty")


def finalize(parts: dict[str, DataFrame], path: str, name: str, original: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Write a data set and return its statistics.

    parts: frames (author, seq, text) by name. `train` is written as {name}_train.csv; `val` and `test`,
    and cross sets like `cross_topic_val`, as {name}_AA_{part}.csv with the verification pairs sampled
    from them as {name}_AV_{part}.csv; `unique_val` and `unique_test` as pairs only. An empty part is
    skipped; a target that isn't empty fails. Statistics go to {name}_stats.json, those of the cross
    sets to {name}_{cross}_stats.json."""
    spark = parts["train"].sparkSession
    _guard(spark, path)
    readers.write_aa(parts["train"], f"{path}/{name}_train.csv")
    sets = {"all": original if original is not None else parts["train"], "train": parts["train"]}
    pairs: dict[str, DataFrame] = {}
    for part, df in parts.items():
        if part == "train" or df.isEmpty():
            continue
        av = sampled_pairs(df, seed)
        if not part.startswith("unique_"):
            readers.write_aa(df, f"{path}/{name}_AA_{part}.csv")
            sets[f"aa_{part}"] = df
        readers.write_av(av, f"{path}/{name}_AV_{part}.csv")
        pairs[f"av_{part}"] = av
    plain = lambda d: {k: v for k, v in d.items() if "cross" not in k and "unique" not in k}
    stats = summary(plain(sets), plain(pairs))
    write_statistics(stats, f"{path}/{name}_stats.json")
    for cross in sorted({k.removeprefix("aa_").rsplit("_", 1)[0] for k in sets if "cross" in k}):
        own = lambda d, cross=cross: {k.replace(f"{cross}_", ""): v for k, v in d.items() if cross in k or k in ("all", "train")}
        write_statistics(summary(own(sets), own(pairs)), f"{path}/{name}_{cross}_stats.json")
    return stats


# -- checks ---------------------------------------------------------------------------------------
def label_values(av: DataFrame, column: str = "same") -> DataFrame:
    """One row: ok, whether the labels are exactly 0 and 1."""
    return av.agg(F.sort_array(F.collect_set(column)).alias("v")).select(F.coalesce(F.col("v") == F.array(F.lit(0), F.lit(1)), F.lit(False)).alias("ok"))  # collect_set of labels: stops at what differs


def same_texts(aa: DataFrame, av: DataFrame) -> DataFrame:
    """(text_md5, side): texts of the attribution set that no pair has, and the reverse; none if the two
    sets hold the same texts. Compared by digest."""
    a = aa.select(F.md5("text").alias("h")).distinct()
    b = av.select(F.explode(F.array(F.md5("text0"), F.md5("text1"))).alias("h")).distinct()
    only = lambda x, y, side: x.join(y, "h", "left_anti").select(F.col("h").alias("text_md5"), F.lit(side).alias("side"))
    return only(a, b, "aa").unionByName(only(b, a, "av"))


def author_count(aa: DataFrame, expected: int) -> DataFrame:
    """One row: n_authors, expected, ok."""
    n = aa.agg(F.count_distinct("author").alias("n_authors"))
    return n.select("n_authors", F.lit(expected).cast("long").alias("expected"), (F.col("n_authors") == expected).alias("ok"))


def same_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: n_before, n_after, ok: that a step neither lost nor added rows."""
    one = before.agg(F.count(F.lit(1)).alias("n_before")).crossJoin(after.agg(F.count(F.lit(1)).alias("n_after")))  # one row each
    return one.withColumn("ok", F.col("n_before") == F.col("n_after"))


def short_texts(aa: DataFrame, least: int = 50) -> DataFrame:
    """(author, n_short): authors that hold texts under `least` characters."""
    return aa.where(F.length("text") < least).groupBy("author").agg(F.count(F.lit(1)).alias("n_short"))
