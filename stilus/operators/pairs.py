"""Pairs of texts and vectors: chunked and cut pairs, samplers for training, hard examples, evaluators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.operators import corpus as c
from stilus.operators import scoring as m
from stilus.operators.evaluation import similarity_summary


def aligned_chunks(pairs: DataFrame, keys: list[str], a: str, b: str, width: int = 1280, most: int = 100_000) -> DataFrame:
    """(keys, no, chunk0, chunk1): pieces of `width` characters at the same places of both texts, up to
    the end of the shorter; of each text at most `most` characters. A pair with an empty text has none."""
    size = F.least(F.length(a), F.length(b), F.lit(most))
    rows = pairs.where(size > 0).select(*keys, F.substring(F.col(a), 1, most).alias("__a"), F.substring(F.col(b), 1, most).alias("__b"), F.explode(F.sequence(F.lit(0), F.ceil(size / float(width)).cast("int") - 1)).alias("no"))
    return rows.select(*keys, "no", F.expr(f"substring(__a, no * {width} + 1, {width})").alias("chunk0"), F.expr(f"substring(__b, no * {width} + 1, {width})").alias("chunk1"))


def chunks_up_to(df: DataFrame, key: str, text: str, width: int = 512, most: int = 100_000) -> DataFrame:
    """(key, no, chunk): tumbling pieces of the first `most` characters; an empty text has none."""
    return c.chunks(df.where(F.length(text) > 0).withColumn(text, F.substring(text, 1, most)), key, text, width)


def long_text_chunks(df: DataFrame, key: str, text: str, width: int = 2560, short: int = 3072, test: bool = False) -> DataFrame:
    """(key, no, chunk): pieces of `width` characters of texts longer than that; a shorter text, and in
    a test set every text, is one piece of at most `short` characters."""
    cut = df.where(F.col(text).isNotNull())
    one = cut if test else cut.where(F.length(text) <= width)
    whole = one.select(key, F.lit(0).alias("no"), F.substring(text, 1, short).alias("chunk"))
    return whole if test else c.chunks(cut.where(F.length(text) > width), key, text, width).unionByName(whole)


def list_chunks(items: Column, size: int) -> Column:
    """An array cut into arrays of `size` elements, the last one shorter; none of an empty array."""
    n = F.size(items)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(items, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def random_substring(text: Column, key: str, width: int = 2560, seed: int = 0) -> Column:
    """`width` characters of a text from a place drawn by its key's hash; the whole of a text not longer
    than that."""
    begin = c.uniform(seed, key) % (F.greatest(F.length(text) - width, F.lit(0)) + 1)
    return F.substring(text, (begin + 1).cast("int"), F.lit(width))


def merge_entries(df: DataFrame, key: str, order: str, texts: list[str], arrays: list[str]) -> DataFrame:
    """One entry per key: its texts joined by line breaks and its arrays one after the other, in the
    order given. Meant for keys with few entries: a key's entries are gathered."""
    parts = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *texts, *arrays))).alias("s"))
    joined = [F.array_join(F.transform("s", _field(t)), "\n").alias(t) for t in texts]
    return parts.select(key, *joined, *[F.flatten(F.filter(F.transform("s", _field(x)), lambda y: y.isNotNull())).alias(x) for x in arrays])


def _field(name: str):
    return lambda x: x[name]


def with_test_flag(train: DataFrame, test: DataFrame) -> DataFrame:
    """Both sets in one, with `is_test_datapoint`."""
    return train.withColumn("is_test_datapoint", F.lit(0)).unionByName(test.withColumn("is_test_datapoint", F.lit(1)))


def min_chars_both(pairs: DataFrame, a: str, b: str, n: int = 50) -> DataFrame:
    return pairs.where((F.length(a) >= n) & (F.length(b) >= n))


def losses_by_author(aa: DataFrame, n: int = 50) -> DataFrame:
    """(author, n_short, n_kept): texts under n characters and others."""
    return aa.groupBy("author").agg(F.count_if(F.length("text") < n).alias("n_short"), F.count_if(F.length("text") >= n).alias("n_kept"))


def gated(aa: DataFrame, n: int = 50, most: int = 9) -> DataFrame:
    """Texts of at least n characters; the query fails if any author would lose more than `most`."""
    bad = losses_by_author(aa, n).agg(F.coalesce(F.max("n_short"), F.lit(0)).alias("worst"))
    checked = bad.select(F.when(F.col("worst") > most, F.raise_error(F.lit(f"an author loses more than {most} texts"))).otherwise(F.lit(True)).alias("ok"))
    return aa.where(F.length("text") >= n).crossJoin(F.broadcast(checked)).where("ok").drop("ok")  # one row


def drawn_pairs(aa: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """(seq0, seq1, same): for each text of an author, by a fair coin of its hash, a text of its own
    author (perhaps itself) or one of another author, drawn by hash. labels: dense author ids."""
    r = c.ranked(aa.select("author", "seq"), "author", "seq", seed).join(labels, "author")
    sizes = r.groupBy("new_id").agg(F.max("n").alias("size"))
    n = labels.count()
    if n < 2:
        return r.limit(0).select(F.col("seq").alias("seq0"), F.col("seq").alias("seq1"), F.lit(0).alias("same"))
    same = (c.uniform(seed + 3, "seq") % 2).cast("int")
    other = F.when(same == 1, F.col("new_id")).otherwise((F.col("new_id") + 1 + c.uniform(seed + 1, "seq") % (n - 1)) % n)
    mine = r.select("seq", same.alias("same"), other.alias("other")).join(sizes.withColumnRenamed("new_id", "other"), "other").withColumn("pick", c.uniform(seed + 2, "seq") % F.col("size") + 1)
    theirs = r.select(F.col("new_id").alias("o2"), F.col("rank").alias("r2"), F.col("seq").alias("seq1"))
    return mine.join(theirs, (F.col("other") == F.col("o2")) & (F.col("pick") == F.col("r2"))).select(F.col("seq").alias("seq0"), "seq1", "same")


def passes_of_pairs(aa: DataFrame, labels: DataFrame, passes: int = 1, seed: int = 0) -> DataFrame:
    """(seq0, seq1, same): in each pass for every text one pair with a text of its own author (perhaps
    itself) and one with a text of any author (perhaps its own), which counts as different."""
    out = None
    for p in range(passes):
        s = seed + 10 * p
        r = c.ranked(aa.select("author", "seq"), "author", "seq", s).join(labels, "author")
        sizes = r.groupBy("new_id").agg(F.max("n").alias("size"))
        n = max(1, labels.count())
        each = r.select("seq", F.explode(F.array(F.struct(F.lit(1).alias("same"), F.col("new_id").alias("other")), F.struct(F.lit(0).alias("same"), (c.uniform(s + 1, "seq") % n).alias("other")))).alias("e")).select("seq", "e.*")
        mine = each.join(sizes.withColumnRenamed("new_id", "other"), "other").withColumn("pick", c.uniform(s + 2, "seq", "same") % F.col("size") + 1)
        theirs = r.select(F.col("new_id").alias("o2"), F.col("rank").alias("r2"), F.col("seq").alias("seq1"))
        one = mine.join(theirs, (F.col("other") == F.col("o2")) & (F.col("pick") == F.col("r2"))).select(F.col("seq").alias("seq0"), "seq1", "same")
        out = one if out is None else out.unionByName(one)
    return out


def training_pairs(aa: DataFrame, least: int = 50, twice: bool = True, unique: bool = True, seed: int = 0) -> DataFrame:
    """(seq0, seq1, same): pairs for training from texts longer than `least` characters, repeats of an
    author's text taken once; sampled once or twice, the second sample's pairs that the first one holds
    left out unless told otherwise."""
    clean = c.dedup_per_author(aa.where(F.length("text") > least).withColumn("text", F.replace("text", F.lit("\x00"), F.lit(""))))
    labels = c.relabel_first_seen(clean)

    def sample(s: int) -> DataFrame:
        return c.positive_pairs(clean, s).unionByName(c.negative_pairs(clean, labels, s))

    first = sample(seed)
    if not twice:
        return first
    return c.union_new(first, sample(seed + 100)) if unique else first.unionByName(sample(seed + 100))


def tasks(aa: DataFrame, ways: int, shots: int, n_tasks: int, seed: int = 0) -> DataFrame:
    """(task, author, seq, role): for each task `ways` authors with at least 2 x `shots` texts, drawn by
    hash, and of each `shots` support texts and `shots` query texts."""
    r = c.ranked(aa.select("author", "seq"), "author", "seq", seed).where(F.col("n") >= 2 * shots)
    ids = r.sparkSession.range(n_tasks).withColumnRenamed("id", "task")
    drawn = r.select("author").distinct().crossJoin(F.broadcast(ids))  # authors x tasks: the caller's choice
    w = Window.partitionBy("task").orderBy(c.hash_of(seed, "task", "author"), "author")
    own = drawn.withColumn("__w", F.row_number().over(w)).where(F.col("__w") <= ways).select("task", "author")
    role = F.when(F.col("rank") <= shots, "support").otherwise("query")
    return r.where(F.col("rank") <= 2 * shots).join(own, "author").select("task", "author", "seq", role.alias("role"))


def row_range_shard(df: DataFrame, seq: str, shards: int = 10) -> DataFrame:
    """`df` with shard 0..shards-1: equal runs of rows in the order of seq."""
    n = df.count()
    at = c.dense_index(df, [seq], "__i")
    return at.withColumn("shard", F.least(F.floor(F.col("__i") * shards / F.lit(max(n, 1))), F.lit(shards - 1)).cast("int")).drop("__i")


def hard_examples(queries: DataFrame, rows: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(query, positive, negative): for each query the farthest other row of its label and the nearest row
    of another label, ties to the smaller key; null where there is none. The query set is stated by the
    caller; a task keeps one candidate of each kind per query before the shuffle."""
    q = queries.select(F.col(key).alias("query"), F.col(label).alias("__l"), F.col(vector).alias("__q"))
    d = m.against_blocks(q, rows.select(key, label, vector)).where(F.col("query") != F.col(key)).select("query", key, (F.col("__l") == F.col(label)).alias("same"), F.round(m.euclidean(F.col("__q"), F.col(vector)), 9).alias("d"))
    best = d.groupBy("query").agg(F.max(F.when(F.col("same"), F.struct("d", F.negate(key).alias("k")))).alias("p"), F.min(F.when(~F.col("same"), F.struct("d", F.col(key).alias("k")))).alias("n"))
    return best.select("query", F.negate("p.k").alias("positive"), F.col("n.k").alias("negative"))


def first_profiles(vectors: DataFrame, label: str, order: str, vector: str, docs: int = 1) -> DataFrame:
    """(label, order, vector): the first `docs` vectors of each label."""
    w = Window.partitionBy(label).orderBy(order)
    return vectors.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= docs).select(label, order, vector)


def nearest_profile(queries: DataFrame, profiles: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(query, mean, first, knn1, knn3, knn5): the label nearest to each query by the mean distance to
    its profile vectors, by the distance to its first one, and by vote of the 1, 3 and 5 nearest profile
    vectors; of equal ones the smaller label. profiles: (label, key, vector); those of the query's own
    key don't count."""
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("__q"))
    d = m.against_blocks(q, profiles.select(F.col(label).alias("c"), F.col(key).alias("k"), F.col(vector).alias("__v"))).where(F.col("query") != F.col("k")).select("query", "c", "k", F.round(m.euclidean(F.col("__q"), F.col("__v")), 9).alias("d"))
    per = d.groupBy("query", "c").agg(F.avg("d").alias("mean"), F.min_by("d", "k").alias("first"))
    by = per.groupBy("query").agg(F.min(F.struct(F.round("mean", 9), "c")).alias("m"), F.min(F.struct("first", "c")).alias("f")).select("query", F.col("m.c").alias("mean"), F.col("f.c").alias("first"))
    near = d.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "k"))).where("r <= 5")
    votes = near.groupBy("query", "c").agg(*[F.count_if(F.col("r") <= k).alias(f"v{k}") for k in (1, 3, 5)])
    vote = votes.groupBy("query").agg(*[F.max(F.struct(F.col(f"v{k}"), F.negate("c").alias("c"))).alias(f"b{k}") for k in (1, 3, 5)])
    return by.join(vote, "query").select("query", "mean", "first", *[F.negate(f"b{k}.c").alias(f"knn{k}") for k in (1, 3, 5)])


def pair_distances(chunks: DataFrame, pair: list[str], no: str, a: str, b: str, seed: int = 0) -> DataFrame:
    """(pair, mean, median, first, random): of each pair's chunk distances (Euclid) the mean, the median,
    that of the first chunk and that of one drawn by hash."""
    d = chunks.select(*pair, no, m.euclidean(F.col(a), F.col(b)).alias("d"))
    r = lambda c_, name: F.round(c_, 9).alias(name)
    return d.groupBy(*pair).agg(r(F.avg("d"), "mean"), r(F.median("d"), "median"), r(F.min_by("d", no), "first"), r(F.min_by("d", F.struct(c.hash_of(seed, *pair, no), F.col(no))), "random"))


def distance_evaluation(distances: DataFrame, ways: tuple[str, ...] = ("mean", "median", "first", "random")) -> DataFrame:
    """(way, min, max, mean, std, median): the kernel similarities of each way of summing up a pair."""
    out = None
    for w in ways:
        one = similarity_summary(distances.select(m.kernel(F.col(w)).alias("s")), "s").withColumn("way", F.lit(w))
        out = one if out is None else out.unionByName(one)
    return out
