"""Corpus operators over the canonical table (author, seq, text): cleaning, dedup, relabelling,
splitting, pairing, set operations and statistics. Every function takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.operators.skew import word_count
from stilus.session import materialize


def canonical(df: DataFrame, author: str, seq: str, text: str) -> DataFrame:
    """(author, seq, text) of the rows with an author; null texts become empty."""
    return df.where(F.col(author).isNotNull()).select(F.col(author).alias("author"), F.col(seq).alias("seq"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def hash_of(seed: int, *columns) -> Column:
    """A hash every SQL engine computes alike: md5 of 'seed:' and the columns."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.col(c).cast("string") for c in columns]))


def uniform(seed: int, *columns) -> Column:
    """A whole number from 0 to 2^32 - 1 from `hash_of`."""
    return F.conv(F.substring(hash_of(seed, *columns), 1, 8), 16, 10).cast("long")


def ranked(df: DataFrame, key: str, seq: str, seed: int = 0) -> DataFrame:
    """`df` with rank (1..n in random order within the key) and n, both BIGINT.

    A key's rows are ranked within 256 buckets of the order's hash and the buckets' sizes added up, so
    no task sorts all rows of a hot key."""
    h = df.withColumn("__h", hash_of(seed, seq)).withColumn("__b", F.substring("__h", 1, 2))
    inside = h.withColumn("__r", F.row_number().over(Window.partitionBy(key, "__b").orderBy("__h", seq)))
    sizes = h.groupBy(key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(key)
    before = F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    sizes = sizes.select(F.col(key).alias("__k"), F.col("__b").alias("__b2"), before.alias("__before"), F.sum("__n").over(w).alias("n"))
    joined = inside.join(sizes, (F.col(key) == F.col("__k")) & (F.col("__b") == F.col("__b2")))
    return joined.withColumn("rank", F.col("__r") + F.col("__before")).drop("__h", "__b", "__r", "__k", "__b2", "__before")


def first_per(df: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row of the smallest seq of each key, by aggregation with partial combining."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("__s")).select(*keys, "__s.*").select(*df.columns)


def dedup_global(aa: DataFrame) -> DataFrame:
    """Of each text the row of the smallest seq."""
    return first_per(aa, ["text"])


def dedup_per_author(aa: DataFrame) -> DataFrame:
    """Of each (author, text) the row of the smallest seq."""
    return first_per(aa, ["author", "text"])


def texts_per_author(aa: DataFrame) -> DataFrame:
    """(author, n_rows, n_distinct)."""
    return aa.groupBy("author").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.xxhash64("text"), F.md5("text")).alias("n_distinct"))


def duplicate_census(aa: DataFrame) -> DataFrame:
    """One row: n_texts, n_distinct, n_repeated (texts held more than once), n_surplus rows."""
    per = aa.groupBy("text").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.sum("c").alias("n_texts"), F.count(F.lit(1)).alias("n_distinct"), F.count_if(F.col("c") > 1).alias("n_repeated"), F.sum(F.col("c") - 1).alias("n_surplus"))


def shared_texts(aa: DataFrame) -> DataFrame:
    """(text_md5, n_rows, n_authors) of texts held by several authors."""
    per = aa.groupBy("text").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("author").alias("n_authors"))
    return per.where("n_authors > 1").select(F.md5("text").alias("text_md5"), "n_rows", "n_authors")


def dedup_impact(aa: DataFrame) -> DataFrame:
    """(author, n_before, n_after): rows of each author before and after the global dedup."""
    after = dedup_global(aa).groupBy("author").agg(F.count(F.lit(1)).alias("n_after"))
    return aa.groupBy("author").agg(F.count(F.lit(1)).alias("n_before")).join(after, "author", "left").fillna(0, ["n_after"])


def dense_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """`df` sorted by `order` with its position from 0: a range sort, then per-partition offsets.

    `df` and the order must be without ties. Nothing is gathered in one task."""
    low = (1 << 33) - 1
    at = materialize(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted")
    sizes = at.groupBy(F.shiftright("__m", 33).alias("__p")).agg(F.count(F.lit(1)).alias("__n")).orderBy("__p").collect()
    offsets, total = [], 0
    for p, n in sizes:  # one row per partition
        offsets.append((p, total))
        total += n
    o = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__p long, __o long")
    return at.withColumn("__p", F.shiftright("__m", 33)).join(F.broadcast(o), "__p").withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(low)).drop("__m", "__p", "__o")


def relabel_first_seen(aa: DataFrame) -> DataFrame:
    """(author, new_id BIGINT): authors numbered from 0 in the order they first appear."""
    first = aa.groupBy("author").agg(F.min("seq").alias("first"))
    return dense_index(first, ["first", "author"], "new_id").select("author", "new_id")


def apply_labels(aa: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their new id; authors without one are dropped."""
    return aa.join(labels, "author").select(F.col("new_id").alias("author"), "seq", "text")


def apply_labels_strict(aa: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their new id; an author without one fails the query."""
    both = aa.join(labels, "author", "left")
    missing = F.raise_error(F.concat(F.lit("no label for author "), F.col("author").cast("string")))
    return both.select(F.when(F.col("new_id").isNull(), missing).otherwise(F.col("new_id")).cast("long").alias("author"), "seq", "text")


def relabel_by_name(aa: DataFrame, author: str = "author") -> DataFrame:
    """(author, new_id): authors numbered from 0 in the order of their names."""
    return dense_index(aa.select(author).distinct(), [author], "new_id").select(author, "new_id")


def restrict_to(df: DataFrame, known: DataFrame, author: str = "author") -> DataFrame:
    """Rows whose author the other set knows."""
    return df.join(known.select(author).distinct(), author, "left_semi")


def first_rows(aa: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    """The n rows of the smallest seq."""
    return aa.orderBy(seq).limit(n)


def shuffled(df: DataFrame, seq: str, seed: int = 0) -> DataFrame:
    """`df` with place BIGINT, its row's place in a random order that is the same at every run; columns
    of one row stay together."""
    return dense_index(df.withColumn("__h", hash_of(seed, seq)), ["__h", seq], "place").drop("__h")


def by_length(df: DataFrame, text: str, partitions: int) -> DataFrame:
    """Rows dealt into partitions of near lengths, sorted by length within them: batches that need little
    padding."""
    return df.repartitionByRange(partitions, F.length(text)).sortWithinPartitions(F.length(text))


def text_addresses(aa: DataFrame) -> DataFrame:
    """(seq, author, text_id): each text's place from 0 among its author's."""
    return numbered(aa.select("author", "seq"), "author", "seq").select("seq", "author", (F.col("no") - 1).alias("text_id"))


def grouped(aa: DataFrame) -> DataFrame:
    """(author, texts): an author's texts in order, for the edge of a pipeline: a list per author."""
    return aa.groupBy("author").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("s")).select("author", F.transform("s", lambda x: x["text"]).alias("texts"))


def ungrouped(df: DataFrame) -> DataFrame:
    """(author, no, text) of lists of texts, numbered from 0."""
    return df.select("author", F.posexplode("texts").alias("no", "text"))


def min_chars(aa: DataFrame, n: int = 100) -> DataFrame:
    return aa.where(F.length(F.trim("text")) >= n)


def min_words(aa: DataFrame, n: int = 101) -> DataFrame:
    """Texts of at least n pieces between single spaces, ends trimmed."""
    return aa.where(F.size(F.split(F.trim("text"), " ")) >= n)


def authors_with(aa: DataFrame, low: int, high: int | None = None, distinct: bool = False) -> DataFrame:
    """Rows of authors with low to high texts (distinct texts, if asked)."""
    count = F.count_distinct("text") if distinct else F.count(F.lit(1))
    kept = aa.groupBy("author").agg(count.alias("c")).where(F.col("c").between(low, high if high is not None else 1 << 62))
    return aa.join(kept.select("author"), "author", "left_semi")


def first_texts(aa: DataFrame, n: int) -> DataFrame:
    """The n texts of the smallest seq of each author (Catalyst limits each group before the shuffle)."""
    w = Window.partitionBy("author").orderBy("seq")
    return aa.withColumn("no", F.row_number().over(w)).where(F.col("no") <= n).drop("no")


def first_authors(aa: DataFrame, n: int) -> DataFrame:
    """Rows up to the one that introduces the n-th distinct author; later rows aren't read, even of
    known authors. Fewer authors: all rows."""
    first = aa.groupBy("author").agg(F.min("seq").alias("first"))
    cut = first.orderBy("first").limit(n).agg(F.max("first")).first()[0]
    return aa.where(F.col("seq") <= F.lit(cut)) if cut is not None else aa.limit(0)


def top_authors(aa: DataFrame, n: int = 50) -> DataFrame:
    """(author, n_texts) of the n authors with most texts; ties by first appearance."""
    per = aa.groupBy("author").agg(F.count(F.lit(1)).alias("n_texts"), F.min("seq").alias("first"))
    return per.orderBy(F.desc("n_texts"), "first", "author").limit(n).select("author", "n_texts")


def stratified_split(aa: DataFrame, parts=(("train", 6), ("val", 2), ("test", 2)), seed: int = 0) -> DataFrame:
    """(author, seq, part): rows of each author dealt by random rank and cumulative quota of tenths."""
    r = ranked(aa.select("author", "seq"), "author", "seq", seed)
    whole, upto, part = sum(q for _, q in parts), 0, None
    for name, q in parts:
        upto += q
        hit = (F.col("rank") - 1) * whole < F.col("n") * upto
        part = F.when(hit, name) if part is None else part.when(hit, name)
    return r.select("author", "seq", part.alias("part"))


def numbered(df: DataFrame, key: str, seq: str) -> DataFrame:
    """`df` with no BIGINT from 1: a row's place in its key's order of seq, which must be unique.

    All rows are sorted by (key, seq) over ranges, so a hot key is cut among tasks, and a row's place is
    its place in all less that of its key's first row."""
    at = dense_index(df, [key, seq], "__i")
    first = at.groupBy(key).agg(F.min("__i").alias("__f"))
    return at.join(first, key).withColumn("no", F.col("__i") - F.col("__f") + 1).drop("__i", "__f")


def positional_split(aa: DataFrame, cuts=(("train", 600), ("val", 800)), rest: str = "test") -> DataFrame:
    """(author, seq, part) by a text's place in its author's order."""
    no, part = F.col("no"), None
    for name, upto in cuts:
        part = F.when(no <= upto, name) if part is None else part.when(no <= upto, name)
    return numbered(aa.select("author", "seq"), "author", "seq").select("author", "seq", part.otherwise(rest).alias("part"))


def forced_train_split(aa: DataFrame, least: int = 2, seed: int = 0) -> DataFrame:
    """Authors under `least` texts go to train; the others are split 80/20."""
    r = ranked(aa.select("author", "seq"), "author", "seq", seed)
    return r.select("author", "seq", F.when((F.col("n") < least) | ((F.col("rank") - 1) * 10 < F.col("n") * 8), "train").otherwise("val").alias("part"))


def bernoulli_split(df: DataFrame, seq: str, p: float = 0.2, seed: int = 0) -> DataFrame:
    """Each row goes to test with probability p, told by its id's hash."""
    return df.select(seq, F.when(uniform(seed, seq) < F.lit(int(p * (1 << 32))), "test").otherwise("train").alias("part"))


def sample_rows(df: DataFrame, seq: str, n: int, seed: int = 0) -> DataFrame:
    """n rows at random, the same at every run."""
    return df.orderBy(hash_of(seed, seq), seq).limit(n)


def positive_pairs(aa: DataFrame, seed: int = 0) -> DataFrame:
    """(seq0, seq1, same = 1): each text with the next one of its author in a random ring. aa must be
    free of repeats per author; authors with one text have none."""
    r = ranked(aa.select("author", "seq"), "author", "seq", seed).where("n > 1")
    other = r.select(F.col("author").alias("a1"), F.col("rank").alias("r1"), F.col("seq").alias("seq1"))
    return r.join(other, (F.col("author") == F.col("a1")) & (F.col("rank") % F.col("n") + 1 == F.col("r1"))).select(F.col("seq").alias("seq0"), "seq1", F.lit(1).alias("same"))


def negative_pairs(aa: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """(seq0, seq1, same = 0): each text of an author with several with a text of another author, both
    drawn by hash; an equi-join on (author number, rank), never a cross join. labels: dense ids."""
    # narrow, and read three times
    r = materialize(ranked(aa.select("author", "seq"), "author", "seq", seed).join(labels, "author").select("new_id", "seq", "rank", "n"), "ranked")
    sizes = r.groupBy("new_id").agg(F.max("n").alias("size"))
    n_authors = labels.count()
    if n_authors < 2:
        return r.limit(0).select(F.col("seq").alias("seq0"), F.col("seq").alias("seq1"), F.lit(0).alias("same"))
    mine = r.where("n > 1").withColumn("other", (F.col("new_id") + 1 + uniform(seed + 1, "seq") % (n_authors - 1)) % n_authors)
    mine = mine.join(sizes.withColumnRenamed("new_id", "other"), "other").withColumn("pick", uniform(seed + 2, "seq") % F.col("size") + 1)
    theirs = r.select(F.col("new_id").alias("o2"), F.col("rank").alias("r2"), F.col("seq").alias("seq1"))
    return mine.join(theirs, (F.col("other") == F.col("o2")) & (F.col("pick") == F.col("r2"))).select(F.col("seq").alias("seq0"), "seq1", F.lit(0).alias("same"))


def pairs_to_rows(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """The distinct members of pairs (unpivot)."""
    return pairs.select(F.explode(F.array(left, right)).alias("seq")).distinct()


def union_new(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of a, then the distinct rows of b that aren't among them."""
    return a.unionByName(b.distinct().join(a, list(a.columns), "left_anti"))


def merge_pairs(large: DataFrame, small: DataFrame, key: str = "id", once: bool = True) -> DataFrame:
    """Two sets of pairs in one; of pairs with the same id that of the larger set, unless repeats are
    wanted."""
    return large.unionByName(small.join(large.select(key), key, "left_anti").select(*large.columns)) if once else large.unionByName(small)


def differences(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(column, side): distinct values of one side that the other hasn't."""
    only = lambda x, y, side: x.select(column).distinct().join(y.select(column), column, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def combine(a: DataFrame, b: DataFrame, drop: int = 0) -> DataFrame:
    """Two corpora with dense author numbers made one: the second's numbers follow the first's, its
    first `drop` authors left out and the others numbered anew."""
    if drop:
        b = b.where(F.col("author") >= drop).withColumn("author", F.col("author") - drop)
    top = a.agg(F.max("author")).first()[0]
    return a.unionByName(b.withColumn("author", F.col("author") + (top + 1 if top is not None else 0)))


def chunks(df: DataFrame, key: str, text: str, width: int = 2560) -> DataFrame:
    """(key, no, chunk): tumbling pieces of `width` characters; an empty text gives one empty chunk."""
    n = F.greatest(F.ceil(F.length(text) / F.lit(float(width))), F.lit(1)).cast("int")
    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).alias("__t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("no"))
    return rows.select(key, "no", F.expr(f"substring(__t, no * {width} + 1, {width})").alias("chunk"))


def corpus_stats(aa: DataFrame, by: list[str]) -> DataFrame:
    """Per group: authors, texts, words, and texts and words per author (max, min, mean, median, std)."""
    per = aa.groupBy(*by, "author").agg(F.count(F.lit(1)).alias("t"), F.sum(word_count(F.col("text")).cast("long")).alias("w"))
    stats = [F.count(F.lit(1)).alias("n_authors"), F.sum("t").alias("n_texts"), F.sum("w").alias("n_words")]
    for c, name in (("t", "texts"), ("w", "words")):
        stats += [F.max(c).alias(f"max_{name}"), F.min(c).alias(f"min_{name}"), F.round(F.avg(c), 6).alias(f"mean_{name}"), F.round(F.median(c), 6).alias(f"median_{name}"), F.round(F.stddev_pop(c), 6).alias(f"std_{name}")]
    return per.groupBy(*by).agg(*stats) if by else per.agg(*stats)


def route(df: DataFrame, column: str, rules: dict[str, list[str]]) -> Column:
    """The part whose list holds the value; an unknown value fails the query."""
    out = None
    for part, values in rules.items():
        hit = F.col(column).isin(values)
        out = F.when(hit, part) if out is None else out.when(hit, part)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown category: "), F.coalesce(F.col(column), F.lit("null")))))


def route_by_name(column: str, rules: dict[str, list[str]], rest: str) -> Column:
    """The part one of whose substrings the value holds, the first in order; else `rest`."""
    out = None
    for part, pieces in rules.items():
        hit = F.lit(False)
        for x in pieces:
            hit = hit | F.col(column).contains(x)
        out = F.when(hit, part) if out is None else out.when(hit, part)
    return F.lit(rest) if out is None else out.otherwise(rest)


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """(column) values of a that are also in b, once."""
    return a.select(column).distinct().join(b.select(column), column, "left_semi")
