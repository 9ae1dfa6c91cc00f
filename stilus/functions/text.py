"""Text functions: normalisers, masks, counts and n-grams, as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stilus.session import materialize

#: Terms with their frequencies are sent to every task up to this many; beyond it they are joined by
#: shuffle.
SENT_TERMS = 300_000


def normal_base(t: Column) -> Column:
    """Digits become 0; runs of a space and a line break or tab after it go; addresses written
    `https:` and backslashes become @. Each step sees what the ones before it left."""
    t = F.regexp_replace(F.regexp_replace(t, "[0-9]", "0"), "( \n| \t)+", "")
    return F.regexp_replace(t, r"https:\\+([a-zA-Z0-9.]+)?", "@")


def distort(t: Column) -> Column:
    """Runs of plain letters become one star, after `normal_base`."""
    return F.regexp_replace(normal_base(t), "[a-zA-Z]+", "*")


def only_words(t: Column) -> Column:
    """`normal_base` without anything but letters, numbers and white space."""
    return F.regexp_replace(normal_base(t), r"[^\p{L}\p{N}\s\x1c-\x1f\x{85}\p{Z}]", "")


def mask_urls(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"(www|http)[^ \t\r\n]+", " URL ")


def mask_tweet(t: Column) -> Column:
    """Links go, user names become @USER."""
    return F.regexp_replace(F.regexp_replace(t, r"http[^ \t\r\n]+", ""), r"@[^ \t\r\n]+", "@USER")


#: Contractions split off, in this order.
CONTRACTIONS = (("cannot ", "can not "), ("n't ", " n't "), ("n 't ", " n't "), ("ca n't", "can't"), ("ai n't", "ain't"), ("'m ", " 'm "), ("'re ", " 're "), ("'s ", " 's "), ("'ll ", " 'll "), ("'d ", " 'd "), ("'ve ", " 've "), (" p . m .", "  p.m."), (" p . m ", " p.m "), (" a . m .", " a.m."), (" a . m ", " a.m "))


def split_contractions(t: Column) -> Column:
    for old, new in CONTRACTIONS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(t, " +", " "))


def nonspace_chars(t: Column) -> Column:
    return F.length(F.regexp_replace(t, r"[ \t\r\n\f]+", ""))


def words(t: Column) -> Column:
    return F.filter(F.split(t, r"[ \t\r\n\f]+"), lambda w: w != "")


def ngrams_of(items: Column, n: int, joiner: str) -> Column:
    """The runs of n neighbouring elements, joined; none if there are fewer.

    Built by pairing shifted slices, so the array is read n times and not once per run."""
    size = F.greatest(F.size(items) - (n - 1), F.lit(0))
    out = F.slice(items, 1, size)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(items, j + 1, size), lambda x, y: F.concat(x, F.lit(joiner), y))
    return out


def array_counts(df: DataFrame, keys: list[str], items: Column) -> DataFrame:
    """(keys, term, n): each distinct non-null element of each row's array and how often it stands
    there. Counted within the row: the array is sorted, each run of equals told by where it begins and
    where the next one does. No shuffle.

    The sorted array passes a generator of one row: the optimiser doesn't carry an expression through
    it, so no array is sorted again for each of its elements."""
    s, st = F.col("__s"), F.col("__st")
    kept = df.select(*keys, F.explode(F.array(F.array_sort(F.filter(items, lambda t: t.isNotNull())))).alias("__s"))
    begun = kept.select(*keys, "__s", F.explode(F.array(F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull()))).alias("__st"))
    ends = F.slice(F.concat(F.slice(st, 2, F.size(st)), F.array(F.size(s))), 1, F.size(st))
    each = begun.select(*keys, F.explode(F.zip_with(st, ends, lambda x, y: F.struct(F.get(s, x).alias("term"), (y - x).cast("long").alias("n")))).alias("__e"))
    return each.select(*keys, "__e.term", "__e.n")


def char_ngrams(t: Column, n: int) -> Column:
    return ngrams_of(F.filter(F.split(t, ""), lambda c: c != ""), n, "")


def ngrams_between(items: Column, low: int, high: int, joiner: str) -> Column:
    """The n-grams of every n from low to high."""
    return F.concat(*[ngrams_of(items, n, joiner) for n in range(low, high + 1)])


def word_tokens(t: Column) -> Column:
    """Words of two or more letters, digits or underscores."""
    return F.regexp_extract_all(t, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def _piece(w: Column, n: int):
    return lambda i: F.substring(w, i + 1, F.lit(n))


def _equals(k: int):
    return lambda x: x == k


def inner_ngrams(t: Column, low: int, high: int) -> Column:
    """Character n-grams that don't leave their word: each word, padded by a space at both ends, gives
    its n-grams of every n from low to high; a padded word no longer than n gives itself, once, at the
    first such n."""

    def of(w: Column) -> Column:
        w = F.concat(F.lit(" "), w, F.lit(" "))
        size, parts = F.length(w), []
        for n in range(low, high + 1):
            runs = F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), _piece(w, n))
            parts.append(runs if n == low else F.when(size >= n, runs).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(words(t), of))


def ngram_counts(df: DataFrame, grams: Column, key: str) -> DataFrame:
    """(gram, n, n_docs): occurrences and documents of each n-gram. Counted per document first within
    the tasks that read it, so each document's repeats don't travel."""
    each = array_counts(df, [], grams)
    return each.groupBy(F.col("term").alias("gram")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))


def frequent(counts: DataFrame, total: int, min_share: float, most: int) -> DataFrame:
    """(gram, n, n_docs, id): grams in at least min_share of `total` documents, at most `most`, the
    ones that occur most, ties by gram; numbered from 0 by gram. most bounds what one task sorts."""
    top = counts.where(F.col("n_docs") >= min_share * total).orderBy(F.desc("n"), "gram").limit(most)
    return top.withColumn("id", F.row_number().over(Window.orderBy("gram")) - 1)


def tfidf(df: DataFrame, key: str, grams: Column, min_docs: int = 2, sublinear: bool = True, scaled: bool = True, min_share: float = 0.0) -> DataFrame:
    """(key, gram, weight): tf (ln((1 + N) / (1 + df)) + 1), where tf is the count or, if sublinear,
    1 + ln of it; scaled to length 1 per document and rounded unless told otherwise. N is the number of rows; grams
    in fewer than min_docs rows or min_share of them have no weight. `key` must be unique.

    Counts are made within each document. While the terms' frequencies are few enough to be sent to
    every task, only they and what belongs to one document again are shuffled."""
    tf = array_counts(df, [key], grams)
    total = df.count()
    seen = materialize(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= F.greatest(F.lit(min_docs), F.lit(min_share * total))), "df")
    if seen.count() <= SENT_TERMS:
        seen = F.broadcast(seen)
    base = 1 + F.log(F.col("n").cast("double")) if sublinear else F.col("n").cast("double")
    raw = tf.join(seen, "term").select(key, F.col("term").alias("gram"), (base * (F.log(F.lit(1.0 + total) / (1 + F.col("df"))) + 1)).alias("w"))
    if not scaled:
        return raw.withColumnRenamed("w", "weight")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # the terms of one document
    return raw.select(key, "gram", F.round(F.col("w") / norm, 6).alias("weight"))


def share_of_length(df: DataFrame, key: str, items: Column) -> DataFrame:
    """(key, gram, weight): count times idf over 1 + the number of elements."""
    weights = tfidf(df, key, items, min_docs=1, sublinear=False, scaled=False)
    size = df.select(key, F.size(items).alias("__size"))
    return weights.join(size, key).select(key, "gram", F.round(F.col("weight") / (1 + F.col("__size")), 9).alias("weight"))


def word_lengths(t: Column) -> Column:
    """Shares of the words of 1 to 10 characters among all words; null where there is no word."""
    w = words(t)
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.round(F.size(F.filter(w, lambda x: F.length(x) == k)) / F.size(w), 6)))


def _spectra(df: DataFrame, key: str, items: Column, window: int | None) -> DataFrame:
    """(key, win, c): per window of `window` elements the counts of its distinct elements. No shuffle."""
    size = F.size(items)
    cut = F.array(items) if window is None else F.transform(F.sequence(F.lit(0), F.ceil(size / window).cast("int") - 1), lambda i: F.slice(items, i * window + 1, F.lit(window)))
    rows = df.where(size > 0).select(key, F.posexplode(cut).alias("win", "__w"))
    kept = rows.select(key, "win", F.explode(F.array(F.array_sort("__w"))).alias("__s"))
    s, st = F.col("__s"), F.col("__st")
    begun = kept.select(key, "win", "__s", F.explode(F.array(F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull()))).alias("__st"))
    ends = F.slice(F.concat(F.slice(st, 2, F.size(st)), F.array(F.size(s))), 1, F.size(st))
    return begun.select(key, "win", F.explode(F.array(F.zip_with(st, ends, lambda x, y: (y - x).cast("double")))).alias("c"))


def _sum(c: Column, f) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + f(x))


def richness(df: DataFrame, key: str, t: Column) -> DataFrame:
    """(key, n_tokens, n_types, hapax, dis, ttr, guiraud, herdan, yule, simpson) of each text's words,
    counted within the row."""
    spectra = _spectra(df, key, words(t), None)
    count = lambda k: F.size(F.filter("c", _equals(k))).cast("long")
    s = spectra.select(key, _sum(F.col("c"), lambda x: x).alias("n"), F.size("c").cast("double").alias("v"), count(1).alias("hapax"), count(2).alias("dis"), _sum(F.col("c"), lambda x: x * x).alias("s2"), _sum(F.col("c"), lambda x: x * (x - 1)).alias("s1"))
    n, v = F.col("n"), F.col("v")
    return s.select(
        key, n.cast("long").alias("n_tokens"), v.cast("long").alias("n_types"), "hapax", "dis", F.round(v / n, 6).alias("ttr"), F.round(v / F.sqrt(n), 6).alias("guiraud"),
        F.round(F.when(n > 1, F.log(v) / F.log(n)), 6).alias("herdan"), F.round(1e4 * (F.col("s2") - n) / (n * n), 6).alias("yule"),
        F.round(F.when(n > 1, F.col("s1") / (n * (n - 1))), 6).alias("simpson"),
    )


#: The names of the indices, in their order.
RICHNESS = ("type_token_ratio", "guiraud_r", "herdan_c", "dugast_k", "maas_a2", "dugast_u", "tuldava_ln", "brunet_w", "cttr", "summer_s", "sichel_s", "michea_m", "honore_h", "herdan_vm", "entropy", "yule_k", "simpson_d")


def richness_indices(df: DataFrame, key: str, items: Column, window: int = 1000) -> DataFrame:
    """(key, the 17 indices of RICHNESS): each computed per window of `window` tokens and averaged over
    a record's windows; an index that isn't defined for a window counts as 0. Records without tokens
    have no row. N tokens, V types, f1 and f2 types occurring once and twice, p = count / N."""
    s = _spectra(df, key, items, window).select(
        key, _sum(F.col("c"), lambda x: x).alias("n"), F.size("c").cast("double").alias("v"), F.size(F.filter("c", lambda x: x == 1)).cast("double").alias("f1"), F.size(F.filter("c", lambda x: x == 2)).cast("double").alias("f2"),
        _sum(F.col("c"), lambda x: x * x).alias("s2"), _sum(F.col("c"), lambda x: x * (x - 1)).alias("s1"), _sum(F.col("c"), lambda x: x * F.log(x)).alias("sl"),
    )
    n, v, f1, f2 = (F.col(c) for c in ("n", "v", "f1", "f2"))
    ln, lv = F.log(n), F.log(v)
    lln = F.when(ln > 0, F.log(ln))
    llv = F.when(lv > 0, F.log(lv))
    p2 = F.col("s2") / (n * n)
    of = F.try_divide
    values = {
        "type_token_ratio": of(v, n), "guiraud_r": of(v, F.sqrt(n)), "herdan_c": of(lv, ln), "dugast_k": of(lv, lln), "maas_a2": of(ln - lv, ln * ln), "dugast_u": of(ln * ln, ln - lv),
        "tuldava_ln": of(1 - v * v, v * v * ln), "brunet_w": F.pow(n, F.pow(v, F.lit(-0.172))), "cttr": of(v, F.sqrt(2 * n)), "summer_s": of(llv, lln), "sichel_s": of(f2, v), "michea_m": of(v, f2),
        "honore_h": of(100 * ln, 1 - of(f1, v)), "herdan_vm": F.when(p2 >= 1 / v, F.sqrt(p2 - 1 / v)), "entropy": ln - F.col("sl") / n, "yule_k": 1e4 * (p2 - 1 / n), "simpson_d": of(F.col("s1"), n * (n - 1)),
    }
    zero = lambda c: F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)
    return s.groupBy(key).agg(*[F.round(F.avg(zero(values[k])), 9).alias(k) for k in RICHNESS])


def legomena_ratio(df: DataFrame, key: str, items: Column) -> DataFrame:
    """(key, ratio): types that occur once over types that occur twice, 0 where none does."""
    c = _spectra(df, key, items, None)
    once, twice = (F.size(F.filter("c", _equals(k))) for k in (1, 2))
    return c.select(key, F.round(F.when(twice > 0, once / twice).otherwise(0.0), 6).alias("ratio"))


def vocabulary(counts: DataFrame, term: str, n: str, most: int, reserved: int = 5) -> DataFrame:
    """(term, id): the `most` most frequent terms, numbered after the reserved ids; ties by term."""
    top = counts.orderBy(F.desc(n), term).limit(most)  # at most `most` rows: one task may number them
    return top.select(term, (F.row_number().over(Window.orderBy(F.desc(n), F.col(term))) + reserved - 1).cast("long").alias("id"))
