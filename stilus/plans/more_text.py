"""Queries over the wider text functions and features, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stilus.functions import features as f
from stilus.functions import normalise as nz
from stilus.functions import text as t
from stilus.operators import pairs as p
from stilus.session import spread, table

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _texts(s, d):
    return spread(table(s, d, "aa_texts").where("text IS NOT NULL").select("row_id", "text"))


def _entries(s, d):
    """One entry per id: repeated rows are equal."""
    e = table(s, d, "ling_entries").where("tokens IS NOT NULL AND pos_tags IS NOT NULL")
    return e.groupBy("entry_id").agg(F.min("tokens").alias("tokens"), F.min("pos_tags").alias("pos_tags"))


_T = "FROM aa_texts WHERE text IS NOT NULL"
_E = "(SELECT entry_id, min(tokens) AS tokens, min(pos_tags) AS pos_tags FROM ling_entries WHERE tokens IS NOT NULL AND pos_tags IS NOT NULL GROUP BY entry_id)"
_BASE = r"regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '0', 'g'), '( \n| \t)+', '', 'g'), 'https:\\+([a-zA-Z0-9.]+)?', '@', 'g')"
_WORDS = "list_filter(regexp_split_to_array({x}, '[ \\t\\r\\n\\f]+'), lambda w: w <> '')"


@query(rf"SELECT row_id, md5(regexp_replace({_BASE}, '[^\p{{L}}\p{{N}}\s\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g')) AS h {_T}")
def norm_words(s, d):
    return _texts(s, d).select("row_id", F.md5(t.only_words(F.col("text"))).alias("h"))


@query(f"SELECT row_id, md5(translate(text, chr(9) || chr(10), '  ')) AS h {_T}")
def norm_tabs(s, d):
    return _texts(s, d).select("row_id", F.md5(nz.tabs_and_breaks_to_spaces(F.col("text"))).alias("h"))


@query("SELECT row_id, md5(translate(text, '" + "".join(nz._QUOTES).replace("'", "''") + "', '" + "".join(nz._QUOTES.values()).replace("'", "''") + f"')) AS h {_T}")
def norm_quotes(s, d):
    return _texts(s, d).select("row_id", F.md5(nz.plain_quotes(F.col("text"))).alias("h"))


@query()
def norm_accents(s, d):
    return _texts(s, d).select("row_id", F.md5(nz.without_accents(nz.composed(F.col("text")))).alias("h"))


@query()
def norm_tweets(s, d):
    return _texts(s, d).select("row_id", nz.normal_tweet(F.col("text")).alias("tweet"))


@query()
def tweet_entries(s, d):
    return nz.tweet_entries(_texts(s, d), "row_id", "text")


@query()
def html_texts(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", nz.from_html(F.col("text")).alias("text"))


@query()
def sentence_counts(s, d):
    docs = table(s, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", *[F.size(nz.tokenize(F.col("text"), k)).alias(f"n_{k}") for k in sorted(nz.TOKENIZERS)], F.size(nz.sentence_split(F.col("text"))).alias("n_sentences"))


_LINES = "list_transform(list_filter(string_split_regex(text, '\\n+'), lambda x: x <> ''), lambda x: " + _WORDS.format(x="x") + ")"


@query(f"""WITH s AS (SELECT row_id, unnest({_LINES}) AS w, generate_subscripts({_LINES}, 1) AS line {_T}),
p AS (SELECT row_id, line, w, unnest(range(0, greatest(1, CAST(ceil(len(w) / 18.0) AS BIGINT)))) AS i, greatest(1, CAST(ceil(len(w) / 18.0) AS BIGINT)) AS n FROM s)
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY line, i) - 1 AS INTEGER) AS no, md5(CASE WHEN i = 0 THEN '<SOS>' ELSE '<SLB>' END || ' ' || CASE WHEN len(w) > 0 THEN array_to_string(w[i * 18 + 1 : i * 18 + 18], ' ') || ' ' ELSE '' END || CASE WHEN i = n - 1 THEN '<EOS>' ELSE '<ELB>' END) AS h FROM p""")
def sentence_reflow(s, d):
    lines = F.filter(F.split("text", r"\n+"), lambda x: x != "")
    return _texts(s, d).select("row_id", F.posexplode(nz.reflow(lines, 20)).alias("no", "line")).select("row_id", "no", F.md5("line").alias("h"))


_WB = f"(SELECT row_id, unnest(list_transform(range(0, greatest(length(w) - 3, 0) + 1), lambda i: substr(w, CAST(i + 1 AS BIGINT), 3))) AS gram FROM (SELECT row_id, ' ' || unnest({_WORDS.format(x='text')}) || ' ' AS w {_T}))"


@query(f"SELECT md5(gram) AS gram_md5, count(*) AS n, count(DISTINCT row_id) AS n_docs FROM {_WB} GROUP BY gram")
def inner_ngram_counts(s, d):
    return t.ngram_counts(_texts(s, d), t.inner_ngrams(F.col("text"), 3, 3), "row_id").select(F.md5("gram").alias("gram_md5"), "n", "n_docs")


_C12 = f"(SELECT row_id, unnest(list_concat(list_transform(range(1, length(text) + 1), lambda i: substr(text, CAST(i AS BIGINT), 1)), list_transform(range(1, greatest(length(text), 1)), lambda i: substr(text, CAST(i AS BIGINT), 2)))) AS gram {_T})"


@query(f"""WITH c AS (SELECT gram, count(*) AS n, count(DISTINCT row_id) AS n_docs FROM {_C12} GROUP BY gram HAVING count(DISTINCT row_id) >= 0.1 * (SELECT count(*) {_T}) ORDER BY n DESC, gram LIMIT 1000)
SELECT md5(gram) AS gram_md5, n, n_docs, CAST(row_number() OVER (ORDER BY gram) - 1 AS INTEGER) AS id FROM c""")
def char_vocabulary(s, d):
    rows = _texts(s, d)
    grams = t.ngrams_between(F.filter(F.split("text", ""), lambda c: c != ""), 1, 2, "")
    return t.frequent(t.ngram_counts(rows, grams, "row_id"), rows.count(), 0.1, 1000).select(F.md5("gram").alias("gram_md5"), "n", "n_docs", "id")


@query(rf"SELECT gram, count(*) AS n, count(DISTINCT row_id) AS n_docs FROM (SELECT row_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200C}}\x{{200D}}]{{2,}}')) AS gram {_T}) GROUP BY gram")
def word_token_counts(s, d):
    return t.ngram_counts(_texts(s, d), t.word_tokens(F.col("text")), "row_id")


_TOK = f"(SELECT entry_id, unnest(tokens) AS gram FROM {_E})"
_TF = f"WITH tf AS (SELECT entry_id, gram, count(*) AS tf FROM {_TOK} WHERE gram IS NOT NULL GROUP BY entry_id, gram), n AS (SELECT count(*) AS n FROM {_E})"


@query(f"""{_TF}, df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 0.1 * (SELECT n FROM n)),
w AS (SELECT entry_id, gram, tf * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram))
SELECT entry_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY entry_id)), 6) AS weight FROM w""")
def tfidf_tokens(s, d):
    return t.tfidf(_entries(s, d), "entry_id", F.col("tokens"), min_docs=1, sublinear=False, min_share=0.1)


@query(f"""{_TF}, df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram)
SELECT entry_id, gram, round(tf * (ln((1.0 + (SELECT n FROM n)) / (1 + df)) + 1) / (1 + len(tokens)), 9) AS weight FROM tf JOIN df USING (gram) JOIN {_E} USING (entry_id)""")
def frequency_over_length(s, d):
    return t.share_of_length(_entries(s, d), "entry_id", F.col("tokens"))


_KEEP = ["the", "a", "and", "of", "to", "in", "he", "she", "it", "was", "but", "that"]
_M = f"(SELECT entry_id, list_filter(list_transform(range(1, greatest(len(tokens), len(pos_tags)) + 1), lambda i: CASE WHEN list_contains({_KEEP!r}, tokens[i]) THEN tokens[i] ELSE pos_tags[i] END), lambda x: x IS NOT NULL) AS m FROM {_E})"


@query(f"SELECT gram, count(*) AS n, count(DISTINCT entry_id) AS n_docs FROM (SELECT entry_id, unnest(list_concat(m, list_transform(range(1, greatest(len(m), 1)), lambda i: m[i] || ' ' || m[i + 1]), list_transform(range(1, greatest(len(m) - 1, 1)), lambda i: m[i] || ' ' || m[i + 1] || ' ' || m[i + 2]))) AS gram FROM {_M}) GROUP BY gram")
def masked_ngram_counts(s, d):
    return t.ngram_counts(_entries(s, d), f.masked_ngrams(F.col("tokens"), F.col("pos_tags"), _KEEP, 3), "entry_id")


_LEX = [("british", "grey"), ("british", "colour"), ("british", "neighbour"), ("british", "harbour"), ("british", "theatre"), ("typos", "teh"), ("typos", "recieve"), ("determiner", "an"), ("determiner", "the")]


@query(f"WITH l(lexicon, word) AS (VALUES {', '.join(map(str, _LEX))}), x AS (SELECT lexicon, list(word) AS ws FROM l GROUP BY lexicon) SELECT entry_id, lexicon, round(len(list_filter(tokens, lambda w: list_contains(ws, w))) / len(tokens), 6) AS rate FROM {_E} CROSS JOIN x WHERE len(tokens) > 0")
def misspelling_rates(s, d):
    return f.lexicon_rates(_entries(s, d), "entry_id", "tokens", s.createDataFrame(_LEX, "lexicon string, word string"))


@query(f"SELECT entry_id, len(tokens) AS n, round(list_sum(list_transform(tokens, lambda w: coalesce(length(w), 0))) / nullif(len(tokens), 0)::DOUBLE, 6) AS chars FROM {_E}")
def token_stats(s, d):
    n, chars = f.word_stats(F.col("tokens"))
    return _entries(s, d).select("entry_id", n.cast("long").alias("n"), F.round(chars, 6).alias("chars"))


_FREQ = f"(SELECT entry_id, gram, count(*) AS c FROM {_TOK} GROUP BY entry_id, gram)"


@query(f"SELECT entry_id, round(CASE WHEN count(*) FILTER (c = 2) > 0 THEN count(*) FILTER (c = 1) / count(*) FILTER (c = 2)::DOUBLE ELSE 0 END, 6) AS ratio FROM (SELECT entry_id, gram, count(*) AS c FROM (SELECT entry_id, unnest(list_filter(tokens, lambda w: w IS NOT NULL)) AS gram FROM {_E}) GROUP BY entry_id, gram) GROUP BY entry_id")
def legomena_ratio(s, d):
    own = _entries(s, d).withColumn("tokens", F.filter("tokens", lambda w: w.isNotNull()))
    return t.legomena_ratio(own, "entry_id", F.col("tokens"))


_RICH = """WITH e AS (SELECT row_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT row_id, {words} AS w {t})), c AS (SELECT row_id, CAST(floor((i - 1) / 50) AS BIGINT) AS win, w[i] AS g, count(*)::DOUBLE AS c FROM e GROUP BY 1, 2, 3),
s AS (SELECT row_id, win, sum(c) AS n, count(*)::DOUBLE AS v, count(*) FILTER (c = 1)::DOUBLE AS f1, count(*) FILTER (c = 2)::DOUBLE AS f2, sum(c * c) AS s2, sum(c * (c - 1)) AS s1, sum(c * ln(c)) AS sl FROM c GROUP BY 1, 2),
l AS (SELECT *, ln(n) AS ln_, ln(v) AS lv, CASE WHEN n > 1 THEN ln(ln(n)) END AS lln, CASE WHEN v > 1 THEN ln(ln(v)) END AS llv, s2 / (n * n) AS p2 FROM s)
SELECT row_id, {figures} FROM l GROUP BY row_id"""
_FIGURES = {
    "type_token_ratio": "v / n", "guiraud_r": "v / sqrt(n)", "herdan_c": "lv / nullif(ln_, 0)", "dugast_k": "lv / nullif(lln, 0)", "maas_a2": "(ln_ - lv) / nullif(ln_ * ln_, 0)", "dugast_u": "ln_ * ln_ / nullif(ln_ - lv, 0)",
    "tuldava_ln": "(1 - v * v) / nullif(v * v * ln_, 0)", "brunet_w": "pow(n, pow(v, -0.172))", "cttr": "v / sqrt(2 * n)", "summer_s": "llv / nullif(lln, 0)", "sichel_s": "f2 / v", "michea_m": "v / nullif(f2, 0)",
    "honore_h": "100 * ln_ / nullif(1 - f1 / v, 0)", "herdan_vm": "CASE WHEN p2 >= 1 / v THEN sqrt(p2 - 1 / v) END", "entropy": "ln_ - sl / n", "yule_k": "10000 * (p2 - 1 / n)", "simpson_d": "s1 / nullif(n * (n - 1), 0)",
}


@query(_RICH.format(words=_WORDS.format(x="text"), t=_T, figures=", ".join(f"round(avg(coalesce({v}, 0)), 9) AS {k}" for k, v in _FIGURES.items())))
def richness_indices(s, d):
    """Windows of 50 tokens, so that texts of the tables have several."""
    return t.richness_indices(_texts(s, d), "row_id", t.words(F.col("text")), window=50)


_Z = f"(SELECT entry_id, unnest(list_transform(range(1, greatest(len(tokens), len(pos_tags)) + 1), lambda i: {{'w': tokens[i], 't': pos_tags[i]}})) AS z FROM {_E})"
_TAGS = ", ".join(f"('{x}')" for x in f.POS_TAGS)


@query(f"""WITH tags(tag) AS (VALUES {_TAGS}), c AS (SELECT entry_id, z.t AS tag, count(DISTINCT z.w) AS d, avg(length(z.w)) AS m FROM {_Z} WHERE z.w IS NOT NULL GROUP BY 1, 2),
x AS (SELECT entry_id, tag, coalesce(d, 0) AS d, coalesce(m, 0) AS m FROM {_E} CROSS JOIN tags LEFT JOIN c USING (entry_id, tag))
SELECT entry_id, tag, round(coalesce(d / nullif(sum(d) OVER (PARTITION BY entry_id), 0), 0), 6) AS fraction, round(m, 6) AS mean_length FROM x""")
def pos_tag_stats(s, d):
    return f.tag_stats(_entries(s, d), "entry_id", "tokens", "pos_tags")


_IDS = f"(SELECT gram AS term, row_number() OVER (ORDER BY n DESC, gram) + 5 AS id FROM (SELECT gram, count(*) AS n FROM {_TOK} WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) >= 10 ORDER BY n DESC, gram LIMIT 5000))"


def _id_table(s, d):
    counts = t.array_counts(_entries(s, d), [], F.col("tokens")).groupBy("term").agg(F.sum("n").alias("n"))
    return f.id_table(counts, "term", "n", 10, 5000)


@query(f"SELECT term, id FROM {_IDS} UNION ALL SELECT * FROM (VALUES {', '.join(f'({t_!r}, {i})' for i, t_ in enumerate(f.RESERVED))}) x(term, id)")
def vocab_reserved(s, d):
    return _id_table(s, d)


@query(f"SELECT gram AS term, row_number() OVER (ORDER BY n DESC, gram) + 1 AS id FROM (SELECT gram, count(*) AS n FROM {_TOK} WHERE gram IS NOT NULL GROUP BY gram HAVING count(*) >= 100 ORDER BY n DESC, gram LIMIT 125) UNION ALL SELECT * FROM (VALUES ('UNK', 0), ('PAD', 1)) x(term, id)")
def vocab_id_map(s, d):
    counts = t.array_counts(_entries(s, d), [], F.col("tokens")).groupBy("term").agg(F.sum("n").alias("n"))
    return f.id_table(counts, "term", "n", 100, 125, ("UNK", "PAD"))


@query(f"""WITH i AS (SELECT entry_id, pos, coalesce(id, 1) AS id FROM (SELECT entry_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM {_E}) LEFT JOIN {_IDS} USING (term)),
l AS (SELECT entry_id, list(id ORDER BY pos) AS ids FROM i GROUP BY entry_id)
SELECT entry_id, list_concat(coalesce(ids, []::BIGINT[])[1:32], list_transform(range(0, greatest(0, 32 - len(coalesce(ids, []::BIGINT[])))), lambda k: 0::BIGINT)) AS ids, list_transform(range(0, 32), lambda k: CASE WHEN k < len(tokens) THEN 0 ELSE -5000 END) AS mask FROM {_E} LEFT JOIN l USING (entry_id)""")
def token_ids(s, d):
    e = _entries(s, d)
    rows = f.to_ids(e, "entry_id", "tokens", _id_table(s, d).where("id >= 6"))
    sized = rows.join(e.select("entry_id", F.size("tokens").alias("size")), "entry_id")
    return sized.select("entry_id", f.padded_ids(F.col("ids"), 32).alias("ids"), f.additive_mask(F.col("size"), 32).alias("mask"))


@query(f"SELECT entry_id, CAST(list_sum(list_transform(tokens, lambda w: coalesce(length(w), 0))) AS BIGINT) AS n_chars, len(tokens) AS n_tokens FROM {_E} WHERE len(tokens) > 0")
def nested_chars(s, d):
    c = F.aggregate(f.nested_chars(F.col("tokens")), F.lit(0), lambda a, x: a + F.greatest(F.coalesce(F.size(x), F.lit(0)), F.lit(0)))
    return _entries(s, d).where(F.size("tokens") > 0).select("entry_id", c.cast("long").alias("n_chars"), F.size("tokens").cast("long").alias("n_tokens"))


@query(f"SELECT entry_id, CAST(unnest(range(0, CAST(ceil(len(tokens) / 10.0) AS BIGINT))) AS INTEGER) AS no, CAST(least(10, len(tokens) - 10 * unnest(range(0, CAST(ceil(len(tokens) / 10.0) AS BIGINT)))) AS INTEGER) AS size FROM {_E}")
def token_list_chunks(s, d):
    return _entries(s, d).select("entry_id", F.posexplode(p.list_chunks(F.col("tokens"), 10)).alias("no", "c")).select("entry_id", "no", F.size("c").alias("size"))


@query()
def lsa_factors(s, d):
    """The 20 strongest factors of the entries' token weights."""
    e = _entries(s, d)
    ids = t.frequent(t.ngram_counts(e, F.col("tokens"), "entry_id"), e.count(), 0.1, 200)
    w = t.tfidf(e, "entry_id", F.col("tokens"), min_docs=1, min_share=0.1)
    return f.lsa(f.dense_vectors(w, "entry_id", ids, ids.count()), "entry_id", "features", 20)
