"""Queries over text functions, scorers and metrics, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from stilus.functions import text as t
from stilus.operators import evaluation as ev
from stilus.operators import scoring as m
from stilus.operators.corpus import uniform
from stilus.session import materialize, spread, table

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _texts(s, d):
    return spread(table(s, d, "aa_texts").where("text IS NOT NULL").select("row_id", "text"))


_T = "FROM aa_texts WHERE text IS NOT NULL"
_BASE = r"regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '0', 'g'), '( \n| \t)+', '', 'g'), 'https:\\+([a-zA-Z0-9.]+)?', '@', 'g')"
_WORDS = "list_filter(regexp_split_to_array({x}, '[ \\t\\r\\n\\f]+'), lambda w: w <> '')"


def _norm(name, column, sql):
    def f(s, d):
        return _texts(s, d).select("row_id", F.md5(column(F.col("text"))).alias("h"))

    f.__name__ = name
    query(f"SELECT row_id, md5({sql}) AS h {_T}")(f)


def _contractions():
    x = "text"
    for old, new in t.CONTRACTIONS:
        x = f"replace({x}, '{old.replace(chr(39), chr(39) * 2)}', '{new.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({x}, ' +', ' ', 'g'), ' ')"


_norm("norm_base", t.normal_base, _BASE)
_norm("norm_distort", t.distort, f"regexp_replace({_BASE}, '[a-zA-Z]+', '*', 'g')")
_norm("mask_tweet", t.mask_tweet, "regexp_replace(regexp_replace(text, 'http[^ \\t\\r\\n]+', '', 'g'), '@[^ \\t\\r\\n]+', '@USER', 'g')")
_norm("tweet_contractions", t.split_contractions, _contractions())


_norm("mask_urls", t.mask_urls, "regexp_replace(lower(text), '(www|http)[^ \\t\\r\\n]+', ' URL ', 'g')")


@query(f"SELECT row_id, length(regexp_replace(text, '[ \\t\\r\\n\\f]+', '', 'g')) AS n {_T}")
def nonspace_chars(s, d):
    return _texts(s, d).select("row_id", t.nonspace_chars(F.col("text")).cast("long").alias("n"))


@query(f"WITH g AS (SELECT row_id, unnest(list_transform(range(1, greatest(1, length(text) - 1)), lambda i: substr(text, CAST(i AS BIGINT), 3))) AS gram {_T} AND length(text) >= 3) SELECT md5(gram) AS gram_md5, count(*) AS n, count(DISTINCT row_id) AS n_docs FROM g GROUP BY gram")
def char_ngram_counts(s, d):
    return t.ngram_counts(_texts(s, d), t.char_ngrams(F.col("text"), 3), "row_id").select(F.md5("gram").alias("gram_md5"), "n", "n_docs")


_W2 = f"SELECT row_id, unnest(list_transform(range(1, greatest(1, len(w))), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM (SELECT row_id, {_WORDS.format(x='text')} AS w {_T})"


@query(f"SELECT gram, count(*) AS n, count(DISTINCT row_id) AS n_docs FROM ({_W2}) GROUP BY gram")
def word_ngram_counts(s, d):
    return t.ngram_counts(_texts(s, d), t.ngrams_of(t.words(F.col("text")), 2, " "), "row_id")


_TOK = f"SELECT row_id, unnest({_WORDS.format(x='text')}) AS gram {_T}"


@query(f"""WITH g AS ({_TOK}), tf AS (SELECT row_id, gram, count(*) AS tf FROM g GROUP BY row_id, gram), df AS (SELECT gram, count(*) AS df FROM tf GROUP BY gram HAVING count(*) >= 2),
w AS (SELECT row_id, gram, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) {_T})) / (1 + df)) + 1) AS w FROM tf JOIN df USING (gram))
SELECT row_id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM w""")
def tfidf_scores(s, d):
    return t.tfidf(_texts(s, d), "row_id", t.words(F.col("text")))


@query(f"SELECT gram, row_number() OVER (ORDER BY n DESC, gram) + 4 AS id FROM (SELECT gram, count(*) AS n FROM ({_TOK}) GROUP BY gram ORDER BY n DESC, gram LIMIT 5000)")
def vocab_ids(s, d):
    return t.vocabulary(t.ngram_counts(_texts(s, d), t.words(F.col("text")), "row_id"), "gram", "n", 5000)


@query(f"SELECT gram, count(*) AS n, count(DISTINCT row_id) AS n_docs FROM ({_TOK}) GROUP BY gram")
def token_counts(s, d):
    return t.ngram_counts(_texts(s, d), t.words(F.col("text")), "row_id")


@query(f"SELECT row_id, CASE WHEN len(w) > 0 THEN list_transform(range(1, 11), lambda k: round(len(list_filter(w, lambda x: length(x) = k)) / len(w), 6)) END AS shares FROM (SELECT row_id, {_WORDS.format(x='text')} AS w {_T})")
def word_len_distribution(s, d):
    return _texts(s, d).select("row_id", t.word_lengths(F.col("text")).alias("shares"))


@query(f"""WITH w AS (SELECT row_id, gram, count(*)::DOUBLE AS c FROM (SELECT row_id, unnest({_WORDS.format(x='text')}) AS gram {_T}) GROUP BY row_id, gram),
s AS (SELECT row_id, sum(c) AS n, count(*)::DOUBLE AS v, count(*) FILTER (c = 1) AS hapax, count(*) FILTER (c = 2) AS dis, sum(c * c) AS s2, sum(c * (c - 1)) AS s1 FROM w GROUP BY row_id)
SELECT row_id, CAST(n AS BIGINT) AS n_tokens, CAST(v AS BIGINT) AS n_types, hapax, dis, round(v / n, 6) AS ttr, round(v / sqrt(n), 6) AS guiraud, round(CASE WHEN n > 1 THEN ln(v) / ln(n) END, 6) AS herdan, round(10000 * (s2 - n) / (n * n), 6) AS yule, round(CASE WHEN n > 1 THEN s1 / (n * (n - 1)) END, 6) AS simpson FROM s""")
def vocab_richness(s, d):
    # letter case kept: the two engines fold letters beyond ASCII differently
    return t.richness(_texts(s, d), "row_id", F.col("text"))


_PPM = """WITH c AS (SELECT {keys}, unnest(range(1, length(text) + 1)) AS p, text FROM ({src}) WHERE length(text) > 0),
x AS (SELECT {keys}, CAST(p - 1 AS INTEGER) AS pos, unnest(range(0, least(p - 1, 3) + 1)) AS k, p, text FROM c)
SELECT {keys}, pos, CAST(k AS INTEGER) AS k, substr(text, CAST(p - k AS BIGINT), CAST(k AS BIGINT)) AS ctx, substr(text, CAST(p AS BIGINT), 1) AS ch FROM x"""


# ppm_counts and ppm_negate count contexts of at most 3 characters; those of order 5 are the whole models
_PPM_5 = _PPM.replace("least(p - 1, 3)", "least(p - 1, 5)")


def _ppm_model(s, d, order):
    return m.ppm_counts(spread(table(s, d, "aa_texts").where("text IS NOT NULL").select("source", "text")), "source", "text", order)


def _ppm_counts(s, d, order):
    return _ppm_model(s, d, order).select("source", "k", F.md5("ctx").alias("ctx_md5"), F.md5("ch").alias("ch_md5"), "n")


@query("SELECT source, k, md5(ctx) AS ctx_md5, md5(ch) AS ch_md5, count(*) AS n FROM (" + _PPM.format(keys="source", src="SELECT source, text FROM aa_texts WHERE text IS NOT NULL") + ") GROUP BY source, k, ctx, ch")
def ppm_counts(s, d):
    return _ppm_counts(s, d, 3)


@query("SELECT source, k, md5(ctx) AS ctx_md5, md5(ch) AS ch_md5, count(*) AS n FROM (" + _PPM_5.format(keys="source", src="SELECT source, text FROM aa_texts WHERE text IS NOT NULL") + ") GROUP BY source, k, ctx, ch")
def ppm_counts_order5(s, d):
    return _ppm_counts(s, d, 5)


def _ppm_negate(s, d, order):
    model, keys = materialize(_ppm_model(s, d, order), "model"), ["k", "ctx", "ch"]
    whole = model.groupBy(*keys).agg(F.sum("n").alias("n"))
    one = model.where("source = 'imdb62'").select(*keys, "n")
    return m.subtract_model(whole, one, keys).select("k", F.md5("ctx").alias("ctx_md5"), F.md5("ch").alias("ch_md5"), "n")


@query("SELECT k, md5(ctx) AS ctx_md5, md5(ch) AS ch_md5, count(*) AS n FROM (" + _PPM.format(keys="source", src="SELECT source, text FROM aa_texts WHERE text IS NOT NULL") + ") WHERE source <> 'imdb62' GROUP BY k, ctx, ch")
def ppm_negate(s, d):
    return _ppm_negate(s, d, 3)


@query("SELECT k, md5(ctx) AS ctx_md5, md5(ch) AS ch_md5, count(*) AS n FROM (" + _PPM_5.format(keys="source", src="SELECT source, text FROM aa_texts WHERE text IS NOT NULL") + ") WHERE source <> 'imdb62' GROUP BY k, ctx, ch")
def ppm_negate_order5(s, d):
    return _ppm_negate(s, d, 5)


@query("SELECT k, md5(ctx) AS ctx_md5, md5(ch) AS ch_md5, count(*) AS n FROM (" + _PPM.format(keys="source", src="SELECT source, text FROM aa_texts WHERE text IS NOT NULL AND source IN ('imdb62', 'blogs50')") + ") GROUP BY k, ctx, ch")
def ppm_merge(s, d):
    model, keys = _ppm_model(s, d, 3), ["k", "ctx", "ch"]
    a, b = (model.where(F.col("source") == x).select(*keys, "n") for x in ("imdb62", "blogs50"))
    return m.merge_models(a, b, keys).select("k", F.md5("ctx").alias("ctx_md5"), F.md5("ch").alias("ch_md5"), "n")


_D = "sqrt(list_sum(list_transform(range(1, 65), lambda i: (q.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - r.embedding[i]::DOUBLE))))"
_KNN = f"SELECT query, vec_id, distance, rank FROM (SELECT q.vec_id AS query, r.vec_id, round({_D}, 9) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_D}, 9), r.vec_id) AS rank FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) WHERE rank <= 5"


def _knn(s, d):
    rows = table(s, d, "embeddings").where("embedding IS NOT NULL")
    return m.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5)


@query(_KNN)
def knn_neighbours(s, d):
    return _knn(s, d)


@query(f"SELECT query, arg_max(label, n * 1000 - label) AS label FROM (SELECT query, label, count(*) AS n FROM ({_KNN}) JOIN embeddings USING (vec_id) GROUP BY query, label) GROUP BY query")
def knn_attribution(s, d):
    votes = _knn(s, d).join(table(s, d, "embeddings").select("vec_id", "label"), "vec_id").groupBy("query", "label").agg(F.count("*").alias("n"))
    return votes.groupBy("query").agg(F.max_by("label", F.struct("n", F.negate("label"))).alias("label"))


@query("SELECT label, list(round(x, 6) ORDER BY i) AS profile FROM (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label")
def author_profiles(s, d):
    return m.mean_vectors(table(s, d, "embeddings"), "label", "embedding")


_PAIR = "FROM embeddings q JOIN embeddings r ON r.vec_id = q.vec_id + 1"
_COS = "list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * r.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE))) * sqrt(list_sum(list_transform(range(1, 65), lambda i: r.embedding[i]::DOUBLE * r.embedding[i]::DOUBLE))))"


def _neighbours(s, d):
    e = table(s, d, "embeddings")
    r = e.select(F.col("vec_id").alias("next"), F.col("embedding").alias("other"), F.col("label").alias("label1"))
    return e.join(r, F.col("vec_id") + 1 == F.col("next"))


@query(f"SELECT q.vec_id, round({_D}, 6) AS euclid, round({_COS}, 6) AS cosine, round(exp(-0.09 * {_D} * {_D} * {_D}) + 1e-10, 9) AS kernel, round(CASE WHEN q.label = r.label THEN pow(greatest(0.5 - (exp(-0.09 * {_D} * {_D} * {_D}) + 1e-10), 0), 2) ELSE pow(greatest(exp(-0.09 * {_D} * {_D} * {_D}) + 1e-10 - 1.5, 0), 2) END, 6) AS loss {_PAIR}")
def kernel_similarity(s, d):
    dist = m.euclidean(F.col("embedding"), F.col("other"))
    p = _neighbours(s, d).withColumn("d", dist)
    same = (F.col("label") == F.col("label1")).cast("int")
    return p.select("vec_id", F.round("d", 6).alias("euclid"), F.round(m.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"), F.round(m.kernel(F.col("d")), 9).alias("kernel"), F.round(m.two_margin_loss(m.kernel(F.col("d")), same), 6).alias("loss"))


_L = "SELECT toxic AS truth, quality / 5.0::DOUBLE AS score FROM doc_labels WHERE toxic IS NOT NULL AND quality IS NOT NULL"


def _scored(s, d):
    return table(s, d, "doc_labels").where("toxic IS NOT NULL AND quality IS NOT NULL").select(F.col("toxic").alias("truth"), (F.col("quality") / 5.0).alias("score"))


@query(f"WITH t AS ({_L}), r AS (SELECT truth, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM t) SELECT round(coalesce((sum(CASE WHEN truth = 1 THEN r END) - sum(truth) * (sum(truth) + 1) / 2.0::DOUBLE) / nullif(sum(truth) * sum(1 - truth), 0)::DOUBLE, 0), 9) AS auc FROM r")
def metrics_auc(s, d):
    return ev.auc(_scored(s, d), "truth", "score")


@query(f"""WITH a AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (score = 0.5)::DOUBLE AS u, count(*) FILTER (score <> 0.5 AND (score > 0.5) = (truth = 1))::DOUBLE AS c, count(*) FILTER (score > 0.5 AND truth = 1)::DOUBLE AS tp, count(*) FILTER (score > 0.5 AND truth = 0)::DOUBLE AS fp, count(*) FILTER (score < 0.5 AND truth = 1)::DOUBLE AS fn, avg((score - truth) * (score - truth)) AS b FROM ({_L}))
SELECT CAST(n AS BIGINT) AS n, round((c + u * c / n) / n, 9) AS c_at_1, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round(coalesce(1.25 * tp / nullif(1.25 * tp + 0.25 * (fn + u) + fp, 0), 0), 9) AS f05u, round(1 - b, 9) AS brier FROM a""")
def metrics_av(s, d):
    return m.verification_metrics(_scored(s, d), "truth", "score")


_P = "SELECT labels AS truth, CAST((labels + (CAST('0x' || substr(md5('0:' || row_id), 1, 8) AS BIGINT) % 3)) AS INTEGER) AS pred FROM aa_texts WHERE labels IS NOT NULL"


@query(f"""WITH p AS ({_P}), c AS (SELECT truth AS c FROM p UNION SELECT pred FROM p), x AS (SELECT c, (SELECT count(*) FROM p WHERE truth = c) AS nt, (SELECT count(*) FROM p WHERE pred = c) AS np, (SELECT count(*) FROM p WHERE truth = c AND pred = c) AS hit FROM c)
SELECT round(sum(hit) / sum(nt), 9) AS accuracy, round(avg(hit / nt) FILTER (nt > 0), 9) AS macro_accuracy, round(avg(coalesce(hit / nullif(np, 0), 0)), 9) AS macro_precision, round(avg(coalesce(hit / nullif(nt, 0), 0)), 9) AS macro_recall, round(avg(2 * hit / (nt + np)), 9) AS macro_f1 FROM x""")
def metrics_aa(s, d):
    p = table(s, d, "aa_texts").where("labels IS NOT NULL").select(F.col("labels").alias("truth"), (F.col("labels") + uniform(0, "row_id") % 3).cast("int").alias("pred"))
    return m.class_metrics(p, "truth", "pred")


@query(f"WITH t AS ({_L}), b AS (SELECT min(score) AS lo, max(score) AS hi, count(*) AS n FROM t), g AS (SELECT lo + (hi - lo) * i / 99 AS threshold, n FROM b, range(100) r(i)) SELECT round(threshold, 9) AS threshold, round((SELECT count(*) FROM t WHERE (score >= threshold - 1e-9) = (truth = 1)) / n, 9) AS accuracy FROM g")
def threshold_search(s, d):
    return m.threshold_search(_scored(s, d), "truth", "score")


@query("WITH g AS (SELECT DISTINCT doc_id, toxic AS truth FROM doc_labels WHERE toxic IS NOT NULL) SELECT g.doc_id, truth, coalesce(max(quality) / 5.0::DOUBLE, 0.5) AS value FROM g LEFT JOIN doc_labels a ON a.doc_id = g.doc_id AND quality IS NOT NULL GROUP BY g.doc_id, truth")
def pan_join_default(s, d):
    labels = table(s, d, "doc_labels")
    gold = labels.where("toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("truth")).distinct()
    answers = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.max("quality") / 5.0).alias("v"))
    return gold.join(answers, "doc_id", "left").select("doc_id", "truth", F.coalesce("v", F.lit(0.5)).alias("value"))


@query(f"WITH x AS (SELECT q.vec_id AS doc, r.label AS cand, min({_D}) AS s FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0 GROUP BY q.vec_id, r.label), e AS (SELECT doc, cand, round(s - avg(s) OVER (PARTITION BY cand), 9) AS err FROM x) SELECT doc, cand, err, CAST(row_number() OVER (PARTITION BY doc ORDER BY err, cand) AS INTEGER) AS rank FROM e")
def score_matrix_normalise(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v"))
    x = m.against_blocks(q, e).where(F.col("doc") != F.col("vec_id")).groupBy("doc", F.col("label").alias("cand")).agg(F.min(m.euclidean(F.col("v"), F.col("embedding"))).alias("s"))
    return m.normalise_scores(x, "doc", "cand", "s")
