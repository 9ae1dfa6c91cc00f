"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from stilus.llm import abuse, canonical, chunking, frequency, language, leakage, mixing, overlap, pii
from stilus.session import table


_FITTED: dict = {}


def _fitted(spark, folder, name, fit):
    """A model of a folder's tables, fitted once in a session while the folder's files are the same."""
    files = tuple(sorted(table(spark, folder, "documents").inputFiles()))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _FITTED:
        _FITTED[key] = fit()
    return _FITTED[key]


def _p1(spark, folder):
    return overlap.cross_split_classes(table(spark, folder, "aa_texts"), "row_id", "text", F.col("split") == "train")


def p1_found(spark, folder):
    return overlap.linked_ids(*_p1(spark, folder), "row_id_a", "row_id_b")


def p1_report(spark, folder):
    """Per split and source: rows, rows that recur in the train split, and their pairs with train rows.
    Pairs are counted from the sizes of the classes; none is expanded."""
    members, links = _p1(spark, folder)
    train = members.where("is_left").groupBy(F.col("class").alias("left")).agg(F.count("*").alias("n"))
    pairs = links.join(train, "left").groupBy(F.col("right").alias("class")).agg(F.sum("n").alias("pairs"))
    hit = members.where("NOT is_left").join(pairs, "class").groupBy(F.col("id").alias("row_id")).agg(F.sum("pairs").alias("pairs"))
    rows = table(spark, folder, "aa_texts").where("split IS NULL OR split <> 'train'").select("row_id", "split", "source").join(hit, "row_id", "left")
    return rows.groupBy("split", "source").agg(F.count("*").alias("n_rows"), F.count("pairs").alias("n_in_train"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))


def p3_found(spark, folder):
    return canonical.same_look_pairs(table(spark, folder, "blog_posts"), "post_id", "text", "post_id_a", "post_id_b")


def p3_canonical(spark, folder):
    return canonical.canonicalize(table(spark, folder, "blog_posts").select("post_id", "text").distinct(), "post_id", "text")


def p4_pieces(spark, folder):
    return chunking.split_long_texts(table(spark, folder, "blog_posts"), "post_id", "text")


def p4_found(spark, folder):
    return p4_pieces(spark, folder).where("n_pieces > 1").select("post_id").distinct()


def _p5(spark, folder, run):
    posts = run(table(spark, folder, "blog_posts"), "post_id", "text", "text")
    return posts.unionByName(run(table(spark, folder, "ling_entries"), "entry_id", "preprocessed", "preprocessed"))


def p5_found(spark, folder):
    return _p5(spark, folder, pii.kinds_found)


def p5_redacted(spark, folder):
    return _p5(spark, folder, pii.redact_table)


def p7_terms(spark, folder):
    tokens = frequency.term_frequencies(table(spark, folder, "ling_entries"), "entry_id", "tokens")
    return tokens.unionByName(frequency.term_frequencies(table(spark, folder, "bert_inputs"), "enc_id", "input_ids"))


def p7_found(spark, folder):
    return p7_terms(spark, folder).where("mark IS NOT NULL").select("field", "term", "mark")


def p8_leaks(spark, folder):
    return leakage.find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "benchmark"), "item_id", "text")


def p8_found(spark, folder):
    return p8_leaks(spark, folder).select("item_id", "doc_id")


def p8_items(spark, folder):
    """Every held-out item with the number of documents that hold it."""
    counts = p8_leaks(spark, folder).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return table(spark, folder, "benchmark").select("item_id").join(counts, "item_id", "left").fillna(0, ["n_documents"])


def p8_clean(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    return leakage.without_leaks(docs, "doc_id", p8_leaks(spark, folder))


def p10_segments(spark, folder):
    docs = table(spark, folder, "documents")
    net = _fitted(spark, folder, "language", lambda: language.train_on(docs, "doc_id", "text", "lang"))
    return language.label_documents(docs, "doc_id", "text", net)


def p10_found(spark, folder):
    docs = table(spark, folder, "documents")
    net = _fitted(spark, folder, "language", lambda: language.train_on(docs, "doc_id", "text", "lang"))
    return language.mislabelled(docs, "doc_id", "text", "lang", net)


def p6_scores(spark, folder):
    docs = table(spark, folder, "documents")
    return abuse.score_documents(docs, *_fitted(spark, folder, "abuse", lambda: abuse.fit(docs, table(spark, folder, "doc_labels"))))


def p6_found(spark, folder):
    return p6_scores(spark, folder).where("abusive").select("doc_id").distinct()


def p6_rates(spark, folder):
    """Per source: documents, abusive ones and their share."""
    by = p6_scores(spark, folder).groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("abusive").cast("int")).alias("n_abusive"))
    return by.withColumn("rate", F.col("n_abusive") / F.col("n_documents"))


def _p9(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text", "source")


def p9_mixture(spark, folder):
    return _p9(spark, folder)[0]


def p9_shares(spark, folder):
    return _p9(spark, folder)[1]


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p8_found, p8_leaks, p8_items, p8_clean, p10_found, p10_segments, p6_found, p6_scores, p6_rates, p9_mixture, p9_shares, p3_found, p3_canonical, p4_found, p4_pieces, p5_found, p5_redacted, p7_found, p7_terms)}

_TERMS = """WITH r AS (
  SELECT 'tokens' AS field, entry_id AS id, min(tokens) AS a FROM ling_entries WHERE tokens IS NOT NULL GROUP BY entry_id
  UNION ALL SELECT 'input_ids', enc_id, CAST(min(input_ids) AS VARCHAR[]) FROM bert_inputs WHERE input_ids IS NOT NULL GROUP BY enc_id),
n AS (SELECT field, count(*) AS total FROM r GROUP BY field),
e AS (SELECT field, id, unnest(a) AS term FROM r),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM e WHERE term IS NOT NULL AND term <> '' GROUP BY field, term),
m AS (SELECT field, term, occurrences, records, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.3 * total THEN 'common' END AS mark FROM c JOIN n USING (field))
"""

ORACLE = {
    "p4_found": "SELECT DISTINCT post_id FROM blog_posts WHERE length(text) > 2560",
    "p7_terms": _TERMS + "SELECT * FROM m",
    "p7_found": _TERMS + "SELECT field, term, mark FROM m WHERE mark IS NOT NULL",
}
