"""Queries over the corpus operators, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from stilus.operators import corpus as c
from stilus.session import table


def _aa(spark, folder):
    return c.canonical(table(spark, folder, "aa_texts"), "labels", "row_id", "text")


AA = "SELECT labels AS author, row_id AS seq, coalesce(text, '') AS text FROM aa_texts WHERE labels IS NOT NULL"
DEDUP = f"SELECT author, text, min(seq) AS seq FROM ({AA}) GROUP BY author, text"
_H = "md5('{s}:' || seq)"
_RANK = "SELECT author, seq, row_number() OVER (PARTITION BY author ORDER BY md5('0:' || seq), seq) AS rank, count(*) OVER (PARTITION BY author) AS n FROM"
_UNI = "CAST('0x' || substr(md5('{s}:' || {c}), 1, 8) AS BIGINT)"
_LABELS = f"SELECT author, row_number() OVER (ORDER BY f, author) - 1 AS new_id FROM (SELECT author, min(seq) AS f FROM ({AA}) GROUP BY author)"
QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"SELECT author, seq, md5(text) AS h FROM ({AA})")
def aa_canonical(s, d):
    return _aa(s, d).select("author", "seq", F.md5("text").alias("h"))


@query(f"SELECT min(seq) AS seq FROM ({AA}) GROUP BY text")
def aa_dedup_global(s, d):
    return c.dedup_global(_aa(s, d)).select("seq")


@query(f"SELECT author, seq FROM ({DEDUP})")
def aa_dedup_per_author(s, d):
    return c.dedup_per_author(_aa(s, d)).select("author", "seq")


@query(f"SELECT CAST(sum(n) AS BIGINT) AS n_texts, count(*) AS n_distinct, count(*) FILTER (n > 1) AS n_repeated, CAST(sum(n - 1) AS BIGINT) AS n_surplus FROM (SELECT count(*) AS n FROM ({AA}) GROUP BY text)")
def dup_census(s, d):
    return c.duplicate_census(_aa(s, d))


@query(f"SELECT md5(text) AS text_md5, count(*) AS n_rows, count(DISTINCT author) AS n_authors FROM ({AA}) GROUP BY text HAVING count(DISTINCT author) > 1")
def shared_text_authors(s, d):
    return c.shared_texts(_aa(s, d))


@query(f"WITH a AS ({AA}), k AS (SELECT arg_min(author, seq) AS author FROM a GROUP BY text) SELECT author, count(*) AS n_before, (SELECT count(*) FROM k WHERE k.author = a.author) AS n_after FROM a GROUP BY author")
def dedup_impact(s, d):
    return c.dedup_impact(_aa(s, d))


@query(_LABELS)
def relabel_first_seen(s, d):
    return c.relabel_first_seen(_aa(s, d))


@query(f"SELECT new_id AS author, seq FROM ({AA}) JOIN ({_LABELS}) USING (author)")
def relabel_apply_map(s, d):
    aa = _aa(s, d)
    return c.apply_labels(aa, c.relabel_first_seen(aa)).select("author", "seq")


@query(f"SELECT author, seq FROM ({AA}) WHERE length(trim(text)) >= 100")
def clean_min_chars(s, d):
    return c.min_chars(_aa(s, d)).select("author", "seq")


@query(f"SELECT author, seq FROM ({AA}) WHERE len(string_split(trim(text), ' ')) >= 101")
def clean_min_words(s, d):
    return c.min_words(_aa(s, d)).select("author", "seq")


@query(f"SELECT author, seq FROM ({AA}) WHERE author IN (SELECT author FROM ({AA}) GROUP BY author HAVING count(*) BETWEEN 5 AND 100)")
def author_count_between(s, d):
    return c.authors_with(_aa(s, d), 5, 100).select("author", "seq")


@query(f"SELECT author, seq FROM ({AA}) WHERE author IN (SELECT author FROM ({AA}) GROUP BY author HAVING count(DISTINCT text) >= 2)")
def author_min_unique(s, d):
    return c.authors_with(_aa(s, d), 2, distinct=True).select("author", "seq")


@query(f"SELECT author, seq FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY seq) AS no FROM ({AA})) WHERE no <= 10")
def lim_texts(s, d):
    return c.first_texts(_aa(s, d), 10).select("author", "seq")


@query(f"SELECT author, seq FROM ({AA}) WHERE seq <= (SELECT max(f) FROM (SELECT min(seq) AS f FROM ({AA}) GROUP BY author ORDER BY f LIMIT 100))")
def first_n_authors(s, d):
    return c.first_authors(_aa(s, d), 100).select("author", "seq")


@query(f"SELECT author, seq FROM ({AA}) WHERE author < 50")
def lim_authors(s, d):
    return _aa(s, d).where("author < 50").select("author", "seq")


@query(f"SELECT author, seq FROM ({AA}) WHERE author >= 50")
def lim_authors_inv(s, d):
    return _aa(s, d).where("author >= 50").select("author", "seq")


@query(f"SELECT author, seq, length(substr(text, 1, 100000)) AS n_chars, md5(substr(text, 1, 100000)) AS h FROM ({AA})")
def shrink_texts(s, d):
    t = F.substring("text", 1, 100000)
    return _aa(s, d).select("author", "seq", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("h"))


@query(f"SELECT author, n_texts FROM (SELECT author, count(*) AS n_texts, min(seq) AS f FROM ({AA}) GROUP BY author) ORDER BY n_texts DESC, f, author LIMIT 50")
def top_authors(s, d):
    return c.top_authors(_aa(s, d))


@query("SELECT row_id, CASE WHEN split = 'train' THEN 'iid_train' WHEN split IN ('AA_val', 'AA_test') THEN 'iid_eval' WHEN split = 'cross_topic_test' THEN 'cross_topic' END AS part FROM aa_texts")
def category_route(s, d):
    rules = {"iid_train": ["train"], "iid_eval": ["AA_val", "AA_test"], "cross_topic": ["cross_topic_test"]}
    return table(s, d, "aa_texts").select("row_id", c.route(None, "split", rules).alias("part"))


@query(f"SELECT author, seq, CASE WHEN (rank - 1) * 10 < n * 6 THEN 'train' WHEN (rank - 1) * 10 < n * 8 THEN 'val' ELSE 'test' END AS part FROM ({_RANK} ({DEDUP}))")
def split_stratified(s, d):
    aa = c.dedup_per_author(_aa(s, d))
    return c.stratified_split(aa).select("author", "seq", F.coalesce("part", F.lit("test")).alias("part"))


@query(f"SELECT author, seq, CASE WHEN no <= 60 THEN 'train' WHEN no <= 80 THEN 'val' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY seq) AS no FROM ({AA}))")
def split_positional(s, d):
    return c.positional_split(_aa(s, d), (("train", 60), ("val", 80)))


@query(f"SELECT author, seq, CASE WHEN no <= 600 THEN 'train' WHEN no <= 800 THEN 'val' ELSE 'test' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY seq) AS no FROM ({AA}))")
def split_positional_600_800(s, d):
    return c.positional_split(_aa(s, d))


@query(f"SELECT author, seq, CASE WHEN n < 2 OR (rank - 1) * 10 < n * 8 THEN 'train' ELSE 'val' END AS part FROM ({_RANK} ({DEDUP}))")
def split_forced_train(s, d):
    return c.forced_train_split(c.dedup_per_author(_aa(s, d)))


@query(f"SELECT row_id, CASE WHEN {_UNI.format(s=0, c='row_id')} < {int(0.2 * (1 << 32))} THEN 'test' ELSE 'train' END AS part FROM aa_texts")
def split_bernoulli(s, d):
    return c.bernoulli_split(table(s, d, "aa_texts"), "row_id")


@query("SELECT row_id FROM aa_texts ORDER BY md5('0:' || row_id), row_id LIMIT 500")
def sample_n(s, d):
    return c.sample_rows(table(s, d, "aa_texts").select("row_id"), "row_id", 500)


_POS = f"WITH r AS ({_RANK} ({DEDUP})) SELECT a.seq AS seq0, b.seq AS seq1, 1 AS same FROM r a JOIN r b ON a.author = b.author AND a.rank % a.n + 1 = b.rank WHERE a.n > 1"


@query(_POS)
def av_pairs_positive(s, d):
    return c.positive_pairs(c.dedup_per_author(_aa(s, d)))


_NEG = f"""WITH l AS ({_LABELS}), r AS (SELECT x.*, new_id FROM ({_RANK} ({DEDUP})) x JOIN l USING (author)), z AS (SELECT new_id AS other, max(n) AS size FROM r GROUP BY new_id),
m AS (SELECT seq AS seq0, (new_id + 1 + {_UNI.format(s=1, c='seq')} % ((SELECT count(*) FROM l) - 1)) % (SELECT count(*) FROM l) AS other FROM r WHERE n > 1)
SELECT seq0, r.seq AS seq1, 0 AS same FROM m JOIN z USING (other) JOIN r ON r.new_id = other AND r.rank = {_UNI.format(s=2, c='seq0')} % size + 1"""


def _negative(s, d):
    aa = c.dedup_per_author(_aa(s, d))
    return c.negative_pairs(aa, c.relabel_first_seen(aa))


@query(_NEG)
def av_pairs_negative(s, d):
    return _negative(s, d)


@query(f"SELECT same, count(*) AS n FROM (SELECT * FROM ({_POS}) UNION ALL SELECT * FROM ({_NEG})) GROUP BY same")
def av_pair_counts(s, d):
    return c.positive_pairs(c.dedup_per_author(_aa(s, d))).unionByName(_negative(s, d)).groupBy("same").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT seq FROM (SELECT unnest([seq0, seq1]) AS seq FROM ({_POS}))")
def pairs_to_aa(s, d):
    return c.pairs_to_rows(c.positive_pairs(c.dedup_per_author(_aa(s, d))), "seq0", "seq1")


@query(f"SELECT a.row_id AS seq0, b.row_id AS seq1, CAST(a.labels = b.labels AS INTEGER) AS same FROM aa_texts a JOIN aa_texts b ON b.row_id = a.row_id + 1 WHERE a.labels IS NOT NULL AND b.labels IS NOT NULL")
def pair_label(s, d):
    t = table(s, d, "aa_texts").where("labels IS NOT NULL").select("row_id", "labels")
    b = t.select(F.col("row_id").alias("seq1"), F.col("labels").alias("l1"))
    return t.join(b, F.col("row_id") + 1 == F.col("seq1")).select(F.col("row_id").alias("seq0"), "seq1", (F.col("labels") == F.col("l1")).cast("int").alias("same"))


@query("WITH a AS (SELECT labels AS author, source FROM aa_texts WHERE split = 'train'), b AS (SELECT labels AS author, source FROM aa_texts WHERE split IS DISTINCT FROM 'train') SELECT author, source, count(*) AS n FROM (SELECT * FROM a UNION ALL SELECT * FROM (SELECT DISTINCT * FROM b) x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.author = x.author AND a.source = x.source)) GROUP BY author, source")
def union_keep_first(s, d):
    t = table(s, d, "aa_texts").select("split", F.col("labels").alias("author"), "source")
    return c.union_new(t.where("split = 'train'").drop("split"), t.where("split IS DISTINCT FROM 'train'").drop("split")).groupBy("author", "source").agg(F.count("*").alias("n"))


@query("SELECT author, count(*) AS n FROM (SELECT labels AS author FROM aa_texts WHERE split = 'train' AND labels IS NOT NULL UNION ALL SELECT labels + (SELECT max(labels) FROM aa_texts WHERE split = 'train') + 1 FROM aa_texts WHERE split IS DISTINCT FROM 'train' AND labels IS NOT NULL) GROUP BY author")
def combine_corpora(s, d):
    t = table(s, d, "aa_texts").where("labels IS NOT NULL").select("split", F.col("labels").alias("author"))
    return c.combine(t.where("split = 'train'").drop("split"), t.where("split IS DISTINCT FROM 'train'").drop("split")).groupBy("author").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CAST(i AS INTEGER) AS no, md5(substr(text, CAST(i * 2560 + 1 AS BIGINT), 2560)) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 2560.0) AS BIGINT)))) AS i FROM documents WHERE text IS NOT NULL)")
def text_chunks(s, d):
    return c.chunks(table(s, d, "documents"), "doc_id", "text").select("doc_id", "no", F.md5("chunk").alias("h"))


_STATS = "CAST({c} AS BIGINT)"


def _stats_sql(by):
    keys = ", ".join([*by, ""])
    group = f"GROUP BY {', '.join(by)}" if by else ""
    per = f"SELECT {keys}labels AS author, count(*) AS t, CAST(sum(coalesce(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 0)) AS BIGINT) AS w FROM aa_texts WHERE labels IS NOT NULL GROUP BY {keys}labels"
    stats = ", ".join(f"max({c}) AS max_{n}, min({c}) AS min_{n}, round(avg({c}), 6) AS mean_{n}, round(median({c}), 6) AS median_{n}, round(stddev_pop({c}), 6) AS std_{n}" for c, n in (("t", "texts"), ("w", "words")))
    return f"SELECT {keys}count(*) AS n_authors, CAST(sum(t) AS BIGINT) AS n_texts, CAST(sum(w) AS BIGINT) AS n_words, {stats} FROM ({per}) {group}"


@query(_stats_sql([]))
def corpus_stats(s, d):
    return c.corpus_stats(_aa(s, d), [])


@query(_stats_sql(["split"]))
def corpus_stats_by_split(s, d):
    t = table(s, d, "aa_texts").where("labels IS NOT NULL")
    return c.corpus_stats(t.select(F.col("labels").alias("author"), "text", "split"), ["split"])


@query("SELECT min(labels) = 0 AND max(labels) = count(DISTINCT labels) - 1 AS dense, (SELECT count(DISTINCT labels) FROM aa_texts WHERE split <> 'train' AND labels NOT IN (SELECT labels FROM aa_texts WHERE split = 'train' AND labels IS NOT NULL)) AS n_unknown FROM aa_texts WHERE split = 'train'")
def quality_labels(s, d):
    t = table(s, d, "aa_texts").where("labels IS NOT NULL").select("labels", "split")
    train, rest = t.where("split = 'train'"), t.where("split <> 'train'")
    dense = train.agg(((F.min("labels") == 0) & (F.max("labels") == F.count_distinct("labels") - 1)).alias("dense"))
    unknown = rest.join(train.select("labels"), "labels", "left_anti").agg(F.count_distinct("labels").alias("n_unknown"))
    return dense.crossJoin(unknown)  # one row each


@query("SELECT md5(text) AS h FROM (SELECT DISTINCT text FROM aa_texts WHERE split = 'train') WHERE text IN (SELECT text FROM aa_texts WHERE split <> 'train' AND text IS NOT NULL)")
def quality_overlap(s, d):
    t = table(s, d, "aa_texts").select("text", "split")
    return c.overlap(t.where("split = 'train'"), t.where("split <> 'train'"), "text").select(F.md5("text").alias("h"))


@query("SELECT split, count(*) AS n FROM aa_texts GROUP BY split")
def quality_split_sizes(s, d):
    return table(s, d, "aa_texts").groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT b.source, count(*) AS n_docs, count(DISTINCT b.author_id) AS n_authors FROM documents b LEFT JOIN blog_authors a USING (author_id) GROUP BY b.source")
def documents_by_author(s, d):
    docs, who = table(s, d, "documents"), table(s, d, "blog_authors")
    return docs.join(who.select("author_id"), "author_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count_distinct("author_id").alias("n_authors"))
