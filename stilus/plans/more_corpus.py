"""Queries over the wider corpus operators: records, splits of the known corpora, pairs, finished data
sets and their checks; with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from stilus.operators import corpus as c
from stilus.operators import finalize as z
from stilus.operators import pairs as p
from stilus.plans.corpus import _LABELS, _NEG, _POS, _RANK, _UNI, AA, DEDUP
from stilus.session import table

QUERIES, ORACLE = {}, {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _aa(s, d, where=None):
    t = table(s, d, "aa_texts")
    return c.canonical(t.where(where) if where else t, "labels", "row_id", "text")


def _sql(where=None):
    return AA + (f" AND {where}" if where else "")


# -- records --------------------------------------------------------------------------------------
@query(f"SELECT author, count(*) AS n, md5(string_agg(text, '|' ORDER BY seq)) AS h FROM ({AA}) GROUP BY author")
def group_by_author(s, d):
    return c.grouped(_aa(s, d)).select("author", F.size("texts").cast("long").alias("n"), F.md5(F.array_join("texts", "|")).alias("h"))


@query(f"SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY seq) - 1 AS INTEGER) AS no, md5(text) AS h FROM ({AA})")
def ungroup_authors(s, d):
    return c.ungrouped(c.grouped(_aa(s, d))).select("author", "no", F.md5("text").alias("h"))


_NEXT = "documents a JOIN documents b ON b.doc_id = a.doc_id + 1"


def _document_pairs(s, d):
    t = table(s, d, "documents").select("doc_id", "text")
    return t.withColumnRenamed("text", "text0").join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text1")), "doc_id")


@query(f"SELECT doc_id, CAST(no AS INTEGER) AS no, md5(substr(x, CAST(no * 1280 + 1 AS BIGINT), 1280)) AS h0, md5(substr(y, CAST(no * 1280 + 1 AS BIGINT), 1280)) AS h1 FROM (SELECT a.doc_id, substr(a.text, 1, 100000) AS x, substr(b.text, 1, 100000) AS y, unnest(range(0, CAST(ceil(least(length(a.text), length(b.text), 100000) / 1280.0) AS BIGINT))) AS no FROM {_NEXT})")
def pair_chunks(s, d):
    # a range of no pieces has no row
    return p.aligned_chunks(_document_pairs(s, d), ["doc_id"], "text0", "text1").select("doc_id", "no", F.md5(F.substring("chunk0", 1, 1280)).alias("h0"), F.md5(F.substring("chunk1", 1, 1280)).alias("h1"))


@query("SELECT doc_id, CAST(no AS INTEGER) AS no, md5(substr(text, CAST(no * 512 + 1 AS BIGINT), least(512, 100000 - no * 512)::BIGINT)) AS h FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(least(length(text), 100000) / 512.0) AS BIGINT))) AS no FROM documents WHERE length(text) > 0)")
def text_chunks_512(s, d):
    return p.chunks_up_to(table(s, d, "documents"), "doc_id", "text").select("doc_id", "no", F.md5("chunk").alias("h"))


@query("SELECT doc_id, CAST(no AS INTEGER) AS no, md5(substr(text, CAST(no * 2560 + 1 AS BIGINT), CASE WHEN length(text) > 2560 THEN 2560 ELSE 3072 END)) AS h FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 2560.0) AS BIGINT)))) AS no FROM documents WHERE text IS NOT NULL)")
def long_text_chunks(s, d):
    return p.long_text_chunks(table(s, d, "documents"), "doc_id", "text").select("doc_id", "no", F.md5("chunk").alias("h"))


@query("SELECT doc_id, 0 AS no, md5(substr(text, 1, 3072)) AS h FROM documents WHERE text IS NOT NULL")
def test_text_chunks(s, d):
    return p.long_text_chunks(table(s, d, "documents"), "doc_id", "text", test=True).select("doc_id", "no", F.md5("chunk").alias("h"))


@query(f"SELECT doc_id, md5(substr(text, {_UNI.format(s=0, c='doc_id')} % (greatest(length(text) - 2560, 0) + 1) + 1, 2560)) AS h FROM documents WHERE text IS NOT NULL")
def random_substrings(s, d):
    return table(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(p.random_substring(F.col("text"), "doc_id")).alias("h"))


_ONE = "(SELECT entry_id, min(author_id) AS author_id, min(coalesce(preprocessed, '')) AS preprocessed, min(tokens) AS tokens FROM ling_entries WHERE tokens IS NOT NULL GROUP BY entry_id)"


@query(f"SELECT author_id, md5(string_agg(preprocessed, chr(10) ORDER BY entry_id)) AS h, CAST(sum(len(tokens)) AS INTEGER) AS n_tokens FROM {_ONE} GROUP BY author_id")
def merged_entries(s, d):
    e = table(s, d, "ling_entries").where("tokens IS NOT NULL").groupBy("entry_id").agg(F.min("author_id").alias("author_id"), F.min(F.coalesce("preprocessed", F.lit(""))).alias("preprocessed"), F.min("tokens").alias("tokens"))
    return p.merge_entries(e, "author_id", "entry_id", ["preprocessed"], ["tokens"]).select("author_id", F.md5("preprocessed").alias("h"), F.size("tokens").alias("n_tokens"))


@query("SELECT is_test_datapoint, count(*) AS n FROM (SELECT CASE WHEN split = 'train' THEN 0 ELSE 1 END AS is_test_datapoint FROM aa_texts WHERE split IS NOT NULL) GROUP BY 1")
def test_flag(s, d):
    t = table(s, d, "aa_texts").select("row_id", "split")
    return p.with_test_flag(t.where("split = 'train'"), t.where("split <> 'train'")).groupBy("is_test_datapoint").agg(F.count("*").alias("n"))


@query(f"SELECT a.doc_id FROM {_NEXT} WHERE length(a.text) >= 50 AND length(b.text) >= 50")
def min_chars_pairs(s, d):
    return p.min_chars_both(_document_pairs(s, d), "text0", "text1").select("doc_id")


@query(f"SELECT author, seq FROM ({AA}) WHERE length(text) >= 50")
def gated_texts(s, d):
    """The gate is open: the tables hold authors with many short texts."""
    return p.gated(_aa(s, d), 50, 1 << 40).select("author", "seq")


@query(f"SELECT author, seq FROM ({_sql("split <> 'train'")}) WHERE author IN (SELECT author FROM ({_sql("split = 'train'")}))")
def restricted_to_train(s, d):
    return c.restrict_to(_aa(s, d, "split <> 'train'"), _aa(s, d, "split = 'train'")).select("author", "seq")


@query(f"SELECT new_id AS author, seq FROM ({AA}) JOIN ({_LABELS}) USING (author)")
def relabel_strict(s, d):
    aa = _aa(s, d)
    return c.apply_labels_strict(aa, c.relabel_first_seen(aa)).select("author", "seq")


@query("SELECT source, row_number() OVER (ORDER BY source) - 1 AS new_id FROM (SELECT DISTINCT source FROM aa_texts)")
def relabel_by_name(s, d):
    return c.relabel_by_name(table(s, d, "aa_texts"), "source")


@query(f"SELECT seq, author, row_number() OVER (PARTITION BY author ORDER BY seq) - 1 AS text_id FROM ({AA})")
def text_addresses(s, d):
    return c.text_addresses(_aa(s, d))


@query("SELECT row_id FROM aa_texts ORDER BY row_id LIMIT 1000")
def first_rows(s, d):
    return c.first_rows(table(s, d, "aa_texts").select("row_id"), 1000, "row_id")


@query("SELECT row_id, labels, row_number() OVER (ORDER BY md5('0:' || row_id), row_id) - 1 AS place FROM aa_texts")
def shuffled_rows(s, d):
    return c.shuffled(table(s, d, "aa_texts").select("row_id", "labels"), "row_id")


@query("SELECT row_id, length(text) AS n FROM aa_texts WHERE text IS NOT NULL")
def length_batches(s, d):
    return c.by_length(table(s, d, "aa_texts").where("text IS NOT NULL").select("row_id", "text"), "text", 16).select("row_id", F.length("text").cast("long").alias("n"))


@query(f"SELECT author, count(*) AS n_rows, count(DISTINCT text) AS n_distinct FROM ({AA}) GROUP BY author")
def texts_per_author(s, d):
    return c.texts_per_author(_aa(s, d))


@query(f"SELECT author, seq FROM ({AA}) UNION ALL SELECT author, seq FROM ({_sql("split IS DISTINCT FROM 'train'")})")
def concat_frames(s, d):
    return _aa(s, d).unionByName(_aa(s, d, "split IS DISTINCT FROM 'train'")).select("author", "seq")


_A, _B = (f"(SELECT DISTINCT labels FROM aa_texts WHERE split {x} 'train' AND labels IS NOT NULL)" for x in ("=", "IS DISTINCT FROM"))


@query(f"SELECT labels, 'left' AS side FROM {_A} WHERE labels NOT IN (SELECT * FROM {_B}) UNION ALL SELECT labels, 'right' FROM {_B} WHERE labels NOT IN (SELECT * FROM {_A})")
def set_differences(s, d):
    t = table(s, d, "aa_texts").where("labels IS NOT NULL")
    return c.differences(t.where("split = 'train'"), t.where("split IS DISTINCT FROM 'train'"), "labels")


@query("SELECT doc_id AS id, source FROM documents WHERE source IS NOT NULL UNION ALL SELECT row_id, source FROM aa_texts WHERE row_id NOT IN (SELECT doc_id FROM documents WHERE source IS NOT NULL)")
def merged_pairs(s, d):
    large = table(s, d, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("id"), "source")
    return c.merge_pairs(large, table(s, d, "aa_texts").select(F.col("row_id").alias("id"), "source"))


@query("WITH a AS (SELECT labels AS author FROM aa_texts WHERE labels IS NOT NULL AND split = 'train'), b AS (SELECT labels - 10 AS author FROM aa_texts WHERE labels >= 10 AND split <> 'train') SELECT author, count(*) AS n FROM (SELECT author FROM a UNION ALL SELECT author + (SELECT max(author) FROM a) + 1 FROM b) GROUP BY author")
def combine_dropping_first(s, d):
    t = table(s, d, "aa_texts").where("labels IS NOT NULL").select("split", F.col("labels").alias("author"))
    return c.combine(t.where("split = 'train'").drop("split"), t.where("split <> 'train'").drop("split"), drop=10).groupBy("author").agg(F.count("*").alias("n"))


@query("SELECT row_id, CAST(least(floor(i * 10 / n), 9) AS INTEGER) AS shard FROM (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS i, count(*) OVER () AS n FROM aa_texts)")
def row_range_shards(s, d):
    return p.row_range_shard(table(s, d, "aa_texts").select("row_id"), "row_id", 10)


@query("SELECT row_id, CASE WHEN contains(source, 'imdb') OR contains(source, 'amazon') THEN 'reviews' WHEN contains(source, 'blogs') THEN 'blogs' ELSE 'other' END AS part FROM aa_texts WHERE source IS NOT NULL")
def name_route(s, d):
    rules = {"reviews": ["imdb", "amazon"], "blogs": ["blogs"]}
    return table(s, d, "aa_texts").where("source IS NOT NULL").select("row_id", c.route_by_name("source", rules, "other").alias("part"))


# -- splits ---------------------------------------------------------------------------------------
def _quota(sql, parts):
    cases, upto = "", 0
    for name, q in parts[:-1]:
        upto += q
        cases += f"WHEN (rank - 1) * 10 < n * {upto} THEN '{name}' "
    return f"SELECT author, seq, CASE {cases}ELSE '{parts[-1][0]}' END AS part FROM ({_RANK} ({sql}))"


_IID = _sql("split <> 'cross_topic_test'")
_CROSS = f"SELECT * FROM ({_sql("split = 'cross_topic_test'")}) WHERE author IN (SELECT author FROM ({_IID}))"


@query(f"{_quota(_IID, (('train', 6), ('val', 2), ('test', 2)))} UNION ALL {_quota(_CROSS, (('cross_topic_val', 5), ('cross_topic_test', 5)))}")
def split_cross_topic(s, d):
    t = table(s, d, "aa_texts").where("labels IS NOT NULL").select(F.col("labels").alias("author"), F.col("row_id").alias("seq"), "split")
    return z.cross_domain(t, "split", {"iid": ["train", "AA_val", "AA_test"], "cross_topic": ["cross_topic_test"]})


_TRAIN, _TEST = _sql("split = 'train'"), _sql("split <> 'train'")


@query(f"{_quota(_TRAIN, (('train', 8), ('val', 2)))} UNION ALL SELECT author, seq, 'test' FROM ({_TEST}) WHERE author IN (SELECT author FROM ({_TRAIN}))")
def split_given_test_80(s, d):
    return z.with_given_test(_aa(s, d, "split = 'train'"), _aa(s, d, "split <> 'train'"))


@query(f"{_quota(_TRAIN, (('train', 9), ('val', 1)))} UNION ALL SELECT author, seq, 'test' FROM ({_TEST}) WHERE author IN (SELECT author FROM ({_TRAIN}))")
def split_given_test_90(s, d):
    return z.with_given_test(_aa(s, d, "split = 'train'"), _aa(s, d, "split <> 'train'"), 9)


@query(_quota(DEDUP, (("train", 8), ("val", 1), ("test", 1))))
def split_80_10_10(s, d):
    return z.parted(c.dedup_per_author(_aa(s, d)), (("train", 8), ("val", 1), ("test", 1)))


_DEAL = _UNI.format(s=0, c="author") + " % 10"


@query(f"""SELECT author, seq, CASE WHEN part = 'train' THEN 'train' WHEN {_UNI.format(s=1, c='seq')} % 2 = 0 THEN 'val' ELSE 'test' END AS part FROM ({_quota(f"SELECT * FROM ({AA}) WHERE {_DEAL} < 8", (('train', 6), ('rest', 4)))})
UNION ALL SELECT author, seq, CASE WHEN {_DEAL} = 8 THEN 'unique_val' ELSE 'unique_test' END FROM ({AA}) WHERE {_DEAL} >= 8""")
def split_disjoint_authors(s, d):
    return z.disjoint_authors(_aa(s, d))


@query("SELECT a.row_id AS id, md5(trim(translate(a.text, chr(9) || chr(10) || chr(13), '   '))) AS h0, md5(trim(translate(b.text, chr(9) || chr(10) || chr(13), '   '))) AS h1, CAST(a.labels = b.labels AS INTEGER) AS same FROM aa_texts a JOIN aa_texts b ON b.row_id = a.row_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL")
def normalised_pairs(s, d):
    t = table(s, d, "aa_texts").where("text IS NOT NULL").select("row_id", "labels", "text")
    b = t.select((F.col("row_id") - 1).alias("row_id"), F.col("labels").alias("author1"), F.col("text").alias("text1"))
    both = t.join(b, "row_id").select(F.col("row_id").alias("id"), F.col("text").alias("text0"), "text1", F.col("labels").alias("author0"), "author1")
    return z.normalised_pairs(both).select("id", F.md5("text0").alias("h0"), F.md5("text1").alias("h1"), "same")


# -- pairs ----------------------------------------------------------------------------------------
def _ranks(sql=DEDUP):
    return f"WITH l AS ({_LABELS}), r AS (SELECT x.*, new_id FROM ({_RANK} ({sql})) x JOIN l USING (author)), s AS (SELECT new_id AS other, max(n) AS size FROM r GROUP BY new_id)"


_COUNT = "(SELECT count(*) FROM l)"


@query(f"""{_ranks()}, m AS (SELECT seq AS seq0, CAST({_UNI.format(s=3, c='seq')} % 2 AS INTEGER) AS same, CASE WHEN {_UNI.format(s=3, c='seq')} % 2 = 1 THEN new_id ELSE (new_id + 1 + {_UNI.format(s=1, c='seq')} % ({_COUNT} - 1)) % {_COUNT} END AS other FROM r)
SELECT seq0, r.seq AS seq1, same FROM m JOIN s USING (other) JOIN r ON r.new_id = other AND r.rank = {_UNI.format(s=2, c='seq0')} % size + 1""")
def av_pairs_drawn(s, d):
    aa = c.dedup_per_author(_aa(s, d))
    return p.drawn_pairs(aa, c.relabel_first_seen(aa))


@query(f"""{_ranks()}, m AS (SELECT seq AS seq0, 1 AS same, new_id AS other FROM r UNION ALL SELECT seq, 0, {_UNI.format(s=1, c='seq')} % {_COUNT} FROM r)
SELECT seq0, r.seq AS seq1, same FROM m JOIN s USING (other) JOIN r ON r.new_id = other AND r.rank = {"CAST('0x' || substr(md5('2:' || seq0 || same), 1, 8) AS BIGINT)"} % size + 1""")
def av_pairs_passes(s, d):
    aa = c.dedup_per_author(_aa(s, d))
    return p.passes_of_pairs(aa, c.relabel_first_seen(aa))


_CLEAN = f"SELECT author, seq, replace(text, chr(0), '') AS text FROM ({AA}) WHERE length(text) > 50"
_ONCE = f"(SELECT * FROM ({_POS.replace(AA, _CLEAN)}) UNION ALL SELECT * FROM ({_NEG.replace(AA, _CLEAN)}))"
_TWICE = _ONCE.replace("'0:'", "'100:'").replace("'1:'", "'101:'").replace("'2:'", "'102:'")


@query(f"WITH a AS {_ONCE} SELECT * FROM a UNION ALL SELECT * FROM (SELECT DISTINCT * FROM {_TWICE} EXCEPT SELECT * FROM a)")
def av_training_pairs(s, d):
    return p.training_pairs(_aa(s, d))


@query(f"""WITH r AS (SELECT * FROM ({_RANK} ({DEDUP})) WHERE n >= 4), t AS (SELECT task, author, row_number() OVER (PARTITION BY task ORDER BY md5('0:' || task || author), author) AS w FROM (SELECT DISTINCT author FROM r) CROSS JOIN range(5) x(task))
SELECT task, author, seq, CASE WHEN rank <= 2 THEN 'support' ELSE 'query' END AS role FROM r JOIN t USING (author) WHERE w <= 5 AND rank <= 4""")
def few_shot_tasks(s, d):
    return p.tasks(c.dedup_per_author(_aa(s, d)), ways=5, shots=2, n_tasks=5)


# -- finished data sets ---------------------------------------------------------------------------
_SETS = {"all": None, "train": "split = 'train'", "aa_val": "split = 'AA_val'", "aa_test": "split = 'AA_test'"}
_WC = "coalesce(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 0)"


def _statistics_sql(sets):
    figures = {"number of authors": "count(*)", "number of documents": "sum(t)", "number of words": "sum(w)", "docs per author": "sum(t) / count(*)", "words per author": "sum(w) / count(*)"}
    for col, name in (("t", "docs"), ("w", "words")):
        figures |= {f"max {name} per author": f"max({col})", f"min {name} per author": f"min({col})", f"mean {name} per author": f"avg({col})", f"median {name} per author": "floor(median(t))" if col == "t" else "median(w)", f"std {name} per author": f"stddev_pop({col})"}
    out = []
    for label, where in sets.items():
        per = f"(SELECT author, count(*) AS t, CAST(sum({_WC}) AS BIGINT) AS w FROM ({_sql(where)}) GROUP BY author)"
        out += [f"SELECT '{label} {k}' AS metric, round(CAST({v} AS DOUBLE), 6) AS value FROM {per}" for k, v in figures.items()]
    return " UNION ALL ".join(out)


@query(_statistics_sql(_SETS))
def finalize_statistics(s, d):
    return z.summary({k: _aa(s, d, w) for k, w in _SETS.items()}, {})


@query(_statistics_sql({"train": "split = 'train'", "aa_cross_topic": "split = 'cross_topic_test'"}))
def finalize_cross_statistics(s, d):
    return z.summary({"train": _aa(s, d, "split = 'train'"), "aa_cross_topic": _aa(s, d, "split = 'cross_topic_test'")}, {})


def _pair_statistics_sql():
    out = []
    for k, w in _SETS.items():
        for name, pairs in (("positive", _POS), ("negative", _NEG)):
            out.append(f"SELECT '{k} number {name} pairs' AS metric, count(*)::DOUBLE AS value FROM ({pairs.replace(AA, _sql(w))})")
    return " UNION ALL ".join(out)


@query(_pair_statistics_sql())
def finalize_pair_statistics(s, d):
    """Pairs sampled from each set, by label."""
    return z.summary({}, {k: z.sampled_pairs(_aa(s, d, _SETS[k])) for k in _SETS})


_PAIRS = f"(SELECT * FROM ({_POS}) UNION ALL SELECT * FROM ({_NEG}))"


@query(f"SELECT list_sort(list(DISTINCT same)) = [0, 1] AS ok FROM {_PAIRS}")
def quality_av_labels(s, d):
    return z.label_values(z.sampled_pairs(_aa(s, d)))


@query(f"WITH p AS (SELECT DISTINCT unnest([seq0, seq1]) AS seq FROM {_PAIRS}), u AS (SELECT md5(text) AS h FROM ({AA}) WHERE seq IN (SELECT seq FROM p)) SELECT DISTINCT md5(text) AS text_md5, 'aa' AS side FROM ({AA}) WHERE md5(text) NOT IN (SELECT h FROM u)")
def quality_same_texts(s, d):
    """Texts that the pairs sampled from them lack: those of authors with one text that no other text
    drew."""
    aa = _aa(s, d)
    return z.same_texts(aa, z.sampled_pairs(aa))


@query(f"SELECT author, count(*) AS n_short FROM ({AA}) WHERE length(text) < 50 GROUP BY author")
def quality_short_texts(s, d):
    return z.short_texts(_aa(s, d))


@query("SELECT count(DISTINCT labels) AS n_authors, 25000::BIGINT AS expected, count(DISTINCT labels) = 25000 AS ok FROM aa_texts")
def quality_author_count(s, d):
    return z.author_count(_aa(s, d), 25000)


@query(f"SELECT count(*) AS n_before, count(*) AS n_after, true AS ok FROM ({AA})")
def quality_same_rows(s, d):
    aa = _aa(s, d)
    return z.same_rows(aa, c.text_addresses(aa))
