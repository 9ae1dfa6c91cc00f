import json
import math
import random

import pytest

from stilus.operators import corpus as c
from stilus.operators import evaluation as ev
from stilus.operators import ppm
from stilus.operators import scoring as m
from stilus.operators import skew
from stilus.sources import readers

AA = "author int, seq long, text string"


def test_skew_nulls_ties_and_empty(spark):
    rows = [(1, "a b", "train"), (1, "a b", "train"), (1, None, "AA_val"), (2, "", "train"), (None, "x", "train")]
    df = spark.createDataFrame([(*r, "extra", i) for i, r in enumerate(rows)], "labels int, text string, split string, salt string, n long")
    got = {r["labels"]: r for r in skew.author_profile(df, min_share=0.5, salts=4).collect()}
    assert set(got) == {1, 2}
    assert (got[1]["n_rows"], got[1]["n_texts"], got[1]["n_words"], got[1]["rows_AA_val"], got[1]["texts_train"]) == (3, 1, 4, 1, 1)
    assert (got[2]["n_rows"], got[2]["n_texts"], got[2]["n_words"]) == (1, 1, 0)
    assert [r[0] for r in skew.dominant_keys(df, "labels", 0.5, ["n"]).collect()] == [1]
    empty = df.limit(0)
    assert skew.author_profile(empty).count() == 0 and skew.dominant_keys(empty, "labels", 0.03, ["n"]).count() == 0


def test_salted_equals_plain(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE CAST(id % 50 AS INT) END AS k", "id")
    got = skew.salted_aggregate(df, "k", ["id"], [F.sum("id").alias("s")], [F.sum("s").alias("s")], min_share=0.1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.groupBy("k").agg(F.sum("id")).collect()))


def test_split_quotas_and_disjoint(spark):
    rows = [(a, a * 100 + i, f"t{i}") for a, n in ((1, 1), (2, 2), (3, 3), (4, 5), (5, 10)) for i in range(n)]
    got = c.stratified_split(spark.createDataFrame(rows, AA)).collect()
    assert len(got) == len(rows) == len({r["seq"] for r in got})
    assert sorted(r["part"] for r in got if r["author"] == 5) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2


def test_pairs_skip_lone_texts(spark):
    aa = c.dedup_per_author(spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (2, 3, "b"), (3, 4, "c"), (3, 5, "d")], AA))
    assert sorted(map(tuple, c.positive_pairs(aa).collect())) == [(4, 5, 1), (5, 4, 1)]
    neg = c.negative_pairs(aa, c.relabel_first_seen(aa)).collect()
    assert len(neg) == 2 and all(r["seq1"] in (1, 2) for r in neg)
    one = aa.where("author = 3")
    assert c.negative_pairs(one, c.relabel_first_seen(one)).count() == 0


def test_dedup_and_relabel(spark):
    aa = spark.createDataFrame([(7, 1, "x"), (9, 2, "x"), (9, 3, "y"), (8, 4, "x")], AA)
    kept = c.dedup_global(aa)
    assert sorted(r["seq"] for r in kept.collect()) == [1, 3]
    assert {r["author"]: r["new_id"] for r in c.relabel_first_seen(kept).collect()} == {7: 0, 9: 1}


@pytest.mark.parametrize("n,want", [(0, 1), (1, 1), (2560, 1), (2561, 2), (5120, 2)])
def test_chunks(spark, n, want):
    got = c.chunks(spark.createDataFrame([(1, "é" * n)], "k int, t string"), "k", "t").collect()
    assert len(got) == want and "".join(r["chunk"] for r in sorted(got, key=lambda r: r["no"])) == "é" * n


def test_metrics_fixture(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.4), (0, 0.6)], "truth int, score double")
    assert ev.auc(df, "truth", "score").first()[0] == 0.75
    r = m.verification_metrics(df, "truth", "score").first()
    assert (r["c_at_1"], round(r["f1"], 6), r["f05u"], round(r["brier"], 6)) == (0.625, 0.666667, 0.5, 0.805)
    assert ev.auc(df.limit(0), "truth", "score").first()[0] == 0.0


def test_ppm_fixture(spark):
    train = spark.createDataFrame([("A", "abab"), (None, "zz"), ("A", None)], "author string, text string")
    docs = spark.createDataFrame([(1, "ab"), (2, "z"), (3, ""), (4, None)], "doc int, text string").repartition(5)
    got = {r["doc"]: r["bits"] for r in ppm.ppm_scores(docs, "doc", "text", train, "author", "text", 1).collect()}
    assert math.isclose(got[1], 0.5) and math.isclose(got[2], 8.0) and set(got) == {1, 2}
    assert ppm.ppm_scores(docs.limit(0), "doc", "text", train, "author", "text").count() == 0


def test_ppm_default_order(spark):
    df = spark.createDataFrame([("A", "abcdefg")], "author string, text string")
    model = m.ppm_counts(df, "author", "text")
    assert {r["ctx"] for r in model.where("k = 5").collect()} == {"abcde", "bcdef"} and model.agg({"k": "max"}).first()[0] == 5
    # after "xabcd" or "yabcd" only the first character of the context tells what follows
    train = spark.createDataFrame([("A", "xabcd1 yabcd2")], "author string, text string")
    got = ppm.ppm_scores(spark.createDataFrame([(1, "yabcd2")], "doc int, text string"), "doc", "text", train, "author", "text").first()["bits"]
    assert math.isclose(got, math.log2(13) / 6)


def _bits(model_texts, text, order=5):
    counts, totals = {}, {}
    for t in model_texts:
        for i, ch in enumerate(t):
            for k in range(min(i, order) + 1):
                ctx = t[i - k : i]
                counts[k, ctx, ch] = counts.get((k, ctx, ch), 0) + 1
                totals[k, ctx] = totals.get((k, ctx), 0) + 1
    total = 0.0
    for i, ch in enumerate(text):
        p = 1 / 256
        for k in range(min(i, order), -1, -1):
            ctx = text[i - k : i]
            if (k, ctx, ch) in counts:
                p = counts[k, ctx, ch] / totals[k, ctx]
                break
        total -= math.log2(p)
    return total / len(text)


def test_ppm_against_brute_force(spark):
    g = random.Random(2)
    text = lambda: "".join(g.choice("abcé 😀d") for _ in range(g.randrange(1, 60)))
    train = [(a, text()) for a in range(70) for _ in range(3)]
    docs = [(i, text()) for i in range(20)]
    got = ppm.ppm_scores(spark.createDataFrame(docs, "doc int, text string").repartition(4), "doc", "text", spark.createDataFrame(train, "author int, text string").repartition(6), "author", "text")
    rows = got.collect()
    assert len(rows) == 70 * 20
    for r in rows:
        want = _bits([t for a, t in train if a == r["author"]], docs[r["doc"]][1])
        assert math.isclose(r["bits"], want, abs_tol=1e-9)
    best = {r["doc"]: (r["author"], r["margin"]) for r in ppm.attribute(got, "doc", "author", "bits").collect()}
    for d in range(20):
        s = sorted((r["bits"], r["author"]) for r in rows if r["doc"] == d)
        assert best[d][0] == s[0][1] and math.isclose(best[d][1], (s[1][0] - s[0][0]) / (s[-1][0] - s[0][0]), abs_tol=1e-5)
    pairs = [(i, text(), text()) for i in range(30)] + [(90, None, "a"), (91, "", "b")]
    feats = {r["i"]: r for r in ppm.pair_features(spark.createDataFrame(pairs, "i int, a string, b string"), ["i"], "a", "b").collect()}
    for i, a, b in pairs[:30]:
        d1, d2 = _bits([a], b), _bits([b], a)
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(tuple(feats[i])[1:], (d1, d2, (d1 + d2) / 2, abs(d1 - d2))))
    assert feats[90]["d1"] is None and feats[91]["gap"] is None


def test_positional_split_of_the_reference(spark, tmp_path):
    from stilus.plans import corpus

    rows = [(i, 1, f"text {i}", "train", "imdb62") for i in range(805)] + [(2000 + i, 2, f"other {i}", "train", "imdb62") for i in range(601)]
    spark.createDataFrame(rows, "row_id long, labels int, text string, split string, source string").coalesce(1).write.parquet(str(tmp_path / "aa_texts.parquet"))
    got = corpus.QUERIES["split_positional_600_800"](spark, str(tmp_path)).groupBy("author", "part").count().collect()
    assert {tuple(r) for r in got} == {(1, "train", 600), (1, "val", 200), (1, "test", 5), (2, "train", 600), (2, "val", 1)}


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, "back\\slash\""), (4, ""), (5, "null"), (6, " blanks ")]
    path = str(tmp_path / "aa")
    readers.write_aa(spark.createDataFrame(rows, "author_id int, text string"), path)
    assert sorted(map(tuple, readers.read_aa(spark, path).collect())) == rows


def test_blog_reader(spark, tmp_path):
    (tmp_path / "5.male.25.Arts.Leo.xml").write_bytes(b"<Blog>\n<date>1,May,2004</date>\n<post>\n\n  first  line\n second\x00\n</post>\n<date>2,May,2004</date>\n<post>\nother\n</post></Blog>")
    got = sorted(map(tuple, readers.read_blogs(spark, str(tmp_path)).select("author_id", "age", "no", "post_date", "text").collect()))
    assert got == [(5, 25, 0, "1,May,2004", "first  line second"), (5, 25, 1, "2,May,2004", "other")]


def _fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_tsv_and_pan(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("1\t9\thello\td\n2\t8\tbye\td\n")
    assert sorted(map(tuple, readers.read_tsv(spark, str(tmp_path / "x.tsv"), 4).select("f0", "f2").collect())) == [("1", "hello"), ("2", "bye")]
    (tmp_path / "y.tsv").write_text("1\t9\thello\td\nbroken\n")
    _fails(readers.read_tsv(spark, str(tmp_path / "y.tsv"), 4), "right number of fields")
    (tmp_path / "p.jsonl").write_text('{"id":"a","pair":["x","y"]}\n')
    (tmp_path / "t.jsonl").write_text('{"id":"a","authors":["u","u"]}\n')
    assert tuple(readers.read_pan(spark, str(tmp_path / "p.jsonl"), str(tmp_path / "t.jsonl")).first()) == ("a", "x", "y", 1)
    (tmp_path / "t.jsonl").write_text('{"id":"b","authors":["u","u"]}\n')
    _fails(readers.read_pan(spark, str(tmp_path / "p.jsonl"), str(tmp_path / "t.jsonl")), "no truth")
    (tmp_path / "a.jsonl").write_text('{"id":"a","value":0.25}\n{"id":"b","same":true}\n')
    assert sorted(map(tuple, readers.read_answers(spark, str(tmp_path / "a.jsonl")).collect())) == [("a", 0.25), ("b", 1.0)]


def test_json_readers(spark, tmp_path):
    (tmp_path / "posts.jsonl").write_text('{"author_id":"u","syms":["a","b"]}\n{"author_id":"v","syms":[]}\n')
    assert sorted(map(tuple, readers.read_posts(spark, str(tmp_path / "posts.jsonl")).collect())) == [("u", "a"), ("u", "b")]
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "books.json").write_text('{"reviewerID":"u","summary":"s","reviewText":"t","style":{"x":1}}\n{"reviewerID":"v","reviewText":"w"}\n{"reviewerID":"x","summary":"only"}\n')
    assert sorted(map(tuple, readers.read_reviews(spark, str(tmp_path / "r")).collect())) == [("u", "books.json", "s t"), ("v", "books.json", " w")]
    (tmp_path / "n.json").write_text('{"the": 3,\n "a": 2}')
    assert sorted(map(tuple, readers.read_counts(spark, str(tmp_path / "n.json")).collect())) == [("a", 2), ("the", 3)]


def test_folder_readers(spark, tmp_path):
    for name, content in (("x/Blogs/S1D113.txt", "caf\xe9"), ("x/Blogs/S2B1G2.txt", "“q”")):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(content.encode("cp1252"))
    pattern, fields, fixes = readers.CORRELATED
    got = sorted(map(tuple, readers.read_pattern(spark, str(tmp_path / "x"), pattern, fields, fixes=fixes).select("author", "genre", "topic", "text").collect()))
    assert got == [("S1", "D", "I", "café"), ("S2", "B", "G", "“q”")]
    (tmp_path / "x/Blogs/odd.txt").write_text("?")
    _fails(readers.read_pattern(spark, str(tmp_path / "x"), pattern, fields), "no match for file")
    (tmp_path / "s/train/ann").mkdir(parents=True)
    (tmp_path / "s/train/ann/1.txt").write_text("one\n\n two \r\nthree")
    assert tuple(readers.read_splits(spark, str(tmp_path / "s")).first()) == ("train", "ann", "1.txt", "one two three")
    (tmp_path / "u/bob").mkdir(parents=True)
    (tmp_path / "u/bob/t.txt").write_text("first\nsecond\n")
    assert sorted(map(tuple, readers.read_lines(spark, str(tmp_path / "u")).collect())) == [("bob", "t.txt", "first"), ("bob", "t.txt", "second")]


def test_broken_tweet_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1\t10\thello\tmon\n22\t11\thalf of\nx\t the rest\tnoon\tq\tz\n33\t44\ttxt\nnoon\n\nbad\t1\tdropped\tmon\n4\t5\thello\tmon\n")
    got = sorted((r["user"], r["text"]) for r in readers.read_tweets(spark, str(tmp_path / "t.txt")).collect())
    # five fields of a broken pair of lines are thrown away; four that come together are a record
    assert got == [(1, "hello"), (33, "txt")]
    assert list(readers.repaired(["a\tb\tc\td", "11\t22", "33\t44", "x"])) == [["a", "b", "c", "d"], ["11", "22", "33", "44"], ["11", "22", "33", "44"]]


def test_lexicons_entries_and_packed(spark, tmp_path):
    def words(name, content, kind):
        (tmp_path / name).write_text(content)
        return sorted(r[0] for r in readers.read_lexicon(spark, str(tmp_path / name), kind).collect())

    assert words("a", "right//Rong, wrongg\n", "misspelled") == ["rong", "wrongg"] and words("b", "believe Beleive\n", "typos") == ["beleive"]
    assert words("c", "Colour grey\tcolor\n", "british") == ["colour", "grey"] and words("d", "An  apple\n", "determiner") == ["an"] and words("e", "The\n", "stopwords") == ["The"]
    from pyspark.sql import functions as F

    entry = json.dumps({"preprocessed": 'a, "b"', "pos_tags": ["DT"], "pos_tag_chunks": None, "pos_tag_chunk_subtrees": [], "tokens": ["a"]})
    df = spark.createDataFrame([(1, entry, entry)], "same int, a string, b string").select("same", F.from_json("a", readers.ENTRY).alias("entry0"), F.from_json("b", readers.ENTRY).alias("entry1"))
    readers.write_entries(df, str(tmp_path / "entries"))
    assert readers.read_entries(spark, str(tmp_path / "entries")).collect() == df.collect()
    p = spark.createDataFrame([("x $$$ y", "z")], "a string, b string").select(readers.packed(F.col("a"), F.col("b")).alias("t"))
    assert p.first()[0] == "x &&& y$$$z" and tuple(p.select(*readers.unpacked(F.col("t"))).first()) == ("x &&& y", "z")
    (tmp_path / "pairs.tsv").write_text("sentiment\treview\n1\ta$$$b\n")
    assert tuple(readers.read_packed_pairs(spark, str(tmp_path / "pairs.tsv")).first()) == (1, "a", "b")
    (tmp_path / "v.txt").write_text("the 0.5 1\nbad 1\nodd x 2\n")
    assert [(r["word"], r["vector"]) for r in readers.read_vectors(spark, str(tmp_path / "v.txt"), 2).collect()] == [("the", [0.5, 1.0])]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb\nc"), (2, "d")], "label int, text string")
    readers.write_tsv(df, str(tmp_path / "o.tsv"), "text", "label")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "o.tsv")).collect()) == ["a b c\t1", "d\t2"]
    readers.append_json(df, str(tmp_path / "j"))
    readers.append_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 4
    metrics = spark.createDataFrame([(0.5, 1.0)], "auc double, f1 double")
    readers.write_pan_result(metrics, str(tmp_path / "pan"))
    assert 'key: "auc"' in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "pan/evaluation.prototext")).collect())
    readers.write_matrix(spark.createDataFrame([(1, [0.5, 2.0])], "id long, vector array<double>"), str(tmp_path / "m"))
    assert readers.read_matrix(spark, str(tmp_path / "m")).first()["vector"] == [0.5, 2.0]
    ranked = spark.createDataFrame([(1, "u", 0.5, 2), (1, "v", 0.1, 1)], "doc int, cand string, err double, rank int")
    assert readers.ranked_text(ranked, "doc", "cand", "err", "rank").first()["value"].startswith("Rank=1 Candidate=v")
    assert readers.author_table(df, "text", "label").count() == 2 and readers.aa_frame(spark, [(1, "x")]).count() == readers.av_frame(spark, [(1, "x", "y")]).count() == 1


def test_text_fixtures(spark):
    from pyspark.sql import functions as F

    from stilus.functions import normalise as nz
    from stilus.functions import text as t

    raw = ["a1\nb", "a \n\tb \t c", "see https:\\\\x.org!", "Ünï-4 x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, t string").orderBy("i")
    col = lambda c: [r[0] for r in df.select(c).collect()]
    assert col(t.normal_base(F.col("t"))) == ["a0\nb", "a\tb c", "see @!", "Ünï-0 x"]
    assert col(t.distort(F.col("t"))) == ["*0\n*", "*\t* *", "* @!", "Ü*ï-0 *"]
    assert col(t.only_words(F.col("t"))) == ["a0\nb", "a\tb c", "see ", "Ünï0 x"]
    one = lambda x, c: spark.createDataFrame([(x,)], "t string").select(c).first()[0]
    assert one("t1 t2 t3 t4 t5 t6 t7 t8 t9", nz.reflow(F.array("t"), 5)) == ["<SOS> t1 t2 t3 <ELB>", "<SLB> t4 t5 t6 <ELB>", "<SLB> t7 t8 t9 <EOS>"]
    assert one("", nz.reflow(F.array("t"), 5)) == ["<SOS> <EOS>"]
    assert one("ab c", t.inner_ngrams(F.col("t"), 2, 3)) == [" a", "ab", "b ", " ab", "ab ", " c", "c ", " c "]
    assert one("@bob don’t see www.x.y…", nz.normal_tweet(F.col("t"))) == "@USER do n't see HTTPURL"
    assert one("<p>a &amp; b<script>x</script></p>", nz.from_html(F.col("t"))) == "a & b"
    assert one("Éa ﬁ", nz.without_accents(F.col("t"))) == "Ea fi"
    assert one("He left. Dr. Who?  Yes\nno", nz.sentence_split(F.col("t"))) == ["He left.", "Dr. Who?", "Yes", "no"]
    assert one("I can't go.", nz.tokenize(F.col("t"), "treebank")) == ["I", "ca", "n't", "go", "."]


def test_losses_and_gates(spark):
    from pyspark.sql import functions as F

    from stilus.operators import pairs as p

    df = spark.createDataFrame([(0.2, 1), (0.9, 1), (2.0, 0), (1.0, 0)], "s double, same int")
    assert [round(r[0], 6) for r in df.select(m.two_margin_loss(F.col("s"), F.col("same"))).collect()] == [0.09, 0.0, 0.25, 0.0]
    assert [round(r[0], 6) for r in df.select(m.contrastive_loss(F.lit(3.0), F.col("s"), F.col("same"))).collect()] == [4.5, 4.5, 0.0, 0.0]
    aa = spark.createDataFrame([(1, i, "short") for i in range(10)] + [(2, 99, "x" * 60)], AA)
    assert p.gated(aa.where("seq < 5 OR author = 2")).count() == 1
    _fails(p.gated(aa), "loses more than 9")
    gold = spark.createDataFrame([("a", 1), ("b", 0)], "id string, truth int")
    answers = spark.createDataFrame([("a", 0.9)], "id string, value double")
    assert ev.pan_evaluation(gold, answers, "id", "truth", "value").first()["auc"] == 1.0
    with pytest.raises(Exception, match="without a gold pair"):
        ev.pan_evaluation(gold, answers.unionByName(spark.createDataFrame([("z", 0.1)], "id string, value double")), "id", "truth", "value")
    _fails(c.apply_labels_strict(aa, spark.createDataFrame([(1, 0)], "author int, new_id long")), "no label for author")


def test_finalized_set(spark, tmp_path):
    from stilus.operators import finalize as z

    rows = lambda base, k: spark.createDataFrame([(a, base + 10 * a + i, f"{base} text {a} {i}") for a in range(4) for i in range(k)], AA)
    parts = {"train": rows(0, 4), "val": rows(1000, 2), "test": rows(2000, 3), "cross_topic_val": rows(3000, 2), "cross_topic_test": rows(4000, 2), "unique_val": rows(5000, 2), "unique_test": rows(6000, 0)}
    path = str(tmp_path / "set")
    stats = {r["metric"]: r["value"] for r in z.finalize(parts, path, "x").collect()}
    assert stats["train number of documents"] == 16 and stats["aa_test median docs per author"] == 3 and stats["av_val number positive pairs"] == 8
    assert readers.read_aa(spark, f"{path}/x_train.csv").count() == 16 and readers.read_av(spark, f"{path}/x_AV_cross_topic_test.csv").count() == 16
    assert (tmp_path / "set/x_stats.json").exists() and (tmp_path / "set/x_cross_topic_stats.json").exists() and (tmp_path / "set/x_AV_unique_val.csv").exists()
    assert not (tmp_path / "set/x_AV_unique_test.csv").exists() and not (tmp_path / "set/x_AA_unique_val.csv").exists()
    with pytest.raises(FileExistsError):
        z.finalize(parts, path, "x")
    av = readers.read_av(spark, f"{path}/x_AV_val.csv")
    assert z.label_values(av).first()["ok"] and z.same_texts(parts["val"], av).count() == 0
    assert not z.author_count(parts["train"], 5).first()["ok"] and z.same_rows(parts["train"], parts["val"]).first()["ok"] is False


def test_stream_scores(spark, tmp_path):
    from stilus.streaming.scoring import stream_word_counts

    src, out = tmp_path / "in", tmp_path / "out"
    spark.createDataFrame([(1, "a b"), (2, None)], "row_id long, text string").write.parquet(str(src))
    q = stream_word_counts(spark, str(src), str(out), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.read.parquet(str(out)).collect())) == [(1, 2), (2, 0)]


def test_stream_posts(spark, tmp_path):
    from stilus.streaming.scoring import stream_daily_words, stream_unique_posts

    src = str(tmp_path / "posts")
    days = ["2020-01-01 10:00:00", "2020-01-02 09:00:00", "2020-01-02 10:00:00", "2020-06-01 00:00:00", "2020-12-01 00:00:00"]
    for i, (post, day) in enumerate(zip((1, 2, 1, 3, 4), days)):
        row = spark.sql(f"SELECT {post}L AS post_id, 1 AS author_id, 'x' AS post_date, 'two words' AS text, TIMESTAMP_NTZ '{day}' AS loaded_at")
        row.coalesce(1).write.mode("append").parquet(src)
    stream_unique_posts(spark, src, str(tmp_path / "once"), str(tmp_path / "c1"), 1).awaitTermination(120)
    assert sorted(r["post_id"] for r in spark.read.parquet(str(tmp_path / "once")).collect()) == [1, 2, 3, 4]
    stream_daily_words(spark, src, str(tmp_path / "days"), str(tmp_path / "c2"), 1).awaitTermination(120)
    got = {str(r["day"])[:10]: (r["n_posts"], r["n_words"]) for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert got["2020-01-01"] == (1, 2) and got["2020-01-02"] == (2, 4) and "2020-12-01" not in got


def test_model_files_and_sweep(spark, tmp_path):
    from stilus.operators import models as mo

    df = spark.createDataFrame([(i, [float(i % 2), float(i)], i % 2) for i in range(40)], "id int, features array<double>, same int")
    model = mo.verification_model(df)
    mo.save_model(model, str(tmp_path / "model"))
    a, b = (mo.verification_scores(x, df, ["id"]).collect() for x in (model, mo.load_model(str(tmp_path / "model"))))
    assert a == b and all((r["score"] > 0.5) == (r["id"] % 2 == 1) for r in a)
    found = mo.sweep({"x": [1, 2, 3], "y": [0, 1]}, lambda x, y: {"accuracy": x - y})
    assert found[0] == {"x": 3, "y": 0, "accuracy": 3} and len(found) == 6


def test_ngram_classifier_and_vote(spark):
    from stilus.operators import models as mo

    rows = [(i, i % 2, ("abab abba baab " if i % 2 else "xyxy yxxy xyyx ") * 5) for i in range(24)]
    df = spark.createDataFrame(rows, "id int, label int, text string")
    p = mo.ngram_attribution(df.where("id < 16"), df.where("id >= 16"), "id", "label", "text", "char", 1, 2, 50, iterations=10)
    assert {r["id"]: r["candidate"] for r in mo.best_candidate(p, "id").collect()} == {i: i % 2 for i in range(16, 24)}
    assert {r["id"]: r["candidate"] for r in ev.soft_vote([p, p], "id", "candidate", "probability").collect()} == {i: i % 2 for i in range(16, 24)}


def test_named_functions_and_routes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0.0, 3.0], [4.0, 0.0], "CDs_and_Vinyl_5.json")], "a array<double>, b array<double>, f string")
    r = df.select(m.similarity(F.col("a"), F.col("b"), "manhattan", "negated").alias("x"), c.route_by_name("f", {"cross": ["CDs", "Beauty"]}, "iid").alias("p")).first()
    assert (r["x"], r["p"]) == (-7.0, "cross")
    with pytest.raises(ValueError):
        m.similarity(F.col("a"), F.col("b"), "no such")
