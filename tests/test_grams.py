"""n-gram models: counts in numpy against the column expressions, the vote against `soft_vote`."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stilus.functions import grams as g
from stilus.functions import text as t
from stilus.operators import evaluation as ev
from stilus.operators import models as mo

ODD = [
    "Call 0123 456 now: it's 9 o'clock", "one \ntwo \t three\n\nfour \n \n", r"see https:\\a.b/c and https:\x https: https://y", "", None, " ", "a", "aa", "é" * 3 + " naïve été", "１２ x² Ⅷ ⅷv _a_ b_c a-b",
    "😀😀 a😀b ok", "日本語 テキスト ภาษาไทย हिन्दी", "nul\x00in \x85 \x1c gap here there", "ab ab ab ab. AB ab",
]
OLD = {
    "char": lambda c: t.ngrams_between(F.filter(F.split(t.normal_base(c), ""), lambda x: x != ""), 1, 3, ""),
    "dist_char": lambda c: t.ngrams_between(F.filter(F.split(t.distort(c), ""), lambda x: x != ""), 1, 3, ""),
    "word": lambda c: t.ngrams_between(t.word_tokens(t.only_words(c)), 1, 3, " "),
}


def test_counts_are_those_of_the_columns(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ODD * 2)], "k int, text string").repartition(3)
    got = g.gram_counts(df, "text", list(OLD), 1, 3, g.word_classes(spark)).collect()
    for kind, old in OLD.items():
        want = {(r["gram"], r["n"], r["n_docs"]) for r in t.ngram_counts(df, old(F.coalesce("text", F.lit(""))), "k").collect()}
        assert {(r["gram"], r["n"], r["n_docs"]) for r in got if r["kind"] == kind} == want and len(want) > 20


def test_counts_over_a_vocabulary(spark, monkeypatch):
    classes, texts = g.word_classes(spark), pa.array(ODD)
    for kind, joiner in g.KINDS.items():
        whole = [x for grams, *_ in g.count(g.symbols(texts, [kind], classes)[0], len(ODD), 1, 3, joiner) for x in grams]
        some = sorted(whole)[::3]
        words = g.Vocabulary([x.split(joiner) if joiner else list(x) for x in some])
        for size in (g.SLICE, 7, 40):  # the result doesn't depend on how many texts are looked at together
            monkeypatch.setattr(g, "SLICE", size)
            (counts,) = g.counts(texts, [kind], [words], classes)
            for i, x in enumerate(ODD):
                own = {y: n for grams, ns, _ in g.count(g.symbols(pa.array([x], pa.string()), [kind], classes)[0], 1, 1, 3, joiner) for y, n in zip(grams, ns)}
                assert counts[i].tolist() == [own.get(y, 0) for y in some]
        assert (g.unpacked(g.packed(counts), words.width) == counts).all()
    assert g.counts(pa.array([], pa.string()), ["char"], [g.Vocabulary([["a"]])], None)[0].shape == (0, 1)
    assert np.isfinite(g.weights(counts, np.ones(words.width), 5)).all()


def test_no_vector_is_gathered_by_shuffle(spark):
    rows = [(i, 7 + i % 3, ("abab abba baab ", "xyxy yxxy xyyx ", "mnop ponm ")[i % 3] * 5) for i in range(30)]
    df = spark.createDataFrame([*rows, (30, 7, None), (31, None, "abab")], "id int, label int, text string")
    train, test = df.where("id < 18 OR id = 31"), df.where("id >= 18 AND id < 31")
    p = mo.ngram_attribution(train, test, "id", "label", "text", "char", 1, 2, 50, iterations=10)
    # each text's weights were gathered as a list of rows: that took more than the memory of an executor
    assert "collect_list" not in p._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["candidate"] for r in mo.best_candidate(p, "id").where("id < 30").collect()} == {i: 7 + i % 3 for i in range(18, 30)}
    kinds = ["char", "word"]
    voted = mo.ngram_vote(mo.ngram_models(train, "label", "text", kinds, 1, 2, 50, iterations=10), test, "id", "text")
    parts = [p if k == "char" else mo.ngram_attribution(train, test, "id", "label", "text", k, 1, 2, 50, iterations=10) for k in kinds]
    want = {r["id"]: r for r in ev.soft_vote(parts, "id", "candidate", "probability").collect()}
    got = {r["id"]: r for r in voted.collect()}
    assert got.keys() == want.keys() and len(got) == 13
    assert all(got[i]["candidate"] == want[i]["candidate"] and abs(got[i]["score"] - want[i]["probability"]) < 1e-6 for i in got)


def test_a_lone_candidate_is_certain(spark):
    df = spark.createDataFrame([(i, 3, "ab ba") for i in range(4)], "id int, label int, text string")
    p = mo.ngram_attribution(df, df, "id", "label", "text", "char", 1, 1, 5, iterations=2).collect()
    assert [(r["candidate"], r["probability"]) for r in p] == [(3, 1.0)] * 4
