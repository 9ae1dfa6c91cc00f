import random

import pytest

from stilus.operators import scoring as m
from stilus.operators import windows as w


def _brute(rows, order):
    out = {}
    for a, t in rows:
        for i in range(len(t or "")):
            for k in range(min(i, order) + 1):
                key = a, k, t[i - k : i], t[i]
                out[key] = out.get(key, 0) + 1
    return out


def _rows(seed):
    g = random.Random(seed)
    text = lambda s: "".join(g.choice(s) for _ in range(g.randrange(0, 60)))
    many = [chr(c) for c in range(0x4E00, 0x4E00 + 1500)]
    rows = [(g.choice(["A", "B", None]), text("abcé 😀\0d")) for _ in range(60)] + [("C", None), ("C", ""), ("D", "".join(many)), ("D", "".join(many[:30]))]
    return rows + [(g.choice("EF"), text(many)) for _ in range(120)]


@pytest.mark.parametrize("held", [w.HELD, 100])
def test_context_counts_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(w, "HELD", held)
    rows = _rows(3)
    df = spark.createDataFrame(rows, "author string, text string").repartition(2)
    got = {(r["author"], r["k"], r["ctx"], r["ch"]): r["n"] for r in m.ppm_counts(df, "author", "text").collect()}
    assert got == _brute(rows, 5)


def test_counts_are_added_up_before_contexts_are_made(spark):
    # a row for each character under each of its contexts was made before anything was added up
    df = spark.createDataFrame([("A", "abab")], "author string, text string")
    plan = m.ppm_counts(df, "author", "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning", plan.index("Generate")) < plan.index("MapInPandas")


def test_negated_model_is_counted_once(spark):
    from stilus.plans import features

    plan = features.ppm_negate_order5(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "FileScan" in plan  # counted before and read twice


@pytest.mark.parametrize("held", [w.HELD, 100])
def test_context_sizes_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(w, "HELD", held)
    rows = [(a and ord(a), t) for a, t in _rows(4)]
    df = spark.createDataFrame(rows, "author int, text string").repartition(3)
    want = {}
    for (a, k, _, _), n in _brute(rows, 5).items():
        if a is not None:
            e, total = want.get((a, k), (0, 0))
            want[a, k] = e + 1, total + n
    assert {(r["c"], r["k"]): (r["n_entries"], r["n"]) for r in w.context_sizes(df, "author", "text", 5).collect()} == want


def test_texts_and_not_entries_are_shuffled_for_author_models(spark):
    from stilus.plans import more_eval

    plan = more_eval.ppm_author_models(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("MapInPandas") < plan.index("Exchange")


def test_pair_bits_against_brute_force():
    from stilus.operators import ppm
    from test_core import _bits

    g = random.Random(1)
    for alphabet in ("ab", "abcé 😀d\0", "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))):
        text = lambda: "".join(g.choice(alphabet) for _ in range(g.randrange(0, 90)))  # noqa: B023, E731
        x = [text() for _ in range(150)]
        y = [t[:40] + text() if i < 50 else text() for i, t in enumerate(x)]
        for a, b, d1, d2 in zip(x, y, *ppm.pair_bits(x, y)):
            if not a or not b:
                assert d1 != d1 and d2 != d2
            else:
                assert abs(d1 - _bits([a], b)) < 1e-9 and abs(d2 - _bits([b], a)) < 1e-9


def test_a_pair_costs_no_sort_of_all_its_contexts():
    # each pair took about seven sorts or searches of all contexts of both texts
    import time

    from stilus.operators import ppm

    g = random.Random(2)
    word = ["".join(g.choice("abcdefghijkl") for _ in range(g.randrange(2, 9))) for _ in range(3000)]
    x, y = ([" ".join(g.choice(word) for _ in range(70)) for _ in range(500)] for _ in range(2))
    began = time.process_time()
    ppm.pair_bits(x, y)
    cost = time.process_time() - began
    began = time.process_time()
    for texts in (x, y):
        for h in ppm.positions(texts)[2:4]:
            h.argsort()
    assert cost < 2 * (time.process_time() - began)


def test_scales_are_added_up_by_batch(spark):
    import statistics

    from stilus.functions import features as f

    g = random.Random(5)
    rows = [(i, [0.1, g.random(), -3.0 * g.random()]) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, v array<double>").repartition(7)
    scales = f.column_scales(df, "v")
    got = {r["i"]: r for r in scales.collect()}
    for k in range(3):
        x = [v[k] for _, v in rows]
        assert abs(got[k]["mean"] - statistics.fmean(x)) < 1e-12 and abs(got[k]["std"] - statistics.pstdev(x)) < 1e-9 and got[k]["max_abs"] == max(map(abs, x))
    assert got[0]["std"] == 0.0
    # a row for each place of each vector was made before
    assert "Generate" not in scales._jdf.queryExecution().executedPlan().toString()


def test_length_of_a_vector_is_taken_once(spark):
    from pyspark.sql import functions as F

    from stilus.functions import text as t
    from stilus.operators import models as mo

    df = spark.createDataFrame([(1, "ab cd"), (2, "ab ef")], "k int, text string")
    out = mo.ngram_features(df, df, "k", "text", t.words(F.col("text")), 10, 0.1)
    assert all(abs(sum(x * x for x in r["features"]) - 1) < 1e-12 for r in out.collect())
    # the optimiser had put the sum of squares inside the division of each of its elements
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_ppm_scores_shuffle_texts_alone(spark):
    """Neither model entries nor documents are repeated in a shuffle (F3)."""
    from stilus.plans import more_eval

    plan = more_eval.ppm_cross_entropy(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [x for x in plan.splitlines() if "Exchange" in x]
    assert len(shuffles) == 2 and "Explode" not in plan and "seen" not in plan


def test_ppm_models_in_pieces(spark, monkeypatch):
    """Authors cut over several pieces and blocks, documents over several pieces and groups."""
    import random

    from stilus.operators import ppm

    g = random.Random(3)
    text = lambda most: "".join(g.choice("abcde f") for _ in range(g.randrange(1, most)))
    train = spark.createDataFrame([(a, text(40)) for a in range(30) for _ in range(40 if a == 7 else 2)] + [(99, ""), (98, None)], "author int, text string")
    docs = spark.createDataFrame([(i, text(50)) for i in range(60)], "doc int, text string")
    scores = lambda: {(r["doc"], r["author"]): round(r["bits"], 9) for r in ppm.ppm_scores(docs, "doc", "text", train, "author", "text").collect()}
    whole = scores()
    assert len(whole) == 1800
    for name, value in {"PIECE": 90, "DOCUMENT_PIECE": 200, "DOCUMENTS": 25, "CANDIDATES": 3, "GROUPS": 1, "_ROWS": 4, "_CELLS": 50, "_SLAB": 3}.items():
        monkeypatch.setattr(ppm, name, value)
    assert scores() == whole


def test_ppm_attribution_keeps_no_scores(spark, monkeypatch):
    """The same as `attribute` of all scores, equal models and a single candidate included; no score is written (F2)."""
    from stilus.operators import ppm
    from stilus.plans import more_eval

    written = []
    monkeypatch.setattr(more_eval, "materialize", lambda df, name: written.append(name) or df)
    more_eval.ppm_attribution(spark, "/root/testdata/sf0.001")
    assert not written
    texts = ["the cat sat", "a dog ran off", "the cat sat", "some words", "a dog ran off", "birds", "the cat sat"]
    train = spark.createDataFrame([(f"a{i}", t) for i, t in enumerate(texts)], "author string, text string")
    docs = spark.createDataFrame([(1, "the cat ran"), (2, "a dog"), (3, "§§"), (4, "birds sat"), (5, "")], "doc int, text string")
    monkeypatch.setattr(ppm, "CANDIDATES", 2)
    monkeypatch.setattr(ppm, "PIECE", 12)
    for own in (train, train.where("author = 'a1'"), train.where("author < 'a2'")):
        args = docs, "doc", "text", own, "author", "text"
        rows = lambda df: sorted(map(tuple, df.collect()))
        assert rows(ppm.ppm_attribution(*args)) == rows(ppm.attribute(ppm.ppm_scores(*args), "doc", "author", "bits"))
