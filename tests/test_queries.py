"""Every core query with a SQL twin gives the twin's rows on the smallest tables."""

import pytest

import oracle
from stilus.plans import corpus, features, more_corpus, more_eval, more_text, skew

FOLDER = "/root/testdata/sf0.001"
ALL = {k: (q, m.ORACLE.get(k)) for m in (skew, corpus, features, more_text, more_corpus, more_eval) for k, q in m.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ALL.items() if sql))
def test_twin(spark, name):
    q, sql = ALL[name]
    assert oracle.differences(spark, FOLDER, q, sql) == ""


@pytest.mark.parametrize("name", sorted(k for k, (_, sql) in ALL.items() if not sql))
def test_runs(spark, name):
    assert ALL[name][0](spark, FOLDER).count() > 0
