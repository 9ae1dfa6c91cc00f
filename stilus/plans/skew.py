"""Queries of the skewed-key operators."""

from __future__ import annotations

from stilus.operators.skew import author_profile, dominant_keys
from stilus.session import table


def p2_found(spark, folder):
    return dominant_keys(table(spark, folder, "aa_texts").select("labels", "row_id"), "labels", 0.03, ["row_id"])


def p2_author_profile(spark, folder):
    return author_profile(table(spark, folder, "aa_texts").select("labels", "text", "split"))


QUERIES = {"p2_found": p2_found, "p2_author_profile": p2_author_profile}

_SPLIT = """CAST(sum(CASE WHEN split = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS "rows_{s}",
 count(DISTINCT CASE WHEN split = '{s}' THEN text END) AS "texts_{s}",
 CAST(sum(CASE WHEN split = '{s}' THEN words ELSE 0 END) AS BIGINT) AS "words_{s}\""""

ORACLE = {
    "p2_found": "SELECT labels FROM aa_texts WHERE labels IS NOT NULL GROUP BY labels HAVING count(*) >= 0.03 * (SELECT count(*) FROM aa_texts WHERE labels IS NOT NULL)",
    "p2_author_profile": "WITH t AS (SELECT labels, split, text, coalesce(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 0) AS words FROM aa_texts WHERE labels IS NOT NULL) SELECT labels, count(*) AS n_rows, count(DISTINCT text) AS n_texts, CAST(sum(words) AS BIGINT) AS n_words, "
    + ", ".join(_SPLIT.format(s=s) for s in ("train", "AA_val", "AA_test", "cross_topic_test"))
    + " FROM t GROUP BY labels",
}
