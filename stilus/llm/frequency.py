"""How often every term occurs and in how many records (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.functions.text import array_counts

#: Ids held by several rows are sent to every task up to this many; beyond it they are joined by shuffle.
MAX_SENT = 1_000_000


def term_counts(records: DataFrame) -> DataFrame:
    """(term, n) of each distinct element of each array `s`, counted within its row; null and empty
    elements aren't terms."""
    return array_counts(records, [], F.filter("s", lambda t: t.isNotNull() & (t.cast("string") != "")))


def records_of(df: DataFrame, key: str, terms: str) -> tuple[DataFrame, int]:
    """(records, number): one non-null array `s` per id; where repeats differ, the smallest array.

    Ids are counted without their arrays; only rows of ids held by several rows are brought together."""
    rows = df.where(F.col(terms).isNotNull()).select(F.col(key).alias("k"), F.col(terms).alias("s"))
    ids = rows.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    number, repeated = ids.agg(F.count(F.lit(1)), F.count_if(F.col("c") > 1)).first()
    if not repeated:
        return rows.select("s"), number
    many = ids.where("c > 1").select(F.col("k").alias("m"), F.lit(True).alias("many"))
    marked = rows.join(F.broadcast(many) if repeated <= MAX_SENT else many, F.col("k").eqNullSafe(F.col("m")), "left")
    again = marked.where("many").groupBy("k").agg(F.min("s").alias("s")).select("s")
    return marked.where("many IS NULL").select("s").unionByName(again), number


def term_frequencies(df: DataFrame, key: str, terms: str, min_records: int = 3, max_share: float = 0.3) -> DataFrame:
    """(field, term, occurrences, records, mark) of every distinct term of the array column `terms`.

    mark: `rare` if fewer than min_records records hold the term, `common` if more than max_share
    of the records whose array isn't null do, else null. Rows repeating an id count as one record.

    Each record gives its terms with their counts, where it is read; these are combined by hash within
    each task, and one (term, occurrences, records) per term and task is shuffled.
    Null and empty elements aren't terms; null arrays aren't records, empty ones are; null ids are
    one id. A term both rare and common (a tiny table) is `rare`. An empty table gives no row.
    """
    records, number = records_of(df, key, terms)
    counts = term_counts(records).groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.lit(max_share * number), "common")
    return counts.select(F.lit(terms).alias("field"), F.col("term").cast("string").alias("term"), "occurrences", "records", mark.alias("mark"))
