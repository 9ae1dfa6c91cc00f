"""One consistent form for texts that look the same (problem 3).

Look-alikes are mapped in SQL, the mapped values are grouped under the accent-sensitive, case-
sensitive Unicode collation (which also holds composed and combining accents equal), each class
takes one of its members as its canonical form, and that member is joined back.

Collation keys are several times as long as the text, so only texts that can have a partner get
one: texts are first blocked by a hash of their plain ASCII part. Equal collation implies an equal
block, so no pair is lost; a block whose texts are all the same has nothing to unify. Texts go by
their digests throughout: whole texts are shuffled only where a block has several, once each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stilus.llm.lookalike import visible_column
from stilus.session import materialize, spread

COLLATION = "UNICODE"
#: Digests are sent to every task up to this many; beyond it they are joined by shuffle.
MAX_SENT = 500_000
#: Ids of a spelling expanded by one row of work at most.
EXPAND = 1000


def _digest(text):
    return F.unhex(F.md5(text))


def classes(texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(members, spellings): members (id, d) of all distinct (key, digest of text), written; spellings
    (d, text, canonical, look) of every text whose look-alike class has several: its class's canonical
    member and a hash that names the class, written.

    canonical is the member with the fewest bytes, the first in binary order of those. Null texts have
    no row; the empty text and texts of invisible characters only are one class. Repeated rows come out
    once; extra columns are ignored; an empty table gives none.
    """
    spark = texts.sparkSession
    rows = spread(texts.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text")))
    plain = F.regexp_replace(visible_column(F.col("text")), r"[ -~]?\p{M}+|[^ -~]+", "")
    members = materialize(rows.select("id", _digest(F.col("text")).alias("d"), F.xxhash64(plain).alias("block")), "looks")
    blocks = members.groupBy("block").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo <> hi").select("block")
    few = materialize(members.join(blocks, "block", "left_semi").select("d").distinct(), "several")
    sent = F.broadcast(few) if few.count() <= MAX_SENT else few
    own = rows.select("text", _digest(F.col("text")).alias("d")).join(sent, "d", "left_semi").groupBy("d").agg(F.first("text").alias("text"))
    looks = materialize(own, "spellings").withColumn("look", F.collate(visible_column(F.col("text")), COLLATION))
    unified = spark.sql(
        """
        WITH class AS (
            SELECT look, min_by(text, struct(octet_length(text), text)) AS canonical
            FROM {looks} GROUP BY look HAVING count(*) > 1
        )
        SELECT s.d, s.text, c.canonical, xxhash64(c.canonical, octet_length(c.canonical)) AS look FROM {looks} s JOIN class c ON s.look = c.look
        """,
        looks=looks,
    )
    return members.select("id", "d").distinct(), materialize(unified, "unified")


def same_look_pairs(texts: DataFrame, key: str, text: str, a: str, b: str) -> DataFrame:
    """Pairs of ids, the smaller first, whose texts differ as stored but look the same.

    Spellings of a class are paired by digest; a spelling's ids are cut into sets of about EXPAND, and
    two spellings are expanded by one row of work per two sets."""
    members, spellings = classes(texts, key, text)
    own = members.join(spellings.select("d"), "d")
    size = own.groupBy("d").agg(F.ceil(F.count(F.lit(1)) / EXPAND).cast("int").alias("sets"))
    sets = own.join(size, "d").groupBy("d", F.pmod(F.xxhash64("id"), F.col("sets")).cast("int").alias("set")).agg(F.collect_list("id").alias("ids"))
    spelled = spellings.select("look", "d").join(sets, "d")
    left = spelled.select("look", F.col("d").alias("d0"), F.col("set").alias("s0"), F.col("ids").alias("xs"))
    right = spelled.select("look", F.col("d").alias("d1"), F.col("set").alias("s1"), F.col("ids").alias("ys"))
    work = left.join(right, "look").where("d0 < d1").repartition("d0", "s0", "d1", "s1")
    pairs = work.select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y")).where("x <> y")
    return pairs.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b)).distinct()


def canonicalize(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, canonical_text) of every row: texts that look the same get the same canonical_text.

    Null stays null. Rows repeated in full stay repeated. The canonical members are joined by digest,
    and sent to every task while they are few."""
    _, spellings = classes(texts, key, text)
    unified = spellings.where("text <> canonical").select(F.col("d").alias("__d"), "canonical")
    rows = texts.select(F.col(key), F.col(text)).withColumn("__d", _digest(F.col(text)))
    few = unified.agg(F.sum(F.octet_length("canonical"))).first()[0] or 0
    return rows.join(F.broadcast(unified) if few <= 32 << 20 else unified, "__d", "left").select(key, text, F.coalesce("canonical", F.col(text)).alias("canonical_text"))
