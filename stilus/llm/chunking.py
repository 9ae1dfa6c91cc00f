"""Cutting long texts at natural boundaries (problem 4), by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2560, 200
#: Repeated (key, digest) are sent to every task up to this many; beyond it they are joined by shuffle.
MAX_SENT = 500_000
#: Boundaries by falling strength; a cut lies at the end of the match.
_BOUNDARIES = tuple(re.compile(p) for p in (r"\n[ \t\r]*\n\s*", r"\r?\n\s*", r"[.!?…。]+[\"'”’»)\]]*\s+", r"[,;:—–]\s+", r"\s+"))


def _cut(text: str, lo: int, hi: int) -> int:
    """Where to halve text[lo:hi]: the strongest boundary in its middle half, nearest the midpoint."""
    mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
    left, right = mid - reach, mid + reach
    for boundary in _BOUNDARIES:
        best = -1
        for m in boundary.finditer(text, left, right):
            if left < m.end() < right or (m.end() == right and right < hi):
                if best < 0 or abs(m.end() - mid) < abs(best - mid):
                    best = m.end()
                elif m.end() > mid:
                    break
        if best > lo:
            return best
    at = mid
    while at > left and (unicodedata.combining(text[at]) or text[at] == "\u200d" or text[at - 1] == "\u200d"):
        at -= 1  # never between a letter and its accent
    return at if at > left else mid


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece: text[core:end] are consecutive and cover the text, and
    text[start:core] repeats up to `overlap` characters from the end of the piece before."""
    if len(text) <= limit:
        return [(0, 0, len(text))]
    if not 0 <= overlap < limit:
        raise ValueError("overlap lies between 0 and limit")
    room, stack, cores = limit - overlap, [(0, len(text))], []
    while stack:
        lo, hi = stack.pop()
        if hi - lo <= room:
            cores.append((lo, hi))
        else:
            at = _cut(text, lo, hi)
            stack += [(at, hi), (lo, at)]
    out = [(0, *cores[0])]
    for lo, hi in cores[1:]:
        start = max(lo - overlap, out[-1][0])
        if overlap and start > out[-1][0] and not text[start - 1].isspace():
            word = re.search(r"\s+", text[start:lo])  # begin with a whole word where there is one
            start = start + word.end() if word and start + word.end() < lo else start
        out.append((start, lo, hi))
    return out


def one_of_each(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Of the rows with the same key and text one. Texts are compared by digest, and only those that
    repeat are brought together."""
    marked = rows.withColumn("__d", F.md5(F.col(text)))
    again = marked.groupBy(key, "__d").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col(key).alias("__k"), F.col("__d").alias("__e"), F.lit(True).alias("__again"))
    n = again.count()
    if not n:
        return rows
    joined = marked.join(F.broadcast(again) if n <= MAX_SENT else again, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__d") == F.col("__e")), "left")
    return joined.where("__again IS NULL").select(*rows.columns).unionByName(joined.where("__again").select(*rows.columns).distinct())


def split_long_texts(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece: key, piece_no INT from 1, n_pieces INT, overlap_chars INT, piece STRING.

    Texts of at most `limit` characters (code points) come out whole as one piece and never leave
    the JVM. Null: no row; the empty text: one empty piece; a text without any boundary is cut
    between characters. Rows of the same key and text come out once. Extra columns are ignored.
    """
    rows = one_of_each(texts.select(F.col(key), F.col(text).alias("__t")).where(F.col("__t").isNotNull()), key, "__t")
    schema = f"`{key}` {dict(rows.dtypes)[key]}, piece_no int, n_pieces int, overlap_chars int, piece string"
    short = rows.where(F.char_length("__t") <= limit).select(key, F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("overlap_chars"), F.col("__t").alias("piece"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(k, i, len(cut), core - start, t[start:end]) for k, t in zip(batch[key], batch["__t"]) for cut in [spans(t, limit, overlap)] for i, (start, core, end) in enumerate(cut, 1)]
            yield pd.DataFrame(out, columns=[key, "piece_no", "n_pieces", "overlap_chars", "piece"])

    return rows.where(F.char_length("__t") > limit).mapInPandas(pieces, schema).unionByName(short)
